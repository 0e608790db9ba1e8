"""Configuration: YAML file to a frozen object of the settings that have an effect, and the document manifest."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvane.functions import fixed as X

MANIFEST = "company string, year int, type string, filename string, url string, sec_cik string, sha256 string, notes string"


@dataclass(frozen=True)
class Config:
    """Live settings; others of a file are ignored. Missing ones take these defaults."""

    text_max_words: int = X.MAX_WORDS
    text_overlap_words: int = X.OVERLAP_WORDS
    table_max_words: int = X.TABLE_MAX_WORDS
    dense_top_k: int = X.TOP_K
    bm25_top_k: int = X.TOP_K
    rrf_k: int = X.RRF_K
    rerank_top_k: int = X.RERANK_TOP_K
    bm25_k1: float = X.BM25_K1
    bm25_b: float = X.BM25_B
    evidence_threshold: float = 0.0
    tolerance: float = X.TOLERANCE
    require_context: bool = True
    data_dir: str = "data"
    documents: tuple[dict[str, Any], ...] = field(default=())


#: Where each setting stands in a file.
_PATHS = {
    "text_max_words": ("chunking", "text", "max_tokens"), "text_overlap_words": ("chunking", "text", "overlap_tokens"), "table_max_words": ("chunking", "table", "max_tokens"),
    "dense_top_k": ("retrieval", "dense_top_k"), "bm25_top_k": ("retrieval", "bm25_top_k"), "rrf_k": ("retrieval", "rrf_k"), "rerank_top_k": ("reranker", "top_k"),
    "bm25_k1": ("bm25", "k1"), "bm25_b": ("bm25", "b"), "evidence_threshold": ("generation", "evidence_threshold"), "data_dir": ("paths", "data_dir"), "require_context": ("verification", "require_context"),
}


def from_mapping(raw: dict[str, Any]) -> Config:
    out: dict[str, Any] = {}
    for name, path in _PATHS.items():
        at: Any = raw
        for p in path:
            at = at.get(p) if isinstance(at, dict) else None
        if at is not None:
            out[name] = at
    return Config(**out, documents=tuple(raw.get("documents") or ()))


def load_config(path: str) -> Config:
    """Reads a YAML file; an empty file gives the defaults."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return from_mapping(yaml.safe_load(f) or {})


def manifest(spark: SparkSession, config: Config) -> DataFrame:
    """The configured documents with their label "company type year"."""
    names = [x.split()[0] for x in MANIFEST.split(", ")]
    rows = [tuple(int(x[n]) if n == "year" and x.get(n) is not None else x.get(n) for n in names) for x in config.documents]
    return spark.createDataFrame(rows, MANIFEST).withColumn("document", F.concat_ws(" ", "company", "type", F.col("year").cast("string")))


def setting_names() -> list[str]:
    return [f.name for f in fields(Config)]
