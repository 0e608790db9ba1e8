"""Exact inner-product search over an embeddings table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvane.functions import fixed as X
from tallyvane.operators.bm25 import ranked

#: Bytes of query vectors in one block; a single block is broadcast, several are met with parts of the corpus.
BLOCK_BYTES = 32 << 20


def l2_normalize(v: Column) -> Column:
    """Unit length, as float; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: (x / norm).cast("float"))).otherwise(v)


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def search(queries: DataFrame, corpus: DataFrame, k: int = X.TOP_K) -> DataFrame:
    """(query_id, chunk_id, ord, score, rank): the best k of corpus(chunk_id, ord, embedding) for each of
    queries(query_id, embedding). Ties keep corpus order; null vectors are left out.

    Query vectors are dealt to blocks of at most BLOCK_BYTES. A single block (its size is known) is broadcast and meets
    every corpus batch; several blocks and the parts of the corpus meet by shuffle, each pair as one group, and no query
    passes the driver. Each meeting is one matrix product that keeps its own best k per query, so k rows a query and
    batch are shuffled for the final ranking. The rows are the same either way.
    """
    q = queries.where(F.col("embedding").isNotNull()).select(F.col("query_id").cast("bigint"), "embedding")
    head = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    c = corpus.where(F.col("embedding").isNotNull()).select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("ord").cast("bigint").alias("ord"), "embedding")
    schema = "query_id bigint, chunk_id string, ord bigint, score double"
    blocks = max(1, -(-head.n * (head.d or 1) * 8 // BLOCK_BYTES))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["query_id"].notna()], pdf[pdf["query_id"].isna()]
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "chunk_id": pd.Series([], dtype="object"), "ord": np.zeros(0, np.int64), "score": np.zeros(0)})
        return _best(left["query_id"].to_numpy().astype(np.int64), np.stack(left["embedding"].to_numpy()).astype(np.float64), right, k)

    if blocks == 1:
        # one block: bounded by BLOCK_BYTES, so it may travel with the tasks
        part = q.toPandas()
        if not len(part):
            return ranked(q.sparkSession.createDataFrame([], schema), k)
        shared = q.sparkSession.sparkContext.broadcast((part["query_id"].to_numpy(), np.stack(part["embedding"].to_numpy()).astype(np.float64)))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, m = shared.value
            for pdf in batches:
                if len(pdf):
                    yield _best(ids, m, pdf, k)

        found = c.mapInPandas(scan, schema)
    else:
        # many blocks: queries by block, the corpus by part; each (block, part) is a group of bounded size
        parts = max(1, c.rdd.getNumPartitions())
        left = q.select("query_id", F.lit(None).cast("string").alias("chunk_id"), F.lit(None).cast("bigint").alias("ord"), "embedding", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"))
        right = c.select(F.lit(None).cast("bigint").alias("query_id"), "chunk_id", "ord", "embedding", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.pmod(F.xxhash64("ord"), F.lit(parts)).cast("int").alias("p"))
        found = left.unionByName(right).groupBy("b", "p").applyInPandas(run, schema)
    return ranked(found.select("query_id", "chunk_id", "ord", F.round("score", 9).alias("score")), k)


def _best(ids: np.ndarray, m: np.ndarray, pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best k of a batch for each query, ties of the last place included."""
    ords, names = pdf["ord"].to_numpy(), pdf["chunk_id"].to_numpy()
    s = np.round(m @ np.stack(pdf["embedding"].to_numpy()).astype(np.float64).T, 9)
    n = min(k, len(pdf))
    best = np.argpartition(-s, n - 1, axis=1)[:, :n]
    low = np.take_along_axis(s, best, 1).min(axis=1)
    r, j = np.nonzero(s >= low[:, None])
    return pd.DataFrame({"query_id": ids[r], "chunk_id": pd.Series(names[j], dtype="object"), "ord": ords[j].astype(np.int64), "score": s[r, j]})


def hashed_encoder(dim: int = X.ENCODER_DIM, prefix: str = "") -> Callable[[Column], Column]:
    """The offline stand-in for a neural encoder: signed hashes of tokens (of the first three hex digits of their md5),
    summed per dimension, unit length. A text without tokens has the zero vector."""
    from tallyvane.functions.text import tokens

    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<float>")
    def fold(hashes: pd.Series) -> pd.Series:
        out = []
        for h in hashes:
            h = np.asarray(h if h is not None else [], dtype=np.int64)
            v = np.bincount((h >> 4) % dim, np.where(h % 2 == 0, 1.0, -1.0), dim)
            out.append((v / (np.sqrt((v * v).sum()) or 1.0)).astype(np.float32))
        return pd.Series(out)

    def encode(text: Column) -> Column:
        return fold(F.transform(tokens(F.concat(F.lit(prefix), F.coalesce(text, F.lit("")))), lambda w: F.conv(F.substring(F.md5(w), 1, 3), 16, 10).cast("int")))

    return encode


def save(embeddings: DataFrame, folder: str) -> None:
    embeddings.write.mode("overwrite").parquet(f"{folder}/embeddings")


def load(spark, folder: str) -> DataFrame:
    """The embeddings table of a folder; FileNotFoundError if there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{folder}/embeddings")
    except AnalysisException as e:
        raise FileNotFoundError(f"no embeddings in {folder}") from e
