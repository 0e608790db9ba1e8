"""Documents to elements: binary files through a pluggable page parser, and JSON-lines interchange of chunks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ELEMENT = (
    "element_type string, content string, grid array<array<string>>, image_path string, page int, company string, document string, year int, section string, caption string, description string, "
    "bbox struct<x0: double, y0: double, x1: double, y1: double>, page_area double, seq int"
)
CHUNK = "chunk_id string, chunk_type string, content string, company string, document string, year int, page int, section string, caption string, raw_table array<array<string>>"
_NAMES = [c.strip().split(" ", 1)[0] for c in ELEMENT.split(", ") if not c.startswith(("y0:", "x1:", "y1:"))]


class PageParser(Protocol):
    """Yields a file's elements page by page (tables, then text, then figures) as dicts of ELEMENT's fields, and `word`
    rows for captions if it knows where words stand."""

    def __call__(self, content: bytes) -> Iterable[dict]: ...


def plain_text_parser(content: bytes) -> Iterator[dict]:
    """The offline stand-in: form feeds part pages, blank lines part blocks, lines with tabs are tables."""
    for no, page in enumerate(content.decode("utf-8", "replace").split("\f"), 1):
        blocks = [b.strip("\n") for b in page.split("\n\n") if b.strip()]
        for b in blocks:
            if "\t" in b:
                grid = [[c.strip() for c in r.split("\t")] for r in b.split("\n")]
                if len(grid) >= 2:
                    yield {"element_type": "table", "grid": grid, "page": no}
        for b in blocks:
            if "\t" not in b and len(b.strip()) >= 10:
                yield {"element_type": "text", "content": b, "page": no}


def missing_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest documents without a file in files(filename)."""
    return manifest.join(files.select("filename").distinct(), "filename", "left_anti")


def source_files(spark: SparkSession, folder: str) -> DataFrame:
    """(filename) of the files below a folder, contents unread."""
    return spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("filename"))


def read_documents(spark: SparkSession, folder: str, manifest: DataFrame, parser: PageParser = plain_text_parser) -> DataFrame:
    """Elements of every manifest file below a folder; files are read and parsed where they lie, missing ones
    skipped (see `missing_files`)."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content")
    meta = manifest.select("filename", F.col("company").alias("m_company"), F.col("year").alias("m_year"), F.col("document").alias("m_document"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                known = {"company": r.m_company, "year": r.m_year, "document": r.m_document}
                for seq, e in enumerate(parser(bytes(r.content))):
                    rows.append([known[n] if n in known else seq if n == "seq" else e.get(n) for n in _NAMES])
            yield pd.DataFrame(rows, columns=_NAMES)

    return files.join(meta, "filename").mapInPandas(run, ELEMENT)


def write_chunks_json(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines, replacing what is there."""
    names = [c.strip().split(" ", 1)[0] for c in CHUNK.split(", ")]
    chunks.select(*[c for c in names if c in chunks.columns]).write.mode("overwrite").json(path)


def read_chunks_json(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of JSON lines; unknown keys are dropped, missing ones are null."""
    return spark.read.schema(CHUNK).json(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks as Parquet, one folder a chunk_type, so that a text-only corpus prunes the rest."""
    chunks.write.mode("overwrite").partitionBy("chunk_type").parquet(path)


def figure_name() -> Column:
    """A unique file name of a figure: company, year, page and a hash of document and box."""
    box = F.xxhash64("document", "page", "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1")
    return F.concat_ws("_", F.regexp_replace(F.coalesce("company", F.lit("none")), r"[^\p{L}\p{N}]+", "-"), F.coalesce(F.col("year").cast("string"), F.lit("0")), F.concat(F.lit("p"), F.coalesce(F.col("page").cast("string"), F.lit("0"))), F.lower(F.hex(box)))


def save_figures(figures: DataFrame, folder: str, image: str = "image") -> DataFrame:
    """Writes the PNG bytes of column `image` below a folder (any file system URI) where they lie, and returns the
    rows with image_path instead. Rows without bytes get no path; writing again replaces the same file."""
    keep = [c for c in figures.columns if c not in (image, "image_path")]
    named = figures.select(*keep, F.col(image).alias("__image"), figure_name().alias("__name"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in figures.select(*keep).schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        filesystem, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        filesystem.create_dir(root, recursive=True)
        for pdf in batches:
            paths = []
            for name, data in zip(pdf["__name"], pdf["__image"]):
                if data is None:
                    paths.append(None)
                    continue
                with filesystem.open_output_stream(f"{root}/{name}.png") as out:
                    out.write(bytes(data))
                paths.append(f"{folder}/{name}.png")
            yield pdf.drop(columns=["__image", "__name"]).assign(image_path=pd.Series(paths, dtype="object", index=pdf.index))

    return named.mapInPandas(run, f"{schema}, image_path string")
