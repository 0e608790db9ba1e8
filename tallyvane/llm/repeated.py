"""Lines repeated across one company's documents.

Every line's documents are kept as a compressed bitmap: documents are numbered densely within their company, and
of a bitmap only the non-empty 64-bit words are stored (company, line, word number, word). Words are OR-ed, first
per variant of a line and then over the variants that agree in their letters; both are aggregates with a map-side
combine of 8 bytes, so a line found in a third of all documents never meets in one task. A line's cardinality is
the sum of its words' bit counts. What is to go from an element is a bitmap of its line numbers, and the text is
rebuilt by looking each line up in it.

Defined results: elements without content, document or company give nothing; an element delivered twice counts
once (its latest delivery); lines without letters are no case; line numbers count all lines, blank ones included;
documents and lines are told apart by hashes of 96 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvane.session import checkpoint, dense_index


def line_letters(line: Column) -> Column:
    """Lower case, letters only: lines equal in this are the same line."""
    return F.regexp_replace(F.lower(line), r"[^\p{L}]+", "")


def latest(df: DataFrame, key: str, at: str) -> DataFrame:
    """One delivery of each key: the latest; all its columns are kept. Rows without key stay out."""
    cols = [c for c in df.columns if c != key]
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*cols), F.coalesce(F.col(at).cast("double"), F.lit(-1e18))).alias("__r"))
    return best.select(key, *[F.col(f"__r.{c}").alias(c) for c in cols])


def current(elements: DataFrame, key: str = "element_id", text: str = "content", at: str = "ingested_at", most: int = 100_000) -> DataFrame:
    """The elements without deliveries whose text differs from that of the latest. Deliveries mostly agree, so only the
    elements whose deliveries differ are looked up; up to `most` of them without a shuffle of the texts."""
    if at not in elements.columns:
        return elements
    h = F.xxhash64(text)
    last = elements.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.max_by(h, F.coalesce(F.col(at).cast("double"), F.lit(-1e18))).alias("__h"), (F.min(h) != F.max(h)).alias("__differ")).where("__differ").drop("__differ")
    last = checkpoint(last)
    last = F.broadcast(last) if last.limit(most + 1).count() <= most else last
    return elements.join(last, F.col(key) == F.col("__k"), "left").where(F.col("__h").isNull() | (F.col("__h") == h)).drop("__k", "__h")


def element_lines(elements: DataFrame) -> DataFrame:
    """(element_id, document, line_no, line, key) of text elements' lines with letters, one row a line."""
    split = F.posexplode(F.split("content", r"\r?\n"))
    rows = elements.where("element_type = 'text' and content is not null and document is not null and element_id is not null")
    return rows.select("element_id", "document", split.alias("line_no", "line")).withColumn("key", line_letters(F.col("line"))).where("key <> ''")


def hashed_lines(elements: DataFrame, min_lines: int) -> DataFrame:
    """(element_id, line_no, d1, d2, k1, k2, variant) of the lines whose letters occur at least `min_lines` times.

    Document, letters and printed form are kept as hashes (96 bits for what is joined), and lines too rare to be a
    case anywhere are dropped before anything else is joined: their number is known from one pre-aggregated count.
    """
    h = element_lines(elements).select("element_id", F.col("line_no").cast("int").alias("line_no"), F.xxhash64("document").alias("d1"), F.hash("document").alias("d2"), F.xxhash64("key").alias("k1"), F.hash("key").alias("k2"), F.xxhash64("line").alias("variant"))
    often = h.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_lines).select("k1", "k2")
    return h.join(often, ["k1", "k2"], "left_semi")


def line_bitmaps(lines: DataFrame, numbered: DataFrame) -> DataFrame:
    """(company, k1, k2, word_no, word): the OR of all variants' bitmaps, non-empty words only."""
    at = lines.join(numbered, ["d1", "d2"]).select("company", "k1", "k2", "variant", F.floor(F.col("doc_no") / 64).cast("bigint").alias("word_no"), F.expr("shiftleft(1L, cast(doc_no % 64 as int))").alias("bit"))
    variants = at.groupBy("company", "k1", "k2", "variant", "word_no").agg(F.bit_or("bit").alias("word"))
    return variants.groupBy("company", "k1", "k2", "word_no").agg(F.bit_or("word").alias("word"))


def repeated_lines(elements: DataFrame, manifest: DataFrame, min_docs: int = 4, min_share: float = 0.4) -> DataFrame:
    """(element_id, line_no) of every line that occurs in at least `min_docs` distinct documents of its company
    and in at least `min_share` of the company's documents that occur in `elements`."""
    elements = current(elements)
    docs = elements.where("document is not null").select("document").distinct().join(manifest.where("company is not null").groupBy("document").agg(F.first("company").alias("company")), "document")
    numbered = dense_index(docs, ["company"], ["document"], "doc_no").select(F.xxhash64("document").alias("d1"), F.hash("document").alias("d2"), "company", "doc_no")
    sizes = docs.groupBy("company").agg(F.count(F.lit(1)).alias("n_docs"))
    lines = checkpoint(hashed_lines(elements, min_docs))
    maps = line_bitmaps(lines, numbered)
    counts = maps.groupBy("company", "k1", "k2").agg(F.sum(F.bit_count("word")).alias("n"))
    # 1e-9: a share that is exact in decimals must not fail by a rounding of the product
    cases = counts.where(F.col("n") >= min_docs).join(sizes, "company").where(F.col("n") >= F.col("n_docs") * min_share - 1e-9).select("company", "k1", "k2")
    keyed = lines.join(numbered.select("d1", "d2", "company"), ["d1", "d2"]).select("element_id", "line_no", "company", "k1", "k2")
    return keyed.join(cases, ["company", "k1", "k2"], "left_semi").select("element_id", F.col("line_no").cast("bigint").alias("line_no")).distinct()


def without_lines(elements: DataFrame, found: DataFrame, key: str = "element_id", text: str = "content") -> DataFrame:
    """The elements with the found lines deleted from `text`; remaining lines are joined by a line feed.

    Elements without a found line keep their text unchanged.
    """
    words = found.groupBy(F.col(key).alias("__k"), F.floor(F.col("line_no") / 64).cast("bigint").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(line_no % 64 as int))")).alias("b"))
    gone = words.groupBy("__k").agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("__gone"))
    set_ = lambda i: F.getbit(F.coalesce(F.try_element_at("__gone", F.floor(i / 64).cast("bigint")), F.lit(0).cast("bigint")), (i % 64).cast("int")) == 1
    kept = F.array_join(F.filter(F.split(text, r"\r?\n"), lambda x, i: ~set_(i)), "\n")
    return elements.join(gone, F.col(key) == F.col("__k"), "left").withColumn(text, F.when(F.col("__gone").isNotNull() & F.col(text).isNotNull(), kept).otherwise(F.col(text))).drop("__k", "__gone")
