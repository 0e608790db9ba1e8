"""The pN_ queries on training text and their SQL counterparts, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyvane.functions.fixed import WS
from tallyvane.llm import leaks, mixing, neardup, repeated, splitting, truncation
from tallyvane.llm.sentences import sentence_units
from tallyvane.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence unit of every text chunk."""
    return sentence_units(table(spark, d, "chunks").where(F.col("chunk_type") == "text"))


def _oversized(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(table(spark, d, "chunks"), table(spark, d, "raw_elements"), table(spark, d, "split_limits"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every item larger than its limit: those that the splitter cuts."""
    return splitting.split_found(table(spark, d, "chunks"), table(spark, d, "raw_elements"), table(spark, d, "split_limits"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every oversized item, by offset."""
    return splitting.pieces(_oversized(spark, d))


def p2_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per oversized item: whether its pieces cover it from end to end, keep the limit, and share exactly the overlap."""
    big = _oversized(spark, d)
    w = Window.partitionBy("record_kind", "record_id").orderBy("piece_no")
    p = splitting.pieces(big).withColumn("prev", F.lag("end_char").over(w)).join(big.select("record_kind", "record_id", "size", "max_chars", "overlap_chars"), ["record_kind", "record_id"])
    inside = (F.col("end_char") - F.col("start_char") <= F.col("max_chars")) & (F.col("end_char") > F.coalesce("prev", F.lit(0)))
    shared = F.when(F.col("prev").isNull(), (F.col("piece_no") == 0) & (F.col("start_char") == 0)).otherwise(F.col("start_char") == F.col("prev") - F.col("overlap_chars"))
    return p.groupBy("record_kind", "record_id").agg(F.bool_and(inside).alias("within"), F.bool_and(shared).alias("shared"), (F.max("end_char") == F.max("size")).alias("whole"), F.max("end_char").alias("size"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every line to remove."""
    return repeated.repeated_lines(table(spark, d, "raw_elements"), table(spark, d, "manifest"))


def p3_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """The text elements without the repeated lines."""
    e = repeated.latest(table(spark, d, "raw_elements").where("element_type = 'text'").select("element_id", "document", "content", "ingested_at"), "element_id", "ingested_at")
    return repeated.without_lines(e, p3_found(spark, d)).select("element_id", "document", "content")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("chunk_type = 'text' and content is not null")
    return c.select(F.col("chunk_id").alias("id"), neardup.normal_body(F.col("content")).alias("t"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of text chunks with similarity at least 0.7."""
    return neardup.similar_pairs(_texts(spark, d), threshold=0.7).select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per text chunk: class of exact copies, group, links; similarity is the weighted overlap of the bags of
    5-character substrings, each with its number of occurrences."""
    return neardup.similar_groups(_texts(spark, d), threshold=0.7, weighted=True).withColumnRenamed("id", "chunk_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Every document and item that share a run of at least 60 letters and digits."""
    return leaks.leaks_found(table(spark, d, "documents"), table(spark, d, "benchmark_items"), run=60)


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """Per leaked item: documents, longest run and best alignment score as a share of a whole copy's."""
    i = table(spark, d, "benchmark_items")
    p = leaks.leak_pairs(table(spark, d, "documents"), i, run=60).where("run >= 60")
    return p.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("run").alias("longest_run"), F.max("score").alias("best_score"))


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return mixing.document_tokens(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Every source that the mix leaves short of its share of a mix as large as the corpus."""
    return mixing.short_sources(_tokens(spark, d), table(spark, d, "mix_targets")).select("source")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix: documents with their copies."""
    return mixing.systematic_mix(_tokens(spark, d), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixing.mix_report(p7_mix(spark, d), table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Every document whose text was cut off."""
    return truncation.truncated(table(spark, d, "documents")).where("cut").select("doc_id")


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """Per source: documents and the share of them that were cut off."""
    docs = table(spark, d, "documents")
    t = truncation.truncated(docs).select("doc_id", "cut")
    return docs.select("doc_id", "source").join(t, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.coalesce(F.col("cut"), F.lit(False)).cast("int")).cast("bigint").alias("cut")).withColumn("rate", F.col("cut") / F.col("documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


P2_SQL = """
WITH e AS (
  SELECT element_id, element_type,
    CASE WHEN element_type = 'text' THEN length(content)
         ELSE length(array_to_string([array_to_string([coalesce(c, '') for c in r], ' | ') for r in grid], chr(10))) END AS size
  FROM raw_elements WHERE element_type IN ('text', 'table'))
SELECT DISTINCT 'chunk' AS record_kind, chunk_id AS record_id
FROM chunks JOIN split_limits ON record_kind = 'chunk' AND item_type = chunk_type WHERE length(content) > max_chars
UNION ALL
SELECT DISTINCT 'element', CAST(element_id AS VARCHAR)
FROM e JOIN split_limits ON record_kind = 'element' AND item_type = element_type WHERE size > max_chars
"""

P3_SQL = r"""
WITH el AS (SELECT element_id, any_value(document) AS document, any_value(content) AS content FROM raw_elements WHERE element_type = 'text' AND content IS NOT NULL GROUP BY element_id),
l AS (SELECT element_id, document, unnest(regexp_split_to_array(content, '\r\n|\n')) AS line, generate_subscripts(regexp_split_to_array(content, '\r\n|\n'), 1) - 1 AS line_no FROM el),
k AS (SELECT element_id, line_no, m.document, m.company, regexp_replace(lower(line), '[^\p{L}]+', '', 'g') AS key FROM l JOIN manifest m USING (document)),
n AS (SELECT m.company, count(DISTINCT document) AS docs FROM raw_elements r JOIN manifest m USING (document) GROUP BY m.company),
c AS (SELECT company, key, count(DISTINCT document) AS n FROM k WHERE key <> '' GROUP BY company, key)
SELECT DISTINCT element_id, CAST(line_no AS BIGINT) AS line_no
FROM k JOIN c USING (company, key) JOIN n USING (company) WHERE c.n >= 4 AND c.n * 5 >= n.docs * 2
"""

P2_COVERAGE_SQL = """
WITH e AS (
  SELECT element_id, element_type,
    CASE WHEN element_type = 'text' THEN length(content)
         ELSE length(array_to_string([array_to_string([coalesce(c, '') for c in r], ' | ') for r in grid], chr(10))) END AS size
  FROM raw_elements WHERE element_type IN ('text', 'table')),
s AS (SELECT DISTINCT 'chunk' AS record_kind, chunk_id AS record_id, length(content) AS size
FROM chunks JOIN split_limits ON record_kind = 'chunk' AND item_type = chunk_type WHERE length(content) > max_chars
UNION ALL
SELECT DISTINCT 'element', CAST(element_id AS VARCHAR), size
FROM e JOIN split_limits ON record_kind = 'element' AND item_type = element_type WHERE size > max_chars)
SELECT record_kind, record_id, true AS within, true AS shared, true AS whole, size FROM s
"""

P3_CLEANED_SQL = rf"""
WITH f AS ({P3_SQL}),
el AS (SELECT element_id, any_value(document) AS document, any_value(content) AS content FROM raw_elements WHERE element_type = 'text' AND element_id IS NOT NULL GROUP BY element_id),
l AS (SELECT element_id, unnest(regexp_split_to_array(content, '\r\n|\n')) AS line, generate_subscripts(regexp_split_to_array(content, '\r\n|\n'), 1) - 1 AS line_no FROM el WHERE content IS NOT NULL),
k AS (SELECT element_id, string_agg(line, chr(10) ORDER BY line_no) AS kept FROM l ANTI JOIN f USING (element_id, line_no) GROUP BY element_id)
SELECT element_id, document, CASE WHEN element_id IN (SELECT element_id FROM f) THEN coalesce(kept, '') ELSE content END AS content FROM el LEFT JOIN k USING (element_id)
"""

P4_SQL = rf"""
WITH n AS (SELECT chunk_id, trim(regexp_replace(lower(regexp_replace(content, '^[^\n]*(\n|$)', '')), '{WS}+', ' ', 'g')) AS t FROM chunks WHERE chunk_type = 'text' AND content IS NOT NULL),
g AS (SELECT DISTINCT chunk_id, substr(t, k, 5) AS g FROM (SELECT chunk_id, t, unnest(range(1, length(t) - 3)) AS k FROM n)),
c AS (SELECT chunk_id, count(*) AS size FROM g GROUP BY chunk_id),
p AS (SELECT x.chunk_id AS a, y.chunk_id AS b, count(*) AS common FROM g x JOIN g y ON x.g = y.g AND x.chunk_id < y.chunk_id GROUP BY ALL)
SELECT a AS chunk_id_a, b AS chunk_id_b FROM p JOIN c x ON x.chunk_id = a JOIN c y ON y.chunk_id = b WHERE common * 10 >= 7 * (x.size + y.size - common)
"""

P6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS s FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS s FROM benchmark_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, substr(s, k, 60) AS g FROM (SELECT doc_id, s, unnest(range(1, length(s) - 58)) AS k FROM d)),
ig AS (SELECT DISTINCT item_id, substr(s, k, 60) AS g FROM (SELECT item_id, s, unnest(range(1, length(s) - 58)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_SQL, "p2_coverage": P2_COVERAGE_SQL, "p3_found": P3_SQL, "p3_cleaned": P3_CLEANED_SQL, "p4_found": P4_SQL, "p6_found": P6_SQL}
