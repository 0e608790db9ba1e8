"""Retrieval quality: gold labels, recall, precision, NDCG, MRR, means and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvane.functions import fixed as X


def gold_labels(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id): chunks of the question's company (ignoring case) on one of its evidence pages.

    A null company or page, and an empty page list, label nothing.
    """
    pages = questions.where(F.col("company").isNotNull()).select("query_id", F.lower("company").alias("c"), F.explode("evidence_pages").alias("p")).distinct()
    return pages.join(chunks.select("chunk_id", F.lower("company").alias("c"), F.col("page").alias("p")), ["c", "p"]).select("query_id", "chunk_id").distinct()


def relevance(ranking: DataFrame, gold: DataFrame) -> DataFrame:
    """The ranking with rel, 1 for a gold chunk and 0 otherwise."""
    g = gold.select("query_id", "chunk_id").distinct().withColumn("rel", F.lit(1))
    return ranking.join(g, ["query_id", "chunk_id"], "left").fillna(0, ["rel"])


def retrieval_metrics(queries: DataFrame, ranking: DataFrame, gold: DataFrame, ks: list[int] | None = None, group: tuple[str, ...] = ()) -> DataFrame:
    """One row for each of queries(query_id) (and group columns of the ranking): recall, precision and NDCG at
    each k, and MRR. Precision divides by k always; without gold every metric is 0."""
    ks = ks or X.METRIC_KS
    by = ["query_id", *group]
    n_gold = gold.select("query_id", "chunk_id").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"))
    r = relevance(ranking, gold).groupBy(*by).agg(
        *[F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0)).alias(f"hit_{k}") for k in ks],
        *[F.sum(F.when(F.col("rank") <= k, F.col("rel") / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"dcg_{k}") for k in ks],
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first_hit"),
    )
    base = queries.select("query_id").distinct()
    if group:
        base = base.join(F.broadcast(ranking.select(*group).distinct()))  # configurations: a handful by construction
    j = base.join(r, by, "left").join(n_gold, "query_id", "left").fillna(0)

    def ideal(k: int) -> Column:
        terms = F.lit(0.0)
        for i in range(1, k + 1):
            terms = terms + F.when(F.col("n_gold") >= i, 1.0 / F.log2(F.lit(i + 1.0))).otherwise(0.0)
        return terms

    some = F.col("n_gold") > 0
    out = [F.when(some, F.col(f"hit_{k}") / F.col("n_gold")).otherwise(0.0).alias(f"recall_{k}") for k in ks]
    out += [F.when(some, F.col(f"hit_{k}") / F.lit(float(k))).otherwise(0.0).alias(f"precision_{k}") for k in ks]
    out += [F.when(some, F.col(f"dcg_{k}") / ideal(k)).otherwise(0.0).alias(f"ndcg_{k}") for k in ks]
    out.append(F.when(some & (F.col("first_hit") > 0), 1.0 / F.col("first_hit")).otherwise(0.0).alias("mrr"))
    return j.select(*by, *out)


def mean_metrics(per_query: DataFrame, by: list[str]) -> DataFrame:
    """Means of all metric columns to 4 decimals; nulls are skipped."""
    names = [c for c, t in per_query.dtypes if c not in (*by, "query_id") and t in ("double", "float", "int", "bigint")]
    return per_query.groupBy(*by).agg(*[F.round(F.avg(c), 4).alias(c) for c in names])


def cited_page(citation: Column) -> Column:
    """The page of a citation given as text: 'page 12', 'p. 12', else its first whole number; null if none."""
    worded = F.regexp_extract(citation, r"(?i)(?:page|p\.)\s*(\d+)", 1)
    first = F.regexp_extract(citation, r"\b(\d+)\b", 1)
    return F.coalesce(F.nullif(worded, F.lit("")), F.nullif(first, F.lit(""))).cast("int")


def citation_page(citation: Column) -> Column:
    """The page of a citation given as text, as a whole number in text, or as JSON with page or page_number (whose
    value is read the same way)."""
    page = F.coalesce(F.get_json_object(citation, "$.page"), F.get_json_object(citation, "$.page_number"))
    return F.when(F.trim(citation).startswith("{"), cited_page(page)).otherwise(cited_page(citation))


def citation_accuracy(citations: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, accuracy): the share of citations(query_id, page) on an evidence page; 0 without either."""
    gold = questions.select("query_id", F.explode("evidence_pages").alias("page")).distinct().withColumn("ok", F.lit(1.0))
    some = questions.select("query_id", (F.size(F.coalesce("evidence_pages", F.array().cast("array<int>"))) > 0).alias("has_pages"))
    hit = citations.join(gold, ["query_id", "page"], "left").groupBy("query_id").agg(F.avg(F.coalesce("ok", F.lit(0.0))).alias("share"))
    return some.join(hit, "query_id", "left").select("query_id", F.when(F.col("has_pages"), F.coalesce("share", F.lit(0.0))).otherwise(0.0).alias("accuracy"))
