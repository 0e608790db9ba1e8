"""Rank fusion, boosts, filtered and company-balanced retrieval. Ranked lists have query_id, chunk_id, ord, rank."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyvane.functions import fixed as X
from tallyvane.functions import text as T
from tallyvane.session import checkpoint


def rrf(lists: DataFrame, k: int = X.RRF_K) -> DataFrame:
    """Unweighted reciprocal rank fusion of lists(query_id, chunk_id, list_id, rank): (query_id, chunk_id, score)."""
    return lists.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (F.lit(float(k)) + F.col("rank"))), 9).alias("score"))


def pool(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """(query_id, chunk_id, ord, dense_rank, bm25_rank): the union of both lists, one row a chunk.

    A union and one aggregate instead of a full outer join: a single shuffle on (query_id, chunk_id).
    """
    d = dense.select("query_id", "chunk_id", "ord", F.col("rank").alias("dense_rank"), F.lit(None).cast("int").alias("bm25_rank"))
    b = lexical.select("query_id", "chunk_id", "ord", F.lit(None).cast("int").alias("dense_rank"), F.col("rank").alias("bm25_rank"))
    return d.unionByName(b).groupBy("query_id", "chunk_id").agg(F.max("ord").alias("ord"), F.max("dense_rank").alias("dense_rank"), F.max("bm25_rank").alias("bm25_rank"))


def wrrf(candidates: DataFrame, w_dense: str = "w_dense", w_bm25: str = "w_bm25", k: int = X.RRF_K) -> DataFrame:
    """Adds wrrf_score: w_d / (k + dense_rank) + w_b / (k + bm25_rank), a missing rank adds nothing."""
    part = lambda w, r: F.coalesce(F.col(w) / (F.lit(float(k)) + F.col(r)), F.lit(0.0))
    return candidates.withColumn("wrrf_score", F.round(part(w_dense, "dense_rank") + part(w_bm25, "bm25_rank"), 9))


def cut(scored: DataFrame, k: int | None, score: str = "score") -> DataFrame:
    """Adds rank: by score descending, then dense rank, then lexical rank (absent ones last); the best k."""
    out = scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(score), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("bm25_rank"))))
    return out if k is None else out.where(F.col("rank") <= k)


def classified(questions: DataFrame, companies: list[str] | None = None) -> DataFrame:
    """questions(query_id, question) with query_class, w_dense and w_bm25."""
    q = questions.select("query_id", "question").withColumn("query_class", T.query_class(F.col("question"), companies))
    return q.withColumns({"w_dense": T.class_weight(F.col("query_class"), 0), "w_bm25": T.class_weight(F.col("query_class"), 1)})


def classified_by_names(questions: DataFrame, companies: DataFrame, near: int = 80) -> DataFrame:
    """`classified` with the names of a table: two different companies named within `near` characters of each other
    make a cross-company question. With no name in the table the default names are used. Names and
    questions meet by join (see `mentioned_companies`), so there may be any number of names."""
    if companies.where(F.col("company").isNotNull()).select("company").limit(1).count() == 0:
        return classified(questions)
    named = mentioned_companies(questions, companies).where("n_companies >= 2")
    low = questions.select("query_id", F.lower(F.trim(F.coalesce("question", F.lit("")))).alias("q"))
    at = named.join(low, "query_id").withColumn("n", F.lower("company"))
    # every place where a name stands; two names are near if one begins at most `near` characters behind another's end
    spots = at.select("query_id", "n", F.explode(F.filter(F.sequence(F.lit(1), F.length("q")), lambda i: F.substr("q", i, F.length("n")) == F.col("n"))).alias("i")).withColumn("e", F.col("i") + F.length("n"))
    # a question's own places: bounded by its length
    ends = spots.groupBy("query_id").agg(F.collect_set(F.struct("n", "e")).alias("ends"))
    pair = spots.join(ends, "query_id").where(F.exists("ends", lambda x: (x["n"] != F.col("n")) & (x["e"] <= F.col("i")) & (F.col("i") - x["e"] <= near))).select("query_id").distinct().withColumn("pair", F.lit(True))
    q = questions.select("query_id", "question").join(pair, "query_id", "left")
    kind = T.query_class(F.col("question"), [""])
    kind = F.when(F.col("pair"), "cross_company").otherwise(kind)
    q = q.withColumn("query_class", kind).drop("pair")
    return q.withColumns({"w_dense": T.class_weight(F.col("query_class"), 0), "w_bm25": T.class_weight(F.col("query_class"), 1)})


def hybrid(questions: DataFrame, dense: DataFrame, lexical: DataFrame, chunks: DataFrame, k: int | None = X.TOP_K, boosts: bool = True, where: dict[str, object] | None = None, rrf_k: int = X.RRF_K) -> DataFrame:
    """(query_id, chunk_id, dense_rank, bm25_rank, wrrf_score, score, rank).

    questions carry query_class and weights (see `classified`). The metadata filter is applied to the candidate
    pool after its truncation, so it may leave fewer than k rows; comparison is by text and ignores case.
    """
    c = wrrf(pool(dense, lexical).join(questions, "query_id"), k=rrf_k)
    meta = chunks.select("chunk_id", "content", "section", "chunk_type", *[x for x in (where or {}) if x not in ("chunk_type", "section", "content")])
    c = c.join(meta, "chunk_id")
    if boosts:
        c = c.withColumn("score", F.round(F.col("wrrf_score") + T.table_boost(F.col("query_class"), F.col("chunk_type")) + T.domain_boost(F.col("question"), F.col("content"), F.col("section"), F.col("chunk_type")), 9))
    else:
        c = c.withColumn("score", F.col("wrrf_score"))
    for name, v in (where or {}).items():
        c = c.where(F.lower(F.coalesce(F.col(name).cast("string"), F.lit(""))) == str(v).lower())
    return cut(c, k).select("query_id", "chunk_id", "dense_rank", "bm25_rank", "wrrf_score", "score", "rank")


def unclassified(questions: DataFrame) -> DataFrame:
    """Equal weights and the factual class, as when the classifier is off."""
    return questions.select("query_id", "question").withColumns({"query_class": F.lit("factual"), "w_dense": F.lit(0.5), "w_bm25": F.lit(0.5)})


def trace(questions: DataFrame, dense: DataFrame, lexical: DataFrame, chunks: DataFrame, k: int = X.TOP_K, rrf_k: int = X.RRF_K) -> DataFrame:
    """Like `hybrid` with the table boost only, keeping every candidate: final_rank is null beyond k."""
    c = wrrf(pool(dense, lexical).join(questions, "query_id"), k=rrf_k).join(chunks.select("chunk_id", "chunk_type"), "chunk_id")
    c = c.withColumn("boosted_score", F.round(F.col("wrrf_score") + T.table_boost(F.col("query_class"), F.col("chunk_type")), 9))
    c = cut(c, None, "boosted_score")
    return c.select("query_id", "chunk_id", "dense_rank", "bm25_rank", "wrrf_score", "boosted_score", F.when(F.col("rank") <= k, F.col("rank")).alias("final_rank"))


def balanced(ranking: DataFrame, companies: DataFrame, k: int, per_company: int, deep: int) -> DataFrame:
    """A retriever's list for cross-company queries: its best k, then each mentioned company's best not yet in it.

    ranking is the deep ranking (rank up to at least `depth` of each query), with the chunk's company;
    companies(query_id, company, company_no, n_companies) are the mentioned ones, in order. Within
    depth = min(k * n * 4, limit) a company's first `per_company` hits count, those already in the list included.
    """
    depth = F.least(F.lit(deep) * F.col("n_companies") * 4, F.lit(X.DEPTH_LIMIT))
    head = ranking.where(F.col("rank") <= k).select("query_id", "chunk_id", "ord", "rank")
    length = head.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_head"))
    mine = ranking.join(companies.select("query_id", "company", "company_no", "n_companies"), ["query_id", "company"]).where(F.col("rank") <= depth)
    mine = mine.withColumn("at", F.row_number().over(W.partitionBy("query_id", "company").orderBy("rank"))).where((F.col("at") <= per_company) & (F.col("rank") > k))
    more = mine.join(length, "query_id", "left").withColumn("rank", (F.coalesce("n_head", F.lit(0)) + F.row_number().over(W.partitionBy("query_id").orderBy("company_no", F.col("rank")))).cast("int"))
    return head.unionByName(more.select("query_id", "chunk_id", "ord", "rank"))


def cross_company(questions: DataFrame, dense: DataFrame, lexical: DataFrame, companies: DataFrame, chunks: DataFrame, k: int = X.TOP_K, per_company: int = X.COMPANY_TOP_K, dense_k: int = X.TOP_K, bm25_k: int = X.TOP_K, rrf_k: int = X.RRF_K) -> DataFrame:
    """Company-balanced fusion with the table boost only; dense and lexical are deep rankings (see `balanced`)."""
    meta = chunks.select("chunk_id", F.col("company"), "chunk_type")
    d = balanced(dense.join(meta.select("chunk_id", "company"), "chunk_id"), companies, dense_k, per_company, dense_k)
    b = balanced(lexical.join(meta.select("chunk_id", "company"), "chunk_id"), companies, bm25_k, per_company, dense_k)
    c = wrrf(pool(d, b).join(questions, "query_id"), k=rrf_k).join(meta.select("chunk_id", "chunk_type"), "chunk_id")
    c = c.withColumn("score", F.round(F.col("wrrf_score") + T.table_boost(F.lit("cross_company"), F.col("chunk_type")), 9))
    return cut(c, k).select("query_id", "chunk_id", "dense_rank", "bm25_rank", "wrrf_score", "score", "rank")


def mentioned_companies(questions: DataFrame, companies: DataFrame) -> DataFrame:
    """(query_id, company, company_no, n_companies): companies whose name occurs in the question, ignoring case,
    numbered in order of name.

    A name lies somewhere in the question, so it begins with one of the question's substrings of its first three
    characters: names and questions meet by these (shorter names by themselves), and containment is then checked. No
    name passes the driver, and there may be any number of them.
    """
    names = companies.where(F.col("company").isNotNull()).select("company").distinct().withColumn("low", F.lower("company")).where(F.length("low") > 0)
    names = names.withColumn("g", F.substring("low", 1, 3))
    q = questions.select("query_id", F.lower(F.coalesce("question", F.lit(""))).alias("q"))
    at = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("q") - n + 1, F.lit(1))), lambda i: F.substr("q", i, F.lit(n)))
    grams = q.select("query_id", "q", F.explode(F.array_distinct(F.concat(at(1), at(2), at(3)))).alias("g"))
    hit = grams.join(names, "g").where(F.col("q").contains(F.col("low"))).select("query_id", "company").distinct()
    w = W.partitionBy("query_id")
    return hit.select("query_id", "company", F.row_number().over(w.orderBy("company")).cast("int").alias("company_no"), F.count(F.lit(1)).over(w).cast("int").alias("n_companies"))


def adaptive(questions: DataFrame, companies: DataFrame, dense: Callable[[DataFrame, int], DataFrame], lexical: Callable[[DataFrame, int], DataFrame], chunks: DataFrame, k: int = X.TOP_K, dense_k: int = X.TOP_K, bm25_k: int = X.TOP_K, where: dict[str, object] | None = None, classify: Callable[[DataFrame], DataFrame] | None = None, rrf_k: int = X.RRF_K) -> DataFrame:
    """The adaptive entry: questions of the cross-company class that name two of `companies` or more are answered
    company by company, all others by the classified hybrid. dense and lexical give the best n of questions."""
    q = (classify or classified)(questions)
    named = checkpoint(mentioned_companies(q.where("query_class = 'cross_company'"), companies).where("n_companies >= 2"))
    most = named.agg(F.max("n_companies")).first()[0]
    if not most:
        return hybrid(q, dense(q, dense_k), lexical(q, bm25_k), chunks, k, where=where, rrf_k=rrf_k)
    ids = named.select("query_id").distinct()
    many, few = q.join(ids, "query_id", "left_semi"), q.join(ids, "query_id", "left_anti")
    deep = min(dense_k * most * 4, X.DEPTH_LIMIT)
    x = cross_company(many, checkpoint(dense(many, deep)), checkpoint(lexical(many, deep)), named, chunks, k, dense_k=dense_k, bm25_k=bm25_k, rrf_k=rrf_k)
    return hybrid(few, dense(few, dense_k), lexical(few, bm25_k), chunks, k, where=where, rrf_k=rrf_k).unionByName(x)
