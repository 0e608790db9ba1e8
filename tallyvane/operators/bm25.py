"""BM25 as tables: postings, document lengths, term weights; search is a join on the query's terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyvane.functions import fixed as X
from tallyvane.functions.text import tokens
from tallyvane.session import checkpoint, spread


#: Rows of (query, term) that may be broadcast, about 64 bytes each.
BROADCAST_TERMS = 500_000


def index(chunks: DataFrame, key: str = "chunk_id", text: str = "content", order: str = "ord") -> dict[str, DataFrame]:
    """postings(term, chunk_id, ord, dl, tf), idf(term, idf) and stats(n, avgdl).

    The postings are written once (a checkpoint), as weights, lengths and search all read them and tokenising is the
    costly part. A chunk without tokens counts in n and avgdl. Negative weights become epsilon times the mean weight
    of all terms (negatives included).
    """
    texts = spread(chunks.select(F.col(key).alias("chunk_id"), F.col(order).cast("bigint").alias("ord"), F.col(text).alias("text")), "chunk_id")
    base = texts.select("chunk_id", "ord", tokens(F.col("text")).alias("terms")).withColumn("dl", F.size("terms"))
    postings = checkpoint(base.select("chunk_id", "ord", "dl", F.explode("terms").alias("term")).groupBy("term", "chunk_id", "ord", "dl").agg(F.count(F.lit(1)).alias("tf")))
    return derived(postings, chunks)


def derived(postings: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
    """The index tables of postings(term, chunk_id, ord, dl, tf); chunks gives the number of chunks, those without
    tokens included."""
    total = postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("all_tf"))
    stats = chunks.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total)).select("n", (F.col("all_tf") / F.col("n")).alias("avgdl"))  # one row each
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = F.col("n").cast("double")
    raw = df.join(F.broadcast(stats.select("n"))).select("term", (F.log(n - F.col("df") + F.lit(0.5)) - F.log(F.col("df") + F.lit(0.5))).alias("w"))  # one row
    mean = raw.agg(F.avg("w").alias("mean"))
    idf = raw.join(F.broadcast(mean)).select("term", F.when(F.col("w") < 0, F.lit(X.BM25_EPSILON) * F.col("mean")).otherwise(F.col("w")).alias("idf"))  # one row
    return {"postings": postings, "idf": idf, "stats": stats}


def search(queries: DataFrame, ix: dict[str, DataFrame], k: int | None = X.TOP_K, k1: float = X.BM25_K1, b: float = X.BM25_B) -> DataFrame:
    """(query_id, chunk_id, ord, score, rank) of queries(query_id, query): the best k, then positive scores only.

    Ties keep corpus order. A query without known terms has no rows. Only postings of query terms are scored, and
    scores are summed with a map-side combine.
    """
    q = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    # up to BROADCAST_TERMS the query terms go to the postings, which then need no shuffle and know no hot terms;
    # beyond it the postings are joined by term, the same rows either way
    few = q.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    weighted = (F.broadcast(q) if few else q).join(ix["idf"], "term")
    hits = ix["postings"].join(F.broadcast(weighted) if few else weighted, "term").join(F.broadcast(ix["stats"].select("avgdl")))  # one row
    tf, dl = F.col("tf").cast("double"), F.col("dl").cast("double")
    part = F.col("qtf") * F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.col("avgdl")))
    scored = hits.groupBy("query_id", "chunk_id", "ord").agg(F.round(F.sum(part), 9).alias("score"))
    return ranked(scored, k).where("score > 0")


def ranked(scored: DataFrame, k: int | None) -> DataFrame:
    """Adds rank (1 first) per query by score descending, then ord; the best k of each query."""
    out = scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "ord")))
    return out if k is None else out.where(F.col("rank") <= k)


def save(ix: dict[str, DataFrame], folder: str) -> None:
    """Writes the index tables below a folder, replacing earlier ones; postings are clustered by term."""
    ix["postings"].repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/postings")
    ix["idf"].write.mode("overwrite").parquet(f"{folder}/idf")
    ix["stats"].write.mode("overwrite").parquet(f"{folder}/stats")


def load(spark, folder: str) -> dict[str, DataFrame]:
    """The index tables of a folder; FileNotFoundError if it holds none."""
    from pyspark.errors import AnalysisException

    try:
        return {t: spark.read.parquet(f"{folder}/{t}") for t in ("postings", "idf", "stats")}
    except AnalysisException as e:
        raise FileNotFoundError(f"no lexical index in {folder}") from e
