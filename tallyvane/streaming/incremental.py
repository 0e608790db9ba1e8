"""New chunks as a stream: appended to the chunk and postings tables batch by batch; statistics stay derived.

A chunk may come again in a later batch: its latest batch counts, and the postings of earlier ones are left out when the
index is read. Texts are tokenised once, in their batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyvane.functions.text import tokens
from tallyvane.operators.bm25 import derived


def chunk_postings(chunks: DataFrame) -> DataFrame:
    """(chunk_id, ord, dl, term, tf) of chunks."""
    base = chunks.select("chunk_id", F.col("ord").cast("bigint").alias("ord"), tokens(F.col("content")).alias("terms")).withColumn("dl", F.size("terms"))
    return base.select("chunk_id", "ord", "dl", F.explode("terms").alias("term")).groupBy("chunk_id", "ord", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def ingest(spark: SparkSession, source: str, target: str, schema, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Streams Parquet chunk files of `source` into target/chunks and target/postings.

    A batch writes its own subfolder (batch=N), so a batch that is repeated after a failure replaces what its
    first attempt wrote.
    """

    def put(batch: DataFrame, no: int) -> None:
        batch = batch.dropDuplicates(["chunk_id"]).persist()
        batch.write.mode("overwrite").parquet(f"{target}/chunks/batch={no}")
        chunk_postings(batch).write.mode("overwrite").parquet(f"{target}/postings/batch={no}")
        batch.unpersist()

    w = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="30 seconds")).start()


def current_index(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    """The lexical index over all batches, from the postings as written: document frequencies, weights and lengths are
    views over them."""
    owner = current_chunks(spark, target).select("chunk_id", "batch")
    postings = spark.read.parquet(f"{target}/postings").join(owner, ["chunk_id", "batch"], "left_semi").drop("batch")
    return derived(postings, owner)


def current_chunks(spark: SparkSession, target: str) -> DataFrame:
    """Every chunk of all batches once, as its latest batch has it."""
    chunks = spark.read.parquet(f"{target}/chunks")
    latest = chunks.groupBy("chunk_id").agg(F.max("batch").alias("batch"))
    return chunks.join(latest, ["chunk_id", "batch"], "left_semi")


def windowed_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Tumbling-window counts by key with a watermark; works on batch and streaming input alike."""
    e = events.withColumn("__t", F.col(ts).cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("__t", late)
    w = e.groupBy(F.window("__t", size), key).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("window_start"), key, "n")
