"""Session settings and table access shared by all operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 8, name: str = "tallyvane", **conf: str) -> SparkSession:
    """A local session for tests and bench; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table of a data directory (a Parquet file or folder)."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that all executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``. Where that is unset a temporary folder is
    used on a single machine (``local``); on a cluster it is an error, as executors would not share the folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), f"tallyvane-{uuid.uuid4().hex}"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables in the shared folder, compressed by columns, for as long as one computation needs them: `keep` writes a
    table and reads it back (cutting the lineage as a checkpoint does), `drop` deletes one, `close` all that are left."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.kept = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        path, self.kept = f"{self.folder}/{self.kept}", self.kept + 1
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            self._delete(path)

    def close(self) -> None:
        self._delete(self.folder)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """A Scratch that is emptied at the end. Meanwhile each execution's shuffle files go when it ends, not when the
    driver happens to collect its garbage: only for executions whose results are kept, none is executed twice."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, s = spark.conf.get(key, None), Scratch(spark)
    spark.conf.set(key, "true")
    try:
        yield s
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
        s.close()


def spread(df: DataFrame, *cols) -> DataFrame:
    """Give every core work before a costly per-row stage: few large input splits otherwise leave cores idle.

    Without columns (for plans that begin at a scan or a written table) the number of partitions is three a core,
    or the input's own if that is more, so it grows with the data. With columns the rows are dealt by their hash
    into the session's shuffle partitions, which adaptive execution merges where they are small; this is for plans
    behind joins or aggregates, whose partitions are not known before they run.
    """
    if cols:
        return df.repartition(*cols)
    n = max(df.sparkSession.sparkContext.defaultParallelism * 3, df.rdd.getNumPartitions())
    return df.repartition(n)


def dense_index(df: DataFrame, group: list[str], order: list[str], out: str, salts: int | None = None) -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... without ever holding a group in one task.

    Rows of a group are dealt by a hash of `order` to `salts` sub-groups, numbered inside each, and shifted by
    the number of rows in the sub-groups before (a window over at most `salts` rows a group). There are as many
    sub-groups as the session has shuffle partitions, 64 at least, so they grow with the cluster. `order` must
    identify a row within its group for the numbering to be reproducible; ties share a sub-group and get
    different numbers. Adds column `out` (bigint). Null group keys form one group of their own.
    """
    from pyspark.sql import Window as W

    salts = salts or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    s, n, b = f"__{out}_salt", f"__{out}_n", f"__{out}_base"
    d = df.withColumn(s, F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(salts)).cast("int"))
    sizes = d.groupBy(*group, s).agg(F.count(F.lit(1)).alias(n))
    w = W.partitionBy(*group).orderBy(s).rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col(s).alias("__s"), F.coalesce(F.sum(n).over(w), F.lit(0)).alias(b))
    inner = W.partitionBy(*group, s).orderBy(*order)
    d = d.withColumn(out, F.row_number().over(inner).cast("bigint") - 1)
    on = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)] + [F.col(s) == F.col("__s")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return d.join(bases, cond).withColumn(out, F.col(out) + F.col(b)).drop(s, b, "__s", *[f"__g{i}" for i in range(len(group))])
