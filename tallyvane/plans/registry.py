"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyvane.plans import corpus, pipeline, retrieval


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return corpus.queries() | retrieval.queries() | pipeline.queries()


def oracle_sql() -> dict[str, str]:
    return retrieval.SQL | pipeline.SQL
