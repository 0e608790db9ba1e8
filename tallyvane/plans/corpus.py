"""Queries of the general data-processing operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvane.operators import changepoint, units
from tallyvane.session import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every number that states a measured quantity, in its base unit."""
    return units.common_units(table(spark, d, "extracted_numbers"), table(spark, d, "chunks"))


def _history(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "extracted_numbers").where("number_id is not null")
    n = n.groupBy("number_id").agg(F.max_by(F.struct("chunk_id", "value", "extracted_at"), "extracted_at").alias("r")).select("number_id", "r.*")
    c = table(spark, d, "chunks").select("chunk_id", F.coalesce("company", F.lit("(none)")).alias("company"))
    return n.join(c, "chunk_id").select("company", "number_id", "extracted_at", "value")


def p5_shifts(spark: SparkSession, d: str) -> DataFrame:
    """Segments of each company's history of recorded values, and the shifts that match a known unit factor."""
    return changepoint.unit_changes(_history(spark, d), "company", ["extracted_at", "number_id"], "value")


def p5_converted(spark: SparkSession, d: str) -> DataFrame:
    """Every recorded value with the unit changes of its company's history up to it reversed."""
    return changepoint.converted_values(_history(spark, d), "company", ["extracted_at", "number_id"], "value")


def queries() -> dict:
    return {"p5_found": p5_found, "p5_shifts": p5_shifts, "p5_converted": p5_converted}
