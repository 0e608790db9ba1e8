"""The text functions as SQL functions of a session, for plain SQL users: expressions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tallyvane.functions import fixed as X

#: name -> (parameters, type, body).
FUNCTIONS = {
    "tv_sigmoid": ("x DOUBLE", "DOUBLE", "1.0D / (1.0D + exp(-x))"),
    "tv_clamp_score": ("raw STRING", "DOUBLE", "greatest(0.0D, least(1.0D, coalesce(try_cast(raw AS DOUBLE), 0.0D)))"),
    "tv_relative_difference": ("a DOUBLE, e DOUBLE", "DOUBLE", "abs(e - a) / greatest(abs(a), 1e-9D)"),
    "tv_percent_difference": ("a DOUBLE, e DOUBLE", "DOUBLE", "round(abs(e - a) / greatest(abs(a), 1e-9D) * 100, 2)"),
    "tv_word_count": ("t STRING", "INT", "CASE WHEN trim(regexp_replace(coalesce(t, ''), '\\\\s+', ' ')) = '' THEN 0 ELSE size(split(trim(regexp_replace(t, '\\\\s+', ' ')), ' ')) END"),
    "tv_inner_product": ("a ARRAY<FLOAT>, b ARRAY<FLOAT>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0.0D, (s, x) -> s + x)"),
    "tv_rrf": ("rank INT", "DOUBLE", f"1.0D / ({X.RRF_K} + rank)"),
}


def register(spark: SparkSession) -> list[str]:
    """Registers the functions as temporary ones, replacing earlier ones; returns their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
