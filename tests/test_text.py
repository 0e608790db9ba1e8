"""Tokens, query classes, boosts, headings and table text."""

import pytest
from pyspark.sql import functions as F

from tallyvane.functions import fixed as X
from tallyvane.functions import text as T


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


@pytest.mark.parametrize(
    "text, want",
    [
        ("$4.2 billion", ["$4.2b"]), ("$4.2B", ["$4.2b"]), ("$4.2bn", ["$4.2b"]), ("$450 million", ["$450m"]), ("$3mn", ["$3m"]), ("$5 thousand", ["$5k"]),
        ("23.5 percent", ["23.5%"]), ("23.5%", ["23.5%"]), ("3 percentage points", ["3%", "age", "points"]), ("FY2024", ["fy2024"]), ("Q3 FY2024 results", ["q3fy2024", "results"]),
        ("The revenue is in a table", ["revenue", "table"]), ("$211,915", ["211", "915"]), ("q1000", ["q1", "000"]), ("fy20245", ["fy2024"]), ("$100basis", ["$100b", "asis"]), ("", []), (None, []), ("売上高 2023", ["売上高", "2023"]),
    ],
)
def test_tokens(spark, text, want):
    assert one(spark, T.tokens(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(
    "query, want",
    [
        ("What was Microsoft's revenue in FY2023?", "numerical"), ("How much did Tesla earn?", "numerical"), ("Compare Q1 2023 with Q1 2022", "comparison"), ("Revenue vs costs", "comparison"), ("Which company grew fastest?", "cross_company"),
        ("Compare Tesla and Apple revenue", "cross_company"), ("tesla against apple", "cross_company"), ("apple apple", "factual"), ("Show the trend of deliveries", "chart_trend"), ("How have margins evolved?", "chart_trend"), ("Who is the chair?", "factual"), ("", "factual"), (None, "factual"),
        ("the figure of the plot", "numerical"),
    ],
)
def test_query_class(spark, query, want):
    assert one(spark, T.query_class(F.lit(query).cast("string"))) == want


def test_company_list(spark):
    q = F.lit("Acme sold more than Borg")
    assert one(spark, T.query_class(q, ["Acme", "Borg"])) == "cross_company"
    assert one(spark, T.query_class(q, ["Acme"])) == "factual"
    assert one(spark, T.query_class(q, [])) == "factual"


def test_weights(spark):
    assert [one(spark, T.class_weight(F.lit(k), 0)) for k in X.WEIGHTS] == [w[0] for w in X.WEIGHTS.values()]
    assert one(spark, T.describe_class(F.lit("numerical"))) == "[numerical] dense=30% | bm25=70% | confidence=high"


def test_boosts(spark):
    b = T.domain_boost(F.lit("What was total revenue in 2023?"), F.lit("Total revenue 2023"), F.lit("Income statements"), F.lit("table"))
    assert one(spark, b) == pytest.approx(0.027)
    assert one(spark, T.table_boost(F.lit("numerical"), F.lit("table"))) == 0.003
    assert one(spark, T.table_boost(F.lit("factual"), F.lit("table"))) == 0.0
    d = T.domain_boost(F.lit("who"), F.lit("deferred revenue"), F.lit(None).cast("string"), F.lit("text"))
    assert one(spark, d) == pytest.approx(-0.009)


@pytest.mark.parametrize("line, want", [("Risk factors and more", True), ("1. Overview of the year", True), ("BALANCE SHEET", True), ("SHORT", False), ("Plain text here", False), ("", False), ("REVENUE " + "X" * 300, False), ("12345678", False)])
def test_headings(spark, line, want):
    assert one(spark, T.is_heading(F.lit(line))) is want


def test_table_text(spark):
    g = F.array(F.array(F.lit("Metric"), F.lit("Q3")), F.array(F.lit("Revenue"), F.lit(None).cast("string")), F.array(F.lit(" "), F.lit("")), F.array(F.lit("Sales"), F.lit("1"), F.lit("x")))
    want = "Section: S\nCaption: C\n| Metric | Q3 |  |\n| --- | --- | --- |\n| Revenue |  |  |\n| Sales | 1 | x |"
    assert one(spark, T.table_text(g, F.lit("C"), F.lit("S"))) == want
    assert one(spark, T.table_text(F.array().cast("array<array<string>>"), F.lit("C"), F.lit("S"))) == ""
    assert one(spark, T.table_text(F.lit(None).cast("array<array<string>>"), F.lit("C"), F.lit("S"))) == ""


def test_small_functions(spark):
    assert one(spark, T.word_count(F.lit("  a  b\nc "))) == 3
    assert one(spark, T.word_count(F.lit(" "))) == 0
    assert one(spark, T.clamp_score(F.lit("1.7"))) == 1.0 and one(spark, T.clamp_score(F.lit("x"))) == 0.0
    assert one(spark, T.stem_keywords(F.array(F.lit("sales"), F.lit("eps"), F.lit("losss")))) == ["sale", "eps", "lo"]
    assert one(spark, T.header("", F.lit("C"), F.lit("D"), F.lit(3), F.lit(""))) == "[C | D | Page 3]"
    assert one(spark, T.header("TABLE", F.lit("C"), F.lit("D"), F.lit(3), F.lit("S"))) == "[TABLE | C | D | Page 3 | S]"
