"""Checks the numbers of answers against the numbers of their evidence.

answers(answer_id, num_ord, value, is_percent, keywords) and evidence(answer_id, ev_ord, value, keywords). Both
closeness and derivability are band joins on logarithmic buckets, so no answer's numbers are paired with all of
its evidence; exact conditions follow. Defined results: a zero never matches and has no nearest value; an answer
without numbers is verified; one without any evidence number is not, and all its numbers are unverifiable.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyvane.functions import fixed as X
from tallyvane.functions.text import stem_keywords

_STEP = 0.02


def _bucket(v: Column) -> Column:
    """The logarithmic bucket of a nonzero value's size."""
    return F.floor(F.log(F.abs(v)) / _STEP).cast("bigint")


def relative_difference(a: Column, e: Column) -> Column:
    return F.abs(e - a) / F.greatest(F.abs(a), F.lit(1e-9))


def checked(answers: DataFrame) -> DataFrame:
    """The numbers worth checking: percentages and sizes of at least one."""
    return answers.where(F.col("is_percent") | (F.abs("value") >= 1))


def close_pairs(answers: DataFrame, evidence: DataFrame, tolerance: float = X.TOLERANCE) -> DataFrame:
    """Pairs within the relative tolerance: answer_id, num_ord, value, keywords, ev_ord, ev_value, ev_keywords."""
    reach = math.ceil(-math.log(1 - tolerance) / _STEP) + 1
    a = answers.where("value <> 0").withColumn("b", F.explode(F.sequence(_bucket(F.col("value")) - reach, _bucket(F.col("value")) + reach)))
    e = evidence.where("value <> 0").select("answer_id", "ev_ord", F.col("value").alias("ev_value"), F.col("keywords").alias("ev_keywords"), _bucket(F.col("value")).alias("b"))
    return a.join(e, ["answer_id", "b"]).where(relative_difference(F.col("value"), F.col("ev_value")) <= tolerance).drop("b")


def consistent(a: Column, e: Column) -> Column:
    """Keyword sets share a stem, or either is empty."""
    return (F.size(a) == 0) | (F.size(e) == 0) | F.arrays_overlap(stem_keywords(a), stem_keywords(e))


def nearest(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(answer_id, num_ord, nearest_value, relative_diff): the evidence value of least relative difference, the
    first of equals. By order: on a sorted line the nearest value is one of the two neighbours."""
    e = evidence.groupBy("answer_id", F.col("value").alias("v")).agg(F.min("ev_ord").alias("eo")).select("answer_id", "v", F.lit(None).cast("int").alias("num_ord"), F.struct("v", "eo").alias("ev"))
    a = answers.where("value <> 0").select("answer_id", F.col("value").alias("v"), F.col("num_ord").cast("int").alias("num_ord"), F.lit(None).cast(e.schema["ev"].dataType).alias("ev"))
    w = W.partitionBy("answer_id").orderBy("v", F.col("num_ord").isNotNull())
    both = a.unionByName(e)
    both = both.withColumn("lo", F.last("ev", True).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("hi", F.first("ev", True).over(w.rowsBetween(0, W.unboundedFollowing)))
    one = lambda x: F.when(F.col(x).isNotNull(), F.struct(relative_difference(F.col("v"), F.col(f"{x}.v")).alias("d"), F.col(f"{x}.eo").alias("eo"), F.col(f"{x}.v").alias("ev")))
    best = F.array_min(F.array_compact(F.array(one("lo"), one("hi"))))
    return both.where(F.col("num_ord").isNotNull()).select("answer_id", "num_ord", best.alias("x")).where(F.col("x").isNotNull()).select("answer_id", "num_ord", F.col("x.ev").alias("nearest_value"), F.col("x.d").alias("relative_diff"))


def derivation_pool(evidence: DataFrame) -> DataFrame:
    """Evidence values to derive percentages from: those of at least 1000 if there is one, else all nonzero."""
    e = evidence.where(F.abs("value") > 1e-9)
    big = F.max(F.abs("value") >= 1000).over(W.partitionBy("answer_id"))
    return e.withColumn("big", big).where(~F.col("big") | (F.abs("value") >= 1000)).drop("big")


def derivable(answers: DataFrame, evidence: DataFrame, tolerance: float = X.TOLERANCE) -> DataFrame:
    """(answer_id, num_ord) of percentages that are |a - b| / |b| * 100 of two evidence numbers, within tolerance.

    For each percentage p and base b, a must lie in one of two narrow bands around b (1 +- p / 100), found by
    bucket; the condition itself is then checked.
    """
    p = answers.where("is_percent and value <> 0").select("answer_id", "num_ord", F.col("value").alias("p"))
    pool = derivation_pool(evidence).select("answer_id", "ev_ord", "value")
    base = p.join(pool.select("answer_id", F.col("ev_ord").alias("bo"), F.col("value").alias("b")), "answer_id")
    size = F.abs("p") / 100.0
    bands = F.array(*[F.struct((F.col("b") * (1 + s * size * (1 - tolerance))).alias("x"), (F.col("b") * (1 + s * size * (1 + tolerance))).alias("y")) for s in (1.0, -1.0)])
    band = base.withColumn("band", F.explode(bands)).select("answer_id", "num_ord", "p", "bo", "b", F.least("band.x", "band.y").alias("lo"), F.greatest("band.x", "band.y").alias("hi"))
    # a band that touches zero spans endless buckets: values below 1e-9 are not in the pool, so it starts there
    least = F.when((F.col("lo") <= 0) & (F.col("hi") >= 0), F.lit(1e-9)).otherwise(F.least(F.abs("lo"), F.abs("hi")))
    most = F.greatest(F.abs("lo"), F.abs("hi"), F.lit(1e-9))
    reach = band.withColumn("k", F.explode(F.sequence(_bucket(F.greatest(least, F.lit(1e-9))) - 1, _bucket(most) + 1)))
    hit = reach.join(pool.select("answer_id", F.col("ev_ord").alias("ao"), F.col("value").alias("a"), _bucket(F.col("value")).alias("k")), ["answer_id", "k"])
    change = F.abs(F.col("a") - F.col("b")) / F.abs("b") * 100.0
    return hit.where((F.col("ao") != F.col("bo")) & (F.abs(change - F.abs("p")) / F.greatest(F.abs("p"), F.lit(1e-9)) <= tolerance)).select("answer_id", "num_ord").distinct()


def verify(answers: DataFrame, evidence: DataFrame, tolerance: float = X.TOLERANCE, require_context: bool = True) -> DataFrame:
    """(answer_id, num_ord, value, status, closest, relative_diff) of each checked number: matched, mismatch,
    derived or unverifiable. Close values with consistent keywords match; close ones without are a mismatch with
    the closest of them; a derivable percentage is derived; a nearest value under 50 % off is a mismatch. Without
    `require_context` keywords do not matter."""
    a = checked(answers).select("answer_id", F.col("num_ord").cast("int").alias("num_ord"), "value", "is_percent", "keywords")
    close = close_pairs(a, evidence, tolerance).groupBy("answer_id", "num_ord").agg(F.max(consistent(F.col("keywords"), F.col("ev_keywords")) | F.lit(not require_context)).alias("agrees"), F.min(F.struct(relative_difference(F.col("value"), F.col("ev_value")).alias("d"), F.col("ev_ord"), F.col("ev_value"))).alias("c"))
    der = derivable(a, evidence, tolerance).withColumn("der", F.lit(True))
    near = nearest(a, evidence)
    j = a.join(close, ["answer_id", "num_ord"], "left").join(der, ["answer_id", "num_ord"], "left").join(near, ["answer_id", "num_ord"], "left")
    status = (
        F.when(F.col("agrees"), "matched").when(F.col("agrees").isNotNull(), "mismatch").when(F.coalesce("der", F.lit(False)), "derived").when(F.col("relative_diff") < X.UNVERIFIABLE_FROM, "mismatch").otherwise("unverifiable")
    )
    j = j.withColumn("status", status)
    shown = F.col("status") == "mismatch"
    return j.select("answer_id", "num_ord", "value", "status", F.when(shown, F.coalesce("c.ev_value", "nearest_value")).alias("closest"), F.when(shown, F.coalesce("c.d", "relative_diff")).alias("relative_diff"))


def report(answers: DataFrame, numbers: DataFrame, evidence: DataFrame, rows: DataFrame) -> DataFrame:
    """Per answer of answers(answer_id): counts by status, verified and a summary line; numbers and evidence are
    the inputs of `verify`, rows its result."""
    counts = rows.groupBy("answer_id").agg(*[F.sum((F.col("status") == s).cast("bigint")).alias(f"n_{s}") for s in ("matched", "derived", "mismatch", "unverifiable")])
    has_ev = evidence.select("answer_id").distinct().withColumn("ev", F.lit(True))
    n_all = numbers.groupBy("answer_id").agg(F.count(F.lit(1)).alias("n_numbers"))
    j = answers.select("answer_id").distinct().join(counts, "answer_id", "left").join(has_ev, "answer_id", "left").join(n_all, "answer_id", "left").fillna(0)
    no_ev = (F.col("n_numbers") > 0) & F.col("ev").isNull()
    j = j.withColumn("n_unverifiable", F.when(no_ev, F.col("n_numbers")).otherwise(F.col("n_unverifiable")))
    line = F.concat_ws("; ", *[F.when(F.col(f"n_{s}") > 0, F.format_string("%d " + s, F.col(f"n_{s}"))) for s in ("matched", "derived", "mismatch", "unverifiable")])
    return j.select("answer_id", "n_matched", "n_derived", "n_mismatch", "n_unverifiable", ((F.col("n_mismatch") == 0) & ~no_ev).alias("verified"), F.when(line == "", "no numbers").otherwise(line).alias("summary"))


def mismatches(answers: DataFrame, evidence: DataFrame, rows: DataFrame, tolerance: float = X.TOLERANCE) -> DataFrame:
    """(answer_id, num_ord, closest_evidence, relative_diff_pct, message) of each mismatch in `rows`, the result of
    `verify` on the same inputs; answers carry `raw`, the number as printed. The difference is in percent to two
    decimals. A value that is close but of another metric is told from one that is off (see the formats)."""
    a = answers.select("answer_id", F.col("num_ord").cast("int").alias("num_ord"), "value", "raw", "keywords")
    close = close_pairs(a, evidence, tolerance).groupBy("answer_id", "num_ord").agg(F.min_by("ev_keywords", "ev_ord").alias("ev_keywords"))
    j = rows.where("status = 'mismatch'").select("answer_id", "num_ord", "closest", "relative_diff").join(a, ["answer_id", "num_ord"]).join(close, ["answer_id", "num_ord"], "left")

    @F.pandas_udf("string")
    def message(raw: pd.Series, value: pd.Series, closest: pd.Series, diff: pd.Series, mine: pd.Series, other: pd.Series) -> pd.Series:
        words = lambda ks: sorted(str(k) for k in ks)
        return pd.Series([
            X.MISMATCH_METRIC.format(raw=r, closest=c, answer=words(m), evidence=words(o)) if o is not None else X.MISMATCH_VALUE.format(raw=r, value=v, closest=c, percent=d * 100)
            for r, v, c, d, m, o in zip(raw, value, closest, diff, mine, other)
        ])

    return j.select("answer_id", "num_ord", F.col("closest").alias("closest_evidence"), F.round(F.col("relative_diff") * 100, 2).alias("relative_diff_pct"), message("raw", "value", "closest", "relative_diff", "keywords", "ev_keywords").alias("message"))
