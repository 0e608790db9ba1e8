"""Exact penalised changepoint search over a source's history of values, and the unit changes it shows.

The cost of a segment is the sum of squared deviations of log10 |value| from its mean; optimal partitioning with
pruning (PELT) finds the segmentation of least cost plus `penalty` per changepoint exactly. A level shift that
matches a known factor (a power of ten or a unit conversion) within `tolerance` marks a unit change; with
`converted_values`, values of later segments are multiplied back to the unit of the first.

Histories longer than `block` values are cut into consecutive blocks so that a source with a third of all rows is
still spread over tasks. In each block a changepoint is sought that belongs to an optimal segmentation whatever the
values before and after the block are; the stretches between these sure changepoints are searched by themselves, so
the segments are those of a search of the whole history. A block without one (a long stretch at one level) is
searched together with its neighbours, in one task.
Defined results: null, zero and non-finite values are left out of the levels and keep their factor of the segment
they fall in by order; a source with one value has one segment; ties in time are ordered by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyvane.session import checkpoint

#: log10 of factors between units in which one quantity is commonly recorded (fixed values).
FACTORS = {"thousand": 3.0, "million": 6.0, "billion": 9.0, "hundred": 2.0, "lb_kg": float(np.log10(0.45359237)), "short_ton_kg": float(np.log10(907.18474)), "sqft_m2": float(np.log10(0.09290304)), "acre_m2": float(np.log10(4046.8564224)), "gal_l": float(np.log10(3.785411784)), "barrel_l": float(np.log10(158.987294928)), "mile_km": float(np.log10(1.609344)), "gj_kwh": float(np.log10(2500 / 9))}


def segments(x: np.ndarray, penalty: float) -> list[int]:
    """The starts of the optimal segments of a series (0 first); exact by optimal partitioning with pruning."""
    n = len(x)
    if n == 0:
        return []
    best, last = _search(x, penalty)
    return _path(last, n)


def _search(x: np.ndarray, penalty: float, spare: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Least cost of each prefix and the start of its last segment; ends early, with the first prefix that costs over
    `spare` more as one segment than segmented."""
    n = len(x)
    s, q = np.concatenate(([0.0], np.cumsum(x))), np.concatenate(([0.0], np.cumsum(x * x)))
    best, last = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0], cand = -penalty, np.array([0])
    for t in range(1, n + 1):
        m = t - cand
        cost = best[cand] + q[t] - q[cand] - (s[t] - s[cand]) ** 2 / m
        i = int(np.argmin(cost))
        best[t], last[t] = cost[i] + penalty, cand[i]
        if q[t] - s[t] ** 2 / t > best[t] + spare:
            return best[: t + 1], last[: t + 1]
        cand = np.append(cand[cost <= best[t]], t)
    return best, last


def _path(last: np.ndarray, t: int) -> list[int]:
    out = []
    while t > 0:
        out.append(int(last[t]))
        t = last[t]
    return out[::-1]


def _windows(x: np.ndarray, penalty: float, most: int) -> list[range]:
    """Disjoint ranges of positions, in order, each holding a changepoint of every optimal segmentation of any series
    that contains `x`: as one part of a segment, the values around it cost more than segmented by themselves with two
    penalties for the edges."""
    out, p, spare = [], 0, 2 * penalty + 1e-6
    while len(out) < most:
        a = p + len(_search(x[p:], penalty, spare)[0]) - 1
        y = x[p:a]
        if not len(y) or _one(y) <= _search(y, penalty)[0][-1] + spare:
            break
        # the shortest such stretch that ends at a
        b = a - len(_search(y[::-1], penalty, spare)[0]) + 1
        out.append(range(b + 1, a))
        p = a
    return out


def _one(x: np.ndarray) -> float:
    return float((x * x).sum() - x.sum() ** 2 / len(x))


def sure_changes(x: np.ndarray, penalty: float, most: int = 40, widest: int = 48) -> list[int]:
    """Positions that are changepoints of one optimal segmentation of any series that contains `x`; [] if none is found.

    An optimal segmentation has a changepoint f in one window and g in a later one, and an optimal segmentation of
    x[f:g] between them; a position that all these have in common for every f and g is sure.
    """
    w = _windows(x, penalty, most)
    for step in (1, 2, 4, 8, 16, 32):
        for i in range(0, min(len(w) - step, 3 * step), step):
            first, second = w[i], w[i + step]
            if max(len(first), len(second)) > widest:
                continue
            common: set[int] | None = None
            for f in first:
                last = _search(x[f : second[-1]], penalty)[1]
                for g in second:
                    path = {f + c for c in _path(last, g - f)} | {g}
                    common = path if common is None else common & path
                if not common:
                    break
            if common:
                return sorted(common)
    return []


def unit_factor(shift: float, tolerance: float = 0.15) -> tuple[str, float] | None:
    """The known factor nearest to a shift of log10 levels, if within the tolerance; negative shifts divide."""
    name, f = min(FACTORS.items(), key=lambda kv: abs(abs(shift) - abs(kv[1])))
    return (name, float(np.sign(shift) * abs(f))) if abs(abs(shift) - abs(f)) <= tolerance else None


def value_segments(df: DataFrame, source: str, order: list[str], value: str, penalty: float = 2.0, block: int = 4096, most_blocks: int = 256) -> DataFrame:
    """Adds block_no, stretch_no, segment_no (within its stretch) and level (mean log10 |value| of the segment).

    Blocks are stretches of the order, cut at approximate quantiles of its first column (a mergeable sketch per
    source); a source of at most `block` rows is one block. Stretches begin at sure changepoints, at most one a block,
    so segments may run over the edges of blocks but never over those of stretches. Nulls come last in the order.
    """
    at = F.coalesce(F.col(order[0]).cast("double"), F.lit(1e308))
    grid = [i / most_blocks for i in range(1, most_blocks)]
    marks = df.groupBy(source).agg(F.percentile_approx(at, F.array(*[F.lit(x) for x in grid]), 10000).alias("__q"), F.ceil(F.count(F.lit(1)) / block).alias("__nb")).withColumnRenamed(source, "__src")
    step = F.size(F.filter("__q", lambda q: q < F.col("__at")))
    numbered = df.withColumn("__at", at).join(marks, F.col(source).eqNullSafe(F.col("__src"))).withColumn("__b", F.floor(step * F.least(F.col("__nb"), F.lit(most_blocks)) / most_blocks).cast("bigint")).drop("__at", "__q", "__src")
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{c}` {t}" for c, t in types.items())

    def usable(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        v = pd.to_numeric(pdf[value], errors="coerce").to_numpy(float)
        ok = np.isfinite(v) & (v != 0)
        return pdf, ok, np.log10(np.abs(v[ok]))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, ok, x = usable(pdf)
        where = np.flatnonzero(ok)
        tied = pdf.duplicated(order).to_numpy()
        at = [where[c] for c in sure_changes(x, penalty) if not tied[where[c]]]
        return pdf.loc[at[:1], [source, *order]]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, ok, x = usable(pdf)
        seg, level = np.zeros(len(pdf), np.int64), np.full(len(pdf), np.nan)
        starts = segments(x, penalty)
        where = np.flatnonzero(ok)
        for i, a in enumerate(starts):
            b = starts[i + 1] if i + 1 < len(starts) else len(x)
            lo = where[a] if i else 0
            hi = where[b] if b < len(x) else len(pdf)
            seg[lo:hi], level[lo:hi] = i, x[a:b].mean()
        return pdf.drop(columns=["__b", "__s"]).assign(block_no=pdf["__b"], stretch_no=pdf["__s"], segment_no=seg, level=level)

    place = F.struct(*[x for i, c in enumerate(order) for x in (F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"c{i}"))])
    keys = dict.fromkeys([source, *order])
    cuts = numbered.where("__nb > 1").select(*dict.fromkeys([source, "__b", *order, value])).groupBy(source, "__b").applyInPandas(cut, ", ".join(f"`{c}` {types[c]}" for c in keys))
    # at most most_blocks places a source
    cuts = cuts.groupBy(F.col(source).alias("__src")).agg(F.collect_list(place).alias("__cuts"))
    before = F.when(F.col("__cuts").isNull(), 0).otherwise(F.size(F.filter("__cuts", lambda c: c <= F.col("__place")))).cast("bigint")
    dealt = numbered.withColumn("__place", place).join(cuts, F.col(source).eqNullSafe(F.col("__src")), "left").withColumn("__s", before).drop("__nb", "__place", "__cuts", "__src")
    return dealt.groupBy(source, "__s").applyInPandas(run, f"{schema}, block_no bigint, stretch_no bigint, segment_no bigint, level double")


def unit_changes(df: DataFrame, source: str, order: list[str], value: str, penalty: float = 2.0, tolerance: float = 0.15) -> DataFrame:
    """(source, block_no, segment_no, level, n_values, shift, unit_change): one row a segment, numbered over the whole
    history, or one for each block a segment runs over (all but the first with shift 0); unit_change names the known
    factor of the shift from the segment before, null if it matches none or there is none."""
    s = _changes(value_segments(df, source, order, value, penalty), source, tolerance)
    number = F.dense_rank().over(W.partitionBy(source).orderBy("stretch_no", "segment_no")).cast("bigint") - 1
    return s.withColumn("segment_no", number).drop("stretch_no", "factor")


def _changes(segmented: DataFrame, source: str, tolerance: float) -> DataFrame:
    """One row a segment and block, with the shift from the one before, the name and signed log10 of its known factor."""
    s = segmented.groupBy(source, "block_no", "stretch_no", "segment_no").agg(F.first("level").alias("level"), F.count(F.lit(1)).alias("n_values"))
    shift = F.col("level") - F.lag("level").over(W.partitionBy(source).orderBy("stretch_no", "segment_no", "block_no"))
    near = F.array_min(F.array(*[F.struct(F.abs(F.abs(F.col("shift")) - abs(f)).alias("d"), F.lit(name).alias("name"), F.lit(abs(f)).alias("f")) for name, f in FACTORS.items()]))
    known = near["d"] <= tolerance
    return s.withColumn("shift", shift).withColumn("unit_change", F.when(known, near["name"])).withColumn("factor", F.when(known, F.signum("shift") * near["f"]))


def converted_values(df: DataFrame, source: str, order: list[str], value: str, penalty: float = 2.0, tolerance: float = 0.15) -> DataFrame:
    """Adds converted: the value in the unit of its source's first segment, all marked unit changes up to its own
    segment reversed; null and zero values stay what they are."""
    s = checkpoint(value_segments(df, source, order, value, penalty))
    total = F.sum(F.coalesce("factor", F.lit(0.0))).over(W.partitionBy(source).orderBy("stretch_no", "segment_no", "block_no").rowsBetween(W.unboundedPreceding, 0))
    keys = [source, "stretch_no", "segment_no", "block_no"]
    f = _changes(s, source, tolerance).select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(keys)], total.alias("__f"))
    on = F.col(source).eqNullSafe(F.col("__0"))
    for i, c in enumerate(keys[1:], 1):
        on = on & (F.col(c) == F.col(f"__{i}"))
    return s.join(f, on).withColumn("converted", F.col(value) * F.pow(F.lit(10.0), -F.col("__f"))).select(*df.columns, "converted")
