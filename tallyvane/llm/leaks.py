"""Evaluation texts leaking into training text.

Items and documents are reduced to letters and digits, lower-cased. A seed is a run of `seed` characters of an item;
how many items hold it is counted over all items, and of every `run - seed + 1` consecutive seeds of an item the rarest
is chosen (ties by hash, then by place). A shared run of `run` characters holds such a stretch whole, so it holds a
chosen seed, and the chosen seeds are a small part of all. Documents are probed at every position by a rolling hash
against a bit filter and the sorted seeds; hits are confirmed on the characters.

Each hit pair is aligned by Smith-Waterman over all windows of the document around its hits, which scores edited and
paraphrased copies. `leaks_found` takes the pairs whose score reaches that of an exact copy of `run` characters - every
pair that shares such a run does - and then checks exactly that their longest common run has the stated length.

Chosen seeds go to the executors in blocks of items, at most `block_seeds` seeds and `block_chars` characters each,
each block against all documents; one block holds tens of thousands of items. Defined results: null or empty texts
match nothing; items or documents that repeat are reported once under their id; long documents are probed to their end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvane.llm.truncation import Hasher
from tallyvane.session import checkpoint, spread

_DROP = re.compile(r"[\W_]+")


def squeeze(text: str) -> str:
    """Lower case, letters and digits only."""
    s = _DROP.sub("", text.lower())
    return s if s.isalnum() else "".join(c for c in s if c.isalnum())


def smith_waterman(a: str, b: str, match: int = 2, mismatch: int = -1, gap: int = -2) -> int:
    """The best local alignment score of two strings (rows vectorised; gaps in a row by a running maximum)."""
    if not a or not b:
        return 0
    x = np.frombuffer(a.encode("utf-32-le"), dtype="<u4")
    y = np.frombuffer(b.encode("utf-32-le"), dtype="<u4")
    if len(x) > len(y):
        x, y = y, x
    n = len(y)
    ramp = np.arange(n + 1, dtype=np.int32) * np.int32(gap)
    h, row, best = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
    # what a character of x scores against each place of y, once for each distinct one
    score = {int(c): np.where(y == c, np.int32(match), np.int32(mismatch)) for c in np.unique(x)}
    for c in x.tolist():
        np.add(h[:-1], score[c], out=row[1:])
        np.maximum(row[1:], h[1:] + np.int32(gap), out=row[1:])
        np.maximum(row, 0, out=row)
        np.subtract(row, ramp, out=row)
        np.maximum.accumulate(row, out=row)
        np.add(row, ramp, out=h)
        np.maximum(best, h, out=best)
        row[0] = 0
    return int(best.max())


def longest_run(a: str, b: str, anchors: list[tuple[int, int]], k: int) -> int:
    """The longest common run through any of the anchors (i in a, j in b, k characters equal)."""
    best = 0
    for i, j in anchors:
        lo = 0
        while lo < min(i, j) and a[i - lo - 1] == b[j - lo - 1]:
            lo += 1
        hi, most = k, min(len(a) - i, len(b) - j)
        while hi < most and a[i + hi] == b[j + hi]:
            hi += 1
        best = max(best, lo + hi)
    return best


def best_score(s: str, t: str, anchors: list[tuple[int, int]]) -> int:
    """The best local alignment of item t in document s around the anchors (i in s, j in t).

    An alignment of positive score has fewer gaps than t has characters, so all that pass through an anchor lie
    within len(t) of its diagonal; the parts of s that this covers are joined where they overlap and aligned whole.
    """
    best, n = 0, len(t)
    parts: list[list[int]] = []
    for x in sorted({i - j for i, j in anchors}):
        lo, hi = max(0, x - n), min(len(s), x + 2 * n)
        if parts and lo <= parts[-1][1]:
            parts[-1][1] = hi
        else:
            parts.append([lo, hi])
    for lo, hi in parts:
        best = max(best, smith_waterman(t, s[lo:hi]))
    return best


def rare_seeds(items: DataFrame, seed: int, window: int) -> DataFrame:
    """(i, t, hs, qs): of items(i, t) the squeezed text and the hashes and places of its chosen seeds."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for pdf in batches:
            for i, t in zip(pdf["i"], pdf["t"]):
                s = squeeze(t)
                h = hasher.at(hasher.prefix(s), np.arange(seed, len(s) + 1), seed).view(np.int64)
                yield pd.DataFrame({"i": i, "q": np.arange(len(h)), "h": h})

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("q")
        rank = np.lexsort((pdf["q"].to_numpy(), pdf["h"].to_numpy(), pdf["n"].to_numpy()))
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        w = min(window, len(place))
        best = np.unique(np.argmin(np.lib.stride_tricks.sliding_window_view(place, w), axis=1) + np.arange(len(place) - w + 1))
        return pd.DataFrame({"i": [pdf["i"].iloc[0]], "hs": [pdf["h"].to_numpy()[best]], "qs": [pdf["q"].to_numpy()[best]]})

    every = items.mapInPandas(cut, "i bigint, q bigint, h bigint")
    counted = every.groupBy("h").agg(F.countDistinct("i").alias("n"))
    return every.join(counted, "h").groupBy("i").applyInPandas(choose, "i bigint, hs array<bigint>, qs array<bigint>")


def leak_pairs(docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", run: int = 60, seed: int = 24, block_seeds: int = 1_000_000, block_chars: int = 16_000_000) -> DataFrame:
    """(doc, item, hits, run, score): every pair that shares a chosen seed.

    hits are the places that share one, run the longest common run through them, score the best Smith-Waterman score
    (2 a match) of the item and the document windows around them.
    """
    spark = docs.sparkSession
    named = items.where(F.col(text).isNotNull() & F.col(item).isNotNull()).select(F.col(item).cast("bigint").alias("item"), F.col(text).alias("t")).distinct().withColumn("i", F.xxhash64("item", "t"))
    chosen = checkpoint(rare_seeds(named.select("i", "t"), seed, run - seed + 1).join(named, "i").select("i", "item", "t", "hs", "qs"))
    size = chosen.agg(F.coalesce(F.sum(F.size("hs")), F.lit(0)).alias("seeds"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size.seeds // block_seeds), -(-size.chars // block_chars))
    schema = "d bigint, i bigint, hits bigint, run bigint, score bigint"
    names = ["d", "i", "hits", "run", "score"]
    source = spread(docs.where(F.col(text).isNotNull() & F.col(doc).isNotNull()).select(F.col(doc).cast("bigint").alias("d"), F.col(text).alias("t")))
    found = None
    for b in range(blocks):
        rows = chosen.where(F.pmod("i", F.lit(blocks)) == b).select("item", "t", "hs", "qs").collect()  # one block
        texts = [squeeze(r.t) for r in rows]
        h = np.array([x for r in rows for x in r.hs], np.int64).view(np.uint64)
        owner = np.array([k for k, r in enumerate(rows) for _ in r.hs], np.int32)
        place = np.array([x for r in rows for x in r.qs], np.int32)
        order = np.argsort(h, kind="stable")
        bits = max(16, (16 * max(1, len(h))).bit_length())
        filt = np.zeros(1 << bits, bool)
        filt[h >> np.uint64(64 - bits)] = True
        shared = spark.sparkContext.broadcast((np.packbits(filt), bits, h[order], owner[order], place[order], texts, [r.item for r in rows]))

        def probe(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            packed, bits, keys, owner, place, texts, ids = shared.value
            filt, shift, hasher = np.unpackbits(packed).view(bool), np.uint64(64 - bits), Hasher()

            def hits(part: list[tuple[int, str]]) -> Iterator[tuple]:
                sizes = np.array([len(s) for _, s in part])
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                p = hasher.prefix("".join(s for _, s in part))
                # the seed that ends behind each position, where it lies in one document
                ends = np.flatnonzero(np.arange(1, len(p)) - np.repeat(starts, sizes) >= seed) + 1
                h = hasher.at(p, ends, seed)
                ok = filt[h >> shift]
                ends, h = ends[ok], h[ok]
                lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
                met: dict[tuple[int, int], list[tuple[int, int]]] = {}
                for x in np.flatnonzero(hi > lo):
                    k = int(np.searchsorted(starts, ends[x] - seed, "right")) - 1
                    at, s = int(ends[x] - seed - starts[k]), part[k][1]
                    for y in range(lo[x], hi[x]):
                        q = int(place[y])
                        if texts[owner[y]][q : q + seed] == s[at : at + seed]:
                            met.setdefault((k, int(owner[y])), []).append((at, q))
                for (k, o), at in met.items():
                    d, s = part[k]
                    yield d, ids[o], len(at), longest_run(s, texts[o], at, seed), best_score(s, texts[o], at)

            for pdf in batches:
                part, have, out = [], 0, []
                for d, t in zip(pdf["d"], pdf["t"]):
                    s = squeeze(t)
                    part.append((d, s))
                    have += len(s)
                    if have > 200_000:
                        out += hits(part)
                        part, have = [], 0
                if part:
                    out += hits(part)
                yield pd.DataFrame(out, columns=names)

        got = source.mapInPandas(probe, schema)
        found = got if found is None else found.union(got)
    # repeated ids: one row each
    found = found.groupBy("d", "i").agg(F.max("hits").alias("hits"), F.max("run").alias("run"), F.max("score").alias("score"))
    return found.select(F.col("d").alias(doc), F.col("i").alias(item), "hits", "run", "score")


def leaks_found(docs: DataFrame, items: DataFrame, run: int = 60, **how) -> DataFrame:
    """(doc_id, item_id) of every document and item that align at least as well as a copy of `run` characters and share
    a run of as many letters and digits."""
    return leak_pairs(docs, items, run=run, **how).where((F.col("score") >= 2 * run) & (F.col("run") >= run)).select("doc_id", "item_id")
