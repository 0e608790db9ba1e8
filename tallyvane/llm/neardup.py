"""Near-duplicate texts: BagMinHash signatures, banding, a sketch filter, exact overlap.

A text is the weighted set (bag) of its shingles. Each shingle owns a Poisson process on (time, weight, component):
the weight axis is cut into octaves [0,1), [1,2), [2,4), ..., each an independent process of rate equal to its
width; in the last octave, which a weight fills in part, a point carries its own place in the octave and counts where
it lies below the weight. So two texts see the same points wherever their weights overlap. The earliest point of each
of `m` components is the signature; two signatures agree in a component with probability equal to the weighted
Jaccard similarity. Points are generated in order of time and a shingle stops at the latest register, so a text costs
about n + m log m points, not n * m. Where similarity counts distinct shingles (`weighted=False`) all weights are one
and only the first octave is used.

Texts of one language or template share a band by chance so often that such pairs grow with the square of the corpus.
So the sketches travel with the band keys, and a pair leaves its bucket only if they agree; only the members are
shuffled, in rounds of a few bands. Buckets arrive sorted by key and are compared as they pass, up to `block` members in
place; the members of larger ones are dealt to blocks, and each pair of blocks meets under a key of its own, so a bucket
that holds a third of all texts is spread over many tasks. Texts travel only with the pairs that the sketches leave.

Defined results: null texts and texts shorter than one shingle are similar to nothing; exact copies (after
normalisation, by a hash of 128 bits) form one class whose representative alone is compared; ids are told apart by a
hash of 64 bits; ties do not arise (pairs
are unordered, the smaller id first); an empty table gives no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvane.operators.components import connected_components
from tallyvane.session import Scratch, checkpoint, scratch

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: White space besides the plain space, as Unicode has it.
_BLANK = r"\t\n\x0B\f\r\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def char_shingles(text: str, k: int = 5) -> np.ndarray:
    """64-bit hashes of all k-character substrings, in order."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    if len(c) < k:
        return np.empty(0, np.uint64)
    n = len(c) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x100000001B3) + c[i : i + n] + np.uint64(1)
    return mix(h)


def word_shingles(text: str, k: int = 5) -> np.ndarray:
    """64-bit hashes of all runs of k words; a text of fewer words is one shingle."""
    import xxhash

    w = text.split()
    return np.array([xxhash.xxh64_intdigest(" ".join(w[i : i + k])) for i in range(max(1, len(w) - k + 1))] if w else [], dtype=np.uint64)


def bag_minhash(hashes: list[np.ndarray], m: int, weights: list[np.ndarray] | None = None) -> np.ndarray:
    """Signatures (texts x m, uint64) of weighted sets given as hashes without repeats (and weights, else 1)."""
    docs = len(hashes)
    reg = np.full(docs * m, np.inf)
    if not docs:
        return reg.view(np.uint64).reshape(0, m)
    owner = np.repeat(np.arange(docs), [len(h) for h in hashes])
    h = np.concatenate(hashes) if len(owner) else np.empty(0, np.uint64)
    width, part = np.ones(len(h)), np.ones(len(h))
    if weights is not None:
        w = np.concatenate(weights).astype(float)
        part = np.minimum(w, 1.0)
        owners, hs, widths, parts = [owner], [h], [width], [part]
        lo, octave = 1.0, 1
        while (on := w > lo).any():
            owners.append(owner[on])
            hs.append(mix(h[on] + np.uint64(octave * int(_GOLD) & 0xFFFFFFFFFFFFFFFF)))
            widths.append(np.full(on.sum(), lo))
            parts.append(np.minimum((w[on] - lo) / lo, 1.0))
            lo, octave = lo * 2, octave + 1
        owner, h, width, part = (np.concatenate(x) for x in (owners, hs, widths, parts))
    time, step = np.zeros(len(h)), 0
    scale = 1.0 / 9007199254740992.0
    while len(h):
        step += 1
        r = mix(h + np.uint64(3 * step * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((r >> np.uint64(11)).astype(float) + 0.5) * scale) / (m * width)
        comp = (mix(r ^ _M1) >> np.uint64(32)).astype(np.int64) * m >> 32
        ok = part >= 1.0
        if not ok.all():
            ok |= ((mix(r ^ _M2) >> np.uint64(11)).astype(float) * scale) < part
        np.minimum.at(reg, (owner * m + comp)[ok], time[ok])
        latest = reg.reshape(docs, m).max(axis=1)
        go = time < latest[owner]
        owner, h, time, width, part = owner[go], h[go], time[go], width[go], part[go]
    return reg.view(np.uint64).reshape(docs, m)


def normal_body(text: Column) -> Column:
    """Without the header line, lower case, white space runs as one space, trimmed. Only runs that are not one plain
    space already are rewritten."""
    body = F.when(F.instr(text, "\n") > 0, F.substr(text, F.instr(text, "\n") + 1)).when(text.isNotNull(), "")
    return F.trim(F.regexp_replace(F.lower(body), rf"(?:[{_BLANK}]| (?=[ {_BLANK}]))[ {_BLANK}]*", " "))


def overlap(a: np.ndarray, b: np.ndarray, wa: np.ndarray | None = None, wb: np.ndarray | None = None) -> float:
    """(Weighted) Jaccard similarity of two sorted arrays without repeats; 0 if either is empty."""
    if not len(a) or not len(b):
        return 0.0
    if wa is None:
        both = np.concatenate([a, b])
        both.sort()
        n = np.count_nonzero(both[1:] == both[:-1])
        return n / (len(both) - n)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    common = np.minimum(wa[i], wb[j]).sum()
    return float(common / (wa.sum() + wb.sum() - common))


#: Sketch of a text: four bit planes of 128 components, plane i in words 2 i and 2 i + 1.
SKETCH = [f"s{i}" for i in range(8)]


def _apart(x: np.ndarray, y: np.ndarray, words: range) -> np.ndarray:
    """In how many components the sketches x and y (words in the last axis, broadcast) differ, over these planes."""
    halves = (reduce(np.bitwise_or, [x[..., i + h] ^ y[..., i + h] for i in words]) for h in (0, 1))
    return sum(np.bitwise_count(h).astype(np.uint8) for h in halves)


def _alike(s: np.ndarray, i: np.ndarray, j: np.ndarray, differ: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of rows (i, j) those whose sketches differ in at most `differ` components."""
    if differ is not None:
        for words in (range(0, 4, 2), range(0, 8, 2)):  # two planes tell most pairs apart
            near = _apart(s[i], s[j], words) <= differ
            i, j = i[near], j[near]
    return i, j


def _met(s: np.ndarray, starts: np.ndarray, sizes: np.ndarray, differ: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one bucket each whose sketches agree; at most about 130,000 compared at once."""
    for n in np.unique(sizes[(sizes > 1) & (sizes <= 64)]):
        u, v = np.triu_indices(n, 1)
        first = starts[sizes == n]
        step = max(1, (1 << 17) // len(u))
        for at in range(0, len(first), step):
            part = first[at : at + step, None]
            yield _alike(s, (part + u).ravel(), (part + v).ravel(), differ)
    for first, n in zip(starts[sizes > 64], sizes[sizes > 64], strict=True):
        step = max(1, (1 << 17) // n)
        for u in range(0, n, step):
            x, y = s[first + u : min(first + u + step, first + n)], s[first + u : first + n]
            if differ is None:
                i, j = np.indices((len(x), len(y))).reshape(2, -1)
            else:
                i, j = np.nonzero(_apart(x[:, None], y[None], range(0, 4, 2)) <= differ)
            later = i < j
            yield _alike(s, first + u + i[later], first + u + j[later], differ)


def _buckets(keys: int, block: int | None, differ: int | None):
    """For mapInArrow: rows sorted by their first `keys` columns, then r, i (block of the member), sketch -> pairs (a, b);
    of a bucket of more than `block` members the rows themselves, with their key, instead."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(a: np.ndarray, b: np.ndarray | None, rows: np.ndarray | None):
            n = len(a)
            more = [pa.nulls(n, pa.int64())] * (1 + words) if rows is None else [pa.array(rows[:, 0]), *(pa.array(rows[:, keys + 2 + w]) for w in range(words))]
            return pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(n, pa.int64()) if b is None else pa.array(b), *more], ["a", "b", "k", *SKETCH[:words]])

        def pairs(m: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
            s, r = m[:, keys + 2 :].view(np.uint64), m[:, keys]
            for i, j in _met(s, starts, sizes, differ):
                if keys > 1:  # a cell of two blocks: pairs across; of one block: all
                    go = (m[i, 1] == m[i, 2]) | (m[i, keys + 1] != m[j, keys + 1])
                    i, j = i[go], j[go]
                a, b = np.minimum(r[i], r[j]), np.maximum(r[i], r[j])
                if (go := a < b).any():
                    yield out(a[go], b[go], None)

        rest, hot, words = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            m = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            words = m.shape[1] - keys - 2
            if rest is not None:
                m = np.concatenate([rest, m])
            at = np.flatnonzero(np.r_[True, (m[1:, :keys] != m[:-1, :keys]).any(axis=1)])
            sizes = np.diff(np.r_[at, len(m)])
            large = sizes > block if block else np.zeros(len(sizes), bool)
            if hot is not None and (m[0, :keys] == hot).all():
                large[0] = True
            whole = ~large
            whole[-1] = False
            yield from pairs(m, at[whole], sizes[whole])
            if large.any():
                rows = m[np.repeat(large, sizes)]
                yield out(rows[:, keys], None, rows)
            # the last bucket may go on in the next batch
            hot = m[-1, :keys].copy() if large[-1] else None
            rest = None if large[-1] else m[at[-1] :].copy()
        if rest is not None:
            yield from pairs(rest, np.array([0]), np.array([len(rest)]))

    return run


def candidate_pairs(banded: DataFrame, block: int = 4000, differ: int | None = None, rounds: list[Column] | None = None) -> DataFrame:
    """(a, b), a < b, once each: the pairs of members r that share a key k of banded(k, r); with `differ` only those whose
    sketches (columns `SKETCH` of banded) differ in at most so many components. With `rounds`, banded has an array for
    k and each of these columns takes the keys of one round out of it; no round is on disk with another."""
    sketch = SKETCH if differ is not None else []
    form = "a bigint, b bigint, k bigint" + "".join(f", {x} bigint" for x in sketch)
    with scratch(banded.sparkSession) as s:
        parts = []
        for keys in rounds or [None]:
            rows = banded.select((F.col("k") if keys is None else F.explode(keys)).alias("k"), "r", F.lit(0).cast("bigint").alias("i"), *sketch)
            parts.append(s.keep(rows.repartition("k").sortWithinPartitions("k").mapInArrow(_buckets(1, block, differ), form)))
        met = reduce(DataFrame.union, parts)
        hot = met.where("b is null").select("k", F.col("a").alias("r"), *sketch)
        met = met.where("b is not null").select("a", "b")
        if not hot.isEmpty():
            large = hot.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / block).cast("bigint").alias("g"))
            rows = hot.join(large, "k").withColumn("i", F.pmod(F.xxhash64("r"), F.col("g")).cast("bigint"))
            cells = rows.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("g") - 1)).alias("j"))
            cells = cells.select("k", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "r", "i", *sketch).repartition("k", "p", "q").sortWithinPartitions("k", "p", "q")
            met = met.union(cells.mapInArrow(_buckets(3, None, differ), form).select("a", "b"))
        return checkpoint(met.distinct())


def similar_classes(texts: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """As `_similar_classes`; both results are written, all else that it wrote is deleted."""
    with scratch(texts.sparkSession) as tables:
        return _similar_classes(tables, texts, **how)


def _similar_classes(tables: Scratch, texts: DataFrame, threshold: float = 0.7, shingle: int = 5, unit: str = "char", weighted: bool = False, bands: int = 32, rows: int = 4, deviations: float = 4.0) -> tuple[DataFrame, DataFrame]:
    """texts(id string, t string) -> (members(id, c bigint, first, long), links(a, b, similarity) between classes c);
    `first` marks the member whose text stands for its class, `long` texts of at least one shingle.

    The sketch keeps four bits of each of 128 components, in bit planes; a candidate stays if as many components agree
    as are expected at the threshold, less `deviations` standard deviations. With 32 bands of 4, a pair at 0.7 is missed with probability
    0.00015, one at 0.8 with 0.00000005.
    """
    m = bands * rows
    if m < 128:
        raise ValueError("the sketch takes 128 components")
    agree = threshold + (1 - threshold) / 16
    least = math.floor(128 * agree - deviations * math.sqrt(128 * agree * (1 - agree)))
    cut = char_shingles if unit == "char" else word_shingles
    enough = F.length("t") >= shingle if unit == "char" else F.length(F.trim("t")) > 0
    def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        if weighted:
            return np.unique(h, return_counts=True)
        h = np.sort(h)
        return h[np.r_[True, h[1:] != h[:-1]]] if len(h) else h, None

    # normalised once, read by classes, signatures and verification; a filter before it is written would normalise twice
    base = tables.keep(texts.select("id", "t", F.xxhash64("id").alias("r"), F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(1), F.col("t")).alias("h2"), enough.alias("long"))).where("t is not null")
    classes = base.groupBy("h1", "h2").agg(F.min("r").alias("c"))
    members = checkpoint(base.select("id", "r", "long", "h1", "h2").join(classes, ["h1", "h2"]).select("id", "c", (F.col("r") == F.col("c")).alias("first"), "long").distinct())
    firsts = base.where("long").join(members.where("first and long").select(F.col("c").alias("r")), "r", "left_semi").select("r", "t")

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for pdf in batches:
            for at in range(0, len(pdf), 64):
                part = pdf.iloc[at : at + 64]
                pairs = [distinct(cut(t, shingle)) for t in part["t"]]
                keep = [i for i, p in enumerate(pairs) if len(p[0])]
                if not keep:
                    continue
                sig = bag_minhash([pairs[i][0] for i in keep], m, [pairs[i][1] for i in keep] if weighted else None)
                nibbles = mix(sig[:, :128])
                planes = np.concatenate([np.packbits((nibbles >> np.uint64(i) & np.uint64(1)).astype(np.uint8), axis=1).view("<i8") for i in range(4)], axis=1)
                folded = sig.reshape(len(keep), bands, rows)
                key = np.broadcast_to(seeds, (len(keep), bands)).copy()
                for j in range(rows):
                    key = mix(key * _GOLD + folded[:, :, j])
                yield pd.DataFrame({"r": part["r"].to_numpy()[keep]} | {x: planes[:, i] for i, x in enumerate(SKETCH)} | {"ks": list(key.view(np.int64))})

    signed = tables.keep(firsts.mapInPandas(sign, "r bigint" + "".join(f", {x} bigint" for x in SKETCH) + ", ks array<bigint>"))
    per = max(1, bands // 4)
    rounds = [F.slice("k", at, per) for at in range(1, bands + 1, per)]
    cand = candidate_pairs(signed.withColumnRenamed("ks", "k"), differ=128 - least, rounds=rounds)
    tables.drop(signed)
    used = cand.select(F.col("a").alias("r")).union(cand.select("b")).distinct()
    some = firsts.join(used, "r", "left_semi")
    pairs = cand.join(some.toDF("a", "ta"), "a").join(some.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made: dict[int, tuple] = {}

            def of(r: int, t: str) -> tuple:
                if r not in made:
                    made[r] = distinct(cut(t, shingle))
                return made[r]

            sims = []
            for a, b, ta, tb in pdf.itertuples(index=False):
                (p, wp), (q, wq) = of(a, ta), of(b, tb)
                sims.append(overlap(p, q, wp, wq) if weighted else overlap(p, q))
            out = pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "similarity": np.array(sims, dtype=float)})
            yield out[out["similarity"] >= threshold]

    return members, checkpoint(pairs.mapInPandas(verify, "a bigint, b bigint, similarity double"))


def similar_pairs(texts: DataFrame, **how) -> DataFrame:
    """All pairs (a, b), a < b, of texts(id, t) at least the threshold alike, copies within a class included.

    The result grows with the square of a class of copies; `similar_groups` is the form for a large corpus.
    """
    members, links = similar_classes(texts, **how)
    ids = members.select("c", "id")
    across = links.select("a", "b").join(ids.toDF("a", "x"), "a").join(ids.toDF("b", "y"), "b").select("x", "y")
    repeated = not members.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    several = members.where("long").groupBy("c").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("c")
    m = ids.join(several, "c", "left_semi")
    within = m.select("c", F.col("id").alias("x")).join(m.select("c", F.col("id").alias("y")), "c").where("x < y").select("x", "y")
    both = across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).union(within.toDF("a", "b"))
    # a pair comes twice only where an id stands for several texts
    return both.distinct() if repeated else both


def similar_groups(texts: DataFrame, **how) -> DataFrame:
    """One row per text: id, class_id (the least id of its exact copies), group_id (the least class of its connected
    group; the class itself if it has no link) and n_links (links of its class to other classes)."""
    members, links = similar_classes(texts, **how)
    comp = connected_components(links.select("a", "b"))
    degree = links.select(F.col("a").alias("c")).union(links.select("b")).groupBy("c").agg(F.count(F.lit(1)).alias("n_links"))
    names = members.groupBy("c").agg(F.min("id").alias("class_id"))
    named = names.join(comp.select(F.col("node").alias("c"), F.col("component").alias("g")), "c", "left").join(degree, "c", "left")
    groups = named.where("g is not null").groupBy("g").agg(F.min("class_id").alias("group_id"))
    named = named.join(groups, "g", "left")
    return members.select("id", "c").join(named, "c").select("id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
