"""Splitting oversized items at natural boundaries, by ranges.

From a cut the next one is sought as far ahead as a piece may reach, the limit less the overlap: a strong boundary
(blank line, line or row end, sentence end) in the farther half, else one in the nearer half but its first quarter,
else a weak one (clause, cell, space), else any; the strongest and of equals the latest. Only where a stretch holds no
boundary at all is it cut at a multiple of a sixteenth of the reach. So the next cut depends on nothing but the text ahead of a cut.

Ranges with halos on both sides are looked at independently. A range follows the cuts from every place at which it can
be entered (its first boundaries) to the place at which it is left; the result is a small table from entry to exit,
number of pieces and cuts on the way. These tables are stitched along the item in two levels (blocks of ranges first,
so a giant file's tables never meet in one task), piece numbers being prefix sums of the pieces of the ranges before,
and the pieces are then emitted by offset: [previous cut - overlap, cut). Items of one range need no stitching.

For files the same tables are built over byte ranges (`split_file`); each task seeks to its range, no file is loaded.

Defined results: null texts are no items; an item at or under its limit is one piece; an element delivered twice
counts once; null cells are empty; a limit below the overlap is an error; white space runs of over 200 characters are
no boundaries.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvane.llm.repeated import latest
from tallyvane.session import checkpoint, spread

RANGE, HALO, LONGEST, BLOCK = 65536, 512, 200, 1000
STRONG = 3
#: (strength, pattern whose end is the boundary), strongest first.
TEXT_BOUNDARIES = [(5, re.compile(r"\n[ \t\r]*\n\s*")), (4, re.compile(r"\r?\n")), (3, re.compile(r"(?:[.!?…][\"”’»)\]]*[ \t\xa0]+|[。！？][」』”）]*|[।؟][\"»]*\s*)")), (2, re.compile(r"[,;:،；，、][ \t]*")), (1, re.compile(r"\s+"))]
TABLE_BOUNDARIES = [(5, re.compile(r"\r?\n")), (2, re.compile(r" \| ")), (1, re.compile(r"\s+"))]


def grid_text(grid: Column) -> Column:
    """A table's rows joined by a line feed, its cells by ' | '; a null cell or row is empty."""
    row = lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | ")
    return F.array_join(F.transform(grid, lambda r: F.coalesce(row(r), F.lit(""))), "\n")


def grid_size(grid: Column) -> Column:
    """The length of `grid_text` without building it: cell lengths and separators summed."""
    cells = lambda r: F.aggregate(F.coalesce(r, F.array().cast("array<string>")), F.lit(0), lambda n, c: n + F.coalesce(F.length(c), F.lit(0))) + 3 * F.greatest(F.size(F.coalesce(r, F.array().cast("array<string>"))) - 1, F.lit(0))
    return F.aggregate(grid, F.lit(0), lambda n, r: n + cells(r)) + F.greatest(F.size(grid) - 1, F.lit(0))


def items(chunks: DataFrame, elements: DataFrame, limits: DataFrame) -> DataFrame:
    """(record_kind, record_id, item_type, size, max_chars, overlap_chars, t, g): text and table items under a
    stated limit; t is the content, g a table element's grid (its text is only built where it is split)."""
    c = chunks.where("chunk_type in ('text', 'table') and content is not null").select(F.lit("chunk").alias("record_kind"), F.col("chunk_id").alias("record_id"), F.col("chunk_type").alias("item_type"), F.length("content").cast("bigint").alias("size"), F.col("content").alias("t"), F.lit(None).cast("array<array<string>>").alias("g"))
    e = elements.where("element_type in ('text', 'table')").select("element_id", "element_type", F.when(F.col("element_type") == "text", F.col("content")).alias("t"), F.when(F.col("element_type") == "table", F.col("grid")).alias("g"), "ingested_at")
    e = e.select(F.lit("element").alias("record_kind"), F.col("element_id").cast("string").alias("record_id"), F.col("element_type").alias("item_type"), F.when(F.col("element_type") == "text", F.length("t")).otherwise(grid_size(F.col("g"))).cast("bigint").alias("size"), "t", "g", F.col("ingested_at").alias("at"))
    both = c.withColumn("at", F.lit(None).cast("timestamp")).unionByName(e).where(F.col("size").isNotNull() & F.col("record_id").isNotNull())
    return both.join(F.broadcast(limits.select("record_kind", "item_type", "max_chars", "overlap_chars")), ["record_kind", "item_type"])  # one row for each kind and type


def oversized(chunks: DataFrame, elements: DataFrame, limits: DataFrame) -> DataFrame:
    """The items larger than their limit, each once (an element by its latest delivery among the large ones)."""
    big = items(chunks, elements, limits).where(F.col("size") > F.col("max_chars"))
    e = big.where("record_kind = 'element'")
    last = latest(e, "record_id", "at")
    return big.where("record_kind = 'chunk'").drop("at").unionByName(last.select(*[c for c in big.columns if c != "at"]))


def plan(max_chars: int, overlap: int) -> tuple[int, int]:
    """(reach, step): how far ahead of a cut the next one may lie, and the grid of cuts where there is no boundary."""
    reach = max_chars - overlap
    if reach < 4:
        raise ValueError("the limit must exceed the overlap")
    return reach, max(1, reach // 16)


def boundaries(text: str, table: bool) -> dict[int, int]:
    """Strength by position of the boundaries of a text."""
    found: dict[int, int] = {}
    for strength, pattern in TABLE_BOUNDARIES if table else TEXT_BOUNDARIES:
        for m in pattern.finditer(text):
            if m.end() - m.start() <= LONGEST:
                found.setdefault(m.end(), strength)
    return found


class Cutter:
    """The cuts of one range [lo, hi) of an item, from its boundaries (absolute positions with strengths)."""

    def __init__(self, at: list[int], strength: list[int], size: int, most: int, reach: int):
        self.at, self.strength, self.size, self.most, self.reach = at, strength, size, most, reach
        self.memo: dict[int, int] = {}

    def next(self, c: int) -> int:
        """The cut that follows cut c."""
        if c in self.memo:
            return self.memo[c]
        room = self.most if c == 0 else self.reach  # the first piece has no overlap
        if self.size - c <= room:
            out = self.size
        else:
            # the first piece is no shorter than what it shares with the second
            least = self.most - self.reach if c == 0 else 0
            a, q, m, b = (bisect_right(self.at, c + max(x, least)) for x in (0, room // 8, room // 2, room))
            far, mid, near = (max(self.strength[x:y], default=0) for x, y in ((m, b), (q, m), (a, q)))
            lo, hi, best = (q, m, mid) if mid >= STRONG > far or mid > far == 0 else (a, q, near) if near > far == mid == 0 else (m, b, far)
            out = next(self.at[i] for i in range(hi - 1, lo - 1, -1) if self.strength[i] == best)
        self.memo[c] = out
        return out

    def walk(self, c: int, hi: int) -> list[int]:
        """The cuts after entry c up to the first at or behind `hi` (or the item's end)."""
        out = []
        while not out or (out[-1] < hi and out[-1] < self.size):
            out.append(self.next(out[-1] if out else c))
        return out


def range_table(at: list[int], strength: list[int], lo: int, hi: int, size: int, most: int, overlap: int) -> tuple[list[int], list[list[int]]]:
    """(entries, the cuts from each entry to the exit) of the range [lo, hi)."""
    reach, _ = plan(most, overlap)
    c = Cutter(at, strength, size, most, reach)
    entries = [0] if lo == 0 else [x for x in at if lo <= x < min(lo + reach, hi, size)]
    return entries, [c.walk(e, hi) for e in entries]


def _table_rows(pdf: pd.DataFrame) -> Iterator[tuple]:
    for r in pdf.itertuples(index=False):
        _, step = plan(r.max_chars, r.overlap_chars)
        first = max(0, r.s - HALO)
        found = {first + p: v for p, v in boundaries(r.x, r.is_table).items()}
        end = first + len(r.x)
        for p in range(-(-max(r.s, 1) // step) * step, end, step):
            found.setdefault(p, 0)
        at = sorted(p for p in found if r.s <= p < r.size and p > 0)
        yield r, range_table(at, [found[p] for p in at], r.s, r.s + RANGE, r.size, r.max_chars, r.overlap_chars)


def stitch(tables: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, no, entry, base): where each range is entered and the number of pieces before it.

    tables: keys, no (0, 1, ... along the item), es (entries), xs (exits), ns (pieces), one row a range.
    """
    kinds = dict(tables.dtypes)
    typed = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def maps(pdf: pd.DataFrame) -> list[tuple[int, dict[int, tuple[int, int]]]]:
        return [(int(no), dict(zip(map(int, es), zip(map(int, xs), map(int, ns))))) for no, es, xs, ns in pdf.sort_values("no")[["no", "es", "xs", "ns"]].itertuples(index=False)]

    def through(m: list, entry: int, base: int) -> Iterator[tuple[int, int, int]]:
        for no, t in m:
            yield no, entry, base
            # an item may end in the range before: then nothing is left to enter
            entry, n = t.get(entry, (entry, 0))
            base += n
        yield -1, entry, base

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        m = maps(pdf)
        es = list(m[0][1])
        ends = [list(through(m, e, 0))[-1] for e in es]
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "no": [m[0][0] // BLOCK], "es": [es], "xs": [[x for _, x, _ in ends]], "ns": [[n for _, _, n in ends]]})

    def enter(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(through(maps(pdf), 0, 0))[:-1]
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "no": [r[0] for r in rows], "entry": [r[1] for r in rows], "base": [r[2] for r in rows]})

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(through(maps(pdf), int(pdf["entry"].iloc[0]), int(pdf["base"].iloc[0])))[:-1]
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "no": [r[0] for r in rows], "entry": [r[1] for r in rows], "base": [r[2] for r in rows]})

    block = (F.col("no") / BLOCK).cast("bigint")
    blocks = tables.groupBy(*keys, block.alias("__b")).applyInPandas(compose, f"{typed}, no bigint, es array<bigint>, xs array<bigint>, ns array<bigint>")
    entered = blocks.groupBy(*keys).applyInPandas(enter, f"{typed}, no bigint, entry bigint, base bigint").withColumnRenamed("no", "__b")
    return tables.withColumn("__b", block).join(entered, [*keys, "__b"]).groupBy(*keys, "__b").applyInPandas(inside, f"{typed}, no bigint, entry bigint, base bigint")


def _ranges(big: DataFrame) -> DataFrame:
    """The items' ranges: s, x (its text with a halo before and the reach of a piece behind) and one (a single range)."""
    cols = ["record_kind", "record_id", "is_table", "size", "max_chars", "overlap_chars"]
    rows = big.select("record_kind", "record_id", (F.col("item_type") == "table").alias("is_table"), "size", "max_chars", "overlap_chars", "t")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                for s in range(0, r.size, RANGE):
                    yield pd.DataFrame([(*r[:6], s, r.t[max(0, s - HALO) : s + RANGE + r.max_chars + HALO])], columns=[*cols, "s", "x"])

    small = rows.where(F.col("size") <= RANGE).select(*cols, F.lit(0).cast("bigint").alias("s"), F.col("t").alias("x"))
    large = rows.where(F.col("size") > RANGE).mapInPandas(cut, "record_kind string, record_id string, is_table boolean, size bigint, max_chars int, overlap_chars int, s bigint, x string")
    return spread(small.unionByName(large), "record_id", "s")


def pieces(big: DataFrame) -> DataFrame:
    """(record_kind, record_id, piece_no, start_char, end_char) of every item of `big`, offsets in its text.

    `big` has record_kind, record_id, item_type, size, max_chars, overlap_chars, t and g.
    """
    ranges = _ranges(big.withColumn("t", F.coalesce(F.col("t"), grid_text(F.col("g")))).withColumns({c: F.col(c).cast("int") for c in ("max_chars", "overlap_chars")}))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(r.record_kind, r.record_id, r.overlap_chars, r.s // RANGE, r.size <= RANGE, es, [w[-1] for w in ws], [len(w) for w in ws], ws) for r, (es, ws) in _table_rows(pdf)]
            yield pd.DataFrame(out, columns=["record_kind", "record_id", "overlap_chars", "no", "one", "es", "xs", "ns", "ws"])

    tables = ranges.mapInPandas(run, "record_kind string, record_id string, overlap_chars int, no bigint, one boolean, es array<bigint>, xs array<bigint>, ns array<bigint>, ws array<array<bigint>>")
    tables = checkpoint(tables)
    keys = ["record_kind", "record_id"]
    entered = stitch(tables.where(~F.col("one")).select(*keys, "no", "es", "xs", "ns"), keys)
    rest = tables.where(~F.col("one")).join(entered, [*keys, "no"])
    whole = tables.where("one").withColumns({"entry": F.lit(0).cast("bigint"), "base": F.lit(0).cast("bigint")})
    p = whole.unionByName(rest.select(*whole.columns)).withColumn("w", F.get("ws", (F.array_position("es", F.col("entry")) - 1).cast("int"))).where("w is not null")
    p = p.select(*keys, "overlap_chars", "base", "entry", F.col("w"), F.posexplode("w").alias("i", "cut"))
    before = F.when(F.col("i") == 0, F.col("entry")).otherwise(F.get("w", F.col("i") - 1))
    return p.select(*keys, (F.col("base") + F.col("i")).alias("piece_no"), F.greatest(before - F.col("overlap_chars"), F.lit(0)).cast("bigint").alias("start_char"), F.col("cut").alias("end_char"))


def piece_texts(big: DataFrame) -> DataFrame:
    """`pieces` with column `piece`, the text of each: an item meets the list of its own pieces once."""
    built = big.select("record_kind", "record_id", F.coalesce(F.col("t"), grid_text(F.col("g"))).alias("t"))
    by = pieces(big).groupBy("record_kind", "record_id").agg(F.collect_list(F.struct("piece_no", "start_char", "end_char")).alias("ps"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(r.record_kind, r.record_id, x["piece_no"], x["start_char"], x["end_char"], r.t[x["start_char"] : x["end_char"]]) for r in pdf.itertuples(index=False) for x in r.ps], columns=["record_kind", "record_id", "piece_no", "start_char", "end_char", "piece"])

    return built.join(by, ["record_kind", "record_id"]).mapInPandas(run, "record_kind string, record_id string, piece_no bigint, start_char bigint, end_char bigint, piece string")


def split_file(spark: SparkSession, path: str, max_bytes: int, overlap_bytes: int = 0, range_bytes: int = 1 << 24, encoding: str = "utf-8") -> DataFrame:
    """(path, piece_no, start_byte, end_byte) of a UTF-8 file of any size, read by byte ranges with halos.

    Every piece has at most `max_bytes` and starts `overlap_bytes` before the previous one ends (moved back to a
    character's first byte). A task reads its own range, 4 KB before it and the reach of a piece behind it, once. An
    empty file has no pieces.
    """
    from pyarrow import fs

    most, overlap, before = max_bytes, overlap_bytes + 4, 4 * HALO + overlap_bytes + 4
    reach, step = plan(most, overlap)
    filesystem, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    size = filesystem.get_file_info(name).size or 0
    if not size:
        return spark.createDataFrame([], "path string, piece_no bigint, start_byte bigint, end_byte bigint")

    def read(s: int, n: int) -> bytes:
        f, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        with f.open_input_file(at) as h:
            return h.read_at(n, s)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for no in pdf["id"]:
                s = int(no) * range_bytes
                a = max(0, s - before)
                raw = read(a, range_bytes + most + 4 * HALO + (s - a))
                lead = next((i for i, c in enumerate(raw[:4]) if c & 0xC0 != 0x80), 0)  # the rest of a character
                x = raw[lead:].decode(encoding, "ignore")
                c = np.frombuffer(x.encode("utf-32-le"), dtype="<u4")
                at = a + lead + np.concatenate(([0], np.cumsum(1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))))
                first = lambda p: int(at[np.searchsorted(at, p, side="right") - 1])  # noqa: E731, B023 - a character's first byte
                found = {int(at[i]): v for i, v in boundaries(x, False).items()}
                for p in range(-(-max(s, 1) // step) * step, min(int(at[-1]), size), step):
                    found.setdefault(first(p), 0)
                places = sorted(p for p in found if s <= p < size and p > 0)
                es, ws = range_table(places, [found[p] for p in places], s, s + range_bytes, size, most, overlap)
                starts = [[max(0, first(p - overlap_bytes)) if p > overlap_bytes else 0 for p in [e, *w[:-1]]] for e, w in zip(es, ws)]
                yield pd.DataFrame({"no": [int(no)], "es": [es], "xs": [[w[-1] for w in ws]], "ns": [[len(w) for w in ws]], "ws": [ws], "ss": [starts]})

    ranges = spark.range(0, -(-size // range_bytes), 1, min(-(-size // range_bytes), 100_000))
    tables = checkpoint(ranges.mapInPandas(run, "no bigint, es array<bigint>, xs array<bigint>, ns array<bigint>, ws array<array<bigint>>, ss array<array<bigint>>").withColumn("path", F.lit(path)))
    p = tables.join(stitch(tables.select("path", "no", "es", "xs", "ns"), ["path"]), ["path", "no"])
    i = (F.array_position("es", F.col("entry")) - 1).cast("int")
    p = p.select("path", "base", F.arrays_zip(F.get("ws", i).alias("w"), F.get("ss", i).alias("s")).alias("z")).where("z is not null")
    return p.select("path", "base", F.posexplode("z").alias("i", "z")).select("path", (F.col("base") + F.col("i")).alias("piece_no"), F.col("z.s").alias("start_byte"), F.col("z.w").alias("end_byte"))


def split_found(chunks: DataFrame, elements: DataFrame, limits: DataFrame) -> DataFrame:
    """(record_kind, record_id) of every item that comes out in more than one piece."""
    return pieces(oversized(chunks, elements, limits)).where("piece_no = 1").select("record_kind", "record_id").distinct()
