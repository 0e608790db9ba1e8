"""Text cut off by field limits: a backward character n-gram model of how texts end.

For the last 1, 2, 3, 4, 6, ... characters of a value the model knows how often, over the whole corpus, a text
ended there and how often it went on. Starting from the shortest context, the end probability is replaced by a
longer context's whenever that differs significantly (Poisson bound), so that " approx." or a sentence inside an
open quotation is told from a sentence that ends. The log-odds of ending are thresholded per language, at the
emptiest stretch of their histogram; each language's histogram is blended with that of all languages by a fixed
weight, so the rule of a language follows its own texts the more of them there are. Endings are counted once for each
distinct tail, so republished texts lend each other no support, and a value's own ending is left out of its judgement.

Names, numbers and initials are masked before counting, and list items have their spaces marked, as a list item
ends without a full stop. A remnant that a cut may leave (an ellipsis character, a bracketed ellipsis, half a
character, tag or entity) is a feature, not a verdict: the model judges the text before it, and the remnant's
likelihood ratio between texts that go on and texts that end, as found in the corpus, is added to the log-odds, up to
`most_shift`. Endings with a remnant are not counted as ends.

Contexts are counted at all positions of all texts: a fixed-size bit filter of the contexts in which some text
ends keeps out the others (false positives cost rows, not correctness), counts are pre-aggregated per batch, and
as contexts nest, longer ones are looked at only where the shorter one passed. Contexts of few characters belong to
most texts; their counts are joined under as many salts as the session has shuffle partitions, at most 256 (the adaptive
skew join splits what is still hot; more copies of each count would cost more than they spread).

Defined results: null, empty and blank texts are no case; ties and copies get the same verdict; unknown languages
share one threshold.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvane.session import checkpoint, spread

ORDERS = (1, 2, 3, 4, 6, 8, 10, 12, 16, 20, 24, 32)
#: Remnants at the end of a text: bracketed ellipsis or word, ellipsis, half a character, half a tag, half an entity.
_ENTITY = "|".join(sorted({"&" + e[:i] for e in ("amp", "lt", "gt", "quot", "apos", "nbsp", "mdash", "ndash", "rsquo", "lsquo", "rdquo", "ldquo", "hellip", "euro", "copy") for i in range(1, len(e) + 1)}, key=len, reverse=True))
MARK = re.compile(rf"(?:\s*(?:(?P<b>\[(?:\.\.\.|…|[a-z ]{{0,12}})\])|(?P<e>…)|(?P<c>�+)|(?P<t><[a-zA-Z/]{{0,8}})|(?P<n>(?:{_ENTITY}|&#x?[0-9a-fA-F]{{0,6}});?)))+\s*$")
KINDS = ("", "b", "e", "c", "t", "n")
_NAME = re.compile(r"[A-Z][a-z]{4,}(?: [A-Z][a-z]{2,3}(?= [A-Z][a-z]{4}))?")
_CODE = re.compile(r"(?:[A-Z0-9]{2,}-)+[A-Z0-9]+")
# patterns that begin with a set of characters are sought fastest: one digit and more, an initial with no letter before it
_DIGITS = re.compile(r"[0-9][0-9]*")
_CODE_HINT = re.compile(r"-[A-Z0-9]{2,}")
_INITIAL = re.compile(r"[A-Z]\. (?<!\w...)")
_ITEM = re.compile(r"(?m)^(?:[•*·–-]|0[.)]) .*$")
_RAW_ITEM = re.compile(r"[^\S\n]*(?:[•*·–-]|[0-9]+[.)]) ")
_MARK_HINT = re.compile(r"[\[…�<&]")
#: Stands between texts laid end to end; no text has it, as UTF-8 cannot hold half a surrogate pair.
_GAP = "\ud800"
_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def remnant(text: str, longest: int = 80) -> re.Match | None:
    """The remnants at the end of a text, of `longest` characters at most."""
    start = max(0, len(text) - longest)
    return MARK.search(text, start) if _MARK_HINT.search(text, start) else None


def mask(text: str, codes: bool | None = None) -> str:
    """Names as X, code words as Q, digits as 0, initials as I., line breaks as one line feed, spaces of list
    items as _. Code words are sought where a text has one of the usual form; `codes` tells so for a part of a text."""
    if _CODE_HINT.search(text) if codes is None else codes:
        text = _CODE.sub("Q", text)
    t = _DIGITS.sub("0", _NAME.sub("X", text))
    if ". " in t:
        t = _INITIAL.sub("I. ", t)
    if "\n" in t:
        t = _ITEM.sub(lambda m: m.group().replace(" ", "_"), "\n".join(x for x in map(str.strip, t.split("\n")) if x))
    return t


def masked_end(text: str, codes: bool, size: int = ORDERS[-1], window: int = 192) -> str:
    """The last `size` characters of the masked text, from a window at its end that is doubled until it holds them.

    A window begins at a space, so that no word is cut; what stands for the text before it tells whether there was a line
    break and whether the line is a list item. Up to five masked characters at its start may differ from the whole
    text's: the stand-in and a short second name (" Van") that belongs to a name before the window.
    """
    while window < len(text):
        at = text.find(" ", len(text) - window)
        line = text.rfind("\n", 0, max(at, 0)) + 1
        if at > line and not text[line:at].isspace():
            s = mask(("\n" if line else "") + ("•" if _RAW_ITEM.match(text, line) else "X") + text[at:], codes)
            if len(s) >= size + 8:
                return s[-size:]
        window *= 2
    return mask(text, codes)[-size:]


class Hasher:
    """Hashes of the k characters before a position, from prefix sums modulo 2^64."""

    def __init__(self, size: int = 1 << 12):
        self.grow(size)

    def grow(self, size: int) -> None:
        self.size = size
        self.power, self.inverse = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, v, np.uint64))), dtype=np.uint64) for v in (_BASE, _INVERSE))

    @staticmethod
    def codes(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")

    @staticmethod
    def single(codes: np.ndarray) -> np.ndarray:
        """The hashes that `at` gives for contexts of one character."""
        return Hasher._mixed(codes.astype(np.uint64) + np.uint64(8))

    def prefix(self, text: str) -> np.ndarray:
        c = self.codes(text).astype(np.uint64) + np.uint64(7)
        if len(c) > self.size:
            self.grow(2 * len(c))
        out = np.zeros(len(c) + 1, np.uint64)
        np.cumsum(c * self.power[: len(c)], out=out[1:])
        return out

    def at(self, prefix: np.ndarray, pos: np.ndarray, k: int | np.ndarray) -> np.ndarray:
        start = pos - k
        h = (prefix[pos] - prefix[start]) * self.inverse[start] + (k.astype(np.uint64) if isinstance(k, np.ndarray) else np.uint64(k))
        return self._mixed(h)

    def everywhere(self, prefix: np.ndarray, first: int, k: int) -> np.ndarray:
        """What `at` gives for all positions from `first` that have a character behind them."""
        last = len(prefix) - 1
        h = prefix[first:last] - prefix[first - k : last - k]
        h *= self.inverse[first - k : last - k]
        h += np.uint64(k)
        return self._mixed(h)

    @staticmethod
    def _mixed(h: np.ndarray) -> np.ndarray:
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h


def _end_contexts(docs: DataFrame) -> DataFrame:
    """(d, l, n, kind, tail, h): of each text its length, its remnant (0 for none), a hash of its raw tail and its
    contexts' hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        hasher, orders = Hasher(), np.array(ORDERS)
        for pdf in batches:
            ends, kinds, tails, full = [], [], [], []
            for t, code in zip(pdf["t"], pdf["code"]):
                t = t.rstrip()
                full.append(bool(t))
                if t:
                    m = remnant(t)
                    code = bool(code or _CODE_HINT.search(t))
                    ends.append(masked_end(t[: m.start()] if m else t, code))
                    kinds.append(KINDS.index(m.lastgroup) if m else 0)
                    tails.append(xxhash.xxh64_intdigest(t[-200:].encode("utf-8", "surrogatepass")))
            # the ends laid end to end behind a gap as long as the longest context
            sizes = np.array([len(s) for s in ends], np.int64)
            h = hasher.at(hasher.prefix(_GAP * ORDERS[-1] + "".join(ends)), (ORDERS[-1] + np.cumsum(sizes))[:, None], orders[None, :]).view(np.int64)
            hs = [r[:n].tolist() for r, n in zip(h, np.searchsorted(orders, sizes, side="right"))]
            of = pdf[np.array(full, bool)]
            yield pd.DataFrame({"d": of["d"].to_numpy(), "l": of["l"].to_numpy(), "n": of["n"].to_numpy(), "kind": np.array(kinds, np.int32), "tail": np.array(tails, np.uint64).view(np.int64), "h": hs})

    # of texts of over 4,096 bytes the last 800 characters and the rest of the line they begin in, with its line feed
    # (list items are marked only in texts of several lines), and whether the whole has a code word: enough for the
    # longest context, a remnant and the whole list item they stand in; only these travel to the cores
    long = F.octet_length("t") > 4096
    head = F.expr("left(t, length(t) - 800)")
    line = F.concat(F.when(F.instr(head, "\n") > 0, "\n").otherwise(""), F.substring_index(head, "\n", -1))
    short = docs.select("d", "l", F.length("t").alias("n"), F.when(long, F.rtrim("t", F.lit(_BLANKS))).otherwise(F.col("t")).alias("t"))
    short = short.select("d", "l", "n", F.when(long & (F.length("t") > 800), F.concat(line, F.expr("right(t, 800)"))).otherwise(F.col("t")).alias("t"), F.when(long, F.col("t").rlike("-[A-Z0-9]{2}")).otherwise(False).alias("code"))
    return spread(short).mapInPandas(run, "d bigint, l string, n bigint, kind int, tail bigint, h array<bigint>")


def _continuations(docs: DataFrame, keys: DataFrame, per_key: int = 16, most_bits: int = 1 << 27) -> DataFrame:
    """(h, n): how often each context of `keys` (and false positives of the filter) goes on, in all texts."""
    spark = docs.sparkSession
    bits = 1 << max(16, min(most_bits, per_key * max(1, keys.count())).bit_length() - 1)
    at = F.shiftrightunsigned("h", 64 - (bits.bit_length() - 1))
    words = keys.select(at.alias("x")).select(F.expr("cast(x div 64 as int)").alias("w"), F.expr("shiftleft(1L, cast(x % 64 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    table = np.zeros(bits // 64, np.uint64)
    got = words.toPandas()  # at most most_bits / 64 words, 16 MB
    table[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64) if len(got) else []
    shared = spark.sparkContext.broadcast(table)
    shift = np.uint64(64 - (bits.bit_length() - 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, filt, most = Hasher(), shared.value, ORDERS[-1]

        def counted(parts: list[np.ndarray]) -> pd.DataFrame:
            u, n = np.unique(np.concatenate(parts), return_counts=True)
            return pd.DataFrame({"h": u.view(np.int64), "n": n.astype(np.int64)})

        def passing(h: np.ndarray) -> np.ndarray:
            i = h >> shift
            return (filt[(i >> np.uint64(6)).view(np.int64)] >> (i & np.uint64(63)) & np.uint64(1)).astype(bool)

        def hits(texts: list[str]) -> list[np.ndarray]:
            """The passing contexts of two characters and more of texts laid end to end with gaps between: what reaches
            over a gap is no context of a key."""
            s = _GAP * most + _GAP.join(texts)
            p, out = hasher.prefix(s), []
            # a text's own end is no continuation
            ok = hasher.codes(s)[most:] != ord(_GAP)
            for k in ORDERS[1:4]:  # most positions pass: all are hashed, without an index
                h = hasher.everywhere(p, most, k)
                ok &= passing(h)
                out.append(h[ok])
            pos = np.flatnonzero(ok) + most
            for k in ORDERS[4:]:
                h = hasher.at(p, pos, k)
                ok = passing(h)
                pos, h = pos[ok], h[ok]
                out.append(h)
            return out

        parts, size, chars, texts, have = [], 0, np.zeros(0, np.int64), [], 0
        for pdf in batches:
            for t in pdf["t"]:
                t = t.rstrip()
                m = remnant(t)
                s = mask(t[: m.start()] if m else t)
                texts.append(s)
                have += len(s)
                if have > 40_000:
                    n = np.bincount(hasher.codes("".join(s[:-1] for s in texts)))
                    if len(n) > len(chars):
                        chars = np.concatenate((chars, np.zeros(len(n) - len(chars), np.int64)))
                    chars[: len(n)] += n
                    new = hits(texts)
                    parts += new
                    size += sum(map(len, new))
                    texts, have = [], 0
                if size > 2_000_000:
                    yield counted(parts)
                    parts, size = [], 0
        if texts:
            n = np.bincount(hasher.codes("".join(s[:-1] for s in texts)), minlength=len(chars))
            n[: len(chars)] += chars
            chars = n
            parts += hits(texts)
        seen = np.flatnonzero(chars)
        yield pd.DataFrame({"h": hasher.single(seen).view(np.int64), "n": chars[seen]})
        if parts:
            yield counted(parts)

    return docs.select("t").mapInPandas(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n_on"))


def _end_log(stats: Column, marked: Column, base: Column) -> Column:
    """log10 of the end probability from the contexts' (n_end, n_on), shortest first."""

    def step(p: Column, s: Column) -> Column:
        ne = F.greatest(s["n_end"] - F.when(marked, 0).otherwise(1), F.lit(0)).cast("double")
        n = ne + s["n_on"]
        mu = n * p
        far = mu - ne + F.when(ne > 0, ne * F.log(ne / mu)).otherwise(0.0)
        less = (ne < mu) & (far > math.log(1e3))
        more = (ne > mu) & (ne >= 3) & (far > math.log(1e4))
        return F.when(less | more, F.greatest(ne, F.lit(0.1)) / (n + 0.2)).otherwise(p)

    return F.log10(F.aggregate(stats, base, step))


def language(lang: Column) -> Column:
    """The two-letter language of a variant code; 'und' for none."""
    two = F.lower(F.regexp_extract(F.coalesce(lang, F.lit("und")), r"^([A-Za-z]{2,3})", 1))
    return F.when(two == "", "und").when(two == "eng", "en").when(two == "jp", "ja").otherwise(two)


def thresholds(scores: DataFrame, prior: float = 200.0) -> dict[str, float]:
    """Per language the middle of the emptiest 0.3-wide stretch of its log-odds histogram between the two modes of the
    histogram of all languages; to each language's histogram that of all languages is added, scaled to `prior` texts.
    Collects languages x bins only."""
    rows = scores.where("kind = 0").groupBy("l", F.floor(F.col("log_end") * 10).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
    by: dict[str, dict[int, float]] = {"": {}}
    for r in rows:
        for key in (r.l, ""):
            h = by.setdefault(key, {})
            h[r.b] = h.get(r.b, 0) + r.n
    lo, hi = _valley(by[""])
    total = max(sum(by[""].values()), 1)
    out = {}
    for key, h in by.items():
        bins = range(lo, max(hi - 2, lo + 1))
        weight = {b: sum(h.get(b + j, 0) + prior * by[""].get(b + j, 0) / total for j in range(3)) for b in bins}
        fewest = min(weight.values())
        # of equally empty stretches the one in the middle
        empty = [b for b in bins if weight[b] == fewest]
        out[key] = (empty[len(empty) // 2] + 1.5) / 10
    return out


def _valley(h: dict[int, float]) -> tuple[int, int]:
    """The bins (tenths of log10) between the two groups of a histogram: from the mean of what lies below the cut that
    divides it with the least variance inside (Otsu's) to the mean of what lies above."""
    bins = sorted(h)
    if len(bins) < 2:
        return -30, -20
    n, s = np.array([h[b] for b in bins], float), np.array([h[b] * b for b in bins], float)
    below, sums = np.cumsum(n)[:-1], np.cumsum(s)[:-1]
    above, rest = n.sum() - below, s.sum() - sums
    i = int(np.argmax(below * above * (sums / below - rest / above) ** 2))
    return math.floor(sums[i] / below[i]), math.ceil(rest[i] / above[i])


def end_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", hot_orders: int = 4, most_salts: int = 256) -> DataFrame:
    """(key, l, kind, log_end) of every non-blank text."""
    raw = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("d"), language(F.col(lang)).alias("l"), F.col(text).alias("t"))
    ends = checkpoint(_end_contexts(raw))
    base = ends.agg(F.least(F.lit(1.0), F.count(F.lit(1)) / F.greatest(F.sum("n"), F.lit(1))).alias("base"))
    # each distinct tail once; what it adds to the ends is 0 for one with a remnant
    tails = ends.select("tail", "h", (F.col("kind") == 0).cast("int").alias("e")).distinct()
    keys = checkpoint(tails.select("e", F.posexplode("h").alias("o", "h")).groupBy("o", "h").agg(F.sum("e").alias("n_end")))
    on = _continuations(spread(raw.select("t")), keys.select("h"))
    # contexts of the model: both counts of every context in which some text ends
    model = keys.join(on, "h", "left").fillna(0, ["n_on"])
    salts = min(most_salts, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    every = F.when(F.col("o") < hot_orders, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    long = ends.select("d", "l", "kind", F.posexplode("h").alias("o", "h")).withColumn("salt", F.when(F.col("o") < hot_orders, F.pmod(F.col("d"), F.lit(salts)).cast("int")).otherwise(0))
    joined = long.join(model.withColumn("salt", F.explode(every)), ["o", "h", "salt"]).groupBy("d", "l", "kind").agg(F.sort_array(F.collect_list(F.struct("o", "n_end", "n_on"))).alias("s"))
    joined = joined.join(F.broadcast(base))  # one row
    return joined.select(F.col("d").alias(key), "l", "kind", _end_log(F.col("s"), F.col("kind") > 0, F.col("base")).alias("log_end"))


def remnant_shifts(scores: DataFrame, limit: Column, most_shift: float) -> dict[int, float]:
    """Per kind of remnant the log10 of how much likelier it is in a text that goes on than in one that ends, judged by
    the text before it; at most `most_shift`, at least 0. Collects kinds x 2 counts."""
    rows = scores.groupBy("kind", (F.col("log_end") < limit).alias("goes_on")).agg(F.count(F.lit(1)).alias("n")).collect()
    n = {(r.kind, r.goes_on): r.n for r in rows}
    all_on, all_end = (sum(v for (_, g), v in n.items() if g == x) for x in (True, False))
    ratio = lambda k: ((n.get((k, True), 0) + 1) / (all_on + 1)) / ((n.get((k, False), 0) + 1) / (all_end + 1))
    return {k: min(max(math.log10(ratio(k)), 0.0), most_shift) for k in {k for k, _ in n} if k}


def truncated(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", most_shift: float = 0.5) -> DataFrame:
    """(key, l, kind, log_end, cut) of every non-blank text."""
    scores = checkpoint(end_scores(docs, key, text, lang))
    t = thresholds(scores)
    limit = F.lit(t[""])
    for k, v in sorted(t.items()):
        if k:
            limit = F.when(F.col("l") == k, F.lit(v)).otherwise(limit)
    shift = F.lit(0.0)
    for k, v in sorted(remnant_shifts(scores, limit, most_shift).items()):
        shift = F.when(F.col("kind") == k, F.lit(v)).otherwise(shift)
    return scores.withColumn("cut", F.col("log_end") - shift < limit)
