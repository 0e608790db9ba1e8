"""Sentence boundaries across languages and scripts.

A linear-chain model tags the gaps between characters as boundary or inside, and Viterbi decoding picks the best
tag sequence of a text. In a paragraph with terminal marks the gaps behind marks, at line breaks and, beside words
of a script without full stops, at spaces are open, and all others are fixed as inside; in a paragraph of an
unspaced script without any mark every gap between two of its characters is open. Emission features describe the
characters around the gap (terminal mark, closing marks, white space, words before and after, open quotations
and brackets; character n-grams where no mark stands); transition features describe the stretch since the previous
gap under each tag of that gap, so that a heading or list item on its own line is told from a wrapped line. The
weights are learnt here by an averaged structured perceptron from texts composed of labelled seed sentences
(`seeds`), for scripts that are or may be written without marks also with all marks stripped.

Defined results: null or blank text has no units; a text without any boundary is one unit; repeated rows give
repeated units. Offsets count code points of the whole content; units carry no outer white space.
"""

from __future__ import annotations

import json
import random
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvane.llm import seeds
from tallyvane.session import spread

TERMINAL = ".!?…。！？｡।॥؟۔።។။"
CLOSERS = set("\"”’»)]」』）】'")
OPENERS = {"„": "“", "«": "»", "‘": "’", "「": "」", "『": "』", "(": ")", "（": "）"}
_GAP = re.compile(rf"[{TERMINAL}]+|\s*\n\s*")
_GAP_SPACES = re.compile(rf"[{TERMINAL}]+|\s*\n\s*|[ \t\xa0\u3000]+")
_MARKS = re.compile(r"[„“”\"«»‘’「」『』（）()]|\n\s*\n")
_SPACE = re.compile(r"\s*")
#: Thai and Lao: sentences are set apart by a space.
_SPACED_OFF = re.compile(r"[\u0e00-\u0eff]")
#: Khmer, Burmese, kana and Han: words are not set apart.
_RUN_ON = re.compile(r"[\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]")
_SPARSE = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]")
_PARAGRAPH = re.compile(r"(?:(?!\n[ \t\r]*\n).)+", re.S)
_JOINERS = "\u1039\u17d2"  # the next letter is written below
_TERMINALS = re.compile(rf"[{TERMINAL}]")
#: A paragraph with fewer characters of an unspaced script and no mark is a heading or label: one unit.
LEAST_RUN = 12


def _kind(ch: str) -> str:
    if not ch:
        return "end"
    o = ord(ch)
    if ch.isdigit():
        return "d"
    if 0x0E00 <= o < 0x0F00:
        return "th"
    if 0x1000 <= o < 0x10A0 or 0x1780 <= o < 0x1800:
        return "km"
    if 0x0600 <= o < 0x0700:
        return "ar"
    if 0x0900 <= o < 0x0980:
        return "hi"
    if 0x3040 <= o < 0x3100:
        return "kana"
    if 0x3400 <= o < 0xA000:
        return "cjk"
    if ch.isupper():
        return "U"
    if ch.isalpha():
        return "l"
    return ch if ch in "•-*–·$%¿¡" else "open" if ch in OPENERS or ch == "“" else "quote" if ch == '"' else "close" if ch in CLOSERS else "comma" if ch in ",;:，、；：،" else "o"


def _shape(w: str) -> str:
    """A short word stands for itself, a long one for its letter case, a number for its digits' form."""
    if any(c.isdigit() for c in w):
        return "#" + re.sub(r"\d+", "0", w)[:8]
    if len(w) <= 5 or (w.islower() and len(w) <= 9 and w.isascii()):
        return w.lower()
    return "Xx" if w[0].isupper() else "xx"


def _bucket(n: int) -> str:
    return "0" if n == 0 else "1" if n == 1 else "2" if n == 2 else "3-6" if n <= 6 else "7+"


class Gap:
    """`end` is the offset behind the unit if the gap is a boundary, `next` where the following text starts."""

    __slots__ = ("end", "feats", "next", "seg")

    def __init__(self, end: int, nxt: int, feats: list[str], seg: list[str]):
        self.end, self.next, self.feats, self.seg = end, nxt, feats, seg


def _unmarked(text: str) -> tuple[list[int], list[int]]:
    """The open positions of paragraphs of an unspaced script that have no terminal mark: between two characters
    without white space, one of them of the script; and the white space beside such a character."""
    out, blanks = [], []
    for m in _PARAGRAPH.finditer(text):
        p, a = m.group(), m.start()
        if _TERMINALS.search(p) or len(_RUN_ON.findall(p)) < LEAST_RUN:
            continue
        for i in range(1, len(p)):
            x, y = p[i - 1], p[i]
            if y.isspace():
                if _RUN_ON.match(x) or _RUN_ON.match(p[i : i + 8].lstrip()[:1]):
                    blanks.append(a + i)
            elif (_RUN_ON.match(x) or _RUN_ON.match(y)) and not x.isspace() and not unicodedata.category(y).startswith("M") and x not in _JOINERS:
                out.append(a + i)
    return out, blanks


def _position(text: str, p: int) -> Gap:
    """An open position without a mark, described by the characters around it."""
    a, b = text[max(0, p - 4) : p], text[p : p + 3]
    feats = [f"L1{a[-1:]}", f"L2{a[-2:]}", f"L3{a[-3:]}", f"L4{a}", f"R1{b[:1]}", f"R2{b[:2]}", f"R3{b}", f"X11{a[-1:]}{b[:1]}", f"X21{a[-2:]}|{b[:1]}", f"X12{a[-1:]}|{b[:2]}", "pos"]
    return Gap(p, p, feats, ["pos"])


def gaps(text: str) -> list[Gap]:
    """The open gaps of a text, in order, with their features."""
    return list(iter_gaps(text))


def iter_gaps(text: str) -> Iterator[Gap]:
    """The open gaps one by one: of a long text only one is held with its features at a time."""
    marks, at, stack, n = list(_MARKS.finditer(text)), 0, [], len(text)
    low, closing = False, set()  # the “ that close a „
    for x in marks:
        if x.group() == "„":
            low = True
        elif "\n" in x.group():
            low = False
        elif low and x.group() == "“":
            closing.add(x.start())
            low = False
    last_end, done = 0, 0
    sparse = _SPARSE.search(text) is not None
    free, blanks = _unmarked(text) if sparse else ([], [])
    bare_text = set(blanks)
    i = 0
    for m in (_GAP_SPACES if sparse else _GAP).finditer(text):
        s, e = m.span()
        while i < len(free) and free[i] <= s:
            if free[i] < s and free[i] > done:
                yield _position(text, free[i])
            i += 1
        if s < done:
            continue
        if text[s] not in TERMINAL and "\n" not in m.group():
            # a space counts beside a word in a script without full stops, or between two unspaced words
            before, behind = text[max(last_end, s - 60) : s].rsplit(None, 1)[-1:], re.match(r"\S{0,60}", text[e : e + 60]).group()
            if not (s in bare_text or _SPACED_OFF.search(before[0] if before else "") or _SPACED_OFF.search(behind) or (_RUN_ON.match(text[e : e + 1]) and s and _RUN_ON.match(text[s - 1]))):
                continue
        term = text[s] in TERMINAL
        after = e
        if term:
            # closing marks belong to what they close; “ closes only where „ is open
            while after < n:
                c = text[after]
                if c in CLOSERS or (c == "“" and after in closing):
                    after += 1
                elif c in " \xa0\u202f" and text[after + 1 : after + 2] == "»":
                    after += 2
                else:
                    break
        while at < len(marks) and marks[at].start() < after:
            c = marks[at].group()
            if "\n" in c:
                stack.clear()
            elif c == '"':
                stack.pop() if '"' in stack and stack[-1] == '"' else stack.append('"')
            elif c == "“":
                stack.pop() if stack and stack[-1] == "„" else stack.append("“")
            elif c in OPENERS:
                stack.append(c)
            elif c == "”":
                if stack and stack[-1] in "“„":
                    stack.pop()
            elif stack and OPENERS.get(stack[-1]) == c:
                stack.pop()
            at += 1
        ws = _SPACE.match(text, after if term else s).group()
        end, nxt = (after, after + len(ws)) if term else (s, s + len(ws))
        if nxt >= n or end <= 0:
            continue
        follow = text[nxt]
        if term and not ws and (follow.isdigit() or follow.islower()) and text[s] == "." and e - s == 1:
            continue  # inside a number, an abbreviation or an address
        done = nxt
        before = text[max(last_end, s - 60) : s].split() if s > last_end else []
        prev, prev2, prev3 = (before[-1] if before else ""), (before[-2] if len(before) > 1 else ""), (before[-3] if len(before) > 2 else "")
        prev_word = prev.lstrip("([{\"“„«‘'")
        w = re.match(r"[^\s.,;:!?]{1,14}", text[nxt : nxt + 14])
        word = w.group() if w else ""
        if word and _RUN_ON.match(word):
            word = word[:2]
        closed = text[e:after] if term else ""
        t = (text[s] if e - s == 1 else "..." if text[s] in ".…" else text[s]) if term else "none"
        gapkind = "nl2" if ws.count("\n") > 1 else "nl" if "\n" in ws else "sp" if ws else "no"
        q = "q" if any(c not in "(（" for c in stack) else "p" if stack else "f"
        k, pk = _kind(follow), _kind(prev_word[-1:])
        thai = "T" if not term and (_SPACED_OFF.search(prev) or pk == "th") else ""
        feats = [f"t{t}", f"t{t}k{k}", f"t{t}w{gapkind}", f"t{t}w{gapkind}k{k}", f"t{t}q{q}", f"t{t}q{q}k{k}w{gapkind}", f"c{closed[:2]}", f"c{closed[:2]}k{k}w{gapkind}", f"t{t}c{bool(closed)}q{q}", "bias"]
        if term:
            sp, init = _shape(prev_word), len(prev_word) == 1 and prev_word.isupper()
            dotted = "." in prev_word
            feats += [f"p{sp}t{t}", f"p{sp}k{k}", f"pk{pk}k{k}t{t}w{gapkind}", f"i{init}k{k}t{t}", f"n{_shape(word)}t{t}", f"n{_shape(word)}pk{pk}", f"n{word.lower()}", f"p{sp}n{_shape(word)}", f"dot{dotted}k{k}", f"p{sp}q{_shape(prev3)}k{k}", f"pp{_shape(prev2)}pk{pk}k{k}", f"p{sp}w{gapkind}k{k}"]
            if k in ("cjk", "kana", "km"):
                feats += [f"t{t}c{closed[:1]}n{follow}", f"t{t}c{closed[:1]}n{word}", f"q{q}t{t}c{closed[:1]}"]
            if closed:
                # a reporting clause is short: how far the next mark is
                nearest = _TERMINALS.search(text, nxt, min(n, nxt + 60))
                d = nearest.start() - nxt if nearest else 60
                feats += [f"c{closed[:2]}d{min(d // 6, 6)}k{k}", f"c{closed[:1]}n{_shape(word)}w{gapkind}"]
        else:
            feats += [f"x{thai}w{gapkind}k{k}", f"xpk{pk}k{k}w{gapkind}", f"x{thai}pk{pk}w{gapkind}"]
            if s in bare_text or (s and sparse and _RUN_ON.match(text[s - 1]) and _RUN_ON.match(follow)):
                feats += [f"sL{text[max(0, s - 2) : s]}", f"sR{text[nxt : nxt + 1]}", f"sw{gapkind}{text[s : s + 1]}"]
        piece = text[last_end:end]
        line0 = piece.lstrip()
        words = len(line0.split(None, 7))
        first = _kind(line0[:1])
        item = bool(re.match(r"([•*–·-]|\d+[.)]|\(\d+\))(\s|$)", line0))
        bare = bool(re.fullmatch(r"\(?\d{1,3}\)?", line0.strip(".) ")))
        caps = line0.isupper() and len(line0) > 4
        seg = [f"t{t}w{gapkind}f{first}n{_bucket(words)}", f"t{t}i{item}w{gapkind}", f"t{t}b{bare}k{k}", f"t{t}i{item}w{gapkind}k{k}", f"t{t}C{caps}w{gapkind}k{k}", f"t{t}w{gapkind}n{_bucket(words)}k{k}f{first}"]
        yield Gap(end, nxt, feats, seg)
        last_end = nxt
    yield from (_position(text, p) for p in free[i:] if p > done)


def viterbi(cand: Iterable[Gap], w: dict[str, float]) -> list[int]:
    """The best tags (1 boundary, 0 inside) of a text's gaps."""
    get = w.get
    s0, s1, back = -1e9, 0.0, []  # before the first gap the state is boundary: a text starts a unit
    for g in cand:
        e = sum(get(f, 0.0) for f in g.feats)
        a0 = s0 + e + sum(get("0|" + x, 0.0) for x in g.seg)
        a1 = s1 + e + sum(get("1|" + x, 0.0) for x in g.seg)
        to1, from1 = (a1, 1) if a1 >= a0 else (a0, 0)
        to0, from0 = (s1, 1) if s1 >= s0 else (s0, 0)
        back.append((from0, from1))
        s0, s1 = to0, to1
    y, tags = (1 if s1 > s0 else 0), []
    for f0, f1 in reversed(back):
        tags.append(y)
        y = f1 if y else f0
    return tags[::-1]


def _name(r: random.Random) -> str:
    return "".join(r.choice(["ka", "ve", "to", "mir", "nal", "so", "phe", "dru", "lin", "ost", "gar", "ul", "bre"]) for _ in range(r.randint(2, 3))).capitalize() + r.choice("nxlrsk")


def fill(template: str, r: random.Random) -> str:
    """A seed sentence with names, numbers and amounts in place of its placeholders."""

    def one(m: re.Match) -> str:
        k = m.group(1)
        if k == "N":
            return _name(r)
        if k == "i":
            return str(r.randint(1, 300))
        if k == "d":
            return r.choice([f"{r.randint(1, 99)}.{r.randint(0, 99)}", f"{r.randint(1, 999)},{r.randint(100, 999)}", f"{r.randint(1, 99)},{r.randint(0, 9)}", str(r.randint(2, 900)), f"{r.randint(1, 99)}.{r.randint(100, 999)},{r.randint(0, 9)}"])
        if k == "p":
            return r.choice([f"{r.randint(1, 99)}.{r.randint(0, 9)}%", f"{r.randint(1, 99)}%", f"{r.randint(1, 99)}.{r.randint(0, 9)} percent"])
        if k == "m":
            return r.choice([f"${r.randint(1, 99)}.{r.randint(0, 9)} million", f"US${r.randint(1, 99)}.{r.randint(0, 9)} bn", f"${r.randint(100, 999)},{r.randint(100, 999)}", f"${r.randint(1, 900)}M", f"USD {r.randint(1, 900)},{r.randint(100, 999)} thousand", f"(${r.randint(1, 99)}.{r.randint(0, 9)} million)", f"${r.randint(1, 99)}.{r.randint(0, 9)}B"])
        if k == "y":
            return str(r.randint(2010, 2026))
        if k == "c":
            return r.choice(seeds.COMPANY)
        if k == "b":
            return r.choice(seeds.MONTHS)
        if k == "t":
            return r.choice(seeds.TITLES)
        if k == "r":
            return r.choice(seeds.REFERENCES)
        if k == "q":
            return r.choice("ABCDEFGHJKLMNPRSTVW") + ". " + r.choice("ABCDEFGHJKLMNPRSTVW") + "."
        return str(r.randint(1, 9))

    return re.sub(r"\{([a-zN])\}", one, template)


_STRIPPED = re.compile(rf"[{TERMINAL}、，,;:；：၊「」『』“”‘’\"()（）]")


def quoted(lang: str, lines: list[str], r: random.Random) -> str:
    """A quotation of one to three seed sentences with its reporting clause: one unit."""
    inner = [fill(r.choice(lines), r) for _ in range(r.randint(1, 3))]
    inner = [x for x in inner if not re.search(r"[\"“”„«»「」『』()（）]", x)] or [fill(lines[0], r)]
    joined = ("" if lang in seeds.UNSPACED else " ").join(inner)
    if joined[-1] == "." and lang in ("en", "de", "fr", "es", "it", "pt"):
        joined = joined[:-1] + ("," if lang == "en" else "")
    return fill(r.choice(seeds.REPORTING[lang].split("\n")), r).replace("~", joined)


def compose(r: random.Random, languages: dict[str, str] | None = None) -> tuple[str, list[tuple[int, int]]]:
    """A training text with the true spans of its units."""
    languages = languages or seeds.LANGUAGES
    drawn = [x for x in languages for _ in range(seeds.SHARES[x])]
    parts: list[str] = []
    spans: list[tuple[int, int]] = []
    pos = 0

    def put(s: str) -> None:
        nonlocal pos
        parts.append(s)
        pos += len(s)

    def unit(s: str) -> None:
        spans.append((pos, pos + len(s)))
        put(s)

    main = r.choice(drawn) if r.random() < 0.6 else "en"
    blocks = r.randint(1, 5)
    for b in range(blocks):
        lang = main if r.random() < 0.75 else r.choice(drawn)
        lang = lang if lang in languages else r.choice(drawn)
        stripped = lang in seeds.UNPUNCTUATED or (lang in seeds.SPARSE and r.random() < 0.3)
        apart = r.choice(["", " ", "\u3000"]) if stripped and lang in seeds.SPARSE else None
        if b:
            put(r.choice(["\n\n", "\n", "\n\n", "\r\n"]) if apart is None else "\n\n")
        if r.random() < 0.25 and apart is None:
            h = fill(r.choice(seeds.HEADINGS.split("\n")), r)
            unit(h.upper() if r.random() < 0.15 else h)
            put(r.choice(["\n\n", "\n"]))
        if r.random() < 0.15 and apart is None:
            bullet, style = r.choice(seeds.BULLETS), r.choice(seeds.ITEMS.split("\n"))
            for k in range(1, r.randint(2, 5)):
                unit(bullet.replace("{k}", str(k)) + " " + fill(style if r.random() < 0.6 else r.choice(seeds.ITEMS.split("\n")), r))
                put("\n")
            put(r.choice(["\n", ""]))
        lines = languages[lang].split("\n")
        for k in range(r.randint(1, 6)):
            s = quoted(lang, lines, r) if lang in seeds.REPORTING and not stripped and r.random() < 0.1 else fill(r.choice(lines), r)
            if lang in seeds.UNPUNCTUATED:
                s = s.rstrip(".")
            elif stripped:
                s = _STRIPPED.sub("", s)
            if k:
                glue = "" if lang in seeds.UNSPACED and r.random() < 0.95 else r.choice([" "] * 12 + ["  ", "\n"]) if lang not in seeds.UNSPACED and r.random() < 0.97 else "" if s[0].isupper() and s[0].isascii() and parts[-1][-1] in ".!?" and parts[-1][-3:-2].islower() else " "
                put(glue if apart is None else apart)
            if r.random() < 0.25 and not stripped:  # a wrapped line
                at = [m.start() for m in re.finditer(r" (?=[a-zà-ü(])", s)]
                if at:
                    i = r.choice(at)
                    s = s[:i] + "\n" + s[i + 1 :]
                elif lang in seeds.UNSPACED and len(s) > 6:
                    i = r.randint(2, len(s) - 3)
                    if all(ord(c) > 0x3040 and c.isalpha() for c in s[i - 1 : i + 1]):
                        s = s[:i] + "\n" + s[i:]
            if r.random() < 0.05:
                s = s.replace(" ", "  ", 1)
            unit(s)
    return "".join(parts), spans


@lru_cache(maxsize=4)
def train(texts: int = 4000, epochs: int = 4, seed: int = 11, held_out: int = 0) -> dict[str, float]:
    """Averaged perceptron over composed texts; deterministic for a seed. With `held_out` = k every k-th seed
    sentence of each language stays out (see `held_out_accuracy`)."""
    r = random.Random(seed)
    data = []
    languages = seeds.LANGUAGES if not held_out else {x: "\n".join(y for i, y in enumerate(t.split("\n")) if i % held_out) for x, t in seeds.LANGUAGES.items()}
    for _ in range(texts):
        text, spans = compose(r, languages)
        ends = {b for _, b in spans}
        g = gaps(text)
        data.append((g, [int(x.end in ends) for x in g]))
    w: dict[str, float] = {}
    total: dict[str, float] = {}
    step = 1

    def add(f: str, v: float) -> None:
        w[f] = w.get(f, 0.0) + v
        total[f] = total.get(f, 0.0) + v * step

    for _ in range(epochs):
        r.shuffle(data)
        for g, gold in data:
            got = viterbi(g, w)
            if got != gold:
                pg, pp = 1, 1
                for x, a, b in zip(g, gold, got):
                    if a != b or (a and pg != pp):
                        for v, y, p in ((1.0, a, pg), (-1.0, b, pp)):
                            if y:
                                for f in x.feats:
                                    add(f, v)
                                for f in x.seg:
                                    add(f"{p}|" + f, v)
                    pg, pp = a, b
            step += 1
    return {f: v - total[f] / step for f, v in w.items() if abs(v - total[f] / step) > 1e-6}


def held_out_accuracy(every: int = 5, texts: int = 300, seed: int = 5) -> dict[str, tuple[float, float]]:
    """Per language (recall, precision) of units in texts composed of the sentences left out of the training."""
    w = train(held_out=every)
    out = {}
    for lang, t in seeds.LANGUAGES.items():
        own, r, right, there, given = {lang: "\n".join(y for i, y in enumerate(t.split("\n")) if i % every == 0)}, random.Random(seed), 0, 0, 0
        for _ in range(texts):
            text, spans = compose(r, own)
            got = split(text, w)
            right, there, given = right + len(set(got) & set(spans)), there + len(spans), given + len(got)
        out[lang] = (right / max(there, 1), right / max(given, 1))
    return out


def save_model(weights: dict[str, float], path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(weights, f, ensure_ascii=False)


def load_model(path: str) -> dict[str, float]:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def split(text: str | None, weights: dict[str, float]) -> list[tuple[int, int]]:
    """The units' (start, end) offsets."""
    if not text or not text.strip():
        return []
    out, start = [], len(text) - len(text.lstrip())
    places: list[tuple[int, int]] = []

    def noted() -> Iterator[Gap]:
        for g in iter_gaps(text):
            places.append((g.end, g.next))
            yield g

    tags = viterbi(noted(), weights)
    for (stop, following), y in zip(places, tags):
        if y and stop > start:
            out.append((start, stop))
            start = following
    end = len(text.rstrip())
    if end > start:
        out.append((start, end))
    return out


def sentence_units(df: DataFrame, key: str = "chunk_id", text: str = "content", header: bool = True, weights: dict[str, float] | None = None) -> DataFrame:
    """One row per sentence unit: key, sent_no, start_char, end_char (offsets in the whole text column).

    header: the first line is a provenance header in brackets and is left out. Null or blank texts give no row.
    """
    w = weights if weights is not None else train()
    kind = dict(df.dtypes)[key]
    shared = df.sparkSession.sparkContext.broadcast(w)  # the model: bounded by the seed sentences

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            keys, no, a, b = [], [], [], []
            for k, t in zip(pdf["k"], pdf["t"]):
                if t is None:
                    continue
                skip = 0
                if header and t.startswith("["):
                    skip = t.find("\n") + 1 or len(t)
                units = split(t[skip:], model)
                keys += [k] * len(units)
                no += range(len(units))
                a += [skip + x for x, _ in units]
                b += [skip + y for _, y in units]
            yield pd.DataFrame({"k": pd.Series(keys, dtype="object" if kind == "string" else None), "n": pd.Series(no, dtype="int64"), "a": pd.Series(a, dtype="int64"), "b": pd.Series(b, dtype="int64")})

    rows = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull()))
    return rows.mapInPandas(run, f"k {kind}, n bigint, a bigint, b bigint").select(F.col("k").alias(key), F.col("n").alias("sent_no"), F.col("a").alias("start_char"), F.col("b").alias("end_char"))
