"""Quantities in common units, from the statement nearest to each number and from its source's recording history.

Order of statements: the number or cell itself, its sentence (a range or pair shares the unit printed after its
last member; a unit named elsewhere in the sentence holds for its bare numbers), the row, the column, then the table
or passage. A dollar scale holds for dollar amounts only. Years, note numbers and page numbers are no quantities.

Where no scale of a dollar amount is printed anywhere, the history of its source decides: the recorded values over the
printed numbers, in order of recording, are cut into segments by exact penalised changepoint search on their logs, and
a segment whose level is shifted from the printed one by a known dollar scale marks a change of the recording unit. A
run of at least `least_run` numbers votes; the amount is then the printed number in the unit recorded.

Defined results: rows without chunk or raw are no case; a number delivered twice counts once (latest delivery);
numbers outside the printed table or text, and quantities without a recognisable unit, give no row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvane.operators.changepoint import value_segments
from tallyvane.session import checkpoint

# Names of base units and their size in the base unit of their quantity, and prefixes.
_PREFIXES = {"k": 1e3, "M": 1e6, "G": 1e9, "T": 1e12}
_ROOTS = {
    "kWh": {"Wh": 1e-3, "J": 1e-3 / 3600, "kWh": 1.0, "GJ": 2500 / 9, "gigajoules": 2500 / 9, "kilowatt hours": 1.0, "megawatt hours": 1e3, "gigawatt hours": 1e6, "therms": 29.3071},
    "kg": {
        "kg": 1.0, "g": 1e-3, "kilograms": 1.0, "kilos": 1.0, "kilogramos": 1.0, "kilogrammes": 1.0, "Kilogramm": 1.0, "公斤": 1.0, "キログラム": 1.0, "кг": 1.0,
        "t": 1e3, "kt": 1e6, "Mt": 1e9, "tonne": 1e3, "tonnes": 1e3, "metric ton": 1e3, "metric tons": 1e3, "metric tonnes": 1e3, "tons métriques": 1e3, "tonnes métriques": 1e3, "toneladas": 1e3, "tonelada": 1e3, "Tonnen": 1e3, "Tonne": 1e3, "tonnellate": 1e3, "ton": 1e3, "トン": 1e3, "吨": 1e3, "тонн": 1e3,
        "lb": 0.45359237, "lbs": 0.45359237, "pounds": 0.45359237, "libras": 0.45359237, "ounces": 0.45359237 / 16, "oz": 0.45359237 / 16, "stone": 14 * 0.45359237, "short tons": 907.18474, "short ton": 907.18474, "long tons": 1016.0469088,
    },
    "m2": {
        "m²": 1.0, "m2": 1.0, "sq m": 1.0, "square metres": 1.0, "square meters": 1.0, "metros cuadrados": 1.0, "mètres carrés": 1.0, "Quadratmeter": 1.0, "metri quadrati": 1.0, "平方メートル": 1.0, "平方米": 1.0, "km²": 1e6, "km2": 1e6, "square kilometres": 1e6, "square kilometers": 1e6, "平方公里": 1e6,
        "sq ft": 0.09290304, "ft²": 0.09290304, "square feet": 0.09290304, "square yards": 0.83612736, "square miles": 2589988.110336, "hectares": 1e4, "hectáreas": 1e4, "Hektar": 1e4, "ettari": 1e4, "ha": 1e4, "ヘクタール": 1e4, "公顷": 1e4, "acres": 4046.8564224,
    },
    "l": {
        "L": 1.0, "l": 1.0, "litres": 1.0, "liters": 1.0, "litros": 1.0, "Liter": 1.0, "litri": 1.0, "リットル": 1.0, "升": 1.0, "ml": 1e-3, "mL": 1e-3, "hl": 100.0, "hectolitres": 100.0, "megalitres": 1e6, "ML": 1e6, "GL": 1e9,
        "m³": 1e3, "m3": 1e3, "cubic metres": 1e3, "cubic meters": 1e3, "metros cúbicos": 1e3, "mètres cubes": 1e3, "Kubikmeter": 1e3, "立方米": 1e3, "立方メートル": 1e3, "gal": 3.785411784, "gallons": 3.785411784, "US gallons": 3.785411784, "galones": 3.785411784, "barrels": 158.987294928, "barriles": 158.987294928, "barils": 158.987294928, "Barrel": 158.987294928, "bbl": 158.987294928, "cubic feet": 28.316846592,
    },
    "km": {"km": 1.0, "m": 1e-3, "kilometres": 1.0, "kilometers": 1.0, "kilómetros": 1.0, "kilomètres": 1.0, "Kilometer": 1.0, "chilometri": 1.0, "metres": 1e-3, "meters": 1e-3, "キロメートル": 1.0, "公里": 1.0, "mi": 1.609344, "miles": 1.609344, "nautical miles": 1.852, "yards": 0.0009144, "feet": 0.0003048, "ft": 0.0003048},
    "bp": {"%": 100.0, "％": 100.0, "percent": 100.0, "per cent": 100.0, "Prozent": 100.0, "pour cent": 100.0, "por ciento": 100.0, "per cento": 100.0, "percentage points": 100.0, "basis points": 1.0, "Basispunkte": 1.0, "points de base": 1.0, "puntos básicos": 1.0, "bps": 1.0, "bp": 1.0},
    "each": {"count": 1.0, "employees": 1.0, "staff": 1.0, "workers": 1.0, "vehicles": 1.0, "units": 1.0, "stores": 1.0, "shops": 1.0, "branches": 1.0, "patents": 1.0, "people": 1.0, "sites": 1.0, "customers": 1.0, "subscribers": 1.0, "Mitarbeiter": 1.0, "employés": 1.0, "empleados": 1.0},
    "USD": {"dollars": 1.0, "US dollars": 1.0, "USD": 1.0, "US$": 1.0, "$": 1.0, "US-Dollar": 1.0, "Dollar": 1.0, "dólares": 1.0, "de dólares": 1.0, "de dollars": 1.0, "dollari": 1.0, "ドル": 1.0, "美元": 1.0, "米ドル": 1.0, "долларов": 1.0},
}
#: Unit as printed -> (base unit, size in it); the prefixes go before Wh and J only, where they are unambiguous.
UNITS = {u: (base, f) for base, us in _ROOTS.items() for u, f in us.items() if u not in ("Wh", "J", "m", "g")} | {p + u: ("kWh", f * _ROOTS["kWh"][u]) for p, f in _PREFIXES.items() for u in ("Wh", "J")}
# Scale words.
SCALES = {
    "hundreds of thousands": 1e5, "tens of thousands": 1e4, "thousands": 1e3, "thousand": 1e3, "K": 1e3, "k": 1e3, "'000": 1e3, "millions": 1e6, "million": 1e6, "M": 1e6, "m": 1e6, "mn": 1e6, "billions": 1e9, "billion": 1e9, "B": 1e9, "bn": 1e9, "trillion": 1e12, "tn": 1e12,
    "Tsd.": 1e3, "Mio.": 1e6, "Mrd.": 1e9, "mil millones": 1e9, "millones": 1e6, "miles": 1e3, "milliards": 1e9, "milliers": 1e3, "百万": 1e6, "十億": 1e9, "億": 1e8, "亿": 1e8, "万": 1e4, "千": 1e3,
}
COUNT_WORDS = re.compile(r"(?i)\b(employees|headcount|staff|workers|stores|shops|branches|patents|vehicles?|units|deliveries|shipments|sites|customers|subscribers|members|aircraft|ships|rooms|seats)\b")
RATIO_WORDS = re.compile(r"(?i)\b(margin|rate|churn|growth|ratio|yield|utilisation)\b")
DOLLAR = r"(?:US\$|\$|USD|dollars?|US dollars)"

_alt = lambda words: "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))
_SCALE_AFTER = re.compile(rf"\s*(?P<s>{_alt(s for s in SCALES if s not in ('k', 'm', 'miles', chr(39) + '000'))})(?![A-Za-z])")
_UNIT_AFTER = re.compile(rf"\s*(?P<u>{_alt(UNITS)})(?![A-Za-z²³])")
_SP = re.compile(r"\s*(?P<s>mil millones|millones|miles) de dólares|\s*(?P<f>milliards|millions|milliers) de dollars")
_SHARE = re.compile(r"^\s*(?:and|to|-|–)\s+(?P<n>\(?(?:US\$|\$|USD )?[\d][\d.,]*\d?\)?)")
# Function words of languages that write a decimal comma, and of English.
_EU = re.compile(r"\b(der|die|das|dem|den|und|von|im|am|bei|auf|für|wegen|lag|betrug|fiel|stieg|le|la|les|des|du|au|aux|et|ont|chez|el|los|las|del|de|en|fue|y|un|una|il|lo|gli|di|della|nel|è|o|os|do|da|em|het|een|van)\b|\b[dl]'")
_EN = re.compile(r"\b(at|of|the|in|to|was|were|is|and|with|by|from|for|compared|fiscal|a|an|on)\b")
_IN_UNIT = re.compile(rf"(?:\b(?:measured|stated|expressed|given|reported|counted)\s+in|\((?:both |all )?in|\bunits?:)\s+(?P<u>(?:(?:{_alt(SCALES)})\s+(?:of\s+)?)?(?:{_alt(UNITS)}))(?![A-Za-z²³])")
_NO_END = "".join(rf"(?<!\b{w}\.)" for w in ("Mio", "Mrd", "Tsd", "approx", "aprox", "env", "ca", "No", "Nr", "Mr", "Dr", "Sr", "St", "vs", "Mt", "Art"))
_SENTENCE_END = re.compile(rf"(?<=[.!?])(?<!\b[A-Z]\.){_NO_END}\s+(?=[A-Z¿¡\"“„«(])|(?<=[。！？])|\n")
_YEAR_BEFORE = re.compile(r"(?i)(?:\bfiscal|\bFY|\bin|\bQ[1-4]|\byear|\bsince|\bof|\bde|\ben|\bJahr|\bthan|,|\bJan(?:uary)?|\bFeb(?:ruary)?|\bMarch|\bApril|\bMay|\bJune|\bJuly|\bAugust|\bSeptember|\bOctober|\bNovember|\bDecember)\s*$")
_REFERENCE = re.compile(r"(?i)(?:\bnotes?|\bpages?|\bp\.|\bpp\.|\bitem|\bno\.|\bfig\.|\bsection|\bart\.|\bversion|\bS\.|\bNr\.)\s*$")
#: A statement on the amounts of a passage, within one sentence: what it is about, a verb of stating, and a scale.
_PASSAGE = re.compile(
    r"\b(?:amounts|figures|values|sums|totals|numbers|note|passage|section|page|below)\b(?:[^.\n]|\.(?!\s))*?\b(?:are|is|stated|expressed|given|shown|reports?)\b(?:[^.\n\d]|\.(?!\s))*?\b(?P<s>hundreds of thousands|tens of thousands|thousands|millions|billions)\b(?: of (?:US )?dollars| of USD|,? ?\(USD\)|(?=\s*[.\n]|$))"
)
_TABLE_SCALE = re.compile(rf"(?i)(?:{DOLLAR}|dollar amounts|\$ figures are|dollar figures are)\s*(?:in|are)?\s*(?:in\s+)?(?P<a>hundreds of thousands|thousands|millions|billions|thousand|million|billion)\b|(?P<b>hundreds of thousands|thousands|millions|billions) of (?:US )?dollars")
_MONEY = re.compile(r"\$|\bUSD\b|(?i:dollar|dólar)|ドル|美元")
_LABEL_UNIT = re.compile(r"(?:\(([^()]*)\)|\[([^\[\]]*)\]|,\s*([^,()\[\]]+))\s*$")


def number(text: str, european: bool = False) -> float | None:
    """The printed number without sign; European texts write a decimal comma and group by dots or spaces."""
    t = re.sub(r"[\s  ']", "", text)
    if "," in t and "." in t:
        dec = "," if t.rfind(",") > t.rfind(".") else "."
        t = t.replace("." if dec == "," else ",", "").replace(dec, ".")
    elif european:
        t = t.replace(",", ".") if "," in t else (t.replace(".", "") if re.fullmatch(r"\d{1,3}(\.\d{3})+", t) else t)
    else:
        t = t.replace(",", "")
    try:
        return float(t)
    except ValueError:
        return None


def unit_of(text: str) -> tuple[str, float] | None:
    """(base unit, factor) of a unit as printed in a label or unit cell, with its scale: 'million sq ft', 'USD bn'."""
    t = text.strip()
    if t in UNITS:
        return UNITS[t]
    m = re.fullmatch(rf"(?P<s>{_alt(SCALES)})\s+(?:of\s+)?(?P<u>{_alt(UNITS)})", t) or re.fullmatch(rf"(?P<u>US\$|USD|\$)\s*(?:in\s+)?(?P<s>{_alt(SCALES)})", t) or re.fullmatch(r"(?P<s>'000)\s*(?P<u>USD|US\$|\$)", t)
    if m:
        base, f = UNITS[m["u"]]
        return base, f * SCALES[m["s"]]
    return None


def _printed(raw: str, european: bool) -> tuple[float | None, float, float | None, str | None]:
    """(amount, sign, scale stated in raw or None, unit stated in raw or None)."""
    t = raw.strip()
    sign = -1.0 if t.startswith("(") and t.endswith(")") or re.match(r"^[-−]", t) else 1.0
    t = t.strip("()").lstrip("-−")
    m = re.match(r"^\s*(?P<c>US\$|USD|\$)?\s*(?P<n>\d[\d.,\s  ']*)(?P<r>.*)$", t, re.S)
    if not m:
        return None, sign, None, None
    rest = m["r"].strip()
    unit = "USD" if m["c"] else None
    scale = None
    if rest:
        s = re.match(rf"(?P<s>{_alt(s for s in SCALES if s != chr(39) + '000')})(?![A-Za-z])", rest)
        if s:
            scale, rest = SCALES[s["s"]], rest[s.end() :].strip()
        if rest:
            u = _UNIT_AFTER.match(rest)
            unit = u["u"] if u else unit
    return number(m["n"].strip().rstrip(".,"), european), sign, scale, unit


Reading = tuple[str, float, bool]


def in_text(content: str, start: int, raw: str) -> tuple[str, float] | None:
    """(base unit, base value) of a number printed in a text, or None; statements are sought in its sentence."""
    got = _read_text(content, start, raw)
    return got[:2] if got else None


def in_table(content: str, caption: str | None, grid: list[list[str | None]] | None, row: int, col: int, raw: str) -> tuple[str, float] | None:
    """(base unit, base value) of a number printed in a table cell, or None."""
    got = _read_table(content, caption, grid, row, col, raw)
    return got[:2] if got else None


def _read_text(content: str, start: int, raw: str) -> Reading | None:
    """Base unit, base value, and whether it is a dollar amount whose scale is printed nowhere."""
    end = start + len(raw)
    cuts = [m.end() for m in _SENTENCE_END.finditer(content, 0, start)]
    first, following = cuts[-1] if cuts else 0, _SENTENCE_END.search(content, end)
    last = following.start() if following else len(content)
    before, after = content[first:start], content[end:last]
    near = before + after
    european = len(_EU.findall(near)) > len(_EN.findall(near))
    amount, sign, scale, unit = _printed(raw, european)
    if amount is None:
        return None
    if not european and re.search(r"[぀-鿿]", near):
        european = False
    if unit is None and re.search(r"(?:US\$|\$|USD)\s*\(?$", before):
        unit = "USD"
    if unit is None and raw.rstrip(")").endswith("%"):
        unit = "%"
    if unit is None and scale is None and _REFERENCE.search(before):
        return None
    if unit is None or scale is None:
        rest = after
        m = _SP.match(rest)
        if m and (unit is None or unit == "USD"):
            unit, scale = "USD", scale or SCALES[{"millions": "million"}.get(m["f"], m["f"])] if m["f"] else SCALES[m["s"]]
        else:
            s = _SCALE_AFTER.match(rest)
            follow = rest[s.end() :] if s else rest
            u = _UNIT_AFTER.match(follow)
            if u and (unit is None or UNITS[u["u"]][0] == UNITS[unit][0]):
                if s and scale is None:
                    scale = SCALES[s["s"]]
                unit = unit or u["u"]
            elif s and scale is None and unit == "USD":
                scale = SCALES[s["s"]]
    if unit is None or (unit == "USD" and scale is None):
        # a pair or range: the unit is printed after its other member
        m = _SHARE.match(after)
        if m:
            tail = after[m.end("n") :]
            s = _SCALE_AFTER.match(tail)
            u = _UNIT_AFTER.match(tail[s.end() :] if s else tail)
            if unit == "USD" and "between" in before and s:
                scale = SCALES[s["s"]]
            elif unit is None and u:
                unit, scale = u["u"], SCALES[s["s"]] if s else scale
            elif unit is None and "$" in m["n"]:
                unit, scale = "USD", SCALES[s["s"]] if s else scale
    if unit is None and scale is None and re.fullmatch(r"(19|20)\d\d", raw.strip()) and (_YEAR_BEFORE.search(before) or re.match(r"\s*(年|年度)", after)):
        return None
    if unit is None:
        # a unit named elsewhere in the sentence: the nearest
        named = min(_IN_UNIT.finditer(content, first, last), key=lambda m: max(m.start() - end, start - m.end()), default=None)
        got = unit_of(named["u"]) if named else None
        if got and got[0] != "USD":
            return got[0], sign * amount * (scale or 1.0) * got[1], False
    if unit is not None:
        base, factor = UNITS[unit]
        if base != "USD":
            return base, sign * amount * (scale or 1.0) * factor, False
        if scale is None:
            scale = _passage_scale(content, start)
        return "USD", sign * amount * (scale or 1.0), scale is None
    stated = _passage_scale(content, start)
    if scale is None and stated is not None:
        return "USD", sign * amount * stated, False
    line = re.split(r"(?<=[.!?])\s+|\n", before)[-1]
    if COUNT_WORDS.search(line):
        return "each", sign * amount * (scale or 1.0), False
    if RATIO_WORDS.search(line):
        return "bp", sign * amount * 100.0, False
    return ("USD", sign * amount * scale, False) if scale is not None else None


def _passage_scale(content: str, start: int) -> float | None:
    """The dollar scale that a passage states; of several the nearest, one "below" only for what follows it."""
    best = None
    for m in _PASSAGE.finditer(content):
        if re.search(r"\bbelow\b", m.group()) and m.start() > start:
            continue
        if best is None or abs(m.start() - start) < abs(best[0] - start):
            best = (m.start(), SCALES[m["s"]])
    return best[1] if best else None


def printed_table(content: str) -> list[list[str]]:
    """The grid of a table printed with bars; the separator line is left out."""
    rows = []
    for line in content.split("\n"):
        t = line.strip()
        if t.startswith("|"):
            cells = [c.strip() for c in re.sub(r"^\||\|$", "", t).split("|")]
            if not all(re.fullmatch(r":?-{2,}:?", c) for c in cells):
                rows.append(cells)
    return rows


def _read_table(content: str, caption: str | None, grid: list[list[str | None]] | None, row: int, col: int, raw: str) -> Reading | None:
    rows = grid if grid is not None and len(grid) else printed_table(content)
    if row <= 0 or row >= len(rows) or col < 0:
        return None
    cells = ["" if c is None else str(c) for c in rows[row]]
    head = ["" if c is None else str(c) for c in rows[0]]
    label = cells[0] if cells else ""
    if col == 0:
        return None
    amount, sign, scale, unit = _printed(raw, False)
    if amount is None:
        return None
    column = head[col].strip() if col < len(head) else ""
    if column.lower() in ("note", "notes", "page", "year"):
        return None
    if unit is None and raw.rstrip(")").endswith("%"):
        unit = "%"
    stated = None
    m = _LABEL_UNIT.search(label)
    if m:
        stated = unit_of(next(g for g in m.groups() if g is not None)) or _words(next(g for g in m.groups() if g is not None))
    if stated is None:
        for j, h in enumerate(head):
            if h.strip().lower() in ("unit", "units") and j < len(cells) and j != col:
                stated = unit_of(cells[j])
    if unit is not None and UNITS[unit][0] != "USD":
        return UNITS[unit][0], sign * amount * (scale or 1.0) * UNITS[unit][1], False
    if stated is not None and unit is None and stated[0] != "USD":
        return stated[0], sign * amount * (scale or 1.0) * stated[1], False
    if unit is None and stated is None:
        dollars = any("$" in c for j, c in enumerate(cells) if j)
        if not dollars and COUNT_WORDS.search(label):
            return "each", sign * amount * (scale or 1.0), False
        if not dollars and RATIO_WORDS.search(label):
            return "bp", sign * amount * 100.0, False
    if scale is None and stated is not None and stated[0] == "USD":
        scale = stated[1]
    if scale is None:
        c = re.search(r"\(([^()]*)\)\s*$", column)
        got = unit_of(c[1].replace("$m", "$ m").replace("$k", "$ k").replace("$bn", "$ bn")) if c else None
        scale = got[1] if got and got[0] == "USD" else None
    if scale is None:
        notes = [head[0] if head else "", caption or ""]
        notes += [line[8:] for line in content.split("\n") if line.startswith("Caption:")]
        notes += [str(r[0]) for r in rows[1:] if r and r[0] and not any(c for c in r[1:])]
        notes += [line for line in content.split("\n")[1:] if not line.startswith(("|", "Section:", "Caption:"))]
        for n in notes:
            got = _words(n)
            if got:
                scale = got[1]
                break
    if scale is None and unit is None and stated is None and not _MONEY.search(" ".join([caption or "", content, *head, *cells])):
        return None  # nothing says what the cell counts
    return "USD", sign * amount * (scale or 1.0), scale is None


def _words(text: str) -> tuple[str, float] | None:
    """A dollar scale stated in words, as '(millions of dollars)' or 'Note: $ figures are billions'."""
    m = _TABLE_SCALE.search(text) or re.search(r"(?i)dollar (?:amounts|figures)\b[^.]*?\b(?P<a>hundreds of thousands|thousands|millions|billions)\b(?P<b>)?", text)
    return ("USD", SCALES[(m["a"] or m["b"]).lower()]) if m else None


def read_numbers(numbers: DataFrame, chunks: DataFrame) -> DataFrame:
    """(number_id, base_unit, amount, open, source, extracted_at, recorded): each distinct number as it is printed;
    open marks dollar amounts without a printed scale, recorded is the recorded value over the printed number. Without
    a company all chunks are one source; without values nothing is recorded."""
    cols = ["chunk_id", "char_start", "cell_row", "cell_col", "raw", "value", "extracted_at"]
    n = numbers.where("number_id is not null and chunk_id is not null and raw is not null")
    n = n if "value" in n.columns else n.withColumn("value", F.lit(None).cast("double"))
    n = n.groupBy("number_id").agg(F.max_by(F.struct(*cols), F.coalesce(F.col("extracted_at").cast("double"), F.lit(-1e18))).alias("r")).select("number_id", *[F.col(f"r.{c}").alias(c) for c in cols])
    # one row a chunk: its numbers (bounded by its own length) meet its text once
    by = n.groupBy("chunk_id").agg(F.collect_list(F.struct("number_id", "char_start", "cell_row", "cell_col", "raw", "value", "extracted_at")).alias("ns"))
    j = chunks.where("content is not null").select("chunk_id", "content", "caption", "raw_table", (F.coalesce("company", F.lit("")) if "company" in chunks.columns else F.lit("")).alias("source")).join(by, "chunk_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                grid = [list(x) if x is not None else [] for x in r.raw_table] if r.raw_table is not None else None
                for x in r.ns:
                    if x["char_start"] is not None and x["char_start"] >= 0:
                        got = _read_text(r.content, int(x["char_start"]), x["raw"]) if r.content[int(x["char_start"]) : int(x["char_start"]) + len(x["raw"])] == x["raw"] else None
                    elif x["cell_row"] is not None and x["cell_col"] is not None:
                        got = _read_table(r.content, r.caption, grid, int(x["cell_row"]), int(x["cell_col"]), x["raw"])
                    else:
                        got = None
                    if got is not None and abs(got[1]) < 9e18:
                        printed = _printed(x["raw"], False)[0]
                        ratio = abs(x["value"]) / printed if printed and x["value"] is not None and x["value"] == x["value"] else None
                        out.append((x["number_id"], *got, r.source, x["extracted_at"], ratio))
            yield pd.DataFrame(out, columns=["number_id", "base_unit", "amount", "open", "source", "extracted_at", "recorded"]).astype({"recorded": float, "extracted_at": "datetime64[ns]"})

    return j.mapInPandas(run, "number_id bigint, base_unit string, amount double, open boolean, source string, extracted_at timestamp, recorded double")


def recorded_scales(read: DataFrame, least_run: int = 5, tolerance: float = 0.15) -> DataFrame:
    """(number_id, factor): the dollar scale in which its source recorded each number with an open scale, where the
    history of the source (recorded over printed, in order of recording) stands in a segment of at least `least_run`
    numbers at the level of a known scale."""
    sources = read.where("open").select("source").distinct()
    history = read.where("recorded > 0").join(sources, "source", "left_semi").select("source", "extracted_at", "number_id", "open", "recorded")
    s = checkpoint(value_segments(history, "source", ["extracted_at", "number_id"], "recorded"))
    keys = ["source", "stretch_no", "segment_no"]
    runs = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first("level").alias("lev")).where(F.col("n") >= least_run)
    scale = F.lit(None).cast("double")
    for f in sorted({math.log10(x) for x in SCALES.values()}):
        scale = F.when(F.abs(F.col("lev") - f) <= tolerance, F.lit(10.0**f)).otherwise(scale)
    return s.where("open").join(runs.withColumn("factor", scale).where("factor is not null"), keys).select("number_id", "factor")


def common_units(numbers: DataFrame, chunks: DataFrame, history: bool = True) -> DataFrame:
    """(number_id, base_unit, base_value) of every distinct number that states a measured quantity; without `history`
    from what is printed alone."""
    read = checkpoint(read_numbers(numbers, chunks))
    value = F.col("amount")
    if history:
        read = read.join(recorded_scales(read), "number_id", "left")
        value = value * F.coalesce("factor", F.lit(1.0))
    return read.where(F.abs(value) < 9e18).select("number_id", "base_unit", F.bround(value).cast("bigint").alias("base_value"))
