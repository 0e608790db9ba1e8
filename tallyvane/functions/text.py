"""Column functions on text: tokens, query classes, boosts, headings, table rendering. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyvane.functions import fixed as X


def tokens(text: Column) -> Column:
    """Financial tokens of a text, in order, with multiplicity; null text gives an empty array."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(X.TOKEN), F.lit(0))
    stop = F.array(*[F.lit(w) for w in X.STOP_WORDS])
    return F.filter(F.transform(found, canonical_token), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def canonical_token(token: Column) -> Column:
    """'$4.2 billion', '$4.2bn' -> '$4.2b'; '23.5 percent' -> '23.5%'; others without commas and white space."""
    t = F.regexp_replace(token, rf"(?:,|{X.WS})", "")
    for words, letter in (("billion|bn", "b"), ("million|mn", "m"), ("thousand", "k")):
        t = F.regexp_replace(t, rf"^\$([\p{{Nd}}.]+)(?:{words})$", f"\\$$1{letter}")
    return F.regexp_replace(t, r"^([\p{Nd}.]+)percent.*$", "$1%")


def word_count(text: Column) -> Column:
    """Words between white space; 0 for null or blank text."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def any_pattern(text: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike("(?i)" + p)
    return out


def mentioned(text: Column, companies: list[str]) -> Column:
    """The listed companies whose name occurs in the text, ignoring case, in list order."""
    low = F.lower(text)
    return F.filter(F.array(*[F.lit(c) for c in companies]) if companies else F.array().cast("array<string>"), lambda c: low.contains(F.lower(c)))


def query_class(query: Column, companies: list[str] | None = None) -> Column:
    """cross_company, comparison, numerical, chart_trend or factual; the first that matches, in this order.

    Two different companies named within 80 characters make a cross-company query; without a company list (or
    with an empty one) the default names are used.
    """
    q = F.trim(F.coalesce(query, F.lit("")))
    names = [c.lower() for c in (companies or X.DEFAULT_COMPANIES)]
    pair = F.lit(False)
    if len(names) > 1:
        esc = "|".join("\\Q" + n + "\\E" for n in names)
        span = F.lower(F.regexp_extract(q, rf"(?i)(?:{esc}).{{0,80}}(?:{esc})", 0))
        pair = F.size(F.filter(F.array(*[F.lit(n) for n in names]), lambda c: span.contains(c))) >= 2
    return (
        F.when(any_pattern(q, X.CROSS_COMPANY_PATTERNS) | pair, "cross_company")
        .when(any_pattern(q, X.COMPARISON_PATTERNS), "comparison")
        .when(any_pattern(q, X.NUMERICAL_PATTERNS), "numerical")
        .when(any_pattern(q, X.CHART_TREND_PATTERNS), "chart_trend")
        .otherwise("factual")
    )


def class_weight(kind: Column, side: int) -> Column:
    """The weight of the dense (0) or lexical (1) list for a query class."""
    out = F.lit(X.WEIGHTS["factual"][side])
    for k, w in X.WEIGHTS.items():
        out = F.when(kind == k, w[side]).otherwise(out)
    return out


def class_confidence(kind: Column) -> Column:
    return F.when(kind == "factual", "low").when(kind == "chart_trend", "medium").otherwise("high")


def describe_class(kind: Column) -> Column:
    """One line that names the class and its weights in percent."""
    return F.format_string("[%s] dense=%.0f%% | bm25=%.0f%% | confidence=%s", kind, class_weight(kind, 0) * 100, class_weight(kind, 1) * 100, class_confidence(kind))


def table_boost(kind: Column, chunk_type: Column, boost: float = X.TABLE_BOOST) -> Column:
    return F.when(kind.isin(X.TABLE_BOOST_TYPES) & (chunk_type == "table"), boost).otherwise(0.0)


def domain_boost(query: Column, content: Column, section: Column, chunk_type: Column, boost: float = X.DOMAIN_BOOST) -> Column:
    """Per metric term of the query found in content or section, one boost; one for a year of the query in the
    content, one for a statement term, half of one for a table, minus one and a half for a distractor."""
    q, c, s = F.lower(query), F.lower(F.coalesce(content, F.lit(""))), F.lower(F.coalesce(section, F.lit("")))
    has = lambda t: c.contains(t) | s.contains(t)
    some = lambda ts: F.exists(F.array(*[F.lit(t) for t in ts]), has)
    metrics = sum((F.when(q.contains(t) & has(t), boost).otherwise(0.0) for t in X.METRIC_TERMS), F.lit(0.0))
    years = F.regexp_extract_all(q, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1))
    return (
        metrics
        + F.when(F.exists(years, lambda y: c.contains(y)), boost).otherwise(0.0)
        + F.when(some(X.STATEMENT_TERMS), boost).otherwise(0.0)
        + F.when(chunk_type == "table", boost * 0.5).otherwise(0.0)
        - F.when(some(X.DISTRACTOR_TERMS), boost * 1.5).otherwise(0.0)
    )


def is_heading(line: Column) -> Column:
    """A known section prefix, or all capitals and 6 to 119 characters; never blank or over 200 characters."""
    t = F.trim(line)
    caps = (F.upper(t) == t) & (F.lower(t) != t) & (F.length(t) > 5) & (F.length(t) < 120)
    return (t != "") & (F.length(t) <= X.HEADING_MAX) & (t.rlike("(?i)" + X.HEADING) | caps)


def _present(x: Column) -> Column:
    return F.coalesce(x, F.lit("")) != ""


def table_text(grid: Column, caption: Column, section: Column) -> Column:
    """A grid as text: Section and Caption lines if given, header, separator, the rows that are not all blank.

    Short rows are padded to the longest; null cells are empty; an empty or null grid gives ''.
    """
    width = F.array_max(F.transform(grid, lambda r: F.size(F.coalesce(r, F.array().cast("array<string>")))))
    cells = lambda r: F.concat(F.transform(F.coalesce(r, F.array().cast("array<string>")), lambda c: F.coalesce(c, F.lit(""))), F.array_repeat(F.lit(""), (width - F.size(F.coalesce(r, F.array().cast("array<string>")))).cast("int")))
    line = lambda r: F.concat(F.lit("| "), F.array_join(cells(r), " | "), F.lit(" |"))
    body = F.filter(F.slice(grid, 2, F.greatest(F.size(grid) - 1, F.lit(0))), lambda r: F.exists(cells(r), lambda c: F.trim(c) != ""))
    rows = F.concat(
        F.when(_present(section), F.array(F.concat(F.lit("Section: "), section))).otherwise(F.array().cast("array<string>")),
        F.when(_present(caption), F.array(F.concat(F.lit("Caption: "), caption))).otherwise(F.array().cast("array<string>")),
        F.array(line(F.element_at(grid, 1)), F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width.cast("int")), " | "), F.lit(" |"))),
        F.transform(body, line),
    )
    return F.when(F.coalesce(F.size(grid), F.lit(0)) <= 0, "").otherwise(F.array_join(rows, "\n"))


def header(kind: str, company: Column, document: Column, page: Column, section: Column | None = None) -> Column:
    """The bracketed provenance line of a chunk; the section only where it is given and not empty."""
    parts = [F.lit(kind)] if kind else []
    parts += [F.coalesce(company, F.lit("")), F.coalesce(document, F.lit("")), F.concat(F.lit("Page "), F.coalesce(page.cast("string"), F.lit("0")))]
    line = F.concat_ws(" | ", *parts)
    if section is not None:
        line = F.when(_present(section), F.concat_ws(" | ", line, section)).otherwise(line)
    return F.concat(F.lit("["), line, F.lit("]"))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def clamp_score(raw: Column) -> Column:
    """A judge's score as a number in [0, 1]; anything else is 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(raw.try_cast("double"), F.lit(0.0))))


def stem_keywords(words: Column) -> Column:
    """Trailing s stripped from words of more than three letters."""
    return F.transform(words, lambda w: F.when(F.length(w) > 3, F.regexp_replace(w, "s+$", "")).otherwise(w))
