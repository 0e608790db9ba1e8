"""Extraction of financial numbers from text, as one Arrow-batched pass per text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvane.functions import fixed as X

SCHEMA = "raw string, value double, is_percent boolean, is_negative boolean, context string, metric_keywords array<string>, char_start int"
_PAREN = re.compile(X.PAREN_NUMBER, re.IGNORECASE)
_PLAIN = re.compile(X.PLAIN_NUMBER, re.IGNORECASE)
_WORD = re.compile(r"\b\w+\b")
_VOCABULARY = frozenset(X.METRIC_KEYWORDS)


def scaled(digits: str, unit: str | None) -> float:
    """The number behind printed digits and a unit word or letter."""
    plain = digits.replace(",", "")
    return (float(plain) if plain else 0.0) * (X.MULTIPLIERS[unit.lower()] if unit else 1.0)


def numbers_in(text: str) -> list[tuple]:
    """All numbers: those in parentheses first, then the others; each with position, sign, context and keywords."""
    out = []

    def note(m: re.Match, negative: bool) -> None:
        _, digits, unit, percent = m.groups()
        if not digits.strip(",."):
            return
        v, (a, b) = scaled(digits, unit), m.span()
        n, w = len(text), X.CONTEXT_CHARS
        near = _WORD.findall(text[max(0, a - w) : min(n, a + w)].lower())
        out.append((m.group().strip(), -v if negative and not percent else v, bool(percent), negative, text[max(0, a - w) : min(n, b + w)].replace("\n", " "), sorted(set(near) & _VOCABULARY), a))

    for m in _PAREN.finditer(text):
        note(m, True)
    # what parentheses hold is masked in equal length by a mark that is neither a word nor a space; only spans
    # that gave a number are, so '(,)' stays
    masked = _PAREN.sub(lambda m: "#" * len(m.group()) if m.group(2).strip(",.") else m.group(), text)
    for m in _PLAIN.finditer(masked):
        note(m, False)
    return out


def extract_numbers(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each number of each text: key, num_ord and the fields of a number. Null texts give none."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, *r) for k, t in zip(pdf["k"], pdf["t"]) if t is not None for i, r in enumerate(numbers_in(t))]
            yield pd.DataFrame(rows, columns=["k", "num_ord", "raw", "value", "is_percent", "is_negative", "context", "metric_keywords", "char_start"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull()).mapInPandas(run, f"k {kind}, num_ord int, {SCHEMA}").withColumnRenamed("k", key)
