"""Evidence, generation, citations and reranking, with models as pluggable callables."""

from __future__ import annotations

import inspect
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyvane.functions import fixed as X
from tallyvane.functions import text as T

RESPONSE = "answer string, citations array<struct<company string, document string, page int, section string, quote string>>, confidence string, abstained boolean"


class Generator(Protocol):
    """Turns a question and its evidence block into the model's raw response."""

    def __call__(self, question: str, evidence: str) -> str: ...


class Describer(Protocol):
    """Describes a figure from its image path and its caption; '' on failure. One that takes `company` and `section`
    is given them."""

    def __call__(self, image_path: str, context: str) -> str: ...


def evidence_filter(ranking: DataFrame, threshold: float = 0.0) -> DataFrame:
    """The evidence rows whose score reaches the threshold."""
    return ranking.where(F.col("score") >= threshold)


def abstains(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, abstained): true where no evidence is left."""
    has = evidence.select("query_id").distinct().withColumn("has", F.lit(True))
    return queries.select("query_id").distinct().join(has, "query_id", "left").select("query_id", F.col("has").isNull().alias("abstained"))


def evidence_block(ranking: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, block): numbered passages in rank order, joined by a line of three dashes."""
    j = ranking.join(chunks.select("chunk_id", "company", "document", "page", "section", "chunk_type", "content"), "chunk_id")
    no = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    or_ = lambda c, v: F.coalesce(F.col(c).cast("string"), F.lit(v))
    head = F.concat(F.lit("[Evidence "), no.cast("string"), F.lit("] Company: "), or_("company", "Unknown"), F.lit(" | Document: "), or_("document", "Unknown"), F.lit(" | Page: "), or_("page", "?"), F.lit(" | Section: "), or_("section", "N/A"), F.lit(" | Type: "), or_("chunk_type", "text"), F.lit(" | Score: "), F.format_string("%.3f", F.col("score")))
    p = j.select("query_id", "rank", F.concat(head, F.lit("\n"), F.coalesce("content", F.lit("")), F.lit("\n")).alias("p"))
    return p.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "p"))), lambda s: s["p"]), "\n---\n").alias("block"))


def parse_response(raw: Column) -> Column:
    """A response as a struct: code fences stripped, missing keys defaulted; text that is no JSON is the answer
    itself with low confidence."""
    bare = F.trim(F.regexp_replace(raw, r"```json\s*|\s*```", ""))
    s = F.from_json(bare, RESPONSE)
    ok = F.get_json_object(bare, "$").isNotNull() & bare.startswith("{")
    none = F.from_json(F.lit("[]"), "array<struct<company string, document string, page int, section string, quote string>>")
    return F.struct(
        F.when(ok, F.coalesce(s["answer"], F.lit(""))).otherwise(bare).alias("answer"),
        F.when(ok, F.coalesce(s["citations"], none)).otherwise(none).alias("citations"),
        F.when(ok, F.coalesce(s["confidence"], F.lit("low"))).otherwise(F.lit("low")).alias("confidence"),
        F.when(ok, F.coalesce(s["abstained"], F.lit(False))).otherwise(F.lit(False)).alias("abstained"),
    )


def valid_citations(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Citations whose company (ignoring case) and page occur in their query's evidence."""
    pairs = evidence.select("query_id", F.lower(F.coalesce("company", F.lit(""))).alias("lc"), "page").distinct()
    return citations.withColumn("lc", F.lower(F.coalesce("company", F.lit("")))).join(pairs, ["query_id", "lc", "page"], "left_semi").drop("lc")


def distinct_tokens(text: Column) -> Column:
    return F.array_distinct(T.tokens(text))


def token_overlap(q: Column, content: Column) -> Column:
    """The share of the query's distinct tokens in the passage's, through a sigmoid."""
    return T.sigmoid(8.0 * F.size(F.array_intersect(q, content)) / F.greatest(F.size(q), F.lit(1)) - 4.0)


def lexical_score(query: Column, content: Column) -> Column:
    """The offline stand-in for a pair scorer, on texts (see `token_overlap`)."""
    return token_overlap(distinct_tokens(query), distinct_tokens(content))


def rerank(ranking: DataFrame, questions: DataFrame, chunks: DataFrame, k: int = X.RERANK_TOP_K, scorer: Callable[[Column, Column], Column] = lexical_score) -> DataFrame:
    """The best k of each query by the scorer; ties keep the earlier order. For the lexical scorer each passage that is
    ranked at all is tokenised once, not once a query."""
    if scorer is lexical_score:
        some = chunks.select("chunk_id", "content").join(ranking.select("chunk_id").distinct(), "chunk_id", "left_semi")
        left, right, score = questions.select("query_id", distinct_tokens(F.col("question")).alias("question")), some.select("chunk_id", distinct_tokens(F.col("content")).alias("content")), token_overlap
    else:
        left, right, score = questions.select("query_id", "question"), chunks.select("chunk_id", "content"), scorer
    j = ranking.select("query_id", "chunk_id", F.col("rank").alias("before")).join(left, "query_id").join(right, "chunk_id")
    j = j.withColumn("score", F.round(score(F.col("question"), F.col("content")), 9))
    return j.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "before"))).where(F.col("rank") <= k).select("query_id", "chunk_id", "before", "score", "rank")


def extractive(question: str, evidence: str) -> str:
    """The offline stand-in for a language model: the first passage's first line with its own citation as JSON."""
    import json
    import re

    if not evidence:
        return json.dumps({"answer": "", "citations": [], "confidence": "low", "abstained": True})
    m = re.search(r"Company: (.*?) \| Document: (.*?) \| Page: (\d+) \| Section: (.*?) \|.*?\n(.*)", evidence)
    if not m:
        return json.dumps({"answer": evidence[:200], "confidence": "low"})
    return json.dumps({"answer": m[5][:200], "citations": [{"company": m[1], "document": m[2], "page": int(m[3]), "section": m[4], "quote": m[5][:80]}], "confidence": "medium", "abstained": False})


def generate(questions: DataFrame, blocks: DataFrame, model: Generator = extractive) -> DataFrame:
    """(query_id, answer, citations, confidence, abstained, calls, latency_s) of questions(query_id, question): one
    model call a row, in Arrow batches, none without evidence; a failing call or missing evidence abstains. latency_s
    is the call's time to two decimals."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, took = [], []
            for q, b in zip(pdf["question"], pdf["block"]):
                t = time.perf_counter()
                try:
                    out.append(model(q, b) if b else '{"answer": "", "abstained": true}')
                except Exception:  # noqa: BLE001 - whatever a model client raises
                    out.append('{"answer": "", "abstained": true}')
                took.append(round(time.perf_counter() - t, 2))
            yield pd.DataFrame({"query_id": pdf["query_id"], "raw": out, "calls": pdf["block"].notna().astype("int64"), "latency_s": np.array(took, dtype=float)})

    rows = questions.select("query_id", "question").join(blocks, "query_id", "left").mapInPandas(run, "query_id bigint, raw string, calls bigint, latency_s double")
    return rows.select("query_id", parse_response(F.col("raw")).alias("r"), "calls", "latency_s").select("query_id", "r.*", "calls", "latency_s")


def display(results: DataFrame, mismatches: DataFrame | None = None) -> DataFrame:
    """(query_id, shown): the answer, its distinct sources, the warnings of mismatches(query_id, num_ord, message) and
    the confidence as one text; see the formats in `fixed`."""
    none = F.array().cast("array<string>")
    or_ = lambda c, v: F.coalesce(c.cast("string"), F.lit(v))
    line = lambda c: F.concat(F.lit(X.BULLET), or_(c["company"], "Unknown"), F.lit(" \u2014 "), or_(c["document"], ""), F.lit(" | Page "), or_(c["page"], "?"), F.when(or_(c["section"], "") != "", F.concat(F.lit(" | "), c["section"])).otherwise(""))
    src = F.array_distinct(F.transform(F.coalesce("citations", F.from_json(F.lit("[]"), results.schema["citations"].dataType)), line))
    r = results
    if mismatches is not None:
        warned = mismatches.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("num_ord", "message"))), lambda m: F.concat(F.lit(X.BULLET), m["message"])).alias("warnings"))
        r = r.join(warned, "query_id", "left")
    warnings = F.coalesce("warnings", none) if mismatches is not None else none
    parts = F.concat(
        F.array(F.coalesce("answer", F.lit("")), F.lit("")),
        F.when(F.size(src) > 0, F.concat(F.array(F.lit(X.SOURCES)), src)).otherwise(none),
        F.when(F.size(warnings) > 0, F.concat(F.array(F.lit(""), F.lit(X.WARNINGS)), warnings)).otherwise(none),
        F.array(F.concat(F.lit("\n*Confidence: "), F.coalesce("confidence", F.lit("")), F.lit("*"))),
    )
    return r.select("query_id", F.array_join(parts, "\n").alias("shown"))


def describe_charts(elements: DataFrame, model: Describer | None = None) -> DataFrame:
    """Figures with a description from the model, which gets image path, caption and, if it takes them, company and
    section; without a model figures are dropped, other elements are kept."""
    if model is None:
        return elements.where("element_type <> 'chart'")
    schema = elements.schema
    takes = set(inspect.signature(model).parameters) & {"company", "section"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = []
            more = zip(*[[x or "" for x in pdf[c]] for c in sorted(takes)]) if takes else iter([()] * len(pdf))
            for kind, path, caption, old, extra in zip(pdf["element_type"], pdf["image_path"], pdf["caption"], pdf["description"], more):
                try:
                    texts.append((model(path, caption or "", **dict(zip(sorted(takes), extra))) or "") if kind == "chart" else old)
                except Exception:  # noqa: BLE001
                    texts.append("")
            yield pdf.assign(description=texts)

    return elements.mapInPandas(run, schema)


def judge(rows: DataFrame, model: Callable[[str, str], str], system: str = "Score from 0 to 1 as JSON with keys score and reason.") -> DataFrame:
    """Adds score and reason to rows(query_id, text): one judge call a row, its JSON read and the score clamped to
    [0, 1]; a failing call or text that is no JSON scores 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t in pdf["text"]:
                try:
                    out.append(model(system, t))
                except Exception:  # noqa: BLE001
                    out.append(None)
            yield pdf.assign(raw=pd.Series(out, dtype="object", index=pdf.index))

    j = rows.select("query_id", "text").mapInPandas(run, "query_id bigint, text string, raw string")
    return j.select("query_id", T.clamp_score(F.get_json_object("raw", "$.score")).alias("score"), F.coalesce(F.get_json_object("raw", "$.reason"), F.lit("")).alias("reason"))


def append_history(results: DataFrame, path: str) -> None:
    """Appends query_id, answer and abstained to a history table."""
    results.select("query_id", "answer", "abstained").write.mode("append").parquet(path)
