"""Where models come from: an ordered choice of clients, the chart prompt, and judges. All models are callables."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvane.functions.text import clamp_score

#: Builds a callable from its key; raises ImportError where its client library is missing.
Builder = Callable[[str], Callable]


def first_available(builders: list[tuple[str, Builder]], environment: Mapping[str, str] | None = None) -> Callable | None:
    """The first model whose environment variable holds a key and whose client library can be imported, in the order
    given; None if there is none, and the stages that need a model are then left out."""
    env = os.environ if environment is None else environment
    for variable, build in builders:
        key = (env.get(variable) or "").strip()
        if not key:
            continue
        try:
            return build(key)
        except ImportError:
            continue
    return None


def gemini_vision(key: str, model: str = "gemini-1.5-flash") -> Callable:
    """A figure describer on the Gemini client, if it is installed."""
    import google.generativeai as client

    client.configure(api_key=key)

    def describe(system: str, context: str, image: str) -> str:
        parts = [system, context, {"mime_type": "image/png", "data": base64.b64decode(image)}]
        return client.GenerativeModel(model).generate_content([p for p in parts if p]).text.strip()

    return describe


def openai_vision(key: str, model: str = "gpt-4o-mini") -> Callable:
    """A figure describer on the OpenAI client, if it is installed."""
    from openai import OpenAI

    client = OpenAI(api_key=key)

    def describe(system: str, context: str, image: str) -> str:
        user = [{"type": "text", "text": context}] if context else []
        user.append({"type": "image_url", "image_url": {"url": f"data:image/png;base64,{image}", "detail": "high"}})
        r = client.chat.completions.create(model=model, messages=[{"role": "system", "content": system}, {"role": "user", "content": user}], max_tokens=512, temperature=0.0)
        return r.choices[0].message.content.strip()

    return describe


def openai_json(key: str, model: str = "gpt-4o-mini") -> Callable:
    """A judge (system, user) -> JSON text on the OpenAI client, if it is installed."""
    from openai import OpenAI

    client = OpenAI(api_key=key)

    def ask(system: str, user: str) -> str:
        r = client.chat.completions.create(model=model, temperature=0, response_format={"type": "json_object"}, messages=[{"role": "system", "content": system}, {"role": "user", "content": user}])
        return r.choices[0].message.content or "{}"

    return ask


#: Clients in order of preference.
VISION: list[tuple[str, Builder]] = [("GEMINI_API_KEY", gemini_vision), ("OPENAI_API_KEY", openai_vision)]
JUDGE: list[tuple[str, Builder]] = [("OPENAI_API_KEY", openai_json)]

CHART_FIELDS = ["Chart", "Company", "Period", "Type", "X-axis", "Y-axis", "Key values", "Trend", "Notable"]


def chart_prompt(company: str | None) -> str:
    """What a describer is asked for: one line a field, the company as the default of its field."""
    lines = [f"{f}: ..." if f != "Company" else f"Company: as shown, else {company or 'Unknown'}" for f in CHART_FIELDS]
    return "Describe this figure of a business report. Answer with these lines only, N/A where nothing is shown; under Key values one line '- metric: value (period)' for each of the main points.\n" + "\n".join(lines)


def chart_context(section: str | None, caption: str | None) -> str:
    """What is known of a figure, for the describer; '' if nothing is."""
    return "\n".join([f"Section: {section}"] * bool(section) + [f"Caption/nearby text: {caption}"] * bool(caption)).strip()


def image_base64(path: str) -> str:
    """A file of any file system as base64; FileNotFoundError if it is missing."""
    from pyarrow import fs

    filesystem, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with filesystem.open_input_file(at) as f:
        return base64.b64encode(f.read()).decode("ascii")


def vision_describer(client: Callable[[str, str, str], str]) -> Callable[..., str]:
    """A describer for `answers.describe_charts` that sends prompt, context and the image itself; a missing file or a
    failing call gives ''."""

    def describe(image_path: str, context: str, company: str = "", section: str = "") -> str:
        try:
            return client(chart_prompt(company), chart_context(section, context), image_base64(image_path)) or ""
        except Exception:  # noqa: BLE001 - whatever a client raises
            return ""

    return describe


FAITHFULNESS = "Judge strictly and answer in JSON with the keys score (0 to 1) and reason: how far do the passages support the answer? What the passages do not say does not count."
CORRECTNESS = "Judge strictly and answer in JSON with the keys score (0 to 1) and reason: how far does the answer agree with the reference and answer the question?"


def faithfulness_text(answer: str, evidence: list[str]) -> str:
    return f"ANSWER:\n{answer}\n\nEVIDENCE:\n" + "\n\n--- EVIDENCE ---\n".join(evidence)


def correctness_text(question: str, answer: str, reference: str) -> str:
    return f"QUESTION:\n{question}\n\nREFERENCE ANSWER:\n{reference}\n\nMODEL ANSWER:\n{answer}"


def overlap_judge(system: str, user: str) -> str:
    """The offline stand-in for a judge: the share of the distinct words of the first part that occur in the last."""
    import json
    import re

    parts = [p.split(":\n", 1)[-1] for p in re.split(r"\n\n(?=[A-Z ]+:\n)", user)]
    first, last = (set(re.findall(r"[a-z0-9]+", p.lower())) for p in (parts[0] if system == FAITHFULNESS else parts[1], parts[-1]))
    return json.dumps({"score": len(first & last) / len(first) if first else 0.0, "reason": "shared words"})


def judge_answers(rows: DataFrame, model: Callable[[str, str], str] = overlap_judge) -> DataFrame:
    """(query_id, faithfulness, answer_correctness, calls) of rows(query_id, question, answer, evidence array<string>,
    gold_answer): two judge calls a row (one without a reference), scores clamped to [0, 1]; a failing call or text
    that is no JSON scores 0; without a reference the correctness is null."""
    import pandas as pd

    def run(batches):
        def ask(system: str, user: str) -> str | None:
            try:
                return model(system, user)
            except Exception:  # noqa: BLE001
                return None

        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                a = ask(FAITHFULNESS, faithfulness_text(r.answer or "", list(r.evidence if r.evidence is not None else [])))
                b = ask(CORRECTNESS, correctness_text(r.question or "", r.answer or "", r.gold_answer)) if r.gold_answer is not None else None
                out.append((r.query_id, a, b, r.gold_answer is not None, 1 + (r.gold_answer is not None)))
            yield pd.DataFrame(out, columns=["query_id", "a", "b", "ref", "calls"])

    j = rows.select("query_id", "question", "answer", "evidence", "gold_answer").mapInPandas(run, "query_id bigint, a string, b string, ref boolean, calls bigint")
    score = lambda c: clamp_score(F.get_json_object(c, "$.score"))
    return j.select("query_id", score("a").alias("faithfulness"), F.when(F.col("ref"), score("b")).alias("answer_correctness"), "calls")


def usage(generated: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """(kind, calls): how often models were called for generated answers and for judging."""
    g = generated.agg(F.lit("generate").alias("kind"), F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"))
    return g if judged is None else g.union(judged.agg(F.lit("judge").alias("kind"), F.coalesce(F.sum("calls"), F.lit(0)).alias("calls")))
