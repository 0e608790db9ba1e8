"""The engine as one object: ingest, index, retrieve in any mode, answer, verify, evaluate; and its command line.

    python -m tallyvane.engine ingest --config config.yaml [--docs folder] --out folder [--skip-charts]
    python -m tallyvane.engine ask --index folder --question "..." [--mode hybrid]
    python -m tallyvane.engine evaluate --index folder --questions questions.json --out results.json
"""

from __future__ import annotations

import argparse
import json
import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvane.functions import fixed as X
from tallyvane.functions.numbers import extract_numbers
from tallyvane.operators import answers, bm25, chunking, dense, fusion, metrics, models, verify
from tallyvane.session import checkpoint
from tallyvane.sources import config as conf
from tallyvane.sources import elements as src
from tallyvane.sources.pdf import document_parser

log = logging.getLogger(__name__)

MODES = ("dense", "bm25", "unweighted", "hybrid", "reranked", "trace")


def ingest(spark: SparkSession, config: conf.Config, folder: str, out: str, parser: src.PageParser = document_parser, describer: answers.Describer | None = None, encoder: Callable[[Column], Column] | None = None) -> DataFrame:
    """Documents to chunks, embeddings and lexical index below `out`; returns the yield of every document.

    Files that the manifest names and the folder lacks are skipped with a warning (the first hundred by name).
    Without a describer figures are left out. Chunks are numbered by id, so a rebuild gives the same order. The
    text-only corpus is the chunk_type=text folder of the same table: nothing is embedded twice.
    """
    manifest = conf.manifest(spark, config)
    missing = src.missing_files(manifest, src.source_files(spark, folder)).select("filename").limit(101).collect()
    for r in missing[:100]:
        log.warning("%s is in the manifest but not in %s; skipped", r.filename, folder)
    if len(missing) > 100:
        log.warning("more files are missing")
    # parsed once: layout, figures and yields all read it
    e = chunking.layout(checkpoint(src.read_documents(spark, folder, manifest, parser)))
    e = e.withColumn("element_id", F.xxhash64("document", "page", "element_type", "content", F.to_json("grid"), "image_path", F.to_json("bbox")))
    e = checkpoint(answers.describe_charts(chunking.clean_grid(e), describer))
    src.write_chunks(chunking.chunk(e, config.text_max_words, config.text_overlap_words, config.table_max_words).dropDuplicates(["chunk_id"]).withColumn("ord", F.xxhash64("chunk_id")), f"{out}/chunks")
    chunks = spark.read.parquet(f"{out}/chunks")
    enc = encoder or dense.hashed_encoder()
    dense.save(chunks.select("chunk_id", "ord", enc(F.col("content")).alias("embedding")), out)
    bm25.save(bm25.index(chunks), out)
    return chunking.document_yield(manifest, e)


@dataclass
class Engine:
    """Tables of an index folder with the pluggable models."""

    spark: SparkSession
    folder: str
    config: conf.Config = field(default_factory=conf.Config)
    query_encoder: Callable[[Column], Column] | None = None
    scorer: Callable[[Column, Column], Column] = answers.lexical_score
    generator: answers.Generator = answers.extractive

    def __post_init__(self) -> None:
        self.chunks = self.spark.read.parquet(f"{self.folder}/chunks")
        self.embeddings = dense.load(self.spark, self.folder)
        self.lexical_index = bm25.load(self.spark, self.folder)
        self.companies = self.chunks.select("company").distinct()

    def _dense(self, q: DataFrame, k: int) -> DataFrame:
        enc = self.query_encoder or dense.hashed_encoder(prefix=X.QUERY_PREFIX)
        return dense.search(q.select("query_id", enc(F.col("question")).alias("embedding")), self.embeddings, k)

    def _lexical(self, q: DataFrame, k: int) -> DataFrame:
        return bm25.search(q.select("query_id", F.col("question").alias("query")), self.lexical_index, k, self.config.bm25_k1, self.config.bm25_b)

    def retrieve(self, questions: DataFrame, mode: str = "hybrid", use_classifier: bool = True, where: dict | None = None) -> DataFrame:
        """Ranked chunks of questions(query_id, question) in one of MODES. Hybrid and reranked questions that name
        two companies or more take the company-balanced way when the classifier is on."""
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        c = self.config
        if mode == "dense":
            return self._dense(questions, c.dense_top_k)
        if mode == "bm25":
            return self._lexical(questions, c.bm25_top_k)
        classify = use_classifier and mode != "unweighted"
        if mode in ("trace", "unweighted") or not classify:
            q = fusion.classified_by_names(questions, self.companies) if classify else fusion.unclassified(questions)
            d, b = self._dense(questions, c.dense_top_k), self._lexical(questions, c.bm25_top_k)
            if mode == "trace":
                return fusion.trace(q, d, b, self.chunks, c.dense_top_k, rrf_k=c.rrf_k)
            out = fusion.hybrid(q, d, b, self.chunks, c.dense_top_k, boosts=mode != "unweighted", where=where, rrf_k=c.rrf_k)
        else:
            out = fusion.adaptive(questions, self.companies, self._dense, self._lexical, self.chunks, c.dense_top_k, c.dense_top_k, c.bm25_top_k, where, classify=lambda q: fusion.classified_by_names(q, self.companies), rrf_k=c.rrf_k)
        return answers.rerank(out, questions, self.chunks, c.rerank_top_k, self.scorer) if mode == "reranked" else out

    def answer(self, questions: DataFrame, mode: str = "reranked", use_classifier: bool = True) -> DataFrame:
        """(query_id, answer, citations, confidence, abstained, verified, summary, calls, latency_s, shown) of
        questions; shown is the answer with sources and warnings as one text."""
        r = answers.evidence_filter(self.retrieve(questions, mode, use_classifier).where(F.col("rank") <= self.config.rerank_top_k), self.config.evidence_threshold)
        ev = r.join(self.chunks.select("chunk_id", "company", "page", "content"), "chunk_id")
        # written once: a model is asked once a question
        g = checkpoint(answers.generate(questions, answers.evidence_block(r, self.chunks), self.generator))
        a = extract_numbers(g, "query_id", "answer").select(F.col("query_id").alias("answer_id"), "num_ord", "raw", "value", "is_percent", F.col("metric_keywords").alias("keywords"))
        e = extract_numbers(ev.withColumn("key", F.struct("query_id", "rank")), "key", "content").select(F.col("key.query_id").alias("answer_id"), (F.col("key.rank") * 1_000_000 + F.col("num_ord")).cast("bigint").alias("ev_ord"), "value", F.col("metric_keywords").alias("keywords"))
        status = verify.verify(a, e, self.config.tolerance, self.config.require_context)
        report = verify.report(g.select(F.col("query_id").alias("answer_id")), a, e, status)
        warned = verify.mismatches(a, e, status, self.config.tolerance).withColumnRenamed("answer_id", "query_id")
        cites = g.select("query_id", F.posexplode("citations").alias("i", "c")).select("query_id", "i", "c.*")
        ok = answers.valid_citations(cites, ev).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "company", "document", "page", "section", "quote"))), lambda s: s.dropFields("i")).alias("citations"))
        j = g.drop("citations").join(ok, "query_id", "left").join(report.withColumnRenamed("answer_id", "query_id").select("query_id", "verified", "summary"), "query_id", "left")
        j = j.withColumn("citations", F.coalesce("citations", F.from_json(F.lit("[]"), "array<struct<company string, document string, page int, section string, quote string>>")))
        return j.join(answers.display(j, warned), "query_id").select("query_id", "answer", "citations", "confidence", "abstained", "verified", "summary", "calls", "latency_s", "shown")

    def evaluate(self, questions: DataFrame, judge: Callable[[str, str], str] | None = None) -> dict:
        """Mean retrieval metrics of every mode over in-scope questions, abstention over the others, citation
        accuracy, mean latency of a model call, model calls, wall-clock seconds of each mode and, with a judge,
        faithfulness and correctness. questions: query_id, question, company, evidence_pages, in_scope and, for
        the judge, gold_answer."""
        inside, outside = questions.where("in_scope"), questions.where("not in_scope")
        gold = metrics.gold_labels(inside, self.chunks)
        out: dict = {"ablation": {}, "seconds": {}}
        for mode in ("dense", "bm25", "unweighted", "hybrid", "reranked"):
            t = time.time()
            m = metrics.retrieval_metrics(inside, self.retrieve(inside, mode), gold)
            row = metrics.mean_metrics(m.withColumn("mode", F.lit(mode)), ["mode"]).first()
            out["ablation"][mode] = {k: v for k, v in row.asDict().items() if k != "mode"} if row else {}
            out["seconds"][mode] = round(time.time() - t, 2)
        refused, given = checkpoint(self.answer(outside)), checkpoint(self.answer(inside))
        out["abstention_accuracy"] = refused.agg(F.avg(F.col("abstained").cast("double"))).first()[0] or 0.0
        cites = given.select("query_id", F.explode("citations.page").alias("page"))
        out["citation_accuracy"] = metrics.citation_accuracy(cites, inside).agg(F.avg("accuracy")).first()[0] or 0.0
        out["numerical_verified"] = given.agg(F.avg(F.col("verified").cast("double"))).first()[0] or 0.0
        both = given.unionByName(refused)
        out["latency_s"] = round(both.agg(F.avg("latency_s")).first()[0] or 0.0, 2)
        judged = None
        if judge is not None:
            best = self.retrieve(inside, "reranked").join(self.chunks.select("chunk_id", "content"), "chunk_id")
            ev = best.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]).alias("evidence"))
            q = inside if "gold_answer" in inside.columns else inside.withColumn("gold_answer", F.lit(None).cast("string"))
            judged = checkpoint(models.judge_answers(given.select("query_id", "answer").join(q.select("query_id", "question", "gold_answer"), "query_id").join(ev, "query_id", "left"), judge))
            row = judged.agg(F.round(F.avg("faithfulness"), 4), F.round(F.avg("answer_correctness"), 4)).first()
            out["faithfulness"], out["answer_correctness"] = row[0] or 0.0, row[1] or 0.0
        out["calls"] = {r.kind: r.calls for r in models.usage(both, judged).collect()}
        return out


def summary_lines(results: dict) -> list[str]:
    """The results of `Engine.evaluate` as lines: one a mode with its main metrics, then the other figures."""
    names = ("mrr", "ndcg_5", "recall_5", "precision_5")
    lines = ["mode".ljust(12) + "".join(n.rjust(13) for n in (*names, "seconds"))]
    for mode, m in results.get("ablation", {}).items():
        lines.append(mode.ljust(12) + "".join(f"{m.get(n, 0.0) or 0.0:13.4f}" for n in names) + f"{results.get('seconds', {}).get(mode, 0.0):13.2f}")
    return lines + [f"{k}: {v}" for k, v in results.items() if k not in ("ablation", "seconds")]


def ask(spark: SparkSession, folder: str, question: str, mode: str = "reranked", use_classifier: bool = True) -> dict:
    """One question as a batch of one."""
    q = spark.createDataFrame([(1, question)], "query_id bigint, question string")
    return Engine(spark, folder).answer(q, mode, use_classifier).first().asDict(recursive=True)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tallyvane")
    sub = p.add_subparsers(dest="what", required=True)
    i = sub.add_parser("ingest")
    for a in ("--config", "--out"):
        i.add_argument(a, required=True)
    i.add_argument("--docs", help="folder of the documents; the configuration's data folder if not given")
    i.add_argument("--skip-charts", "--skip_charts", action="store_true", help="leave figures out even if a model to describe them is at hand")
    a = sub.add_parser("ask")
    a.add_argument("--index", required=True)
    a.add_argument("--question", required=True)
    a.add_argument("--mode", default="reranked", choices=MODES)
    e = sub.add_parser("evaluate")
    for x in ("--index", "--questions", "--out"):
        e.add_argument(x, required=True)
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("tallyvane").getOrCreate()
    if args.what == "ingest":
        config = conf.load_config(args.config)
        client = None if args.skip_charts else models.first_available(models.VISION)
        for r in ingest(spark, config, args.docs or config.data_dir, args.out, describer=client and models.vision_describer(client)).where("verdict <> 'ok'").toLocalIterator():
            print(f"{r.verdict}: {r.document} has {r.n} elements")
    elif args.what == "ask":
        print(json.dumps(ask(spark, args.index, args.question, args.mode), ensure_ascii=False, indent=1))
    else:
        q = spark.read.schema("query_id bigint, question string, company string, evidence_pages array<int>, in_scope boolean, gold_answer string").json(args.questions)
        results = Engine(spark, args.index).evaluate(q, models.first_available(models.JUDGE))
        with open(args.out, "w", encoding="utf-8") as f:
            json.dump(results, f, indent=1)
        print("\n".join(summary_lines(results)))


if __name__ == "__main__":
    main()
