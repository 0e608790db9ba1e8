"""Search, fusion, boosts, company balance and metrics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyvane.operators import answers as A
from tallyvane.operators import bm25, dense, fusion, metrics
from tallyvane.operators.components import connected_components

R = "query_id bigint, chunk_id string, ord bigint, rank int"
CHUNK = "chunk_id string, ord bigint, content string, section string, chunk_type string, company string, year int, page int, document string"


def test_bm25_by_hand(spark):
    docs = ["cat dog", "cat cat mouse", "bird song tree", None, "tree house"]
    c = spark.createDataFrame([(f"c{i}", i, t) for i, t in enumerate(docs)], "chunk_id string, ord bigint, content string")
    q = spark.createDataFrame([(1, "cat mouse cat"), (2, "zzz"), (3, ""), (4, None)], "query_id bigint, query string")
    got = [(r.query_id, r.chunk_id, r.score) for r in bm25.search(q, bm25.index(c)).orderBy("query_id", "rank").collect()]
    toks = [(d or "").split() for d in docs]
    n, avg = len(docs), sum(map(len, toks)) / len(docs)
    idf = {t: math.log(n - df + 0.5) - math.log(df + 0.5) for t in {x for d in toks for x in d} for df in [sum(t in d for d in toks)]}
    mean = sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in idf.items()}
    want = []
    for i, d in enumerate(toks):
        s = sum(idf[t] * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in ["cat", "mouse", "cat"] if t in d)
        if s > 0:
            want.append((1, f"c{i}", round(s, 9)))
    assert got == sorted(want, key=lambda x: -x[2])


def test_index_round_trip(spark, tmp_path):
    c = spark.createDataFrame([("a", 0, "tax rate"), ("b", 1, "tax")], "chunk_id string, ord bigint, content string")
    bm25.save(bm25.index(c), str(tmp_path))
    q = spark.createDataFrame([(1, "rate")], "query_id bigint, query string")
    assert [r.chunk_id for r in bm25.search(q, bm25.load(spark, str(tmp_path))).collect()] == [r.chunk_id for r in bm25.search(q, bm25.index(c)).collect()]
    with pytest.raises(FileNotFoundError):
        bm25.load(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        dense.load(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("block", [1 << 25, 64])
def test_dense_blocks_and_ties(spark, monkeypatch, block):
    monkeypatch.setattr(dense, "BLOCK_BYTES", block)
    r = np.random.default_rng(0)
    m = np.round(r.normal(size=(60, 4)), 1)
    m[10] = m[3]
    c = spark.createDataFrame([(f"c{i}", i, [float(x) for x in v]) for i, v in enumerate(m)] + [("n", 99, None)], "chunk_id string, ord bigint, embedding array<double>")
    q = spark.createDataFrame([(i, [float(x) for x in m[i]]) for i in range(5)] + [(9, None)], "query_id bigint, embedding array<double>")
    got = {}
    for x in dense.search(q, c.repartition(3), 7).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.ord))
    for i in range(5):
        s = np.round(m @ m[i], 9)
        assert [o for _, o in sorted(got[i])] == sorted(range(60), key=lambda j: (-s[j], j))[:7]
    assert dense.search(q.limit(0), c).count() == 0


def test_fusion_by_hand(spark):
    d = spark.createDataFrame([(1, "a", 0, 1), (1, "b", 1, 2)], R)
    b = spark.createDataFrame([(1, "a", 0, 1), (1, "c", 2, 2)], R)
    w = fusion.wrrf(fusion.pool(d, b).withColumns({"w_dense": F.lit(0.3), "w_bm25": F.lit(0.7)}))
    got = {r.chunk_id: round(r.wrrf_score, 7) for r in w.collect()}
    assert got == {"a": 0.0163934, "b": 0.0048387, "c": 0.0112903}
    lists = d.withColumn("list_id", F.lit(1)).union(b.withColumn("list_id", F.lit(2)))
    assert {r.chunk_id: round(r.score, 6) for r in fusion.rrf(lists).collect()}["a"] == round(2 / 61, 6)


def test_filter_comes_after_the_cut(spark):
    d = spark.createDataFrame([(1, "a", 0, 1), (1, "b", 1, 2)], R)
    c = spark.createDataFrame([("a", 0, "x", "", "text", "Acme", 2020, 1, "D"), ("b", 1, "y", None, "table", "Borg", None, 1, "D"), ("z", 2, "x", "", "table", "Borg", 2020, 1, "D")], CHUNK)
    q = fusion.classified(spark.createDataFrame([(1, "How much revenue?")], "query_id bigint, question string"))
    e = spark.createDataFrame([], R)
    assert [r.chunk_id for r in fusion.hybrid(q, d, e, c, where={"company": "BORG"}).collect()] == ["b"]
    assert [r.chunk_id for r in fusion.hybrid(q, d, e, c, where={"year": 2020}).collect()] == ["a"]


def test_company_balance(spark):
    chunks = spark.createDataFrame([(f"c{i}", i, "t", "", "text", "Acme" if i < 30 else "Borg", 2020, 1, "D") for i in range(40)], CHUNK)
    rank = spark.createDataFrame([(1, f"c{i}", i, i + 1) for i in range(40)], R).join(chunks.select("chunk_id", "company"), "chunk_id")
    q = spark.createDataFrame([(1, "Acme or Borg?"), (2, "nobody")], "query_id bigint, question string")
    named = fusion.mentioned_companies(q, chunks)
    assert [(r.query_id, r.company, r.company_no, r.n_companies) for r in named.orderBy("company").collect()] == [(1, "Acme", 1, 2), (1, "Borg", 2, 2)]
    got = [(r.chunk_id, r.rank) for r in fusion.balanced(rank, named, 5, 3, 5).orderBy("rank").collect()]
    assert got == [(f"c{i}", i + 1) for i in range(5)] + [("c30", 6), ("c31", 7), ("c32", 8)]


def test_metrics_by_hand(spark):
    r = spark.createDataFrame([(1, "x", 0, 1), (1, "a", 1, 2), (1, "b", 2, 3), (2, "x", 0, 1)], R)
    g = spark.createDataFrame([(1, "a"), (1, "b")], "query_id bigint, chunk_id string")
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id bigint")
    m = {x.query_id: x for x in metrics.retrieval_metrics(q, r, g).collect()}
    assert (m[1].recall_1, m[1].recall_3, round(m[1].precision_3, 4), round(m[1].ndcg_3, 5), m[1].mrr) == (0.0, 1.0, 0.6667, 0.69343, 0.5)
    assert m[2].mrr == 0.0 and m[3].recall_10 == 0.0


def test_citations(spark):
    t = spark.createDataFrame([("see page 12 of 3",), ("p. 7",), ("12 or 13",), ("none",), (None,)], "t string")
    assert [r.p for r in t.select(metrics.cited_page(F.col("t")).alias("p")).collect()] == [12, 7, 12, None, None]


def test_responses(spark):
    raw = ['```json\n{"answer": "A", "citations": [{"company": "C", "page": "7"}, {"company": "C", "page": 7}]}\n```', "plain", '{"abstained": true}', None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, raw string").select("i", A.parse_response(F.col("raw")).alias("r")).select("i", "r.*").orderBy("i").collect()
    assert (df[0].answer, df[0].confidence, len(df[0].citations)) == ("A", "low", 2)
    assert (df[1].answer, df[1].abstained) == ("plain", False)
    assert (df[2].answer, df[2].abstained) == ("", True)


def test_failing_model_abstains(spark):
    def broken(q, e):
        raise RuntimeError("no network")

    q = spark.createDataFrame([(1, "q"), (2, "q")], "query_id bigint, question string")
    b = spark.createDataFrame([(1, "x")], "query_id bigint, block string")
    assert [r.abstained for r in A.generate(q, b, broken).orderBy("query_id").collect()] == [True, True]


def test_components(spark):
    links = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("x", "y"), ("y", "x"), ("z", "z")], "a string, b string")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert {got[f"n{i:03d}"] for i in range(41)} == {"n000"} and got["y"] == got["x"] == "x" and "z" not in got
    assert connected_components(links.limit(0)).count() == 0


def test_judge_and_history(spark, tmp_path):
    def model(system, text):
        if text == "fail":
            raise RuntimeError
        return {"a": '{"score": 1.5, "reason": "ok"}', "b": '{"score": "x"}'}.get(text, "no json")

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "fail"), (5, None)], "query_id bigint, text string")
    assert [(r.score, r.reason) for r in A.judge(df, model).orderBy("query_id").collect()] == [(1.0, "ok"), (0.0, ""), (0.0, ""), (0.0, ""), (0.0, "")]
    h = spark.createDataFrame([(1, "x", False)], "query_id bigint, answer string, abstained boolean")
    A.append_history(h, str(tmp_path / "h"))
    A.append_history(h, str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 2
