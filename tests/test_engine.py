"""Documents to answers, end to end."""

import pytest

from tallyvane.engine import Engine, ask, ingest
from tallyvane.sources.config import from_mapping

DOCS = {
    "acme.txt": "RISK REVIEW OF ACME\n\nTotal revenue was $5.2 billion in 2023, a strong year for Acme.\n\nMetric\tFY2023\nRevenue\t$5.2B\nNet income\t$1.1B\fThe Acme plant in Ohio employs 400 people.",
    "borg.txt": "Borg reported net income of $300 million in 2023 after a difficult year.\fThe board of Borg approved a dividend.",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("engine")
    (d / "docs").mkdir()
    for n, t in DOCS.items():
        (d / "docs" / n).write_text(t)
    c = from_mapping({"documents": [{"company": "Acme", "year": 2023, "type": "10-K", "filename": "acme.txt"}, {"company": "Borg", "year": 2023, "type": "10-K", "filename": "borg.txt"}, {"company": "Gone", "year": 2023, "type": "10-K", "filename": "gone.txt"}]})
    y = {r.document: r.verdict for r in ingest(spark, c, str(d / "docs"), str(d / "out")).collect()}
    assert y == {"Acme 10-K 2023": "warning", "Borg 10-K 2023": "warning", "Gone 10-K 2023": "error"}
    return str(d / "out")


@pytest.mark.parametrize("mode", ["dense", "bm25", "unweighted", "hybrid", "reranked", "trace"])
def test_modes(spark, folder, mode):
    q = spark.createDataFrame([(1, "What was total revenue of Acme in 2023?"), (2, "Which company earned more, Acme or Borg?"), (3, "")], "query_id bigint, question string")
    rows = Engine(spark, folder).retrieve(q, mode).collect()
    assert {1, 2} <= {r.query_id for r in rows}
    if mode in ("bm25", "hybrid", "reranked"):
        e = Engine(spark, folder)
        first = e.chunks.where(e.chunks.chunk_id == [r.chunk_id for r in rows if r.query_id == 1 and r["rank"] == 1][0]).first()
        assert first.company == "Acme"


def test_unknown_mode(spark, folder):
    with pytest.raises(ValueError):
        Engine(spark, folder).retrieve(spark.createDataFrame([(1, "x")], "query_id bigint, question string"), "other")


def test_ask_and_evaluate(spark, folder):
    r = ask(spark, folder, "What was total revenue of Acme in 2023?")
    assert not r["abstained"] and r["verified"] and r["citations"][0]["company"] == "Acme"
    q = spark.createDataFrame([(1, "total revenue of Acme", "Acme", [1], True), (2, "board of Borg dividend", "borg", [2], True), (3, "weather", None, [], False)], "query_id bigint, question string, company string, evidence_pages array<int>, in_scope boolean")
    e = Engine(spark, folder).evaluate(q)
    assert e["ablation"]["bm25"]["mrr"] > 0.5 and set(e["ablation"]) == {"dense", "bm25", "unweighted", "hybrid", "reranked"}
