"""Sources, elements, chunking, streaming."""

import random

import pytest
from pyspark.sql import functions as F

from tallyvane.operators import chunking as C
from tallyvane.sources import config, elements
from tallyvane.streaming import incremental

EL = "element_id bigint, element_type string, content string, grid array<array<string>>, page int, company string, document string, year int, section string, caption string, description string"


def test_pack():
    s = " ".join(f"Sentence number {i} here." for i in range(100))
    out = C.pack(s, 50, 10)
    assert len(out) > 1 and all(len(x.split()) <= 60 for x in out)
    assert out[1].split()[:10] == out[0].split()[-10:]
    assert C.pack("", 5, 1) == [] and C.pack("a\n\n\n b ", 5, 1) == ["a b"]
    assert len(C.pack("word " * 80, 20, 5)) == 1  # one sentence is never split
    assert C.pack("A b. C d.", 2, 0) == ["A b.", "A b. C d."]  # no overlap keeps the whole chunk


def test_chunks(spark):
    grid = [["M", "Q"]] + [[f"r{i}", "1"] for i in range(45)]
    rows = [
        (1, "text", "Hello there. " * 5, None, 3, "Co", "Doc", 2020, "Sec", None, None), (2, "table", None, grid, None, None, "Doc", None, None, None, None), (3, "chart", None, None, 1, "Co", "Doc", 2020, "", "Cap", "Desc"), (4, "chart", None, None, 1, "Co", "Doc", 2020, "", None, " "),
        (5, "table", None, [["only", "header"]], 1, "Co", "Doc", 2020, "", "", ""), (6, "other", "x", None, 1, "Co", "Doc", 2020, "", "", ""), (7, "text", None, None, 1, "Co", "Doc", 2020, "", "", ""), (8, "table", None, [], 1, "Co", "Doc", 2020, "", "", ""),
    ]
    c = C.chunk(spark.createDataFrame(rows, EL), table_most=60).collect()
    by = {}
    for r in c:
        by.setdefault(r.element_id, []).append(r)
    assert by[1][0].content.startswith("[Co | Doc | Page 3 | Sec]\nHello")
    parts = sorted(by[2], key=lambda r: r.part)
    assert [len(p.raw_table) for p in parts] == [21, 21, 6] and "(rows 41–45)" in parts[2].content and "Caption:  (rows 1–20)" in parts[0].content
    assert by[3][0].content == "[CHART | Co | Doc | Page 1]\nDesc\nAdditional context: Cap"
    assert 4 not in by and 6 not in by and 7 not in by and 8 not in by and 5 in by
    assert len({r.chunk_id for r in c}) == len(c)


def test_overlap_against_brute_force(spark):
    r = random.Random(5)
    box = lambda: (lambda x, y: (x, y, x + r.uniform(1, 300), y + r.uniform(1, 300)))(r.uniform(0, 500), r.uniform(0, 700))
    b = [(i, "D", r.randint(1, 3), *box()) for i in range(80)] + [(99, "D", 1, None, None, None, None)]
    t = [("D", r.randint(1, 3), *box()) for _ in range(6)]
    s = "x0 double, y0 double, x1 double, y1 double"
    got = {x.block_id for x in C.outside_tables(spark.createDataFrame(b, f"block_id bigint, document string, page int, {s}"), spark.createDataFrame(t, f"document string, page int, {s}")).collect()}
    want = {i for i, d, p, *x in b if x[0] is None or not any(p == q and x[0] < y[2] and x[2] > y[0] and x[1] < y[3] and x[3] > y[1] for _, q, *y in t)}
    assert got == want


def test_sections_carry(spark):
    df = spark.createDataFrame([("D", 1, 1, 0, "text"), ("D", 1, 1, 1, "RISK REVIEW"), ("D", 2, 0, 2, "table"), ("D", 2, 1, 3, "more"), ("E", 1, 1, 0, "other")], "document string, page int, kind_order int, seq int, line string")
    got = {(r.document, r.seq): r.section for r in C.carry_sections(df).collect()}
    assert got == {("D", 0): None, ("D", 1): "RISK REVIEW", ("D", 2): "RISK REVIEW", ("D", 3): "RISK REVIEW", ("E", 0): None}


def test_config_and_documents(spark, tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("retrieval: {dense_top_k: 7}\nbm25: {k1: 1.2}\ndocuments:\n  - {company: Acme, year: 2023, type: 10-K, filename: a.txt}\n  - {company: Borg, year: 2022, type: 10-K, filename: b.txt}\n")
    c = config.load_config(str(f))
    assert (c.dense_top_k, c.bm25_k1, c.bm25_top_k) == (7, 1.2, 20)
    m = config.manifest(spark, c)
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.txt").write_text("A paragraph of text.\n\nM\tQ\nRevenue\t1\fSecond page text.")
    e = elements.read_documents(spark, str(tmp_path / "docs"), m).collect()
    assert [(x.element_type, x.page, x.company, x.document) for x in e] == [("table", 1, "Acme", "Acme 10-K 2023"), ("text", 1, "Acme", "Acme 10-K 2023"), ("text", 2, "Acme", "Acme 10-K 2023")]
    files = spark.createDataFrame([("a.txt",)], "filename string")
    assert [x.filename for x in elements.missing_files(m, files).collect()] == ["b.txt"]
    y = {x.document: x.verdict for x in C.document_yield(m, spark.createDataFrame(e, elements.ELEMENT)).collect()}
    assert y == {"Acme 10-K 2023": "warning", "Borg 10-K 2022": "error"}


def test_json_round_trip(spark, tmp_path):
    c = spark.createDataFrame([("a", "table", "x", "C", "D", 2020, 1, "", None, [["a", None]])], elements.CHUNK).withColumn("extra", F.lit(1))
    elements.write_chunks_json(c, str(tmp_path / "j"))
    r = elements.read_chunks_json(spark, str(tmp_path / "j")).first()
    assert r.raw_table == [["a", None]] and r.caption is None


def test_streaming_ingest(spark, tmp_path):
    s = "chunk_id string, ord bigint, content string"
    src, dst = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", 0, "tax rate"), ("a", 0, "tax rate")], s).write.parquet(src)
    incremental.ingest(spark, src, dst, s, str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([("b", 1, "tax")], s).write.mode("append").parquet(src)
    incremental.ingest(spark, src, dst, s, str(tmp_path / "cp")).awaitTermination()
    ix = incremental.current_index(spark, dst)
    assert {(r.term, r.chunk_id, r.tf) for r in ix["postings"].collect()} == {("tax", "a", 1), ("rate", "a", 1), ("tax", "b", 1)}
    assert spark.read.parquet(f"{dst}/postings").count() == 3
    # a chunk that comes again in a later batch: the later one counts
    spark.createDataFrame([("a", 0, "cash")], s).write.mode("append").parquet(src)
    incremental.ingest(spark, src, dst, s, str(tmp_path / "cp")).awaitTermination()
    ix = incremental.current_index(spark, dst)
    assert {(r.term, r.chunk_id, r.tf) for r in ix["postings"].collect()} == {("cash", "a", 1), ("tax", "b", 1)} and ix["stats"].first().n == 2


@pytest.mark.parametrize("skip", [True, False])
def test_chart_descriptions(spark, skip):
    from tallyvane.operators.answers import describe_charts

    e = spark.createDataFrame([("chart", "p.png", "cap", None), ("text", None, None, None)], "element_type string, image_path string, caption string, description string")
    r = describe_charts(e, None if skip else (lambda p, c: 1 / 0)).collect()
    assert len(r) == (1 if skip else 2) and (skip or [x.description for x in r if x.element_type == "chart"] == [""])


def test_save_figures(spark, tmp_path):
    rows = [("Co A", "D", 2020, 1, (1.0, 2.0, 3.0, 4.0), bytearray(b"png")), ("Co A", "E", 2020, 1, (1.0, 2.0, 3.0, 4.0), bytearray(b"p2")), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "company string, document string, year int, page int, bbox struct<x0: double, y0: double, x1: double, y1: double>, image binary")
    out = elements.save_figures(df, str(tmp_path / "img")).collect()
    paths = [r.image_path for r in out if r.image_path]
    assert len(set(paths)) == 2 and sorted(open(p, "rb").read() for p in paths) == [b"p2", b"png"] and sum(r.image_path is None for r in out) == 1
