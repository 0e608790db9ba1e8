"""PDF files through parser, layout and chunks; missing files; SQL functions; models and judges."""

import json
import logging
import zlib

import pytest

from tallyvane.operators import answers, chunking, fusion, metrics, models, verify
from tallyvane.sources import elements as src
from tallyvane.sources.pdf import document_parser, pdf_parser

PAGE = rb"""BT /F1 12 Tf 72 720 Td (RISK REVIEW OF ACME) Tj 0 -40 Td (Total revenue was \(net\) $5.2 billion in 2023,) Tj 0 -14 Td [(a st) 20 (rong) -300 (year.)] TJ ET
BT /F1 10 Tf 72 622 Td (Key figures) Tj ET
BT /F1 10 Tf 1 0 0 1 72 600 Tm (Metric) Tj 1 0 0 1 250 600 Tm (FY2023) Tj 1 0 0 1 72 586 Tm (Revenue) Tj 1 0 0 1 250 586 Tm ($5.2B) Tj ET
q 300 0 0 200 72 300 cm /Im1 Do Q q 10 0 0 10 500 700 cm /Im1 Do Q
BT /F1 9 Tf 80 280 Td (Sales by year) Tj ET"""


def pdf(*pages: bytes, flate: bool = True) -> bytes:
    n = len(pages)
    objs = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d /MediaBox [0 0 612 792] >>" % (b" ".join(b"%d 0 R" % (5 + 2 * i) for i in range(n)), n), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", b"<< /Type /XObject /Subtype /Image /Width 1 /Height 1 >>\nstream\nxx\nendstream"]
    for i, p in enumerate(pages):
        d = zlib.compress(p) if flate else p
        objs.append(b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> /XObject << /Im1 4 0 R >> >> /Contents %d 0 R >>" % (6 + 2 * i))
        objs.append(b"<< /Length %d %s >>\nstream\n" % (len(d), b"/Filter /FlateDecode" if flate else b"") + d + b"\nendstream")
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, x) for i, x in enumerate(objs)) + b"%%EOF"


@pytest.mark.parametrize("flate", [True, False])
def test_pdf_elements(flate):
    e = list(pdf_parser(pdf(PAGE, b"BT /F1 10 Tf 72 700 Td (Second page text.) Tj ET", flate=flate)))
    assert [x["grid"] for x in e if x["element_type"] == "table"] == [[["Metric", "FY2023"], ["Revenue", "$5.2B"]]]
    assert [(x["page"], x["content"]) for x in e if x["element_type"] == "text"] == [(1, "RISK REVIEW OF ACME"), (1, "Total revenue was (net) $5.2 billion in 2023,\na strong year."), (1, "Key figures"), (1, "Sales by year"), (2, "Second page text.")]
    boxes = [x["bbox"] for x in e if x["element_type"] == "chart"]
    assert boxes[0] == {"x0": 72.0, "y0": 292.0, "x1": 372.0, "y1": 492.0} and len(boxes) == 2
    assert list(pdf_parser(b"junk")) == [] and list(pdf_parser(b"%PDF-1.4 broken")) == [] and list(document_parser("plain text of a page".encode()))[0]["element_type"] == "text"


def test_unicode_fonts():
    cmap = b"1 beginbfrange <0041> <0043> <0391> endbfrange 1 beginbfchar <0001> <00e9> endbfchar"
    body = pdf(b"BT /F1 10 Tf 72 700 Td <00410001> Tj ET").replace(b"/Subtype /Type1 /BaseFont /Helvetica", b"/Subtype /Type0 /ToUnicode 99 0 R")
    body = body.replace(b"%%EOF", b"99 0 obj\n<< >>\nstream\n" + cmap + b"\nendstream\nendobj\n%%EOF")
    assert [x["content"] for x in pdf_parser(body) if x["element_type"] == "text"] == ["Αé"]


def test_layout_of_a_pdf(spark, tmp_path, caplog):
    from tallyvane.engine import ingest
    from tallyvane.sources.config import from_mapping

    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.pdf").write_bytes(pdf(PAGE, b"BT /F1 10 Tf 72 700 Td (The second page says more of it.) Tj ET"))
    c = from_mapping({"documents": [{"company": "Acme", "year": 2023, "type": "10-K", "filename": "a.pdf"}, {"company": "Gone", "year": 2023, "type": "10-K", "filename": "gone.pdf"}]})
    e = chunking.layout(src.read_documents(spark, str(tmp_path / "docs"), __import__("tallyvane.sources.config", fromlist=["manifest"]).manifest(spark, c), document_parser)).collect()
    kinds = sorted((x.element_type, x.caption or "", x.section or "") for x in e)
    # the small image is gone, the table has the words above it, the figure those below; sections carry over pages
    assert ("table", "Key figures", "") in kinds and ("chart", "Sales by year", "RISK REVIEW OF ACME") in kinds and len([k for k in kinds if k[0] == "chart"]) == 1
    assert [x.section for x in e if x.page == 2] == ["RISK REVIEW OF ACME"] and not any(x.element_type == "word" for x in e)
    with caplog.at_level(logging.WARNING):
        y = {r.document: r.verdict for r in ingest(spark, c, str(tmp_path / "docs"), str(tmp_path / "out"), describer=lambda p, k, company, section: f"{company}: {k} ({section})").collect()}
    assert "gone.pdf" in caplog.text and y["Gone 10-K 2023"] == "error"
    chunks = spark.read.parquet(str(tmp_path / "out" / "chunks"))
    assert "Acme: Sales by year (RISK REVIEW OF ACME)" in chunks.where("chunk_type = 'chart'").first().content


def test_clients_in_order():
    built = []
    make = lambda name, ok: (name, lambda key: built.append((name, key)) or (lambda *a: name) if ok else (_ for _ in ()).throw(ImportError()))
    two = [make("A", True), make("B", True)]
    assert models.first_available(two, {"B": "k"})() == "B" and models.first_available(two, {"A": "k", "B": "k"})() == "A"
    assert models.first_available(two, {"A": " "}) is None and models.first_available([make("A", False), make("B", True)], {"A": "k", "B": "k"})() == "B"


def test_chart_prompt_and_image(tmp_path):
    (tmp_path / "i.png").write_bytes(b"png")
    seen = []
    d = models.vision_describer(lambda *a: seen.append(a) or "text")
    assert d(str(tmp_path / "i.png"), "cap", company="Acme", section="Sales") == "text" and seen[0][1] == "Section: Sales\nCaption/nearby text: cap" and seen[0][2] == "cG5n" and "Acme" in seen[0][0]
    assert d(str(tmp_path / "none.png"), "cap") == "" and models.chart_context("", None) == "" and "Unknown" in models.chart_prompt(None)
    assert models.vision_describer(lambda *a: 1 / 0)(str(tmp_path / "i.png"), "") == ""


def test_judges(spark):
    rows = spark.createDataFrame([(1, "q", "red green", ["red blue"], "green"), (2, "q", "", None, None), (3, None, "x", [], "y")], "query_id bigint, question string, answer string, evidence array<string>, gold_answer string")
    got = {r.query_id: r for r in models.judge_answers(rows).collect()}
    assert (got[1].faithfulness, got[1].answer_correctness, got[1].calls) == (0.5, 1.0, 2) and (got[2].faithfulness, got[2].answer_correctness, got[2].calls) == (0.0, None, 1)
    odd = {r.query_id: r.faithfulness for r in models.judge_answers(rows, lambda s, u: {"q": "7"}.get("q") if "red" in u else json.dumps({"score": 3})).collect()}
    assert odd == {1: 0.0, 2: 1.0, 3: 1.0}
    assert all(r.faithfulness == 0.0 for r in models.judge_answers(rows, lambda s, u: 1 / 0).collect())
    assert {r.kind: r.calls for r in models.usage(spark.createDataFrame([(1,), (0,)], "calls bigint"), models.judge_answers(rows)).collect()} == {"generate": 1, "judge": 5}


def test_messages(spark):
    a = spark.createDataFrame([(1, 0, "$97.3B", 97.3e9, False, ["revenue"]), (1, 1, "21.5%", 21.5, True, []), (2, 0, "5,000", 5000.0, False, ["cash", "debt"])], "answer_id bigint, num_ord int, raw string, value double, is_percent boolean, keywords array<string>")
    e = spark.createDataFrame([(1, 0, 96.8e9, ["revenue"]), (1, 1, 18.2, ["margin"]), (2, 0, 5010.0, ["sales"])], "answer_id bigint, ev_ord bigint, value double, keywords array<string>")
    m = {(r.answer_id, r.num_ord): r for r in verify.mismatches(a, e, verify.verify(a, e)).collect()}
    assert m[1, 1].message == "Answer states 21.5% (≈21.5) but closest evidence value is 18.2 (15.3% difference)." and m[1, 1].relative_diff_pct == 15.35
    assert m[2, 0].message == "5,000 matches evidence value 5010 numerically but metric context differs (answer: ['cash', 'debt'], evidence: ['sales']). Possible metric substitution."
    assert (1, 0) not in m and {r.status for r in verify.verify(a.where("answer_id = 2"), e, require_context=False).collect()} == {"matched"}


def test_display_and_citations(spark):
    r = answers.generate(spark.createDataFrame([(1, "q"), (2, "q")], "query_id bigint, question string"), spark.createDataFrame([(1, "[Evidence 1] Company: A | Document: D | Page: 3 | Section: S | Type: text | Score: 1\nBody\n")], "query_id bigint, block string"))
    assert {x.query_id: x.calls for x in r.collect()} == {1: 1, 2: 0}
    shown = {x.query_id: x.shown for x in answers.display(r, spark.createDataFrame([(1, 0, "off")], "query_id bigint, num_ord int, message string")).collect()}
    assert shown[1] == "Body\n\n**Sources:**\n  • A — D | Page 3 | S\n\n⚠️ **Numerical Verification Warnings:**\n  • off\n\n*Confidence: medium*"
    c = spark.createDataFrame([('{"page": 4}',), ('{"page_number": "p. 5"}',), ("6",), ("Page 7 of 9",), ("{}",), (None,), ("none",)], "c string")
    assert [x.p for x in c.select(metrics.citation_page(c.c).alias("p")).collect()] == [4, 5, 6, 7, None, None, None]


def test_names_by_join(spark):
    names = spark.createDataFrame([("Acme",), ("acme corp",), ("X",), ("Borg",), (None,), ("Borg",), ("",)], "company string")
    q = spark.createDataFrame([(1, "Did Acme Corp beat BORG?"), (2, "nothing"), (3, None), (4, "Acme" + " " * 100 + "Borg"), (5, "Borg and Borg")], "query_id bigint, question string")
    got = {}
    for r in fusion.mentioned_companies(q, names).collect():
        got.setdefault(r.query_id, []).append((r.company_no, r.company, r.n_companies))
    assert sorted(got[1]) == [(1, "Acme", 3), (2, "Borg", 3), (3, "acme corp", 3)] and set(got) == {1, 4, 5} and got[5] == [(1, "Borg", 1)]
    kinds = {r.query_id: r.query_class for r in fusion.classified_by_names(q, names).collect()}
    assert kinds == {1: "cross_company", 2: "factual", 3: "factual", 4: "factual", 5: "factual"}


def test_sql_functions(spark):
    from tallyvane.functions import registered

    assert "tv_sigmoid" in registered.register(spark)
    r = spark.sql("SELECT tv_sigmoid(0) a, tv_clamp_score('1.5') b, tv_clamp_score('x') c, tv_percent_difference(97.3, 96.8) d, tv_word_count(' a  b ') e, tv_word_count(NULL) f, tv_inner_product(array(1f, 2f), array(3f, 4f)) g").first()
    assert tuple(r) == (0.5, 1.0, 0.0, 0.51, 2, 0, 11.0)
