"""Ingestion, chunking, verification and answer queries, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvane.functions import fixed as X
from tallyvane.functions import numbers as N
from tallyvane.functions import text as T
from tallyvane.operators import answers, chunking, metrics, models, verify
from tallyvane.plans import retrieval as R
from tallyvane.plans import sql as S
from tallyvane.session import table

SQL: dict[str, str] = {}


def _elements(spark, d) -> DataFrame:
    """Each element once; copies of an element have equal contents."""
    return table(spark, d, "raw_elements").dropDuplicates(["element_id"])


EL = "el AS (SELECT * FROM raw_elements QUALIFY row_number() OVER (PARTITION BY element_id ORDER BY ingested_at) = 1)"


def manifest_label(spark, d):
    """Manifest rows with the label company, type and year."""
    return table(spark, d, "manifest").select("filename", F.concat_ws(" ", "company", "type", F.col("year").cast("string")).alias("label"))


SQL["manifest_label"] = "SELECT filename, concat_ws(' ', company, type, CAST(year AS VARCHAR)) AS label FROM manifest"


def route_elements(spark, d):
    """Elements by type, text before tables before figures; other types are dropped."""
    e = _elements(spark, d)
    return e.where(F.col("element_type").isin("text", "table", "chart")).select("element_id", "element_type", F.when(F.col("element_type") == "text", 0).when(F.col("element_type") == "table", 1).otherwise(2).alias("kind_order"))


SQL["route_elements"] = f"WITH {EL} SELECT element_id, element_type, CASE element_type WHEN 'text' THEN 0 WHEN 'table' THEN 1 ELSE 2 END AS kind_order FROM el WHERE element_type IN ('text', 'table', 'chart')"


def clean_tables(spark, d):
    """Cleaned grids of at least two rows."""
    return chunking.clean_grid(_elements(spark, d).where("element_type = 'table'")).select("element_id", F.size("grid").alias("n_rows"), F.array_join(F.transform("grid", lambda r: F.array_join(r, "|")), "/").alias("cells"))


SQL["clean_tables"] = f"WITH {EL} SELECT element_id, len(grid) AS n_rows, array_to_string([array_to_string([coalesce(trim(c), '') for c in coalesce(r, [])], '|') for r in grid], '/') AS cells FROM el WHERE element_type = 'table' AND len(grid) >= 2"


def _lines(spark, d) -> DataFrame:
    e = _elements(spark, d).where("element_type = 'text' and content is not null")
    return e.select("element_id", "document", "page", F.posexplode(F.split("content", r"\r?\n")).alias("line_no", "line")).withColumn("kind_order", F.lit(1))


LN = EL + r", ln AS (SELECT element_id, document, page, unnest(regexp_split_to_array(content, '\r?\n')) AS line, generate_subscripts(regexp_split_to_array(content, '\r?\n'), 1) - 1 AS line_no FROM el WHERE element_type = 'text' AND content IS NOT NULL)"
_HEAD = f"(trim(line) <> '' AND length(trim(line)) <= {X.HEADING_MAX} AND (regexp_matches(trim(line), '(?i){X.HEADING}') OR (upper(trim(line)) = trim(line) AND lower(trim(line)) <> trim(line) AND length(trim(line)) > 5 AND length(trim(line)) < 120)))"


def heading_flags(spark, d):
    """Heading flag of every line."""
    return _lines(spark, d).select("element_id", "line_no", T.is_heading(F.col("line")).alias("heading"))


SQL["heading_flags"] = f"WITH {LN} SELECT element_id, line_no, {_HEAD} AS heading FROM ln"


def section_carry(spark, d):
    """The section in force at every line, table and figure; a page's tables come before its text, figures after."""
    e = _elements(spark, d).where("element_type in ('table', 'chart')").select("element_id", "document", "page", F.lit(-1).alias("line_no"), F.lit(None).cast("string").alias("line"), F.when(F.col("element_type") == "table", 0).otherwise(2).alias("kind_order"))
    return chunking.carry_sections(_lines(spark, d).unionByName(e), order=("page", "kind_order", "element_id", "line_no")).select("element_id", "line_no", "section")


SQL["section_carry"] = f"WITH {LN}, x AS (SELECT element_id, document, page, line, line_no, 1 AS ko FROM ln UNION ALL SELECT element_id, document, page, NULL, -1, CASE element_type WHEN 'table' THEN 0 ELSE 2 END FROM el WHERE element_type IN ('table', 'chart')) SELECT element_id, line_no, last_value(CASE WHEN {_HEAD} THEN substr(trim(line), 1, {X.SECTION_MAX}) END IGNORE NULLS) OVER (PARTITION BY document ORDER BY page, ko, element_id, line_no ROWS UNBOUNDED PRECEDING) AS section FROM x"


def _boxes(spark, d, kind: str) -> DataFrame:
    return _elements(spark, d).where(F.col("element_type") == kind).select(F.col("element_id").alias("block_id"), "document", "page", "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1")


def text_not_in_tables(spark, d):
    """Text blocks that overlap no table of their page."""
    return chunking.outside_tables(_boxes(spark, d, "text"), _boxes(spark, d, "table")).select("block_id")


SQL["text_not_in_tables"] = f"WITH {EL} SELECT element_id AS block_id FROM el b WHERE element_type = 'text' AND NOT EXISTS (SELECT 1 FROM el t WHERE t.element_type = 'table' AND t.document = b.document AND t.page = b.page AND b.bbox.x0 < t.bbox.x1 AND b.bbox.x1 > t.bbox.x0 AND b.bbox.y0 < t.bbox.y1 AND b.bbox.y1 > t.bbox.y0)"


def chart_regions(spark, d):
    """Figures that cover at least 2 % of a page of 612 by 792."""
    r = _boxes(spark, d, "chart").where("x0 is not null").withColumn("page_area", F.lit(612.0 * 792.0))
    return chunking.large_regions(r).select("block_id")


SQL["chart_regions"] = f"WITH {EL} SELECT element_id AS block_id FROM el WHERE element_type = 'chart' AND (bbox.x1 - bbox.x0) * (bbox.y1 - bbox.y0) / (612e0 * 792e0) >= {X.MIN_AREA}e0"


def caption_lookup(spark, d):
    """Captions of tables and figures from the words in the strip above or below them: the words of their own captions,
    set there one after the other, and every other word of the page's text blocks along the block's first line."""
    e = _elements(spark, d).where("bbox is not null")
    boxes = e.where("element_type in ('table', 'chart')").select("element_id", "element_type", "caption", "document", "page", "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1")
    own = boxes.select("document", "page", "x0", F.when(F.col("element_type") == "table", F.col("y0") - 12).otherwise(F.col("y1") + 8).alias("y0"), F.posexplode(F.split("caption", " ")).alias("i", "word"))
    text = e.where("element_type = 'text' and content is not null").select("document", "page", "bbox.x0", "bbox.y0", F.posexplode(F.split(F.substring_index("content", "\n", 1), " ")).alias("i", "word"))
    words = own.select("document", "page", (F.col("x0") + F.col("i")).alias("x0"), "y0", "word").unionByName(text.select("document", "page", (F.col("x0") + 5 * F.col("i")).alias("x0"), "y0", "word"))
    return chunking.captions(boxes.drop("caption"), words)


SQL["caption_lookup"] = f"""WITH {EL}, b AS (SELECT element_id, element_type, caption, document, page, bbox.x0 AS x0, bbox.x1 AS x1, bbox.y0 AS y0, bbox.y1 AS y1, CASE element_type WHEN 'table' THEN bbox.y0 - 30 ELSE bbox.y1 END AS lo, CASE element_type WHEN 'table' THEN bbox.y0 ELSE bbox.y1 + 40 END AS hi FROM el WHERE element_type IN ('table', 'chart') AND bbox IS NOT NULL),
o AS (SELECT document, page, x0, CASE element_type WHEN 'table' THEN y0 - 12 ELSE y1 + 8 END AS y0, unnest(string_split(caption, ' ')) AS word, generate_subscripts(string_split(caption, ' '), 1) - 1 AS i FROM b WHERE caption IS NOT NULL),
t AS (SELECT document, page, bbox.x0 AS x0, bbox.y0 AS y0, unnest(string_split(split_part(content, chr(10), 1), ' ')) AS word, generate_subscripts(string_split(split_part(content, chr(10), 1), ' '), 1) - 1 AS i FROM el WHERE element_type = 'text' AND bbox IS NOT NULL AND content IS NOT NULL),
w AS (SELECT document, page, x0 + i AS wx, y0 AS wy, word FROM o UNION ALL SELECT document, page, x0 + 5 * i, y0, word FROM t)
SELECT element_id, string_agg(word, ' ' ORDER BY wy, wx, word) AS caption FROM b JOIN w USING (document, page) WHERE wy >= lo AND wy < hi AND wx >= b.x0 AND wx < b.x1 GROUP BY element_id HAVING length(string_agg(word, ' ')) BETWEEN 1 AND 199"""


def doc_yield(spark, d):
    """Elements of every manifest document and the verdict on their number."""
    return chunking.document_yield(table(spark, d, "manifest"), _elements(spark, d))


SQL["doc_yield"] = f"WITH {EL} SELECT m.document, count(e.element_id) AS n, CASE WHEN count(e.element_id) = 0 THEN 'error' WHEN count(e.element_id) < 10 THEN 'warning' ELSE 'ok' END AS verdict FROM (SELECT DISTINCT document FROM manifest) m LEFT JOIN el e USING (document) GROUP BY m.document"


def type_distribution(spark, d):
    """Chunks by type, company and page range."""
    return table(spark, d, "chunks").groupBy("chunk_type", "company").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("document").alias("documents"), F.max("page").alias("last_page"))


SQL["type_distribution"] = "SELECT chunk_type, company, count(*) AS n, count(DISTINCT document) AS documents, max(page) AS last_page FROM chunks GROUP BY ALL"


def text_chunks(spark, d):
    """Packed pieces of every document, at most 100 words with 16 words of overlap."""
    return chunking.pack_texts(table(spark, d, "documents"), "doc_id", "text", 100, 16).select("doc_id", "piece_no", F.md5("piece").alias("piece"), F.length("piece").alias("n"))


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{X.WS}+|{X.WS}+$', '', 'g')"


def _words(x: str) -> str:
    return f"CASE WHEN {_strip(x)} = '' THEN {_EMPTY} ELSE regexp_split_to_array({_strip(x)}, '{X.WS}+') END"


_EMPTY = "CAST([] AS VARCHAR[])"


def _pack_sql(source: str, most: int, overlap: int) -> str:
    """CTEs ending in e(k, i, piece): the packed pieces of `source`, which gives k and t."""
    return f"""p AS (SELECT k, unnest(regexp_split_to_array(t, '\n{{2,}}')) AS p, generate_subscripts(regexp_split_to_array(t, '\n{{2,}}'), 1) AS pi FROM ({source}) WHERE t IS NOT NULL),
q AS (SELECT k, pi, {_strip('p')} AS p FROM p WHERE {_strip('p')} <> ''),
v AS (SELECT k, pi, CASE WHEN len({_words('p')}) <= {most} THEN [p] ELSE regexp_split_to_array(regexp_replace(p, '([.!?]){X.WS}+', '\\1' || chr(1), 'g'), chr(1)) END AS us FROM q),
w AS (SELECT k, pi, unnest(us) AS unit, generate_subscripts(us, 1) AS si FROM v),
u AS (SELECT k, unit, len({_words('unit')}) AS n, row_number() OVER (PARTITION BY k ORDER BY pi, si) AS i FROM w),
r AS (SELECT DISTINCT k, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS cur, CAST(0 AS BIGINT) AS have, CAST(NULL AS VARCHAR) AS last, CAST(NULL AS VARCHAR) AS emit FROM u
UNION ALL
SELECT k, i, CASE WHEN over AND nl IS NOT NULL THEN array_to_string(tail, ' ') || ' ' || unit WHEN cur IS NULL THEN unit ELSE cur || ' ' || unit END, CASE WHEN over AND nl IS NOT NULL THEN len(tail) ELSE have END + n, nl, emit
FROM (SELECT *, list_slice({_words('nl')}, -{overlap}, -1) AS tail FROM (SELECT r.k, u.i, u.unit, u.n, r.cur, r.have, r.have + u.n > {most} AS over, CASE WHEN r.have + u.n > {most} THEN r.cur END AS emit, CASE WHEN r.have + u.n > {most} AND r.cur IS NOT NULL THEN r.cur ELSE r.last END AS nl FROM r JOIN u ON u.k = r.k AND u.i = r.i + 1))),
e AS (SELECT k, i, emit AS piece FROM r WHERE emit IS NOT NULL UNION ALL SELECT k, i + 1, cur FROM r WHERE cur IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1)"""


SQL["text_chunks"] = f"""WITH RECURSIVE {_pack_sql('SELECT doc_id AS k, text AS t FROM documents', 100, 16)}
SELECT k AS doc_id, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS piece_no, md5(piece) AS piece, length(piece) AS n FROM e WHERE {_strip('piece')} <> ''"""


def table_to_text(spark, d):
    """Every table element as text."""
    e = _elements(spark, d).where("element_type = 'table'")
    return e.select("element_id", T.table_text(F.col("grid"), F.col("caption"), F.col("section")).alias("text"))


def _table_text_sql(grid: str, caption: str, section: str) -> str:
    w = f"list_max([len(coalesce(r, {_EMPTY})) for r in {grid}])"
    cells = lambda r: f"list_resize([coalesce(c, '') for c in coalesce({r}, {_EMPTY})], {w}, '')"
    line = lambda r: f"'| ' || array_to_string({cells(r)}, ' | ') || ' |'"
    return f"""CASE WHEN coalesce(len({grid}), 0) = 0 THEN '' ELSE array_to_string(list_concat(CASE WHEN coalesce({section}, '') <> '' THEN ['Section: ' || {section}] ELSE {_EMPTY} END, CASE WHEN coalesce({caption}, '') <> '' THEN ['Caption: ' || {caption}] ELSE {_EMPTY} END,
[{line(grid + '[1]')}, '| ' || array_to_string(['---' for i in range({w})], ' | ') || ' |'], [{line('q')} for q in {grid}[2:] if len([z for z in coalesce(q, {_EMPTY}) if trim(coalesce(z, '')) <> '']) > 0]), chr(10)) END"""


SQL["table_to_text"] = f"WITH {EL} SELECT element_id, {_table_text_sql('grid', 'caption', 'section')} AS text FROM el WHERE element_type = 'table'"


def table_row_groups(spark, d):
    """Chunks of every table element, large tables (over 60 words) in groups of 5 rows."""
    return chunking.table_chunks(_elements(spark, d), 60, 5).select("element_id", "part", "content", F.size("raw_table").alias("n_rows"))


_THEAD = "'[TABLE | ' || coalesce(company, '') || ' | ' || coalesce(document, '') || ' | Page ' || coalesce(page, 0) || ']'"
SQL["table_row_groups"] = f"""WITH {EL}, t AS (SELECT element_id, {_THEAD} AS head, coalesce(section, '') AS section, coalesce(caption, '') AS caption, grid FROM el WHERE element_type = 'table' AND len(grid) > 0),
w AS (SELECT *, head || chr(10) || {_table_text_sql('grid', 'caption', 'section')} AS whole FROM t), n AS (SELECT *, len(regexp_split_to_array(trim(regexp_replace(whole, '\\s+', ' ', 'g')), ' ')) AS words FROM w),
g AS (SELECT *, unnest(range(CAST(ceil((len(grid) - 1) / 5e0) AS BIGINT))) AS part FROM n WHERE words > 60 AND len(grid) > 1),
s AS (SELECT *, list_concat(grid[1:1], grid[part * 5 + 2 : part * 5 + 6]) AS sub FROM g), l AS (SELECT *, ' (rows ' || (part * 5 + 1) || '{X.EN_DASH}' || (part * 5 + len(sub) - 1) || ')' AS label FROM s)
SELECT element_id, 0 AS part, whole AS content, len(grid) AS n_rows FROM n WHERE words <= 60
UNION ALL SELECT element_id, part, head || label || chr(10) || {_table_text_sql('sub', '(caption || label)', 'section')}, len(sub) FROM l"""


def chart_chunks(spark, d):
    """Chunks of every figure."""
    return chunking.chart_chunks(_elements(spark, d)).select("element_id", "content")


SQL["chart_chunks"] = f"""WITH {EL}, c AS (SELECT *, trim(coalesce(description, '')) AS ds, trim(coalesce(caption, '')) AS cp FROM el WHERE element_type = 'chart')
SELECT element_id, '[CHART | ' || coalesce(company, '') || ' | ' || coalesce(document, '') || ' | Page ' || coalesce(page, 0) || ']' || chr(10) || CASE WHEN ds <> '' AND cp <> '' THEN ds || chr(10) || 'Additional context: ' || cp WHEN ds <> '' THEN ds ELSE '[CHART/FIGURE]' || chr(10) || 'Caption: ' || cp END AS content FROM c WHERE ds <> '' OR cp <> ''"""


def chunk_elements(spark, d):
    """All chunks of all elements with their ids."""
    c = chunking.chunk(_elements(spark, d))
    return c.select("chunk_id", "element_id", "part", "chunk_type", F.length("content").alias("n"))


_SHEAD = "'[' || coalesce(company, '') || ' | ' || coalesce(document, '') || ' | Page ' || coalesce(page, 0) || CASE WHEN coalesce(section, '') <> '' THEN ' | ' || section ELSE '' END || ']'"
SQL["chunk_elements"] = f"""WITH RECURSIVE {EL}, {_pack_sql("SELECT element_id AS k, content AS t FROM el WHERE element_type = 'text'", X.MAX_WORDS, X.OVERLAP_WORDS)},
tx AS (SELECT k AS element_id, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS part, piece FROM e WHERE {_strip('piece')} <> ''),
tc AS (SELECT element_id, part, 'text' AS chunk_type, {_SHEAD} || chr(10) || piece AS content FROM tx JOIN el USING (element_id)),
t AS (SELECT element_id, {_THEAD} AS head, coalesce(section, '') AS section, coalesce(caption, '') AS caption, grid FROM el WHERE element_type = 'table' AND len(grid) > 0),
ww AS (SELECT *, head || chr(10) || {_table_text_sql('grid', 'caption', 'section')} AS whole FROM t), nn AS (SELECT *, len(regexp_split_to_array(trim(regexp_replace(whole, '\\s+', ' ', 'g')), ' ')) AS words FROM ww),
g AS (SELECT *, unnest(range(CAST(ceil((len(grid) - 1) / {X.ROW_GROUP}e0) AS BIGINT))) AS part FROM nn WHERE words > {X.TABLE_MAX_WORDS} AND len(grid) > 1),
s AS (SELECT *, list_concat(grid[1:1], grid[part * {X.ROW_GROUP} + 2 : part * {X.ROW_GROUP} + {X.ROW_GROUP} + 1]) AS sub FROM g), l AS (SELECT *, ' (rows ' || (part * {X.ROW_GROUP} + 1) || '{X.EN_DASH}' || (part * {X.ROW_GROUP} + len(sub) - 1) || ')' AS label FROM s),
tb AS (SELECT element_id, 0 AS part, 'table' AS chunk_type, whole AS content FROM nn WHERE words <= {X.TABLE_MAX_WORDS} UNION ALL SELECT element_id, part, 'table', head || label || chr(10) || {_table_text_sql('sub', '(caption || label)', 'section')} FROM l),
ch AS (SELECT element_id, 0 AS part, 'chart' AS chunk_type, content FROM ({SQL['chart_chunks'].replace('WITH ' + EL + ', c AS', 'WITH c AS')}))
SELECT sha256(coalesce(document, '') || '|' || element_id || '|' || part) AS chunk_id, element_id, CAST(part AS BIGINT) AS part, chunk_type, length(content) AS n FROM (SELECT * FROM tc UNION ALL SELECT * FROM tb UNION ALL SELECT * FROM ch) JOIN (SELECT element_id, document FROM el) USING (element_id) WHERE length(content) >= {X.MIN_CHARS}"""


def describe_charts(spark, d):
    """Figures described by a stand-in model from their caption."""
    e = table(spark, d, "raw_elements").dropDuplicates(["element_id"]).where("element_type = 'chart'").drop("bbox", "ingested_at", "grid")
    return answers.describe_charts(e, lambda path, context: f"Figure {path}: {context}").select("element_id", "description")


SQL["describe_charts"] = f"WITH {EL} SELECT element_id, 'Figure ' || coalesce(image_path, 'None') || ': ' || coalesce(caption, '') AS description FROM el WHERE element_type = 'chart'"


def extract_numbers(spark, d):
    """All numbers of all chunks."""
    return N.extract_numbers(table(spark, d, "chunks"), "chunk_id", "content").drop("context")


_WORDS = ["revenue", "income", "sales", "margin", "cash"]


def _statements(spark, d) -> tuple[DataFrame, DataFrame]:
    """Answers and evidence from orders: a customer's order totals are the evidence; the answer states their
    largest exactly, 1 % off, 3 % off, far off or as a percentage change, by customer."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("answer_id"), F.col("o_orderkey").alias("ev_ord"), F.round("o_totalprice", 2).alias("value"))
    word = lambda x: F.element_at(F.array(*[F.lit(w) for w in _WORDS]), (F.pmod(x, F.lit(5)) + 1).cast("int"))
    ev = o.withColumn("keywords", F.when(F.col("ev_ord") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(word(F.col("ev_ord")))))
    top = o.groupBy("answer_id").agg(F.max("value").alias("hi"), F.min("value").alias("lo"))
    kw = F.when(F.col("answer_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(word(F.col("answer_id")), F.lit("s"))))
    a = top.select("answer_id", kw.alias("keywords"), F.posexplode(F.array(F.col("hi"), F.col("hi") * 1.01, F.col("lo") * 1.03, F.col("hi") * 3.7, (F.col("hi") - F.col("lo")) / F.col("lo") * 100.0, F.lit(0.0))).alias("num_ord", "value"))
    return a.withColumn("is_percent", F.col("num_ord") == 4).select("answer_id", "num_ord", "value", "is_percent", "keywords"), ev


def _kw(x: str) -> str:
    return f"{S.quoted(_WORDS)}[({x} % 5) + 1]"


STATEMENTS = f"""o AS (SELECT o_custkey AS answer_id, o_orderkey AS ev_ord, round(o_totalprice, 2) AS value FROM orders),
ev AS (SELECT *, CASE WHEN ev_ord % 3 = 0 THEN {_EMPTY} ELSE [{_kw('ev_ord')}] END AS keywords FROM o),
tp AS (SELECT answer_id, max(value) AS hi, min(value) AS lo FROM o GROUP BY answer_id),
an AS (SELECT answer_id, CASE WHEN answer_id % 4 = 0 THEN {_EMPTY} ELSE [{_kw('answer_id')} || 's'] END AS keywords, unnest([hi, hi * 1.01e0, lo * 1.03e0, hi * 3.7e0, (hi - lo) / lo * 100e0, 0e0]) AS value, unnest([0, 1, 2, 3, 4, 5]) AS num_ord FROM tp),
ck AS (SELECT *, num_ord = 4 AS is_percent FROM an WHERE num_ord = 4 OR abs(value) >= 1),
pr AS (SELECT c.answer_id, c.num_ord, c.value, c.is_percent, c.keywords, e.ev_ord, e.value AS ev_value, e.keywords AS ev_keywords, abs(e.value - c.value) / greatest(abs(c.value), 1e-9) AS d FROM ck c JOIN ev e USING (answer_id) WHERE c.value <> 0)"""
_STEM = lambda k: f"[CASE WHEN length(x) > 3 THEN regexp_replace(x, 's+$', '') ELSE x END for x in {k}]"
VERIFIED = f"""{STATEMENTS},
cl AS (SELECT answer_id, num_ord, bool_or(len(keywords) = 0 OR len(ev_keywords) = 0 OR list_has_any({_STEM('keywords')}, {_STEM('ev_keywords')})) AS agrees, min(struct_pack(d := d, o := ev_ord, v := ev_value)) AS c FROM pr WHERE d <= {X.TOLERANCE} AND ev_value <> 0 GROUP BY ALL),
ne AS (SELECT answer_id, num_ord, min(struct_pack(d := d, o := ev_ord, v := ev_value)) AS n FROM pr GROUP BY ALL),
pl AS (SELECT *, bool_or(abs(value) >= 1000) OVER (PARTITION BY answer_id) AS big FROM ev WHERE abs(value) > 1e-9),
pool AS (SELECT * FROM pl WHERE NOT big OR abs(value) >= 1000),
de AS (SELECT DISTINCT c.answer_id, c.num_ord FROM ck c JOIN pool a USING (answer_id) JOIN pool b USING (answer_id) WHERE is_percent AND c.value <> 0 AND a.ev_ord <> b.ev_ord AND abs(abs(a.value - b.value) / abs(b.value) * 100e0 - abs(c.value)) / greatest(abs(c.value), 1e-9) <= {X.TOLERANCE}),
st AS (SELECT ck.answer_id, ck.num_ord, ck.value, CASE WHEN agrees THEN 'matched' WHEN agrees IS NOT NULL THEN 'mismatch' WHEN de.num_ord IS NOT NULL THEN 'derived' WHEN n.d < {X.UNVERIFIABLE_FROM} THEN 'mismatch' ELSE 'unverifiable' END AS status, coalesce(c.v, n.v) AS cv, coalesce(c.d, n.d) AS cd
FROM ck LEFT JOIN cl USING (answer_id, num_ord) LEFT JOIN ne USING (answer_id, num_ord) LEFT JOIN de USING (answer_id, num_ord))"""


def verify_numbers(spark, d):
    """Status of every checked number."""
    v = verify.verify(*_statements(spark, d))
    return v.select("answer_id", "num_ord", F.round("value", 4).alias("value"), "status", "closest", F.round("relative_diff", 6).alias("relative_diff"))


SQL["verify_numbers"] = f"WITH {VERIFIED} SELECT answer_id, num_ord, round(value, 4) AS value, status, CASE WHEN status = 'mismatch' THEN cv END AS closest, CASE WHEN status = 'mismatch' THEN round(cd, 6) END AS relative_diff FROM st"


def verify_report(spark, d):
    """Report of every answer."""
    a, e = _statements(spark, d)
    return verify.report(a, a, e, verify.verify(a, e))


_STATUSES = ("matched", "derived", "mismatch", "unverifiable")
SQL["verify_report"] = f"""WITH {VERIFIED}, r AS (SELECT answer_id, {', '.join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in _STATUSES)} FROM st GROUP BY answer_id)
SELECT answer_id, {', '.join('n_' + s for s in _STATUSES)}, n_mismatch = 0 AS verified, concat_ws('; ', {', '.join(f"CASE WHEN n_{s} > 0 THEN n_{s} || ' {s}' END" for s in _STATUSES)}) AS summary FROM r"""


def derived_percent(spark, d):
    """Percentages that follow from two evidence numbers."""
    return verify.derivable(*_statements(spark, d))


SQL["derived_percent"] = f"WITH {VERIFIED} SELECT answer_id, num_ord FROM de"


def nearest_value(spark, d):
    """The nearest evidence value of every answer number."""
    n = verify.nearest(*_statements(spark, d))
    return n.select("answer_id", "num_ord", "nearest_value", F.round("relative_diff", 6).alias("relative_diff"))


SQL["nearest_value"] = f"WITH {VERIFIED}, pa AS (SELECT an.answer_id, an.num_ord, e.ev_ord, e.value AS v, abs(e.value - an.value) / greatest(abs(an.value), 1e-9) AS d FROM an JOIN ev e USING (answer_id) WHERE an.value <> 0), m AS (SELECT answer_id, num_ord, min(struct_pack(d := d, o := ev_ord, v := v)) AS n FROM pa GROUP BY ALL) SELECT answer_id, num_ord, n.v AS nearest_value, round(n.d, 6) AS relative_diff FROM m"


def evidence_block(spark, d):
    """The evidence text of every question from its five reranked passages."""
    return answers.evidence_block(R.rerank_lexical(spark, d), table(spark, d, "chunks"))


SQL["evidence_block"] = f"""WITH {R._hybrid_sql(R.CLASSED, True)}, {R.RERANKED}
SELECT query_id, string_agg('[Evidence ' || rank || '] Company: ' || coalesce(company, 'Unknown') || ' | Document: ' || coalesce(document, 'Unknown') || ' | Page: ' || coalesce(CAST(page AS VARCHAR), '?') || ' | Section: ' || coalesce(section, 'N/A') || ' | Type: ' || coalesce(chunk_type, 'text') || ' | Score: ' || printf('%.3f', score) || chr(10) || coalesce(content, '') || chr(10), chr(10) || '---' || chr(10) ORDER BY rank) AS block
FROM rr JOIN chunks USING (chunk_id) GROUP BY query_id"""


def abstain_filter(spark, d):
    """Questions that abstain when evidence must score at least 0.5."""
    ev = answers.evidence_filter(R.rerank_lexical(spark, d), 0.5)
    return answers.abstains(R._questions(spark, d), ev)


SQL["abstain_filter"] = f"WITH {R._hybrid_sql(R.CLASSED, True)}, {R.RERANKED} SELECT item_id AS query_id, NOT EXISTS (SELECT 1 FROM rr WHERE rr.query_id = item_id AND score >= 0.5e0) AS abstained FROM benchmark_items"


def benchmark_filter(spark, d):
    """In-scope questions, and the number of evidence pages."""
    return table(spark, d, "benchmark_items").where("in_scope").select("item_id", "query_type", F.size(F.coalesce("evidence_pages", F.array().cast("array<int>"))).alias("n_pages"))


SQL["benchmark_filter"] = "SELECT item_id, query_type, coalesce(len(evidence_pages), 0) AS n_pages FROM benchmark_items WHERE in_scope"


def abstention_rate(spark, d):
    """Share of out-of-scope questions that abstain, 0 if there are none."""
    out = table(spark, d, "benchmark_items").where("not in_scope").select(F.col("item_id").alias("query_id"))
    return abstain_filter(spark, d).join(out, "query_id", "left_semi").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.round(F.avg(F.col("abstained").cast("double")), 6), F.lit(0.0)).alias("rate"))


SQL["abstention_rate"] = f"WITH {R._hybrid_sql(R.CLASSED, True)}, {R.RERANKED}, ab AS (SELECT item_id, NOT EXISTS (SELECT 1 FROM rr WHERE rr.query_id = item_id AND score >= 0.5e0) AS a FROM benchmark_items WHERE NOT in_scope) SELECT count(*) AS n, coalesce(round(avg(CASE WHEN a THEN 1e0 ELSE 0e0 END), 6), 0e0) AS rate FROM ab"


def generate_answers(spark, d):
    """The stand-in model's answers with validated citations."""
    q = R._questions(spark, d)
    ev = R.rerank_lexical(spark, d)
    g = answers.generate(q, answers.evidence_block(ev, table(spark, d, "chunks")))
    c = g.select("query_id", F.explode("citations").alias("c")).select("query_id", "c.*")
    ok = answers.valid_citations(c, ev.join(table(spark, d, "chunks").select("chunk_id", "company", "page"), "chunk_id")).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_valid"))
    return answers.display(g).join(g.select("query_id", "abstained", "confidence"), "query_id").join(ok, "query_id", "left").fillna(0, ["n_valid"])


def _citations(spark, d) -> DataFrame:
    """Citations made of every question's passages: the passage itself in upper case, and one page on."""
    ev = R.hybrid_topk(spark, d).where("rank <= 5").join(table(spark, d, "chunks").select("chunk_id", "company", "page"), "chunk_id")
    return ev, ev.select("query_id", "rank", F.explode(F.array(F.struct(F.upper("company").alias("company"), F.col("page").alias("page")), F.struct(F.col("company"), (F.col("page") + 1).alias("page")))).alias("c")).select("query_id", "rank", "c.company", "c.page")


_CITED = f"""{R._hybrid_sql(R.CLASSED, True)}, evd AS (SELECT h.query_id, h.rank, c.company, c.page FROM hyb h JOIN chunks c USING (chunk_id) WHERE h.rank <= 5),
cit AS (SELECT query_id, rank, upper(company) AS company, page FROM evd UNION ALL SELECT query_id, rank, company, page + 1 FROM evd)"""


def valid_citations(spark, d):
    """Citations whose company and page are in the evidence."""
    ev, c = _citations(spark, d)
    return answers.valid_citations(c, ev)


SQL["valid_citations"] = f"WITH {_CITED} SELECT * FROM cit c WHERE EXISTS (SELECT 1 FROM evd e WHERE e.query_id = c.query_id AND lower(coalesce(e.company, '')) = lower(coalesce(c.company, '')) AND e.page = c.page)"


def citation_accuracy(spark, d):
    """Share of citations on an evidence page."""
    a = metrics.citation_accuracy(_citations(spark, d)[1], R._questions(spark, d))
    return a.select("query_id", F.round("accuracy", 6).alias("accuracy"))


SQL["citation_accuracy"] = f"WITH {_CITED} SELECT item_id AS query_id, round(CASE WHEN len(evidence_pages) > 0 THEN coalesce((SELECT avg(CASE WHEN list_contains(evidence_pages, page) THEN 1e0 ELSE 0e0 END) FROM cit WHERE query_id = item_id), 0e0) ELSE 0e0 END, 6) AS accuracy FROM benchmark_items"


def cited_pages(spark, d):
    """Pages read from citation texts: the gold answers and questions."""
    b = table(spark, d, "benchmark_items")
    return b.select("item_id", metrics.cited_page(F.concat_ws(" ", "question", "gold_answer")).alias("page"))


SQL["cited_pages"] = r"SELECT item_id, TRY_CAST(coalesce(nullif(regexp_extract(concat_ws(' ', question, gold_answer), '(?i)(?:page|p\.)\s*(\d+)', 1), ''), nullif(regexp_extract(concat_ws(' ', question, gold_answer), '\b(\d+)\b', 1), '')) AS INTEGER) AS page FROM benchmark_items"


def parse_llm_json(spark, d):
    """Responses made of the gold answers: fenced JSON, JSON with keys missing, or plain text, by item."""
    b = table(spark, d, "benchmark_items").select("item_id", F.coalesce("gold_answer", F.lit("none")).alias("g"))
    js = F.to_json(F.struct(F.col("g").alias("answer"), F.lit("high").alias("confidence")))
    raw = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("```json\n"), js, F.lit("\n```"))).when(F.col("item_id") % 3 == 1, F.lit('{"abstained": true}')).otherwise(F.col("g"))
    return b.select("item_id", answers.parse_response(raw).alias("r")).select("item_id", "r.answer", "r.confidence", "r.abstained", F.size("r.citations").alias("n_citations"))


SQL["parse_llm_json"] = "SELECT item_id, CASE item_id % 3 WHEN 1 THEN '' ELSE trim(coalesce(gold_answer, 'none')) END AS answer, CASE item_id % 3 WHEN 0 THEN 'high' ELSE 'low' END AS confidence, item_id % 3 = 1 AS abstained, 0 AS n_citations FROM benchmark_items"


def judge_clamp(spark, d):
    """Scores read from text, clamped to [0, 1]."""
    n = table(spark, d, "extracted_numbers")
    return n.select("raw", T.clamp_score(F.col("raw")).alias("score")).distinct()


SQL["judge_clamp"] = "SELECT DISTINCT raw, greatest(0e0, least(1e0, coalesce(TRY_CAST(raw AS DOUBLE), 0e0))) AS score FROM extracted_numbers"


def evaluate_configs(spark, d):
    """Per configuration: mean metrics, abstention over out-of-scope questions and mean citation accuracy."""
    m = R.ablation_summary(spark, d)
    ab = abstention_rate(spark, d).select(F.col("rate").alias("abstention_accuracy"))
    ca = citation_accuracy(spark, d).agg(F.round(F.avg("accuracy"), 4).alias("citation_accuracy"))
    return m.join(F.broadcast(ab)).join(F.broadcast(ca))  # one row each


_METS = ", ".join(f"round(avg({m}_{k}), 4) AS {m}_{k}" for k in X.METRIC_KS for m in ("recall", "precision", "ndcg"))
SQL["evaluate_configs"] = f"""WITH {R._hybrid_sql(R.CLASSED, True)}, {R.RERANKED}, {R._UNWEIGHTED}, {R.GOLD}, {R.FIVE}, {R._metrics_sql('five', 'config')},
ab AS (SELECT NOT EXISTS (SELECT 1 FROM rr WHERE rr.query_id = item_id AND score >= 0.5e0) AS a FROM benchmark_items WHERE NOT in_scope),
evd AS (SELECT h.query_id, h.rank, c.company, c.page FROM hyb h JOIN chunks c USING (chunk_id) WHERE h.rank <= 5),
cit AS (SELECT query_id, rank, upper(company) AS company, page FROM evd UNION ALL SELECT query_id, rank, company, page + 1 FROM evd),
ca AS (SELECT round(CASE WHEN len(evidence_pages) > 0 THEN coalesce((SELECT avg(CASE WHEN list_contains(evidence_pages, page) THEN 1e0 ELSE 0e0 END) FROM cit WHERE query_id = item_id), 0e0) ELSE 0e0 END, 6) AS accuracy FROM benchmark_items)
SELECT config, {_METS}, round(avg(mrr), 4) AS mrr, (SELECT coalesce(round(avg(CASE WHEN a THEN 1e0 ELSE 0e0 END), 6), 0e0) FROM ab) AS abstention_accuracy, (SELECT round(avg(accuracy), 4) FROM ca) AS citation_accuracy FROM met GROUP BY config"""


def verify_messages(spark, d):
    """What is said of every mismatch, and its difference in percent."""
    a, e = _statements(spark, d)
    a = a.withColumn("raw", F.concat(F.lit("#"), F.col("num_ord").cast("string")))
    m = verify.mismatches(a, e, verify.verify(a, e))
    return m.withColumn("closest_evidence", F.round("closest_evidence", 4))


_SHOWN = lambda k: f"CASE WHEN len({k}) = 0 THEN '[]' ELSE '[' || chr(39) || array_to_string(list_sort({k}), chr(39) || ', ' || chr(39)) || chr(39) || ']' END"
SQL["verify_messages"] = f"""WITH {VERIFIED}, fk AS (SELECT answer_id, num_ord, arg_min(ev_keywords, ev_ord) AS ek FROM pr WHERE d <= {X.TOLERANCE} AND ev_value <> 0 GROUP BY ALL)
SELECT st.answer_id, st.num_ord, round(cv, 4) AS closest_evidence, round(cd * 100, 2) AS relative_diff_pct,
CASE WHEN ek IS NOT NULL THEN '#' || st.num_ord || ' matches evidence value ' || format('{{:.4g}}', cv) || ' numerically but metric context differs (answer: ' || {_SHOWN('an.keywords')} || ', evidence: ' || {_SHOWN('ek')} || '). Possible metric substitution.'
ELSE 'Answer states #' || st.num_ord || ' (\u2248' || format('{{:.4g}}', st.value) || ') but closest evidence value is ' || format('{{:.4g}}', cv) || ' (' || format('{{:.1f}}', cd * 100) || '% difference).' END AS message
FROM st JOIN an ON an.answer_id = st.answer_id AND an.num_ord = st.num_ord LEFT JOIN fk ON fk.answer_id = st.answer_id AND fk.num_ord = st.num_ord WHERE status = 'mismatch'"""


def verify_no_context(spark, d):
    """Status of every checked number where keywords do not matter."""
    v = verify.verify(*_statements(spark, d), require_context=False)
    return v.select("answer_id", "num_ord", "status")


SQL["verify_no_context"] = f"WITH {VERIFIED.replace('bool_or(len(keywords) = 0', 'bool_or(true OR len(keywords) = 0')} SELECT answer_id, num_ord, status FROM st"


def judge_answers(spark, d):
    """Faithfulness and correctness of the gold answers by the stand-in judge: the share of the answer's words in the
    passage, and of the reference's words in the answer; the answer is the gold answer or, without one, the question."""
    b = table(spark, d, "benchmark_items").select(F.col("item_id").alias("query_id"), "question", F.coalesce("gold_answer", "question").alias("answer"), F.array("text").alias("evidence"), "gold_answer")
    j = models.judge_answers(b)
    return j.select("query_id", F.round("faithfulness", 6).alias("faithfulness"), F.round("answer_correctness", 6).alias("answer_correctness"), "calls")


_BAG = lambda x: f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+'))"
_PART = lambda a, b: f"CASE WHEN len({_BAG(a)}) = 0 THEN 0e0 ELSE round(len(list_intersect({_BAG(a)}, {_BAG(b)})) / CAST(len({_BAG(a)}) AS DOUBLE), 6) END"
SQL["judge_answers"] = f"SELECT item_id AS query_id, {_PART('coalesce(gold_answer, question)', 'text')} AS faithfulness, CASE WHEN gold_answer IS NOT NULL THEN {_PART('gold_answer', 'gold_answer')} END AS answer_correctness, 1 + CAST(gold_answer IS NOT NULL AS BIGINT) AS calls FROM benchmark_items"


def display_answers(spark, d):
    """Answers as shown: two citations of each item's first page (one repeated), a warning for every third item."""
    b = table(spark, d, "benchmark_items")
    page = F.get("evidence_pages", F.lit(0))
    cite = F.struct(F.col("company"), F.lit("Report").alias("document"), page.alias("page"), F.when(F.col("item_id") % 2 == 0, F.lit("Notes")).alias("section"), F.lit("").alias("quote"))
    r = b.select(F.col("item_id").alias("query_id"), F.coalesce("gold_answer", F.lit("")).alias("answer"), F.array(cite, cite).alias("citations"), F.lit("high").alias("confidence"))
    w = b.where("item_id % 3 = 0").select(F.col("item_id").alias("query_id"), F.lit(0).alias("num_ord"), F.concat(F.lit("check "), F.col("item_id").cast("string")).alias("message"))
    return answers.display(r, w)


SQL["display_answers"] = f"""SELECT item_id AS query_id, coalesce(gold_answer, '') || chr(10) || chr(10) || '{X.SOURCES}' || chr(10) || '{X.BULLET}' || coalesce(company, 'Unknown') || ' \u2014 Report | Page ' || coalesce(CAST(evidence_pages[1] AS VARCHAR), '?') || CASE WHEN item_id % 2 = 0 THEN ' | Notes' ELSE '' END
|| CASE WHEN item_id % 3 = 0 THEN chr(10) || chr(10) || '{X.WARNINGS}' || chr(10) || '{X.BULLET}' || 'check ' || item_id ELSE '' END || chr(10) || chr(10) || '*Confidence: high*' AS shown FROM benchmark_items"""


def citation_pages(spark, d):
    """Pages of citations given as JSON with page or page_number, as a number or as text, by item."""
    b = table(spark, d, "benchmark_items").withColumn("p", F.coalesce(F.get("evidence_pages", F.lit(0)), F.lit(7)))
    p = F.col("p").cast("string")
    c = F.when(F.col("item_id") % 4 == 0, F.concat(F.lit('{"page": '), p, F.lit("}"))).when(F.col("item_id") % 4 == 1, F.concat(F.lit('{"page_number": "p. '), p, F.lit('"}'))).when(F.col("item_id") % 4 == 2, p).otherwise(F.concat(F.lit("10-K 2020, page "), p))
    return b.select("item_id", metrics.citation_page(c).alias("page"))


SQL["citation_pages"] = "SELECT item_id, coalesce(evidence_pages[1], 7) AS page FROM benchmark_items"


def event_windows(spark, d):
    """Hourly counts of events by type (batch form of the streaming operator)."""
    from tallyvane.streaming.incremental import windowed_counts

    w = windowed_counts(table(spark, d, "events"))
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n")


SQL["event_windows"] = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL"


def queries() -> dict:
    return {k: f for k, f in globals().items() if callable(f) and not k.startswith("_") and getattr(f, "__module__", "") == __name__ and k != "queries"}
