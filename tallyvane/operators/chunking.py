"""From parsed elements to chunks: sections, headings, table and figure handling, text packing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyvane.functions import fixed as X
from tallyvane.functions import text as T

_PARAGRAPH, _SENTENCE = re.compile(X.PARAGRAPH_SPLIT), re.compile(X.SENTENCE_SPLIT)


def pack(text: str, most: int = X.MAX_WORDS, overlap: int = X.OVERLAP_WORDS) -> list[str]:
    """A text's chunks of about `most` words: paragraphs, or the sentences of a longer one, are taken in order; a
    full chunk is closed and the next begins with its last `overlap` words (all of them for 0)."""
    units: list[tuple[str, int]] = []
    for p in (x.strip() for x in _PARAGRAPH.split(text)):
        if p:
            n = len(p.split())
            units += [(p, n)] if n <= most else [(s, len(s.split())) for s in _SENTENCE.split(p)]
    done: list[str] = []
    parts: list[str] = []
    have = 0
    for unit, n in units:
        if have + n > most:
            if parts:
                done.append(" ".join(parts))
            if done:
                tail = done[-1].split()[-overlap:]
                parts, have = [" ".join(tail)], len(tail)
        parts.append(unit)
        have += n
    if parts:
        done.append(" ".join(parts))
    return [c for c in done if c.strip()]


def pack_texts(df: DataFrame, key: str, text: str, most: int = X.MAX_WORDS, overlap: int = X.OVERLAP_WORDS) -> DataFrame:
    """(key, piece_no, piece): the packed pieces of each text, by one linear pass per text in Arrow batches.

    The fold is sequential by definition; its state would be copied at every step inside a column expression.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(k, i, c) for k, t in zip(pdf["k"], pdf["t"]) if t is not None for i, c in enumerate(pack(t, most, overlap))], columns=["k", "piece_no", "piece"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, piece_no int, piece string").withColumnRenamed("k", key)


def base_columns(elements: DataFrame) -> DataFrame:
    """Metadata defaults: empty texts, page and year 0."""
    d = {"company": "", "document": "", "section": "", "caption": "", "description": ""}
    out = elements
    for c, v in d.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in elements.columns else F.lit(v))
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("page", "year")})


def chunk_id(*parts: Column) -> Column:
    """A reproducible id from what identifies a chunk."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def text_chunks(elements: DataFrame, most: int = X.MAX_WORDS, overlap: int = X.OVERLAP_WORDS) -> DataFrame:
    """Chunks of text elements: header line (with section) and a packed piece."""
    e = base_columns(elements.where("element_type = 'text'"))
    p = pack_texts(e, "element_id", "content", most, overlap).join(e.drop("content", "grid"), "element_id")
    content = F.concat(T.header("", F.col("company"), F.col("document"), F.col("page"), F.col("section")), F.lit("\n"), F.col("piece"))
    return p.select("element_id", F.col("piece_no").alias("part"), F.lit("text").alias("chunk_type"), content.alias("content"), "company", "document", "year", "page", "section", "caption", F.lit(None).cast("array<array<string>>").alias("raw_table"))


def table_chunks(elements: DataFrame, most: int = X.TABLE_MAX_WORDS, group: int = X.ROW_GROUP) -> DataFrame:
    """Chunks of table elements: one if the text has at most `most` words, else one for each `group` data rows,
    each with the header row and its range of rows; a larger table of a header alone gives none."""
    e = base_columns(elements.where("element_type = 'table' and size(grid) > 0"))
    top = T.header("TABLE", F.col("company"), F.col("document"), F.col("page"))
    e = e.withColumn("whole", F.concat(top, F.lit("\n"), T.table_text(F.col("grid"), F.col("caption"), F.col("section"))))
    small = T.word_count(F.col("whole")) <= most
    one = e.where(small).select("*", F.lit(0).alias("part"), F.col("whole").alias("content2"), F.col("grid").alias("raw_table"))
    g = e.where(~small & (F.size("grid") > 1)).withColumn("part", F.explode(F.sequence(F.lit(0), (F.ceil((F.size("grid") - 1) / group) - 1).cast("int"))))
    rows = F.slice(F.col("grid"), F.col("part") * group + 2, F.lit(group))
    g = g.withColumn("raw_table", F.concat(F.slice("grid", 1, 1), rows))
    label = F.concat(F.lit(" (rows "), (F.col("part") * group + 1).cast("string"), F.lit(X.EN_DASH), (F.col("part") * group + F.size("raw_table") - 1).cast("string"), F.lit(")"))
    g = g.withColumn("content2", F.concat(top, label, F.lit("\n"), T.table_text(F.col("raw_table"), F.concat(F.col("caption"), label), F.col("section"))))
    both = one.select(*[c for c in g.columns]).unionByName(g)
    return both.select("element_id", "part", F.lit("table").alias("chunk_type"), F.col("content2").alias("content"), "company", "document", "year", "page", "section", "caption", "raw_table")


def chart_chunks(elements: DataFrame) -> DataFrame:
    """Chunks of figures from description and caption; neither gives none."""
    e = base_columns(elements.where("element_type = 'chart'"))
    d, c = F.trim("description"), F.trim("caption")
    body = F.when((d != "") & (c != ""), F.concat(d, F.lit("\nAdditional context: "), c)).when(d != "", d).when(c != "", F.concat(F.lit("[CHART/FIGURE]\nCaption: "), c))
    content = F.concat(T.header("CHART", F.col("company"), F.col("document"), F.col("page")), F.lit("\n"), body)
    return e.select("element_id", F.lit(0).alias("part"), F.lit("chart").alias("chunk_type"), content.alias("content"), "company", "document", "year", "page", "section", "caption", F.lit(None).cast("array<array<string>>").alias("raw_table")).where(F.col("content").isNotNull())


def chunk(elements: DataFrame, most: int = X.MAX_WORDS, overlap: int = X.OVERLAP_WORDS, table_most: int = X.TABLE_MAX_WORDS, least: int = X.MIN_CHARS) -> DataFrame:
    """All chunks of elements with reproducible ids; contents under `least` characters (header included) go."""
    c = text_chunks(elements, most, overlap).unionByName(table_chunks(elements, table_most)).unionByName(chart_chunks(elements))
    return c.where(F.length("content") >= least).withColumn("chunk_id", chunk_id(F.col("document"), F.col("element_id"), F.col("part")))


def clean_grid(elements: DataFrame) -> DataFrame:
    """Cells stripped, null cells empty; tables of fewer than two rows are dropped."""
    cells = F.transform("grid", lambda r: F.transform(F.coalesce(r, F.array().cast("array<string>")), lambda c: F.coalesce(F.trim(c), F.lit(""))))
    return elements.where((F.col("element_type") != "table") | (F.size("grid") >= 2)).withColumn("grid", F.when(F.col("element_type") == "table", cells).otherwise(F.col("grid")))


def carry_sections(lines: DataFrame, by: str = "document", order: tuple[str, ...] = ("page", "kind_order", "seq"), text: str = "line") -> DataFrame:
    """Adds section: the last heading up to and including the row, first 80 characters; null before the first."""
    heading = F.when(T.is_heading(F.col(text)), F.substring(F.trim(F.col(text)), 1, X.SECTION_MAX))
    return lines.withColumn("section", F.last(heading, True).over(W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def outside_tables(blocks: DataFrame, tables: DataFrame, cell: float = 200.0) -> DataFrame:
    """Blocks that overlap no table of their page. Boxes are x0, y0, x1, y1 beside document and page.

    Tables and blocks meet by page and a coarse grid of cells, so only boxes near each other are compared.
    """
    spread = lambda lo, hi: F.sequence(F.floor(F.least(F.col(lo), F.col(hi)) / cell), F.floor(F.greatest(F.col(lo), F.col(hi)) / cell))
    t = tables.where("x0 is not null and x1 is not null and y0 is not null and y1 is not null").select("document", "page", *[F.col(c).alias("t" + c) for c in ("x0", "y0", "x1", "y1")]).withColumn("gx", F.explode(spread("tx0", "tx1"))).withColumn("gy", F.explode(spread("ty0", "ty1")))
    b = blocks.where("x0 is not null and x1 is not null and y0 is not null and y1 is not null").select("block_id", "document", "page", "x0", "y0", "x1", "y1").withColumn("gx", F.explode(spread("x0", "x1"))).withColumn("gy", F.explode(spread("y0", "y1")))
    hit = b.join(t, ["document", "page", "gx", "gy"]).where("x0 < tx1 and x1 > tx0 and y0 < ty1 and y1 > ty0").select("block_id").distinct()
    return blocks.join(hit, "block_id", "left_anti")


def captions(elements: DataFrame, words: DataFrame, above: float = 30.0, below: float = 40.0) -> DataFrame:
    """(element_id, caption): words in the strip above a table or below a figure, in reading order; only captions
    of 1 to 199 characters count. Strips and words meet by page and horizontal bands of `above + below` points."""
    e = elements.select("element_id", "document", "page", "x0", "x1", F.when(F.col("element_type") == "table", F.col("y0") - above).otherwise(F.col("y1")).alias("lo"), F.when(F.col("element_type") == "table", F.col("y0")).otherwise(F.col("y1") + below).alias("hi"))
    band = lambda c: F.floor(F.col(c) / (above + below))
    e = e.where("lo is not null and hi is not null").withColumn("band", F.explode(F.sequence(band("lo"), F.greatest(band("hi"), band("lo")))))
    w = words.where("y0 is not null").select("document", "page", F.col("x0").alias("wx"), F.col("y0").alias("wy"), "word", band("y0").alias("band"))
    hit = e.join(w, ["document", "page", "band"]).where("wy >= lo and wy < hi and wx >= x0 and wx < x1")
    c = hit.groupBy("element_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("wy", "wx", "word"))), lambda s: s["word"]), " ").alias("caption"))
    return c.where("length(caption) > 0 and length(caption) < 200")


def large_regions(regions: DataFrame, least: float = X.MIN_AREA) -> DataFrame:
    """Image regions of at least this share of their page's area."""
    return regions.where((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / F.col("page_area") >= least)


def layout(elements: DataFrame) -> DataFrame:
    """Parsed elements (see `sources.elements`) as they go into chunks.

    Text blocks under ten characters or over a table of their page go, and figures under two percent of the page;
    tables and figures without a caption get the words above or below them; every element gets the section in force,
    tables that of the pages before, unless it states its own. `word` rows serve the captions only.
    """
    e = elements.withColumn("block_id", F.xxhash64("document", "page", "seq"))
    box = ["block_id", "document", "page", "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1"]
    text = outside_tables(e.where((F.col("element_type") == "text") & (F.length(F.trim("content")) >= X.MIN_BLOCK)).select("*", "bbox.*"), e.where("element_type = 'table'").select(*box)).select(*e.columns)
    charts = e.where("element_type = 'chart'").select("*", "bbox.*")
    charts = large_regions(charts.where("x0 is not null and page_area > 0")).select(*e.columns).unionByName(charts.where("x0 is null or page_area is null or page_area <= 0").select(*e.columns))
    kept = e.where("element_type = 'table'").unionByName(text).unionByName(charts)
    words = e.where("element_type = 'word' and bbox is not null").select("document", "page", "bbox.x0", "bbox.y0", F.col("content").alias("word"))
    named = captions(kept.where("element_type <> 'text' and bbox is not null").select(F.col("block_id").alias("element_id"), "element_type", *box[1:]), words)
    kept = kept.join(named.select(F.col("element_id").alias("block_id"), F.col("caption").alias("__found")), "block_id", "left").withColumn("caption", F.coalesce(F.nullif("caption", F.lit("")), "__found")).drop("__found")
    kind = F.when(F.col("element_type") == "table", 0).when(F.col("element_type") == "text", 1).otherwise(2)
    lined = kept.withColumns({"kind_order": kind, "__own": F.col("section"), "line": F.when(F.col("element_type") == "text", F.substring_index(F.ltrim("content"), "\n", 1))})
    return carry_sections(lined, order=("page", "kind_order", "seq")).withColumn("section", F.coalesce(F.nullif("__own", F.lit("")), "section")).drop("kind_order", "line", "__own", "block_id")


def document_yield(manifest: DataFrame, elements: DataFrame) -> DataFrame:
    """(document, n, verdict) of each manifest document: error without elements, warning below 10, else ok."""
    n = elements.groupBy("document").agg(F.count(F.lit(1)).alias("n"))
    j = manifest.select("document").distinct().join(n, "document", "left").fillna(0, ["n"])
    return j.withColumn("verdict", F.when(F.col("n") == 0, "error").when(F.col("n") < 10, "warning").otherwise("ok"))
