"""Retrieval and evaluation queries over the chunks, with their SQL counterparts."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvane.functions import fixed as X
from tallyvane.functions import text as T
from tallyvane.operators import answers, bm25, dense, fusion, metrics
from tallyvane.plans import sql as S
from tallyvane.session import checkpoint, spread, table

_BUILT: dict[tuple, object] = {}


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark_items").withColumnRenamed("item_id", "query_id")


def _once(spark: SparkSession, d: str, name: str, build: Callable[[], object]) -> object:
    """What `build` makes of a table of the directory, made once a session and kept for as long as its files stay the
    same: an index is built once and read by all queries."""
    files = tuple(sorted((f, os.path.getmtime(p) if os.path.exists(p := f.removeprefix("file://").removeprefix("file:")) else 0) for f in table(spark, d, name.split(":")[0]).inputFiles()))
    key = (spark.sparkContext.applicationId, name, files)
    if key not in _BUILT:
        _BUILT[key] = build()
    return _BUILT[key]


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """The offline encoder's vector of every chunk."""
    e = dense.hashed_encoder()
    return _once(spark, d, "chunks:vectors", lambda: checkpoint(spread(_chunks(spark, d).select("chunk_id", "ord", "content")).select("chunk_id", "ord", e(F.col("content")).alias("embedding"))))


def _encoded(questions: DataFrame) -> DataFrame:
    e = dense.hashed_encoder(prefix=X.QUERY_PREFIX)
    return questions.select("query_id", e(F.col("question")).alias("embedding"))


def _query_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _encoded(_questions(spark, d))


def _index(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return _once(spark, d, "chunks:bm25", lambda: bm25.index(_chunks(spark, d)))


def _document_index(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return _once(spark, d, "documents:bm25", lambda: bm25.index(table(spark, d, "documents"), "doc_id", "text", "doc_id"))


def _dense(spark: SparkSession, d: str, k: int = X.TOP_K) -> DataFrame:
    return dense.search(_query_vectors(spark, d), _vectors(spark, d), k)


def _lexical(spark: SparkSession, d: str, k: int | None = X.TOP_K) -> DataFrame:
    return bm25.search(_questions(spark, d).select("query_id", F.col("question").alias("query")), _index(spark, d), k)


C_VECS = S.vectors("SELECT chunk_id AS id, content AS t FROM chunks", "cv")
VECS = C_VECS + "," + S.vectors(f"SELECT item_id AS id, '{X.QUERY_PREFIX}' || coalesce(question, '') AS t FROM benchmark_items", "qv")
Q_VEC = "SELECT id AS query_id, embedding FROM qv"
C_VEC = "SELECT chunk_id, ord, embedding FROM chunks JOIN cv ON id = chunk_id"
CORPUS = "SELECT chunk_id, ord, content FROM chunks"
QUESTIONS = "SELECT item_id AS query_id, question AS query FROM benchmark_items"
BOTH = VECS + "," + S.dense(C_VEC, Q_VEC) + "," + S.bm25(CORPUS, QUESTIONS)
CLASSED = f"qs AS (SELECT item_id AS query_id, question, query_class, {S.weight('query_class', 0)} AS w_dense, {S.weight('query_class', 1)} AS w_bm25 FROM (SELECT *, {S.query_class('question', S.named_pair('question'))} AS query_class FROM benchmark_items))"
PLAIN = "qs AS (SELECT item_id AS query_id, question, 'factual' AS query_class, 0.5e0 AS w_dense, 0.5e0 AS w_bm25 FROM benchmark_items)"


def _hybrid_sql(qs: str, boosts: bool, where: str = "true", k: int = X.TOP_K) -> str:
    score = f"round(w + {S.table_boost()} + {S.domain_boost()}, 9)" if boosts else "w"
    return f"""{BOTH}, {qs},
cand AS (SELECT p.*, question, query_class, {S.wrrf()} AS w FROM ({S.pool()}) p JOIN qs USING (query_id)),
sc AS (SELECT cand.*, c.company, c.year, {score} AS score FROM cand JOIN chunks c USING (chunk_id) WHERE {where}),
hyb AS (SELECT query_id, chunk_id, dense_rank, bm25_rank, w AS wrrf_score, score, {S.cut()} AS rank FROM sc QUALIFY rank <= {k})"""


SQL: dict[str, str] = {}


def tokenize_terms(spark, d):
    """Frequency of every token over all chunks."""
    return _chunks(spark, d).select(F.explode(T.tokens(F.col("content"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


SQL["tokenize_terms"] = f"SELECT term, count(*) AS n FROM (SELECT unnest({S.tokens('content')}) AS term FROM chunks) GROUP BY term"


def canonical_money(spark, d):
    """Canonical form of every printed number."""
    n = table(spark, d, "extracted_numbers")
    return n.select("raw", T.canonical_token(F.lower("raw")).alias("canonical")).distinct()


SQL["canonical_money"] = f"SELECT DISTINCT raw, {S.canonical('lower(raw)')} AS canonical FROM extracted_numbers"


def bm25_stats(spark, d):
    """Document frequency and weight of every term of the documents."""
    ix = _document_index(spark, d)
    df = ix["postings"].groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    return df.join(ix["idf"], "term").select("term", "df", "cf", F.round("idf", 6).alias("idf"))


_DOCS = "SELECT doc_id AS chunk_id, doc_id AS ord, text AS content FROM documents"
_PASSAGES = "SELECT item_id AS query_id, text AS query FROM benchmark_items"
SQL["bm25_stats"] = f"WITH {S.bm25(_DOCS, _PASSAGES)} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, round(any_value(idf), 6) AS idf FROM lex_p JOIN lex_i USING (term) GROUP BY term"


def bm25_topk(spark, d):
    """The 20 best documents of every benchmark passage."""
    ix = _document_index(spark, d)
    q = table(spark, d, "benchmark_items").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return bm25.search(q, ix).select("query_id", F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


SQL["bm25_topk"] = f"WITH {S.bm25(_DOCS, _PASSAGES)} SELECT query_id, chunk_id AS doc_id, round(score, 6) AS score, rank FROM lex"


def dense_topk(spark, d):
    """The 20 nearest vectors of every vector whose id is divisible by 100."""
    e = table(spark, d, "embeddings")
    q = e.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return dense.search(q, e.select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("ord"), "embedding")).select("query_id", F.col("ord").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


SQL["dense_topk"] = f"WITH {S.dense('SELECT vec_id AS chunk_id, vec_id AS ord, embedding FROM embeddings', 'SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 100 = 0')} SELECT query_id, ord AS vec_id, round(score, 6) AS score, rank FROM den"


def l2_normalize(spark, d):
    """Norm of every vector after normalisation of its multiple by three."""
    e = table(spark, d, "embeddings").withColumn("v", dense.l2_normalize(F.transform("embedding", lambda x: x * 3)))
    return e.select("vec_id", F.round(dense.inner_product(F.col("v"), F.col("v")), 4).alias("norm"), F.round(F.element_at("v", 1).cast("double"), 5).alias("first"))


SQL["l2_normalize"] = "SELECT vec_id, 1.0 AS norm, round(CAST(CAST(embedding[1] * 3 AS FLOAT) AS DOUBLE) / sqrt(list_inner_product([CAST(x * 3 AS DOUBLE) for x in embedding], [CAST(x * 3 AS DOUBLE) for x in embedding])), 5) AS first FROM embeddings"


def rrf(spark, d):
    """Unweighted fusion of both lists of every question."""
    a, b = _dense(spark, d), _lexical(spark, d)
    lists = a.select("query_id", "chunk_id", F.lit(1).alias("list_id"), "rank").unionByName(b.select("query_id", "chunk_id", F.lit(2).alias("list_id"), "rank"))
    return fusion.rrf(lists)


SQL["rrf"] = f"WITH {BOTH} SELECT query_id, chunk_id, round(sum(1e0 / ({X.RRF_K}e0 + rank)), 9) AS score FROM (SELECT query_id, chunk_id, rank FROM den UNION ALL SELECT query_id, chunk_id, rank FROM lex) GROUP BY ALL"


def _classified(spark, d):
    return fusion.classified(_questions(spark, d))


def wrrf(spark, d):
    """Weighted fusion of both lists of every question, all candidates."""
    return fusion.wrrf(fusion.pool(_dense(spark, d), _lexical(spark, d)).join(_classified(spark, d), "query_id")).select("query_id", "chunk_id", "dense_rank", "bm25_rank", "wrrf_score")


SQL["wrrf"] = f"WITH {BOTH}, {CLASSED} SELECT query_id, chunk_id, dense_rank, bm25_rank, {S.wrrf()} AS wrrf_score FROM ({S.pool()}) JOIN qs USING (query_id)"


def table_boost(spark, d):
    """Table boost of every candidate."""
    c = fusion.pool(_dense(spark, d), _lexical(spark, d)).join(_classified(spark, d), "query_id").join(_chunks(spark, d).select("chunk_id", "chunk_type"), "chunk_id")
    return c.select("query_id", "chunk_id", T.table_boost(F.col("query_class"), F.col("chunk_type")).alias("boost"))


SQL["table_boost"] = f"WITH {BOTH}, {CLASSED} SELECT query_id, chunk_id, {S.table_boost()} AS boost FROM ({S.pool()}) JOIN qs USING (query_id) JOIN (SELECT chunk_id, chunk_type FROM chunks) USING (chunk_id)"


def domain_boost(spark, d):
    """Domain boost of every chunk for a question about revenue and one about margins."""
    out = None
    for i, q in enumerate(BOOST_QUERIES):
        x = _chunks(spark, d).select(F.lit(i).alias("query_no"), "chunk_id", F.round(T.domain_boost(F.lit(q), F.col("content"), F.col("section"), F.col("chunk_type")), 9).alias("boost"))
        out = x if out is None else out.unionByName(x)
    return out


BOOST_QUERIES = ["What was total revenue and net sales in 2023?", "How did gross margin and earnings develop from 2019 to 2021?"]
SQL["domain_boost"] = " UNION ALL ".join(f"SELECT {i} AS query_no, chunk_id, round({S.domain_boost(chr(39) + q + chr(39))}, 9) AS boost FROM chunks" for i, q in enumerate(BOOST_QUERIES))


def hybrid_topk(spark, d):
    """Classified, fused, boosted: the 20 best chunks of every question."""
    return fusion.hybrid(_classified(spark, d), _dense(spark, d), _lexical(spark, d), _chunks(spark, d))


SQL["hybrid_topk"] = f"WITH {_hybrid_sql(CLASSED, True)} SELECT * FROM hyb"


def hybrid_no_classifier(spark, d):
    """Equal weights, factual class."""
    return fusion.hybrid(fusion.unclassified(_questions(spark, d)), _dense(spark, d), _lexical(spark, d), _chunks(spark, d))


SQL["hybrid_no_classifier"] = f"WITH {_hybrid_sql(PLAIN, True)} SELECT * FROM hyb"


def hybrid_filtered(spark, d):
    """Filtered after the pools' truncation: chunk_type TEXT and year 2022."""
    return fusion.hybrid(_classified(spark, d), _dense(spark, d), _lexical(spark, d), _chunks(spark, d), where={"chunk_type": "TEXT", "year": 2022})


SQL["hybrid_filtered"] = f"WITH {_hybrid_sql(CLASSED, True, where='lower(c.chunk_type) = ' + chr(39) + 'text' + chr(39) + ' AND c.year = 2022')} SELECT * FROM hyb"


def hybrid_unweighted(spark, d):
    """Equal weights and no boosts."""
    return fusion.hybrid(fusion.unclassified(_questions(spark, d)), _dense(spark, d), _lexical(spark, d), _chunks(spark, d), boosts=False)


SQL["hybrid_unweighted"] = f"WITH {_hybrid_sql(PLAIN, False)} SELECT * FROM hyb"


def hybrid_trace(spark, d):
    """All candidates with every rank and score, table boost only."""
    return fusion.trace(_classified(spark, d), _dense(spark, d), _lexical(spark, d), _chunks(spark, d))


SQL["hybrid_trace"] = f"""WITH {BOTH}, {CLASSED},
cand AS (SELECT p.*, query_class, {S.wrrf()} AS wrrf_score FROM ({S.pool()}) p JOIN qs USING (query_id)),
b AS (SELECT cand.*, round(wrrf_score + {S.table_boost()}, 9) AS boosted_score FROM cand JOIN (SELECT chunk_id, chunk_type FROM chunks) USING (chunk_id)),
r AS (SELECT *, {S.cut('boosted_score')} AS rank FROM b)
SELECT query_id, chunk_id, dense_rank, bm25_rank, wrrf_score, boosted_score, CASE WHEN rank <= {X.TOP_K} THEN rank END AS final_rank FROM r"""


def baseline_dense(spark, d):
    return _dense(spark, d).select("query_id", "chunk_id", "score", "rank")


def baseline_bm25(spark, d):
    return _lexical(spark, d).select("query_id", "chunk_id", "score", "rank")


SQL["baseline_dense"] = f"WITH {VECS}, {S.dense(C_VEC, Q_VEC)} SELECT query_id, chunk_id, score, rank FROM den"
SQL["baseline_bm25"] = f"WITH {S.bm25(CORPUS, QUESTIONS)} SELECT query_id, chunk_id, score, rank FROM lex"


def _pair_questions(spark, d):
    """One question for each two companies next to each other by name."""
    from pyspark.sql import Window as W

    c = table(spark, d, "manifest").where("company is not null").select("company").distinct()
    # a manifest's company names: a small dimension by its nature, numbered in one window
    w = W.orderBy("company")
    c = c.select("company", F.lead("company").over(w).alias("other"), F.row_number().over(w).cast("bigint").alias("query_id")).where("other is not null")
    return c.select("query_id", F.format_string("Which company sold more in 2022, %s or %s?", F.col("company"), F.col("other")).alias("question"))


PAIRS = "pq AS (SELECT query_id, 'Which company sold more in 2022, ' || company || ' or ' || other || '?' AS question FROM (SELECT company, lead(company) OVER (ORDER BY company) AS other, row_number() OVER (ORDER BY company) AS query_id FROM (SELECT DISTINCT company FROM manifest WHERE company IS NOT NULL)) WHERE other IS NOT NULL)"
MENTIONED = "mc AS (SELECT query_id, company, row_number() OVER (PARTITION BY query_id ORDER BY company) AS company_no, count(*) OVER (PARTITION BY query_id) AS n_companies FROM pq JOIN (SELECT DISTINCT company FROM manifest WHERE company IS NOT NULL) ON contains(lower(question), lower(company)))"


def mentioned_companies(spark, d):
    """Companies named in each question."""
    return fusion.mentioned_companies(_pair_questions(spark, d), table(spark, d, "manifest"))


SQL["mentioned_companies"] = f"WITH {PAIRS}, {MENTIONED} SELECT query_id, company, company_no, n_companies FROM mc"


def cross_company_topk(spark, d):
    """Company-balanced retrieval for the questions that name two companies."""
    q = _pair_questions(spark, d)
    named = fusion.mentioned_companies(q, table(spark, d, "manifest"))
    return _cross_company(spark, d, q, fusion.classified(q), named)


def _cross_company(spark, d, q, classed, named):
    named = checkpoint(named)
    most = named.agg(F.max("n_companies")).first()[0] or 1
    deep = min(X.TOP_K * most * 4, X.DEPTH_LIMIT)
    den = checkpoint(dense.search(_encoded(q), _vectors(spark, d), deep))
    lex = checkpoint(bm25.search(q.select("query_id", F.col("question").alias("query")), _index(spark, d), deep))
    return fusion.cross_company(classed, den, lex, named, _chunks(spark, d))


def _balanced_sql(name: str, out: str) -> str:
    return f"""{out}_g AS (SELECT query_id, chunk_id, ord, rank FROM {name} WHERE rank <= {X.TOP_K}),
{out}_n AS (SELECT query_id, count(*) AS n_head FROM {out}_g GROUP BY query_id),
{out}_m AS (SELECT r.query_id, r.chunk_id, r.ord, r.rank, mc.company_no, row_number() OVER (PARTITION BY r.query_id, mc.company ORDER BY r.rank) AS pos FROM {name} r JOIN chunks c USING (chunk_id) JOIN mc ON mc.query_id = r.query_id AND mc.company = c.company WHERE r.rank <= least({X.TOP_K} * n_companies * 4, {X.DEPTH_LIMIT})),
{out} AS (SELECT query_id, chunk_id, ord, rank FROM {out}_g UNION ALL SELECT m.query_id, chunk_id, ord, coalesce(n_head, 0) + row_number() OVER (PARTITION BY m.query_id ORDER BY company_no, rank) FROM {out}_m m LEFT JOIN {out}_n USING (query_id) WHERE pos <= {X.COMPANY_TOP_K} AND rank > {X.TOP_K})"""


_CROSS = f"""{C_VECS}, {S.vectors(f"SELECT query_id AS id, '{X.QUERY_PREFIX}' || question AS t FROM pq", 'pv')},
{S.dense(C_VEC, 'SELECT id AS query_id, embedding FROM pv', None, 'dp')},
{S.bm25(CORPUS, 'SELECT query_id, question AS query FROM pq', None, 'lp')},
{_balanced_sql('dp', 'bd')}, {_balanced_sql('lp', 'bl')}"""
SQL["cross_company_topk"] = f"""WITH {PAIRS}, {MENTIONED}, {_CROSS},
sc AS (SELECT p.*, {S.wrrf('0.5e0', '0.5e0')} AS wrrf_score, round({S.wrrf('0.5e0', '0.5e0')} + CASE WHEN chunk_type = 'table' THEN {X.TABLE_BOOST}e0 ELSE 0e0 END, 9) AS score FROM ({S.pool('bd', 'bl')}) p JOIN (SELECT chunk_id, chunk_type FROM chunks) USING (chunk_id))
SELECT query_id, chunk_id, dense_rank, bm25_rank, wrrf_score, score, {S.cut()} AS rank FROM sc QUALIFY rank <= {X.TOP_K}"""

def adaptive_topk(spark, d):
    """The adaptive entry over the benchmark questions and those that name two companies (numbered from -1 down): a
    cross-company question that names two companies or more takes the company-balanced way, all others the hybrid."""
    q = _questions(spark, d).select("query_id", "question").unionByName(_pair_questions(spark, d).select((-F.col("query_id")).alias("query_id"), "question"))
    return fusion.adaptive(q, table(spark, d, "manifest"), lambda x, k: dense.search(_encoded(x), _vectors(spark, d), k), lambda x, k: bm25.search(x.select("query_id", F.col("question").alias("query")), _index(spark, d), k), _chunks(spark, d))


_ALL = "aq AS (SELECT item_id AS query_id, question FROM benchmark_items UNION ALL SELECT -query_id, question FROM pq)"
_NAMED = "mn AS (SELECT query_id, company, row_number() OVER (PARTITION BY query_id ORDER BY company) AS company_no, count(*) OVER (PARTITION BY query_id) AS n_companies FROM aq JOIN (SELECT DISTINCT company FROM manifest WHERE company IS NOT NULL) ON contains(lower(question), lower(company)))"
SQL["adaptive_topk"] = f"""WITH {PAIRS}, {_ALL}, {_NAMED},
ac AS (SELECT query_id, question, {S.query_class('question', S.named_pair('question'))} AS query_class FROM aq),
qx AS (SELECT *, query_class = 'cross_company' AND query_id IN (SELECT query_id FROM mn WHERE n_companies >= 2) AS crossed FROM ac),
mc AS (SELECT * FROM mn WHERE query_id IN (SELECT query_id FROM qx WHERE crossed)),
qs AS (SELECT query_id, question, query_class, {S.weight('query_class', 0)} AS w_dense, {S.weight('query_class', 1)} AS w_bm25 FROM qx WHERE NOT crossed),
{C_VECS}, {S.vectors(f"SELECT query_id AS id, '{X.QUERY_PREFIX}' || coalesce(question, '') AS t FROM aq", 'av')},
{S.dense(C_VEC, 'SELECT id AS query_id, embedding FROM av', None, 'da')}, {S.bm25(CORPUS, 'SELECT query_id, question AS query FROM aq', None, 'la')},
den AS (SELECT * FROM da WHERE rank <= {X.TOP_K} AND query_id IN (SELECT query_id FROM qs)), lex AS (SELECT * FROM la WHERE rank <= {X.TOP_K} AND query_id IN (SELECT query_id FROM qs)),
cand AS (SELECT p.*, question, query_class, {S.wrrf()} AS w FROM ({S.pool()}) p JOIN qs USING (query_id)),
s1 AS (SELECT cand.*, round(w + {S.table_boost()} + {S.domain_boost()}, 9) AS score FROM cand JOIN chunks c USING (chunk_id)),
dp AS (SELECT * FROM da WHERE query_id IN (SELECT query_id FROM qx WHERE crossed)), lp AS (SELECT * FROM la WHERE query_id IN (SELECT query_id FROM qx WHERE crossed)),
{_balanced_sql('dp', 'bd')}, {_balanced_sql('lp', 'bl')},
s2 AS (SELECT p.*, {S.wrrf('0.5e0', '0.5e0')} AS w, round({S.wrrf('0.5e0', '0.5e0')} + CASE WHEN chunk_type = 'table' THEN {X.TABLE_BOOST}e0 ELSE 0e0 END, 9) AS score FROM ({S.pool('bd', 'bl')}) p JOIN (SELECT chunk_id, chunk_type FROM chunks) USING (chunk_id)),
sx AS (SELECT query_id, chunk_id, dense_rank, bm25_rank, w, score FROM s1 UNION ALL SELECT query_id, chunk_id, dense_rank, bm25_rank, w, score FROM s2)
SELECT query_id, chunk_id, dense_rank, bm25_rank, w AS wrrf_score, score, {S.cut()} AS rank FROM sx QUALIFY rank <= {X.TOP_K}"""

QUERY_TEXTS = [
    "Which company had the highest margin?", "Compare revenue of Tesla and Apple", "How do Microsoft and Nvidia differ?", "Q1 2023 vs Q1 2022", "How did growth change compared with last year?",
    "How much cash was on hand?", "What was total revenue in FY2023?", "What is the percentage?", "Plot the trend of deliveries over time", "How have sales evolved?", "Who chairs the audit committee?", "year over year", "Total net income of $4.2 billion", "", "   Which figure is it?  ",
]


def classify_queries(spark, d):
    """Class, weights and confidence of the benchmark questions and of a list of texts."""
    q = table(spark, d, "benchmark_items").select("question").unionByName(spark.createDataFrame([(x,) for x in QUERY_TEXTS], "question string")).distinct()
    q = q.withColumn("query_class", T.query_class(F.col("question")))
    return q.select("question", "query_class", T.class_weight(F.col("query_class"), 0).alias("w_dense"), T.class_weight(F.col("query_class"), 1).alias("w_bm25"), T.class_confidence(F.col("query_class")).alias("confidence"))


SQL["classify_queries"] = f"""WITH q AS (SELECT question FROM benchmark_items UNION SELECT unnest({S.quoted(QUERY_TEXTS)})), k AS (SELECT question, {S.query_class('question', S.named_pair('question'))} AS query_class FROM q)
SELECT question, query_class, {S.weight('query_class', 0)} AS w_dense, {S.weight('query_class', 1)} AS w_bm25, CASE query_class WHEN 'factual' THEN 'low' WHEN 'chart_trend' THEN 'medium' ELSE 'high' END AS confidence FROM k"""

GOLD = "gold AS (SELECT DISTINCT q.item_id AS query_id, c.chunk_id FROM (SELECT item_id, company, unnest(evidence_pages) AS p FROM benchmark_items) q JOIN chunks c ON lower(c.company) = lower(q.company) AND c.page = q.p)"


def gold_labels(spark, d):
    """Gold chunks of every benchmark question."""
    return metrics.gold_labels(_questions(spark, d), _chunks(spark, d))


SQL["gold_labels"] = f"WITH {GOLD} SELECT * FROM gold"


def _metrics_sql(ranking: str, by: str = "") -> str:
    b = f", {by}" if by else ""
    ks = X.METRIC_KS
    hits = ", ".join(f"sum(CASE WHEN rank <= {k} THEN rel ELSE 0 END) AS hit_{k}, sum(CASE WHEN rank <= {k} THEN rel / log2(rank + 1e0) ELSE 0e0 END) AS dcg_{k}" for k in ks)
    out = ", ".join(f"CASE WHEN n_gold > 0 THEN coalesce(hit_{k}, 0) / CAST(n_gold AS DOUBLE) ELSE 0e0 END AS recall_{k}, CASE WHEN n_gold > 0 THEN coalesce(hit_{k}, 0) / {k}e0 ELSE 0e0 END AS precision_{k}, CASE WHEN n_gold > 0 THEN coalesce(dcg_{k}, 0e0) / (SELECT sum(1e0 / log2(i + 1e0)) FROM range(1, {k + 1}) t(i) WHERE i <= n_gold) ELSE 0e0 END AS ndcg_{k}" for k in ks)
    base = f"SELECT * FROM (SELECT item_id AS query_id FROM benchmark_items), (SELECT DISTINCT {by} FROM {ranking})" if by else "SELECT item_id AS query_id FROM benchmark_items"
    using = f"(query_id, {by})" if by else "(query_id)"
    return f"""rel AS (SELECT r.query_id{', r.' + by if by else ''}, r.rank, CASE WHEN g.chunk_id IS NULL THEN 0 ELSE 1 END AS rel FROM {ranking} r LEFT JOIN gold g ON g.query_id = r.query_id AND g.chunk_id = r.chunk_id),
agg AS (SELECT query_id{b}, {hits}, min(CASE WHEN rel = 1 THEN rank END) AS first_hit FROM rel GROUP BY ALL),
ng AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY query_id),
met AS (SELECT query_id{b}, {out}, CASE WHEN n_gold > 0 AND first_hit > 0 THEN 1e0 / first_hit ELSE 0e0 END AS mrr FROM ({base}) LEFT JOIN agg USING {using} LEFT JOIN ng USING (query_id))"""


_ROUNDED = ", ".join(f"round({m}_{k}, 6) AS {m}_{k}" for k in X.METRIC_KS for m in ("recall", "precision", "ndcg")) + ", round(mrr, 6) AS mrr"


def _rounded(m: DataFrame, by: list[str]) -> DataFrame:
    return m.select(*by, *[F.round(c, 6).alias(c) for c in m.columns if c not in by])


def retrieval_metrics(spark, d):
    """Metrics of the hybrid ranking for every question."""
    q = _questions(spark, d)
    return _rounded(metrics.retrieval_metrics(q, hybrid_topk(spark, d), gold_labels(spark, d)), ["query_id"])


SQL["retrieval_metrics"] = f"WITH {_hybrid_sql(CLASSED, True)}, {GOLD}, {_metrics_sql('hyb')} SELECT query_id, {_ROUNDED} FROM met"


def _five(spark, d):
    """The five configurations in one long table: config, query_id, chunk_id, rank."""
    q, c = _questions(spark, d), _chunks(spark, d)
    # each list is read by several configurations: written once
    den, lex = checkpoint(_dense(spark, d)), checkpoint(_lexical(spark, d))
    weighted = checkpoint(fusion.hybrid(fusion.classified(q), den, lex, c))
    parts = {"dense": den, "bm25": lex, "unweighted": fusion.hybrid(fusion.unclassified(q), den, lex, c, boosts=False), "weighted": weighted, "reranked": answers.rerank(weighted, q, c)}
    out = None
    for name, p in parts.items():
        p = p.select(F.lit(name).alias("config"), "query_id", "chunk_id", "rank")
        out = p if out is None else out.unionByName(p)
    return out


def ablation_summary(spark, d):
    """Mean metrics of five configurations."""
    m = metrics.retrieval_metrics(_questions(spark, d), _five(spark, d), gold_labels(spark, d), group=("config",))
    return metrics.mean_metrics(m, ["config"])


LEXSCORE = f"round(1e0 / (1e0 + exp(-(8e0 * len(list_intersect(list_distinct({S.tokens('question')}), list_distinct({S.tokens('c.content')}))) / greatest(len(list_distinct({S.tokens('question')})), 1) - 4e0))), 9)"
RERANKED = f"rr AS (SELECT query_id, chunk_id, before, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank FROM (SELECT query_id, chunk_id, h.rank AS before, {LEXSCORE} AS score FROM hyb h JOIN qs USING (query_id) JOIN chunks c USING (chunk_id)) QUALIFY rank <= {X.RERANK_TOP_K})"
_UNWEIGHTED = f"hu AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, dense_rank ASC NULLS LAST, bm25_rank ASC NULLS LAST) AS rank FROM (SELECT *, {S.wrrf('0.5e0', '0.5e0')} AS w FROM ({S.pool()})) QUALIFY rank <= {X.TOP_K})"
FIVE = """five AS (SELECT 'dense' AS config, query_id, chunk_id, rank FROM den UNION ALL SELECT 'bm25', query_id, chunk_id, rank FROM lex UNION ALL SELECT 'unweighted', query_id, chunk_id, rank FROM hu UNION ALL SELECT 'weighted', query_id, chunk_id, rank FROM hyb UNION ALL SELECT 'reranked', query_id, chunk_id, rank FROM rr)"""
SQL["ablation_summary"] = f"""WITH {_hybrid_sql(CLASSED, True)}, {RERANKED}, {_UNWEIGHTED}, {GOLD}, {FIVE},
{_metrics_sql('five', 'config')} SELECT config, {', '.join(f'round(avg({m}_{k}), 4) AS {m}_{k}' for k in X.METRIC_KS for m in ('recall', 'precision', 'ndcg'))}, round(avg(mrr), 4) AS mrr FROM met GROUP BY config"""


def rerank_lexical(spark, d):
    """The five best of every question's hybrid ranking by the pair scorer."""
    return answers.rerank(hybrid_topk(spark, d), _questions(spark, d), _chunks(spark, d))


SQL["rerank_lexical"] = f"WITH {_hybrid_sql(CLASSED, True)}, {RERANKED} SELECT * FROM rr"


def encode_texts(spark, d):
    """The offline encoder's vectors of all questions, with the query prefix, one row a dimension."""
    return _query_vectors(spark, d).select("query_id", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.round(F.col("x").cast("double"), 6))


SQL["encode_texts"] = f"WITH {VECS} SELECT id AS query_id, unnest(range({X.ENCODER_DIM})) AS dim, round(CAST(unnest(embedding) AS DOUBLE), 6) AS x FROM qv"


def queries() -> dict:
    return {k: f for k, f in globals().items() if callable(f) and not k.startswith("_") and getattr(f, "__module__", "") == __name__ and k != "queries"}
