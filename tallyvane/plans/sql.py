"""SQL texts (for another engine) of the building blocks, composed into the queries' counterparts."""

from __future__ import annotations

from tallyvane.functions import fixed as X


def quoted(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def canonical(t: str) -> str:
    s = rf"regexp_replace({t}, '(?:,|{X.WS})', '', 'g')"
    for words, letter in (("billion|bn", "b"), ("million|mn", "m"), ("thousand", "k")):
        s = rf"regexp_replace({s}, '^\$([\p{{Nd}}.]+)(?:{words})$', '$\1{letter}')"
    return rf"regexp_replace({s}, '^([\p{{Nd}}.]+)percent.*$', '\1%')"


def tokens(text: str) -> str:
    return f"[y for y in [{canonical('x')} for x in regexp_extract_all(lower(coalesce({text}, '')), '{X.TOKEN}')] if length(y) > 1 and not list_contains({quoted(X.STOP_WORDS)}, y)]"


def bm25(corpus: str, queries: str, k: int | None = X.TOP_K, name: str = "lex") -> str:
    """CTEs ending in `name`(query_id, chunk_id, ord, score, rank); corpus gives chunk_id, ord, content and queries query_id, query."""
    top = f"rank <= {k} AND " if k else ""
    return f"""
{name}_c AS (SELECT chunk_id, ord, {tokens('content')} AS terms FROM ({corpus})),
{name}_s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(CAST(len(terms) AS DOUBLE)) AS avgdl FROM {name}_c),
{name}_p AS (SELECT chunk_id, ord, dl, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT chunk_id, ord, CAST(len(terms) AS DOUBLE) AS dl, unnest(terms) AS term FROM {name}_c) GROUP BY ALL),
{name}_r AS (SELECT term, ln((SELECT n FROM {name}_s) - count(*) + 0.5e0) - ln(count(*) + 0.5e0) AS w FROM {name}_p GROUP BY term),
{name}_i AS (SELECT term, CASE WHEN w < 0 THEN {X.BM25_EPSILON}e0 * (SELECT avg(w) FROM {name}_r) ELSE w END AS idf FROM {name}_r),
{name}_q AS (SELECT query_id, term, CAST(count(*) AS DOUBLE) AS qtf FROM (SELECT query_id, unnest({tokens('query')}) AS term FROM ({queries})) GROUP BY ALL),
{name}_h AS (SELECT query_id, chunk_id, ord, round(sum(qtf * idf * tf * {X.BM25_K1 + 1}e0 / (tf + {X.BM25_K1}e0 * (1e0 - {X.BM25_B}e0 + {X.BM25_B}e0 * dl / (SELECT avgdl FROM {name}_s)))), 9) AS score FROM {name}_q JOIN {name}_i USING (term) JOIN {name}_p USING (term) GROUP BY ALL),
{name}_k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS rank FROM {name}_h),
{name} AS (SELECT * FROM {name}_k WHERE {top}score > 0)"""


HEX = "'0123456789abcdef'"


def vectors(texts: str, name: str, dim: int = X.ENCODER_DIM) -> str:
    """CTEs ending in `name`(id, embedding): the offline encoder's vectors of texts giving id and t."""
    digit = lambda i: f"(strpos({HEX}, substr(m, {i}, 1)) - 1)"
    return f"""
{name}_t AS (SELECT id, {tokens('t')} AS ts FROM ({texts})),
{name}_d AS (SELECT id, dim, sum(s) AS s FROM (SELECT id, ({digit(1)} * 16 + {digit(2)}) % {dim} AS dim, CASE WHEN {digit(3)} % 2 = 0 THEN 1e0 ELSE -1e0 END AS s FROM (SELECT id, md5(t) AS m FROM (SELECT id, unnest(ts) AS t FROM {name}_t))) GROUP BY ALL),
{name}_n AS (SELECT id, sqrt(sum(s * s)) AS n FROM {name}_d GROUP BY id),
{name} AS (SELECT k.id, array_agg(coalesce(CAST(s / nullif(n, 0) AS FLOAT), CAST(0 AS FLOAT)) ORDER BY k.dim) AS embedding FROM (SELECT id, unnest(range({dim})) AS dim FROM {name}_t) k LEFT JOIN {name}_d d ON d.id = k.id AND d.dim = k.dim LEFT JOIN {name}_n n ON n.id = k.id GROUP BY k.id)"""


def dense(corpus: str, queries: str, k: int | None = X.TOP_K, name: str = "den") -> str:
    """CTEs ending in `name`(query_id, chunk_id, ord, score, rank); both inputs give embedding."""
    top = f"WHERE rank <= {k}" if k else ""
    return f"""
{name}_h AS (SELECT query_id, chunk_id, ord, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 9) AS score FROM ({queries}) q, ({corpus}) c),
{name}_k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS rank FROM {name}_h),
{name} AS (SELECT * FROM {name}_k {top})"""


def any_pattern(text: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, '(?i){p}')" for p in patterns) + ")"


def query_class(q: str, pair: str = "false") -> str:
    t = f"trim(coalesce({q}, ''))"
    return f"CASE WHEN {any_pattern(t, X.CROSS_COMPANY_PATTERNS)} OR {pair} THEN 'cross_company' WHEN {any_pattern(t, X.COMPARISON_PATTERNS)} THEN 'comparison' WHEN {any_pattern(t, X.NUMERICAL_PATTERNS)} THEN 'numerical' WHEN {any_pattern(t, X.CHART_TREND_PATTERNS)} THEN 'chart_trend' ELSE 'factual' END"


def named_pair(q: str) -> str:
    """Two of the default names within 80 characters."""
    alt = "|".join(X.DEFAULT_COMPANIES)
    span = f"lower(regexp_extract({q}, '(?i)(?:{alt}).{{0,80}}(?:{alt})'))"
    return f"len([c for c in {quoted(X.DEFAULT_COMPANIES)} if contains({span}, c)]) >= 2"


def weight(kind: str, side: int) -> str:
    return "CASE " + kind + " " + " ".join(f"WHEN '{k}' THEN {w[side]}e0" for k, w in X.WEIGHTS.items()) + " END"


def wrrf(wd: str = "w_dense", wb: str = "w_bm25") -> str:
    return f"round(coalesce({wd} / ({X.RRF_K}e0 + dense_rank), 0e0) + coalesce({wb} / ({X.RRF_K}e0 + bm25_rank), 0e0), 9)"


def pool(d: str = "den", b: str = "lex") -> str:
    return f"SELECT coalesce(d.query_id, b.query_id) AS query_id, coalesce(d.chunk_id, b.chunk_id) AS chunk_id, coalesce(d.ord, b.ord) AS ord, d.rank AS dense_rank, b.rank AS bm25_rank FROM {d} d FULL OUTER JOIN {b} b ON d.query_id = b.query_id AND d.chunk_id = b.chunk_id"


def table_boost(kind: str = "query_class", chunk_type: str = "chunk_type") -> str:
    return f"CASE WHEN list_contains({quoted(X.TABLE_BOOST_TYPES)}, {kind}) AND {chunk_type} = 'table' THEN {X.TABLE_BOOST}e0 ELSE 0e0 END"


def domain_boost(question: str = "question", content: str = "content", section: str = "section", chunk_type: str = "chunk_type") -> str:
    b = X.DOMAIN_BOOST
    q, c, s = f"lower({question})", f"lower(coalesce({content}, ''))", f"lower(coalesce({section}, ''))"
    some = lambda ts: f"len([t for t in {quoted(ts)} if contains({c}, t) OR contains({s}, t)]) > 0"
    return (
        f"(len([t for t in {quoted(X.METRIC_TERMS)} if contains({q}, t) AND (contains({c}, t) OR contains({s}, t))]) * {b}e0"
        f" + CASE WHEN len([y for y in regexp_extract_all({q}, '\\b((?:19|20)\\d{{2}})\\b', 1) if contains({c}, y)]) > 0 THEN {b}e0 ELSE 0e0 END"
        f" + CASE WHEN {some(X.STATEMENT_TERMS)} THEN {b}e0 ELSE 0e0 END + CASE WHEN {chunk_type} = 'table' THEN {b * 0.5}e0 ELSE 0e0 END"
        f" - CASE WHEN {some(X.DISTRACTOR_TERMS)} THEN {b * 1.5}e0 ELSE 0e0 END)"
    )


def cut(score: str = "score") -> str:
    return f"row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, dense_rank ASC NULLS LAST, bm25_rank ASC NULLS LAST)"
