"""Word lists, patterns, constants and formats that results depend on.

Every list is stated plainly and in the order in which it is tried.
"""

# White space as Unicode knows it, in a form that Java and RE2 read alike.
WS = r"[\s\x{0085}\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# Tokeniser.
STOP_WORDS = ["a", "an", "the", "is", "it", "in", "on", "at", "to", "for", "of", "and", "or", "be", "was", "were", "are", "has", "have", "had", "this", "that", "with", "from", "as", "by", "its"]
TOKEN_ALTERNATIVES = [
    rf"\${WS}*[\p{{Nd}},.]+{WS}*(?:billion|bn|million|mn|thousand)",
    r"\$[\p{Nd},.]+[bmk]",
    rf"[\p{{Nd}},.]+{WS}*(?:percent|percentage{WS}+points?)",
    r"[\p{Nd},.]+%",
    rf"q[1-4]{WS}*fy\p{{Nd}}{{4}}",
    r"fy\p{Nd}{4}",
    r"q[1-4]",
    r"[\p{L}\p{N}_]+",
]
TOKEN = "|".join(TOKEN_ALTERNATIVES)

# BM25 (the library's defaults) and rank fusion.
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
TOP_K, RERANK_TOP_K, COMPANY_TOP_K, DEPTH_LIMIT = 20, 5, 10, 10000
TABLE_BOOST, DOMAIN_BOOST = 0.003, 0.006
TABLE_BOOST_TYPES = ["numerical", "comparison", "cross_company"]
METRIC_TERMS = ["total revenue", "revenue", "net sales", "sales", "net income", "operating income", "gross profit", "gross margin", "earnings", "eps", "cash flow"]
STATEMENT_TERMS = ["income statements", "income statement", "summary results of operations", "results of operations", "consolidated statements", "statement of operations", "financial statements"]
DISTRACTOR_TERMS = ["unearned revenue", "deferred revenue", "revenue recognition", "revenue guidance", "remaining performance obligations"]

# Query classes (weight of the dense list, of the lexical list) and their patterns, tried in order.
WEIGHTS = {"factual": (0.5, 0.5), "numerical": (0.3, 0.7), "comparison": (0.5, 0.5), "chart_trend": (0.7, 0.3), "cross_company": (0.5, 0.5)}
DEFAULT_COMPANIES = ["tesla", "apple", "microsoft", "nvidia", "amazon", "google", "meta", "alphabet", "netflix", "salesforce"]
CROSS_COMPANY_PATTERNS = [r"\bwhich company\b", r"\bacross companies\b", r"\ball companies\b", r"\b(highest|lowest|best|worst)\b.{0,40}\b(company|companies|among)\b", r"\bcompare\b.{0,80}\band\b.{0,80}\b(revenue|income|profit|margin|sales)\b"]
COMPARISON_PATTERNS = [r"\bcompare\b.{0,60}\b(q[1-4]|quarter|fy|year|annual|h[12])\b", r"\b(vs\.?|versus)\b", r"\byear.{0,10}over.{0,10}year\b", r"\bq[1-4]\s+\d{4}.{0,40}q[1-4]\s+\d{4}\b", r"\b(changed|change|differ|difference|growth|decline)\b.{0,40}\b(compared|relative|against|from|since)\b", r"\b(q[1-4]|quarter|fy|fiscal\s+year).{0,20}(q[1-4]|quarter|fy)\b"]
NUMERICAL_PATTERNS = [r"\bhow much\b", r"\bwhat\s+(was|is|were)\b.{0,80}\b(revenue|income|profit|loss|margin|eps|ebitda|sales|cost|expense|cash|total)\b", r"\b(total|net|gross|operating)\b.{0,20}\b(revenue|income|profit|loss|margin|eps|ebitda)\b", r"\$\s*[\d,]+", r"\b\d{1,3}(?:,\d{3})*(?:\.\d+)?\s*(?:billion|million|thousand|bn|mn)\b", r"\bpercentage\b|\bpercent\b|\b%\b", r"\bfigure\b|\bnumber\b|\bvalue\b|\bamount\b", r"\b(fy\d{4}|q[1-4]\s*\d{4})\b", r"\bfiscal\s+year\b"]
CHART_TREND_PATTERNS = [r"\b(trend|trajectory|pattern|over time)\b", r"\b(chart|graph|figure|plot|visual)\b", r"\b(grew|declined|increased|decreased|rose|fell)\b.{0,30}\b(over|through|from|since|during)\b", r"\bhow\b.{0,30}\b(changed|evolved|trended|performed)\b", r"\b(delivery|deliveries)\b", r"\b(seasonality|seasonal|cycle)\b"]

# Number extraction and verification.
METRIC_KEYWORDS = ["revenue", "revenues", "sales", "income", "earnings", "profit", "loss", "margin", "margins", "ebitda", "ebit", "eps", "diluted", "basic", "cash", "debt", "assets", "liabilities", "equity", "capex", "fcf", "growth", "increase", "decrease", "change", "yoy", "qoq", "deliveries", "units", "shipments", "employees", "headcount", "operating", "gross", "net", "total", "segment", "geographic"]
PAREN_NUMBER = r"\((\$\s*)?([0-9,]+(?:\.[0-9]+)?)\s*(billion|million|thousand|bn|mn|[bBmMkK](?!\w))?\s*(%?)\)"
PLAIN_NUMBER = r"(?<!\w)(\$\s*)?([0-9,]+(?:\.[0-9]+)?)\s*(billion|million|thousand|bn|mn|[bBmMkK](?!\w))?\s*(%)?(?!\d)"
MULTIPLIERS = {"b": 1e9, "bn": 1e9, "billion": 1e9, "m": 1e6, "mn": 1e6, "million": 1e6, "k": 1e3, "thousand": 1e3}
TOLERANCE, UNVERIFIABLE_FROM, CONTEXT_CHARS = 0.02, 0.5, 60

MISMATCH_METRIC = "{raw} matches evidence value {closest:.4g} numerically but metric context differs (answer: {answer}, evidence: {evidence}). Possible metric substitution."
MISMATCH_VALUE = "Answer states {raw} (\u2248{value:.4g}) but closest evidence value is {closest:.4g} ({percent:.1f}% difference)."

# Chunking and element parsing.
MAX_WORDS, OVERLAP_WORDS, TABLE_MAX_WORDS, MIN_CHARS, ROW_GROUP = 512, 64, 1024, 30, 20
SENTENCE_SPLIT = r"(?<=[.!?])\s+"
PARAGRAPH_SPLIT = r"\n{2,}"
HEADING = r"^(?:(?:\d+[.)]?\s+)?(?:results\s+of\s+operations|financial\s+(highlights|results|statements)|revenue|net\s+income|gross\s+profit|operating|risk\s+factors|liquidity|management.{0,30}discussion|notes?\s+to|segment|overview|outlook|guidance|cash\s+flow)[^\n]{0,120})"
HEADING_MAX, SECTION_MAX, MIN_BLOCK, MIN_AREA = 200, 80, 10, 0.02
METRIC_KS = [1, 3, 5, 10]
# Display of answers.
BULLET, SOURCES, WARNINGS = "  \u2022 ", "**Sources:**", "\u26a0\ufe0f **Numerical Verification Warnings:**"
ENCODER_DIM = 64
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
EN_DASH = "–"
