"""Splitting, repeated lines, leaks, mixing, truncation."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyvane.llm import leaks as L
from tallyvane.llm import mixing as M
from tallyvane.llm import repeated as R
from tallyvane.llm import splitting as S
from tallyvane.llm import truncation as T

CH = "chunk_id string, chunk_type string, content string, extra int"
EL = "element_id bigint, element_type string, content string, grid array<array<string>>, document string, ingested_at timestamp"
LIM = "record_kind string, item_type string, max_chars int, overlap_chars int"


def tables(spark):
    r = random.Random(1)
    long = "".join(r.choice(["Word ", "two. ", "Line\n", "par\n\n", "x" * 50]) for _ in range(40_000))
    chunks = spark.createDataFrame([("a", "text", "short", 1), ("b", "text", long, 1), ("c", "table", "| a | b |\n" * 50, 1), ("d", "chart", long, 1), ("e", "text", None, 1), ("f", "text", "y" * 950, 1), ("b2", "text", long, 1)], CH)
    grid = [["h", None]] + [["row", "cell " * 30]] * 20 + [None]
    els = spark.createDataFrame([(1, "text", "w " * 300, None, "D", None), (1, "text", "w " * 300, None, "D", None), (2, "table", None, grid, "D", None), (3, "table", None, None, "D", None), (4, "table", None, [], "D", None), (5, "text", "", None, "D", None)], EL)
    lim = spark.createDataFrame([("chunk", "text", 300, 40), ("chunk", "table", 100, 0), ("element", "text", 200, 20), ("element", "table", 120, 0)], LIM)
    return chunks, els, lim


def test_pieces(spark):
    chunks, els, lim = tables(spark)
    big = S.oversized(chunks, els, lim)
    items = {(r.record_kind, r.record_id): r for r in big.withColumn("x", F.coalesce("t", S.grid_text(F.col("g")))).collect()}
    assert set(items) == {("chunk", "b"), ("chunk", "b2"), ("chunk", "c"), ("chunk", "f"), ("element", "1"), ("element", "2")}
    by = defaultdict(list)
    for p in S.piece_texts(big).collect():
        by[p.record_kind, p.record_id].append(p)
    for k, ps in by.items():
        i = items[k]
        ps.sort(key=lambda p: p.piece_no)
        assert [p.piece_no for p in ps] == list(range(len(ps))) and ps[0].start_char == 0 and ps[-1].end_char == i.size == len(i.x)
        assert all(p.end_char - p.start_char <= i.max_chars and p.piece == i.x[p.start_char : p.end_char] for p in ps)
        assert all(q.start_char == p.end_char - i.overlap_chars and q.end_char > p.end_char for p, q in zip(ps, ps[1:]))
    assert all(p.piece.endswith("\n") for p in by["chunk", "c"][:-1])
    assert set(by) == set(items) == {(r.record_kind, r.record_id) for r in S.split_found(chunks, els, lim).collect()}
    assert S.split_found(chunks.limit(0), els.limit(0), lim).count() == 0


def test_cuts_only_where_there_is_no_boundary(spark):
    """No hard cut and no broken sentence where a boundary lies within the reach of a cut; a text of many ranges is cut
    as one of a single range is."""
    r = random.Random(8)
    text = "".join(r.choice(["Word and more. ", "two, ", "line\n", "x" * r.randint(1, 90), " ", "y" * 260]) for _ in range(9000))
    size, most, overlap = len(text), 200, 30
    found = S.boundaries(text, False)
    df = spark.createDataFrame([("chunk", "big", "text", size, most, overlap, text, None)], "record_kind string, record_id string, item_type string, size bigint, max_chars int, overlap_chars int, t string, g array<array<string>>")
    cuts = [p.end_char for p in sorted(S.pieces(df).collect(), key=lambda p: p.piece_no)]
    assert size > 3 * S.RANGE and cuts[-1] == size
    for a, b in zip([0] + cuts, cuts[:-1]):
        near = [p for p in found if a + (overlap if a == 0 else 0) < p <= a + (most if a == 0 else most - overlap)]
        assert b in found or not near
        assert found.get(b, 0) >= S.STRONG or not any(found[p] >= S.STRONG for p in near if p > a + max((most if a == 0 else most - overlap) // 8, overlap if a == 0 else 0))
    step = S.plan(most, overlap)[1]
    at = dict(found) | {p: found.get(p, 0) for p in range(step, size, step)}
    places = sorted(p for p in at if 0 < p < size)
    assert S.range_table(places, [at[p] for p in places], 0, size, size, most, overlap)[1][0] == cuts


def test_split_file(spark, tmp_path):
    r = random.Random(2)
    t = "".join(r.choice(["word ", "日本語。", "é" * 9 + "\n", "emoji 😀 ", "\n\n", "z" * 300]) for _ in range(3000))
    (tmp_path / "f.txt").write_text(t)
    raw = t.encode()
    ps = sorted(S.split_file(spark, str(tmp_path / "f.txt"), 500, 60, range_bytes=4000).collect(), key=lambda p: p.piece_no)
    assert ps[0].start_byte == 0 and ps[-1].end_byte == len(raw)
    out = b""
    for a, b in zip([None] + ps, ps):
        raw[b.start_byte : b.end_byte].decode()
        assert b.end_byte - b.start_byte <= 500
        if a:
            assert a.end_byte - 64 <= b.start_byte <= a.end_byte - 60
        out += raw[max(b.start_byte, a.end_byte if a else 0) : b.end_byte]
    assert out == raw
    (tmp_path / "e.txt").write_text("")
    assert S.split_file(spark, str(tmp_path / "e.txt"), 500).count() == 0
    with pytest.raises(ValueError):
        S.plan(10, 9)


def test_repeated_lines_against_brute_force(spark):
    r = random.Random(3)
    man = [(f"d{i}", "big" if i < 30 else "small" if i < 36 else None) for i in range(40)]
    common = ["All rights reserved", "ALL RIGHTS reserved!", "Page 1", "12345", "Share this", "rare line"]
    els = []
    for i in range(200):
        lines = [r.choice(common[:5]) if r.random() < 0.5 else f"line {r.random()} {'abcdefgh'[r.randrange(8)] * r.randint(1, 9)}" for _ in range(r.randint(0, 5))]
        els.append((i, "text", r.choice(["\n", "\r\n"]).join(lines), None, f"d{r.randrange(42)}", None))
    els += els[:20] + [(900, "text", None, None, "d1", None), (901, "text", "x", None, None, None), (902, "table", "All rights reserved", None, "d2", None), (903, "text", "", None, "d3", None)]
    company = {d: c for d, c in man if c}
    docs = {e[4] for e in els if e[4] in company}
    where = defaultdict(set)
    key = lambda s: "".join(c for c in s.lower() if c.isalpha())
    import re

    lines = {(e[0], n): (company[e[4]], e[4], key(x)) for e in els if e[1] == "text" and e[2] is not None and e[4] in company for n, x in enumerate(re.split("\r\n|\n", e[2])) if key(x)}
    for c, d, k in lines.values():
        where[c, k].add(d)
    size = {c: sum(company[d] == c for d in docs) for c in set(company.values())}
    want = {i for i, (c, d, k) in lines.items() if len(where[c, k]) >= 4 and len(where[c, k]) * 5 >= size[c] * 2}
    edf, mdf = spark.createDataFrame(els, EL), spark.createDataFrame(man, "document string, company string")
    found = R.repeated_lines(edf, mdf)
    got = [(x.element_id, x.line_no) for x in found.collect()]
    assert want and set(got) == want and len(got) == len(want)
    clean = {x.element_id: x.content for x in R.without_lines(edf.dropDuplicates(["element_id"]), found).collect()}
    src = {e[0]: e[2] for e in els}
    for i, t in clean.items():
        if src[i] is None or not any(a == i for a, _ in want):
            assert t == src[i]
        else:
            assert t == "\n".join(x for n, x in enumerate(re.split("\r\n|\n", src[i])) if (i, n) not in want)
    assert R.repeated_lines(edf.limit(0), mdf).count() == 0


@pytest.mark.parametrize("bound", [1_000_000, 20])
def test_leaks_against_brute_force(spark, bound):
    r = random.Random(4)
    item = ["".join(r.choice("abcdefgh 1,") for _ in range(150)) for _ in range(5)]
    docs = []
    for i in range(60):
        t = r.choice(item)
        a = r.randrange(100)
        docs.append((i, "junk " * r.randint(0, 400) + t[a : a + r.randint(10, 150)].upper().replace(" ", "\n") + " tail" * r.randint(0, 50)))
    docs += [(100, None), (101, ""), (102, docs[0][1])]
    items = list(enumerate(item)) + [(8, None), (9, item[0]), (10, "short")]
    sq = L.squeeze
    want = {(d, i) for d, t in docs if t for i, u in items if u and any(sq(u)[k : k + 60] in sq(t) for k in range(len(sq(u)) - 59))}
    got = [(x.doc_id, x.item_id) for x in L.leaks_found(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), block_seeds=bound).collect()]
    assert want and set(got) == want and len(got) == len(want)


def test_alignment():
    def plain(a, b):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1][j + 1] = max(0, h[i][j] + (2 if a[i] == b[j] else -1), h[i][j + 1] - 2, h[i + 1][j] - 2)
        return max(map(max, h))

    r = random.Random(5)
    for _ in range(30):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 20))) for _ in "xy")
        assert L.smith_waterman(a, b) == plain(a, b)


def test_shortness_follows_from_the_mix(spark):
    """A source is short if the sampled mix spends all its documents and stays below the target; same as the budget."""
    r = random.Random(16)
    for _ in range(3):
        n = {s: r.randint(1, 40) for s in "abcde"}
        docs = [(k * 100 + i, "word " * r.randint(1, 30), s) for k, s in enumerate(n) for i in range(n[s])] + [(900, "", "f"), (901, None, "g")]
        share = {s: r.random() for s in "abcdefgh"}
        targets = spark.createDataFrame([(s, x / sum(share.values()), r.randint(1, 3)) for s, x in share.items()], "source string, target_share double, max_repeats int")
        tokens = M.document_tokens(spark.createDataFrame(docs, "doc_id bigint, text string, source string"))
        want = {x.source for x in M.source_budget(tokens, targets).where("not reachable").collect()}
        assert {x.source for x in M.short_sources(tokens, targets).collect()} == want and {"f", "g", "h"} <= want


def test_mixing(spark):
    r = random.Random(6)
    docs = [(i, "word " * r.randint(1, 60), "big" if i < 900 else "small" if i < 960 else "spare") for i in range(1000)] + [(2000, None, "big"), (2001, "", "small"), (2002, "word", None)]
    targets = spark.createDataFrame([("big", 0.5, 3), ("small", 0.2, 2), ("none", 0.3, 4)], "source string, target_share double, max_repeats int")
    tokens = M.document_tokens(spark.createDataFrame(docs, "doc_id bigint, text string, source string"))
    b = {x.source: x for x in M.source_budget(tokens, targets).collect()}
    assert b["none"].tokens == 0 and not b["none"].reachable and b["big"].reachable
    mix = M.systematic_mix(tokens, targets)
    rows = mix.collect()
    assert all(x.copies <= {"big": 3, "small": 2}[x.source] for x in rows) and len({x.doc_id for x in rows}) == len(rows) and not any(x.tokens == 0 for x in rows)
    for s in ("big", "small"):
        want = b[s].tokens * b[s].copies
        assert sum(x.tokens * x.copies for x in rows if x.source == s) == pytest.approx(want, rel=0.03)
    rep = {x.source: x for x in M.mix_report(mix, targets).collect()}
    assert rep["none"].mix_tokens == 0 and sum(x.actual_share for x in rep.values()) == pytest.approx(1)
    assert sorted(x.doc_id for x in M.systematic_mix(tokens, targets).collect()) == sorted(x.doc_id for x in rows)


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_tokenizers(name):
    n = M.encoder(name)(["hello world", "", "<|endoftext|>"])
    assert n[0] >= 2 and n[1] == 0 and n[2] > 1


def corpus(n=1500, seed=7):
    r = random.Random(seed)
    nouns, verbs = ["Revenue", "Margin", "Demand", "Backlog"], ["rose", "fell", "eased", "held up"]
    s = lambda: r.choice([f"{r.choice(nouns)} at Vornal {r.choice(verbs)} by {r.randint(1, 99)} percent.", f"Mr. Selkan met Dr. Torvik at approx. {r.randint(1, 9)} sites.", f'"{r.choice(nouns)} held up. Costs fell," said the chair.'])
    docs, cut = [], set()
    for i in range(n):
        t = " ".join(s() for _ in range(r.randint(3, 9)))
        if r.random() < 0.1:
            k = r.randint(len(t) // 2, len(t) - 2)
            while t[k - 1] in ".!" and not t[:k].endswith(("approx.", "Mr.", "Dr.", "up.")) or t[:k].rstrip().endswith("percent"):
                k -= 1
            t = t[:k] + r.choice(["", "", "…", " [...]"])
            cut.add(i)
        elif r.random() < 0.15:
            t += r.choice(["\nAll rights reserved", f"\nRef. Vornal-{r.randint(1, 99)}"])
        docs.append((i, t, r.choice(["en", "EN", None, "en-US"])))
    return docs, cut


def test_truncation(spark):
    docs, cut = corpus()
    df = spark.createDataFrame(docs + [(9000, None, "en"), (9001, "", "en"), (9002, " \n", "en")], "doc_id bigint, text string, lang string")
    got = {x.doc_id for x in T.truncated(df).where("cut").collect()}
    tp = len(got & cut)
    assert tp / len(cut) > 0.93 and tp / len(got) > 0.93
    assert T.truncated(df.limit(0)).count() == 0


def test_language_codes(spark):
    df = spark.createDataFrame([(x,) for x in ["en", "EN", "eng", "en-US", "jp", "zh-CN", None, ""]], "l string")
    assert [r.x for r in df.select(T.language(F.col("l")).alias("x")).collect()] == ["en", "en", "en", "en", "ja", "zh", "und", "und"]


def test_clashing_extra_columns(spark):
    """Columns of the names that the operators use inside do no harm."""
    names = ["t", "k", "n", "g", "l", "h", "company", "tokens", "n_docs", "size", "word", "a", "b", "key", "tail", "d1", "line", "doc_no", "copies", "marked"]

    def clash(df):
        for c in names:
            if c not in df.columns:
                df = df.withColumn(c, F.lit("x"))
        return df

    chunks, els, lim = tables(spark)
    assert S.split_found(clash(chunks), clash(els), clash(lim)).count() == 6
    man = spark.createDataFrame([("D", "Co")], "document string, company string")
    assert R.repeated_lines(clash(els), clash(man)).count() == 0
    docs = spark.createDataFrame([(1, "some text here.", "s", "en")], "doc_id bigint, text string, source string, lang string")
    targets = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    mix = M.systematic_mix(M.document_tokens(clash(docs)), clash(targets))
    assert M.mix_report(mix, clash(targets)).count() == 1
    assert T.truncated(clash(docs)).count() == 1
    assert L.leaks_found(clash(docs), clash(spark.createDataFrame([(1, "x" * 80)], "item_id bigint, text string"))).count() == 0


def test_context_counts_against_brute_force(spark):
    import numpy as np

    r = random.Random(1)
    texts = ["".join(r.choice("ab .") for _ in range(r.randint(1, 60))) for _ in range(2000)]
    df = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "d bigint, l string, t string").where("trim(t) <> ''")
    keys = T._end_contexts(df).select(F.explode("h").alias("h")).distinct()
    got = {x.h: x.n_on for x in T._continuations(df, keys).collect()}
    want: dict[int, int] = defaultdict(int)
    h = T.Hasher()
    for t in texts:
        s = T.mask(t.rstrip())
        p = h.prefix(s)
        for pos in range(1, len(s)):
            ks = np.array([k for k in T.ORDERS if k <= pos])
            for x in h.at(p, np.full(len(ks), pos), ks).view(np.int64).tolist():
                want[x] += 1
    assert all(got.get(x.h, 0) == want[x.h] for x in keys.collect())


def test_end_contexts_of_long_list_items(spark):
    """Every order's context at the end of a text is that of the whole masked text, however long its last line."""
    import numpy as np

    words = " ".join(["revenue and margin"] * 120)
    texts = ["Intro.\n- " + words[:n] for n in (100, 400, 790, 2000)] + [words, "One line.\n" + words + " \r\n" + "\n" * 900, "Short."]
    df = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "d bigint, l string, t string")
    got = {x.d: x.h for x in T._end_contexts(df).collect()}
    assert T.ORDERS == (1, 2, 3, 4, 6, 8, 10, 12, 16, 20, 24, 32)
    h = T.Hasher()
    for i, t in enumerate(texts):
        s = T.mask(t.rstrip())
        ks = np.array([k for k in T.ORDERS if k <= len(s)])
        assert got[i] == h.at(h.prefix(s), np.full(len(ks), len(s)), ks).view(np.int64).tolist()


def test_code_words_at_the_end_of_a_text_that_has_one_at_its_start(spark):
    """What tells that a text has code words counts for its end too, however far before it stands."""
    import numpy as np

    texts = ["Order ACME-2024 was filed.\n" + "The plan was approved by the board.\n" * n + "See section AB-1" for n in (2, 8, 30, 200)]
    df = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "d bigint, l string, t string")
    got = {x.d: x.h for x in T._end_contexts(df).collect()}
    h = T.Hasher()
    for i, t in enumerate(texts):
        s = T.mask(t)
        assert s.endswith("section Q")
        assert got[i] == h.at(h.prefix(s), np.full(len(T.ORDERS), len(s)), np.array(T.ORDERS)).view(np.int64).tolist()


def test_masked_ends_by_windows(monkeypatch):
    """The end of a masked text comes from a window of it, the same as from the whole."""
    r = random.Random(4)
    words = ["Vornal", "Van", "Ltd", "  ", "\n", " \n ", "- ", "• ", "1. ", "12) ", "A. ", "AB-12", "X-1", "revenue", "and", "the", "2024", "McDonald", "Smith. ", "東京。", "\t", "–", "_", "a", " " * 300, "Q" * 300, "7" * 300, "- long item of " + "words " * 60]
    for _ in range(3000):
        t = "".join(r.choice(words) + r.choice(["", " "]) for _ in range(r.randint(0, 150))).rstrip()
        assert T.masked_end(t, bool(T._CODE_HINT.search(t))) == T.mask(t)[-32:]
    read, mask = [], T.mask
    monkeypatch.setattr(T, "mask", lambda t, *a: read.append(len(t)) or mask(t, *a))
    T.masked_end("The plan was approved by the board.\n" * 100, False)
    assert sum(read) < 250


@pytest.mark.parametrize("bound", [1_000_000, 20])
def test_scores_cover_all_windows(spark, bound):
    """A full or edited copy behind an early short quotation is scored whole, whatever the number of seeds."""
    r = random.Random(8)
    item = "".join(r.choice("abcdefgh") for _ in range(300))
    junk = "".join(r.choice("xyz") for _ in range(5000))
    docs = [(1, item[100:170] + junk + item + junk), (2, item[:130] + "xyz" * 15 + item[130:]), (3, junk + item[:150] + junk + item[150:])]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(7, item)], "item_id bigint, text string")
    got = {x.doc_id: x.score for x in L.leak_pairs(d, i, block_seeds=bound).collect()}
    assert got == {k: L.smith_waterman(item, s) for k, s in docs} and got[1] == 600 and got[2] == 510


def test_a_remnant_is_no_verdict(spark):
    """Whole closing lines that look like a cut's remnant stay; texts cut inside a sentence are found with and without."""
    docs, _ = corpus()
    closing = ["Managed by R&D", "Contact: AT&T", "Signed, P&L", "The filing is complete. [more]"]
    body = "The plan was approved by the board. "
    docs += [(70_000 + 10 * k + j, body * (j + 2) + "\n" + c) for k, c in enumerate(closing) for j in range(8)]
    cut = [(80_000 + i, body * 3 + "The plan was appro" + m) for i, m in enumerate(["…", " [...]", "&am", "<b", "�", ""])]
    df = spark.createDataFrame([(i, t, "en") for i, t in [(d[0], d[1]) for d in docs] + cut], "doc_id bigint, text string, lang string")
    got = {x.doc_id for x in T.truncated(df).where("cut").collect()}
    assert {i for i, _ in cut} <= got and not {i for i in got if 70_000 <= i < 80_000}
    assert all(T.MARK.search(x) is None for x in ("Managed by R&D", "Contact: AT&T", "Signed, P&L")) and T.MARK.search("half&am") and T.MARK.search("x &#8")


def test_latest_delivery_counts(spark):
    """A line that only an earlier delivery held is no case, however many elements were delivered twice."""
    man = spark.createDataFrame([(f"d{i}", "co") for i in range(5)], "document string, company string")
    rows = [(i, "text", "Old notice\nbody %d" % i, f"d{i}", 1) for i in range(5)] + [(i, "text", "New notice\nbody %d" % i, f"d{i}", 2) for i in range(5)]
    els = spark.createDataFrame(rows, "element_id bigint, element_type string, content string, document string, at int").withColumn("ingested_at", F.timestamp_seconds("at"))
    want = {(i, n) for i in range(5) for n in (0, 1)}
    for most in (100_000, 0):
        kept = R.current(els, most=most)
        assert {(r.element_id, r.content[:3]) for r in kept.collect()} == {(i, "New") for i in range(5)}
    assert {(r.element_id, r.line_no) for r in R.repeated_lines(els, man).collect()} == want
    text = {r.element_id: r.content for r in R.without_lines(R.latest(els, "element_id", "ingested_at"), R.repeated_lines(els, man).where("line_no = 0")).collect()}
    assert text == {i: f"body {i}" for i in range(5)}
    long = spark.createDataFrame([(1, "\n".join(str(i) for i in range(200)))], "element_id bigint, content string")
    gone = spark.createDataFrame([(1, n) for n in (0, 63, 64, 127, 199)], "element_id bigint, line_no bigint")
    assert R.without_lines(long, gone).first().content == "\n".join(str(i) for i in range(200) if i not in (0, 63, 64, 127, 199))
