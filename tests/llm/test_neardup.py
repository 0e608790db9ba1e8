"""BagMinHash and near-duplicate pairs against brute force."""

import random

import numpy as np
import pytest

from tallyvane.llm import neardup as N


def test_signatures_are_unbiased():
    r = np.random.default_rng(1)
    est, true = [], []
    for _ in range(150):
        h = np.unique(r.integers(0, 2**63, 200).astype(np.uint64))
        a = r.uniform(0.2, 9, len(h))
        b = np.maximum(0.1, a + r.uniform(-3, 3, len(h)))
        s = N.bag_minhash([h, h], 128, [a, b])
        est.append((s[0] == s[1]).mean())
        true.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(est) - np.mean(true)) < 0.01


def texts(seed, n=120):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(r.choices(words, k=60)) for _ in range(12)]
    out = []
    for i in range(n):
        w = r.choice(base).split()
        for _ in range(r.randint(0, 12)):
            w[r.randrange(len(w))] = r.choice(words)
        out.append((f"t{i:03d}", " ".join(w)))
    return out + [("x1", "abc"), ("x2", "abc"), ("n", None), ("e1", ""), ("e2", "")]


@pytest.mark.parametrize("weighted", [False, True])
def test_pairs_against_brute_force(spark, weighted):
    rows = texts(4)
    cut = {k: np.unique(N.char_shingles(t), return_counts=True) for k, t in rows if t}
    want = set()
    for a in cut:
        for b in cut:
            if a < b:
                (p, wp), (q, wq) = cut[a], cut[b]
                if (N.overlap(p, q, wp, wq) if weighted else N.overlap(p, q)) >= 0.7:
                    want.add((a, b))
    got = [(r.a, r.b) for r in N.similar_pairs(spark.createDataFrame(rows, "id string, t string"), weighted=weighted).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(want - set(got)) <= len(want) * 0.01


def test_groups_and_word_shingles(spark):
    t = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty " * 3
    rows = [("a", t + "end"), ("b", t + "end"), ("c", t + "fin"), ("d", "something else entirely that is long enough to be cut"), ("e", None)]
    g = {r.id: r for r in N.similar_groups(spark.createDataFrame(rows, "id string, t string"), unit="word", threshold=0.8).collect()}
    assert g["a"].class_id == g["b"].class_id == "a" and g["c"].class_id == "c" and g["a"].group_id == g["c"].group_id == "a"
    assert g["a"].n_links == 1 and g["d"].n_links == 0 and g["d"].group_id == "d" and "e" not in g
    assert N.similar_groups(spark.createDataFrame([], "id string, t string")).count() == 0


def test_normal_body(spark):
    df = spark.createDataFrame([("[H]\n A  b\r\nC ",), ("only header",), (None,)], "x string")
    assert [r.y for r in df.select(N.normal_body(df.x).alias("y")).collect()] == ["a b c", "", None]


def test_blocks_of_a_hot_bucket(spark):
    """A bucket that holds a third of all members gives the same pairs in one block and in many, each once."""
    r = random.Random(3)
    rows = [(1, i) for i in range(40)] + [(k, r.randrange(200)) for k in range(2, 40) for _ in range(r.randint(1, 4))]
    want = {(a, b) for k in {k for k, _ in rows} for a in {x for y, x in rows if y == k} for b in {x for y, x in rows if y == k} if a < b}
    df = spark.createDataFrame(rows, "k bigint, r bigint").distinct()
    for block in (1000, 7, 1):
        got = [(x.a, x.b) for x in N.candidate_pairs(df, block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("block", [1000, 70, 5])
def test_pairs_alike_by_chance_stay_in_their_bucket(spark, block):
    """Of the pairs of a bucket only those whose sketches agree come out, each once: in place, in blocks and in rounds."""
    r = np.random.default_rng(7)
    group = r.integers(0, 30, 150)
    sketches = r.integers(-(2**63), 2**63, (30, 8))[group]
    sketches[:, 0] ^= 1 << r.integers(0, 50, 150)
    keys = np.stack([r.integers(0, 2, 150), 10 + r.integers(0, 40, 150), 100 + np.arange(150)], axis=1)
    want = set()
    for a in range(150):
        for b in range(a):
            planes = sketches[a] ^ sketches[b]
            apart = sum(int(np.bitwise_or.reduce(planes[h::2]).view(np.uint64)).bit_count() for h in (0, 1))
            if apart <= 57 and (keys[a] == keys[b]).any():
                want.add((b, a))
    assert 0 < len(want) < 1000
    rows = [(k.tolist(), i, *s.tolist()) for i, (k, s) in enumerate(zip(keys, sketches, strict=True))]
    df = spark.createDataFrame(rows, "k array<bigint>, r bigint" + "".join(f", {x} bigint" for x in N.SKETCH))
    got = [(x.a, x.b) for x in N.candidate_pairs(df, block, 57, [N.F.slice("k", i, 1) for i in (1, 2, 3)]).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_disk_left_by_pairs(spark):
    """What the search wrote is gone when it has its links: less is left than the texts take, which share most bands."""
    from pathlib import Path

    from tallyvane.session import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    r = random.Random(5)
    common = " ".join(f"w{i}" for i in range(120))
    rows = [(f"t{i:03d}", common + " " + " ".join(str(r.random()) for _ in range(40))) for i in range(300)]
    before = size()
    pairs = N.similar_pairs(spark.createDataFrame(rows + [("x1", rows[0][1]), ("x2", rows[1][1] + " end")], "id string, t string"))
    assert size() - before < sum(len(t) for _, t in rows) / 2
    assert not list(folder.rglob("scratch-*"))
    assert {(x.a, x.b) for x in pairs.collect()} == {("t000", "x1"), ("t001", "x2")}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_pairs_of_a_repeated_id(spark):
    """An id that stands for two texts, both like a third: the pair comes once."""
    t = " ".join(f"word{i}" for i in range(80))
    rows = [("a", t), ("a", t + " more"), ("b", t), ("c", t)]
    got = sorted((x.a, x.b) for x in N.similar_pairs(spark.createDataFrame(rows, "id string, t string")).collect() if x.a != x.b)
    assert got == [("a", "b"), ("a", "c"), ("b", "c")]
