"""Number extraction and verification against brute force."""

import random

import pytest

from tallyvane.functions import fixed as X
from tallyvane.functions.numbers import extract_numbers, numbers_in
from tallyvane.operators import verify as V

A = "answer_id bigint, num_ord int, value double, is_percent boolean, keywords array<string>"
E = "answer_id bigint, ev_ord bigint, value double, keywords array<string>"


@pytest.mark.parametrize(
    "text, want",
    [
        ("$25.2B", [(25.2e9, False, False)]), ("18.5%", [(18.5, True, False)]), ("$450M", [(450e6, False, False)]), ("$96.8 billion", [(96.8e9, False, False)]), ("(9%)", [(9.0, True, True)]), ("($1.2B)", [(-1.2e9, False, True)]), ("$211,915", [(211915.0, False, False)]),
        ("x5 and ,", []), ("5 (3) million", [(-3.0, False, True), (5.0, False, False)]), ("", []), ("3 bn and 4", [(3e9, False, False), (4.0, False, False)]),
    ],
)
def test_numbers(text, want):
    assert [(v, p, n) for _, v, p, n, *_ in numbers_in(text)] == want


def test_keywords_and_positions(spark):
    df = spark.createDataFrame([(1, "Total revenue was $5M."), (2, None), (3, "")], "id bigint, t string")
    r = extract_numbers(df, "id", "t").collect()
    assert len(r) == 1 and r[0].metric_keywords == ["revenue", "total"] and r[0].char_start == 18


def brute(answers, evidence):
    out = {}
    for a, i, v, pct, kw in answers:
        ev = [e for e in evidence if e[0] == a]
        if not (pct or abs(v) >= 1):
            continue
        stem = lambda ks: {k.rstrip("s") if len(k) > 3 else k for k in ks}
        diff = lambda e: abs(e - v) / max(abs(v), 1e-9)
        close = [e for e in ev if v != 0 and e[2] != 0 and diff(e[2]) <= X.TOLERANCE]
        pool = [e for e in ev if abs(e[2]) > 1e-9]
        if any(abs(e[2]) >= 1000 for e in pool):
            pool = [e for e in pool if abs(e[2]) >= 1000]
        der = pct and v != 0 and any(x[1] != y[1] and abs(abs(x[2] - y[2]) / abs(y[2]) * 100 - abs(v)) / max(abs(v), 1e-9) <= X.TOLERANCE for x in pool for y in pool)
        if close:
            s = "matched" if any(not kw or not e[3] or stem(kw) & stem(e[3]) for e in close) else "mismatch"
        elif der:
            s = "derived"
        else:
            s = "mismatch" if v != 0 and ev and min(diff(e[2]) for e in ev) < X.UNVERIFIABLE_FROM else "unverifiable"
        out[a, i] = s
    return out


def test_verify_against_brute_force(spark):
    r = random.Random(3)
    words = [[], ["revenue"], ["sales"], ["revenues", "net"]]
    ev = [(a, j, r.choice([0.0, 5.0, -40.0, round(r.uniform(1, 3000), 1), round(r.uniform(1000, 9000), 0)]), r.choice(words)) for a in range(40) for j in range(r.randint(0, 8))]
    an = []
    for a in range(40):
        mine = [e[2] for e in ev if e[0] == a] or [7.0]
        for i in range(6):
            b, c = r.choice(mine), r.choice(mine)
            v = r.choice([b, b * 1.015, b * 1.2, b * 9, abs(b - c) / abs(c) * 100 if c else 12.0, 0.0, 0.5])
            an.append((a, i, float(v), r.random() < 0.4, r.choice(words)))
    adf, edf = spark.createDataFrame(an, A), spark.createDataFrame(ev, E)
    rows = V.verify(adf, edf)
    got = {(x.answer_id, x.num_ord): x.status for x in rows.collect()}
    assert got == brute(an, ev)
    rep = {x.answer_id: x for x in V.report(adf, adf, edf, rows).collect()}
    none = [a for a in range(40) if not any(e[0] == a for e in ev)]
    assert none and all(not rep[a].verified and rep[a].n_unverifiable == 6 for a in none)


def test_empty(spark):
    a, e = spark.createDataFrame([], A), spark.createDataFrame([], E)
    assert V.verify(a, e).count() == 0


def test_nearest_tie_takes_first(spark):
    a = spark.createDataFrame([(1, 0, 10.0, False, [])], A)
    e = spark.createDataFrame([(1, 7, 12.0, []), (1, 3, 8.0, []), (1, 5, 8.0, [])], E)
    r = V.nearest(a, e).first()
    assert (r.nearest_value, round(r.relative_diff, 6)) == (8.0, 0.2)
