"""Units and changepoints."""

import numpy as np
import pytest

from tallyvane.operators import changepoint as CP
from tallyvane.operators import units as U


@pytest.mark.parametrize(
    "text, raw, want",
    [
        ("Net loss was $8,052M in fiscal 2016.", "$8,052M", ("USD", 8052e6)), ("compared with 38.43 billion dollars a year earlier", "38.43 billion", ("USD", 38.43e9)), ("Gross margin stood at (49.8%) in fiscal 2024", "(49.8%)", ("bp", -4980)), ("reached 73 bps", "73", ("bp", 73)),
        ("Effluent read 52,799 and 5,268 in the two halves (both in cubic metres).", "52,799", ("l", 52799e3)), ("Water moved from 3,900,057 to 3,031,818 gal.", "3,900,057", ("l", 3900057 * 3.785411784)), ("should fall between $10.54 and $38.37 billion.", "$10.54", ("USD", 10.54e9)),
        ("Der Umsatz von Gaddexo betrug 568,29 Tsd. US-Dollar.", "568,29", ("USD", 568290)), ("La chatarra de Jasdexon pesó 55.891,3 toneladas.", "55.891,3", ("kg", 55891300)), ("fue de 73,52 miles de dólares.", "73,52", ("USD", 73520)), ("atteint 852,53 milliards de dollars", "852,53", ("USD", 852.53e9)),
        ("Xの売上高は183.69万ドルであった。", "183.69", ("USD", 1836900)), ("Xの廃棄量は1,036トンであった。", "1,036", ("kg", 1036000)), ("X的人工费用为4.0亿美元", "4.0", ("USD", 4e8)), ("came to 75.1 million vehicles in", "75.1 million", ("each", 75.1e6)), ("14,625.1 million sq ft of", "14,625.1 million", ("m2", 14625.1e6 * 0.09290304)),
        ("Amounts for Orama below are stated in hundreds of thousands of US dollars. Revenue came to 229,721, and", "229,721", ("USD", 229721e5)), ("appear in Note 28 on page 32", "28", None), ("appear in Note 28 on page 32", "32", None), ("in fiscal 2016, compared", "2016", None), ("", "5", None),
    ],
)
def test_in_text(text, raw, want):
    got = U.in_text(text, text.find(raw), raw) if text else U.in_text("5", 0, "5")
    assert (got is None) == (want is None)
    if want:
        assert got[0] == want[0] and got[1] == pytest.approx(want[1])


@pytest.mark.parametrize(
    "grid, caption, at, want",
    [
        ([["Item", "FY1 ($m)", "FY2 ($k)"], ["Net sales", "5", "7"]], None, (1, 2), ("USD", 7000)), ([["Item", "FY1"], ["Net sales [USD bn]", "5"]], "in millions of US dollars", (1, 1), ("USD", 5e9)), ([["$ in thousands", "FY1"], ["Net sales", "$5M"]], None, (1, 1), ("USD", 5e6)), ([["", "FY1"], ["Stores", "12"], ["Dollar amounts in millions unless the cell says otherwise", ""]], None, (1, 1), ("each", 12)),
        ([["", "Unit", "FY1"], ["Growth", "%", "5.6"]], None, (1, 2), ("bp", 560)), ([["", "FY1"], ["Energy, GJ", "9"]], "US$ in billions except where noted", (1, 1), ("kWh", 2500)), ([["", "FY1"], ["Tax charge", "(7)"], ["Note: $ figures are thousands", None]], None, (1, 1), ("USD", -7000)), ([["", "2016"], ["x", "1"]], None, (0, 1), None),
    ],
)
def test_in_table(grid, caption, at, want):
    r, c = at
    got = U.in_table("", caption, grid, r, c, grid[r][c])
    assert (got is None) == (want is None) and (want is None or (got[0] == want[0] and got[1] == pytest.approx(want[1])))


def test_common_units_edge_cases(spark):
    n = "number_id bigint, chunk_id string, char_start int, cell_row int, cell_col int, raw string, value double, extracted_at timestamp, extra string"
    c = "chunk_id string, content string, caption string, raw_table array<array<string>>, extra string"
    chunks = spark.createDataFrame([("a", "[h]\nIt used 5 kWh.", None, None, "z"), ("b", None, None, None, "z"), ("t", "x", None, [["", "FY"], ["Stores", None]], "z")], c)
    rows = [(1, "a", 12, None, None, "5", None, None, "e"), (1, "a", 12, None, None, "5", 5.0, None, "e"), (2, "b", 0, None, None, "5", 5.0, None, "e"), (3, "a", 900, None, None, "5", 5.0, None, "e"), (4, "a", None, None, None, "5", 5.0, None, "e"), (5, "t", None, 9, 9, "5", 5.0, None, "e"), (None, "a", 12, None, None, "5", 5.0, None, "e"), (6, "a", 12, None, None, None, 5.0, None, "e")]
    got = [(r.number_id, r.base_unit, r.base_value) for r in U.common_units(spark.createDataFrame(rows, n), chunks).collect()]
    assert got == [(1, "kWh", 5)]
    assert U.common_units(spark.createDataFrame([], n), chunks).count() == 0


def brute_segments(x, penalty):
    n = len(x)
    best = [(-penalty, [])]
    for t in range(1, n + 1):
        best.append(min((best[s][0] + float(((x[s:t] - x[s:t].mean()) ** 2).sum()) + penalty, best[s][1] + [s]) for s in range(t)))
    return best[n][1]


def test_changepoints_are_optimal():
    r = np.random.default_rng(2)
    for _ in range(20):
        x = np.concatenate([r.normal(m, 0.3, r.integers(2, 8)) for m in r.choice([0, 3, 6], 3)])
        got = CP.segments(x, 1.0)
        cost = lambda st: sum(((x[a:b] - x[a:b].mean()) ** 2).sum() + 1.0 for a, b in zip(st, st[1:] + [len(x)]))
        assert cost(got) == pytest.approx(cost(brute_segments(x, 1.0)))
    assert CP.segments(np.array([]), 1.0) == [] and CP.unit_factor(3.02)[0] == "thousand" and CP.unit_factor(4.5) is None


def test_unit_changes(spark):
    rows = [("s", i, float(v)) for i, v in enumerate([5, 6, 5.5, 6, 5, 5500, 6000, 5200, 5800, 6100])] + [("s", 50, None), ("one", 1, 3.0), ("none", 1, None)]
    r = CP.unit_changes(spark.createDataFrame(rows, "source string, id bigint, value double"), "source", ["id"], "value").collect()
    assert sorted((x.source, x.segment_no, x.n_values, x.unit_change) for x in r) == [("none", 0, 1, None), ("one", 0, 1, None), ("s", 0, 5, None), ("s", 1, 6, "thousand")]
    many = spark.createDataFrame([("s", i, 10.0 if i < 6000 else 1e7) for i in range(12000)], "source string, id bigint, value double")
    r = CP.unit_changes(many, "source", ["id"], "value").collect()
    assert sum(x.n_values for x in r) == 12000 and [x.unit_change for x in r if x.unit_change] == ["million"] and len({x.block_no for x in r}) == 3


def test_blocks_do_not_change_the_segments(spark):
    """A history of many blocks has the segments of one search over the whole of it."""
    r = np.random.default_rng(5)
    x = {"mixed": r.normal(4, 2, 1500), "flat": np.concatenate([r.normal(3, 0.1, 700), r.normal(5, 0.1, 300)]), "levels": np.concatenate([r.normal(m, 0.3, 20) for m in r.choice([0, 1, 3, 6], 60)])}
    rows = [(k, i, float(10**v) if i % 7 else None) for k, xs in x.items() for i, v in enumerate(xs)]
    got = CP.value_segments(spark.createDataFrame(rows, "source string, id bigint, value double"), "source", ["id"], "value", block=100).toPandas()
    for k, xs in x.items():
        ok = [i for i in range(len(xs)) if i % 7]
        starts = [ok[a] for a in CP.segments(xs[ok], 2.0)]
        g = got[got.source == k].sort_values("id")
        assert g.block_no.nunique() == -(-len(xs) // 100)
        assert (g.stretch_no.nunique() > 5) == (k != "flat")
        key = list(zip(g.stretch_no, g.segment_no))
        assert [0] + [i for i in range(1, len(xs)) if key[i] != key[i - 1]] == [0] + starts[1:]


def test_sure_changes_hold_in_any_surroundings():
    r = np.random.default_rng(6)
    found = 0
    for _ in range(40):
        x = r.normal(0, r.choice([0.5, 1, 2]), 120)
        sure = CP.sure_changes(x, 2.0)
        found += bool(sure)
        for _ in range(5):
            left, right = r.normal(r.normal(0, 3), r.choice([0.1, 2]), r.integers(0, 60)), r.normal(r.normal(0, 3), r.choice([0.1, 2]), r.integers(0, 60))
            assert {len(left) + c for c in sure} <= set(CP.segments(np.concatenate([left, x, right]), 2.0))
    assert found > 10


def test_converted_values(spark):
    """Values behind marked changes are brought back to the unit of the first segment."""
    rows = [("s", i, float(v)) for i, v in enumerate([5] * 6 + [5000] * 6 + [5e6 * 0.45359237] * 6 + [5] * 6)] + [("s", 50, None), ("s", 51, 0.0), (None, 1, 3.0), ("n", 1, -7.0)]
    rows += [("t", i, 8.0) for i in range(6)] + [("t", i, 8e-6) for i in range(6, 12)] + [("t", i, 8.0) for i in range(12, 18)]
    r = CP.converted_values(spark.createDataFrame(rows, "source string, id bigint, value double"), "source", ["id"], "value").collect()
    got = {(x.source, x.id): x.converted for x in r}
    assert len(r) == len(rows) and got["s", 50] is None and got["s", 51] == 0 and got[None, 1] == 3 and got["n", 1] == -7
    # 3 + (3 - 0.34, no known factor) - 5.66 (no known factor): only the first change is reversed
    assert [got["s", i] for i in (0, 6, 12, 18)] == pytest.approx([5, 5, 5e3 * 0.45359237, 5e-3])
    assert all(got["t", i] == pytest.approx(8) for i in range(18))


def test_units_named_far_off_and_in_other_words():
    far = "Plant consumption, measured in GWh by the meters that the board had installed after the long dispute with the grid company over the two older ones, came to 5.3 last year."
    assert U.in_text(far, far.index("5.3"), "5.3") == ("kWh", 5.3e6)
    for text, raw, want in (("Pesava 14 tonnellate.", "14", ("kg", 14e3)), ("The catch was 14 stone.", "14", ("kg", 14 * 14 * 0.45359237)), ("The field covers 3 square miles.", "3", ("m2", 3 * 2589988.110336)), ("Der Tank fasst 1.250,5 Liter.", "1.250,5", ("l", 1250.5))):
        assert U.in_text(text, text.index(raw), raw) == pytest.approx(want)


def test_a_bare_table_says_nothing():
    grid = [["", "2023"], ["Alpha", "12"]]
    assert U.in_table("", None, grid, 1, 1, "12") is None
    assert U.in_table("", "Amounts in $", grid, 1, 1, "12") == ("USD", 12.0)


def test_a_shift_of_the_recording_unit_gives_the_scale(spark):
    """Dollar amounts without a printed scale follow their source's history: without the shifts the result differs."""
    import datetime as dt

    chunks = spark.createDataFrame([("a", "Costs were $12.5 there.", None, None, "X"), ("b", "Costs were $12.5 there.", None, None, "Y")], "chunk_id string, content string, caption string, raw_table array<array<string>>, company string")
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1000 * k + i, c, 11, None, None, "$12.5", 12.5 * (1e6 if c == "a" and i >= 30 else 1.0), t0 + dt.timedelta(days=i)) for k, c in enumerate("ab") for i in range(60)]
    rows.append((5000, "b", 11, None, None, "$12.5", 12.5e6, t0 + dt.timedelta(days=20, hours=1)))  # a single one is no run
    numbers = spark.createDataFrame(rows, "number_id bigint, chunk_id string, char_start int, cell_row int, cell_col int, raw string, value double, extracted_at timestamp")
    got = {r.number_id: (r.base_unit, r.base_value) for r in U.common_units(numbers, chunks).collect()}
    plain = {r.number_id: (r.base_unit, r.base_value) for r in U.common_units(numbers, chunks, history=False).collect()}
    assert set(plain.values()) == {("USD", 12)} and set(got) == set(plain)
    assert {k for k in got if got[k] != plain[k]} == set(range(30, 60)) and got[45] == ("USD", 12_500_000)
