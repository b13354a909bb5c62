"""Parsing of text, dates and amounts; resolution against dictionaries; vector search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import columns as C
from ledgerlens.functions import text as X
from ledgerlens.operators import resolve as R
from ledgerlens.operators.joins import overlaps, period_matches, with_bounds


def apply(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v")).alias("x")).collect()]


def test_normalise(spark):
    got = apply(spark, ["  What's the GP\tplan?? ", "ODF in Khurda.", "agp gpx", "o&m cost"], X.normalise_query_text)
    assert got == ["what is the gram panchayat plan", "open defecation free sanitation in khordha", "agp gpx",
                   "operation and maintenance cost"]


@pytest.mark.parametrize("raw,rupees,error", [
    ("7 lakh", 7e5, None), ("1.25 crore", 1.25e7, None), ("₹81,500", 81500.0, None), ("Rs 12,34,000/-", 1234000.0, None), ("640", 640.0, None),
    ("9 lacs rupees", 9e5, None), ("8k", 8e3, None), ("4 acres", None, "unknown amount unit"), ("plenty", None, "not an amount"),
    ("-6", -6.0, None), ("", None, "not an amount"), ("6 lakh more", None, "not an amount"), ("INR 3 cr.", 3e7, None)])
def test_amounts(spark, raw, rupees, error):
    got = apply(spark, [raw], X.parse_amount)[0]
    assert (got["rupees"], got["error"]) == (rupees, error)


@pytest.mark.parametrize("text,years", [
    ("FY 24-25", ["2024-2025"]), ("2024-25 vs 2023-24", ["2023-2024", "2024-2025"]), ("in 2024", ["2024-2025"]),
    ("2024-2025", ["2024-2025"]), ("2023-2025", ["2023-2024", "2025-2026"]), ("୨୦୨୪-୨୫", ["2024-2025"]), ("₹2024 only", []),
    ("2024 households", []), ("how many", []), ("2023–24", ["2023-2024"]), ("2099-00", ["2099-2100"]), ("12024", []),
    ("Rs. 2021 and 2022", ["2022-2023"]), ("24-26", []), ("2023-2025 households", ["2023-2024"]), ("Rs          2024 paid", []),
    ("2031 / 2032 schemes", ["2031-2032"]), ("₹2024-2027", ["2027-2028"])])
def test_fiscal_years(spark, text, years):
    # '2099-00' keeps its century, so it is no consecutive pair and stays a bare year
    assert apply(spark, [text], X.absolute_fiscal_years)[0] == years


def test_relative_years(spark):
    known = F.array(*[F.lit(y) for y in ("2020-2021", "2021-2022", "2022-2023")])
    texts = ["last two years", "this year", "previous fiscal year", "past 9 years", "nothing", "current year vs last year"]
    got = apply(spark, texts, lambda c: X.fiscal_years(c, known))
    assert got == [["2021-2022", "2022-2023"], ["2022-2023"], ["2021-2022"], ["2020-2021", "2021-2022", "2022-2023"], [],
                   ["2021-2022", "2022-2023"]]
    assert apply(spark, ["last year"], lambda c: X.fiscal_years(c, F.array().cast("array<string>"))) == [[]]


@pytest.mark.parametrize("text,window", [
    ("in 2024", ("2024-01-01", "2024-12-31")), ("between 2023 and 2025", ("2023-01-01", "2025-12-31")),
    ("FY 2024-25", ("2024-04-01", "2025-03-31")), ("March 2025", ("2025-03-01", "2025-03-31")), ("feb, 2024", ("2024-02-01", "2024-02-29")),
    ("last year", None), ("2024-2025", ("2024-04-01", "2025-03-31"))])
def test_date_windows(spark, text, window):
    got = apply(spark, [text], X.date_window)[0]
    assert (None if got is None else (str(got["start"]), str(got["end"]))) == window


@pytest.mark.parametrize("text,day,error", [
    ("2024-06-30", "2024-06-30", None), ("30 June 2024", "2024-06-30", None), ("Jun 30, 2024", "2024-06-30", None),
    ("30-06-2024", "2024-06-30", None), ("05-06-2024", None, "ambiguous"), ("31 June 2024", None, "not a date"), ("soon", None, "not a date"),
    (" ", None, "empty"), ("30-Jun-2024", "2024-06-30", None)])
def test_deadlines(spark, text, day, error):
    got = apply(spark, [text], X.parse_deadline)[0]
    assert (got["deadline"] and str(got["deadline"]), got["error"]) == (day, error)


def test_number_text_and_periods(spark):
    nums = spark.createDataFrame([(1234567.0,), (999.0,), (-100000.0,), (25000000.0,), (12345678901.0,)], "v double")
    assert [r[0] for r in nums.select(C.indian_grouping("v")).collect()] == [
        "12,34,567", "999", "-1,00,000", "2,50,00,000", "12,34,56,78,901"]
    assert [r[0] for r in nums.select(C.rupee_text("v")).collect()][:3] == ["Rs 12.35 lakh", "Rs 999", "Rs -1.00 lakh"]
    got = apply(spark, ["2020-08", "2020-Q3", "2024-2025", "2024-2026", "x"], C.period_bounds)
    assert [(g["first"], g["last"]) if g else None for g in got] == [
        (2020 * 12 + 7,) * 2, (2020 * 12 + 6, 2020 * 12 + 8), (2024 * 12 + 3, 2024 * 12 + 14), None, None]


def test_event_windows_with_grace(spark):
    events = spark.createDataFrame([("e", 100, 103)], "event string, event_first int, event_last int")
    periods = spark.createDataFrame([(n, n + 1) for n in (97, 98, 99, 103, 104, 106, 107)], "first int, last int")
    got = {r["first"]: r["relation"] for r in period_matches(periods, events).collect()}
    assert got == {99: "inside", 103: "inside", 104: "in the months just after", 106: "in the months just after"}


def test_labels_are_parsed_once_each(spark):
    """A filter on the bounds stays above the distinct, so parsing does not grow with the rows that carry a label."""
    rows = spark.range(1000).select(F.concat(F.lit(2000) + F.col("id") % 5, F.lit("-Q1")).alias("label"))
    periods = with_bounds(rows).select("label", "b.first", "b.last").filter("first <= last")
    assert sorted(map(tuple, periods.collect())) == [(f"{y}-Q1", y * 12, y * 12 + 2) for y in range(2000, 2005)]
    plan = periods._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan and "Aggregate" not in plan


def test_overlaps_of_short_and_long_intervals(spark):
    rng = np.random.default_rng(6)

    def rows(n, longest):
        starts = rng.integers(-300, 300, n)
        return [(int(k), int(a), int(a + rng.choice([0, 0, 1, 3, 17, longest]) - (k % 37 == 5))) for k, a in enumerate(starts)]

    left, right = rows(150, 400) + [(900, None, 3), (901, -10**9, 10**9)], rows(120, 90) + [(901, 5, None)]
    a = spark.createDataFrame(left, "i long, first long, last long")
    b = spark.createDataFrame(right, "j long, f int, l int")
    got = [(r["i"], r["j"]) for r in overlaps(a, b, ("first", "last"), ("f", "l")).collect()]
    whole = lambda x: x[1] is not None and x[2] is not None and x[1] <= x[2]
    want = [(x[0], y[0]) for x in left for y in right if whole(x) and whole(y) and x[1] <= y[2] and y[1] <= x[2]]
    assert sorted(got) == sorted(want)
    assert overlaps(a.limit(0), b, ("first", "last"), ("f", "l")).count() == 0


def test_similar_pairs_are_complete(spark):
    rng = np.random.default_rng(4)
    letters = list("abcd")
    words = ["".join(rng.choice(letters, rng.integers(1, 15))) for _ in range(150)]
    left = spark.createDataFrame([(w,) for w in words[:75]], "l string")
    right = spark.createDataFrame([(w,) for w in words[75:]], "r string")
    for threshold in (60, 85):
        fast = {(r["l"], r["r"]) for r in R.edit_pairs(left, right, threshold).collect()}
        every = left.distinct().join(right.distinct(), F.lit(True)).filter(R.similarity(F.col("l"), F.col("r")) >= threshold)
        assert fast == {(r["l"], r["r"]) for r in every.collect()}


def test_resolution_ladder(spark):
    registry = spark.createDataFrame([("Khordha Town",), ("Cuttack City",), ("Puri",)], "name string")
    asked = spark.createDataFrame([(" khordha  TOWN",), ("old capital",), ("Khorda Town",), ("zzz",), (None,)], "t string")
    aliases = spark.createDataFrame([("Old Capital", "cuttack city")], "alias string, canonical string")
    got = {r["asked"]: (r["value"], r["confidence"]) for r in R.resolve(asked, "t", registry, "name", aliases).collect()}
    assert got == {"khordha town": ("Khordha Town", "exact"), "old capital": ("Cuttack City", "alias"),
                   "khorda town": ("Khordha Town", "fuzzy"), "zzz": (None, "none")}
    near = R.suggestions(spark.createDataFrame([("pury",)], "asked string"), registry, "name", 2).orderBy("position").collect()
    assert near[0]["suggestion"] == "puri" and len(near) == 2


@pytest.mark.parametrize("blocks", [(256, 2048), (3, 7)])
def test_suggestions_are_the_best_of_all_values(spark, blocks):
    rng = np.random.default_rng(8)
    words = sorted({"".join(rng.choice(list("abcdef"), rng.integers(1, 12))) for _ in range(160)})
    names, texts = words[::2], [*words[1::2], "zzzz", "a", words[0]]
    registry = spark.createDataFrame([(w,) for w in names] + [(None,)], "name string")
    asked = spark.createDataFrame([(w,) for w in texts] + [("",), (None,), ("zzzz",)], "asked string")
    got = {}
    for r in R.suggestions(asked, registry, "name", 3, asked_block=blocks[0], value_block=blocks[1]).collect():
        got.setdefault(r["asked"], []).append((r["position"], r["suggestion"], round(r["score"], 9)))

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = {}
    for t in set(texts):
        best = sorted((-(1 - edits(t, v) / max(len(t), len(v))) * 100, v) for v in names)[:3]
        want[t] = [(k, v, pytest.approx(-score, abs=1e-6)) for k, (score, v) in enumerate(best, 1)]
    assert {t: sorted(x) for t, x in got.items()} == want


def test_roster_never_picks_a_namesake(spark):
    roster = spark.createDataFrame([(str(100 + i), "Laxmipur", "East" if i else "West") for i in range(15)] + [
        ("7", "Other", "West"), ("8", "Bank of India", "South"), ("9", "Bank", "India"), ("10", "Greenfield", "North")],
        "code string, name string, place string")
    asked = spark.createDataFrame([("Laxmipur",), ("laxmipur of west",), ("7",), ("nobody",), ("Other",), ("Bank of India",), ("bank of india of south",),
                                   ("old other",), ("Grenfield",)], "q string")
    aliases = spark.createDataFrame([("Old Other", "other")], "alias string, canonical string")
    got = {r["asked"]: r for r in R.resolve_roster(asked, "q", roster, "code", "name", "place", 12, aliases).collect()}
    assert got["laxmipur"]["matches"] == 15 and got["laxmipur"]["bound"] is None
    assert len(got["laxmipur"]["candidates"].split(",")) == 12
    assert got["laxmipur of west"]["bound"] == "100" and got["7"]["bound"] == "7" and got["other"]["bound"] == "7"
    assert got["nobody"]["matches"] == 0
    assert got["bank of india"]["bound"] == "8" and got["bank of india of south"]["bound"] == "8"
    assert got["old other"]["bound"] == "7" and got["grenfield"]["bound"] == "10"


def test_vectors_count_owners_once(spark, monkeypatch):
    rows = [("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [0.9, 0.1]), ("c", [-1.0, 0.0]), ("d", [0.0, 0.0]), ("e", None)]
    index = spark.createDataFrame(rows, "owner string, v array<double>").repartition(4)
    asked = spark.createDataFrame([("q", [2.0, 0.0]), ("r", [0.0, 3.0])] + [(f"z{i}", [1.0, float(i)]) for i in range(9)], "query string, vector array<double>")
    every = R.vector_top_k(index, "owner", "v", asked, 3).collect()
    top = sorted((r for r in every if r["query"] == "q"), key=lambda r: r["position"])
    assert [r["owner"] for r in top] == ["a", "b", "d"] and top[0]["score"] == pytest.approx(1.0) and top[0]["vectors"] == 2
    monkeypatch.setattr(R, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, R.vector_top_k(index, "owner", "v", asked, 3).collect())) == sorted(map(tuple, every))
    assert R.vector_top_k(index, "owner", "v", asked.limit(0), 3).count() == 0


@pytest.mark.parametrize("spread", [0.05, 2.0])
def test_pruned_search_equals_full_search(spark, spread):
    """Clustered vectors, where most cells are left out, and scattered ones, where few can be."""
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 8))
    vectors = [(middles[k % 12] + spread * rng.normal(size=8)).tolist() for k in range(700)] + [[0.0] * 8]
    rows = [(f"o{k % 90:02}", v) for k, v in enumerate(vectors)]
    index = spark.createDataFrame(rows + rows[:3], "owner string, v array<double>").repartition(5)
    asked = [(f"q{k}", (middles[k % 12] + 0.1 * rng.normal(size=8)).tolist()) for k in range(30)] + [("zero", [0.0] * 8)]
    built = R.build_index(index, "owner", "v")
    visited = []
    visit = R._visit
    R._visit = lambda i, names, m, wanted, k: visited.append(wanted) or visit(i, names, m, wanted, k)
    try:
        got = R.search(built, spark.createDataFrame(asked, "query string, vector array<double>"), 4).collect()
    finally:
        R._visit = visit
    x, q = R.unit_rows(v for _, v in rows), R.unit_rows(v for _, v in asked)
    owners = np.array([o for o, _ in rows])
    for j, (name, _) in enumerate(asked):
        scores = x @ q[j]
        best = sorted((-round(float(scores[owners == o].max()), 9), o) for o in set(owners))[:4]
        mine = sorted((r["position"], r["owner"], round(r["score"], 7)) for r in got if r["query"] == name)
        assert mine == [(p, o, pytest.approx(-s, abs=1e-6)) for p, (s, o) in enumerate(best, 1)]
    share = sum(w[:-1].sum() for w in visited) / visited[0][:-1].size
    assert share <= (0.5 if spread < 1 else 1.0)


def test_zones(spark):
    rows = [("x", 1, 0.2), ("y", 1, 0.45), ("y", 2, 0.44), ("z", 1, 0.45), ("z", 2, 0.4), ("w", 1, 0.9), ("w", 2, 0.9)]
    top = spark.createDataFrame(rows, "query string, position int, score double")
    assert {r["query"]: r["zone"] for r in R.confidence_zone(top).collect()} == {
        "x": "no_match", "y": "ambiguous", "z": "proceed", "w": "proceed"}
