"""Follow-up operations, their refusals, and the parameter rules of templates."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import result_frames as R
from ledgerlens.plans.templates import TEMPLATES, Unbound

ROLES = {"hospital": "dimension", "cases": "additive_count", "claimed": "additive_value", "rate": "ratio",
         "beds": "snapshot_stock", "mystery": "unclassified"}


@pytest.fixture(scope="module")
def frame(spark):
    df = spark.createDataFrame(
        [("A", 10, 100.0, 0.5, 40, 1), ("B", 30, 50.0, 0.25, 60, 2), ("C", 20, None, 0.75, 20, 3)],
        "hospital string, cases int, claimed double, rate double, beds int, mystery int")
    return R.ResultFrame(df, ROLES)


def one(df):
    return df.first()[0]


def test_additive(frame):
    assert one(R.total(frame, "cases")) == 60 and one(R.average(frame, "claimed")) == 75
    for name in ("mystery", "hospital"):
        with pytest.raises(R.Refused):
            R.total(frame, name)


def test_ratio_needs_its_base(frame, spark):
    with pytest.raises(R.Refused):
        R.average(frame, "rate")
    base = spark.createDataFrame([(1.0, 4.0), (3.0, 4.0)], "num double, den double")
    ready = R.ResultFrame(frame.df, ROLES, base=base, ratios={"rate": R.Ratio("num", "den", 100)})
    assert one(R.average(ready, "rate")) == 50


def test_statistics(frame):
    assert one(R.median(frame, "cases")) == 20 and one(R.stdev(frame, "cases")) == 10
    assert one(R.percentile(frame, "cases", 25)) == 15
    with pytest.raises(R.Refused):
        R.percentile(frame, "cases", 101)
    row = R.value_range(frame, "cases", "hospital").first()
    assert (row["value"], row["high_label"], row["low_label"]) == (20, "B", "A")
    assert R.extreme(frame, "claimed", True, "hospital", "hospital").first()["label"] == "A"


def test_mode_and_distinct(spark):
    df = spark.createDataFrame([(" x",), ("x ",), ("y",), ("y",), ("z",), (None,)], "v string")
    f = R.ResultFrame(df, {"v": "dimension"})
    assert [(r["value"], r["n"]) for r in R.mode(f, "v").collect()] == [("x", 2), ("y", 2)]
    assert one(R.count_distinct(f, "v")) == 3
    unique = R.ResultFrame(spark.createDataFrame([("a",), ("b",)], "v string"), {"v": "dimension"})
    assert R.mode(unique, "v").count() == 0


def test_shares_change_and_order(frame, spark):
    assert {r["hospital"]: r["cases_pct"] for r in R.share_of_total(frame, "cases").collect()}["B"] == 50.0
    assert R.share_of_total(frame, "cases", ("hospital", "B")).count() == 1
    zero = R.ResultFrame(frame.df.withColumn("zero", F.lit(0)), {**ROLES, "zero": "additive_count"})
    for refused in (lambda: R.share_of_total(zero, "zero"), lambda: R.share_of_total(frame, "cases", ("hospital", "Z")),
                    lambda: R.share_of_total(frame, "rate"), lambda: R.sort_frame(frame, "nowhere")):
        with pytest.raises(R.Refused):
            refused()
    roles = {"y": "temporal", "v": "additive_value"}
    series = R.ResultFrame(spark.createDataFrame([(2019, None), (2020, -50.0), (2021, 25.0)], "y int, v double"), roles)
    assert R.percent_change(series, "y", "v").first()["pct_change"] == 150
    for rows in ([(1, 0.0), (2, 5.0)], [(1, 5.0)], []):
        with pytest.raises(R.Refused):
            R.percent_change(R.ResultFrame(spark.createDataFrame(rows, "y int, v double"), roles), "y", "v")
    assert [r["hospital"] for r in R.sort_frame(frame, "claimed", "desc").collect()][0] == "C"
    assert [r["hospital"] for r in R.sort_frame(frame, "claimed", "asc").collect()][-1] == "C"
    assert R.top_n(frame, "claimed", 0).count() == 1 and R.bottom_n(frame, "claimed").count() == 2


def test_filters_and_coercion(frame, spark):
    text = R.ResultFrame(spark.createDataFrame([("₹1,200",), ("90",), ("junk",), (None,)], "v string"), {})
    assert R.filter_rows(text, "v", ">", "1,000").count() == 1
    assert sorted(x for (x,) in text.df.select(R.numeric("v")).collect() if x is not None) == [90.0, 1200.0]
    assert R.filter_rows(frame, "hospital", "=", " a ").count() == 1
    with pytest.raises(R.Refused):
        R.filter_rows(frame, "hospital", "~", "a")


def test_population_operations_see_past_the_cut(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 5.0), ("c", 9.0)], "k string, v double")
    roles = {"k": "dimension", "v": "additive_value"}
    cut = R.ResultFrame(rows.orderBy(F.desc("v")).limit(2), roles, limit=2, uncut=rows)
    assert R.extreme(cut, "v", False, "k", "k").first()["value"] == 1 and one(R.value_range(cut, "v", "k")) == 8
    assert [r.k for r in R.bottom_n(cut, "v", 1).collect()] == ["a"] and R.share_of_total(cut, "v").count() == 3
    blind = R.ResultFrame(cut.df, roles, limit=2)
    for refused in (lambda: R.extreme(blind, "v", True, "k", "k"), lambda: R.value_range(blind, "v", "k"), lambda: R.top_n(blind, "v"),
                    lambda: R.bottom_n(blind, "v"), lambda: R.share_of_total(blind, "v"), lambda: R.median(blind, "v")):
        with pytest.raises(R.Refused):
            refused()


def test_quantiles_of_many_partitions(spark):
    import statistics

    values = [((k * 7919) % 1000) / 3 for k in range(777)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(9)
    frame = R.ResultFrame(df, {"v": "additive_value"})
    assert one(R.median(frame, "v")) == pytest.approx(statistics.median(values))
    assert one(R.percentile(frame, "v", 0)) == min(values) and one(R.percentile(frame, "v", 100)) == max(values)
    assert one(R.median(R.ResultFrame(df.filter("v < 0"), {"v": "additive_value"}), "v")) is None


def test_truncation_guard(frame):
    cut = R.ResultFrame(frame.df.limit(3), ROLES, limit=3)
    with pytest.raises(R.Refused):
        R.total(cut, "cases")
    assert one(R.total(R.ResultFrame(frame.df, ROLES, limit=10), "cases")) == 60
    assert one(R.total(R.ResultFrame(frame.df.limit(2), ROLES, limit=2, uncut=frame.df), "cases")) == 60


def test_compare_limits(frame):
    with pytest.raises(R.Refused):
        R.compare(frame, "hospital", "A", ["B"])
    again = R.ResultFrame(frame.df, ROLES, requery=lambda slot, v: frame.df)
    with pytest.raises(R.Refused):
        R.compare(again, "hospital", "A", [])
    assert R.compare(again, "hospital", "A", list("BCDE")).count() == 15
    with pytest.raises(R.Refused):
        R.compare_delta(R.compare(again, "hospital", "A", ["B"]), "hospital", "A", "cases")


def test_template_binding(spark, tables):
    q4, q6, q11 = TEMPLATES["Q04"], TEMPLATES["Q06"], TEMPLATES["Q11"]
    assert q4.bind({}) == {"region": None, "top_n": 10}
    assert q4.bind({"top_n": 99999})["top_n"] == 99999 and q4.bind({"top_n": 0})["top_n"] == 1
    with pytest.raises(Unbound):
        q6.bind({})
    with pytest.raises(Unbound):
        q4.bind({"stray": 1})
    assert q11.bind({"year": 1997, "year_2": 1999}) == {"year": 1999, "year_2": 1997}
    tables.register()
    up = q11.run(spark, {"year": 1999, "year_2": 1997}).collect()
    assert up == q11.run(spark, {"year": 1997, "year_2": 1999}).collect()
    # an unset filter folds away, a set one reaches the scan
    plan = lambda v: TEMPLATES["Q02"].run(spark, v)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(n_name,NATION_1)" in plan({"nation": "NATION_1"}) and "EqualTo(n_name" not in plan({})


def test_numbers_in_text_are_ordered_by_value(spark):
    rows = [("a", "9"), ("b", "1,000"), ("c", "₹100"), ("d", "none"), ("e", None), ("f", "-3.5")]
    frame = R.ResultFrame(spark.createDataFrame(rows, "name string, amount string"), {"amount": "additive_value"})
    names = lambda df: [r["name"] for r in df.collect()]
    assert names(R.top_n(frame, "amount", 2)) == ["b", "c"] and names(R.bottom_n(frame, "amount", 2)) == ["f", "a"]
    assert names(R.top_n(frame, "amount", 99)) == ["b", "c", "a", "f"]
    assert names(R.sort_frame(frame, "amount", "asc", tie=["name"])) == ["f", "a", "c", "b", "d", "e"]
    assert names(R.sort_frame(frame, "amount", "desc", tie=["name"])) == ["d", "e", "b", "c", "a", "f"]
    for column in ("name", "day"):
        dated = R.ResultFrame(frame.df.withColumn("day", F.to_date(F.lit("2020-01-01"))), {})
        with pytest.raises(R.Refused):
            R.top_n(dated, column)
    with pytest.raises(R.Refused):
        R.bottom_n(frame, "nowhere")


def test_whole_numbers_and_dates_as_measures(spark):
    frame = R.ResultFrame(spark.createDataFrame([(1, True), (7, None)], "v int, flag boolean"), {"v": "additive_value"})
    assert R.total(frame, "v").first()[0] == 8 and R.sort_frame(frame, "flag", tie=["v"]).count() == 2
