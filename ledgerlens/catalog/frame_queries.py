"""Registered queries: follow-up operations on result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.catalog.registry import query
from ledgerlens.operators import result_frames as R
from ledgerlens.operators.scan import scan
from ledgerlens.tables import Tables

NATION_SQL = """n AS (SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS price,
  round(sum(o_totalprice), 2) / count(*) AS mean_price
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name)"""
YEAR_SQL = """y AS (SELECT year(o_orderdate) AS year, count(*) AS orders, round(sum(o_totalprice), 2) AS price
  FROM orders GROUP BY 1)"""
ROLES = {"n_name": "dimension", "orders": "additive_count", "price": "additive_value", "mean_price": "ratio"}


def nation_orders(t: Tables) -> DataFrame:
    return (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("price"))
        .withColumn("mean_price", F.col("price") / F.col("orders")))


def nation_frame(t: Tables, limit: int | None = None) -> R.ResultFrame:
    rows = nation_orders(t)
    shown = rows if limit is None else rows.orderBy(F.desc("price"), "n_name").limit(limit)
    base = t.orders.withColumn("one", F.lit(1))
    return R.ResultFrame(shown, ROLES, limit=limit, uncut=rows, base=base,
                         ratios={"mean_price": R.Ratio("o_totalprice", "one")})


def yearly_orders(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(
        F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("price"))


@query("f01_sum_and_average", f"""WITH {NATION_SQL}
SELECT 'sum' AS operation, round(sum(price), 2) AS value FROM n UNION ALL SELECT 'average', round(avg(price), 4) FROM n""")
def f01(t: Tables) -> DataFrame:
    f = nation_frame(t)
    return R.total(f, "price").select(F.lit("sum").alias("operation"), F.round("value", 2).alias("value")).unionByName(
        R.average(f, "price").select(F.lit("average").alias("operation"), F.round("value", 4).alias("value")))


@query("f02_min_and_max", f"""WITH {NATION_SQL}
SELECT 'max' AS operation, max(price) AS value, arg_max(n_name, price) AS label FROM n
UNION ALL SELECT 'min', min(price), arg_min(n_name, price) FROM n""")
def f02(t: Tables) -> DataFrame:
    f = nation_frame(t, limit=5)
    return R.extreme(f, "price", True, "n_name", "n_name").withColumn("operation", F.lit("max")).unionByName(
        R.extreme(f, "price", False, "n_name", "n_name").withColumn("operation", F.lit("min")))


@query("f03_count_rows", f"WITH {NATION_SQL} SELECT count(*) AS value FROM n")
def f03(t: Tables) -> DataFrame:
    return R.count_rows(nation_frame(t))


@query("f04_median", f"WITH {NATION_SQL} SELECT median(price) AS value FROM n")
def f04(t: Tables) -> DataFrame:
    return R.median(nation_frame(t, limit=5), "price")


@query("f05_stdev", f"WITH {NATION_SQL} SELECT round(stddev_samp(price), 3) AS value FROM n")
def f05(t: Tables) -> DataFrame:
    return R.stdev(nation_frame(t, limit=5), "price").select(F.round("value", 3).alias("value"))


@query("f06_percentile", f"WITH {NATION_SQL} SELECT round(quantile_cont(price, 0.9), 4) AS value FROM n")
def f06(t: Tables) -> DataFrame:
    return R.percentile(nation_frame(t, limit=5), "price", 90).select(F.round("value", 4).alias("value"))


@query("f07_range", f"""WITH {NATION_SQL} SELECT round(max(price) - min(price), 2) AS value, arg_max(n_name, price) AS high_label,
  arg_min(n_name, price) AS low_label FROM n""")
def f07(t: Tables) -> DataFrame:
    return R.value_range(nation_frame(t, limit=5), "price", "n_name").withColumn("value", F.round("value", 2))


@query("f08_mode", """WITH c AS (SELECT trim(CAST(p_size AS VARCHAR)) AS value, count(*) AS n FROM part GROUP BY 1)
SELECT value, n FROM c WHERE n = (SELECT max(n) FROM c) AND n > 1 ORDER BY value""")
def f08(t: Tables) -> DataFrame:
    return R.mode(R.ResultFrame(t.part.select("p_size"), {"p_size": "dimension"}), "p_size")


@query("f09_count_distinct", "SELECT count(DISTINCT trim(p_name)) AS value FROM part")
def f09(t: Tables) -> DataFrame:
    return R.count_distinct(R.ResultFrame(t.part.select("p_name"), {"p_name": "dimension"}), "p_name")


@query("f10_share_of_total", f"""WITH {NATION_SQL}
SELECT n_name, price, round(price / (SELECT sum(price) FROM n) * 100, 2) AS price_pct FROM n""")
def f10(t: Tables) -> DataFrame:
    return R.share_of_total(nation_frame(t, limit=5), "price").select("n_name", "price", "price_pct")


@query("f11_percent_change", f"""WITH {YEAR_SQL}
SELECT arg_min(price, year) AS first_value, arg_max(price, year) AS last_value, min(year) AS first_period, max(year) AS last_period,
  round((arg_max(price, year) - arg_min(price, year)) / abs(arg_min(price, year)) * 100, 6) AS pct_change FROM y""")
def f11(t: Tables) -> DataFrame:
    years = yearly_orders(t)
    cut = R.ResultFrame(years.orderBy(F.desc("price")).limit(2), {"year": "temporal", "price": "additive_value"}, limit=2, uncut=years)
    return R.percent_change(cut, "year", "price").withColumn("pct_change", F.round("pct_change", 6))


@query("f12_sort", f"WITH {NATION_SQL} SELECT n_name, orders FROM n ORDER BY orders DESC NULLS FIRST, n_name")
def f12(t: Tables) -> DataFrame:
    return R.sort_frame(nation_frame(t), "orders", tie=["n_name"]).select("n_name", "orders")


@query("f13_top_and_bottom_n", f"""WITH {NATION_SQL}
SELECT * FROM (SELECT 'top' AS side, n_name, price FROM n ORDER BY price DESC, n_name LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'bottom', n_name, price FROM n ORDER BY price, n_name LIMIT 3)""")
def f13(t: Tables) -> DataFrame:
    cut = nation_frame(t, limit=5)
    return R.top_n(cut, "price", tie=["n_name"]).withColumn("side", F.lit("top")).unionByName(
        R.bottom_n(cut, "price", 3, tie=["n_name"]).withColumn("side", F.lit("bottom"))).select("side", "n_name", "price")


#: Counts and prices as a spreadsheet shows them: text with thousands separators, and now and then a dash.
TEXT_SQL = NATION_SQL + """, tx AS (SELECT n_name, CASE WHEN n_name LIKE '%7' THEN '-' ELSE format('{:,}', orders) END AS orders_text,
  CASE WHEN n_name LIKE '%9' THEN NULL ELSE '₹' || format('{:,}', CAST(floor(price) AS BIGINT)) END AS price_text, orders, price FROM n)"""


def text_frame(t: Tables) -> R.ResultFrame:
    rows = nation_orders(t).select(
        "n_name", F.when(F.col("n_name").like("%7"), "-").otherwise(F.format_number("orders", 0)).alias("orders_text"),
        F.when(~F.col("n_name").like("%9"), F.concat(F.lit("₹"), F.format_number(F.floor("price"), 0))).alias("price_text"))
    return R.ResultFrame(rows, {"n_name": "dimension", "orders_text": "additive_count", "price_text": "additive_value"})


@query("f12_sort_numbers_in_text", f"""WITH {TEXT_SQL} SELECT n_name, orders_text, row_number() OVER (ORDER BY
  CASE WHEN orders_text <> '-' THEN orders END DESC NULLS FIRST, n_name) AS position FROM tx""")
def f12_text(t: Tables) -> DataFrame:
    frame = text_frame(t)
    value = R.measure(frame, frame.df, "orders_text")
    placed = scan(R.sort_frame(frame, "orders_text", tie=["n_name"]).select("n_name", "orders_text"), [],
                  [value.desc_nulls_first(), F.col("n_name")])
    return placed.select("n_name", "orders_text", "position")


@query("f13_ends_of_numbers_in_text", f"""WITH {TEXT_SQL}
SELECT * FROM (SELECT 'top' AS side, n_name, price_text FROM tx WHERE price_text IS NOT NULL ORDER BY floor(price) DESC, n_name LIMIT 7)
UNION ALL SELECT * FROM (SELECT 'bottom', n_name, price_text FROM tx WHERE price_text IS NOT NULL ORDER BY floor(price), n_name LIMIT 6)""")
def f13_text(t: Tables) -> DataFrame:
    frame = text_frame(t)
    return R.top_n(frame, "price_text", 7, tie=["n_name"]).select(F.lit("top").alias("side"), "n_name", "price_text").unionByName(
        R.bottom_n(frame, "price_text", 6, tie=["n_name"]).select(F.lit("bottom").alias("side"), "n_name", "price_text"))


@query("f14_filter_rows", """
SELECT 'numeric' AS test, p_brand, count(*) AS parts FROM part WHERE p_retailprice >= 1200 GROUP BY p_brand
UNION ALL SELECT 'equals', p_brand, count(*) FROM part WHERE lower(trim(p_type)) = 'promo' GROUP BY p_brand
UNION ALL SELECT 'contains', p_brand, count(*) FROM part WHERE contains(lower(trim(p_name)), 'ring') GROUP BY p_brand""")
def f14(t: Tables) -> DataFrame:
    tests = [("numeric", "p_retailprice", ">=", "1,200"), ("equals", "p_type", "=", " Promo "), ("contains", "p_name", "contains", "RING")]
    out = None
    for name, column, op, value in tests:
        part = R.filter_rows(R.ResultFrame(t.part, {}), column, op, value).groupBy("p_brand").agg(F.count("*").alias("parts")).withColumn(
            "test", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("f15_compare", """
WITH x AS (SELECT n_name, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey
  WHERE n_name IN ('NATION_1', 'NATION_2', 'NATION_3') GROUP BY 1)
SELECT n_name AS compared_nation, orders, orders - (SELECT orders FROM x WHERE n_name = 'NATION_1') AS orders_delta FROM x""")
def f15(t: Tables) -> DataFrame:
    facts = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(
        t.nation, F.col("c_nationkey") == F.col("n_nationkey"))

    def run(slot: str, value: object) -> DataFrame:
        return facts.filter(F.col("n_name") == value).agg(F.count("*").alias("orders"))

    frame = R.ResultFrame(run("nation", "NATION_1"), {"orders": "additive_count"}, requery=run)
    both = R.compare(frame, "nation", "NATION_1", ["NATION_2", "NATION_3"])
    return R.compare_delta(both, "nation", "NATION_1", "orders")


@query("f16_additivity_policy", f"""WITH {YEAR_SQL}
SELECT 'ratio' AS role, round(sum(o_totalprice) / count(*), 4) AS value FROM orders
UNION ALL SELECT 'snapshot_stock', arg_max(orders, year)::DOUBLE FROM y""")
def f16(t: Tables) -> DataFrame:
    ratio = R.total(nation_frame(t), "mean_price").select(F.lit("ratio").alias("role"), F.round("value", 4).alias("value"))
    stock = R.total(R.ResultFrame(yearly_orders(t), {"year": "temporal", "orders": "snapshot_stock"}), "orders")
    return ratio.unionByName(stock.select(F.lit("snapshot_stock").alias("role"), "value"))


@query("f17_truncation_guard", f"WITH {NATION_SQL} SELECT round(sum(price), 2) AS value FROM n")
def f17(t: Tables) -> DataFrame:
    return R.total(nation_frame(t, limit=5), "price").select(F.round("value", 2).alias("value"))


@query("f18_numeric_coercion", """
SELECT count(*) AS parsed, round(sum(p_retailprice), 2) AS total FROM part""")
def f18(t: Tables) -> DataFrame:
    text = F.concat(F.lit("₹"), F.format_number("p_retailprice", 2))
    rows = t.part.select(text.alias("price"))
    return rows.agg(F.count(R.numeric("price")).alias("parsed"), F.round(F.sum(R.numeric("price")), 2).alias("total"))
