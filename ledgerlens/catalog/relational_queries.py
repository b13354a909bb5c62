"""Registered queries: expressions, joins, aggregates, windows, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.catalog.registry import query
from ledgerlens.functions import columns as C
from ledgerlens.operators import aggregates as A
from ledgerlens.operators import joins as J
from ledgerlens.operators.scan import scan
from ledgerlens.tables import Tables

TYPE_NAMES = {"ECONOMY": "Economy line", "LARGE": "Large line", "PROMO": "Promotion"}
FY_SQL = "(year({d}) - CASE WHEN month({d}) >= 4 THEN 0 ELSE 1 END)"
FYL_SQL = "(" + FY_SQL + " || '-' || (" + FY_SQL + " + 1))"


def fy(d: str) -> str:
    return FYL_SQL.format(d=d)


# ---- expressions -----------------------------------------------------------------------------

@query("p01_decode_with_default", """
SELECT p_partkey, coalesce(r_name, 'Code ' || p_size) AS size_label
FROM part LEFT JOIN region ON r_regionkey = p_size""")
def p01(t: Tables) -> DataFrame:
    return J.decode(t.part, t.region, "p_size", "r_regionkey", "r_name").select(
        "p_partkey", C.decoded("r_name", "p_size").alias("size_label"))


@query("p02_code_normalisation", """
SELECT p_partkey, CAST(CAST(CAST((p_size || '.0') AS DOUBLE) AS BIGINT) AS VARCHAR) AS size_code FROM part""")
def p02(t: Tables) -> DataFrame:
    raw = F.concat(F.col("p_size").cast("string"), F.lit(".0"))
    return t.part.select("p_partkey", C.normalised_code(raw).alias("size_code"))


@query("p03_label_cleaning", r"""
SELECT doc_id, md5(trim(replace(text, chr(9), ' '), ' ')) AS cleaned_hash FROM documents""")
def p03(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(C.clean_label("text")).alias("cleaned_hash"))


@query("p04_flag_columns", """
SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate::VARCHAR AS shipped,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_returned,
       CASE WHEN l_linestatus = 'O' AND l_discount = 0 THEN 1 ELSE 0 END AS is_open_full_price FROM lineitem""")
def p04(t: Tables) -> DataFrame:
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("shipped"),
        C.flag(F.col("l_returnflag") == "R").alias("is_returned"),
        C.flag((F.col("l_linestatus") == "O") & (F.col("l_discount") == 0)).alias("is_open_full_price"))


@query("p05_category_ladder", """
SELECT category, count(*) AS parts FROM (
  SELECT CASE WHEN upper(p_name) LIKE '%RED%' OR upper(p_name) LIKE '%BLUE%' THEN 'Coloured'
              WHEN upper(p_name) IN ('SMALL RING', 'SMALL WIDGET') THEN 'Small goods'
              ELSE trim(p_name) END AS category FROM part) GROUP BY category""")
def p05(t: Tables) -> DataFrame:
    name = F.upper("p_name")
    ladder = C.category_ladder("p_name", [
        (name.like("%RED%") | name.like("%BLUE%"), "Coloured"),
        (name.isin("SMALL RING", "SMALL WIDGET"), "Small goods")])
    return t.part.groupBy(ladder.alias("category")).agg(F.count("*").alias("parts"))


@query("p06_range_bucket", """
SELECT band, count(*) AS parts FROM (SELECT CASE WHEN p_size IS NULL THEN NULL WHEN p_size < 10 THEN 'small'
  WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS band FROM part) GROUP BY band""")
def p06(t: Tables) -> DataFrame:
    return t.part.groupBy(C.bucket("p_size", [10, 30], ["small", "medium", "large"]).alias("band")).agg(
        F.count("*").alias("parts"))


@query("p07_prefix_class", """
SELECT class, count(*) AS parts FROM (SELECT CASE WHEN substr(upper(trim(p_type)), 1, 1) IN ('E', 'P') THEN 'value'
  WHEN substr(upper(trim(p_type)), 1, 1) IN ('S', 'M', 'L') THEN 'sized' ELSE 'other' END AS class FROM part)
GROUP BY class""")
def p07(t: Tables) -> DataFrame:
    return t.part.groupBy(C.prefix_class("p_type", {"EP": "value", "SML": "sized"}, "other").alias("class")).agg(
        F.count("*").alias("parts"))


@query("p08_data_relative_now", """
SELECT c_mktsegment, CAST(min(date_diff('day', o_orderdate::DATE, (SELECT max(o_orderdate)::DATE FROM orders))) AS BIGINT) AS days_quiet
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")
def p08(t: Tables) -> DataFrame:
    as_of = t.orders.agg(F.max("o_orderdate")).first()[0]
    last = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(
        F.max("o_orderdate").alias("last_order"))
    return last.select("c_mktsegment", C.days_since("last_order", F.lit(as_of)).cast("long").alias("days_quiet"))


@query("p09_period_keys", f"""
SELECT strftime(o_orderdate, '%Y-%m') AS month, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS quarter,
       year(o_orderdate) AS year, {fy('o_orderdate')} AS fiscal_year, count(*) AS orders
FROM orders GROUP BY 1, 2, 3, 4""")
def p09(t: Tables) -> DataFrame:
    return t.orders.groupBy(
        C.month_key("o_orderdate").alias("month"), C.quarter_key("o_orderdate").alias("quarter"),
        F.year("o_orderdate").cast("long").alias("year"), C.fiscal_year("o_orderdate").alias("fiscal_year"),
    ).agg(F.count("*").alias("orders"))


@query("p10_year_label", """
SELECT DISTINCT CAST(year(o_orderdate) AS VARCHAR) AS start_year, year(o_orderdate) || '-' || (year(o_orderdate) + 1) AS label
FROM orders""")
def p10(t: Tables) -> DataFrame:
    start = F.year("o_orderdate").cast("string")
    return t.orders.select(start.alias("start_year"), C.year_label(start).alias("label")).distinct()


@query("p11_duration_days", """
SELECT user_id, round(avg(days), 6) AS mean_days FROM (
  SELECT user_id, (epoch_ms(date_trunc('second', ts)) - epoch_ms(date_trunc('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)))) / 86400000.0 AS days
  FROM events) GROUP BY user_id""")
def p11(t: Tables) -> DataFrame:
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    gaps = t.events.select("user_id", C.days_between(before, "ts").alias("days"))
    return gaps.groupBy("user_id").agg(F.round(F.avg("days"), 6).alias("mean_days"))


@query("p12_days_since", """
SELECT o_orderkey, CAST(date_diff('day', o_orderdate::DATE, DATE '2002-01-01') AS INTEGER) AS days_since FROM orders""")
def p12(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey", C.days_since("o_orderdate", F.lit("2002-01-01").cast("date")).alias("days_since"))


@query("p13_safe_ratio", """
SELECT c_custkey, round(c_acctbal / nullif(p_size - 10, 0), 8) AS ratio FROM customer LEFT JOIN part ON p_partkey = c_custkey""")
def p13(t: Tables) -> DataFrame:
    joined = t.customer.join(t.part, F.col("p_partkey") == F.col("c_custkey"), "left")
    return joined.select("c_custkey", F.round(C.safe_ratio("c_acctbal", (F.col("p_size") - 10).cast("double")), 8).alias("ratio"))


@query("p14_signed_difference", """
WITH s AS (SELECT l_orderkey, sum(l_extendedprice) AS spent FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)
SELECT o_orderkey, round(coalesce(spent, 0) - coalesce(o_totalprice, 0), 2) AS over_plan,
       round(coalesce(o_totalprice, 0) - spent, 2) AS under_sanction
FROM orders LEFT JOIN s ON l_orderkey = o_orderkey""")
def p14(t: Tables) -> DataFrame:
    spent = t.lineitem.filter(F.col("l_returnflag") == "R").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_extendedprice").alias("spent"))
    return t.orders.join(spent, "o_orderkey", "left").select(
        "o_orderkey", F.round(C.signed_difference("spent", "o_totalprice"), 2).alias("over_plan"),
        F.round(C.signed_difference("o_totalprice", "spent", keep_null_base=True), 2).alias("under_sanction"))


@query("p15_search_text", """
SELECT p_partkey, lower(p_name || ' ' || coalesce(p_type, '')) AS search_text FROM part""")
def p15(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", C.search_text("p_name", F.coalesce("p_type", F.lit(""))).alias("search_text"))


@query("p16_substring", """
SELECT substr(strftime(o_orderdate, '%Y-%m'), 1, 4) AS year_part, substr(o_orderpriority, 1, 1) AS level, count(*) AS orders
FROM orders GROUP BY 1, 2""")
def p16(t: Tables) -> DataFrame:
    return t.orders.groupBy(
        F.substring(C.month_key("o_orderdate"), 1, 4).alias("year_part"),
        F.substring("o_orderpriority", 1, 1).alias("level")).agg(F.count("*").alias("orders"))


@query("p17_unit_conversion", "SELECT p_partkey, round(p_size * 2.471, 3) AS acres FROM part")
def p17(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.round(F.col("p_size") * 2.471, 3).alias("acres"))


@query("p18_threshold_flag", """
SELECT l_returnflag, CAST(sum(CASE WHEN l_tax > 1.10 * l_discount THEN 1 ELSE 0 END) AS BIGINT) AS over_declared
FROM lineitem GROUP BY l_returnflag""")
def p18(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(
        F.sum(C.flag(F.col("l_tax") > 1.10 * F.col("l_discount"))).alias("over_declared"))


@query("p19_equality_slice", """
SELECT l_linestatus, count(*) AS lines, round(sum(l_quantity), 2) AS quantity FROM lineitem
WHERE l_returnflag = 'R' AND l_discount = 0.05 GROUP BY l_linestatus""")
def p19(t: Tables) -> DataFrame:
    return t.lineitem.filter((F.col("l_returnflag") == "R") & (F.col("l_discount") == 0.05)).groupBy("l_linestatus").agg(
        F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("p20_optional_filter", """
SELECT c_mktsegment, count(*) AS customers FROM customer WHERE c_nationkey = 3 GROUP BY c_mktsegment""")
def p20(t: Tables) -> DataFrame:
    rows = C.optional_filter(C.optional_filter(t.customer, "c_nationkey", 3), "c_mktsegment", None)
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("customers"))


@query("p21_date_window", """
SELECT o_orderstatus, count(*) AS orders FROM orders
WHERE o_orderdate::DATE BETWEEN DATE '1997-04-01' AND DATE '1998-03-31' GROUP BY o_orderstatus""")
def p21(t: Tables) -> DataFrame:
    return C.date_window(t.orders, "o_orderdate", "iso", "1997-04-01", "1998-03-31").groupBy("o_orderstatus").agg(
        F.count("*").alias("orders"))


@query("p22_null_safe_compare", """
SELECT count(*) FILTER (l.quality IS NOT DISTINCT FROM l.toxic) AS same, count(*) FILTER (l.quality IS DISTINCT FROM l.toxic) AS differ
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def p22(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    same = F.col("quality").eqNullSafe(F.col("toxic"))
    return joined.agg(F.count_if(same).alias("same"), F.count_if(~same).alias("differ"))


# ---- joins -----------------------------------------------------------------------------------

@query("j01_inner_join", """
SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name""")
def j01(t: Tables) -> DataFrame:
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(
        F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("j02_left_rollups", """
WITH a AS (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1),
     b AS (SELECT l_orderkey, max(l_tax) AS top_tax FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey, CAST(a.lines AS DOUBLE) AS lines, b.top_tax FROM orders LEFT JOIN a ON a.l_orderkey = o_orderkey LEFT JOIN b ON b.l_orderkey = o_orderkey""")
def j02(t: Tables) -> DataFrame:
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    returned = F.col("l_returnflag") == "R"
    # both child roll-ups share one aggregation over the same key
    return J.left_rollup(
        t.orders.select("o_orderkey"), lines, "o_orderkey",
        F.count("*").cast("double").alias("lines"), F.max(F.when(returned, F.col("l_tax"))).alias("top_tax"))


@query("j03_constant_side_join", """
SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey = 1""")
def j03(t: Tables) -> DataFrame:
    one_region = t.nation.filter(F.col("n_regionkey") == 1)
    return J.decode(t.customer, one_region, "c_nationkey", "n_nationkey", "n_name").select("c_custkey", "n_name")


@query("j04_full_outer_using", """
WITH a AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS orders FROM orders GROUP BY 1),
 b AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS lines FROM lineitem GROUP BY 1),
 c AS (SELECT strftime(ts, '%Y-%m') AS month, count(*) AS events FROM events GROUP BY 1)
SELECT month, CAST(orders AS DOUBLE) AS orders, CAST(lines AS DOUBLE) AS lines, CAST(events AS DOUBLE) AS events FROM a FULL JOIN b USING (month) FULL JOIN c USING (month)""")
def j04(t: Tables) -> DataFrame:
    def per_month(df, date, name):
        return df.groupBy(C.month_key(date).alias("month")).agg(F.count("*").cast("double").alias(name))

    return per_month(t.orders, "o_orderdate", "orders").join(
        per_month(t.lineitem, "l_shipdate", "lines"), "month", "full").join(
        per_month(t.events, "ts", "events"), "month", "full")


@query("j05_zero_filled_grid", """
WITH b AS (SELECT date_trunc('month', min(o_orderdate)) AS lo, date_trunc('month', max(o_orderdate)) AS hi FROM orders),
 cal AS (SELECT strftime(m, '%Y-%m') AS month FROM (SELECT unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS m FROM b)),
 f AS (SELECT n_name, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS orders, round(sum(o_totalprice), 2) AS price
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2)
SELECT n.n_name, cal.month, coalesce(orders, 0) AS orders, coalesce(price, 0.0) AS price
FROM nation n CROSS JOIN cal LEFT JOIN f ON f.n_name = n.n_name AND f.month = cal.month""")
def j05(t: Tables) -> DataFrame:
    spine = J.grid(t.nation.select("n_name"), "month", J.month_axis(t.orders, "o_orderdate"))
    facts = (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name", C.month_key("o_orderdate").alias("month"))
        .agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("price")))
    return J.zero_filled(spine, facts, ["n_name", "month"], ["orders", "price"])


@query("j06_anti_join_orphans", """
SELECT o_orderkey FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey WHERE l_orderkey IS NULL""")
def j06(t: Tables) -> DataFrame:
    return J.orphans(t.orders, t.lineitem, "o_orderkey", "l_orderkey").select("o_orderkey")


@query("j07_semi_join", """
SELECT o_orderpriority, count(*) AS orders FROM orders WHERE o_custkey IN (
  SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)) GROUP BY 1""")
def j07(t: Tables) -> DataFrame:
    nations = t.nation.filter(F.col("n_regionkey") == 2)
    customers = t.customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return t.orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left_semi").groupBy("o_orderpriority").agg(
        F.count("*").alias("orders"))


@query("j08_majority_vote_map", """
SELECT s_nationkey, p_brand, votes FROM (
  SELECT s_nationkey, p_brand, count(*) AS votes, row_number() OVER (PARTITION BY s_nationkey ORDER BY count(*) DESC, p_brand) AS rn
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) WHERE rn = 1""")
def j08(t: Tables) -> DataFrame:
    pairs = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(
        t.part, F.col("l_partkey") == F.col("p_partkey")).select("s_nationkey", "p_brand")
    return J.majority_map(pairs, "s_nationkey", "p_brand")


@query("j09_roster_without_record", """
SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'
  AND year(o_orderdate) = 1997)""")
def j09(t: Tables) -> DataFrame:
    seen = t.orders.filter((F.col("o_orderstatus") == "P") & (F.year("o_orderdate") == 1997))
    return t.customer.join(seen, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("j10_interval_match_with_grace", """
WITH p AS (SELECT DISTINCT year(o_orderdate) || '-Q' || quarter(o_orderdate) AS label,
              year(o_orderdate) * 12 + (quarter(o_orderdate) - 1) * 3 AS first FROM orders),
 e AS (SELECT CAST(n_nationkey AS VARCHAR) AS event, 1995 * 12 + n_nationkey * 3 AS ef, 1995 * 12 + n_nationkey * 3 + 2 + n_regionkey AS el FROM nation)
SELECT label, event, CASE WHEN first <= el AND first + 2 >= ef THEN 'inside' ELSE 'in the months just after' END AS relation
FROM p, e WHERE (first <= el AND first + 2 >= ef) OR (first > el AND first <= el + 3)""")
def j10(t: Tables) -> DataFrame:
    periods = J.with_bounds(t.orders.select(C.quarter_key("o_orderdate").alias("label"))).select("label", "b.first", "b.last")
    start = F.lit(1995 * 12) + F.col("n_nationkey") * 3
    events = t.nation.select(
        F.col("n_nationkey").cast("string").alias("event"), start.alias("event_first"),
        (start + 2 + F.col("n_regionkey")).alias("event_last"))
    return J.period_matches(periods, events).select("label", "event", "relation")


# ---- aggregates ------------------------------------------------------------------------------

@query("a01_group_by", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 6) AS discount,
       count(*) AS lines, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY 1, 2""")
def a01(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"),
        F.count("*").alias("lines"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))


@query("a02_count_distinct", """
SELECT p_brand, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_suppkey) AS suppliers
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""")
def a02(t: Tables) -> DataFrame:
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(
        F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("a03_conditional_aggregation", """
SELECT event_type, round(sum(CASE WHEN value > 50 THEN value ELSE 0 END), 2) AS high_value,
       count(*) FILTER (value <= 50) AS low_events FROM events GROUP BY event_type""")
def a03(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(
        F.round(A.sum_where(F.col("value") > 50, "value"), 2).alias("high_value"),
        F.count_if(F.col("value") <= 50).alias("low_events"))


@query("a04_arg_max", """
SELECT l_orderkey, min(l_partkey) AS top_part FROM (
  SELECT l_orderkey, l_partkey, rank() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC) AS r FROM lineitem)
WHERE r = 1 GROUP BY l_orderkey""")
def a04(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(A.arg_max("l_partkey", "l_extendedprice").alias("top_part"))


@query("a05_mode", """
SELECT user_id, event_type AS usual_event FROM (SELECT user_id, event_type,
  row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn FROM events GROUP BY 1, 2) WHERE rn = 1""")
def a05(t: Tables) -> DataFrame:
    return A.mode_by_count(t.events, ["user_id"], "event_type", "usual_event")


@query("a06_membership_flags", """
SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS has_purchase,
       max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS has_signup FROM events GROUP BY user_id""")
def a06(t: Tables) -> DataFrame:
    return A.membership_flags(t.events, "user_id", "event_type", ["purchase", "signup"])


@query("a07_ratio_of_sums", """
SELECT p_type, round(sum(l_extendedprice) / nullif(sum(l_quantity), 0), 6) AS price_per_unit
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type""")
def a07(t: Tables) -> DataFrame:
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type").agg(
        F.round(A.ratio_of_sums("l_extendedprice", "l_quantity"), 6).alias("price_per_unit"))


@query("a08_two_level_share", """
SELECT n_name, c_mktsegment, round(balance / sum(balance) OVER (PARTITION BY n_name), 6) AS share FROM (
  SELECT n_name, c_mktsegment, sum(abs(c_acctbal)) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)""")
def a08(t: Tables) -> DataFrame:
    cells = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "c_mktsegment").agg(
        F.sum(F.abs("c_acctbal")).alias("balance"))
    return A.share_within(cells, ["n_name"], "balance", "share").select(
        "n_name", "c_mktsegment", F.round("share", 6).alias("share"))


@query("a11_distinct_grain", """
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_keys, count(*) FILTER (n > 1) AS repeated_keys
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def a11(t: Tables) -> DataFrame:
    return A.distinct_grain(t.lineitem, ["l_orderkey", "l_linenumber"])


# ---- windows, order, sets --------------------------------------------------------------------

@query("w01_latest_row_per_key", """
SELECT user_id, event_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def w01(t: Tables) -> DataFrame:
    return A.one_per_key(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select(
        "user_id", "event_id", "event_type")


@query("w02_ranked_pairing", """
SELECT n_name, c_mktsegment, customers FROM (SELECT n_name, c_mktsegment, count(*) AS customers,
  row_number() OVER (PARTITION BY n_name ORDER BY count(*) DESC, c_mktsegment) AS rn
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) WHERE rn <= 2""")
def w02(t: Tables) -> DataFrame:
    counted = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "c_mktsegment").agg(
        F.count("*").alias("customers"))
    ranked = counted.withColumn("rn", F.row_number().over(
        Window.partitionBy("n_name").orderBy(F.desc("customers"), "c_mktsegment")))
    return ranked.filter("rn <= 2").drop("rn")


@query("w03_running_total", """
SELECT o_orderstatus, month, CAST(sum(n) OVER (PARTITION BY o_orderstatus ORDER BY month ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running
FROM (SELECT o_orderstatus, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1, 2)""")
def w03(t: Tables) -> DataFrame:
    monthly = t.orders.groupBy("o_orderstatus", C.month_key("o_orderdate").alias("month")).agg(F.count("*").alias("n"))
    return A.running_total(monthly, ["o_orderstatus"], "month", "n", "running").drop("n")


@query("w04_share_of_total", """
SELECT p_brand, round(sum(p_retailprice) / (SELECT sum(p_retailprice) FROM part) * 100, 6) AS pct FROM part GROUP BY p_brand""")
def w04(t: Tables) -> DataFrame:
    from ledgerlens.operators.result_frames import ResultFrame, share_of_total

    brands = t.part.groupBy("p_brand").agg(F.sum("p_retailprice").alias("price"))
    return share_of_total(ResultFrame(brands, {"price": "additive_value"}), "price", decimals=6).select("p_brand", F.col("price_pct").alias("pct"))


@query("w05_first_to_last_change", """
SELECT c_mktsegment, round((arg_max(v, y) - arg_min(v, y)) / abs(arg_min(v, y)) * 100, 6) AS pct_change FROM (
  SELECT c_mktsegment, year(o_orderdate) AS y, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
GROUP BY c_mktsegment""")
def w05(t: Tables) -> DataFrame:
    yearly = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(
        "c_mktsegment", F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("v"))
    return A.first_last_change(yearly, ["c_mktsegment"], "y", "v").select(
        "c_mktsegment", F.round("pct_change", 6).alias("pct_change"))


@query("w06_top_one_per_group", """
SELECT n_regionkey, n_name, balance FROM (SELECT n_regionkey, n_name, round(sum(c_acctbal), 2) AS balance,
  row_number() OVER (PARTITION BY n_regionkey ORDER BY sum(c_acctbal) DESC, n_name) AS rn
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) WHERE rn = 1""")
def w06(t: Tables) -> DataFrame:
    sums = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_name").agg(
        F.sum("c_acctbal").alias("balance"))
    return A.one_per_key(sums, ["n_regionkey"], [F.desc("balance"), "n_name"]).withColumn(
        "balance", F.round("balance", 2))


@query("u01_union_all_facts", """
SELECT source, count(*) AS rows, round(sum(amount), 2) AS amount FROM (
  SELECT 'order' AS source, o_totalprice AS amount FROM orders UNION ALL SELECT 'line', l_extendedprice FROM lineitem
  UNION ALL SELECT 'event', value FROM events) GROUP BY source""")
def u01(t: Tables) -> DataFrame:
    from ledgerlens.plans.views import benefit_facts

    return benefit_facts(t).groupBy("source").agg(F.count("*").alias("rows"), F.round(F.sum("amount"), 2).alias("amount"))


@query("u02_union_of_domains", """
SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT p_size FROM part""")
def u02(t: Tables) -> DataFrame:
    parts = [t.customer.select(F.col("c_nationkey").alias("nationkey")), t.supplier.select("s_nationkey"),
             t.part.select("p_size")]
    # each side is reduced before the union, so the final distinct sees domains and not rows
    out = parts[0].distinct()
    for p in parts[1:]:
        out = out.union(p.distinct())
    return out.distinct()


@query("u03_intersect_keys", "SELECT o_orderkey AS key FROM orders INTERSECT SELECT l_orderkey FROM lineitem")
def u03(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("key")).intersect(t.lineitem.select("l_orderkey"))


@query("u04_set_difference", "SELECT o_orderkey AS key FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def u04(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("key")).join(
        t.lineitem, F.col("key") == F.col("l_orderkey"), "left_anti").distinct()


@query("g01_month_calendar", """
SELECT strftime(m, '%Y-%m') AS month, year(m) || '-Q' || quarter(m) AS quarter FROM (
  SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS m FROM orders)""")
def g01(t: Tables) -> DataFrame:
    bounds = t.orders.agg(F.trunc(F.min("o_orderdate"), "month").alias("lo"), F.trunc(F.max("o_orderdate"), "month").alias("hi"))
    return bounds.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("m")).select(
        C.month_key("m").alias("month"), C.quarter_key("m").alias("quarter"))


@query("g02_observed_domain_spine", f"SELECT DISTINCT {fy('o_orderdate')} AS fiscal_year, o_orderstatus FROM orders")
def g02(t: Tables) -> DataFrame:
    return t.orders.select(C.fiscal_year("o_orderdate").alias("fiscal_year"), "o_orderstatus").distinct()


@query("o01_sort_null_placement", """
SELECT doc_id, CAST(quality AS DOUBLE) AS quality, row_number() OVER (ORDER BY quality DESC NULLS FIRST, doc_id) AS position
FROM documents LEFT JOIN labels USING (doc_id)""")
def o01(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id").join(t.labels.select("doc_id", F.col("quality").cast("double").alias("quality")), "doc_id", "left")
    return scan(rows, [], [F.desc_nulls_first("quality"), F.col("doc_id")]).drop("group_rows")


@query("o02_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def o02(t: Tables) -> DataFrame:
    from ledgerlens.operators.result_frames import ResultFrame, top_n

    frame = ResultFrame(t.orders.select("o_orderkey", "o_totalprice"), {"o_totalprice": "additive_value"})
    return top_n(frame, "o_totalprice", tie=["o_orderkey"])


@query("o04_content_hash", """
WITH r AS (SELECT sha256(concat_ws(chr(31), n_nationkey, n_name, n_regionkey)) AS h FROM nation)
SELECT count(*) AS row_count, sha256(concat_ws(':', sum(('0x' || substr(h, 1, 15))::BIGINT), sum(('0x' || substr(h, 16, 15))::BIGINT),
  sum(('0x' || substr(h, 31, 15))::BIGINT), sum(('0x' || substr(h, 46, 15))::BIGINT))) AS content_hash FROM r""")
def o04(t: Tables) -> DataFrame:
    return A.content_hash(t.nation, ["n_nationkey", "n_name", "n_regionkey"])
