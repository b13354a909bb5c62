"""Registered queries: sources, sinks and data checks. Files are made from the given tables first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.catalog.mining_queries import mining, sql as mining_sql
from ledgerlens.catalog.registry import query
from ledgerlens.operators import aggregates as A
from ledgerlens.operators import checked as C
from ledgerlens.operators import quality as D
from ledgerlens.plans import views as V
from ledgerlens.session import scratch_path
from ledgerlens.sources import readers as S
from ledgerlens.tables import Tables

CUSTOMER = S.Source(
    "customer", ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    {"c_custkey": "int", "c_nationkey": "int", "c_acctbal": "float"}, "c_custkey", 1500)
ORDERS = S.Source(
    "orders", ("o_orderkey", "o_orderdate", "o_totalprice"),
    {"o_orderkey": "int", "o_orderdate": "timestamp", "o_totalprice": "float"}, "o_orderkey")


def as_csv(t: Tables, df: DataFrame, name: str) -> str:
    path = scratch_path(t.spark, name)
    S.export_csv(df, path)
    return path


@query("s01_typed_csv_scan", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def s01(t: Tables) -> DataFrame:
    return S.typed_csv(t.spark, as_csv(t, t.customer.select(*CUSTOMER.columns), "customer"), CUSTOMER)


@query("s01_failed_casts", """
SELECT 'c_custkey' AS column_name, count(*) FILTER (try_cast(c_name AS DOUBLE) IS NULL) AS failed FROM customer
UNION ALL SELECT 'c_nationkey', 0 UNION ALL SELECT 'c_acctbal', 0""")
def s01_failed(t: Tables) -> DataFrame:
    broken = t.customer.select(F.col("c_name").alias("c_custkey"), *CUSTOMER.columns[1:])
    return S.failed_casts(t.spark, as_csv(t, broken, "customer"), CUSTOMER).withColumnRenamed("column", "column_name")


@query("s02_utc_timestamp_cast", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS at_utc FROM orders""")
def s02(t: Tables) -> DataFrame:
    # stored with a +05:30 offset, read back as UTC wall time
    text = F.concat(F.date_format(F.col("o_orderdate") + F.expr("interval '5:30' hour to minute"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30"))
    return t.orders.select("o_orderkey", F.date_format(S.utc_naive(text), "yyyy-MM-dd HH:mm:ss").alias("at_utc"))


@query("s03_parquet_projection", "SELECT count(DISTINCT o_custkey) AS customers FROM orders")
def s03(t: Tables) -> DataFrame:
    return S.parquet_columns(t.spark, f"{t.folder}/orders.parquet", "o_custkey").agg(F.count_distinct("o_custkey").alias("customers"))


@query("s04_table_loader", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s04(t: Tables) -> DataFrame:
    return S.load_table(t.spark, t.folder, "nation", view="loaded_nation")


@query("s05_parquet_sink", "SELECT year(o_orderdate) AS year, count(*) AS orders, round(sum(o_totalprice), 2) AS price FROM orders GROUP BY 1")
def s05(t: Tables) -> DataFrame:
    df = t.orders.select("o_orderkey", "o_totalprice", F.year("o_orderdate").cast("long").alias("year"))
    back = S.write_view(df, scratch_path(t.spark, "orders"), ["year"])
    return back.groupBy(F.col("year").cast("long").alias("year")).agg(
        F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("price"))


@query("s06_view_chain", """
SELECT n_name, count(*) AS customers, CAST(count(*) FILTER (c_acctbal < 0) AS BIGINT) AS in_debt
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def s06(t: Tables) -> DataFrame:
    staging = {
        "stg_customer": lambda spark: t.customer.withColumn("is_in_debt", (F.col("c_acctbal") < 0).cast("int")),
        "stg_nation": lambda spark: t.nation,
    }
    views = {
        "view1_customers": "SELECT c_custkey, n_name, is_in_debt FROM stg_customer JOIN stg_nation ON c_nationkey = n_nationkey",
        "view2_nations": "SELECT n_name, count(*) AS customers, sum(is_in_debt) AS in_debt FROM view1_customers GROUP BY n_name",
    }
    return S.build_pack(t.spark, staging, views, scratch_path(t.spark, "pack"))["view2_nations"]


@query("s07_findings_json", mining_sql("""
SELECT strategy, type AS pattern_type, CAST(sum(n_common) AS BIGINT) AS common_members, round(max(score), 6) AS best_score
FROM finds WHERE NOT low_support GROUP BY ALL"""))
def s07(t: Tables) -> DataFrame:
    found = mining(t).findings
    path = scratch_path(t.spark, "findings")
    S.write_findings(found, path)
    back = S.read_findings(t.spark, path, found.schema)
    return back.select("strategy", "pattern_type", "score", F.explode("commonness").alias("c")).groupBy("strategy", "pattern_type").agg(
        F.sum("c.cnt").alias("common_members"), F.round(F.max("score"), 6).alias("best_score"))


@query("s08_jsonl_scan", "SELECT role, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY role")
def s08(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "conversations")
    t.conversations.write.json(path)
    back = S.read_jsonl(t.spark, path, "conv_id long, turn long, role string, text string")
    return back.groupBy("role").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))


@query("s09_event_table", """
SELECT n_name AS event, CAST(1995 * 12 + n_nationkey AS INTEGER) AS event_first, CAST(1995 * 12 + n_nationkey + 2 AS INTEGER) AS event_last
FROM nation WHERE n_nationkey < 10 AND n_regionkey <> 4""")
def s09(t: Tables) -> DataFrame:
    def month(shift: int):
        return F.date_format(F.add_months(F.lit("1995-01-01").cast("date"), F.col("n_nationkey") + shift), "yyyy-MM")

    rows = t.nation.select(
        F.when(F.col("n_regionkey") == 4, F.concat(F.lit("TODO(SME) "), "n_name")).otherwise(F.col("n_name")).alias("event"),
        month(0).alias("start_month"),
        F.when(F.col("n_nationkey") < 10, month(2)).otherwise("YYYY-MM").alias("end_month"), F.lit("note").alias("note"))
    return S.read_event_table(t.spark, as_csv(t, rows, "events")).select("event", "event_first", "event_last")


@query("s10_result_csv_export", "SELECT r_regionkey, r_name FROM region")
def s10(t: Tables) -> DataFrame:
    return t.spark.read.schema("r_regionkey int, r_name string").option("header", True).csv(as_csv(t, t.region.select("r_regionkey", "r_name"), "region"))


@query("s11_materialised_dashboard", """
SELECT 'by_status' AS id, count(DISTINCT o_orderstatus) AS row_count, 'FRESH' AS status FROM orders
UNION ALL SELECT 'by_segment', count(DISTINCT c_mktsegment), 'FRESH' FROM customer UNION ALL SELECT 'broken', 0, 'ERROR'""")
def s11(t: Tables) -> DataFrame:
    jobs = {
        "by_status": lambda: t.orders.groupBy("o_orderstatus").count(),
        "by_segment": lambda: t.customer.groupBy("c_mktsegment").count(),
        "broken": lambda: t.customer.select("no_such_column"),
    }
    return S.dashboard_status(S.materialise_dashboard(t.spark, jobs, scratch_path(t.spark, "dashboard")))


@query("s12_day_serial_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_date, o_orderkey AS other FROM orders")
def s12(t: Tables) -> DataFrame:
    serial = F.datediff("o_orderdate", F.lit("1899-12-30").cast("date"))
    df = t.orders.select("o_orderkey", serial.alias("order_date"), F.col("o_orderkey").alias("other"))
    return S.with_serial_dates(df, ["order_date", "other"]).withColumn("order_date", F.date_format("order_date", "yyyy-MM-dd"))


# ---- data checks -----------------------------------------------------------------------------

@query("d01_row_count", """SELECT count(*) AS actual, e AS expected, round(abs(count(*) - e) / e * 100, 6) AS off_pct, abs(count(*) - e) / e * 100 < 5 AS passed
FROM orders, (SELECT 10 * count(*) AS e FROM customer) GROUP BY e""")
def d01(t: Tables) -> DataFrame:
    """Ten orders are expected for each customer, at any scale."""
    return D.row_count_check(t.orders, 10 * t.customer.count(), 5.0).withColumns(
        {"off_pct": F.round("off_pct", 6), "expected": F.col("expected").cast("long")})


@query("d02_key_uniqueness", """
SELECT 'lineitem' AS table_name, count(*) AS rows, count(DISTINCT l_orderkey) AS distinct_keys, count(*) - count(DISTINCT l_orderkey) AS duplicates FROM lineitem
UNION ALL SELECT 'orders', count(*), count(DISTINCT o_orderkey), count(*) - count(DISTINCT o_orderkey) FROM orders""")
def d02(t: Tables) -> DataFrame:
    return D.key_uniqueness(t.lineitem, "l_orderkey").withColumn("table_name", F.lit("lineitem")).unionByName(
        D.key_uniqueness(t.orders, "o_orderkey").withColumn("table_name", F.lit("orders")))


@query("d03_foreign_key_orphans", """
SELECT CAST(count(*) FILTER (l_orderkey IS NULL) AS BIGINT) AS orphans, count(*) AS total,
       round(count(*) FILTER (l_orderkey IS NULL) / count(*) * 100, 6) AS orphan_pct
FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey""")
def d03(t: Tables) -> DataFrame:
    return D.foreign_key(t.orders, "o_orderkey", t.lineitem, "l_orderkey").withColumn("orphan_pct", F.round("orphan_pct", 6))


@query("d04_null_rates", """
WITH j AS (SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id))
SELECT 'quality' AS column_name, round(avg(CASE WHEN quality IS NULL THEN 1 ELSE 0 END), 6) AS null_rate FROM j
UNION ALL SELECT 'toxic', round(avg(CASE WHEN toxic IS NULL THEN 1 ELSE 0 END), 6) FROM j""")
def d04(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return D.null_rates(joined, 0.05).withColumn("null_rate", F.round("null_rate", 6))


@query("d05_categorical_domain", "SELECT DISTINCT event_type AS value FROM events WHERE event_type NOT IN ('view', 'click', 'purchase')")
def d05(t: Tables) -> DataFrame:
    return D.unexpected_values(t.events, "event_type", ["view", "click", "purchase"])


@query("d06_date_span", """
SELECT round(date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) / 365.0, 6) AS years,
       date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) / 365.0 BETWEEN 5 AND 8 AS passed FROM orders""")
def d06(t: Tables) -> DataFrame:
    return D.date_span(t.orders, "o_orderdate", 5, 8).withColumn("years", F.round("years", 6))


def _profile_sql(table: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values, count(*) AS rows, "
        f"CAST(min({c}) AS VARCHAR) AS low, CAST(max({c}) AS VARCHAR) AS high FROM {table}" for c in cols)


PROFILED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"]


@query("d07_column_profile", _profile_sql("(SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate) FROM orders)", PROFILED))
def d07(t: Tables) -> DataFrame:
    df = t.orders.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return D.profile(df, PROFILED).withColumn("rows", F.col("rows").cast("long"))


@query("d08_view_check", """
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) FILTER (n > 1) AS repeated_keys, sum(n) BETWEEN 100 AND 10000 AND count(*) FILTER (n > 1) = 0 AS passed
FROM (SELECT l_suppkey, year(l_shipdate) AS y, 1 AS n FROM lineitem GROUP BY 1, 2)""")
def d08(t: Tables) -> DataFrame:
    cube = t.lineitem.groupBy("l_suppkey", F.year("l_shipdate").alias("y")).agg(F.count("*").alias("lines"))
    return D.view_check(cube, ["l_suppkey", "y"], 100, 10000)


@query("d08_checks_with_the_write", """
WITH v AS (SELECT o.*, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS priority FROM orders o),
 n AS (SELECT count(*) AS n, date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) / 365.0 AS years,
         count(*) FILTER (priority IS NULL) / count(*) AS share, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS odd FROM v)
SELECT 'rows' AS check_name, '' AS subject, CAST(n AS DOUBLE) AS found, n BETWEEN 1 AND 1000000000 AS passed FROM n
UNION ALL SELECT 'null_share', 'priority', round(share, 6), share <= 0.05 FROM n
UNION ALL SELECT 'unexpected', 'o_orderstatus', odd, odd = 0 FROM n
UNION ALL SELECT 'span_years', 'o_orderdate', round(years, 6), years BETWEEN 5 AND 8 FROM n
UNION ALL SELECT 'repeated_keys', 'o_orderkey', count(*), count(*) = 0 FROM (SELECT 1 FROM v GROUP BY o_orderkey HAVING count(*) > 1)
UNION ALL SELECT 'repeated_keys', 'o_custkey,o_orderdate', count(*), count(*) = 0
  FROM (SELECT 1 FROM v GROUP BY o_custkey, o_orderdate HAVING count(*) > 1)
UNION ALL SELECT 'duplicates', 'o_custkey', count(*) - count(DISTINCT o_custkey), count(*) = count(DISTINCT o_custkey) FROM v
UNION ALL SELECT 'orphans', 'o_custkey', count(*), count(*) = 0 FROM v WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'orphans', 'o_orderkey', count(*), count(*) = 0 FROM v WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def d08_written(t: Tables) -> DataFrame:
    view = t.orders.withColumn("priority", F.when(F.col("o_orderstatus") == "P", None).otherwise(F.col("o_orderpriority")))
    checks = C.ViewChecks(
        rows=(1, 1_000_000_000), null_share={"priority": 0.05}, domains={"o_orderstatus": ["F", "O"]}, spans={"o_orderdate": (5, 8)},
        grains=(("o_orderkey",), ("o_custkey", "o_orderdate")), unique=("o_custkey",),
        parents={"o_custkey": (t.customer, "c_custkey"), "o_orderkey": (t.lineitem, "l_orderkey")})
    _, report = C.write_checked(view, scratch_path(t.spark, "checked-orders"), checks)
    return report.withColumn("found", F.round("found", 6))


@query("d09_table_parity", """
WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
   CASE WHEN o_orderkey % 50 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 1000 <> 7)
SELECT 'o_totalprice' AS check_name, count(*) FILTER (l.o_totalprice <> r.o_totalprice) AS mismatches FROM orders l JOIN r USING (o_orderkey)
UNION ALL SELECT 'o_orderstatus', count(*) FILTER (l.o_orderstatus <> r.o_orderstatus) FROM orders l JOIN r USING (o_orderkey)
UNION ALL SELECT 'only_left', count(*) FROM orders WHERE o_orderkey % 1000 = 7 UNION ALL SELECT 'only_right', 0""")
def d09(t: Tables) -> DataFrame:
    left = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    key = F.col("o_orderkey")
    right = left.filter(key % 1000 != 7).select(
        "o_orderkey",
        F.when(key % 100 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        F.when(key % 50 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return D.table_parity(left, right, ["o_orderkey"])


@query("d09_equal_tables", "SELECT count(*) AS left_rows, 0 AS rows_to_join FROM lineitem")
def d09_equal(t: Tables) -> DataFrame:
    """A table and its copy in another order: digests agree, so no row is left to join."""
    columns = ["l_partkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    left = t.lineitem.select("l_orderkey", *columns)
    a, b = D.differing_rows(left, left.repartition("l_partkey"), ["l_orderkey"], columns)
    counted = a.select(F.lit(0).alias("all_rows"), F.lit(1).alias("open")).unionByName(
        b.select(F.lit(0).alias("all_rows"), F.lit(1).alias("open"))).unionByName(
        left.groupBy().agg(F.count("*").alias("all_rows")).withColumn("open", F.lit(0)))
    return counted.agg(F.sum("all_rows").alias("left_rows"), F.sum("open").alias("rows_to_join"))


@query("d10_column_pair_parity", """
WITH s AS (SELECT l_orderkey, sum(l_extendedprice) AS spent FROM lineitem GROUP BY 1)
SELECT 'o_totalprice~spent' AS pair, count(*) FILTER (spent IS NULL OR abs(o_totalprice - spent) > 0.005) AS mismatches
FROM orders LEFT JOIN s ON l_orderkey = o_orderkey
UNION ALL SELECT 'o_totalprice~rounded', count(*) FILTER (abs(o_totalprice - round(o_totalprice)) > 0.005) FROM orders""")
def d10(t: Tables) -> DataFrame:
    joined = t.orders.join(V.line_rollup(t).select("o_orderkey", "spent"), "o_orderkey", "left").withColumn(
        "rounded", F.round("o_totalprice"))
    return D.column_pair_parity(joined, [("o_totalprice", "spent"), ("o_totalprice", "rounded")])


@query("d11_swap_diagnosis", """
WITH l AS (SELECT n_nationkey, n_nationkey AS a, n_regionkey AS b FROM nation),
 r AS (SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_regionkey ELSE n_nationkey END AS a,
       CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey WHEN n_nationkey % 3 = 1 THEN -1 ELSE n_regionkey END AS b FROM nation WHERE n_nationkey > 2)
SELECT CASE WHEN r.n_nationkey IS NULL THEN 'left only' WHEN l.a = r.a AND l.b = r.b THEN 'same'
            WHEN l.a = r.b AND l.b = r.a THEN 'swapped' ELSE 'different' END AS verdict, count(*) AS rows
FROM l LEFT JOIN r USING (n_nationkey) GROUP BY 1""")
def d11(t: Tables) -> DataFrame:
    k, g = F.col("n_nationkey"), F.col("n_regionkey")
    left = t.nation.select("n_nationkey", k.alias("a"), g.alias("b"))
    right = t.nation.filter(k > 2).select(
        "n_nationkey", F.when(k % 3 == 0, g).otherwise(k).alias("a"),
        F.when(k % 3 == 0, k).when(k % 3 == 1, -1).otherwise(g).alias("b"))
    return D.swap_diagnosis(left, right, ["n_nationkey"], "a", "b")


@query("d12_crosswalk_profile", " UNION ALL ".join(
    f"SELECT '{tb}' AS table_name, '{c}' AS column_name, round(count({c}) / count(*) * 100, 6) AS fill_pct, count(DISTINCT {c}) AS distinct_values FROM {tb}"
    for tb, cols in {"customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "region": ["r_regionkey", "r_name"]}.items() for c in cols))
def d12(t: Tables) -> DataFrame:
    return D.crosswalk_profile({"customer": t.customer, "region": t.region}).withColumn("fill_pct", F.round("fill_pct", 6))


@query("d13_definitional_pairs", """
WITH v AS (SELECT o_orderstatus, o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END AS finished_price,
   CASE WHEN o_orderpriority = '5-LOW' AND o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS low_quarter FROM orders),
 c AS (SELECT 'o_orderstatus' AS dimension, o_orderstatus AS value, finished_price, low_quarter FROM v
       UNION ALL SELECT 'o_orderpriority', o_orderpriority, finished_price, low_quarter FROM v),
 m AS (SELECT dimension, value, count(*) AS n, 'finished_price' AS measure, count(*) FILTER (finished_price <> 0) AS nz FROM c GROUP BY ALL
       UNION ALL SELECT dimension, value, count(*), 'low_quarter', count(*) FILTER (low_quarter <> 0) FROM c GROUP BY ALL),
 t AS (SELECT *, sum(nz) OVER (PARTITION BY dimension, measure) AS all_nz, sum(n) OVER (PARTITION BY dimension, measure) AS all_n FROM m)
SELECT measure, dimension, value, nz, n FROM t
WHERE (nz / n >= 0.99 AND (all_nz - nz) / (all_n - n) <= 0.01) OR (nz = all_nz AND nz >= 100)""")
def d13(t: Tables) -> DataFrame:
    df = t.orders.select(
        "o_orderstatus", "o_orderpriority",
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0).alias("finished_price"),
        F.when((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderkey") % 4 == 0), 1).otherwise(0).alias("low_quarter"))
    return D.definitional_pairs(df, ["o_orderstatus", "o_orderpriority"], ["finished_price", "low_quarter"])


@query("d14_temporal_support_profile", mining_sql("""
SELECT measure, breakdown, count(*) AS series_examined, count(*) FILTER (NOT ok) AS series_below_guard,
       CAST(min(nz) AS BIGINT) AS nonzero_points_min, CAST(max(nz) AS BIGINT) AS nonzero_points_max
FROM (SELECT measure, breakdown, f1d, f1v, count(*) FILTER (value <> 0) AS nz,
             count(*) FILTER (value <> 0) >= 4 AND count(*) FILTER (value <> 0) >= count(*) / 3.0 AS ok
      FROM pts WHERE temporal GROUP BY ALL) GROUP BY ALL HAVING count(*) FILTER (NOT ok) * 2 > count(*)""", view="events", stage="cube"))
def d14(t: Tables) -> DataFrame:
    from ledgerlens.mining.enrich import support_profile

    return support_profile(mining(t, "events", 1))
