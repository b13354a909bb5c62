"""Registered queries: analytical view recipes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.catalog.registry import query
from ledgerlens.catalog.relational_queries import fy
from ledgerlens.plans import views as V
from ledgerlens.tables import Tables

PLACE = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
ROLL = """roll AS (SELECT l_orderkey AS o_orderkey, sum(l_extendedprice) AS spent, sum(l_quantity) AS quantity, count(*) AS lines,
  max(l_linenumber) AS last_line, min(l_partkey) AS first_part,
  sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) AS returned FROM lineitem GROUP BY 1)"""
DOM = """pt AS (SELECT l_orderkey AS o_orderkey, p_type, sum(l_extendedprice) AS money FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
 rk AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY money DESC, p_type) AS rn FROM pt),
 dom AS (SELECT o_orderkey, sum(money) AS sanctioned, max(p_type) FILTER (rn = 1) AS main_type,
  sum(CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN money ELSE 0 END) AS tied,
  sum(CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN 0 ELSE money END) AS untied FROM rk GROUP BY 1)"""

SQL = {
    "v01_order_lifecycle": f"""WITH {ROLL}, {DOM}
SELECT o_orderkey, r_name, n_name, c_mktsegment, o_orderpriority, o_orderstatus, {fy('o_orderdate')} AS fiscal_year,
  CAST(coalesce(lines, 0) AS BIGINT) AS n_lines, round(spent, 2) AS spent, round(coalesce(spent, 0) - o_totalprice, 2) AS over_plan,
  main_type, round(tied, 2) AS tied, round(untied, 2) AS untied, CASE WHEN returned > 0 THEN 1 ELSE 0 END AS has_return,
  CASE WHEN tied > untied THEN 'tied' WHEN untied > 0 THEN 'untied' ELSE 'none' END AS tied_class
FROM orders JOIN {PLACE} ON o_custkey = c_custkey LEFT JOIN roll USING (o_orderkey) LEFT JOIN dom USING (o_orderkey)""".replace(
        f"JOIN {PLACE} ON o_custkey = c_custkey", f"JOIN (SELECT * FROM {PLACE}) p ON o_custkey = c_custkey"),
    "v02_geo_month_cube": f"""WITH b AS (SELECT date_trunc('month', min(o_orderdate)) AS lo, date_trunc('month', max(o_orderdate)) AS hi FROM orders),
 cal AS (SELECT m FROM (SELECT unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS m FROM b)),
 loc AS (SELECT o.*, n_name FROM orders o JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey),
 fo AS (SELECT n_name, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS orders, sum(o_totalprice) AS price FROM loc GROUP BY 1, 2),
 fl AS (SELECT n_name, strftime(l_shipdate, '%Y-%m') AS month, count(*) AS lines FROM loc JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
 fn AS (SELECT n_name, strftime(d, '%Y-%m') AS month, count(*) AS new_customers FROM (SELECT o_custkey, n_name, min(o_orderdate) AS d FROM loc GROUP BY 1, 2) GROUP BY 1, 2)
SELECT n.n_name, r_name, strftime(m, '%Y-%m') AS month, year(m) || '-Q' || quarter(m) AS quarter, {fy('m')} AS fiscal_year,
  coalesce(orders, 0) AS orders, round(coalesce(price, 0.0), 2) AS price, coalesce(lines, 0) AS lines, coalesce(new_customers, 0) AS new_customers
FROM nation n JOIN region ON n_regionkey = r_regionkey CROSS JOIN cal
LEFT JOIN fo ON fo.n_name = n.n_name AND fo.month = strftime(m, '%Y-%m') LEFT JOIN fl ON fl.n_name = n.n_name AND fl.month = strftime(m, '%Y-%m')
LEFT JOIN fn ON fn.n_name = n.n_name AND fn.month = strftime(m, '%Y-%m')""",
    "v03_supplier_year": """WITH y AS (SELECT DISTINCT year(l_shipdate) AS year FROM lineitem),
 f AS (SELECT l_suppkey, year(l_shipdate) AS year, count(*) AS lines, sum(l_extendedprice) AS price, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2)
SELECT s_suppkey, y.year, coalesce(lines, 0) AS lines, round(coalesce(price, 0.0), 2) AS price,
  round(coalesce(price, 0) / nullif(coalesce(quantity, 0), 0), 6) AS unit_price, CASE WHEN coalesce(lines, 0) = 0 THEN 1 ELSE 0 END AS is_idle
FROM supplier CROSS JOIN y LEFT JOIN f ON l_suppkey = s_suppkey AND f.year = y.year""",
    "v04_expenditure_rollup": f"""WITH {ROLL} SELECT o_orderkey, round(spent, 2) AS spent, round(quantity, 2) AS quantity, lines, last_line, first_part,
  round(returned, 2) AS returned FROM roll""",
    "v05_approval_rollup": f"""WITH {DOM} SELECT o_orderkey, round(sanctioned, 2) AS sanctioned, main_type, round(tied, 2) AS tied, round(untied, 2) AS untied FROM dom""",
    "v06_order_workhorse": """SELECT o_orderkey, n_name, CASE WHEN o_orderstatus = 'F' THEN 'Finished' WHEN o_orderstatus = 'O' THEN 'Open' ELSE 'Partial' END AS status_label,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_completed, CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END AS is_urgent,
  CAST(date_diff('day', o_orderdate::DATE, DATE '2002-01-01') AS INTEGER) AS days_since, lower(c_name || ' ' || o_orderpriority) AS search_text
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "v07_facts_with_places": f"""SELECT 'line' AS kind, r_name, n_name, count(*) AS n, round(sum(l_quantity), 2) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL
UNION ALL SELECT 'order', r_name, n_name, count(*), round(sum(o_totalprice), 2) FROM orders JOIN (SELECT * FROM {PLACE}) ON o_custkey = c_custkey GROUP BY ALL""",
    "v08_user_lifecycle": """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS z FROM events),
 m AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn FROM events GROUP BY 1, 2)
SELECT e.user_id, max(e.event_type) FILTER (a = 1) AS first_event, max(e.event_type) FILTER (z = 1) AS last_event, any_value(m.event_type) AS usual_event,
  count(*) AS events, round(sum(value), 2) AS value, any_value(n_name) AS n_name, any_value(c_mktsegment) AS c_mktsegment
FROM e JOIN m ON m.user_id = e.user_id AND rn = 1 LEFT JOIN (SELECT c_custkey, c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey) ON c_custkey = e.user_id GROUP BY e.user_id""",
    "v09_month_cube_full_join": """WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS orders, sum(o_totalprice) AS price FROM orders GROUP BY 1),
 l AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS lines, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1),
 e AS (SELECT strftime(ts, '%Y-%m') AS month, count(*) AS events FROM events GROUP BY 1)
SELECT month, CAST(orders AS DOUBLE) AS orders, round(price, 2) AS price, CAST(lines AS DOUBLE) AS lines, CAST(events AS DOUBLE) AS events,
  CAST(sum(orders) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS orders_to_date, round(price / orders, 4) AS mean_price,
  round(quantity / lines, 6) AS mean_quantity FROM o FULL JOIN l USING (month) FULL JOIN e USING (month)""",
    "v10_supplier_type": """SELECT s_suppkey, p_type, count(*) AS lines, round(sum(l_extendedprice), 2) AS price,
  round(count(*) / nullif(abs(any_value(s_acctbal)), 0), 9) AS lines_per_balance, CASE WHEN sum(l_extendedprice) = 0 THEN 1 ELSE 0 END AS is_zero
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_suppkey, p_type""",
    "v11_customer_journey": """WITH e AS (SELECT o_custkey, min(o_orderdate) AS f, max(o_orderdate) AS l, count(*) AS orders, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last_status FROM orders GROUP BY 1),
 x AS (SELECT c_custkey, orders, last_status, (epoch(l) - epoch(f)) / 86400.0 AS lag_days FROM customer LEFT JOIN e ON o_custkey = c_custkey)
SELECT c_custkey, CAST(coalesce(orders, 0) AS BIGINT) AS orders, last_status, round(lag_days, 4) AS lag_days, CASE WHEN lag_days IS NULL THEN 'no orders' WHEN lag_days < 30 THEN 'under a month'
  WHEN lag_days < 365 THEN 'under a year' WHEN lag_days < 1460 THEN 'under four years' ELSE 'longer' END AS lag_bucket FROM x""",
    "v12_benefit_facts": """SELECT source, party, count(*) AS facts, round(sum(amount), 2) AS amount FROM (SELECT 'order' AS source, o_custkey AS party, o_totalprice AS amount FROM orders
  UNION ALL SELECT 'line', l_suppkey, l_extendedprice FROM lineitem UNION ALL SELECT 'event', user_id, value FROM events) WHERE amount > 10 GROUP BY ALL""",
    "v13_customer_360": """SELECT c_custkey, c_mktsegment, coalesce(f, 0) AS has_finished, coalesce(u, 0) AS has_urgent, coalesce(p, 0) AS has_purchase, coalesce(r, 0) AS has_error,
  coalesce(f, 0) + coalesce(u, 0) + coalesce(p, 0) + coalesce(r, 0) AS kinds FROM customer
LEFT JOIN (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS f, max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS u FROM orders GROUP BY 1) ON o_custkey = c_custkey
LEFT JOIN (SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS p, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS r FROM events GROUP BY 1) ON user_id = c_custkey""",
    "v14_return_lines": """SELECT l_orderkey, l_partkey, round(l_extendedprice * (1 - l_discount), 4) AS net, CASE WHEN l_discount >= 0.09 THEN 1 ELSE 0 END AS is_deep_discount
FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 40""",
    "v15_equity_cube": """WITH c AS (SELECT n_name, c_mktsegment, count(*) AS customers, count(price) AS with_orders, coalesce(sum(price), 0.0) AS price FROM customer JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS price FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT n_name, c_mktsegment, customers, with_orders, round(with_orders / customers, 6) AS coverage, round(price, 2) AS price,
  round((price / nullif(sum(price) OVER w, 0)) / (customers / sum(customers) OVER w), 6) AS representation FROM c WINDOW w AS (PARTITION BY n_name)""",
    "v16_spend_against_supply": """WITH s AS (SELECT n_name, sum(o_totalprice) AS spend FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
 k AS (SELECT n_name, sum(l_extendedprice) AS cost FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
SELECT n_name, round(spend, 2) AS spend, round(cost, 2) AS cost, round(spend / nullif(cost, 0), 6) AS realisation FROM s JOIN k USING (n_name)""",
    "v17_declared_against_lines": f"""WITH {ROLL} SELECT o_orderkey, o_totalprice, round(spent, 2) AS recorded, round(o_totalprice / nullif(spent, 0), 6) AS ratio,
  CASE WHEN o_totalprice > 1.10 * spent THEN 1 ELSE 0 END AS is_over_declared FROM orders JOIN roll USING (o_orderkey)""",
    "v18_nation_type_mix": """WITH f AS (SELECT n_name, p_type, sum(l_extendedprice) AS price FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2),
 g AS (SELECT n.n_name, ty.p_type, coalesce(price, 0.0) AS price FROM nation n CROSS JOIN (SELECT DISTINCT p_type FROM part) ty LEFT JOIN f ON f.n_name = n.n_name AND f.p_type = ty.p_type)
SELECT n_name, p_type, round(price, 2) AS price, round(price / nullif(sum(price) OVER (PARTITION BY n_name), 0), 6) AS share FROM g""",
}


def _simple(name: str, recipe, finish=lambda df: df) -> None:
    @query(name, SQL[name])
    def run(t: Tables) -> DataFrame:
        return finish(recipe(t))


_simple("v01_order_lifecycle", V.order_lifecycle)
_simple("v02_geo_month_cube", V.geo_month_cube)
_simple("v03_supplier_year", V.supplier_year)
_simple("v04_expenditure_rollup", V.line_rollup, lambda df: df.select(
    "o_orderkey", F.round("spent", 2).alias("spent"), F.round("quantity", 2).alias("quantity"), "lines", "last_line", "first_part",
    F.round("returned", 2).alias("returned")))
_simple("v05_approval_rollup", V.dominant_type, lambda df: df.select(
    "o_orderkey", F.round("sanctioned", 2).alias("sanctioned"), "main_type", F.round("tied", 2).alias("tied"), F.round("untied", 2).alias("untied")))
_simple("v06_order_workhorse", V.order_workhorse)
_simple("v07_facts_with_places", V.facts_with_places)
_simple("v08_user_lifecycle", V.user_lifecycle)
_simple("v09_month_cube_full_join", V.month_cube_full_join, lambda df: df.withColumns(
    {c: F.col(c).cast("double") for c in ("orders", "lines", "events", "orders_to_date")}))
_simple("v10_supplier_type", V.supplier_type)
_simple("v11_customer_journey", V.customer_journey)
_simple("v12_benefit_facts", V.benefit_facts, lambda df: df.filter("amount > 10").groupBy("source", "party").agg(
    F.count("*").alias("facts"), F.round(F.sum("amount"), 2).alias("amount")))
_simple("v13_customer_360", V.customer_360)
_simple("v14_return_lines", V.return_lines)
_simple("v15_equity_cube", V.equity_cube)
_simple("v16_spend_against_supply", V.spend_against_supply)
_simple("v17_declared_against_lines", V.declared_against_lines)
_simple("v18_nation_type_mix", V.nation_type_mix)
