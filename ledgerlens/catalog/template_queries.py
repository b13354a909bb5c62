"""Registered queries: the parameterised query shapes with example values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.catalog.registry import query
from ledgerlens.plans.templates import FISCAL, PLACED, TEMPLATES, dashboard_jobs
from ledgerlens.session import scratch_path
from ledgerlens.sources import readers as S
from ledgerlens.tables import Tables

# name -> (template, values, result SQL)
SHAPES = {
    "q01_scalar_summary": ("Q01", {"nation": "NATION_4"}, f"""
SELECT count(*) AS orders, round(sum(o_totalprice), 2) AS price, count(DISTINCT o_custkey) AS customers FROM {PLACED} WHERE n_name = 'NATION_4'"""),
    "q02_breakdown": ("Q02", {}, f"""
SELECT c_mktsegment, o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS price FROM {PLACED} GROUP BY 1, 2"""),
    "q03_percentage": ("Q03", {"year": 1997}, f"""
SELECT c_mktsegment, round(sum(o_totalprice), 2) AS price, round(sum(o_totalprice) / sum(sum(o_totalprice)) OVER () * 100, 4) AS pct_of_total,
  round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) / sum(o_totalprice) * 100, 4) AS pct_finished
FROM {PLACED} WHERE {FISCAL} = 1997 GROUP BY c_mktsegment"""),
    "q04_top_n": ("Q04", {"top_n": 7}, f"""
SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS price FROM {PLACED} GROUP BY n_name ORDER BY sum(o_totalprice) DESC, n_name LIMIT 7"""),
    "q05_bottom_n": ("Q05", {}, f"""
SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS price FROM {PLACED} GROUP BY n_name ORDER BY sum(o_totalprice), n_name LIMIT 10"""),
    "q06_record_list": ("Q06", {"nation": "NATION_9"}, f"""
SELECT o_orderkey, c_name, o_totalprice FROM {PLACED} WHERE n_name = 'NATION_9' AND o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'"""),
    "q06b_more_than_one_child": ("Q06B", {"n": 5}, """
SELECT l_orderkey, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 5"""),
    "q07_absence_from_roster": ("Q07", {"nation": "NATION_2", "year": 1998}, f"""
SELECT c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_2' AND c_custkey NOT IN (
  SELECT o_custkey FROM orders WHERE {FISCAL} = 1998)"""),
    "q08_roster_denominator": ("Q08", {"year": 1999}, f"""
SELECT n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_custkey) AS with_orders,
  round(count(DISTINCT o_custkey) / nullif(count(DISTINCT c_custkey), 0) * 100, 4) AS pct FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey
LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE {FISCAL} = 1999) ON o_custkey = c_custkey GROUP BY n_name"""),
    "q09_complete_coverage": ("Q09", {}, """
SELECT n_name, c_mktsegment, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) ON o_custkey = c_custkey GROUP BY 1, 2 HAVING count(*) = count(o_custkey)"""),
    "q10_yearly_trend": ("Q10", {}, f"""
SELECT CAST({FISCAL} AS INTEGER) AS fiscal_year, count(*) AS orders, round(sum(o_totalprice), 2) AS price FROM orders GROUP BY 1"""),
    "q11_two_year_change": ("Q11", {"year": 1997, "year_2": 1999}, f"""
SELECT c_mktsegment, later, earlier, later - earlier AS change, round((later - earlier) / nullif(earlier, 0) * 100, 4) AS pct_change FROM (
  SELECT c_mktsegment, count(*) FILTER ({FISCAL} = 1999) AS later, count(*) FILTER ({FISCAL} = 1997) AS earlier FROM {PLACED} GROUP BY 1)"""),
    "q12_side_by_side": ("Q12", {"nation": "NATION_1", "nation_2": "NATION_20"}, f"""
SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS price, count(DISTINCT o_custkey) AS customers FROM {PLACED}
WHERE n_name IN ('NATION_1', 'NATION_20') GROUP BY n_name"""),
    "q13_entity_vs_average": ("Q13", {"nation": "NATION_7"}, f"""
WITH n AS (SELECT n_name, count(*) AS orders FROM {PLACED} GROUP BY 1)
SELECT n_name, orders, round((SELECT avg(orders) FROM n), 6) AS avg_orders, round(orders - (SELECT avg(orders) FROM n), 6) AS difference FROM n WHERE n_name = 'NATION_7'"""),
    "q14_leader_per_group": ("Q14", {}, f"""
SELECT r_name, n_name, orders FROM (SELECT r_name, n_name, count(*) AS orders FROM {PLACED} GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY r_name ORDER BY orders DESC, n_name) = 1"""),
    "q15_value_bands": ("Q15", {}, """
SELECT CASE WHEN o_totalprice < 50000 THEN 'under 50k' WHEN o_totalprice < 200000 THEN '50k to 200k' WHEN o_totalprice < 400000 THEN '200k to 400k'
  ELSE '400k and over' END AS band, count(*) AS orders, round(count(*) / (SELECT count(*) FROM orders) * 100, 4) AS pct FROM orders GROUP BY 1"""),
    "q16_keyword_items_by_stage": ("Q16", {}, """
SELECT count(*) AS lines, round(sum(l_extendedprice), 2) AS planned, count(*) FILTER (l_linestatus = 'O') AS ongoing, count(*) FILTER (l_linestatus = 'F') AS completed,
  round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END), 2) AS returned FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE regexp_matches(lower(p_name || ' ' || coalesce(p_type, '')), 'ring|widget')"""),
    "q17_aged_records": ("Q17", {"as_of": "2001-12-31", "n": 400}, """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS ordered, CAST(date_diff('day', o_orderdate::DATE, DATE '2001-12-31') AS INTEGER) AS days_since
FROM orders WHERE o_orderstatus = 'O' AND date_diff('day', o_orderdate::DATE, DATE '2001-12-31') > 400"""),
    "q18_mismatch_list": ("Q18", {}, """
SELECT o_orderkey, o_totalprice, round(spent, 2) AS spent, round((spent - o_totalprice) / o_totalprice * 100, 4) AS overrun_pct FROM orders
JOIN (SELECT l_orderkey, sum(l_extendedprice) AS spent FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_totalprice > 0 AND spent > o_totalprice * 1.5"""),
    "q18a_quality_counts": ("Q18A", {}, """
SELECT count(*) AS documents, count(*) FILTER (quality IS NULL) AS unlabelled, count(*) FILTER (toxic = 1 AND quality = 1) AS contradictory,
  round(count(*) FILTER (quality IS NULL OR (toxic = 1 AND quality = 1)) / count(*) * 100, 4) AS pct_unusable FROM documents LEFT JOIN labels USING (doc_id)"""),
    "q19_duplicate_text": ("Q19", {}, "SELECT source, md5(text) AS text_hash, count(*) AS copies FROM documents GROUP BY 1, 2 HAVING count(*) > 1"),
    "q20_lookup": ("Q20", {"order": 77}, "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey = 77"),
    "q21_persistence": ("Q21", {"k": 6}, f"""
SELECT o_custkey, count(DISTINCT {FISCAL}) AS years, count(*) AS orders FROM orders GROUP BY 1 HAVING count(DISTINCT {FISCAL}) >= 6"""),
    "q22_quadrant": ("Q22", {}, f"""
WITH n AS (SELECT n_name, c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS price FROM {PLACED} GROUP BY 1, 2)
SELECT n_name, c_mktsegment, orders, price FROM n WHERE price > (SELECT avg(price) FROM n) AND orders < (SELECT avg(orders) FROM n)"""),
    "q23_code_universe": ("Q23", {}, """
SELECT p_partkey, p_name, count(l_partkey) AS lines FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2 HAVING count(l_partkey) < 20"""),
    "q24_receipts_payments_balance": ("Q24", {}, """
SELECT user_id, round(sum(CASE WHEN event_type IN ('purchase', 'signup') THEN value ELSE 0 END), 2) AS receipts,
  round(sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END), 2) AS payments,
  round(sum(CASE WHEN event_type IN ('purchase', 'signup') THEN value WHEN event_type = 'error' THEN -value ELSE 0 END), 2) AS balance FROM events GROUP BY user_id"""),
}


def _register(name: str, template: str, values: dict, sql: str) -> None:
    @query(name, sql)
    def run(t: Tables) -> DataFrame:
        t.register(TEMPLATES[template].tables)
        return TEMPLATES[template].run(t.spark, values)


for _name, (_template, _values, _sql) in SHAPES.items():
    _register(_name, _template, _values, _sql)


@query("s11_template_dashboard", f"""
SELECT 'Q14' AS id, count(DISTINCT r_name) AS row_count, 'FRESH' AS status FROM {PLACED}
UNION ALL SELECT 'Q15', count(DISTINCT CASE WHEN o_totalprice < 50000 THEN 1 WHEN o_totalprice < 200000 THEN 2 WHEN o_totalprice < 400000 THEN 3 ELSE 4 END), 'FRESH' FROM orders
UNION ALL SELECT 'Q24', count(DISTINCT user_id), 'FRESH' FROM events""")
def s11_templates(t: Tables) -> DataFrame:
    t.register()
    table = S.materialise_dashboard(t.spark, dashboard_jobs(t.spark, ["Q14", "Q15", "Q24"]), scratch_path(t.spark, "dashboard"))
    return S.dashboard_status(table)


@query("o03_bounded_store", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) = 1)
ORDER BY o_totalprice DESC, o_custkey DESC LIMIT 100""")
def o03(t: Tables) -> DataFrame:
    from ledgerlens.operators.aggregates import bounded_store

    return bounded_store(t.orders, "o_custkey", "o_totalprice", "o_orderkey", 100).select("o_custkey", "o_orderkey", "o_totalprice")
