"""Pre-approved parameterised reporting queries: one statement per shape, bound by name.

Values are bound as typed literals, so `(:p IS NULL OR col = :p)` with no value folds away and
a given value is pushed to the scan like any written predicate.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.tables import TABLES

DEFAULT_TOP_N = 10

PLACED = """orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey"""
FISCAL = "(year(o_orderdate) - CASE WHEN month(o_orderdate) >= 4 THEN 0 ELSE 1 END)"


class Unbound(ValueError):
    """A required parameter has no value, or a value is not allowed."""


@dataclass(frozen=True)
class Template:
    """A statement with its parameters: required, optional (unset means no filter) and page size."""

    id: str
    question: str
    sql: str
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    defaults: tuple[tuple[str, Any], ...] = ()

    @property
    def tables(self) -> list[str]:
        return [t for t in TABLES if re.search(rf"\b{t}\b", self.sql)]

    def bind(self, values: dict[str, Any]) -> dict[str, Any]:
        """One value per name: required ones must be there, optional ones become NULL."""
        known = set(self.required) | set(self.optional) | {k for k, _ in self.defaults}
        stray = set(values) - known
        if stray:
            raise Unbound(f"{self.id} has no parameter {sorted(stray)}")
        missing = [p for p in self.required if values.get(p) is None]
        if missing:
            raise Unbound(f"{self.id} needs {missing}")
        args = {p: values[p] for p in self.required}
        args.update({p: values.get(p) for p in self.optional})
        for name, default in self.defaults:
            given = values.get(name)
            args[name] = default if given is None else given
        if "top_n" in args:
            # an unset page size must not mean all rows
            args["top_n"] = max(int(args["top_n"]), 1)
        return ordered_years(args)

    def run(self, spark: SparkSession, values: dict[str, Any] | None = None) -> DataFrame:
        return spark.sql(self.sql, args=self.bind(values or {}))


def ordered_years(args: dict[str, Any]) -> dict[str, Any]:
    """Of a pair (year, year_2) the second is the earlier one, however they were given."""
    if args.get("year") is not None and args.get("year_2") is not None and args["year"] < args["year_2"]:
        args = {**args, "year": args["year_2"], "year_2": args["year"]}
    return args


TOP = (("top_n", DEFAULT_TOP_N),)

TEMPLATES = {t.id: t for t in (
    Template("Q01", "How much was ordered in all, optionally in one nation and year?", f"""
SELECT count(*) AS orders, round(sum(o_totalprice), 2) AS price, count(DISTINCT o_custkey) AS customers FROM {PLACED}
WHERE (:nation IS NULL OR n_name = :nation) AND (:year IS NULL OR {FISCAL} = :year)""", optional=("nation", "year")),
    Template("Q02", "How do orders break down by segment and status?", f"""
SELECT c_mktsegment, o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS price FROM {PLACED}
WHERE (:nation IS NULL OR n_name = :nation) GROUP BY c_mktsegment, o_orderstatus""", optional=("nation",)),
    Template("Q03", "What share of the money does each segment have, and how much of it is finished?", f"""
SELECT c_mktsegment, round(sum(o_totalprice), 2) AS price,
  round(sum(o_totalprice) / sum(sum(o_totalprice)) OVER () * 100, 4) AS pct_of_total,
  round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) / nullif(sum(o_totalprice), 0) * 100, 4) AS pct_finished
FROM {PLACED} WHERE (:year IS NULL OR {FISCAL} = :year) GROUP BY c_mktsegment""", optional=("year",)),
    Template("Q04", "Which nations order most?", f"""
SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS price FROM {PLACED}
WHERE (:region IS NULL OR r_name = :region) GROUP BY n_name ORDER BY sum(o_totalprice) DESC, n_name LIMIT :top_n""",
             optional=("region",), defaults=TOP),
    Template("Q05", "Which nations order least?", f"""
SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS price FROM {PLACED}
WHERE (:region IS NULL OR r_name = :region) GROUP BY n_name ORDER BY sum(o_totalprice), n_name LIMIT :top_n""",
             optional=("region",), defaults=TOP),
    Template("Q06", "Which orders of a nation are urgent and still open?", f"""
SELECT o_orderkey, c_name, o_totalprice FROM {PLACED}
WHERE n_name = :nation AND o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'""", required=("nation",)),
    Template("Q06B", "Which orders are linked to more than a number of suppliers?", """
SELECT l_orderkey, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) > :n""",
             defaults=(("n", 1),)),
    Template("Q07", "Which customers of a nation ordered nothing in a year?", f"""
SELECT c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = :nation AND NOT EXISTS (
  SELECT 1 FROM orders WHERE o_custkey = c_custkey AND {FISCAL} = :year)""", required=("nation", "year")),
    Template("Q08", "How many customers of each nation ordered in a year, with nations at zero kept?", f"""
SELECT n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_custkey) AS with_orders,
  round(count(DISTINCT o_custkey) / nullif(count(DISTINCT c_custkey), 0) * 100, 4) AS pct
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE {FISCAL} = :year)
  ON o_custkey = c_custkey GROUP BY n_name""", required=("year",)),
    Template("Q09", "In which nations and segments does every customer have an order?", """
SELECT n_name, c_mktsegment, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE :status IS NULL OR o_orderstatus = :status) ON o_custkey = c_custkey
GROUP BY n_name, c_mktsegment HAVING count(*) = count(o_custkey)""", optional=("status",)),
    Template("Q10", "How did orders develop year by year?", f"""
SELECT {FISCAL} AS fiscal_year, count(*) AS orders, round(sum(o_totalprice), 2) AS price FROM {PLACED}
WHERE (:nation IS NULL OR n_name = :nation) GROUP BY {FISCAL} ORDER BY fiscal_year""", optional=("nation",)),
    Template("Q11", "How did each segment change between two years?", f"""
SELECT c_mktsegment, later, earlier, later - earlier AS change, round((later - earlier) / nullif(earlier, 0) * 100, 4) AS pct_change FROM (
  SELECT c_mktsegment, count_if({FISCAL} = :year) AS later, count_if({FISCAL} = :year_2) AS earlier FROM {PLACED} GROUP BY c_mktsegment)""",
             required=("year", "year_2")),
    Template("Q12", "How do two nations compare?", f"""
SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS price, count(DISTINCT o_custkey) AS customers FROM {PLACED}
WHERE n_name IN (:nation, :nation_2) GROUP BY n_name""", required=("nation", "nation_2")),
    Template("Q13", "How does a nation compare with the average of all?", f"""
SELECT n_name, orders, round(avg_orders, 6) AS avg_orders, round(orders - avg_orders, 6) AS difference FROM (
  SELECT n_name, orders, avg(orders) OVER () AS avg_orders FROM (SELECT n_name, count(*) AS orders FROM {PLACED} GROUP BY n_name))
WHERE n_name = :nation""", required=("nation",)),
    Template("Q14", "Which nation leads each region?", f"""
SELECT r_name, n_name, orders FROM (SELECT r_name, n_name, count(*) AS orders,
  row_number() OVER (PARTITION BY r_name ORDER BY count(*) DESC, n_name) AS rn FROM {PLACED} GROUP BY r_name, n_name) WHERE rn = 1"""),
    Template("Q15", "How do orders split into value bands?", """
SELECT band, count(*) AS orders, round(count(*) / sum(count(*)) OVER () * 100, 4) AS pct FROM (
  SELECT CASE WHEN o_totalprice < 50000 THEN 'under 50k' WHEN o_totalprice < 200000 THEN '50k to 200k' WHEN o_totalprice < 400000 THEN '200k to 400k'
    ELSE '400k and over' END AS band FROM orders) GROUP BY band"""),
    # the keywords are our own choice
    Template("Q16", "How many lines mention a keyword, and by stage?", """
SELECT count(*) AS lines, round(sum(l_extendedprice), 2) AS planned, count_if(l_linestatus = 'O') AS ongoing, count_if(l_linestatus = 'F') AS completed,
  round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END), 2) AS returned
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE lower(concat(p_name, ' ', coalesce(p_type, ''))) RLIKE :keywords""",
             defaults=(("keywords", "ring|widget"),)),
    Template("Q17", "Which open orders are older than a number of days?", """
SELECT o_orderkey, date_format(o_orderdate, 'yyyy-MM-dd') AS ordered, datediff(to_date(:as_of), o_orderdate) AS days_since FROM orders
WHERE o_orderstatus = 'O' AND datediff(to_date(:as_of), o_orderdate) > :n""",
             required=("as_of",), defaults=(("n", 365),)),
    Template("Q18", "Which orders' lines exceed their total by a percentage?", """
SELECT o_orderkey, o_totalprice, round(spent, 2) AS spent, round((spent - o_totalprice) / o_totalprice * 100, 4) AS overrun_pct FROM orders
JOIN (SELECT l_orderkey, sum(l_extendedprice) AS spent FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
WHERE o_totalprice > 0 AND spent > o_totalprice * (1 + :pct / 100.0)""", defaults=(("pct", 50),)),
    Template("Q18A", "How many documents have unusable labels?", """
SELECT count(*) AS documents, count_if(quality IS NULL) AS unlabelled, count_if(toxic = 1 AND quality = 1) AS contradictory,
  round(count_if(quality IS NULL OR (toxic = 1 AND quality = 1)) / count(*) * 100, 4) AS pct_unusable FROM documents LEFT JOIN labels USING (doc_id)"""),
    Template("Q19", "Which texts occur more than once within a source?", """
SELECT source, md5(text) AS text_hash, count(*) AS copies FROM documents GROUP BY source, md5(text) HAVING count(*) > 1"""),
    Template("Q20", "What is known about one order?", """
SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey = :order""", required=("order",)),
    Template("Q21", "Which customers ordered in at least k years?", f"""
SELECT o_custkey, count(DISTINCT {FISCAL}) AS years, count(*) AS orders FROM orders GROUP BY o_custkey HAVING count(DISTINCT {FISCAL}) >= :k""",
             defaults=(("k", 5),)),
    # high and low mean above and below the average of all cells; the thresholds are our own choice
    Template("Q22", "Which segments of which nations have high spending but few orders?", f"""
SELECT n_name, c_mktsegment, orders, price FROM (
  SELECT n_name, c_mktsegment, orders, price, avg(price) OVER () AS mp, avg(orders) OVER () AS mo FROM (
    SELECT n_name, c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS price FROM {PLACED} GROUP BY n_name, c_mktsegment))
WHERE price > mp AND orders < mo"""),
    Template("Q23", "Which parts have fewer than n lines?", """
SELECT p_partkey, p_name, coalesce(lines, 0) AS lines FROM part LEFT JOIN (SELECT l_partkey, count(*) AS lines FROM lineitem GROUP BY l_partkey)
  ON l_partkey = p_partkey WHERE coalesce(lines, 0) < :n""", defaults=(("n", 20),)),
    Template("Q24", "What came in, what went out, and what remains per user?", """
SELECT user_id, round(sum(CASE WHEN event_type IN ('purchase', 'signup') THEN value ELSE 0 END), 2) AS receipts,
  round(sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END), 2) AS payments,
  round(sum(CASE WHEN event_type IN ('purchase', 'signup') THEN value WHEN event_type = 'error' THEN -value ELSE 0 END), 2) AS balance
FROM events GROUP BY user_id"""),
)}


def dashboard_jobs(spark: SparkSession, ids: list[str]) -> dict:
    """Templates run without parameters over everything, as jobs for the dashboard table."""
    return {i: (lambda i=i: TEMPLATES[i].run(spark)) for i in ids}
