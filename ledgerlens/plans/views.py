"""Analytical view recipes over the standard tables, each with one declared grain.

Detail tables are always aggregated to the join key before they are joined, so no join
multiplies rows; small dimensions are left to Spark's own broadcast decision by size.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import columns as C
from ledgerlens.operators import aggregates as A
from ledgerlens.operators import joins as J
from ledgerlens.tables import Tables

c = F.col


def places(t: Tables) -> DataFrame:
    return t.nation.join(t.region, c("n_regionkey") == c("r_regionkey")).select("n_nationkey", "n_name", "r_name")


def customer_places(t: Tables) -> DataFrame:
    return t.customer.join(places(t), c("c_nationkey") == c("n_nationkey")).select(
        "c_custkey", "c_name", "c_mktsegment", "c_acctbal", "n_name", "r_name")


def line_rollup(t: Tables) -> DataFrame:
    """Grain: order. Sums, the largest line number and the smallest part."""
    return t.lineitem.groupBy(c("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_extendedprice").alias("spent"), F.sum("l_quantity").alias("quantity"),
        F.count("*").alias("lines"), F.max("l_linenumber").alias("last_line"), F.min("l_partkey").alias("first_part"),
        F.sum(F.when(c("l_returnflag") == "R", c("l_extendedprice")).otherwise(0.0)).alias("returned"),
        F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))


def dominant_type(t: Tables) -> DataFrame:
    """Grain: order. The part type with the most money, tied and untied money."""
    typed = t.lineitem.join(t.part.select("p_partkey", "p_type"), c("l_partkey") == c("p_partkey"), "left")
    per_type = typed.groupBy(c("l_orderkey").alias("o_orderkey"), "p_type").agg(F.sum("l_extendedprice").alias("money"))
    tied = c("p_type").isin("PROMO", "ECONOMY")
    return per_type.groupBy("o_orderkey").agg(
        F.sum("money").alias("sanctioned"), A.arg_max("p_type", "money").alias("main_type"),
        F.sum(F.when(tied, c("money")).otherwise(0.0)).alias("tied"),
        F.sum(F.when(tied, 0.0).otherwise(c("money"))).alias("untied"))


def order_lifecycle(t: Tables) -> DataFrame:
    """Grain: order. The order with its place and its 1:1 roll-ups."""
    return (
        t.orders.join(customer_places(t), c("o_custkey") == c("c_custkey"))
        .join(line_rollup(t), "o_orderkey", "left").join(dominant_type(t), "o_orderkey", "left")
        .select(
            "o_orderkey", "r_name", "n_name", "c_mktsegment", "o_orderpriority", "o_orderstatus",
            C.fiscal_year("o_orderdate").alias("fiscal_year"),
            F.coalesce("lines", F.lit(0)).cast("long").alias("n_lines"), F.round("spent", 2).alias("spent"),
            F.round(C.signed_difference("spent", "o_totalprice"), 2).alias("over_plan"),
            "main_type", F.round("tied", 2).alias("tied"), F.round("untied", 2).alias("untied"),
            C.flag(c("returned") > 0).alias("has_return"),
            F.when(c("tied") > c("untied"), "tied").when(c("untied") > 0, "untied").otherwise("none").alias("tied_class")))


def geo_month_cube(t: Tables) -> DataFrame:
    """Grain: nation x month, zero-filled, from three roll-ups."""
    months = J.month_axis(t.orders, "o_orderdate")
    spine = J.grid(places(t).select("n_name", "r_name"), "month", months)
    located = t.orders.join(customer_places(t).select("c_custkey", "n_name"), c("o_custkey") == c("c_custkey"))
    orders = located.groupBy("n_name", C.month_key("o_orderdate").alias("month")).agg(
        F.count("*").alias("orders"), F.sum("o_totalprice").alias("price"))
    lines = located.select("o_orderkey", "n_name").join(
        t.lineitem, c("o_orderkey") == c("l_orderkey")).groupBy("n_name", C.month_key("l_shipdate").alias("month")).agg(
        F.count("*").alias("lines"))
    newest = located.groupBy("o_custkey", "n_name").agg(F.min("o_orderdate").alias("d")).groupBy(
        "n_name", C.month_key("d").alias("month")).agg(F.count("*").alias("new_customers"))
    out = reduce(lambda a, b: a.join(b, ["n_name", "month"], "left"), [orders, lines, newest], spine)
    year = F.substring("month", 1, 4).cast("int")
    return out.fillna(0, ["orders", "price", "lines", "new_customers"]).select(
        "n_name", "r_name", "month",
        F.concat(F.substring("month", 1, 4), F.lit("-Q"), F.ceil(F.substring("month", 6, 2).cast("int") / 3)).alias("quarter"),
        C.year_label(year - F.when(F.substring("month", 6, 2).cast("int") >= 4, 0).otherwise(1)).alias("fiscal_year"),
        "orders", F.round("price", 2).alias("price"), "lines", "new_customers")


def supplier_year(t: Tables) -> DataFrame:
    """Grain: supplier x observed year."""
    yearly = t.lineitem.groupBy("l_suppkey", F.year("l_shipdate").cast("long").alias("year")).agg(
        F.count("*").alias("lines"), F.sum("l_extendedprice").alias("price"), F.sum("l_quantity").alias("quantity"))
    spine = J.spine(t.supplier.select("s_suppkey", "s_nationkey"), yearly.select("year"))
    filled = spine.join(yearly, (c("s_suppkey") == c("l_suppkey")) & (spine["year"] == yearly["year"]), "left").select(
        "s_suppkey", "s_nationkey", spine["year"], "lines", "price", "quantity").fillna(0, ["lines", "price", "quantity"])
    return filled.select(
        "s_suppkey", "year", "lines", F.round("price", 2).alias("price"),
        F.round(C.safe_ratio("price", "quantity"), 6).alias("unit_price"), C.flag(c("lines") == 0).alias("is_idle"))


def order_workhorse(t: Tables, as_of: str = "2002-01-01") -> DataFrame:
    """Grain: order. Decoded labels, flags and days since."""
    status = c("o_orderstatus")
    return t.orders.join(customer_places(t), c("o_custkey") == c("c_custkey"), "left").select(
        "o_orderkey", "n_name", F.when(status == "F", "Finished").when(status == "O", "Open").otherwise("Partial").alias("status_label"),
        C.flag(status == "F").alias("is_completed"), C.flag(c("o_orderpriority").startswith("1")).alias("is_urgent"),
        C.days_since("o_orderdate", F.lit(as_of).cast("date")).alias("days_since"),
        C.search_text("c_name", "o_orderpriority").alias("search_text"))


def facts_with_places(t: Tables) -> DataFrame:
    """Grain: fact row of each kind with its place."""
    located = t.supplier.join(places(t), c("s_nationkey") == c("n_nationkey"))
    supply = t.lineitem.join(located, c("l_suppkey") == c("s_suppkey")).groupBy("r_name", "n_name").agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("v")).withColumn("kind", F.lit("line"))
    demand = t.orders.join(customer_places(t), c("o_custkey") == c("c_custkey")).groupBy("r_name", "n_name").agg(
        F.count("*").alias("n"), F.sum("o_totalprice").alias("v")).withColumn("kind", F.lit("order"))
    return supply.unionByName(demand).select("kind", "r_name", "n_name", "n", F.round("v", 2).alias("v"))


def user_lifecycle(t: Tables) -> DataFrame:
    """Grain: user. First and last event, usual event type and the matching customer."""
    ends = t.events.groupBy("user_id").agg(
        F.min_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("a"),
        F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("z"),
        F.count("*").alias("events"), F.sum("value").alias("value"))
    usual = A.mode_by_count(t.events, ["user_id"], "event_type", "usual_event")
    return ends.join(usual, "user_id", "left").join(customer_places(t), c("user_id") == c("c_custkey"), "left").select(
        "user_id", c("a.event_type").alias("first_event"), c("z.event_type").alias("last_event"), "usual_event", "events",
        F.round("value", 2).alias("value"), "n_name", "c_mktsegment")


def month_cube_full_join(t: Tables) -> DataFrame:
    """Grain: month seen in any source. Roll-ups full-joined, a running total and ratios."""
    def monthly(df, date, *aggs):
        return df.groupBy(C.month_key(date).alias("month")).agg(*aggs)

    orders = monthly(t.orders, "o_orderdate", F.count("*").alias("orders"), F.sum("o_totalprice").alias("price"))
    lines = monthly(t.lineitem, "l_shipdate", F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))
    events = monthly(t.events, "ts", F.count("*").alias("events"))
    joined = orders.join(lines, "month", "full").join(events, "month", "full")
    # months are few: the running total runs over calendar rows, never over facts
    total = A.running_total(joined.withColumn("all", F.lit(1)), ["all"], "month", "orders", "orders_to_date")
    return total.select(
        "month", "orders", F.round("price", 2).alias("price"), "lines", "events", "orders_to_date",
        F.round(C.safe_ratio("price", "orders"), 4).alias("mean_price"),
        F.round(C.safe_ratio("quantity", "lines"), 6).alias("mean_quantity"))


def supplier_type(t: Tables) -> DataFrame:
    """Grain: supplier x part type."""
    cells = t.lineitem.join(t.part.select("p_partkey", "p_type"), c("l_partkey") == c("p_partkey")).groupBy(
        "l_suppkey", "p_type").agg(F.count("*").alias("lines"), F.sum("l_extendedprice").alias("price"))
    return cells.join(t.supplier, c("l_suppkey") == c("s_suppkey")).select(
        "s_suppkey", "p_type", "lines", F.round("price", 2).alias("price"),
        F.round(c("lines") / F.nullif(F.abs("s_acctbal"), F.lit(0.0)), 9).alias("lines_per_balance"),
        C.flag(c("price") == 0).alias("is_zero"))


def customer_journey(t: Tables) -> DataFrame:
    """Grain: customer. First and last order, the lag between them in days and its bucket."""
    ends = t.orders.groupBy(c("o_custkey").alias("c_custkey")).agg(
        F.min("o_orderdate").alias("first_order"), F.max("o_orderdate").alias("last_order"), F.count("*").alias("orders"),
        F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("last_status"))
    lag = C.days_between("first_order", "last_order")
    return t.customer.join(ends, "c_custkey", "left").select(
        "c_custkey", F.coalesce("orders", F.lit(0)).cast("long").alias("orders"), "last_status", F.round(lag, 4).alias("lag_days"),
        F.coalesce(C.bucket(lag, [30, 365, 1460], ["under a month", "under a year", "under four years", "longer"]),
                   F.lit("no orders")).alias("lag_bucket"))


def benefit_facts(t: Tables) -> DataFrame:
    """Grain: money fact of any source."""
    parts = [
        t.orders.select(F.lit("order").alias("source"), c("o_custkey").alias("party"), c("o_totalprice").alias("amount")),
        t.lineitem.select(F.lit("line").alias("source"), c("l_suppkey").alias("party"), c("l_extendedprice").alias("amount")),
        t.events.select(F.lit("event").alias("source"), c("user_id").alias("party"), c("value").alias("amount")),
    ]
    return reduce(DataFrame.unionByName, parts)


def customer_360(t: Tables) -> DataFrame:
    """Grain: customer. Flags of what the customer took part in."""
    return t.customer.select("c_custkey", "c_mktsegment").join(
        t.orders.groupBy(c("o_custkey").alias("c_custkey")).agg(
            F.max((c("o_orderstatus") == "F").cast("int")).alias("has_finished"),
            F.max((c("o_orderpriority") == "1-URGENT").cast("int")).alias("has_urgent")), "c_custkey", "left").join(
        A.membership_flags(t.events.withColumnRenamed("user_id", "c_custkey"), "c_custkey", "event_type",
                           ["purchase", "error"]), "c_custkey", "left").fillna(
        0, ["has_finished", "has_urgent", "has_purchase", "has_error"]).withColumn(
        "kinds", c("has_finished") + c("has_urgent") + c("has_purchase") + c("has_error"))


def return_lines(t: Tables) -> DataFrame:
    """Grain: returned line. Filtered projection with flags."""
    return t.lineitem.filter((c("l_returnflag") == "R") & (c("l_quantity") >= 40)).select(
        "l_orderkey", "l_partkey", F.round(c("l_extendedprice") * (1 - c("l_discount")), 4).alias("net"),
        C.flag(c("l_discount") >= 0.09).alias("is_deep_discount"))


def equity_cube(t: Tables) -> DataFrame:
    """Grain: nation x segment. Coverage, amount and representation index."""
    people = customer_places(t)
    active = t.orders.groupBy(c("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("price"))
    cells = people.join(active, "c_custkey", "left").groupBy("n_name", "c_mktsegment").agg(
        F.count("*").alias("customers"), F.count("price").alias("with_orders"), F.coalesce(F.sum("price"), F.lit(0.0)).alias("price"))
    totals = cells.groupBy("n_name").agg(F.sum("customers").alias("t_c"), F.sum("price").alias("t_p"))
    joined = cells.join(totals, "n_name")
    share = C.safe_ratio("price", "t_p")
    return joined.select(
        "n_name", "c_mktsegment", "customers", "with_orders", F.round(c("with_orders") / c("customers"), 6).alias("coverage"),
        F.round("price", 2).alias("price"),
        F.round(share / C.safe_ratio("customers", "t_c"), 6).alias("representation"))


def spend_against_supply(t: Tables) -> DataFrame:
    """Grain: nation with both sides. Customer spend over supplier cost."""
    spend = t.orders.join(customer_places(t), c("o_custkey") == c("c_custkey")).groupBy("n_name").agg(
        F.sum("o_totalprice").alias("spend"))
    cost = t.lineitem.join(t.supplier.join(places(t), c("s_nationkey") == c("n_nationkey")), c("l_suppkey") == c("s_suppkey")).groupBy(
        "n_name").agg(F.sum("l_extendedprice").alias("cost"))
    return spend.join(cost, "n_name").select(
        "n_name", F.round("spend", 2).alias("spend"), F.round("cost", 2).alias("cost"),
        F.round(C.safe_ratio("spend", "cost"), 6).alias("realisation"))


def declared_against_lines(t: Tables) -> DataFrame:
    """Grain: order. Declared total against the sum of its lines, ratio and flag."""
    return t.orders.join(line_rollup(t).select("o_orderkey", "spent"), "o_orderkey").select(
        "o_orderkey", "o_totalprice", F.round("spent", 2).alias("recorded"),
        F.round(C.safe_ratio("o_totalprice", "spent"), 6).alias("ratio"),
        C.flag(c("o_totalprice") > 1.10 * c("spent")).alias("is_over_declared"))


def nation_type_mix(t: Tables) -> DataFrame:
    """Grain: nation x part type, every pair present. Share of the nation's total."""
    located = t.supplier.join(places(t), c("s_nationkey") == c("n_nationkey")).select("s_suppkey", "n_name")
    cells = t.lineitem.join(t.part.select("p_partkey", "p_type"), c("l_partkey") == c("p_partkey")).join(
        located, c("l_suppkey") == c("s_suppkey")).groupBy("n_name", "p_type").agg(F.sum("l_extendedprice").alias("price"))
    types = t.part.select("p_type").filter("p_type IS NOT NULL")
    filled = J.zero_filled(J.spine(t.nation.select("n_name"), types), cells, ["n_name", "p_type"], ["price"])
    return A.share_within(filled, ["n_name"], "price", "share").select(
        "n_name", "p_type", F.round("price", 2).alias("price"), F.round("share", 6).alias("share"))


VIEWS: dict[str, Callable[[Tables], DataFrame]] = {
    "order_lifecycle": order_lifecycle, "geo_month_cube": geo_month_cube, "supplier_year": supplier_year,
    "line_rollup": line_rollup, "dominant_type": dominant_type, "order_workhorse": order_workhorse,
    "facts_with_places": facts_with_places, "user_lifecycle": user_lifecycle, "month_cube_full_join": month_cube_full_join,
    "supplier_type": supplier_type, "customer_journey": customer_journey, "benefit_facts": benefit_facts,
    "customer_360": customer_360, "return_lines": return_lines, "equity_cube": equity_cube,
    "spend_against_supply": spend_against_supply, "declared_against_lines": declared_against_lines,
    "nation_type_mix": nation_type_mix,
}
