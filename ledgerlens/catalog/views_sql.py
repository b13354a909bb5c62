"""Mined views: their Spark recipe, SQL text and configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.mining.config import Measure, ViewConfig
from ledgerlens.tables import Tables


def with_periods(df: DataFrame, date: str) -> DataFrame:
    return df.withColumns({
        "month": F.date_format(date, "yyyy-MM"),
        "quarter": F.concat(F.year(date), F.lit("-Q"), F.quarter(date)),
        "year": F.year(date).cast("string"),
    })


def periods_sql(date: str) -> str:
    return (
        f"strftime({date}, '%Y-%m') AS month, year({date}) || '-Q' || quarter({date}) AS quarter, "
        f"CAST(year({date}) AS VARCHAR) AS year"
    )


def order_view(t: Tables) -> DataFrame:
    """One row per order with its customer's place."""
    joined = (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return with_periods(joined, "o_orderdate").select(
        "r_name", "n_name", "c_mktsegment", "o_orderpriority", "o_orderstatus", "month", "quarter", "year",
        F.col("o_totalprice").alias("price"), F.lit(1).alias("orders"), F.col("c_acctbal").alias("balance"),
    )


ORDER_VIEW_SQL = f"""
SELECT r_name, n_name, c_mktsegment, o_orderpriority, o_orderstatus, {periods_sql('o_orderdate')},
       o_totalprice AS price, 1 AS orders, c_acctbal AS balance
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey"""


def order_config(depth: int = 1, **changes) -> ViewConfig:
    settings = dict(
        name="orders",
        dimensions=("r_name", "n_name", "c_mktsegment", "o_orderpriority", "o_orderstatus"),
        temporal_dimensions=("month", "quarter", "year"),
        measures=(Measure("price"), Measure("orders"), Measure("mean_price", "avg", "price"),
                  Measure("mean_balance", "avg", "balance")),
        impact_measures=("price", "orders"),
        max_subspace_depth=depth,
        excluded_pairs=(("orders", "o_orderstatus"),),
    )
    settings.update(changes)
    return ViewConfig(**settings)


HALF_VIEW_SQL = f"SELECT *, CASE WHEN right(month, 2) <= '06' THEN 'first half' ELSE 'second half' END AS half FROM ({ORDER_VIEW_SQL})"


def half_view(t: Tables) -> DataFrame:
    """The order view with a dimension of two values."""
    half = F.when(F.substring("month", 6, 2) <= "06", "first half").otherwise("second half")
    return order_view(t).withColumn("half", half)


def half_config(depth: int = 1) -> ViewConfig:
    return order_config(depth, name="halves", dimensions=("r_name", "half", "o_orderpriority"), temporal_dimensions=("quarter", "year"),
                        measures=(Measure("price"), Measure("orders"), Measure("mean_price", "avg", "price")), excluded_pairs=())


def line_view(t: Tables) -> DataFrame:
    """One row per order line with order, customer, place and part."""
    joined = (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    )
    return with_periods(joined, "o_orderdate").select(
        "r_name", "c_mktsegment", "o_orderpriority", "l_returnflag", "l_linestatus", "p_brand",
        "month", "quarter", "year",
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        F.lit(1).alias("lines"), F.col("l_discount").alias("discount"),
    )


LINE_VIEW_SQL = f"""
SELECT r_name, c_mktsegment, o_orderpriority, l_returnflag, l_linestatus, p_brand, {periods_sql('o_orderdate')},
       l_quantity AS quantity, l_extendedprice AS price, l_extendedprice * (1 - l_discount) AS revenue,
       1 AS lines, l_discount AS discount
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey"""


def line_config(depth: int = 2, **changes) -> ViewConfig:
    settings = dict(
        name="lines",
        dimensions=("r_name", "c_mktsegment", "o_orderpriority", "l_returnflag", "l_linestatus", "p_brand"),
        temporal_dimensions=("month", "quarter", "year"),
        measures=(Measure("quantity"), Measure("price"), Measure("revenue"), Measure("lines"),
                  Measure("mean_discount", "avg", "discount")),
        impact_measures=("revenue", "lines"),
        max_subspace_depth=depth,
    )
    settings.update(changes)
    return ViewConfig(**settings)


def event_view(t: Tables) -> DataFrame:
    """One row per event; user groups stand in for places."""
    return t.events.select(
        "event_type", (F.col("user_id") % 7).cast("string").alias("user_group"),
        F.date_format("ts", "EEEE").alias("weekday"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.col("value"), F.lit(1).alias("events"), F.when(F.col("value") > 300, F.col("value")).otherwise(0.0).alias("spikes"),
    )


EVENT_VIEW_SQL = """
SELECT event_type, CAST(user_id % 7 AS VARCHAR) AS user_group, dayname(ts) AS weekday,
       strftime(ts, '%Y-%m-%d') AS day, value, 1 AS events,
       CASE WHEN value > 300 THEN value ELSE 0.0 END AS spikes FROM events"""


def event_config(depth: int = 1, **changes) -> ViewConfig:
    settings = dict(
        name="events",
        dimensions=("event_type", "user_group", "weekday"),
        temporal_dimensions=("day",),
        measures=(Measure("value"), Measure("events"), Measure("mean_value", "avg", "value"), Measure("spikes")),
        impact_measures=("value",),
        max_subspace_depth=depth,
    )
    settings.update(changes)
    return ViewConfig(**settings)


def document_view(t: Tables) -> DataFrame:
    """One row per document: language, source and size class."""
    return t.documents.select(
        "lang", "source",
        F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 3000, "medium").otherwise("long").alias("size"),
        F.col("n_chars").alias("chars"), F.lit(1).alias("documents"),
    )


DOCUMENT_VIEW_SQL = """
SELECT lang, source, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 3000 THEN 'medium' ELSE 'long' END AS size,
       n_chars AS chars, 1 AS documents FROM documents"""


def document_config(depth: int = 1, **changes) -> ViewConfig:
    settings = dict(
        name="documents",
        dimensions=("lang", "source", "size"),
        temporal_dimensions=(),
        measures=(Measure("chars"), Measure("documents"), Measure("mean_chars", "avg", "chars")),
        impact_measures=("documents",),
        max_subspace_depth=depth,
    )
    settings.update(changes)
    return ViewConfig(**settings)


def wide_view(t: Tables) -> DataFrame:
    """One row per order line with fourteen dimensions, three time grains and eight measures."""
    c = F.col
    makers = t.supplier.join(t.nation, c("s_nationkey") == c("n_nationkey")).select(
        "s_suppkey", c("n_name").alias("s_nation"))
    joined = (
        t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey"))
        .join(t.customer, c("o_custkey") == c("c_custkey"))
        .join(t.nation, c("c_nationkey") == c("n_nationkey"))
        .join(t.region, c("n_regionkey") == c("r_regionkey"))
        .join(t.part, c("l_partkey") == c("p_partkey"))
        .join(makers, c("l_suppkey") == c("s_suppkey"))
    )
    return with_periods(joined, "o_orderdate").select(
        "r_name", "n_name", "c_mktsegment", "o_orderpriority", "o_orderstatus", "l_returnflag", "l_linestatus",
        "p_brand", "p_type", "s_nation", c("l_discount").cast("string").alias("discount_step"),
        c("l_tax").cast("string").alias("tax_step"), F.date_format("l_shipdate", "E").alias("weekday"),
        F.floor(c("l_quantity") / 10).cast("string").alias("quantity_band"), "month", "quarter", "year",
        c("l_quantity").alias("quantity"), c("l_extendedprice").alias("price"),
        (c("l_extendedprice") * (1 - c("l_discount"))).alias("revenue"), F.lit(1).alias("lines"),
        c("l_discount").alias("discount"), c("p_retailprice").alias("retail"), c("o_totalprice").alias("order_total"),
        c("c_acctbal").alias("balance"),
    )


def wide_config(depth: int = 2, **changes) -> ViewConfig:
    settings = dict(
        name="wide",
        dimensions=("r_name", "n_name", "c_mktsegment", "o_orderpriority", "o_orderstatus", "l_returnflag", "l_linestatus",
                    "p_brand", "p_type", "s_nation", "discount_step", "tax_step", "weekday", "quantity_band"),
        temporal_dimensions=("month", "quarter", "year"),
        measures=(Measure("quantity"), Measure("price"), Measure("revenue"), Measure("lines"),
                  Measure("mean_discount", "avg", "discount"), Measure("mean_retail", "avg", "retail"),
                  Measure("mean_total", "avg", "order_total"), Measure("mean_balance", "avg", "balance")),
        impact_measures=("revenue", "lines"),
        max_subspace_depth=depth,
    )
    settings.update(changes)
    return ViewConfig(**settings)
