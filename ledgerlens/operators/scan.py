"""Positions, running sums and totals of ordered groups, where one group may span any number of tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import cut_lineage


#: Up to so many rows, counted, one plain window is enough.
FEW = 100_000


def scan(rows: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column] | None = None, few: int = FEW) -> DataFrame:
    """`rows` with `position` (from 1) and `group_rows`, and for each sum `running_<name>` and `total_<name>` of its group.

    Two passes over blocks instead of one window by group: rows are range-partitioned by group and order, a block is what one
    partition holds of a group, the sums of blocks give each block its start, and a window inside the block does the rest. So
    no task holds more of a group than one range. Tables of at most `few` rows, counted, take the one window, with the same
    result. `order` must tell all rows of a group apart; nulls are a group of their own.
    """
    sums = sums or {}
    key = F.struct(*keys).alias("__key") if keys else F.struct(F.lit(1).alias("one")).alias("__key")
    stored = cut_lineage(rows.select("*", key), "scan-rows")
    if stored.count() <= few:
        whole = Window.partitionBy("__key")
        upto = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return stored.select(
            *rows.columns, F.row_number().over(whole.orderBy(*order)).cast("long").alias("position"), F.count("*").over(whole).alias("group_rows"),
            *[F.sum(c).over(upto).alias(f"running_{n}") for n, c in sums.items()],
            *[F.sum(c).over(whole).alias(f"total_{n}") for n, c in sums.items()])
    keyed = stored.repartitionByRange("__key", *order)
    placed = cut_lineage(keyed.withColumn("__block", F.spark_partition_id()), "scan-blocks")
    inside = Window.partitionBy("__key", "__block").orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = placed.withColumns({
        "__at": F.row_number().over(inside),
        **{f"__sum_{n}": F.sum(c).over(so_far) for n, c in sums.items()}})
    blocks = placed.groupBy("__key", "__block").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s_{n}") for n, c in sums.items()])
    # one row for each block of a group from here on
    group = Window.partitionBy("__key")
    before = group.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        "__key", "__block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"), F.sum("n").over(group).alias("group_rows"),
        *[x for n in sums for x in (F.sum(f"s_{n}").over(before).alias(f"__before_{n}"), F.sum(f"s_{n}").over(group).alias(f"total_{n}"))])
    running = [
        F.when(F.col(f"__sum_{n}").isNull(), F.col(f"__before_{n}")).when(F.col(f"__before_{n}").isNull(), F.col(f"__sum_{n}"))
        .otherwise(F.col(f"__before_{n}") + F.col(f"__sum_{n}")).alias(f"running_{n}") for n in sums]
    return within.join(starts, ["__key", "__block"]).select(
        *rows.columns, (F.col("__start") + F.col("__at")).alias("position"), "group_rows", *running, *[f"total_{n}" for n in sums])


#: Sketch size of `quantiles`: a wanted rank is known to one part in this many rows before it is looked up.
ACCURACY = 2_000


def quantiles(df: DataFrame, keys: list[str], value: Column, share: float) -> DataFrame:
    """Exact interpolated quantile of each group as `value`, with its number of values as `n`.

    A sketch of bounded size brackets the two wanted ranks; a second pass counts the values below the bracket and, by value,
    those inside it, combined before they are shuffled; only these counts are put in order. No values are sorted or gathered.
    """
    known = df.select(*keys, value.cast("double").alias("v")).filter("v IS NOT NULL")
    margin = 2.0 / ACCURACY
    ends = known.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx(
        "v", [max(0.0, share - margin), min(1.0, share + margin)], ACCURACY).alias("ends"), F.min("v").alias("least"), F.max("v").alias("most"))
    few = F.col("n") <= 2 * ACCURACY  # the margin is less than two rows there
    low = F.when(few | F.lit(share <= margin), F.col("least")).otherwise(F.get("ends", F.lit(0)))
    high = F.when(few | F.lit(share >= 1 - margin), F.col("most")).otherwise(F.get("ends", F.lit(1)))
    bracket = ends.select(F.struct(*keys, F.lit(0).alias("one")).alias("k"), "n", low.alias("low"), high.alias("high"))
    # struct keys compare nulls as equal; one row for each group
    inside = known.withColumn("k", F.struct(*keys, F.lit(0).alias("one"))).join(bracket, "k").filter(F.col("v") <= F.col("high"))
    counted = inside.groupBy("k", "n", F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v")).agg(F.count("*").alias("times"))
    ranked = scan(counted, ["k"], [F.asc_nulls_first("v")], {"times": F.col("times")}).filter("v IS NOT NULL")
    at = (F.col("n") - 1) * F.lit(float(share)) + 1
    first, last = F.col("running_times") - F.col("times") + 1, F.col("running_times")

    def here(rank: Column) -> Column:
        return F.max(F.when((rank >= first) & (rank <= last), F.col("v")))

    found = ranked.groupBy("k", "n").agg(here(F.floor(at)).alias("a"), here(F.ceil(at)).alias("b"))
    part = at - F.floor(at)
    return found.select(*[F.col(f"k.{c}").alias(c) for c in keys], "n", (F.col("a") + (F.col("b") - F.col("a")) * part).alias("value"))
