"""Aggregations with stated tie rules, and windows over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.scan import scan


def sum_of(c: str, name: str | None = None) -> Column:
    return F.sum(c).alias(name or f"sum_{c}")


def sum_where(condition: Column, c: str) -> Column:
    return F.sum(F.when(condition, F.col(c)).otherwise(0.0))


def arg_max(value: str, by: str) -> Column:
    """`value` where `by` is largest; a tie takes the smaller value."""
    return F.min_by(value, F.struct(-F.col(by), F.col(value)))


def mode_by_count(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Most frequent value per key; a tie takes the smaller value."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    return counted.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("__n"), F.col(value))).alias(name))


def membership_flags(df: DataFrame, key: str, kind: str, kinds: list[str], prefix: str = "has_") -> DataFrame:
    """One 0/1 column per kind telling whether the key has any such row."""
    return df.groupBy(key).agg(*[
        F.max((F.col(kind) == k).cast("int")).alias(prefix + k.lower().replace(" ", "_")) for k in kinds
    ])


def ratio_of_sums(a: str, b: str) -> Column:
    return F.sum(a) / F.nullif(F.sum(b).cast("double"), F.lit(0.0))


def share_within(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Cell value over its group's total, by joining the small totals back."""
    totals = df.groupBy(*keys).agg(F.sum(value).alias("__t"))
    return df.join(totals, keys).withColumn(name, F.col(value) / F.nullif(F.col("__t"), F.lit(0.0))).drop("__t")


def distinct_grain(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, distinct keys and keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(
        F.sum("n").alias("rows"), F.count("*").alias("distinct_keys"), F.count_if(F.col("n") > 1).alias("repeated_keys"))


def one_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row per key in the given order."""
    ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("__rn = 1").drop("__rn")


def running_total(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """The sum of `value` up to and including a row; a key of any size is summed up in blocks."""
    return scan(df, keys, [F.col(order)], {"value": F.col(value)}).select(*df.columns, F.col("running_value").alias(name))


def first_last_change(df: DataFrame, keys: list[str], period: str, value: str) -> DataFrame:
    """First and last non-null value by period and the change in percent of the first."""
    known = df.filter(F.col(value).isNotNull())
    out = known.groupBy(*keys).agg(
        F.min_by(value, period).alias("first_value"), F.max_by(value, period).alias("last_value"))
    return out.withColumn(
        "pct_change", (F.col("last_value") - F.col("first_value")) / F.nullif(F.abs("first_value"), F.lit(0.0)) * 100)


def content_hash(df: DataFrame, order: list[str]) -> DataFrame:
    """sha-256 per row, added up in four 60-bit pieces: equal contents give equal hashes in any row order."""
    row = F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in order]), 256)
    pieces = [
        F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)
    ]
    sums = df.select(row.alias("h")).agg(F.count("*").alias("row_count"), *pieces)
    return sums.select(
        "row_count", F.sha2(F.concat_ws(":", *[F.col(f"s{i}").cast("string") for i in range(4)]), 256).alias("content_hash"))


def bounded_store(df: DataFrame, key: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows, one per key. At the cut a score tie keeps the larger key; the output lists the smaller first."""
    best = one_per_key(df, [key], [F.desc(score), F.desc(tie)])
    return best.orderBy(F.desc(score), F.desc(key)).limit(k).orderBy(F.desc(score), F.asc(key))
