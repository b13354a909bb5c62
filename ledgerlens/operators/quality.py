"""Data checks and profiles; each is an aggregation, and its result a DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_count_check(df: DataFrame, expected: int, tolerance_pct: float) -> DataFrame:
    off = F.abs(F.col("actual") - expected) / F.lit(float(expected)) * 100
    return df.agg(F.count("*").alias("actual")).select(
        "actual", F.lit(expected).cast("long").alias("expected"), off.alias("off_pct"), (off < tolerance_pct).alias("passed"))


def key_uniqueness(df: DataFrame, key: str) -> DataFrame:
    """Rows minus distinct non-null keys; nulls count as duplicates."""
    return df.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("distinct_keys")).withColumn(
        "duplicates", F.col("rows") - F.col("distinct_keys"))


def foreign_key(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Orphans, non-null child keys and the orphan percentage, counted per distinct key first."""
    per_key = child.filter(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("k")).agg(F.count("*").alias("n"))
    known = parent.select(F.col(parent_key).alias("k")).distinct().withColumn("known", F.lit(True))
    joined = per_key.join(known, "k", "left")
    return joined.agg(
        F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("orphans"), F.sum("n").alias("total"),
    ).withColumn("orphan_pct", F.col("orphans") / F.nullif(F.col("total"), F.lit(0)) * 100)


def null_rates(df: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Null share per column, one pass, columns above the threshold."""
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in df.columns])
    return rates.unpivot([], df.columns, "column_name", "null_rate").filter(F.col("null_rate") > threshold)


def unexpected_values(df: DataFrame, column: str, expected: list[str]) -> DataFrame:
    return df.select(F.col(column).cast("string").alias("value")).filter("value IS NOT NULL").distinct().filter(
        ~F.col("value").isin(*expected))


def date_span(df: DataFrame, column: str, low_years: float, high_years: float) -> DataFrame:
    span = F.datediff(F.max(column), F.min(column)) / 365.0
    return df.agg(span.alias("years")).withColumn("passed", F.col("years").between(low_years, high_years))


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Nulls, distinct values, minimum and maximum as text for every column, in one aggregation.

    Distinct counts come from one explode to (column, value) pairs, so all columns share a
    single shuffle of distinct pairs instead of one sort per column.
    """
    names = columns or df.columns
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in names
    ])).alias("p")).select("p.*")
    counted = pairs.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    text = counted.groupBy("column_name").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.count("value").alias("distinct_values"), F.sum("n").alias("rows"))
    bounds = df.agg(*[
        F.struct(F.min(c).cast("string").alias("low"), F.max(c).cast("string").alias("high")).alias(c) for c in names
    ]).unpivot([], names, "column_name", "b").select("column_name", "b.low", "b.high")
    return text.join(bounds, "column_name")


def view_check(df: DataFrame, grain: list[str], low: int, high: int) -> DataFrame:
    keys = df.groupBy(*grain).agg(F.count("*").alias("n"))
    return keys.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(F.col("n") > 1).alias("repeated_keys"),
    ).withColumn("passed", F.col("rows").between(low, high) & (F.col("repeated_keys") == 0))


def differs(a: Column, b: Column, rtol: float = 1e-9, atol: float = 1e-6) -> Column:
    """Null equals null and NaN equals NaN; numbers compare with tolerance."""
    both = F.abs(a - b) > atol + rtol * F.abs(b)
    return F.coalesce(both, F.lit(True)) & ~a.eqNullSafe(b)


#: Row hashes of a table are summed up by so many leaves.
LEAVES = 1 << 16


def _leaf(grain: list[str]) -> Column:
    """Leaf of a row by its grain; -1 if part of the grain is null, because such a row meets no other."""
    missing = F.greatest(*[F.col(c).isNull() for c in grain]) if len(grain) > 1 else F.col(grain[0]).isNull()
    return F.when(missing, F.lit(-1)).otherwise(F.pmod(F.xxhash64(*grain), F.lit(LEAVES)).cast("int"))


def differing_leaves(left: DataFrame, right: DataFrame, grain: list[str], columns: list[str]) -> DataFrame:
    """Leaves in which the rows of two tables differ, and leaf -1; at most LEAVES + 1 rows.

    Hashes of one side are added and those of the other taken off, by leaf and combined on the map side: equal leaves come to
    zero. One small shuffle whatever the tables hold. A null is hashed as its own mark, because Spark's hash passes over nulls.
    """
    parts = [x for c in (*grain, *columns) for x in (F.col(c), F.col(c).isNull())]

    def hashed(df: DataFrame, sign: int) -> DataFrame:
        h = df.select(_leaf(grain).alias("leaf"), F.xxhash64(*parts).alias("h"), F.xxhash64(F.lit(1), *parts).alias("g"))
        return h.select("leaf", F.lit(sign).alias("n"), (F.shiftright("h", 32) * sign).alias("high"),
                        (F.col("h").bitwiseAND(0xFFFFFFFF) * sign).alias("low"), "g")

    sums = hashed(left, 1).unionAll(hashed(right, -1)).groupBy("leaf").agg(
        F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"), F.bit_xor("g").alias("mixed"))
    return sums.filter("leaf < 0 OR n <> 0 OR high <> 0 OR low <> 0 OR mixed <> 0").select("leaf")


def differing_rows(left: DataFrame, right: DataFrame, grain: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of both tables in leaves that differ; the rest is equal, up to a collision of 128-bit digests."""
    # at most LEAVES + 1 rows: small enough to send to all tasks; both sides use one broadcast
    leaves = F.broadcast(differing_leaves(left, right, grain, columns))

    def inside(df: DataFrame) -> DataFrame:
        return df.withColumn("__leaf", _leaf(grain)).join(leaves.withColumnRenamed("leaf", "__leaf"), "__leaf", "left_semi").drop("__leaf")

    return inside(left), inside(right)


def table_parity(left: DataFrame, right: DataFrame, grain: list[str]) -> DataFrame:
    """Mismatches per column between two tables joined on their grain, and rows on one side only.

    Digests of both tables are compared first and only rows of leaves that differ are shuffled and joined, so the parity of
    equal tables moves digests only. The grain is to be unique in both tables (`view_check`); a row with a null in it is on
    one side only.
    """
    values = [c for c in left.columns if c in right.columns and c not in grain]
    left, right = differing_rows(left.select(*grain, *values), right.select(*grain, *values), grain, values)
    a = left.select(*grain, *[F.col(c).alias(f"a_{c}") for c in values], F.lit(1).alias("in_a"))
    b = right.select(*grain, *[F.col(c).alias(f"b_{c}") for c in values], F.lit(1).alias("in_b"))
    joined = a.join(b, grain, "full")
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    numeric = ("double", "float", "bigint", "int", "smallint")
    kinds = dict(left.dtypes)

    def off(c: str) -> Column:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        return differs(x, y) if kinds[c] in numeric else ~x.eqNullSafe(y)

    counts = joined.agg(
        *[F.count_if(both & off(c)).alias(c) for c in values],
        F.count_if(F.col("in_b").isNull()).alias("only_left"), F.count_if(F.col("in_a").isNull()).alias("only_right"))
    return counts.unpivot([], [*values, "only_left", "only_right"], "check_name", "mismatches")


def column_pair_parity(df: DataFrame, pairs: list[tuple[str, str]], tolerance: float = 0.005) -> DataFrame:
    """Mismatch count of each column pair in one pass."""
    names = [f"{a}~{b}" for a, b in pairs]
    counts = df.agg(*[
        F.count_if(differs(F.col(a), F.col(b), 0.0, tolerance)).alias(n) for (a, b), n in zip(pairs, names)
    ])
    return counts.unpivot([], names, "pair", "mismatches")


def swap_diagnosis(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Tally of rows whose two columns agree, are crosswise swapped, differ, or exist on one side only."""
    x = left.select(*keys, F.col(a).alias("la"), F.col(b).alias("lb"), F.lit(1).alias("in_l"))
    y = right.select(*keys, F.col(a).alias("ra"), F.col(b).alias("rb"), F.lit(1).alias("in_r"))
    same = F.col("la").eqNullSafe(F.col("ra")) & F.col("lb").eqNullSafe(F.col("rb"))
    swapped = F.col("la").eqNullSafe(F.col("rb")) & F.col("lb").eqNullSafe(F.col("ra"))
    verdict = (
        F.when(F.col("in_r").isNull(), "left only").when(F.col("in_l").isNull(), "right only")
        .when(same, "same").when(swapped, "swapped").otherwise("different"))
    return x.join(y, keys, "full").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("rows"))


def crosswalk_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Fill percentage and distinct values of every column of every table."""
    parts = [
        profile(df).select(
            F.lit(name).alias("table_name"), "column_name",
            ((F.col("rows") - F.col("nulls")) / F.nullif(F.col("rows"), F.lit(0)) * 100).alias("fill_pct"), "distinct_values")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def definitional_pairs(df: DataFrame, dimensions: list[str], measures: list[str], min_rows: int = 100) -> DataFrame:
    """(measure, dimension, value) where the measure is non-zero almost only in that value.

    Either non-zero on >= 99 % of the value's rows and <= 1 % of all others, or all its non-zero
    rows (at least `min_rows`) lie in the one value.
    """
    nz = [F.count_if(F.coalesce(F.col(m).cast("double"), F.lit(0.0)) != 0).alias(f"nz_{m}") for m in measures]
    pairs = df.select(
        F.explode(F.array(*[
            F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions
        ])).alias("p"), *measures,
    ).select("p.*", *measures).filter("value IS NOT NULL")
    cells = pairs.groupBy("dimension", "value").agg(F.count("*").alias("n"), *nz)
    totals = cells.groupBy("dimension").agg(F.sum("n").alias("all_n"), *[F.sum(f"nz_{m}").alias(f"all_{m}") for m in measures])
    long = cells.join(F.broadcast(totals), "dimension").select(
        "dimension", "value", "n", "all_n",
        F.explode(F.array(*[
            F.struct(F.lit(m).alias("measure"), F.col(f"nz_{m}").alias("nz"), F.col(f"all_{m}").alias("all_nz")) for m in measures
        ])).alias("m")).select("dimension", "value", "n", "all_n", "m.*")
    inside = F.col("nz") / F.col("n")
    outside = (F.col("all_nz") - F.col("nz")) / F.nullif(F.col("all_n") - F.col("n"), F.lit(0))
    rule = ((inside >= 0.99) & (outside <= 0.01)) | ((F.col("nz") == F.col("all_nz")) & (F.col("nz") >= min_rows)
                                                      & (F.col("n") < F.col("all_n")))
    return long.filter(rule).select("measure", "dimension", "value", "nz", "n")
