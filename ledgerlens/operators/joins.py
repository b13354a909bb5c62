"""Join shapes over roster, fact and dictionary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.columns import period_bounds
from ledgerlens.session import cut_lineage

BROADCAST_ROWS = 500_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast `df` when a count shows it has at most `limit` rows, else leave the choice to Spark."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def decode(fact: DataFrame, codes: DataFrame, key: str, code: str, label: str) -> DataFrame:
    """Left join of a code dictionary; `label` is null for unknown codes, the smallest where a code has several."""
    side = codes.groupBy(F.col(code).alias("__code")).agg(F.min(label).alias(label))
    return fact.join(small(side), fact[key] == F.col("__code"), "left").drop("__code")


def left_rollup(base: DataFrame, detail: DataFrame, key: str, *aggs: Column) -> DataFrame:
    """Left join of a detail table aggregated to the key first, so the base grain is kept."""
    return base.join(detail.groupBy(key).agg(*aggs), key, "left")


def spine(entities: DataFrame, observed: DataFrame) -> DataFrame:
    """Every entity with every observed value: the grid itself is the wanted result, so its size is the output's.

    The observed values stay a distributed frame and travel to the tasks whole only when their count is small.
    """
    values = observed.distinct()
    few = values.limit(10_001).count() <= 10_000
    return entities.crossJoin(F.broadcast(values) if few else values)


def grid(entities: DataFrame, column: str, values: list) -> DataFrame:
    """Every entity with every value of a short, driver-known axis (a calendar, the observed years)."""
    return entities.withColumn(column, F.explode(F.array(*[F.lit(v) for v in values])))


def month_axis(df: DataFrame, date: str) -> list[str]:
    """All months between the first and the last date; one row of bounds reaches the driver."""
    bounds = df.agg(F.min(date).alias("lo"), F.max(date).alias("hi")).first()
    if bounds["lo"] is None:
        return []
    first, last = bounds["lo"].year * 12 + bounds["lo"].month - 1, bounds["hi"].year * 12 + bounds["hi"].month - 1
    return [f"{m // 12:04d}-{m % 12 + 1:02d}" for m in range(first, last + 1)]


def zero_filled(spine: DataFrame, facts: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Left join of rolled-up facts to the spine, missing cells as 0."""
    return spine.join(facts, keys, "left").fillna(0, measures)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    keys = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.filter(F.col(child_key).isNotNull()).join(keys, child_key, "left_anti")


def majority_map(pairs: DataFrame, source: str, target: str) -> DataFrame:
    """For each source value the target it is most often paired with; ties go to the smaller target."""
    counted = pairs.groupBy(source, target).agg(F.count("*").alias("votes"))
    best = Window.partitionBy(source).orderBy(F.desc("votes"), F.col(target))
    return counted.withColumn("rn", F.row_number().over(best)).filter("rn = 1").drop("rn")


def _level(first: Column, last: Column) -> Column:
    """The least power of two above an interval's length less one; buckets of that width hold it in two at most."""
    return F.when(last <= first, 0).otherwise(F.length(F.bin(last - first)))


def _buckets(first: Column, last: Column, level: Column) -> Column:
    return F.sequence(F.call_function("shiftright", first, level), F.call_function("shiftright", last, level))


def overlaps(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str]) -> DataFrame:
    """All pairs of rows whose intervals of whole numbers, ends included, have a number in common.

    A ladder of bucket widths instead of one row for each number: an interval lies in at most two buckets of its own width, and
    a shorter one in at most two of any wider bucket. The shorter of a pair looks the longer one up at the longer one's width,
    so both sides meet in an equi-join on (width, bucket), and a pair that shares two buckets is kept in the later one.
    """
    a, b = (df.withColumn(f"__{n}", F.struct(F.col(ends[0]).cast("long").alias("first"), F.col(ends[1]).cast("long").alias("last")))
            .filter(f"__{n}.first <= __{n}.last").withColumn(f"__level_{n}", _level(F.col(f"__{n}.first"), F.col(f"__{n}.last")))
            for df, ends, n in ((left, left_ends, "a"), (right, right_ends, "b")))

    def met(long: DataFrame, short: DataFrame, x: str, y: str, equal: bool) -> DataFrame:
        levels = sorted(r[0] for r in long.select(f"__level_{x}").distinct().collect())  # 64 at most
        stored = long.withColumn("__width", F.col(f"__level_{x}")).withColumn(
            "__bucket", F.explode(_buckets(F.col(f"__{x}.first"), F.col(f"__{x}.last"), F.col("__width"))))
        above = F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda w: (w >= F.col(f"__level_{y}")) if equal else (w > F.col(f"__level_{y}")))
        asked = short.withColumn("__width", F.explode(above)).withColumn(
            "__bucket", F.explode(_buckets(F.col(f"__{y}.first"), F.col(f"__{y}.last"), F.col("__width"))))
        start = F.greatest(*[F.call_function("shiftright", F.col(f"__{n}.first"), F.col("__width")) for n in (x, y)])
        both = stored.join(asked, ["__width", "__bucket"]).filter(F.col("__bucket") == start)
        return both.filter((F.col("__a.first") <= F.col("__b.last")) & (F.col("__b.first") <= F.col("__a.last")))

    columns = [*left.columns, *right.columns]
    return met(b, a, "b", "a", True).select(columns).unionByName(met(a, b, "a", "b", False).select(columns))


def with_bounds(labels: DataFrame) -> DataFrame:
    """Distinct rows of `labels` with `b`, the bounds of the period `label` names; null where it names none.

    Distinct rows are written first: else a later filter on the bounds moves below the distinct and parses every row.
    """
    return cut_lineage(labels.distinct(), "period-labels").withColumn("b", period_bounds("label"))


def period_matches(periods: DataFrame, events: DataFrame, grace: int = 3) -> DataFrame:
    """Periods that overlap an event window, or start within `grace` months after it.

    Both sides carry month indexes: `first` and `last`, `event_first` and `event_last`. Windows of any length take two rows.
    """
    during = (F.col("first") <= F.col("event_last")) & (F.col("last") >= F.col("event_first"))
    after = (F.col("first") > F.col("event_last")) & (F.col("first") <= F.col("event_last") + grace)
    late = events.withColumn("__late", F.col("event_last") + grace)
    return (
        overlaps(periods, late, ("first", "last"), ("event_first", "__late")).drop("__late").filter(during | after)
        .withColumn("relation", F.when(during, "inside").otherwise("in the months just after")).distinct()
    )
