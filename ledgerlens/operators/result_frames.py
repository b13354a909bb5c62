"""Follow-up operations on a result table.

A result table is a DataFrame plus column roles: dimension, temporal, identifier,
additive_count, additive_value, ratio, snapshot_stock, unclassified. Operations that a role
does not allow raise `Refused`; all others return DataFrames of any size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ledgerlens.operators.scan import quantiles

ADDITIVE = ("additive_count", "additive_value")
ROLES = ("dimension", "temporal", "identifier", *ADDITIVE, "ratio", "snapshot_stock", "unclassified")


class Refused(ValueError):
    """The operation has no honest answer on this table."""


@dataclass(frozen=True)
class Ratio:
    """A ratio column is recomputed from the sums of these two columns of the base table."""

    numerator: str
    denominator: str
    scale: float = 1.0


@dataclass
class ResultFrame:
    """Rows, roles and what is needed to recompute: the uncut rows, the base table, a requery hook."""

    df: DataFrame
    roles: dict[str, str]
    limit: int | None = None
    uncut: DataFrame | None = None
    base: DataFrame | None = None
    ratios: dict[str, Ratio] = field(default_factory=dict)
    requery: Callable[[str, object], DataFrame] | None = None

    def is_cut(self) -> bool:
        """A table with fewer rows than its limit was not cut."""
        return self.limit is not None and self.df.limit(self.limit).count() >= self.limit

    def population(self) -> DataFrame:
        """The rows a whole-population statistic may use."""
        if not self.is_cut():
            return self.df
        if self.uncut is None:
            raise Refused("the table is cut to its top rows and cannot be recomputed without the cut")
        return self.uncut


def numeric(c: str) -> Column:
    """Numbers as they are; text without thousands separators and rupee signs; anything else null."""
    return F.regexp_replace(F.col(c).cast("string"), "[,₹]", "").try_cast("double")


def measure(frame: ResultFrame, df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    if isinstance(kind, NumericType):
        return F.col(column).cast("double")
    return numeric(column) if isinstance(kind, StringType) else F.lit(None).cast("double")


def _additive(frame: ResultFrame, column: str, what: str) -> None:
    role = frame.roles.get(column, "unclassified")
    if role == "unclassified":
        raise Refused(f"{column} has no known role, so its {what} is not defined")
    if role not in ADDITIVE + ("ratio", "snapshot_stock"):
        raise Refused(f"{column} is no measure")


def total(frame: ResultFrame, column: str) -> DataFrame:
    """Sum: additive columns add up, ratios are recomputed from their base, stocks are taken at one date."""
    _additive(frame, column, "sum")
    role = frame.roles[column]
    if role == "ratio":
        return recomputed_ratio(frame, column)
    if role == "snapshot_stock":
        return stock_total(frame, column)
    df = frame.population()
    return df.agg(F.sum(measure(frame, df, column)).alias("value"))


def average(frame: ResultFrame, column: str) -> DataFrame:
    _additive(frame, column, "average")
    if frame.roles[column] == "ratio":
        return recomputed_ratio(frame, column)
    df = frame.population()
    return df.agg(F.avg(measure(frame, df, column)).alias("value"))


def recomputed_ratio(frame: ResultFrame, column: str) -> DataFrame:
    """Ratio of sums over the base table, never a sum or mean of ratios."""
    if column not in frame.ratios or frame.base is None:
        raise Refused(f"{column} is a ratio and its base table is not at hand")
    r = frame.ratios[column]
    return frame.base.agg(
        (F.sum(r.numerator) / F.nullif(F.sum(r.denominator).cast("double"), F.lit(0.0)) * r.scale).alias("value"))


def stock_total(frame: ResultFrame, column: str) -> DataFrame:
    """A stock does not add up over time: the sum at the latest period."""
    df = frame.population()
    time = [c for c, role in frame.roles.items() if role == "temporal"]
    if not time:
        return df.agg(F.sum(measure(frame, df, column)).alias("value"))
    per_period = df.groupBy(time[0]).agg(F.sum(measure(frame, df, column)).alias("v"))
    return per_period.agg(F.max_by("v", time[0]).alias("value"))


def extreme(frame: ResultFrame, column: str, largest: bool, label: str, tie: str) -> DataFrame:
    """The largest or smallest value of the whole population with the label of the first row that holds it."""
    rows = frame.population()
    df = rows.withColumn("__v", measure(frame, rows, column)).filter("__v IS NOT NULL")
    order = F.struct(-F.col("__v") if largest else F.col("__v"), F.col(tie))
    return df.agg(
        (F.max("__v") if largest else F.min("__v")).alias("value"), F.min_by(label, order).alias("label"))


def count_rows(frame: ResultFrame) -> DataFrame:
    return frame.df.agg(F.count("*").alias("value"))


def quantile(df: DataFrame, value: Column, share: float) -> DataFrame:
    """Exact interpolated quantile as `value`; one row, null without values."""
    found = quantiles(df, [], value, share).select("value")
    return found.agg(F.max("value").alias("value"))  # of one row or none


def median(frame: ResultFrame, column: str) -> DataFrame:
    df = frame.population()
    return quantile(df, measure(frame, df, column), 0.5)


def stdev(frame: ResultFrame, column: str) -> DataFrame:
    """Sample standard deviation; null below two values."""
    df = frame.population()
    v = measure(frame, df, column)
    return df.agg(F.when(F.count(v) >= 2, F.stddev_samp(v)).alias("value"))


def percentile(frame: ResultFrame, column: str, p: float) -> DataFrame:
    if not 0 <= p <= 100:
        raise Refused("a percentile lies between 0 and 100")
    df = frame.population()
    return quantile(df, measure(frame, df, column), p / 100.0)


def value_range(frame: ResultFrame, column: str, label: str) -> DataFrame:
    rows = frame.population()
    df = rows.withColumn("__v", measure(frame, rows, column)).filter("__v IS NOT NULL")
    return df.agg(
        (F.max("__v") - F.min("__v")).alias("value"),
        F.min_by(label, F.struct(-F.col("__v"), F.col(label))).alias("high_label"),
        F.min_by(label, F.struct(F.col("__v"), F.col(label))).alias("low_label"))


def mode(frame: ResultFrame, column: str) -> DataFrame:
    """The most frequent trimmed values, all that tie, sorted; none when every value is unique."""
    df = frame.population()
    text = F.trim(F.col(column).cast("string"))
    counts = df.select(text.alias("value")).filter("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n"))
    top = counts.agg(F.max("n").alias("top"))
    return counts.join(F.broadcast(top), counts["n"] == top["top"]).filter("n > 1").select("value", "n").orderBy("value")


def count_distinct(frame: ResultFrame, column: str) -> DataFrame:
    df = frame.population()
    return df.agg(F.count_distinct(F.trim(F.col(column).cast("string"))).alias("value"))


def share_of_total(frame: ResultFrame, column: str, label: tuple[str, object] | None = None, decimals: int = 2) -> DataFrame:
    """Adds `<column>_pct` of the whole population's total; a zero total has no shares, an unknown label no answer."""
    if frame.roles.get(column) not in ADDITIVE:
        raise Refused(f"{column} does not add up, so it has no shares")
    df = frame.population()
    value = measure(frame, df, column)
    whole = df.agg(F.sum(value)).first()[0]
    if not whole:
        raise Refused("the total is zero, so shares are not defined")
    out = df.withColumn(f"{column}_pct", F.round(value / F.lit(float(whole)) * 100, decimals))
    if label is None:
        return out
    one = out.filter(F.col(label[0]) == label[1])
    if one.isEmpty():
        raise Refused(f"no row with {label[0]} = {label[1]!r}")
    return one


def percent_change(frame: ResultFrame, period: str, column: str) -> DataFrame:
    """First to last non-null value by period in percent of the first; without two periods or from zero it is refused."""
    if frame.roles.get(period) != "temporal":
        raise Refused(f"{period} is no time column")
    df = frame.population()
    known = df.withColumn("__v", measure(frame, df, column)).filter("__v IS NOT NULL")
    ends = known.agg(
        F.min_by(column, period).alias("first_value"), F.max_by(column, period).alias("last_value"),
        F.min(period).alias("first_period"), F.max(period).alias("last_period"))
    row = ends.first()
    if row.first_period is None or row.first_period == row.last_period:
        raise Refused("a change needs two periods")
    if not row.first_value:
        raise Refused("the change from zero in percent is not defined")
    return ends.withColumn("pct_change", (F.col("last_value") - F.col("first_value")) / F.abs("first_value") * 100)


def _known(frame: ResultFrame, column: str) -> None:
    if column not in frame.df.columns:
        raise Refused(f"no column {column!r}")


def sort_frame(frame: ResultFrame, column: str, direction: str = "desc", tie: list[str] = ()) -> DataFrame:
    """The shown rows by number, numbers in text too; values that are none come last ascending and first descending."""
    _known(frame, column)
    value = measure(frame, frame.df, column)
    return frame.df.orderBy(value.asc_nulls_last() if direction == "asc" else value.desc_nulls_first(), *tie)


def _ends(frame: ResultFrame, column: str, n: int, largest: bool, tie: list[str]) -> DataFrame:
    """The first n rows by number of the whole population; rows without one don't count, and a column without any is refused."""
    _known(frame, column)
    df = frame.population()
    value = measure(frame, df, column)
    ranked = df.filter(value.isNotNull()).orderBy(value.desc() if largest else value.asc(), *tie).limit(max(1, n))
    if ranked.isEmpty():
        raise Refused(f"{column} has no numeric values to rank")
    return ranked


def top_n(frame: ResultFrame, column: str, n: int = 5, tie: list[str] = ()) -> DataFrame:
    """The n largest of the whole population."""
    return _ends(frame, column, n, True, tie)


def bottom_n(frame: ResultFrame, column: str, n: int = 5, tie: list[str] = ()) -> DataFrame:
    """The n smallest of the whole population."""
    return _ends(frame, column, n, False, tie)


def filter_rows(frame: ResultFrame, column: str, op: str, value) -> DataFrame:
    """Numeric comparison, or case-insensitive trimmed text equality and containment, over the shown rows."""
    _known(frame, column)
    df = frame.df
    if op in (">", ">=", "<", "<="):
        left, right = numeric(column), float(str(value).replace(",", ""))
        test = {">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[op]
        return df.filter(test)
    text, wanted = F.lower(F.trim(F.col(column).cast("string"))), str(value).strip().lower()
    if op in ("=", "=="):
        return df.filter(text == wanted)
    if op == "!=":
        return df.filter(text != wanted)
    if op == "contains":
        return df.filter(F.contains(text, F.lit(wanted)))
    raise Refused(f"unknown operator {op!r}")


def compare(frame: ResultFrame, slot: str, own: object, peers: list) -> DataFrame:
    """Re-run the query for other values of one parameter and stack the results."""
    if frame.requery is None:
        raise Refused("this result cannot be run again")
    if not peers:
        raise Refused("compare with at least one other")
    name = f"compared_{slot}"
    out = frame.df.withColumn(name, F.lit(own))
    for peer in peers:
        out = out.unionByName(frame.requery(slot, peer).withColumn(name, F.lit(peer)))
    return out


def compare_delta(compared: DataFrame, slot: str, own: object, column: str) -> DataFrame:
    """Difference of each compared single row from the row first asked for; results of several rows have none."""
    name = f"compared_{slot}"
    rows = compared.groupBy(name).count().collect()  # one row for each compared value
    if any(r["count"] != 1 for r in rows) or own not in {r[name] for r in rows}:
        raise Refused("differences are defined for results of a single row")
    base = compared.filter(F.col(name) == own).select(F.col(column).alias("__own"))
    return compared.crossJoin(F.broadcast(base)).withColumn(f"{column}_delta", F.col(column) - F.col("__own")).drop("__own")
