"""Checks of a view that ride on the job writing it, and key checks that share one job."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ledgerlens.session import inline_table
from ledgerlens.sources.readers import write_view

REPORT = "check_name string, subject string, found double, passed boolean"


@dataclass(frozen=True)
class ViewChecks:
    """What a view has to satisfy; every part may be left out."""

    rows: tuple[int, int] | None = None                                         # least and most rows
    null_share: Mapping[str, float] = field(default_factory=dict)               # column -> largest share of nulls
    domains: Mapping[str, list[str]] = field(default_factory=dict)              # column -> expected values, as text
    spans: Mapping[str, tuple[float, float]] = field(default_factory=dict)      # date column -> least and most years
    grains: tuple[tuple[str, ...], ...] = ()                                    # columns that repeat in no two rows
    unique: tuple[str, ...] = ()                                                # keys; nulls count as duplicates
    parents: Mapping[str, tuple[DataFrame, str]] = field(default_factory=dict)  # child column -> parent table and key


def _metrics(checks: ViewChecks) -> list[Column]:
    out = [F.count(F.lit(1)).alias("rows")]
    out += [F.count_if(F.col(c).isNull()).alias(f"nulls:{c}") for c in checks.null_share]
    out += [F.count_if(F.coalesce(~F.col(c).cast("string").isin(*v), F.lit(False))).alias(f"unexpected:{c}")
            for c, v in checks.domains.items()]
    out += [F.datediff(F.max(c), F.min(c)).alias(f"days:{c}") for c in checks.spans]
    return out


def _value_rows(checks: ViewChecks, seen: dict) -> list[tuple]:
    """One row for each check that needs no keys; a share or a span of no rows is null, and neither passes nor fails."""
    n = seen.get("rows") or 0
    out = []
    if checks.rows:
        out.append(("rows", "", float(n), checks.rows[0] <= n <= checks.rows[1]))
    for c, most in checks.null_share.items():
        share = seen[f"nulls:{c}"] / n if n else None
        out.append(("null_share", c, share, None if share is None else share <= most))
    for c in checks.domains:
        odd = seen.get(f"unexpected:{c}") or 0
        out.append(("unexpected", c, float(odd), odd == 0))
    for c, (low, high) in checks.spans.items():
        days = seen.get(f"days:{c}")
        years = None if days is None else days / 365.0
        out.append(("span_years", c, years, None if years is None else low <= years <= high))
    return out


def _key(columns: tuple[str, ...]) -> Column:
    if len(columns) == 1:
        return F.col(columns[0]).cast("string")
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def key_report(df: DataFrame, checks: ViewChecks) -> DataFrame | None:
    """Repeated grains, duplicate keys and orphans of all key checks by one aggregation, None if there are none.

    Each row gives one (check, key) pair to every check and parents add theirs without a count, so one shuffle of pairs,
    combined on the map side, serves all checks and no parent is joined.
    """
    wanted = [("repeated_keys", ",".join(g)) for g in checks.grains] + [("duplicates", k) for k in checks.unique]
    wanted += [("orphans", c) for c in checks.parents]
    if not wanted:
        return None
    keys = [_key(g) for g in checks.grains] + [_key((c,)) for c in (*checks.unique, *checks.parents)]
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("check_no"), k.alias("key")) for i, k in enumerate(keys)])).alias("p")).select(
        "p.*", F.lit(1).alias("n"), F.lit(False).alias("known"))
    kinds = dict(df.dtypes)
    for i, (child, (parent, key)) in enumerate(checks.parents.items(), len(checks.grains) + len(checks.unique)):
        pairs = pairs.unionByName(parent.select(
            F.lit(i).alias("check_no"), F.col(key).cast(kinds[child]).cast("string").alias("key"), F.lit(0).alias("n"), F.lit(True).alias("known")))
    per_key = pairs.groupBy("check_no", "key").agg(F.sum("n").alias("n"), F.bool_or("known").alias("known"))
    keyed = F.col("key").isNotNull()
    found = per_key.groupBy("check_no").agg(
        F.count_if(F.col("n") > 1).alias("repeated"),
        (F.sum("n") - F.count_if(keyed & (F.col("n") > 0))).alias("duplicates"),
        F.sum(F.when(keyed & ~F.col("known"), F.col("n")).otherwise(0)).alias("orphans"))
    names = inline_table(df.sparkSession, [(i, *w) for i, w in enumerate(wanted)], "check_no int, check_name string, subject string")
    value = F.when(F.col("check_name") == "orphans", F.col("orphans")).when(
        F.col("check_name") == "duplicates", F.col("duplicates")).otherwise(F.col("repeated"))
    # one row a check on either side; a view without rows has no pairs
    return names.join(found, "check_no", "left").withColumn("found", F.coalesce(value, F.lit(0)).cast("double")).select(
        "check_name", "subject", "found", (F.col("found") == 0).alias("passed"))


def write_checked(df: DataFrame, path: str, checks: ViewChecks, partition_by: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Write a view and return (a scan of it, its report: check_name, subject, found, passed).

    Counts, nulls, odd values and date spans are metrics of the writing job itself. They sit in the last stage of the job,
    where a task that is run again counts once. Key checks read the key columns of the written files, all in one job.
    """
    seen = Observation()
    written = write_view(df.observe(seen, *_metrics(checks)), path, partition_by)
    report = inline_table(df.sparkSession, _value_rows(checks, seen.get), REPORT)
    keyed = key_report(written, checks)
    return written, report if keyed is None else report.unionByName(keyed)
