"""The numbers behind findings, read from the cube that was already aggregated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.mining import cube as cubes
from ledgerlens.mining.mine import Mining
from ledgerlens.mining.readable import name_scope
from ledgerlens.mining.siblings import VARIES
from ledgerlens.operators.joins import period_matches, with_bounds
from ledgerlens.operators.scan import scan

# pattern types whose highlight is a date
DATED_TYPES = ("CHANGE_POINT", "OUTLIER", "UNIMODALITY")


def support_profile(run: Mining) -> DataFrame:
    """Per (measure, time breakdown): series of the view and its depth-1 slices below the support guard.

    Series are sums whatever the measure's aggregate; listed only where most of them fail.
    """
    config, keys = run.config, run.cube.layout.keys
    depth_one = [i for i, f in enumerate(run.cube.layout.filter_sets) if len(f) <= 1]
    sums = cubes.points(run.cube, as_sums=True).filter(F.col("temporal") & F.col("fset").isin(depth_one))
    series = sums.groupBy("role", *keys, "mid", "dim_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("value") != 0).alias("nonzero"))
    enough = (F.col("nonzero") >= config.min_temporal_nonzero) & (
        F.col("nonzero") >= config.min_temporal_nonzero_frac * F.col("n"))
    out = name_scope(run.cube, series.groupBy("mid", "dim_id").agg(
        F.count("*").alias("series_examined"), F.count_if(~enough).alias("series_below_guard"),
        F.min("nonzero").alias("nonzero_points_min"), F.max("nonzero").alias("nonzero_points_max"),
    )).filter(F.col("series_below_guard") * 2 > F.col("series_examined"))
    return out.select(
        "measure", "breakdown", "series_examined", "series_below_guard", "nonzero_points_min", "nonzero_points_max")


def finding_points(run: Mining, found: DataFrame) -> DataFrame:
    """The base slice's distribution of every finding with one breakdown and one measure."""
    keys = run.cube.layout.keys
    single = found.filter((F.col("breakdown") != VARIES) & (F.col("measure") != VARIES)).select(
        "finding_id", "pattern_type", "highlight", F.col("group_role").alias("role"), *keys, F.col("group_mid").alias("mid"))
    return run.points.join(single, ["role", *keys, "mid"])


def value_stats(run: Mining, found: DataFrame, top: int = 5, bottom: int = 2) -> DataFrame:
    """Ranked values of each finding's distribution: the first `top`, the last `bottom` and the highlighted ones.

    `total` and `share_pct` exist only for summed measures, where the parts add up to the whole;
    `n_rows` is the number of rows behind each value. A distribution of any length is ranked in blocks.
    """
    sums = [i for i, m in enumerate(run.config.measures) if m.agg == "sum"]
    pts = finding_points(run, found).select("finding_id", "mid", "label", "value", "n_rows", "highlight")
    ranked = scan(pts, ["finding_id"], [F.desc("value"), F.col("label")], {"value": F.col("value")}).withColumns({
        "total": F.when(F.col("mid").isin(*sums), F.col("total_value")),
        "highlighted": F.array_contains(F.split("highlight", "\\|"), F.col("label"))})
    shown = (F.col("position") <= top) | (F.col("position") > F.col("group_rows") - bottom) | F.col("highlighted")
    return ranked.filter(shown).select(
        "finding_id", F.col("position").cast("int").alias("position"), "label", "value", F.col("group_rows").alias("n_values"), "total",
        F.when(F.col("total") > 0, F.col("value") / F.col("total") * 100).alias("share_pct"), "n_rows", "highlighted")


def _beside(run: Mining, found: DataFrame, measure: str) -> DataFrame:
    """Points of another measure in the same slice and breakdown as each finding."""
    names = [m.name for m in run.config.measures]
    keys = run.cube.layout.keys
    heads = found.filter(F.col("breakdown") != VARIES).select(
        "finding_id", "measure", F.col("group_role").alias("role"), *keys)
    return run.points.filter(F.col("mid") == names.index(measure)).join(heads, ["role", *keys])


def volume_share(run: Mining, found: DataFrame, volume: str) -> DataFrame:
    """Each group's share of the volume measure, for categorical findings about something else."""
    pts = _beside(run, found, volume).filter(~F.col("temporal") & (F.col("measure") != volume))
    whole = pts.groupBy("finding_id").agg(F.sum("value").alias("__t"))
    return pts.join(whole, "finding_id").filter("__t > 0").select(
        "finding_id", "label", F.col("value").alias("volume"), (F.col("value") / F.col("__t") * 100).alias("volume_share_pct"))


def intensity_companion(run: Mining, found: DataFrame, companions: dict[str, str], top: int = 5) -> DataFrame:
    """For totals that have an averaged alias: the `top` highest averages and the rows behind each."""
    out = None
    for total, mean in companions.items():
        pts = _beside(run, found.filter(F.col("measure") == total), mean).filter(~F.col("temporal"))
        order = Window.partitionBy("finding_id").orderBy(F.desc("value"), "label")
        part = pts.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= top).select(
            "finding_id", "position", "label", F.lit(mean).alias("companion"), F.col("value").alias("mean_value"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out


def utilisation_companion(run: Mining, found: DataFrame, numerator: str, denominator: str, words: str) -> DataFrame:
    """Ratio of sums per group, not on a time axis; a group without a denominator says so."""
    num = _beside(run, found, numerator).filter(~F.col("temporal")).select("finding_id", "label", F.col("value").alias("num"))
    den = _beside(run, found, denominator).filter(~F.col("temporal")).select("finding_id", "label", F.col("value").alias("den"))
    both = num.join(den, ["finding_id", "label"])
    pct = F.when(F.col("den") > 0, F.col("num") / F.col("den") * 100)
    return both.select(
        "finding_id", "label", pct.alias("utilisation_pct"),
        F.when(F.col("den") > 0, F.lit("ratio of sums")).otherwise(F.lit(f"no {words} on file")).alias("basis"))


def earmark_deviation(df: DataFrame, purpose: str, amount: str, purposes: list[str], slice_column: str | None = None) -> DataFrame:
    """Share of an earmarked amount that sits on its named purposes, and the residue by purpose."""
    keyed = df.withColumn("__slice", F.col(slice_column) if slice_column else F.lit(""))
    inside = F.col(purpose).isin(*purposes)
    by_purpose = keyed.groupBy("__slice", purpose).agg(F.sum(amount).alias("amount"))
    totals = by_purpose.groupBy("__slice").agg(
        F.sum("amount").alias("total"), F.sum(F.when(inside, F.col("amount")).otherwise(0.0)).alias("earmarked"))
    residue = by_purpose.join(totals, "__slice").filter((F.col("total") > 0) & ~inside & (F.col("amount") > 0))
    return residue.select(
        *([F.col("__slice").alias(slice_column)] if slice_column else []), F.col(purpose).alias("residue_purpose"),
        F.col("amount").alias("residue"), (F.col("earmarked") / F.col("total") * 100).alias("earmarked_pct"))


def boundary_caveat(found: DataFrame, members: DataFrame, count_measures: list[str], year_dim: str,
                    before: list[str], after: list[str], compared: DataFrame) -> DataFrame:
    """Findings that compare a count measure across a break in how years were reported.

    `members(finding_id, member_label)` are siblings, of which only those with one of the labels given here matter;
    `compared(finding_id, label)` are the labels of a finding's own breakdown.
    """
    labels = members.groupBy("finding_id").agg(
        F.bool_or(F.col("member_label").isin(*count_measures)).alias("member_is_count"),
        F.bool_or(F.col("member_label").isin(*before)).alias("member_before"),
        F.bool_or(F.col("member_label").isin(*after)).alias("member_after"),
        F.bool_or(F.col("member_label") == year_dim).alias("member_is_year"))
    own = compared.groupBy("finding_id").agg(
        F.bool_or(F.col("label").isin(*before)).alias("own_before"), F.bool_or(F.col("label").isin(*after)).alias("own_after"))
    joined = found.join(labels, "finding_id", "left").join(own, "finding_id", "left")
    yes = F.lit(True)
    counted = F.when(F.col("measure") == VARIES, F.col("member_is_count")).otherwise(F.col("measure").isin(*count_measures))
    across = (
        F.when((F.col("strategy") == "subspace") & (F.col("extending_dimension") == year_dim),
               F.col("member_before") & F.col("member_after"))
        .when(F.col("breakdown") == year_dim, F.coalesce(F.col("own_before") & F.col("own_after"), ~yes))
        .when(F.col("breakdown") == VARIES, F.col("member_is_year")).otherwise(~yes))
    return joined.select("finding_id", F.coalesce(counted & across, ~yes).alias("reporting_caveat"))


def finding_periods(found: DataFrame, members: DataFrame, depth: int) -> DataFrame:
    """Dated periods a finding points at: its highlight, its exceptions and its own slice."""
    dated = F.col("pattern_type").isin(*DATED_TYPES)

    def parts(column: str) -> Column:
        return F.explode(F.transform(F.split(column, "\\|"), lambda x: F.substring_index(x, ":", 1)))

    rows = found.filter(dated).select(
        "finding_id", parts("highlight").alias("label"), F.lit("the shift this finding reports").alias("what"))
    odd = members.filter(F.col("category") == "HIGHLIGHT_CHANGE").join(
        found.filter(dated).select("finding_id"), "finding_id", "left_semi").select(
        "finding_id", parts("highlight").alias("label"), F.lit("an exception in this finding").alias("what"))
    out = rows.unionByName(odd)
    for i in range(1, depth + 1):
        out = out.unionByName(found.filter(F.col(f"filter{i}_value").isNotNull()).select(
            "finding_id", F.col(f"filter{i}_value").alias("label"),
            F.lit("the period this finding is restricted to").alias("what")))
    bounded = with_bounds(out).filter("b IS NOT NULL")
    return bounded.select("finding_id", "what", "label", "b.first", "b.last")


def event_citations(periods: DataFrame, events: DataFrame, grace: int = 3) -> DataFrame:
    """One row per event and kind of overlap; being inside the window wins over just after it."""
    matched = period_matches(periods, events.select("event", "event_first", "event_last", "start_month", "end_month", "note"), grace)
    return matched.groupBy("event", "start_month", "end_month", "note", "what").agg(
        F.when(F.bool_or(F.col("relation") == "inside"), "inside").otherwise(F.min("relation")).alias("relation"), F.count_distinct("finding_id").alias("findings"))


def data_quality_list(run: Mining) -> DataFrame:
    """Displaced findings and thinly supported measures in one table."""
    displaced = run.displaced.select(
        F.lit("displaced finding").alias("kind"), "measure", "breakdown", "pattern_type", "finding_id",
        F.col("n_supported").cast("long").alias("supported"), F.col("hdp_size").cast("long").alias("examined"))
    thin = support_profile(run).select(
        F.lit("thin measure").alias("kind"), "measure", "breakdown", F.lit(None).cast("string").alias("pattern_type"),
        F.lit(None).cast("string").alias("finding_id"),
        (F.col("series_examined") - F.col("series_below_guard")).alias("supported"), F.col("series_examined").alias("examined"))
    return displaced.unionByName(thin)
