"""Registered mining queries (cube, patterns, sibling findings)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.catalog import mining_sql as ms
from ledgerlens.catalog.registry import query
from ledgerlens.catalog.views_sql import (
    DOCUMENT_VIEW_SQL, EVENT_VIEW_SQL, HALF_VIEW_SQL, LINE_VIEW_SQL, ORDER_VIEW_SQL, document_config, document_view, event_config,
    event_view, half_config, half_view, line_config, line_view, order_config, order_view,
)
from ledgerlens.mining.config import CATEGORICAL_TYPES, TEMPORAL_TYPES
from ledgerlens.mining.mine import Mining
from ledgerlens.mining.patterns import requested_verdict, scope_patterns
from ledgerlens.mining.readable import readable_hits, readable_points, readable_shares, scope_list, subspaces
from ledgerlens.operators.scan import quantiles
from ledgerlens.tables import Tables

_RUNS: dict[tuple, Mining] = {}
_VIEWS = {
    "orders": (order_view, order_config, ORDER_VIEW_SQL),
    "lines": (line_view, line_config, LINE_VIEW_SQL),
    "events": (event_view, event_config, EVENT_VIEW_SQL),
    "documents": (document_view, document_config, DOCUMENT_VIEW_SQL),
    "halves": (half_view, half_config, HALF_VIEW_SQL),
}


def mining(t: Tables, view: str = "orders", depth: int = 1) -> Mining:
    """One run per session, state of the folder, view and depth; its stages are files later queries read."""
    recipe, config, _ = _VIEWS[view]
    key = (*t.state, view, depth)
    if key not in _RUNS:
        _RUNS[key] = Mining(recipe(t), config(depth))
    return _RUNS[key]


def forget_runs() -> None:
    _RUNS.clear()


def sql(select: str, view: str = "orders", depth: int = 1, stage: str = "findings") -> str:
    _, config, text = _VIEWS[view]
    cfg = config(depth)
    parts = ms.ctes(text, cfg)
    if stage == "shares":
        parts = [p for p in parts if p.split(" ", 1)[0] in ("v", "slices", "shares")]
    if stage in ("hits", "findings"):
        parts += ms.hit_ctes(cfg)
    if stage == "findings":
        parts += ms.finding_ctes(cfg)
    return ms.statement(parts, select)


SLICE = "f1d AS filter1_dim, f1v AS filter1_value, f2d AS filter2_dim, f2v AS filter2_value"
FINDING_SQL = """
SELECT strategy, ext AS extending_dimension, type AS pattern_type, gb AS breakdown, gm AS measure,
       g1d AS filter1_dim, g1v AS filter1_value, CAST(size AS BIGINT) AS hdp_size, highlight,
       CAST(common_count AS BIGINT) AS common_count, CAST(n_hc AS BIGINT) AS n_highlight_change,
       CAST(n_tc AS BIGINT) AS n_type_change, CAST(n_np AS BIGINT) AS n_no_pattern,
       round(conciseness, 6) AS conciseness, round(impact, 6) AS impact, impact_measure, round(score, 6) AS score
FROM finds"""


def finding_columns(found: DataFrame) -> DataFrame:
    return found.select(
        "strategy", "extending_dimension", "pattern_type", "breakdown", "measure",
        F.coalesce("filter1_dim", F.lit("")).alias("filter1_dim"),
        F.coalesce("filter1_value", F.lit("")).alias("filter1_value"),
        F.col("hdp_size").cast("long").alias("hdp_size"), "highlight", F.col("common_count").cast("long").alias("common_count"),
        *[F.col(c).cast("long").alias(c) for c in ("n_highlight_change", "n_type_change", "n_no_pattern")],
        F.round("conciseness", 6).alias("conciseness"), F.round("impact", 6).alias("impact"), "impact_measure",
        F.round("score", 6).alias("score"),
    )


@query("a09_slice_cube", sql(f"""
SELECT {SLICE}, breakdown, label, measure, round(CASE WHEN measure LIKE 'mean%' THEN value * n_rows ELSE value END, 2) AS total, CAST(n_rows AS BIGINT) AS n_rows FROM pts""", stage="cube"))
def slice_cube(t: Tables) -> DataFrame:
    return readable_points(mining(t).cube, mining(t).points)


@query("a09_slice_cube_depth2", sql(f"""
SELECT {SLICE}, breakdown, label, measure, round(CASE WHEN measure LIKE 'mean%' THEN value * n_rows ELSE value END, 2) AS total, CAST(n_rows AS BIGINT) AS n_rows FROM pts""",
    view="events", depth=2, stage="cube"))
def slice_cube_depth2(t: Tables) -> DataFrame:
    run = mining(t, "events", 2)
    return readable_points(run.cube, run.points)


@query("a10_pair_grain_groupby", sql("""
SELECT f1d AS sibling_dim, f1v AS sibling, breakdown, measure, label, round(CASE WHEN measure LIKE 'mean%' THEN value * n_rows ELSE value END, 2) AS total
FROM pts WHERE f1d <> ''""", stage="cube"))
def pair_grain(t: Tables) -> DataFrame:
    run = mining(t)
    return readable_points(run.cube, run.points).filter("filter1_dim <> ''").select(
        F.col("filter1_dim").alias("sibling_dim"), F.col("filter1_value").alias("sibling"), "breakdown", "measure", "label", "total")


def _subspace_sql(depth: int) -> str:
    cfg = order_config(depth)
    parts = ["SELECT '' AS filter1_dim, '' AS filter1_value, '' AS filter2_dim, '' AS filter2_value"]
    for filters in ms.filter_sets(cfg)[1:]:
        if len(filters) == 1:
            d = filters[0]
            parts.append(f"SELECT DISTINCT '{d}', {d}, '', '' FROM v WHERE {d} IS NOT NULL")
        else:
            a, b = filters
            parts.append(
                f"SELECT '{a}', x, '{b}', y FROM (SELECT DISTINCT {a} AS x FROM v WHERE {a} IS NOT NULL), "
                f"(SELECT DISTINCT {b} AS y FROM v WHERE {b} IS NOT NULL)"
            )
    return f"WITH v AS ({ORDER_VIEW_SQL}), subs AS ({' UNION ALL '.join(parts)})"


@query("m01_subspace_enumeration", _subspace_sql(2) + " SELECT * FROM subs")
def m01(t: Tables) -> DataFrame:
    return subspaces(mining(t, depth=2).cube)


def _scope_sql() -> str:
    cfg = order_config(1)
    dims = " UNION ALL ".join(f"SELECT '{d}' AS breakdown" for d in cfg.all_dims)
    measures = " UNION ALL ".join(f"SELECT '{m.name}' AS measure" for m in cfg.measures)
    return _subspace_sql(1) + f""" SELECT filter1_dim, filter1_value, breakdown, measure FROM subs, ({dims}), ({measures})
        WHERE breakdown <> filter1_dim AND NOT (measure = 'orders' AND breakdown = 'o_orderstatus')"""


@query("m02_scope_enumeration", _scope_sql())
def m02(t: Tables) -> DataFrame:
    return scope_list(mining(t).cube).select("filter1_dim", "filter1_value", "breakdown", "measure")


_SHARE = f"""SELECT {SLICE}, round(i_0, 6) AS impact_price, round(i_1, 6) AS impact_orders, round(max_share, 6) AS max_impact
FROM shares"""


def _shares(t: Tables) -> DataFrame:
    run = mining(t, depth=2)
    return readable_shares(run.cube, run.shares)


@query("m03_subspace_impact", sql(_SHARE, depth=2, stage="shares"))
def m03(t: Tables) -> DataFrame:
    return _shares(t)


@query("m04_impact_prune", sql(_SHARE + " WHERE max_share >= 0.01", depth=2, stage="shares"))
def m04(t: Tables) -> DataFrame:
    run = mining(t, depth=2)
    return readable_shares(run.cube, run.shares.filter(F.col("max_share") >= run.config.min_impact))


@query("m05_scope_query", sql("""
SELECT label, round(CASE WHEN measure LIKE 'mean%' THEN value * n_rows ELSE value END, 2) AS total FROM pts
WHERE f1d = 'n_name' AND f1v = 'NATION_3' AND breakdown = 'quarter' AND measure = 'mean_price'""", stage="cube"))
def m05(t: Tables) -> DataFrame:
    run = mining(t)
    return readable_points(run.cube, run.points).filter(
        (F.col("filter1_value") == "NATION_3") & (F.col("breakdown") == "quarter") & (F.col("measure") == "mean_price")
    ).select("label", "total")


def _register_pattern(number: int, kind: str) -> None:
    views = (("orders", 2), ("events", 2)) + ((("documents", 1),) if kind in CATEGORICAL_TYPES else ())
    parts = [
        f"SELECT * FROM ({sql(f'''SELECT '{v}' AS view, {SLICE}, breakdown, measure, highlight FROM hits WHERE type = '{kind}' ''', v, d, 'hits')})"
        for v, d in views
    ]

    @query(f"m{number:02d}_{kind.lower()}", " UNION ALL ".join(parts))
    def run(t: Tables) -> DataFrame:
        out = None
        for v, d in views:
            m = mining(t, v, d)
            part = readable_hits(m.cube, m.scopes).filter(F.col("type") == kind).select(
                F.lit(v).alias("view"), "filter1_dim", "filter1_value", "filter2_dim", "filter2_value",
                "breakdown", "measure", "highlight",
            )
            out = part if out is None else out.unionByName(part)
        return out


for _i, _kind in enumerate(CATEGORICAL_TYPES + TEMPORAL_TYPES):
    _register_pattern(6 + _i, _kind)


@query("m17_pattern_eligibility", sql("""
SELECT type, count(*) AS scopes, count(*) FILTER (breakdown IN ('month', 'quarter', 'year')) AS temporal_scopes
FROM hits GROUP BY type""", stage="hits"))
def m17(t: Tables) -> DataFrame:
    run = mining(t)
    return run.scopes.withColumn("h", F.explode("hits")).groupBy(F.col("h.type").alias("type")).agg(
        F.count("*").alias("scopes"), F.count_if("temporal").alias("temporal_scopes"))


_ALL_TYPES = CATEGORICAL_TYPES + TEMPORAL_TYPES
_KIND = "CASE WHEN requested IN (" + ", ".join(f"'{x}'" for x in TEMPORAL_TYPES) + ") THEN temporal ELSE NOT temporal END"


@query("m18_detect_other_pattern", sql(f"""
SELECT requested, breakdown, measure, verdict, count(*) AS scopes FROM (
  SELECT requested, f1d, f1v, breakdown, measure, CASE WHEN bool_or(type = requested) THEN requested WHEN count(type) > 0 THEN 'OTHER_PATTERN' ELSE 'NO_PATTERN' END AS verdict
  FROM (SELECT DISTINCT f1d, f1v, breakdown, measure, temporal FROM pts)
  JOIN (SELECT unnest({list(_ALL_TYPES)!r}) AS requested) ON {_KIND}
  LEFT JOIN (SELECT f1d, f1v, breakdown, measure, type FROM hits) USING (f1d, f1v, breakdown, measure)
  GROUP BY requested, f1d, f1v, breakdown, measure) GROUP BY ALL""", stage="hits"))
def m18(t: Tables) -> DataFrame:
    run = mining(t)
    scopes = readable_hits(run.cube, run.scopes, explode=False)
    asked = F.array(*[F.struct(F.lit(x).alias("requested"), F.lit(x in TEMPORAL_TYPES).alias("timed"), requested_verdict(x).alias("verdict"))
                      for x in _ALL_TYPES])
    judged = scopes.withColumn("a", F.explode(asked)).filter(F.col("a.timed") == F.col("temporal"))
    return judged.groupBy("a.requested", "breakdown", "measure", "a.verdict").agg(F.count("*").alias("scopes"))


@query("x01_own_pattern_test", sql("""
SELECT f1d AS filter1_dim, f1v AS filter1_value, breakdown, measure, 'WIDE' AS pattern, max(label) FILTER (lo = 1) || '<' || max(label) FILTER (hi = 1) AS highlight FROM (
  SELECT *, row_number() OVER (PARTITION BY f1d, f1v, breakdown, measure ORDER BY value DESC, label) AS hi,
    row_number() OVER (PARTITION BY f1d, f1v, breakdown, measure ORDER BY value, label) AS lo FROM pts WHERE NOT temporal)
GROUP BY f1d, f1v, breakdown, measure HAVING count(*) >= 3 AND max(value) > 1.2 * min(value) AND min(value) > 0
UNION ALL
SELECT f1d, f1v, breakdown, measure, 'LATE_PEAK', max(label) FROM (SELECT *, max(label) OVER (PARTITION BY f1d, f1v, breakdown, measure) AS last,
    max(value) OVER (PARTITION BY f1d, f1v, breakdown, measure) AS top FROM pts WHERE temporal)
GROUP BY f1d, f1v, breakdown, measure HAVING bool_or(label = last AND value = top)""", stage="cube"))
def x01(t: Tables) -> DataFrame:
    """Two tests of a user's own: one over the statistics of a scope, one as a pandas UDF over its series."""
    run = mining(t)

    @F.pandas_udf("string")
    def late_peak(labels: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([k[-1] if v[-1] == max(v) else None for k, v in zip(labels, values)], dtype=object)

    wide = lambda config: F.when((F.col("n") >= 3) & (F.col("v1") > 1.2 * F.col("b1")) & (F.col("b1") > 0), F.concat("low1", F.lit("<"), "top1"))
    layout = run.cube.layout
    found = scope_patterns(run.points, layout.keys, run.config, "code" if layout.ordered_codes else "label", extra_tests={
        "categorical": {"WIDE": wide}, "series": {"LATE_PEAK": lambda config: late_peak("labels", "values")}})
    own = found.withColumn("hits", F.filter("hits", lambda h: h["type"].isin("WIDE", "LATE_PEAK"))).filter(F.size("hits") > 0)
    rows = readable_hits(run.cube, own, explode=False)
    return rows.withColumn("h", F.explode("hits")).select(
        "filter1_dim", "filter1_value", "breakdown", "measure", F.col("h.type").alias("pattern"), F.col("h.highlight").alias("highlight"))


@query("m19_subspace_siblings", sql("""
SELECT g1d AS filter1_dim, g1v AS filter1_value, ext AS extending_dimension, gb AS breakdown, gm AS measure,
       CAST(any_value(size) AS BIGINT) AS hdp_size, count(DISTINCT member) AS members_with_pattern
FROM mem WHERE strategy = 'subspace' AND size >= 3 GROUP BY ALL""", view="events", depth=2))
def m19(t: Tables) -> DataFrame:
    run = mining(t, "events", 2)
    from ledgerlens.mining.readable import name_groups

    keys = run.cube.layout.keys
    grouped = run.members.filter(F.col("strategy") == "subspace").groupBy(
        "group_role", "ext_id", "group_mid", *keys).agg(
        F.first("size").cast("long").alias("hdp_size"), F.count_distinct("member").alias("members_with_pattern"))
    return name_groups(run.cube, grouped).select(
        "filter1_dim", "filter1_value", "extending_dimension", "breakdown", "measure", "hdp_size", "members_with_pattern")


def _register_strategy(name: str, where: str, cond) -> None:
    @query(name, sql(FINDING_SQL + f" WHERE NOT low_support AND {where}"))
    def run(t: Tables) -> DataFrame:
        return finding_columns(mining(t).findings.filter(cond))


_register_strategy("m20_measure_and_grain_siblings", "strategy <> 'subspace'", "strategy <> 'subspace'")
_register_strategy("m24_seed_rule", "g1d <> ''", "filter1_dim IS NOT NULL")


def _register_view(name: str, view: str) -> None:
    @query(name, sql(FINDING_SQL + " WHERE NOT low_support", view))
    def run(t: Tables) -> DataFrame:
        return finding_columns(mining(t, view).findings)


_register_view("m21_minimum_sibling_size", "halves")  # a dimension of two values, which extends no set


@query("m22_commonness_and_exceptions", sql("""
SELECT strategy, type AS pattern_type, count(*) AS findings, CAST(sum(n_common) AS BIGINT) AS common_members,
       CAST(sum(n_hc) AS BIGINT) AS highlight_changes, CAST(sum(n_tc) AS BIGINT) AS type_changes,
       CAST(sum(n_np) AS BIGINT) AS no_patterns FROM finds WHERE NOT low_support GROUP BY ALL"""))
def m22(t: Tables) -> DataFrame:
    # siblings are counted while sets are grouped; those without a pattern are the rest of the domain and are never listed
    def total(c: str):
        return F.sum(F.col(c).cast("long"))

    return mining(t).findings.groupBy("strategy", "pattern_type").agg(
        F.count("*").alias("findings"), total("n_common").alias("common_members"), total("n_highlight_change").alias("highlight_changes"),
        total("n_type_change").alias("type_changes"), total("n_no_pattern").alias("no_patterns"))


@query("m23_sibling_set_dedup", sql("""
SELECT strategy, type AS pattern_type, gb AS breakdown, count(*) AS sibling_sets FROM (SELECT DISTINCT * FROM finds)
GROUP BY ALL"""))
def m23(t: Tables) -> DataFrame:
    return mining(t).all_findings.groupBy("strategy", "pattern_type", "breakdown").agg(
        F.count_distinct("finding_id").alias("sibling_sets"))


@query("m25_conciseness", sql("""
SELECT CAST(size AS BIGINT) AS hdp_size, CAST(n_common AS BIGINT) AS n_common, CAST(n_hc AS BIGINT) AS n_highlight_change,
       CAST(n_tc AS BIGINT) AS n_type_change, CAST(n_np AS BIGINT) AS n_no_pattern,
       round(max(conciseness), 6) AS conciseness, count(*) AS findings FROM finds GROUP BY ALL"""))
def m25(t: Tables) -> DataFrame:
    cols = ("hdp_size", "n_common", "n_highlight_change", "n_type_change", "n_no_pattern")
    return mining(t).all_findings.groupBy(*[F.col(c).cast("long").alias(c) for c in cols]).agg(
        F.round(F.max("conciseness"), 6).alias("conciseness"), F.count("*").alias("findings"))


@query("m26_finding_impact", sql("""
SELECT strategy, g1d AS filter1_dim, g1v AS filter1_value, ext AS extending_dimension,
       round(max(impact), 6) AS impact, any_value(impact_measure) AS impact_measure FROM finds GROUP BY ALL"""))
def m26(t: Tables) -> DataFrame:
    return mining(t).all_findings.groupBy(
        "strategy", F.coalesce("filter1_dim", F.lit("")).alias("filter1_dim"),
        F.coalesce("filter1_value", F.lit("")).alias("filter1_value"), "extending_dimension",
    ).agg(F.round(F.max("impact"), 6).alias("impact"), F.max("impact_measure").alias("impact_measure"))


@query("m27_scored_findings", sql(FINDING_SQL + " WHERE NOT low_support"))
def m27(t: Tables) -> DataFrame:
    return finding_columns(mining(t).findings)


@query("m27_scored_findings_depth2", sql(FINDING_SQL + " WHERE NOT low_support", view="events", depth=2))
def m27_depth2(t: Tables) -> DataFrame:
    return finding_columns(mining(t, "events", 2).findings)


@query("m28_temporal_support_guard", sql("""
SELECT strategy, ext AS extending_dimension, type AS pattern_type, gb AS breakdown, gm AS measure, g1v AS filter1_value,
       CAST(n_ok AS BIGINT) AS supported_members, CAST(common_count AS BIGINT) AS common_count, low_support
FROM finds WHERE type IN ('TREND', 'OUTLIER', 'SEASONALITY', 'CHANGE_POINT', 'UNIMODALITY')"""))
def m28(t: Tables) -> DataFrame:
    return mining(t).all_findings.filter(F.col("pattern_type").isin(*TEMPORAL_TYPES)).select(
        "strategy", "extending_dimension", "pattern_type", "breakdown", "measure",
        F.coalesce("filter1_value", F.lit("")).alias("filter1_value"),
        F.col("n_supported").cast("long").alias("supported_members"),
        F.col("common_count").cast("long").alias("common_count"), "low_support")


@query("m30_diagnostics", sql("""
SELECT type AS pattern_type, count(*) AS findings, round(max(score), 6) AS best_score,
       round(quantile_cont(score, 0.5), 6) AS median_score FROM finds WHERE NOT low_support GROUP BY type"""))
def m30(t: Tables) -> DataFrame:
    found = mining(t).findings
    best = found.groupBy("pattern_type").agg(F.round(F.max("score"), 6).alias("best_score"))
    middle = quantiles(found, ["pattern_type"], F.col("score"), 0.5)
    return middle.join(best, "pattern_type").select(
        "pattern_type", F.col("n").alias("findings"), "best_score", F.round("value", 6).alias("median_score"))
