"""Eleven pattern tests on distributions, as column expressions over per-scope statistics.

A categorical scope needs its extremes and the moments of what remains without them, which
combine on the map side. A temporal scope, as long as its time axis, needs ordered-window
quantities: the windows and the final aggregation share one shuffle of its points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.mining.config import CATEGORICAL_TYPES, TEMPORAL_TYPES, ViewConfig
from ledgerlens.mining.stats import t_tail

# fixed thresholds of the pattern definitions
Z_ONE = 2.0
Z_TWO = 1.5
TOP_TWO_RATIO = 1.3
LAST_TWO_RATIO = 0.77
EVEN_CV = 0.15
ATTRIBUTION_SHARE = 0.5
ATTRIBUTION_RATIO = 2.0
TREND_P = 0.05
TREND_RHO = 0.5
OUTLIER_Z = 3.0
OUTLIER_SHARE = 0.2
SEASON_LAGS = (3, 4, 6, 12)
SEASON_ACF = 0.4
CHANGE_P = 0.01
# |t| below the normal quantile of CHANGE_P cannot reach CHANGE_P at any degree of freedom
CHANGE_T_FLOOR = 2.5758
UNIMODAL_SHARE = 0.7


def _ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def _sorted_pair(a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def outstanding_first(config: ViewConfig) -> Column:
    c = F.col
    clear = F.when(c("v2") == c("b1"), c("v1") > c("v2")).otherwise(
        _ratio(c("v1") - c("mean_not_top1"), c("sd_not_top1")) >= Z_ONE
    )
    apart = F.when(c("v2") > 0, _ratio(c("v1"), c("v2")) >= 1.0 / config.extremum_ratio).otherwise(True)
    return F.when((c("n") >= 3) & (c("total") != 0) & clear & apart, c("top1"))


def outstanding_last(config: ViewConfig) -> Column:
    c = F.col
    clear = F.when(c("b2") == c("v1"), c("b1") < c("b2")).otherwise(
        _ratio(c("b1") - c("mean_not_low1"), c("sd_not_low1")) <= -Z_ONE
    )
    apart = F.when(c("b2") > 0, _ratio(c("b1"), c("b2")) <= config.extremum_ratio).otherwise(True)
    return F.when((c("n") >= 3) & (c("total") != 0) & clear & apart, c("low1"))


def top_two(config: ViewConfig) -> Column:
    c = F.col
    clear = F.when(c("v3") == c("b1"), c("v2") > c("v3")).otherwise(
        (_ratio(c("v1") - c("mean_not_top2"), c("sd_not_top2")) >= Z_TWO)
        & (_ratio(c("v2") - c("mean_not_top2"), c("sd_not_top2")) >= Z_TWO)
    )
    apart = F.when(c("v3") > 0, _ratio(c("v2"), c("v3")) >= TOP_TWO_RATIO).otherwise(True)
    return F.when((c("n") >= 4) & (c("total") != 0) & clear & apart, _sorted_pair(c("top1"), c("top2")))


def last_two(config: ViewConfig) -> Column:
    c = F.col
    clear = F.when(c("b3") == c("v1"), c("b2") < c("b3")).otherwise(
        (_ratio(c("b1") - c("mean_not_low2"), c("sd_not_low2")) <= -Z_TWO)
        & (_ratio(c("b2") - c("mean_not_low2"), c("sd_not_low2")) <= -Z_TWO)
    )
    apart = F.when(c("b3") > 0, _ratio(c("b2"), c("b3")) <= LAST_TWO_RATIO).otherwise(True)
    return F.when((c("n") >= 4) & (c("total") != 0) & clear & apart, _sorted_pair(c("low1"), c("low2")))


def evenness(config: ViewConfig) -> Column:
    c = F.col
    even = (_ratio(c("sd"), c("mean")) < EVEN_CV) & (_ratio(c("v1"), c("total")) <= F.lit(2.0) / c("n"))
    return F.when((c("n") >= 3) & (c("mean") != 0) & even, F.lit("EVEN"))


def attribution(config: ViewConfig) -> Column:
    c = F.col
    major = _ratio(c("v1"), c("total")) > ATTRIBUTION_SHARE
    apart = F.when(c("v2") > 0, _ratio(c("v1"), c("v2")) >= ATTRIBUTION_RATIO).otherwise(True)
    return F.when((c("n") >= 3) & (c("total") != 0) & major & apart, c("top1"))


def trend(config: ViewConfig) -> Column:
    c = F.col
    strong = (F.round(F.abs(c("rho")), 12) >= TREND_RHO) & (c("rho_p") < TREND_P)
    return F.when((c("n") >= 4) & strong, F.when(c("rho") > 0, "INCREASING").otherwise("DECREASING"))


def outlier(config: ViewConfig) -> Column:
    c = F.col
    few = (F.size("far") > 0) & (F.size("far") <= OUTLIER_SHARE * c("n"))
    text = F.concat_ws("|", F.transform(F.array_sort("far"), lambda x: x["text"]))
    return F.when((c("n") >= 5) & (c("v_max") > c("v_min")) & few, text)


def seasonality(config: ViewConfig) -> Column:
    c = F.col
    acfs = [F.when((c(f"acf_{k}") > SEASON_ACF) & (F.lit(2 * k) <= c("n")), c(f"acf_{k}")) for k in SEASON_LAGS]
    best = F.greatest(*acfs)
    name = F.coalesce(*[F.when(a == best, F.lit(f"PERIOD_{k}")) for a, k in zip(acfs, SEASON_LAGS)])
    return F.when((c("n") >= 12) & (c("v_max") > c("v_min")), name)


def change_point(config: ViewConfig) -> Column:
    return F.when((F.col("n") >= 6) & (F.col("split.p") < CHANGE_P), F.col("split.label"))


def unimodality(config: ViewConfig) -> Column:
    c = F.col

    def score(i: str, left: str, right: str) -> Column:
        before, after = c(left) / F.nullif(c(i), F.lit(0)), c(right) / F.nullif(c("n") - 1 - c(i), F.lit(0))
        inside = (c(i) >= 1) & (c(i) <= c("n") - 2)
        return F.when(inside & (before >= UNIMODAL_SHARE) & (after >= UNIMODAL_SHARE), (before + after) / 2)

    peak = score("i_max", "up_to_max", "down_from_max")
    valley = score("i_min", "down_to_min", "up_from_min")
    shape = (
        F.when(peak.isNotNull() & (valley.isNull() | (peak >= valley)), F.concat(F.lit("PEAK|"), c("max_label")))
        .when(valley.isNotNull(), F.concat(F.lit("VALLEY|"), c("min_label")))
    )
    return F.when(c("n") >= 5, shape)


CATEGORICAL: dict[str, Callable[[ViewConfig], Column]] = dict(zip(
    CATEGORICAL_TYPES,
    (outstanding_first, outstanding_last, top_two, last_two, evenness, attribution),
))
TEMPORAL: dict[str, Callable[[ViewConfig], Column]] = dict(zip(
    TEMPORAL_TYPES, (trend, outlier, seasonality, change_point, unimodality),
))


def hits_column(tests: dict[str, Callable[[ViewConfig], Column]], config: ViewConfig) -> Column:
    """array<struct<type, highlight>> of the tests that fire on the row."""
    found = F.array(*[
        F.struct(F.lit(name).alias("type"), test(config).alias("highlight")) for name, test in tests.items()
    ])
    return F.filter(found, lambda h: h["highlight"].isNotNull())


def categorical_stats(points: DataFrame, scope: list[str], keep: list[str] = (), order: str = "code") -> DataFrame:
    """Moments and three extremes at either end per scope, with the moments of the rest.

    Moments are one map-side combined aggregation. The extremes come from rank limits of three, which Spark applies in every
    map task, so no task sorts or holds a scope. The moments of the rest follow by taking the extremes out of the whole.
    """
    c = F.col
    base = points.groupBy(*scope).agg(
        *[F.first(k).alias(k) for k in keep],
        F.count("value").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"), F.sum((c("value") != 0).cast("int")).alias("nonzero"), F.var_pop("value").alias("spread"))

    def ends(side: str, by: Column) -> DataFrame:
        ranked = points.select(*scope, "value", "label", order).withColumn(
            "rank", F.row_number().over(Window.partitionBy(*scope).orderBy(by, order)))
        return ranked.filter("rank <= 3").select(*scope, "value", "label", "rank", F.lit(side).alias("side"))

    def at(side: str, i: int, what: str) -> Column:
        return F.max(F.when((c("side") == side) & (c("rank") == i), c(what)))

    extremes = ends("hi", F.desc("value")).unionByName(ends("lo", F.asc("value"))).groupBy(*scope).agg(
        *[at("hi", i, "value").alias(f"v{i}") for i in (1, 2, 3)], *[at("lo", i, "value").alias(f"b{i}") for i in (1, 2, 3)],
        *[at("hi", i, "label").alias(f"top{i}") for i in (1, 2)], *[at("lo", i, "label").alias(f"low{i}") for i in (1, 2)])
    stats = base.join(extremes, scope)
    for side, value in (("top", "v"), ("low", "b")):
        mean, squares = c("mean"), c("spread") * c("n")
        for i in (1, 2):
            left = F.nullif(c("n") - i, F.lit(0))
            without = (mean * (c("n") - i + 1) - c(f"{value}{i}")) / left
            squares = squares - (c(f"{value}{i}") - mean) * (c(f"{value}{i}") - without)
            mean = without
            # rounding can leave nothing of a small rest beside a huge extreme; the rest is then small, not constant
            rest = F.greatest(squares, F.lit(1e-15) * c("spread") * c("n"))
            stats = stats.withColumns({f"mean_not_{side}{i}": mean, f"sd_not_{side}{i}": F.sqrt(rest / F.nullif(c("n") - i - 1, F.lit(0)))})
    return stats.drop("spread")


def _p_order(p: Column) -> Column:
    """Order of p-values that treats a difference in the last bits as a tie, won by the earlier split."""
    return F.when(p <= 0, F.lit(-1e9)).otherwise(F.round(F.log10(F.when(p > 0, p)), 9))


def temporal_stats(points: DataFrame, scope: list[str], keep: list[str] = (), order: str = "code") -> DataFrame:
    """Ordered-series statistics per scope."""
    whole = Window.partitionBy(*scope)
    ordered = whole.orderBy(order)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    from_here = whole.orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    c = F.col
    series = points.withColumns({
        "n": F.count("value").over(whole),
        "mean": F.avg("value").over(whole),
        "sd": F.stddev_samp("value").over(whole),
        "v_max": F.max("value").over(whole),
        "v_min": F.min("value").over(whole),
        "i": F.row_number().over(ordered) - 1,
        "step": c("value") - F.lag("value").over(ordered),
        "rank": F.rank().over(whole.orderBy("value"))
        + (F.count("value").over(Window.partitionBy(*scope, "value")) - 1) / 2.0,
        "m1": F.avg("value").over(before),
        "s1": F.var_samp("value").over(before),
        "m2": F.avg("value").over(from_here),
        "s2": F.var_samp("value").over(from_here),
        **{f"lag_{k}": F.lag("value", k).over(ordered) for k in SEASON_LAGS},
    })
    series = series.withColumns({
        "i_max": F.min(F.when(c("value") == c("v_max"), c("i"))).over(whole),
        "i_min": F.min(F.when(c("value") == c("v_min"), c("i"))).over(whole),
    })
    series = welch(series)

    def steps(cond: Column) -> Column:
        return F.sum(cond.cast("int"))

    def acf(k: int) -> Column:
        both = F.when(c(f"lag_{k}").isNotNull(), c("value"))
        return F.covar_pop("value", f"lag_{k}") / F.nullif(
            F.stddev_pop(both) * F.stddev_pop(f"lag_{k}"), F.lit(0.0)
        )

    z = (c("value") - c("mean")) / F.nullif(c("sd"), F.lit(0.0))
    far = F.struct(
        c(order), F.concat("label", F.lit(":"), F.when(z > 0, "ABOVE").otherwise("BELOW")).alias("text")
    )
    rho = F.covar_pop("i", "rank") / F.nullif(F.stddev_pop("i") * F.stddev_pop("rank"), F.lit(0.0))
    stats = series.groupBy(*scope).agg(
        *[F.first(k).alias(k) for k in keep],
        F.count("value").alias("n"),
        F.sum((c("value") != 0).cast("int")).alias("nonzero"),
        F.first("v_max").alias("v_max"), F.first("v_min").alias("v_min"),
        F.first("i_max").alias("i_max"), F.first("i_min").alias("i_min"),
        rho.alias("rho"),
        F.collect_list(F.when(F.abs(z) > OUTLIER_Z, far)).alias("far"),
        *[acf(k).alias(f"acf_{k}") for k in SEASON_LAGS],
        F.min_by(F.struct("p", "label"), F.when(c("p") < CHANGE_P, F.struct(_p_order(c("p")).alias("p"), "i"))).alias("split"),
        steps((c("step") > 0) & (c("i") <= c("i_max"))).alias("up_to_max"),
        steps((c("step") < 0) & (c("i") > c("i_max"))).alias("down_from_max"),
        steps((c("step") < 0) & (c("i") <= c("i_min"))).alias("down_to_min"),
        steps((c("step") > 0) & (c("i") > c("i_min"))).alias("up_from_min"),
        F.max(F.when(c("i") == c("i_max"), c("label"))).alias("max_label"),
        F.max(F.when(c("i") == c("i_min"), c("label"))).alias("min_label"),
    )
    slack = (1 - c("rho")) * (1 + c("rho"))
    t = F.abs(c("rho")) * F.sqrt((c("n") - 2) / F.when(slack > 0, slack))
    wanted = (F.round(F.abs(c("rho")), 12) >= TREND_RHO) & (c("n") >= 4)
    p = t_tail(F.when(wanted, t), F.when(wanted, (c("n") - 2).cast("double")))
    return stats.withColumn("rho_p", F.when(wanted & (slack <= 0), F.lit(0.0)).otherwise(p))


def welch(series: DataFrame) -> DataFrame:
    """Welch's test of the points before `i` against the points from `i` on, as t, df, p.

    Two constant sides differ with p = 0 or not at all.
    """
    c = F.col
    n1, n2 = c("i").cast("double"), (c("n") - c("i")).cast("double")
    e1, e2 = c("s1") / F.nullif(n1, F.lit(0.0)), c("s2") / F.nullif(n2, F.lit(0.0))
    inside = (c("i") >= 3) & (c("i") <= c("n") - 3)
    out = series.withColumns({
        "t": F.when(inside & (e1 + e2 > 0), F.abs(c("m1") - c("m2")) / F.sqrt(e1 + e2)),
        "df": F.when(
            inside & (e1 + e2 > 0),
            (e1 + e2) * (e1 + e2)
            / (e1 * e1 / F.nullif(n1 - 1, F.lit(0.0)) + e2 * e2 / F.nullif(n2 - 1, F.lit(0.0))),
        ),
        "flat_shift": inside & (e1 + e2 == 0) & (c("m1") != c("m2")),
    })
    tested = F.col("t") > CHANGE_T_FLOOR
    p = t_tail(F.when(tested, c("t")), F.when(tested, c("df")))
    return out.withColumn("p", F.when(c("flat_shift"), F.lit(0.0)).otherwise(p))


def scope_patterns(points: DataFrame, keys: list[str], config: ViewConfig, order: str = "code",
                   extra_tests: dict[str, dict[str, Callable[[ViewConfig], Column]]] | None = None) -> DataFrame:
    """One row per scope with the array of patterns that hold in it.

    `order` is the column that carries the label order: the code, or the label where codes have no order. `extra_tests` adds
    tests of the user's own under "categorical", "temporal" or "series": a test is a name and a function that gives a column
    with the highlight, or null where the pattern does not hold. The first two see the statistics of `categorical_stats` and
    `temporal_stats`; a "series" test sees `labels` and `values`, the ordered arrays of a temporal scope, and may be a pandas UDF.
    """
    extra = extra_tests or {}
    scope = ["role", *keys, "mid"]
    keep = ["fset", "dim_id", "temporal"]
    out = [*scope, *keep, "n", "nonzero"]
    over_time = points.filter(F.col("temporal"))
    cat = categorical_stats(points.filter(~F.col("temporal")), scope, keep, order)
    tem = temporal_stats(over_time, scope, keep, order)
    hits = hits_column({**TEMPORAL, **extra.get("temporal", {})}, config)
    if extra.get("series"):
        series = over_time.groupBy(*scope).agg(F.array_sort(F.collect_list(F.struct(order, "label", "value"))).alias("s"))
        lists = series.select(*scope, F.transform("s", lambda x: x["label"]).alias("labels"), F.transform("s", lambda x: x["value"]).alias("values"))
        own = lists.select(*scope, hits_column(extra["series"], config).alias("own_hits"))
        tem = tem.join(own, scope)
        hits = F.concat(hits, "own_hits")
    return cat.select(*out, hits_column({**CATEGORICAL, **extra.get("categorical", {})}, config).alias("hits")).unionByName(
        tem.select(*out, hits.alias("hits"))
    )


def requested_verdict(requested: str) -> Column:
    """For a scope with its hits: the requested pattern, another one, or none."""
    return F.when(F.exists("hits", lambda h: h["type"] == requested), requested).when(
        F.size("hits") > 0, "OTHER_PATTERN").otherwise("NO_PATTERN")
