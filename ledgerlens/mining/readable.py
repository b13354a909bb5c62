"""Stages of a mining run with names and values in place of codes."""

from __future__ import annotations

from itertools import accumulate
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.mining.cube import Cube, domain_side
from ledgerlens.session import inline_table


def name_filters(cube: Cube, df: DataFrame, set_column: str = "fset") -> DataFrame:
    """Add filter1_dim, filter1_value, filter2_dim, filter2_value ('' where unused)."""
    layout, spark = cube.layout, cube.cells.sparkSession
    depth = max(2, cube.config.max_subspace_depth)
    rows = []
    for i, filters in enumerate(layout.filter_sets):
        row = [i]
        for j in range(depth):
            if j < len(filters):
                row += [layout.dim_id(filters[j]), filters[j], *layout.slots[filters[j]]]
            else:
                row += [-1, "", 0, 0, 1]
        rows.append(tuple(row))
    schema = f"{set_column} int, " + ", ".join(
        f"d{j} int, filter{j}_dim string, w{j} int, sh{j} int, bt{j} int" for j in range(1, depth + 1)
    )
    out = df.join(F.broadcast(inline_table(spark, rows, schema)), set_column)
    for j in range(1, depth + 1):
        side = domain_side(cube).select(
            F.col("dim_id").alias(f"d{j}"), F.col("code").alias(f"c{j}"), F.col("label").alias(f"filter{j}_value")
        )
        out = out.withColumn(f"c{j}", layout.code_of(F.col(f"w{j}"), F.col(f"sh{j}"), F.col(f"bt{j}"))).join(
            side, [f"d{j}", f"c{j}"], "left"
        ).withColumn(f"filter{j}_value", F.coalesce(f"filter{j}_value", F.lit("")))
    return out.drop(*[f"{p}{j}" for j in range(1, depth + 1) for p in ("d", "c", "w", "sh", "bt")])


def name_scope(cube: Cube, df: DataFrame) -> DataFrame:
    """Add breakdown and measure names to rows with dim_id and mid."""
    dims = F.array(*[F.lit(d) for d in cube.config.all_dims])
    measures = F.array(*[F.lit(m.name) for m in cube.config.measures])
    return df.withColumns({
        "breakdown": F.get(dims, F.col("dim_id")), "measure": F.get(measures, F.col("mid")),
    })


FILTERS = ["filter1_dim", "filter1_value", "filter2_dim", "filter2_value"]


def readable_points(cube: Cube, points: DataFrame) -> DataFrame:
    """`total` is the sum behind the value, for averages too."""
    means = [m.name for m in cube.config.measures if m.agg == "avg"]
    total = F.when(F.col("measure").isin(*means), F.col("value") * F.col("n_rows")).otherwise(F.col("value"))
    return name_scope(cube, name_filters(cube, points)).select(
        *FILTERS, "breakdown", "label", "measure", F.round(total, 2).alias("total"), "n_rows"
    )


def readable_hits(cube: Cube, scopes: DataFrame, explode: bool = True) -> DataFrame:
    named = name_scope(cube, name_filters(cube, scopes))
    if not explode:
        return named
    return named.withColumn("h", F.explode("hits")).select(
        *FILTERS, "breakdown", "measure", F.col("h.type").alias("type"), F.col("h.highlight").alias("highlight")
    )


def readable_shares(cube: Cube, shares: DataFrame) -> DataFrame:
    return name_filters(cube, shares).select(
        *FILTERS,
        *[F.round(f"i_{j}", 6).alias(f"impact_{m}") for j, m in enumerate(cube.config.impact_measures)],
        F.round("max_share", 6).alias("max_impact"),
    )


def name_groups(cube: Cube, groups: DataFrame) -> DataFrame:
    """Names for subspace sibling groups keyed by (group_role, ext_id, group_mid)."""
    layout = cube.layout
    roles = inline_table(
        cube.cells.sparkSession,
        [(i, fset, layout.dim_id(b)) for i, (fset, b) in enumerate(layout.roles)],
        "group_role int, fset int, dim_id int",
    )
    dims = F.array(*[F.lit(d) for d in cube.config.all_dims])
    named = name_filters(cube, groups.join(F.broadcast(roles), "group_role"))
    return name_scope(cube, named.withColumn("mid", F.col("group_mid"))).withColumn(
        "extending_dimension", F.get(dims, F.col("ext_id"))
    )


def set_sizes(cube: Cube) -> list[int]:
    """Slices of each filter set: the product of its domains."""
    return [prod(cube.layout.sizes[d] for d in filters) for filters in cube.layout.filter_sets]


def _branch(at: Column, starts: list[int], low: int, high: int) -> Column:
    """The last of `starts[low:high]` that is not after `at`, by halving."""
    if high - low == 1:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(at < starts[middle], _branch(at, starts, low, middle)).otherwise(_branch(at, starts, middle, high))


def unranked(cube: Cube, others: list[int] | None = None) -> DataFrame:
    """fset, c1, c2 .. (0 where unused) and `other` of every slice, computed from its number.

    Slices of a filter set are counted off in mixed radix over the codes of its dimensions, sets follow each other, and
    `others[fset]` numbers one more digit. So the set is a range of known length, dealt out evenly, and no domain is joined
    with a domain.
    """
    layout, spark = cube.layout, cube.cells.sparkSession
    others = others or [1] * len(layout.filter_sets)
    sizes = [n * k for n, k in zip(set_sizes(cube), others)]
    full = [i for i, n in enumerate(sizes) if n]
    if not full:
        full, sizes = [0], [0] * len(sizes)
    ends = list(accumulate(sizes[i] for i in full))
    starts = [0, *ends[:-1]]
    depth = max(2, cube.config.max_subspace_depth)
    digits = [[others[i], *[layout.sizes[d] for d in layout.filter_sets[i]], *[1] * depth][: depth + 1] for i in full]

    def of_set(values: list[int]) -> Column:
        return F.get(F.array(*[F.lit(v).cast("long") for v in values]), F.col("at"))

    out = spark.range(ends[-1]).withColumn("at", _branch(F.col("id"), starts, 0, len(full))).withColumn("rest", F.col("id") - of_set(starts))
    for j in range(depth + 1):
        radix = of_set([d[j] for d in digits])
        used = of_set([1 if j == 0 or j <= len(layout.filter_sets[i]) else 0 for i in full])
        digit = F.pmod("rest", radix)
        out = out.withColumn("other" if j == 0 else f"c{j}", (digit if j == 0 else F.when(used > 0, digit + 1).otherwise(0)).cast("int"))
        out = out.withColumn("rest", F.call_function("div", F.col("rest"), radix))
    return out.withColumn("fset", of_set(full).cast("int")).drop("id", "at", "rest")


def _labelled(cube: Cube, slices: DataFrame) -> DataFrame:
    """Dimension names and labels of unranked slices; a code meets one row of its domain."""
    layout, spark = cube.layout, cube.cells.sparkSession
    rows = [(i, *[x for j in (0, 1) for x in ((layout.dim_id(f[j]), f[j]) if j < len(f) else (-1, ""))]) for i, f in enumerate(layout.filter_sets)]
    out = slices.join(F.broadcast(inline_table(spark, rows, "fset int, d1 int, filter1_dim string, d2 int, filter2_dim string")), "fset")
    for j in (1, 2):
        side = domain_side(cube).select(F.col("dim_id").alias(f"d{j}"), F.col("code").alias(f"c{j}"), F.col("label").alias(f"filter{j}_value"))
        out = out.join(side, [f"d{j}", f"c{j}"], "left").withColumn(f"filter{j}_value", F.coalesce(f"filter{j}_value", F.lit("")))
    return out


def subspaces(cube: Cube) -> DataFrame:
    """Every slice up to the configured depth, present in the data or not."""
    return _labelled(cube, unranked(cube)).select(*FILTERS)


def scopes_of_sets(cube: Cube) -> list[list[tuple[str, str]]]:
    """(breakdown, measure) pairs that the slices of each filter set may be asked for."""
    config = cube.config
    return [[(b, config.measures[i].name) for b in config.all_dims if b not in filters for i in config.measures_for(b)]
            for filters in cube.layout.filter_sets]


def scope_count(cube: Cube) -> int:
    return sum(n * len(s) for n, s in zip(set_sizes(cube), scopes_of_sets(cube)))


def scope_list(cube: Cube) -> DataFrame:
    """Every (slice, breakdown, measure) that may be queried."""
    scopes = scopes_of_sets(cube)
    rows = [(i, k, *pair) for i, pairs in enumerate(scopes) for k, pair in enumerate(pairs)]
    names = inline_table(cube.cells.sparkSession, rows, "fset int, other int, breakdown string, measure string")
    # one row for each set, breakdown and measure of the configuration
    numbered = unranked(cube, [len(s) for s in scopes]).join(F.broadcast(names), ["fset", "other"])
    return _labelled(cube, numbered).select(*FILTERS, "breakdown", "measure")
