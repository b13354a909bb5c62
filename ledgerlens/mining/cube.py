"""The slice cube: every (filters, breakdown) cell of a view in one aggregation.

Every dimension value gets a small integer code, and the codes of one row are packed into
one or more longs. A cell of the cube is then `packed & mask`, so a row serves a grouping set
by one bit operation, and the shuffle carries (set, long, sums) after the map-side combine
instead of one wide string key per grouping set. Rows are first aggregated to a few wide sets,
and the many narrow sets are read from those cells.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.mining.config import ViewConfig
from ledgerlens.session import cut_lineage, inline_table

WORD_BITS = 62
# a wide set may have at most one cell per this many rows, so aggregating it shrinks the rows
CELLS_PER_ROW_SHARE = 16
DOMAIN_BUCKETS = 256


@dataclass(frozen=True)
class Layout:
    """Where each dimension's code sits in the packed words, and which sets are aggregated."""

    config: ViewConfig
    sizes: dict[str, int]

    @property
    def ordered_codes(self) -> bool:
        """Codes follow the label order while every domain is small enough to be sorted in one task."""
        return max(self.sizes.values(), default=0) <= self.config.broadcast_domain_limit

    @cached_property
    def slots(self) -> dict[str, tuple[int, int, int]]:
        """dim -> (word, shift, bits); code 0 is kept for null."""
        out, word, used = {}, 0, 0
        for dim in self.config.all_dims:
            bits = max(1, self.sizes.get(dim, 0).bit_length())
            if used + bits > WORD_BITS:
                word, used = word + 1, 0
            out[dim] = (word, used, bits)
            used += bits
        return out

    @property
    def words(self) -> int:
        return 1 + max(slot[0] for slot in self.slots.values())

    @property
    def keys(self) -> list[str]:
        return [f"k{w}" for w in range(self.words)]

    @cached_property
    def filter_sets(self) -> list[tuple[str, ...]]:
        dims = self.config.dimensions
        return [c for k in range(self.config.max_subspace_depth + 1) for c in combinations(dims, k)]

    @cached_property
    def roles(self) -> list[tuple[int, str]]:
        """(filter set id, breakdown) pairs; the position is the role id."""
        return [
            (i, b)
            for i, filters in enumerate(self.filter_sets)
            for b in self.config.all_dims
            if b not in filters
        ]

    @cached_property
    def role_ids(self) -> dict[tuple[int, str], int]:
        return {role: i for i, role in enumerate(self.roles)}

    @cached_property
    def filter_set_ids(self) -> dict[frozenset, int]:
        return {frozenset(f): i for i, f in enumerate(self.filter_sets)}

    @cached_property
    def grouping_sets(self) -> dict[frozenset, int]:
        wanted = [frozenset(f) for f in self.filter_sets]
        wanted += [frozenset(self.filter_sets[i]) | {b} for i, b in self.roles]
        return {dims: i for i, dims in enumerate(dict.fromkeys(wanted))}

    def mask(self, dims) -> list[int]:
        out = [0] * self.words
        for dim in dims:
            word, shift, bits = self.slots[dim]
            out[word] |= ((1 << bits) - 1) << shift
        return out

    def dim_id(self, dim: str) -> int:
        return self.config.all_dims.index(dim)

    def code_of(self, word: Column, shift: Column, bits: Column) -> Column:
        """The code stored at a slot given as columns."""
        held = F.element_at(F.array(*[F.col(k) for k in self.keys]), word + 1)
        return F.call_function("shiftright", held, shift).bitwiseAND(
            F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        ).cast("int")


@dataclass
class Cube:
    """Aggregated cells plus the value domains that decode them."""

    layout: Layout
    cells: DataFrame      # set_id, k*, sum_of_<column>, rows_of_<column>
    domain: DataFrame     # dim_id, code, label

    @property
    def config(self) -> ViewConfig:
        return self.layout.config


def aggregate_columns(config: ViewConfig) -> list[str]:
    return [f"{kind}_of_{c}" for c in config.value_columns for kind in ("sum", "rows")]


def finest_grain(view: DataFrame, config: ViewConfig) -> DataFrame:
    """One row per combination of dimension values, with sums and counts of every column.

    The map-side combine makes this the only pass over the raw rows; everything after it
    works on at most as many rows as there are combinations.
    """
    aggs = []
    for c in config.value_columns:
        value = F.col(c).cast("double")
        aggs += [F.sum(value).alias(f"sum_of_{c}"), F.count(value).alias(f"rows_of_{c}")]
    dims = [F.col(d).cast("string").alias(d) for d in config.all_dims]
    return view.groupBy(*dims).agg(*aggs)


def distinct_values(base: DataFrame, config: ViewConfig) -> DataFrame:
    """Non-null values of each dimension."""
    pairs = base.select(
        F.explode(
            F.array(*[
                F.struct(F.lit(i).alias("dim_id"), F.col(d).alias("label"))
                for i, d in enumerate(config.all_dims)
            ])
        ).alias("p")
    ).select("p.*")
    return pairs.filter(F.col("label").isNotNull()).distinct()


def coded_in_order(values: DataFrame) -> DataFrame:
    """Codes 1.. in label order; one task sorts one dimension, so for domains of checked size."""
    by_label = Window.partitionBy("dim_id").orderBy("label")
    return values.withColumn("code", F.row_number().over(by_label))


def coded_in_buckets(values: DataFrame) -> DataFrame:
    """Dense codes for domains of any size, in no order: numbered within hash buckets, plus the bucket's offset."""
    bucketed = values.withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(DOMAIN_BUCKETS)).cast("int"))
    sizes = bucketed.groupBy("dim_id", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("dim_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("dim_id", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    within = Window.partitionBy("dim_id", "bucket").orderBy("label")
    numbered = bucketed.withColumn("rn", F.row_number().over(within))
    return numbered.join(F.broadcast(offsets), ["dim_id", "bucket"]).select(
        "dim_id", "label", (F.col("skip") + F.col("rn")).cast("int").alias("code"))


def pack(base: DataFrame, domain: DataFrame, layout: Layout) -> DataFrame:
    """Replace the dimension columns by the packed code words."""
    config = layout.config
    packed = base
    for i, dim in enumerate(config.all_dims):
        codes = domain.filter(F.col("dim_id") == i).select(
            F.col("label").alias(f"l_{i}"), F.col("code").alias(f"c_{i}")
        )
        if layout.sizes.get(dim, 0) <= config.broadcast_domain_limit:
            codes = F.broadcast(codes)
        packed = packed.join(codes, packed[dim] == F.col(f"l_{i}"), "left")
    words = []
    for w in range(layout.words):
        parts = [
            F.shiftleft(F.coalesce(F.col(f"c_{i}"), F.lit(0)).cast("long"), layout.slots[dim][1])
            for i, dim in enumerate(config.all_dims)
            if layout.slots[dim][0] == w
        ]
        words.append(reduce(lambda a, b: a + b, parts).alias(f"w{w}"))
    return packed.select(*words, *aggregate_columns(config))


def build_cube(view: DataFrame, config: ViewConfig) -> Cube:
    """Aggregate every grouping set that a scope of depth <= max_subspace_depth needs."""
    # each stage is a table in the shared folder: plans stay short and a lost executor costs one stage
    base = cut_lineage(finest_grain(view, config), "base")
    values = cut_lineage(distinct_values(base, config), "values")
    # one row per dimension reaches the driver
    found = {r["dim_id"]: r["n"] for r in values.groupBy("dim_id").agg(F.count("*").alias("n")).collect()}
    sizes = {d: found.get(i, 0) for i, d in enumerate(config.all_dims)}
    layout = Layout(config, sizes)
    coded = coded_in_order(values) if layout.ordered_codes else coded_in_buckets(values)
    domain = cut_lineage(coded, "domain")

    rows = base.count()
    wide = cover(layout, rows // CELLS_PER_ROW_SHARE)
    partial = _aggregate(pack(base, domain, layout), layout, {s: i for i, s in enumerate(wide)}, "wide_id")
    cells = _narrow(partial, layout, wide)
    return Cube(layout, cut_lineage(_drop_null_codes(cells, layout), "cells"), domain)


def cover(layout: Layout, budget: int) -> dict[frozenset, list[frozenset]]:
    """Wider sets of at most `budget` cells that contain the grouping sets: wide set -> sets taken from it.

    Rows are aggregated once per wide set, and the grouping sets are then aggregated from the wide
    sets' cells. The more rows there are, the wider the sets and the fewer passes a row takes part
    in. A grouping set with more cells than the budget stands for itself.
    """
    size = {d: layout.sizes.get(d, 0) + 1 for d in layout.config.all_dims}

    def cells(dims) -> int:
        return reduce(lambda n, d: n * size[d], dims, 1)

    left = sorted(layout.grouping_sets, key=lambda s: (-cells(s), sorted(s)))
    out: dict[frozenset, list[frozenset]] = {}
    while left:
        wide = left[0]
        while True:
            fits = [d for d in layout.config.all_dims if d not in wide and cells(wide) * size[d] <= budget]
            if not fits:
                break
            gain = {d: sum(s <= wide | {d} for s in left) for d in fits}
            wide = wide | {max(fits, key=lambda d: (gain[d] / size[d], d))}
        out[wide] = [s for s in left if s <= wide]
        left = [s for s in left if not s <= wide]
    return out


def _set_masks(layout: Layout, sets: dict[frozenset, int]) -> list[Column]:
    return [
        F.struct(
            F.lit(i).alias("id"),
            *[F.lit(m).cast("long").alias(f"m{w}") for w, m in enumerate(layout.mask(dims))],
        )
        for dims, i in sets.items()
    ]


def _aggregate(packed: DataFrame, layout: Layout, sets: dict[frozenset, int], name: str) -> DataFrame:
    """Sums of every set over the packed rows, combined on the map side before the shuffle."""
    sums = aggregate_columns(layout.config)
    spread = packed.withColumn("g", F.explode(F.array(*_set_masks(layout, sets)))).select(
        F.col("g.id").alias(name),
        *[F.col(f"w{w}").bitwiseAND(F.col(f"g.m{w}")).alias(k) for w, k in enumerate(layout.keys)],
        *sums,
    )
    return spread.groupBy(name, *layout.keys).agg(*[F.sum(c).alias(c) for c in sums])


def _narrow(partial: DataFrame, layout: Layout, wide: dict[frozenset, list[frozenset]]) -> DataFrame:
    """Aggregate each grouping set from the cells of its wide set."""
    sums = aggregate_columns(layout.config)
    rows = [
        (i, layout.grouping_sets[s], *layout.mask(s)) for i, sets in enumerate(wide.values()) for s in sets
    ]
    schema = "wide_id int, set_id int, " + ", ".join(f"m{w} long" for w in range(layout.words))
    taken = inline_table(partial.sparkSession, rows, schema)
    spread = partial.join(F.broadcast(taken), "wide_id").select(
        "set_id", *[F.col(k).bitwiseAND(F.col(f"m{w}")).alias(k) for w, k in enumerate(layout.keys)], *sums)
    return spread.groupBy("set_id", *layout.keys).agg(*[F.sum(c).alias(c) for c in sums])


def _drop_null_codes(cells: DataFrame, layout: Layout) -> DataFrame:
    """A null breakdown or filter value is no cell."""
    spark = cells.sparkSession
    rows = [
        (i, [tuple(layout.slots[d]) for d in sorted(dims)]) for dims, i in layout.grouping_sets.items()
    ]
    slots = inline_table(spark, rows, "set_id int, slots array<struct<word:int,shift:int,bits:int>>")
    full = F.forall("slots", lambda s: layout.code_of(s["word"], s["shift"], s["bits"]) != 0)
    return cells.join(F.broadcast(slots), "set_id").filter(full).drop("slots")


def role_table(cube: Cube) -> DataFrame:
    """One row per role: the set that holds its cells and how to read label and filters."""
    layout, spark = cube.layout, cube.cells.sparkSession
    rows = []
    for role_id, (fset, breakdown) in enumerate(layout.roles):
        filters = layout.filter_sets[fset]
        word, shift, bits = layout.slots[breakdown]
        rows.append((
            layout.grouping_sets[frozenset(filters) | {breakdown}], role_id, fset,
            layout.dim_id(breakdown), layout.config.is_temporal(breakdown),
            word, shift, bits, *layout.mask(filters),
        ))
    schema = (
        "set_id int, role int, fset int, dim_id int, temporal boolean, word int, shift int, bits int, "
        + ", ".join(f"f{w} long" for w in range(layout.words))
    )
    return inline_table(spark, rows, schema)


def settled(value: Column, digits: int = 12) -> Column:
    """The value to 12 significant digits, so the order in which doubles were added decides no tie."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(value))))
    return F.when(value == 0, F.lit(0.0)).otherwise(F.rint(value * scale) / scale)


def points(cube: Cube, as_sums: bool = False) -> DataFrame:
    """Every distribution point: role, slice key, measure id, label code, label, value.

    With `as_sums` the averaged measures are read as sums of their column too.
    """
    layout, config = cube.layout, cube.config
    read = cube.cells.join(F.broadcast(role_table(cube)), "set_id")
    code = layout.code_of(F.col("word"), F.col("shift"), F.col("bits"))
    by_measure = F.array(*[
        F.struct(
            F.lit(i).alias("mid"),
            settled(F.col(f"sum_of_{m.source}") / F.nullif(F.col(f"rows_of_{m.source}"), F.lit(0))
                    if m.agg == "avg" and not as_sums
                    else F.coalesce(F.col(f"sum_of_{m.source}"), F.lit(0.0))).alias("value"),
            F.col(f"rows_of_{m.source}").alias("n_rows"),
        )
        for i, m in enumerate(config.measures)
    ])
    long = read.select(
        "role", "fset", "dim_id", "temporal",
        *[F.col(k).bitwiseAND(F.col(f"f{w}")).alias(k) for w, k in enumerate(layout.keys)],
        code.alias("code"), F.explode(by_measure).alias("v"),
    ).select("role", "fset", "dim_id", "temporal", *layout.keys, "code", "v.*")
    excluded = [
        (layout.dim_id(b), i)
        for i, m in enumerate(config.measures)
        for b in config.all_dims
        if (m.name, b) in config.excluded_pairs
    ]
    if excluded:
        pairs = inline_table(cube.cells.sparkSession, excluded, "dim_id int, mid int")
        long = long.join(F.broadcast(pairs), ["dim_id", "mid"], "left_anti")
    return long.join(domain_side(cube), ["dim_id", "code"]).filter(F.col("value").isNotNull())


def domain_side(cube: Cube) -> DataFrame:
    """The domain as a join side: broadcast while its counted size stays small."""
    domain = cube.domain.select("dim_id", "code", "label")
    if sum(cube.layout.sizes.values()) <= cube.config.broadcast_domain_limit:
        return F.broadcast(domain)
    return domain


def slice_shares(cube: Cube) -> DataFrame:
    """Share of each impact measure's grand total held by every slice (0 if the total is not positive)."""
    layout, config = cube.layout, cube.config
    spark = cube.cells.sparkSession
    sets = inline_table(spark, 
        [(layout.grouping_sets[frozenset(f)], i) for i, f in enumerate(layout.filter_sets)],
        "set_id int, fset int",
    )
    slices = cube.cells.join(F.broadcast(sets), "set_id")
    # the depth-0 slice is one row
    whole = slices.filter(F.col("fset") == 0).select(*[f"sum_of_{m}" for m in config.impact_measures]).first()
    totals = [(whole[j] or 0.0) if whole else 0.0 for j in range(len(config.impact_measures))]
    shares = [
        (F.round(F.coalesce(F.col(f"sum_of_{m}"), F.lit(0.0)) / F.lit(totals[j]), 12) if totals[j] > 0 else F.lit(0.0))
        .alias(f"i_{j}")
        for j, m in enumerate(config.impact_measures)
    ]
    out = slices.select("fset", *layout.keys, *shares)
    best = [F.col(f"i_{j}") for j in range(len(shares))]
    return out.withColumn("max_share", F.greatest(*best) if len(best) > 1 else best[0])
