"""Sibling sets: what most members share, which ones break it, and the score of that."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.mining.config import TEMPORAL_TYPES, ViewConfig
from ledgerlens.mining.cube import Cube, domain_side
from ledgerlens.session import inline_table

EXCEPTION_KINDS = 3
GAMMA = 0.5
VARIES = "(varies)"
GROUP = ["strategy", "group_role", "ext_id", "group_mid"]


def entropy_bound(tau: float, kinds: int = EXCEPTION_KINDS, r: float = 1.0) -> float:
    """Largest entropy a finding can have at this tau."""
    tau_r = tau ** (1.0 / r)
    if kinds < (1 - tau) * math.e / tau_r:
        return -math.log2(tau) + r * (kinds * tau_r / math.e) * math.log2(math.e / (kinds * tau_r))
    return -tau * math.log2(tau) - r * (1 - tau) * math.log2((1 - tau) / kinds)


def _entropy(p: Column) -> Column:
    return F.when(p > 0, -p * F.log2(p)).otherwise(F.lit(0.0))


def conciseness(common_entropy: Column, counts: list[Column], size: Column, tau: float, gamma) -> Column:
    """1 - (entropy + gamma when there are no exceptions) / bound, not below 0."""
    bound = entropy_bound(tau)
    entropy = common_entropy
    for k in counts:
        entropy = entropy + _entropy(k / size)
    none = sum(counts[1:], counts[0]) == 0
    gamma = gamma if isinstance(gamma, Column) else F.lit(float(gamma))
    if bound <= 0:
        return F.lit(1.0)
    return F.greatest(F.lit(0.0), 1 - (entropy + F.when(none, gamma).otherwise(F.lit(0.0))) / bound)


def _extension_tables(cube: Cube) -> tuple[DataFrame, DataFrame]:
    """(role, filter) -> parent role and (filter set, filter) -> parent set, with the domain size."""
    layout, config = cube.layout, cube.config
    spark = cube.cells.sparkSession
    role_rows, set_rows = [], []
    for fset, filters in enumerate(layout.filter_sets):
        for dim in filters:
            rest = tuple(d for d in filters if d != dim)
            parent = layout.filter_set_ids[frozenset(rest)]
            size = layout.sizes[dim]
            if size < config.min_hdp_size:
                continue
            word, shift, bits = layout.slots[dim]
            tail = (layout.dim_id(dim), size, word, shift, bits, *layout.mask(rest))
            set_rows.append((fset, parent, *tail))
            for b in config.all_dims:
                if b not in filters:
                    role_rows.append((layout.role_ids[(fset, b)], layout.role_ids[(parent, b)], *tail))
    tail = "ext_id int, size int, word int, shift int, bits int, " + ", ".join(
        f"f{w} long" for w in range(layout.words)
    )
    return (
        inline_table(spark, role_rows, f"role int, group_role int, {tail}"),
        inline_table(spark, set_rows, f"fset int, parent int, {tail}"),
    )


def memberships(cube: Cube, scopes: DataFrame) -> DataFrame:
    """Every (sibling set, member scope) row for scopes that hold any pattern."""
    layout, config = cube.layout, cube.config
    spark = cube.cells.sparkSession
    keys = layout.keys
    found = scopes.filter(F.size("hits") > 0)
    info = ["hits", "seed", "supported", "nonzero"]
    ext, _ = _extension_tables(cube)
    parts = [
        found.join(F.broadcast(ext), "role").select(
            F.lit("subspace").alias("strategy"), "group_role",
            *[F.col(k).bitwiseAND(F.col(f"f{w}")).alias(k) for w, k in enumerate(keys)],
            "ext_id", F.col("mid").alias("group_mid"), "size",
            layout.code_of(F.col("word"), F.col("shift"), F.col("bits")).alias("member"), *info,
        )
    ]
    measure_roles = [
        (i, len(config.measures_for(b)))
        for i, (_, b) in enumerate(layout.roles)
        if len(config.measures_for(b)) >= config.min_hdp_size
    ]
    if measure_roles:
        roles = inline_table(spark, measure_roles, "role int, size int")
        parts.append(found.join(F.broadcast(roles), "role").select(
            F.lit("measure").alias("strategy"), F.col("role").alias("group_role"), *keys,
            F.lit(-1).alias("ext_id"), F.lit(-1).alias("group_mid"), "size",
            F.col("mid").alias("member"), *info,
        ))
    grains = {
        m: sum((config.measures[m].name, t) not in config.excluded_pairs for t in config.temporal_dimensions)
        for m in range(len(config.measures))
    }
    grain_rows = [(m, n) for m, n in grains.items() if n >= config.min_hdp_size]
    if grain_rows:
        sizes = inline_table(spark, grain_rows, "mid int, size int")
        parts.append(found.filter("temporal").join(F.broadcast(sizes), "mid").select(
            F.lit("breakdown").alias("strategy"), F.col("fset").alias("group_role"), *keys,
            F.lit(-1).alias("ext_id"), F.col("mid").alias("group_mid"), "size",
            F.col("dim_id").alias("member"), *info,
        ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_seed_and_support(cube: Cube, scopes: DataFrame, shares: DataFrame) -> DataFrame:
    """Flag scopes whose slice clears the impact prune, and series with enough non-zero points."""
    config = cube.config
    keys = cube.layout.keys
    marked = scopes.join(shares.select("fset", *keys, "max_share"), ["fset", *keys])
    return marked.withColumns({
        "seed": F.col("max_share") >= config.min_impact,
        "supported": (F.col("nonzero") >= config.min_temporal_nonzero)
        & (F.col("nonzero") >= config.min_temporal_nonzero_frac * F.col("n")),
    }).drop("max_share")


def sibling_groups(cube: Cube, scopes: DataFrame, members: DataFrame) -> DataFrame:
    """Sibling sets with at least one commonness set, reached from a seed, with exception counts."""
    config = cube.config
    keys = cube.layout.keys
    group = [*GROUP, *keys]
    tau = config.tau
    any_hit = members.groupBy(*group).agg(F.count("*").alias("n_any"))
    hits = members.withColumn("h", F.explode("hits")).select(
        *group, "size", "member", "seed", "supported", "nonzero",
        F.col("h.type").alias("type"), F.col("h.highlight").alias("highlight"),
    )
    by_highlight = hits.groupBy(*group, "size", "type", "highlight").agg(
        F.count("*").alias("cnt"), F.max("seed").alias("seed"),
        F.sum(F.col("supported").cast("int")).alias("n_supported"),
        F.min("nonzero").alias("nonzero_min"), F.max("nonzero").alias("nonzero_max"),
    )
    common = F.col("cnt") / F.col("size") > tau
    share = F.round(F.col("cnt") / F.col("size"), 4)
    by_type = by_highlight.groupBy(*group, "size", "type").agg(
        F.sum("cnt").alias("n_type"), F.max("seed").alias("seed"),
        F.sum(F.when(common, F.col("cnt"))).alias("n_common"),
        F.sum(F.when(common, _entropy(share))).alias("common_entropy"),
        F.collect_list(F.when(common, F.struct(
            "cnt", "highlight", share.alias("share"), "n_supported", "nonzero_min", "nonzero_max",
        ))).alias("commonness"),
    ).filter(F.col("n_common") > 0)
    # the base slice is no member of its own subspace set but may be what led to it
    base = scopes.filter("seed").withColumn("h", F.explode("hits")).select(
        F.col("role").alias("group_role"), *keys, F.col("mid").alias("group_mid"),
        F.col("h.type").alias("type"), F.lit(True).alias("base_seed"),
    ).withColumn("strategy", F.lit("subspace"))
    out = by_type.join(any_hit, group).join(
        base, ["strategy", "group_role", *keys, "group_mid", "type"], "left"
    )
    return out.filter(F.col("seed") | F.coalesce("base_seed", F.lit(False))).withColumns({
        "n_highlight_change": F.col("n_type") - F.col("n_common"),
        "n_type_change": F.col("n_any") - F.col("n_type"),
        "n_no_pattern": F.col("size") - F.col("n_any"),
    }).drop("seed", "base_seed")


def group_impact(cube: Cube, groups: DataFrame, shares: DataFrame) -> DataFrame:
    """Impact of each sibling set: member shares added up to at most 1, or the base slice's share."""
    layout, config = cube.layout, cube.config
    keys = layout.keys
    measures = range(len(config.impact_measures))
    _, ext = _extension_tables(cube)
    spread = shares.join(F.broadcast(ext), "fset").select(
        F.col("parent").alias("group_fset"), "ext_id",
        *[F.col(k).bitwiseAND(F.col(f"f{w}")).alias(k) for w, k in enumerate(keys)],
        *[F.col(f"i_{j}") for j in measures],
    ).groupBy("group_fset", "ext_id", *keys).agg(
        *[F.least(F.lit(1.0), F.sum(f"i_{j}")).alias(f"i_{j}") for j in measures]
    )
    own = shares.select(
        F.col("fset").alias("group_fset"), F.lit(-1).alias("ext_id"), *keys, *[F.col(f"i_{j}") for j in measures]
    )
    role_sets = inline_table(cube.cells.sparkSession, 
        [(i, fset) for i, (fset, _) in enumerate(layout.roles)], "group_role int, fset int"
    )
    located = groups.join(F.broadcast(role_sets), "group_role", "left").withColumn(
        "group_fset", F.when(F.col("strategy") == "breakdown", F.col("group_role")).otherwise(F.col("fset"))
    ).drop("fset")
    out = located.join(spread.unionByName(own), ["group_fset", "ext_id", *keys])
    # equal shares may differ in the last bits of the sums; the first measure wins a tie
    out = out.withColumns({f"i_{j}": F.round(f"i_{j}", 12) for j in measures})
    best = F.greatest(F.lit(0.0), *[F.col(f"i_{j}") for j in measures])
    name = F.coalesce(
        *[F.when((F.col(f"i_{j}") == best) & (best > 0), F.lit(m)) for j, m in enumerate(config.impact_measures)],
        F.lit(config.impact_measures[0]),
    )
    return out.withColumns({"impact": best, "impact_measure": name}).drop(*[f"i_{j}" for j in measures])


def findings(cube: Cube, scopes: DataFrame, members: DataFrame, shares: DataFrame) -> DataFrame:
    """Scored findings, decoded to names. `low_support` rows belong to the data-quality list."""
    layout, config = cube.layout, cube.config
    scored = group_impact(cube, sibling_groups(cube, scopes, members), shares)
    size = F.col("size").cast("double")
    counts = [F.col("n_highlight_change"), F.col("n_type_change"), F.col("n_no_pattern")]
    scored = scored.withColumn(
        "conciseness", conciseness(F.col("common_entropy"), counts, size, config.tau, GAMMA)
    ).withColumn("score", F.col("conciseness") * F.col("impact")).filter(F.col("score") > 0)
    top = F.element_at(
        F.array_sort(
            "commonness",
            lambda a, b: F.when(a["cnt"] != b["cnt"], b["cnt"].cast("int") - a["cnt"].cast("int"))
            .when(a["highlight"] < b["highlight"], -1).when(a["highlight"] > b["highlight"], 1).otherwise(0),
        ), 1)
    scored = scored.withColumn("top", top).withColumn(
        "low_support",
        F.col("type").isin(*TEMPORAL_TYPES) & (F.col("top.n_supported") / size <= config.tau),
    )
    return decode(cube, scored)


def decode(cube: Cube, scored: DataFrame) -> DataFrame:
    """Turn role ids, codes and measure ids into names and values."""
    layout, config = cube.layout, cube.config
    spark = cube.cells.sparkSession
    dims, measures = config.all_dims, config.measures
    sets = []
    for i, filters in enumerate(layout.filter_sets):
        slots = [(layout.dim_id(d), *layout.slots[d]) for d in filters]
        sets.append((i, slots))
    slots = inline_table(spark, 
        sets, "group_fset int, filters array<struct<dim_id:int,word:int,shift:int,bits:int>>"
    )
    role_dims = inline_table(spark, 
        [(i, layout.dim_id(b)) for i, (_, b) in enumerate(layout.roles)], "group_role int, b_id int"
    )
    dim_name = F.array(*[F.lit(d) for d in dims])
    measure_name = F.array(*[F.lit(m.name) for m in measures])
    out = scored.join(F.broadcast(slots), "group_fset").join(F.broadcast(role_dims), "group_role", "left")
    codes = F.transform("filters", lambda s: F.struct(
        s["dim_id"].alias("dim_id"), layout.code_of(s["word"], s["shift"], s["bits"]).alias("code")
    ))
    out = out.withColumn("codes", codes).drop("filters")
    for i in range(1, config.max_subspace_depth + 1):
        side = domain_side(cube).select(
            F.col("dim_id").alias(f"d{i}"), F.col("code").alias(f"e{i}"), F.col("label").alias(f"filter{i}_value")
        )
        out = out.withColumns({
            f"d{i}": F.get("codes", F.lit(i - 1))["dim_id"], f"e{i}": F.get("codes", F.lit(i - 1))["code"],
        }).join(side, [f"d{i}", f"e{i}"], "left").withColumn(
            f"filter{i}_dim", F.get(dim_name, F.col(f"d{i}"))
        )
    filters = [c for i in range(1, config.max_subspace_depth + 1) for c in (f"filter{i}_dim", f"filter{i}_value")]
    extending = (
        F.when(F.col("strategy") == "subspace", F.get(dim_name, F.col("ext_id")))
        .when(F.col("strategy") == "measure", F.lit("measure")).otherwise(F.lit("temporal_grain"))
    )
    return out.select(
        F.lit(config.name).alias("view"), "strategy", extending.alias("extending_dimension"),
        F.col("type").alias("pattern_type"),
        F.when(F.col("strategy") == "breakdown", F.lit(VARIES))
        .otherwise(F.get(dim_name, F.col("b_id"))).alias("breakdown"),
        F.when(F.col("strategy") == "measure", F.lit(VARIES))
        .otherwise(F.get(measure_name, F.when(F.col("group_mid") >= 0, F.col("group_mid")))).alias("measure"),
        *filters,
        F.col("size").alias("hdp_size"),
        F.col("top.highlight").alias("highlight"), F.col("top.cnt").alias("common_count"),
        F.col("top.share").alias("common_share"),
        "commonness", "common_entropy", "n_common", "n_highlight_change", "n_type_change", "n_no_pattern",
        "conciseness", "impact", "impact_measure", "score", "low_support",
        F.col("top.n_supported").alias("n_supported"),
        F.col("top.nonzero_min").alias("nonzero_min"), F.col("top.nonzero_max").alias("nonzero_max"),
        "group_role", "ext_id", "group_mid", *layout.keys,
    )


def _hash_pieces(text: Column) -> list[Column]:
    """Four numbers of 60 bits out of a text's hash; their sums over rows do not depend on the order of the rows."""
    h = F.sha2(text, 256)
    return [F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]


def _digest_text(n: Column, sums: list[Column]) -> Column:
    return F.concat_ws(":", n.cast("string"), *[F.coalesce(p, F.lit(0)).cast("decimal(38,0)").cast("string") for p in sums])


def digest(text: Column, when: Column | None = None) -> Column:
    """Order-free digest of the rows of a group that meet a condition: their number and sums of hash pieces."""
    when = F.lit(True) if when is None else when
    return _digest_text(F.count_if(when), [F.sum(F.when(when, p)) for p in _hash_pieces(text)])


def _labelled(cube: Cube, rows: DataFrame) -> DataFrame:
    """Members (strategy, ext_id, member) with the label of their code."""
    measures = F.array(*[F.lit(m.name) for m in cube.config.measures])
    dims = F.array(*[F.lit(d) for d in cube.config.all_dims])
    values = domain_side(cube).select(F.col("dim_id").alias("ext_id"), F.col("code").alias("member"), F.col("label").alias("value"))
    label = (
        F.when(F.col("strategy") == "subspace", F.col("value")).when(F.col("strategy") == "measure", F.get(measures, F.col("member").cast("int")))
        .otherwise(F.get(dims, F.col("member").cast("int"))))
    return rows.join(values, ["ext_id", "member"], "left").withColumn("member_label", label).drop("value")


def _category(own: Column) -> Column:
    shared = F.array_contains(F.transform("commonness", lambda c: c["highlight"]), own)
    return F.when(own.isNotNull() & shared, "COMMON").when(own.isNotNull(), "HIGHLIGHT_CHANGE")


def own_members(cube: Cube, found: DataFrame, members: DataFrame) -> DataFrame:
    """One row per finding and sibling that holds its pattern: COMMON or HIGHLIGHT_CHANGE, reached from the patterns found."""
    group = [*GROUP, *cube.layout.keys]
    head = found.select(*group, "pattern_type", "commonness", "finding_id")
    hits = members.withColumn("h", F.explode("hits")).select(
        *group, "member", F.col("h.type").alias("pattern_type"), F.col("h.highlight").alias("own"))
    return _labelled(cube, hits.join(head, [*group, "pattern_type"])).select(
        "finding_id", "member_label", _category(F.col("own")).alias("category"), F.col("own").alias("highlight"))


def _common_and_own() -> list[Column]:
    said = F.concat_ws("~", "highlight", "member_label")
    return [digest(said, F.col("category") == "COMMON").alias("common"), digest(said).alias("own")]


def own_digests(cube: Cube, found: DataFrame, members: DataFrame) -> DataFrame:
    """finding_id and the digests `common` and `own` of `member_digests`."""
    return own_members(cube, found, members).groupBy("finding_id").agg(*_common_and_own())


def _sums(name: str, text: Column, when: Column | None = None) -> list[Column]:
    """Sums name0 to name3 of the hash pieces of the rows of a group that meet a condition, 0 where none does."""
    return [F.coalesce(F.sum(p if when is None else F.when(when, p)), F.lit(0)).cast("decimal(38,0)").alias(f"{name}{i}")
            for i, p in enumerate(_hash_pieces(text))]


def member_digests(cube: Cube, found: DataFrame, members: DataFrame) -> DataFrame:
    """finding_id and four digests that say which siblings are in which category, without listing a sibling set.

    `common`: siblings with a common highlight; `own`: those that hold the pattern at all; `held`: those that hold any pattern;
    `odd`: all siblings that are not common, each with its category and highlight. Digests are sums, so TYPE_CHANGE is what is
    held less what is own, and NO_PATTERN is the whole domain less what is held. A domain is summed once for all its sets, and
    what is held once for all findings of a set.
    """
    group = [*GROUP, *cube.layout.keys]

    def as_kind(kind: str) -> Column:
        return F.concat_ws("~", F.col("member_label"), F.lit(kind), F.lit(""))

    changed = F.concat_ws("~", "member_label", "category", "highlight")
    own = own_members(cube, found, members).groupBy("finding_id").agg(
        *_common_and_own(), F.count_if(F.col("category") == "COMMON").alias("n_shared"),
        *_sums("changed", changed, F.col("category") == "HIGHLIGHT_CHANGE"), *_sums("own_type", as_kind("TYPE_CHANGE")))
    sets = members.select(*group, "member").join(found.select(*group).distinct(), group, "left_semi")
    held = _labelled(cube, sets).groupBy(*group).agg(
        digest(F.col("member_label")).alias("held"), *_sums("held_type", as_kind("TYPE_CHANGE")), *_sums("held_none", as_kind("NO_PATTERN")))
    whole = None
    for (strategy, key), domain in _domains(cube).items():
        sums = domain.groupBy(key).agg(F.count("*").alias("n_set"), *_sums("none", as_kind("NO_PATTERN")))
        part = found.filter(F.col("strategy") == strategy).select(*group, F.col(key).alias("set_key"), "finding_id").join(
            F.broadcast(sums.withColumnRenamed(key, "set_key")), "set_key").drop("set_key")
        whole = part if whole is None else whole.unionByName(part)
    both = whole.join(held, group).join(own, "finding_id")
    odd = [F.expr(f"changed{i} + (held_type{i} - own_type{i}) + (none{i} - held_none{i})") for i in range(4)]
    return both.select("finding_id", "held", "common", "own", _digest_text(F.col("n_set") - F.col("n_shared"), odd).alias("odd"))


def _domains(cube: Cube) -> dict[tuple[str, str], DataFrame]:
    """The siblings a set of each strategy has (member, member_label), with the column of a finding that tells which set."""
    layout, config = cube.layout, cube.config
    spark = cube.cells.sparkSession
    values = domain_side(cube).select(F.col("dim_id").alias("ext_id"), F.col("code").alias("member"), F.col("label").alias("member_label"))
    pairs = [
        (b, i, config.measures[i].name) for b in config.all_dims for i in config.measures_for(b)
    ]
    grains = [
        (m.name, layout.dim_id(t), t) for m in config.measures for t in config.temporal_dimensions
        if (m.name, t) not in config.excluded_pairs
    ]
    return {
        ("subspace", "ext_id"): values,
        ("measure", "breakdown"): inline_table(spark, pairs, "breakdown string, member int, member_label string"),
        ("breakdown", "measure"): inline_table(spark, grains, "measure string, member int, member_label string"),
    }


def set_members(cube: Cube, found: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Every sibling of every finding, with or without rows in the data; or only those with one of a few labels."""
    head = found.select(*GROUP, *cube.layout.keys, "pattern_type", "commonness", "finding_id", "breakdown", "measure")
    out = None
    for (strategy, key), domain in _domains(cube).items():
        side = domain if labels is None else domain.filter(F.col("member_label").isin(*labels))
        part = head.filter(F.col("strategy") == strategy).join(side if strategy == "subspace" else F.broadcast(side), key)
        out = part if out is None else out.unionByName(part)
    return out


def finding_members(cube: Cube, found: DataFrame, members: DataFrame) -> DataFrame:
    """One row per (finding, sibling): COMMON, HIGHLIGHT_CHANGE, TYPE_CHANGE or NO_PATTERN.

    Siblings with no row in the data are members too, so the list starts from the domain. For listings only: it has as many rows
    as the sets have siblings.
    """
    group = [*GROUP, *cube.layout.keys]
    held = members.select(*group, "member", "hits")
    joined = set_members(cube, found).join(held, [*group, "member"], "left")
    own = F.get(F.filter("hits", lambda h: h["type"] == F.col("pattern_type")), F.lit(0))["highlight"]
    category = F.coalesce(_category(F.col("own")), F.when(F.size("hits") > 0, "TYPE_CHANGE").otherwise("NO_PATTERN"))
    return joined.withColumn("own", own).select(
        "finding_id", "member_label", category.alias("category"), F.col("own").alias("highlight"),
    )
