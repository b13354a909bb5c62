"""Ranking of findings for diversity, gamma sweeps, and the feed pooled across views.

Greedy picks need few rows: a gain only falls while picks are added, so the gain a row had at any earlier time bounds it. A
job prices every row against the picks so far and hands over the FETCHED rows of largest gain of each view; picks are made
among those for as long as the best of them is before every row left behind, and only then the next job runs. The result is
that of pricing all rows before each pick, mostly from one job, and what meets on the driver is bounded whatever the number
of findings.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Context, Decimal
from itertools import combinations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ledgerlens.mining.siblings import VARIES, conciseness
from ledgerlens.operators.quality import differing_rows
from ledgerlens.operators.scan import scan
from ledgerlens.session import cut_lineage, inline_table

TOP_K = 15
FEED_K = 50
SALTS = 64
#: Rows of each view that one job hands to the greedy picks.
FETCHED = 256
#: Findings of one key in a block of pairs.
PAIR_BLOCK = 512
RANK_DECAY = 0.85
TWINS = ("OUTSTANDING_1", "ATTRIBUTION")
# weights of the overlap ratio per extending strategy
WEIGHTS = {
    "subspace": {"slice": 0.4, "extending": 0.3, "measure": 0.15, "breakdown": 0.15},
    "measure": {"slice": 0.6, "extending": 0.0, "measure": 0.0, "breakdown": 0.4},
    "breakdown": {"slice": 0.6, "extending": 0.0, "measure": 0.4, "breakdown": 0.0},
}


def filter_array(depth: int, prefix: str = "") -> Column:
    """The base slice as array<'dim=value'>."""
    return F.array_compact(F.array(*[
        F.when(F.col(f"{prefix}filter{i}_dim").isNotNull(),
               F.concat(f"{prefix}filter{i}_dim", F.lit("="), f"{prefix}filter{i}_value"))
        for i in range(1, depth + 1)
    ]))


def _best_first() -> list[Column]:
    return [F.desc(F.round("score", 12)), F.col("finding_id")]


def merge_twins(found: DataFrame, digests: DataFrame, depth: int) -> DataFrame:
    """One finding of each OUTSTANDING_1 / ATTRIBUTION pair that says the same; the better score stays.

    `digests` are a run's `own_digests`, here and below.
    """
    twin = F.col("pattern_type").isin(*TWINS)
    filters = [f"filter{i}_{p}" for i in range(1, depth + 1) for p in ("dim", "value")]
    key = ["view", "strategy", "extending_dimension", "breakdown", "measure", *filters, "commonness_digest"]
    twins = found.filter(twin).join(digests.select("finding_id", F.col("common").alias("commonness_digest")), "finding_id")
    # null filter columns group together, so each absent filter is part of the key as it is
    w = Window.partitionBy(*key)
    ranked = twins.withColumns({
        "__rn": F.row_number().over(w.orderBy(*_best_first())),
        "__types": F.collect_set("pattern_type").over(w),
    })
    kept = ranked.filter("__rn = 1").withColumn(
        "merged_twins", F.array_sort(F.array_except("__types", F.array("pattern_type"))))
    others = found.filter(~twin).withColumn("merged_twins", F.array().cast("array<string>"))
    return others.unionByName(kept.drop("__rn", "__types", "commonness_digest"))


def _first_of(rows: DataFrame, groups: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; salted first, so that no task sorts a whole group."""
    salt = F.pmod(F.xxhash64("finding_id"), F.lit(SALTS))
    part = Window.partitionBy(*groups, "__salt").orderBy(*order)
    some = rows.withColumn("__salt", salt).withColumn("__rn", F.row_number().over(part)).filter(F.col("__rn") <= k)
    w = Window.partitionBy(*groups).orderBy(*order)
    return some.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k).drop("__rn", "__salt")


def prefilter(found: DataFrame, k: int) -> DataFrame:
    """The best k findings of each view."""
    return _first_of(found, ["view"], _best_first(), k)


def _of(row: str | Column, name: str) -> Column:
    return F.col(f"{row}.{name}") if isinstance(row, str) else row[name]


def _slice_overlap(fa: Column, fb: Column) -> Column:
    """Shared filters in proportion to the smaller slice; two unfiltered slices are the same."""
    return (
        F.when((F.size(fa) == 0) & (F.size(fb) == 0), 1.0)
        .when((F.size(fa) == 0) | (F.size(fb) == 0), 0.0)
        .otherwise(F.size(F.array_intersect(fa, fb)) / F.least(F.size(fa), F.size(fb))))


def overlap_ratio(a: str | Column, b: str | Column) -> Column:
    """Overlap of two findings given as structs with strategy, pattern_type, extending_dimension,
    measure, breakdown and filters."""
    def same(name: str) -> Column:
        return _of(a, name) == _of(b, name)

    fa, fb = _of(a, "filters"), _of(b, "filters")
    coefficient = _slice_overlap(fa, fb)
    content = same("measure") | same("breakdown") | F.arrays_overlap(fa, fb)
    ratio = None
    for strategy, w in WEIGHTS.items():
        value = (
            w["slice"] * coefficient + w["extending"] * same("extending_dimension").cast("int")
            + w["measure"] * same("measure").cast("int") + w["breakdown"] * same("breakdown").cast("int"))
        hit = _of(a, "strategy") == strategy
        ratio = F.when(hit, value) if ratio is None else ratio.when(hit, value)
    return F.when(same("strategy") & same("pattern_type") & content, ratio).otherwise(0.0)


def content_keys(measure: str, breakdown: str, filters: Column) -> Column:
    """One key for each thing whose sharing lets two findings overlap."""
    return F.array_distinct(F.concat(
        F.array(F.concat(F.lit("measure "), F.col(measure)), F.concat(F.lit("breakdown "), F.col(breakdown))),
        F.transform(filters, lambda x: F.concat(F.lit("filter "), x))))


def pair_overlaps(selected: DataFrame, depth: int, block: int = PAIR_BLOCK) -> DataFrame:
    """Overlap of each pair of findings that overlap; pairs meet on what they share, so others are never formed.

    The findings of a key are dealt into blocks of about `block`, and a pair of blocks is a join key of its own: a measure that
    nearly all findings have is spread over as many tasks as it has pairs of blocks.
    """
    keys = ["view", "strategy", "pattern_type", "shared"]
    one = selected.select("view", "strategy", "pattern_type", "finding_id", "score", F.struct(
        "strategy", "pattern_type", "extending_dimension", "measure", "breakdown",
        filter_array(depth).alias("filters")).alias("f"), F.explode(content_keys("measure", "breakdown", filter_array(depth))).alias("shared"))
    sizes = one.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    one = one.join(sizes, keys).withColumn("at", F.pmod(F.xxhash64("finding_id"), F.col("blocks")).cast("int"))
    left = one.select(*keys, F.col("at").alias("block_a"), F.explode(F.sequence("at", F.col("blocks") - 1)).alias("block_b"),
                      F.col("finding_id").alias("id_a"), F.col("score").alias("score_a"), F.col("f").alias("a"))
    right = one.select(*keys, F.explode(F.sequence(F.lit(0), "at")).alias("block_a"), F.col("at").alias("block_b"),
                       F.col("finding_id").alias("id_b"), F.col("score").alias("score_b"), F.col("f").alias("b"))
    first = F.array_min(F.array_intersect(*[
        F.concat(F.array(F.concat(F.lit("measure "), _of(x, "measure")), F.concat(F.lit("breakdown "), _of(x, "breakdown"))),
                 F.transform(_of(x, "filters"), lambda v: F.concat(F.lit("filter "), v))) for x in ("a", "b")]))
    once = (F.col("block_a") < F.col("block_b")) | (F.col("id_a") < F.col("id_b"))
    # a pair that shares several things is kept where it meets on the first of them
    pairs = left.join(right, [*keys, "block_a", "block_b"]).filter(once & (F.col("shared") == first)).withColumn(
        "ratio", overlap_ratio("a", "b"))
    return pairs.filter("ratio > 0").select(
        "view", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "ratio",
        (F.least("score_a", "score_b") * F.col("ratio")).alias("redundancy"))


def _overlap_terms(filters: Column, depth: int) -> Column:
    """The overlap of two findings as a sum over the keys they share: array of (key, weight) of one finding.

    Sharing a measure or a breakdown, or both, are keys; a shared slice is a key for each non-empty set of its filters, signed
    so that each pair with a common filter counts once; `1 / min(p, q)` of the slice overlap is 1 less `1/t - 1/(t+1)` for each
    t below both sizes. `filters` is the ordered slice.
    """
    m, b, e = F.col("measure"), F.col("breakdown"), F.col("extending_dimension")
    arms = []

    def term(strategy: str, weight: float, name: str, *parts, when: Column | None = None) -> None:
        if weight:
            values = [p.alias(f"p{i}") for i, p in enumerate(parts)]
            key = F.to_json(F.struct(F.lit(strategy).alias("s"), F.lit(name).alias("t"), *values))
            here = F.col("strategy") == strategy
            arms.append(F.when(here if when is None else here & when, F.struct(key.alias("key"), F.lit(float(weight)).alias("weight"))))

    for strategy, w in WEIGHTS.items():
        term(strategy, w["measure"], "m", m)
        term(strategy, w["breakdown"], "b", b)
        for sign, name, parts in ((1, "m", (m,)), (1, "b", (b,)), (-1, "mb", (m, b))):
            term(strategy, sign * w["extending"], f"e{name}", e, *parts)
            term(strategy, sign * w["slice"], f"bare {name}", *parts, when=F.size(filters) == 0)
        for size in range(1, depth + 1):
            for places in combinations(range(depth), size):
                some, there = F.array(*[F.get(filters, i) for i in places]), F.size(filters) > max(places)
                odd = w["extending"] * (-1) ** (size + 1)
                for sign, name, parts in ((1, "", ()), (-1, "m", (m,)), (-1, "b", (b,)), (1, "mb", (m, b))):
                    term(strategy, sign * odd, f"e{name} slice {size}", e, some, *parts, when=there)
        for i in range(depth):
            there, one = F.size(filters) > i, F.get(filters, i)
            term(strategy, w["slice"], "filter", one, when=there)
            for t in range(1, depth):
                term(strategy, -w["slice"] * (1 / t - 1 / (t + 1)), f"filter over {t}", one, when=there & (F.size(filters) > t))
    return F.array_compact(F.array(*arms))


def total_use(selected: DataFrame, depth: int) -> DataFrame:
    """Sum of scores minus the overlap of all pairs, per view, without forming a pair.

    For findings that share a key, by falling score, the smaller score of a pair is that of the later one: the sum over pairs
    is that of score times the number of findings before.
    """
    scores = selected.groupBy("view").agg(F.sum("score").alias("score_sum"), F.count("*").alias("selected"))
    terms = selected.select("view", *SLIM, "finding_id", "score", F.array_sort(filter_array(depth)).alias("in_order")).select(
        "view", "pattern_type", "finding_id", "score", F.explode(_overlap_terms(F.col("in_order"), depth)).alias("t")).select(
        "view", "pattern_type", "finding_id", "score", "t.key", "t.weight")
    ranked = scan(terms, ["view", "pattern_type", "key"], [F.desc("score"), F.col("finding_id")])
    lost = ranked.groupBy("view").agg(F.sum(F.col("weight") * F.col("score") * (F.col("position") - 1)).alias("lost"))
    return scores.join(lost, "view", "left").select(
        "view", "selected", (F.col("score_sum") - F.coalesce("lost", F.lit(0.0))).alias("total_use"))


SLIM = ("strategy", "pattern_type", "extending_dimension", "measure", "breakdown")
PICKED = ("view string, group string, finding_id string, score double, gain double, view_rank int, filters array<string>, "
          + ", ".join(f"{c} string" for c in SLIM))


def slice_overlap_of(fa: list[str], fb: list[str]) -> float:
    """`_slice_overlap` of two collected slices."""
    if not fa or not fb:
        return float(not fa and not fb)
    return len(set(fa) & set(fb)) / min(len(fa), len(fb))


def overlap_of(a: Row, b: Row) -> float:
    """`overlap_ratio` of two collected findings."""
    m, k, e = (float(a[c] == b[c]) for c in ("measure", "breakdown", "extending_dimension"))
    if a["strategy"] != b["strategy"] or a["pattern_type"] != b["pattern_type"] or not (m or k or set(a["filters"]) & set(b["filters"])):
        return 0.0
    w = WEIGHTS[a["strategy"]]
    return w["slice"] * slice_overlap_of(a["filters"], b["filters"]) + w["extending"] * e + w["measure"] * m + w["breakdown"] * k


def settled(value: float) -> float:
    """A double to twelve places, rounded as Spark's `round` does."""
    return float(Decimal(repr(value)).quantize(Decimal("1e-12"), ROUND_HALF_UP, Context(prec=400)))


@dataclass
class Candidate:
    """A fetched row, its score and what of it the picks so far have already said."""

    row: Row
    score: float
    lost: float
    tie: tuple

    @property
    def gain(self) -> float:
        return self.score - self.lost

    @property
    def key(self) -> tuple:
        return -settled(self.gain), -settled(self.score), *self.tie


def greedy_picks(fetch: Callable[[set], dict], take: Callable, again: Callable[[Candidate, object], None], full: Callable, size: int) -> None:
    """Pick the row of largest gain of each group until a group is full or no gain is left.

    `fetch(ended)` prices all rows of the other groups and gives each group's first `size` candidates by key, in order; with no
    such group it gives nothing. A key never gets smaller, so a fetched row whose key is not after the last fetched one is
    before every row left behind; otherwise all rows are priced again. Each fetch brings the row of least key, so each one yields a pick or ends a group.
    """
    ended: set = set()
    while fetched := fetch(ended):
        for group, rows in fetched.items():
            complete, bound = len(rows) < size, rows[-1].key
            while True:
                best = min(rows, key=lambda c: c.key, default=None)
                if best is None or not complete and best.key > bound:
                    if complete:
                        ended.add(group)
                    break
                if not take(group, best):
                    ended.add(group)
                    break
                rows.remove(best)
                for c in rows:
                    again(c, best)
                if full(group):
                    ended.add(group)
                    break


def rank(found: DataFrame, depth: int, k: int = TOP_K, group: Column | None = None, fetched: int = FETCHED) -> DataFrame:
    """The k most useful findings of each view (and `group`, for sweeps): best score first, then the largest score less its
    overlap with all picks, while that is positive. Ties go to the higher score, then the smaller id.

    Columns: view, group, finding_id, view_rank and the gain each finding had when it was picked.
    """
    spark = found.sparkSession
    group = F.lit("") if group is None else group.cast("string")
    slim = found.select("view", group.alias("group"), "finding_id", "score", filter_array(depth).alias("filters"), *SLIM)
    picks: dict[tuple, list[tuple[Row, float]]] = {}
    row = F.struct("filters", *SLIM)

    def flat(groups) -> list[tuple]:
        return [(*g, r.finding_id, r.score, gain, n, list(r.filters), *[r[c] for c in SLIM])
                for g in groups for n, (r, gain) in enumerate(picks[g], 1)]

    def fetch(ended: set) -> dict[tuple, list[Candidate]]:
        nonlocal slim
        lost, rows = F.lit(0.0), slim
        if picks:
            if len(ended) == len(picks):
                return {}
            slim = cut_lineage(slim, "rank-rows")  # one job is mostly enough; from the second on rows are read back
            so_far = inline_table(spark, flat(picks.keys() - ended), PICKED).groupBy("view", "group").agg(F.transform(F.array_sort(F.collect_list(F.struct(
                "view_rank", F.struct("finding_id", "score", "filters", *SLIM).alias("p")))), lambda x: x["p"]).alias("picks"))
            rows = slim.join(F.broadcast(so_far), ["view", "group"]).filter(  # at most k picks for each view and group
                ~F.exists("picks", lambda p: p["finding_id"] == F.col("finding_id")))
            lost = F.aggregate("picks", F.lit(0.0), lambda acc, p: acc + F.least(F.col("score"), p["score"]) * overlap_ratio(row, p))
        order = [F.desc(F.round(F.col("score") - F.col("lost"), 12)), *_best_first()]
        lists = {}
        for r in _first_of(rows.withColumn("lost", lost).drop("picks"), ["view", "group"], order, fetched).collect():
            lists.setdefault((r["view"], r["group"]), []).append(Candidate(r, r["score"], r["lost"], (r["finding_id"],)))
        for mine in lists.values():
            mine.sort(key=lambda c: c.key)
        return lists

    def take(g, best: Candidate) -> bool:
        mine = picks.setdefault(g, [])
        if mine and settled(best.gain) <= 0:
            return False
        mine.append((best.row, best.gain))
        return True

    def again(c: Candidate, best: Candidate) -> None:
        c.lost += min(c.score, best.score) * overlap_of(c.row, best.row)

    greedy_picks(fetch, take, again, lambda g: len(picks[g]) >= k, fetched)
    return inline_table(spark, flat(picks), PICKED).select("view", "group", "finding_id", "view_rank", "gain")


def merge_prefilter_rank(found: DataFrame, digests: DataFrame, depth: int, k: int = TOP_K, best: int | None = None) -> DataFrame:
    """Twin merge, then the prefilter if `best` is given, then greedy rank: the findings in rank order of their view."""
    merged = merge_twins(found, digests, depth)
    if best is not None:
        merged = prefilter(merged, best)
    return merged.join(F.broadcast(rank(merged, depth, k).drop("group", "gain")), ["view", "finding_id"])  # k for each view


def gamma_rescored(found: DataFrame, gammas: list[float], tau: float) -> DataFrame:
    """Every finding once per gamma with its conciseness and score recomputed."""
    counts = [F.col("n_highlight_change"), F.col("n_type_change"), F.col("n_no_pattern")]
    spread = found.withColumn("gamma", F.explode(F.array(*[F.lit(float(g)) for g in gammas])))
    return spread.withColumn(
        "conciseness", conciseness(F.col("common_entropy"), counts, F.col("hdp_size").cast("double"), tau, F.col("gamma"))
    ).withColumn("score", F.col("conciseness") * F.col("impact"))


def gamma_sensitivity(found: DataFrame, depth: int, tau: float, gammas: list[float], baseline: float, k: int = TOP_K) -> DataFrame:
    """Per gamma: universal and actionable findings in the top k, the best score, total use, and who entered or left against the baseline."""
    scored = gamma_rescored(found, gammas, tau).filter("score > 0")
    ranks = rank(scored, depth, k, F.col("gamma")).withColumn("gamma", F.col("group").cast("double")).drop("group")
    # a finding's gain when picked is its score less its overlap with all earlier picks, so gains add up to the total use
    use = ranks.groupBy("view", "gamma").agg(F.sum("gain").alias("total_use"))
    ranks = ranks.drop("gain")
    chosen = scored.join(ranks, ["view", "finding_id", "gamma"])
    exceptions = F.col("n_highlight_change") + F.col("n_type_change") + F.col("n_no_pattern")
    base = ranks.filter(F.col("gamma") == baseline).select("view", "finding_id", F.lit(True).alias("in_base"))
    base_size = base.groupBy("view").agg(F.count("*").alias("base_size"))
    return chosen.join(base, ["view", "finding_id"], "left").groupBy("view", "gamma").agg(
        F.count_if(exceptions == 0).alias("universal"), F.count_if(exceptions > 0).alias("actionable"),
        F.max("score").alias("top_score"), F.count_if(F.col("in_base").isNull()).alias("entered"),
        F.count("in_base").alias("__kept"),
    ).join(use, ["view", "gamma"]).join(base_size, "view").withColumn("exited", F.col("base_size") - F.col("__kept")).drop("__kept", "base_size")


# ---- the feed across views -------------------------------------------------------------------

def coverage(views: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Distinct entities per view, and whether equal weights still follow from equal coverage."""
    parts = None
    for name, (df, entity) in views.items():
        part = df.agg(F.count_distinct(entity).alias("entities")).withColumn("view", F.lit(name))
        parts = part if parts is None else parts.unionByName(part)
    every = Window.partitionBy(F.lit(1))  # one row per view
    return parts.select(
        "view", "entities", F.lit(1.0 / len(views)).alias("weight"),
        (F.min("entities").over(every) != F.max("entities").over(every)).alias("uneven"))


def global_scores(ranked: DataFrame, weights: dict[str, float]) -> DataFrame:
    weight = F.create_map(*[x for v, w in weights.items() for x in (F.lit(v), F.lit(float(w)))])
    decay = F.pow(F.lit(RANK_DECAY), F.col("view_rank") - 1)
    return ranked.withColumn("global_score", weight[F.col("view")] * F.col("score") * decay)


def in_source_terms(found: DataFrame, lineage: dict[tuple[str, str], str], depth: int) -> DataFrame:
    """Replace column names by the source concept they come from; unknown names stand for themselves."""
    table = F.create_map(*[x for (v, name), concept in lineage.items() for x in (F.lit(f"{v}~{name}"), F.lit(concept))]) \
        if lineage else None

    def concept(column: Column) -> Column:
        return column if table is None else F.coalesce(F.try_element_at(table, F.concat("view", F.lit("~"), column)), column)

    filters = F.array_compact(F.array(*[
        F.when(F.col(f"filter{i}_dim").isNotNull(),
               F.concat(concept(F.col(f"filter{i}_dim")), F.lit("="), F.col(f"filter{i}_value")))
        for i in range(1, depth + 1)]))
    return found.withColumns({
        "c_measure": concept(F.col("measure")), "c_breakdown": concept(F.col("breakdown")),
        "c_extending": concept(F.col("extending_dimension")), "c_filters": F.array_sort(filters)})


def lineage_dedup(pool: DataFrame) -> DataFrame:
    """One finding per (source concepts, pattern type, slice, highlight): the one with the best global score."""
    concepts = F.array_sort(F.array_distinct(F.filter(
        F.array("c_measure", "c_breakdown", "c_extending"), lambda x: x != VARIES)))
    key = F.to_json(F.struct(concepts.alias("c"), "pattern_type", "c_filters", "highlight"))
    w = Window.partitionBy("lineage_key").orderBy(F.desc(F.round("global_score", 12)), "view", "view_rank")
    return pool.withColumn("lineage_key", key).withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def cross_view_overlap(a: str | Column, b: str | Column) -> Column:
    """Overlap of two pooled findings in source terms, with the content gate."""
    def same(name: str) -> Column:
        return (_of(a, name) == _of(b, name)).cast("int")

    fa, fb = _of(a, "c_filters"), _of(b, "c_filters")
    w = WEIGHTS["subspace"]
    gate = (_of(a, "pattern_type") == _of(b, "pattern_type")) & (
        (same("c_measure") + same("c_breakdown") > 0) | F.arrays_overlap(fa, fb))
    return F.when(gate, w["slice"] * _slice_overlap(fa, fb) + w["extending"] * same("c_extending")
                  + w["measure"] * same("c_measure") + w["breakdown"] * same("c_breakdown")).otherwise(0.0)


def cross_view_pairs(left: DataFrame, right: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """Overlap of each pair of findings of two views, in source terms, that share something; met in blocks as `pair_overlaps`."""
    fields = ("pattern_type", "c_measure", "c_breakdown", "c_extending", "c_filters")
    keys = ["pattern_type", "shared"]

    def side(found: DataFrame, name: str) -> DataFrame:
        return found.select("finding_id", "pattern_type", F.struct(*fields).alias(name),
                            F.explode(content_keys("c_measure", "c_breakdown", F.col("c_filters"))).alias("shared"))

    def sizes(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias(f"of_{name}"))

    a, b = side(left, "a"), side(right, "b")
    both = sizes(a, "a").join(sizes(b, "b"), keys)

    def dealt(rows: DataFrame, mine: str, other: str) -> DataFrame:
        return rows.join(both, keys).select(
            *keys, F.pmod(F.xxhash64("finding_id"), F.col(f"of_{mine}")).cast("int").alias(f"block_{mine}"),
            F.explode(F.sequence(F.lit(0), F.col(f"of_{other}") - 1)).alias(f"block_{other}"), F.col("finding_id").alias(f"id_{mine}"), mine)

    def things(x: str) -> Column:
        return F.concat(F.array(F.concat(F.lit("measure "), _of(x, "c_measure")), F.concat(F.lit("breakdown "), _of(x, "c_breakdown"))),
                        F.transform(_of(x, "c_filters"), lambda v: F.concat(F.lit("filter "), v)))

    met = dealt(a, "a", "b").join(dealt(b, "b", "a"), [*keys, "block_a", "block_b"]).filter(
        F.col("shared") == F.array_min(F.array_intersect(things("a"), things("b"))))
    return met.withColumn("ratio", cross_view_overlap("a", "b")).filter("ratio > 0").select("id_a", "id_b", "ratio")


POOLED = (*SLIM, "c_measure", "c_breakdown", "c_extending")
FEED = ("view string, finding_id string, feed_rank int, seed boolean, worst_overlap double, gain double, global_score double, "
        "filters array<string>, c_filters array<string>, " + ", ".join(f"{c} string" for c in POOLED))


def cross_view_overlap_of(a: Row, b: Row) -> float:
    """`cross_view_overlap` of two collected findings."""
    m, k, e = (float(a[c] == b[c]) for c in ("c_measure", "c_breakdown", "c_extending"))
    if a["pattern_type"] != b["pattern_type"] or not (m or k or set(a["c_filters"]) & set(b["c_filters"])):
        return 0.0
    w = WEIGHTS["subspace"]
    return w["slice"] * slice_overlap_of(a["c_filters"], b["c_filters"]) + w["extending"] * e + w["measure"] * m + w["breakdown"] * k


def select_feed(pool: DataFrame, depth: int, k: int = FEED_K, fetched: int = FETCHED) -> DataFrame:
    """The pooled feed: each view's best rank as a seed, then the largest score less its worst overlap with the selection.

    Findings left out have feed_rank 0 and the numbers behind that. Nothing is cut before or after the seeds.
    """
    spark = pool.sparkSession
    fields = ("finding_id", "global_score", "filters", "c_filters", *POOLED)
    slim = cut_lineage(pool.select(
        "view", "view_rank", "finding_id", "global_score", filter_array(depth).alias("filters"), "c_filters", *POOLED), "feed-rows")
    row = F.struct("view", "filters", "c_filters", *POOLED)
    picks: list[tuple] = []

    def add(r, seed: bool, worst: float, gain: float) -> None:
        picks.append((r.view, r.finding_id, len(picks) + 1, seed, worst, gain, r.global_score, list(r.filters), list(r.c_filters),
                      *[r[c] for c in POOLED]))

    def priced(rows: DataFrame) -> DataFrame:
        """Rows with their worst overlap with the picks so far, and what is left of their score."""
        chosen = inline_table(spark, picks, FEED).agg(F.collect_list(F.struct("view", *fields)).alias("picks"))  # at most k and the seeds
        overlap = lambda p: F.when(F.col("view") == p["view"], overlap_ratio(row, p)).otherwise(cross_view_overlap(row, p))
        worst = F.aggregate("picks", F.lit(0.0), lambda acc, p: F.greatest(acc, F.least(F.col("global_score"), p["global_score"]) * overlap(p)))
        return rows.crossJoin(F.broadcast(chosen)).withColumn("worst_overlap", worst).withColumn(
            "gain", F.col("global_score") - F.least("global_score", "worst_overlap"))

    seeds = slim.groupBy("view").agg(F.min_by(F.struct("view", *fields), F.struct("view_rank", -F.round("global_score", 12))).alias("s"))
    for r in sorted(seeds.collect(), key=lambda r: (-round(r.s.global_score, 12), r.s.view)):  # one row for each view
        add(r.s, True, 0.0, r.s.global_score)

    def fetch(ended: set) -> dict[str, list[Candidate]]:
        if not picks or len(picks) >= k or ended:
            return {}
        open_rows = priced(slim).filter(~F.exists("picks", lambda p: (p["view"] == F.col("view")) & (p["finding_id"] == F.col("finding_id"))))
        order = [F.desc(F.round("gain", 12)), F.desc(F.round("global_score", 12)), F.col("view"), F.col("view_rank")]
        rows = _first_of(open_rows.drop("picks").withColumn("all", F.lit("feed")), ["all"], order, fetched).collect()
        found = [Candidate(r, r.global_score, min(r.global_score, r.worst_overlap), (r.view, r.view_rank)) for r in rows]
        return {"feed": sorted(found, key=lambda c: c.key)} if found else {}

    def take(_, best: Candidate) -> bool:
        if settled(best.gain) <= 0:
            return False
        add(best.row, False, best.lost, best.gain)
        return True

    def again(c: Candidate, best: Candidate) -> None:
        overlap = overlap_of if c.row.view == best.row.view else cross_view_overlap_of
        c.lost = min(c.score, max(c.lost, min(c.score, best.score) * overlap(c.row, best.row)))

    greedy_picks(fetch, take, again, lambda _: len(picks) >= k, fetched)
    chosen = inline_table(spark, picks, FEED).select(
        "view", "finding_id", "feed_rank", "seed", F.col("worst_overlap").alias("own_worst"), F.col("gain").alias("own_gain"))
    left = priced(slim).select("view", "finding_id", "worst_overlap", "gain").join(
        F.broadcast(chosen), ["view", "finding_id"], "left").select(  # at most k and the seeds
        "view", "finding_id", F.coalesce("feed_rank", F.lit(0)).alias("feed_rank"), F.coalesce("seed", F.lit(False)).alias("seed"),
        F.coalesce("own_worst", "worst_overlap").alias("worst_overlap"), F.coalesce("own_gain", "gain").alias("gain"))
    return pool.join(left, ["view", "finding_id"])


def rejected(feed: DataFrame, n: int = 15) -> DataFrame:
    """The best findings left out, with their worst overlap and remaining gain."""
    return feed.filter("feed_rank = 0").orderBy(F.desc(F.round("global_score", 12)), "view", "view_rank").limit(n).select(
        "view", "view_rank", "sentence", F.round("global_score", 6).alias("global_score"),
        F.round("worst_overlap", 6).alias("worst_overlap"), F.round("gain", 6).alias("marginal_gain"))


def set_identity(hashes: DataFrame) -> DataFrame:
    """Identity of a set of named results from (name, content_hash) rows, one per result."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("name", "content_hash"))),
                        lambda x: F.concat(x["name"], F.lit(":"), x["content_hash"], F.lit("\n")))
    return hashes.agg(F.substring(F.sha2(F.concat_ws("", lines), 256), 1, 16).alias("set_id"), F.count("*").alias("files"))


def finding_diff(now: DataFrame, before: DataFrame, now_digests: DataFrame, before_digests: DataFrame) -> DataFrame:
    """Findings only in one of two runs, by what they say and not by their score; runs that agree move digests only."""
    def signed(found: DataFrame, digests: DataFrame) -> DataFrame:
        return found.join(digests, "finding_id").select("finding_id", F.concat_ws("~", "finding_id", "common").alias("signature"))

    a, b = differing_rows(signed(now, now_digests), signed(before, before_digests), ["signature"], ["finding_id"])
    return a.join(b, "signature", "left_anti").select(F.lit("entered").alias("change"), "finding_id").unionByName(
        b.join(a, "signature", "left_anti").select(F.lit("exited").alias("change"), "finding_id"))


def canonical_keys(found: DataFrame, digests: DataFrame, depth: int) -> DataFrame:
    """Identity of each finding from its content: its defining fields and digests of its members, of bounded length."""
    filters = F.concat_ws(";", F.array_sort(filter_array(depth)))
    return found.join(digests, "finding_id").select("finding_id", F.concat_ws(
        "||", "strategy", "extending_dimension", "pattern_type", "breakdown", "measure", filters,
        F.col("hdp_size").cast("string"), "common", "odd").alias("canonical_key"))


def pattern_text(kind: Column, highlight: Column, measure: Column, breakdown: Column, signed_measures: tuple[str, ...] = ()) -> Column:
    """What one pattern says, in words of our own."""
    part = F.split(highlight, "\\|")
    named = F.array_join(F.transform(part, lambda x: F.concat(
        F.substring_index(x, ":", 1), F.lit(" ("), F.lower(F.substring_index(x, ":", -1)), F.lit(")"))), ", ")
    signed = measure.isin(*signed_measures) if signed_measures else F.lit(False)

    def say(*words) -> Column:
        return F.concat(*[F.lit(w) if isinstance(w, str) else w for w in words])

    text = {
        "OUTSTANDING_1": say(measure, " is by far highest for ", highlight, " when split by ", breakdown),
        "OUTSTANDING_LAST": say(measure, " is by far lowest for ", highlight, " when split by ", breakdown),
        "TOP_TWO": say(measure, " is highest for the two of ", F.array_join(part, ", "), " when split by ", breakdown),
        "LAST_TWO": say(measure, " is lowest for the two of ", F.array_join(part, ", "), " when split by ", breakdown),
        "EVENNESS": F.when(signed, say("no ", breakdown, " dominates ", measure, ", whose parts may cancel")).otherwise(
            say(measure, " differs little by ", breakdown)),
        "ATTRIBUTION": say("more than half of ", measure, " belongs to ", highlight, " when split by ", breakdown),
        "TREND": say(measure, " keeps ", F.lower(highlight), " along ", breakdown),
        "OUTLIER": say(measure, " is unusual along ", breakdown, " at ", named),
        "SEASONALITY": say(measure, " repeats along ", breakdown, " with ", highlight),
        "CHANGE_POINT": say(measure, " moves to another level along ", breakdown, " from ", highlight, " on"),
        "UNIMODALITY": say(measure, " has a single ", F.lower(F.get(part, F.lit(0))), " along ", breakdown, " at ", F.get(part, F.lit(1))),
    }
    body = None
    for name, value in text.items():
        body = F.when(kind == name, value) if body is None else body.when(kind == name, value)
    return body


def sentence(signed_measures: tuple[str, ...] = ()) -> Column:
    """One plain sentence per finding from its commonest highlight."""
    c = F.col
    counted = F.concat(F.lit(" ("), c("common_count").cast("string"), F.lit(" of "), c("hdp_size").cast("string"), F.lit("): "))
    prefix = (
        F.when(c("common_share") >= 1.0, F.concat(F.lit("For every "), c("extending_dimension"), F.lit(": ")))
        .when(c("common_share") >= 0.9, F.concat(F.lit("For nearly every "), c("extending_dimension"), counted))
        .otherwise(F.concat(F.lit("For most of "), c("extending_dimension"), counted)))
    return F.concat(prefix, pattern_text(c("pattern_type"), c("highlight"), c("measure"), c("breakdown"), signed_measures))


def with_sentences(found: DataFrame, members: DataFrame, signed_measures: tuple[str, ...] = (), shown: int = 3) -> DataFrame:
    """Findings with their sentence and the first `shown` named exceptions.

    An exception with another highlight says its own pattern; exceptions to evenness are about the spread only.
    """
    heads = found.select("finding_id", "pattern_type", "measure", "breakdown")
    odd = members.filter(F.col("category") != "COMMON").select("finding_id", "member_label", "category", F.col("highlight").alias("own")).join(
        heads, "finding_id")
    even = F.col("pattern_type") == "EVENNESS"
    own = pattern_text(F.col("pattern_type"), F.col("own"), F.col("measure"), F.col("breakdown"), signed_measures)
    why = (
        F.when((F.col("category") == "HIGHLIGHT_CHANGE") & own.isNotNull(), own)
        .when(F.col("category") == "TYPE_CHANGE", F.when(even, "spread in another way").otherwise("another pattern"))
        .otherwise(F.when(even, "uneven").otherwise("no pattern")))
    named = F.concat("member_label", F.lit(" ("), why, F.lit(")"))
    salted = Window.partitionBy("finding_id", F.pmod(F.xxhash64("member_label"), F.lit(SALTS))).orderBy("member_label")
    some = odd.select("finding_id", "member_label", named.alias("text")).withColumn("__rn", F.row_number().over(salted)).filter(F.col("__rn") <= shown)
    # at most `shown` for each salt are left of a finding
    listed = some.groupBy("finding_id").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(
        F.struct("member_label", "text"))), 1, shown), lambda x: x["text"]), "; ").alias("__odd"))
    exceptions = F.col("n_highlight_change") + F.col("n_type_change") + F.col("n_no_pattern")
    more = F.when(exceptions > shown, F.concat(F.lit(" and "), (exceptions - shown).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    label = F.when(even, "Not even in").when(exceptions == 1, "Exception").otherwise("Exceptions")
    note = F.when(even, "; this is about the spread, not the level").otherwise("")
    tail = F.when(F.col("__odd").isNotNull(), F.concat(F.lit(". "), label, F.lit(": "), F.col("__odd"), more, note)).otherwise(F.lit(""))
    return found.join(listed, "finding_id", "left").withColumn(
        "sentence", F.concat(sentence(signed_measures), tail)).drop("__odd")
