"""SimHash near-duplicates by meeting in the middle of Hamming balls.

Two fingerprints differ in at most `radius` (even) bits exactly when some value lies within radius / 2 of both. So every
fingerprint emits all variants within half the radius and those that meet on a variant are linked; members of one variant
are chained, which gives the same components as all pairs and grows with the members, not with their square. A ball has
2,081 variants at radius 4, so no variant can hold more than that share of the rows, however alike they are.

The same rule thins out the input first: of two linked fingerprints one 32-bit half differs in at most radius / 2 bits, so
balls over the halves (66 variants at radius 4) find every fingerprint that can have a partner; only those emit full balls.

Defined cases: a null text counts as empty; no words give fingerprint zero, linked like any other; fewer words than a
shingle has are one shingle; equal fingerprints are one node, whatever their number; repeated rows each get their result;
a component of rows that all lack an id has a null component; an empty table gives an empty result. Only the id and text
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.common import LOWER_ASCII, WORD_BYTES, gram_hashes, mix, signed, sized_join, texts, word_hash, Cache
from ledgerlens.llm.components import components
from ledgerlens.session import cut_lineage

SEED = 42
#: Shingle hashes a worker holds before it reduces them to fingerprints.
HELD_HASHES = 1_000_000
#: Shingles whose counts the driver holds to put frequent ones last.
COMMON_SHINGLES = 1 << 18
#: Pairs that a later round may make for each meeting of the first one.
PER_MEETING = 4
#: Slack of bounds that only choose candidates, against the rounding of doubles.
ROUNDING = 1e-6
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(words: list[bytes], n: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of `n` words joined by a space; of the whole sequence if it is shorter."""
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - n + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[n - 1 :].tolist())], np.uint64)


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """For each array the 64 bits that are set in over half of its values; zero for an empty one.

    Bits are counted eight lanes at a time in 64-bit adds over runs of at most 255 values, so no lane overflows.
    """
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat, sizes = np.concatenate([hashes[k] for k in full]), sizes[full]
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    runs = -(-sizes // 255)
    first_run = np.concatenate([[0], np.cumsum(runs)[:-1]])
    owner = np.repeat(np.arange(len(full)), runs)
    run_start = offsets[owner] + 255 * (np.arange(runs.sum()) - first_run[owner])
    counts = np.zeros((len(full), 64), np.int64)
    for j in range(8):
        lanes = np.add.reduceat((flat >> np.uint64(j)) & _LANES, run_start)
        counts[:, j::8] = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first_run, axis=0)
    bits = counts * 2 > sizes[:, None]
    out[full] = (bits.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def _fingerprint_rows(shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values in texts(batches):
            done, held, size = [], [], 0
            for value in values:
                held.append(shingle_hashes(WORD_BYTES.findall((value or b"").translate(LOWER_ASCII)), shingle_words))
                size += len(held[-1])
                if size > HELD_HASHES:
                    done.append(majority(held))
                    held, size = [], 0
            done.append(majority(held))
            yield pa.record_batch([part.column(0), pa.array(np.concatenate(done).view(np.int64), pa.int64())], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle_words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the fingerprint as a signed long, over repeats of shingles too."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return narrow.mapInArrow(_fingerprint_rows(shingle_words), "doc_id long, fp long")


def masks(bits: int, radius: int) -> list[int]:
    """All values of `bits` bits with at most `radius` of them set, as signed longs."""
    return [signed(sum(1 << b for b in c)) for r in range(radius + 1) for c in combinations(range(bits), r)]


def _flips(value: Column, flips: list[int]) -> Column:
    return F.explode(F.transform(F.array(*[F.lit(m).cast("long") for m in flips]), lambda m: value.bitwiseXOR(m)))


def half_keys(nodes: DataFrame, radius: int) -> DataFrame:
    """node, fp, key: the variants of both halves of each fingerprint."""
    flips = masks(32, (radius // 2 + 1) // 2)
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    return nodes.select("node", "fp", _flips(low, flips).alias("key")).union(
        nodes.select("node", "fp", _flips(high.bitwiseOR(F.lit(1 << 40)), flips).alias("key")))


def with_partner(nodes: DataFrame, radius: int) -> DataFrame:
    """The rows of `nodes` (node, fp) one of whose halves comes close enough to that of another node."""
    keys = half_keys(nodes, radius)
    by = W.partitionBy("key").orderBy("fp")
    near = keys.select("node", "fp", *[F.lag("fp", k).over(by).alias(f"before{k}") for k in (1, 2)],
                       *[F.lead("fp", k).over(by).alias(f"after{k}") for k in (1, 2)])
    # two that meet alone are measured here, which removes chance meetings; of three and more all go on
    meets = [F.bit_count(F.col("fp").bitwiseXOR(F.col(c))) <= radius for c in ("before1", "after1")]
    crowd = F.expr("before2 is not null or after2 is not null or (before1 is not null and after1 is not null)")
    return near.where(F.coalesce(meets[0], F.lit(False)) | F.coalesce(meets[1], F.lit(False)) | crowd).select("node", "fp").distinct()


def close_nodes(nodes: DataFrame, radius: int, name: str) -> DataFrame:
    """The nodes that can have a partner, dealt out over all tasks."""
    if radius % 2:
        raise ValueError("the radius must be even: variants that meet are then within it without a further check")
    spread = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(with_partner(nodes, radius), f"{name}-close").repartition(spread, "node")


def ball_links(nodes: DataFrame, radius: int, name: str) -> DataFrame:
    """Links a, b between nodes (node, fp) that meet on a variant: each with the one before it in the variant's order."""
    close = close_nodes(nodes, radius, name)
    variants = close.select("node", _flips(F.col("fp"), masks(64, radius // 2)).alias("variant"))
    met = variants.select(F.col("node").alias("a"), F.lag("node").over(W.partitionBy("variant").orderBy("node")).alias("b"))
    return met.where("b is not null and a <> b").distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (smallest id reachable by links of at most `radius` bits) of every row."""
    rows = cut_lineage(fingerprints(docs, shingle_words, id_col, text_col), "simhash-rows")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    links = ball_links(distinct.select(F.col("fp").alias("node"), "fp"), radius, "simhash")
    joined = components(links, "simhash-components").withColumnRenamed("node", "fp")
    groups = cut_lineage(distinct.join(joined, "fp", "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("component")), "simhash-groups")
    smallest = groups.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_fp = groups.join(smallest, "component").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


# ------------------------------------------------------------------------------------ keeping one document of a group

def _set_of(value: bytes | None, n: int, cache: Cache) -> np.ndarray:
    """The distinct hashes of the runs of `n` words of a text, of the whole text if it is shorter; sorted."""
    words = WORD_BYTES.findall((value or b"").translate(LOWER_ASCII))
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.int64, len(words)).view(np.uint64)
    return np.unique(gram_hashes(h, min(n, len(words))))


def _shingle_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Cache(word_hash)
        for part, values in texts(batches, rows=128):
            sets = [_set_of(value, n, cache).view(np.int64) for value in values]
            cache.trim()
            yield pa.record_batch([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return run


def _repeats(n: int):
    """shingle and count, for the shingles that come in several of the texts held at once."""
    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        flat = np.concatenate(held)
        held.clear()  # one copy at a time
        flat.sort()
        values, more = np.unique(flat[1:][flat[1:] == flat[:-1]], return_counts=True)
        return pa.record_batch([pa.array(values.view(np.int64)), pa.array(more + 1)], ["shingle", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, held, size = Cache(word_hash), [], 0
        for _, values in texts(batches):
            for value in values:
                held.append(_set_of(value, n, cache))
                size += len(held[-1])
                if size > HELD_HASHES:
                    yield counted(held)
                    size = 0
            cache.trim()
        if held:
            yield counted(held)

    return run


def _prefixes(n: int, similarity: float, common: np.ndarray, counts: np.ndarray):
    """node, size of its set, and the first shingles of the set in the common order (rarest first) with their places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Cache(word_hash)
        for part, values in texts(batches, rows=128):
            keys, sizes, nodes = [], [], part.column(0).to_numpy()
            for value in values:
                h = _set_of(value, n, cache)
                sizes.append(len(h))
                if len(common) and len(h):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    h = h[np.argsort(np.where(common[at] == h, counts[at], 0), kind="stable")]
                # sets without shingles are equal: they meet on one key
                keys.append(h[: len(h) - ceil(similarity * len(h) - ROUNDING) + 1] if len(h) else np.zeros(1, np.uint64))
            cache.trim()
            lengths = [len(k) for k in keys]
            place = [np.arange(k) for k in lengths]
            yield pa.record_batch([
                pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(nodes, lengths)),
                pa.array(np.repeat(sizes, lengths).astype(np.int32)), pa.array(np.concatenate(place).astype(np.int32))],
                ["key", "node", "size", "place"])

    return run


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays of distinct values; two empty ones are equal."""
    shared = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - shared
    return F.when(every == 0, 1.0).otherwise(shared / every)


def meetings(narrow: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """key, node, size, place, weight: the shingles on which two or more nodes (node, text) of `narrow` can meet.

    Sets are put in one order of all shingles. Of two sets with a Jaccard similarity of at least `similarity` the first
    common shingle lies in both within the first size - ceil(similarity * size) + 1, so no pair is lost whatever the order
    is. Frequent shingles come last, as far as counts over parts of the table show them: that only saves meetings.
    `weight` is smaller the more meetings a node has.
    """
    heavy = narrow.mapInArrow(_repeats(shingle_words), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = heavy.orderBy(F.desc("n"), "shingle").limit(COMMON_SHINGLES).toArrow()
    common = top["shingle"].to_numpy().view(np.uint64)
    by_value = np.argsort(common)
    run = _prefixes(shingle_words, similarity, common[by_value], top["n"].to_numpy()[by_value])
    every = narrow.mapInArrow(run, "key long, node long, size int, place int").repartition("key")
    # one exchange by key serves the removal of repeats and the question which keys have several nodes
    once = every.groupBy("key", "node").agg(F.min("size").alias("size"), F.min("place").alias("place"))
    by = W.partitionBy("key")
    counted = once.withColumns({"low": F.min("node").over(by), "high": F.max("node").over(by), "n": F.count(F.lit(1)).over(by)})
    met = cut_lineage(counted.where("low <> high").drop("low", "high"), "near-meetings")
    weights = met.groupBy("node").agg((-F.sum("n")).alias("weight"))
    return met.drop("n").join(weights, "node")


def _word_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and a fingerprint over the distinct words of a text, which changes less under an edit than one over shingles."""
    cache = Cache(word_hash)
    for part, values in texts(batches):
        held = []
        for value in values:
            words = set(WORD_BYTES.findall((value or b"").translate(LOWER_ASCII)))
            held.append(mix(np.fromiter(map(cache.__getitem__, words), np.int64, len(words)).view(np.uint64)))
        cache.trim()
        yield pa.record_batch([part.column(0), pa.array(majority(held).view(np.int64), pa.int64())], ["node", "fp"])


def first_links(close: DataFrame, radius: int) -> DataFrame:
    """Links between each node and the first one it meets on a variant of a half, where both are within the radius."""
    by = W.partitionBy("key").orderBy("node")
    met = half_keys(close, radius).select(F.col("node").alias("a"), "fp", F.first("node").over(by).alias("b"), F.first("fp").over(by).alias("first_fp"))
    within = F.bit_count(F.col("fp").bitwiseXOR(F.col("first_fp"))) <= radius
    return met.where((F.col("a") != F.col("b")) & within).select("a", "b").distinct()


def chain_links(close: DataFrame, radius: int) -> DataFrame:
    """Links between neighbours on a variant that are not in one `group` yet; a link inside a group would change nothing."""
    variants = close.select("node", "group", _flips(F.col("fp"), masks(64, radius // 2)).alias("variant"))
    by = W.partitionBy("variant").orderBy("node")
    met = variants.select(F.col("node").alias("a"), "group", F.lag("node").over(by).alias("b"), F.lag("group").over(by).alias("other"))
    return met.where("group <> other").select("a", "b").distinct()


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The written `pairs` a, b whose `sets` (node, shingles) are at least `similarity` alike; only sets of their nodes move."""
    rows = pairs.count()
    if not rows:
        return pairs
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    needed = sized_join(sets, ends, "node", "left_semi", 2 * rows)
    left = needed.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = needed.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(left, "a").join(right, "b").where(jaccard(F.col("sa"), F.col("sb")) >= similarity).select("a", "b")


def ball_pairs(narrow: DataFrame, sets: DataFrame, similarity: float, radius: int) -> DataFrame:
    """Links a, b between nodes (node, text) of `narrow` that SimHash brings together and whose `sets` are alike.

    Fingerprints over words are looked up in balls as in `near_duplicates`; equal ones are one point, and their texts are
    compared with its first. A point is compared with the first it meets on a half, then on a full variant with the one
    before it where the two are in different groups.
    """
    marks = cut_lineage(narrow.mapInArrow(_word_marks, "node long, fp long").distinct(), "near-marks")
    points = marks.groupBy("fp").agg(F.min("node").alias("node"))
    close = close_nodes(points.select("node", "fp"), radius, "near-points")
    stars = marks.join(points.withColumnRenamed("node", "b"), "fp").where("node <> b").select(F.col("node").alias("a"), "b")
    firsts = cut_lineage(stars.union(first_links(close, radius)), "near-first-pairs")
    alike = cut_lineage(verified(firsts, sets, similarity), "near-first-links")
    groups = components(alike, "near-first-groups")
    labelled = close.join(groups, "node", "left").select("node", "fp", F.coalesce("component", "node").alias("group"))
    chained = cut_lineage(chain_links(labelled, radius), "near-chain-pairs")
    return alike.union(cut_lineage(verified(chained, sets, similarity), "near-chain-links"))


def similar_groups(met: DataFrame, sets: DataFrame, similarity: float, known: DataFrame | None = None) -> DataFrame:
    """node, component of the nodes linked by pairs whose `sets` (node, shingles) are at least `similarity` alike.

    A few nodes of each key, those with most meetings first, are compared with all others on the key that are in another
    group, then leave it; keys that have one group left are done. Links join groups before the next round, which takes
    four times as many nodes of a key at once, or more while that makes at most PER_MEETING pairs for each meeting of the
    first round. It ends when no key is left: then each meeting of two groups has been measured.
    `known` are links a, b of such pairs that are found already; their groups are there before the first round.
    """
    links, groups, at_once, most = known, None, 1, None
    wider = [4**k for k in range(1, 15)]
    if known is not None:
        groups = cut_lineage(components(known, "near-components"), "near-groups")
    while True:
        if groups is None:
            grouped = met.withColumn("group", F.col("node"))
        else:
            grouped = met.join(groups, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")
        several = grouped.groupBy("key").agg(
            F.min("group").alias("low"), F.max("group").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high")
        open_ = cut_lineage(grouped.join(several.select("key", "n"), "key"), "near-open")
        rows, largest, *made = open_.agg(
            F.count(F.lit(1)), F.max("n"), *[F.sum(F.least("n", F.lit(k))) for k in wider]).first()
        if not rows:
            break
        if most is None:
            most = PER_MEETING * rows
        else:
            at_once = max([at_once, *[k for k, n in zip(wider, made) if n <= most]])
        rank = F.row_number().over(W.partitionBy("key").orderBy("weight", "node"))
        hubs = cut_lineage(open_.withColumn("rank", rank).where(F.col("rank") <= at_once).drop("rank"), "near-hubs")
        hub = hubs.select("key", *[F.col(c).alias(f"hub_{c}") for c in ("node", "size", "place", "weight", "group")])
        both = F.col("size") + F.col("hub_size")
        after = F.least(F.col("size") - F.col("place"), F.col("hub_size") - F.col("hub_place"))  # can be shared from here on
        able = (F.least("size", "hub_size") >= similarity * F.greatest("size", "hub_size") - ROUNDING) & (
            after >= similarity / (1 + similarity) * both - ROUNDING)
        later = F.struct("weight", "node") > F.struct("hub_weight", "hub_node")
        pairs = cut_lineage(open_.join(hub, "key").where((F.col("group") != F.col("hub_group")) & later & able).select(
            F.col("node").alias("a"), F.col("hub_node").alias("b")).distinct(), "near-pairs")
        found = cut_lineage(verified(pairs, sets, similarity), "near-links")
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            groups = cut_lineage(components(links, "near-components"), "near-groups")
        if largest <= at_once:
            break
        last = hubs.groupBy("key").agg(F.max(F.struct("weight", "node")).alias("last"))
        met = open_.drop("group", "n").join(last, "key").where(F.struct("weight", "node") > F.col("last")).drop("last")
        at_once *= 4
    return groups if groups is not None else met.select("node", F.col("node").alias("component")).limit(0)


def one_of_each_group(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, radius: int = 4,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without near-duplicates: of each group the row with the smallest id stays (a missing id comes last).

    Equal texts are one node. Two nodes are linked when their sets of `shingle_words`-word shingles have a Jaccard
    similarity of at least `similarity`, and a group is a component of all such links. SimHash finds links first
    (`ball_pairs`); what lies beyond its radius is found exactly: `meetings` loses no pair, and `similar_groups` measures
    each that is not inside a group by then. Null texts count as empty; all columns of `docs` are kept
    as they are.
    """
    key = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    node = F.conv(F.substring("key", 1, 15), 16, 10).cast("long")
    keyed = docs.select(key.alias("key"), F.col(text_col).cast("binary").alias("text"))
    narrow = keyed.select(node.alias("node"), "text")
    met = cut_lineage(meetings(narrow, shingle_words, similarity), "near-met")
    chosen = narrow.join(met.select("node").distinct(), "node")
    one = chosen.groupBy("node").agg(F.first("text").alias("text"))
    sets = cut_lineage(one.mapInArrow(_shingle_sets(shingle_words), "node long, shingles array<long>"), "near-shingles")
    joined = similar_groups(met, sets, similarity, ball_pairs(narrow, sets, similarity, radius))

    counted = docs.select(key.alias("key"), F.col(id_col).alias("id")).groupBy("key", "id").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "n")).alias("best"))
    grouped = best.withColumn("node", node).join(joined, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    stay = cut_lineage(grouped.groupBy("component").agg(F.min(F.struct("best", "key")).alias("x")).select(
        F.col("x.key").alias("key"), F.col("x.best.id").alias("id"), F.col("x.best.n").alias("n")), "near-stay")
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"), F.col(id_col).alias("id"))
    kept = tagged.join(stay, (tagged["key"] == stay["key"]) & tagged["id"].eqNullSafe(stay["id"])).select(
        "row", tagged["key"], "n")
    single = kept.where("n = 1").select("row.*")
    repeated = kept.where("n > 1").groupBy("key").agg(F.first("row").alias("row")).select("row.*")
    return single.union(repeated)
