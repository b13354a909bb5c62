"""Resolving free text against dictionaries and rosters, and vector search over an index."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.text import collapsed_key
from ledgerlens.session import cut_lineage

# similarity is 100 * (1 - edits / longer length); this threshold is our own, see the README
FUZZY_THRESHOLD = 85
SUGGESTIONS = 3


def vocabulary(df: DataFrame, column: str) -> DataFrame:
    """Distinct values, most frequent first."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count("*").alias("uses")).orderBy(F.desc("uses"), "value")


def similarity(a: Column, b: Column) -> Column:
    return (1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))) * 100


def edit_pairs(left: DataFrame, right: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """All (l, r) text pairs at least `threshold` similar, without comparing every pair.

    A pair within e edits shares one of any e + 1 pieces of the right text, at most e positions
    away. So right texts are cut into pieces and left texts into the substrings that could equal
    one; both sides meet in an equi-join and only those pairs are measured. No pair is missed.
    """
    slack = 1 - threshold / 100.0

    def edits(length: Column) -> Column:
        # the longer text of a pair has at most length / (1 - slack) letters
        return F.floor(F.lit(slack) * F.floor(length / (1 - slack) + 1e-9) + 1e-9).cast("int")

    def pieces(length: Column) -> Column:
        e = edits(length)
        n = F.least(e + 1, length)
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
            i.alias("i"), (F.floor(i * length / n) + 1).cast("int").alias("at"),
            (F.floor((i + 1) * length / n) - F.floor(i * length / n)).cast("int").alias("size")))

    r = right.select(F.col("r"), F.length("r").alias("n")).filter("n > 0").distinct()
    r = r.withColumn("p", F.explode(pieces(F.col("n")))).select(
        "r", "n", F.col("p.i").alias("i"), F.expr("substring(r, p.at, p.size)").alias("piece"))
    l = left.select(F.col("l"), F.length("l").alias("m")).filter("m > 0").distinct()
    low = F.ceil(F.col("m") * (1 - slack) - 1e-9).cast("int")
    high = F.floor(F.col("m") / (1 - slack) + 1e-9).cast("int")
    l = l.withColumn("n", F.explode(F.sequence(F.greatest(low, F.lit(1)), F.greatest(high, F.lit(1)))))
    l = l.withColumn("p", F.explode(pieces(F.col("n")))).withColumn("e", edits(F.col("n")))
    first = F.greatest(F.col("p.at") - F.col("e"), F.lit(1))
    last = F.least(F.col("p.at") + F.col("e"), F.col("m") - F.col("p.size") + 1)
    l = l.filter(last >= first).withColumn("at", F.explode(F.sequence(first, last))).select(
        "l", "n", F.col("p.i").alias("i"), F.expr("substring(l, at, p.size)").alias("piece")).distinct()
    pairs = l.join(r, ["n", "i", "piece"]).select("l", "r").distinct()
    return pairs.withColumn("score", similarity(F.col("l"), F.col("r"))).filter(F.col("score") >= threshold)


def resolve(texts: DataFrame, column: str, registry: DataFrame, value: str, aliases: DataFrame | None = None,
            threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """Each distinct text with its registry value: exact, else alias, else the most similar, else suggestions.

    Work is done once per distinct collapsed text; join the result back on the collapsed key.
    """
    asked = texts.select(collapsed_key(column).alias("asked")).filter("asked <> ''").distinct()
    values = registry.filter(F.col(value).isNotNull()).groupBy(collapsed_key(value).alias("key")).agg(F.min(value).alias("value"))
    exact = asked.join(values.select(F.col("key").alias("asked"), "value"), "asked").withColumn("confidence", F.lit("exact"))
    rest = asked.join(exact.select("asked"), "asked", "left_anti")
    found = exact.withColumn("score", F.lit(100.0))
    if aliases is not None:
        named = aliases.groupBy(collapsed_key("alias").alias("asked")).agg(F.min(collapsed_key("canonical")).alias("key"))
        by_alias = rest.join(named, "asked").join(values, "key").select("asked", "value", F.lit("alias").alias("confidence"), F.lit(100.0).alias("score"))
        rest = rest.join(by_alias.select("asked"), "asked", "left_anti")
        found = found.unionByName(by_alias)
    close = edit_pairs(rest.select(F.col("asked").alias("l")), values.select(F.col("key").alias("r")), threshold)
    best = close.groupBy("l").agg(F.min_by(F.struct("r", "score"), F.struct(-F.col("score"), F.col("r"))).alias("b"))
    fuzzy = best.select(F.col("l").alias("asked"), F.col("b.r").alias("key"), F.col("b.score").alias("score")).join(
        values, "key").select("asked", "value", F.lit("fuzzy").alias("confidence"), "score")
    missing = rest.join(fuzzy.select("asked"), "asked", "left_anti").select(
        "asked", F.lit(None).cast("string").alias("value"), F.lit("none").alias("confidence"), F.lit(None).cast("double").alias("score"))
    return found.unionByName(fuzzy).unionByName(missing)


#: Similarities at which suggestions are looked for by shared pieces; below the last one pieces would be single letters.
SUGGESTED_FROM = (70.0,)
ASKED_BLOCK, VALUE_BLOCK = 256, 2048


def suggestions(missing: DataFrame, registry: DataFrame, value: str, k: int = SUGGESTIONS, steps: tuple[float, ...] = SUGGESTED_FROM,
                asked_block: int = ASKED_BLOCK, value_block: int = VALUE_BLOCK) -> DataFrame:
    """The k registry values most similar to each unresolved text, out of all of them.

    With a falling threshold: all pairs of at least that similarity come from shared pieces, and a text that has k of them is
    done, since any other value is less similar. Texts that resemble nothing are left; those are compared with the whole
    registry, block with block, and a block keeps its k best.
    """
    values = cut_lineage(registry.select(collapsed_key(value).alias("key")).filter("key <> ''").distinct(), "suggested-values")
    rest = cut_lineage(missing.select("asked").filter("asked <> ''").distinct(), "suggested-texts")
    first = Window.partitionBy("asked").orderBy(F.desc("score"), "key")
    found = None
    for threshold in steps:
        pairs = edit_pairs(rest.select(F.col("asked").alias("l")), values.select(F.col("key").alias("r")), threshold).select(
            F.col("l").alias("asked"), F.col("r").alias("key"), "score")
        ranked = cut_lineage(pairs.withColumn("position", F.row_number().over(first)).filter(F.col("position") <= k), "suggested-pairs")
        enough = ranked.filter(F.col("position") == k).select("asked")
        done = ranked.join(enough, "asked", "left_semi")
        found = done if found is None else found.unionByName(done)
        rest = rest.join(enough, "asked", "left_anti")
    rest = cut_lineage(rest, "suggested-rest")
    asked_blocks, value_blocks = (max(1, -(-df.count() // size)) for df, size in ((rest, asked_block), (values, value_block)))

    def dealt(df: DataFrame, column: str, mine: int, other: int, names: tuple[str, str]) -> DataFrame:
        """Rows with their own block, once for each block of the other side."""
        own = F.pmod(F.xxhash64(column), F.lit(mine)).cast("int")
        return df.select(column, own.alias(names[0]), F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(names[1]))

    met = dealt(rest, "asked", asked_blocks, value_blocks, ("a", "v")).join(
        dealt(values, "key", value_blocks, asked_blocks, ("v", "a")), ["a", "v"])
    scored = met.select("asked", "v", F.struct((-similarity(F.col("asked"), F.col("key"))).alias("worst"), "key").alias("s"))
    some = scored.groupBy("asked", "v").agg(F.slice(F.array_sort(F.collect_list("s")), 1, k).alias("best"))  # at most one block each
    compared = some.select("asked", F.explode("best").alias("s")).select("asked", F.col("s.key").alias("key"), (-F.col("s.worst")).alias("score"))
    compared = compared.withColumn("position", F.row_number().over(first)).filter(F.col("position") <= k)
    every = compared if found is None else found.unionByName(compared)
    return every.select("asked", F.col("key").alias("suggestion"), "score", "position")


def resolve_roster(asked: DataFrame, column: str, roster: DataFrame, code: str, name: str, place: str, listed: int,
                   aliases: DataFrame | None = None, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """A code binds its entity; else a name as it is, an alias, "X of Y" with X a name, or the names similar enough.

    Each step takes only what the ones before left. Whoever bears a found name counts; one alone is bound, of several the
    first `listed` codes are named and `matches` says how many there are.
    """
    # each step is used by the ones after it, so it is written once
    texts = cut_lineage(asked.select(collapsed_key(column).alias("asked")).filter("asked <> ''").distinct(), "roster-texts")
    people = cut_lineage(roster.select(
        F.col(code).cast("string").alias("code"), collapsed_key(name).alias("name"), collapsed_key(place).alias("place")), "roster-people")
    names = cut_lineage(people.select("name").distinct(), "roster-names")
    anywhere = F.lit(None).cast("string").alias("want_place")
    by_code = cut_lineage(texts.join(people.select(F.col("code").alias("asked"), F.col("code").alias("hit")), "asked").select("asked", "hit"), "roster-codes")
    wanted: DataFrame | None = None
    rest = texts.join(by_code, "asked", "left_anti")

    def take(step: DataFrame) -> None:
        """Texts that a step resolves leave the rest."""
        nonlocal wanted, rest
        step = cut_lineage(step, "roster-step")
        wanted = step if wanted is None else wanted.unionByName(step)
        rest = cut_lineage(rest.join(step.select("asked").distinct(), "asked", "left_anti"), "roster-rest")

    take(rest.join(names.select(F.col("name").alias("asked")), "asked").select("asked", F.col("asked").alias("want_name"), anywhere))
    if aliases is not None:
        known = aliases.select(collapsed_key("alias").alias("asked"), collapsed_key("canonical").alias("want_name")).distinct()
        take(rest.join(known, "asked").select("asked", "want_name", anywhere))
    # every " of " is a place to split; those whose head is a name count
    words = F.split("asked", " of ")
    cuts = rest.filter(F.size(words) > 1).select("asked", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.struct(
            F.array_join(F.slice(words, 1, i), " of ").alias("want_name"),
            F.array_join(F.slice(words, i + 1, F.size(words)), " of ").alias("want_place")))).alias("c")).select("asked", "c.*")
    take(cuts.join(names.select(F.col("name").alias("want_name")), "want_name", "left_semi").select("asked", "want_name", "want_place"))
    close = edit_pairs(rest.select(F.col("asked").alias("l")), names.select(F.col("name").alias("r")), threshold)
    take(close.select(F.col("l").alias("asked"), F.col("r").alias("want_name"), anywhere))
    hits = cut_lineage(people.join(wanted, (F.col("name") == F.col("want_name")) & (
        F.col("want_place").isNull() | (F.col("place") == F.col("want_place")))).select("asked", "code"), "roster-hits")
    counts = hits.groupBy("asked").agg(F.count("*").alias("n"))
    order = [F.col("code").cast("long"), F.col("code")]
    salted = Window.partitionBy("asked", F.pmod(F.xxhash64("code"), F.lit(64))).orderBy(*order)
    some = hits.withColumn("rn", F.row_number().over(salted)).filter(F.col("rn") <= listed)
    first = some.withColumn("rn", F.row_number().over(Window.partitionBy("asked").orderBy(*order))).filter(
        F.col("rn") <= listed).groupBy("asked").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "code"))), lambda x: x["code"]).alias("codes"))
    named = texts.join(by_code.select("asked"), "asked", "left_anti").join(counts, "asked", "left").join(first, "asked", "left").select(
        "asked", F.coalesce("n", F.lit(0)).alias("matches"), "codes")
    coded = by_code.select("asked", F.lit(1).cast("long").alias("matches"), F.array("hit").alias("codes"))
    return coded.unionByName(named).select(
        "asked", "matches", F.when(F.col("matches") == 1, F.get("codes", F.lit(0))).alias("bound"),
        F.when(F.col("matches") > 1, F.concat_ws(",", "codes")).alias("candidates"))


QUERY_BLOCK = 1024
#: Most centres of a vector index; their vectors travel to the tasks.
MOST_CENTRES = 4096


def unit_rows(vectors) -> np.ndarray:
    """Vectors as rows of length one; a zero vector stays zero and resembles nothing."""
    matrix = np.array(list(vectors), dtype=float)
    norms = np.linalg.norm(matrix, axis=-1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


@dataclass
class VectorIndex:
    """Vectors stored by the centre they are nearest to, and how far each centre's vectors reach, as an angle."""

    cells: DataFrame  # centre, owner, vector
    sizes: DataFrame  # owner, vectors
    centres: np.ndarray
    radii: np.ndarray  # below zero: no vectors


def build_index(index: DataFrame, owner: str, vector: str, most_centres: int = MOST_CENTRES) -> VectorIndex:
    """Deal vectors to the nearest of about the square root of their number of centres, which are vectors picked by hash."""
    slim = index.filter(F.col(vector).isNotNull()).select(
        F.col(owner).cast("string").alias("owner"), F.col(vector).cast("array<double>").alias("vector"))
    n = slim.count()
    wanted = max(1, min(most_centres, math.isqrt(n)))
    picked = slim.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(wanted).collect()  # at most MOST_CENTRES rows
    centres = unit_rows(r["vector"] for r in picked) if picked else np.empty((0, 1))

    def dealt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                cosines = unit_rows(pdf["vector"]) @ centres.T
                at = cosines.argmax(axis=1)
                yield pd.DataFrame({"centre": at.astype(np.int32), "owner": pdf["owner"], "vector": pdf["vector"],
                                    "angle": np.arccos(np.clip(cosines[np.arange(len(at)), at], -1, 1))})

    placed = slim.mapInPandas(dealt, "centre int, owner string, vector array<double>, angle double")
    cells = cut_lineage(placed.repartitionByRange("centre", F.xxhash64("vector")).sortWithinPartitions("centre"), "vector-cells")
    radii = np.full(len(centres), -1.0)
    for r in cells.groupBy("centre").agg(F.max("angle").alias("radius")).collect():  # one row for each centre
        radii[r["centre"]] = r["radius"]
    return VectorIndex(cells.drop("angle"), slim.groupBy("owner").agg(F.count("*").alias("vectors")), centres, radii)


def search(index: VectorIndex, queries: DataFrame, k: int) -> DataFrame:
    """The k owners with the best cosine for each query, exactly: query, owner, score, vectors, position.

    No vector of a cell is nearer to a query than the query's angle to the centre less the cell's radius. So each query first
    visits its most promising cells; the k-th score found there bounds what a cell must be able to reach to be visited as
    well. `queries` (query, vector) may have any number of rows; they travel to the tasks in blocks of about QUERY_BLOCK.
    """
    spark = index.cells.sparkSession
    asked = queries.select("query", F.col("vector").cast("array<double>").alias("vector"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    found = None
    for b in range(blocks if len(index.centres) else 0):
        rows = asked.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).collect()  # about QUERY_BLOCK rows
        if not rows:
            continue
        names, matrix = [r["query"] for r in rows], unit_rows(r["vector"] for r in rows)
        reach = np.cos(np.maximum(np.arccos(np.clip(matrix @ index.centres.T, -1, 1)) - index.radii, 0))  # query by cell
        reach[:, index.radii < 0] = -2
        zero = ~matrix.any(axis=1)
        reach[np.ix_(zero, index.radii >= 0)] = 0  # a zero vector's cosines are zero
        first = np.zeros(reach.shape, bool)
        np.put_along_axis(first, np.argsort(-reach, axis=1, kind="stable")[:, : max(2, 2 * k // 3)], True, axis=1)
        first &= reach > -2
        near = _visit(index, names, matrix, first, k)
        floor = np.full(len(names), -2.0)
        at = {name: j for j, name in enumerate(names)}
        for r in near.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least")).collect():
            if r["n"] == k:
                floor[at[r["query"]]] = r["least"]
        more = ~first & (reach >= floor[:, None] - 1e-8) & (reach > -2)
        part = near.unionByName(_visit(index, names, matrix, more, k)) if more.any() else near
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "query string, owner string, score double")
    top = _best_owners(found, k)
    return top.join(index.sizes, "owner").select("query", "owner", "score", "vectors", "position")


def _best_owners(scores: DataFrame, k: int) -> DataFrame:
    best = scores.groupBy("query", "owner").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "owner")
    return best.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)


def _visit(index: VectorIndex, names: list[str], matrix: np.ndarray, wanted: np.ndarray, k: int) -> DataFrame:
    """The k best owners of each query among the cells it visits; each task sends k rows a query, once."""
    cells = np.flatnonzero(wanted.any(axis=0))
    visits = {int(c): np.flatnonzero(wanted[:, c]) for c in cells}
    rows = index.cells.filter(F.col("centre").isin([int(c) for c in cells]))

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict[str, float]] = [{} for _ in names]
        for pdf in frames:
            for centre, part in pdf.groupby("centre"):
                asking = visits[centre]
                best = pd.DataFrame(unit_rows(part["vector"]) @ matrix[asking].T).groupby(part["owner"].to_numpy()).agg("max")
                owners, values = best.index.to_numpy(), best.to_numpy()  # owners are sorted: a stable sort keeps the smaller of equals
                order = np.argsort(-np.round(values, 9), axis=0, kind="stable")[:k]
                for j, q in enumerate(asking):
                    mine = held[q]
                    for i in order[:, j]:
                        mine[owners[i]] = max(values[i, j], mine.get(owners[i], -2.0))
                    if len(mine) > k:
                        kept = sorted(mine, key=lambda o: (-round(mine[o], 9), o))[:k]
                        held[q] = {o: mine[o] for o in kept}
        out = [(names[q], str(o), float(v)) for q, mine in enumerate(held) for o, v in mine.items()]
        yield pd.DataFrame(out, columns=["query", "owner", "score"])

    found = rows.mapInPandas(scored, "query string, owner string, score double")
    return cut_lineage(_best_owners(found, k).drop("position"), "vector-visits")


def vector_top_k(index: DataFrame, owner: str, vector: str, queries: DataFrame, k: int) -> DataFrame:
    """The k owners with the best cosine for each query, from an index built for them; keep the index to search it again."""
    return search(build_index(index, owner, vector), queries, k)


# confidence zones of a ranked list
NO_MATCH_BELOW, TRUST_FROM, MARGIN = 0.30, 0.50, 0.015


def confidence_zone(top: DataFrame, no_match_below: float = NO_MATCH_BELOW, trust_from: float = TRUST_FROM, margin: float = MARGIN) -> DataFrame:
    """no_match, ambiguous or proceed from the first two scores of each query."""
    first = F.max(F.when(F.col("position") == 1, F.col("score")))
    second = F.max(F.when(F.col("position") == 2, F.col("score")))
    both = top.groupBy("query").agg(first.alias("first"), second.alias("second"))
    zone = (
        F.when(F.col("first").isNull() | (F.col("first") < no_match_below), "no_match")
        .when((F.col("first") < trust_from) & (F.col("first") - F.col("second") < margin), "ambiguous").otherwise("proceed"))
    return both.withColumn("zone", zone)


def recall_at(ranked: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """Share of queries whose gold owner is within the first k distinct owners, for each k."""
    hit = gold.join(ranked.select("query", F.col("owner").alias("gold"), "position"), ["query", "gold"], "left")
    one = hit.agg(F.count("*").alias("queries"), *[
        F.avg(F.coalesce((F.col("position") <= k).cast("double"), F.lit(0.0))).alias(str(k)) for k in ks])
    return one.unpivot(["queries"], [str(k) for k in ks], "k", "recall").withColumn("k", F.col("k").cast("int"))
