"""Benchmark decontamination by SimHash over item-sized windows.

Windows of an item's length get a weighted SimHash and are looked up in a multi-index over the items: fingerprints are cut into
radius + 1 bit blocks, so two within the radius agree on at least one block whole. The exact weighted similarity of the two
bags of shingles (Dice, equal-sized windows) then decides.

At a similarity of 0.8 the radius is so wide that blocks are three or four bits and any fingerprint meets nearly all items.
Shingles therefore choose the items first, exactly: Dice s needs s / (2 - s) of an item's weight inside the window, so some
shingle of its rarest ones that weigh more than the rest is in the document. Only for these items a shared shingle says where
the item would start, and only that item's place in the index is asked.

A shingle of an item weighs ln(1 + items / items that have it), so phrases common to many items count little; a shingle that
the item has not weighs ln(1 + items). Both are counted over the whole benchmark in Spark and joined to the items, so blocks
change no result and a block holds the counts of its own shingles only.

Items are broadcast in blocks of about `block_items`; a larger benchmark takes more passes over the documents.

Defined cases: null and empty texts and items match nothing; an item of fewer words than a shingle is one shingle of its own
length; of repeated items and repeated rows each gets its own result; windows at the edge of a document are cut there; the
earliest of equally good windows is reported; empty tables give an empty result; ids that are no whole numbers are refused.
Only ids and texts are read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import LOWER_ASCII, WORD_BYTES, Cache, array_texts, gram_hashes, texts, whole_ids, word_hash
from ledgerlens.session import cut_lineage

TABLE_BITS = 20


def word_hashes(text: bytes | None, cache: Cache) -> np.ndarray:
    words = WORD_BYTES.findall((text or b"").translate(LOWER_ASCII))
    return np.fromiter(map(cache.__getitem__, words), np.int64, len(words)).view(np.uint64)


def grams_of(words: np.ndarray, shingle_words: int) -> np.ndarray:
    return gram_hashes(words, min(shingle_words, len(words)))


@dataclass
class Items:
    """A block of benchmark items with their fingerprints, the multi-index over them and the shingles that choose them."""

    ids: list
    words: list[np.ndarray]
    shingle_words: int
    radius: int
    similarity: float
    #: Items of the whole benchmark that have a shingle, for those that several have, and items in all; None: this block is all.
    having: dict[int, int] | None = None
    total: int | None = None
    weight: dict[int, float] = field(init=False)
    rare: dict[int, dict[int, list[int]]] = field(init=False)

    def __post_init__(self):
        self.sizes = [min(self.shingle_words, len(w)) for w in self.words]
        self.grams = [grams_of(w, self.shingle_words) for w in self.words]
        self.bags = [Counter(g.tolist()) for g in self.grams]
        having = Counter(g for bag in self.bags for g in bag) if self.having is None else self.having
        total = len(self.bags) if self.total is None else self.total
        self.weight = {g: math.log(1 + total / n) for g, n in having.items()}
        self.unknown = math.log(1 + total)  # also the weight of what one item has
        self.rare, self.tables = {}, {}
        for i, (bag, n) in enumerate(zip(self.bags, self.sizes)):
            for g in self.rarest(bag):
                self.rare.setdefault(n, {}).setdefault(g, []).append(i)
        for n, where in self.rare.items():
            table = np.zeros(1 << TABLE_BITS, bool)
            table[np.fromiter(where, np.uint64, len(where)) & np.uint64((1 << TABLE_BITS) - 1)] = True
            self.tables[n] = table
        self.prints = [self.fingerprint(bag, bag) for bag in self.bags]
        edges = np.linspace(0, 64, self.radius + 2).astype(int).tolist()
        self.blocks = [(a, (1 << (b - a)) - 1) for a, b in zip(edges, edges[1:]) if b > a]
        self.index: dict[tuple[int, int], set[int]] = defaultdict(set)
        for i, fp in enumerate(self.prints):
            for key in self.keys(fp):
                self.index[key].add(i)

    def keys(self, fp: int):
        return [(k, fp >> shift & mask) for k, (shift, mask) in enumerate(self.blocks)]

    def weigh(self, g: int, item: Counter) -> float:
        return self.weight.get(g, self.unknown) if g in item else self.unknown

    def rarest(self, item: Counter) -> list[int]:
        """Shingles that weigh more than a window at the similarity can do without, rarest first."""
        ordered = sorted(item, key=lambda g: (-self.weigh(g, item), g))
        weights = [self.weigh(g, item) * item[g] for g in ordered]
        spare = (1 - self.similarity / (2 - self.similarity)) * sum(weights) * (1 + 1e-9)
        out, held = [], 0.0
        for g, w in zip(ordered, weights):
            out.append(g)
            held += w
            if held > spare:
                break
        return out

    def fingerprint(self, bag: Counter, item: Counter) -> int:
        grams = np.fromiter(bag, np.uint64, len(bag))
        weights = np.array([self.weigh(g, item) * n for g, n in bag.items()])
        bits = np.unpackbits(grams.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
        up = weights @ (bits * 2 - 1) > 0
        return int(np.packbits(up, bitorder="little").view(np.uint64)[0])

    def alike(self, a: Counter, item: Counter) -> float:
        w = lambda bag: sum(self.weigh(g, item) * n for g, n in bag.items())
        shared = sum(self.weigh(g, item) * min(n, item[g]) for g, n in a.items() if g in item)
        return 2 * shared / (w(a) + w(item))

    def chosen(self, grams: np.ndarray, n: int) -> set[int]:
        """Items of shingle size `n` that have one of their rarest shingles among `grams`."""
        where, table = self.rare[n], self.tables[n]
        found = grams[table[grams & np.uint64((1 << TABLE_BITS) - 1)]]
        return {i for g in np.unique(found).tolist() for i in where.get(g, ())}

    def windows(self, i: int, ordered: np.ndarray, places: np.ndarray, words: int) -> set[tuple[int, int]]:
        """Where item `i` would lie if a shingle that it shares with the document were in its place."""
        low, high = np.searchsorted(ordered, self.grams[i], "left"), np.searchsorted(ordered, self.grams[i], "right")
        size = len(self.words[i])
        return {(max(0, p - k), min(words, p - k + size))
                for k in np.flatnonzero(high > low).tolist() for p in places[low[k] : high[k]].tolist()}

    def leaks(self, h: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """item -> best similarity, first word and words of its window, for items at or above the similarity."""
        found: dict[int, tuple[float, int, int]] = {}
        for n in self.rare:
            if len(h) < n:
                continue
            grams = gram_hashes(h, n)
            chosen = self.chosen(grams, n)
            if not chosen:
                continue
            places = np.argsort(grams, kind="stable")
            ordered = grams[places]
            for i in chosen:
                item = self.bags[i]
                for start, end in self.windows(i, ordered, places, len(h)):
                    bag = Counter(gram_hashes(h[start:end], min(n, end - start)).tolist())
                    fp = self.fingerprint(bag, item)
                    if any(i in self.index.get(key, ()) for key in self.keys(fp)) and (fp ^ self.prints[i]).bit_count() <= self.radius:
                        alike = self.alike(bag, item)
                        if alike >= self.similarity and (i not in found or (alike, -start) > (found[i][0], -found[i][1])):
                            found[i] = (alike, start, end - start)
        return found


def _item_shingles(shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Cache(word_hash)
        for part, values in texts(batches):
            words = [word_hashes(value, cache) for value in values]
            sets = [np.unique(grams_of(h, shingle_words)).view(np.int64) if len(h) else None for h in words]
            cache.trim()
            yield pa.record_batch([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["row", "shingles"])

    return run


def item_blocks(benchmark: DataFrame, shingle_words: int, radius: int, similarity: float, block_items: int, id_col: str, text_col: str):
    """The benchmark as `Items` of about `block_items` items each, one after the other."""
    # stored, so that rows keep the numbers that tell repeated items apart
    plain = cut_lineage(benchmark.select(
        F.monotonically_increasing_id().alias("row"), whole_ids(benchmark, id_col).alias("id"), F.col(text_col).cast("binary").alias("text")), "items")
    sets = cut_lineage(plain.select("row", "text").mapInArrow(_item_shingles(shingle_words), "row long, shingles array<long>")
                       .where("shingles IS NOT NULL"), "item-shingles")
    total = sets.count()
    blocks = max(1, -(-total // block_items))
    each = sets.select("row", F.explode("shingles").alias("g"))
    several = each.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    having = each.join(several, "g").groupBy("row").agg(F.collect_list(F.struct("g", "n")).alias("having"))  # as long as an item
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block")
    weighed = cut_lineage(plain.join(sets.select("row"), "row", "left_semi").join(having, "row", "left").select("*", block), "weighed-items")
    for b in range(blocks):
        rows = weighed.where(F.col("block") == b).orderBy("id", "text").collect()  # about block_items rows
        cache = Cache(word_hash)
        counts = {p.g & (1 << 64) - 1: p.n for r in rows for p in r.having or ()}
        yield Items([r.id for r in rows], [word_hashes(bytes(r.text), cache) for r in rows], shingle_words, radius, similarity, counts, total)


def _leak_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, cache = shared.value, Cache(word_hash)
        for part, values in texts(batches):
            out = [(row, items.ids[i], *found) for row, text in enumerate(values) for i, found in items.leaks(word_hashes(text, cache)).items()]
            cache.trim()
            yield pa.record_batch([
                part.column(0).take(pa.array([o[0] for o in out], pa.int64())), pa.array([o[1] for o in out], pa.int64()),
                pa.array([o[2] for o in out], pa.float64()), pa.array([o[3] for o in out], pa.int64()), pa.array([o[4] for o in out], pa.int64())],
                ["doc_id", "item_id", "similarity", "start_word", "n_words"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, shingle_words: int = 5, similarity: float = 0.8, radius: int = 20, block_items: int = 20_000,
          id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_words: one row for every document row and item found in it."""
    narrow = docs.select(whole_ids(docs, id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    out = None
    for items in item_blocks(benchmark, shingle_words, radius, similarity, block_items, item_id_col, item_text_col):
        found = narrow.mapInArrow(_leak_rows(docs.sparkSession.sparkContext.broadcast(items)),
                                  "doc_id long, item_id long, similarity double, start_word long, n_words long")
        out = found if out is None else out.union(found)
    return out


def _contaminated(shared):
    @F.arrow_udf("boolean")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, cache = shared.value, Cache(word_hash)
        for part in array_texts(parts):
            out = []
            for values in part:
                out += [bool(own.leaks(word_hashes(t, cache))) for t in values]
                cache.trim()
            yield pa.array(out, pa.bool_())

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, shingle_words: int = 5, similarity: float = 0.8, radius: int = 20,
                      block_items: int = 20_000, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """`docs` without the rows that contain a benchmark item, columns as they were."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    clean = docs.select(row, F.col(text_col).cast("binary").alias("text"))
    for items in item_blocks(benchmark, shingle_words, radius, similarity, block_items, item_id_col, item_text_col):
        clean = clean.where(~_contaminated(docs.sparkSession.sparkContext.broadcast(items))(F.col("text")))
    return clean.select("row.*")
