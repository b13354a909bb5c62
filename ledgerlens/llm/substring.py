"""Removal of long repeated passages, found with suffix automata over shards of reference text.

A word goes when a window of `window` words that covers it also starts in a document with a smaller id. Windows are judged on
the input. The work is cut down to the passages that can repeat before any automaton is built:

1. Each window is assigned the smallest hash among its runs of GRAM words (its anchor). Equal windows have the same anchor at
   the same place, so it is enough to compare the segments around equal anchors. Anchors thin the corpus to about one row per
   20 words; anchors of a single document end here, after a combined group-by.
2. Equal segments are one segment with its smallest document. An anchor all of whose segments are equal is settled by that.
3. The other segments form the reference shards, one for each anchor. Shards are dealt out by anchor instead of being
   broadcast whole, as the reference grows with the corpus. A shard's suffix automaton knows for each state the smallest
   document in which its words occur; its segments are streamed through it and each position's matching state, cut back to
   `window` words, gives the window's smallest document.
4. A very common passage has one anchor with ever new surroundings. Shards of over SHARD_SEGMENTS segments are not loaded
   into one task: their windows are settled by 128-bit window hashes in a combined group-by, which is exact up to a hash
   collision and the same rule.

Defined cases: null and empty texts have no words; a row without an id keeps all its words and is no source; rows that share
an id are one document, each judged by itself; blanks between kept words become one space; an empty table gives an empty
result; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import WORD_BYTES, Cache, gram_hashes, mix, texts, word_hash
from ledgerlens.session import cut_lineage

GRAM = 8
SHARD_SEGMENTS = 256
#: Words a worker keeps with their hashes; this operator goes over each word twice.
KNOWN_WORDS = 400_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def run_hashes(h: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hash of each run of words h[start : start + length], from prefix sums of a polynomial."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(_BASE, len(h)), dtype=np.uint64)])
    raw = (sums[starts + lengths] - sums[starts]) * _powers(_BASE_INVERSE, len(h) + 1)[starts]
    return mix(raw + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def anchors(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window, number of windows and segment hash of each run of windows with one anchor."""
    if len(h) < window:
        none = np.empty(0, np.int64)
        return none, none, none, none
    grams = gram_hashes(h, GRAM)
    width = window - GRAM + 1
    places = []
    for k in range(0, len(grams) - width + 1, 20_000):  # bounded memory for long texts
        part = grams[k : k + 20_000 + width - 1]
        view = np.lib.stride_tricks.sliding_window_view(part, width)
        places.append(view.argmin(axis=1) + np.arange(k, k + len(view)))
    place = np.concatenate(places)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    count = np.diff(np.concatenate([first, [len(place)]]))
    return grams[place[first]].view(np.int64), first, count, run_hashes(h, first, count + window - 1).view(np.int64)


def _hashes(text: bytes | None, cache: Cache) -> np.ndarray:
    words = WORD_BYTES.findall(text or b"")
    return np.fromiter(map(cache.__getitem__, words), np.int64, len(words)).view(np.uint64)


def _anchor_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Cache(word_hash, KNOWN_WORDS)
        for part, values in texts(batches, rows=256):
            found = [anchors(_hashes(v, cache), window) for v in values]
            cache.trim()
            rows = pa.array(np.repeat(np.arange(len(values)), [len(f[0]) for f in found]))
            yield pa.record_batch(
                [part.column(0).take(rows), part.column(1).take(rows)] + [pa.array(np.concatenate([f[k] for f in found]), pa.int64()) for k in (0, 3)]
                + [pa.array(np.concatenate([f[k] for f in found]), pa.int32()) for k in (1, 2)], ["doc", "mark", "anchor", "seg", "start", "n"])

    return run


def _segment_rows(window: int):
    """The words of the wanted segments of each document; a row with the same id and other words yields none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values in texts(batches, rows=128):
            out = []
            for doc, text, wanted in zip(part.column("doc").to_pylist(), values, part.column("wanted").to_pylist()):
                words = WORD_BYTES.findall(text or b"")
                for w in wanted:
                    out.append((w["anchor"], w["seg"], doc, b" ".join(words[w["start"] : w["start"] + w["n"] + window - 1])))
            yield pa.record_batch([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                  ["anchor", "seg", "doc", "words"])

    return run


class Automaton:
    """Suffix automaton over several word sequences; every state knows the smallest document its words occur in."""

    def __init__(self):
        self.next, self.link, self.length, self.low = [{}], [-1], [0], [float("inf")]

    def _state(self, length, edges, link, low) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.low.append(low)
        return len(self.next) - 1

    def _split(self, at: int, word, below: int) -> int:
        """A copy of state `below` for the words that reach it from `at` by `word` only."""
        copy = self._state(self.length[at] + 1, dict(self.next[below]), self.link[below], float("inf"))
        self.link[below] = copy
        while at >= 0 and self.next[at].get(word) == below:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def add(self, words: list, doc: int) -> None:
        last = 0
        for word in words:
            there = self.next[last].get(word)
            if there is not None:
                last = there if self.length[there] == self.length[last] + 1 else self._split(last, word, there)
            else:
                new = self._state(self.length[last] + 1, {}, 0, float("inf"))
                at = last
                while at >= 0 and word not in self.next[at]:
                    self.next[at][word] = new
                    at = self.link[at]
                if at >= 0:
                    there = self.next[at][word]
                    self.link[new] = there if self.length[there] == self.length[at] + 1 else self._split(at, word, there)
                last = new
            self.low[last] = min(self.low[last], doc)

    def settle(self) -> None:
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            up = self.link[state]
            self.low[up] = min(self.low[up], self.low[state])

    def stream(self, words: list, window: int) -> list[int | None]:
        """For each window of the sequence the smallest document that has it; None where no document does."""
        out, state, matched = [], 0, 0
        for k, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                matched += 1
            while self.length[self.link[state]] >= window:
                state = self.link[state]
                matched = self.length[state]
            if k >= window - 1:
                out.append(self.low[state] if matched >= window else None)
        return out


def _shard_rows(window: int):
    """Segments, in order of anchor, through the automaton of their anchor's shard."""
    def settled(anchor, shard):
        automaton = Automaton()
        ids: dict[bytes, int] = {}
        sequences = [[ids.setdefault(w, len(ids)) for w in words.split(b" ")] for _, _, words in shard]
        for (_, doc, _), sequence in zip(shard, sequences):
            automaton.add(sequence, doc)
        automaton.settle()
        return [(anchor, seg, automaton.stream(sequence, window)) for (seg, _, _), sequence in zip(shard, sequences)]

    def emit(rows):
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["anchor", "seg", "lows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, shard, out = None, [], []
        for batch in batches:
            for anchor, seg, doc, words in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                if anchor != current:
                    out += settled(current, shard) if shard else []
                    current, shard = anchor, []
                    if len(out) > 2_000:
                        yield emit(out)
                        out = []
                shard.append((seg, doc, words))
        yield emit(out + (settled(current, shard) if shard else []))

    return run


def _window_rows(window: int):
    """Two hashes of each window of a segment, with its place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Cache(word_hash, KNOWN_WORDS)
        for part, values in texts(batches, "words", rows=256):
            pieces = []
            for text in values:
                h = _hashes(text, cache)
                at = np.arange(max(0, len(h) - window + 1))
                size = np.full(len(at), window)
                pieces.append((at, run_hashes(h, at, size), run_hashes(mix(h), at, size)))
            cache.trim()
            rows = pa.array(np.repeat(np.arange(len(values)), [len(p[0]) for p in pieces]))
            flat = [np.concatenate([p[k] for p in pieces]) if pieces else np.empty(0) for k in range(3)]
            yield pa.record_batch([part.column(k).take(rows) for k in range(3)] + [
                pa.array(flat[0], pa.int32()), pa.array(flat[1].view(np.int64), pa.int64()), pa.array(flat[2].view(np.int64), pa.int64())],
                ["anchor", "seg", "doc", "at", "h1", "h2"])

    return run


def _kept_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values in texts(batches, rows=256):
            kept, n_words, n_removed = [], [], []
            for text, ranges in zip(values, part.column("ranges").to_pylist()):
                words = WORD_BYTES.findall(text or b"")
                gone = np.zeros(len(words) + 1, np.int64)
                for r in ranges or ():
                    at = np.arange(r["n"]) if r["hits"] is None else np.array(r["hits"], np.int64)
                    np.add.at(gone, at + r["start"], 1)
                    np.add.at(gone, at + r["start"] + window, -1)
                gone = np.cumsum(gone)[:-1] > 0
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join([words[k] for k in np.flatnonzero(~gone)] if n_removed[-1] else words))
            yield pa.record_batch([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())],
                                  ["doc_id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and the kept words of every row."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).cast("binary").alias("text"))
    schema = "doc long, mark long, anchor long, seg long, start int, n int"
    rows = cut_lineage(plain.where("doc is not null").mapInArrow(_anchor_rows(window), schema), "repeat-anchors")
    segments = rows.groupBy("anchor", "seg").agg(F.min(F.struct("doc", "mark", "start")).alias("first"), F.max("doc").alias("last"), F.first("n").alias("n"))
    segments = cut_lineage(segments, "repeat-segments")
    repeated = segments.groupBy("anchor").agg(F.count(F.lit(1)).alias("segs"), F.min("first.doc").alias("lo"), F.max("last").alias("hi")).where("lo < hi")
    wanted = cut_lineage(segments.join(repeated.select("anchor", "segs"), "anchor").select(
        "anchor", "seg", "segs", F.col("first.doc").alias("doc"), F.col("first.mark").alias("mark"), F.col("first.start").alias("start"), "n"), "repeat-wanted")

    alone = wanted.where("segs = 1").select("anchor", "seg", F.col("doc").alias("low"), F.lit(None).cast("array<long>").alias("lows"))
    asked = wanted.where("segs > 1").groupBy("doc", "mark").agg(F.collect_list(F.struct("anchor", "seg", "start", "n")).alias("wanted"))
    content = plain.join(asked, ["doc", "mark"]).select("doc", "text", "wanted").mapInArrow(
        _segment_rows(window), "anchor long, seg long, doc long, words binary").dropDuplicates(["anchor", "seg"])
    crowded = wanted.where(F.col("segs") > SHARD_SEGMENTS).select("anchor", "seg")
    content = cut_lineage(content, "repeat-content")
    few = content.join(crowded, ["anchor", "seg"], "left_anti")
    many = content.join(crowded, ["anchor", "seg"], "left_semi")
    shards = few.repartition("anchor").sortWithinPartitions("anchor", "doc", "seg").mapInArrow(
        _shard_rows(window), "anchor long, seg long, lows array<long>")
    windows = cut_lineage(many.mapInArrow(_window_rows(window), "anchor long, seg long, doc long, at int, h1 long, h2 long"), "repeat-windows")
    lows = windows.groupBy("h1", "h2").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
    earlier = windows.join(lows, (windows["h1"] == lows["h1"]) & (windows["h2"] == lows["h2"]) & (windows["doc"] > lows["low"])).groupBy(
        "anchor", "seg").agg(F.map_from_entries(F.collect_list(F.struct("at", "low"))).alias("low_at"))
    # a window without an earlier source has its own segment's first document as the smallest
    each = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.coalesce(F.try_element_at("low_at", k), F.col("doc")))
    hashed = wanted.where(F.col("segs") > SHARD_SEGMENTS).join(earlier, ["anchor", "seg"], "left").select(
        "anchor", "seg", each.alias("lows"))
    known = alone.unionByName(shards.unionByName(hashed).withColumn("low", F.lit(None).cast("long")))
    known = cut_lineage(known, "repeat-known")

    hits = F.filter(F.sequence(F.lit(0), F.size("lows") - 1), lambda k: F.col("lows")[k] < F.col("doc"))
    judged = rows.join(known, ["anchor", "seg"]).select(
        "doc", "mark", "start", "n", F.col("low") < F.col("doc"), F.when(F.col("lows").isNotNull(), hits).alias("hits")).toDF(
        "doc", "mark", "start", "n", "whole", "hits")
    ranges = judged.where("whole or size(hits) > 0").distinct().groupBy("doc", "mark").agg(
        F.collect_list(F.struct("start", "n", "hits")).alias("ranges"))
    out = plain.join(ranges, ["doc", "mark"], "left").select("doc", "text", "ranges").mapInArrow(
        _kept_rows(window), "doc_id long, n_words long, n_removed long, kept binary")
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))
