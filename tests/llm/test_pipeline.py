"""The stages, each held against plain Python on its own input."""

from __future__ import annotations

import random
import re

import corpus_pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerlens.llm import simhash

FOLDER = "/root/testdata/sf0.001"


def grams(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def test_stages_on_the_small_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    clean = docs.where("doc_id is not null")
    kept = steps["simhash_dedup"](spark, clean, FOLDER).collect()
    texts = {r.doc_id: grams(r.text) for r in clean.collect()}
    ids = {r.doc_id for r in kept}
    assert len(ids) == len(kept)
    alike = lambda a, b: len(a & b) / len(a | b) >= 0.8 if a | b else True
    for i, own in texts.items():
        if i not in ids:
            assert any(alike(own, other) for k, other in texts.items() if k != i)
    exact = {}
    for r in clean.collect():
        exact.setdefault(r.text or "", []).append(r.doc_id)
    assert all(len(ids & set(same)) <= 1 for same in exact.values())

    masked = steps["pii"](spark, docs, FOLDER)
    assert masked.schema == docs.schema and masked.count() == docs.count()
    assert masked.where(F.col("text").rlike("[a-z0-9]@[a-z0-9]+[.][a-z]")).count() == 0
    leaks = steps["decontamination"](spark, docs, FOLDER)
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    left = {r.doc_id for r in leaks.collect()}
    for r in docs.collect():
        if any(t in (r.text or "") for t in items if len(t.split()) > 5):
            assert r.doc_id not in left
        elif not any(grams(t) & grams(r.text) for t in items):
            assert r.doc_id in left


def test_run_packs_what_is_left(spark):
    packed = corpus_pipeline.run(spark, FOLDER)
    assert {"doc_id", "bin_id", "capacity", "n_tokens"} <= set(packed.columns)
    assert packed.count() > 0


def test_near_copies_of_a_large_group_leave_one(spark):
    rng = random.Random(6)
    base = [f"t{rng.randrange(9000)}" for _ in range(200)]
    rows = []
    for k in range(300):
        words = list(base)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(200)] = f"u{rng.randrange(9000)}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, " ".join(f"t{rng.randrange(9000)}" for _ in range(120))) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, docs, FOLDER).collect()}
    assert {k for k in kept if k >= 1000} == set(range(1000, 1100)) and len(kept) == 101


def kept_by_brute_force(texts):
    """Smallest ids of the components of all pairs >= 0.8, and the similarities of all linked or nearly linked pairs."""
    ids, sets = sorted(texts), {i: grams(t) for i, t in texts.items()}
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    near = {}
    for k, a in enumerate(ids):
        for b in ids[:k]:
            shared = len(sets[a] & sets[b])
            if shared and (value := shared / len(sets[a] | sets[b])) >= 0.6:
                near[a, b] = value
                if value >= 0.8:
                    ra, rb = root(a), root(b)
                    parent[max(ra, rb)] = min(ra, rb)
    return {root(i) for i in ids}, near


def edited(rng, words, edits):
    words = list(words)
    for k in rng.sample(range(len(words)), edits):
        words[k] = f"u{rng.randrange(10**6)}"
    return words


def near_kept(spark, texts):
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartition(6)
    return {r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, docs, FOLDER).collect()}


def test_star_groups_leave_what_all_pairs_leave(spark):
    """Copies are alike to their base only; the base has a middle, the largest or the smallest id."""
    rng = random.Random(11)
    texts = {}
    for star, at in enumerate((50, 100, 0)):
        base = [f"s{star}x{rng.randrange(9000)}" for _ in range(100)]
        for k in range(101):
            texts[1000 * star + k] = " ".join(base if k == at else edited(rng, base, 2))
    want, near = kept_by_brute_force(texts)
    assert sum(v < 0.8 for v in near.values()) > 2000 and len(want) < 10
    assert near_kept(spark, texts) == want


def test_no_pair_above_the_similarity_is_left(spark):
    """Pairs spread over 0.75 to 1, chains, short texts and a line that all share."""
    rng = random.Random(12)
    texts, line = {}, [f"line{k}" for k in range(12)]
    for k in range(300):
        size = rng.choice((20, 60, 120, 300, 600))
        base = [f"t{rng.randrange(90000)}" for _ in range(size)]
        texts[10 * k] = " ".join(line + base)
        texts[10 * k + 1] = " ".join(line + edited(rng, base, max(1, round(size * rng.uniform(0.0, 0.03)))))
    base = [f"c{rng.randrange(9000)}" for _ in range(150)]
    for k in range(40):
        texts[5000 + k] = " ".join(base)
        base = edited(rng, base, 2)
    texts |= {6000: "", 6001: " \n", 6002: "one", 6003: "One ", 6004: "one two", 6005: "a b c d e f"}
    want, near = kept_by_brute_force(texts)
    bands = [sum(low <= v < low + 0.05 for v in near.values()) for low in (0.8, 0.85, 0.9, 0.95)]
    assert min(bands) >= 20
    assert near_kept(spark, texts) - {6000, 6001} == want - {6000, 6001}


def test_simhash_brings_near_copies_together(spark):
    """Links of the SimHash step alone: all alike enough, and most of the light edits among them."""
    rng = random.Random(14)
    texts = {}
    for k in range(150):
        base = [f"t{rng.randrange(90000)}" for _ in range(300)]
        texts[2 * k], texts[2 * k + 1] = " ".join(base), " ".join(edited(rng, base, 2))
    texts |= {1000: " ".join(reversed(texts[0].split())), 1001: texts[2].upper()}
    narrow = spark.createDataFrame(sorted(texts.items()), "node long, text string").select("node", F.col("text").cast("binary").alias("text"))
    sets = narrow.mapInArrow(simhash._shingle_sets(5), "node long, shingles array<long>")
    found = {(max(r.a, r.b), min(r.a, r.b)) for r in simhash.ball_pairs(narrow, sets, 0.8, 4).collect()}
    _, near = kept_by_brute_force(texts)
    want = {pair for pair, value in near.items() if value >= 0.8}
    assert found <= want and len(found) >= 0.9 * len(want)


def test_stage_uses_simhash(spark, monkeypatch):
    """The near-dedup stage asks for SimHash links; a chain it cannot see whole is completed by the exact step."""
    seen, plain = [], simhash.ball_pairs
    monkeypatch.setattr(simhash, "ball_pairs", lambda *args: seen.append(args) or plain(*args))
    words = [f"w{k}" for k in range(60)]
    texts = {1: " ".join(words), 2: " ".join(words[:59] + ["x"]), 3: " ".join(f"y{k}" for k in range(30))}
    assert near_kept(spark, texts) == {1, 3} and len(seen) == 1


def rows_shuffled(frame):
    """Rows that the exchanges of a collected frame have written."""
    plan, found = frame._jdf.queryExecution().executedPlan(), 0
    todo = [plan.executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        elif node.nodeName() == "Exchange":
            found += node.metrics().apply("shuffleRecordsWritten").value()
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return found


def test_only_sets_of_pairs_are_moved(spark):
    """Pairs are measured without a shuffle of the sets of all other nodes."""
    rows = [(k, [100 * (k // 2) + j for j in range(9 + k % 2)]) for k in range(4000)]
    sets = spark.createDataFrame(rows, "node long, shingles array<long>")
    pairs = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "a long, b long")
    found = simhash.verified(pairs, sets, 0.8)
    assert sorted(map(tuple, found.collect())) == [(1, 0), (3, 2)]
    assert rows_shuffled(found) < 100
    assert simhash.verified(pairs.limit(0), sets, 0.8).count() == 0


def test_few_rounds_for_a_crowded_key(spark, monkeypatch):
    """Nodes that share one key and are all different are measured in a few rounds, each pair once."""
    rounds, plain = [], simhash.cut_lineage
    monkeypatch.setattr(simhash, "cut_lineage", lambda df, name: rounds.append(name) or plain(df, name))
    nodes = range(300)
    met = spark.createDataFrame([(7, k, 10, 0, -300) for k in range(20)] + [(100 + k // 2, k, 10, 0, -300) for k in nodes],
                                "key long, node long, size int, place int, weight long")
    sets = spark.createDataFrame([(k, [1000 * (k // 3) + j for j in range(10)]) for k in nodes], "node long, shingles array<long>")
    got = {r.node: r.component for r in simhash.similar_groups(met, sets, 0.8).collect()}
    parent = {}
    for k in nodes:
        for other in range(k):
            if k // 3 == other // 3 and (max(k, other) < 20 or k // 2 == other // 2):
                parent[k] = min(parent.get(k, k), parent.get(other, other))
                parent.setdefault(other, other)
    assert got == parent
    assert rounds.count("near-open") == 2


def test_stages_hand_texts_over_in_small_batches(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    sizes = lambda batches: (pa.record_batch([pa.array([b.num_rows])], ["n"]) for b in batches)
    docs = spark.range(0, 5_000, 1, 1).selectExpr("id as doc_id", "'a few words' as text")
    before = spark.conf.get(key)
    try:
        for setting, most in (("10000", 1_000), ("0", 1_000), ("200", 200)):
            spark.conf.set(key, setting)
            stage = corpus_pipeline.STAGES[3][1](spark, docs, FOLDER)
            found = stage.select("text").mapInArrow(sizes, "n long").collect()
            assert sum(r.n for r in found) == 5_000 and max(r.n for r in found) <= most
    finally:
        spark.conf.set(key, before)


def test_repeated_shingles_are_counted_by_parts(monkeypatch):
    import tracemalloc

    words = [b"w%d" % (k * 37 % 5_003) for k in range(400_000)]
    texts = [b" ".join(words[k : k + 2_000]) for k in range(0, 400_000, 2_000)]
    batch = pa.record_batch([pa.array(texts, pa.binary())], ["text"])
    got = {}
    for p in simhash._repeats(5)(iter([batch])):
        got.update(zip(p.column(0).to_pylist(), p.column(1).to_pylist()))
    cache = simhash.Cache(simhash.word_hash)
    values, counts = np.unique(np.concatenate([simhash._set_of(t, 5, cache) for t in texts]).view(np.int64), return_counts=True)
    assert got == {int(v): int(c) for v, c in zip(values, counts) if c > 1}

    monkeypatch.setattr(simhash, "_set_of", lambda value, n, cache: np.arange(len(value) * 1_000, dtype=np.uint64) + np.uint64(int(value)))
    batch = pa.record_batch([pa.array([b"%0400d" % (k * 400_000) for k in range(3)], pa.binary())], ["text"])
    tracemalloc.start()
    try:
        assert sum(p.num_rows for p in simhash._repeats(5)(iter([batch]))) == 0
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 3.2 * 8 * 1_200_000  # the held sets, one copy of them in order and little more
