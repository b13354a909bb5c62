"""Nearest examples and leaks against brute force, and accuracy on rows held out."""

from __future__ import annotations

import pickle
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate, queries, toxicity
from ledgerlens.llm.common import Cache, word_hash


def test_blocks_give_the_exact_neighbours():
    rng = random.Random(1)
    rows = []
    for _ in range(400):
        row = {rng.randrange(60): rng.random() for _ in range(rng.randrange(1, 6))}
        norm = sum(v * v for v in row.values()) ** 0.5
        rows.append({t: v / norm for t, v in row.items()})
    index = toxicity.Index(np.arange(400), np.zeros(400), rows, 10)
    for q in rows[:80]:
        at, cos = index.best(q)
        every = np.round([sum(w * r.get(t, 0) for t, w in q.items()) for r in rows], 9)
        kth = np.sort(every)[-10]
        want = {i for i in range(400) if every[i] >= kth and every[i] > 0}
        assert set(at.tolist()) == want
        assert np.allclose(cos, every[at])


def test_monotone_fit():
    cuts, levels = toxicity.monotone_fit(np.array([0.1, 0.2, 0.2, 0.4, 0.5]), np.array([0, 1, 0, 0, 1]))
    assert (np.diff(levels) >= 0).all() and len(cuts) == len(levels) and levels[-1] == 1


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scored = queries.op3_toxicity(spark, folder).cache()
    assert scored.count() == docs.count()
    assert scored.where("score < 0 or score > 1 or (score >= 0.5) <> (predicted = 1)").count() == 0
    held = scored.where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    assert sum(r.predicted == r.toxic for r in held) >= 0.94 * len(held)
    model = queries.toxicity_model(docs, labels)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == scored.where("predicted = 0").count()


def test_toxicity_defined_cases(spark):
    schema = "doc_id long, text string, score int, row string"
    docs = spark.createDataFrame([(1, None, 1, "a"), (2, "", 2, "b"), (None, "calm words", 3, "c")] + [(10 + k, "foul thing" if k % 2 else "calm thing", 0, None) for k in range(40)] * 2, schema)
    labels = spark.createDataFrame([(10 + k, k % 2) for k in range(40)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert got[1] == got[2] == got[None] == 0 and got[11] == 1 and got[10] == 0
    assert toxicity.drop_toxic(docs, model).count() == 43
    none = toxicity.fit(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def brute_leaks(docs, items, n, similarity):
    """Every window of an item's length that shares a shingle at the same place, compared with the item."""
    out = {}
    cache = Cache(word_hash)
    block = decontaminate.Items([i for i, _ in items], [decontaminate.word_hashes(t.encode(), cache) for _, t in items], n, 20, similarity)
    from collections import Counter

    from ledgerlens.llm.common import gram_hashes
    for doc, text in docs:
        h = decontaminate.word_hashes(text.encode() if text else None, cache)
        for i, (item, _) in enumerate(items):
            size = len(block.words[i])
            for start in range(-size + 1, len(h)):
                part = h[max(0, start) : start + size]
                g = min(n, size)
                own, theirs = gram_hashes(h, g) if len(h) >= g else [], gram_hashes(block.words[i], g)
                aligned = any(0 <= start + k < len(own) and own[start + k] == theirs[k] for k in range(len(theirs)))
                if aligned and len(part) >= g:
                    alike = block.alike(Counter(gram_hashes(part, g).tolist()), block.bags[i])
                    if alike >= similarity:
                        out[doc, item] = max(alike, out.get((doc, item), 0))
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(400)}"
    items = [(k, " ".join(word() for _ in range(rng.randrange(2, 50)))) for k in range(25)]
    docs = [(0, None), (1, ""), (2, "short")]
    for k in range(3, 60):
        words = [word() for _ in range(rng.randrange(0, 90))]
        planted = items[rng.randrange(25)][1].split()
        for _ in range(rng.randrange(3)):
            planted[rng.randrange(len(planted))] = word()
        at = rng.randrange(len(words) + 1)
        docs.append((k, " ".join(words[:at] + planted + words[at:])))
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([*items, (90, None), (91, "")], "item_id long, text string")
    want = brute_leaks(docs, items, 5, 0.8)
    assert len(want) > 20
    for block_items in (20_000, 7):
        rows = decontaminate.leaks(frame, bench, block_items=block_items).collect()
        got = {(r.doc_id, r.item_id): r.similarity for r in rows}
        assert len(rows) == len(got)
        if block_items > 25:
            assert got == pytest.approx(want)
    kept = decontaminate.drop_contaminated(frame, bench)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {d for d, _ in want}
    assert decontaminate.leaks(frame.limit(0), bench).count() == decontaminate.leaks(frame, bench.limit(0)).count() == 0


@pytest.mark.parametrize("block_items", [20_000, 7, 1])
def test_leaks_do_not_depend_on_blocks(spark, block_items):
    rng = random.Random(8)
    shared = " ".join(f"s{k}" for k in range(12))
    items = [(k, shared + " " + " ".join(f"w{rng.randrange(400)}" for _ in range(20))) for k in range(25)]
    docs = []
    for k in range(80):
        words = items[rng.randrange(25)][1].split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = "x"
        docs.append((k, " ".join(words)))
    want = brute_leaks(docs, items, 5, 0.8)
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(frame, bench, block_items=block_items).collect()}
    assert len(want) > 20 and got == pytest.approx(want)


def test_items_share_phrases_and_few_are_looked_at(spark):
    """Twenty thousand items with a common phrase: each document is held against the items it may contain, and no others."""
    rng = random.Random(11)
    phrase = "choose the one correct answer to the question below"
    cache = Cache(word_hash)
    texts = [f"{phrase} " + " ".join(f"w{rng.randrange(5_000)}" for _ in range(rng.randrange(12, 30))) for _ in range(20_000)]
    block = decontaminate.Items(list(range(20_000)), [decontaminate.word_hashes(t.encode(), cache) for t in texts], 5, 20, 0.8)
    looked = found = 0
    for k in range(0, 20_000, 400):
        words = (f"some text before {phrase} " + texts[k] + f" and after {phrase}").split()
        words[rng.randrange(20, len(words) - 12)] = "edited"
        h = decontaminate.word_hashes(" ".join(words).encode(), cache)
        looked += len(block.chosen(decontaminate.gram_hashes(h, 5), 5))
        window = h[3 + 9 : 3 + 9 + len(block.words[k])]  # behind "some text before" and the phrase
        alike = block.alike(Counter(decontaminate.gram_hashes(window, 5).tolist()), block.bags[k])
        assert (k in block.leaks(h)) == (alike >= 0.8)
        found += alike >= 0.8
    assert looked <= 100 and found > 15  # of 50 x 20,000 pairs


def test_choice_by_rarest_shingles_loses_nothing(spark):
    rng = random.Random(12)
    cache = Cache(word_hash)
    hashes = lambda words: decontaminate.word_hashes(" ".join(words).encode(), cache)
    items = [[f"w{rng.randrange(12)}" for _ in range(rng.randrange(1, 40))] for _ in range(60)]
    block = decontaminate.Items(list(range(60)), [hashes(w) for w in items], 3, 20, 0.8)
    for _ in range(300):
        i = rng.randrange(60)
        words = list(items[i])
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(12)}"
        n = block.sizes[i]
        grams = decontaminate.gram_hashes(hashes(words), n)
        if block.alike(Counter(grams.tolist()), block.bags[i]) >= 0.8:
            assert i in block.chosen(grams, n)


def test_ids_that_are_no_numbers_are_refused(spark):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    with pytest.raises(TypeError):
        decontaminate.leaks(spark.createDataFrame([("x", "a b")], "doc_id string, text string"), bench)


def test_index_leaves_its_input_behind():
    rows = [{t: 0.1 for t in range(k % 50, k % 50 + 20)} for k in range(2_000)]
    index = toxicity.Index(np.arange(2_000), np.zeros(2_000), rows, 10)
    assert len(pickle.dumps(index)) < 1.2 * sum(x.nbytes for x in (index.ids, index.toxic, index.at, index.weight, index.begin, index.highest))


def test_features_are_handed_on_in_parts(monkeypatch):
    monkeypatch.setattr(toxicity, "HELD_FEATURES", 1_000, raising=False)
    texts = [" ".join(f"w{(k * 7 + j) % 9_000}" for j in range(300)) for k in range(200)]
    batch = pa.record_batch([pa.array(texts), pa.array([k % 3 == 0 for k in range(200)])], ["text", "toxic"])
    parts = list(toxicity._feature_counts(iter([batch])))
    assert max(p.num_rows for p in parts) < 2_500 and len(parts) > 1
    got, want = Counter(), Counter()
    for p in parts:
        for feature, n1, n0 in zip(*[p.column(k).to_pylist() for k in range(3)]):
            got.update({(feature, True): n1, (feature, False): n0})
    for k, text in enumerate(texts):
        want.update((f, k % 3 == 0) for f in {f for w in set(toxicity.tokens(text)) for f in toxicity.word_features(w)})
    assert +got == want


def test_word_cache_is_small():
    cache = Cache(word_hash)
    for k in range(150_000):
        cache[b"%d" % k]
        cache.trim()
    assert len(cache) <= 100_000
