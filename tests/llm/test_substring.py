"""Repeated passages against a plain dictionary of windows."""

from __future__ import annotations

import hashlib
import random
import re

from ledgerlens.llm import queries, substring

SMALL = "/root/testdata/sf0.001"


def expected(rows, window):
    """For each (id, text) row: words, removed, hash of the kept words."""
    low = {}
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, words in split:
        for k in range(len(words) - window + 1) if i is not None else ():
            key = tuple(words[k : k + window])
            low[key] = min(i, low.get(key, i))
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - window + 1) if i is not None else ():
            if low[tuple(words[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_query_on_the_small_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = sorted([tuple(r) for r in queries.op9_substring_dedup(spark, SMALL).collect()], key=str)
    assert got == expected(rows, 50)
    assert sum(r[2] for r in got) > 0


def random_rows(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passage, rows = [word() for _ in range(70)], [(900, None), (901, ""), (902, "x " * 300), (903, "x " * 200), (None, "x " * 300)]
    for k in range(120):
        words = [word() for _ in range(rng.randrange(150))]
        at = rng.randrange(len(words) + 1)
        rows.append((rng.randrange(10_000), " ".join(words[:at] + passage[rng.randrange(5):rng.randrange(50, 70)] + words[at:])))
    for k in range(60):
        i, t = rows[rng.randrange(5, len(rows))]
        words = t.split()
        words[rng.randrange(len(words))] = word()
        rows.append((rng.choice([i, i + 1, 20_000 + k]), "\n".join(words)))
    return rows


def test_random_rows(spark, monkeypatch, tmp_path):
    rows = random_rows(3)
    docs = spark.createDataFrame([(i, t, 1, "a") for i, t in rows], "doc_id long, text string, doc int, anchor string").repartition(6)
    want = expected(rows, 50)
    for limit in (substring.SHARD_SEGMENTS, 3):
        monkeypatch.setattr(substring, "SHARD_SEGMENTS", limit)
        kept = substring.remove_repeats(docs, 50)
        got = sorted([(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in kept.collect()], key=str)
        assert got == want
    assert substring.remove_repeats(docs.limit(0), 50).count() == 0


def test_automaton_statistics():
    rng = random.Random(8)
    for _ in range(30):
        sequences = [[rng.randrange(3) for _ in range(rng.randrange(4, 40))] for _ in range(5)]
        automaton = substring.Automaton()
        for doc, s in enumerate(sequences):
            automaton.add(s, doc)
        automaton.settle()
        probe = [rng.randrange(3) for _ in range(50)]
        for s in [*sequences, probe]:
            want = []
            for k in range(len(s) - 3):
                have = [d for d, o in enumerate(sequences) if any(o[j : j + 4] == s[k : k + 4] for j in range(len(o)))]
                want.append(min(have) if have else None)
            assert automaton.stream(s, 4) == want
