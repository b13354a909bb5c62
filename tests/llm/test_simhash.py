"""Fingerprints, links and groups against plain Python."""

from __future__ import annotations

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import queries, simhash
from ledgerlens.llm.components import components

SMALL = "/root/testdata/sf0.001"
BLANK = r"[^\x20\x09-\x0D]+"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def fingerprint(text, n=4):
    words = re.findall(BLANK, lower(text))
    grams = [" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))] if words else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows, linked):
    """Smallest id reachable, for (id, value) rows."""
    seen, out = set(), {}
    for start in sorted(rows):
        if start in seen:
            continue
        todo, group = [start], set()
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += [y for y in rows if y not in group and linked(rows[x], rows[y])]
        seen |= group
        out |= {x: min(group) for x in group}
    return out


def check(rows, texts):
    fps = {i: fingerprint(t) for i, t in texts.items()}
    groups = brute(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", groups[r.doc_id])


def test_query_on_the_small_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    check(queries.op10_simhash(spark, SMALL).collect(), texts)


def test_hard_texts(spark, tmp_path):
    rng = random.Random(5)
    base = [f"w{rng.randrange(900)}" for _ in range(400)]
    texts = {0: None, 1: "", 2: " \t\n", 3: "one", 4: "ONE", 5: "a b c", 6: "A  b\x0bc", 7: "É é É é É", 8: " ".join(base), 9: "x " * 30000}
    for k in range(10, 80):
        copy = list(base)
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(400)] = f"v{rng.randrange(900)}"
        texts[k] = " ".join(copy)
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, "q", 1) for i, t in texts.items()], "doc_id long, text string, fp string, node int").repartition(5).write.parquet(f"{folder}/documents.parquet")
    check(queries.op10_simhash(spark, folder).collect(), texts)


def test_empty_and_missing_ids(spark):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = simhash.near_duplicates(spark.createDataFrame([(None, "x y"), (7, "x y"), (None, "other words here now then"), (7, "x y")], schema)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in rows) == [(0, 0), (0, 7), (7, 7), (7, 7)]


def test_halves_lose_no_partner(spark):
    rng = random.Random(9)
    values = set()
    for _ in range(60):
        v = rng.getrandbits(64)
        values.add(v)
        for _ in range(3):
            w = v
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                w ^= 1 << b
            values.add(w)
    nodes = {k: v for k, v in enumerate(sorted(values))}
    frame = spark.createDataFrame([(k, simhash.signed(v)) for k, v in nodes.items()], "node long, fp long")
    got = {r.node: r.component for r in components(simhash.ball_links(frame, 4, "t")).collect()}
    want = brute(nodes, lambda a, b: (a ^ b).bit_count() <= 4)
    assert {k: got.get(k, k) for k in nodes} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 5001 + k) for k in range(200)]
    graph = {}
    for a, b in edges:
        graph.setdefault(a, set()).add(b)
        graph.setdefault(b, set()).add(a)
    want = {}
    for n in sorted(graph):
        if n not in want:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in want:
                    want[x] = n
                    todo += graph[x]
    frame = spark.createDataFrame(edges, "x long, y long").repartition(7)
    got = {r.node: r.component for r in components(frame).collect()}
    linked = {n for n in graph if graph[n] - {n}}
    assert got == {n: want[n] for n in linked}


def test_one_of_each_group(spark):
    rng = random.Random(3)
    prose = lambda n: [f"t{rng.randrange(5000)}" for _ in range(n)]
    rows, groups = [], {}
    for g in range(12):
        base = prose(120)
        rows.append((10 * g, " ".join(base), 1))
        rows.append((10 * g + 1, " ".join(base), 2))
        edited = list(base)
        edited[60] = "changed"
        rows.append((10 * g + 2, " ".join(edited), 3))
        groups[10 * g] = {10 * g, 10 * g + 1, 10 * g + 2}
    rows += [(500 + k, " ".join(prose(80)), 4) for k in range(20)] + [(None, "no id here at all", 5)] * 2 + [(900, None, 6), (901, "", 7), (902, "same row", 8), (902, "same row", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int").repartition(4)
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect())
    assert ids == sorted([*groups, *range(500, 520), -1, 900, 902])
