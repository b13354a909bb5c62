"""Integer clustering against plain Python integers, and the defined cases."""

import hashlib
import math
import random

import pytest

from ledgerlens.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, clusters=16, rounds=3, components=64):
    kept = [(v, [int(math.floor(64 * x)) if abs(x) < 1e100 else int(x) * 64 for x in e]) for v, e, _ in rows
            if e is not None and len(e) == components and all(x is not None and math.isfinite(x) for x in e)]
    first = sorted(kept, key=lambda r: hashlib.sha256(f"1:{'null' if r[0] is None else r[0]}".encode()).hexdigest())[:clusters]
    cents = [list(e) for _, e in first]

    def nearest():
        return [min((sum((a - b) ** 2 for a, b in zip(e, c)), k) for k, c in enumerate(cents)) for _, e in kept]

    for _ in range(rounds):
        at = nearest()
        for k in range(len(cents)):
            mine = [e for (_, e), (_, c) in zip(kept, at) if c == k]
            if mine:
                cents[k] = [sum(column) // len(mine) for column in zip(*mine)]
    at = nearest()
    total = [sum(d for d, c in at if c == k) for k in range(len(cents))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]

    def fits(x):
        return x if x < 2**63 else None

    every = fits(max(total)) and fits(sum(total)) if total else None
    return sorted((v is not None, v, c, fits(d), fits(total[c]), every, sha[c]) for (v, _), (d, c) in zip(kept, at))


def found(vectors, **kw):
    rows = centroids.report(*centroids.cluster(vectors, **kw)).collect()
    return sorted((r["vec_id"] is not None, r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"])
                  for r in rows)


def random_rows(rng, n, spread=1.0):
    middles = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(20)]
    return [(v, [m + rng.gauss(0, 0.1) * spread for m in rng.choice(middles)], v % 3) for v in range(n)]


def test_equal_to_plain_integers(spark):
    rows = random_rows(random.Random(1), 400)
    rows += [(1000, [0.5] * 63, 1), (1001, None, 1), (1002, [0.1] * 63 + [None], 1), (1003, [float("nan")] + [0.0] * 63, 1),
             (1004, [float("inf")] + [0.0] * 63, 1), (1005, [0.0] * 64, None), (1006, [0.0] * 64, 2)] + rows[:5]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3)) == plain(rows)


def test_components_beyond_64_bits(spark):
    rows = random_rows(random.Random(2), 60)
    rows += [(500, [1e30] * 64, 0), (501, [-1e30 + k for k in range(64)], 0), (502, [3e7] * 64, 0)]
    got, want = found(spark.createDataFrame(rows, SCHEMA), clusters=2), plain(rows, clusters=2)
    assert got == want
    assert None in {r[3] for r in want}


@pytest.mark.parametrize("n", [0, 1, 5])
def test_fewer_vectors_than_clusters(spark, n):
    rows = random_rows(random.Random(n), n)
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_null_id_and_ties(spark):
    rows = [(None, [0.25] * 64, 0)] + [(v, [(v % 2) / 2.0] * 64, 0) for v in range(40)]
    assert found(spark.createDataFrame(rows, SCHEMA), clusters=3) == plain(rows, clusters=3)


def test_products_follow_the_centroids(spark):
    """Kept products equal products taken anew, and only components that moved are touched."""
    rows, cents = centroids.cluster(spark.createDataFrame(random_rows(random.Random(4), 50), SCHEMA), clusters=4, rounds=2)
    for r in rows.collect():
        assert list(r["dots"]) == [sum(a * b for a, b in zip(r["x"], c)) for c in cents]
        assert r["distance"] == sum((a - b) ** 2 for a, b in zip(r["x"], cents[r["cluster"]]))
