"""Cover trees and links against all pairs."""

from __future__ import annotations

import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.llm import covertree, queries

SMALL = "/root/testdata/sf0.001"


def expected(rows, threshold=0.98):
    ok = [i for i, (v, e, l) in enumerate(rows) if v is not None and l is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    unit = {i: np.array(rows[i][1], float) for i in ok}
    near = {i: set() for i in range(len(rows))}
    for a in ok:
        for b in ok:
            if a != b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]):
                if unit[a] @ unit[b] / (np.linalg.norm(unit[a]) * np.linalg.norm(unit[b])) >= threshold:
                    near[a].add(b)
    out = []
    for i in range(len(rows)):
        group, todo = set(), [i]
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += near[x]
        ids = [rows[k][0] for k in group if rows[k][0] is not None]
        out.append((rows[i][0], len(near[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def test_query_on_the_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = queries.op7_embedding_dedup(spark, SMALL).collect()
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=str) == expected(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


@pytest.mark.parametrize("leaves", [1, 40])
def test_clusters_blocks_and_odd_rows(spark, leaves):
    rng = np.random.default_rng(2)
    rows, k = [], 0
    for label in (1, 2):
        for _ in range(14):
            base = rng.normal(size=12)
            for _ in range(rng.integers(1, 12)):
                rows.append((k, (base + rng.normal(size=12) * rng.choice([0.02, 0.05, 0.1])).tolist(), label))
                k += 1
    rows += [(500 + i, rows[0][1], 1) for i in range(9)] + [(600, [2 * x for x in rows[0][1]], 1), (601, rows[0][1], 2), (602, rows[0][1], None), (None, rows[0][1], 1)]
    rows += [(700, None, 1), (701, [0.0] * 12, 1), (702, [float("nan")] * 12, 1), (703, [None, 1.0], 1), (704, [float("inf"), 1.0], 1), (705, [1.0, 0.0], 1), (706, [1.0, 0.001], 1), (707, [], 1), (708, [-0.0, 3.0], 8), (709, [0.0, 3.0], 8)]
    rows.append(rows[5])
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, node int").repartition(5)
    got = covertree.near_duplicates(frame, block_rows=10 if leaves > 1 else 30, most_leaves=leaves).collect()
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=str) == expected(rows)
    assert covertree.near_duplicates(frame.limit(0)).count() == 0


def test_traversal_finds_all_close_pairs():
    rng = np.random.default_rng(3)
    points = rng.normal(size=(300, 6))
    points[150:] = points[:150] + rng.normal(size=(150, 6)) * 0.05
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    a, b = covertree.CoverTree(points[:200], 0.2), covertree.CoverTree(points[200:], 0.2)
    got = set(zip(*[x.tolist() for x in covertree.close_pairs(a, b, 0.2)]))
    want = set(zip(*[x.tolist() for x in np.nonzero(covertree.distances(points[:200], points[200:]) <= 0.2)]))
    assert got == want


class Sent:
    """Stands for a broadcast value."""

    def __init__(self, value):
        self.value = value


def batch(label, vectors, **columns):
    n, width = vectors.shape
    values = pa.array(vectors.ravel())
    vector = pa.FixedSizeListArray.from_arrays(values, width).cast(pa.list_(values.type))
    given = {"label": np.full(n, label), "node": np.arange(n), "weight": np.ones(n, np.int64)} | columns
    return pa.record_batch([*(pa.array(x) for x in given.values()), vector], [*given, "vector"])


@pytest.mark.parametrize("leaves,values", [(1, 400), (40, 300), (40, 3000), (200, 300)])
def test_many_tiles(spark, monkeypatch, leaves, values):
    monkeypatch.setattr(covertree, "TILE_VALUES", values)
    rng = np.random.default_rng(5)
    rows = []
    for label, groups in ((1, 90), (2, 12), (3, 30)):
        for _ in range(groups):
            base = rng.normal(size=10)
            rows += [((base + rng.normal(size=10) * 0.1 * (k > 0)).tolist(), label) for k in range(rng.integers(1, 6))]
    rows += [((np.ones(10) + rng.normal(size=10) * 0.04).tolist(), 2) for _ in range(120)]  # one large group, over several tiles
    rows += [([3.0, 1.0], 1), ([6.0, 2.0], 1), ([1.0, 3.0], 1)]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, (v, label) in enumerate(rows)]
    want = expected(rows)
    for kind in ("double", "float"):
        frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3)
        got = covertree.near_duplicates(frame, block_rows=8, most_leaves=leaves).collect()
        assert sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=str) == want


def test_vectors_travel_by_tile_in_pieces():
    rng, eps = np.random.default_rng(7), math.sqrt(0.04)
    points = rng.normal(size=(4500, 16))
    points = rng.permutation(covertree._unit(np.concatenate([points, points + rng.normal(size=points.shape) * 0.03])))
    leaves = covertree.Leaves(points[:60])
    leaf, far = leaves.nearest(points)
    leaves.close(np.bincount(leaf, minlength=60), np.array([far[leaf == k].max() for k in range(60)]), eps, 64)
    assert leaves.tiles == covertree.TILES < len(leaves.blocks)
    none = pa.array([None] * len(points), pa.int64())
    rows = batch(1, points, leaf=leaf, far=far, spread=rng.integers(0, 1 << 40, len(points)), blocks=none, tiles=none)
    out = list(covertree._dealt(Sent({(1, 16): leaves}), eps)(iter([rows])))
    assert max(x.num_rows for x in out) <= covertree.ROWS
    out = pa.Table.from_batches(out).to_pandas()
    assert sorted(out.node[~out.passing]) == list(range(len(points)))  # each is held once
    assert len(out) <= len(points) * (1 + covertree.TILES // 2)
    assert not out.duplicated(["tile", "node"]).any()
    at = {n: set(t) for n, t in out.groupby("node").tile}
    held = out[~out.passing].set_index("node").tile
    for x, y in zip(*np.nonzero(np.triu(covertree.distances(points, points) <= eps, 1))):
        if held[x] != held[y]:
            assert (held[y] in at[x]) != (held[x] in at[y])  # each pair within eps meets once


@pytest.mark.parametrize("kind", ["float32", "float64"])
@pytest.mark.parametrize("strip,split", [(0, 0), (1 << 20, 1 << 16), (1 << 20, 16)])
def test_blocks_of_different_leaves(monkeypatch, kind, strip, split):
    """Whether strips are measured at once or by the trees, all links are found; short and long vectors alike."""
    monkeypatch.setattr(covertree, "STRIP", strip)
    monkeypatch.setattr(covertree, "SPLIT", split)
    rng, eps = np.random.default_rng(9), math.sqrt(0.04)
    points = rng.normal(size=(700, 12))
    points = np.concatenate([points, points + rng.normal(size=points.shape) * 0.06, points[:1] + rng.normal(size=(300, 12)) * 0.1])
    points = (rng.permutation(points) * rng.choice([1, 1e-25, 1e25], size=(1700, 1))).astype(kind)
    unit = covertree._unit(points)
    cosines = unit @ unit.T
    leaves = covertree.Leaves(unit[:50])
    leaf, far = leaves.nearest(unit)
    leaves.close(np.bincount(leaf, minlength=50), np.array([far[leaf == k].max() for k in range(50)]), eps, 16)
    none = pa.array([None] * len(points), pa.int64())
    rows = batch(1, points, leaf=leaf, far=far, spread=rng.integers(0, 1 << 40, len(points)), blocks=none, tiles=none)
    dealt = pa.Table.from_batches(covertree._dealt(Sent({(1, 12): leaves}), eps)(iter([rows])))
    dealt = dealt.sort_by([(c, "ascending") for c in ("tile", "passing", "leaf", "block")])
    out = pa.Table.from_batches(covertree._compared(Sent({(1, 12): leaves}), 0.98, eps)(iter(dealt.to_batches(max_chunksize=100)))).to_pandas()
    got = out.groupby("node").links.sum().reindex(range(len(points)), fill_value=0)
    assert leaves.tiles > 1 and got.tolist() == ((cosines >= 0.98).sum(axis=1) - 1).tolist()
    assert set(out.root) <= set(out.node)


def test_near_copies_are_compared_in_little_memory():
    rng, eps = np.random.default_rng(8), math.sqrt(0.04)
    points = rng.normal(size=64) + rng.normal(size=(2048, 64)) * 0.02
    more = dict(tile=np.zeros(2048, np.int64), passing=np.arange(2048) >= 1024, leaf=np.full(2048, -1), block=np.arange(2048) // 1024, far=np.zeros(2048))
    tracemalloc.start()
    try:
        out = pa.Table.from_batches(covertree._compared(Sent({}), 0.98, eps)(iter([batch(1, points, **more)]))).to_pandas()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sorted(out.node) == list(range(2048)) and out.links.sum() == 1023 * 1024 + 2 * 1024 * 1024  # a passing block's own links are counted where it is held
    assert out.root.isin(range(1024)).all()
    assert peak < 200e6  # all pairs' vectors at once would be over 1 GB
