"""Embedding near-duplicates by dual traversal of cover trees.

Vectors with cosine >= `threshold` are those whose unit vectors lie within eps = sqrt(2 - 2 * threshold). Trees have nested
levels of centres with halving radii; a pair of nodes is dropped when its centres are further apart than the two covering
radii and eps allow, so exactly the pairs within the threshold are left at the bottom.

The tree has two storeys. The upper one is built from a sample of at most `most_leaves` centres; every vector is put under the
nearest leaf of its label, the leaves' covering radii are taken over all vectors, and the dual traversal of this tree gives
the leaf pairs, and for each vector the leaves, that may hold partners. Leaves are cut into blocks of about `block_rows`
vectors, however large they are; the lower storey is a cover tree in each block. Vectors under two centres are within eps only
if their ways to the plane halfway between the centres make eps together, so of two leaves only the strips along that plane
meet: small ones are measured at once, others by traversing the trees with the vectors of the strips.

Blocks of neighbouring leaves make a tile of at most TILE_VALUES components. A task holds the trees of one tile, and the blocks
of about half of the other tiles pass through it one by one, so it holds a tile and a block however many vectors there are,
and a vector travels once for each tile it may meet, not for each block. Rows are dealt out and pairs measured in pieces.

Equal vectors of a label are one node with a count. A task reports how many vectors each node is linked to, and a spanning
forest of the links instead of all pairs, so a group of near copies costs its size, not its square.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do rows with a
null label or id; they report no links and themselves as component. Vectors of different length never link. Repeated rows
are vectors of their own; rows that share an id link like others and share the component. An empty table gives an empty
result. Only the id, vector and label columns are read, a few times over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ledgerlens.llm.common import sized_join
from ledgerlens.llm.components import components
from ledgerlens.session import cut_lineage

#: Above the rounding of a distance near 0, which is the root of that of a product.
SLACK = 1e-7
#: Components of the vectors in a tile: what a task holds.
TILE_VALUES = 1 << 24
#: Tiles of a label that has vectors enough for as many tasks, and blocks in the smallest of them.
TILES, TILE_BLOCKS = 4, 4
#: Numbers in a matrix of distances that is made at a time.
PIECE = 1 << 20
#: Pairs of vectors between two leaves that are measured without their trees.
STRIP = 1 << 20
#: Above so many the wider strip is cut up, each part to meet a strip of its own.
SPLIT = 1 << 16
#: Rows handed on at a time.
ROWS = 4096


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a @ b.T
    d *= -2
    d += 2
    np.maximum(d, 0, out=d)
    return np.sqrt(d, out=d)


def products(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the rows i of a with the rows j of b, as doubles."""
    out, step = np.empty(len(i)), max(1, PIECE // max(1, a.shape[1]))
    for k in range(0, len(i), step):
        x, y = a[i[k : k + step]].astype(np.float64, copy=False), b[j[k : k + step]].astype(np.float64, copy=False)
        out[k : k + step] = np.einsum("ij,ij->i", x, y)
    return out


class CoverTree:
    """Levels of centres over unit vectors: radii 1, 1/2, ... down to below `eps` / 2, then the points themselves.

    `levels` lists for each level the centres' points, their covering radii and the place of their parent one level up.
    Each centre of a level is a centre of all lower levels; a centre covers its children within the level's radius.
    With `norms` the points are divided by them whenever they are asked for.
    """

    def __init__(self, points: np.ndarray, eps: float, norms: np.ndarray | None = None):
        self.points, self.norms = points, norms
        n = len(points)
        unit = self.at(np.arange(n))
        apart = distances(unit, unit)
        np.fill_diagonal(apart, 0)
        nets, radius, centres, near = [np.zeros(1, np.int64)], 1.0, [0], apart[0]
        while radius > eps / 4 and len(centres) < n:
            open_ = np.flatnonzero(near > radius)
            while len(open_):
                c = int(open_[0])
                centres.append(c)
                near = np.minimum(near, apart[c])
                open_ = open_[near[open_] > radius]
            nets.append(np.array(centres))
            radius /= 2
        parents = [np.zeros(1, np.int64)]
        for upper, lower in zip(nets, nets[1:]):  # the upper net comes first in the lower one, and is its own parent
            new = lower[len(upper) :]
            parents.append(np.concatenate([np.arange(len(upper)), apart[np.ix_(new, upper)].argmin(axis=1)]))
        place = np.full(n, -1)
        place[nets[-1]] = np.arange(len(nets[-1]))
        rest = np.flatnonzero(place < 0)
        place[rest] = apart[np.ix_(rest, nets[-1])].argmin(axis=1)
        nets.append(np.arange(n))
        parents.append(place)
        covers, owner = [np.zeros(n)], np.arange(n)
        for net, parent in zip(nets[-2::-1], parents[:0:-1]):
            owner = parent[owner]
            cover = np.zeros(len(net))
            np.maximum.at(cover, owner, apart[np.arange(n), net[owner]])
            covers.append(cover)
        self.levels = list(zip(nets, covers[::-1], parents))

    def at(self, places: np.ndarray) -> np.ndarray:
        points = self.points[places]
        return points if self.norms is None else points.astype(np.float64) / self.norms[places][:, None]

    def level(self, k: int):
        """Level k; below the last one it stays the points themselves."""
        if k < len(self.levels):
            return self.levels[k]
        last = self.levels[-1]
        return last[0], last[1], np.arange(len(last[0]))

    def above(self, wanted: np.ndarray) -> list[np.ndarray]:
        """For each level whether a centre has a wanted point below it."""
        out = [wanted]
        for (net, _, _), (_, _, up) in zip(self.levels[-2::-1], self.levels[:0:-1]):
            has = np.zeros(len(net), bool)
            has[up[out[-1]]] = True
            out.append(has)
        return out[::-1]

    def owners(self) -> list[np.ndarray]:
        """For each level the place of the centre above each point."""
        out = [np.arange(len(self.points))]
        for _, _, up in self.levels[:0:-1]:
            out.append(up[out[-1]])
        return out[::-1]


def descend(a: CoverTree, b: CoverTree, eps: float, wanted_a: np.ndarray | None = None,
            wanted_b: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in either tree and which pairs of them may be within eps (with slack), by descending both level by level.

    Only wanted points count, if told. A place without a pair is left out from its level on.
    """
    rows, cols, alive = np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones((1, 1), bool)
    in_a = None if wanted_a is None else a.above(wanted_a)
    in_b = None if wanted_b is None else b.above(wanted_b)

    def below(tree, k, up, had, within):
        """Places on level k below those of the level above, and which of these each is below."""
        old = np.full(len(tree.level(k - 1)[0]), -1)
        old[had] = np.arange(len(had))
        old = old[up]
        if within is not None:
            old[~within[min(k, len(within) - 1)]] = -1
        here = np.flatnonzero(old >= 0)
        return here, old[here]

    for k in range(max(len(a.levels), len(b.levels))):
        (ca, ra, ua), (cb, rb, ub) = a.level(k), b.level(k)
        if k:
            (rows, p), (cols, q) = below(a, k, ua, rows, in_a), below(b, k, ub, cols, in_b)
            whole = alive.all()
            alive = np.ones((len(rows), len(cols)), bool) if whole else alive[np.ix_(p, q)]
        x, y, reach = a.at(ca[rows]), b.at(cb[cols]), rb[cols] + eps + SLACK
        if np.count_nonzero(alive) * 8 < alive.size:  # few pairs are left: measure those alone
            i, j = np.nonzero(alive)
            alive[i, j] = np.sqrt(np.maximum(2 - 2 * products(x, i, y, j), 0)) <= ra[rows][i] + reach[j]
        else:
            step = max(1, PIECE // max(1, len(cols)))
            for s in range(0, len(rows), step):
                far = distances(x[s : s + step], y)
                far -= ra[rows[s : s + step]][:, None]
                alive[s : s + step] &= far <= reach
        some, other = alive.any(axis=1), alive.any(axis=0)
        if not (some.all() and other.all()):
            rows, cols, alive = rows[some], cols[other], alive[np.ix_(some, other)]
        if not len(rows):
            break
    return rows, cols, alive


def close_pairs(a: CoverTree, b: CoverTree, eps: float, wanted_a: np.ndarray | None = None,
                wanted_b: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the point pairs within eps (with slack)."""
    rows, cols, alive = descend(a, b, eps, wanted_a, wanted_b)
    i, j = np.nonzero(alive)
    return rows[i], cols[j]


class Leaves:
    """The upper storey of one label and length: centres, radii, partner leaves, and the tile of each block."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres

    def nearest(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        leaf, far, step = np.zeros(len(unit), np.int64), np.zeros(len(unit)), max(1, PIECE // len(self.centres))
        for k in range(0, len(unit), step):
            d = distances(unit[k : k + step], self.centres)
            leaf[k : k + step], far[k : k + step] = d.argmin(axis=1), d.min(axis=1)
        return leaf, far

    def close(self, sizes: np.ndarray, radii: np.ndarray, eps: float, block_rows: int) -> None:
        """Partners by the upper storey's dual traversal; blocks in the order of the tree, cut into tiles of like size."""
        m, self.radii = len(self.centres), radii
        tree = CoverTree(self.centres, eps)
        owners = tree.owners()
        for k, ((net, _, parents), owner) in enumerate(zip(tree.levels, owners)):  # radii over all vectors below, not over the centres only
            full = np.zeros(len(net))
            np.maximum.at(full, owner, np.sqrt(np.maximum(2 - 2 * products(self.centres, np.arange(m), self.centres, net[owner]), 0)) + radii)
            tree.levels[k] = (net, full, parents)
        rows, cols, alive = descend(tree, tree, eps)
        self.partners = np.zeros((m, m), bool)
        self.partners[np.ix_(rows, cols)] = alive
        self.blocks = np.maximum(1, -(-sizes // block_rows))
        order = np.lexsort(owners[::-1])
        last = np.cumsum(self.blocks[order])
        self.start = np.zeros(m, np.int64)
        self.start[order] = last - self.blocks[order]
        ahead = np.cumsum(np.repeat(sizes[order] / self.blocks[order], self.blocks[order]))
        self.tiles = tiles(int(sizes.sum()), self.centres.shape[1], block_rows)
        self.tile = np.minimum(self.tiles - 1, (ahead - ahead[0]) * self.tiles // max(1, ahead[-1])).astype(np.int64)
        self.holds = np.zeros((m, self.tiles), np.float32)  # leaf, tile: whether it has a block there
        for leaf in range(m):
            self.holds[leaf, self.tile[self.start[leaf] : self.start[leaf] + self.blocks[leaf]]] = 1

    def reach(self, unit: np.ndarray, leaf: np.ndarray, far: np.ndarray, eps: float) -> np.ndarray:
        """vector, tile: whether a vector may have a partner in the tile."""
        out, step = np.zeros((len(unit), self.tiles), bool), max(1, PIECE // len(self.centres))
        for k in range(0, len(unit), step):
            here = leaf[k : k + step]
            d = distances(unit[k : k + step], self.centres)
            near = self.partners[here] & (d <= self.radii + (eps + SLACK))
            near &= in_strip(d, far[k : k + step, None], distances(self.centres[here], self.centres), eps)
            near[np.arange(len(here)), here] = True
            out[k : k + step] = near.astype(np.float32) @ self.holds > 0
        return out


def in_strip(to_other: np.ndarray, to_own: np.ndarray, between, eps: float) -> np.ndarray:
    """Whether a vector is within eps of those nearer to the other centre: twice its distance to the plane halfway, times `between`, is the difference of squares."""
    return to_other * to_other - to_own * to_own <= 2 * eps * between + SLACK


def tiles(n: int, width: int, block_rows: int) -> int:
    """Number of tiles for n vectors."""
    return max(1, -(-n * width // TILE_VALUES), min(TILES, n // (block_rows * TILE_BLOCKS)))


def holders(tile: np.ndarray, count: int) -> np.ndarray:
    """tile, other: whether the other tile's task is the one in which the two meet; each pair meets in one, all tasks have about as many."""
    other = np.arange(count)
    back = (tile[:, None] - other) % count
    return (back > 0) & ((2 * back < count) | (2 * back == count) & (other < tile[:, None]))


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _by_label(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """(label, length) and the places of its rows."""
    keys = np.stack([batch.column("label").to_numpy(), batch.column("vector").value_lengths().to_numpy()])
    order = np.lexsort(keys)
    cuts = np.flatnonzero((keys[:, order[1:]] != keys[:, order[:-1]]).any(axis=0)) + 1
    for rows in np.split(order, cuts) if len(order) else []:
        yield tuple(keys[:, rows[0]].tolist()), rows


def _assigned(shared):
    """leaf and distance of each node: the nearest leaf of its label; -1 where the sample has none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = shared.value
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                leaf, far = np.full(batch.num_rows, -1, np.int64), np.zeros(batch.num_rows)
                for key, rows in _by_label(batch):
                    if key in upper:
                        leaf[rows], far[rows] = upper[key].nearest(_unit(_matrix(batch.column("vector").take(pa.array(rows)))))
                yield pa.record_batch([*batch.columns, pa.array(leaf), pa.array(far)], [*batch.schema.names, "leaf", "far"])

    return run


def _dealt(shared, eps: float):
    """A row for each tile whose task a node goes to: the tile, whether it passes through, the node's block, the node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = shared.value
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                leaf, far = batch.column("leaf").to_numpy(), batch.column("far").to_numpy()
                spread = batch.column("spread").to_numpy()
                block, places, targets, passes = np.zeros(len(leaf), np.int64), [], [], []
                for key, rows in _by_label(batch):
                    if leaf[rows[0]] >= 0:
                        leaves = upper[key]
                        block[rows] = spread[rows] % leaves.blocks[leaf[rows]]
                        tile, count = leaves.tile[leaves.start[leaf[rows]] + block[rows]], leaves.tiles
                    else:  # no leaf: blocks and tiles by number
                        blocks, count = batch.column("blocks")[int(rows[0])].as_py(), batch.column("tiles")[int(rows[0])].as_py()
                        block[rows] = spread[rows] % blocks
                        tile = block[rows] * count // blocks
                    places.append(rows)
                    targets.append(tile)
                    passes.append(np.zeros(len(rows), bool))
                    if count > 1:
                        to = holders(tile, count)
                        if leaf[rows[0]] >= 0:
                            to &= leaves.reach(_unit(_matrix(batch.column("vector").take(pa.array(rows)))), leaf[rows], far[rows], eps)
                        x, y = np.nonzero(to)
                        places.append(rows[x])
                        targets.append(y)
                        passes.append(np.ones(len(x), bool))
                places, targets, passes = (np.concatenate(x) for x in (places, targets, passes))
                for s in range(0, len(places), ROWS):
                    here = places[s : s + ROWS]
                    some = batch.select(["label", "leaf", "far", "node", "weight", "vector"]).take(pa.array(here))
                    yield pa.record_batch([pa.array(targets[s : s + ROWS]), pa.array(passes[s : s + ROWS]), pa.array(block[here]), *some.columns],
                                          ["tile", "passing", "block", *some.schema.names])

    return run


class Block:
    """Nodes of one block and their cover tree; `first` is the place of the first one in its tile."""

    def __init__(self, leaf: int, parts: list[pa.RecordBatch], eps: float, first: int):
        self.leaf, self.first, self.eps = leaf, first, eps
        self.node, self.weight, self.far = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("node", "weight", "far"))
        self.raw = np.concatenate([_matrix(p.column("vector")) for p in parts])
        self.norms = np.linalg.norm(self.raw.astype(np.float64), axis=1)

    def __len__(self):
        return len(self.node)

    @cached_property
    def tree(self) -> CoverTree:
        return CoverTree(self.raw, self.eps, self.norms)

    def unit(self, places=slice(None)) -> np.ndarray:
        return self.raw[places].astype(np.float64) / self.norms[places][:, None]


def linked(a: Block, b: Block, threshold: float, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the place pairs that are linked."""
    ok = products(a.raw, i, b.raw, j) / (a.norms[i] * b.norms[j]) >= threshold
    if a is b:
        ok &= i != j
    return i[ok], j[ok]


def _roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    top = parent[x]
    while True:
        up = parent[top]
        if (up == top).all():
            return top
        parent[x] = top = up


def unite(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Join the sets of x[k] and y[k] for all k; the smallest place is the root."""
    while len(x):
        x, y = _roots(parent, x), _roots(parent, y)
        apart = x != y
        x, y = x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))


class Tile:
    """The blocks a task holds, leaf by leaf, their nodes' numbers of links and their sets so far."""

    def __init__(self, leaves: Leaves | None, threshold: float, eps: float):
        self.leaves, self.threshold, self.eps = leaves, threshold, eps
        self.blocks, self.links, self.parent, self.seen = [], None, None, (-1, None, None)

    def add(self, leaf: int, parts: list[pa.RecordBatch]) -> None:
        first = self.blocks[-1].first + len(self.blocks[-1]) if self.blocks else 0
        self.blocks.append(Block(leaf, parts, self.eps, first))

    def meet(self) -> None:
        """Put the blocks together and link them with each other."""
        n = sum(len(x) for x in self.blocks)
        self.links, self.parent = np.zeros(n, np.int64), np.arange(n)
        if not self.blocks:
            return
        leaf = np.array([x.leaf for x in self.blocks])
        self.runs = np.concatenate([[0], np.flatnonzero(leaf[1:] != leaf[:-1]) + 1, [len(leaf)]])  # first block of each leaf
        self.leaf = leaf[self.runs[:-1]]
        self.starts = np.array([self.blocks[k].first for k in self.runs[:-1]])
        self.raw, self.norms, self.far = (np.concatenate([getattr(x, c) for x in self.blocks]) for c in ("raw", "norms", "far"))
        if not (self.norms.min() > 1e-30 and self.norms.max() < 1e30):  # single precision does not hold such products
            self.raw = self.raw.astype(np.float64)
        for x in self.blocks:
            x.raw = self.raw[x.first : x.first + len(x)]
        for run, (lo, hi) in enumerate(zip(self.runs, self.runs[1:])):
            for k in range(lo, hi):
                b = self.blocks[k]
                for a, i, j in self.pairs(b, run + 1, k):
                    self.count(a, i, b.weight[j])
                    if a is not b:
                        self.count(b, j, a.weight[i])
                    unite(self.parent, a.first + i, b.first + j)
            for b in self.blocks[lo:hi]:
                b.__dict__.pop("tree", None)  # seldom asked for again

    def beside(self, leaf: int) -> tuple[np.ndarray, np.ndarray]:
        """Of all held nodes by how much the squared distance to the centre exceeds that to their own, and the least of each leaf."""
        if self.seen[0] != leaf:
            more = self.raw @ self.leaves.centres[leaf].astype(self.raw.dtype) / self.norms
            more *= -2
            more += 2 - self.far * self.far
            self.seen = leaf, more, np.fmin.reduceat(more, self.starts)
        return self.seen[1:]

    def pairs(self, b: Block, from_run: int = 0, from_block: int = 0) -> Iterator[tuple[Block, np.ndarray, np.ndarray]]:
        """A held block and the places of its nodes and of those of b that are linked, from a leaf and, in b's own, from a block on.

        Vectors x and y under the centres c and d are within eps only if |x - d|^2 - |x - c|^2 and |y - c|^2 - |y - d|^2 together
        are at most 2 eps |c - d|, since their sum is 2 (x - y)(c - d).
        """
        for run in np.flatnonzero(self.leaf == b.leaf):
            for a in self.blocks[max(from_block, self.runs[run]) : self.runs[run + 1]]:
                yield a, *linked(a, b, self.threshold, *close_pairs(a.tree, b.tree, self.eps))
        if self.leaves is None or from_run >= len(self.leaf):
            return
        ours, least = self.beside(b.leaf)
        unit, centres = b.unit(), self.leaves.centres[self.leaf[from_run:]]
        theirs = distances(unit, centres)
        theirs *= theirs
        theirs -= (b.far * b.far)[:, None]
        slack = SLACK + 4 * self.raw.shape[1] * np.finfo(self.raw.dtype).eps
        room = 2 * self.eps * distances(self.leaves.centres[b.leaf : b.leaf + 1], centres)[0] + slack
        left = room - np.fmin.reduce(theirs, axis=0)  # for the held nodes of each leaf
        short, least_product = unit.astype(self.raw.dtype), 1 - (self.eps + SLACK) ** 2 / 2 - slack
        open_ = self.leaves.partners[b.leaf, self.leaf[from_run:]] & (self.leaf[from_run:] != b.leaf) & ~(least[from_run:] > left)
        for run in np.flatnonzero(open_):
            lo, hi = self.runs[from_run + run], self.runs[from_run + run + 1]
            start, end = self.starts[from_run + run], self.blocks[hi - 1].first + len(self.blocks[hi - 1])
            here = ours[start:end]
            rows = np.flatnonzero(~(here > left[run]))
            cols = np.flatnonzero(~(theirs[:, run] > room[run] - np.fmin.reduce(here[rows]))) if len(rows) else rows
            if len(rows) * len(cols) > STRIP:  # many: by the trees
                wanted_a, wanted_b = np.zeros(end - start, bool), np.zeros(len(b), bool)
                wanted_a[rows], wanted_b[cols] = True, True
                for a in self.blocks[lo:hi]:
                    wanted = wanted_a[a.first - start :][: len(a)]
                    if wanted.any():
                        yield a, *linked(a, b, self.threshold, *close_pairs(a.tree, b.tree, self.eps, wanted, wanted_b))
            elif len(rows) and len(cols):
                cut = np.array_split(rows[np.argsort(here[rows])], min(4, len(rows))) if len(rows) * len(cols) > SPLIT else [rows]
                for part in cut:
                    if part is not rows:
                        cols = np.flatnonzero(~(theirs[:, run] > room[run] - here[part[0]]))
                    part = part + start
                    near = self.raw[part] @ short[cols].T >= (least_product * self.norms[part]).astype(self.raw.dtype)[:, None]
                    if not near.any():
                        continue
                    i, j = np.nonzero(near)
                    i, j = part[i], cols[j]
                    for a in self.blocks[lo:hi]:
                        mine = (i >= a.first) & (i < a.first + len(a))
                        if mine.any():
                            yield a, *linked(a, b, self.threshold, i[mine] - a.first, j[mine])

    def count(self, block: Block, places: np.ndarray, weights: np.ndarray) -> None:
        if len(places):
            self.links[block.first : block.first + len(block)] += np.bincount(places, weights, len(block)).astype(np.int64)

    def passed(self, leaf: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        """node, root, links of the nodes in a block that passes: its links with the held ones, one of which is the root."""
        if self.links is None:
            self.meet()
        b = Block(leaf, parts, self.eps, 0)
        links, met, ids = np.zeros(len(b), np.int64), np.full(len(b), -1), np.zeros(len(b), np.int64)
        for a, i, j in self.pairs(b) if self.blocks else ():
            self.count(a, i, b.weight[j])
            links += np.bincount(j, a.weight[i], len(b)).astype(np.int64)
            new = met[j] < 0
            met[j[new]], ids[j[new]] = a.first + i[new], a.node[i[new]]  # of several the last, for both alike
            unite(self.parent, a.first + i, met[j])
        some = met >= 0
        return found(b.node[some], ids[some], links[some])

    def held(self) -> Iterator[pa.RecordBatch]:
        """The same of the held nodes, once all others have passed."""
        if self.links is None:
            self.meet()
        if not self.blocks:
            return
        node = np.concatenate([x.node for x in self.blocks])
        some = np.flatnonzero(self.links)
        roots = _roots(self.parent, some) if len(some) else some
        for k in range(0, len(some), ROWS):
            yield found(node[some[k : k + ROWS]], node[roots[k : k + ROWS]], self.links[some[k : k + ROWS]])


def found(node: np.ndarray, root: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(node, pa.int64()), pa.array(root, pa.int64()), pa.array(links, pa.int64())], ["node", "root", "links"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Key (label, length, tile, passing, leaf, block) and rows of each block of rows in order."""
    key, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column("label").to_numpy(), batch.column("vector").value_lengths().to_numpy(), batch.column("tile").to_numpy(),
                         batch.column("passing").to_numpy(zero_copy_only=False), batch.column("leaf").to_numpy(), batch.column("block").to_numpy()])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
            this = tuple(keys[:, lo].tolist())
            if this != key and parts:
                yield key, parts
                parts = []
            key = this
            parts.append(batch.slice(lo, hi - lo))
    if parts:
        yield key, parts


def _compared(shared, threshold: float, eps: float):
    """Of the tiles in order, held blocks before passing ones: the nodes' numbers of linked vectors and a spanning forest of the links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, at = None, None
        for (label, width, number, passing, leaf, _), parts in _runs(batches):
            if at != (label, width, number):
                if tile is not None:
                    yield from tile.held()
                tile, at = Tile(shared.value[label, width] if leaf >= 0 else None, threshold, eps), (label, width, number)
            if not passing:
                tile.add(leaf, parts)
                continue
            out = tile.passed(leaf, parts)
            if out.num_rows:
                yield out
        if tile is not None:
            yield from tile.held()

    return run


def _sampled(picked: DataFrame) -> dict[tuple[int, int], Leaves]:
    """The upper storey from the picked nodes."""
    rows = picked.toArrow().combine_chunks()
    rows = rows.to_batches()[0] if rows.num_rows else pa.RecordBatch.from_pylist([], rows.schema)
    node = rows.column("node").to_numpy()
    out = {}
    for key, places in _by_label(rows):
        places = places[np.argsort(node[places], kind="stable")]
        out[key] = Leaves(_unit(_matrix(rows.column("vector").take(pa.array(places)))))
    return out


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, block_rows: int = 1024, most_leaves: int = 4096,
                    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark = vectors.sparkSession
    eps = math.sqrt(2 - 2 * threshold)
    single = isinstance(vectors.schema[vector_col].dataType, ArrayType) and isinstance(vectors.schema[vector_col].dataType.elementType, FloatType)
    kind = "float" if single else "double"  # single components stay so where they are stored; all sums are of doubles
    v = F.col(vector_col).cast(f"array<{kind}>")
    least, most, zero, beyond = F.array_min(v), F.array_max(v), F.lit(0.0).cast(kind), F.lit(float("inf")).cast(kind)
    # NaN is the largest value; array_contains is null where a null could be what it looks for
    finite = (most < beyond) & (least > -beyond) & ~F.array_contains(v, beyond)
    usable = F.coalesce(finite & ((least != 0) | (most != 0)), F.lit(False)) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    # + 0.0 makes the two zeros one value
    plain = F.when(F.array_contains(v, zero), F.transform(v, lambda x: (x + 0.0).cast(kind))).otherwise(v)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.when(usable, plain).alias("vector"))
    rows = rows.withColumn("node", F.when(F.col("vector").isNotNull(), F.xxhash64("label", "vector")))
    known = rows.where("node is not null")
    total = known.select("node").distinct().count()
    share = min(1.0, min(most_leaves, -(-total // block_rows)) / max(1, total))
    picked = known.where(F.pmod(F.xxhash64("node"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))).select("node", "label", "vector")
    upper = _sampled(picked.groupBy("node", "label", "vector").agg(F.count(F.lit(1)).alias("n")).drop("n"))  # about most_leaves vectors
    first = spark.sparkContext.broadcast(upper)
    nodes = known.groupBy("node", "label", "vector").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first_id"))
    stored = f"node long, label long, vector array<{kind}>, weight long, first_id long, leaf long, far double"
    placed = cut_lineage(nodes.mapInArrow(_assigned(first), stored), "embedding-placed")
    stats = placed.groupBy("label", F.size("vector").alias("width"), "leaf").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))
    stats = cut_lineage(stats, "embedding-leaves")
    sizes = {key: (np.zeros(len(x.centres), np.int64), np.zeros(len(x.centres))) for key, x in upper.items()}
    for r in stats.where("leaf >= 0").collect():  # a row for each leaf
        sizes[r.label, r.width][0][r.leaf], sizes[r.label, r.width][1][r.leaf] = r.n, r.radius
    for key, leaves in upper.items():
        leaves.close(*sizes[key], eps, block_rows)
    first.unpersist()
    second = spark.sparkContext.broadcast(upper)
    bare = stats.where("leaf < 0").select(
        F.col("label").alias("l"), F.col("width").alias("w"), F.ceil(F.col("n") / block_rows).cast("long").alias("blocks"),
        F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("width") / TILE_VALUES), F.least(F.lit(TILES), F.floor(F.col("n") / (block_rows * TILE_BLOCKS)))).cast("long").alias("tiles"))
    bare_rows, bare_tiles = bare.agg(F.count(F.lit(1)), F.coalesce(F.sum("tiles"), F.lit(0))).first()
    spread = F.pmod(F.xxhash64(F.col("node"), F.lit(7)), F.lit(1 << 40)).alias("spread")
    dealt = sized_join(placed, bare, (F.col("label") == F.col("l")) & (F.size("vector") == F.col("w")), "left", bare_rows).select(
        "node", "label", "weight", "vector", "leaf", "far", spread, "blocks", "tiles")
    key = ["label", "width", "tile"]
    met = dealt.mapInArrow(_dealt(second, eps), "tile long, passing boolean, block long, label long, leaf long, far double, node long, weight long, "
                           f"vector array<{kind}>").withColumn("width", F.size("vector"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(bare_tiles + sum(x.tiles for x in upper.values()), total // block_rows, 2_000))
    met = met.repartition(parts, *key).sortWithinPartitions(*key, "passing", "leaf", "block")
    found = cut_lineage(met.drop("width").mapInArrow(_compared(second, threshold, eps), "node long, root long, links long"), "embedding-found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select("node", "root"), "embedding-components")
    grouped = cut_lineage(placed.select("node", "weight", "first_id").join(links, "node", "left").join(joined, "node", "left").select(
        "node", "first_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component")),
        "embedding-groups")
    smallest = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_node = grouped.join(smallest, "component").select("node", "n_links", "component_id")
    out = rows.select("vec_id", "node").join(by_node, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
