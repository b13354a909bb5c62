"""Centroid clustering on integers with a distance matrix that is kept and updated.

Each vector keeps its exact dot product with every centroid. When centroids move, a product changes by the sum of
`x[j] * change[j]` over the components that moved; components that stayed cost nothing. The squared distance is
`|x|^2 - 2 x.c + |c|^2`, and the nearest centroid is the least of them. A round is a narrow pass: it reads the stored
products, adds the changes, takes the minimum and stores products and cluster again in the shared folder, so a lost executor
costs one round. The sums of a cluster are added up inside each task and then by a combined aggregation; what meets on the
driver is `clusters x components` integers, never a vector.

Integers are exact whatever the components: if any reaches 2^27 after scaling, products are Python integers stored as text,
else 64-bit ones (64 such components give distances within 64 bits). Both give the same numbers.

Defined cases: vectors of another length, null vectors and those with a null or non-finite component are left out; rows that
share an id are clustered each (ties in the first centroids go by components); a null id counts as the text `null` in the
hash; fewer vectors than clusters give as many centroids as there are vectors; no vectors give no rows; a distance or sum
beyond a long is null. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import cut_lineage

SCALE = 64
#: 64 components below this bound give products and distances within 64 bits
NARROW = 1 << 27
LIMB = 48
LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Numbers:
    """How whole numbers are held: 64 bits, or Python integers that are stored as text."""

    wide: bool

    @property
    def dtype(self):
        return object if self.wide else np.int64

    @property
    def sql(self) -> str:
        return "string" if self.wide else "bigint"

    def scaled(self, e: np.ndarray) -> np.ndarray:
        """floor(64 * x) of doubles; scaling by a power of two is exact as long as it stays finite."""
        if not self.wide:
            return np.floor(e * SCALE).astype(np.int64)
        return np.array([[scaled(v) for v in row] for row in e.tolist()], dtype=object).reshape(e.shape)

    def matrix(self, column: pa.ListArray, width: int) -> np.ndarray:
        flat = column.flatten()
        values = np.array([int(v) for v in flat.to_pylist()], dtype=object) if self.wide else flat.to_numpy(zero_copy_only=False)
        return values.reshape(len(column), width)

    def lists(self, values: np.ndarray) -> pa.ListArray:
        flat = pa.array(map(str, values.ravel().tolist()), pa.string()) if self.wide else pa.array(values.ravel())
        return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), flat)


def scaled(value: float) -> int:
    top, bottom = value.as_integer_ratio()
    return top * SCALE // bottom


def usable(vectors: DataFrame, components: int) -> DataFrame:
    """vec_id and components as doubles of the vectors that take part."""
    e = F.col("embedding").cast("array<double>")
    fits = (F.size(e) == components) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.coalesce(fits, F.lit(False))).select("vec_id", e.alias("e"))


def first_centroids(rows: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The `clusters` rows that come first by the hash of their id: a top-k, so only so many leave."""
    name = F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), name).cast("binary"), 256)
    return [[scaled(v) for v in r["e"]] for r in rows.select(key.alias("key"), "e").orderBy("key", "e").limit(clusters).collect()]


def assign(rows: DataFrame, numbers: Numbers, centroids: list[list[int]], change: list[list[int]], stage: str) -> DataFrame:
    """Rows with their products moved by `change` and the nearest of `centroids`, stored.

    Rows without products (the first time) start from zero, so the first change is the centroids themselves.
    """
    width, dtype = len(centroids[0]), numbers.dtype
    moved = [[j for j, v in enumerate(row) if v] for row in change]
    begun = "dots" in rows.columns

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = [np.array([row[j] for j in js], dtype=dtype) for row, js in zip(change, moved)]
        lengths = np.array([sum(v * v for v in c) for c in centroids], dtype=dtype)
        for batch in batches:
            if not batch.num_rows:
                continue
            if begun:
                x = numbers.matrix(batch.column("x"), width)
                dots = numbers.matrix(batch.column("dots"), len(centroids)).copy()
            else:
                x = numbers.scaled(batch.column("e").flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
                dots = np.zeros((len(x), len(centroids)), dtype=dtype)
            for c, (js, step) in enumerate(zip(moved, steps)):
                if js:
                    dots[:, c] += x[:, js] @ step
            distance = (x * x).sum(axis=1)[:, None] - 2 * dots + lengths
            cluster = distance.argmin(axis=1)  # the first of equals: ties go to the smaller number
            least = distance[np.arange(len(x)), cluster].tolist()
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id"), numbers.lists(x), numbers.lists(dots), pa.array(cluster.astype(np.int32)),
                pa.array([v if v <= LONG else None for v in least], pa.int64()),
            ], names=["vec_id", "x", "dots", "cluster", "distance"])

    ids = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {ids}, x array<{numbers.sql}>, dots array<{numbers.sql}>, cluster int, distance bigint"
    return cut_lineage(rows.mapInArrow(products, schema), stage)


def moved_centroids(rows: DataFrame, numbers: Numbers, centroids: list[list[int]]) -> list[list[int]]:
    """floor(sum / count) of the rows of each centroid; one without rows stays."""
    width = len(centroids[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # component sums and the row count, one line for each centroid; sums are split into limbs so that they add up exactly
        total = np.zeros((len(centroids), width + 1), dtype=object)
        for batch in batches:
            x = numbers.matrix(batch.column("x"), width)
            cluster = batch.column("cluster").to_numpy()
            for c in np.unique(cluster):
                part = x[cluster == c]
                total[c, :width] += part.sum(axis=0)
                total[c, width] += len(part)
        out = []
        for (c, j), value in np.ndenumerate(total):
            value, k = int(value), 0
            while value not in (0, -1):
                out.append((c, j, k, value & ((1 << LIMB) - 1)))
                value, k = value >> LIMB, k + 1
            if value:
                out.append((c, j, k, value))
        columns = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([
            pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()),
            pa.array(columns[3], pa.int64())], names=["c", "j", "limb", "value"])

    found = (
        rows.select("x", "cluster").mapInArrow(sums, "c int, j int, limb int, value bigint")
        .groupBy("c", "j", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect())
    total = [[0] * (width + 1) for _ in centroids]
    for r in found:
        total[r["c"]][r["j"]] += int(r["value"]) << (LIMB * r["limb"])
    return [[v // t[width] for v in t[:width]] if t[width] else c for c, t in zip(centroids, total)]


def cluster(vectors: DataFrame, clusters: int = 16, rounds: int = 3, components: int = 64, seed: int = 1) -> tuple[DataFrame, list[list[int]]]:
    """Rows (vec_id, x, dots, cluster, distance) after the last assignment, and the centroids they were assigned to."""
    rows = usable(vectors, components)
    centroids = first_centroids(rows, clusters, seed)
    if not centroids:
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    largest = rows.agg(F.max(F.array_max(F.transform("e", F.abs)))).first()[0]
    numbers = Numbers(wide=largest * SCALE >= NARROW - 1)
    rows = assign(rows, numbers, centroids, centroids, "centroids-0")
    for k in range(1, rounds + 1):
        new = moved_centroids(rows, numbers, centroids)
        change = [[b - a for a, b in zip(old, c)] for old, c in zip(centroids, new)]
        centroids = new
        rows = assign(rows, numbers, centroids, change, f"centroids-{k}")
    return rows, centroids


def report(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster, distance, the distance summed over the cluster and over all, and a digest of the centroid."""
    found = rows.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), (F.count("*") - F.count("distance")).alias("beyond")).collect()
    sums = {r["cluster"]: None if r["beyond"] else int(r["total"]) for r in found}
    inertia = None if None in sums.values() else sum(sums.values())

    def fits(value: int | None):
        return F.lit(value if value is not None and value <= LONG else None).cast("long")

    by_cluster = F.array(*[fits(sums.get(c)) for c in range(len(centroids))], F.lit(None).cast("long"))
    digests = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids], F.lit(None).cast("string"))
    return rows.select("vec_id", "cluster", "distance", F.get(by_cluster, F.col("cluster")).alias("cluster_inertia"),
                       fits(inertia).alias("inertia"), F.get(digests, F.col("cluster")).alias("centroid_sha256"))
