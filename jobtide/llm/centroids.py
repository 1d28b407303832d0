"""Centroid clustering of vectors in whole numbers, with Ptolemaic pivots.

Components become integers, so distances, sums and means are exact and do not depend on how
rows are dealt to tasks. Pivots are fixed, and every vector's distances to them are stored with
it once. In each round a centroid needs its distances to the pivots only: for a pair of pivots
p and q, Ptolemy's inequality

    d(x, c) * d(p, q) >= | d(x, p) * d(c, q) - d(x, q) * d(c, p) |

gives a lower bound on the distance of vector and centroid, rounded down by more than all
errors of the floating point it is computed in. The centroid of the least bound is measured
first; those whose bound lies above the best distance are left out, the others are measured
exactly. Ties go to the smaller number.

A round is one pass over the stored vectors: tasks add up their vectors by cluster, and only
sums by cluster and component are shuffled, one row each per task. The driver holds the
centroids. Sums are kept in limbs of 30 bits, so that components of any size stay exact.

Defined results: vectors that are null, of another length, or with null or non-finite components
are left out. A null id counts as '' in the order of the first centroids; equal ids are ordered by their
components. Repeated rows are vectors of their own. With fewer vectors than centroids there are
as many centroids as vectors. An empty table gives an empty table. A distance or inertia beyond
a long is null. Result columns replace columns of the same names.
"""

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.llm import scratch

RESULTS = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
# Components up to this are added and multiplied as 64-bit integers.
SMALL = 1 << 27
_LIMB = 30
_LONGEST = (1 << 63) - 1
# More than the relative errors of a bound's few operations together.
_SLACK = 2.0 ** -49

Vector = list[int]


def _whole_numbers(batches: Iterator[pa.RecordBatch], embedding: str, size: int, scale: int):
    """Batches of the vectors that are kept, and their components as an array of whole doubles."""
    for batch in batches:
        vectors = batch.column(embedding)
        offsets = vectors.offsets.to_numpy()
        fits = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False) & (np.diff(offsets) == size))
        # null components become NaN
        every = vectors.values.to_numpy(zero_copy_only=False).astype(float)
        place = offsets[fits][:, None] + np.arange(size)
        numbers = np.floor(scale * every[place]) if len(fits) else np.zeros((0, size))
        good = np.isfinite(every[place]).all(axis=1) if len(fits) else np.zeros(0, bool)
        yield batch.take(pa.array(fits[good])), numbers[good]


def squared_distances(numbers: np.ndarray, centroid: Vector) -> np.ndarray:
    """Exact squared distances; as Python integers where 64 bits may not hold them."""
    if numbers.dtype == np.int64:
        difference = numbers - np.array(centroid, np.int64)
        return np.einsum("ij,ij->i", difference, difference)
    difference = numbers - np.array(centroid, object)
    return (difference * difference).sum(axis=1)


def _exact_parts(numbers: np.ndarray, centroids: list[Vector]):
    """Rows in two parts: those whose distances fit 64 bits, and the others as Python integers."""
    small = np.abs(numbers).max(axis=1, initial=0) <= SMALL
    if any(abs(v) > SMALL for c in centroids for v in c):
        small[:] = False
    rows = np.flatnonzero(small)
    if len(rows):
        yield rows, numbers[rows].astype(np.int64)
    rows = np.flatnonzero(~small)
    if len(rows):
        exact = np.array([[int(v) for v in row] for row in numbers[rows].tolist()], object)
        yield rows, exact


class Pivots:
    """Fixed pivots, and which pairs of them give bounds."""

    def __init__(self, vectors: list[Vector], pairs: int):
        self.vectors = vectors
        far = sorted(((_root(_squared(p, q)), i, j) for i, p in enumerate(vectors)
                      for j, q in enumerate(vectors[:i])), reverse=True)
        # each pivot with its farthest one, then the farthest pairs left
        first = {max((f for f in far if i in f[1:]), default=None) for i in range(len(vectors))} - {None}
        ordered = sorted(first, reverse=True) + [f for f in far if f not in first]
        self.pairs = [(i, j, d) for d, i, j in ordered if d > 0][:pairs]

    def distances(self, numbers: np.ndarray) -> np.ndarray:
        """The distance of each row to each pivot, correct to a few units in the last place."""
        out = np.empty((len(numbers), len(self.vectors)))
        for rows, exact in _exact_parts(numbers, self.vectors):
            for i, pivot in enumerate(self.vectors):
                out[rows, i] = np.sqrt(squared_distances(exact, pivot).astype(float))
        return out

    def lower_bounds(self, known: np.ndarray, centroids: list[Vector]) -> np.ndarray:
        """For each row and centroid, a number that the squared distance is not below."""
        near = np.array([[_root(_squared(c, p)) for p in self.vectors] for c in centroids])
        best = np.zeros((len(known), len(centroids)))
        for i, j, apart in self.pairs:
            one = known[:, i, None] * near[None, :, j]
            two = known[:, j, None] * near[None, :, i]
            np.maximum(best, (np.abs(one - two) - (one + two) * _SLACK) * ((1 - _SLACK) / apart), out=best)
        return best * best * (1 - _SLACK)


def _squared(a: Vector, b: Vector) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def _root(square: int) -> float:
    return math.sqrt(float(square))


def nearest(numbers: np.ndarray, known: np.ndarray, centroids: list[Vector], pivots: Pivots):
    """The nearest centroid of each row, the squared distance, and how many were measured in all."""
    bounds = pivots.lower_bounds(known, centroids)
    cluster = np.zeros(len(numbers), np.int32)
    distance = np.zeros(len(numbers), object)
    measured = 0
    for rows, exact in _exact_parts(numbers, centroids):
        bound = bounds[rows]
        first = bound.argmin(axis=1)
        best = np.zeros(len(rows), exact.dtype)
        for c, centroid in enumerate(centroids):
            mine = np.flatnonzero(first == c)
            if len(mine):
                best[mine] = squared_distances(exact[mine], centroid)
        chosen = first.copy()
        measured += len(rows)
        for c, centroid in enumerate(centroids):
            left = np.flatnonzero((first != c) & (bound[:, c] <= best.astype(float) * (1 + _SLACK)))
            if len(left) == 0:
                continue
            measured += len(left)
            found = squared_distances(exact[left], centroid)
            nearer = (found < best[left]) | ((found == best[left]) & (c < chosen[left]))
            best[left[nearer]], chosen[left[nearer]] = found[nearer], c
        cluster[rows], distance[rows] = chosen, best
    return cluster, distance, measured


def _limbs(total: int) -> list[int]:
    out = []
    while not -(1 << _LIMB) < total < 1 << _LIMB:
        out.append(total & ((1 << _LIMB) - 1))
        total >>= _LIMB
    return [*out, total]


def _add_up(numbers: np.ndarray, cluster: np.ndarray, sums: dict) -> None:
    """Add the rows to ``sums`` by (cluster, component, limb); component -1 counts rows."""
    for rows, exact in _exact_parts(numbers, []):
        for c in np.unique(cluster[rows]).tolist():
            mine = exact[cluster[rows] == c]
            for place, total in enumerate([len(mine), *mine.sum(axis=0).tolist()], -1):
                for limb, part in enumerate(_limbs(int(total))):
                    sums[c, place, limb] = sums.get((c, place, limb), 0) + part


def _stored_numbers(batch: pa.RecordBatch, size: int, pivots: int) -> tuple[np.ndarray, np.ndarray]:
    return (batch.column("_c_numbers").flatten().to_numpy().reshape(-1, size),
            batch.column("_c_known").flatten().to_numpy().reshape(-1, pivots))


def prepare(vectors: DataFrame, embedding: str, size: int, scale: int, pivots: Pivots | None) -> DataFrame:
    """The kept vectors' rows with their whole numbers and distances to the pivots."""
    own = vectors.drop(*RESULTS)
    plain = own.withColumn(embedding, F.col(f"`{embedding}`").cast("array<double>"))
    names = [f.name for f in plain.schema if f.name != embedding]

    def work(batches: Iterator[pa.RecordBatch]):
        for batch, numbers in _whole_numbers(batches, embedding, size, scale):
            known = pivots.distances(numbers) if pivots else np.zeros((len(numbers), 0))
            columns = [batch.column(n) for n in names]
            for table in (numbers, known):
                marks = np.arange(len(table) + 1, dtype=np.int32) * table.shape[1]
                columns.append(pa.ListArray.from_arrays(marks, pa.array(table.reshape(-1))))
            yield pa.RecordBatch.from_arrays(columns, [*names, "_c_numbers", "_c_known"])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema if f.name != embedding]
    return plain.mapInArrow(work, ", ".join([*schema, "_c_numbers array<double>", "_c_known array<double>"]))


def first_centroids(vectors: DataFrame, vec_id: str, embedding: str, clusters: int, size: int,
                    scale: int, seed: int | str) -> list[Vector]:
    """The vectors of smallest hash of seed and id; ``clusters`` rows reach the driver."""
    key = F.coalesce(F.col(f"`{vec_id}`").cast("string"), F.lit(""))
    narrow = vectors.select(F.col(f"`{vec_id}`"), F.col(f"`{embedding}`"))
    hashed = prepare(narrow, embedding, size, scale, None).select(
        F.sha2(F.concat(F.lit(f"{seed}:"), key), 256).alias("h"), "_c_numbers")
    rows = hashed.orderBy("h", "_c_numbers").limit(clusters).collect()
    return [[int(v) for v in r["_c_numbers"]] for r in rows]


def moved_centroids(prepared: DataFrame, centroids: list[Vector], pivots: Pivots) -> list[Vector]:
    """One round: every vector to its nearest centroid, every centroid to the mean of its vectors."""
    size, count = len(centroids[0]), len(pivots.vectors)

    def work(batches: Iterator[pa.RecordBatch]):
        sums: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            numbers, known = _stored_numbers(batch, size, count)
            _add_up(numbers, nearest(numbers, known, centroids, pivots)[0], sums)
        keys = np.array(list(sums), np.int32).reshape(-1, 3).T
        yield pa.RecordBatch.from_arrays(
            [*map(pa.array, keys), pa.array(list(sums.values()), pa.int64())],
            ["cluster", "place", "limb", "total"])

    rows = (prepared.select("_c_numbers", "_c_known")
            .mapInArrow(work, "cluster int, place int, limb int, total long")
            .groupBy("cluster", "place", "limb").agg(F.sum("total").alias("total")).collect())
    sums = [[0] * (size + 1) for _ in centroids]  # the count comes first
    for r in rows:
        sums[r.cluster][r.place + 1] += r.total << (_LIMB * r.limb)
    return [[total // own[0] for total in own[1:]] if own[0] else old
            for own, old in zip(sums, centroids, strict=True)]


def assigned(prepared: DataFrame, centroids: list[Vector], pivots: Pivots) -> DataFrame:
    """``prepared`` with ``cluster`` and ``distance`` in place of the working columns."""
    size, count = len(centroids[0]), len(pivots.vectors)
    names = [n for n in prepared.columns if not n.startswith("_c_")]

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            numbers, known = _stored_numbers(batch, size, count)
            cluster, distance, _ = nearest(numbers, known, centroids, pivots)
            held = [int(d) if d <= _LONGEST else None for d in distance.tolist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(cluster), pa.array(held, pa.int64())],
                [*names, "cluster", "distance"])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in prepared.schema if f.name in names]
    return prepared.mapInArrow(work, ", ".join([*schema, "cluster int", "distance long"]))


def cluster_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", clusters: int = 8,
    size: int = 64, scale: int = 1024, rounds: int = 10, seed: int | str = 3, pairs: int = 8,
) -> DataFrame:
    """The kept rows without the vector, with cluster, distance, inertias and the centroid's digest."""
    spark = vectors.sparkSession
    centroids = first_centroids(vectors, vec_id, embedding, clusters, size, scale, seed)
    pivots = Pivots(centroids, pairs)
    prepared = scratch.stored(prepare(vectors, embedding, size, scale, pivots), "vectors")
    for _ in range(rounds if centroids else 0):
        centroids = moved_centroids(prepared, centroids, pivots)
    # an empty table has no centroids, and none are asked for
    found = scratch.stored(assigned(prepared, centroids or [[0] * size], pivots), "assigned")
    sums = {r.cluster: r for r in found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"),
        F.count_if(F.col("distance").isNull()).alias("unknown")).collect()}

    def held(rows) -> int | None:
        total = sum(int(r.total or 0) for r in rows)
        return None if total > _LONGEST or any(r.unknown for r in rows) else total

    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    table = spark.createDataFrame(
        [(c, held([r]), held(list(sums.values())), digests[c]) for c, r in sorted(sums.items())],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    names = [n for n in found.columns if n not in RESULTS]
    return found.join(F.broadcast(table), "cluster").select(*[F.col(f"`{n}`") for n in names], *RESULTS)
