import hashlib
import math
import random

import numpy as np
import pytest

from jobtide.llm.centroids import Pivots, cluster_vectors, nearest, squared_distances

VECTORS = "vec_id long, embedding array<double>, cluster string, note string"


def brute_force(rows, clusters=8, size=64, rounds=10, scale=1024, seed=3):
    """(vec_id, cluster, distance, cluster_inertia, inertia, digest) by trying every centroid."""
    kept = [(k, [math.floor(scale * x) for x in v]) for k, v in rows
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (
        hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))
                for _, v in kept]

    for _ in range(rounds):
        chosen = [i for _, i in assign()]
        for c in range(len(centroids)):
            mine = [v for (_, v), i in zip(kept, chosen, strict=True) if i == c]
            if mine:
                centroids[c] = [sum(column) // len(mine) for column in zip(*mine, strict=True)]
    found = assign()
    sums = [sum(d for d, i in found if i == c) for c in range(len(centroids))]

    def held(n):
        return n if n < 1 << 63 else None

    return [(k, i, held(d), held(sums[i]), held(sum(sums)),
             hashlib.sha256(",".join(map(str, centroids[i])).encode()).hexdigest())
            for (k, _), (d, i) in zip(kept, found, strict=True)]


def ordered(rows):
    return sorted(rows, key=lambda row: [(v is None, str(v)) for v in row])


def check(spark, rows, **more):
    table = spark.createDataFrame([(k, v, "old", "n") for k, v in rows], VECTORS).repartition(3)
    out = cluster_vectors(table, **more)
    assert out.columns == ["vec_id", "note", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    seen = [tuple(r) for r in out.drop("note").collect()]
    options = {k: v for k, v in more.items() if k != "pairs"}
    assert ordered(seen) == ordered(brute_force(rows, **options))


def vector(rng, size, spread):
    return [rng.uniform(-spread, spread) for _ in range(size)]


def test_against_every_centroid(spark):
    rng = random.Random(1)
    rows = [(i, vector(rng, 64, 1)) for i in range(300)]
    check(spark, rows)
    check(spark, [(i, vector(rng, 5, 3)) for i in range(200)], size=5, clusters=4, rounds=3, scale=10, pairs=2)


def test_ties_repeats_and_odd_rows(spark):
    # whole numbers on a small grid: many equal distances
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(0, 2)) for _ in range(3)]) for i in range(150)]
    rows += [(7, [1.0, 1.0, 1.0])] * 30 + [(7, [0.0, 0.0, 1.0])] * 3 + [(None, [2.0, 0.0, 2.0])] * 2
    rows += [(900, None), (901, []), (902, [1.0, 2.0]), (903, [1.0, None, 2.0]), (904, [1.0, float("nan"), 0.0]),
             (905, [float("inf"), 0.0, 0.0]), (906, [1.0, 1.0, 1.0, 1.0])]
    check(spark, rows, size=3, clusters=5, scale=1)


def test_components_beyond_64_bits(spark):
    rng = random.Random(3)
    rows = [(i, vector(rng, 4, 1)) for i in range(20)]
    rows += [(100 + i, vector(rng, 4, 10.0 ** rng.choice([6, 9, 15, 30, 38]))) for i in range(25)]
    check(spark, rows, size=4, clusters=6, rounds=4)
    check(spark, [(i, vector(rng, 4, 2.0 ** 17)) for i in range(40)], size=4, clusters=3, rounds=4)


def test_few_equal_or_no_vectors(spark):
    check(spark, [(1, [0.5, 1.0])], size=2)
    check(spark, [(i, [0.5, 1.0]) for i in range(12)], size=2)
    none = spark.createDataFrame([], VECTORS)
    assert cluster_vectors(none).collect() == []


@pytest.mark.parametrize("spread", [3, 1 << 20, 1 << 27, 1 << 60])
def test_bounds_never_exceed_distances(spread):
    rng = np.random.default_rng(5)
    numbers = np.floor(rng.uniform(-spread, spread, (200, 6)))
    centers = [[int(v) for v in row] for row in np.floor(rng.uniform(-spread, spread, (9, 6))).tolist()]
    pivots = Pivots(centers[:5], pairs=10)
    known = pivots.distances(numbers)
    bounds = pivots.lower_bounds(known, centers)
    exact = np.array([[int(v) for v in row] for row in numbers.tolist()], object)
    for c, center in enumerate(centers):
        for bound, square in zip(bounds[:, c].tolist(), squared_distances(exact, center), strict=True):
            assert int(bound) <= square
    # a pivot's own bound is its distance, nearly
    assert (bounds[:, 0] > 0.99 * known[:, 0] ** 2).all()


def test_bounds_spare_measurements():
    rng = np.random.default_rng(6)
    centers = np.floor(rng.uniform(-1000, 1000, (8, 64)))
    numbers = np.floor(centers[rng.integers(0, 8, 2000)] + rng.normal(0, 30, (2000, 64)))
    whole = [[int(v) for v in row] for row in centers.tolist()]
    pivots = Pivots(whole, pairs=8)
    cluster, _, measured = nearest(numbers, pivots.distances(numbers), whole, pivots)
    assert (cluster == ((numbers[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert measured < 1.1 * len(numbers)
