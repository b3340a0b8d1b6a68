import hashlib
import math

import numpy as np
import pytest

from pagequarry.llm import vectors as V

SCHEMA = "vec_id long, embedding array<float>, cluster int, label int"


def plain(rows, k, rounds, dimensions):
    """All distances of all rounds, in Python's integers."""
    kept = []
    for vec_id, e in rows:
        if e is not None and len(e) == dimensions and all(x is not None and math.isfinite(x) for x in e):
            kept.append((vec_id, tuple(max(-V.LIMIT, min(V.LIMIT, math.floor(1024 * float(np.float32(x))))) for x in e)))
    digest = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    pack = lambda q: np.array(q, dtype="<i4").tobytes()
    centroids = [q for _, q in sorted(kept, key=lambda r: (digest(r[0]), pack(r[1])))[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda q: min((dist(q, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(q)[1] for _, q in kept]
        for j in set(own):
            mine = [q for (_, q), o in zip(kept, own, strict=True) if o == j]
            centroids[j] = tuple(sum(x) // len(mine) for x in zip(*mine, strict=True))
    out = [(i, *near(q)) for i, q in kept]
    total = sum(d for _, d, _ in out)
    inertia = {j: sum(d for _, d, o in out if o == j) for j in range(len(centroids))}
    return [(i, j, d, inertia[j], total, hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in out]


def key(r):
    return tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)


def check(spark, rows, k=8, rounds=10, dimensions=4, parts=3):
    frame = spark.createDataFrame([(i, e, 7, 0) for i, e in rows], SCHEMA).repartition(parts)
    found, centroids = V.cluster(frame, k=k, rounds=rounds, dimensions=dimensions)
    got = V.digest(found, centroids)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(rows, k, rounds, dimensions), key=key)
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_agrees_with_all_distances(spark, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 1, (6, 4))
    rows = [(i, (centers[i % 6] + rng.normal(0, 0.3, 4)).astype(np.float32).tolist()) for i in range(400)]
    found = check(spark, rows)
    assert found.where("not scanned").count() > 200  # bounds spare most rows the full scan by the last round
    bad = found.where("upper < 0 or lower < 0").count()
    assert bad == 0


def test_ties_repeats_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 5), 0.0, float(i % 2), 0.0]) for i in range(60)]  # a grid: many ties
    rows += [(7, [1.0, 0.0, 0.0, 0.0])] * 40 + [(None, [2.0, 2.0, 2.0, 2.0]), (None, [0.5, 0.5, -0.5, -0.0005])]
    rows += [(100, None), (101, []), (102, [1.0, 2.0, 3.0]), (103, [1.0, None, 0.0, 0.0]), (104, [1.0, nan, 0.0, 0.0]), (105, [1.0, inf, 0.0, 0.0]), (106, [3e38, -3e38, 1.0, 1.0]), (107, [0.0] * 5)]
    check(spark, rows)


def test_few_equal_and_no_vectors(spark):
    check(spark, [(1, [1.0, 1.0, 1.0, 1.0]), (2, [2.0, 1.0, 1.0, 1.0])])
    check(spark, [(i, [1.0, 1.0, 1.0, 1.0]) for i in range(30)])
    check(spark, [(1, [-0.3, 0.1, 0.7, 9.0])])
    check(spark, [(1, None)])
    check(spark, [])


def test_bounds_hold(spark):
    """Every bound is true of exact distances after each round."""
    rng = np.random.default_rng(9)
    v = rng.integers(-500, 500, (300, 8))
    c = v[:5].copy()
    own, upper, lower, before = np.zeros(300, dtype=int), np.full(300, np.inf), np.zeros(300), c
    spared = 0
    for _ in range(12):
        own, upper, lower, scanned = V.Geometry(before, c).assign(v, own, upper, lower)
        d = V.squared(v, c)
        assert (own == d.argmin(axis=1)).all()
        assert (upper >= np.sqrt(d[np.arange(300), own])).all()
        d[np.arange(300), own] = np.iinfo(np.int64).max
        assert (lower <= np.sqrt(d.min(axis=1))).all()
        before, c = c, np.array([v[own == j].sum(axis=0) // (own == j).sum() for j in range(5)])
        spared += int((~scanned).sum())
    assert spared > 300
