"""Bit planes and centroid clustering against plain integers."""

import hashlib
import math

import numpy as np
import pytest

from curatum.llm import centroids
from curatum.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, cluster string, ints int"


@pytest.mark.parametrize("low, high", [(0, 1), (-1, 1), (-160, 160), (5, 6), (-centroids.MOST, centroids.MOST + 1)])
def test_planes_are_exact(low, high):
    rng = np.random.default_rng(3)
    a, b = rng.integers(low, high, (70, 64)), rng.integers(-90, 300, (9, 64))
    pa, pb = centroids.pack(a), centroids.pack(b)
    assert (centroids.unpack(pa) == a).all() and (centroids.own_dots(pa) == (a * a).sum(1)).all()
    assert (centroids.dots(pa, pb) == a @ b.T).all()


def brute(rows, k, rounds, scale=256):
    kept = [(i, [max(-centroids.MOST, min(centroids.MOST, math.floor(scale * float(np.float32(x))))) for x in v]) for i, v in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    means = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda v, m: sum((x - y) ** 2 for x, y in zip(v, m, strict=True))
    for n in range(rounds + 1):
        at = [min(range(len(means)), key=lambda c: (far(v, means[c]), c)) for _, v in kept]
        if n < rounds:
            for c in range(len(means)):
                if own := [v for (_, v), a in zip(kept, at, strict=True) if a == c]:
                    means[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    distances = [far(v, means[a]) for (_, v), a in zip(kept, at, strict=True)]
    return [(i, a, d, sum(x for x, b in zip(distances, at, strict=True) if b == a), sum(distances), centroids.digest(means[a])) for (i, _), a, d in zip(kept, at, distances, strict=True)]


@pytest.fixture(scope="module")
def vectors():
    """Nulls, other lengths, ties, repeated ids and rows, one large component, a third of all rows equal."""
    rng = np.random.default_rng(11)
    v = [[float(x) for x in rng.normal(0, 0.3, 64)] for _ in range(60)]
    rows = list(enumerate(v)) + [(100 + i, v[0]) for i in range(40)]
    rows += [(None, v[3]), (None, v[4]), (7, v[8]), (7, v[8]), (200, None), (201, []), (202, v[1][:63]), (203, v[1] + [0.0])]
    rows += [(204, [None, *v[1][1:]]), (205, [float("nan"), *v[1][1:]]), (206, [float("-inf"), *v[1][1:]]), (207, [1000.0, *v[1][1:]]), (208, [0.0] * 64)]
    return rows


@pytest.mark.parametrize("k, rounds", [(40, 5), (3, 2), (500, 1)])
def test_rounds_equal_brute_force(spark, vectors, k, rounds):
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in vectors], SCHEMA).repartition(5)
    got = centroids.cluster_report(table, k=k, rounds=rounds).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(vectors, k, rounds), key=repr)


def test_empty_and_oversized(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert centroids.cluster_report(empty).collect() == []
    assert centroids.cluster_report(spark.createDataFrame([(1, None, "x", 1)], SCHEMA)).collect() == []
    huge = [(i, [3e38 * (1 - 2 * (i % 2))] * 64) for i in range(4)]
    got = centroids.cluster_report(spark.createDataFrame([(i, v, "x", 1) for i, v in huge], SCHEMA), k=1, rounds=0).collect()
    assert sorted(map(tuple, got)) == sorted((*r[:3], min(r[3], 2**63 - 1), min(r[4], 2**63 - 1), r[5]) for r in brute(huge, 1, 0))


def test_batches_with_other_numbers_of_planes(spark):
    rows = [(i, [float(i % 3) * 2.0 ** (i % 5)] * 64) for i in range(30)]
    got = centroids.cluster_report(spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(7, "vec_id"), k=4, rounds=3).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 4, 3))


def test_registered(spark, sf):
    assert QUERIES["op13_centroid_clustering"](spark, sf).count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()
