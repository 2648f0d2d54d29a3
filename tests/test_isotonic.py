"""Isotonic fits against the min-max formula and against pooling in one pass."""

import numpy as np
import pytest

from curatum.operators import isotonic


def _df(spark, p, y):
    return spark.createDataFrame([(a, b) for a, b in zip(p, y, strict=True)], "p double, y int")


def _knots(spark, p, y, **more):
    return sorted((r.p, r.calibrated) for r in isotonic.isotonic_fit(_df(spark, p, y), **more).collect())


def _by_formula(p, y):
    """The fit at each score: the largest over starts of the smallest mean over ends, knots at both ends of equal fits."""
    p, y = np.array(p), np.array(y)
    xs = np.unique(p)
    w, s = np.array([(p == x).sum() for x in xs]), np.array([y[p == x].sum() for x in xs])
    fit = [max(min(s[a : b + 1].sum() / w[a : b + 1].sum() for b in range(i, len(xs))) for a in range(i + 1)) for i in range(len(xs))]
    ends = {}
    for x, v in zip(xs.tolist(), fit, strict=True):
        ends.setdefault(float(v), []).append(x)
    return sorted({(x, v) for v, at in ends.items() for x in (at[0], at[-1])})


@pytest.mark.parametrize("seed,n,levels,shape", [(1, 60, 60, "rise"), (2, 80, 12, "rise"), (3, 50, 50, "fall"), (4, 40, 40, "flat"), (5, 1, 1, "flat"), (6, 60, 30, "step")])
@pytest.mark.parametrize("cuts", [2, 4, 256])
def test_equal_to_the_formula(spark, seed, n, levels, shape, cuts):
    rng = np.random.default_rng(seed)
    p = rng.integers(0, levels, n) / levels
    chance = {"rise": p, "fall": 1 - p, "flat": 0.5 + 0 * p, "step": (p > 0.5) * 1.0}[shape]
    y = (rng.random(n) < chance).astype(int)
    assert _knots(spark, p.tolist(), y.tolist(), cuts=cuts) == _by_formula(p, y)


def test_edges(spark):
    assert _knots(spark, [], []) == []
    assert _knots(spark, [None, float("nan"), 0.5], [1, 1, None]) == []
    assert _knots(spark, [0.3, 0.3, 0.3, None], [0, 1, 1, 0]) == [(0.3, 2 / 3)]
    assert _knots(spark, [0.1, 0.2, 0.3], [1, 1, 1]) == [(0.1, 1.0), (0.3, 1.0)]
    assert _knots(spark, [-5.0, 0.0, 7.0, 9.0], [-2, 3, 3, 900]) == [(-5.0, -2.0), (0.0, 3.0), (7.0, 3.0), (9.0, 900.0)]
    with pytest.raises(TypeError):
        isotonic.isotonic_fit(spark.createDataFrame([(0.5, 0.5)], "p double, y double"))


def test_many_scores_in_no_single_task(spark):
    n, cuts = 1_000_000, 256
    rows = spark.range(n).selectExpr("cast((id + 0.5) / 1000000 as double) as p", "cast(pmod(xxhash64(id), 1000) < id / 1000 as int) as y")
    local = isotonic.corners(rows.repartition(16), cuts)
    blocks = isotonic.segments(local, cuts)
    sizes = [r["count"] for r in blocks.groupBy("segment").count().collect()]
    assert len(sizes) > 100 and max(sizes) < 100 and sum(sizes) < n / 100 and blocks.selectExpr("sum(w)").first()[0] == n
    whole = isotonic.pool((r.p, r.p, 1, r.y) for r in rows.orderBy("p").toLocalIterator())
    want = sorted({(x, s / w) for low, high, w, s in whole for x in (low, high)})
    assert sorted((r.p, r.calibrated) for r in isotonic.isotonic_fit(rows).collect()) == want
