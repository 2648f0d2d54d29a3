"""Exact percentiles by bins against sorting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatum.operators import selection

PS = [0.0, 0.1, 0.25, 0.5, 1 / 3, 0.9, 0.999, 1.0]


def _cases():
    rng = random.Random(3)
    return {
        "uniform": [rng.random() for _ in range(3001)], "signed": [rng.gauss(0, 5) for _ in range(2000)], "one": [7.5], "two": [1.0, 2.0], "equal": [0.25] * 500,
        "hot": [0.5] * 3000 + [rng.random() for _ in range(500)], "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(900)], "close": [1.0 + k * 2.0**-52 for k in rng.sample(range(10000), 700)],
        "ends": [float("-inf"), -0.0, 0.0, 5e-324, -5e-324, 1.7e308, float("inf"), 3.0, 3.0], "few": [float(rng.randrange(5)) for _ in range(1000)],
    }


@pytest.mark.parametrize("parts", [4096, 3])
def test_equal_to_sorting(spark, parts, monkeypatch):
    monkeypatch.setattr(selection, "PARTS", parts)
    cases = _cases()
    rows = [(name, v) for name, vs in cases.items() for v in vs] + [("uniform", None), ("none", None)]
    random.Random(1).shuffle(rows)
    table = selection.stored(spark.createDataFrame(rows, "name string, value double").repartition(4))
    got = selection.percentiles(table, {name: PS for name in [*cases, "none", "absent"]})
    want = {r["name"]: r["p"] for r in table.groupBy("name").agg(F.percentile("value", F.array(*map(F.lit, PS))).alias("p")).collect()}
    for name, values in cases.items():
        assert got[name] == want[name], name
        if name not in ("ends", "wide"):
            assert np.allclose(got[name], np.quantile(values, PS), rtol=1e-12)
    assert got["none"] == got["absent"] == [None] * len(PS)


def test_nan_is_largest(spark):
    rows = [("x", v) for v in (1.0, float("nan"), 2.0, float("nan"), 0.5)]
    got = selection.percentiles(spark.createDataFrame(rows, "name string, value double"), {"x": [0.0, 0.5, 1.0]})["x"]
    assert got[:2] == [0.5, 2.0] and np.isnan(got[2])


def test_no_task_gathers_values(spark):
    """The plan of a pass counts bins; nothing collects or sorts values."""
    df = spark.range(1000).selectExpr("'x' as `group`", "cast(id as double) as value", "id as bin")
    plan = df.groupBy("group", "bin").agg(F.count("*"), F.min("value"))._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "partial_count" in plan
