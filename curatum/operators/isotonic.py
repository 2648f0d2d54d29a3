"""Isotonic regression by pool-adjacent-violators, in blocks that need no task with all scores.

The fit at a score is the slope of the lower convex hull of the points (rows up to a score, labels
up to it). Ranges of scores are pooled on their own, which leaves the hull of each range. For a
slope i / cuts, the point of the whole hull that it touches is the smallest of what the ranges'
hulls offer, one minimum over their corners; fits before that point are below the slope and
fits after it are not, so the points split the problem into segments that know nothing of each
other. A segment's blocks are then pooled once more. All comparisons are between whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import BooleanType, IntegralType

from .ingest import stored

_FITTED = {"low": "double", "high": "double", "w": "long", "s": "long"}
_CORNER = {"part": "double", **_FITTED, "at_w": "long", "at_s": "long", "from_cut": "int", "to_cut": "int"}
_ARROW = {"double": pa.float64(), "long": pa.int64(), "int": pa.int32()}


def _ddl(schema: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in schema.items())


def _frames(rows: list[tuple], schema: dict[str, str], size: int = 10_000) -> Iterator[pa.RecordBatch]:
    kinds = [_ARROW[kind] for kind in schema.values()]
    for i in range(0, len(rows), size):
        columns = zip(*rows[i : i + size], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names=list(schema))


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(x.to_pylist() for x in batch.columns), strict=True)


def pool(blocks: Iterable[tuple[float, float, int, int]]) -> list[tuple[float, float, int, int]]:
    """Ascending blocks (low, high, rows, labels) merged until their means rise strictly."""
    kept: list[tuple[float, float, int, int]] = []
    for low, high, w, s in blocks:
        while kept and kept[-1][3] * w >= s * kept[-1][2]:
            low, _, more, labels = kept.pop()
            w, s = w + more, s + labels
        kept.append((low, high, w, s))
    return kept


def _hull_of_range(cuts: int):
    """The blocks of a task's range, each as the corner behind it: rows and labels of the range up to there, and
    the cuts whose slope touches the hull there. A corner without rows comes first."""

    def hull(batches):
        blocks = pool((p, p, w, s) for p, w, s in _rows(batches))
        if not blocks:
            return
        reach = [min(max(cuts * s // w, 0), cuts - 1) for _, _, w, s in blocks] + [cuts - 1]
        part, at_w, at_s = blocks[0][0], 0, 0
        corners = [(part, part, part, 0, 0, 0, 0, 1, reach[0])]
        for block, below, upto in zip(blocks, reach, reach[1:], strict=False):
            at_w, at_s = at_w + block[2], at_s + block[3]
            corners.append((part, *block, at_w, at_s, below + 1, upto))
        yield from _frames(corners, _CORNER)

    return hull


def _pool_segments(batches):
    """Blocks in order of segment and score, pooled within each segment; one segment's result is held at a time."""
    for _, rows in groupby(_rows(batches), key=itemgetter(0)):
        yield from _frames(pool(row[1:] for row in rows), _FITTED)


def corners(rows: DataFrame, cuts: int) -> DataFrame:
    """The stored blocks of each range of scores, see ``_hull_of_range``."""
    scored = rows.where("p is not null and not isnan(p) and y is not null")
    counts = scored.groupBy(F.col("p").cast("double").alias("p")).agg(F.count("*").alias("w"), F.sum(F.col("y").cast("long")).alias("s"))
    return stored(counts.repartitionByRange("p").sortWithinPartitions("p").mapInArrow(_hull_of_range(cuts), _ddl(_CORNER)))


def segments(local: DataFrame, cuts: int) -> DataFrame:
    """Blocks of ``corners`` with the segment each lies in."""
    ahead = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = local.groupBy("part").agg(F.sum("w").alias("w"), F.sum("s").alias("s"))  # a row a task
    before = totals.select("part", F.coalesce(F.sum("w").over(ahead), F.lit(0)).alias("b_w"), F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("b_s"))
    placed = local.join(before, "part").withColumn("at_w", F.col("at_w") + F.col("b_w")).withColumn("at_s", F.col("at_s") + F.col("b_s"))
    touching = placed.where("from_cut <= to_cut").select(F.explode(F.sequence("from_cut", "to_cut")).alias("cut"), "at_w", "at_s")
    lowest = touching.groupBy("cut").agg(F.min(F.struct(F.col("at_s") * cuts - F.col("cut") * F.col("at_w"), "at_w")).getField("at_w").alias("at_w"))
    split = lowest.agg(F.collect_set("at_w").alias("splits"))  # one row of fewer numbers than cuts
    segment = F.size(F.filter("splits", lambda x: x < F.col("at_w")))
    return placed.where("w > 0").crossJoin(F.broadcast(split)).select(segment.alias("segment"), *_FITTED)


def isotonic_fit(rows: DataFrame, cuts: int = 256) -> DataFrame:
    """(p, calibrated) at both ends of each block of the monotone map from p to y that has the least squared error.

    ``y`` holds whole numbers, as a rule 0 and 1. Exact on all distinct scores. Rows with null or NaN
    ``p`` or null ``y`` take no part, equal scores are one point with a weight, no rows give an empty fit.

    Rows are counted by score before they are shuffled. A task holds the blocks of its range or segment, not
    the scores: of n rows with labels 0 and 1 there are at most O(n ** (2/3)) means that rise strictly.
    """
    if not isinstance(rows.schema["y"].dataType, (IntegralType, BooleanType)):
        raise TypeError("y must hold whole numbers")
    parted = segments(corners(rows, cuts), cuts).repartition("segment").sortWithinPartitions("segment", "low")
    fitted = parted.mapInArrow(_pool_segments, _ddl(_FITTED))
    return fitted.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("p"), (F.col("s") / F.col("w")).alias("calibrated"))
