"""Exact percentiles of columns of any size, without one task that holds all distinct values.

Values fall into bins in their order, first by sign and logarithm, and Spark counts the bins with
the smallest and largest value of each. Only bins that hold a wanted rank, and where neither end
is the answer, are cut again, into equal parts between their ends; every pass divides such a
bin by up to ``PARTS``, so a few passes do at any size. A task sends on one row a bin that it has.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .ingest import stored

PARTS = 4096
_OCTAVE, _SHIFT, _END = 16, 20000, 1 << 20


def _coarse(v: Column) -> Column:
    """A bin number that never falls as ``v`` grows: Java's logarithm is monotone. At most 2 * 34,000 numbers."""
    size = F.floor(F.log2(F.abs(v)) * _OCTAVE).cast("long") + _SHIFT
    inner = F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0).cast("long"))
    return F.when(F.isnan(v), F.lit(2 * _END)).when(v == float("inf"), F.lit(_END)).when(v == float("-inf"), F.lit(-_END)).otherwise(inner)


def _counted(binned: DataFrame) -> dict:
    """Bins (bin, n, low, high) of each group in order."""
    found: dict = {}
    for r in binned.groupBy("group", "bin").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).collect():
        found.setdefault(r["group"], []).append((r["bin"], r["n"], r["low"], r["high"]))
    return {g: sorted(rows) for g, rows in found.items()}


def _settle(ranks: list[int], bins: list[tuple], before: int) -> tuple[dict[int, float], dict[tuple[float, float, int], list[int]]]:
    """Values of ranks at the ends of their bins, and the ranks inside bins (low, high, rows before it)."""
    known, inside, at = {}, {}, before
    for _, n, low, high in bins:
        for rank in ranks:
            if at <= rank < at + n:
                if rank == at or low == high or math.isnan(low):
                    known[rank] = low
                elif rank == at + n - 1:
                    known[rank] = high
                else:
                    inside.setdefault((low, high, at), []).append(rank)
        at += n
    return known, inside


def percentiles(values: DataFrame, wanted: Mapping[str, Sequence[float]]) -> dict[str, list[float | None]]:
    """For each name of ``wanted``, the exact percentiles of its non-null values in ``values(name, value)``,
    interpolated linearly as Spark's ``percentile`` does; None where a name has no value.

    ``values`` is read once a pass, so it should be a stored table. NaN is the largest value.
    """
    rows = values.where("value is not null")
    bins = _counted(rows.select(F.col("name").alias("group"), "value", _coarse(F.col("value")).alias("bin")))
    known: dict[str, dict[int, float]] = {name: {} for name in wanted}
    places = {name: [(sum(b[1] for b in bins[name]) - 1) * p for p in ps] if name in bins else [] for name, ps in wanted.items()}
    open_bins: list[tuple[str, tuple[float, float, int], list[int]]] = []
    for name in wanted:
        ranks = sorted({r for x in places[name] for r in (math.floor(x), math.ceil(x))})
        done, inside = _settle(ranks, bins.get(name, []), 0)
        known[name] |= done
        open_bins += [(name, b, r) for b, r in inside.items()]
    while open_bins:
        cut = lambda low, high: F.floor((F.col("value") - low) / (high - low) * PARTS).cast("long")
        parts = [rows.where((F.col("name") == name) & F.col("value").between(low, high)).select(F.lit(i).alias("group"), "value", cut(low, high).alias("bin")) for i, (name, (low, high, _), _) in enumerate(open_bins)]
        union = parts[0]
        for p in parts[1:]:
            union = union.unionAll(p)
        bins, left = _counted(union), []
        for i, (name, (low, high, before), ranks) in enumerate(open_bins):
            done, inside = _settle(ranks, bins[i], before)
            known[name] |= done
            left += [(name, b, r) for b, r in inside.items()]
        open_bins = left

    def value(name: str, place: float) -> float:
        lower, upper = math.floor(place), math.ceil(place)
        a, b = known[name][lower], known[name][upper]
        return a if lower == upper or a == b else (upper - place) * a + (place - lower) * b

    return {name: [value(name, x) for x in places[name]] or [None] * len(ps) for name, ps in wanted.items()}


def column_percentiles(df: DataFrame, wanted: Mapping[str, Sequence[float]]) -> dict[str, list[float | None]]:
    """Exact percentiles of SQL expressions over ``df``, whose values are stored for it."""
    names = list(wanted)
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), F.expr(n).cast("double").alias("value")) for n in names))
    return percentiles(stored(df.select(F.inline(pairs))), wanted)
