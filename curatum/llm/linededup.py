"""Line dedup: repeated line runs over line-id sequences by distributed prefix doubling.

Texts are sequences of line ids (128-bit digests of trimmed, non-blank lines), put one after
another in order of (doc_id, text hash, line). Round k of the doubling has, for every place
whose run of 2**k lines occurs elsewhere too, the name of that run; round k + 1 names the pair
of names at i and i + 2**k. Places with one name are an interval of the suffix array: suffixes
that share their first 2**k lines. The interval at any depth L between 2**k and 2**(k+1) is
named by the two names at i and i + L - 2**k, which overlap and together cover the L lines.

A run is deleted where one earlier place holds all of it and it has at least ``min_words``
words; a later copy is every place of an interval but its first. Each part of a later copy is
a later copy itself, so it is enough to look at the shortest runs of ``min_words`` words that
begin or end at a line: their union is the union of all maximal repeated runs that are long
enough. As a line has at least one word, those runs have at most ``min_words`` lines, and the
doubling ends after log2(min_words) rounds, however long the copies are.

Frequent lines: names are counted with partial aggregation; the ``HOT`` most frequent ones are
joined back by broadcast, so that no single line's places meet in one task.

Defined cases: null and empty texts pass unchanged; blank lines are no part of a run and stay
unless all other lines go, when the text becomes empty; a repeated line of fewer than
``min_words`` words stays unless a longer repeated run holds it; rows equal in doc_id and text
are one document and edited alike; rows with a null doc_id come first in order; other columns
pass through untouched, columns called n_lines or n_deleted are replaced; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .support import fresh, store
from .tokens import slices

_BLANK = " \t\r\x0b\x0c"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Names joined back by broadcast: a fixed number of rows of some 60 bytes.
HOT = 2000


def shortest_runs(counts: np.ndarray, min_words: int) -> list[list[int]]:
    """For each line, the lengths of the runs beginning there that have ``min_words`` words and
    would have fewer without their last line, or without their first."""
    total = np.concatenate(([0], np.cumsum(counts)))
    out: list[list[int]] = [[] for _ in counts]
    stop = np.searchsorted(total, total[:-1] + min_words)  # first end with enough words
    for i in np.flatnonzero(stop <= len(counts)):
        out[i].append(int(stop[i] - i))
    start = np.searchsorted(total, total[1:] - min_words, side="right") - 1  # last start with enough words
    for t in np.flatnonzero(start >= 0):
        length = int(t + 1 - start[t])
        if length not in out[start[t]]:
            out[start[t]].append(length)
    return out


def _scan(min_words: int):
    """(d, h, pos, c, runs) of each non-blank line: document key, place, line id, shortest runs from there."""

    def scan(batches):
        for batch in (part for whole in batches for part in slices(whole, 2)):
            d, h, at, ids, runs = [], [], [], [], []
            for doc, key, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                lines = [y for y in (x.strip(_BLANK) for x in text.split("\n")) if y]
                d += [doc] * len(lines)
                h += [key] * len(lines)
                at += range(len(lines))
                ids += [hashlib.blake2b(x.encode(), digest_size=16).digest() for x in lines]
                runs += shortest_runs(np.array([len(_WORD.findall(x)) for x in lines], np.int64), min_words)
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(h, pa.int64()), pa.array(at, pa.int32()), pa.array(ids, pa.binary()), pa.array(runs, pa.list_(pa.int32()))], names=["d", "h", "pos", "c", "runs"])

    return scan


_PLACE = "struct(d is not null as known, d, h, pos)"


def _intervals(named: DataFrame) -> DataFrame:
    """Rows of ``named`` (d, h, pos, c, ...) whose name occurs at two places or more, with
    ``later``: not the first place of its name. ``named`` is a stored table, read twice."""
    place = F.expr(_PLACE)
    ends = named.groupBy("c").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).where("first <> last")
    ends = store(ends.select("c", "first", "n"))
    hot = F.broadcast(ends.orderBy(F.desc("n"), "c").limit(HOT).select("c", F.col("first").alias("hot")))
    marked = named.join(hot, "c", "left")
    often = marked.where("hot is not null").select(*named.columns, (place != F.col("hot")).alias("later"))
    rest = marked.where("hot is null").join(ends.select("c", "first"), "c").select(*named.columns, (place != F.col("first")).alias("later"))
    return often.unionByName(rest).dropDuplicates(["d", "h", "pos", *(["length"] if "length" in named.columns else [])])


def _pairs(left: DataFrame, right: DataFrame, offset) -> DataFrame:
    """Rows of ``left`` with the name ``c2`` that ``right`` has ``offset`` lines further on."""
    there = right.select(F.col("d").alias("d2"), F.col("h").alias("h2"), F.col("pos").alias("pos2"), F.col("c").alias("c2"))
    return left.withColumn("to", F.col("pos") + offset).join(there, F.col("d").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")) & (F.col("to") == F.col("pos2")))


def later_copies(docs: DataFrame, min_words: int) -> DataFrame:
    """(d, h, pos, length) of the shortest runs of ``min_words`` words that an earlier place holds whole."""
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))
    lines = store(texts.mapInArrow(_scan(min_words), "d long, h long, pos int, c binary, runs array<int>"))
    places, found, k = store(_intervals(lines)), None, 0
    while True:
        size = 1 << k
        part = places.where(F.col("later") & F.array_contains("runs", size)).select("d", "h", "pos", F.lit(size).alias("length"))
        found = part if found is None else found.unionByName(part)
        if size > 1:
            asked = places.select("d", "h", "pos", "c", F.explode(F.expr(f"filter(runs, x -> x > {size} and x < {2 * size})")).alias("length"))
            whole = _pairs(asked, places, F.col("length") - size).select("d", "h", "pos", "length", F.expr("unhex(md5(concat(c, c2, cast(cast(length as string) as binary))))").alias("c"))
            found = found.unionByName(_intervals(store(whole)).where("later").select("d", "h", "pos", "length"))
        if 2 * size > min_words:
            return found
        longer = places.select("d", "h", "pos", "c", "runs")
        named = _pairs(longer, places, F.lit(size)).select("d", "h", "pos", F.expr("unhex(md5(concat(c, c2)))").alias("c"), "runs")
        places, k = store(_intervals(store(named))), k + 1


def delete_runs(text: str, marks: list[tuple[int, int]]) -> tuple[str, int, int]:
    """The text without the runs ``marks`` (first line, length), its non-blank lines and how many of them went."""
    lines = text.split("\n")
    solid = [i for i, x in enumerate(lines) if x.strip(_BLANK)]
    edge = np.zeros(len(solid) + 1, np.int64)
    for start, length in marks:
        edge[start] += 1
        edge[start + length] -= 1
    gone = np.cumsum(edge)[:-1] > 0
    if not gone.any():
        return text, len(solid), 0
    dead = {solid[i] for i in np.flatnonzero(gone)}
    left = "" if gone.all() else "\n".join(x for i, x in enumerate(lines) if i not in dead)
    return left, len(solid), int(gone.sum())


def dedup_lines(docs: DataFrame, *, min_words: int = 10) -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from ``text``, and the columns
    ``n_lines`` and ``n_deleted``."""
    docs = docs.drop("n_lines", "n_deleted")
    key, hashed, marks = fresh(docs, "d", "h", "marks")
    found = later_copies(docs, min_words).groupBy("d", "h").agg(F.collect_list(F.struct("pos", "length")).alias(marks)).withColumnsRenamed({"d": key, "h": hashed})
    joined = docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(hashed)), "left").drop(key, hashed)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.IntegerType()), T.StructField("n_deleted", T.IntegerType())])
    names, text = docs.columns, docs.columns.index("text")

    def edit(batches):
        for part in (p for whole in batches for p in slices(whole, text)):
            out = []
            for t, m in zip(part.column(text).to_pylist(), part.column(len(names)).to_pylist(), strict=True):
                out.append((t, 0, 0) if t is None else delete_runs(t, [(x["pos"], x["length"]) for x in m or ()]))
            columns = [part.column(i) for i in range(len(names))]
            columns[text] = pa.array([o[0] for o in out], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32())], names=[*names, "n_lines", "n_deleted"])

    return joined.mapInArrow(edit, schema)
