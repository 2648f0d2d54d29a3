"""Mixing sources to target weights, with DataFrame functions only.

Documents get a random key (a hash of their id and text). Within each source the keys are split into
ranges, about as many as the square root of the source's rows, so that neither a range nor
the list of ranges grows out of hand; word counts are summed per range, ranges get their
prefix sums, and rows are sorted and summed within their range. Together these are the
source's prefix sums in key order; a hot source is spread over all its ranges. Each source is
cut at its exact budget; a budget above the source's size repeats whole epochs first.

Defined cases: a null or empty text has size 0 and is taken 0 times; a null source is a source
of its own, last in order; a null doc_id counts as the empty string; rows equal in doc_id and
text have one key and, where whole documents are delivered, are delivered alike; an empty table
gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .support import fresh, store

WORD = r"[^\x20\x09-\x0D]+"


def _key():
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).cast("binary"))


def budgets(sources: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Add ``target`` to ``sources(source, source_size, n)``: ``share`` of all sizes dealt by the
    repeating ``weights`` in code point order of the sources, none above ``most`` times its size.

    The water level of the excess dealt again is the largest of the levels at which the first
    sources, by size per weight, are full. The windows run over the list of sources.
    """
    ordered = W.orderBy(F.col("source").asc_nulls_last())
    by_room = W.orderBy("room", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))).cast("int") + 1)
    full = F.col("source_size") * F.lit(float(most))
    rows = sources.withColumn("weight", weight).withColumn("room", full / F.col("weight"))
    before = F.coalesce(F.sum(full).over(by_room.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_room.rowsBetween(0, W.unboundedFollowing))
    everything = W.partitionBy()
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - before) / rest)
    return rows.withColumn("target", F.least(full, F.col("weight") * F.max("level").over(everything))).drop("weight", "room", "level")


def mix(docs: DataFrame, *, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, source, key, size, source_size, target, epochs, taken for every row of ``docs``.

    ``taken`` counts the words taken of a document: ``epochs`` whole passes, and in the last,
    partial pass those before the source's cut.
    """
    sized = store(docs.select("doc_id", "source", _key().alias("key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = budgets(sources, weights, share, most)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    plan = store(plan.withColumn("rest", F.floor("target") - F.col("epochs") * F.col("source_size")).withColumn("ranges", F.ceil(F.sqrt("n"))).withColumnRenamed("source", "_s"))
    at = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 4294967296.0 * F.col("ranges")).cast("long")
    placed = sized.join(plan, F.col("source").eqNullSafe(F.col("_s"))).withColumn("range", at)
    sums = placed.groupBy("source", "range").agg(F.sum("size").alias("words"))
    ahead = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_r"), F.col("range").alias("_at"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    within = W.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = placed.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("_r")) & (F.col("range") == F.col("_at")))
    last = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("ahead") - F.col("inner")))
    return rows.select("doc_id", "source", "key", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + last).alias("taken"))


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, the document at a source's cut whole."""
    rows = mix(docs, **parameters)
    of, whole, cut, copies, copy = fresh(docs, "of", "whole", "cut", "copies", "copy")
    taken_last = F.col("taken") > F.col("epochs") * F.col("size")
    cuts = store(rows.groupBy("source").agg(F.max("epochs").alias(whole), F.max(F.when(taken_last, F.col("key"))).alias(cut)).withColumnRenamed("source", of))
    size = F.regexp_count("text", F.lit(WORD))
    times = F.when(F.coalesce(size, F.lit(0)) > 0, F.col(whole) + F.coalesce(_key() <= F.col(cut), F.lit(False)).cast("long")).otherwise(0)
    out = docs.join(cuts, F.col("source").eqNullSafe(F.col(of)), "left").withColumn(copies, times).where(F.col(copies) > 0)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(docs.columns)


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(text, ''))) AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM sources),
room AS (SELECT *, source_size * 2.0::DOUBLE AS full_size, source_size * 2.0::DOUBLE / weight AS room FROM weighed),
levels AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
    - coalesce(sum(full_size) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / CAST(sum(weight) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM room),
targets AS (SELECT source, source_size, least(full_size, weight * max(level) OVER ()) AS target FROM levels),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM targets),
summed AS (SELECT s.*, p.source_size, p.target, p.epochs, CAST(floor(p.target) AS BIGINT) - p.epochs * p.source_size AS rest,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id NULLS FIRST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + least(size, greatest(0, rest - ahead)) AS BIGINT) AS taken FROM summed
"""
