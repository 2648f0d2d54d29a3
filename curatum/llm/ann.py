"""Approximate nearest neighbours by a permutation index.

A vector is represented by its ``prefix`` nearest pivots in order. A shard of vectors keeps,
for each pivot, an inverted file: a row that says of each vector at which place it has the pivot, if at all. A query's
candidates are ranked by the footrule distance of the two orders, a pivot outside a prefix
counting as place ``prefix``. The best of each shard are reranked by exact cosine, and each query's best
rows are the answer. Over all shards ``effort`` times the square root of the number of vectors are
reranked, but at least ``k`` a shard: neighbours get nearer, and easier to rank, as the table
grows (recall at the defaults is measured in the tests, on tables of which a fraction is reranked).

Pivots are a bounded, documented sample: the ``pivots`` vectors with the smallest id hashes.
Every valid vector is indexed: its pivots are found once and stored with it. Queries and vectors
meet in a grid of blocks (query block x
vector shard), both bounded, so no task holds all queries or all vectors. The footrule is summed for all
pairs of the grid, so that work grows with queries times vectors; only the reranking does not.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component, and
rows without an id, take no part; of rows sharing an id the one with the smallest vector counts;
vectors of different lengths have no cosine and are searched apart, each length with pivots of
its own; equal vectors tie and the smaller id comes first, in the ranking by footrule as in the result; without queries the
answer is empty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .support import store

_FIELDS = "query_id long, vec_id long, score double"


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _nearest(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The ``prefix`` nearest pivots of each row, nearest first."""
    return np.argsort(-(_unit(x) @ pivots.T), axis=1, kind="stable")[:, :prefix]


def _indexer(pivots: np.ndarray, prefix: int):
    """Adds the place order of each vector's nearest pivots, and the vector itself as bytes."""

    def index(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            order = _nearest(x, pivots, prefix).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([o.tobytes() for o in order], pa.binary())], names=["vec_id", "q", "vector", "places"])

    return index


def _search_cell(queries: pd.DataFrame, vectors: pd.DataFrame, n_pivots: int, share: float, k: int) -> pd.DataFrame:
    if not len(vectors) or not len(queries):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    vectors = vectors.sort_values("vec_id")
    v_ids, q_ids = vectors.vec_id.to_numpy(), queries.vec_id.to_numpy()
    of = lambda column, kind: np.stack([np.frombuffer(x, kind) for x in column])
    v, q, order, asked = of(vectors.vector, float), of(queries.vector, float), of(vectors.places, np.uint16), of(queries.places, np.uint16)
    prefix = order.shape[1]
    near = (prefix - np.arange(prefix)).astype(np.uint8)[:, None]
    files = np.zeros((n_pivots, len(v)), np.uint8)  # of each pivot: prefix less its place in each vector's order, 0 outside
    files[order.T, np.arange(len(v))] = near
    n = min(len(v), max(k, int(np.ceil(share * len(v)))))
    norms, lengths = np.sqrt((v * v).sum(1)), np.sqrt((q * q).sum(1))
    found_q, found_v, scores = [], [], []
    for i, ranks in enumerate(asked):
        # the footrule is prefix * (prefix + 1) less twice, over shared pivots, the smaller of both nearnesses
        shared = np.minimum(files[ranks], near).sum(0, dtype=np.uint16)
        best = np.argsort(np.uint16(0xFFFF) - shared, kind="stable")[: n + 1]
        best = best[v_ids[best] != q_ids[i]][:n]
        score = (v[best] @ q[i]) / (norms[best] * lengths[i])
        top = np.lexsort((v_ids[best], -score))[:k]
        found_q.append(np.full(len(top), q_ids[i]))
        found_v.append(v_ids[best][top])
        scores.append(score[top])
    return pd.DataFrame({"query_id": np.concatenate(found_q), "vec_id": np.concatenate(found_v), "score": np.concatenate(scores)})


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 5, pivots: int = 256, prefix: int = 64, effort: float = 12.0, shard_rows: int = 4096, query_rows: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of every row of ``vectors`` (vec_id,
    embedding) for which ``is_query`` holds. ``prefix`` is at most 255."""
    if not 0 < prefix < 256:
        raise ValueError("prefix must be 1 to 255")
    spark = vectors.sparkSession
    x = F.expr("transform(embedding, e -> cast(e as double))")
    valid = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("q")).where(
        "vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, e -> e is not null and not isnan(e) and abs(e) < double('Infinity')) and exists(embedding, e -> e <> 0)"
    )
    valid = store(valid.groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.max("q").alias("q")))
    found = None
    for width in [r[0] for r in valid.groupBy(F.size("embedding").alias("n")).agg(F.max("q").alias("q")).where("q").select("n").collect()]:
        part = _nearest_of(valid.where(F.size("embedding") == width), k, pivots, prefix, effort, shard_rows, query_rows)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double") if found is None else found


def _nearest_of(valid: DataFrame, k: int, pivots: int, prefix: int, effort: float, shard_rows: int, query_rows: int) -> DataFrame:
    """``nearest`` among vectors of one length."""
    points = _unit(np.array([r[0] for r in valid.orderBy(F.xxhash64("vec_id"), "vec_id").select("embedding").limit(pivots).collect()]))
    index = store(valid.select("vec_id", "embedding", "q").mapInArrow(_indexer(points, min(prefix, len(points))), "vec_id long, q boolean, vector binary, places binary"))
    n, n_q = index.agg(F.count("*"), F.count(F.when(F.col("q"), 1))).first()
    shards, blocks = -(-n // shard_rows), max(1, -(-n_q // query_rows))
    of = lambda col, m: F.pmod(F.xxhash64(F.col(col), F.lit(m)), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = index.where("q").select("vec_id", "vector", "places", of("vec_id", blocks).alias("block"), every(shards).alias("shard"))
    right = index.select("vec_id", "vector", "places", of("vec_id", shards).alias("shard"), every(blocks).alias("block"))
    cell = lambda a, b: _search_cell(a, b, len(points), effort / n**0.5, k)
    found = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInPandas(cell, _FIELDS)
    best = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("d"), "vec_id", "score"))), 1, k).alias("top"))
    return best.select("query_id", F.posexplode("top").alias("pos", "hit")).select("query_id", (F.col("pos") + 1).alias("rank"), "hit.vec_id", "hit.score")
