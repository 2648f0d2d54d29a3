"""Centroid clustering on bit planes.

A vector of 64 integers is kept as its bit planes: plane ``p`` is one 64-bit word that holds
bit ``p`` of every component, in two's complement, so the last plane weighs ``-2 ** p``. The
dot product of two vectors is the sum over pairs of planes of ``weight * weight * popcount(plane
AND plane)``; with the dot products of each vector with itself it gives exact squared distances.
Rows need as many planes as their largest component has bits; shorter rows are extended by
repeating their last plane.

Vectors are packed once. Each round is one pass over the packed table: tasks hand on one row of
sums for each centroid, Spark adds them up, and the driver divides ``k`` sums of 64 numbers.
The centroids that travel to the tasks and the table of cluster totals have ``k`` rows.

Defined cases: vectors that are null, of another length than 64, or hold null or non-finite
components take no part; components beyond 2 ** 26 after scaling count as 2 ** 26, so that
every distance fits a long, and sums of distances stop at the largest long; a null id counts as
an empty one when the first centroids are drawn, rows with one id are told apart by their
components, and equal rows may each be a first centroid (the larger number stays empty). With
fewer than ``k`` vectors there are as many centroids as vectors; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .support import store

LANES = 64
MOST = 1 << 26
_ROWS = 4096
_U = np.uint64


def pack(values: np.ndarray) -> np.ndarray:
    """Planes (rows, bits) as 64-bit words of integers (rows, 64); two's complement."""
    bits = max(int(np.max(values, initial=0)), -int(np.min(values, initial=0)) - 1, 0).bit_length() + 1
    shifted = (values[:, None, :] >> np.arange(bits)[None, :, None]) & 1
    return np.packbits(shifted.astype(np.uint8), axis=2, bitorder="little").view("<u8").reshape(len(values), bits)


def unpack(planes: np.ndarray) -> np.ndarray:
    """The integers of ``planes``."""
    bits = np.unpackbits(np.ascontiguousarray(planes).astype("<u8").view(np.uint8).reshape(*planes.shape, 8), axis=2, bitorder="little")
    return np.tensordot(bits.astype(np.int64), weights(planes.shape[1]), axes=(1, 0))


def weights(bits: int) -> np.ndarray:
    w = np.left_shift(np.int64(1), np.arange(bits, dtype=np.int64))
    w[-1] = -w[-1]
    return w


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact dot products (rows of a, rows of b) from planes: counts of one weight are added before they are scaled."""
    p, q = a.shape[1], b.shape[1]
    total = np.zeros((len(a), len(b)), np.int64)
    for power in range(p + q - 1):
        counts = np.zeros(total.shape, np.int16)
        for i in range(max(0, power - q + 1), min(p, power + 1)):
            j = power - i
            both = np.bitwise_count(a[:, i, None] & b[None, :, j])
            (np.subtract if (i == p - 1) != (j == q - 1) else np.add)(counts, both, out=counts)
        total += counts.astype(np.int64) << power
    return total


def own_dots(a: np.ndarray) -> np.ndarray:
    """Dot product of each row of planes with itself."""
    w = weights(a.shape[1])
    total = np.zeros(len(a), np.int64)
    for i in range(a.shape[1]):
        total += w[i] * (np.bitwise_count(a[:, i, None] & a).astype(np.int64) @ w)
    return total


def nearest(planes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's nearest centroid, the smallest of equals, and the squared distance."""
    distance = own_dots(planes)[:, None] - 2 * dots(planes, centroids) + own_dots(centroids)[None, :]
    cluster = np.argmin(distance, axis=1)
    return cluster, distance[np.arange(len(planes)), cluster]


def _planes_of(column: pa.ListArray) -> np.ndarray:
    """Planes of a batch; rows with fewer planes repeat their last one."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    sizes = np.diff(offsets)
    if not len(sizes):
        return np.zeros((0, 1), _U)
    at = np.minimum(np.arange(sizes.max())[None, :], sizes[:, None] - 1) + offsets[:-1, None] - offsets[0]
    return column.flatten().to_numpy().astype(np.int64).view(_U)[at]


def _packed(batches):
    for batch in batches:
        for part in (batch.slice(i, _ROWS) for i in range(0, batch.num_rows, _ROWS)):
            values = part.column("ints").flatten().to_numpy().astype(np.int64).reshape(-1, LANES)
            planes = pack(values).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(planes) + 1, dtype=np.int32) * planes.shape[1]), pa.array(planes.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("id"), lists], ["id", "planes"])


def integers(vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, ints): the vectors that take part, each component as ``floor(scale * x)``."""
    usable = (F.size(vector) == LANES) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ints = F.transform(vector, lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(x.cast("double") * scale))).cast("long"))
    return vectors.where(F.coalesce(usable, F.lit(False))).select(F.col(id).alias("id"), ints.alias("ints"))


def first_centroids(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The ``k`` vectors with the smallest hash of their id."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    drawn = rows.orderBy(key, "ints").limit(k).select("ints").collect()
    return np.array([r["ints"] for r in drawn], np.int64).reshape(-1, LANES)


def _summing(centroids: np.ndarray):
    packed = pack(centroids)

    def run(batches):
        n, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), LANES), np.int64)
        for batch in batches:
            for part in (batch.slice(i, _ROWS) for i in range(0, batch.num_rows, _ROWS)):
                planes = _planes_of(part.column("planes"))
                cluster, _ = nearest(planes, packed)
                order = np.argsort(cluster, kind="stable")
                starts = np.flatnonzero(np.diff(cluster[order], prepend=-1))
                hit = cluster[order][starts]
                sums[hit] += np.add.reduceat(unpack(planes)[order], starts, axis=0)
                n += np.bincount(cluster, minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(list(sums[at]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def _assigning(centroids: np.ndarray):
    packed = pack(centroids)

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, _ROWS) for i in range(0, batch.num_rows, _ROWS)):
                cluster, distance = nearest(_planes_of(part.column("planes")), packed)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    return run


def moved(packed: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: exact floor of the mean of each one's vectors; empty ones stay."""
    parts = packed.select("planes").mapInArrow(_summing(centroids), "cluster int, n long, sums array<long>")
    lane = lambda i: F.sum(F.col("sums")[i].cast("decimal(28,0)")).alias(f"s{i}")
    out = centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *map(lane, range(LANES))).collect():
        out[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(LANES)]
    return out


def cluster(vectors: DataFrame, *, k: int = 40, rounds: int = 5, salt: str = "2", scale: int = 256, id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every vector that takes part, and the final centroids (k, 64)."""
    rows = integers(vectors, id=id, vector=vector, scale=scale)
    kind = rows.schema["id"].dataType.simpleString()
    packed = store(rows.mapInArrow(_packed, f"id {kind}, planes array<long>"))
    centroids = first_centroids(rows, k, salt)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(packed, centroids)
    if not len(centroids):
        return packed.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    return packed.mapInArrow(_assigning(centroids), f"id {kind}, cluster int, distance long"), centroids


def digest(centroid) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def cluster_report(vectors: DataFrame, **parameters) -> DataFrame:
    """vec_id, cluster, distance, the sums of distances over the cluster and over all, and the digest of the centroid."""
    found, centroids = cluster(vectors, **parameters)
    found = store(found)
    whole = lambda x: F.least(x, F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("of_cluster"))
    sums = sums.join(sums.agg(F.sum("of_cluster").alias("of_all")).hint("broadcast"), how="cross")  # one row
    names = found.sparkSession.createDataFrame([(i, digest(c)) for i, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    totals = names.join(sums, "cluster").select("cluster", whole(F.col("of_cluster").cast("decimal(38,0)")).alias("cluster_inertia"), whole(F.col("of_all").cast("decimal(38,0)")).alias("inertia"), "centroid_sha256")
    return found.join(F.broadcast(totals), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round(n: int) -> str:
    """SQL of one round: vectors with their cluster, then the centroids after it."""
    return f"""
a{n} AS (SELECT r, arg_min(c, ROW(d, c)) AS c, min(d) AS d FROM (
    SELECT v.r, k.c, list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, k.x) + list_inner_product(k.x, k.x) AS d FROM ints v CROSS JOIN c{n} k) GROUP BY r),
m{n} AS (SELECT c, list(s ORDER BY i) AS x FROM (SELECT a.c, l.i, floor(sum(l.x) / count(*)) AS s FROM a{n} a JOIN lanes l ON a.r = l.r GROUP BY a.c, l.i) GROUP BY c),
c{n + 1} AS (SELECT k.c, coalesce(m.x, k.x) AS x FROM c{n} k LEFT JOIN m{n} m ON k.c = m.c)"""


ORACLE = f"""
WITH ints AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
lanes AS MATERIALIZED (SELECT r, generate_subscripts(x, 1) AS i, unnest(x) AS x FROM ints),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INTEGER) AS c, x FROM (SELECT sha256('2:' || vec_id) AS h, x FROM ints ORDER BY h, x LIMIT 40)),{",".join(map(_round, range(6)))}
SELECT v.vec_id, a.c AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(k.x, lambda y: CAST(y AS BIGINT)), ',')) AS centroid_sha256
FROM a5 a JOIN ints v ON a.r = v.r JOIN c5 k ON a.c = k.c
"""
