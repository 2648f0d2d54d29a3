"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class k has mean m_k and covariance S_k; the covariance used is

    (1 - gamma) * ((1 - lam) * S_k + lam * S_pooled) + gamma * I

on standardised statistics. A text's score is the logistic of the difference of the classes'
log densities, each ``-0.5 * |L_k^-1 (x - m_k)|^2 - log det L_k + log prior_k`` with the
Cholesky factor L_k computed once and cached for all rows.

Plan: one scan turns whole texts into statistics (numpy over byte classes and word hashes),
stored; class sums and outer products are summed per partition and then by Spark, so the
driver receives 2 * (1 + d + d^2) numbers whatever the number of labels; scoring is one pass
over the stored statistics.

Defined cases: null and empty texts have the statistics of a text without words and get a
score; a label that is null or not 0/1 is not learned; several labels of one document all
count; rows with a null doc_id are scored and never held out; if a class has no training row,
every score is the share of label 1 among the training rows (0.5 without any).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .support import store
from .tokens import slices, text_bytes, word_hashes

_SYMBOLS = b"#$%&*!|<>{}[]=~^_@+/\\`"
_CLASSES = {
    "upper": range(0x41, 0x5B), "lower": range(0x61, 0x7B), "digit": range(0x30, 0x3A), "symbol": _SYMBOLS,
    "stop": b".,;:?", "newline": b"\n", "high": range(0x80, 0x100), "bang": b"!",
}
STATISTICS = (
    "log_words", "word_length", "upper_share", "digit_share", "symbols_per_word", "stops_per_word", "words_per_line",
    "high_share", "distinct_words", "repeated_neighbour", "top_word", "bangs_per_word", "letters_share", "longest_run",
)
#: Words added to a text's own, so that one repetition in a short text weighs little.
_PRIOR = 15


def _statistics(batches):
    tables = {name: np.isin(np.arange(256), list(members)) for name, members in _CLASSES.items()}
    for batch in (part for whole in batches for part in slices(whole, 1, 1 << 21)):
        ids, out = batch.column(0).cast(pa.int64()), _block(text_bytes(batch.column(1)), tables)
        values = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), len(STATISTICS)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([ids, values, *batch.columns[2:]], names=["doc_id", "x", *batch.schema.names[2:]])


def _block(texts: list[bytes], tables: dict[str, np.ndarray]) -> np.ndarray:
    raw = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)
    sizes = np.array([len(t) for t in texts], float)
    start = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])).astype(np.int64)
    n = {name: np.add.reduceat(t[raw].astype(np.int32), start).astype(float) for name, t in tables.items()}
    n["newline"] -= 1
    words, counts = word_hashes(texts)
    count = counts.astype(float)
    doc = np.repeat(np.arange(len(texts)), counts)
    distinct = top = same = run = np.zeros(len(texts))
    if len(words):
        order = np.lexsort((words, doc))
        d, w = doc[order], words[order]
        first = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (w[1:] != w[:-1])))
        times = np.diff(np.append(first, len(w)))
        distinct = np.bincount(d[first], minlength=len(texts)).astype(float)
        top = np.zeros(len(texts))
        np.maximum.at(top, d[first], times)
        equal = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
        same = np.bincount(doc[1:][equal], minlength=len(texts)).astype(float)
        starts = np.flatnonzero(np.append(True, ~equal))
        run = np.zeros(len(texts))
        np.maximum.at(run, doc[starts], np.diff(np.append(starts, len(words))))
    some, chars = np.maximum(count, 1), np.maximum(sizes, 1)
    letters = n["upper"] + n["lower"] + n["high"]
    share = lambda a, b: np.arcsin(np.sqrt(np.clip(a / b, 0, 1)))
    return np.column_stack([
        np.log1p(count), np.log1p(letters / some), share(n["upper"], np.maximum(letters, 1)), share(n["digit"], chars), np.log1p(4 * n["symbol"] / (some + 2)),
        np.log1p(4 * (n["stop"] + 1) / (some + 8)), np.log1p(count / (n["newline"] + 1)), share(n["high"], chars), np.log1p(distinct) / np.log(some + 1.72),
        share(same, some + _PRIOR), share(np.maximum(top - 2, 0), some + _PRIOR), np.log1p(4 * n["bang"] / (some + 2)), share(letters + 10, chars + 12), np.log1p(np.maximum(run - 2, 0)),
    ])


def text_hash() -> Column:
    """Tells texts apart where rows share a doc_id; null for a null text."""
    return F.md5(F.col("text").cast("string"))


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x, text_hash): the transformed statistics of each text, in the order of ``STATISTICS``."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_hash().alias("text_hash")).mapInArrow(_statistics, "doc_id long, x array<double>, text_hash string")


def _moments(frames):
    held: dict[int, list] = {}
    for pdf in frames:
        for k, part in pdf.groupby("label"):
            x = np.stack(part.x.to_numpy())
            n, s, q = held.get(int(k), (0, 0, 0))
            held[int(k)] = (n + len(x), s + x.sum(0), q + x.T @ x)
    for k, (n, s, q) in held.items():
        flat = np.concatenate([[n], s, q.ravel()])
        yield pd.DataFrame({"label": k, "i": np.arange(len(flat)), "v": flat})


class Discriminant:
    """Fitted model: per class the centre, the Cholesky factor and the constant of its log density."""

    def __init__(self, moments: dict[int, np.ndarray], lam: float, gamma: float):
        d = len(STATISTICS)
        n = {k: moments[k][0] if k in moments else 0.0 for k in (0, 1)}
        self.share = n[1] / (n[0] + n[1]) if n[0] + n[1] else 0.5
        self.classes = None
        if not n[0] or not n[1]:
            return
        total = moments[0] + moments[1]
        self.centre = total[1 : d + 1] / total[0]
        spread = np.sqrt(np.maximum(total[d + 1 :].reshape(d, d).diagonal() / total[0] - self.centre**2, 0))
        self.scale = np.where(spread > 1e-6, spread, 1.0)
        mean, cov = {}, {}
        for k in (0, 1):
            m = moments[k][1 : d + 1] / n[k]
            mean[k] = (m - self.centre) / self.scale
            cov[k] = (moments[k][d + 1 :].reshape(d, d) / n[k] - np.outer(m, m)) / np.outer(self.scale, self.scale)
        pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
        self.classes = []
        for k in (0, 1):
            factor = np.linalg.cholesky((1 - gamma) * ((1 - lam) * cov[k] + lam * pooled) + gamma * np.eye(d))
            self.classes.append((mean[k], np.linalg.inv(factor), np.log(n[k]) - np.log(factor.diagonal()).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), self.share)
        z = (x - self.centre) / self.scale
        density = [c - 0.5 * (((z - m) @ inv.T) ** 2).sum(1) for m, inv, c in self.classes]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -60, 60)))


def fit(stats: DataFrame, labels: DataFrame, *, lam: float = 0.1, gamma: float = 0.02) -> Discriminant:
    """Fit on ``stats(doc_id, x)`` joined with ``labels(doc_id, label)``."""
    rows = stats.join(labels.where("label in (0, 1)").select("doc_id", F.col("label").cast("int").alias("label")), "doc_id").select("label", "x")
    sums = rows.mapInPandas(_moments, "label int, i int, v double").groupBy("label", "i").agg(F.sum("v").alias("v")).orderBy("label", "i").toPandas()
    return Discriminant({int(k): part.v.to_numpy() for k, part in sums.groupby("label")}, lam, gamma)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, *, lam: float = 0.1, gamma: float = 0.02) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; learned from ``labels(doc_id, quality)``
    of documents that are not held out. ``lam`` and ``gamma`` are the shrinkage weights."""
    return text_scores(docs, labels, lam=lam, gamma=gamma).drop("text_hash")


def text_scores(docs: DataFrame, labels: DataFrame, *, lam: float = 0.1, gamma: float = 0.02) -> DataFrame:
    """``quality_scores`` with the ``text_hash`` of each row, which with its doc_id finds the row again."""
    stats = store(statistics(docs))
    model = fit(stats, labels.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label")), lam=lam, gamma=gamma)

    def scored(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(model.score(x), 9)), batch.column(2)], names=["doc_id", "score", "text_hash"])

    out = stats.mapInArrow(scored, "doc_id long, score double, text_hash string")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "text_hash")
