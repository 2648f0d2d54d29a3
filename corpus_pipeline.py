"""From raw documents to training tokens: quality, line dedup, near-dedup, mixing, encoding.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and reread as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from curatum.llm import bpe, linededup, minhash, mixing, quality
from curatum.llm.queries import tokenizer_path
from curatum.llm.support import fresh, store, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from ``labels``, does not reject: each row by its own text."""
    scores = quality.text_scores(docs, table(spark, sf_dir, "labels")).where("predicted = 0")
    key, text = fresh(docs, "id", "hash")
    gone = store(scores.select(F.col("doc_id").alias(key), F.col("text_hash").alias(text)).distinct())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & quality.text_hash().eqNullSafe(F.col(text))
    return docs.join(gone, same, "left_anti").select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and with them documents that have no other line."""
    edited = linededup.dedup_lines(docs).where("n_deleted = 0 or text <> ''")
    return edited.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def _numbered(docs: DataFrame, node: str, twin: str) -> DataFrame:
    """``docs`` with ``node``, one number for each different (doc_id, text), and ``twin``: whether it is not the doc_id itself.

    A doc_id that no other row has is the row's number. Rows whose id is null or repeated are
    numbered above all ids, or below them where those reach 2 ** 62; where ids leave no room at either
    end, all rows are numbered anew.
    """
    (key, text, number) = fresh(docs, "id", "hash", "number")
    id, hashed = F.col("doc_id").cast("long"), F.coalesce(quality.text_hash(), F.lit(""))
    low, high = docs.agg(F.min(id), F.max(id)).first()
    room = low is None or high < 1 << 62 or low > -(1 << 62)
    start = F.lit(0 if low is None or not room else high + 1 if high < 1 << 62 else low - 1).cast("long")
    sign = -1 if room and high is not None and high >= 1 << 62 else 1
    shared = docs.groupBy(id.alias(key)).agg(F.count("*").alias(number)).where(F.col(key).isNull() | (F.col(number) > 1) | F.lit(not room)).select(key)
    twins = docs.select(id.alias("_i"), hashed.alias(text)).join(shared, F.col("_i").eqNullSafe(F.col(key)), "left_semi").distinct()
    twins = store(twins.select(F.col("_i").alias(key), text, (start + F.monotonically_increasing_id() * sign).alias(number)))
    found = docs.join(twins, id.eqNullSafe(F.col(key)) & (hashed == F.col(text)), "left")
    return found.select(*docs.columns, F.coalesce(F.col(number), id).alias(node), F.col(number).isNotNull().alias(twin))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest number.

    A document is a row, known by its doc_id and text together: texts that share an id, or have none,
    are judged apart, and of rows equal in both one stays, whatever their text, and whichever has the
    smallest hash of all columns. A unique id is its row's number; rows of other ids come after all of
    these, or before them where ids reach 2 ** 62.

    Links are taken from a similarity of 0.8; with 13 bands a pair there is missed with
    probability 2 * (1 - 0.8 ** 3) ** 13 = 0.00018.
    """
    node, twin, gone_id, row = fresh(docs, "node", "twin", "gone", "row")
    rows = _numbered(docs, node, twin)
    judged = minhash.node_table(rows.select(F.col(node).alias("doc_id"), "text"), percent=80, bands=13, rows=3)
    gone = store(judged.where("not kept").select(F.col("doc_id").alias(gone_id)).distinct())
    left = rows.join(gone, F.col(node) == F.col(gone_id), "left_anti")
    first = F.min_by(F.struct(*docs.columns), F.xxhash64(*(F.col(c).cast("string") for c in docs.columns))).alias(row)
    ones = left.where(F.col(twin)).groupBy(node).agg(first).select(f"{row}.*")
    return left.where(~F.col(twin)).select(docs.columns).unionByName(ones)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's share of the mix takes it."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document copy, encoded and decoded again."""
    return bpe.digests(docs, tokenizer_path())


STAGES = [("quality classifier", keep_quality), ("line dedup", dedup_lines), ("MinHash near-dedup", dedup_near), ("mixing sources", mix_sources), ("BPE encoding", encode)]

#: The discriminant's floating-point fit and the token ids have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir))
    return docs
