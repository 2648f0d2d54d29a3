"""Readers and writers of entry files and of the curated tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import answers as A
from ..operators import formats
from ..operators.ingest import shared_dir

ENTRY = "id long, prompt string, chosen string, rejected string"


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share."""
    return f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"


def read_entries(spark: SparkSession, path: str, schema: str = ENTRY, *, quarantine: bool = False) -> DataFrame:
    """Entries of JSON Lines files, or of JSON list files where ``path`` ends in ``.json``.

    Blank lines are skipped. Malformed input is an error; with ``quarantine`` its text comes back
    in ``_corrupt_record`` instead.
    """
    reader = spark.read.option("multiLine", path.endswith(".json"))
    if quarantine:
        return reader.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return reader.schema(schema).option("mode", "FAILFAST").json(path)


def export_training(entries: DataFrame, target: str, path: str, *, partition_by: tuple[str, ...] = ()) -> None:
    """Write (id, prompt, chosen, rejected) as JSON Lines of format ``target``; alpaca too, since one array needs one writer."""
    rows = formats.write(entries, target)
    if partition_by:
        rows = rows.join(entries.select("id", *partition_by), "id")
    rows.write.mode("overwrite").partitionBy(*partition_by).json(path)


def append_rows(rows: DataFrame, path: str, *, day: str = "created_at") -> None:
    """Append a batch to a table of date partitions; rows are rebalanced so that a day gets few files and a large day several tasks."""
    rows.withColumn("day", F.to_date(day)).hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(path)


def _content(columns: list[str], key: str) -> list:
    return [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns if c != key]


def keyed(rows: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` whose null keys are the hash of their content."""
    return rows.withColumn(key, F.coalesce(key, F.abs(F.xxhash64(*_content(rows.columns, key))).cast(rows.schema[key].dataType)))


def newest(rows: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """The row with the highest ``version`` of each ``key``; ties go by content.

    ``max_by`` combines before the shuffle, so that no key's history is sorted in one task.
    """
    columns = rows.columns
    best = F.max_by(F.struct(*columns), F.struct(version, F.xxhash64(*_content(columns, key)))).alias("_r")
    return rows.groupBy(F.col(key).alias("_k")).agg(best).select(*(F.col(f"_r.{c}").alias(c) for c in columns))


def upsert(old: DataFrame, new: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """The merged rows of two tables; :mod:`.versioned` merges into a stored one."""
    return newest(keyed(old.unionByName(new), key), key, version)


def write_routed(scored: DataFrame, path: str, threshold: float = 0.7) -> None:
    """Store rows with ``confidence`` and ``subject`` by route, domain and subject; readers prune by folder."""
    domain = F.split_part("subject", F.lit("_"), F.lit(1))
    scored.withColumn("route", A.route(F.col("confidence"), threshold)).withColumn("domain", domain).hint("rebalance", "route", "subject").write.mode("overwrite").partitionBy("route", "domain", "subject").parquet(path)


def page_text_documents(pages: DataFrame) -> DataFrame:
    """(doc, text, page_count, word_count, content_hash) from page texts (doc, page_no, text), in page order."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    docs = pages.groupBy("doc").agg(F.array_join(parts, "\n\n").alias("text"), F.count("*").alias("page_count"))
    return docs.withColumn("word_count", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).withColumn("content_hash", F.sha2("text", 256))
