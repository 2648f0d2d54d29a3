"""Shared plumbing: reading tables and cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import ctypes
import re
import uuid
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data directory, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder driver and executors share: ``spark.checkpoint.dir``, or one in the warehouse where it is
    unset and every task runs in this process or the warehouse is remote; an error else."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if urlparse(warehouse).scheme in ("", "file") and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{warehouse}/curatum-stored"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many leading underscores as keep it apart from the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and return that table.

    The lineage is cut: a lost executor only makes Spark reread files, and what several
    branches use is computed once. The files live as long as the shared folder does.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_memory() -> None:
    """Give memory that a finished block of work has freed back to the system, where the platform can:
    Python workers live on, and what they keep adds up on their machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
