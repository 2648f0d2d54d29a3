"""Versioned tables: copy-on-write folders and one manifest file a version.

A table is a folder with ``data/`` and ``versions/``. Rows lie in hash buckets of their key; a
commit writes new folders for the buckets it touches and then publishes a manifest
``versions/<number>.json`` that names one folder a bucket, so versions share what did not change.
The manifest is written under another name and renamed to a name that must not exist: a writer
that dies before that leaves the table as it was, and of two writers that began from one
version one fails and begins again. A reader reads the folders of one manifest, whatever
is published meanwhile. Files go through Hadoop's file systems, as Spark's own do; exclusive
renaming is theirs (HDFS has it; a local folder has it for one writer at a time).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .tables import keyed, newest

_BUCKET = "versioned_bucket"


class Conflict(RuntimeError):
    """Another writer has published the version that this one was to become."""


class _Files:
    """The few file operations on the table's own file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.gateway, self.root = spark.sparkContext._gateway, path
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(path)] if self.fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self._path(name), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename(self, old: str, new: str) -> None:
        """Raises Conflict where ``new`` exists."""
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.gateway.new_array(kind, 1)
        how[0] = kind.NONE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        try:
            context.rename(self.fs.makeQualified(self._path(old)), self.fs.makeQualified(self._path(new)), how)
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                raise Conflict(new) from None
            raise

    def drop(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Published versions, ascending."""
    return sorted(int(n.removesuffix(".json")) for n in _Files(spark, path).names("versions") if n.removesuffix(".json").isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The manifest of ``version``, or of the newest: version, schema, buckets and the folder of each bucket."""
    if version is None:
        found = versions(spark, path)
        if not found:
            raise FileNotFoundError(f"no version in {path}")
        version = found[-1]
    return json.loads(_Files(spark, path).read(f"versions/{version:012d}.json"))


def _folders(spark: SparkSession, path: str, state: dict, buckets: list[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(state["schema"])
    named = [f"{path}/data/{f}" for b, f in sorted(state["folders"].items()) if buckets is None or int(b) in set(buckets)]
    return spark.read.schema(schema).parquet(*named) if named else spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of ``version``, or of the newest when this is called."""
    return _folders(spark, path, manifest(spark, path, version))


def _write(rows: DataFrame, path: str, key: str, n: int) -> dict[str, str]:
    """New folders with ``rows``: the folder of each bucket that has any. The list has at most ``n`` names."""
    at, folder = F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int"), uuid.uuid4().hex
    rows.withColumn(_BUCKET, at).hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(f"{path}/data/{folder}")
    names = _Files(rows.sparkSession, path).names(f"data/{folder}")
    return {x.partition("=")[2]: f"{folder}/{x}" for x in names if x.startswith(f"{_BUCKET}=")}


def _publish(spark: SparkSession, path: str, state: dict) -> int:
    files, draft = _Files(spark, path), f"versions/draft-{uuid.uuid4().hex}"
    files.write(draft, json.dumps(state))
    try:
        files.rename(draft, f"versions/{state['version']:012d}.json")
    except Conflict:
        files.drop(draft)
        raise
    return state["version"]


def create_table(rows: DataFrame, path: str, *, key: str = "id", version: str = "version", buckets: int = 64) -> int:
    """Publish the newest row of each key of ``rows`` as version 1."""
    rows = newest(keyed(rows, key), key, version)
    state = {"version": 1, "schema": rows.schema.jsonValue(), "buckets": buckets, "folders": _write(rows, path, key, buckets)}
    return _publish(rows.sparkSession, path, state)


def upsert_table(rows: DataFrame, path: str, *, key: str = "id", version: str = "version", attempts: int = 5) -> int:
    """Merge ``rows`` into the table and publish the result; the number of the new version.

    Only the buckets that ``rows`` touch are read and written again. Where another writer was
    first, the merge starts again from what that one published, ``attempts`` times at most.
    """
    spark, rows = rows.sparkSession, keyed(rows, key)
    for left in range(attempts - 1, -1, -1):
        state = manifest(spark, path)
        n = state["buckets"]
        touched = [r[0] for r in rows.select(F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int")).distinct().collect()]  # at most n numbers
        old = _folders(spark, path, state, touched)
        folders = state["folders"] | (_write(newest(old.unionByName(rows.select(old.columns)), key, version), path, key, n) if touched else {})
        try:
            return _publish(spark, path, state | {"version": state["version"] + 1, "folders": folders})
        except Conflict:
            if not left:
                raise
    raise ValueError("attempts must be positive")


def expire(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Unpublish all but the ``keep`` newest versions and delete folders that only those named; how many folders went.

    Folders that no manifest names may belong to a commit under way and stay.
    """
    files, numbers = _Files(spark, path), versions(spark, path)
    old, live = numbers[: max(0, len(numbers) - keep)], set()
    for v in numbers[len(old) :]:
        live |= set(manifest(spark, path, v)["folders"].values())
    gone = set()
    for v in old:
        gone |= set(manifest(spark, path, v)["folders"].values()) - live
        files.drop(f"versions/{v:012d}.json")
    for folder in sorted(gone):
        files.drop(f"data/{folder}")
    return len(gone)
