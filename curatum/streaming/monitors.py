"""Structured Streaming jobs with batch twins: the same column functions over stream and table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import answers as A
from ..operators.ingest import shared_dir


def answer_events(events: DataFrame) -> DataFrame:
    """ts, model, subject, right, confidence from the event table or stream."""
    return events.select("event_id", "user_id", "ts", F.concat(F.lit("model-"), (F.col("user_id") % 3).cast("string")).alias("model"), F.col("event_type").alias("subject"), (F.col("value") < 50).alias("right"), F.least(F.lit(1.0), F.col("value") / 100.0).alias("confidence"))


def accuracy_by_window(rows: DataFrame, width: str = "1 day", slide: str | None = None) -> DataFrame:
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = rows.groupBy(w.alias("w"), "model").agg(F.count("*").alias("n"), F.round(F.avg(F.col("right").cast("double")), 6).alias("accuracy"))
    return g.select(F.col("w.start").alias("start"), "model", "n", "accuracy")


def _exact(x: Column) -> Column:
    return x.try_cast("decimal(28,18)")


def _total(exact: Column, plain: Column) -> Column:
    """Sum of decimals, as doubles would depend on their order; ``plain`` doubles stand in where a number has no such decimal."""
    fit, other = F.sum(exact).cast("double"), F.sum(F.when(exact.isNull(), plain))
    return F.coalesce(fit + other, fit, other)


def bins_by_window(rows: DataFrame, width: str = "7 days", slide: str = "1 day") -> DataFrame:
    """Confidence bins per sliding window: what a rolling calibration error is folded from."""
    b = F.least(F.floor(F.col("confidence") * 10), F.lit(9)).cast("int")
    rows = rows.select("ts", b.alias("bin"), "confidence", "right", _exact(F.col("confidence")).alias("_exact"))
    g = rows.groupBy(F.window("ts", width, slide).alias("w"), "bin").agg(F.count("*").alias("n"), _total(F.col("_exact"), F.col("confidence")).alias("c"), F.sum(F.col("right").cast("double")).alias("a"))
    return g.select(F.col("w.start").alias("start"), "bin", "n", "c", "a")


def fold_ece(bins: DataFrame) -> DataFrame:
    c, a = F.col("c"), F.col("a")
    gaps = _total(F.abs(_exact(c) - _exact(a)), F.abs(c - a))
    return bins.groupBy("start").agg(F.sum("n").alias("n"), F.round(gaps / F.sum("n"), 6).alias("ece"))


def ece_alerts(rolling: DataFrame, baseline: DataFrame) -> DataFrame:
    """Windows of ``rolling`` (start, n, ece) with ``alert``: whether their error exceeds the mean of the
    ``baseline`` windows by more than two standard deviations. The baseline is folded to one row."""
    base = baseline.agg((F.avg("ece") + 2 * F.coalesce(F.stddev_pop("ece"), F.lit(0.0))).alias("limit"))
    return rolling.crossJoin(F.broadcast(base)).select("start", "n", "ece", (F.col("ece") > F.col("limit")).alias("alert"))


def load_by_window(rows: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Automation share, errors among the accepted and review load per day."""
    r = A.route(F.col("confidence"), threshold)
    g = rows.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.count_if(r == "auto_approved").alias("accepted"), F.count_if((r == "auto_approved") & ~F.col("right")).alias("accepted_wrong"), F.count_if(r == "needs_review").alias("review"))
    return g.select(F.col("w.start").alias("start"), "n", "accepted", "accepted_wrong", "review")


def sessions(rows: DataFrame, gap: str = "30 minutes") -> DataFrame:
    g = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_to_table(spark: SparkSession, path: str, schema, job: Callable[[DataFrame], DataFrame], *, late: str = "1 day", mode: str = "append", glob: str = "*.parquet", files: int | None = None) -> DataFrame:
    """Run ``job`` over files under ``path`` as a stream until it has read all, and return what it wrote:
    in append mode the windows that the watermark has closed. With ``files``, a batch reads so many files, oldest first."""
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    source = reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    query = job(source).writeStream.outputMode(mode).format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/data")


def first_by_content(rows: DataFrame, *content: str, late: str = "1 day") -> DataFrame:
    """The first arrival of each content hash; on a stream, within the watermark ``late`` that the caller has set."""
    hashed = rows.withColumn("content_hash", F.sha2(F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in content)), 256))
    if rows.isStreaming:
        return hashed.dropDuplicatesWithinWatermark(["content_hash"]).select("content_hash", "event_id", "ts")
    best = hashed.groupBy("content_hash").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    return best.select("content_hash", F.col("f.event_id").alias("event_id"), F.col("f.ts").alias("ts"))


def route_stream(rows: DataFrame, out: str, threshold: float = 0.7):
    """Start a query that writes each batch below ``out`` by route and batch id; a batch that runs again replaces its files."""
    routed = rows.withColumn("route", A.route(F.col("confidence"), threshold))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("route").parquet(f"{out}/data/batch={batch_id}")

    return routed.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
