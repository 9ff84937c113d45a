"""Streaming extensions: churn by event time, sessions, and incremental versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.operators.temporal import apply_changes
from graphlake.sources.snapshots import save


def churn_stream(commits: DataFrame, window: str = "14 days", slide: str = "1 day", late: str = "1 day", key: str = "file", ts: str = "ts") -> DataFrame:
    """Commits per key and window; rows over ``late`` behind the newest are dropped, as the watermark says."""
    return commits.withWatermark(ts, late).groupBy(F.window(ts, window, slide), key).agg(F.count("*").alias("commits"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", key: str = "user_id", ts: str = "ts") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("events"))


def versions(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The table that ``versions_sink`` keeps under ``path``: of each bucket the newest epoch, or the newest below ``before``."""
    rows = spark.read.parquet(path)
    if before is not None:
        rows = rows.filter(F.col("epoch") < before)
    newest = rows.groupBy("bucket").agg(F.max("epoch").alias("epoch"))  # reads no column of the files
    return rows.join(F.broadcast(newest), ["bucket", "epoch"], "left_semi")


def versions_sink(path: str, buckets: int = 64):  # noqa: ANN201
    """A foreachBatch function that applies extracted batches (id, file, content_hash, at, ...) to the table under ``path``.

    Files are dealt to ``buckets`` by a hash; a batch reads and writes only the buckets of its files, each as a new epoch, from the newest epoch before its own, so a batch that is repeated writes the same again and epochs may be missing. Rows without a time take the batch's greatest; a batch without any time is an error, an empty one changes nothing. Old epochs stay until someone deletes them.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        at, n = batch.agg(F.max("at"), F.count("*")).first()
        if n == 0:
            return
        if at is None:
            raise ValueError("a batch of versions needs a time")
        rows = batch.drop("at")
        place = F.pmod(F.xxhash64("file"), F.lit(buckets)).cast("int")
        none = rows.limit(0).withColumn("valid_from", F.lit(0.0)).withColumn("valid_to", F.lit(None).cast("double"))
        hit = rows.select(place.alias("bucket")).distinct()  # at most ``buckets`` rows
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        known = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
        current = versions(spark, path, epoch).join(F.broadcast(hit), "bucket", "left_semi").select(none.columns) if known else none
        out = apply_changes(current, rows, rows.select("file"), float(at)).withColumn("bucket", place).withColumn("epoch", F.lit(epoch).cast("int"))
        save(out, path, "bucket", "epoch")

    return write
