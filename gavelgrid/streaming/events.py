"""Event streams: sessions, windows, folded turns and incremental tables, each as a batch and as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gavelgrid.operators.ingest import upsert_latest
from gavelgrid.sources.files import list_names


def event_time(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def sessions(events: DataFrame, gap_seconds: int = 3600, watermark: str | None = None) -> DataFrame:
    """(user_id, session_start, session_end, n): a pause of the gap or more starts a session. Works on streams, where
    a session comes out once the watermark has passed its end."""
    rows = event_time(events)
    if watermark:
        rows = rows.withWatermark("ts", watermark)
    spans = rows.groupBy("user_id", F.session_window("ts", f"{gap_seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))
    return spans.select("user_id", F.col("w.start").alias("session_start"), F.col("last_ts").alias("session_end"), "n")


def tumbling_counts(events: DataFrame, width: str = "1 hour", watermark: str | None = None) -> DataFrame:
    rows = event_time(events)
    if watermark:
        rows = rows.withWatermark("ts", watermark)
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def sliding_sums(events: DataFrame, width: str = "2 hours", slide: str = "1 hour", watermark: str | None = None) -> DataFrame:
    rows = event_time(events)
    if watermark:
        rows = rows.withWatermark("ts", watermark)
    sums = rows.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.sum("value").alias("total"))
    return sums.select(F.col("w.start").alias("window_start"), "event_type", F.round("total", 4).alias("total"))


def fold_turns(events: DataFrame, turn: list[str], order: list[str], kind: str, payload: str) -> DataFrame:
    """(turn, n, kinds in order, last payload): an event stream folded into one record per turn."""
    key = F.struct(*order)
    return events.groupBy(*turn).agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(kind).alias("_k")))), lambda x: x["_k"]), ">").alias("kinds"),
        F.max_by(payload, key).alias("last_payload"),
    )


def latest_by_day(events: DataFrame, since: str | None = None) -> DataFrame:
    """Batch form of applying dated deltas in order: per user the latest row of the days after ``since``."""
    rows = events.withColumn("day", F.to_date("ts"))
    if since:
        rows = rows.filter(F.col("day") > F.lit(since).cast("date"))
    latest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return rows.withColumn("_n", F.row_number().over(latest)).filter("_n = 1").drop("_n")


def pending_deltas(manifest: DataFrame, applied: str | None, snapshot: str) -> DataFrame:
    """Deltas of a manifest (date, path, sha256) still to apply, oldest first: those after the last applied date, or
    after the snapshot if none was."""
    return manifest.filter(F.col("date") > F.lit(applied or snapshot)).orderBy("date", "path")


def stream_upsert(stream: DataFrame, target: str, checkpoint: str, key: list[str], version: str) -> StreamingQuery:
    """Keeps a parquet table at ``target`` at the latest row per key. Every batch writes a new version folder and then
    its marker, so readers never see half of one; a batch that runs again after its marker was written is skipped."""

    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        name, newest = f"v{epoch:08d}", newest_version(spark, target)
        if newest is not None and newest >= name:
            return
        current = read_version(spark, target)
        merged = upsert_latest(batch.limit(0) if current is None else current, batch, key, version)
        publish_version(merged, target, name)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish_version(df: DataFrame, target: str, version: str) -> None:
    """Write a version folder, then create its marker in ``target/_versions``. Nothing that readers use is deleted or
    replaced; the marker with the greatest name is the current version, so names must sort by age."""
    if not version or version.startswith(("_", ".")) or "/" in version:
        raise ValueError(f"not a version name: {version!r}")
    df.write.mode("overwrite").parquet(f"{target}/{version}")
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/_versions/{version}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True).close()


def newest_version(spark: SparkSession, target: str) -> str | None:
    names = [name for name in list_names(spark, f"{target}/_versions") if not name.startswith(("_", "."))]
    return max(names, default=None)


def read_version(spark: SparkSession, target: str) -> DataFrame | None:
    """The published version, or None if there is none."""
    version = newest_version(spark, target)
    return spark.read.parquet(f"{target}/{version}") if version else None


def unexpired(jobs: DataFrame, finished: str, now: Column, minutes: int = 30) -> DataFrame:
    """Jobs that still run, or finished at most ``minutes`` ago; ``finished`` is NULL while a job runs."""
    return jobs.filter(F.col(finished).isNull() | (F.col(finished) >= now - F.make_interval(mins=F.lit(minutes))))


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process all that is available, then stop; what was committed before is not processed again."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
