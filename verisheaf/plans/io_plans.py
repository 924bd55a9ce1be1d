"""Queries of sources, sinks, state and streams over the tables' own files and rows. Files have no SQL form."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from verisheaf.operators import stats as A
from verisheaf.plans.tables import table
from verisheaf.sources import io
from verisheaf.streaming import state as ST


def hashes(spark, sf):
    """IO15, IO16: size and hash of all tables' files."""
    return io.file_digests(spark, sf).select("size", "sha256")


def kinds(spark, sf):
    return io.image_kinds(io.file_heads(spark, sf)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def rewritten(spark, sf):
    out, n = io.rewrite_prefix(table(spark, sf, "pages").select("page_id", "url"), "url", "http", "HTTP")
    return out.withColumn("n", F.lit(n))


REWRITTEN = "SELECT page_id, replace(url, 'http', 'HTTP') AS url, CAST((SELECT sum((length(url) - length(replace(url, 'http', ''))) / 4) FROM pages) AS INTEGER) AS n FROM pages"


def streamed_latest(spark, sf):
    """ST2 as a stream over the events, read to its end."""
    log = _events(spark, sf).select(F.col("user_id").alias("case_index"), F.pmod("event_id", F.lit(4)).alias("rank"), F.col("event_id").alias("line"), "event_type")
    return _finished(spark, ST.latest_stream(log, "case_index", ["rank", "line"]), "complete")


def streamed_windows(spark, sf):
    """Counts and sums of hourly windows with a watermark, over the events as a stream, read to its end."""
    events = _events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return _finished(spark, ST.windowed_counts(events, "ts", "event_type", "1 hour", "1 hour").withColumn("total", F.round("total", 6)).withColumn("start", F.col("start").cast("timestamp_ntz")), "complete")


def _events(spark, sf):
    """The events as a stream; the table is a file or a folder of files."""
    path = f"{sf}/events.parquet"
    folder = _folder(spark, path)
    reader = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "*.parquet" if folder else "events.parquet")
    return reader.parquet(path if folder else sf)


def _folder(spark, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()


def _finished(spark, stream, mode: str):
    """The rows of a stream over a finished table, as a table in memory: for demonstrations of bounded results."""
    name = f"stream_{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


STREAMED_LATEST = "SELECT case_index, rank, line, event_type FROM (SELECT user_id AS case_index, event_id % 4 AS rank, event_id AS line, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 4 DESC, event_id DESC) AS k FROM events) WHERE k = 1"
STREAMED_WINDOWS = "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2"


def stages(spark, sf):
    return ST.stage_registry(spark, [("smoke", "smoke"), ("train", "model"), ("quick-test", "quick"), ("evaluate", "scores"), ("merge", "merged"), ("export", "export")])


def metric_groups(spark, sf):
    return A.availability(spark).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


STAGES = "SELECT CAST(position AS INTEGER) AS position, stage, output FROM (VALUES (0, 'smoke', 'smoke'), (1, 'train', 'model'), (2, 'quick-test', 'quick'), (3, 'evaluate', 'scores'), (4, 'merge', 'merged'), (5, 'export', 'export')) AS t(position, stage, output)"
METRIC_GROUPS = "SELECT * FROM (VALUES ('available', 8::BIGINT), ('needs confidences', 1), ('needs token embeddings', 1), ('needs embeddings', 1), ('needs attribution shares', 1)) AS t(status, n)"

QUERIES = {
    "io_hashes": (hashes, None),
    "io_image_kinds": (kinds, None),
    "io_rewrite": (rewritten, REWRITTEN),
    "st_stream_latest": (streamed_latest, STREAMED_LATEST),
    "st_stream_windows": (streamed_windows, STREAMED_WINDOWS),
    "st_stages": (stages, STAGES),
    "ag_availability_counts": (metric_groups, METRIC_GROUPS),
}
