"""Resumable, latest-wins bookkeeping of prediction logs, in batch and as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def completed(log: DataFrame, rule: str = "not_null") -> DataFrame:
    """ST1: keys that are done. Rules: not_null (a prediction and no error), not_empty, no_error."""
    ok = F.col("error").isNull()
    if rule == "not_null":
        ok = ok & F.col("prediction").isNotNull()
    elif rule == "not_empty":
        ok = ok & (F.trim(F.coalesce("prediction", F.lit(""))) != "")
    elif rule != "no_error":
        raise ValueError(rule)
    return log.where(ok).select("case_index").distinct()


def pending(cases: DataFrame, log: DataFrame, rule: str = "not_null") -> DataFrame:
    """ST1, JN11: cases yet to do."""
    return cases.join(completed(log, rule), "case_index", "left_anti")


def latest(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """ST2, ST4: the last row of each key in the order of some columns; partial maxima before the shuffle."""
    rest = [c for c in log.columns if c != key]
    best = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return best.select(key, *[F.col(f"__r.{c}").alias(c) for c in rest]).select(*log.columns)


def shard(cases: DataFrame, ordinal: str, world: int, rank: int) -> DataFrame:
    """ST3."""
    return cases.where(F.pmod(F.col(ordinal), F.lit(world)) == rank)


def stage_registry(spark, rows: list[tuple[str, str]]) -> DataFrame:
    """ST5: name and output of each stage, in order."""
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "position int, stage string, output string")


def latest_stream(stream: DataFrame, key: str, order: list[str]) -> DataFrame:
    """ST2 on a stream: the row of each key with the greatest order so far, whatever the order of arrival. Run in
    update or complete mode; the state is one row a key."""
    rest = [c for c in stream.columns if c != key]
    best = stream.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return best.select(key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def windowed_counts(stream: DataFrame, time: str, by: str, width: str, late: str) -> DataFrame:
    """Rows and sums of value per window, with a watermark for late rows."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def upsert_latest(batch: DataFrame, path: str, key: str, order: list[str], version: int) -> str:
    """One foreachBatch step of ST2: merges a batch into the newest version of a table under path, and writes the next
    version. A step that is run again writes the same version again."""
    spark = batch.sparkSession
    old = f"{path}/version={version - 1}"
    merged = batch
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        merged = batch.unionByName(spark.read.parquet(old))
    new = f"{path}/version={version}"
    latest(merged, key, order).write.mode("overwrite").parquet(new)
    return new


def resume_sink(path: str, key: str, order: list[str]):
    """IO14: a function for writeStream.foreachBatch that keeps the newest row of each key."""
    return lambda batch, number: upsert_latest(batch, path, key, order, number)
