"""Connected components of a table of links."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ensure_checkpoints(spark) -> None:
    """Checkpoints go to the folder that spark.checkpoint.dir names; where it is unset and all runs on one machine, to a
    folder of our own. On a cluster that would be a folder of the driver's, so it is an error there."""
    if spark.sparkContext.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="verisheaf-"))


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component), component the smallest node: labels travel along links, then follow their own label."""
    ensure_checkpoints(links.sparkSession)
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).union(links.select(F.col(b), F.col(a))).distinct().checkpoint()
    labels = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("u"), F.min("v")).alias("label")).checkpoint()
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        far = step.select(F.col("node").alias("new"), F.col("new").alias("far"))
        step = step.join(far, "new").select("node", "label", F.least("new", "far").alias("new")).checkpoint()
        done = step.where("new <> label").isEmpty()
        labels = step.select("node", F.col("new").alias("label"))
        if done:
            return labels.select("node", F.col("label").alias("component"))
