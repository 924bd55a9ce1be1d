"""Operator 7: exact deduplication by content sort.

Normalised bytes are range-partitioned by sampled splitters, an external sort inside each range puts equal texts next
to one another, and neighbours are compared in full. Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verisheaf.llm.common import WHITE, read_table, stage_table, text_of

#: Characters of a text that lead its sort key. Splitters hold this much text, not whole documents.
LEAD = 64
#: Parts into which the copies of one text are dealt, so that a text that makes up a third of all rows has no one task.
SALTS = 256


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lead: int = LEAD, salts: int = SALTS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space (space, tab to carriage return) becomes one space.
    The row with the smallest id of its group stays.

    The sort key is (first characters, SHA-256, salt); RangePartitioning on it puts the copies that share a salt in one
    range, where the window sorts by key, whole text and id and compares neighbouring texts in full. At most `salts`
    partial groups per text then meet in a second, text-free aggregation.

    Null text counts as empty; empty texts form a group of their own. Null ids sort last, so a row with an id stays
    rather than one without; a group of null ids alone has keep_id null and keeps one row. Rows repeated with the same
    id and text: one stays. The same id with another text is another group. Empty input gives no rows. Extra columns
    are ignored. Very long texts spill in the sort like any other row.
    """
    norm = F.regexp_replace(text_of(text_col), WHITE, " ")
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), norm.alias("norm"))
    keyed = keyed.select(
        "doc_id",
        "norm",
        F.substring("norm", 1, lead).alias("lead"),
        F.sha2("norm", 256).alias("text_sha256"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"),
    )
    ranged = keyed.repartitionByRange("lead", "text_sha256", "salt")
    same = Window.partitionBy("lead", "text_sha256", "salt", "norm")
    parts = ranged.select(
        "doc_id",
        "text_sha256",
        F.row_number().over(same.orderBy(F.col("doc_id").asc_nulls_last())).alias("place"),
        F.min("doc_id").over(same).alias("part_first"),
        F.count(F.lit(1)).over(same).alias("part_rows"),
    )
    parts = stage_table(parts, "exact-parts")
    groups = (
        parts.where("place = 1")
        .groupBy("text_sha256")
        .agg(F.min("part_first").alias("keep_id"), F.sum("part_rows").alias("group_size"), F.count(F.lit(1)).alias("members"))
    )
    # A text seen in one part only already has its answer; the join carries the others.
    out = parts.join(groups.where("members > 1 or group_size > 1"), "text_sha256", "left")
    keep = F.when(F.col("members").isNull(), F.col("part_first")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", "part_rows").alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep) & (F.col("place") == 1) & F.col("part_first").eqNullSafe(keep)).alias("kept"),
        "text_sha256",
    )


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup(read_table(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm
)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept,
       sha256(n.norm) AS text_sha256
FROM n JOIN g USING (norm)
"""
