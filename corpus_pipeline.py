"""The corpus pipeline: quality, near duplicates, benchmark passages, mixture, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verisheaf.llm.common import read_table, stage_path, stage_table
from verisheaf.llm.decontamination import drop_contaminated
from verisheaf.llm.mixing import repeat_mixed
from verisheaf.llm.near_dedup import drop_near_duplicates
from verisheaf.llm.quality import keep_good
from verisheaf.llm.token_output import read_tokens, write_tokens


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id."""
    return drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return repeat_mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the documents in ascending order of doc_id, read back: doc_id, start, n_tokens, ids_crc32."""
    path = stage_path(spark, "pipeline-tokens")
    write_tokens(docs, path)
    return read_tokens(spark, path)


STAGES = [
    ("quality classifier", quality_stage),
    ("near duplicates", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("source mixture", mixing_stage),
    ("token files", token_stage),
]

#: Near duplicates and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not STAGES[-1][1]:
            docs = stage_table(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
