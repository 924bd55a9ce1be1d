"""Operator 4: token counts of documents in flat token files, by separator scan.

The files are little-endian 16- or 32-bit ids and nothing else: no index, no lengths. Each is cut into blocks; a
vectorised search finds the end-of-document ids of a block; a prefix scan over the blocks of a file hands each block the
last end before it and the number of ends so far, so a document that spans blocks is counted once and whole.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verisheaf.llm.common import read_table, stage_path, stage_table, text_of
from verisheaf.llm.near_dedup import slices
from verisheaf.llm.tokens import default_tokenizer, encoder_for

END_ID = 49407
#: Bytes of a block, a multiple of an id's, and of a file. A file is one row of Spark's reader, so it has to be bounded.
BLOCK_BYTES, FILE_BYTES = 1 << 20, 1 << 24
TEXT_BYTES = 1 << 22


def write_flat(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write flat files of 16-bit ids, each text followed by end_id, where the documents are, without a shuffle, and
    return their list: (file, doc_ids in order, n_ids). A file is written under a name of its own and counts only if it
    is in the list, so tasks that are run again do no harm.

    The end id must stand for nothing else: strings of special tokens are encoded as ordinary text. Null texts are
    empty. Rows that repeat an id stay, null ids too. Empty input writes nothing. A text longer than a file makes a
    longer file.
    """
    tokenizer = tokenizer or default_tokenizer()

    def written(batches):
        from pyarrow import fs

        encoder = encoder_for(tokenizer, plain_specials=True)
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        held: list = []
        doc_ids: list = []

        def flush():
            name = f"{uuid.uuid4().hex}.u16"
            with store.open_output_stream(f"{root}/{name}") as out:
                for ids in held:
                    out.write(ids)
            done = pa.RecordBatch.from_pydict({"file": [name], "doc_ids": pa.array([list(doc_ids)], pa.list_(pa.int64())), "n_ids": pa.array([sum(map(len, held))], pa.int64())})
            held.clear()
            doc_ids.clear()
            return done

        for batch in batches:
            for at, to in slices(batch.column(1), min(TEXT_BYTES, file_bytes)):
                ids, _ = encoder.encode(batch.column(1).slice(at, to - at), end_id)
                if len(ids) and int(ids.max()) > 0xFFFF:
                    raise ValueError("an id needs more than 16 bits")
                held.append(ids.astype("<u2"))
                doc_ids.extend(batch.column(0).slice(at, to - at).to_pylist())
                if sum(map(len, held)) * 2 >= file_bytes:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return stage_table(rows.mapInArrow(written, "file string, doc_ids array<long>, n_ids long"), "flat-files")


def flat_blocks(spark: SparkSession, path: str, files: DataFrame | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, block, data) of the files at path, or of those listed. Files must fit a row of Spark's reader."""
    found = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    if files is not None:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(folder).getFileCount()
        if there != files.count():  # tasks that ran again left files that don't count
            found = found.join(files.select("file"), "file", "left_semi")
    size = F.length("content")
    cuts = F.when(size > 0, F.sequence(F.lit(0), F.floor((size - 1) / F.lit(block_bytes)).cast("int"))).otherwise(F.array(F.lit(0)))
    cut = found.select("file", "content", F.explode(cuts).alias("block"))
    return cut.select("file", "block", F.substring("content", F.col("block") * F.lit(block_bytes) + 1, F.lit(block_bytes)).alias("data"))


def count_tokens(blocks: DataFrame, end_id: int = END_ID, id_bytes: int = 2) -> DataFrame:
    """One row per document: file, doc_in_file (from 0), start (ids before it in its file), n_tokens (with the end id)
    and whole, false for ids after the last end id of a file.

    blocks: (file, block, data), blocks numbered in order, each a whole number of ids. An empty file has no document; a
    document is never empty, since its end id counts. Data of another length raises ValueError. Null data is empty.
    """
    kind = f"<u{id_bytes}"

    def scanned(batches):
        for batch in batches:
            sizes, ends = [], []
            for i in range(len(batch)):
                data = batch.column(2)[i].as_buffer() if batch.column(2)[i].is_valid else b""
                if len(data) % id_bytes:
                    raise ValueError("a block isn't a whole number of ids")
                ids = np.frombuffer(data, dtype=kind)
                sizes.append(len(ids))
                ends.append(np.flatnonzero(ids == end_id) + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], ["file", "block", "n_ids", "ends"])

    found = blocks.select(F.col("file").cast("string").alias("file"), F.col("block").cast("int").alias("block"), F.col("data").cast("binary").alias("data"))
    found = stage_table(found.mapInArrow(scanned, "file string, block int, n_ids long, ends array<long>"), "separator-ends")
    past = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = found.select("file", "block", "n_ids", F.size("ends").alias("n_ends"), F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("last"))
    sums = sums.withColumn("start", F.coalesce(F.sum("n_ids").over(past), F.lit(0))).withColumn("ends_before", F.coalesce(F.sum("n_ends").over(past), F.lit(0)))
    sums = sums.withColumn("last_end", F.coalesce(F.max(F.col("start") + F.col("last")).over(past), F.lit(0)))
    sums = stage_table(sums, "separator-scan", shrink=8)
    each = found.select("file", "block", "ends").join(sums.select("file", "block", "start", "ends_before", "last_end"), ["file", "block"])
    each = each.select("file", "start", "ends_before", "last_end", F.posexplode("ends").alias("k", "end"), "ends")
    begin = F.when(F.col("k") == 0, F.col("last_end")).otherwise(F.col("start") + F.get("ends", F.col("k") - 1))
    whole = each.select("file", (F.col("ends_before") + F.col("k")).alias("doc_in_file"), begin.alias("start"), (F.col("start") + F.col("end") - begin).alias("n_tokens"), F.lit(True).alias("whole"))
    rest = sums.groupBy("file").agg(F.max(F.col("start") + F.col("n_ids")).alias("n"), F.sum("n_ends").alias("doc_in_file"), F.coalesce(F.max(F.col("start") + F.col("last")), F.lit(0)).alias("start"))
    rest = rest.where("n > start").select("file", "doc_in_file", "start", (F.col("n") - F.col("start")).alias("n_tokens"), F.lit(False).alias("whole"))
    return whole.unionByName(rest)


def op4_token_counts(spark, sf_dir):
    """Per document, from the flat files: doc_id, n_tokens (with the end id) and start (ids before it in its file)."""
    path = stage_path(spark, "flat")
    files = write_flat(read_table(spark, sf_dir, "documents"), path)
    counts = count_tokens(flat_blocks(spark, path, files))
    names = files.select("file", F.posexplode("doc_ids").alias("doc_in_file", "doc_id"))
    return counts.join(names.withColumn("doc_in_file", F.col("doc_in_file").cast("long")), ["file", "doc_in_file"], "full_outer").select("doc_id", "n_tokens", "start")
