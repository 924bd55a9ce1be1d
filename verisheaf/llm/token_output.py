"""Operator 2: token ids written in a binary format with an adaptive range coder, and read back.

Documents are range-partitioned and sorted by id, so files in partition order hold ids in ascending document order. A
file is Parquet whose rows are segments: whole documents of about 8 million ids, coded in blocks that stand alone (see
range_coder). The Spark writer commits the files, so a lost executor leaves none half written.

A segment is, in bytes: "VST1", then little-endian 32-bit numbers of documents and blocks; for each document its number
of ids (64 bits); for each block its length in bytes (32 bits); the blocks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verisheaf.llm import range_coder
from verisheaf.llm.common import read_table, stage_path, stage_table, text_of
from verisheaf.llm.near_dedup import slices
from verisheaf.llm.tokens import default_tokenizer, encoder_for

#: Ids after which a segment ends, and the id after each document.
SEGMENT, END_ID = range_coder.BLOCK * range_coder.TOGETHER, 1
MAGIC = b"VST1"
#: Bytes of text tokenized at once.
TEXT_BYTES = 1 << 23
#: Words that a worker remembers.
REMEMBERED = 1_500_000


def pack_segment(lengths: np.ndarray, ids: np.ndarray) -> bytes:
    blocks = range_coder.encode_blocks(ids)
    head = MAGIC + np.array([len(lengths), len(blocks)], dtype="<u4").tobytes() + np.asarray(lengths, dtype="<u8").tobytes()
    return head + np.array([len(b) for b in blocks], dtype="<u4").tobytes() + b"".join(blocks)


def unpack_segment(data) -> tuple[np.ndarray, np.ndarray]:
    """(ids of each document, ids). Raises ValueError for other data and where a checksum doesn't hold."""
    data = memoryview(data)
    if bytes(data[:4]) != MAGIC:
        raise ValueError("not a segment of token ids")
    docs, n = (int(x) for x in np.frombuffer(data[4:12], dtype="<u4"))
    lengths = np.frombuffer(data[12 : 12 + 8 * docs], dtype="<u8").astype(np.int64)
    at = 12 + 8 * docs
    sizes = np.frombuffer(data[at : at + 4 * n], dtype="<u4").astype(np.int64)
    ends = at + 4 * n + np.concatenate([[0], np.cumsum(sizes)])
    ids = range_coder.decode_blocks([data[ends[i] : ends[i + 1]] for i in range(n)])
    if len(ids) != lengths.sum():
        raise ValueError("a segment of token ids has another length than its documents")
    return lengths, ids


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encode every whole text, add end_id, and write the ids to path in ascending order of id_col.

    Null texts are empty and have the end id alone. Null ids come first. Rows that repeat an id stay, next to one
    another. Empty input writes no segment. Extra columns are ignored. A text longer than a segment is a segment.
    """
    tokenizer = tokenizer or default_tokenizer()

    def coded(batches):
        encoder = encoder_for(tokenizer, remembered=REMEMBERED)
        seq, start = 0, 0
        doc_ids: list = []
        lengths: list = []
        held: list = []
        part = 0

        def row():
            nonlocal seq, start
            ids = np.concatenate(held)
            held.clear()
            out = pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "start_in_part": pa.array([start], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()),
                "doc_ids": pa.array([list(doc_ids)], pa.list_(pa.int64())), "segment": pa.array([pack_segment(np.array(lengths), ids)], pa.binary()),
            })
            seq, start = seq + 1, start + len(ids)
            for x in (doc_ids, lengths):
                x.clear()
            return out

        for batch in batches:
            part = batch.column(0)[0].as_py() if len(batch) else part
            for at, to in slices(batch.column(2), TEXT_BYTES):
                ids, ends = encoder.encode(batch.column(2).slice(at, to - at), end_id)
                numbers = batch.column(1).slice(at, to - at).to_pylist()
                first = 0
                while first < to - at:
                    room = SEGMENT - sum(map(len, held))
                    last = max(first + (not held), int(np.searchsorted(ends, ends[first] + room, side="right")) - 1)
                    if last > first:
                        held.append(ids[ends[first] : ends[last]])
                        doc_ids.extend(numbers[first:last])
                        lengths.extend(np.diff(ends[first : last + 1]).tolist())
                    if last < to - at:
                        yield row()
                    first = last
        if held:
            yield row()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select(F.spark_partition_id().alias("part"), "doc_id", "text")
    rows.mapInArrow(coded, "part int, seq int, start_in_part long, n_ids long, doc_ids array<long>, segment binary").write.parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """One row per document, from the files alone: doc_id, start (ids of all documents before it), n_tokens (with the
    end id) and ids_crc32. To have the ids themselves, map unpack_segment over the column `segment`."""

    def decoded(batches):
        for batch in batches:
            for i in range(len(batch)):
                lengths, ids = unpack_segment(batch.column(2)[i].as_buffer())
                ends = np.concatenate([[0], np.cumsum(lengths)])
                raw = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                first = batch.column(3)[i].as_py()
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(lengths), batch.column(0)[i].as_py(), dtype=np.int32)), batch.column(1)[i].values,
                    pa.array(first + ends[:-1]), pa.array(lengths), pa.array(sums, pa.int64()),
                ], ["part", "doc_id", "start_in_part", "n_tokens", "ids_crc32"])

    files = spark.read.parquet(path)
    # A row per partition, summed in order: as many rows as there are files.
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = stage_table(parts.select("part", before.alias("part_start")), "token-parts", shrink=1 << 30)
    docs = files.select("part", "doc_ids", "segment", "start_in_part").mapInArrow(decoded, "part int, doc_id long, start_in_part long, n_tokens long, ids_crc32 long")
    out = docs.join(parts, "part")
    return out.select("doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_output(spark, sf_dir):
    path = stage_path(spark, "tokens")
    write_tokens(read_table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path)
