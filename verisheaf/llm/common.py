"""Shared helpers: where intermediate tables go, and word hashing over Arrow string columns."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = r"[\x20\x09-\x0D]+"
NOT_WHITE = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where it is unset and all runs on one machine (tests), a folder of
    our own. On a cluster that would be a folder of the driver's, so it is an error there."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='verisheaf-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stage_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stage_table(df: DataFrame, label: str, shrink: int = 1) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts the lineage, survives lost executors and
    gives the optimizer a true size to decide on broadcasts with. shrink: of a table without texts, made by a shuffle
    that is dealt out for texts, so many partitions become one file."""
    spark = df.sparkSession
    path = stage_path(spark, label)
    if shrink > 1:
        df = df.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // shrink))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_on_disk(df: DataFrame) -> DataFrame:
    """df, computed once and kept on the executors' disks; what a lost executor held is computed again."""
    return df.persist(StorageLevel.DISK_ONLY)


def text_of(column: str) -> Column:
    """The text column, null counted as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- word hashes over Arrow buffers ------------------------------------------------------------------------------

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


#: A random 64-bit value for each byte, from a fixed seed so that every executor agrees.
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _BASE)
_POWERS = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = 1 << int(n - 1).bit_length()
        steps = np.full(size, _BASE, dtype=np.uint64)
        steps[0] = 1
        _POWERS = np.cumprod(steps, dtype=np.uint64)
    return _POWERS


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows (one more than rows). Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def word_hashes(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word (maximal run of bytes for which space is false, cut at row ends), and the number of
    words before each row. The hash of a word is a polynomial over its bytes, mixed."""
    rows = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, dtype=np.uint64), np.zeros(rows + 1, dtype=np.int64)
    inside = ~space
    before = np.empty(len(raw), dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    row_starts = offsets[:-1][offsets[:-1] < len(raw)]
    before[row_starts] = False
    starts = np.flatnonzero(inside & ~before)
    counts = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), counts
    at = np.flatnonzero(inside)
    first = np.searchsorted(at, starts)
    lengths = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, lengths)
    terms = _BYTE[raw[at]] * _powers(int(lengths.max()) + 1)[place]
    return mix64(np.add.reduceat(terms, first) + lengths.astype(np.uint64)), counts


def row_hashes(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit hash of every row's bytes, made as those of words; an empty row's is 0."""
    lengths = np.diff(offsets)
    out = np.zeros(len(lengths), dtype=np.uint64)
    if len(raw):
        place = np.arange(len(raw))
        place -= np.repeat(offsets[:-1], lengths)
        terms = _BYTE[raw]
        terms *= _powers(int(lengths.max()) + 1)[place]
        full = lengths > 0
        out[full] = mix64(np.add.reduceat(terms, offsets[:-1][full]) + lengths[full].astype(np.uint64))
    return out


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of width words of each row; a row of fewer words, but one at least, has one shingle of all
    its words. Second: the number of shingles before each row."""
    n = np.diff(counts)
    each = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out = np.concatenate([[0], np.cumsum(each)])
    starts = np.repeat(counts[:-1] - out[:-1], each) + np.arange(out[-1])
    row = np.repeat(np.arange(len(n)), each)
    left = n[row]
    total = np.zeros(out[-1], dtype=np.uint64)
    for k in range(width):
        word = words[np.minimum(starts + k, len(words) - 1)] if len(words) else np.zeros(len(starts), dtype=np.uint64)
        total += np.where(left > k, word, np.uint64(k + 7)) * np.uint64(pow(int(_BASE), k, 1 << 64))
    return mix64(total), out
