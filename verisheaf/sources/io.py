"""Sources and sinks of the report tools: JSON, JSON lines, CSV, registries, file listings and manifests."""

from __future__ import annotations

import hashlib
import json
import os
import re
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verisheaf.functions.records import RECORD

PREDICTION = (
    "case_index long, rank int, images array<string>, resolved_images array<string>, prompt string, reference string, prediction string, error string, "
    "traceback string, input_tokens long, output_tokens long, hit_max_new_tokens boolean, peak_gpu_memory_bytes long, latency_sec double, generated_at_unix double"
)


def read_json_array(spark: SparkSession, path: str, schema: str = RECORD, ordinal: str | None = "record_index") -> DataFrame:
    """IO1: an array of objects in one file, with its order as a column."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.posexplode(F.from_json("value", f"array<struct<{_struct(schema, ordinal)}>>")).alias("__at", "__r"))
    return rows.select(*([F.col("__at").cast("long").alias(ordinal)] if ordinal else []), "__r.*")


def _struct(schema: str, without: str | None) -> str:
    """A DDL schema as the inside of a struct type."""
    from pyspark.sql.types import StructType

    fields = [f for f in StructType.fromDDL(schema).fields if f.name != without]
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in fields)


def read_jsonl(spark: SparkSession, path: str, schema: str, mode: str = "PERMISSIVE") -> DataFrame:
    """IO2: JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path, mode=mode)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line (from 1) and value of the lines of text files; a file is read by one task, which knows its lines."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", "\r\n|\n|\r")).alias("__at", "value")).select("path", (F.col("__at") + 1).cast("long").alias("line"), "value")


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """IO4: (good rows with their line, malformed (path, line, error)). A root that isn't an object is malformed."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    parsed = lines.withColumn("__r", F.from_json("value", schema + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    object_ = F.trim("value").startswith("{")
    bad = F.col("__r").isNull() | F.col("__r._corrupt_record").isNotNull() | ~object_
    good = parsed.where(~bad).select("line", "__r.*").drop("_corrupt_record")
    whole = F.try_parse_json("value").isNotNull()
    return good, parsed.where(bad).select("path", "line", F.when(whole, "ValueError").otherwise("JSONDecodeError").alias("error"))


def read_jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """IO3: raises with path and line of the first malformed line."""
    good, bad = read_jsonl_tolerant(spark, path, schema)
    if first := bad.orderBy("path", "line").limit(1).collect():
        raise ValueError(f"{first[0].path}:{first[0].line}: {first[0].error}")
    return good


def read_records(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """IO5: by suffix JSON lines or JSON; a single object is a list of one."""
    if path.endswith(".jsonl"):
        good, _ = read_jsonl_tolerant(spark, path, ", ".join(f"{n.split(':')[0]} {n.split(':', 1)[1]}" for n in _top(_struct(schema, "record_index"))))
        return good.withColumn("record_index", F.col("line") - 1).drop("line")
    text = spark.read.text(path, wholetext=True).select(F.when(F.trim("value").startswith("{"), F.concat(F.lit("["), F.col("value"), F.lit("]"))).otherwise(F.col("value")).alias("value"))
    rows = text.select(F.posexplode(F.from_json("value", f"array<struct<{_struct(schema, 'record_index')}>>")).alias("__at", "__r"))
    return rows.select(F.col("__at").cast("long").alias("record_index"), "__r.*")


def _top(text: str) -> list[str]:
    """Parts of a struct's inside that commas separate on the top level."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def _open(path: str, mode: str):
    return open(path, mode, encoding="utf-8")


def read_registered(spark: SparkSession, registry_path: str, name: str, schema: str = RECORD) -> DataFrame:
    """IO6: a dataset by its name; its file is relative to the registry."""
    with _open(registry_path, "r") as f:
        registry = json.load(f)
    if name not in registry:
        raise KeyError(f"{name} isn't registered")
    return read_records(spark, os.path.join(os.path.dirname(registry_path), registry[name]["file_name"]), schema)


def registry_rows(spark: SparkSession, registry_path: str) -> DataFrame:
    """name, file_name, formatting, columns and tags of each registered dataset."""
    text = spark.read.text(registry_path, wholetext=True)
    entry = "struct<file_name:string,formatting:string,columns:map<string,string>,tags:map<string,string>>"
    return text.select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("name", "__r")).select("name", "__r.*")


def register(registry_path: str, entries: dict[str, dict]) -> str:
    """IO7: add entries to a registry. Equal ones change nothing, different ones raise; a change keeps a dated copy and
    replaces the file in one step. Returns unchanged or written."""
    current: dict = {}
    if os.path.exists(registry_path):
        with _open(registry_path, "r") as f:
            current = json.load(f)
    if conflicts := sorted(n for n, e in entries.items() if n in current and current[n] != e):
        raise ValueError(f"registered otherwise: {conflicts}")
    if all(n in current for n in entries):
        return "unchanged"
    if current:
        with _open(f"{registry_path}.{time.strftime('%Y%m%d-%H%M%S')}.bak", "w") as f:
            json.dump(current, f, ensure_ascii=False, indent=2)
    with _open(registry_path + ".new", "w") as f:
        json.dump(current | entries, f, ensure_ascii=False, indent=2)
    os.replace(registry_path + ".new", registry_path)
    return "written"


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """IO8, IO9: all columns as text; a byte-order mark before the first name is dropped."""
    df = spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=True)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def write_json_document(document: dict | list, path: str) -> None:
    """IO10: a small document, not a table."""
    with _open(path, "w") as f:
        json.dump(document, f, ensure_ascii=False, indent=2)


def write_jsonl(df: DataFrame, path: str) -> None:
    """IO11: null fields are written."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, mark: bool = False) -> None:
    """IO12; mark: a byte-order mark before the first name, as some readers want."""
    if mark and df.columns:
        df = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0])
    df.write.mode("overwrite").csv(path, header=True)


def six_places(value: Column, missing: str = "N/A") -> Column:
    """IO13: the number format of reports."""
    return F.when(value.isNull(), missing).otherwise(F.format_string("%.6f", value.cast("double")))


def markdown_table(df: DataFrame, most_rows: int = 10_000) -> str:
    """IO13: a report table from a small frame; larger ones are refused."""
    cells = df.select(*[(six_places(F.col(f.name), "—") if f.dataType.typeName() in ("double", "float") else F.coalesce(F.col(f.name).cast("string"), F.lit("—"))).alias(f.name) for f in df.schema.fields])
    rows = cells.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows")
    line = lambda values: "| " + " | ".join(values) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *[line(map(str, r)) for r in rows]]) + "\n"


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, length and content of the files under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def _local(spark: SparkSession, path: str) -> bool:
    """Whether files are ones that executors open by themselves."""
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file"


def _by_path(spark: SparkSession, path: str, value: str, kind: str, work) -> DataFrame:
    """path, length and work(name of the file) of the files under a folder of executors' own; contents are no rows."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                made = work(batch.column(0)[k].as_py().removeprefix("file:"))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([made])], ["path", "length", value])

    return files(spark, path).select("path", "length").mapInArrow(run, f"path string, length long, {value} {kind}")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """IO15 of the files under a folder: path, size, sha256. A digest is a chain over its file, so a file is one task's; it
    is read in blocks, where executors can open it, and so may be larger than a row."""

    def digest(name: str) -> str:
        with open(name, "rb") as f:
            return hashlib.file_digest(f, "sha256").hexdigest()

    if not _local(spark, path):
        return file_hashes(files(spark, path))
    return _by_path(spark, path, "sha256", "string", digest).withColumnRenamed("length", "size")


def file_heads(spark: SparkSession, path: str, n: int = 12) -> DataFrame:
    """path, length and content of the files under a folder, content cut to the first n bytes; no more is read where
    executors can open files."""

    def head(name: str) -> bytes:
        with open(name, "rb") as f:
            return f.read(n)

    if not _local(spark, path):
        return files(spark, path).withColumn("content", F.substring("content", 1, n))
    return _by_path(spark, path, "content", "binary", head)


def file_hashes(found: DataFrame) -> DataFrame:
    """IO15."""
    return found.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def manifest(found: DataFrame, root: str, itself: str = "manifest.json") -> tuple[DataFrame, DataFrame]:
    """IO16: (relative path, size, sha256 in order; one row of totals), without the manifest."""
    inside = F.regexp_replace("path", r"^[a-z]+:/*" + re.escape(root.rstrip("/").lstrip("/")) + "/|^" + re.escape(root.rstrip("/")) + "/", "")
    listed = file_hashes(found).withColumn("path", inside).where(F.col("path") != itself)
    return listed.orderBy("path"), listed.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("n_bytes"))


def release_hashes(listed: DataFrame) -> DataFrame:
    """IO17: lines of hash, two spaces, path."""
    return listed.select(F.concat_ws("  ", "sha256", "path").alias("value"))


def rewrite_prefix(text: DataFrame, column: str, old: str, new: str) -> tuple[DataFrame, int]:
    """IO18: (text with old replaced, occurrences); raises if there is none."""
    n = text.agg(F.sum((F.length(column) - F.length(F.replace(F.col(column), F.lit(old), F.lit("")))) / len(old))).first()[0]
    if not n:
        raise ValueError(f"no occurrence of {old}")
    return text.withColumn(column, F.replace(F.col(column), F.lit(old), F.lit(new))), int(n)


def missing_images(records: DataFrame, listing: DataFrame, root: str) -> DataFrame:
    """IO19: records with missing_files, the number of images that the listing (path) lacks; relative paths are below
    root."""
    each = records.select("record_index", F.explode("images").alias("image"))
    full = F.when(F.col("image").startswith("/"), F.col("image")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.col("image")))
    known = listing.select(F.regexp_replace("path", "^file:/*", "/").alias("__path")).distinct()
    gone = each.withColumn("__path", full).join(known, "__path", "left_anti").groupBy("record_index").agg(F.count(F.lit(1)).alias("missing_files"))
    return records.join(gone, "record_index", "left").fillna(0, ["missing_files"])


#: IO20: what files of a kind begin with.
MAGIC = {"png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "gif": "47494638", "tiff-le": "49492A00", "tiff-be": "4D4D002A", "webp": "52494646", "bmp": "424D"}


def image_kinds(found: DataFrame) -> DataFrame:
    """IO20: path and kind of image, null for what is none."""
    start = F.hex(F.substring("content", 1, 12))
    kind = F.coalesce(*[F.when(start.startswith(m), F.lit(k.split("-")[0])) for k, m in MAGIC.items()])
    return found.select("path", kind.alias("kind"))
