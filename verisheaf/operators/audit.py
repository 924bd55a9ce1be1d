"""Leakage, privacy and integrity audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisheaf.functions import lexicon as L
from verisheaf.functions import text as T


def overlap(train: DataFrame, test: DataFrame, key: str, trivial_chars: int = 10) -> DataFrame:
    """AG13: one row, test rows whose key train has, and how many of them are trivial (short) or not."""
    seen = test.join(train.select(key).distinct(), key, "left_semi")
    short = F.length(key) < trivial_chars
    return seen.agg(F.count(F.lit(1)).alias("shared"), F.count_if(short).alias("trivial"), F.count_if(~short).alias("nontrivial"))


def shared_values(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """AG13, SE1: distinct values of both sides, sorted."""
    return train.select(column).intersect(test.select(column)).orderBy(column)


def ordered_digest(rows: DataFrame, order: str, text: str) -> DataFrame:
    """AG14: SHA-256 of texts joined by line feeds in order. The texts pass through one task, as the digest needs."""
    return rows.agg(F.sha2(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text])), 256).alias("digest"))


def rule_hits(text: Column, site_rules: tuple = ()) -> Column:
    """PV1, JN14: names of the sensitive patterns that occur, one compiled expression for each. site_rules: further
    rules (name, expression, whether case counts), such as for the names of a site's hosts, mounts and providers."""
    rules = (*L.PRIVACY_RULES, *site_rules)
    return F.array_compact(F.array(*[F.when(text.rlike(p if cased else "(?i)" + p), F.lit(name)) for name, p, cased in rules]))


def suspicious_name(path: Column) -> Column:
    """PV2."""
    name = F.lower(F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1))
    suffix = F.lit(False)
    for s in L.SENSITIVE_SUFFIXES:
        suffix = suffix | name.endswith(s)
    return name.isin(*L.SENSITIVE_NAMES) | suffix


def paths_by_blob(entries: DataFrame) -> DataFrame:
    """PV5: oid and its paths, sorted."""
    return entries.where(F.coalesce("path", F.lit("")) != "").groupBy("oid").agg(F.sort_array(F.collect_set("path")).alias("paths"))


def history_findings(blobs: DataFrame, most_bytes: int = L.MOST_BLOB_BYTES, site_rules: tuple = ()) -> DataFrame:
    """PV1, PV2, PV4: distinct (rule, path, oid) of blobs (oid, paths, size, data). Large blobs are named and not read;
    content with a NUL among its first 8,192 bytes isn't searched. Content never leaves the scan."""
    label = F.array_min("paths")
    binary = F.position(F.lit(bytearray(b"\x00")), F.substring("data", 1, 8192)) > 0
    text = F.decode(F.coalesce("data", F.lit(bytearray())), "ISO-8859-1")
    small = F.col("size") <= most_bytes
    rules = F.concat(
        F.when(~small, F.array(F.lit("oversized-blob"))).otherwise(F.array().cast("array<string>")),
        F.when(small & F.exists("paths", suspicious_name), F.array(F.lit("sensitive-filename"))).otherwise(F.array().cast("array<string>")),
        F.when(small & ~binary, rule_hits(text, site_rules)).otherwise(F.array().cast("array<string>")),
    )
    return blobs.select(F.explode(rules).alias("rule"), label.alias("path"), F.substring("oid", 1, 12).alias("oid")).distinct()


def tree_findings(files: DataFrame, allowed: tuple[str, ...] = (), most_bytes: int = L.MOST_BLOB_BYTES, site_rules: tuple = ()) -> DataFrame:
    """PV3, PV4: distinct (rule, path) of files (path, length, content) of a working tree."""
    path = F.replace("path", F.lit("\\"), F.lit("/"))
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    empty = F.array().cast("array<string>")
    rules = F.concat(
        F.when(F.col("path").contains("\\"), F.array(F.lit("backslash-in-path"))).otherwise(empty),
        F.when(suffix.isin(*L.BLOCKED_SUFFIXES) & ~path.isin(*allowed), F.array(F.lit("blocked-extension"))).otherwise(empty),
        F.when(F.col("length") > most_bytes, F.array(F.lit("oversized-file"))).otherwise(empty),
        F.when(suffix.isin(*L.TEXT_SUFFIXES), rule_hits(F.decode("content", "ISO-8859-1"), site_rules)).otherwise(empty),
    )
    return files.select(F.explode(rules).alias("rule"), "path").distinct()


def text_findings(rows: DataFrame, id_col: str, text_col: str, site_rules: tuple = ()) -> DataFrame:
    """PV1 over any text: (id, rule)."""
    return rows.select(id_col, F.explode(rule_hits(F.coalesce(text_col, F.lit("")), site_rules)).alias("rule"))


def report_key(text: str) -> Column:
    return T.squeezed_lower(F.col(text))
