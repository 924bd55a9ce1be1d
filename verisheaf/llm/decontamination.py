"""Operator 6: benchmark decontamination by size-partitioned MinHash containment search.

A short test item may hide in a document of any length, so Jaccard similarity is of no use: the search is for
containment, the share of the item's shingles that the document has. Items are partitioned by size. Each keeps a
bottom-s MinHash sketch, its s smallest shingle hashes, with s = floor((1 - t) q) + 1 for q shingles: a document with
containment of at least t lacks fewer than s shingles, so it holds at least one of the sketch. Documents are sketched by
the hash bound of the partition, so their sketch grows with their length and long ones lose nothing. Candidates are
verified by exact containment of the shingles themselves. Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisheaf.llm.common import read_table, stage_table, text_of

WIDTH, THRESHOLD = 5, 0.8


def words_of(column: str) -> Column:
    """Lower-case words; all but letters and digits separates them."""
    return F.split(F.trim(F.regexp_replace(F.lower(text_of(column)), r"[^\p{L}\p{N}]+", " ")), " ")


def _shingles(words: str, width: int, each) -> Column:
    """each(i) for every place i at which a shingle begins; none in a text of fewer words."""
    n = F.size(words)
    places = F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, each)


def shingle_hashes(words: str, width: int) -> Column:
    return _shingles(words, width, lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(width)]))


def shingle_texts(words: str, width: int) -> Column:
    return F.array_distinct(_shingles(words, width, lambda i: F.array_join(F.slice(F.col(words), i + 1, width), " ")))


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WIDTH,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """A row per document and item it contains: doc_id, item_id, n_shared, n_item (distinct shingles), containment, and
    text_key, the MD5 of the document's words.

    Words are compared without case and punctuation. Items of fewer than five words have no shingle and match nothing,
    as do null and empty texts on either side. Items that repeat an id are taken as they are: each text is searched
    for, and (doc_id, item_id) appears once with the highest containment. Rows of documents that repeat an id and text
    give one row, those with another text are searched too. Null ids are kept as null. Empty tables give no rows. Extra
    columns are ignored.
    """
    index = items.select(F.col(item_id_col).alias("item_id"), words_of(item_text_col).alias("item_words")).where(F.size("item_words") >= width)
    index = index.select("item_id", shingle_texts("item_words", width).alias("item_shingles"), F.array_distinct(shingle_hashes("item_words", width)).alias("hashes"))
    q = F.size("hashes")
    index = index.select(
        F.monotonically_increasing_id().alias("item_key"),
        "item_id",
        "item_shingles",
        F.floor(F.log2(q)).cast("int").alias("part"),
        F.slice(F.array_sort("hashes"), 1, (F.floor(q * F.lit(1 - threshold) + 1e-9) + 1).cast("int")).alias("sketch"),
    )
    index = stage_table(index, "leak-items", shrink=8)
    sketch = index.select("item_key", "part", F.explode("sketch").alias("hash"))
    bounds = sketch.groupBy("part").agg(F.max("hash").alias("bound"))
    bound = bounds.agg(F.max("bound")).first()[0]
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), words_of(text_col).alias("doc_words"))
    base = base.where(F.size("doc_words") >= width).withColumn("text_key", F.md5(F.array_join("doc_words", " ")))
    seen = base.select("doc_id", "text_key", F.explode(shingle_hashes("doc_words", width)).alias("hash"))
    # Hashes above every partition's bound can meet no sketch; within it the join decides.
    seen = seen.where(F.col("hash") <= F.lit(bound if bound is not None else -(2**63)).cast("long"))
    found = seen.join(sketch, "hash").groupBy("doc_id", "text_key", "item_key").agg(F.count(F.lit(1)).alias("hits"))
    found = stage_table(found.drop("hits"), "leak-found", shrink=8)
    texts = base.join(found.select("doc_id", "text_key").distinct().select(F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key")), F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_key") == F.col("found_key")), "left_semi")
    texts = texts.select(F.col("doc_id").alias("held_id"), F.col("text_key").alias("held_key"), shingle_texts("doc_words", width).alias("doc_shingles"))
    pairs = found.join(index.select("item_key", "item_id", "item_shingles"), "item_key")
    pairs = pairs.join(texts, F.col("doc_id").eqNullSafe(F.col("held_id")) & (F.col("text_key") == F.col("held_key")))
    pairs = pairs.select(
        "doc_id",
        "text_key",
        "item_id",
        F.size(F.array_intersect("item_shingles", "doc_shingles")).cast("long").alias("n_shared"),
        F.size("item_shingles").cast("long").alias("n_item"),
    )
    pairs = pairs.where(F.col("n_shared") >= F.col("n_item") * F.lit(threshold) - 1e-9)
    best = pairs.groupBy("doc_id", "text_key", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_shared", "n_item")).alias("best"))
    return best.select("doc_id", "item_id", "best.n_shared", "best.n_item", "best.containment", "text_key")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without those that contain an item, all columns as they were. Cases as in contaminated."""
    found = contaminated(docs, items, id_col, text_col, **options).select(F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key")).distinct()
    found = stage_table(found, "leak-rows", shrink=8)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("at_id"), F.md5(F.array_join(words_of(text_col), " ")).alias("at_key"))
    return rows.join(found, F.col("at_id").eqNullSafe(F.col("found_id")) & (F.col("at_key") == F.col("found_key")), "left_anti").select("row.*")


def op6_decontaminate(spark, sf_dir):
    found = contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.drop("text_key")


SQL = r"""
WITH w AS (
  SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS ws FROM documents
), v AS (
  SELECT item_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS ws FROM benchmark
), d AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)
), b AS (
  SELECT DISTINCT item_id, array_to_string(ws[i:i+4], ' ') AS s FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM v)
), n AS (
  SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id
)
SELECT doc_id, item_id, CAST(count(*) AS BIGINT) AS n_shared, CAST(any_value(n_item) AS BIGINT) AS n_item,
       count(*)::DOUBLE / any_value(n_item)::DOUBLE AS containment
FROM d JOIN b USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= any_value(n_item) * 0.8 - 1e-9
"""
