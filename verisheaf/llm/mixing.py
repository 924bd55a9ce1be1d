"""Operator 10: mixing sources to target weights by weighted fair queueing.

Every shuffled document gets a virtual finish time, the words of its source up to its own end divided by the source's
target; the documents are ordered by it globally and cut at the total budget. Only DataFrame functions run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verisheaf.llm.common import NOT_WHITE, keep_on_disk, read_table, stage_table, text_of

#: Weights of the sources in the order of their names, repeating.
CYCLE = (5.0, 2.0, 1.0)
#: Budget as a share of all sizes, and how often a source may be repeated.
SHARE, EPOCHS = 1.5, 2
#: Hash ranges into which each source is cut for its running sum.
SLICES = 4096
#: Rows among which the last cut is made in one window.
LAST_CUT = 5000
SEED = "mix"


@dataclass
class Mix:
    """decisions: a row per document (doc_id, size, source_size, target, taken, copies, first_finish, text_key, source_key);
    budget: words in all; cut: the virtual finish time of the last entry taken."""

    decisions: DataFrame
    budget: float
    cut: float | None


def _source_key(column: str):
    """The source as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("~"))


def targets(sizes: DataFrame, cycle=CYCLE, share: float = SHARE, epochs: int = EPOCHS) -> tuple[DataFrame, float]:
    """Target of each source. sizes: a row per source (source, source_key, source_size), few enough for one task: names
    have to be ranked. A source asks for its weight's part of the budget; what it asks for beyond epochs times its
    size is reshared among the others by weight, until none is above. Only sums come to the driver."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, cycle)), F.pmod(rank, F.lit(len(cycle))).cast("int") + 1)
    table = sizes.select("source_key", "source_size", weight.alias("weight"), (F.col("source_size") * epochs).cast("double").alias("most"))
    table = stage_table(table, "mix-sources", shrink=1 << 30)
    total, most = table.agg(F.sum("source_size"), F.sum("most")).first()
    budget = min(share * (total or 0), most or 0.0)
    # A source is full once level * weight reaches its most; the level only rises, so this ends.
    level = 0.0
    while True:
        full = F.col("most") < F.lit(level) * F.col("weight")
        taken, weights = table.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not weights:
            break
        new = (budget - (taken or 0.0)) / weights
        if new <= level:
            break
        level = new
    return table.select("source_key", "source_size", F.least("most", F.lit(level) * F.col("weight")).alias("target")), budget


def _cut(entries: DataFrame, budget: float) -> tuple[float | None, DataFrame | None]:
    """The finish time below which all entries are taken, and the few entries at the cut that need to be ranked. The
    interval that holds the cut is halved into 1024 parts until it holds few rows or a single finish time."""
    low, high, before = None, None, 0
    span = entries.agg(F.min("finish"), F.max("finish"), F.sum("size")).first()
    if span[0] is None or span[2] <= budget:
        return None, None
    low, high = span[0], span[1]
    while True:
        width = (high - low) / 1024
        inside = entries.where((F.col("finish") >= low) & (F.col("finish") <= high))
        if width <= 0 or low + width == low:
            return low, inside.withColumn("before", F.lit(before).cast("long"))
        part = F.least(F.floor((F.col("finish") - low) / width), F.lit(1023)).cast("int")
        sums = sorted(inside.groupBy(part.alias("part")).agg(F.sum("size"), F.count(F.lit(1)), F.min("finish"), F.max("finish")).collect())
        for _, words, rows, first, last in sums:
            if before + words > budget:
                low, high = first, last
                break
            before += words
        if rows <= LAST_CUT or first == last:
            inside = entries.where((F.col("finish") >= low) & (F.col("finish") <= high))
            return low, inside.withColumn("before", F.lit(before).cast("long"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    cycle=CYCLE,
    share: float = SHARE,
    epochs: int = EPOCHS,
    seed: str = SEED,
) -> Mix:
    """Mix documents so that each source comes near its target.

    A document's size is its number of words (runs of what isn't white space). Its place in its source comes from the
    MD5 of seed and id, the same in each repeat. Entries (document, repeat) are taken in the order of finish time,
    source, repeat, hash, id and size as long as their sum stays within the budget.

    Running sums are made in two levels (4,096 hash ranges a source, summed first), so a source with a third of all
    rows has no task of its own; the cut is found by histograms.

    Null text has size 0 and takes 0; documents of size 0 are never taken. Null sources are a source, the last. Null
    ids share a hash; ties and repeated rows are ordered by size, and equal rows get the same multiset of decisions.
    Empty input gives no rows. Extra columns are ignored.
    """
    if not cycle or min(cycle) <= 0:
        raise ValueError("weights must be above 0")
    size = F.regexp_count(text_of(text_col), F.lit(NOT_WHITE)).cast("long")
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        _source_key(source_col).alias("source_key"),
        size.alias("size"),
        F.xxhash64(text_of(text_col)).alias("text_key"),
    )
    base = base.withColumn("hash", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    base = base.withColumn("slice", F.conv(F.substring("hash", 1, 3), 16, 10).cast("int"))
    base = keep_on_disk(base)
    slices = base.groupBy("source", "source_key", "slice").agg(F.sum("size").alias("slice_size"))
    slices = stage_table(slices, "mix-slices", shrink=8)
    goal, budget = targets(slices.groupBy("source", "source_key").agg(F.sum("slice_size").alias("source_size")), cycle, share, epochs)
    before = Window.partitionBy("source_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select("source_key", "slice", F.coalesce(F.sum("slice_size").over(before), F.lit(0)).alias("start"))
    starts = starts.join(goal, "source_key")
    inside = Window.partitionBy("source_key", "slice").orderBy("hash", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = base.join(starts, ["source_key", "slice"]).withColumn("end", F.col("start") + F.sum("size").over(inside))
    placed = placed.select("doc_id", "text_key", "source_key", "hash", "size", "source_size", "target", "end")
    placed = stage_table(placed, "mix-placed", shrink=8)
    times = [((F.lit(k) * F.col("source_size") + F.col("end")) / F.col("target")) for k in range(epochs)]
    entries = placed.where("size > 0 and target > 0").select(
        "*", F.posexplode(F.array(*times)).alias("turn", "finish")
    )
    entries = entries.select("doc_id", "source_key", "hash", "size", "end", "turn", "finish")
    low, edge = _cut(entries, budget)
    if low is None:
        copies = F.when((F.col("size") > 0) & (F.col("target") > 0), F.lit(epochs)).otherwise(F.lit(0))
        decided = placed.withColumn("copies", copies)
    else:
        order = Window.orderBy("finish", "source_key", "turn", "hash", F.col("doc_id").asc_nulls_last(), "size")
        ranked = edge.withColumn("sum", F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        ranked = ranked.where(F.col("sum") <= F.lit(budget))
        # "end" tells apart rows of one source; turns at the edge are few.
        more = ranked.groupBy("source_key", "end", "size").agg(F.count(F.lit(1)).alias("more"))
        sure = sum((F.when(t < F.lit(low), 1).otherwise(0) for t in times), F.lit(0))
        decided = placed.join(more, ["source_key", "end", "size"], "left")
        copies = F.when((F.col("size") > 0) & (F.col("target") > 0), sure + F.coalesce("more", F.lit(0))).otherwise(F.lit(0))
        decided = decided.withColumn("copies", copies)
    out = decided.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).cast("long").alias("taken"),
        F.col("copies").cast("int").alias("copies"),
        (F.when(F.col("target") > 0, times[0])).alias("first_finish"),
        "text_key",
        "source_key",
    )
    return Mix(out, budget, low)


def repeat_mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """docs as often as the mix takes them, all columns as they were. Cases as in mix_sources."""
    taken = mix_sources(docs, id_col, source_col, text_col, **options).decisions.where("copies > 0")
    taken = taken.groupBy(F.col("doc_id").alias("mix_id"), F.col("text_key").alias("mix_key"), F.col("source_key").alias("mix_source")).agg(F.sum("copies").cast("int").alias("copies"), F.count(F.lit(1)).alias("n_rows"))
    taken = stage_table(taken, "mix-taken", shrink=4)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("at_id"), F.xxhash64(text_of(text_col)).alias("at_key"), _source_key(source_col).alias("at_source"))
    out = rows.join(taken, F.col("at_id").eqNullSafe(F.col("mix_id")) & (F.col("at_key") == F.col("mix_key")) & (F.col("at_source") == F.col("mix_source")))
    if not taken.where("n_rows > 1").isEmpty():  # rows that repeat id, text and source were counted together
        out = out.dropDuplicates(["at_id", "at_key", "at_source"])
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def op10_mix_sources(spark, sf_dir):
    return mix_sources(read_table(spark, sf_dir, "documents")).decisions.select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH b AS (
  SELECT doc_id, source, coalesce('=' || source, '~') AS source_key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hash
  FROM documents
), s AS (
  SELECT source_key, CAST(sum(size) AS BIGINT) AS source_size,
         (ARRAY[5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[CAST((row_number() OVER (ORDER BY any_value(source) NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight
  FROM b GROUP BY source_key
), t AS (
  SELECT *, 2.0::DOUBLE * source_size AS most FROM s
), r AS (
  SELECT *, row_number() OVER (ORDER BY most / weight, source_key) AS k,
         coalesce(sum(most) OVER (ORDER BY most / weight, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
         sum(weight) OVER (ORDER BY most / weight, source_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM t
), q AS (
  SELECT (SELECT least(1.5::DOUBLE * sum(source_size), sum(most)) FROM t) AS budget
), l AS (
  SELECT (q.budget - full_before) / open_weight AS level
  FROM r, q WHERE (q.budget - full_before) / open_weight * weight <= most ORDER BY k LIMIT 1
), g AS (
  SELECT source_key, source_size, least(most, l.level * weight) AS target FROM t, l
), p AS (
  SELECT b.*, g.source_size, g.target,
         CAST(sum(size) OVER (PARTITION BY b.source_key ORDER BY hash, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "end"
  FROM b JOIN g USING (source_key)
), e AS (
  SELECT p.*, turn, (turn * source_size + "end") / target AS finish
  FROM p, (VALUES (0), (1)) AS v(turn) WHERE size > 0 AND target > 0
), c AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY finish, source_key, turn, hash, doc_id, size ROWS UNBOUNDED PRECEDING) AS run FROM e
), k AS (
  SELECT doc_id, CAST(sum(c.size) AS BIGINT) AS taken FROM c, q WHERE run <= q.budget GROUP BY doc_id
)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(k.taken, 0) AS taken
FROM p LEFT JOIN k USING (doc_id)
"""
