"""Joins with the guards that the report tools put on them. Each says what becomes of rows without a partner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unmatched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Keys of either side that the other lacks, with the side that has them."""
    a = left.select(*on).distinct().withColumn("__l", F.lit(1))
    b = right.select(*on).distinct().withColumn("__r", F.lit(1))
    both = a.join(b, on, "full_outer").where(F.col("__l").isNull() | F.col("__r").isNull())
    return both.select(*on, F.when(F.col("__l").isNull(), "right").otherwise("left").alias("side"))


def complete_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """JN1, JN3: inner join that raises if a key of either side has no partner."""
    bad = unmatched(left, right, on).limit(5).collect()
    if bad:
        raise ValueError(f"keys without a partner: {bad}")
    return left.join(right, on)


def paired(left: DataFrame, right: DataFrame, on: str, value: str, other: str | None = None) -> DataFrame:
    """JN4, JN5: (on, a, b), a value of the left and one of the right (of the same name unless other is given) for keys
    that both sides have; other keys are left out, null keys too."""
    return left.select(on, F.col(value).alias("a")).join(right.select(on, F.col(other or value).alias("b")), on)


def last_wins_join(left: DataFrame, right: DataFrame, on: str, order: str) -> DataFrame:
    """JN2: inner join with the last right row of each key; left rows without one are dropped."""
    columns = [c for c in right.columns if c != on]
    last = right.groupBy(on).agg(F.max_by(F.struct(*columns), order).alias("__last"))
    return left.join(last, on).select(*left.columns, *[F.col(f"__last.{c}").alias(c) for c in columns if c not in left.columns])


def positional_join(left: DataFrame, right: DataFrame, ordinal: str) -> DataFrame:
    """JN6, JN7: rows with the same ordinal; raises if the numbers of rows differ."""
    sizes = left.agg(F.count(F.lit(1))).first()[0], right.agg(F.count(F.lit(1))).first()[0]
    if sizes[0] != sizes[1]:
        raise ValueError(f"sides of {sizes[0]} and {sizes[1]} rows")
    return left.join(right, ordinal)


def resolve_reference(rows: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """JN8: a value of digits alone stands for the value of the row with that key."""
    known = rows.select(F.col(key).alias("__key"), F.col(value).alias("__value"))
    points = F.when(F.col(value).rlike(r"^\d+\z"), F.col(value).try_cast("long"))
    return rows.withColumn("__points", points).join(known, F.col("__points") == F.col("__key"), "left").select(*rows.columns, F.when(F.col("__points").isNull(), F.col(value)).otherwise(F.col("__value")).alias(out))


def present_in(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """JN9."""
    return left.join(right.select(*on).distinct(), on, "left_semi")


def absent_from(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """JN10, JN11."""
    return left.join(right.select(*on).distinct(), on, "left_anti")


def others_in_case(views: DataFrame, case: str, view: str, values: str, out: str) -> DataFrame:
    """JN12: for each view the distinct values (arrays) of the other views of its case. A value that other views have is
    one that more views of the case hold than this one does, so views never meet in pairs."""
    each = views.select(case, view, F.explode(F.array_distinct(values)).alias("__v"))
    holders = each.groupBy(case, "__v").agg(F.count(F.lit(1)).alias("__n"))
    everyone = holders.groupBy(case).agg(F.collect_list(F.struct("__v", "__n")).alias("__all"))
    joined = views.join(everyone, case, "left")
    mine = F.col(values)
    other = F.filter(F.coalesce("__all", F.array()), lambda x: (x["__n"] > 1) | ~F.array_contains(mine, x["__v"]))
    return joined.select(*views.columns, F.transform(other, lambda x: x["__v"]).alias(out))


def matching_terms(texts: DataFrame, text: str, terms: DataFrame, most_terms: int = 10_000) -> DataFrame:
    """JN13: (text columns, term) where the text contains the term, case aside. terms: a word list, whose size is
    checked before it goes to every task."""
    listed = [r.term for r in terms.select("term").distinct().limit(most_terms + 1).collect()]
    if len(listed) > most_terms:
        raise ValueError(f"more than {most_terms} terms")
    known = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(t.lower()).alias("low")) for t in sorted(listed)]) if listed else F.array().cast("array<struct<term:string,low:string>>")
    low = F.lower(F.col(text))
    return texts.withColumn("__low", low).select(*texts.columns, F.explode(F.filter(known, lambda t: F.contains(F.col("__low"), t["low"]))).alias("__t")).select(*texts.columns, F.col("__t.term").alias("term"))
