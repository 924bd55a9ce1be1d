"""Data-quality rules, deduplication and split checks of message records."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verisheaf.functions import kernels as K
from verisheaf.functions import records as R
from verisheaf.functions import text as T


def reasons_of(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, sorted."""
    return F.array_sort(F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])))


def prepare(records: DataFrame, min_analysis_chars: int = 8, missing_files: str | None = None) -> DataFrame:
    """DQ1: records (record_index, images, messages) with target, cleaned, diagnosis, canonical_target and reasons.
    missing_files: a column that counts images without a file (see sources.listing)."""
    out = records.withColumn("target", R.first_content(F.col("messages"), "assistant")).withColumn("prompt", R.first_content(F.col("messages"), "user"))
    out = out.withColumn("pictures", F.coalesce("images", F.array().cast("array<string>")))
    out = out.withColumn("__t", K.parts_of("target"))
    part = lambda name: F.col(f"__t.{name}")
    out = out.select("*", *[part(name).alias(name) for name in ("cleaned", "diagnosis", "body", "canonical_target")])
    rules = {
        "missing_assistant_target": part("blank"),
        "no_images": F.size("pictures") == 0,
        "duplicate_image_path_within_case": F.size("pictures") != F.size(F.array_distinct("pictures")),
        "image_placeholder_count_mismatch": T.placeholder_count(F.col("prompt")) != F.size("pictures"),
        "missing_image_file": (F.col(missing_files) > 0) if missing_files else F.lit(False),
        "repeated_position_header": F.size(part("headers")) != F.size(F.array_distinct(part("headers"))),
        "position_header_count_exceeds_images": F.size(part("headers")) > F.size("pictures"),
        "missing_diagnosis_section": ~part("labelled"),
        "empty_diagnosis": part("labelled") & (F.col("diagnosis") == ""),
        "diagnosis_unavailable_placeholder": part("unavailable"),
        "analysis_too_short": part("body_chars") < min_analysis_chars,
        "insufficient_pathology_content": part("cues") < 2,
        "target_too_short": part("target_chars") < min_analysis_chars + 8,
    }
    return listed_once(out, "reasons", reasons_of(rules)).drop("prompt", "pictures", "__t")


def listed_once(rows: DataFrame, name: str, reasons: Column) -> DataFrame:
    """rows with a column of reasons that is made once a row. It comes out of a generator, since a filter on a plain
    column is moved below it and takes copies of all expressions it is made of along, one for each mention."""
    return rows.select("*", F.explode(F.array(reasons)).alias(name))


def split_kept(prepared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DQ2: rows without and with reasons."""
    return prepared.where(F.size("reasons") == 0), prepared.where(F.size("reasons") > 0)


def keep_first(rows: DataFrame, key: str | list[str], order: str) -> DataFrame:
    """DD1: rows with keep and duplicate_of, the order value of the first row of the key (null for that row)."""
    keys = [key] if isinstance(key, str) else key
    first = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min(order).alias("__first"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    joined = rows.join(first, on)
    return joined.select(*rows.columns, (F.col(order) == F.col("__first")).alias("keep"), F.when(F.col(order) != F.col("__first"), F.col("__first")).alias("duplicate_of"))


def repeats_itself(values: Column) -> Column:
    """DD2."""
    return F.size(F.array_distinct(values)) != F.size(values)


#: Rows that one task may fold alone.
FOLD_ROWS = 200_000


def keep_first_of_two(rows: DataFrame, order: str, a: str, b: str) -> DataFrame:
    """DD3: in order, a row is kept if neither of its keys was kept before; a rejected row reserves neither. Adds keep.

    A row that comes first of both its keys is kept whatever the others are, and rows that share a key with it are
    rejected; what is left is judged so again. Rounds work on numbers and keys alone, in aggregations and anti joins, so no
    task holds a key's rows. The last rows, FOLD_ROWS at most, are folded in one task. Should a round settle less than a
    twentieth, as in long chains of rows that wait for each other, the rest is folded in connected groups. A null key is
    a key like any other; rows that tie in order go by their keys.
    """
    from verisheaf.operators.graph import ensure_checkpoints

    ensure_checkpoints(rows.sparkSession)
    base = rows.withColumn("__row", F.monotonically_increasing_id()).checkpoint()
    sort = [F.asc_nulls_last(c) for c in ("__order", "__a", "__b")]
    keys = base.select("__row", F.col(order).alias("__order"), F.col(a).alias("__a"), F.col(b).alias("__b"))
    # Ranges follow one another, so the numbers of rows sorted inside them are in order over all.
    placed = keys.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("__at", F.monotonically_increasing_id()).drop("__order").checkpoint()
    left = placed.select("__at", "__a", "__b")
    n, kept = left.count(), []
    while n > FOLD_ROWS:
        first = lambda k: left.groupBy(k).agg(F.min("__at").alias("__at"))  # noqa: B023, E731
        won = first("__a").join(first("__b"), "__at").checkpoint()
        kept.append(won.select("__at"))
        for k in ("__a", "__b"):
            left = left.join(won.select(F.col(k).alias("__won")), F.col(k).eqNullSafe(F.col("__won")), "left_anti")
        left = left.checkpoint()
        before, n = n, left.count()
        if n > FOLD_ROWS and before - n < before / 20:
            break
    if n:
        kept.append(_folded(left, n <= FOLD_ROWS))
    won = reduce(DataFrame.unionByName, kept) if kept else placed.select("__at").limit(0)
    won = placed.join(won, "__at", "left_semi").select("__row", F.lit(True).alias("keep"))
    return base.join(won, "__row", "left").select(*rows.columns, F.coalesce("keep", F.lit(False)).alias("keep"))


def _folded(left: DataFrame, few: bool) -> DataFrame:
    """__at of the rows that a fold over (__at, __a, __b) keeps, in one group or in connected ones."""
    from verisheaf.operators.graph import connected

    node = lambda k: F.coalesce(F.concat(F.lit(k + ":"), F.col(k).cast("string")), F.lit(k))
    if few:
        placed = left.withColumn("__group", F.lit("all"))
    else:
        groups = connected(left.select(node("__a").alias("x"), node("__b").alias("y")), "x", "y")
        placed = left.join(groups.select(F.col("node").alias("__node"), F.col("component").alias("__group")), node("__a") == F.col("__node")).drop("__node")

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        seen_a, seen_b, keep = set(), set(), []
        frame = frame.sort_values("__at")
        for at, x, y in zip(frame["__at"], frame["x"], frame["y"], strict=True):
            if x not in seen_a and y not in seen_b:
                seen_a.add(x)
                seen_b.add(y)
                keep.append(at)
        return pd.DataFrame({"__at": keep})

    return placed.select("__group", "__at", node("__a").alias("x"), node("__b").alias("y")).groupBy("__group").applyInPandas(fold, "__at long")


def message_issues(records: DataFrame) -> DataFrame:
    """DQ3: (record_index, issue), a row for each issue."""
    said = F.col("messages")
    answers = F.filter(said, lambda m: m["role"] == "assistant")
    places = F.aggregate(said, F.lit(0), lambda n, m: n + F.regexp_count(F.coalesce(m["content"], F.lit("")), F.lit("<image>")))
    rules = {
        "no_messages": F.size(said) == 0,
        "placeholder_mismatch": places != F.size(F.coalesce("images", F.array().cast("array<string>"))),
        "first_role_not_user": F.coalesce(F.get(said, F.lit(0))["role"], F.lit("")) != "user",
        "no_assistant": F.size(answers) == 0,
        "empty_assistant": F.exists(answers, lambda m: F.trim(F.coalesce(m["content"], F.lit(""))) == ""),
    }
    return records.select("record_index", F.explode(reasons_of(rules)).alias("issue"))


def reason_counts(excluded: DataFrame, column: str = "reasons") -> DataFrame:
    """AG10."""
    return excluded.select(F.explode(column).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def remove_shared(train: DataFrame, test: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """JN10: train without, and with only, rows whose key is in test."""
    keys = test.select(key).distinct()
    return train.join(keys, key, "left_anti"), train.join(keys, key, "left_semi")


def clean_split(prepared: DataFrame, key: str = "canonical_target", order: str = "record_index") -> DataFrame:
    """Rows that pass the rules and come first of their target, with clean_index in order. A row crosses the network once
    at most, by the digest of its key; all columns given go along."""
    kept = split_kept(prepared)[0]
    first = kept.groupBy(F.sha2(F.col(key), 256).alias("__key")).agg(F.min_by(F.struct(*kept.columns), order).alias("__row")).select("__row.*")
    return dense_ordinal(first, order, "clean_index")


def dense_ordinal(rows: DataFrame, order: str, name: str) -> DataFrame:
    """WN2: 0, 1, … in the order of a column, over all rows. Ranges of the order are numbered apart and then shifted by
    the sizes of those before, so no task sees all rows."""
    placed = rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at"))
    placed = placed.withColumn("__at", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).persist(StorageLevel.DISK_ONLY)
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    return placed.join(starts, "__part").select(*rows.columns, (F.col("__start") + F.col("__at")).alias(name))


def assert_none(violations: dict[str, DataFrame]) -> DataFrame:
    """DQ6, DQ7: (rule, violations), a row per rule; raise with require_none."""
    out = None
    for name, frame in violations.items():
        row = frame.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("rule"), "violations")
        out = row if out is None else out.unionByName(row)
    return out


def require_none(summary: DataFrame) -> None:
    bad = [(r.rule, r.violations) for r in summary.where("violations > 0").limit(100).collect()]
    if bad:
        raise ValueError(f"rules are violated: {bad}")


def missing_indexes(expected: DataFrame, predictions: DataFrame, key: str = "case_index") -> DataFrame:
    """DQ8, DQ9: (key, problem) for keys missing, unexpected, failed or empty."""
    both = expected.select(key, F.lit(True).alias("__e")).join(predictions.select(key, "prediction", "error", F.lit(True).alias("__p")), key, "full_outer")
    problem = (
        F.when(F.col("__p").isNull(), "missing")
        .when(F.col("__e").isNull(), "unexpected")
        .when(F.col("error").isNotNull(), "errored")
        .when(F.trim(F.coalesce("prediction", F.lit(""))) == "", "empty")
    )
    return both.select(key, problem.alias("problem")).where("problem is not null")


def config_contrast(settings: DataFrame, baseline: str, controlled: list[str], allowed: dict[str, list[str]]) -> DataFrame:
    """DQ12: settings (file, key, value); (file, key, problem) where a controlled key differs from the baseline, another
    differs without being allowed, or an allowed one doesn't differ."""
    base = settings.where(F.col("file") == baseline).select("key", F.col("value").alias("base_value"))
    files = settings.select("file").distinct().where(F.col("file") != baseline)
    keys = settings.select("key").distinct()
    # Configurations are a handful of files with a few dozen keys.
    grid = files.join(F.broadcast(keys)).join(settings, ["file", "key"], "left").join(base, "key", "left")
    differs = ~F.col("value").eqNullSafe(F.col("base_value"))
    may = F.lit(False)
    for name, ok in allowed.items():
        may = may | ((F.col("file") == name) & F.col("key").isin(*ok))
    problem = F.when(differs & F.col("key").isin(*controlled), "controlled_differs").when(differs & ~may, "unexpected_difference").when(~differs & may, "missing_difference")
    return grid.select("file", "key", problem.alias("problem")).where("problem is not null")


def adapter_components(keys: DataFrame, components: dict[str, list[str | tuple[str, ...]]], column: str = "key") -> DataFrame:
    """DQ13: run and, for each component, whether a key names it: has one of its parts, or all parts of a tuple."""
    has = lambda part: F.contains(F.col(column), F.lit(part))
    each = lambda part: has(part) if isinstance(part, str) else reduce(Column.__and__, map(has, part))
    found = [F.bool_or(F.greatest(*map(each, parts), F.lit(False))).alias(name) for name, parts in components.items()]
    return keys.groupBy("run").agg(*found)


def empty_answers(records: DataFrame) -> DataFrame:
    """DQ14: (source_index from 1) of records with an empty or absent answer."""
    bad = ~F.exists("messages", lambda m: (m["role"] == "assistant") & (F.trim(F.coalesce(m["content"], F.lit(""))) != ""))
    return records.where(bad).select((F.col("record_index") + 1).alias("source_index"))


def placeholder_paths(settings: DataFrame) -> DataFrame:
    """DQ15."""
    return settings.where(F.contains(F.col("value"), F.lit("/path/to/"))).select("file", "key")


def acceptance(row: DataFrame, required: list[str], zero: list[str], ordered: tuple[str, str]) -> DataFrame:
    """DQ11 over a one-row frame: what is given, 0 <= low <= high <= 1, no errors; and all of it as accepted."""
    low, high = ordered
    given = F.forall(F.array(*[F.col(c).cast("double") for c in required]), lambda v: v.isNotNull() & ~F.isnan(v))
    return row.select(
        given.alias("complete"),
        F.coalesce((F.col(low) >= 0) & (F.col(low) <= F.col(high)) & (F.col(high) <= 1), F.lit(False)).alias("interval_ordered"),
        F.forall(F.array(*[F.col(c).cast("long") for c in zero]), lambda v: v == 0).alias("no_errors"),
    ).withColumn("accepted", F.col("complete") & F.col("interval_ordered") & F.col("no_errors"))

