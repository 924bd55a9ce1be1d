"""Aggregations: means, classification, calibration, bootstrap and paired statistics."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def mean(value: Column) -> Column:
    """AG1, AG2: of what is neither null nor NaN."""
    return F.avg(F.when(~F.isnan(value.cast("double")), value.cast("double")))


def ratio(a: Column, b: Column) -> Column:
    """AG3: null for a denominator of 0."""
    return F.try_divide(F.sum(a).cast("double"), F.sum(b).cast("double"))


def sample_deviation(value: Column) -> Column:
    """AG7: 0 for a single value."""
    return F.when(F.count(value) == 1, 0.0).otherwise(F.stddev_samp(value))


def summary(value: str) -> list[Column]:
    """AG4-AG7."""
    v = F.col(value).cast("double")
    return [F.sum(v).alias("sum"), F.max(v).alias("max"), F.count(v).alias("n"), F.median(v).alias("median"), F.percentile(v, F.lit(0.95)).alias("p95"), F.stddev_pop(v).alias("sd_pop"), sample_deviation(v).alias("sd_samp")]


def value_counts(rows: DataFrame, value: str, order: str, top: int | None = None) -> DataFrame:
    """AG8, AG9: most common first, ties by first appearance."""
    counts = rows.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen")).orderBy(F.desc("n"), "first_seen")
    return counts if top is None else counts.limit(top)


def duplicate_groups(rows: DataFrame, key: str) -> DataFrame:
    """AG11: groups of more than one row, and the rows in them."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """AG16 in long form: (truth, predicted, n)."""
    return rows.groupBy(F.col(truth).cast("string").alias("truth"), F.col(predicted).cast("string").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(rows: DataFrame, truth: str, predicted: str, labels: list[str]) -> DataFrame:
    """AG16: a row per true label, a column per predicted one."""
    return confusion(rows, truth, predicted).groupBy("truth").pivot("predicted", labels).agg(F.sum("n")).fillna(0)


def per_label(table: DataFrame) -> DataFrame:
    """AG15: label, precision, recall, f1, support from a table (truth, predicted, n)."""
    sides = table.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p")), F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p")))).alias("s"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"))
    sums = sides.groupBy("s.label").agg(F.sum("s.t").alias("support"), F.sum("s.p").alias("predicted"), F.sum(F.when(F.col("s.t") > 0, F.col("hit")).otherwise(0)).alias("hits"))
    precision, recall = F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0)), F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    return sums.select("label", "support", "predicted", "hits", precision.alias("precision"), recall.alias("recall"), F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"))


def classification(table: DataFrame) -> DataFrame:
    """AG15: one row from a table (truth, predicted, n): accuracy, balanced accuracy, macro and micro averages, Matthews
    correlation, Cohen's kappa."""
    labels = per_label(table).agg(
        F.sum("support").cast("double").alias("n"), F.sum("hits").cast("double").alias("hits"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), F.sum(F.col("support").cast("double") * F.col("predicted")).alias("tp"),
        F.sum(F.pow(F.col("support").cast("double"), F.lit(2))).alias("tt"), F.sum(F.pow(F.col("predicted").cast("double"), F.lit(2))).alias("pp"),
    )
    n, accuracy, chance = F.col("n"), F.try_divide("hits", "n"), F.try_divide(F.col("tp"), F.col("n") * F.col("n"))
    spread = F.sqrt((n * n - F.col("tt")) * (n * n - F.col("pp")))
    return labels.select(
        accuracy.alias("accuracy"), "balanced_accuracy", "macro_precision", "macro_recall", "macro_f1", accuracy.alias("micro_precision"), accuracy.alias("micro_recall"), accuracy.alias("micro_f1"),
        F.coalesce(F.try_divide(F.col("hits") * n - F.col("tp"), spread), F.lit(0.0)).alias("mcc"), F.try_divide(accuracy - chance, 1 - chance).alias("cohen_kappa"),
    )


def concept_scores(rows: DataFrame, key: str, truth: str, predicted: str) -> DataFrame:
    """AG17: concept, hits, predicted, support, precision, recall, f1 of sets in arrays. Micro averages are ratios of the
    sums, macro averages are over concepts with support."""
    each = lambda c, side: rows.select(key, F.explode(F.array_distinct(c)).alias("concept"), F.lit(1).alias(side))
    both = each(truth, "t").join(each(predicted, "p"), [key, "concept"], "full_outer").fillna(0, ["t", "p"])
    sums = both.groupBy("concept").agg(F.sum(F.col("t") * F.col("p")).alias("hits"), F.sum("p").alias("predicted"), F.sum("t").alias("support"))
    precision, recall = F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0)), F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    return sums.select("*", precision.alias("precision"), recall.alias("recall"), F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"))


def hashed_pick(seed: int, sample: Column, place: Column, n: Column) -> Column:
    """A place below n from MD5 of seed, sample and place: the same in every engine."""
    text = F.concat_ws("|", F.lit(str(seed)), sample.cast("string"), place.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n


#: Draws of one task.
DRAWS = 1_000_000


def bootstrap_means(values: DataFrame, value: str, ordinal: str, samples: int, seed: int, paired: bool = False) -> DataFrame:
    """AG20, AG22: n, mean, ci95_low, ci95_high (and ci_excludes_zero) of a column numbered from 0. Every sample draws n
    places with replacement. paired: the interval of differences, whose ends are picked by another convention.

    Rows are values times samples; each value is counted where it was drawn, so nothing is gathered but sample means.
    """
    v = values.select(F.col(ordinal).cast("long").alias("place"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    n = v.count()
    if not n:
        return v.sparkSession.createDataFrame([], "n long, mean double, ci95_low double, ci95_high double, ci_excludes_zero boolean")
    # Tasks grow in number with the draws, so that neither the drawing nor the counting of one takes more than DRAWS.
    tasks = -(-n * samples // DRAWS)
    draws = v.repartition(tasks, "place").select(F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"), "place")
    drawn = draws.select("sample", hashed_pick(seed, F.col("sample"), F.col("place"), F.lit(n)).alias("place")).repartition(tasks, "place")
    picked = drawn.groupBy("sample", "place").agg(F.count(F.lit(1)).alias("times"))
    v = v.repartition(tasks, "place")
    means = picked.join(v, "place").groupBy("sample").agg((F.sum(F.col("times") * F.col("v")) / n).alias("m"))
    low, high = (int(0.025 * (samples - 1)), int(0.975 * (samples - 1))) if paired else (max(0, int(0.025 * samples) - 1), min(samples - 1, int(0.975 * samples)))
    ends = means.agg(F.sort_array(F.collect_list("m")).alias("all")).select(F.col("all")[low].alias("ci95_low"), F.col("all")[high].alias("ci95_high"))
    # One row on either side.
    out = v.agg(F.count("v").alias("n"), F.avg("v").alias("mean")).join(ends)
    return out.withColumn("ci_excludes_zero", (F.col("ci95_low") > 0) | (F.col("ci95_high") < 0))


def bootstrap_statistic(values: DataFrame, ordinal: str, samples: int, seed: int, statistic: Callable[[pd.DataFrame], float], most_rows: int = 1_000_000) -> DataFrame:
    """AG21: value and interval of any statistic of a frame. Each sample is a group, so a group holds as many rows as the
    input; inputs above most_rows are refused."""
    n = values.count()
    if n > most_rows:
        raise ValueError(f"{n} rows; a sample must fit a task")
    numbered = values.withColumn("__place", F.col(ordinal).cast("long"))
    draws = numbered.select(F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("__sample"), F.col("__place").alias("__drawn"))
    draws = draws.select("__sample", hashed_pick(seed, F.col("__sample"), F.col("__drawn"), F.lit(max(n, 1))).alias("__place"))
    sampled = draws.join(numbered, "__place")
    each = sampled.groupBy("__sample").applyInPandas(lambda g: pd.DataFrame({"m": [float(statistic(g))]}), "m double")
    low, high = max(0, int(0.025 * samples) - 1), min(samples - 1, int(0.975 * samples))
    point = float(statistic(values.toPandas())) if n else None
    return each.agg(F.sort_array(F.collect_list("m")).alias("all")).select(F.lit(point).cast("double").alias("value"), F.col("all")[low].alias("ci95_low"), F.col("all")[high].alias("ci95_high"), F.lit(n).cast("long").alias("n"))


def run_deltas(base: DataFrame, other: DataFrame, higher_is_better: dict[str, bool]) -> DataFrame:
    """AG23 over one-row frames of metrics: metric, base, other, delta, higher_is_better, improved."""
    names = list(higher_is_better)
    long = lambda df, to: df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in names])).alias("x")).select("x.metric", F.col("x.v").alias(to))
    better = F.create_map(*[F.lit(x) for pair in higher_is_better.items() for x in pair])[F.col("metric")]
    both = long(base, "base").join(long(other, "other"), "metric").withColumn("delta", F.col("other") - F.col("base")).withColumn("higher_is_better", better)
    return both.withColumn("improved", F.when(F.col("higher_is_better"), F.col("delta") > 0).otherwise(F.col("delta") < 0))


def mcnemar(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """AG24 per group: n01 (only b right), n10, n00, n11, and the continuity-corrected statistic; 0 without discordance."""
    x, y = F.col(a).cast("boolean"), F.col(b).cast("boolean")
    out = pairs.groupBy(*by).agg(F.count_if(~x & y).alias("n01"), F.count_if(x & ~y).alias("n10"), F.count_if(~x & ~y).alias("n00"), F.count_if(x & y).alias("n11"))
    off = F.col("n01") + F.col("n10")
    return out.withColumn("statistic", F.coalesce(F.try_divide(F.pow(F.abs(F.col("n01") - F.col("n10")) - 1, F.lit(2)).cast("double"), off), F.lit(0.0)))


@F.udf(T.DoubleType())
def chi2_p(statistic: float | None) -> float | None:
    """Tail of the chi-squared law with one degree of freedom; there is no error function in SQL, and rows are few."""
    return None if statistic is None else math.erfc(math.sqrt(statistic / 2))


def with_p(table: DataFrame) -> DataFrame:
    return table.withColumn("p", F.when(F.col("n01") + F.col("n10") == 0, 1.0).otherwise(chi2_p("statistic")))


def holm(tests: DataFrame, p: str = "p", name: str = "run", alpha: float = 0.05) -> DataFrame:
    """AG25, WN1: step-down adjustment over a handful of tests: rank, raw (p times tests left), adjusted (never below an
    earlier one), significant by the raw value, and significant_monotone by the adjusted one."""
    order = Window.orderBy(p, name)
    out = tests.withColumn("rank", F.row_number().over(order)).withColumn("__m", F.count(F.lit(1)).over(Window.partitionBy()))
    out = out.withColumn("raw", F.least(F.lit(1.0), (F.col("__m") - F.col("rank") + 1) * F.col(p)))
    out = out.withColumn("adjusted", F.max("raw").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return out.drop("__m").withColumn("significant", F.col("raw") < alpha).withColumn("significant_monotone", F.col("adjusted") < alpha)


def reliability(rows: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """AG26: bin, n, mean confidence, accuracy and gap of bins of equal width, the last closed. A confidence is put by
    the edges themselves, since a product can round across one; what is outside 0 to 1 is in no bin."""
    c = F.col(confidence).cast("double")
    edges = F.array(*[F.lit(k / bins) for k in range(bins + 1)])
    place = F.least(F.size(F.filter(edges, lambda e: e <= c)) - 1, F.lit(bins - 1))
    inside = rows.where((c >= 0) & (c <= 1))
    out = inside.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(c).alias("confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy"))
    return out.withColumn("gap", F.abs(F.col("confidence") - F.col("accuracy")))


def expected_calibration_error(rows: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """AG26: one row, n (confidences outside count too) and ece."""
    n = rows.where(F.col(confidence).isNotNull()).agg(F.count(F.lit(1)).alias("n"))
    sums = reliability(rows, confidence, correct, bins).agg(F.coalesce(F.sum(F.col("n") * F.col("gap")), F.lit(0.0)).alias("__sum"))
    return n.join(sums).select("n", F.try_divide(F.col("__sum"), F.col("n")).alias("ece"))


def k_fold(rows: DataFrame, ordinal: str, metrics: list[str], k: int = 5, seed: int = 0) -> DataFrame:
    """AG27: metric, mean and standard deviation of fold means. Rows are shuffled by hash and dealt to folds in turn."""
    shuffled = rows.withColumn("__h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(ordinal).cast("string"))))
    from verisheaf.operators.quality import dense_ordinal

    dealt = dense_ordinal(shuffled, "__h", "__rank").withColumn("fold", F.col("__rank") % k)
    long = dealt.select("fold", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x")).select("fold", "x.metric", "x.v")
    means = long.groupBy("metric", "fold").agg(F.avg("v").alias("m"))
    return means.groupBy("metric").agg(F.round(F.avg("m"), 6).alias("fold_mean"), F.round(F.stddev_pop("m"), 6).alias("fold_sd"), F.count("m").alias("folds"))


def circular_benchmark(rows: DataFrame, index: str, hit: str, choice: str, error: str, period: int = 1_000_000) -> DataFrame:
    """AG28: one row. A group of permutations passes if all its parsed rows are right (strict_all_rows: all its rows)."""
    valid, h = F.col(error).isNull(), F.col(hit).cast("boolean")
    parsed = valid & F.col(choice).isNotNull()
    groups = rows.groupBy((F.col(index) % period).alias("g")).agg(F.bool_and(F.when(parsed, h)).alias("strict"), F.bool_and(parsed & h).alias("all_rows"))
    strict = groups.agg(F.avg(F.col("strict").cast("double")).alias("strict_circular"), F.avg(F.col("all_rows").cast("double")).alias("strict_all_rows"), F.count("strict").alias("n_groups"))
    flat = rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(valid).alias("n_valid"), F.count_if(parsed).alias("n_parsed"), F.count_if(~valid).alias("n_errors"),
        F.avg(F.when(parsed, h.cast("double"))).alias("all_accuracy"), F.avg(F.when(parsed & (F.col(index) <= period), h.cast("double"))).alias("circ0_accuracy"),
    )
    return flat.join(strict).withColumn("parse_rate", F.coalesce(F.try_divide("n_parsed", "n_valid"), F.lit(0.0)))


def by_category(rows: DataFrame, category: str, hit: str) -> DataFrame:
    return rows.groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(hit).cast("double")).alias("accuracy"))


def group_sizes(rows: DataFrame, key: str) -> DataFrame:
    """AG30: how many groups have how many rows."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("groups"))


def means_and_deviations(rows: DataFrame, metrics: list[str], error: str) -> DataFrame:
    """AG29: metric, mean, sd, n valid, n errors."""
    ok = F.col(error).isNull()
    long = rows.select(ok.alias("ok"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x"))
    v = F.when(F.col("ok"), F.col("x.v"))
    return long.groupBy("x.metric").agg(F.avg(v).alias("mean"), sample_deviation(v).alias("sd"), F.count_if("ok").alias("n_valid"), F.count_if(~F.col("ok")).alias("n_errors"))


def first_given(*columns: str) -> Column:
    """AG31: the first metric that isn't null, as a double."""
    return F.coalesce(*[F.col(c).cast("double") for c in columns])


def alignment_tax(value: Column, base: Column) -> Column:
    """AG31, in percentage points."""
    return 100 * (value - base)


#: AG33: which metrics the engine makes itself and which need columns from a model.
AVAILABLE = {
    "rouge": "built in", "bleu": "built in", "chrf": "built in", "meteor_exact": "built in", "cider_lite": "built in", "facts": "built in", "numbers": "built in",
    "classification": "built in", "calibration": "needs confidences", "bertscore": "needs token embeddings", "similarity": "needs embeddings", "attribution": "needs attribution shares",
}


def availability(spark, given: set[str] = frozenset()) -> DataFrame:
    """AG33: metric, status; metrics whose columns are given are available."""
    return spark.createDataFrame([(m, "available" if m in given or s == "built in" else s) for m, s in AVAILABLE.items()], "metric string, status string")
