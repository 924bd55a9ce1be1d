"""Acceptance rules of message datasets and of runs: violations as rows, gates as boolean columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisheaf.functions import records as R
from verisheaf.functions import text as T
from verisheaf.functions.lexicon import PLACEHOLDERS
from verisheaf.operators.quality import keep_first, reasons_of

#: The thirteen metrics that a finished run gives.
REQUIRED_METRICS = (
    "rougeL_f1",
    "bertscore_f1",
    "bleu4",
    "meteor",
    "cider",
    "exact_diagnosis_accuracy",
    "bootstrap_95ci_low",
    "bootstrap_95ci_high",
    "ece",
    "entropy_proxy",
    "gradient_visual_share",
    "attention_visual_mass",
    "biobert_similarity",
)


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key an earlier row of the split has."""
    return keep_first(rows, ["split", key], "record_index").where("not keep").select("split", "record_index")


def _leaked(rows: DataFrame, key: Column) -> DataFrame:
    """Values of a key that more than one split has, once each."""
    seen = rows.select("split", key.alias("value")).groupBy("value").agg(F.count_distinct("split").alias("splits"))
    return seen.where("splits > 1")


def _with_missing(rows: DataFrame) -> DataFrame:
    return rows if "missing_files" in rows.columns else rows.withColumn("missing_files", F.lit(0))


def clean_set_violations(rows: DataFrame, sizes: dict[str, int] | None = None) -> DataFrame:
    """DQ6: rows (split, record_index, images, messages and, from sources.io.missing_images, missing_files); a row
    (split, record_index, rule) for each rule broken. record_index is null where the rule is of a split or of all
    splits, split too in the latter case: target_leakage is a row for each target that several splits have. sizes: the
    number of rows a split must have. Null images count as none, a null message as empty. No rows break no rule but
    sizes."""
    base = _with_missing(rows).withColumn("target", R.first_content(F.col("messages"), "assistant"))
    label = r"(?sU)病理诊断\s*[：:]\s*(\S.*)"
    base = base.withColumn("first_line", T.squeezed_lower(F.regexp_extract("target", r"(?U)病理诊断\s*[：:]\s*(\S[^\r\n]*)", 1)))
    base = base.withColumn("key", T.squeezed_lower(F.col("target"))).withColumn("pictures", F.coalesce("images", F.array().cast("array<string>")))
    rules = {
        "position_in_target": F.col("target").rlike(T.POSITION),
        "missing_diagnosis": ~F.col("target").rlike(label),
        "unavailable_diagnosis": F.col("first_line").isin(*PLACEHOLDERS),
        "bad_images": (F.size("pictures") == 0) | (F.size(F.array_distinct("pictures")) != F.size("pictures")),
        "missing_image": F.col("missing_files") > 0,
    }
    single = base.select("split", "record_index", F.explode(reasons_of(rules)).alias("rule"))
    narrow = base.select("split", "record_index", F.md5("key").alias("key"))
    found = single.unionByName(_repeated(narrow, "key").withColumn("rule", F.lit("duplicate_target")))
    return found.unionByName(_of_sets(_leaked(narrow, F.col("key")), "target_leakage", rows)).unionByName(_sizes(rows, sizes))


def _of_sets(found: DataFrame, rule: str, like: DataFrame) -> DataFrame:
    kinds = dict(like.dtypes)
    nothing = [F.lit(None).cast(kinds[c]).alias(c) for c in ("split", "record_index")]
    return found.select(*nothing, F.lit(rule).alias("rule"))


def _sizes(rows: DataFrame, sizes: dict[str, int] | None) -> DataFrame:
    wanted = rows.sparkSession.createDataFrame(list((sizes or {}).items()), "split string, wanted long")
    found = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    off = wanted.join(found, "split", "left").where(F.coalesce("n", F.lit(0)) != F.col("wanted"))
    index = F.lit(None).cast(dict(rows.dtypes)["record_index"])
    return off.select("split", index.alias("record_index"), F.lit("unexpected_size").alias("rule"))


def one_to_one_violations(rows: DataFrame) -> DataFrame:
    """DQ7: rows as in clean_set_violations, each a single view; (split, record_index, rule) for each rule broken.
    Repeats within a split have a row for each split and no record_index; leaks between splits have one row for each
    value, without a split."""
    target, prompt = R.first_content(F.col("messages"), "assistant"), R.first_content(F.col("messages"), "user")
    base = _with_missing(rows).withColumn("target", target).withColumn("prompt", prompt)
    base = base.withColumn("pictures", F.coalesce("images", F.array().cast("array<string>")))
    rules = {
        "image_count_not_one": F.size("pictures") != 1,
        "placeholder_count_not_one": T.placeholder_count(F.col("prompt")) != 1,
        "invalid_target_schema": ~F.col("target").startswith("图像分析："),
        "case_diagnosis_copied_to_single_view": F.col("target").contains("病理诊断"),
        "position_token_in_target": F.col("target").rlike(T.VIEW_POSITION),
        "missing_image": F.col("missing_files") > 0,
    }
    found = base.select("split", "record_index", F.explode(reasons_of(rules)).alias("rule"))
    images = base.select("split", F.explode("pictures").alias("value"))
    marks = "(?U)[\\s，。；;：:、\\\\（）()【】\\[\\]<>《》“”\"'—-]+"
    targets = base.select("split", F.md5(F.lower(F.regexp_replace("target", marks, ""))).alias("value"))
    for kind, values, leak in (("image", images, "image_leakage_train_to_test"), ("target", targets, "exact_target_leakage_train_to_test")):
        twice = values.groupBy("split", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("split").distinct()
        index = F.lit(None).cast(dict(rows.dtypes)["record_index"]).alias("record_index")
        found = found.unionByName(twice.select("split", index, F.lit(f"duplicate_{kind}_within_split").alias("rule")))
        found = found.unionByName(_of_sets(_leaked(values, F.col("value")), leak, rows))
    return found


def image_mismatches(predictions: DataFrame, audit: DataFrame, key: str) -> DataFrame:
    """DQ10: predictions (key, images, prediction, error) against audit (key, image), one row of each a key; (key,
    problem) where the prediction is missing, failed or empty, or its images aren't just the audited one. Null images
    are no images."""
    got = predictions.select(key, "images", "prediction", "error", F.lit(True).alias("__p"))
    both = audit.select(key, "image").join(got, key, "left")
    invalid = F.col("error").isNotNull() | (T.strip(F.coalesce("prediction", F.lit(""))) == "")
    other = ~F.coalesce("images", F.array().cast("array<string>")).eqNullSafe(F.array("image"))
    problem = F.when(F.col("__p").isNull(), "missing").when(invalid, "invalid_prediction").when(other, "image_mismatch")
    return both.select(key, problem.alias("problem")).where("problem is not null")


def component_mismatches(observed: DataFrame, expected: dict[str, dict[str, bool]]) -> DataFrame:
    """DQ13: observed (run and a boolean column per component, from adapter_components) against the matrix of expected
    components; (run, component, expected, observed) where they differ. A run that isn't observed differs in all."""
    listed = [(run, name, value) for run, parts in expected.items() for name, value in parts.items()]
    wanted = observed.sparkSession.createDataFrame(listed, "run string, component string, expected boolean")
    names = sorted({name for _, name, _ in listed})
    pair = lambda n: F.struct(F.lit(n).alias("component"), F.col(n).alias("observed"))
    long = observed.select(F.col("run").cast("string").alias("run"), F.explode(F.array(*map(pair, names))).alias("x"))
    both = wanted.join(long.select("run", "x.*"), ["run", "component"], "left")
    return both.where(~F.col("expected").eqNullSafe(F.col("observed")))


def first_where(rows: DataFrame, predicate: Column, order: str, n: int) -> DataFrame:
    """SO2: the first n rows in order that meet a predicate: each task keeps n, so nothing else is moved."""
    return rows.where(predicate).orderBy(order).limit(n)


def concatenate(splits: dict[str, DataFrame], order: str) -> DataFrame:
    """SE2, SO1: splits under another, with their names in split, ordered by (split, order). Columns that a split lacks
    are null."""
    named = [rows.withColumn("split", F.lit(name)) for name, rows in splits.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named).orderBy("split", order)


# --- runs ----------------------------------------------------------------------------------------------------------


def _given(frame: DataFrame | None, column: str) -> Column:
    there = frame is not None and column in frame.columns
    return (F.col(column) if there else F.lit(None)).cast("double")


def _one(frame: DataFrame | None, spark, columns: dict[str, Column]) -> DataFrame:
    """The columns of a one-row frame; a row of nulls without it."""
    source = frame if frame is not None else spark.range(1)
    return source.select(*[c.alias(n) for n, c in columns.items()])


def export_metrics(run: str, metrics: DataFrame, calibration: DataFrame | None = None, interpretation: DataFrame | None = None,
                   benchmark: DataFrame | None = None, base: DataFrame | None = None, external: DataFrame | None = None) -> DataFrame:
    """AG31: one row of a run's metrics under the names of the export, from one-row frames. What a frame lacks is null.
    bleu4 is the corpus figure or else the mean of sentences; the interval is that of the diagnosis or else of ROUGE-L;
    the alignment tax is in percentage points against base."""
    spark, m = metrics.sparkSession, lambda c: _given(metrics, c)
    has_diagnosis = m("diagnosis_ci95_low").isNotNull() | m("diagnosis_ci95_high").isNotNull()
    end = lambda e: F.when(has_diagnosis, m(f"diagnosis_ci95_{e}")).otherwise(m(f"rougeL_ci95_{e}"))
    c, i, b, x = (lambda n, f=f: _given(f, n) for f in (calibration, interpretation, benchmark, external))
    parts = [
        _one(metrics, spark, {
            "rougeL_f1": m("mean_rougeL_f1"), "bertscore_f1": m("bertscore_f1"), "bleu4": F.coalesce(m("corpus_bleu4"), m("mean_sentence_bleu4")),
            "meteor": m("mean_meteor_exact"), "cider": m("cider_lite"), "exact_diagnosis_accuracy": m("accuracy"),
            "bootstrap_95ci_low": end("low"), "bootstrap_95ci_high": end("high"),
        }),
        _one(calibration, spark, {"ece": c("ece"), "entropy_proxy": c("mean_entropy_proxy")}),
        _one(interpretation, spark, {n: i(n) for n in ("gradient_visual_share", "attention_visual_mass")}),
        _one(benchmark, spark, {"mmbench_strict_circular_accuracy": b("strict_circular_accuracy"), "mmbench_vanilla_circ0_accuracy": b("vanilla_circ0_accuracy")}),
        _one(base, spark, {"__base": _given(base, "strict_circular_accuracy")}),
        _one(external, spark, {"biobert_similarity": x("biobert_similarity")}),
    ]
    # One row on either side.
    row = reduce(lambda a, b: a.join(b), parts)
    tax = 100 * (F.col("mmbench_strict_circular_accuracy") - F.col("__base"))
    return row.withColumn("alignment_tax_pp_vs_base", tax).drop("__base").select(F.lit(run).alias("run"), "*")


def accept_run(metrics: DataFrame, calibration: DataFrame, bins: DataFrame, interpretation: DataFrame,
               benchmark: DataFrame | None = None, rows: int | None = None, groups: int | None = None) -> DataFrame:
    """DQ11: one row of checks and accepted, which is all of them. metrics: a row of export_metrics; calibration,
    interpretation: one row with n_errors and n_cases; bins: count of each confidence bin; benchmark, where it is
    required: one row with n_errors, parse_rate, n_rows, n_circular_groups, of which rows and groups are the wanted
    numbers. A value that is null fails its check; no bins sum to 0."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    given = reduce(Column.__and__, [F.col(n).isNotNull() & ~F.isnan(F.col(n).cast("double")) for n in REQUIRED_METRICS])
    low, high = F.col("bootstrap_95ci_low"), F.col("bootstrap_95ci_high")
    strict = F.col("mmbench_strict_circular_accuracy").isNotNull() if benchmark is not None else F.lit(True)
    clean = lambda n: [yes(F.col("n_errors") == 0).alias(f"{n}_no_errors"), yes(F.col("n_cases") > 0).alias(f"{n}_has_cases")]
    parts = [
        metrics.select(given.alias("metrics_given"), yes((low >= 0) & (low <= high) & (high <= 1)).alias("interval_ordered"), strict.alias("strict_given")),
        calibration.select(*clean("calibration"), F.col("n_cases").alias("__n")),
        bins.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("__binned")),
        interpretation.select(*clean("interpretation")),
    ]
    if benchmark is not None:
        right = lambda c, n: yes(F.col(c) == F.lit(n)) if n is not None else F.lit(True)
        parts.append(benchmark.select(
            yes(F.col("n_errors") == 0).alias("benchmark_no_errors"), yes(F.col("parse_rate") == 1).alias("all_parsed"),
            right("n_rows", rows).alias("row_count"), right("n_circular_groups", groups).alias("group_count"),
        ))
    # One row on either side.
    row = reduce(lambda a, b: a.join(b), parts).withColumn("bins_sum", yes(F.col("__binned") == F.col("__n"))).drop("__binned", "__n")
    return row.withColumn("accepted", reduce(Column.__and__, [F.col(c) for c in row.columns]))


# --- attention shares ------------------------------------------------------------------------------------------------


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _masked(rows: DataFrame) -> DataFrame:
    """Adds, by key: seen (attention on visual keys), grad (size of the gradient up to the query's own place) and mixed
    (that times attention)."""
    size = F.transform("gradient", lambda g, i: F.when(i <= F.col("position"), F.abs(g.cast("double"))).otherwise(0.0))
    out = rows.withColumn("attention", F.transform("attention", lambda a: a.cast("double"))).withColumn("grad", size)
    out = out.withColumn("seen", F.zip_with("attention", "visual", lambda a, v: F.when(v, a).otherwise(0.0)))
    return out.withColumn("mixed", F.zip_with("grad", "attention", lambda g, a: g * a))


def visual_shares(rows: DataFrame, key: str) -> DataFrame:
    """MB4: rows (key, position, attention, gradient, visual), one for each head and query of a case: the query's place
    from 0, its weights and their gradients over all keys, and which keys are of images. Per case the means of
    attention_visual_mass, gradient_visual_share and grad_attention_visual_share. Shares see no key after the query; a
    share of nothing is 0."""
    only = lambda c: F.zip_with(c, "visual", lambda x, v: F.when(v, x).otherwise(0.0))
    share = lambda c: _total(only(c)) / F.greatest(_total(F.col(c)), F.lit(1e-12))
    names = {"attention_visual_mass": _total(F.col("seen")), "gradient_visual_share": share("grad"), "grad_attention_visual_share": share("mixed")}
    return _masked(rows).groupBy(key).agg(*[F.avg(c).alias(n) for n, c in names.items()])


def image_shares(rows: DataFrame, key: str, counts: str) -> DataFrame:
    """MB4: (key, image, attention, grad_attention) of each image of a case, in order from 0. counts: the numbers of keys
    of its images, the same in each row of a case; visual keys belong to images in that order. grad_attention sums to 1
    over a case unless all of it is 0."""
    of = lambda c: F.transform(F.filter(F.arrays_zip(F.col(c).alias("x"), F.col("visual").alias("v")), lambda z: z["v"]), lambda z: z["x"])
    start = F.aggregate(F.slice(F.col(counts), F.lit(1), F.col("image")), F.lit(0), lambda s, n: s + n.cast("int"))
    each = _masked(rows).select(key, counts, of("seen").alias("a"), of("mixed").alias("g"))
    each = each.select("*", F.posexplode(counts).alias("image", "n")).withColumn("start", start)
    piece = lambda c: _total(F.slice(F.col(c), F.col("start") + 1, F.col("n").cast("int")))
    means = each.groupBy(key, "image").agg(F.avg(piece("a")).alias("attention"), F.avg(piece("g")).alias("g"))
    whole = means.groupBy(F.col(key).alias("__key")).agg(F.sum("g").alias("__sum"))
    joined = means.join(whole, F.col(key).eqNullSafe(F.col("__key")))
    return joined.select(key, "image", "attention", F.when(F.col("__sum") > 0, F.col("g") / F.col("__sum")).otherwise(F.col("g")).alias("grad_attention"))
