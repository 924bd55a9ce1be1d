"""Scoring of prediction logs: a wide row per case, a document of metrics, and view-level scores.

The n-gram metrics come from tables keyed by case and are joined once; all else is computed in the row. Rows that failed
or hold no prediction count as empty predictions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verisheaf.functions import extract as X
from verisheaf.functions import pairs as P
from verisheaf.functions import text as T
from verisheaf.operators import joins as J
from verisheaf.operators import ngrams as N
from verisheaf.operators import stats as A


def per_case(predictions: DataFrame, key: str = "case_index", strip_positions: bool = False) -> DataFrame:
    """A row per case with lexical, diagnostic, factual, numeric and structural metrics."""
    r, p = F.col("reference"), F.coalesce("prediction", F.lit(""))
    base = predictions.select(F.col(key).alias("pair_id"), r.alias("reference"), p.alias("prediction"))
    base = base.withColumn("ref_tokens", T.tokens(F.col("reference"), strip_positions)).withColumn("pred_tokens", T.tokens(F.col("prediction"), strip_positions))
    base = base.withColumn("ref_chars", T.char_tokens(F.col("reference"))).withColumn("pred_chars", T.char_tokens(F.col("prediction")))
    base = base.withColumn("re", X.entities(F.col("reference"))).withColumn("pe", X.entities(F.col("prediction")))
    base = base.withColumn("numbers", X.compare_numbers(F.col("reference"), F.col("prediction"))).persist()
    r, p = F.col("reference"), F.col("prediction")
    row = base.select(
        "pair_id",
        P.rouge_l(F.col("ref_tokens"), F.col("pred_tokens")).alias("rougeL"), P.rouge_l(F.col("ref_chars"), F.col("pred_chars")).alias("char_rougeL"), N.repetition(F.col("pred_tokens")).alias("repetition"),
        P.exact_match(T.canonical_diagnosis(r), T.canonical_diagnosis(p)).cast("double").alias("diagnosis_exact"), P.set_prf(T.diagnosis_terms(r), T.diagnosis_terms(p)).alias("terms"),
        P.set_prf(T.diagnosis_concepts(r), T.diagnosis_concepts(p)).alias("concepts"), P.set_prf(X.facts(F.col("re"), r), X.facts(F.col("pe"), p)).alias("facts"),
        P.set_prf(X.key_facts(F.col("re"), r), X.key_facts(F.col("pe"), p)).alias("key_facts"), P.set_prf(X.entity_names(F.col("re")), X.entity_names(F.col("pe"))).alias("entities"),
        P.set_prf(X.relations(F.col("re")), X.relations(F.col("pe"))).alias("relations"), P.contradictions(F.col("re"), F.col("pe")).alias("contradiction"), P.severity_agreement(F.col("re"), F.col("pe")).alias("severity"),
        F.col("numbers"), T.stage(r).alias("ref_stage"), T.stage(p).alias("pred_stage"), P.label_coverage(T.image_labels(r), T.image_labels(p)).alias("label_coverage"),
        T.has_diagnosis_section(p).cast("double").alias("has_diagnosis"), P.length_ratio(T.compact(r), T.compact(p)).alias("length_ratio"), (T.canonical_diagnosis(r) == "__MISSING__").alias("no_reference_diagnosis"),
        T.canonical_diagnosis(r).isin("未找到").alias("placeholder_diagnosis"),
    )
    wide = row.select("*", *[F.col(f"{c}.{m}").alias(f"{c}_{m}") for c in ("rougeL", "char_rougeL", "terms", "concepts", "facts", "key_facts", "entities", "relations") for m in ("precision", "recall", "f1")])
    wide = wide.withColumn("discordance", F.coalesce(F.try_divide("contradiction.contradictions", "contradiction.compared"), F.lit(0.0))).withColumn("hallucination", 1 - F.col("facts_precision"))
    wide = wide.withColumn("quality", P.quality_score(F.col("facts_recall"), F.col("key_facts_recall"), F.col("hallucination"), F.col("discordance")))
    for table in (N.rouge_and_bleu(base), N.meteor_exact(base), N.chrf(base), N.cider_lite(base)):
        wide = wide.join(table, "pair_id")
    return wide.drop("rougeL", "char_rougeL", "terms", "concepts", "facts", "key_facts", "entities", "relations").withColumnRenamed("pair_id", key)


def stage_accuracy(cases: DataFrame) -> DataFrame:
    """AG19: comparable cases, and the shares of exact stages and of stages at most one apart."""
    both = F.col("ref_stage").isNotNull() & F.col("pred_stage").isNotNull()
    gap = F.when(both, F.abs(F.col("ref_stage") - F.col("pred_stage")))
    return cases.agg(F.count_if(both).alias("comparable"), F.avg((gap == 0).cast("double")).alias("exact"), F.avg((gap <= 1).cast("double")).alias("within_one"))


def placeholder_accuracy(cases: DataFrame, exact: str = "diagnosis_exact", placeholder: str = "placeholder_diagnosis") -> DataFrame:
    """AG18: accuracy on cases whose reference diagnosis says nothing, and on the others."""
    return cases.agg(F.count_if(placeholder).alias("n_placeholder"), F.avg(F.when(F.col(placeholder), F.col(exact))).alias("placeholder_accuracy"), F.avg(F.when(~F.col(placeholder), F.col(exact))).alias("other_accuracy"))


#: Sections of the metrics document and the per-case columns whose means they hold.
SECTIONS = {
    "lexical": ("rouge1_f1", "rouge2_f1", "rougeL_f1", "char_rougeL_f1", "meteor_exact", "bleu4", "chrf", "cider", "repetition"),
    "diagnostic": ("diagnosis_exact", "terms_f1", "concepts_f1"),
    "clinical_reference_proxies": ("facts_precision", "facts_recall", "facts_f1", "key_facts_recall", "entities_f1", "relations_f1", "hallucination", "discordance", "quality"),
    "structure": ("label_coverage", "has_diagnosis", "length_ratio"),
}


def metrics_document(cases: DataFrame, predictions: DataFrame | None = None) -> DataFrame:
    """(section, metric, value): means over cases, ratios of sums for numbers, and throughput where the log has it."""
    entries = [(s, c, A.mean(F.col(c))) for s, columns in SECTIONS.items() for c in columns]
    n = lambda c: F.col(f"numbers.{c}")
    entries += [
        ("numeric_and_stage", "number_recall", A.ratio(n("matched_count"), n("reference_count"))), ("numeric_and_stage", "number_exact", A.ratio(n("exact_count"), n("matched_count"))),
        ("numeric_and_stage", "number_within5", A.ratio(n("within5_count"), n("matched_count"))), ("numeric_and_stage", "number_within10", A.ratio(n("within10_count"), n("matched_count"))),
        ("numeric_and_stage", "number_unsupported", A.ratio(n("unsupported_count"), n("prediction_count"))), ("numeric_and_stage", "number_omitted", A.ratio(n("omitted_count"), n("reference_count"))),
        ("clinical_reference_proxies", "severity_agreement", A.ratio(F.col("severity.agreed"), F.col("severity.compared"))),
    ]
    out = _long(cases, entries)
    stages = stage_accuracy(cases)
    out = out.unionByName(_long(stages, [("numeric_and_stage", f"stage_{c}", F.max(c)) for c in ("exact", "within_one")]))
    if predictions is not None:
        v = lambda c: F.col(c).cast("double")
        rate = F.try_divide(F.sum(v("output_tokens")), F.sum(v("latency_sec")))
        entries = [("efficiency", "mean_latency_sec", F.avg(v("latency_sec"))), ("efficiency", "median_latency_sec", F.median(v("latency_sec"))), ("efficiency", "p95_latency_sec", F.percentile(v("latency_sec"), F.lit(0.95))), ("efficiency", "output_tokens_per_sec", rate), ("efficiency", "hit_max_rate", F.avg(v("hit_max_new_tokens"))), ("efficiency", "peak_gpu_memory_bytes", F.max(v("peak_gpu_memory_bytes"))), ("efficiency", "errors", F.count("error").cast("double"))]
        out = out.unionByName(_long(predictions, entries))
    return out


def _long(df: DataFrame, entries) -> DataFrame:
    one = df.agg(*[e.cast("double").alias(f"v{i}") for i, (_, _, e) in enumerate(entries)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(m).alias("metric"), F.col(f"v{i}").alias("value")) for i, (s, m, _) in enumerate(entries)])).alias("x")).select("x.*")


def per_view(audit: DataFrame, predictions: DataFrame, compat: bool = False) -> DataFrame:
    """View-level scores of predictions (case_index is the view's index; reference, prediction) joined with the audit
    (one_to_one_index, clean_case_index, image): facts, discordance, text taken from other views of the case, and schema
    flags. compat divides contradictions by themselves, as an old tool does, which makes discordance 0 or 1."""
    both = J.complete_join(audit.withColumn("case_index", F.col("one_to_one_index")), predictions.select("case_index", "reference", F.coalesce("prediction", F.lit("")).alias("prediction")), ["case_index"])
    r, p = F.col("reference"), F.col("prediction")
    both = both.withColumn("re", X.entities(r)).withColumn("pe", X.entities(p)).withColumn("rf", X.facts(F.col("re"), r)).withColumn("pf", X.facts(F.col("pe"), p))
    both = J.others_in_case(both, "clean_case_index", "one_to_one_index", "rf", "others").withColumn("c", P.contradictions(F.col("re"), F.col("pe")))
    compared = F.col("c.contradictions") if compat else F.col("c.compared")
    return both.select(
        "one_to_one_index", "clean_case_index", P.set_prf(F.col("rf"), F.col("pf")).alias("facts"), F.coalesce(F.try_divide(F.col("c.contradictions"), compared), F.lit(0.0)).alias("discordance"),
        F.coalesce(F.try_divide(F.size(F.array_intersect(F.array_except("pf", "rf"), "others")), F.size("pf")), F.lit(0.0)).alias("other_view_share"), T.schema_flags(p).alias("flags"),
    ).select("one_to_one_index", "clean_case_index", "facts.*", "discordance", "other_view_share", "flags.*")


def confidence_from_logits(rows: DataFrame, logits: str = "logits") -> DataFrame:
    """Mean and least probability of the chosen token, from an array of score vectors, one per token."""
    top = lambda v: 1 / F.aggregate(F.transform(v, lambda x: F.exp(x.cast("double") - F.array_max(v))), F.lit(0.0), lambda s, x: s + x)
    each = rows.withColumn("__p", F.transform(logits, top))
    mean = F.aggregate("__p", F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size("__p"), F.lit(0))
    return each.withColumn("mean_token_confidence", mean).withColumn("min_token_confidence", F.array_min("__p")).withColumn("target_tokens", F.size("__p").cast("long")).drop("__p")


def register_functions(spark) -> None:
    """The helpers that aren't built in, for use in SQL."""
    spark.udf.register("lcs_length", P.lcs_length)
    spark.udf.register("compare_numbers", P.compare_numbers)
    spark.udf.register("chi2_p", A.chi2_p)
