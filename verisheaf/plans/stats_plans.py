"""Queries of statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from verisheaf.functions import pairs as P
from verisheaf.operators import stats as A
from verisheaf.plans.tables import table


def _round(df, *keep):
    return df.select(*[c if c in keep or t not in ("double", "float") else F.round(c, 9).alias(c) for c, t in df.dtypes])


def _runs(spark, sf):
    """doc_id, source, confidence and two verdicts for labelled documents."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    return docs.join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id", "source", "lang", F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"), (F.col("n_chars") / (F.col("n_chars") + F.lit(1000.0))).alias("confidence")
    )


_RUNS = "runs AS (SELECT doc_id, source, lang, quality AS a, 1 - toxic AS b, n_chars / (n_chars + 1000.0::DOUBLE) AS confidence FROM documents JOIN labels USING (doc_id))"


def summaries(spark, sf):
    return _round(table(spark, sf, "events").groupBy("event_type").agg(*A.summary("value")), "event_type")


SUMMARIES = "SELECT event_type, round(sum(value), 9) AS sum, round(max(value), 9) AS max, count(value) AS n, round(median(value), 9) AS median, round(quantile_cont(value, 0.95), 9) AS p95, round(stddev_pop(value), 9) AS sd_pop, round(CASE WHEN count(value) = 1 THEN 0.0 ELSE stddev_samp(value) END, 9) AS sd_samp FROM events GROUP BY event_type"


def counts(spark, sf):
    return A.value_counts(table(spark, sf, "events"), "event_type", "event_id", 30)


COUNTS = "SELECT event_type, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY event_type ORDER BY n DESC, first_seen LIMIT 30"


def ratios(spark, sf):
    return _round(table(spark, sf, "lineitem").groupBy("l_returnflag").agg(A.ratio(F.col("l_discount"), F.col("l_tax")).alias("ratio"), A.mean(F.when(F.col("l_linenumber") == 1, float("nan")).otherwise(F.col("l_quantity"))).alias("mean")), "l_returnflag")


RATIOS = "SELECT l_returnflag, round(sum(l_discount) / nullif(sum(l_tax), 0), 9) AS ratio, round(avg(l_quantity) FILTER (l_linenumber <> 1), 9) AS mean FROM lineitem GROUP BY 1"


def _labels(spark, sf):
    return table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("t"), F.concat("l_returnflag", F.when(F.col("l_linenumber") > 4, "F").otherwise(F.col("l_linestatus"))).alias("p"))


_LABELS = "c AS (SELECT l_returnflag || l_linestatus AS truth, l_returnflag || CASE WHEN l_linenumber > 4 THEN 'F' ELSE l_linestatus END AS predicted, count(*) AS n FROM lineitem GROUP BY ALL)"


def confusion(spark, sf):
    return A.confusion(_labels(spark, sf), "t", "p")


def per_label(spark, sf):
    return _round(A.per_label(A.confusion(_labels(spark, sf), "t", "p")), "label")


_PER = "l AS (SELECT label, CAST(sum(t) AS BIGINT) AS support, CAST(sum(p) AS BIGINT) AS predicted, CAST(sum(h) AS BIGINT) AS hits FROM (SELECT truth AS label, n AS t, 0 AS p, CASE WHEN truth = predicted THEN n ELSE 0 END AS h FROM c UNION ALL SELECT predicted, 0, n, 0 FROM c) GROUP BY label), s AS (SELECT *, coalesce(hits / nullif(predicted, 0)::DOUBLE, 0) AS precision, coalesce(hits / nullif(support, 0)::DOUBLE, 0) AS recall, coalesce(2 * hits / nullif(predicted + support, 0)::DOUBLE, 0) AS f1 FROM l)"
PER_LABEL = f"WITH {_LABELS}, {_PER} SELECT label, support, predicted, hits, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM s"


def classification(spark, sf):
    return _round(A.classification(A.confusion(_labels(spark, sf), "t", "p")))


CLASSIFICATION = f"""WITH {_LABELS}, {_PER}, a AS (SELECT sum(support)::DOUBLE AS n, sum(hits)::DOUBLE AS h, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf, avg(recall) FILTER (support > 0) AS ba, sum(support::DOUBLE * predicted) AS tp, sum(support::DOUBLE * support) AS tt, sum(predicted::DOUBLE * predicted) AS pp FROM s)
SELECT round(h / n, 9) AS accuracy, round(ba, 9) AS balanced_accuracy, round(mp, 9) AS macro_precision, round(mr, 9) AS macro_recall, round(mf, 9) AS macro_f1, round(h / n, 9) AS micro_precision, round(h / n, 9) AS micro_recall, round(h / n, 9) AS micro_f1,
 round((h * n - tp) / sqrt((n * n - tt) * (n * n - pp)), 9) AS mcc, round((h / n - tp / (n * n)) / (1 - tp / (n * n)), 9) AS cohen_kappa FROM a"""


def mcnemar(spark, sf):
    return _round(A.mcnemar(_runs(spark, sf), ["source"], "a", "b"), "source")


_MC = "m AS (SELECT source, count(*) FILTER (a = 0 AND b = 1) AS n01, count(*) FILTER (a = 1 AND b = 0) AS n10, count(*) FILTER (a = 0 AND b = 0) AS n00, count(*) FILTER (a = 1 AND b = 1) AS n11 FROM runs GROUP BY source)"
MCNEMAR = f"WITH {_RUNS}, {_MC} SELECT *, round(coalesce(pow(abs(n01 - n10) - 1, 2) / nullif(n01 + n10, 0)::DOUBLE, 0.0), 9) AS statistic FROM m"


def holm(spark, sf):
    """The tests' p values stand in as a share here, so that SQL can state the rows."""
    tests = _runs(spark, sf).groupBy("source").agg((F.sum("a") / F.count(F.lit(1)) / 20).alias("p"))
    return _round(A.holm(tests, "p", "source"), "source")


HOLM = f"""WITH {_RUNS}, t AS (SELECT source, sum(a) / count(*)::DOUBLE / 20 AS p FROM runs GROUP BY source), r AS (SELECT *, row_number() OVER (ORDER BY p, source) AS rank, count(*) OVER () AS m FROM t), w AS (SELECT source, p, rank, least(1.0::DOUBLE, (m - rank + 1) * p) AS raw FROM r), x AS (SELECT *, max(raw) OVER (ORDER BY rank) AS adjusted FROM w)
SELECT source, round(p, 9) AS p, CAST(rank AS INTEGER) AS rank, round(raw, 9) AS raw, round(adjusted, 9) AS adjusted, raw < 0.05 AS significant, adjusted < 0.05 AS significant_monotone FROM x"""


def significance(spark, sf):
    return _round(A.holm(A.with_p(A.mcnemar(_runs(spark, sf), ["source"], "a", "b")), "p", "source"), "source")


def reliability(spark, sf):
    return _round(A.reliability(_runs(spark, sf), "confidence", "a"), "bin")


_BINS = "e AS (SELECT *, least(len(list_filter(list_transform(range(0, 11), lambda k: k / 10.0::DOUBLE), lambda x: x <= confidence)) - 1, 9) AS bin FROM runs WHERE confidence BETWEEN 0 AND 1), b AS (SELECT bin, count(*) AS n, avg(confidence) AS confidence, avg(a::DOUBLE) AS accuracy FROM e GROUP BY bin)"
RELIABILITY = f"WITH {_RUNS}, {_BINS} SELECT CAST(bin AS INTEGER) AS bin, n, round(confidence, 9) AS confidence, round(accuracy, 9) AS accuracy, round(abs(confidence - accuracy), 9) AS gap FROM b"


def ece(spark, sf):
    return _round(A.expected_calibration_error(_runs(spark, sf), "confidence", "a"))


ECE = f"WITH {_RUNS}, {_BINS} SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(confidence - accuracy)) / sum(n), 9) AS ece FROM b"



def bootstrap(spark, sf):
    low = table(spark, sf, "supplier").agg(F.min("s_suppkey")).first()[0]
    values = table(spark, sf, "supplier").select((F.col("s_suppkey") - low).alias("k"), (F.col("s_acctbal") / 100).alias("v"))
    return _round(A.bootstrap_means(values, "v", "k", 200, 20260810))


BOOTSTRAP = """WITH v AS (SELECT s_suppkey - (SELECT min(s_suppkey) FROM supplier) AS k, s_acctbal / 100 AS v FROM supplier), n AS (SELECT count(*) AS n FROM v),
d AS (SELECT sample, CAST(('0x' || substr(md5('20260810|' || sample || '|' || k), 1, 8)) AS BIGINT) % n AS k FROM v, n, (SELECT unnest(range(200)) AS sample)),
m AS (SELECT sample, sum(v) / any_value(n) AS m FROM d JOIN v USING (k), n GROUP BY sample), o AS (SELECT list_sort(list(m)) AS l FROM m)
SELECT (SELECT count(*) FROM v) AS n, round((SELECT avg(v) FROM v), 9) AS mean, round(l[5], 9) AS ci95_low, round(l[196], 9) AS ci95_high, l[5] > 0 OR l[196] < 0 AS ci_excludes_zero FROM o"""


def paired(spark, sf):
    low = table(spark, sf, "supplier").agg(F.min("s_suppkey")).first()[0]
    values = table(spark, sf, "supplier").select((F.col("s_suppkey") - low).alias("k"), (F.col("s_acctbal") / 100 - 40).alias("v"))
    return _round(A.bootstrap_means(values, "v", "k", 200, 20260811, paired=True))


PAIRED = BOOTSTRAP.replace("20260810", "20260811").replace("s_acctbal / 100 AS v", "s_acctbal / 100 - 40 AS v").replace("l[196]", "l[195]")


def bootstrap_median(spark, sf):
    low = table(spark, sf, "supplier").agg(F.min("s_suppkey")).first()[0]
    return A.bootstrap_statistic(table(spark, sf, "supplier").select((F.col("s_suppkey") - low).alias("k"), "s_acctbal"), "k", 50, 7, lambda g: g["s_acctbal"].median())


BOOTSTRAP_MEDIAN = """WITH v AS (SELECT s_suppkey - (SELECT min(s_suppkey) FROM supplier) AS k, s_acctbal AS v FROM supplier), n AS (SELECT count(*) AS n FROM v),
d AS (SELECT sample, CAST(('0x' || substr(md5('7|' || sample || '|' || k), 1, 8)) AS BIGINT) % n AS k FROM v, n, (SELECT unnest(range(50)) AS sample)),
m AS (SELECT sample, median(v) AS m FROM d JOIN v USING (k) GROUP BY sample), o AS (SELECT list_sort(list(m)) AS l FROM m)
SELECT (SELECT median(v) FROM v) AS value, l[1] AS ci95_low, l[49] AS ci95_high, (SELECT count(*) FROM v) AS n FROM o"""


def folds(spark, sf):
    return A.k_fold(_runs(spark, sf), "doc_id", ["a", "b", "confidence"], 5, 1)


FOLDS = f"""WITH {_RUNS}, r AS (SELECT *, (row_number() OVER (ORDER BY md5('1|' || doc_id)) - 1) % 5 AS fold FROM runs), m AS (SELECT fold, avg(a::DOUBLE) AS a, avg(b::DOUBLE) AS b, avg(confidence) AS confidence FROM r GROUP BY fold)
SELECT metric, round(avg(v), 6) AS fold_mean, round(stddev_pop(v), 6) AS fold_sd, count(*) AS folds FROM (UNPIVOT m ON a, b, confidence INTO NAME metric VALUE v) GROUP BY metric"""


def circular(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("i"), (F.col("l_returnflag") == "N").alias("hit"), F.when(F.col("l_linenumber") != 7, "A").alias("choice"), F.when(F.col("l_quantity") == 50, "failed").alias("error"))
    return _round(A.circular_benchmark(rows, "i", "hit", "choice", "error", 3000))


CIRCULAR = """WITH r AS (SELECT l_orderkey AS i, l_returnflag = 'N' AS hit, l_quantity <> 50 AS valid, l_quantity <> 50 AND l_linenumber <> 7 AS parsed FROM lineitem),
g AS (SELECT i % 3000 AS g, bool_and(hit) FILTER (parsed) AS s, bool_and(parsed AND hit) AS x FROM r GROUP BY 1)
SELECT (SELECT count(*) FROM r) AS n_rows, count(*) FILTER (valid) AS n_valid, count(*) FILTER (parsed) AS n_parsed, count(*) FILTER (NOT valid) AS n_errors, round(avg(hit::DOUBLE) FILTER (parsed), 9) AS all_accuracy, round(avg(hit::DOUBLE) FILTER (parsed AND i <= 3000), 9) AS circ0_accuracy,
 round((SELECT avg(s::DOUBLE) FROM g), 9) AS strict_circular, round((SELECT avg(x::DOUBLE) FROM g), 9) AS strict_all_rows, (SELECT count(s) FROM g) AS n_groups, round(count(*) FILTER (parsed) / count(*) FILTER (valid)::DOUBLE, 9) AS parse_rate FROM r"""


def categories(spark, sf):
    return _round(A.by_category(_runs(spark, sf), "lang", "a"), "lang")


def deltas(spark, sf):
    m = lambda c: table(spark, sf, "labels").agg(F.avg(c).alias("rate"), F.sum(c).cast("double").alias("errors"))
    return _round(A.run_deltas(m("quality"), m("toxic"), {"rate": True, "errors": False}), "metric")


DELTAS = "WITH m AS (SELECT avg(quality) AS a, avg(toxic) AS b, sum(quality)::DOUBLE AS c, sum(toxic)::DOUBLE AS d FROM labels) SELECT 'rate' AS metric, round(a, 9) AS base, round(b, 9) AS other, round(b - a, 9) AS delta, true AS higher_is_better, b - a > 0 AS improved FROM m UNION ALL SELECT 'errors', c, d, d - c, false, d - c < 0 FROM m"


def attribution(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_discount", "l_tax", F.when(F.col("l_linenumber") == 1, "x").alias("error"))
    return _round(A.means_and_deviations(rows, ["l_discount", "l_tax"], "error"), "metric")


ATTRIBUTION = "SELECT metric, round(avg(v) FILTER (l_linenumber <> 1), 9) AS mean, round(stddev_samp(v) FILTER (l_linenumber <> 1), 9) AS sd, count(*) FILTER (l_linenumber <> 1) AS n_valid, count(*) FILTER (l_linenumber = 1) AS n_errors FROM (UNPIVOT (SELECT l_linenumber, l_discount, l_tax FROM lineitem) ON l_discount, l_tax INTO NAME metric VALUE v) GROUP BY metric"


def similarity(spark, sf):
    e = table(spark, sf, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").groupBy("label").agg(F.round(F.avg(P.cosine(F.col("embedding"), F.col("other"))), 6).alias("similarity"), F.count(F.lit(1)).alias("n"))


SIMILARITY = "SELECT a.label, round(avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS similarity, count(*) AS n FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 GROUP BY a.label"


def exported(spark, sf):
    one = table(spark, sf, "labels").agg(F.lit(None).cast("double").alias("corpus_bleu4"), F.avg("quality").alias("sentence_bleu4"), F.avg("toxic").alias("strict"))
    return _round(one.select(A.first_given("corpus_bleu4", "sentence_bleu4").alias("bleu4"), A.alignment_tax(F.col("strict"), F.col("sentence_bleu4")).alias("alignment_tax")))


def availability(spark, sf):
    return A.availability(spark, {"calibration"})


AVAILABILITY = """SELECT * FROM (VALUES ('rouge', 'available'), ('bleu', 'available'), ('chrf', 'available'), ('meteor_exact', 'available'), ('cider_lite', 'available'), ('facts', 'available'), ('numbers', 'available'),
('classification', 'available'), ('calibration', 'available'), ('bertscore', 'needs token embeddings'), ('similarity', 'needs embeddings'), ('attribution', 'needs attribution shares')) AS t(metric, status)"""

QUERIES = {
    "ag_summary": (summaries, SUMMARIES),
    "ag_value_counts": (counts, COUNTS),
    "ag_ratio": (ratios, RATIOS),
    "ag_confusion": (confusion, f"WITH {_LABELS} SELECT truth, predicted, n FROM c"),
    "ag_per_label": (per_label, PER_LABEL),
    "ag_classification": (classification, CLASSIFICATION),
    "ag_mcnemar": (mcnemar, MCNEMAR),
    "ag_holm": (holm, HOLM),
    "ag_significance": (significance, None),
    "ag_reliability": (reliability, RELIABILITY),
    "ag_ece": (ece, ECE),
    "ag_bootstrap": (bootstrap, BOOTSTRAP),
    "ag_paired_bootstrap": (paired, PAIRED),
    "ag_bootstrap_statistic": (bootstrap_median, BOOTSTRAP_MEDIAN),
    "ag_k_fold": (folds, FOLDS),
    "ag_circular": (circular, CIRCULAR),
    "ag_by_category": (categories, f"WITH {_RUNS} SELECT lang, count(*) AS n, round(avg(a::DOUBLE), 9) AS accuracy FROM runs GROUP BY lang"),
    "ag_run_deltas": (deltas, DELTAS),
    "ag_attribution": (attribution, ATTRIBUTION),
    "ag_similarity": (similarity, SIMILARITY),
    "ag_export": (exported, "SELECT round(avg(quality), 9) AS bleu4, round(100 * (avg(toxic) - avg(quality)), 9) AS alignment_tax FROM labels"),
    "ag_availability": (availability, AVAILABILITY),
}
