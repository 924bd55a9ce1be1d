"""Operator 3: quality classifier with hierarchical empirical Bayes.

A logistic classifier on surface features gives the evidence of each document. Hosts and paths within hosts get
posterior means from grouped sums of that evidence: a host is shrunk toward the global mean, a path toward its host, the
more so the fewer documents it has, with prior strengths estimated from the spread between groups. The evidence is then
weighed with the prior odds of the document's own path, from which the document itself is left out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisheaf.llm.common import WHITE, read_table, stage_table, text_of

#: Bound of the labelled sample: rows of either label, those of smallest MD5 of the id.
MOST_EACH = 10_000
#: Limits of a prior's strength, in documents.
WEAKEST, STRONGEST = 2.0, 1000.0


def features(text: Column) -> list[Column]:
    """Shares of upper-case letters among letters, of letters, digits, marks of emphasis and other signs among the
    characters that aren't white space, the share of distinct words, the mean length of a word, and the log of the
    number of words."""
    n = F.length(F.regexp_replace(text, WHITE, "")).cast("double")
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    upper = F.length(F.regexp_replace(text, r"[^\p{Lu}]+", ""))
    digits = F.length(F.regexp_replace(text, r"[^\p{N}]+", ""))
    marks = F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))
    signs = F.length(F.regexp_replace(text, r"[\p{L}\p{N}\p{Z}\s.,;:!?'\"()-]+", ""))
    words = F.filter(F.split(F.lower(text), WHITE), lambda w: w != "")
    count = F.size(words).cast("double")
    share = lambda part, whole: F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))
    return [
        share(upper, letters.cast("double")),
        share(letters, n),
        share(digits, n),
        share(marks, n),
        share(signs, n),
        share(F.size(F.array_distinct(words)), count),
        share(n, count),
        F.log1p(count),
    ]


@dataclass
class Model:
    """Weights of the features, of their squares, and the intercept last; None where a label is missing, and then every
    document has even odds."""

    weights: list[float] | None
    mean: list[float] = field(default_factory=list)
    spread: list[float] = field(default_factory=list)

    def log_odds(self, row: Column) -> Column:
        if self.weights is None:
            return F.lit(0.0)
        k = len(self.mean)
        total = F.lit(self.weights[-1])
        for i in range(k):
            z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (row[i] - F.lit(self.mean[i])) / F.lit(self.spread[i])))
            total = total + F.lit(self.weights[i]) * z + F.lit(self.weights[k + i]) * z * z
        return F.greatest(F.lit(-12.0), F.least(F.lit(12.0), total))


def _design(x: np.ndarray, mean, spread) -> np.ndarray:
    z = np.clip((x - mean) / spread, -8, 8)
    return np.hstack([z, z * z, np.ones((len(z), 1))])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Fit on a bounded sample of labelled documents, at most MOST_EACH of either label, small enough to be broadcast.
    Of several labels for an id the lowest counts; null ids and labels other than 0 and 1 count for nothing."""
    one = labels.where(F.col(label_col).isin(0, 1) & F.col(label_id_col).isNotNull())
    one = one.groupBy(F.col(label_id_col).cast("long").alias("at_id")).agg(F.min(label_col).cast("int").alias("good"))
    order = F.md5(F.col("at_id").cast("string"))
    picked = one.where("good = 1").orderBy(order, "at_id").limit(MOST_EACH).union(one.where("good = 0").orderBy(order, "at_id").limit(MOST_EACH))
    sample = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("body")).join(F.broadcast(picked), F.col("doc_id") == F.col("at_id"))
    rows = sample.select("good", F.array(*features(F.col("body"))).alias("x"), F.md5("body").alias("by")).collect()
    rows.sort(key=lambda r: (r.by, r.good))  # sums of floats then don't depend on the order of arrival
    y = np.array([r.good for r in rows], dtype=float)
    if len(set(y.tolist())) < 2:
        return Model(None)
    x = np.array([r.x for r in rows])
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    a = _design(x, mean, spread)
    w = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        pull = np.full(len(w), 1.0)
        pull[-1] = 1e-6
        grad = a.T @ (p - y) + pull * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag(pull)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return Model([float(v) for v in w], mean.tolist(), spread.tolist())


def _strength(groups: DataFrame, mean: Column) -> float:
    """Strength of a Beta prior by the method of moments: the spread between group means beyond what chance gives.
    groups: n, s (sum of probabilities). Only sums come to the driver."""
    m = F.col("s") / F.col("n")
    sums = groups.where("n >= 2").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(m - mean, F.lit(2))).alias("between"), F.sum(F.col("n") * mean * (1 - mean)).alias("chance")
    ).first()
    if not sums.k or sums.k < 2 or not sums.n:
        return STRONGEST
    each = (sums.chance or 0.0) / sums.n  # variance of one document about its group's mean
    extra = ((sums.between or 0.0) - sums.k * each) / sums.n
    if extra <= 0 or each <= 0:
        return STRONGEST
    return float(min(STRONGEST, max(WEAKEST, each / extra - 1)))


def _odds(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def _evidence(docs: DataFrame, model: Model, text_col: str, host_col: str, path_col: str, keep: list[str]) -> DataFrame:
    """row (a struct of the columns to keep), host, path and odds. Null hosts and paths are groups of their own."""
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~"))
    out = docs.select(F.struct(*keep).alias("row"), named(host_col).alias("host"), named(path_col).alias("path"), F.array(*features(text_of(text_col))).alias("x"))
    return out.select("row", "host", "path", model.log_odds(F.col("x")).alias("odds"))


def site_posteriors(evidence: DataFrame) -> tuple[DataFrame, float, float, float]:
    """(host, path, path_n, path_s, host_mean) for each path, the global mean, and the strengths of the priors of
    hosts and paths. evidence: host, path, odds."""
    p = 1 / (1 + F.exp(-F.col("odds")))
    # Sums of fixed-point numbers don't depend on the order of the rows.
    paths = evidence.groupBy("host", "path").agg(F.count(F.lit(1)).alias("path_n"), F.sum(F.round(p * 1e9).cast("long")).alias("fixed"))
    paths = stage_table(paths.select("host", "path", "path_n", (F.col("fixed") / F.lit(1e9)).alias("path_s")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("path_n").alias("n"), F.sum(F.round(F.col("path_s") * 1e9).cast("long")).alias("fixed"))
    hosts = hosts.select("host", "n", (F.col("fixed") / F.lit(1e9)).alias("s"))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum(F.round(F.col("s") * 1e9).cast("long")).alias("fixed")).first()
    mean = whole.fixed / 1e9 / whole.n if whole.n else 0.5
    k_host = round(_strength(hosts, F.lit(mean)), 6)
    hosts = hosts.select("host", ((F.col("s") + F.lit(k_host * mean)) / (F.col("n") + F.lit(k_host))).alias("host_mean"))
    joined = paths.join(hosts, "host")
    k_path = round(_strength(joined.select(F.col("path_n").alias("n"), F.col("path_s").alias("s"), "host_mean"), F.col("host_mean")), 6)
    return stage_table(joined, "quality-sites"), mean, k_host, k_path


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", host_col: str = "source", path_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """row (a struct of the columns to keep, all unless given), doc_score (the classifier's probability that the document
    is good), host_mean and path_mean (posterior means of its host and path) and score; a document is rejected below 0.5.

    The site table has a row per path and is joined as its size at run time allows; documents of one host are never
    gathered unless it outgrows a broadcast, and then skewed hosts are split.

    Null text counts as empty, which has zeros for features; null hosts and paths are groups of their own. Repeated
    rows count as often as they occur. Empty input gives no rows. Other columns pass through.
    """
    evidence = _evidence(docs, model, text_col, host_col, path_col, keep or docs.columns)
    sites, mean, _, k_path = site_posteriors(evidence.select("host", "path", "odds"))
    sites = sites.select(F.col("host").alias("site_host"), F.col("path").alias("site_path"), "path_n", "path_s", "host_mean")
    p = 1 / (1 + F.exp(-F.col("odds")))
    out = evidence.join(sites, (F.col("host") == F.col("site_host")) & (F.col("path") == F.col("site_path")))
    prior = (F.col("path_s") - p + F.lit(k_path) * F.col("host_mean")) / (F.col("path_n") - 1 + F.lit(k_path))
    shift = _odds(prior) - _odds(F.lit(mean))
    return out.select("row", p.alias("doc_score"), "host_mean", prior.alias("path_mean"), (1 / (1 + F.exp(-(F.col("odds") + shift)))).alias("score"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """docs without those that the classifier, trained on labels, rejects; all columns as they were."""
    model = train(docs, labels, id_col, text_col)
    return score_quality(docs, model, text_col, host_col, path_col).where("score >= 0.5").select("row.*")


def op3_quality(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    out = score_quality(docs, train(docs, read_table(spark, sf_dir, "labels")), keep=["doc_id"])
    rounded = [F.round(c, 9).alias(c) for c in ("doc_score", "host_mean", "path_mean", "score")]
    return out.select("row.doc_id", *rounded, (F.col("score") >= 0.5).alias("kept"))
