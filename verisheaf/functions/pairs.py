"""Metrics of a reference and a prediction, as Column expressions over columns of one row."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from verisheaf.functions import kernels as K
from verisheaf.functions.kernels import compared
from verisheaf.functions.text import let, lower_squeezed


def prf(overlap: Column, predicted: Column, reference: Column) -> Column:
    """MT2: precision, recall and F1 from counts; what is empty on both sides is right."""
    p = F.when(predicted > 0, overlap / predicted).when(reference == 0, 1.0).otherwise(0.0)
    r = F.when(reference > 0, overlap / reference).when(predicted == 0, 1.0).otherwise(0.0)
    both = F.struct(p.cast("double").alias("p"), r.cast("double").alias("r"))
    return let(both, lambda x: F.struct(x["p"].alias("precision"), x["r"].alias("recall"), F.when(x["p"] + x["r"] > 0, 2 * x["p"] * x["r"] / (x["p"] + x["r"])).otherwise(0.0).alias("f1")))


def set_prf(reference: Column, predicted: Column) -> Column:
    """MT3."""
    a, b = F.array_distinct(reference), F.array_distinct(predicted)
    return prf(F.size(F.array_intersect(a, b)), F.size(b), F.size(a))


#: MT5 over arrays, in Arrow batches.
lcs_length = K.lcs_of_arrays


def lcs_length_native(a: Column, b: Column) -> Column:
    """MT5 by nested folds, quadratic in interpreted steps: for short arrays."""
    zero = F.transform(b, lambda _: F.lit(0))

    def next_row(row: Column, x: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("cells"), F.lit(0).alias("left"))
        places = F.sequence(F.lit(0), F.size(b) - 1)

        def cell(acc: Column, j: Column) -> Column:
            above = F.get(row, j)
            diagonal = F.coalesce(F.get(row, j - 1), F.lit(0))
            best = F.when(F.get(b, j) == x, diagonal + 1).otherwise(F.greatest(above, acc["left"]))
            return let(best, lambda v: F.struct(F.concat(acc["cells"], F.array(v)).alias("cells"), v.alias("left")))

        return F.aggregate(places, start, cell)["cells"]

    full = F.coalesce(F.element_at(F.aggregate(a, zero, next_row), -1), F.lit(0)).cast("long")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0).cast("long")).otherwise(full)


def rouge_l(reference: Column, predicted: Column) -> Column:
    """MT6."""
    return prf(lcs_length(reference, predicted), F.size(predicted), F.size(reference))


def rouge_l_capped(reference: Column, predicted: Column, limit: int = 512) -> Column:
    """MT7: F1 over the first characters of the squeezed texts."""
    chars = lambda t: F.filter(F.split(F.substring(lower_squeezed(t), 1, limit), ""), lambda c: c != "")
    return rouge_l(chars(reference), chars(predicted))["f1"]


def rouge_l_of_texts(reference: Column, predicted: Column) -> Column:
    """MT6 over the tokens of two texts, and the F1 of MT7: struct of m and capped_f1. Tokens don't leave the worker."""
    score = lambda x, of: prf(x[f"{of}_lcs"], x[f"{of}_prediction"], x[f"{of}_reference"])
    return let(K.lcs_of(reference, predicted), lambda x: F.struct(score(x, "token").alias("m"), score(x, "char")["f1"].alias("capped_f1")))


def bag_overlap(a: Column, b: Column) -> Column:
    """Clipped overlap of two arrays as bags. Each distinct element is counted on both sides."""
    count = lambda of, x: F.size(F.filter(of, lambda y: y == x))
    return F.aggregate(F.transform(F.array_intersect(a, b), lambda x: F.least(count(a, x), count(b, x))), F.lit(0), lambda s, x: s + x)


def char_prf(reference: Column, predicted: Column) -> Column:
    """MT8."""
    chars = lambda t: F.filter(F.split(lower_squeezed(t), ""), lambda c: c != "")
    return let(F.struct(chars(reference).alias("r"), chars(predicted).alias("p")), lambda x: prf(bag_overlap(x["r"], x["p"]), F.size(x["p"]), F.size(x["r"])))


def contradictions(reference: Column, predicted: Column) -> Column:
    """MT15 over results of extract.entities: statuses that differ, shared entities, and all entities of either side."""
    shared = F.filter(F.transform(reference, lambda r: F.struct(r["status"].alias("status"), F.get(F.filter(predicted, lambda p: p["entity"] == r["entity"]), F.lit(0))["status"].alias("other"))), lambda x: x["other"].isNotNull())
    names = lambda of: F.transform(of, lambda e: e["entity"])
    return let(
        shared,
        lambda s: F.struct(
            F.size(F.filter(s, lambda x: x["status"] != x["other"])).cast("long").alias("contradictions"),
            F.size(s).cast("long").alias("shared"),
            F.size(F.array_union(names(reference), names(predicted))).cast("long").alias("compared"),
        ),
    )


def severity_agreement(reference: Column, predicted: Column) -> Column:
    """MT16: entities that state a severity on both sides, and how many agree."""
    met = F.transform(reference, lambda r: F.struct(r["severity"].alias("a"), F.get(F.filter(predicted, lambda p: p["entity"] == r["entity"]), F.lit(0))["severity"].alias("b")))
    both = F.filter(met, lambda x: x["a"].isNotNull() & x["b"].isNotNull())
    return let(both, lambda b: F.struct(F.size(F.filter(b, lambda x: x["a"] == x["b"])).cast("long").alias("agreed"), F.size(b).cast("long").alias("compared")))


@F.pandas_udf(K.NUMBERS)
def compare_numbers(reference: pd.Series, predicted: pd.Series) -> pd.DataFrame:
    """MT17 (and JN15) over claims: each number of the reference takes the nearest free one of the same entity and unit, in
    order. From texts, extract.compare_numbers does it without handing claims around."""
    given = lambda of: of if of is not None else []
    return pd.DataFrame([compared(given(a), given(b)) for a, b in zip(reference, predicted, strict=True)])


def label_coverage(reference: Column, predicted: Column) -> Column:
    """MT18: null if the reference has none."""
    return F.when(F.size(reference) > 0, F.size(F.array_intersect(reference, predicted)) / F.size(reference))


def quality_score(fact_recall: Column, key_recall: Column, hallucination: Column, discordance: Column) -> Column:
    """MT19."""
    return (fact_recall + key_recall + (1 - hallucination) + (1 - discordance)) / 4


def length_ratio(reference: Column, predicted: Column) -> Column:
    """MT21 over compact texts."""
    return F.length(predicted) / F.greatest(F.lit(1), F.length(reference))


def exact_match(reference: Column, predicted: Column) -> Column:
    """MT20 and MT22 over normalised values."""
    return reference.eqNullSafe(predicted)


def cosine(a: Column, b: Column) -> Column:
    """MT24: 0 where a vector has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return let(size, lambda n: F.when(n > 0, dot(a, b) / n).otherwise(0.0))


def greedy_match(reference: Column, predicted: Column) -> Column:
    """MT25: BERTScore from token embeddings of unit length (arrays of vectors)."""
    best = lambda of, others: F.transform(of, lambda x: F.array_max(F.transform(others, lambda y: cosine(x, y))))
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(v), F.lit(0))
    both = F.struct(mean(best(predicted, reference)).alias("p"), mean(best(reference, predicted)).alias("r"))
    return let(both, lambda x: F.struct(x["p"].alias("precision"), x["r"].alias("recall"), F.when(x["p"] + x["r"] > 0, 2 * x["p"] * x["r"] / (x["p"] + x["r"])).otherwise(0.0).alias("f1")))


def entropy_bits(confidence: Column) -> Column:
    """MT26."""
    p = F.least(F.greatest(confidence, F.lit(1e-6)), F.lit(1 - 1e-6))
    return let(p, lambda x: -(x * F.log2(x) + (1 - x) * F.log2(1 - x)))
