"""The n-gram family. Both sides of a pair are in one row, so grams are counted and clipped there, over Arrow batches,
and nothing is shuffled; only document frequencies need a table of grams.

Input: pair_id, ref_tokens, pred_tokens (arrays; null counts as empty).
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisheaf.functions.pairs import prf


def grams(tokens: Column, n: int) -> Column:
    """MT1: the n-grams of an array in order, joined by an unused character."""
    places = F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(tokens, i + 1, n), "\u0001"))


#: Tokens of both sides that are counted at once, unless one pair has more.
SLICE_TOKENS = 1 << 20
#: Odd numbers that the digest of a gram is multiplied by before the next token's is added.
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], dtype=np.uint64)


def _codes(keys: np.ndarray) -> np.ndarray:
    """Small numbers for keys, equal where keys are."""
    return np.unique(keys, return_inverse=True)[1].reshape(-1)


def clip(tokens: np.ndarray, ref: np.ndarray, pred: np.ndarray, orders: tuple[int, ...]) -> list[np.ndarray]:
    """Of each pair and order the clipped hits, the grams of the prediction and those of the reference, as three arrays
    (pairs x orders). tokens: codes of all references and then all predictions; ref, pred: lengths of either side. A gram
    of n is the gram of n - 1 before it and one more token, so grams are told apart exactly."""
    rows, kinds = len(ref), int(tokens.max(initial=0)) + 1
    lengths = np.concatenate([ref, pred])
    row = np.repeat(np.concatenate([np.arange(rows)] * 2), lengths)
    end = np.repeat(np.cumsum(lengths), lengths)
    at, ids, split = np.arange(len(tokens)), row, int(ref.sum())
    out = [np.zeros((rows, len(orders)), dtype=np.int64) for _ in range(3)]
    for n in range(1, max(orders) + 1):
        fits = at + n <= end[at]
        at, ids = at[fits], ids[fits]
        ids = _codes(ids * kinds + tokens[at + n - 1])
        if n in orders:
            size, of_pred = int(ids.max(initial=-1)) + 1, at >= split
            home = np.zeros(size, dtype=np.int64)
            home[ids] = row[at]
            counts = [np.bincount(ids[side], minlength=size) for side in (of_pred, ~of_pred)]
            for k, count in enumerate((np.minimum(*counts), *counts)):
                out[k][:, orders.index(n)] = np.bincount(home, weights=count, minlength=rows).astype(np.int64)
    return out


def align(tokens: np.ndarray, ref: np.ndarray, pred: np.ndarray) -> list[np.ndarray]:
    """Matches and chunks of each pair: the k-th occurrence of a token in the prediction is aligned with its k-th in the
    reference, and chunks are runs of aligned tokens that follow one another in the reference too. Input as in clip."""
    rows, kinds, split = len(ref), int(tokens.max(initial=0)) + 1, int(ref.sum())
    lengths = np.concatenate([ref, pred])
    home = np.repeat(np.arange(2 * rows), lengths)
    order = np.lexsort((tokens, home))
    same = np.zeros(len(tokens), dtype=bool)
    same[1:] = (home[order][1:] == home[order][:-1]) & (tokens[order][1:] == tokens[order][:-1])
    place = np.arange(len(tokens))
    nth = np.empty(len(tokens), dtype=np.int64)
    nth[order] = place - np.maximum.accumulate(np.where(same, 0, place))
    row = home % max(rows, 1)
    keys = _codes(row * kinds + tokens) * (int(nth.max(initial=0)) + 1) + nth
    _, ours, theirs = np.intersect1d(keys[split:], keys[:split], assume_unique=True, return_indices=True)
    by = np.argsort(ours)
    ours, theirs = ours[by], theirs[by]
    starts = np.ones(len(ours), dtype=bool)
    starts[1:] = (theirs[1:] != theirs[:-1] + 1) | (row[split + ours[1:]] != row[split + ours[:-1]])
    return [np.bincount(row[split + ours], weights=w, minlength=rows).astype(np.int64) for w in (np.ones(len(ours)), starts)]


def _counted(pairs: DataFrame, columns: tuple[str, str], count, fields: str) -> DataFrame:
    """pair_id and the fields that count(tokens, ref, pred) gives, in slices of rows of bounded length."""

    def run(batches):
        for batch in batches:
            sides = [batch.column(k).fill_null([]) if batch.column(k).null_count else batch.column(k) for k in (1, 2)]
            lengths = [np.asarray(side.value_lengths(), dtype=np.int64) for side in sides]
            total, at = np.cumsum(sum(lengths)), 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE_TOKENS, side="right")))
                flat = pa.concat_arrays([side.slice(at, to - at).flatten() for side in sides])
                tokens = np.asarray(flat.dictionary_encode(null_encoding="encode").indices, dtype=np.int64)
                found = count(tokens, *(x[at:to] for x in lengths))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), *map(as_arrow, found)], names)
                at = to

    def as_arrow(x: np.ndarray) -> pa.Array:
        if x.ndim == 1:
            return pa.array(x, pa.int64())
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1), pa.int64()))

    names = ["pair_id", *(field.split()[0] for field in fields.split(", "))]
    kind = pairs.schema["pair_id"].dataType.simpleString()
    return pairs.select("pair_id", *columns).mapInArrow(run, f"pair_id {kind}, {fields}")


def clipped(pairs: DataFrame, orders: tuple[int, ...] = (1, 2, 3, 4), columns: tuple[str, str] = ("ref_tokens", "pred_tokens")) -> DataFrame:
    """pair_id, and arrays hits, predicted, reference with an element for each order."""
    return _counted(pairs, columns, lambda *sides: clip(*sides, orders), "hits array<bigint>, predicted array<bigint>, reference array<bigint>")


def rouge_n(pairs: DataFrame, orders: tuple[int, ...] = (1, 2)) -> DataFrame:
    """MT4: pair_id, n, precision, recall, f1, of pairs without grams too."""
    each = F.arrays_zip(F.array(*map(F.lit, orders)).alias("n"), "hits", "predicted", "reference")
    sums = clipped(pairs, orders).select("pair_id", F.inline(each)).toDF("pair_id", "n", "overlap", "predicted", "reference")
    return sums.select("pair_id", "n", prf(F.col("overlap"), F.col("predicted"), F.col("reference")).alias("m")).select("pair_id", "n", "m.*")


def meteor_exact(pairs: DataFrame) -> DataFrame:
    """MT9: from matches and chunks (WN4) of each pair."""
    lengths = [F.coalesce(F.size(c), F.lit(0)).alias(n) for c, n in (("ref_tokens", "n_ref"), ("pred_tokens", "n_pred"))]
    both = pairs.select(F.struct("pair_id", *lengths).alias("pair_id"), "ref_tokens", "pred_tokens")
    sums = _counted(both, ("ref_tokens", "pred_tokens"), align, "matches bigint, chunks bigint").select("pair_id.*", "matches", "chunks")
    m, c, r, p = F.col("matches"), F.col("chunks"), F.col("n_ref"), F.col("n_pred")
    mean = 10 * (m / p) * (m / r) / ((m / r) + 9 * (m / p))
    score = F.when((r == 0) & (p == 0), 1.0).when(m == 0, 0.0).otherwise(mean * (1 - 0.5 * F.pow(c / m, F.lit(3))))
    return sums.select("pair_id", score.alias("meteor_exact"))


def _bleu4() -> Column:
    """BLEU-4 over columns of clipped."""
    log = lambda n: F.log(F.when(F.col("hits")[n] > 0, F.col("hits")[n]).otherwise(0.1) / F.greatest(F.col("predicted")[n], F.lit(1)))
    mean = F.exp((log(0) + log(1) + log(2) + log(3)) / 4)
    # As many 1-grams as tokens.
    n_ref, n_pred = F.col("reference")[0], F.col("predicted")[0]
    short = F.when(n_pred > n_ref, 1.0).otherwise(F.exp(1 - F.try_divide(n_ref, n_pred)))
    return F.when((n_pred == 0) | (F.col("hits")[0] == 0), 0.0).otherwise(short * mean)


def sentence_bleu(pairs: DataFrame) -> DataFrame:
    """MT10: BLEU-4 with 0.1 in place of a numerator of 0 (and 1 in place of a total of 0); 0 without a shared word."""
    return clipped(pairs).select("pair_id", _bleu4().alias("bleu4"))


def rouge_and_bleu(pairs: DataFrame) -> DataFrame:
    """MT4 of 1 and 2 and MT10 in one row from one count of a pair's grams: pair_id, bleu4, rouge1_precision, ..."""
    scores = {n: prf(F.col("hits")[n - 1], F.col("predicted")[n - 1], F.col("reference")[n - 1]).alias(f"rouge{n}") for n in (1, 2)}
    return clipped(pairs).select("pair_id", _bleu4().alias("bleu4"), *scores.values()).select("pair_id", "bleu4", *[F.col(f"rouge{n}.{m}").alias(f"rouge{n}_{m}") for n in scores for m in ("precision", "recall", "f1")])


def corpus_bleu(pairs: DataFrame) -> DataFrame:
    """MT11: one row, bleu1 to bleu4 of the whole corpus, with the smoothing of sentences."""
    sums = [F.sum(F.col(c)[n - 1]).alias(f"{name}{n}") for n in (1, 2, 3, 4) for c, name in (("hits", "hits"), ("predicted", "total"))]
    wide = clipped(pairs).agg(*sums, F.sum(F.col("reference")[0]).alias("n_ref"), F.sum(F.col("predicted")[0]).alias("n_pred"))
    log = lambda n: F.log(F.when(F.coalesce(f"hits{n}", F.lit(0)) > 0, F.col(f"hits{n}")).otherwise(0.1) / F.greatest(F.coalesce(f"total{n}", F.lit(0)), F.lit(1)))
    short = F.when(F.col("n_pred") > F.col("n_ref"), 1.0).otherwise(F.exp(1 - F.try_divide(F.col("n_ref"), F.col("n_pred"))))
    none = F.coalesce("hits1", F.lit(0)) == 0
    return wide.select(*[F.when(none, 0.0).otherwise(short * F.exp(sum((log(k) for k in range(1, n + 1)), F.lit(0.0)) / n)).alias(f"bleu{n}") for n in (1, 2, 3, 4)])


def chrf(pairs: DataFrame, orders: int = 6, beta: float = 3.0) -> DataFrame:
    """MT12: per pair the mean over orders of the F score of character n-grams, white space left out; an order that
    neither side has doesn't count. Input: pair_id, ref_chars, pred_chars. The corpus score is the mean."""
    at = tuple(range(1, orders + 1))
    sums = clipped(pairs, at, ("ref_chars", "pred_chars"))
    weight = beta * beta

    def score(n: int) -> Column:
        hits, p, r = (F.col(c)[n - 1] for c in ("hits", "predicted", "reference"))
        precision, recall = F.coalesce(F.try_divide(hits, p), F.lit(0.0)), F.coalesce(F.try_divide(hits, r), F.lit(0.0))
        return F.when(p + r > 0, F.coalesce(F.try_divide((1 + weight) * precision * recall, weight * precision + recall), F.lit(0.0)))

    scores = F.array_compact(F.array(*map(score, at)))
    mean = F.aggregate(scores, F.lit(0.0), lambda total, x: total + x) / F.size(scores)
    return sums.select("pair_id", F.when(F.size(scores) > 0, mean).otherwise(0.0).alias("chrf"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread over the whole word."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def gram_digests(pairs: DataFrame, orders: int = 4, columns: tuple[str, str] = ("ref_tokens", "pred_tokens")) -> DataFrame:
    """pair_id, n, a and b (a digest of 128 bits), ref_count, pred_count: a row for each gram of a pair, counted in the
    pair's row, so neither grams nor single occurrences cross the network."""

    def run(batches):
        for batch in batches:
            sides = [batch.column(k).fill_null([]) if batch.column(k).null_count else batch.column(k) for k in (1, 2)]
            lengths = [np.asarray(side.value_lengths(), dtype=np.int64) for side in sides]
            total, at = np.cumsum(sum(lengths)), 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE_TOKENS, side="right")))
                yield from counted(batch.column(0).slice(at, to - at), [side.slice(at, to - at).flatten() for side in sides], [x[at:to] for x in lengths])
                at = to

    def counted(pair_ids, sides, lengths):
        coded = pa.concat_arrays(sides).dictionary_encode(null_encoding="encode")
        tokens, rows = np.asarray(coded.indices, dtype=np.int64), len(pair_ids)
        if not len(tokens):
            return
        words = np.frombuffer(b"".join(md5(b"" if w is None else b"=" + w.encode()).digest() for w in coded.dictionary.to_pylist()), dtype=np.uint64).reshape(-1, 2)[tokens]
        kinds, split, both = int(tokens.max()) + 1, len(sides[0]), np.concatenate(lengths)
        row, end = np.repeat(np.concatenate([np.arange(rows)] * 2), both), np.repeat(np.cumsum(both), both)
        at, ids, hashes = np.arange(len(tokens)), row, np.zeros((len(tokens), 2), dtype=np.uint64)
        for n in range(1, orders + 1):
            fits = at + n <= end[at]
            at, ids, hashes = at[fits], ids[fits], hashes[fits]
            hashes = hashes * MULTIPLIERS + words[at + n - 1]
            _, first, ids = np.unique(ids * kinds + tokens[at + n - 1], return_index=True, return_inverse=True)
            ids, of_ref = ids.reshape(-1), at < split
            counts = [pa.array(np.bincount(ids[side], minlength=len(first)), pa.int32()) for side in (of_ref, ~of_ref)]
            digests = [pa.array(_mixed(hashes[first, k] + np.uint64(n)).view(np.int64)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pair_ids.take(pa.array(row[at[first]])), pa.array(np.full(len(first), n), pa.int32()), *digests, *counts], ["pair_id", "n", "a", "b", "ref_count", "pred_count"])

    kind = pairs.schema["pair_id"].dataType.simpleString()
    return pairs.select("pair_id", *columns).mapInArrow(run, f"pair_id {kind}, n int, a bigint, b bigint, ref_count int, pred_count int")


def cider_lite(pairs: DataFrame) -> DataFrame:
    """MT13: pair_id and ten times the mean over n of the cosine of TF-IDF vectors; document frequencies from the
    references. The corpus score is the mean. Grams go to their frequencies as digests and come back as one row of sums a
    pair and task."""
    table = gram_digests(pairs)
    df = table.where("ref_count > 0").groupBy("a", "b").agg(F.count(F.lit(1)).alias("df"))
    n_docs = pairs.count()
    idf = F.log(F.lit(n_docs + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    seen = table.join(df, ["a", "b"], "left").select("pair_id", "n", (F.col("ref_count") * idf).alias("r"), (F.col("pred_count") * idf).alias("p"))
    r, p = F.col("r"), F.col("p")
    sums = [F.sum(F.when(F.col("n") == n, x)).alias(f"{name}{n}") for n in (1, 2, 3, 4) for x, name in ((r * p, "dot"), (r * r, "rr"), (p * p, "pp"))]
    cosine = lambda n: F.coalesce(F.try_divide(F.col(f"dot{n}"), F.sqrt(f"rr{n}") * F.sqrt(f"pp{n}")), F.lit(0.0))
    by = seen.groupBy("pair_id").agg(*sums).select("pair_id", (sum((cosine(n) for n in (1, 2, 3, 4)), F.lit(0.0)) * 2.5).alias("cider"))
    return pairs.select("pair_id").join(by, "pair_id", "left").fillna(0.0, ["cider"])


def repetition(tokens: Column, n: int = 3) -> Column:
    """MT14."""
    made = grams(tokens, n)
    return F.when(F.size(tokens) < n, 0.0).otherwise(1 - F.size(F.array_distinct(made)) / F.greatest(F.size(made), F.lit(1)))
