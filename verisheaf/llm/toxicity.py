"""Operator 8: toxic passages by maximum-scoring segments.

Tokens score their log odds of standing in toxic rather than clean text, with an informative Dirichlet prior, less a
drift, so that clean text falls; the k-th time a word occurs in a document it scores a k-th of that. A linear scan finds
every maximal-scoring segment of a document. The scores of segments of clean text follow an extreme-value law (Karlin
and Altschul), which turns each score into the number of such segments that clean text of that length would show. The
least likely of "so many segments at least so high" is the document's evidence, calibrated on labelled documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verisheaf.llm.common import keep_on_disk, mix64, read_table, stage_table, text_buffer, text_of, word_hashes
from verisheaf.llm.near_dedup import slices

#: Bounds of the labelled sample: rows of either label, those of smallest MD5 of the id.
MOST_TOXIC, MOST_CLEAN = 5_000, 15_000
#: Most tokens in the model, those furthest from chance.
MOST_TOKENS = 50_000
#: A token counts if its log odds are so many standard deviations from 0.
LEAST_Z = 3.0
#: The Dirichlet prior counts as so many documents; every token loses DRIFT.
PRIOR, DRIFT = 5.0, 0.5
#: Segments of which clean text of that length would show fewer than this are significant, and so are, in a document
#: whose evidence is that strong, those of which it would show fewer than one.
SIGNIFICANT = 0.01
#: Words unknown as such are known by their first letters, the longest first.
STEMS = (6, 5, 4)

_ONLY_SPACE = np.zeros(256, dtype=bool)
_ONLY_SPACE[0x20] = True


def _tag(hashes: np.ndarray, stem: int) -> np.ndarray:
    return mix64(hashes + np.uint64(stem))


def token_hashes(raw: np.ndarray, offsets: np.ndarray):
    """For every word the hashes of the word and of its stems (0 where the word is no longer than the stem), and the
    number of words before each row. raw: UTF-8 with words separated by spaces."""
    space = _ONLY_SPACE[raw]
    words, counts = word_hashes(raw, offsets, space)
    out = [_tag(words, 0)]
    # A copy of the text in which each word ends after its stem, hashed the same way.
    lead = (raw & 0xC0) != 0x80
    inside = ~space
    order = np.cumsum(lead & inside)
    first = inside.copy()
    first[1:] &= space[:-1]
    starts = offsets[:-1][offsets[:-1] < len(raw)]
    first[starts] = inside[starts]
    at = np.flatnonzero(first)
    base = np.zeros(len(raw), dtype=np.int64)
    if len(at):
        base = np.repeat(order[at] - 1, np.diff(np.append(at, len(raw))))
        base = np.concatenate([np.zeros(at[0], dtype=np.int64), base])
    place = order - base  # the number of this letter in its word, from 1
    letters = np.maximum.reduceat(np.where(inside, place, 0), at) if len(at) else np.zeros(0, dtype=np.int64)
    for stem in STEMS:
        cut = space | (place > stem)
        stems, _ = word_hashes(raw, offsets, cut)
        out.append(np.where(letters > stem, _tag(stems, stem), np.uint64(0)))
    return out, counts


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (from, to, score), by the linear algorithm of Ruzzo and Tompa."""
    found: list[list] = []  # from, to, sum before, sum up to the end
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = [i, i + 1, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(a, b, high - low) for a, b, low, high in found]


@dataclass
class Model:
    """hashes, ascending, with their scores; rate and size of the extreme-value law; intercept and slope of the
    calibration. Without both labels there is no model and every score is 0."""

    hashes: np.ndarray
    odds: np.ndarray
    rate: float = 1.0
    size: float = 1.0
    intercept: float = 0.0
    slope: float = 1.0
    fitted: bool = True

    def scores(self, raw, offsets):
        tokens, counts = token_hashes(raw, offsets)
        out = np.zeros(len(tokens[0]))
        open_ = np.ones(len(out), dtype=bool)
        for hashes in tokens:
            if not len(self.hashes) or not open_.any():
                break
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = open_ & (self.hashes[at] == hashes)
            out[hit] = self.odds[at[hit]]
            open_ &= ~hit
        up = np.flatnonzero(out > DRIFT)
        if len(up):  # the k-th time a word occurs in a row it says a k-th
            row = np.searchsorted(counts, up, side="right")
            order = np.lexsort((up, tokens[0][up], row))
            same = np.zeros(len(up), dtype=bool)
            same[1:] = (row[order][1:] == row[order][:-1]) & (tokens[0][up][order][1:] == tokens[0][up][order][:-1])
            start = np.maximum.accumulate(np.where(same, 0, np.arange(len(up))))
            out[up[order]] /= np.arange(len(up)) - start + 1
        return out - DRIFT, counts

    def passages(self, scores: np.ndarray) -> list[tuple[int, int, float]]:
        """(first word, end, score) of the maximal segments. Only words above zero and the sums between them matter."""
        up = np.flatnonzero(scores > 0)
        if not len(up):
            return []
        sums = np.concatenate([[0.0], np.cumsum(scores)])
        row: list[float] = []
        for k, i in enumerate(up):
            if k:
                row.append(float(sums[i] - sums[up[k - 1] + 1]))
            row.append(float(scores[i]))
        return [(int(up[(a + 1) // 2]), int(up[(b - 1) // 2]) + 1, s) for a, b, s in segments(row)]

    def evidence(self, n: int, found) -> float:
        """Minus the log of the chance that clean text of n words shows as many segments as high, for the number of
        segments for which that is least: the number of segments above a height is a Poisson count."""
        best = 0.0
        for r, s in enumerate(sorted((s for _, _, s in found), reverse=True), 1):
            log_mean = math.log(self.size * max(n, 1)) - self.rate * s
            if log_mean >= math.log(r):
                continue
            best = max(best, math.lgamma(r + 1) - r * log_mean + math.exp(log_mean))
        return best

    def probability(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, self.intercept + self.slope * evidence))))


def letters(text_col: str):
    """Lower-case runs of letters, separated by single spaces."""
    return F.trim(F.regexp_replace(F.lower(text_of(text_col)), r"[^\p{L}]+", " "))


def _each_row(batches, column: int, model: Model):
    for batch in batches:
        text = batch.column(column)
        for at, to in slices(text):
            scores, counts = model.scores(*text_buffer(text.slice(at, to - at)))
            for i in range(at, to):
                mine = scores[counts[i - at] : counts[i - at + 1]]
                yield batch, i, mine


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton steps, with a weak pull to 0."""
    a = np.stack([np.ones_like(x), x], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + 1e-2 * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def _rate(values: np.ndarray, counts: np.ndarray) -> float:
    """The rate at which the expected exponential of a clean token's score is 1. Each kind of score above zero is
    counted once more than seen, so that a rate exists."""
    counts = counts + (values > 0)
    p = counts / counts.sum()
    low, high = 1e-6, 20.0
    for _ in range(100):
        mid = (low + high) / 2
        if (p * np.exp(np.minimum(mid * values, 500))).sum() > 1:
            high = mid
        else:
            low = mid
    return low


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic") -> Model:
    """Fit on a bounded sample of labelled documents, at most MOST_TOXIC and MOST_CLEAN, which is small enough to be
    broadcast. Labels other than 0 and 1 count for nothing; of several for an id the highest does."""
    one = labels.where(F.col(label_col).isin(0, 1) & F.col(label_id_col).isNotNull())
    one = one.groupBy(F.col(label_id_col).cast("long").alias("at_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    order = F.md5(F.col("at_id").cast("string"))
    picked = one.where("toxic = 1").orderBy(order, "at_id").limit(MOST_TOXIC).union(one.where("toxic = 0").orderBy(order, "at_id").limit(MOST_CLEAN))
    sample = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).join(F.broadcast(picked), F.col("doc_id") == F.col("at_id"))
    sample = stage_table(sample.select("doc_id", "toxic", letters(text_col).alias("norm")), "toxic-sample")
    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    nothing = Model(np.zeros(0, dtype=np.uint64), np.zeros(0), fitted=False)
    if not n_toxic or not n_clean:
        return nothing
    forms = [F.col("word"), *(F.when(F.length("word") > k, F.concat(F.lit(f"{k} "), F.substring("word", 1, k))) for k in STEMS)]
    # A word counts once for each pair of neighbours that it stands between, so copies of a document don't add up.
    lists = sample.select("toxic", F.split("norm", " ").alias("words"))
    placed = F.transform("words", lambda w, i: F.struct(w.alias("word"), F.xxhash64(F.get("words", i - 1), F.get("words", i + 1)).alias("between")))
    each = lists.select("toxic", F.explode(placed).alias("p")).select("toxic", "p.word", "p.between").where("word <> ''").distinct()
    each = keep_on_disk(each.select("toxic", "word"))
    sums = {r.toxic: r["count"] for r in each.groupBy("toxic").count().collect()}
    w_toxic, w_clean = sums.get(1, 0), sums.get(0, 0)
    if not w_toxic or not w_clean:
        return nothing
    a = PRIOR * (w_toxic + w_clean) / (n_toxic + n_clean)  # in words
    each = each.select("toxic", F.explode(F.array_compact(F.array(*forms))).alias("token"))
    seen = each.groupBy("token").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    seen = seen.withColumn("prior", F.lit(a) * (F.col("t") + F.col("c")) / F.lit(w_toxic + w_clean))
    odds = F.log((F.col("t") + F.col("prior")) / (w_toxic + a - F.col("t") - F.col("prior"))) - F.log((F.col("c") + F.col("prior")) / (w_clean + a - F.col("c") - F.col("prior")))
    spread = F.sqrt(1 / (F.col("t") + F.col("prior")) + 1 / (F.col("c") + F.col("prior")))
    seen = seen.where((F.col("t") + F.col("prior") < w_toxic + a) & (F.col("c") + F.col("prior") < w_clean + a))
    kept = seen.select("token", odds.alias("odds"), (odds / spread).alias("z")).where(F.abs("z") >= LEAST_Z)
    kept = kept.orderBy(F.desc(F.abs("z")), "token").limit(MOST_TOKENS).collect()
    hashes = np.zeros(len(kept), dtype=np.uint64)
    for stem in (0, *STEMS):
        mine = [i for i, r in enumerate(kept) if (int(r.token.split(" ")[0]) if " " in r.token else 0) == stem]
        if mine:
            raw, offsets = text_buffer(pa.array([kept[i].token.split(" ")[-1] for i in mine]))
            hashes[mine] = _tag(word_hashes(raw, offsets, _ONLY_SPACE[raw])[0], stem)
    by = np.argsort(hashes)
    model = Model(hashes[by], np.array([r.odds for r in kept])[by])

    def described(batches):
        for batch, i, mine in _each_row(batches, 1, model):
            found = model.passages(mine)
            values, counts = np.unique(np.round(mine, 2), return_counts=True)
            yield pa.RecordBatch.from_pydict({
                "toxic": pa.array([batch.column(0)[i].as_py()], pa.int32()), "n": pa.array([len(mine)], pa.int64()),
                "tops": pa.array([[s for _, _, s in found]], pa.list_(pa.float64())),
                "values": pa.array([values], pa.list_(pa.float64())), "counts": pa.array([counts], pa.list_(pa.int64())),
            })

    rows = sample.select("toxic", "norm").mapInArrow(described, "toxic int, n long, tops array<double>, values array<double>, counts array<long>").collect()
    clean: dict[float, int] = {}
    for r in rows:
        if not r.toxic:
            for v, c in zip(r["values"], r["counts"], strict=True):
                clean[v] = clean.get(v, 0) + c
    if not clean:
        return nothing
    model.rate = _rate(np.array(list(clean)), np.array(list(clean.values()), dtype=float))
    # The size of the law is such that clean documents show as many segments above a middling height as it says.
    n = sum(r.n for r in rows if not r.toxic)
    tops = sorted((s for r in rows if not r.toxic for s in r.tops), reverse=True)
    height = tops[len(tops) // 10] if tops else 1.0
    model.size = max(1e-4, min(1.0, (len(tops) // 10 + 1) / max(n, 1) * math.exp(min(model.rate * height, 50))))
    x = np.array([model.evidence(r.n, [(0, 0, s) for s in r.tops]) for r in rows])
    model.intercept, model.slope = _logistic(np.minimum(x, 50.0), np.array([r.toxic for r in rows], dtype=float))
    return model


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (0 to 1), predicted (1 from 0.5), evidence, and passages, the significant
    segments as (first word, end word, score, expected), words counted in runs of letters.

    Null and empty texts and texts without letters have no token and get the score of no evidence. Without a fitted
    model every score is 0. Ids pass through, null or repeated. Empty input gives no rows. Extra columns are ignored.
    Texts are scanned whole, whatever their length.
    """
    schema = "doc_id long, score double, predicted int, evidence double, passages array<struct<start:long,end:long,score:double,expected:double>>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))

    def scored(batches):
        for batch in batches:
            scores, evidences, passages = [], [], []
            for _, _, mine in _each_row([batch], 1, model):
                found = model.passages(mine)
                e = model.evidence(len(mine), found)
                evidences.append(e)
                scores.append(model.probability(min(e, 50.0)) if model.fitted else 0.0)
                least = model.size * max(len(mine), 1)
                expected = [least * math.exp(-min(model.rate * s, 500)) for _, _, s in found]
                passages.append([{"start": a, "end": b, "score": s, "expected": x} for (a, b, s), x in zip(found, expected, strict=True) if x < SIGNIFICANT or e > -math.log(SIGNIFICANT) and x < 1] if model.fitted else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(evidences, pa.float64()), pa.array(passages, kind)], ["doc_id", "score", "predicted", "evidence", "passages"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), letters(text_col).alias("norm")).mapInArrow(scored, schema)


def held_out(id_col: str = "doc_id"):
    """Whether the CRC-32 of the id as text is a multiple of five. Null ids are not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def op8_toxicity(spark, sf_dir):
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out()))
    out = score_toxicity(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))
