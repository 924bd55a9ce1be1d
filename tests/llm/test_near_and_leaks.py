"""Near duplicates and benchmark passages against brute force, and their awkward cases."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import awkward, empty, words

from verisheaf.llm import near_dedup as N
from verisheaf.llm.decontamination import contaminated, drop_contaminated

WORD = re.compile(r"[^\W_]+")


def bag(text):
    w = WORD.findall((text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def probability_jaccard(a, b):
    if not a or not b:
        return float(not a and not b)
    every = set(a) | set(b)
    return sum(1 / sum(max(a.get(y, 0) / a[x], b.get(y, 0) / b[x]) for y in every) for x in a if x in b)


def brute_classes(rows):
    bags = [bag(r.text) for r in rows]
    home = list(range(len(rows)))

    def find(i):
        while home[i] != i:
            i = home[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] == bags[j] or (set(bags[i]) & set(bags[j]) and probability_jaccard(bags[i], bags[j]) >= 0.8):
                a, b = find(i), find(j)
                home[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return list(groups.values())


def check_near(rows, got):
    want = Counter()
    for members in brute_classes(rows):
        named = [rows[i].doc_id for i in members if rows[i].doc_id is not None]
        for i in members:
            want[rows[i].doc_id, min(named) if named else None, len(members)] += 1
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == want
    assert sum(r.kept for r in got) == len(brute_classes(rows))
    assert all(r.doc_id == r.class_id for r in got if r.kept)


def edited(text, share, seed):
    rng = np.random.default_rng(seed)
    out = text.split()
    for i in rng.choice(len(out), max(1, int(share * len(out))), replace=False):
        out[i] = f"edit{seed}x{i}"
    return " ".join(out)


def test_similarity_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(30):
        a = {int(k): float(rng.integers(1, 5)) for k in rng.choice(40, 20, replace=False)}
        b = {int(k): float(rng.integers(1, 5)) for k in rng.choice(40, 25, replace=False)}
        arrays = lambda d: (np.array(sorted(d), dtype=np.uint64), np.array([d[k] for k in sorted(d)]))
        assert N.similarity(*arrays(a), *arrays(b)) == pytest.approx(probability_jaccard(a, b))


def test_signatures_estimate_similarity():
    text = words(300, 9)
    raw, offsets = N.text_buffer(pa.array([text, edited(text, 0.03, 1), edited(text, 0.1, 2)]))
    rows, hashes, weights = N._weighted(raw, offsets, 5)
    s = N.prob_minhash(rows, hashes, weights, 3, 2000)
    for k in (1, 2):
        exact = probability_jaccard(bag(text), bag([None, edited(text, 0.03, 1), edited(text, 0.1, 2)][k]))
        assert (s[0] == s[k]).mean() == pytest.approx(exact, abs=0.05)


def test_awkward(spark):
    df = awkward(spark)
    check_near(df.collect(), N.near_duplicates(df).collect())
    assert N.near_duplicates(empty(spark)).count() == 0
    kept = N.drop_near_duplicates(df)
    assert kept.columns == df.columns and kept.count() == len(brute_classes(df.collect()))
    assert N.drop_near_duplicates(empty(spark)).count() == 0


def test_families(spark):
    """A family whose members are near their original and not one another, chains, and texts that share a passage."""
    base, passage = words(200, 11), words(60, 12)
    rows = [(1000, base)] + [(i, edited(base, 0.015 + 0.01 * (i % 3), i)) for i in range(40)]
    chain = words(150, 13)
    for i in range(6):
        rows.append((2000 + i, chain))
        chain = edited(chain, 0.012, 500 + i)
    rows += [(3000 + i, words(40, 100 + i) + " " + passage) for i in range(30)]
    rows += [(4000 + i, "x y z " * 80 + words(5, i % 2)) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_near(df.collect(), N.near_duplicates(df).collect())


def test_large_buckets_are_cut_finer(spark, monkeypatch):
    monkeypatch.setattr(N, "SMALL", 4)
    base = words(120, 21)
    rows = [(i, edited(base, 0.03, i)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_near(df.collect(), N.near_duplicates(df).collect())


def brute_leaks(docs, items):
    out = Counter()
    for d in {(r.doc_id, tuple(WORD.findall((r.text or "").lower()))) for r in docs}:
        have = {d[1][i : i + 5] for i in range(len(d[1]) - 4)}
        for item in items:
            w = tuple(WORD.findall((item.text or "").lower()))
            need = {w[i : i + 5] for i in range(len(w) - 4)}
            if need and len(need & have) >= 0.8 * len(need) - 1e-9:
                out[d[0], item.item_id, len(need & have), len(need)] += 1
    return out


def test_leaks(spark):
    items = spark.createDataFrame([(1, words(20, 31)), (2, words(50, 32).upper()), (3, "too short"), (4, None), (5, ""), (6, words(5, 33)), (6, words(9, 34))], "item_id long, text string")
    rows = [(100, words(3000, 41) + " " + words(20, 31) + " " + words(3000, 42)), (101, edited(words(50, 32), 0.02, 3)), (102, edited(words(50, 32), 0.2, 4)), (103, words(5, 33)), (104, words(400, 43)), (105, words(9, 34).replace(" ", ", "))]
    docs = awkward(spark).select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = contaminated(docs, items)
    assert Counter((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got.collect()) == brute_leaks(docs.collect(), items.collect())
    left = {r.doc_id for r in drop_contaminated(docs, items).collect()}
    assert {100, 101, 103, 105}.isdisjoint(left) and {102, 104, 4, 5} <= left


def test_no_leaks(spark):
    docs = awkward(spark)
    items = spark.createDataFrame([(1, words(20, 31))], "item_id long, text string")
    assert contaminated(empty(spark), items).count() == 0 and contaminated(docs, items.where("false")).count() == 0
    assert drop_contaminated(docs, items.where("false")).count() == docs.count()
