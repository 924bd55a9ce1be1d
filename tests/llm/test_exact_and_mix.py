"""Exact deduplication and mixing against brute force, and their awkward cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from cases import awkward, empty

from verisheaf.llm.exact_dedup import exact_dedup
from verisheaf.llm.mixing import mix_sources, repeat_mixed

WHITE = re.compile(r"[\x20\x09-\x0D]+")


def check_exact(rows, got):
    groups = defaultdict(list)
    for r in rows:
        groups[WHITE.sub(" ", r.text or "")].append(r.doc_id)
    want = Counter()
    for text, ids in groups.items():
        named = [i for i in ids if i is not None]
        keep = min(named) if named else None
        left = 1
        for i in sorted(ids, key=lambda x: (x is None, x)):
            kept = i == keep and left > 0
            left -= kept
            want[i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want


def test_exact_awkward(spark):
    df = awkward(spark)
    check_exact(df.collect(), exact_dedup(df).collect())
    assert exact_dedup(empty(spark)).count() == 0


@pytest.mark.parametrize("salts", [1, 7])
def test_exact_hot_group(spark, salts):
    df = spark.createDataFrame([(i, "same text" if i % 3 else f"text {i % 50}") for i in range(600)], "doc_id long, text string")
    check_exact(df.collect(), exact_dedup(df, salts=salts).collect())


def brute_mix(rows, cycle=(5.0, 2.0, 1.0), share=1.5, epochs=2):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    docs = [(r.doc_id, r.source, size(r.text)) for r in rows]
    names = sorted({s for _, s, _ in docs}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    total = {s: sum(n for _, x, n in docs if x == s) for s in names}
    most = {s: epochs * total[s] for s in names}
    budget = min(share * sum(total.values()), float(sum(most.values())))
    open_, left, target = set(names), budget, {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if most[s] < level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = float(most[s])
            left -= most[s]
        open_ -= full
    return docs, total, target, budget


def check_mix(rows, mix):
    docs, total, target, budget = brute_mix(rows)
    got = mix.decisions.collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, n) for d, _, n in docs)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        name = None if r.source_key == "~" else r.source_key[1:]
        assert r.source_size == total[name] and r.target == pytest.approx(target[name]) and r.taken == r.size * r.copies and r.copies in (0, 1, 2)
        taken[name] += r.taken
        largest[name] = max(largest[name], r.size)
    assert sum(taken.values()) <= budget + 1e-9
    for name in total:
        assert abs(taken[name] - target[name]) <= largest[name] + 1e-6


def test_mix_awkward(spark):
    df = awkward(spark)
    check_mix(df.collect(), mix_sources(df))
    assert mix_sources(empty(spark)).decisions.count() == 0
    nothing = df.where("doc_id in (4, 5, 6)")
    assert [r.taken for r in mix_sources(nothing).decisions.collect()] == [0, 0, 0]


def test_mix_near_targets(spark):
    rows = [(i, "w " * (1 + zlib.crc32(str(i).encode()) % 40), "big" if i % 3 else f"s{i % 7}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mix_sources(df)
    check_mix(df.collect(), mix)
    again = sorted(tuple(r) for r in mix_sources(df.repartition(5)).decisions.collect())
    assert again == sorted(tuple(r) for r in mix.decisions.collect())


def test_mix_repeats_rows(spark):
    df = awkward(spark)
    out = repeat_mixed(df)
    assert out.columns == df.columns
    words = Counter()
    for r in mix_sources(df).decisions.collect():
        words[r.doc_id] += r.taken
    got = Counter()
    for r in out.collect():
        got[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in got.items() if v}


def test_mix_rejects_weights(spark):
    with pytest.raises(ValueError):
        mix_sources(awkward(spark), cycle=(1.0, 0.0))
