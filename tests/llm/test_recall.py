"""Near duplicates on a whole test table against the similarity of every pair of texts that share a shingle."""

from collections import defaultdict

import numpy as np
import pyarrow as pa

from verisheaf.llm import near_dedup as N

SF = "/root/testdata/sf0.01"


def test_recall_on_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", N._normalised("text").alias("norm")).orderBy("doc_id").collect()
    raw, offsets = N.text_buffer(pa.array([r.norm for r in rows]))
    home, hashes, weights = N._weighted(raw, offsets, 5)
    cut = np.searchsorted(home, np.arange(len(rows) + 1))
    bags = [(hashes[a:b], weights[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
    holders = defaultdict(list)
    for i, h in zip(home.tolist(), hashes.tolist(), strict=True):
        holders[h].append(i)
    pairs = {(a, b) for who in holders.values() for k, b in enumerate(who) for a in who[:k]}
    links = [(a, b) for a, b in pairs if N.similarity(*bags[a], *bags[b]) >= 0.8]
    assert len(links) > 50
    got = {r.doc_id: r.class_id for r in N.near_duplicates(docs).collect()}
    of = [got[r.doc_id] for r in rows]
    found = sum(of[a] == of[b] for a, b in links)
    assert found / len(links) >= 0.99
    # Nothing is in a class without a link to it.
    linked = {i for pair in links for i in pair}
    empty = {i for i, r in enumerate(rows) if not r.norm}
    size = defaultdict(int)
    for c in of:
        size[c] += 1
    assert {i for i, c in enumerate(of) if size[c] > 1} <= linked | empty
    print("links", len(links), "found", found)
