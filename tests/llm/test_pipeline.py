"""Each stage of the pipeline against a plain version on its own input; queries against their SQL."""

import glob
import math
import os
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from test_exact_and_mix import brute_mix
from test_near_and_leaks import brute_leaks

from verisheaf.llm import registry
from verisheaf.llm.tokens import WordEncoder, default_tokenizer

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    steps = dict(corpus_pipeline.STAGES)
    good = steps["quality classifier"](spark, docs, SF).localCheckpoint()
    left = {r.doc_id for r in good.collect()}
    assert good.columns == docs.columns
    assert all((d in left) == bool(r.quality) for d, r in labels.items())

    from test_near_and_leaks import brute_classes

    rows = good.collect()
    first = steps["near duplicates"](spark, good, SF).localCheckpoint()
    assert Counter(r.doc_id for r in first.collect()) == Counter(min(rows[i].doc_id for i in c) for c in brute_classes(rows))

    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    clean = steps["benchmark decontamination"](spark, first, SF).localCheckpoint()
    leaked = {k[0] for k in brute_leaks(first.collect(), items)}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in first.collect()} - leaked

    mixed = steps["source mixture"](spark, clean, SF).localCheckpoint()
    _, _, target, _ = brute_mix(clean.collect())
    words, largest = Counter(), Counter()
    for r in mixed.collect():
        words[r.source] += len(r.text.split())
    for r in clean.collect():
        largest[r.source] = max(largest[r.source], len(r.text.split()))
    assert mixed.columns == docs.columns and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 2
    assert all(abs(words[s] - target[s]) <= largest[s] for s in target)

    out = sorted(steps["token files"](spark, mixed, SF).collect(), key=lambda r: r.start)
    t = WordEncoder(default_tokenizer()).tokenizer
    want = sorted((r.doc_id, len(t.encode(r.text, add_special_tokens=False).ids) + 1) for r in mixed.collect())
    assert [(r.doc_id, r.n_tokens) for r in out] == want and [r.start for r in out] == [0, *np.cumsum([n for _, n in want])[:-1].tolist()]


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 8) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries(spark, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in cursor.fetchall())
