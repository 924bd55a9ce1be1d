"""Quality, toxicity, main text and licences: held-out accuracy, exact parts against brute force, awkward cases."""

import itertools
import os

import pytest
from cases import awkward, empty, words
from pyspark.sql import functions as F

from verisheaf.llm import html_text as H
from verisheaf.llm import licenses as L
from verisheaf.llm import quality as Q
from verisheaf.llm import toxicity as X

SF, COMMON = "/root/testdata/sf0.01", "/usr/share/common-licenses"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_segments_are_the_maximal_ones():
    """Ruzzo and Tompa's segments are found by taking the best segment and going on to its left and right."""

    def slow(s, at=0):
        best = max(((sum(s[i:j]), -(j - i), i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=None)
        if not best or best[0] <= 0:
            return []
        _, _, i, j = best
        return [*slow(s[:i], at), (at + i, at + j, best[0]), *slow(s[j:], at + j)]

    for s in itertools.product((-2, 1, 3), repeat=6):
        assert [x[2] for x in X.segments(list(s))] == [x[2] for x in slow(list(s))]


def test_toxicity_held_out(spark, tables):
    docs, labels = tables
    model = X.train(docs, labels.where(~X.held_out()))
    rows = X.score_toxicity(docs, model).withColumn("held_out", X.held_out()).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)
    assert any(r.passages for r in rows if r.toxic)


def test_toxicity_awkward(spark, tables):
    docs, labels = tables
    model = X.train(docs, labels)
    df = awkward(spark)
    got = X.score_toxicity(df, model).collect()
    assert sorted(repr(r.doc_id) for r in got) == sorted(repr(r.doc_id) for r in df.collect()) and all(r.predicted == 0 for r in got if r.doc_id != 7)
    assert X.score_toxicity(empty(spark), model).count() == 0
    none = X.train(docs, labels.where("toxic = 0"))
    assert {r.score for r in X.score_toxicity(df, none).collect()} == {0.0}
    odd = labels.union(spark.createDataFrame([(None, 1, 1), (1, None, None), (1, 7, 7)], labels.schema))
    assert X.train(docs, odd).fitted


def test_quality(spark, tables):
    docs, labels = tables
    train = labels.where("doc_id % 2 = 0")
    rows = Q.score_quality(docs, Q.train(docs, train)).select("row.*", "score").join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert sum((r.score >= 0.5) == bool(r.quality) for r in rows) / len(rows) > 0.97
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    good = labels.where("quality = 1").join(docs.select("doc_id"), "doc_id")
    assert kept.join(good, "doc_id").count() == good.count()


def test_site_posteriors(spark):
    """Means shrink toward the level above, sparse groups more so."""
    rows = [("a", "x", 5.0)] * 100 + [("b", "y", -5.0)] * 100 + [("c", "z", 5.0)]
    sites, mean, k_host, k_path = Q.site_posteriors(spark.createDataFrame(rows, "host string, path string, odds double"))
    got = {r.host: r.host_mean for r in sites.collect()}
    assert mean == pytest.approx(0.5, abs=0.01) and got["a"] > got["c"] > 0.5 > got["b"]
    assert got["c"] == pytest.approx((0.9933 + k_host * mean) / (1 + k_host), abs=1e-3)


def test_quality_awkward(spark, tables):
    docs, labels = tables
    df = awkward(spark)
    model = Q.train(docs, labels)
    assert Q.score_quality(df, model).count() == df.count() and Q.score_quality(empty(spark), model).count() == 0
    none = Q.train(docs, labels.where("quality = 1"))
    assert none.weights is None and {r["score"] for r in Q.score_quality(df, none).collect()} == {0.5}
    assert Q.keep_good(df, labels.where("false")).count() == df.count()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header>Site</header><nav><ul><li><a href=x>Menu</a></li></ul></nav><!-- no -->
<div class="ad banner">Buy</div><div class="cookie-notice">Cookies</div><article><header><h1>Title &amp; more</h1></header><p>One <b>two</b>&nbsp;three<br>four<p>Fi<i>v</i>e   six</p><script>x</script>
<form><input><button>Send</button></form><aside>Side</aside><p>A</p></article><section id="comments"><p>Nice!</p></section><div class="sidebar"><div>in</div>side</div><footer>&copy; foot</footer></body></html>"""


def test_main_text():
    model = H.weights(H.count_labels(PAGE))
    assert H.main_text(PAGE, *model)[0] == "Title & more One two three four Five six A"
    assert H.main_text(None, *model) == ("", 0.0) and H.main_text("<p></p><!-- x", *model) == ("", 0.0)
    assert H.main_text("plain words", *model)[0] == "plain words"
    assert H.main_text("<p>a < b &lt; c<p>d", *model)[0] == "a < b < c d"
    assert H.main_text("<div class='menu'>m<div>n</div></div><div><p>text here now</p>", *model)[0] == "text here now"
    assert H.main_text("<script>never closed <p>x", *model)[0] == ""


def test_pages(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", ""), (3, "w", "<p>" + words(30000, 1) + "</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n", F.lit(1))
    got = H.extract_text(df).collect()
    assert sorted(r.n_chars for r in got)[:2] == [0, 0] and sum(r.text.startswith("Title & more") for r in got) == 2
    assert all(r.n_chars == len(r.text) for r in got) and max(r.n_chars for r in got) == len(words(30000, 1))
    assert H.extract_text(df.where("false")).count() == 0


def test_licences(spark):
    mit = dict(L.known_texts())["MIT"] and next(t for n, t in L.known_texts() if n == "MIT")
    spelled = "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace("SUBLICENSE", "SUB-LICENCE").replace(",", " ,")
    rows = [(1, mit), (2, spelled), (3, "text\nReleased under the MIT Licence\nmore\nLicensed under the Apache License, Version 2.0."), (4, None), (5, ""), (6, mit + " and more"), (None, "MIT licence"), (7, "Licensed under CC BY-NC 4.0.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("clash")).withColumn("license_id", F.lit("clash"))
    got = {r.doc_id: r for r in L.scan_licenses(df, L.catalog(spark)).collect()}
    assert len(got) == 8 and [got[k].license_id for k in (1, 2, 3, 4, 5, 6, None)] == ["MIT", "MIT", None, None, None, None, None]
    assert got[3].notices == "Apache-2.0,MIT" and got[3].n_notices == 2 and got[7].notices == "CC-BY-NC-4.0" and got[5].notices == ""
    assert L.scan_licenses(df.where("false"), L.catalog(spark)).count() == 0 and L.scan_licenses(df, L.catalog(spark, [])).where("license_id is not null or notices <> ''").count() == 0
    assert L.scan_licenses(awkward(spark), L.catalog(spark)).count() == awkward(spark).count()


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="no folder of licence texts on this machine")
def test_whole_licences(spark):
    """Whole texts as published, and in capitals on other lines, are known; with a word more they are not."""
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = [(n, open(f"{COMMON}/{f}", encoding="utf-8").read()) for f, n in names.items() if os.path.exists(f"{COMMON}/{f}")]
    rows = [(i * 3 + k, t) for i, (_, text) in enumerate(texts) for k, t in enumerate((text, text.upper().replace("\n", "  \n"), text + "\nmore"))]
    got = {r.doc_id: r.license_id for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), L.catalog(spark)).collect()}
    assert got == {i * 3 + k: n if k < 2 else None for i, (n, _) in enumerate(texts) for k in range(3)}
