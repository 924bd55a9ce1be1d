"""Pairs that share no more bands than the buckets that were cut finer."""

import pytest
from cases import words
from test_near_and_leaks import check_near, edited

from verisheaf.llm import near_dedup as N


@pytest.mark.parametrize("bands", [1, 2, 3])
def test_pairs_without_a_further_band_are_compared(spark, monkeypatch, bands):
    """Texts of one template below the threshold, each with a near copy; every bucket that holds several classes counts
    as large, and a pair shares as many bands as there are."""
    monkeypatch.setattr(N, "SMALL", 0)
    monkeypatch.setattr(N, "BLOCK", 8, raising=False)
    template, rows = words(300, 51), []
    for i in range(8):
        text = template + " " + words(60, 60 + i)
        rows += [(2 * i, text), (2 * i + 1, edited(text, 0.002, i))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_near(df.collect(), N.near_duplicates(df, bands=bands, rows=1).collect())
