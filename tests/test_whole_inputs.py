"""Registered queries over small tables whose findings lie where a cut would lose them."""

import re

from verisheaf.functions import lexicon as L
from verisheaf.plans import quality_plans as P


def test_patterns_are_found_behind_long_texts(spark, tmp_path):
    far = "word " * 60
    rows = [(8 + 9 * k, far + end) for k, end in enumerate(("AKIA" + "B" * 16, "ghp_" + "c" * 24, "1" + "5" * 10, "mrn: XY-9876", "nothing"))]
    rows += [(0, None), (9, far), (12, far * 500 + "2" * 18)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    planted = {0: "AKIA" + "A" * 16, 3: " 13" + "0" * 9 + " "}
    want = {(i, name) for i, text in rows for name, p, cased in L.PRIVACY_RULES if re.search(p, f"{text or ''} {planted.get(i % 9, '')}", 0 if cased else re.I)}
    assert {(8, "aws-access-key"), (12, "national-id"), (0, "aws-access-key")} <= want
    assert sorted(tuple(r) for r in P.privacy(spark, str(tmp_path)).collect()) == sorted(want)


def test_long_pages_are_searched(spark, tmp_path):
    """Pages of 5 MiB are searched and judged by name; a byte more, which is fewer characters, and they are only named."""
    most = L.MOST_BLOB_BYTES
    html = ["x" * 20_000 + " AKIA" + "B" * 16, "y" * 20_000, "z" * most, "é" * (most // 2) + "!" + "AKIA" + "C" * 16, None]
    rows = [(4, html[0]), (5, html[1]), (7, html[2]), (10, html[3]), (14, html[4])]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.rule: r.n for r in P.blobs(spark, str(tmp_path)).collect()}
    assert got == {"aws-access-key": 1, "sensitive-filename": 2, "oversized-blob": 1}
