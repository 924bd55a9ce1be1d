"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing names."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("size", "norm", "key", "salt", "hash", "score", "kept", "bucket", "id", "label", "marks", "finish", "part", "target", "digest", "lines", "__key", "__id")


def words(n: int, seed: int) -> str:
    """n made-up words, the same for a seed."""
    x, out = seed * 7919 + 1, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append("".join("bcdfghjklmnprstv"[(x >> s) & 15] + "aeiou"[(x >> (s + 3)) % 5] for s in (4, 9, 14)))
    return " ".join(out)


def awkward(spark):
    base = words(60, 1)
    rows = [
        (1, base, "en", "a", 0), (2, base, "en", "a", 0), (3, base.replace(" ", "  \n"), "en", "b", None), (4, None, None, None, None), (5, "", "en", "a", 0), (6, " \t\n", "de", "b", 3),
        (7, words(40000, 2), "en", "a", 0), (8, "one", "en", "", 0), (9, "one two three four", "fr", "b", 0), (9, "one two three four", "fr", "b", 0), (9, words(50, 3), "en", "a", 0), (None, words(30, 4), "en", None, 1),
        (None, words(30, 4), "en", None, 1), (10, "naïve ✓   \U0001f600 " + words(30, 5), "en", "c", 0), (11, "!!! ??? ###", "en", "c", 0), (12, words(30, 6).upper() + "!!", "en", "c", 0),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in CLASHES:
        df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return awkward(spark).where("false")
