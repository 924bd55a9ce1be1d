"""What keeps queries within their tasks when tables grow: rows dealt over tasks, expressions made once, folds in rounds."""

import hashlib
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from verisheaf.functions import kernels as K
from verisheaf.functions import pairs as P
from verisheaf.functions import text as T
from verisheaf.operators import ngrams as N
from verisheaf.operators import quality as Q
from verisheaf.operators import stats as A
from verisheaf.plans import io_plans, quality_plans
from verisheaf.plans.tables import reports, tokenized, turn_pairs
from verisheaf.sources import io

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_reports_are_dealt_over_tasks(spark):
    """The orders are one row group, which one task reads."""
    assert reports(spark, SF).rdd.getNumPartitions() >= 8


def test_filters_on_reasons_repeat_no_rule(spark):
    """A rule is made in one place of the plan, however many filters follow."""
    for df in (quality_plans.reason_counts(spark, SF), Q.split_kept(Q.prepare(quality_plans._records(spark, SF)))[0]):
        assert plan(df).count("missing_assistant_target") == 1


def test_cues_are_sought_in_a_text_that_is_lowered_once(spark):
    df = spark.createDataFrame([("CK7 炎",)], "t string").select(T.cue_count(T.analysis_body(F.col("t"))).alias("n"))
    assert df.first().n == 2 and plan(df).count("lower(") == 1


def test_two_keys_in_rounds(spark, monkeypatch):
    """Rounds alone, rounds with a rest, and a chain that rounds don't shorten, against a plain fold. Keys may be null."""
    random.seed(3)
    dense = [(random.randrange(900), random.choice([None, *range(40)]), random.choice([None, *"abcdefghij"])) for _ in range(1200)]
    chain = [(i, (i + 1) // 2, str(i // 2)) for i in range(300)]
    for rows, most in ((dense, 0), (dense, 50), (chain, 0), (chain, 1000)):
        monkeypatch.setattr(Q, "FOLD_ROWS", most)
        seen, want = (set(), set()), []
        for at, a, b in sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2] is None, r[2] or "")):
            want.append((at, a, b, a not in seen[0] and b not in seen[1]))
            if want[-1][-1]:
                seen[0].add(a)
                seen[1].add(b)
        df = spark.createDataFrame(rows, "at long, a long, b string").repartition(5)
        assert sorted(map(repr, (tuple(r) for r in Q.keep_first_of_two(df, "at", "a", "b").collect()))) == sorted(map(repr, want))


def test_long_arrays_have_their_subsequence(spark):
    """By bits of a number, as by the table."""
    random.seed(4)
    rows = [([random.choice("abcd") for _ in range(random.randrange(150))], [random.choice("abce") for _ in range(random.randrange(150))]) for _ in range(60)] + [(["x"] * 3000, ["x", "y"] * 2000), ([], ["a"]), (None, ["a"])]

    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    got = [r.n for r in spark.createDataFrame(rows, "a array<string>, b array<string>").coalesce(1).select(P.lcs_length("a", "b").alias("n")).collect()]
    assert got == [table(a or [], b) for a, b in rows[:60]] + [2000, 0, 0]
    a, b = "汇管区炎 3.5 期", "汇管区 3.5 炎"
    assert K.lcs_of_texts(a, b)["token_lcs"] == table(K.tokens(a), K.tokens(b))


def test_repeated_texts_are_worked_on_once(spark):
    df = spark.createDataFrame([("未见界面炎", "a 3个"), (None, None), ("未见界面炎", "a 3个")], "r string, p string").coalesce(1)
    one, none, two = df.select(K.entities_of("r").alias("e"), K.numbers_of("r", "p").alias("n")).collect()
    assert one == two and [(e.entity, e.status) for e in one.e] == [("interface_hepatitis", "absent")] and one.n.prediction_count == 1
    assert none.e == [] and none.n.prediction_count == 0
    made = []
    run = K.by_text(lambda a, b: made.append(a) or a + b, StringType()).func
    assert run(pa.array(["x", "y", "x", "x"]), pa.array(["1", "1", None, "1"])).to_pylist() == ["x1", "y1", "x", "x1"] and len(made) == 3


def test_grams_travel_as_digests(spark):
    """One row for each gram of a pair, of fixed size."""
    pairs = spark.createDataFrame([(1, ["a", "b", "a", "b"], ["a", "b", "c"]), (2, ["ab"], []), (3, None, ["b", "a"])], "pair_id long, ref_tokens array<string>, pred_tokens array<string>").coalesce(1)
    rows = N.gram_digests(pairs).collect()
    got = sorted((r.pair_id, r.n, r.ref_count, r.pred_count) for r in rows)
    assert got == sorted([(1, 1, 2, 1), (1, 1, 2, 1), (1, 1, 0, 1), (1, 2, 2, 1), (1, 2, 1, 0), (1, 2, 0, 1), (1, 3, 1, 0), (1, 3, 1, 0), (1, 3, 0, 1), (1, 4, 1, 0), (2, 1, 1, 0), (3, 1, 0, 1), (3, 1, 0, 1), (3, 2, 0, 1)])
    assert len({(r.a, r.b) for r in rows}) == 11
    assert "\u0001" not in plan(N.cider_lite(tokenized(turn_pairs(spark, SF))))


def test_draws_are_dealt_over_tasks(spark, monkeypatch):
    values = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    want = A.bootstrap_means(values, "v", "k", 40, 5).collect()
    monkeypatch.setattr(A, "DRAWS", 1000)
    df = A.bootstrap_means(values, "v", "k", 40, 5)
    assert df.collect() == want and "RepartitionByExpression [place" in plan(df) and re.search(r"RepartitionByExpression \[place#\d+L\], 20\b", plan(df))


def test_files_larger_than_a_row(spark, tmp_path):
    """A sparse file of 2 GiB and a byte: its head is read alone, its digest in blocks."""
    with open(tmp_path / "big one.png", "wb") as f:
        f.write(bytes.fromhex(io.MAGIC["png"]))
        f.truncate((1 << 31) + 1)
    (tmp_path / "small").write_bytes(b"abc")
    with open(tmp_path / "big one.png", "rb") as f:
        want = hashlib.file_digest(f, "sha256").hexdigest()
    assert {(r.size, r.sha256) for r in io_plans.hashes(spark, str(tmp_path)).collect()} == {((1 << 31) + 1, want), (3, hashlib.sha256(b"abc").hexdigest())}
    assert {(r.kind, r.n) for r in io_plans.kinds(spark, str(tmp_path)).collect()} == {("png", 1), (None, 1)}


def test_grams_of_cases_are_counted_once_for_rouge_and_bleu(spark):
    pairs = tokenized(turn_pairs(spark, SF))
    got = {r.pair_id: r for r in N.rouge_and_bleu(pairs).collect()}
    assert {i: r.bleu4 for i, r in got.items()} == {r.pair_id: r.bleu4 for r in N.sentence_bleu(pairs).collect()}
    assert {(i, n): r[f"rouge{n}_f1"] for i, r in got.items() for n in (1, 2)} == {(r.pair_id, r.n): r.f1 for r in N.rouge_n(pairs).collect()}
