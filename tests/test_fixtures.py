"""Small cases with values worked out from the definitions."""

import json
import math

import pytest
from pyspark.sql import functions as F

from verisheaf.functions import extract as X
from verisheaf.functions import pairs as P
from verisheaf.functions import records as R
from verisheaf.functions import text as T
from verisheaf.operators import audit as U
from verisheaf.operators import dataset as D
from verisheaf.operators import joins as J
from verisheaf.operators import ngrams as N
from verisheaf.operators import quality as Q
from verisheaf.operators import scoring as C
from verisheaf.operators import stats as A
from verisheaf.sources import io
from verisheaf.streaming import state as ST

GOOD = "左上图：肝穿组织共见7个中小汇管区，小叶结构可辨\n右上图：汇管区中度炎性细胞浸润，可见淋巴细胞聚集灶\n左下图：环绕并攻击小胆管，可见上皮样肉芽肿\n右下图：未见明显界面炎，未见细胆管反应，未见纤维组织增生\n病理诊断：原发性胆汁性胆管炎 I期"
BAD = GOOD.replace("未见明显界面炎", "可见明显界面炎").replace("I期", "III期")


@pytest.fixture(scope="module")
def report(spark):
    df = spark.createDataFrame([(0, GOOD, BAD)], "pair_id long, r string, p string")
    return df.withColumn("re", X.entities(F.col("r"))).withColumn("pe", X.entities(F.col("p"))).cache()


def one(df, *columns):
    return df.select(*columns).first()


def test_report_rules(report):
    row = one(report, T.canonical_diagnosis(F.col("r")).alias("d"), T.stage(F.col("r")).alias("a"), T.stage(F.col("p")).alias("b"), T.image_labels(F.col("r")).alias("l"))
    assert (row.d, row.a, row.b) == ("原发性胆汁性胆管炎", 1, 3)
    assert row.l == ["左上图", "右上图", "左下图", "右下图"]
    row = one(report, "re", "pe")
    status = lambda of: next(e.status for e in of if e.entity == "interface_hepatitis")
    assert (status(row.re), status(row.pe)) == ("absent", "present")


def test_contradictions_and_facts(report):
    row = one(report, P.contradictions(F.col("re"), F.col("re")).alias("same"), P.contradictions(F.col("re"), F.col("pe")).alias("other"))
    assert row.same.contradictions == 0 and row.other.contradictions >= 1
    facts = X.facts(F.col("re"), F.col("r"))
    assert one(report, P.set_prf(facts, facts).alias("m")).m.f1 == 1.0


def test_numbers(report):
    claims = one(report, X.numeric_claims(F.col("r")).alias("n")).n
    assert [(c.entity, c.value, c.unit) for c in claims] == [("portal_tract", 7.0, "个")]


def test_greedy_numbers(spark):
    claim = "array<struct<entity:string,value:double,unit:string,context:string>>"
    make = lambda *v: [("e", x, "%", "") for x in v]
    df = spark.createDataFrame([(make(10.0, 20.0), make(18.0, 11.0)), ([], []), (None, make(1.0))], f"r {claim}, p {claim}")
    first, empty, none = df.select(P.compare_numbers("r", "p").alias("m")).collect()
    assert first.m.absolute_errors == [1.0, 2.0]
    assert (first.m.exact_count, first.m.within5_count, first.m.unsupported_count, first.m.omitted_count) == (0, 2, 0, 0)
    assert empty.m.matched_count == 0 and none.m.unsupported_count == 1


@pytest.mark.parametrize("overlap,predicted,reference,want", [(0, 0, 0, (1, 1, 1)), (0, 0, 3, (0, 0, 0)), (0, 3, 0, (0, 0, 0)), (2, 3, 3, (2 / 3, 2 / 3, 2 / 3))])
def test_prf(spark, overlap, predicted, reference, want):
    m = spark.range(1).select(P.prf(F.lit(overlap), F.lit(predicted), F.lit(reference)).alias("m")).first().m
    assert tuple(m) == pytest.approx(want)


def tokens(spark, *pairs):
    return spark.createDataFrame([(i, a.split(), b.split()) for i, (a, b) in enumerate(pairs)], "pair_id long, ref_tokens array<string>, pred_tokens array<string>")


def test_ngram_metrics(spark):
    pairs = tokens(spark, ("a b c", "a c d"), ("a a b", "a a a"), ("", ""), ("a b c", ""))
    rouge = {r.pair_id: r for r in N.rouge_n(pairs, (1,)).collect()}
    assert rouge[0].f1 == pytest.approx(2 / 3) and rouge[1].precision == pytest.approx(2 / 3) and rouge[2].f1 == 1.0 and rouge[3].f1 == 0.0
    meteor = {r.pair_id: r.meteor_exact for r in N.meteor_exact(pairs).collect()}
    assert meteor[0] == pytest.approx(1 / 3) and meteor[2] == 1.0 and meteor[3] == 0.0
    assert {r.pair_id: r.bleu4 for r in N.sentence_bleu(tokens(spark, ("a b c d e", "a b c d e"), ("a", "b"))).collect()} == {0: pytest.approx(1.0), 1: 0.0}
    assert N.cider_lite(tokens(spark, ("a b c d", "a b c d"))).first().cider == pytest.approx(10.0)
    assert pairs.sparkSession.range(1).select(N.repetition(F.array(*map(F.lit, "ababa"))).alias("r")).first().r == pytest.approx(1 / 3)
    chars = pairs.select("pair_id", F.col("ref_tokens").alias("ref_chars"), F.col("ref_tokens").alias("pred_chars")).where("pair_id = 0")
    assert N.chrf(chars).first().chrf == pytest.approx(1.0)


def test_lcs(spark):
    df = spark.createDataFrame([("abcd", "bcd"), ("", "x"), ("abcbdab", "bdcaba"), ("aaaa", "aa")], "a string, b string")
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    rows = df.select(P.lcs_length(chars("a"), chars("b")).alias("x"), P.lcs_length_native(chars("a"), chars("b")).alias("y")).collect()
    assert [r.x for r in rows] == [3, 0, 4, 2] == [r.y for r in rows]


def test_entropy_and_choice(spark):
    assert spark.range(1).select(P.entropy_bits(F.lit(0.9)).alias("h")).first().h == pytest.approx(0.468996, abs=1e-6)
    df = spark.createDataFrame([("B",), ("<think>A</think> (C)",), ("answer: d",), ("none",), (None,)], "t string")
    assert [r.c for r in df.select(T.extract_choice(F.col("t"), F.array(*map(F.lit, "ABCD"))).alias("c")).collect()] == ["B", "C", "D", None, None]


def test_view_sections(spark):
    df = spark.createDataFrame([("左上图：甲\n左上图：乙\n右上图：\n病理诊断：丙",), ("无",), ("左上图：甲\n左上图：",)], "t string")
    a, b, c = [r.v for r in df.select(T.view_sections(F.col("t")).alias("v")).collect()]
    assert [tuple(s) for s in a.sections] == [("左上图", "甲")] and a.reasons == ["duplicate_position_section", "empty_position_section"]
    assert b.reasons == ["no_line_start_position_sections"] and c.reasons == ["duplicate_position_section"]


def test_mcnemar_and_holm(spark):
    rows = [("s", 0, 1)] * 10 + [("s", 1, 0)] * 2 + [("s", 1, 1)] + [("t", 1, 1)]
    out = {r.g: r for r in A.with_p(A.mcnemar(spark.createDataFrame(rows, "g string, a int, b int"), ["g"], "a", "b")).collect()}
    assert out["s"].statistic == pytest.approx(49 / 12) and out["s"].p == pytest.approx(0.043308, abs=1e-6) and out["t"].p == 1.0
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "run string, p double")
    holm = {r.run: r for r in A.holm(tests).collect()}
    assert [round(holm[k].adjusted, 10) for k in "acb"] == [0.03, 0.06, 0.06] and [holm[k].significant for k in "acb"] == [True, False, True]


def test_calibration(spark):
    rows = spark.createDataFrame([(0.95, 1), (0.85, 0), (0.15, 0)], "c double, y int")
    assert A.expected_calibration_error(rows, "c", "y").first().ece == pytest.approx(0.35)
    edge = spark.createDataFrame([(0.29, 1), (1.0, 1), (1.5, 1)], "c double, y int")
    assert sorted(r.bin for r in A.reliability(edge, "c", "y", 100).collect()) == [29, 99]
    assert A.expected_calibration_error(edge, "c", "y", 100).first().n == 3


def test_circular(spark):
    rows = spark.createDataFrame([(1, True), (1000001, False), (2, True), (1000002, True)], "i long, hit boolean").select("*", F.lit("A").alias("c"), F.lit(None).cast("string").alias("e"))
    r = A.circular_benchmark(rows, "i", "hit", "c", "e").first()
    assert (r.all_accuracy, r.circ0_accuracy, r.strict_circular, r.n_groups) == (0.75, 1.0, 0.5, 2)


def test_keep_first(spark):
    rows = spark.createDataFrame([(0, "x"), (1, "y"), (2, "x"), (3, None), (4, None)], "i long, k string")
    assert {r.i: (r.keep, r.duplicate_of) for r in Q.keep_first(rows, "k", "i").collect()} == {0: (True, None), 1: (True, None), 2: (False, 0), 3: (True, None), 4: (False, 3)}


def test_two_keys(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "y"), (4, "c", "z")], "at long, a string, b string")
    assert {r["at"]: r.keep for r in Q.keep_first_of_two(rows, "at", "a", "b").collect()} == {1: True, 2: False, 3: True, 4: True}


def test_null_keys_are_keys(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, None, "y"), (3, "b", None), (4, "c", None), (5, "d", "z")], "at long, a string, b string")
    assert {r["at"]: r.keep for r in Q.keep_first_of_two(rows, "at", "a", "b").collect()} == {1: True, 2: False, 3: True, 4: False, 5: True}


def test_site_rules(spark):
    rows = spark.createDataFrame([(1, "see Made-Up-Host7"), (2, "none")], "id long, text string")
    found = U.text_findings(rows, "id", "text", (("our-host", "made-up-host[0-9]", False),))
    assert [tuple(r) for r in found.collect()] == [(1, "our-host")]


def test_case_aggregation(spark):
    views = spark.createDataFrame([(10, 0, "汇管区炎症", "慢性肝炎", 100), (10, 1, "胆管损伤", "慢性肝炎", 100), (11, 2, "肝细胞脂肪变", "脂肪性肝病", 101), (12, 3, "x", "a", 1), (12, 4, "y", "b", 1)], "case long, i long, text string, dx string, src long")
    grouped = D.group_cases(views, "case", "i", "text", "dx", "src")
    cases = {r["case"]: r for r in D.case_records(D.consistent_cases(grouped)).collect()}
    assert set(cases) == {10, 11} and cases[10].view_order == [0, 1] and cases[10].record.messages[1].content == "病理诊断：慢性肝炎" and "慢性肝炎" not in cases[10].record.messages[0].content
    with pytest.raises(ValueError):
        D.consistent_cases(grouped, "abort")


def test_privacy_rules(spark):
    planted = {
        "aws-access-key": "AKIA" + "A" * 16, "github-token": "ghp_" + "a" * 20, "credential-in-url": "https://" + "u:p" + "@host", "phone-number": "1" + "3" + "0" * 9, "national-id": "1" * 17 + "X",
        "medical-record-identifier": "MRN" + ": " + "AB-1234",
    }
    clean = ["AKIA" + "A" * 15, "9" * 30]
    rows = spark.createDataFrame([(k, v) for k, v in planted.items()] + [(f"clean{i}", v) for i, v in enumerate(clean)], "id string, t string")
    assert {r.id: r.rule for r in U.text_findings(rows, "id", "t").collect()} == {k: k for k in planted}
    blobs = spark.createDataFrame([("a" * 40, ["x/.env"], 3, bytearray(b"abc")), ("b" * 40, ["y.txt"], 3, bytearray(b"\x00AKIA" + b"A" * 16)), ("c" * 40, ["z.txt"], 1 << 30, None)], "oid string, paths array<string>, size long, data binary")
    assert sorted(r.rule for r in U.history_findings(blobs).collect()) == ["oversized-blob", "sensitive-filename"]
    files = spark.createDataFrame([("a\\b.py", 1, bytearray(b"")), ("d/e.csv", 1, bytearray(b"")), ("ok.md", 1, bytearray(("root" + "@").encode()))], "path string, length long, content binary")
    assert sorted((r.rule, r.path) for r in U.tree_findings(files).collect()) == [("backslash-in-path", "a\\b.py"), ("blocked-extension", "d/e.csv"), ("privileged-ssh-endpoint", "ok.md")]


def test_joins(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(2,), (3,)], "k long")
    assert sorted(tuple(r) for r in J.unmatched(a, b, ["k"]).collect()) == [(1, "left"), (3, "right")]
    with pytest.raises(ValueError):
        J.complete_join(a, b, ["k"])
    with pytest.raises(ValueError):
        J.positional_join(a, b.union(b), "k")
    views = spark.createDataFrame([(1, 1, ["a"]), (1, 2, ["a", "b"]), (2, 3, ["c"])], "c long, v long, f array<string>")
    assert {r.v: sorted(r.o) for r in J.others_in_case(views, "c", "v", "f", "o").collect()} == {1: ["a", "b"], 2: ["a"], 3: []}


def test_records(spark):
    df = spark.createDataFrame([([("system", "s"), ("user", ""), ("user", "q"), ("assistant", "x")],), ([],)], "m array<struct<role:string,content:string>>")
    rows = df.select(R.first_content(F.col("m"), "user").alias("a"), R.first_filled(F.col("m"), "user").alias("b"), R.replace_content(F.col("m"), "assistant", F.lit("z")).alias("c")).collect()
    assert (rows[0].a, rows[0].b, rows[0].c[3].content, rows[1].a, rows[1].b) == ("", "q", "z", "", "")
    with pytest.raises(Exception, match="assistant"):
        df.where("size(m) = 0").select(R.strict_content(F.col("m"), "assistant")).collect()
    p = spark.createDataFrame([("d\\左上图.jpg",), ("x/上图下图.png",), ("n.png",)], "p string").select(R.case_key(F.col("p")).alias("k"), R.image_position(F.col("p")).alias("i")).collect()
    assert [(r.k, r.i) for r in p] == [("d", "左上图"), ("x", None), ("n.png", None)]


def test_sources(spark, tmp_path):
    rows = [{"messages": [{"role": "user", "content": "q"}], "images": ["a.png"]}, {"messages": [], "images": []}]
    (tmp_path / "d.json").write_text(json.dumps(rows))
    (tmp_path / "d.jsonl").write_text("\n".join(json.dumps(r) for r in rows) + "\n\n[1]\n{bad\n")
    assert [r.record_index for r in io.read_json_array(spark, str(tmp_path / "d.json")).collect()] == [0, 1]
    good, bad = io.read_jsonl_tolerant(spark, str(tmp_path / "d.jsonl"), "messages array<struct<role:string,content:string>>, images array<string>")
    assert good.count() == 2 and sorted((r.line, r.error) for r in bad.collect()) == [(4, "ValueError"), (5, "JSONDecodeError")]
    with pytest.raises(ValueError, match=":4:"):
        io.read_jsonl_strict(spark, str(tmp_path / "d.jsonl"), "images array<string>")
    registry = str(tmp_path / "dataset_info.json")
    entry = {"file_name": "d.json", "formatting": "sharegpt", "columns": {"messages": "messages"}, "tags": {}}
    assert io.register(registry, {"d": entry}) == "written" and io.register(registry, {"d": entry}) == "unchanged"
    with pytest.raises(ValueError):
        io.register(registry, {"d": entry | {"formatting": "x"}})
    assert io.read_registered(spark, registry, "d").count() == 2 and io.registry_rows(spark, registry).first().file_name == "d.json"
    with pytest.raises(KeyError):
        io.read_registered(spark, registry, "e")
    (tmp_path / "c.csv").write_text("﻿a,b\n1,\"x\ny\"\n", encoding="utf-8")
    assert [tuple(r) for r in io.read_csv(spark, str(tmp_path / "c.csv")).collect()] == [("1", "x\ny")]
    out = str(tmp_path / "out")
    io.write_csv(spark.range(2).withColumnRenamed("id", "n"), out, mark=True)
    assert io.read_csv(spark, out).columns == ["n"]
    listed, totals = io.manifest(io.files(spark, str(tmp_path)), str(tmp_path), "d.json")
    assert "d.json" not in [r.path for r in listed.collect()] and totals.first().n_files == listed.count() and io.release_hashes(listed).first().value
    records = io.read_json_array(spark, str(tmp_path / "d.json"))
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.png").write_bytes(bytes.fromhex("89504E470D0A1A0A"))
    found = io.files(spark, str(tmp_path / "img"))
    assert {r.record_index: r.missing_files for r in io.missing_images(records, found, str(tmp_path / "img")).collect()} == {0: 0, 1: 0} and io.image_kinds(found).first().kind == "png"
    assert "0.500000" in io.markdown_table(spark.createDataFrame([(0.5, None)], "x double, y string"))


def test_state(spark, tmp_path):
    log = spark.createDataFrame([(5, 0, 1, "a"), (5, 1, 1, "b"), (6, 1, 3, "c"), (6, 1, 8, "d")], "case_index long, rank int, line long, prediction string")
    want = {5: "b", 6: "d"}
    assert {r.case_index: r.prediction for r in ST.latest(log, "case_index", ["rank", "line"]).collect()} == want
    path = str(tmp_path / "merged")
    for i, part in enumerate((log.where("line <> 8"), log.where("line = 8"), log.where("line = 3"))):
        new = ST.upsert_latest(part, path, "case_index", ["rank", "line"], i)
    assert {r.case_index: r.prediction for r in spark.read.parquet(new).collect()} == want
    done = log.withColumn("error", F.lit(None).cast("string"))
    assert ST.pending(spark.createDataFrame([(5,), (7,)], "case_index long"), done).first().case_index == 7
    with pytest.raises(ValueError):
        ST.completed(done, "other")


def test_bootstrap(spark):
    values = spark.range(20).select(F.col("id").alias("k"), F.lit(3.0).alias("v"))
    r = A.bootstrap_means(values, "v", "k", 50, 1).first()
    assert (r.n, r.mean, r.ci95_low, r.ci95_high, r.ci_excludes_zero) == (20, 3.0, 3.0, 3.0, True)
    assert math.isclose(A.bootstrap_statistic(values, "k", 10, 1, lambda g: g["v"].max()).first().value, 3.0)
    assert A.bootstrap_means(values.where("k < 0"), "v", "k", 5, 1).count() == 0


def test_acceptance_and_contrast(spark):
    row = spark.createDataFrame([(0.2, 0.4, 0)], "low double, high double, n_errors int")
    assert Q.acceptance(row, ["low", "high"], ["n_errors"], ("low", "high")).first().accepted
    settings = spark.createDataFrame([("a", "x", "1"), ("b", "x", "2"), ("a", "y", "1"), ("b", "y", "1"), ("b", "p", "/path/to/z")], "file string, key string, value string")
    assert sorted(tuple(r) for r in Q.config_contrast(settings, "a", ["y"], {"b": ["x"]}).collect()) == [("b", "p", "unexpected_difference")]
    assert Q.placeholder_paths(settings).count() == 1


def test_scoring(spark):
    log = spark.createDataFrame([(0, GOOD, GOOD), (1, GOOD, BAD), (2, GOOD, None)], "case_index long, reference string, prediction string")
    rows = {r.case_index: r for r in C.per_case(log).collect()}
    assert rows[0].facts_f1 == rows[0].rougeL_f1 == rows[0].diagnosis_exact == 1.0 and rows[0].meteor_exact > 0.99 and rows[0].contradiction.contradictions == 0
    assert rows[1].contradiction.contradictions >= 1 and rows[1].facts_f1 < 1 and (rows[1].ref_stage, rows[1].pred_stage) == (1, 3)
    assert rows[2].facts_recall == 0.0 and rows[2].bleu4 == 0.0
    values = {(r.section, r.metric): r.value for r in C.metrics_document(C.per_case(log)).collect()}
    assert values["numeric_and_stage", "stage_exact"] == 0.5 and values["diagnostic", "diagnosis_exact"] == pytest.approx(2 / 3)


def test_views(spark):
    audit = spark.createDataFrame([(0, 10, "a.jpg"), (1, 10, "b.jpg"), (2, 11, "c.jpg")], "one_to_one_index long, clean_case_index long, image string")
    text = ["图像分析：汇管区炎症", "图像分析：胆管损伤", "图像分析：肝细胞脂肪变"]
    log = spark.createDataFrame([(i, t, t) for i, t in enumerate(text)], "case_index long, reference string, prediction string")
    rows = C.per_view(audit, log).collect()
    assert len(rows) == 3 and all(r.f1 == 1.0 and r.has_prefix and not r.has_position and not r.has_diagnosis and r.discordance == 0 for r in rows)
    with pytest.raises(ValueError):
        C.per_view(audit, log.where("case_index < 2"))


def test_confidence(spark):
    rows = spark.createDataFrame([([[0.0, 0.0], [math.log(3.0), 0.0]],), ([],)], "logits array<array<double>>")
    a, b = C.confidence_from_logits(rows).collect()
    assert (a.mean_token_confidence, a.min_token_confidence, a.target_tokens) == (pytest.approx(0.625), 0.5, 2) and b.mean_token_confidence is None
    C.register_functions(spark)
    assert spark.sql("select lcs_length(array('a', 'b'), array('b')) as n").first().n == 1


def test_greedy_match(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]], [[1.0, 0.0]])], "r array<array<double>>, p array<array<double>>")
    m = df.select(P.greedy_match(F.col("r"), F.col("p")).alias("m")).first().m
    assert (m.precision, m.recall) == (1.0, 0.5)
