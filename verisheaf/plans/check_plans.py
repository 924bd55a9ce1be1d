"""Queries of acceptance rules, run exports, attention shares and records, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from verisheaf.functions import records as R
from verisheaf.functions import text as T
from verisheaf.operators import checks as K
from verisheaf.operators import dataset as D
from verisheaf.operators import joins as J
from verisheaf.operators import quality as Q
from verisheaf.operators import stats as A
from verisheaf.plans.tables import REPORTS, WS, reports, table

# Rows of made-up sets by the number k of an order; these expressions mean the same in Spark and in DuckDB.
_SPLIT = "CASE WHEN k % 10 = 0 THEN 'test' ELSE 'train' END"
_TARGET = (
    "CASE k % 6 WHEN 0 THEN '左上图：汇管区 ' || k WHEN 1 THEN '图像分析：小叶 ' || k % 799 WHEN 2 THEN '肝细胞 ' || k || chr(10) || '病理诊断： 肝炎' "
    "WHEN 3 THEN '汇管区' || chr(10) || '病理诊断：未 找到' || chr(10) || '随访 ' || k WHEN 4 THEN '病理诊断:  ' ELSE '图像分析：脂变，' || k % 899 || '% 病理诊断：脂肪肝' END"
)
_IMAGES = "CASE k % 9 WHEN 0 THEN array('i' || k, 'i' || k) WHEN 1 THEN array('i' || k % 899, 'j' || k) ELSE array('i' || k % 1499) END"
_PROMPT = "CASE WHEN k % 7 = 0 THEN '<image><image>' WHEN k % 7 = 1 THEN '' ELSE '<image>' END || '请分析'"


def _sets(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    rows = rows.select(F.expr(_SPLIT).alias("split"), F.col("k").alias("record_index"), F.expr(_IMAGES).alias("images"), F.expr(_PROMPT).alias("p"), F.expr(_TARGET).alias("t"), (F.col("k") % 50 == 0).cast("int").alias("missing_files"))
    say = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return rows.select("split", "record_index", "images", "missing_files", F.array(say("user", "p"), say("assistant", "t")).alias("messages"))


_SETS = f"s AS (SELECT k, {_SPLIT} AS split, {_IMAGES.replace('array(', 'list_value(')} AS im, {_PROMPT} AS p, {_TARGET} AS t FROM (SELECT o_orderkey AS k FROM orders))"


def _filled(found):
    return found.select(F.coalesce("split", F.lit("all")).alias("split"), F.coalesce("record_index", F.lit(-1)).cast("long").alias("record_index"), "rule")


def clean_set(spark, sf):
    return _filled(K.clean_set_violations(_sets(spark, sf), {"train": 5090, "test": 276}))


_POSITION = "(?:(?:左|中|右)(?:上|中|下)|上|下)图"
_NAMED = lambda rules: "unnest(list_filter([" + ", ".join(f"CASE WHEN {r} THEN '{n}' END" for n, r in rules.items()) + "], lambda x: x IS NOT NULL)) AS rule"
_CLEAN_RULES = {
    "position_in_target": f"regexp_matches(t, '{_POSITION}')",
    "missing_diagnosis": rf"NOT regexp_matches(t, '病理诊断{WS}*[：:]{WS}*[^\s\x{{00a0}}\x{{3000}}]')",
    "unavailable_diagnosis": rf"regexp_replace(regexp_extract(t, '病理诊断{WS}*[：:]{WS}*([^\n]+)', 1), '{WS}', '', 'g') IN ('未找到', '无法诊断', '不详', '无')",
    "bad_images": "len(im) = 0 OR len(list_distinct(im)) <> len(im)",
    "missing_image": "k % 50 = 0",
}
CLEAN_SET = f"""WITH {_SETS}, n AS (SELECT *, lower(regexp_replace(t, '{WS}+', '', 'g')) AS key FROM s)
SELECT split, k AS record_index, {_NAMED(_CLEAN_RULES)} FROM n
UNION ALL SELECT split, record_index, 'duplicate_target' FROM (SELECT split, k AS record_index, row_number() OVER (PARTITION BY split, key ORDER BY k) AS place FROM n) WHERE place > 1
UNION ALL SELECT 'all', -1, 'target_leakage' FROM (SELECT key FROM n GROUP BY key HAVING count(DISTINCT split) > 1)
UNION ALL SELECT w.split, -1, 'unexpected_size' FROM (VALUES ('train', 5090), ('test', 276)) AS w(split, wanted) WHERE wanted <> (SELECT count(*) FROM s WHERE s.split = w.split)"""


def one_to_one_set(spark, sf):
    return _filled(K.one_to_one_violations(_sets(spark, sf)))


_VIEW_RULES = {
    "image_count_not_one": "len(im) <> 1",
    "placeholder_count_not_one": "(length(p) - length(replace(p, '<image>', ''))) <> 7",
    "invalid_target_schema": "NOT starts_with(t, '图像分析：')",
    "case_diagnosis_copied_to_single_view": "contains(t, '病理诊断')",
    "position_token_in_target": "regexp_matches(t, '左上图|右上图|左中图|右中图|左下图|右下图|上图|下图')",
    "missing_image": "k % 50 = 0",
}
ONE_TO_ONE_SET = rf"""WITH {_SETS}, i AS (SELECT split, unnest(im) AS v FROM s),
t AS (SELECT split, lower(regexp_replace(t, '[\s，。；;：:、\\（）()【】\[\]<>《》“”"''—-]+', '', 'g')) AS v FROM s)
SELECT split, k AS record_index, {_NAMED(_VIEW_RULES)} FROM s
UNION ALL SELECT DISTINCT split, -1, 'duplicate_image_within_split' FROM (SELECT split FROM i GROUP BY split, v HAVING count(*) > 1)
UNION ALL SELECT DISTINCT split, -1, 'duplicate_target_within_split' FROM (SELECT split FROM t GROUP BY split, v HAVING count(*) > 1)
UNION ALL SELECT 'all', -1, 'image_leakage_train_to_test' FROM (SELECT v FROM i GROUP BY v HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'all', -1, 'exact_target_leakage_train_to_test' FROM (SELECT v FROM t GROUP BY v HAVING count(DISTINCT split) > 1)"""

_GOT = "CASE k % 5 WHEN 0 THEN array('i' || k % 7, 'x') WHEN 1 THEN array('i' || k % 3) ELSE array('i' || k % 7) END"


def image_audit(spark, sf):
    k = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    audit = k.select(F.col("k").alias("view"), F.expr("'i' || k % 7").alias("image"))
    got = k.where("k % 11 <> 0").select(F.col("k").alias("view"), F.expr(f"CASE WHEN k % 13 <> 0 THEN {_GOT} END").alias("images"), F.expr("CASE WHEN k % 19 = 0 THEN ' ' ELSE 'p' END").alias("prediction"), F.expr("CASE WHEN k % 17 = 0 THEN 'e' END").alias("error"))
    return K.image_mismatches(got, audit, "view")


IMAGE_AUDIT = f"""SELECT view, problem FROM (SELECT k AS view, CASE WHEN k % 11 = 0 THEN 'missing' WHEN k % 17 = 0 OR k % 19 = 0 THEN 'invalid_prediction'
WHEN k % 13 = 0 OR {_GOT.replace('array(', 'list_value(')} <> ['i' || k % 7] THEN 'image_mismatch' END AS problem FROM (SELECT o_orderkey AS k FROM orders)) WHERE problem IS NOT NULL"""

_MATRIX = {f"R{i}": {"plated": i % 2 == 0, "promo_steel": True, "large": i < 3} for i in range(7)}


def component_matrix(spark, sf):
    keys = table(spark, sf, "part").select(F.concat(F.lit("R"), F.pmod("p_size", F.lit(5)).cast("string")).alias("run"), F.col("p_type").alias("key"))
    parts = {"plated": ["PLATED"], "promo_steel": [("PROMO", "STEEL")], "large": ["LARGE", "JUMBO"]}
    return K.component_mismatches(Q.adapter_components(keys, parts), _MATRIX)


_MATRIX_ROWS = ", ".join(f"('{run}', '{name}', {str(value).lower()})" for run, parts in _MATRIX.items() for name, value in parts.items())
COMPONENT_MATRIX = f"""WITH o AS (SELECT 'R' || p_size % 5 AS run, bool_or(contains(p_type, 'PLATED')) AS plated, bool_or(contains(p_type, 'PROMO') AND contains(p_type, 'STEEL')) AS promo_steel, bool_or(contains(p_type, 'LARGE') OR contains(p_type, 'JUMBO')) AS large FROM part GROUP BY 1),
l AS (UNPIVOT o ON plated, promo_steel, large INTO NAME component VALUE observed)
SELECT e.run, e.component, e.expected, l.observed FROM (VALUES {_MATRIX_ROWS}) AS e(run, component, expected) LEFT JOIN l ON l.run = e.run AND l.component = e.component WHERE e.expected IS DISTINCT FROM l.observed"""


def _exported(spark, sf):
    labels = table(spark, sf, "labels")
    metrics = labels.agg(F.avg("quality").alias("mean_rougeL_f1"), F.avg("toxic").alias("mean_sentence_bleu4"), F.lit(None).cast("double").alias("corpus_bleu4"), F.avg(F.col("quality") * F.col("toxic")).alias("accuracy"), F.lit(0.25).alias("rougeL_ci95_low"), F.lit(0.5).alias("rougeL_ci95_high"), F.lit(1.5).alias("cider_lite"))
    calibration = labels.agg((F.sum("toxic") / F.count(F.lit(1))).alias("ece"), F.lit(0.5).alias("mean_entropy_proxy"))
    bench = lambda c: labels.agg(F.avg(c).alias("strict_circular_accuracy"))
    return K.export_metrics("R1", metrics, calibration, None, bench("quality"), bench("toxic"), labels.agg(F.lit(0.75).alias("biobert_similarity")))


def exported(spark, sf):
    row = _exported(spark, sf)
    return row.select("run", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.round(c, 9).alias("value")) for c in row.columns if c != "run"])).alias("x")).select("run", "x.*").where("value is not null")


EXPORTED = """WITH m AS (SELECT avg(quality) AS q, avg(toxic) AS t, avg(quality * toxic) AS qt FROM labels)
SELECT 'R1' AS run, metric, round(value::DOUBLE, 9) AS value FROM (
  SELECT 'rougeL_f1' AS metric, q AS value FROM m UNION ALL SELECT 'bleu4', t FROM m UNION ALL SELECT 'cider', 1.5 UNION ALL SELECT 'exact_diagnosis_accuracy', qt FROM m
  UNION ALL SELECT 'bootstrap_95ci_low', 0.25 UNION ALL SELECT 'bootstrap_95ci_high', 0.5 UNION ALL SELECT 'ece', t FROM m UNION ALL SELECT 'entropy_proxy', 0.5
  UNION ALL SELECT 'mmbench_strict_circular_accuracy', q FROM m UNION ALL SELECT 'alignment_tax_pp_vs_base', 100 * (q - t) FROM m UNION ALL SELECT 'biobert_similarity', 0.75)"""


def accepted(spark, sf):
    """Two runs: one that lacks metrics, one that has all but loses confidences outside the bins."""
    docs = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") / 2000.0).alias("confidence"), (F.col("doc_id") % 2).alias("hit"))
    bins = A.reliability(docs, "confidence", "hit").select(F.col("n").alias("count"))
    cases = docs.agg(F.count("confidence").alias("n_cases"), F.lit(0).alias("n_errors"))
    bench = table(spark, sf, "benchmark").agg(F.count(F.lit(1)).alias("n_rows"), F.lit(0).alias("n_errors"), F.lit(1.0).alias("parse_rate"), F.lit(3).alias("n_circular_groups"))
    some = _exported(spark, sf)
    whole = some.select(*[F.coalesce(c, F.lit(0.5)).alias(c) if c != "run" else F.col(c) for c in some.columns])
    runs = [K.accept_run(m, cases, bins, cases, bench, 10, 3).select(F.lit(n).alias("run"), "*") for n, m in (("partial", some), ("whole", whole))]
    return runs[0].unionByName(runs[1])


ACCEPTED = """WITH b AS (SELECT count(*) FILTER (n_chars / 2000.0 <= 1) AS binned, count(*) AS n FROM documents), g AS (SELECT count(*) = 10 AS ok FROM benchmark),
c AS (SELECT r.run, r.run = 'whole' AS metrics_given, binned = n AS bins_sum, g.ok AS row_count FROM (VALUES ('partial'), ('whole')) AS r(run), b, g)
SELECT run, metrics_given, true AS interval_ordered, true AS strict_given, true AS calibration_no_errors, true AS calibration_has_cases, true AS interpretation_no_errors, true AS interpretation_has_cases,
 true AS benchmark_no_errors, true AS all_parsed, row_count, true AS group_count, bins_sum, metrics_given AND row_count AND bins_sum AS accepted FROM c"""


def first_rows(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"), "l_quantity")
    return K.first_where(rows, F.col("l_quantity") == 50, "place", 5)


FIRST_ROWS = "SELECT l_orderkey * 10 + l_linenumber AS place, l_quantity FROM lineitem WHERE l_quantity = 50 ORDER BY place LIMIT 5"


def first_or_error(spark, sf):
    return D.take_first(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 3)


def concatenated(spark, sf):
    docs = table(spark, sf, "documents")
    return K.concatenate({"train": docs.where("doc_id % 10 <> 0").select("doc_id", "source"), "test": docs.where("doc_id % 10 = 0").select("doc_id")}, "doc_id")


CONCATENATED = "SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN source END AS source, CASE WHEN doc_id % 10 <> 0 THEN 'train' ELSE 'test' END AS split FROM documents"


def paired(spark, sf):
    docs, labels = table(spark, sf, "documents").withColumn("long", F.col("n_chars") > 500), table(spark, sf, "labels")
    return J.paired(docs, labels, "doc_id", "long", "quality")


def shared_images(spark, sf):
    rows = _sets(spark, sf)
    return D.shared_images(rows.where("split = 'train'"), rows.where("split = 'test'"))


SHARED_IMAGES = f"WITH {_SETS}, i AS (SELECT split, unnest(im) AS image FROM s) SELECT image FROM i GROUP BY image HAVING count(DISTINCT split) > 1"


def direct_records(spark, sf):
    found = D.direct_records(_sets(spark, sf), "请给出诊断")
    said = lambda role: R.first_content(F.col("record.messages"), role)
    return found.select("record_index", said("user").alias("prompt"), said("assistant").alias("answer"), F.array_join("record.images", ",").alias("images"))


_STRIP = lambda v: rf"regexp_replace({v}, '^{WS}+|{WS}+\z', '', 'g')"
_TAIL = lambda v: _STRIP(rf"regexp_replace(regexp_extract({v}, '(?s)病理诊断{WS}*[：:]{WS}*(.*)', 1), '{WS}+', ' ', 'g')")
DIRECT_RECORDS = f"WITH {_SETS}, d AS (SELECT k, im, {_TAIL('t')} AS d FROM s) SELECT k AS record_index, repeat('<image>', len(im)) || '请给出诊断' AS prompt, '病理诊断：' || d AS answer, array_to_string(im, ',') AS images FROM d WHERE d <> '' AND len(im) > 0"


def benchmark_prompts(spark, sf):
    hint = F.expr("CASE p_size % 3 WHEN 0 THEN p_brand WHEN 1 THEN ' ' END")
    options = {"A": F.col("p_brand"), "B": F.expr("CASE WHEN p_size % 2 = 0 THEN p_type END")}
    return table(spark, sf, "part").select("p_partkey", R.benchmark_prompt(hint, F.col("p_name"), options, "Answer with the letter.").alias("prompt"))


BENCHMARK_PROMPTS = "SELECT p_partkey, concat_ws(chr(10), CASE WHEN p_size % 3 = 0 THEN 'Hint: ' || p_brand END, 'Question: ' || p_name, 'A. ' || p_brand, CASE WHEN p_size % 2 = 0 THEN 'B. ' || p_type END, 'Answer with the letter.') AS prompt FROM part"


def heads(spark, sf):
    return R.head(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", 20)


def empty_answers(spark, sf):
    k = F.col("o_orderkey")
    content = F.when(k % 5 == 1, "  ").when(k % 5 > 1, F.col("o_orderpriority"))
    role = F.when(k % 7 == 0, "user").otherwise("assistant")
    return Q.empty_answers(table(spark, sf, "orders").select(k.alias("record_index"), F.array(F.struct(role.alias("role"), content.alias("content"))).alias("messages")))


def diagnosis_forms(spark, sf):
    doubled = F.concat("reference", F.lit("\n"), "prediction")
    return reports(spark, sf).select("report_id", T.diagnosis_tail(doubled).alias("tail"), T.diagnosis_or_sentinel(F.col("reference")).alias("sentinel"), T.after_last_label(doubled).alias("last"))


DIAGNOSIS_FORMS = rf"""WITH {REPORTS}, d AS (SELECT *, reference || chr(10) || prediction AS pair FROM reports), v AS (SELECT *, lower(regexp_replace(regexp_extract(reference, '(?s)病理诊断{WS}*[：:]{WS}*(.*)', 1), '{WS}+', '', 'g')) AS x FROM d)
SELECT report_id, {_TAIL('pair')} AS tail, CASE WHEN NOT regexp_matches(reference, '病理诊断{WS}*[：:]') THEN '__MISSING__' WHEN x = '' THEN '__EMPTY__' ELSE x END AS sentinel, {_STRIP(f"regexp_extract(pair, '(?s)^.*病理诊断{WS}*[：:]{WS}*(.*)', 1)")} AS last FROM v"""


def _heads(spark, sf):
    """Embeddings as attention: each is the weights of a query in a made-up case, its neighbours by 8 the case's others."""
    e = table(spark, sf, "embeddings")
    weights = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    visual = F.transform("embedding", lambda x, i: (i % 3 != 0) & (i < 30))
    counts = F.expr("array(cast(vec_id div 8 % 4 + 1 AS int), cast(20 - 1 - vec_id div 8 % 4 AS int))")
    return e.select(F.expr("vec_id div 8").alias("case"), (F.col("vec_id") % 40).alias("position"), weights.alias("attention"), F.col("embedding").alias("gradient"), visual.alias("visual"), counts.alias("counts"))


_HEADS = """h AS (SELECT vec_id, vec_id // 8 AS case, vec_id % 40 AS position, (vec_id // 8) % 4 + 1 AS n0, unnest(range(len(embedding))) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings),
w AS (SELECT *, abs(x) AS a, i % 3 <> 0 AND i < 30 AS v, CASE WHEN i <= position THEN abs(x) ELSE 0 END AS g FROM h),"""


def attention_shares(spark, sf):
    out = K.visual_shares(_heads(spark, sf), "case")
    return out.select("case", *[F.round(c, 6).alias(c) for c in out.columns if c != "case"])


ATTENTION_SHARES = f"""WITH {_HEADS} q AS (SELECT vec_id, "case", coalesce(sum(a) FILTER (v), 0) AS m, coalesce(sum(g) FILTER (v), 0) / greatest(sum(g), 1e-12) AS gs, coalesce(sum(g * a) FILTER (v), 0) / greatest(sum(g * a), 1e-12) AS ga FROM w GROUP BY ALL)
SELECT "case", round(avg(m), 6) AS attention_visual_mass, round(avg(gs), 6) AS gradient_visual_share, round(avg(ga), 6) AS grad_attention_visual_share FROM q GROUP BY "case" """


def picture_shares(spark, sf):
    out = K.image_shares(_heads(spark, sf), "case", "counts")
    return out.select("case", F.col("image").cast("long").alias("image"), F.round("attention", 6).alias("attention"), F.round("grad_attention", 6).alias("grad_attention"))


PICTURE_SHARES = f"""WITH {_HEADS} p AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY vec_id ORDER BY i) <= n0 THEN 0 ELSE 1 END AS image FROM w WHERE v),
q AS (SELECT vec_id, "case", image, sum(a) AS a, sum(g * a) AS ga FROM p GROUP BY ALL), m AS (SELECT "case", image, avg(a) AS attention, avg(ga) AS ga FROM q GROUP BY ALL)
SELECT "case", CAST(image AS BIGINT) AS image, round(attention, 6) AS attention, round(CASE WHEN sum(ga) OVER c > 0 THEN ga / sum(ga) OVER c ELSE ga END, 6) AS grad_attention FROM m WINDOW c AS (PARTITION BY "case")"""


QUERIES = {
    "dq_clean_set": (clean_set, CLEAN_SET),
    "dq_one_to_one_set": (one_to_one_set, ONE_TO_ONE_SET),
    "dq_image_audit": (image_audit, IMAGE_AUDIT),
    "dq_component_matrix": (component_matrix, COMPONENT_MATRIX),
    "dq_acceptance": (accepted, ACCEPTED),
    "dq_empty_answers": (empty_answers, "SELECT o_orderkey + 1 AS source_index FROM orders WHERE o_orderkey % 5 < 2 OR o_orderkey % 7 = 0"),
    "ag_export_metrics": (exported, EXPORTED),
    "so_first_rows": (first_rows, FIRST_ROWS),
    "so_take_first": (first_or_error, "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 3"),
    "se_concatenate": (concatenated, CONCATENATED),
    "jn_paired": (paired, "SELECT doc_id, n_chars > 500 AS a, quality AS b FROM documents JOIN labels USING (doc_id)"),
    "gr_shared_images": (shared_images, SHARED_IMAGES),
    "pr_direct_records": (direct_records, DIRECT_RECORDS),
    "pr_benchmark_prompt": (benchmark_prompts, BENCHMARK_PROMPTS),
    "pr_head": (heads, "SELECT doc_id, source FROM documents WHERE doc_id < 20"),
    "tx_diagnosis_forms": (diagnosis_forms, DIAGNOSIS_FORMS),
    "mb_visual_shares": (attention_shares, ATTENTION_SHARES),
    "mb_image_shares": (picture_shares, PICTURE_SHARES),
}
