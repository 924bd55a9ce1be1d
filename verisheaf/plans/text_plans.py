"""Queries of text scalars and record accessors."""

from __future__ import annotations

from pyspark.sql import functions as F

from verisheaf.functions import lexicon as L
from verisheaf.functions import records as R
from verisheaf.functions import text as T
from verisheaf.operators import quality as Q
from verisheaf.plans import tables as S
from verisheaf.plans.tables import REPORTS, WS, reports, table


def normalized(spark, sf):
    t = F.col("reference")
    return reports(spark, sf).select("report_id", T.normalize(t).alias("normal"), T.normalize_space(t).alias("space"), T.compact(t).alias("compact"), T.squeezed_lower(t).alias("squeezed"))


NORMALIZED = f"WITH {REPORTS} SELECT report_id, {S.sql_normalize('reference')} AS normal, {S.sql_normalize_space('reference')} AS space, {S.sql_compact('reference')} AS compact, {S.sql_squeezed('reference')} AS squeezed FROM reports"


def squeezed_documents(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.md5(T.squeezed_lower(t)).alias("squeezed"), F.length(T.normalize(t)).cast("long").alias("normal_chars"))


SQUEEZED = f"SELECT doc_id, md5({S.sql_squeezed('text')}) AS squeezed, CAST(length({S.sql_normalize('text')}) AS BIGINT) AS normal_chars FROM documents"


def token_lists(spark, sf):
    tok = T.tokens(F.col("reference"))
    return reports(spark, sf).select("report_id", F.array_join(tok, "|").alias("tokens"), F.size(tok).cast("long").alias("n_tokens"), F.size(T.char_tokens(F.col("reference"))).cast("long").alias("n_chars"), T.cjk_count(F.col("reference")).alias("cjk"))


TOKENS = rf"WITH {REPORTS} SELECT report_id, array_to_string({S.sql_tokens('reference')}, '|') AS tokens, CAST(len({S.sql_tokens('reference')}) AS BIGINT) AS n_tokens, CAST(length({S.sql_compact('reference')}) AS BIGINT) AS n_chars, CAST(len(regexp_extract_all(reference, '[\x{{4e00}}-\x{{9fff}}]')) AS BIGINT) AS cjk FROM reports"


def diagnoses(spark, sf):
    t = F.col("reference")
    return reports(spark, sf).select("report_id", T.extract_diagnosis(t).alias("diagnosis"), T.canonical_diagnosis(t).alias("canonical"), T.stage(t).alias("stage"), F.array_join(F.array_sort(T.diagnosis_terms(t)), "|").alias("terms"), T.has_diagnosis_section(t).alias("has_section"))


_STAGE = f"regexp_extract({S.sql_normalize('reference')}, '(?i)([ivxⅠⅡⅢⅣ一二三四1-4]+){WS}*期', 1)"
_STAGE_MAP = "CASE lower(raw) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in L.STAGES.items()) + " END"
DIAGNOSES = rf"""WITH {REPORTS}, d AS (
  SELECT report_id, reference, {S.sql_extract_diagnosis('reference')} AS diagnosis, {S.sql_canonical('reference')} AS canonical, {_STAGE} AS raw FROM reports
)
SELECT report_id, diagnosis, canonical, CAST(CASE WHEN regexp_matches(raw, '^\d+$') THEN CAST(raw AS BIGINT) ELSE {_STAGE_MAP} END AS BIGINT) AS stage,
       CASE WHEN canonical = '__MISSING__' THEN '' ELSE array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(canonical, '并|伴|合并|及|/|\+'), lambda x: x <> ''))), '|') END AS terms,
       regexp_matches({S.sql_normalize('reference')}, '病理诊断{WS}*[：:]{WS}*[^\s\x{{00a0}}\x{{3000}}]') AS has_section
FROM d"""


def concepts(spark, sf):
    return reports(spark, sf).select("report_id", F.array_join(T.diagnosis_concepts(F.col("reference")), "|").alias("concepts"))


_CONCEPT_LIST = ", ".join(f"CASE WHEN {' OR '.join(f'''contains(v, '{t.lower()}')''' for t in terms)} THEN '{name}' END" for name, terms in L.CONCEPTS.items())
CONCEPTS = f"WITH {REPORTS}, c AS (SELECT report_id, lower(regexp_replace({S.sql_extract_diagnosis('reference')}, '{WS}+', '', 'g')) AS v FROM reports) SELECT report_id, array_to_string(list_filter([{_CONCEPT_LIST}], lambda x: x IS NOT NULL), '|') AS concepts FROM c"


def positions(spark, sf):
    t = F.col("reference")
    v = T.view_sections(t)
    out = reports(spark, sf).select("report_id", T.strip_position_headers(t).alias("stripped"), F.array_join(T.image_labels(t), "|").alias("labels"), T.schema_flags(t).alias("f"), T.cue_count(T.analysis_body(t)).alias("cues"), v.alias("v"))
    return out.select("report_id", "stripped", "labels", "f.has_prefix", "f.has_position", "f.has_diagnosis", "cues")


_POS = "(?:(?:左|中|右)(?:上|中|下)|上|下)图"
_STRIPPED = rf"regexp_replace(regexp_replace(regexp_replace({S.sql_normalize_space('reference')}, '(?m)^{WS}*{_POS}{WS}*[：:]?{WS}*', '', 'g'), '{_POS}', '', 'g'), '[（(]{WS}*[）)]', '', 'g')"
_STRIPPED = rf"regexp_replace(regexp_replace(regexp_replace({_STRIPPED}, '\n[ \t]+', chr(10), 'g'), '\n{{2,}}', chr(10), 'g'), '^{WS}+|{WS}+\z', '', 'g')"
_BODY = rf"regexp_replace({S.sql_normalize_space('reference')}, '(?s)病理诊断{WS}*[：:].*', '')"
_CUES = " + ".join(f"CAST(contains(lower({_BODY}), '{c.lower()}') AS BIGINT)" for c in L.CUES)
POSITIONS = rf"""WITH {REPORTS} SELECT report_id, {_STRIPPED} AS stripped,
  array_to_string((SELECT list(l ORDER BY k) FROM (SELECT l, min(k) AS k FROM (SELECT unnest(x) AS l, unnest(range(1, len(x) + 1)) AS k FROM (SELECT regexp_extract_all({S.sql_normalize('reference')}, '(?:左上|右上|左下|右下|上|下)图') AS x)) GROUP BY l)), '|') AS labels,
  starts_with(reference, '图像分析：') AS has_prefix, regexp_matches(reference, '{_POS}') AS has_position, contains(reference, '病理诊断') AS has_diagnosis, {_CUES} AS cues FROM reports"""


def records(spark, sf):
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    m = F.col("m")
    return rows.select(
        "conv_id", F.md5(R.first_content(m, "assistant")).alias("answer"), F.md5(R.first_filled(m, "user")).alias("question"), F.size("m").cast("long").alias("n_turns"),
        F.coalesce(F.get(m, F.lit(0))["role"], F.lit("")).alias("first_role"),
    )


RECORDS = """SELECT conv_id, md5(coalesce(arg_min(text, turn) FILTER (role = 'assistant'), '')) AS answer,
  md5(coalesce(arg_min(text, turn) FILTER (role = 'user' AND text <> ''), '')) AS question, count(*) AS n_turns, arg_min(role, turn) AS first_role
FROM conversations GROUP BY conv_id"""


def issues(spark, sf):
    rows = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("record_index")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    return Q.message_issues(rows.withColumn("images", F.array().cast("array<string>"))).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


ISSUES = """WITH r AS (SELECT conv_id, arg_min(role, turn) AS first_role, count(*) FILTER (role = 'assistant') AS answers, count(*) FILTER (role = 'assistant' AND trim(coalesce(text, '')) = '') AS blank,
    sum(len(regexp_extract_all(coalesce(text, ''), '<image>'))) AS places FROM conversations GROUP BY conv_id),
i AS (SELECT unnest([CASE WHEN places <> 0 THEN 'placeholder_mismatch' END, CASE WHEN first_role <> 'user' THEN 'first_role_not_user' END, CASE WHEN answers = 0 THEN 'no_assistant' END, CASE WHEN blank > 0 THEN 'empty_assistant' END]) AS issue FROM r)
SELECT issue, count(*) AS n FROM i WHERE issue IS NOT NULL GROUP BY issue"""


def choices(spark, sf):
    answer = F.element_at(F.array(*map(F.lit, ("B", "<think>A</think> (C)", "answer: d", "the option is [A]", "no idea", "E or B", ""))), (F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(7)) + 1).cast("int"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.extract_choice(answer, F.array(*map(F.lit, "ABCD"))).alias("choice"))


CHOICES = """SELECT l_orderkey, l_linenumber, (['B', 'C', 'D', 'A', NULL, 'B', NULL])[CAST((l_orderkey + l_linenumber) % 7 AS INTEGER) + 1] AS choice FROM lineitem"""


def samples(spark, sf):
    n = F.col("p_size").cast("long")
    return table(spark, sf, "part").select("p_partkey", F.array_join(T.evenly_spaced(n, F.lit(4)).cast("array<string>"), ",").alias("places"), T.last_subsequence(F.sequence(F.lit(1), n.cast("int")), F.array(F.lit(2), F.lit(3))).alias("last"))


SAMPLES = """SELECT p_partkey, array_to_string(CASE WHEN least(4, p_size) = 1 THEN [CAST(p_size // 2 AS BIGINT)] ELSE list_transform(range(0, least(4, p_size)), lambda i: CAST(round_even(i * (p_size - 1) / (least(4, p_size) - 1)::DOUBLE, 0) AS BIGINT)) END, ',') AS places,
  CASE WHEN p_size >= 3 THEN CAST(1 AS BIGINT) END AS last FROM part"""


def paths(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat_ws("/", F.lit("root"), F.concat(F.lit("case"), F.col("p_size").cast("string")), F.concat(F.element_at(F.array(*map(F.lit, L.POSITIONS["views"])), (F.pmod("p_partkey", F.lit(8)) + 1).cast("int")), F.lit(".jpg"))).alias("path"))
    return p.select("p_partkey", R.case_key(F.col("path")).alias("case_key"), R.image_position(F.col("path")).alias("position"), R.preview(F.col("path"), 9).alias("preview"))


PATHS = f"SELECT p_partkey, 'root/case' || p_size AS case_key, {S._pick(L.POSITIONS['views'], 'p_partkey')} AS position, substr('root/case' || p_size || '/', 1, 9) AS preview FROM part"


def finite_numbers(spark, sf):
    raw = F.when(F.pmod("l_linenumber", F.lit(4)) == 0, "nan").when(F.pmod("l_linenumber", F.lit(4)) == 1, "x").when(F.pmod("l_linenumber", F.lit(4)) == 2, "Infinity").otherwise(F.col("l_orderkey").cast("string"))
    return table(spark, sf, "lineitem").select("l_linenumber", R.finite(raw).alias("v")).groupBy("l_linenumber").agg(F.count("v").alias("n"), F.sum("v").alias("total"))


FINITE = "SELECT l_linenumber, count(v) AS n, sum(v) AS total FROM (SELECT l_linenumber, CASE WHEN l_linenumber % 4 = 3 THEN l_orderkey::DOUBLE END AS v FROM lineitem) GROUP BY l_linenumber"

QUERIES = {
    "tx_normalize": (normalized, NORMALIZED),
    "tx_squeezed_documents": (squeezed_documents, SQUEEZED),
    "tx_tokens": (token_lists, TOKENS),
    "tx_diagnosis": (diagnoses, DIAGNOSES),
    "tx_concepts": (concepts, CONCEPTS),
    "tx_positions": (positions, POSITIONS),
    "tx_choice": (choices, CHOICES),
    "tx_samples": (samples, SAMPLES),
    "pr_records": (records, RECORDS),
    "pr_paths": (paths, PATHS),
    "pr_finite": (finite_numbers, FINITE),
    "dq_message_issues": (issues, ISSUES),
}
