"""Queries of data quality, deduplication, leakage, privacy, datasets, joins and state."""

from __future__ import annotations

from pyspark.sql import functions as F

from verisheaf.functions import lexicon as L
from verisheaf.functions import text as T
from verisheaf.operators import audit as U
from verisheaf.operators import dataset as D
from verisheaf.operators import joins as J
from verisheaf.operators import quality as Q
from verisheaf.operators import stats as A
from verisheaf.plans import tables as S
from verisheaf.plans.tables import REPORTS, WS, reports, table
from verisheaf.streaming import state as ST


def _records(spark, sf):
    """Reports as records: prompts hold as many placeholders as the order number says, images repeat now and then."""
    k = F.col("report_id")
    images = F.transform(F.sequence(F.lit(1), (F.pmod(k, F.lit(3)) + 1).cast("int")), lambda i: F.concat(F.lit("case"), k.cast("string"), F.lit("/"), F.element_at(F.array(F.lit("左上图"), F.lit("右上图")), (F.pmod(k + i * F.pmod(k, F.lit(5)), F.lit(2)) + 1).cast("int")), F.lit(".jpg")))
    said = F.array(F.struct(F.lit("user").alias("role"), F.repeat(F.lit("<image>"), (F.pmod(k, F.lit(4)) + 1).cast("int")).alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("reference").alias("content")))
    return reports(spark, sf).select(k.alias("record_index"), images.alias("images"), said.alias("messages"))


def rules(spark, sf):
    return Q.prepare(_records(spark, sf)).select("record_index", F.array_join("reasons", ",").alias("reasons"), "diagnosis", F.md5("canonical_target").alias("target_key"))


_POS = "(?:(?:左|中|右)(?:上|中|下)|上|下)图"
_STRIP = lambda v: rf"regexp_replace({v}, '^{WS}+|{WS}+\z', '', 'g')"
_CLEANED = rf"regexp_replace(regexp_replace(regexp_replace({S.sql_normalize_space('reference')}, '(?m)^{WS}*{_POS}{WS}*[：:]?{WS}*', '', 'g'), '{_POS}', '', 'g'), '[（(]{WS}*[）)]', '', 'g')"
_CLEANED = _STRIP(rf"regexp_replace(regexp_replace({_CLEANED}, '\n[ \t]+', chr(10), 'g'), '\n{{2,}}', chr(10), 'g')")
_PUNCT = r"[\s\x{00a0}\x{3000}，,。；;：:、/\\（）()【】\[\]<>《》·—_-]+"
_COMPACT = lambda v: f"lower(regexp_replace({S.sql_normalize_space(v)}, '{_PUNCT}', '', 'g'))"
_CJK = lambda v: rf"len(regexp_extract_all({v}, '[\x{{4e00}}-\x{{9fff}}]'))"
_CUES = " + ".join(f"CAST(contains(lower(body), '{c.lower()}') AS INTEGER)" for c in L.CUES)
_REASONS = {
    "missing_assistant_target": f"{_STRIP('reference')} = ''",
    "duplicate_image_path_within_case": "len(list_distinct(images)) <> len(images)",
    "image_placeholder_count_mismatch": "placeholders <> len(images)",
    "repeated_position_header": "len(list_distinct(headers)) <> len(headers)",
    "position_header_count_exceeds_images": "len(headers) > len(images)",
    "missing_diagnosis_section": "NOT labelled",
    "empty_diagnosis": "labelled AND diagnosis = ''",
    "diagnosis_unavailable_placeholder": f"{_COMPACT('diagnosis')} IN ({', '.join(chr(39) + x + chr(39) for x in L.PLACEHOLDERS)})",
    "analysis_too_short": f"{_CJK(_COMPACT('body'))} < 8",
    "insufficient_pathology_content": f"({_CUES}) < 2",
    "target_too_short": f"{_CJK(_COMPACT('cleaned'))} < 16",
}
_RECORDS = rf"""rec AS (
  SELECT report_id, reference, report_id % 4 + 1 AS placeholders,
    list_transform(range(1, report_id % 3 + 2), lambda i: 'case' || report_id || '/' || (['左上图', '右上图'])[CAST((report_id + i * (report_id % 5)) % 2 AS INTEGER) + 1] || '.jpg') AS images FROM reports
), cl AS (SELECT *, {_CLEANED} AS cleaned, regexp_extract_all(reference, '(?m)^{WS}*({_POS}){WS}*[：:]?{WS}*', 1) AS headers FROM rec
), dg AS (SELECT *, regexp_matches(cleaned, '病理诊断{WS}*[：:]') AS labelled, {_STRIP(rf"regexp_extract({S.sql_normalize_space('cleaned')}, '病理诊断{WS}*[：:]{WS}*([^\n]*)', 1)")} AS diagnosis,
    {_STRIP(rf"regexp_replace({S.sql_normalize_space('cleaned')}, '(?s)病理诊断{WS}*[：:].*', '')")} AS body FROM cl
), pr AS (SELECT report_id AS record_index, array_to_string(list_sort(list_filter([{', '.join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in _REASONS.items())}], lambda x: x IS NOT NULL)), ',') AS reasons, diagnosis, md5({_COMPACT('cleaned')}) AS target_key FROM dg)"""
RULES = f"WITH {REPORTS}, {_RECORDS} SELECT record_index, reasons, diagnosis, target_key FROM pr"


def reason_counts(spark, sf):
    _, excluded = Q.split_kept(Q.prepare(_records(spark, sf)))
    return Q.reason_counts(excluded)


REASON_COUNTS = f"WITH {REPORTS}, {_RECORDS} SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, ',')) AS reason FROM pr WHERE reasons <> '') GROUP BY reason"


def clean(spark, sf):
    return Q.clean_split(Q.prepare(_records(spark, sf)).select("record_index", "canonical_target", "reasons")).select("record_index", "clean_index")


CLEAN = f"WITH {REPORTS}, {_RECORDS}, f AS (SELECT min(record_index) AS record_index FROM pr WHERE reasons = '' GROUP BY target_key) SELECT record_index, row_number() OVER (ORDER BY record_index) - 1 AS clean_index FROM f"


def keep_first(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", T.squeezed_lower(F.col("text")).alias("k")).select("doc_id", F.md5("k").alias("key"))
    return Q.keep_first(docs, "key", "doc_id").select("doc_id", "keep", "duplicate_of")


KEEP_FIRST = f"WITH d AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY {S.sql_squeezed('text')}) AS f FROM documents) SELECT doc_id, doc_id = f AS keep, CASE WHEN doc_id <> f THEN f END AS duplicate_of FROM d"


def keep_first_of_two(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return Q.keep_first_of_two(rows, "at", "a", "b").select("at", "keep")


def one_to_one(spark, sf):
    views, _ = D.one_to_one(_records(spark, sf))
    return views.select("one_to_one_index", "record_index", "image", "source_position", "answer", "analysis_chars")


def leakage(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", T.squeezed_lower(F.col("text")).alias("key"))
    return U.overlap(docs.where("doc_id % 10 <> 0"), docs.where("doc_id % 10 = 0"), "key", 50)


LEAKAGE = f"WITH d AS (SELECT doc_id, {S.sql_squeezed('text')} AS key FROM documents), s AS (SELECT * FROM d WHERE doc_id % 10 = 0 AND key IN (SELECT key FROM d WHERE doc_id % 10 <> 0)) SELECT count(*) AS shared, count(*) FILTER (length(key) < 50) AS trivial, count(*) FILTER (length(key) >= 50) AS nontrivial FROM s"


def without_shared(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.md5(T.squeezed_lower(F.col("text"))).alias("key"))
    kept, removed = Q.remove_shared(docs.where("doc_id % 10 <> 0"), docs.where("doc_id % 10 = 0"), "key")
    return kept.select("doc_id", F.lit(True).alias("kept")).union(removed.select("doc_id", F.lit(False)))


WITHOUT_SHARED = f"WITH d AS (SELECT doc_id, {S.sql_squeezed('text')} AS key FROM documents) SELECT doc_id, key NOT IN (SELECT key FROM d WHERE doc_id % 10 = 0) AS kept FROM d WHERE doc_id % 10 <> 0"


def shared_sources(spark, sf):
    docs = table(spark, sf, "documents")
    return U.shared_values(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "source")


def duplicate_reports(spark, sf):
    return A.duplicate_groups(table(spark, sf, "documents").select(F.md5(T.squeezed_lower(F.col("text"))).alias("key")), "key")


DUPLICATES = f"SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows FROM (SELECT count(*) AS n FROM documents GROUP BY {S.sql_squeezed('text')} HAVING count(*) > 1)"


def digest(spark, sf):
    return U.ordered_digest(table(spark, sf, "benchmark"), "item_id", "text")


DIGEST = "SELECT sha256(string_agg(text, chr(10) ORDER BY item_id)) AS digest FROM benchmark"

#: Made-up sensitive values, put together so that no file holds one: kind and value by the number of a row.
_PLANTED = ("'AKIA' || repeat('A', 16)", "'ghp_' || repeat('a', 20)", "'https://' || 'u:p' || '@host'", "' 1' || '3' || repeat('0', 9) || ' '", "repeat('1', 17) || 'X'", "'MRN' || ': ' || 'AB-1234'", "'AKIA' || repeat('A', 15)", "'C:' || chr(92) || 'Users' || chr(92) || 'me'", "''")


def privacy(spark, sf):
    value = "case pmod(doc_id, 9) " + " ".join(f"when {i} then {v}" for i, v in enumerate(_PLANTED)) + " end"
    rows = table(spark, sf, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.expr(value)).alias("text"))
    return U.text_findings(rows, "doc_id", "text")


_RULE_SQL = ", ".join("CASE WHEN regexp_matches(t, '{}') THEN '{}' END".format(("" if cased else "(?i)") + p.replace("'", "''"), name) for name, p, cased in L.PRIVACY_RULES)
PRIVACY = f"WITH p AS (SELECT doc_id, coalesce(text, '') || ' ' || (CASE doc_id % 9 {' '.join(f'WHEN {i} THEN {v}' for i, v in enumerate(_PLANTED))} END) AS t FROM documents) SELECT doc_id, rule FROM (SELECT doc_id, unnest([{_RULE_SQL}]) AS rule FROM p) WHERE rule IS NOT NULL"


def blobs(spark, sf):
    names = F.element_at(F.array(*map(F.lit, (".env", "a/b.py", "keys/x.PEM", "c\\id_rsa", "notes.txt"))), (F.pmod("page_id", F.lit(5)) + 1).cast("int"))
    rows = table(spark, sf, "pages").select(F.sha2("html", 256).alias("oid"), F.array(names).alias("paths"), F.octet_length("html").cast("long").alias("size"), F.encode("html", "UTF-8").alias("data"))
    return U.history_findings(rows).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


BLOBS = "WITH b AS (SELECT DISTINCT substr(sha256(html), 1, 12) AS oid, page_id % 5 AS k, length(html) AS size FROM pages) SELECT CASE WHEN size > 10000 THEN 'oversized-blob' ELSE 'sensitive-filename' END AS rule, count(*) AS n FROM b WHERE size > 10000 OR k IN (0, 2, 3) GROUP BY 1"


def paths_by_blob(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("oid"), F.concat(F.lit("p/"), F.col("l_suppkey").cast("string")).alias("path"))
    return U.paths_by_blob(rows).select("oid", F.array_join("paths", ",").alias("paths"))


PATHS = "SELECT l_partkey AS oid, string_agg(DISTINCT 'p/' || l_suppkey, ',' ORDER BY 'p/' || l_suppkey) AS paths FROM lineitem GROUP BY l_partkey"


def cases(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), "o_orderkey", F.col("o_orderpriority").alias("text"), F.when(F.pmod("o_custkey", F.lit(3)) == 0, F.col("o_orderstatus")).otherwise("D").alias("diagnosis"), F.col("o_custkey").alias("source"))
    out = D.group_cases(rows, "case_id", "o_orderkey", "text", "diagnosis", "source")
    return out.select("case_id", "view_count", "evidence", F.array_join(F.col("view_order").cast("array<string>"), ",").alias("view_order"), "consistent")


CASES = """WITH v AS (SELECT o_custkey AS case_id, o_orderkey, o_orderpriority AS text, CASE WHEN o_custkey % 3 = 0 THEN o_orderstatus ELSE 'D' END AS diagnosis, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)
SELECT case_id, count(*) AS view_count, string_agg('证据' || k || '：' || text, chr(10) ORDER BY k) AS evidence, string_agg(o_orderkey::VARCHAR, ',' ORDER BY k) AS view_order, count(DISTINCT diagnosis) = 1 AS consistent FROM v GROUP BY case_id"""


def group_sizes(spark, sf):
    return A.group_sizes(table(spark, sf, "orders"), "o_custkey")


GROUP_SIZES = "SELECT size, count(*) AS groups FROM (SELECT count(*) AS size FROM orders GROUP BY o_custkey) GROUP BY size"


def contiguous(spark, sf):
    return D.contiguous(table(spark, sf, "documents"), "doc_id")


CONTIGUOUS = "SELECT min(doc_id) = 0 AND max(doc_id) = count(*) - 1 AND count(DISTINCT doc_id) = count(*) AS contiguous FROM documents"


def unmatched(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return J.unmatched(docs, labels, ["doc_id"])


UNMATCHED = "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'right' ELSE 'left' END AS side FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL"


def complete(spark, sf):
    docs, labels = table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels")
    return J.complete_join(J.present_in(docs, labels, ["doc_id"]), labels, ["doc_id"]).select("doc_id", "source", "quality")


COMPLETE = "SELECT doc_id, source, quality FROM documents JOIN labels USING (doc_id)"


def last_wins(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_brand")
    lines = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), "l_quantity")
    return J.last_wins_join(parts, lines, "p_partkey", "at").select("p_partkey", "p_brand", "at", "l_quantity")


LAST_WINS = "SELECT p_partkey, p_brand, max(l_orderkey * 10 + l_linenumber) AS at, arg_max(l_quantity, l_orderkey * 10 + l_linenumber) AS l_quantity FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL"


def references(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(F.pmod("o_orderkey", F.lit(2)) == 0, F.floor(F.col("o_orderkey") / 2).cast("string")).alias("image"))
    rows = rows.withColumn("image", F.when(F.pmod("o_orderkey", F.lit(2)) == 0, F.col("image")).otherwise("img"))
    return J.resolve_reference(rows, "o_orderkey", "image", "resolved").select("o_orderkey", "resolved")


REFERENCES = "WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey // 2)::VARCHAR ELSE 'img' END AS image FROM orders) SELECT a.o_orderkey, CASE WHEN regexp_matches(a.image, '^[0-9]+$') THEN b.image ELSE a.image END AS resolved FROM r a LEFT JOIN r b ON CASE WHEN regexp_matches(a.image, '^[0-9]+$') THEN a.image::BIGINT END = b.o_orderkey"


def terms(spark, sf):
    return J.matching_terms(table(spark, sf, "documents").select("doc_id", "text"), "text", spark.createDataFrame([(t,) for t in ("license", "the", "idiot", "und ")], "term string")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


TERMS = "SELECT term, count(*) AS n FROM documents, (SELECT unnest(['license', 'the', 'idiot', 'und ']) AS term) WHERE contains(lower(text), term) GROUP BY term"


def latest(spark, sf):
    log = table(spark, sf, "events").select(F.col("user_id").alias("case_index"), F.pmod("event_id", F.lit(4)).alias("rank"), F.col("event_id").alias("line"), "event_type", "value")
    return ST.latest(log, "case_index", ["rank", "line"])


LATEST = "SELECT case_index, rank, line, event_type, value FROM (SELECT user_id AS case_index, event_id % 4 AS rank, event_id AS line, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 4 DESC, event_id DESC) AS k FROM events) WHERE k = 1"


def pending(spark, sf):
    cases_ = table(spark, sf, "customer").select(F.col("c_custkey").alias("case_index"))
    log = table(spark, sf, "orders").select(F.col("o_custkey").alias("case_index"), F.when(F.col("o_orderstatus") == "F", "failed").alias("error"), F.col("o_orderpriority").alias("prediction"))
    return ST.pending(cases_, log)


PENDING = "SELECT c_custkey AS case_index FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'F')"


def shards(spark, sf):
    docs = table(spark, sf, "documents")
    return ST.shard(docs, "doc_id", 4, 1).select("doc_id")


def completeness(spark, sf):
    expected = table(spark, sf, "documents").select(F.col("doc_id").alias("case_index"))
    got = table(spark, sf, "labels").select((F.col("doc_id") + 1).alias("case_index"), F.when(F.col("quality") == 1, F.lit("x")).otherwise("").alias("prediction"), F.when(F.col("toxic") == 1, "bad").alias("error"))
    return Q.missing_indexes(expected, got)


COMPLETENESS = "SELECT coalesce(e.doc_id, p.k) AS case_index, CASE WHEN p.k IS NULL THEN 'missing' WHEN e.doc_id IS NULL THEN 'unexpected' WHEN toxic = 1 THEN 'errored' ELSE 'empty' END AS problem FROM documents e FULL JOIN (SELECT doc_id + 1 AS k, quality, toxic FROM labels) p ON p.k = e.doc_id WHERE p.k IS NULL OR e.doc_id IS NULL OR toxic = 1 OR quality = 0"


def assertions(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return Q.assert_none({"empty_text": docs.where("trim(text) = ''"), "label_without_document": J.absent_from(labels, docs, ["doc_id"]), "wrong_length": docs.where("n_chars <> length(text)")})


ASSERTIONS = "SELECT 'empty_text' AS rule, count(*) AS violations FROM documents WHERE trim(text) = '' UNION ALL SELECT 'label_without_document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'wrong_length', count(*) FROM documents WHERE n_chars <> length(text)"


def adapters(spark, sf):
    keys = table(spark, sf, "part").select((F.col("p_size") % 5).alias("run"), F.col("p_type").alias("key"))
    return Q.adapter_components(keys, {"steel": ["STEEL"], "large": ["LARGE", "JUMBO"]})


ADAPTERS = "SELECT p_size % 5 AS run, bool_or(contains(p_type, 'STEEL')) AS steel, bool_or(contains(p_type, 'LARGE') OR contains(p_type, 'JUMBO')) AS large FROM part GROUP BY 1"


def configs(spark, sf):
    rows = table(spark, sf, "nation").select(F.concat(F.lit("c"), F.pmod("n_nationkey", F.lit(3)).cast("string")).alias("file"), F.concat(F.lit("k"), F.floor(F.col("n_nationkey") / 3).cast("string")).alias("key"), F.pmod(F.col("n_nationkey") * 7, F.lit(2)).cast("string").alias("value"))
    return Q.config_contrast(rows, "c0", ["k0", "k1"], {"c1": ["k2"], "c2": ["k3"]})


CONFIGS = """WITH s AS (SELECT 'c' || n_nationkey % 3 AS file, 'k' || n_nationkey // 3 AS key, (n_nationkey * 7 % 2)::VARCHAR AS value FROM nation), g AS (SELECT f.file, k.key, s.value, b.value AS base FROM (SELECT DISTINCT file FROM s WHERE file <> 'c0') f CROSS JOIN (SELECT DISTINCT key FROM s) k LEFT JOIN s ON s.file = f.file AND s.key = k.key LEFT JOIN s b ON b.file = 'c0' AND b.key = k.key),
p AS (SELECT file, key, CASE WHEN value IS DISTINCT FROM base AND key IN ('k0', 'k1') THEN 'controlled_differs' WHEN value IS DISTINCT FROM base AND NOT ((file = 'c1' AND key = 'k2') OR (file = 'c2' AND key = 'k3')) THEN 'unexpected_difference' WHEN value IS NOT DISTINCT FROM base AND ((file = 'c1' AND key = 'k2') OR (file = 'c2' AND key = 'k3')) THEN 'missing_difference' END AS problem FROM g)
SELECT * FROM p WHERE problem IS NOT NULL"""

QUERIES = {
    "dq_rules": (rules, RULES),
    "dq_reason_counts": (reason_counts, REASON_COUNTS),
    "dq_clean_split": (clean, CLEAN),
    "dq_completeness": (completeness, COMPLETENESS),
    "dq_assertions": (assertions, ASSERTIONS),
    "dq_adapter_components": (adapters, ADAPTERS),
    "dq_config_contrast": (configs, CONFIGS),
    "dd_keep_first": (keep_first, KEEP_FIRST),
    "dd_two_keys": (keep_first_of_two, None),
    "dd_one_to_one": (one_to_one, None),
    "ag_overlap": (leakage, LEAKAGE),
    "ag_shared_values": (shared_sources, "SELECT DISTINCT source FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT source FROM documents WHERE doc_id % 2 = 1"),
    "ag_duplicates": (duplicate_reports, DUPLICATES),
    "ag_digest": (digest, DIGEST),
    "ag_group_sizes": (group_sizes, GROUP_SIZES),
    "jn_anti_semi": (without_shared, WITHOUT_SHARED),
    "jn_unmatched": (unmatched, UNMATCHED),
    "jn_complete": (complete, COMPLETE),
    "jn_last_wins": (last_wins, LAST_WINS),
    "jn_reference": (references, REFERENCES),
    "jn_terms": (terms, TERMS),
    "gr_cases": (cases, CASES),
    "wn_contiguous": (contiguous, CONTIGUOUS),
    "pv_patterns": (privacy, PRIVACY),
    "pv_blobs": (blobs, BLOBS),
    "pv_paths": (paths_by_blob, PATHS),
    "st_latest": (latest, LATEST),
    "st_pending": (pending, PENDING),
    "st_shard": (shards, "SELECT doc_id FROM documents WHERE doc_id % 4 = 1"),
}
