"""Queries of reference and prediction metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from verisheaf.functions import extract as X
from verisheaf.functions import lexicon as L
from verisheaf.functions import pairs as P
from verisheaf.functions import text as T
from verisheaf.operators import joins as J
from verisheaf.operators import ngrams as N
from verisheaf.operators import scoring as C
from verisheaf.operators import stats as A
from verisheaf.plans import tables as S
from verisheaf.plans.tables import PAIRS, REPORTS, reports, table, tokenized, turn_pairs


def _rounded(df, *keep):
    return df.select(*keep, *[F.round(c, 9).alias(c) for c in df.columns if c not in keep])


def rouge1_by_turn(spark, sf):
    pairs = tokenized(turn_pairs(spark, sf))
    scores = N.rouge_n(pairs, (1,)).join(pairs.select("pair_id", "turn"), "pair_id")
    return scores.groupBy("turn").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("precision"), 9).alias("precision"), F.round(F.avg("recall"), 9).alias("recall"), F.round(F.avg("f1"), 9).alias("f1"))


def _gram_sql(orders: str = "1, 2", table_: str = "t") -> str:
    """Common table expressions from t(pair_id, turn, r, p): grams with counts of either side."""
    return f"""e AS (
  SELECT pair_id, n, side, array_to_string(w[i:i + n - 1], chr(1)) AS gram
  FROM (SELECT pair_id, n, side, w, unnest(range(1, len(w) - n + 2)) AS i
        FROM (SELECT pair_id, 0 AS side, r AS w FROM {table_} UNION ALL SELECT pair_id, 1, p FROM {table_}), (SELECT unnest([{orders}]) AS n))
), g AS (
  SELECT pair_id, n, gram, count(*) FILTER (side = 0) AS rc, count(*) FILTER (side = 1) AS pc FROM e GROUP BY ALL
)"""


_T = f"{PAIRS}, t AS (SELECT pair_id, turn, {S.sql_tokens('reference')} AS r, {S.sql_tokens('prediction')} AS p FROM pairs)"
_SUMS = "o AS (SELECT pair_id, n, sum(least(rc, pc)) AS hits, sum(pc) AS total, sum(rc) AS ref FROM g GROUP BY ALL)"
ROUGE1 = f"""WITH {_T}, {_gram_sql('1')}, {_SUMS}, m AS (
  SELECT t.pair_id, t.turn, {S.prf_sql('coalesce(hits, 0)', 'coalesce(total, 0)', 'coalesce(ref, 0)')} FROM t LEFT JOIN o USING (pair_id))
SELECT turn, count(*) AS n, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, round(avg(f1), 9) AS f1 FROM m GROUP BY turn"""


def rouge_1_2(spark, sf):
    return _rounded(N.rouge_n(tokenized(turn_pairs(spark, sf))), "pair_id", "n")


ROUGE12 = f"""WITH {_T}, {_gram_sql()}, {_SUMS} SELECT t.pair_id, k.n, {S.prf_sql('coalesce(hits, 0)', 'coalesce(total, 0)', 'coalesce(ref, 0)')}
FROM t CROSS JOIN (SELECT unnest([1, 2]) AS n) k LEFT JOIN o ON o.pair_id = t.pair_id AND o.n = k.n"""


def meteor(spark, sf):
    return _rounded(N.meteor_exact(tokenized(turn_pairs(spark, sf))), "pair_id")


METEOR = f"""WITH {_T}, r AS (SELECT pair_id, w, i, row_number() OVER (PARTITION BY pair_id, w ORDER BY i) AS k FROM (SELECT pair_id, unnest(r) AS w, unnest(range(len(r))) AS i FROM t)),
q AS (SELECT pair_id, w, i, row_number() OVER (PARTITION BY pair_id, w ORDER BY i) AS k FROM (SELECT pair_id, unnest(p) AS w, unnest(range(len(p))) AS i FROM t)),
a AS (SELECT pair_id, r.i AS ri, lag(r.i) OVER (PARTITION BY pair_id ORDER BY q.i) AS last FROM q JOIN r USING (pair_id, w, k)),
s AS (SELECT pair_id, count(*) AS m, count(*) FILTER (last IS NULL OR ri <> last + 1) AS c FROM a GROUP BY pair_id)
SELECT t.pair_id, round(CASE WHEN len(r) = 0 AND len(p) = 0 THEN 1.0 WHEN m IS NULL THEN 0.0
  ELSE 10 * (m / len(p)::DOUBLE) * (m / len(r)::DOUBLE) / ((m / len(r)::DOUBLE) + 9 * (m / len(p)::DOUBLE)) * (1 - 0.5 * pow(c / m::DOUBLE, 3)) END::DOUBLE, 9) AS meteor_exact
FROM t LEFT JOIN s USING (pair_id)"""


def bleu(spark, sf):
    return _rounded(N.sentence_bleu(tokenized(turn_pairs(spark, sf))), "pair_id")


_LOG = " + ".join(f"ln((CASE WHEN coalesce(h{n}, 0) > 0 THEN h{n}::DOUBLE ELSE 0.1 END) / greatest(coalesce(t{n}, 0), 1))" for n in (1, 2, 3, 4))
_WIDE = ", ".join(f"sum(hits) FILTER (n = {n}) AS h{n}, sum(total) FILTER (n = {n}) AS t{n}" for n in (1, 2, 3, 4))
_SHORT = lambda p, r: f"(CASE WHEN {p} > {r} THEN 1.0::DOUBLE ELSE exp(1 - {r}::DOUBLE / nullif({p}, 0)) END)"
BLEU = f"""WITH {_T}, {_gram_sql('1, 2, 3, 4')}, {_SUMS}, w AS (SELECT pair_id, {_WIDE} FROM o GROUP BY pair_id)
SELECT t.pair_id, round(CASE WHEN len(p) = 0 OR coalesce(h1, 0) = 0 THEN 0.0::DOUBLE ELSE {_SHORT('len(p)', 'len(r)')} * exp(({_LOG}) / 4) END, 9) AS bleu4 FROM t LEFT JOIN w USING (pair_id)"""


def corpus_bleu(spark, sf):
    return _rounded(N.corpus_bleu(tokenized(turn_pairs(spark, sf))))


_LOGS = [f"ln((CASE WHEN coalesce(h{n}, 0) > 0 THEN h{n}::DOUBLE ELSE 0.1 END) / greatest(coalesce(t{n}, 0), 1))" for n in (1, 2, 3, 4)]
CORPUS_BLEU = f"""WITH {_T}, {_gram_sql('1, 2, 3, 4')}, {_SUMS}, w AS (SELECT {_WIDE} FROM o), l AS (SELECT sum(len(r)) AS nr, sum(len(p)) AS np FROM t)
SELECT {', '.join(f"round(CASE WHEN coalesce(h1, 0) = 0 THEN 0.0::DOUBLE ELSE {_SHORT('np', 'nr')} * exp(({' + '.join(_LOGS[:n])}) / {n}) END, 9) AS bleu{n}" for n in (1, 2, 3, 4))} FROM w, l"""


def chrf(spark, sf):
    t = reports(spark, sf)
    pairs = t.select(F.col("report_id").alias("pair_id"), T.char_tokens(F.col("reference")).alias("ref_chars"), T.char_tokens(F.col("prediction")).alias("pred_chars"))
    return _rounded(N.chrf(pairs), "pair_id")


_C = f"{REPORTS}, t AS (SELECT report_id AS pair_id, 0 AS turn, string_split({S.sql_compact('reference')}, '') AS r, string_split({S.sql_compact('prediction')}, '') AS p FROM reports)"
CHRF = f"""WITH {_C}, {_gram_sql('1, 2, 3, 4, 5, 6')}, {_SUMS}, s AS (
  SELECT pair_id, coalesce(hits / nullif(total, 0)::DOUBLE, 0) AS pr, coalesce(hits / nullif(ref, 0)::DOUBLE, 0) AS re FROM o), f AS (
  SELECT pair_id, avg(coalesce(10 * pr * re / nullif(9 * pr + re, 0), 0)) AS chrf FROM s GROUP BY pair_id)
SELECT t.pair_id, round(coalesce(chrf, 0)::DOUBLE, 9) AS chrf FROM t LEFT JOIN f USING (pair_id)"""


def cider(spark, sf):
    return _rounded(N.cider_lite(tokenized(turn_pairs(spark, sf))), "pair_id")


CIDER = f"""WITH {_T}, {_gram_sql('1, 2, 3, 4')}, d AS (SELECT n, gram, count(*) AS df FROM g WHERE rc > 0 GROUP BY ALL),
i AS (SELECT g.*, ln(((SELECT count(*) FROM t) + 1)::DOUBLE / (coalesce(df, 0) + 1)) + 1 AS idf FROM g LEFT JOIN d USING (n, gram)),
s AS (SELECT pair_id, n, sum(rc * idf * pc * idf) AS dot, sqrt(sum(rc * idf * rc * idf)) AS ra, sqrt(sum(pc * idf * pc * idf)) AS rb FROM i GROUP BY ALL),
f AS (SELECT pair_id, sum(coalesce(dot / nullif(ra * rb, 0), 0)) * 2.5 AS cider FROM s GROUP BY pair_id)
SELECT t.pair_id, round(coalesce(cider, 0)::DOUBLE, 9) AS cider FROM t LEFT JOIN f USING (pair_id)"""


def repetition(spark, sf):
    return _rounded(tokenized(turn_pairs(spark, sf)).select("pair_id", N.repetition(F.col("pred_tokens")).alias("repetition")), "pair_id")


REPETITION = f"""WITH {_T}, {_gram_sql('3')}, s AS (SELECT pair_id, count(*) FILTER (pc > 0) AS d, sum(pc) AS n FROM g GROUP BY pair_id)
SELECT t.pair_id, round(coalesce(CASE WHEN n > 0 THEN 1 - d / n::DOUBLE END, 0.0)::DOUBLE, 9) AS repetition FROM t LEFT JOIN s USING (pair_id)"""


def char_bags(spark, sf):
    out = reports(spark, sf).select("report_id", P.char_prf(F.col("reference"), F.col("prediction")).alias("m"))
    return _rounded(out.select("report_id", "m.*"), "report_id")


CHAR_BAGS = f"""WITH {REPORTS}, t AS (SELECT report_id AS pair_id, 0 AS turn, string_split({S.sql_squeezed('reference')}, '') AS r, string_split({S.sql_squeezed('prediction')}, '') AS p FROM reports), {_gram_sql('1')}, {_SUMS}
SELECT pair_id AS report_id, {S.prf_sql('hits', 'total', 'ref')} FROM o"""


def lcs_short(spark, sf):
    """MT5, MT6 and MT7 over whole texts of generated reports."""
    out = reports(spark, sf).select("report_id", P.rouge_l_of_texts(F.col("reference"), F.col("prediction")).alias("x"))
    return _rounded(out.select("report_id", "x.capped_f1", "x.m.*"), "report_id")


def rouge_l_turns(spark, sf):
    out = tokenized(turn_pairs(spark, sf)).select("pair_id", P.rouge_l(F.col("ref_tokens"), F.col("pred_tokens")).alias("m"))
    return _rounded(out.select("pair_id", "m.*"), "pair_id")


ROUGE_L = f"""WITH RECURSIVE {_T}, l AS (
  SELECT pair_id, r, p, 0::BIGINT AS i, list_transform(range(0, len(p) + 1), lambda z: 0::BIGINT) AS row FROM t
  UNION ALL
  SELECT pair_id, r, p, i + 1, list_reduce(range(1, len(p) + 1), lambda acc, j: list_append(acc, CASE WHEN p[j] = r[i + 1] THEN row[j] + 1 ELSE greatest(row[j + 1], acc[-1]) END), [0::BIGINT]) FROM l WHERE i < len(r)
), f AS (SELECT pair_id, r, p, row[-1] AS n FROM l WHERE i = len(r))
SELECT pair_id, {S.prf_sql('n', 'len(p)', 'len(r)')} FROM f"""


# --- facts -------------------------------------------------------------------------------------------------------


def _facts(spark, sf):
    both = reports(spark, sf).select("report_id", "case_id", "reference", "prediction", X.entities(F.col("reference")).alias("re"), X.entities(F.col("prediction")).alias("pe"))
    return both


def entities(spark, sf):
    out = _facts(spark, sf).select("report_id", F.explode("re").alias("e"))
    return out.select("report_id", "e.*")


def _entity_sql(side: str) -> str:
    """(report_id, entity, status, severity, uncertain, term, context) of one side, a row per entity."""
    terms = ", ".join(f"('{name}', {rank}, '{t}')" for name, ts in L.ENTITY_TERMS.items() for rank, t in enumerate(sorted(ts, key=len, reverse=True)))
    any_of = lambda words, x: " OR ".join(f"contains({x}, '{w}')" for w in words)
    negated = " OR ".join(f"contains(before, '{w}') OR contains(context, '{w}' || term)" for w in L.NEGATIONS)
    severity = "CASE " + " ".join(f"WHEN contains(context, '{s}') THEN '{s}'" for s in L.SEVERITIES) + " END"
    return rf"""n AS (SELECT report_id, {S.sql_normalize(side)} AS x FROM reports),
m AS (SELECT report_id, x, entity, term, rank, strpos(lower(x), lower(term)) - 1 AS place FROM n, (VALUES {terms}) AS v(entity, rank, term) WHERE contains(lower(x), lower(term))),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY report_id, entity ORDER BY rank) = 1),
c AS (SELECT report_id, entity, term, regexp_extract(substr(x, greatest(place - 14, 0) + 1, place - greatest(place - 14, 0)), '[^\n。；]*\z') || substr(x, place + 1, length(term)) || regexp_extract(substr(x, place + length(term) + 1, 14), '^[^\n。；]*') AS context,
        substr(x, greatest(place - 10, 0) + 1, least(place, 10)) AS before FROM b),
ent AS (SELECT report_id, entity, CASE WHEN {negated} THEN 'absent' ELSE 'present' END AS status, {severity} AS severity, ({any_of(L.UNCERTAINTY, 'context')}) AS uncertain, term, context FROM c)"""


ENTITIES = f"WITH {REPORTS}, {_entity_sql('reference')} SELECT report_id, entity, status, severity, uncertain, term, context FROM ent"


def _two_sides() -> str:
    a, b = _entity_sql("reference"), _entity_sql("prediction")
    for name in ("n", "m", "b", "c", "ent"):
        b = b.replace(f"{name} AS (SELECT", f"{name}2 AS (SELECT").replace(f"FROM {name},", f"FROM {name}2,").replace(f"FROM {name})", f"FROM {name}2)").replace(f"FROM {name} ", f"FROM {name}2 ")
    return f"{a}, {b}"


def fact_scores(spark, sf):
    both = _facts(spark, sf)
    out = both.select("report_id", X.facts(F.col("re"), F.col("reference")).alias("rf"), X.facts(F.col("pe"), F.col("prediction")).alias("pf"), P.contradictions(F.col("re"), F.col("pe")).alias("c"), P.severity_agreement(F.col("re"), F.col("pe")).alias("s"))
    return _rounded(out.select("report_id", P.set_prf(F.col("rf"), F.col("pf")).alias("m"), "c", "s").select("report_id", "m.*", "c.contradictions", "c.compared", F.col("s.agreed").alias("severity_agreed"), F.col("s.compared").alias("severity_compared")), "report_id", "contradictions", "compared", "severity_agreed", "severity_compared")


_TERMS = lambda x: rf"(CASE WHEN {x} = '__MISSING__' THEN [] ELSE list_distinct(list_filter(regexp_split_to_array({x}, '并|伴|合并|及|/|\+'), lambda z: z <> '')) END)"
FACTS = f"""WITH {REPORTS}, {_two_sides()},
k AS (SELECT report_id, {S.sql_canonical('reference')} AS rc, {S.sql_canonical('prediction')} AS pc FROM reports),
rf AS (SELECT report_id, 'entity:' || entity || ':' || status AS f FROM ent UNION SELECT report_id, 'diagnosis:' || unnest({_TERMS('rc')}) FROM k),
pf AS (SELECT report_id, 'entity:' || entity || ':' || status AS f FROM ent2 UNION SELECT report_id, 'diagnosis:' || unnest({_TERMS('pc')}) FROM k),
x AS (SELECT report_id, count(a.f) AS nr, count(b.f) AS np, count(*) FILTER (a.f IS NOT NULL AND b.f IS NOT NULL) AS hits FROM rf a FULL JOIN pf b USING (report_id, f) GROUP BY report_id),
y AS (SELECT report_id, count(*) FILTER (a.status <> b.status) AS contradictions, count(*) AS compared, count(*) FILTER (a.severity = b.severity) AS sa, count(*) FILTER (a.severity IS NOT NULL AND b.severity IS NOT NULL) AS sc FROM ent a FULL JOIN ent2 b USING (report_id, entity) GROUP BY report_id)
SELECT r.report_id, {S.prf_sql('coalesce(hits, 0)', 'coalesce(np, 0)', 'coalesce(nr, 0)')}, coalesce(contradictions, 0) AS contradictions, coalesce(compared, 0) AS compared, coalesce(sa, 0) AS severity_agreed, coalesce(sc, 0) AS severity_compared
FROM reports r LEFT JOIN x USING (report_id) LEFT JOIN y USING (report_id)"""


def relations(spark, sf):
    out = _facts(spark, sf).select(F.explode(X.relations(F.col("re"))).alias("relation"))
    return out.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


RELATIONS = f"""WITH {REPORTS}, {_entity_sql('reference')}, r AS (SELECT entity || '|status=' || status AS relation FROM ent UNION ALL SELECT entity || '|severity=' || severity FROM ent WHERE severity IS NOT NULL UNION ALL SELECT entity || '|uncertain=true' FROM ent WHERE uncertain)
SELECT relation, count(*) AS n FROM r GROUP BY relation"""


def numbers(spark, sf):
    """EX7 and MT17."""
    out = reports(spark, sf).select("report_id", X.compare_numbers(F.col("reference"), F.col("prediction")).alias("m"))
    return out.select("report_id", *[f"m.{c}" for c in ("reference_count", "prediction_count", "matched_count", "exact_count", "within5_count", "within10_count", "unsupported_count", "omitted_count")])


def other_views(spark, sf):
    """MT23: facts that a prediction takes from the other views of its case."""
    both = _facts(spark, sf)
    out = both.select("report_id", "case_id", X.entity_names(F.col("re")).alias("rf"), X.entity_names(F.col("pe")).alias("pf"))
    found = J.others_in_case(out, "case_id", "report_id", "rf", "others")
    share = F.size(F.array_intersect(F.array_except("pf", "rf"), "others")) / F.greatest(F.size("pf"), F.lit(1))
    return _rounded(found.select("report_id", share.alias("supplement")), "report_id")


OTHER_VIEWS = f"""WITH {REPORTS}, {_two_sides()}, h AS (SELECT DISTINCT r.case_id, r.report_id, entity FROM ent JOIN reports r USING (report_id)),
p AS (SELECT r.case_id, e.report_id, e.entity, exists(SELECT 1 FROM h WHERE h.report_id = e.report_id AND h.entity = e.entity) AS own, exists(SELECT 1 FROM h WHERE h.case_id = r.case_id AND h.report_id <> e.report_id AND h.entity = e.entity) AS others FROM ent2 e JOIN reports r USING (report_id)),
s AS (SELECT report_id, count(*) FILTER (NOT own AND others) / count(*)::DOUBLE AS v FROM p GROUP BY report_id)
SELECT report_id, round(coalesce(v, 0.0), 9) AS supplement FROM reports LEFT JOIN s USING (report_id)"""


def concept_table(spark, sf):
    rows = reports(spark, sf).select("report_id", T.diagnosis_concepts(F.col("reference")).alias("r"), T.diagnosis_concepts(F.col("prediction")).alias("p"))
    return _rounded(A.concept_scores(rows, "report_id", "r", "p"), "concept", "hits", "predicted", "support")


_CONCEPT = lambda x: f"lower(regexp_replace({S.sql_extract_diagnosis(x)}, '{S.WS}+', '', 'g'))"
_CONCEPT_ROWS = ", ".join(f"('{name}', '{t.lower()}')" for name, ts in L.CONCEPTS.items() for t in ts)
CONCEPT_TABLE = f"""WITH {REPORTS}, v AS (SELECT report_id, {_CONCEPT('reference')} AS r, {_CONCEPT('prediction')} AS p FROM reports), c AS (SELECT * FROM (VALUES {_CONCEPT_ROWS}) AS k(concept, term)),
b AS (SELECT report_id, concept, bool_or(contains(r, term)) AS r, bool_or(contains(p, term)) AS p FROM v, c GROUP BY ALL),
s AS (SELECT concept, count(*) FILTER (r AND p) AS hits, count(*) FILTER (p) AS predicted, count(*) FILTER (r) AS support FROM b WHERE r OR p GROUP BY concept)
SELECT concept, hits, predicted, support, round(coalesce(hits / nullif(predicted, 0)::DOUBLE, 0), 9) AS precision, round(coalesce(hits / nullif(support, 0)::DOUBLE, 0), 9) AS recall, round(coalesce(2 * hits / nullif(predicted + support, 0)::DOUBLE, 0), 9) AS f1 FROM s"""


def cosines(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(n, "vec_id").select("vec_id", F.round(P.cosine(F.col("embedding"), F.col("next")), 6).alias("similarity"))


COSINES = "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def entropies(spark, sf):
    c = F.col("n_chars") / (F.col("n_chars") + F.lit(1000.0))
    return table(spark, sf, "documents").select("doc_id", F.round(P.entropy_bits(c), 9).alias("entropy"))


ENTROPIES = "SELECT doc_id, round(-(p * log2(p) + (1 - p) * log2(1 - p)), 9) AS entropy FROM (SELECT doc_id, least(greatest(n_chars / (n_chars + 1000.0::DOUBLE), 1e-6), 1 - 1e-6) AS p FROM documents)"


def case_metrics(spark, sf):
    """MT18-MT22: coverage of labels, composite quality, exact diagnosis, length ratio and exact match."""
    both = _facts(spark, sf)
    r, p = F.col("reference"), F.col("prediction")
    facts = lambda e, t: X.facts(F.col(e), t)
    out = both.select("report_id", P.set_prf(facts("re", r), facts("pe", p)).alias("f"), P.set_prf(X.key_facts(F.col("re"), r), X.key_facts(F.col("pe"), p)).alias("k"), P.contradictions(F.col("re"), F.col("pe")).alias("c"),
        P.label_coverage(T.image_labels(r), T.image_labels(p)).alias("coverage"), P.exact_match(T.canonical_diagnosis(r), T.canonical_diagnosis(p)).alias("same_diagnosis"), P.length_ratio(T.compact(r), T.compact(p)).alias("length_ratio"), P.exact_match(T.compact(r), T.compact(p)).alias("same_text"))
    discord = F.coalesce(F.try_divide("c.contradictions", "c.compared"), F.lit(0.0))
    score = P.quality_score(F.col("f.recall"), F.col("k.recall"), 1 - F.col("f.precision"), discord)
    return out.select("report_id", F.round("coverage", 9).alias("coverage"), "same_diagnosis", F.round("length_ratio", 9).alias("length_ratio"), "same_text", F.round(score, 9).alias("quality"))


_LABELS = lambda x: f"list_distinct(regexp_extract_all({S.sql_normalize(x)}, '(?:左上|右上|左下|右下|上|下)图'))"
_KEY = "entity IN ({})".format(", ".join(f"'{e}'" for e in L.KEY_ENTITIES))
_STATED = lambda name, ent, c, only: f"{name} AS (SELECT report_id, 'entity:' || entity || ':' || status AS f FROM {ent} WHERE {only} UNION SELECT report_id, 'diagnosis:' || unnest({_TERMS(c)}) FROM k)"
_MET = lambda name, r, p: f"{name} AS (SELECT report_id, count(a.f) AS nr, count(b.f) AS np, count(*) FILTER (a.f IS NOT NULL AND b.f IS NOT NULL) AS hits FROM {r} a FULL JOIN {p} b USING (report_id, f) GROUP BY report_id)"
_SHARE = lambda t, of, other: f"(CASE WHEN coalesce({t}.{of}, 0) > 0 THEN {t}.hits::DOUBLE / {t}.{of} WHEN coalesce({t}.{other}, 0) = 0 THEN 1.0 ELSE 0.0 END)"
CASE_METRICS = f"""WITH {REPORTS}, {_two_sides()},
k AS (SELECT report_id, {S.sql_canonical('reference')} AS rc, {S.sql_canonical('prediction')} AS pc, {S.sql_compact('reference')} AS rt, {S.sql_compact('prediction')} AS pt, {_LABELS('reference')} AS rl, {_LABELS('prediction')} AS pl FROM reports),
{_STATED('rf', 'ent', 'rc', 'true')}, {_STATED('pf', 'ent2', 'pc', 'true')}, {_STATED('rk', 'ent', 'rc', _KEY)}, {_STATED('pk', 'ent2', 'pc', _KEY)},
{_MET('x', 'rf', 'pf')}, {_MET('z', 'rk', 'pk')},
y AS (SELECT report_id, count(*) FILTER (a.status <> b.status) / count(*)::DOUBLE AS discord FROM ent a FULL JOIN ent2 b USING (report_id, entity) GROUP BY report_id)
SELECT k.report_id, round(CASE WHEN len(rl) > 0 THEN len(list_intersect(rl, pl))::DOUBLE / len(rl) END, 9) AS coverage, rc = pc AS same_diagnosis,
 round(length(pt)::DOUBLE / greatest(1, length(rt)), 9) AS length_ratio, rt = pt AS same_text,
 round((({_SHARE('x', 'nr', 'np')} + {_SHARE('z', 'nr', 'np')} + {_SHARE('x', 'np', 'nr')} + (1 - coalesce(discord, 0))) / 4)::DOUBLE, 9) AS quality
FROM k LEFT JOIN x USING (report_id) LEFT JOIN z USING (report_id) LEFT JOIN y USING (report_id)"""


def _staged(spark, sf):
    r, p = F.col("reference"), F.col("prediction")
    return reports(spark, sf).select("report_id", T.stage(r).alias("ref_stage"), T.stage(p).alias("pred_stage"), (T.canonical_diagnosis(r) == T.canonical_diagnosis(p)).cast("double").alias("diagnosis_exact"), (T.canonical_diagnosis(r) == "未找到").alias("placeholder_diagnosis"))


def stage_accuracy(spark, sf):
    return _rounded(C.stage_accuracy(_staged(spark, sf)), "comparable")


_STAGE_OF = lambda x: rf"regexp_extract({S.sql_normalize(x)}, '(?i)([ivxⅠⅡⅢⅣ一二三四1-4]+){S.WS}*期', 1)"
_STAGE_NO = lambda x: rf"(CASE WHEN regexp_matches({x}, '^\d+$') THEN CAST({x} AS BIGINT) ELSE CASE lower({x}) {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {v}' for k, v in L.STAGES.items())} END END)"
_STAGED = f"{REPORTS}, s0 AS (SELECT report_id, {_STAGE_OF('reference')} AS a, {_STAGE_OF('prediction')} AS b, {S.sql_canonical('reference')} AS rc, {S.sql_canonical('prediction')} AS pc FROM reports), st AS (SELECT report_id, {_STAGE_NO('a')} AS a, {_STAGE_NO('b')} AS b, rc, pc FROM s0)"
STAGE_ACCURACY = f"WITH {_STAGED} SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS comparable, round(avg((abs(a - b) = 0)::INTEGER), 9) AS exact, round(avg((abs(a - b) <= 1)::INTEGER), 9) AS within_one FROM st"


def placeholder_accuracy(spark, sf):
    return _rounded(C.placeholder_accuracy(_staged(spark, sf)), "n_placeholder")


PLACEHOLDER = f"WITH {_STAGED} SELECT count(*) FILTER (rc = '未找到') AS n_placeholder, round(avg((rc = pc)::INTEGER) FILTER (rc = '未找到'), 9) AS placeholder_accuracy, round(avg((rc = pc)::INTEGER) FILTER (rc <> '未找到'), 9) AS other_accuracy FROM st"


def case_scores(spark, sf):
    """E1: the wide table, over conversations."""
    cases = C.per_case(turn_pairs(spark, sf).withColumnRenamed("pair_id", "case_index"))
    return cases.select("case_index", *[F.round(c, 9).alias(c) for c in ("rouge1_f1", "rouge2_f1", "rougeL_f1", "char_rougeL_f1", "meteor_exact", "bleu4", "chrf", "cider", "facts_f1", "quality", "length_ratio")])


def document(spark, sf):
    log = turn_pairs(spark, sf).withColumnRenamed("pair_id", "case_index").withColumn("latency_sec", F.col("turn") + F.lit(0.5)).withColumn("output_tokens", F.length("prediction")).withColumn("hit_max_new_tokens", F.lit(False)).withColumn("peak_gpu_memory_bytes", F.lit(None).cast("long")).withColumn("error", F.lit(None).cast("string"))
    return C.metrics_document(C.per_case(log), log).select("section", "metric", F.round("value", 9).alias("value"))


QUERIES = {
    "ag_stage_accuracy": (stage_accuracy, STAGE_ACCURACY),
    "ag_placeholder_accuracy": (placeholder_accuracy, PLACEHOLDER),
    "e1_case_scores": (case_scores, None),
    "e1_metrics_document": (document, None),
    "rouge1_by_turn": (rouge1_by_turn, ROUGE1),
    "mt_rouge_1_2": (rouge_1_2, ROUGE12),
    "mt_rouge_l": (rouge_l_turns, ROUGE_L),
    "mt_lcs_reports": (lcs_short, None),
    "mt_meteor": (meteor, METEOR),
    "mt_sentence_bleu": (bleu, BLEU),
    "mt_corpus_bleu": (corpus_bleu, CORPUS_BLEU),
    "mt_chrf": (chrf, CHRF),
    "mt_cider": (cider, CIDER),
    "mt_repetition": (repetition, REPETITION),
    "mt_char_bags": (char_bags, CHAR_BAGS),
    "ex_entities": (entities, ENTITIES),
    "ex_relations": (relations, RELATIONS),
    "mt_facts": (fact_scores, FACTS),
    "mt_numbers": (numbers, None),
    "mt_other_views": (other_views, OTHER_VIEWS),
    "mt_case_metrics": (case_metrics, CASE_METRICS),
    "ag_concepts": (concept_table, CONCEPT_TABLE),
    "mt_cosine": (cosines, COSINES),
    "mt_entropy": (entropies, ENTROPIES),
}
