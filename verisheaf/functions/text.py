"""Text scalars as Column expressions. Patterns are Java's; (?U) makes white space Unicode-aware and (?iu) folds case so.
Rules that take many passes over a text are in kernels.py and run in Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verisheaf.functions import kernels as K
from verisheaf.functions import lexicon as L

CJK = r"[\u4e00-\u9fff]"
TOKEN = r"[\u4e00-\u9fff]|[A-Za-z]+|\d+(?:\.\d+)?|[^\s]"
#: Position names as a family, and the ones of the view rules in their order.
POSITION = "(?:(?:左|中|右)(?:上|中|下)|上|下)图"
VIEW_POSITION = "|".join(L.POSITIONS["views"])


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sub(text: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(text, pattern, to)


def strip(text: Column) -> Column:
    """Without white space at either end, as Unicode has it."""
    return sub(text, r"(?U)^\s+|\s+\z")


def unix_lines(text: Column) -> Column:
    return sub(F.coalesce(text.cast("string"), F.lit("")), r"\r\n?", "\n")


def normalize(text: Column, strip_positions: bool = False) -> Column:
    """TX1: line feeds, no thoughts, single spaces, at most one empty line; optionally no position names."""
    out = sub(unix_lines(text), r"(?is)<think>.*?</think>")
    if strip_positions:
        out = sub(sub(out, POSITION), r"[（(](?U:\s*)[）)]")
    return strip(sub(sub(out, "[ \t]+", " "), "\n{3,}", "\n\n"))


def normalize_space(text: Column) -> Column:
    """TX2."""
    return strip(sub(sub(unix_lines(text), "[ \t]+", " "), "\n{3,}", "\n\n"))


def normalize_lines(text: Column) -> Column:
    """TX3: like TX2, without empty lines."""
    return strip(sub(sub(unix_lines(text), "[ \t]+", " "), "\n{2,}", "\n"))


def squeezed_lower(text: Column) -> Column:
    """TX4: without white space, lower case."""
    return F.lower(sub(F.coalesce(text.cast("string"), F.lit("")), r"(?U)\s+"))


def compact(text: Column, strip_positions: bool = False) -> Column:
    """TX5."""
    if not strip_positions:
        return K.compact_of(text)
    return F.lower(sub(normalize(text, strip_positions), r"(?U)\s+"))


def compact_punctuation(text: Column) -> Column:
    """TX6."""
    return F.lower(sub(normalize_space(text), r"(?U)[\s，,。；;：:、/\\（）()【】\[\]<>《》·—_-]+"))


def canonical_target(text: Column) -> Column:
    """TX7: another set of marks goes."""
    return F.lower(sub(normalize_lines(text), "(?U)[\\s，。；;：:、\\\\（）()【】\\[\\]<>《》“”\"'—-]+"))


def lower_squeezed(text: Column) -> Column:
    """TX8: lower case first."""
    return sub(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"(?U)\s+")


def strip_position_headers(text: Column) -> Column:
    """TX9."""
    out = sub(normalize_space(text), rf"(?mU)^\s*{POSITION}\s*[：:]?\s*")
    out = sub(sub(out, POSITION), r"(?U)[（(]\s*[）)]")
    return strip(sub(sub(out, "\n[ \t]+", "\n"), "\n{2,}", "\n"))


def tokens(text: Column, strip_positions: bool = False) -> Column:
    """TX10."""
    return F.regexp_extract_all(normalize(text, strip_positions), F.lit(TOKEN), F.lit(0))


def char_tokens(text: Column) -> Column:
    """TX11."""
    return F.filter(F.split(compact(text), ""), lambda c: c != "")


def cjk_count(text: Column) -> Column:
    """TX12."""
    return F.regexp_count(text, F.lit(CJK)).cast("long")


def extract_diagnosis(text: Column) -> Column:
    """TX13: what follows the first label on its line, up to the first full stop or semicolon; empty without a label."""
    line = F.regexp_extract(normalize(text), r"(?U)病理诊断\s*[：:]\s*([^\n]*)", 1)
    return strip(sub(strip(line), r"[。；;].*$"))


def diagnosis_line(text: Column) -> Column:
    """TX14: with its punctuation."""
    return strip(F.regexp_extract(normalize_space(text), r"(?U)病理诊断\s*[：:]\s*([^\n]*)", 1))


def diagnosis_tail(text: Column) -> Column:
    """TX14: all that follows, white space collapsed."""
    tail = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?sU)病理诊断\s*[：:]\s*(.*)", 1)
    return strip(sub(tail, r"(?U)\s+", " "))


def diagnosis_or_sentinel(text: Column) -> Column:
    """TX14: __MISSING__ without a label, __EMPTY__ with nothing after it."""
    found = squeezed_lower(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?sU)病理诊断\s*[：:]\s*(.*)", 1))
    missing = ~F.coalesce(text, F.lit("")).rlike(r"(?U)病理诊断\s*[：:]")
    return let(found, lambda x: F.when(missing, "__MISSING__").when(x == "", "__EMPTY__").otherwise(x))


def after_last_label(text: Column) -> Column:
    """TX14: text after the last label."""
    return strip(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?sU)^.*病理诊断\s*[：:]\s*(.*)", 1))


def canonical_diagnosis(text: Column) -> Column:
    """TX15."""
    return K.canonical_of(text)


def diagnosis_terms(text: Column) -> Column:
    """TX16."""
    return K.terms_of(text)


def diagnosis_concepts(text: Column) -> Column:
    """TX17: names in the order of the list."""
    named = F.array(*[F.struct(F.lit(name).alias("name"), F.array(*[F.lit(t.lower()) for t in terms]).alias("terms")) for name, terms in L.CONCEPTS.items()])
    said = lambda v: F.filter(named, lambda c: F.exists(c["terms"], lambda t: F.contains(v, t)))
    return let(compact(extract_diagnosis(text)), lambda v: F.transform(said(v), lambda c: c["name"]))


def stage(text: Column) -> Column:
    """TX18."""
    raw = F.regexp_extract(normalize(text), r"(?iuU)([ivxⅠⅡⅢⅣ一二三四1-4]+)\s*期", 1)
    known = F.create_map(*[F.lit(x) for pair in L.STAGES.items() for x in pair])
    return let(raw, lambda x: F.when(x.rlike(r"^\d+\z"), x.try_cast("long")).otherwise(F.try_element_at(known, F.lower(x)).cast("long")))


def image_labels(text: Column) -> Column:
    """TX19."""
    return K.labels_of(text)


def view_sections(text: Column) -> Column:
    """TX20: struct of sections (array of label and content, the first of a label) and reasons."""
    return K.sections_of(text)


def analysis_body(text: Column) -> Column:
    """TX21."""
    return strip(sub(normalize_space(text), r"(?sU)病理诊断\s*[：:].*"))


def cue_count(text: Column) -> Column:
    """TX22."""
    cues = F.array(*[F.lit(c.lower()) for c in L.CUES])
    return let(F.lower(text), lambda low: F.size(F.filter(cues, lambda c: F.contains(low, c))).cast("long"))


def placeholder_count(text: Column) -> Column:
    """TX23."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("<image>")).cast("long")


def extract_choice(text: Column, choices: Column) -> Column:
    """TX24: by priority, the first letter that is a choice."""
    tail = F.upper(strip(F.element_at(F.split(F.coalesce(text, F.lit("")), "</think>"), -1)))
    found = []
    for pattern in (r"(?U)^\s*[\(\[]?([A-Z])[\)\].,:;\s]", r"(?U)(?:ANSWER|OPTION|CHOICE)\s*(?:IS|:)\s*[\(\[]?([A-Z])", r"\b([A-Z])\b"):
        found.append(F.get(F.filter(F.regexp_extract_all(tail, F.lit(pattern), F.lit(1)), lambda c: F.array_contains(choices, c)), F.lit(0)))
    return F.coalesce(*found)


def schema_flags(text: Column) -> Column:
    """TX25."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(text.startswith("图像分析：").alias("has_prefix"), text.rlike(POSITION).alias("has_position"), text.contains("病理诊断").alias("has_diagnosis"))


def has_diagnosis_section(text: Column) -> Column:
    """TX26."""
    return normalize(text).rlike(r"(?U)病理诊断\s*[：:]\s*\S")


def evenly_spaced(n: Column, k: Column) -> Column:
    """TX27: k places among n, first and last included."""
    places = F.transform(F.sequence(F.lit(0), F.least(k, n).cast("int") - 1), lambda i: F.bround(i * (n - 1) / (F.least(k, n) - 1)).cast("long"))
    return F.when(n <= 0, F.array().cast("array<long>")).when(F.least(k, n) == 1, F.array(F.floor(n / 2).cast("long"))).otherwise(F.array_distinct(places))


def last_subsequence(values: Column, part: Column) -> Column:
    """TX28: where part begins for the last time in values, from 0; null if nowhere."""
    starts = F.when(F.size(values) >= F.size(part), F.sequence(F.lit(0), F.size(values) - F.size(part))).otherwise(F.array().cast("array<int>"))
    return F.array_max(F.filter(starts, lambda i: F.slice(values, i + 1, F.size(part)) == part)).cast("long")
