"""Rules of one text in plain Python, run as Column expressions over Arrow batches. Each distinct text of a batch is worked
on once, so repeated texts cost a look-up; texts that don't repeat cost the rules themselves.

The patterns are those of text.py, written out for Python: white space is what Java's (?U) takes for it, and a dot stops
where Java's does.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import functions as F
from pyspark.sql import types as T

from verisheaf.functions import lexicon as L

SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
_S = f"[{SPACES}]"


def by_text(work: Callable[..., object], kind: T.DataType):
    """A function of columns of texts that gives work(text, ...) of each row; null counts as empty."""
    from pyspark.sql.pandas.types import to_arrow_type

    def run(*columns):
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = [c.cast(pa.string()).fill_null("") for c in columns]
        keys = texts[0].dictionary_encode()
        if len(texts) == 1:
            distinct, places = keys.dictionary, keys.indices
            made = [work(t) for t in distinct.to_pylist()]
        else:
            codes = keys.indices.cast(pa.int64())
            sides = [t.dictionary_encode() for t in texts]
            for side in sides[1:]:
                codes = pc.add(pc.multiply(codes, len(side.dictionary)), side.indices.cast(pa.int64()))
            both = codes.dictionary_encode()
            words, places, made = [s.dictionary.to_pylist() for s in sides], both.indices, []
            for code in both.dictionary.to_pylist():
                at = []
                for side in reversed(words):
                    code, k = divmod(code, len(side))
                    at.append(side[k])
                made.append(work(*reversed(at)))
        return pa.array(made, arrow).take(places)

    arrow = to_arrow_type(kind)
    return F.arrow_udf(run, kind, F.ArrowUDFType.SCALAR)


_THOUGHT = re.compile(r"<[tT][hH][iI][nN][kK]>.*?</[tT][hH][iI][nN][kK]>", re.S)
_BLANKS, _EMPTY_LINES = re.compile("[ \t]+"), re.compile("\n{3,}")


def normalize(text: str) -> str:
    """TX1 without position names taken out."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "<" in text:
        text = _THOUGHT.sub("", text)
    return _EMPTY_LINES.sub("\n\n", _BLANKS.sub(" ", text)).strip(SPACES)


_LABEL = re.compile(rf"病理诊断{_S}*[：:]{_S}*([^\n]*)")
_SENTENCE_END = re.compile("[。；;][^\n\r\x85  ]*\\Z")
_GRADES = re.compile("[（(][^）)]*(?:期|级|ama|评分)[^）)]*[）)]", re.I)
_STAGE = re.compile(rf"(?:分期|stage)?{_S}*[ivxⅠⅡⅢⅣ一二三四0-4]+{_S}*期", re.I)
_HEDGE = re.compile(rf"\A(?:考虑|倾向|符合|诊断为|提示){_S}*")
_MARKS = re.compile(rf"[{SPACES}，,。；;：:、]+")
_JOINTS = re.compile(r"并|伴|合并|及|/|\+")
_SPELLINGS = [(a.lower(), b) for a, b in L.SYNONYMS.items()]


def canonical_diagnosis(text: str) -> str:
    """TX15."""
    out = normalize(text)
    if "病理诊断" in text:
        found = _LABEL.search(out)
        out = _SENTENCE_END.sub("", found[1].strip(SPACES)).strip(SPACES) if found else ""
    out = _HEDGE.sub("", _STAGE.sub("", _GRADES.sub("", out.lower())))
    for spelling, name in _SPELLINGS:
        out = out.replace(spelling, name)
    return _MARKS.sub("", out) or "__MISSING__"


def diagnosis_terms(text: str) -> list[str]:
    """TX16."""
    out = canonical_diagnosis(text)
    return [] if out == "__MISSING__" else list(dict.fromkeys(t for t in _JOINTS.split(out) if t))


def normalize_space(text: str) -> str:
    """TX2."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return _EMPTY_LINES.sub("\n\n", _BLANKS.sub(" ", text)).strip(SPACES)


_POSITION = re.compile("(?:(?:左|中|右)(?:上|中|下)|上|下)图")
#: A line begins after any of Java's ends of lines.
_LINE_START = "(?:\\A|(?<=[\n\x85\u2028\u2029])|(?<=\r)(?!\n))"
_HEADER = re.compile(f"{_LINE_START}{_S}*({_POSITION.pattern}){_S}*[：:]?{_S}*")
_NOTHING = re.compile(f"[（(]{_S}*[）)]")
_INDENT, _LINES = re.compile("\n[ \t]+"), re.compile("\n{2,}")
_COMPACT = re.compile(rf"[{SPACES}，,。；;：:、/\\（）()【】\[\]<>《》·—_-]+")
_SECTION = re.compile(f"病理诊断{_S}*[：:]")
_CJK = re.compile("[\u4e00-\u9fff]")
_CUES = [c.lower() for c in L.CUES]


def strip_position_headers(text: str) -> str:
    """TX9."""
    out = _NOTHING.sub("", _POSITION.sub("", _HEADER.sub("", normalize_space(text))))
    return _LINES.sub("\n", _INDENT.sub("\n", out)).strip(SPACES)


def compact_punctuation(text: str) -> str:
    """TX6."""
    return _COMPACT.sub("", normalize_space(text)).lower()


def target_parts(text: str) -> dict:
    """What the rules of DQ1 need of a target: TX9, TX14, TX21, TX6, TX12 and TX22 of it."""
    cleaned = strip_position_headers(text)
    again = normalize_space(cleaned)
    line, label = _LABEL.search(again), _SECTION.search(again)
    body = (again[: label.start()] if label else again).strip(SPACES)
    canonical, low = compact_punctuation(cleaned), body.lower()
    diagnosis = line[1].strip(SPACES) if line else ""
    return {
        "cleaned": cleaned, "diagnosis": diagnosis, "body": body, "canonical_target": canonical, "headers": _HEADER.findall(text), "blank": not text.strip(SPACES),
        "labelled": bool(_SECTION.search(cleaned)), "unavailable": compact_punctuation(diagnosis) in L.PLACEHOLDERS, "body_chars": len(_CJK.findall(compact_punctuation(body))),
        "target_chars": len(_CJK.findall(canonical)), "cues": sum(c in low for c in _CUES),
    }


def normalize_lines(text: str) -> str:
    """TX3."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return _LINES.sub("\n", _BLANKS.sub(" ", text)).strip(SPACES)


_VIEW = re.compile("|".join(L.POSITIONS["views"]))
_VIEW_START = re.compile(f"{_S}*({_VIEW.pattern}){_S}*[：:]?{_S}*")
_VIEW_SECTION = re.compile(f"{_LINE_START}{_S}*(?:{_VIEW.pattern}){_S}*[：:]?{_S}*.*?(?={_LINE_START}{_S}*(?:{_VIEW.pattern})|\\Z)", re.S)
_SECTION_LINE = re.compile(f"{_LINE_START}{_S}*{_SECTION.pattern}")


def view_sections(text: str) -> dict:
    """TX20. A section is a duplicate if its label was there before with content, kept or not."""
    body = _SECTION_LINE.split(normalize_lines(text), maxsplit=1)[0].strip(SPACES)
    found = _VIEW_SECTION.findall(body)
    if not found:
        return {"sections": [], "reasons": ["no_line_start_position_sections"]}
    kept, filled, reasons = [], set(), set()
    for raw in found:
        start = _VIEW_START.match(raw)
        label, content = start[1], normalize_lines(_VIEW.sub("", normalize_lines(raw[start.end() :])))
        if label in filled:
            reasons.add("duplicate_position_section")
        elif content:
            kept.append({"label": label, "content": content})
        else:
            reasons.add("empty_position_section")
        if content:
            filled.add(label)
    return {"sections": kept, "reasons": sorted(reasons)}


_TERMS = [(name, [(t, t.lower()) for t in sorted(terms, key=len, reverse=True)]) for name, terms in L.ENTITY_TERMS.items()]
_BREAK = re.compile("[\n。；]")


def _around(text: str, start: int, end: int, radius: int) -> str:
    """EX1."""
    left = _BREAK.split(text[max(start - radius, 0) : start])[-1]
    return left + text[start:end] + _BREAK.split(text[end : end + radius], maxsplit=1)[0]


def entities(text: str) -> list[tuple]:
    """EX2: (entity, status, severity, uncertain, term, context)."""
    clean = normalize(text)
    low, out = clean.lower(), []
    for name, terms in _TERMS:
        for term, small in terms:
            at = low.find(small)
            if at >= 0:
                context, before = _around(clean, at, at + len(term), 14), clean[max(at - 10, 0) : at]
                absent = any(n in before or n + term in context for n in L.NEGATIONS)
                severity = next((s for s in L.SEVERITIES if s in context), None)
                out.append((name, "absent" if absent else "present", severity, any(h in context for h in L.UNCERTAINTY), term, context))
                break
    return out


_TOKEN = re.compile("[\u4e00-\u9fff]|[A-Za-z]+|[0-9]+(?:\\.[0-9]+)?|[^ \t\n\x0b\f\r]")
_SPACE_RUN = re.compile(f"{_S}+")


def tokens(text: str) -> list[str]:
    """TX10."""
    return _TOKEN.findall(normalize(text))


def squeezed_chars(text: str, limit: int) -> str:
    """The first characters of TX8."""
    return _SPACE_RUN.sub("", text.lower())[:limit]


_NUMBER = re.compile(r"(?<![A-Za-z\d])([0-9]+(?:\.[0-9]+)?)\s*(%|个|期|级)?")


def claims(text: str) -> list[dict]:
    """EX7 over a normalised text."""
    out = []
    for m in _NUMBER.finditer(text):
        around = _around(text, m.start(), m.end(), 18)
        named = next((name for name, terms in L.ENTITY_TERMS.items() if any(t in around for t in terms)), None)
        out.append({"entity": named or ("stage" if m[2] == "期" else "unscoped"), "value": float(m[1]), "unit": m[2] or "number", "context": around})
    return out


def compared(reference: list[dict], predicted: list[dict]) -> dict:
    """MT17 (and JN15): each number of the reference takes the nearest free one of the same entity and unit, in order."""
    free: dict[tuple, list[tuple[int, float]]] = {}
    for i, p in enumerate(predicted):
        free.setdefault((p["entity"], p["unit"]), []).append((i, p["value"]))
    errors = []
    for r in reference:
        if open_ := free.get((r["entity"], r["unit"])):
            nearest = min(open_, key=lambda x: (abs(x[1] - r["value"]), x[0]))
            open_.remove(nearest)
            errors.append(abs(nearest[1] - r["value"]))
    return {
        "reference_count": len(reference), "prediction_count": len(predicted), "matched_count": len(errors), "exact_count": sum(e == 0 for e in errors),
        "within5_count": sum(e <= 5 for e in errors), "within10_count": sum(e <= 10 for e in errors), "unsupported_count": len(predicted) - len(errors),
        "omitted_count": len(reference) - len(errors), "absolute_errors": errors,
    }


def lcs(a, b) -> int:
    """Length of the longest common subsequence. Bit j of the row is unset where the best of the first j + 1 of b exceeds
    that of the first j; a step over one element of a is an addition over the whole row."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    places: dict = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


_LABELLED = re.compile("(?:左上|右上|左下|右下|上|下)图")


def image_labels(text: str) -> list[str]:
    """TX19."""
    return list(dict.fromkeys(_LABELLED.findall(normalize(text))))


def compact(text: str) -> str:
    """TX5."""
    return _SPACE_RUN.sub("", normalize(text)).lower()


def lcs_of_texts(reference: str, predicted: str, limit: int = 512) -> dict:
    """MT5 and MT7: over tokens, and over the first characters of the squeezed texts, with the lengths of both sides."""
    out = {}
    for name, cut in (("token", tokens), ("char", lambda t: squeezed_chars(t, limit))):
        a, b = cut(reference), cut(predicted)
        out |= {f"{name}_lcs": lcs(a, b), f"{name}_reference": len(a), f"{name}_prediction": len(b)}
    return out


def _lcs_of_arrays(left, right):
    import pyarrow as pa

    out = []
    for i in range(len(left)):
        # Row by row: as Python lists, a batch of long texts by characters would not fit.
        a, b = left.slice(i, 1).flatten(), right.slice(i, 1).flatten()
        codes = pa.concat_arrays([a, b]).dictionary_encode(null_encoding="encode").indices.to_pylist()
        out.append(lcs(codes[: len(a)], codes[len(a) :]))
    return pa.array(out, pa.int64())


_TEXT = T.StringType()
_ENTITY = T.ArrayType(T.StructType([T.StructField(n, T.BooleanType() if n == "uncertain" else _TEXT) for n in ("entity", "status", "severity", "uncertain", "term", "context")]))
CLAIM = T.ArrayType(T.StructType([T.StructField("entity", _TEXT), T.StructField("value", T.DoubleType()), T.StructField("unit", _TEXT), T.StructField("context", _TEXT)]))
NUMBERS = T.StructType([T.StructField(f"{n}_count", T.LongType()) for n in ("reference", "prediction", "matched", "exact", "within5", "within10", "unsupported", "omitted")] + [T.StructField("absolute_errors", T.ArrayType(T.DoubleType()))])

_NAMES = [f.name for f in _ENTITY.elementType.fields]
entities_of = by_text(lambda t: [dict(zip(_NAMES, e, strict=True)) for e in entities(t)], _ENTITY)
_PARTS = {**dict.fromkeys(("cleaned", "diagnosis", "body", "canonical_target"), _TEXT), "headers": T.ArrayType(_TEXT), **dict.fromkeys(("blank", "labelled", "unavailable"), T.BooleanType()), **dict.fromkeys(("body_chars", "target_chars", "cues"), T.LongType())}
parts_of = by_text(target_parts, T.StructType([T.StructField(n, t) for n, t in _PARTS.items()]))
terms_of = by_text(diagnosis_terms, T.ArrayType(_TEXT))
canonical_of = by_text(canonical_diagnosis, _TEXT)
claims_of = by_text(lambda t: claims(normalize(t)), CLAIM)
numbers_of = by_text(lambda a, b: compared(claims(normalize(a)), claims(normalize(b))), NUMBERS)
lcs_of = by_text(lcs_of_texts, T.StructType([T.StructField(f"{of}_{n}", T.LongType()) for of in ("token", "char") for n in ("lcs", "reference", "prediction")]))
sections_of = by_text(view_sections, T.StructType([T.StructField("sections", T.ArrayType(T.StructType([T.StructField("label", _TEXT), T.StructField("content", _TEXT)]))), T.StructField("reasons", T.ArrayType(_TEXT))]))
lcs_of_arrays = F.arrow_udf(_lcs_of_arrays, T.LongType(), F.ArrowUDFType.SCALAR)
labels_of = by_text(image_labels, T.ArrayType(_TEXT))
compact_of = by_text(compact, _TEXT)
