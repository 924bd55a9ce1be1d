"""Registered queries without SQL, against plain Python over the same rows."""

import hashlib
import math
import os
import re

from verisheaf.functions import lexicon as L
from verisheaf.plans import catalog, io_plans, pair_plans, quality_plans, stats_plans
from verisheaf.plans.tables import reports, table, turn_pairs

SF = "/root/testdata/sf0.001"
#: Queries that this module checks in place of SQL.
CHECKED = {"dd_two_keys", "dd_one_to_one", "ag_significance", "mt_lcs_reports", "mt_numbers", "io_hashes", "io_image_kinds", "e1_case_scores", "e1_metrics_document"}


def normalize(text):
    text = re.sub(r"(?is)<think>.*?</think>", "", re.sub(r"\r\n?", "\n", text or ""))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def f1(a, b):
    """Precision, recall, F1 of the longest common subsequence."""
    n = lcs(a, b)
    p = n / len(b) if b else float(not a)
    r = n / len(a) if a else float(not b)
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def test_every_query_is_checked():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == CHECKED


def test_two_keys(spark):
    rows = sorted((r.l_orderkey * 10 + r.l_linenumber, r.l_partkey, r.l_suppkey) for r in table(spark, SF, "lineitem").collect())
    seen, want = (set(), set()), []
    for at, a, b in rows:
        want.append((at, a not in seen[0] and b not in seen[1]))
        if want[-1][1]:
            seen[0].add(a)
            seen[1].add(b)
    assert sorted(tuple(r) for r in quality_plans.keep_first_of_two(spark, SF).collect()) == sorted(want)


def sections(text):
    """Sections of a report by position, or None if they are not all there once."""
    text = re.sub(r"\n{2,}", "\n", re.sub(r"[ \t]+", " ", text)).strip()
    body = re.split(r"(?m)^\s*病理诊断\s*[：:]", text)[0].strip()
    names = "|".join(L.POSITIONS["views"])
    starts = [(m.start(), m[1], m.end()) for m in re.finditer(rf"(?m)^\s*({names})\s*[：:]?\s*", body)]
    found = {}
    for i, (_, label, end) in enumerate(starts):
        content = re.sub(names, "", body[end : starts[i + 1][0] if i + 1 < len(starts) else len(body)])
        content = re.sub(r"\n{2,}", "\n", re.sub(r"[ \t]+", " ", content)).strip()
        if not content or label in found:
            return None
        found[label] = content
    return found or None


def test_one_to_one(spark):
    seen, want = (set(), set()), []
    for r in sorted(quality_plans._records(spark, SF).collect(), key=lambda r: r.record_index):
        target = next(m.content for m in r.messages if m.role == "assistant")
        found, places = sections(target), [re.search("左上图|右上图", i)[0] for i in r.images]
        if found is None or len(set(places)) < len(places) or set(places) != set(found):
            continue
        for image, place in zip(r.images, places, strict=True):
            text = found[place]
            answer, n = "图像分析：" + text, len(re.findall("[一-鿿]", text))
            key = re.sub("[\\s，。；;：:、\\\\（）()【】\\[\\]<>《》“”\"'—-]+", "", answer).lower()
            if n >= 8 and image not in seen[0] and key not in seen[1]:
                seen[0].add(image)
                seen[1].add(key)
                want.append((len(want), r.record_index, image, place, answer, n))
    got = quality_plans.one_to_one(spark, SF).orderBy("one_to_one_index").collect()
    assert [tuple(r) for r in got] == want and want


def test_significance(spark):
    rows = {r.source: r for r in stats_plans.significance(spark, SF).collect()}
    tests = {}
    for r in stats_plans._runs(spark, SF).collect():
        cell = tests.setdefault(r.source, [0, 0])
        cell[0] += r.a == 0 and r.b == 1
        cell[1] += r.a == 1 and r.b == 0
    p = {s: math.erfc(math.sqrt((abs(x - y) - 1) ** 2 / (x + y) / 2)) if x + y else 1.0 for s, (x, y) in tests.items()}
    top = 0.0
    for rank, s in enumerate(sorted(p, key=lambda s: (p[s], s)), 1):
        raw = min(1.0, (len(p) - rank + 1) * p[s])
        top = max(top, raw)
        assert math.isclose(rows[s].p, p[s], abs_tol=1e-8) and rows[s]["rank"] == rank
        assert math.isclose(rows[s].raw, raw, abs_tol=1e-8) and math.isclose(rows[s].adjusted, top, abs_tol=1e-8)
    assert set(rows) == set(p)


def test_lcs(spark):
    token = re.compile(r"[一-鿿]|[A-Za-z]+|\d+(?:\.\d+)?|[^\s]")
    texts = {r.report_id: (r.reference, r.prediction) for r in reports(spark, SF).limit(150).collect()}
    rows = {r.report_id: r for r in pair_plans.lcs_short(spark, SF).collect()}
    assert len(rows) == reports(spark, SF).count()
    for i, (a, b) in texts.items():
        want = f1(token.findall(normalize(a)), token.findall(normalize(b)))
        squeezed = [re.sub(r"\s+", "", t.lower())[:512] for t in (a, b)]
        got = (rows[i].precision, rows[i].recall, rows[i].f1, rows[i].capped_f1)
        assert all(math.isclose(x, y, abs_tol=1e-8) for x, y in zip(got, (*want, f1(*squeezed)[2]), strict=True))


def claims(text):
    """(entity, value, unit) of each number that doesn't go on from a letter or digit."""
    out = []
    for m in re.finditer(r"[0-9]+(?:\.[0-9]+)?", text):
        if m.start() and re.match(r"[A-Za-z0-9]", text[m.start() - 1]):
            continue
        unit = re.match(r"\s*([%个期级])", text[m.end() :])
        end = m.end() + (unit.end() if unit else 0)
        if not unit:
            end = m.end() + len(re.match(r"\s*", text[m.end() :])[0])
        near = re.split("[\n。；]", text[max(0, m.start() - 18) : m.start()])[-1] + text[m.start() : end] + re.split("[\n。；]", text[end : end + 18])[0]
        named = [e for e, terms in L.ENTITY_TERMS.items() if any(t in near for t in terms)]
        out.append((named[0] if named else "stage" if unit and unit[1] == "期" else "unscoped", float(m[0]), unit[1] if unit else "number"))
    return out


def test_numbers(spark):
    rows = {r.report_id: r for r in pair_plans.numbers(spark, SF).collect()}
    for r in reports(spark, SF).collect():
        a, b = claims(normalize(r.reference)), claims(normalize(r.prediction))
        left, gaps = list(b), []
        for entity, value, unit in a:
            near = sorted((abs(x[1] - value), i) for i, x in enumerate(left) if (x[0], x[2]) == (entity, unit))
            if near:
                gaps.append(near[0][0])
                del left[near[0][1]]
        want = (r.report_id, len(a), len(b), len(gaps), sum(g == 0 for g in gaps), sum(g <= 5 for g in gaps), sum(g <= 10 for g in gaps), len(left), len(a) - len(gaps))
        assert tuple(rows[r.report_id]) == want


def test_files(spark, tmp_path):
    for name, start in (("a.png", b"\x89PNG\r\n\x1a\n"), ("b.jpg", b"\xff\xd8\xff\xe0"), ("c.gif", b"GIF89a"), ("d.txt", b"text")):
        (tmp_path / name).write_bytes(start + bytes(20))
    from verisheaf.sources import io

    assert {os.path.basename(r.path): r.kind for r in io.image_kinds(io.files(spark, str(tmp_path))).collect()} == {"a.png": "png", "b.jpg": "jpeg", "c.gif": "gif", "d.txt": None}
    want = set()
    for folder, _, names in os.walk(SF):
        for name in names:
            raw = open(os.path.join(folder, name), "rb").read()
            want.add((len(raw), hashlib.sha256(raw).hexdigest()))
    assert {(r.size, r.sha256) for r in io_plans.hashes(spark, SF).collect()} == want
    assert [tuple(r) for r in io_plans.kinds(spark, SF).collect()] == [(None, len(want))]


def test_case_scores_and_their_document(spark):
    """The wide table against the queries of its single metrics, and the document's means against the table."""
    wide = {r.case_index: r for r in pair_plans.case_scores(spark, SF).collect()}
    pairs = {r.pair_id: r for r in turn_pairs(spark, SF).collect()}
    assert set(wide) == set(pairs)
    for name, column in (("mt_meteor", "meteor_exact"), ("mt_sentence_bleu", "bleu4"), ("mt_cider", "cider")):
        for r in catalog.queries()[name](spark, SF).collect():
            (value,) = [v for k, v in r.asDict().items() if isinstance(v, float)]
            assert math.isclose(wide[r.pair_id][column], value, abs_tol=1e-8), name
    for i, r in pairs.items():
        compact = [re.sub(r"\s+", "", normalize(t)) for t in (r.reference, r.prediction)]
        assert math.isclose(wide[i].length_ratio, len(compact[1]) / max(1, len(compact[0])), abs_tol=1e-8)
    document = {(r.section, r.metric): r.value for r in pair_plans.document(spark, SF).collect()}
    means = {c: sum(r[c] for r in wide.values()) / len(wide) for c in ("rougeL_f1", "chrf", "meteor_exact")}
    for name, mean in means.items():
        assert any(name in metric and value is not None and math.isclose(value, mean, abs_tol=1e-6) for (_, metric), value in document.items()), name
