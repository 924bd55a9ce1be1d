"""Operator 5: main text of web pages by maximum-scoring subsequence.

A page is read as a sequence of words and tags. Words score above zero, tags below, with weights learned from pages
that name their content (article, main). One linear scan finds the contiguous region of highest score. It may lack short
first and last blocks of the article, whose tags outweigh their words, so the smallest container that holds the region
is the article. Navigation, adverts, forms and the like leave nothing to score, but for elements that hold the article.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verisheaf.llm.common import read_table

# Elements and names by their meaning in HTML.
RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "object", "canvas", "audio", "video", "xmp")
DROPPED = frozenset(("head", "nav", "aside", "footer", "form", "menu", "dialog", "select", "button", "fieldset", "datalist", "optgroup", "option", "applet"))
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("html body main article section div table blockquote td center".split())
NAMED = frozenset(("article", "main"))
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math meter nobr output picture progress q rp rt ruby s samp "
    "slot small span strike strong sub sup time tt u var".split()
)
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright "
    "disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination paywall popup promo promoted "
    "promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW)})\b(?:\"[^\"]*\"|'[^']*'|[^\"'>])*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*+)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^\"'>])*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-z][^\s/>]*+)(?P<attrs2>[^>]*+)>"
    r"|<[!?/][^>]*+>"
    r"|<[a-z/!?][^>]*+\Z",
    re.I | re.S,
)
ATTRS = re.compile(r"\b(class|id|role|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?<=\s)(hidden)(?=[\s/]|$)", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")


HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

KEEP, DROP, NAMED_SO, PARTLY = range(4)


def judged(name: str, attrs: str) -> int:
    """What an element's name and attributes say: DROP it; NAMED_SO where a class or id is made of words for boilerplate
    alone; PARTLY where one has such a word beside others (as in no-sidebar); else KEEP."""
    if name in DROPPED:
        return DROP
    if not attrs or name in ("html", "body"):
        return KEEP
    out = KEEP
    for m in ATTRS.finditer(attrs):
        if m[5]:
            return DROP
        value, kind = (m[2] or m[3] or m[4] or "").lower(), m[1].lower()
        if kind == "role" and value.strip() in ROLES or kind == "style" and HIDDEN.search(value):
            return DROP
        if kind in ("class", "id"):
            for token in value.split():
                words = [w for w in SPLIT.split(token) if w]
                listed = sum(w in BOILERPLATE for w in words)
                if listed:
                    out = NAMED_SO if listed == len(words) or out == NAMED_SO else PARTLY
    return out


class Page:
    """Tokens of a page: for the k-th tag its name, attributes, whether it closes, the token at which its element ends,
    and sums of words and of named containers before it. Elements that aren't closed end with their parent; p and li
    where the next begins."""

    def __init__(self, page: str):
        self.matches = list(TOKEN.finditer(page))
        n = len(self.matches)
        self.name, self.attrs, self.close = [""] * n, [""] * n, [False] * n
        self.end, self.mark = [n] * n, [KEEP] * n
        self.words, self.named = [0] * (n + 1), [0] * (n + 1)
        stack: list[int] = []
        opened: dict[str, list[int]] = {}

        def pop_to(i: int, at: int) -> None:
            while stack[-1] != i:
                self.end[stack[-1]] = at
                opened[self.name[stack.pop()]].pop()
            self.end[i] = at
            opened[self.name[stack.pop()]].pop()

        def close_implied(kinds: tuple, walls: frozenset, at: int) -> None:
            for i in reversed(stack):
                if self.name[i] in kinds:
                    return pop_to(i, at)
                if self.name[i] in walls:
                    return None

        at = 0
        for k, m in enumerate(self.matches):
            self.words[k] += len(page[at : m.start()].split())
            self.words[k + 1] = self.words[k]
            self.named[k + 1] = self.named[k]
            at = m.end()
            name = self.name[k] = (m["name"] or m["name2"] or "").lower()
            if not name:
                continue
            attrs = self.attrs[k] = (m["attrs"] if m["name"] else m["attrs2"]) or ""
            self.close[k] = (m["close"] or m["close2"]) == "/"
            if name in VOID or attrs.endswith("/"):
                self.end[k] = k
            elif self.close[k]:
                if opened.get(name):
                    pop_to(opened[name][-1], k)
            else:
                if name in BLOCKS:
                    close_implied(("p",), BLOCKS - {"p"}, k)
                if name == "li":
                    close_implied(("li",), frozenset(("ul", "ol", "menu")), k)
                stack.append(k)
                opened.setdefault(name, []).append(k)
                self.mark[k] = judged(name, attrs)
                self.named[k + 1] += name in NAMED and self.mark[k] in (KEEP, PARTLY)
        self.words[n] += len(page[at:].split())

    def unwanted(self, k: int, in_article: bool) -> bool:
        """Whether the element that opens at k leaves nothing. A class or id that speaks of boilerplate doesn't count
        on an element that holds every named container of the page, nor, if it says so only partly, on one that holds
        more than half of the page's words, nor on an article or main that is no other's."""
        mark, name = self.mark[k], self.name[k]
        if mark == DROP or name == "header" and not in_article:
            return True
        if mark == KEEP:
            return False
        inside, every = self.named[self.end[k]] - self.named[k], self.named[-1]
        if every and inside == every or name in NAMED and (mark == PARTLY or not every):
            return False
        return mark == NAMED_SO or 2 * (self.words[self.end[k]] - self.words[k]) <= self.words[-1]


def parse(page: str, drop: bool = True) -> tuple[list, list]:
    """pieces: (kind, text, name, inside) in page order, kind "w" for text and "t" for a tag, inside whether a container
    that names its content is open; containers: [name, first piece, end]. With drop, unwanted elements leave nothing."""
    tokens = Page(page)
    pieces: list = []
    containers: list = []
    ends: dict[int, list[int]] = {}  # containers by the token that ends them
    named = at = until = 0
    for k, m in enumerate(tokens.matches):
        for c in ends.pop(k, ()):
            containers[c][2] = len(pieces) + (m.start() > at and k >= until)
            named -= containers[c][0] in NAMED
        if k < until:
            at = m.end()
            continue
        if m.start() > at:
            pieces.append(("w", page[at : m.start()], "", named > 0))
        at = m.end()
        name = tokens.name[k]
        if not name:
            if m["raw"]:
                pieces.append(("t", "", m["raw"].lower(), named > 0))
            continue
        pieces.append(("t", "", name, named > 0))
        if tokens.close[k] or tokens.end[k] == k:
            continue
        if drop and tokens.unwanted(k, named > 0):
            to = tokens.end[k]
            if to == len(tokens.matches):
                at = len(page)
                break
            # What closes it is skipped too; what closes its parent or opens its sibling isn't.
            until = to + (tokens.close[to] and tokens.name[to] == name)
        elif name in CONTAINERS:
            ends.setdefault(tokens.end[k], []).append(len(containers))
            containers.append([name, len(pieces), len(page) + 1])
            named += name in NAMED
    if at < len(page):
        pieces.append(("w", page[at:], "", named > 0))
    return pieces, containers


def known(name: str) -> str:
    """The name of an element of HTML; all others count as one."""
    return name if name in BLOCKS or name in INLINE or name in VOID or name in RAW or name in DROPPED else "other"


def count_labels(page: str) -> Counter:
    """Words and tags inside and outside the named container of a labelled page; nothing for other pages."""
    pieces, containers = parse(page, drop=False)
    out: Counter = Counter()
    if any(name in NAMED for name, _, _ in containers):
        for kind, text, name, inside in pieces:
            out["w" if kind == "w" else f"t:{known(name)}", inside] += len(text.split()) if kind == "w" else 1
    return out


def weights(counts: dict) -> tuple[float, dict[str, float], float]:
    """The score of a word, of each tag, and of a tag that no labelled page has. counts: (token, inside) to number.
    A token's score is its log odds of standing inside, smoothed by one; a word keeps at least 0.5 and a tag at most
    -0.05, so that words are always above zero and tags below."""
    word = max(0.5, min(3.0, math.log((counts.get(("w", True), 0) + 1) / (counts.get(("w", False), 0) + 1))))
    tags = {}
    for name in {k[2:] for k, _ in counts if k[:2] == "t:"}:
        odds = math.log((counts.get((f"t:{name}", True), 0) + 1) / (counts.get((f"t:{name}", False), 0) + 1))
        tags[name] = min(-0.05, odds - 1.0)
    return word, tags, -1.0


def best_region(scores: list[float]) -> tuple[float, int, int]:
    """The highest sum of contiguous scores and its (from, to), by one scan; (0, 0, 0) if none is above zero."""
    best, start, end = 0.0, 0, 0
    total, since = 0.0, 0
    for i, score in enumerate(scores):
        total += score
        if total <= 0:
            total, since = 0.0, i + 1
        elif total > best:
            best, start, end = total, since, i + 1
    return best, start, end


def main_text(page: str | None, word: float, tags: dict[str, float], other: float) -> tuple[str, float]:
    """The text of the best region's container, and the region's score."""
    if not page:
        return "", 0.0
    pieces, containers = parse(page)
    best, start, end = best_region([word * len(text.split()) if kind == "w" else tags.get(known(name), other) for kind, text, name, _ in pieces])
    if not best:
        return "", 0.0
    home = (start, end)
    for name, first, last in containers:  # in order of opening, so the last that fits is the smallest
        if name not in ("html", "body") and first <= start and end <= last:
            home = (first, min(last, len(pieces)))
    out = []
    for kind, text, name, _ in pieces[home[0] : home[1]]:
        if kind == "w":
            out.append(html.unescape(text) if "&" in text else text)
        elif name in BLOCKS or name in RAW:
            out.append(" ")
    return " ".join("".join(out).split()), best


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points) and region_score.

    Two passes: the first counts words and tags inside and outside the named containers of all labelled pages, the
    second scores and extracts. The counts that reach the driver are two per element of HTML; all other elements count
    as one. An element is left out for its name (nav, form, header outside the article), role, hidden state, or class and
    id, but never for the latter if it holds every article of the page (see Page.unwanted).

    Null and empty pages, and pages of tags alone, have empty text. White space (as Unicode has it) inside a block
    becomes one space and blocks are joined by one. Unclosed elements end with their parent, unclosed comments and
    scripts at the end of the page. Ids and urls pass through, null or repeated. Without labelled pages words score 0.5
    and tags -1. Empty input gives no rows. Extra columns are ignored. Pages are handled one at a time, whole.
    """

    def counted(batches):
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                total.update(count_labels(page or ""))
        yield pa.RecordBatch.from_pydict({"token": [t for t, _ in total], "inside": [i for _, i in total], "n": pa.array(list(total.values()), pa.int64())}) if total else pa.RecordBatch.from_pydict(
            {"token": pa.array([], pa.string()), "inside": pa.array([], pa.bool_()), "n": pa.array([], pa.int64())}
        )

    counts = pages.select(F.col(html_col)).mapInArrow(counted, "token string, inside boolean, n long").groupBy("token", "inside").agg(F.sum("n").alias("n"))
    model = weights({(r.token, r.inside): r.n for r in counts.collect()})

    def extracted(batches):
        for batch in batches:
            found = [main_text(page, *model) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())],
                ["page_id", "url", "text", "n_chars", "region_score"],
            )

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col))
    return rows.mapInArrow(extracted, "page_id long, url string, text string, n_chars long, region_score double")


def op5_html_text(spark, sf_dir):
    return extract_text(read_table(spark, sf_dir, "pages"))
