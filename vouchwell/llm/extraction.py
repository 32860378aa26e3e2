"""HTML extraction by tag-path ratios.

Every text run has a path of tags (with classes) from the root. Per path, text length and
punctuation are summed and divided by the number of runs on the path; the two ratios are fused with
the share of text outside links and smoothed over the runs in page order. Where an element of the
path names itself something else than an article (its class or id is made of such words alone), the
score is multiplied by a small prior, so it has to be far above all others to count. Paths from a
share of the best path's score on are content.

The article is the page's one ``article`` (or ``main``) element with content, else the smallest
element that holds all content. Of its blocks go those in elements that the standard sets apart
(navigation, forms, footers and so on); those in elements that name themselves something else, or
follow a heading that announces readers' comments, and have most of their text off the content paths;
and those in lists of links whose paths carry nothing else and are no content. A heading all of whose
text until the next one goes, goes too. How much of the page's text an element holds decides nothing.
Where only the page's body holds all content, the bulk's element, other content runs and the title
are taken.

Edge cases: null or empty html, pages without text, and pages of nothing but navigation, forms,
footers and the like give the empty string; unclosed tags end where the standard lets them; nesting
of any depth is judged; repeated rows are extracted each; an empty table gives no row; extra columns
are kept by ``extract_pages``.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchwell.llm.markup import BLOCK, RAW, VOID, Stack, attributes, tokens

#: A path is content from this share of the best path's score on.
THRESHOLD = 0.2
#: What a path's score is multiplied by where an element on it names itself furniture.
NAMED_PRIOR = 0.02
#: The bulk's element is the deepest with at least this share of the content.
ARTICLE_SHARE = 0.7

# Elements, roles and class words that mark what is not the article.
_TAGS = frozenset("nav footer form button select dialog menu fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_WORDS = frozenset(
    "nav navbar navigation menu menus header masthead footer sidebar aside rail ad ads adbox advert adverts advertisement "
    "advertising sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices "
    "alert newsletter subscribe subscription signup login share sharing social related recommended recommendations comment "
    "comments commentlist reply replies respond disqus breadcrumb breadcrumbs pagination pager toolbar widget widgets popup "
    "modal overlay copyright skip hidden outbrain taboola".split()
)
# Words that say where or what kind of box, and nothing of what is in it.
_NEUTRAL = frozenset(
    "area bar block body bottom box button buttons col column container content div entry form global group head holder inner "
    "item items js left li line link links list main module outer page panel post posts primary region right row secondary "
    "section sections site slot story strip tab thread threads top ul unit user users reader readers view wrap wrapper".split()
)
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr blockquote pre figcaption ul ol dl".split())
_LEVELS = {f"h{i}": i for i in range(1, 7)}
_HEADINGS = frozenset(("header", "hgroup", *_LEVELS))
# What announces readers' comments, alone or with their number.
_REMARKS = re.compile(
    r"(?i)\W*(?:\d+\W+)?(?:(?:reader|user)s?'?s?\W+)?(?:comments?|responses?|replies|reactions|leave a (?:reply|comment)|kommentare?|commentaires?|comentarios?)"
    r"(?:\W+\d+)?\W*"
)
_WHOLE = frozenset("# html body".split())
# What may hold a list of links.
_GROUPS = frozenset("ul ol menu div section dl table p".split())
_MAIN = frozenset("article main".split())
_SPLIT = re.compile(r"[^a-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?¡¿،。，、；：！？…]")


def _set_apart(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    """Is it no part of an article, by the standard's elements, roles and states?"""
    if tag in _TAGS or (tag in ("header", "aside") and not in_article):
        return True
    if attrs.get("role", "").lower() in _ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    return bool(re.search(r"display\s*:\s*none", attrs.get("style", "")))


@lru_cache(maxsize=10_000)
def _says_furniture(name: str) -> bool:
    words = set(_SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())) - {""}
    return not words.isdisjoint(_WORDS) and words <= _WORDS | _NEUTRAL


def _is_named(attrs: dict[str, str]) -> bool:
    """Is one of its class names or its id made of furniture words (and neutral ones) alone?"""
    return any(map(_says_furniture, [*attrs.get("class", "").split(), attrs.get("id", "")]))


class _Page:
    """Elements in opening order, the paths they stand on, and text runs with element and block."""

    def __init__(self, page: str):
        self.parent, self.tag, self.path, self.apart, self.named = [-1], ["#"], [0], [False], [False]
        self.within = [False]  # in an article or main element
        self.prior = [1.0]  # of each path
        self.runs: list[tuple[int, int, str, bool]] = []  # element, block, text, in a link
        paths: dict[tuple, int] = {}
        stack, block, links = Stack(), 0, 0
        said: list[str] = []  # the text of the open heading
        remarks: dict[int, int] = {}  # elements in which comments are announced, with the heading's level

        def leave(depth: int):
            for i in stack.cut(depth):
                level = _LEVELS.get(self.tag[i])
                if level:
                    if remarks.get(self.parent[i], 7) >= level:
                        remarks.pop(self.parent[i], None)
                    if _REMARKS.fullmatch("".join(said)[:200]):
                        remarks[self.parent[i]] = level
                    said.clear()
                elif i in remarks and self.tag[i] == "div" and self.parent[i] not in remarks and self._bare(i):
                    remarks[self.parent[i]] = remarks[i]  # a box around the heading alone

        for kind, value, raw in tokens(page):
            if kind == "text":
                if not value.isspace() or self.runs:
                    self.runs.append((stack.numbers[-1], block, value, stack.last("a") >= 0))
                if len(said) < 99:
                    said.append(value)
                continue
            if value == "br":
                self.runs.append((stack.numbers[-1], block, " ", False))
            block += value in BLOCK
            if kind == "close":
                if (depth := stack.last(value)) >= 0:
                    leave(depth)
                continue
            if value in VOID:
                continue
            leave(stack.closed_by(value))
            attrs = attributes(raw) if raw.strip() else {}
            up = stack.numbers[-1]
            if value in _LEVELS:
                said.clear()
            named = value not in _WHOLE and (_is_named(attrs) or (up in remarks and value not in _LEVELS))
            article = max(stack.last("article"), stack.last("main")) >= 0
            self.parent.append(up)
            self.tag.append(value)
            key = (self.path[up], value, attrs.get("class", ""), named)
            if key not in paths:
                paths[key] = len(self.prior)
                self.prior.append(NAMED_PRIOR if named else self.prior[self.path[up]])
            self.path.append(paths[key])
            self.apart.append(_set_apart(value, attrs, article))
            self.named.append(named)
            self.within.append(article)
            if value not in RAW:
                stack.push(len(self.parent) - 1, value)

    def _bare(self, i: int) -> bool:
        """Has the element no text beside its one heading?"""
        return all(self.parent[k] == i and self.tag[k] in _LEVELS for k in range(i + 1, len(self.parent))) and not any(
            e == i and not t.isspace() for e, _, t, _ in self.runs[-8:]
        )


def _gathered(parent: list[int], own: np.ndarray) -> np.ndarray:
    total = own.copy()
    for i in range(len(parent) - 1, 0, -1):
        total[parent[i]] += total[i]
    return total


def _content(page: _Page, live: list) -> set[int]:
    """The paths above the threshold."""
    sums = defaultdict(lambda: [0, 0, 0, 0])
    for e, _, text, link, size in live:
        s = sums[page.path[e]]
        s[0] += 1
        s[1] += size
        s[2] += len(_PUNCTUATION.findall(text))
        s[3] += size * link
    fused = {p: (length / k) ** 0.5 * (1 + marks / k) * (1 - linked / length) for p, (k, length, marks, linked) in sums.items()}
    scores = np.array([fused[page.path[e]] for e, *_ in live])
    smooth = np.convolve(np.pad(scores, 1, mode="edge"), [0.25, 0.5, 0.25], mode="valid")
    by_path = defaultdict(list)
    for (e, *_), s in zip(live, smooth):
        by_path[page.path[e]].append(s)
    mean = {p: float(np.mean(s)) * page.prior[p] for p, s in by_path.items()}
    limit = THRESHOLD * max(mean.values())
    return {p for p, s in mean.items() if s >= limit}


def _deepest(page: _Page, weight: np.ndarray, share: float) -> int:
    found = 0
    for i in range(1, len(page.parent)):  # a child comes after its parent
        if page.parent[i] == found and weight[i] >= share * weight[0] and page.tag[i] not in _LEAVES and page.tag[i] in BLOCK:
            found = i
    return found


def _below(page: _Page, marked: list[bool]) -> list[bool]:
    """Which elements are marked or stand in one that is."""
    inside = list(marked)
    for i in range(1, len(inside)):
        inside[i] = inside[i] or inside[page.parent[i]]
    return inside


def _up(page: _Page, i: int) -> list[int]:
    found = [i]
    while page.parent[found[-1]] >= 0:
        found.append(page.parent[found[-1]])
    return found


def _article(page: _Page, live: list, weight: np.ndarray, apart: list[bool]) -> int:
    """The one article or main element with content, else the smallest element with all content."""
    named = _below(page, page.named)
    for kind in ("article", "main"):
        of_kind = [t == kind for t in page.tag]
        within = _below(page, of_kind)
        outer = [
            i for i, t in enumerate(of_kind) if t and not within[page.parent[i]] and weight[i] and not named[i] and not apart[i]
        ]
        if len(outer) == 1:
            return outer[0]
    found = _deepest(page, weight, 1)
    line = _up(page, found)
    around = [i for i in line if page.tag[i] in _MAIN]
    if around:
        return around[-1]
    place = {i: k for k, i in enumerate(line)}
    meets = [place.get(0, 0)] * len(page.parent)  # where an element's own line meets this one
    for i in range(1, len(meets)):
        meets[i] = place[i] if i in place else meets[page.parent[i]]
    titled = _below(page, [t == "h1" for t in page.tag])
    wide = max((meets[e] for e, *_ in live if titled[e]), default=0)
    return found if page.tag[line[wide]] in _WHOLE else line[wide]


def _headings_without_text(page: _Page, words: list, inside: list[bool], out: list[bool]) -> list[bool]:
    """Headings (but the title) all of whose text until the next heading, or the end of what they
    stand in, goes, if there is any."""
    heading = _below(page, [t in _LEVELS for t in page.tag])
    last, found = 0, {}
    nearest = [i if page.tag[i] in _LEVELS else 0 for i in range(len(page.tag))]
    end = list(range(len(page.tag)))  # the last element within each
    for i in range(len(end) - 1, 0, -1):
        end[page.parent[i]] = max(end[page.parent[i]], end[i])
    for i in range(1, len(nearest)):
        nearest[i] = nearest[i] or nearest[page.parent[i]]
    size_of = np.zeros(len(nearest), np.int64)
    for e, _, _, _, size in words:
        size_of[e] += size
    size_of = _gathered(page.parent, size_of)
    scope = list(page.parent)  # what an element stands in, beside boxes that hold it alone
    for i in range(1, len(scope)):
        if scope[i] > 0 and size_of[scope[i]] == size_of[i]:
            scope[i] = scope[scope[i]]
    for e, _, _, _, size in words:
        if heading[e]:
            last = nearest[e]
        elif last and size and last < e <= end[scope[last]]:
            kept, gone = found.get(last, (0, 0))
            goes = out[e] or not inside[e]
            found[last] = (kept + (not goes), gone + goes)
    return [page.tag[i] != "h1" and found.get(i, (1, 0))[0] == 0 and found[i][1] > 0 for i in range(len(page.tag))]


def extract(html: str) -> str:
    page = _Page(html)
    words = [(e, b, t, a, len("".join(t.split()))) for e, b, t, a in page.runs]
    n = len(page.parent)
    # a form around the whole page isn't set apart, nor is anything else around an article
    holds = np.zeros(n, np.int64)
    for i in range(n):
        holds[i] = page.tag[i] in _MAIN and not page.named[i]
    holds = _gathered(page.parent, holds)
    apart = _below(page, [a and not h for a, h in zip(page.apart, holds)])
    live = [w for w in words if w[4] and not apart[w[0]]]
    if not live:
        return ""
    content = _content(page, live)
    own, off, chosen, linked = (np.zeros(n, np.int64) for _ in range(4))
    links = np.array([t == "a" for t in page.tag], np.int64)
    for e, _, _, link, size in live:
        own[e] += size
        off[e] += size * (link or page.path[e] not in content)
        chosen[e] += size * (page.path[e] in content)
        linked[e] += size * link
    own, off, weight, linked, links = (_gathered(page.parent, x) for x in (own, off, chosen, linked, links))
    article = _article(page, live, weight, apart)
    title = np.array([t == "h1" for t in page.tag], np.int64)
    title = _gathered(page.parent, title)
    inside = _below(page, [i == article for i in range(n)])

    def goes(i: int) -> bool:
        if holds[i] or page.tag[i] in _WHOLE or i == article:
            return False
        if inside[i] and (page.tag[i] in _HEADINGS or title[i]):
            return False
        judged = page.named[i] or (page.tag[i] == "aside" and page.within[i])
        menu = page.tag[i] in _GROUPS and links[i] > 1 and linked[i] == own[i] and not weight[i]
        return (judged and 2 * off[i] > own[i]) or menu

    out = _below(page, [a or goes(i) for i, a in enumerate(apart)])
    if page.tag[article] in _WHOLE:
        bulk = _deepest(page, weight, ARTICLE_SHARE)
        inside = _below(page, [i == bulk for i in range(n)])
        titled = _below(page, [t == "h1" for t in page.tag])
        for e, *_ in live:
            inside[e] = inside[e] or page.path[e] in content or titled[e]
    out = _below(page, [a or b for a, b in zip(out, _headings_without_text(page, words, inside, out))])
    blocks: dict[int, list[str]] = {}
    for e, b, text, _, _ in words:
        if inside[e] and not out[e]:
            blocks.setdefault(b, []).append(text)
    joined = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(t for t in joined if t)


def _extract_batches(batches):
    for batch in batches:
        texts = [extract(h or "") for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(texts, pa.string())], names=["_row", "text"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """All columns of ``pages`` but html in the struct _row, and text."""
    rest = [c for c in pages.columns if c != "html"]
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    fields = ", ".join(f"`{c}`: {pages.schema[c].dataType.simpleString()}" for c in rest)
    return pages.select("html", row.alias("_row")).mapInArrow(_extract_batches, f"_row struct<{fields}>, text string")
