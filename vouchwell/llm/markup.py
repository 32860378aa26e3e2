"""A forgiving reader of HTML: tags, text runs, and nothing of scripts, styles and comments.

Its time grows with the page's length: quotation marks that never close, tags that never end and
nesting of any depth cost no more than other text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_UNQUOTED = re.compile(r"[^>\"']*")
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# Elements of the HTML standard.
RAW = frozenset("script style noscript template textarea title svg iframe object canvas xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Those that begin and end a block of their own; all others, known or not, stand within a line.
BLOCK = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav optgroup option p plaintext "
    "pre search section summary table tbody td tfoot th thead tr ul ol".split()
)
# An opening tag of the key's set ends an open element of the value's.
_LISTS = frozenset("ul ol menu dl table".split())
_SIBLINGS = {
    **dict.fromkeys(("li",), frozenset({"li"})),
    **dict.fromkeys(("dt", "dd"), frozenset({"dt", "dd"})),
    **dict.fromkeys(("td", "th"), frozenset({"td", "th"})),
    "tr": frozenset({"tr", "td", "th"}),
    "option": frozenset({"option"}),
}
# the end tag of a raw element, where ASCII case alone makes no difference
_RAW_ENDS = {name: re.compile(rf"(?ai)</{name}(?=[\s/>])") for name in RAW}


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)}


class _Tags:
    """Where tags end. A ``>`` within quotation marks doesn't end one, unless they never close; once
    a tag would reach the page's end this way, quotation marks count no longer."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True
        self.last = {q: page.rfind(q) for q in "\"'"}

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends the tag whose name ends at ``at``, or -1."""
        page, i = self.page, at
        while self.quotes:
            i = _UNQUOTED.match(page, i).end()
            if i == len(page):
                self.quotes = False
            elif page[i] == ">":
                return i
            elif self.last[page[i]] == i:
                break
            else:
                i = page.index(page[i], i + 1) + 1
        return page.find(">", at)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", decoded run, ""), ("open", tag, raw attributes) and ("close", tag, "")."""
    tags, text, at = _Tags(page), 0, 0  # text: where the run began that isn't given yet

    def run(end: int):
        found = page[text:end]
        return "text", html.unescape(found) if "&" in found else found, ""

    while (lt := page.find("<", at)) >= 0:
        second = page[lt + 1 : lt + 2]
        closes = second == "/"
        name = _NAME.match(page, lt + 1 + closes)
        if name is None:
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                end = len(page) - 1 if end < 0 else end + 2
            elif second in ("!", "?"):
                end = page.find(">", lt)
                if end < 0:
                    break
            else:
                at = lt + 1  # a mark in the text
                continue
        else:
            end = page.find(">", name.end()) if closes else tags.end(name.end())
            if end < 0:
                break  # no tag ends any more: all is text
        if lt > text:
            yield run(lt)
        text = at = end + 1
        if name is None:
            continue
        tag = name[0].lower()
        if closes:
            yield "close", tag, ""
            continue
        attrs = page[name.end() : end]
        yield "open", tag, attrs
        if tag in RAW and not attrs.endswith("/"):
            stop = _RAW_ENDS[tag].search(page, at)
            text = at = stop.start() if stop else len(page)
    if text < len(page):
        yield run(len(page))


_STOPS = _LISTS | {"div", "section", "article", "body", "td", "th"}


class Stack:
    """The open elements: their numbers, and for each tag the depths at which it is open, so that no
    question about them takes longer where they are many."""

    def __init__(self):
        self.numbers, self.tags = [0], ["#"]
        self.open: dict[str, list[int]] = {}

    def push(self, number: int, tag: str) -> None:
        self.open.setdefault(tag, []).append(len(self.tags))
        self.numbers.append(number)
        self.tags.append(tag)

    def cut(self, depth: int) -> list[int]:
        """Closes all from ``depth`` on: their numbers, innermost first."""
        gone = self.numbers[depth:][::-1]
        for tag in self.tags[depth:]:
            self.open[tag].pop()
        del self.numbers[depth:], self.tags[depth:]
        return gone

    def last(self, tag: str) -> int:
        """The depth of the innermost open ``tag``, or -1."""
        depths = self.open.get(tag)
        return depths[-1] if depths else -1

    def closed_by(self, tag: str) -> int:
        """How deep the stack stays when ``tag`` opens: paragraphs, list items and table cells end
        without an end tag."""
        ends = _SIBLINGS.get(tag, frozenset()) | ({"p"} if tag in BLOCK else frozenset())
        found = max(map(self.last, ends), default=-1)
        stop = max(map(self.last, _STOPS - ends), default=-1)
        return found if found > stop else len(self.tags)
