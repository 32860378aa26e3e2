"""Pages with their article's text as a person would copy it out, and a plain walk of the tables'
pages as a second opinion."""

import time
from html.parser import HTMLParser

import pytest

from vouchwell.llm import extraction
from vouchwell.llm.markup import tokens

DATA = "/root/testdata/sf0.01"
A = "The harbour was rebuilt in three years, with stone from the hills; it opened in May."
B = "Nobody had expected the boats to return, but they came, one by one, all summer long."
C = "In autumn the council met again, and it voted for a second pier, somewhat longer."
R = "I was there, too, and I must say that the pier is far too short! Who paid for it, really?"
REMARKS = "".join(f"<p>{R} {k}</p>" for k in range(12))
UNITS = "".join(f'<li class="comment"><b>Bo</b> <a href="/r">Reply</a><p>{R} {k}</p></li>' for k in range(12))
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/b">Boats</a></li></ul></nav>'
FOOT = "<footer><p>Written and printed by the harbour office, all rights reserved, since 1901.</p></footer>"
HEAD = "<!DOCTYPE html><html><head><title>Piers</title><style>p{x:y}</style><script>var a='<p>no</p>';</script></head>"


def around(body):
    return f"{HEAD}<body>{NAV}{body}{FOOT}</body></html>"


PS = f"<p>{A}</p><p>{B}</p><p>{C}</p>"
PAGES = {
    "article": (around(f"<article><h1>Piers</h1>{PS}</article>"), ["Piers", A, B, C]),
    "main": (around(f"<main><h1>Piers</h1>{PS}</main>"), ["Piers", A, B, C]),
    "plain div": (around(f"<div><h1>Piers</h1>{PS}</div>"), ["Piers", A, B, C]),
    "comments longer than the article": (around(f'<article><h1>Piers</h1><p>{A}</p></article><section class="comments">{REMARKS}</section>'), ["Piers", A]),
    "comments within the article": (around(f'<article><h1>Piers</h1><p>{A}</p><section class="comments">{REMARKS}</section></article>'), ["Piers", A]),
    "comments without an article": (around(f'<div><div class="story"><h1>Piers</h1><p>{A}</p></div><div id="comments"><ol>{UNITS}</ol></div></div>'), ["Piers", A]),
    "comments by id": (around(f'<div><h1>Piers</h1><p>{A}</p><p>{B}</p><div id="reader-comments">{REMARKS}</div></div>'), ["Piers", A, B]),
    "comments as articles": (
        around(f'<article><h1>Piers</h1><p>{A}</p><p>{B}</p></article><ol class="comment-list">' + f'<li><article class="comment-body"><p>{R}</p></article></li>' * 9 + "</ol>"),
        ["Piers", A, B],
    ),
    "unnamed remarks after an article": (around(f"<article><h1>Piers</h1><p>{A}</p></article><div>{REMARKS}</div>"), ["Piers", A]),
    "share-price": (around(f'<article><h1>Piers</h1><p>{A}</p><div class="share-price"><p>{B}</p></div></article>'), ["Piers", A, B]),
    "notice-text": (around(f'<article><h1>Piers</h1><p>{A}</p><div class="notice-text"><p>{B}</p></div></article>'), ["Piers", A, B]),
    "aside that quotes": (around(f"<article><h1>Piers</h1><p>{A}</p><aside><p>{B}</p></aside><p>{C}</p></article>"), ["Piers", A, B, C]),
    "aside of links": (around(f'<article><h1>Piers</h1><p>{A}</p><aside><a href="/x">More piers</a> <a href="/y">Old piers</a></aside><p>{C}</p></article>'), ["Piers", A, C]),
    "aside beside": (around(f"<article><h1>Piers</h1><p>{A}</p></article><aside><p>{B}</p></aside>"), ["Piers", A]),
    "related": (around(f'<article><h1>Piers</h1>{PS}<div class="related-posts"><h3>See also</h3><a href="/a">One</a><a href="/b">Two</a></div></article>'), ["Piers", A, B, C]),
    "newsletter": (around(f'<article><h1>Piers</h1><p>{A}</p><div class="newsletter-box"><p>Get our letter, each week, free of charge.</p></div><p>{B}</p></article>'), ["Piers", A, B]),
    "cookie notice": (around(f'<div class="cookie-notice"><p>We use cookies, as all do, to see you; is it fine with you? Yes, or no.</p></div><div><h1>Piers</h1>{PS}</div>'), ["Piers", A, B, C]),
    "advert between": (around(f'<article><h1>Piers</h1><p>{A}</p><div class="ad"><p>Buy a boat, now, at half the price! Call us, or come by.</p></div><p>{B}</p></article>'), ["Piers", A, B]),
    "form around the page": (f'{HEAD}<body><form id="page">{NAV}<article><h1>Piers</h1>{PS}</article>{FOOT}</form></body>', ["Piers", A, B, C]),
    "form within": (around(f"<article><h1>Piers</h1><p>{A}</p><form><p>Your name, please, and your mail:</p><button>Send</button></form><p>{B}</p></article>"), ["Piers", A, B]),
    "sidebar": (around(f'<div><h1>Piers</h1>{PS}</div><div class="sidebar"><p>{R}</p><p>{R}</p></div>'), ["Piers", A, B, C]),
    "widget around all": (f'{HEAD}<body>{NAV}<div class="widget"><h1>Piers</h1>{PS}</div></body>', ["Piers", A, B, C]),
    "body classes": (f'{HEAD}<body class="sidebar comments">{NAV}<div><h1>Piers</h1>{PS}</div>{FOOT}</body>', ["Piers", A, B, C]),
    "header block": (around(f'<article><header class="entry-header"><h1>Piers</h1><p>By the sea.</p></header>{PS}</article>'), ["Piers", "By the sea.", A, B, C]),
    "list": (around(f"<article><h1>Piers</h1><p>{A}</p><ul><li>stone</li><li>wood</li></ul><p>{B}</p></article>"), ["Piers", A, "stone", "wood", B]),
    "table": (around(f"<article><h1>Piers</h1><p>{A}</p><table><tr><td>1901</td><td>stone</td></tr></table></article>"), ["Piers", A, "1901", "stone"]),
    "sections": (around(f"<div><section><h2>One</h2><p>{A}</p></section><section><h2>Two</h2><p>{B}</p><p>{C}</p></section></div>"), ["One", A, "Two", B, C]),
    "links in prose": (around(f'<article><h1>Piers</h1><p>{A} See <a href="/m">the map</a>, too.</p></article>'), ["Piers", f"{A} See the map, too."]),
    "entities": (around(f"<article><h1>Piers &amp; boats</h1><p>{A} &lt;b&gt; &eacute;&nbsp;&#33;</p></article>"), ["Piers & boats", f"{A} <b> é !"]),
    "comment tags": (around(f"<article><h1>Piers</h1><p>{A}<!-- not <p>this</p> --></p><p>{B}</p></article>"), ["Piers", A, B]),
    "unclosed": (f"{HEAD}<body>{NAV}<article><h1>Piers</h1><p>{A}<p>{B}<ul><li>x<li>y</ul>", ["Piers", A, B, "x", "y"]),
    "script end in another case": (around(f"<article><h1>Piers</h1><p>{A}</p><SCRIPT>var t = '<p>no';</Script ><p>{B}</p></article>"), ["Piers", A, B]),
    "dotted capital i": (around(f"<article><h1>{'İ' * 40}</h1><script>var t = 1;</script><p>{A}</p><p>{B}</p></article>"), ["İ" * 40, A, B]),
    "mark in an attribute": (around(f'<article><h1>Piers</h1><p title="a > b">{A}</p><p>{B}</p></article>'), ["Piers", A, B]),
    "hidden": (around(f'<article><h1>Piers</h1><p>{A}</p><div style="display: none"><p>{R}</p></div><p hidden>{R}</p><p>{B}</p></article>'), ["Piers", A, B]),
    "nothing but a menu": (f"{HEAD}<body>{NAV}</body>", [""]),
    "a footer and a form": (f"{HEAD}<body>{FOOT}<form>Sign in, please.</form></body>", [""]),
    "a script in a paragraph": (around(f"<article><p>Hello, dear <script>var x;</script>world. {A}</p></article>"), [f"Hello, dear world. {A}"]),
    "other elements in a paragraph": (around(f"<article><p>One <noscript>x</noscript>two <svg><path/></svg>three <x-mark>four</x-mark> {A}</p></article>"), [f"One two three four {A}"]),
    "a button in a paragraph": (around(f"<article><p>One <button>Press</button>two {A}</p></article>"), [f"One two {A}"]),
    "formulas": (around(f"<article><p>{A} So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>"), [f"{A} So x=2 holds."]),
    "comments under a plain heading": (around(f"<article><h1>Piers</h1><p>{A}</p><p>{B}</p><section><h3>3 comments</h3><div>{REMARKS}</div></section></article>"), ["Piers", A, B]),
    "comments in main": (around(f'<main><h1>Piers</h1><p>{A}</p><p>{B}</p><h2>Comments</h2><ol class="thread"><li><p>{R}</p></li><li><p>{R}</p></li></ol></main>'), ["Piers", A, B]),
    "comments under a boxed heading": (around(f"<main><h1>Piers</h1><p>{A}</p><p>{B}</p><div><h2>Comments (2)</h2></div><ol><li><p>{R}</p></li><li><p>{R}</p></li></ol></main>"), ["Piers", A, B]),
    "text after the comments": (around(f"<article><h2>One</h2><p>{A}</p><h3>Comments</h3><div><p>{R}</p></div><h2>Two</h2><p>{B}</p></article>"), ["One", A, "Two", B]),
    "comments as a subject": (around(f"<article><h1>Piers</h1><h2>Comments on the pier</h2><p>{A}</p><p>{B}</p></article>"), ["Piers", "Comments on the pier", A, B]),
    "a list of links in main": (around(f'<main><h1>Piers</h1><p>{A}</p><p>{B}</p><h3>Related stories</h3><ul><li><a href="/x">More piers</a></li><li><a href="/y">Old piers</a></li></ul></main>'), ["Piers", A, B]),
    "a list with one link": (around(f'<article><h1>Piers</h1><p>{A}</p><ul><li><a href="/x">The map</a></li><li>stone</li></ul></article>'), ["Piers", A, "The map", "stone"]),
    "deeper than any stack": (around(f'<article><p>{A}</p>{"<div>" * 3000}<p>{B}</p><div class="ad"><p>{C}</p></div>{"</div>" * 3000}</article>'), [A, B]),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    html, want = PAGES[name]
    assert extraction.extract(html).split("\n") == want


class Walk(HTMLParser):
    """Blocks of the text in the article element."""

    INLINE = {"a", "b", "i", "em", "strong", "span", "small", "u", "code"}

    def __init__(self):
        super().__init__()
        self.depth, self.skip, self.blocks = 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.skip += tag in ("script", "style")
        if tag == "br":
            self.blocks[-1] += " "
        elif tag not in self.INLINE:
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.skip -= tag in ("script", "style")
        if tag not in self.INLINE:
            self.blocks.append("")

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.blocks[-1] += data


def walked(html):
    w = Walk()
    w.feed(html or "")
    w.close()
    return "\n".join(x for x in (" ".join(b.split()) for b in w.blocks) if x)


def test_paths_decide_within_articles(spark, monkeypatch):
    """Without what the paths say, the tables' articles with planted link lists come out otherwise."""
    rows = spark.read.parquet(f"{DATA}/pages.parquet").limit(40).collect()
    links = "<h4>More</h4><ul>" + '<li><a href="/x">another page</a></li>' * 3 + "</ul>"
    planted = {r.page_id: r.html.replace("</article>", f"{links}</article>") for r in rows if "<article>" in (r.html or "")}
    assert planted
    assert {k: extraction.extract(h) for k, h in planted.items()} == {r.page_id: walked(r.html) for r in rows if r.page_id in planted}
    monkeypatch.setattr(extraction, "_content", lambda page, live: set(page.path))
    assert all(extraction.extract(h) != walked(h.replace(links, "")) for h in planted.values())


def test_tables_pages_equal_a_plain_walk(spark):
    rows = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    assert {r.page_id: extraction.extract(r.html or "") for r in rows} == {r.page_id: walked(r.html) for r in rows}


@pytest.mark.parametrize("unit", ['<a "', "<a '", '<a "<a >"', "<a ", "<b>", "<i><h1></h1>", "<p", "<!--", "</", "&lt", "<div class='x'>", "<script>", '<p title="'])
def test_time_grows_with_length(unit):
    """A million characters of what a reader could look at again and again."""
    page = unit * (1_000_000 // len(unit))
    began = time.perf_counter()
    for _ in tokens(page):
        pass
    assert time.perf_counter() - began < 2
    extraction.extract(page[:200_000])
    assert time.perf_counter() - began < 8
