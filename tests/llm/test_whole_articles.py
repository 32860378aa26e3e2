"""Articles with header blocks, several sections and telling class names stay whole."""

import pytest

from vouchwell.llm import extraction

LONG = "Here is a paragraph of the article, which has several clauses, and goes on; it says something. "
NOISE = '<nav><a href="/">Home</a></nav>{}<div id="comments"><p>I agree, really. So well said!</p></div><footer>(c) Someone.</footer>'


def got(article):
    return extraction.extract(f"<html><body>{NOISE.format(article)}</body></html>").split("\n")


@pytest.mark.parametrize("tag", ["article", "div"])
def test_header_block(tag):
    head = "<header><h1>Title</h1><p>A short lead.</p></header>" if tag == "article" else "<div><h1>Title</h1><p>A short lead.</p></div>"
    body = "".join(f"<p>{LONG * 2}{i}</p>" for i in range(8))
    assert got(f"<{tag}>{head}<div class='body'>{body}</div></{tag}>") == ["Title", "A short lead.", *[f"{LONG * 2}{i}" for i in range(8)]]


@pytest.mark.parametrize("tag", ["article", "div"])
def test_sections_of_unequal_length(tag):
    parts = [f"<section><h2>S{k}</h2>" + "".join(f"<p>{LONG * 2}{k}{i}</p>" for i in range(m)) + "</section>" for k, m in enumerate((1, 9, 1))]
    want = [line for k, m in enumerate((1, 9, 1)) for line in [f"S{k}", *[f"{LONG * 2}{k}{i}" for i in range(m)]]]
    assert got(f"<{tag}>{''.join(parts)}</{tag}>") == want


def test_class_words_within_an_article():
    body = "".join(f"<p>{LONG * 2}{i}</p>" for i in range(4))
    more = f'<h2 id="related-work">Related work</h2><section id="discussion"><p>{LONG * 2}d</p></section><div class="notice-text"><p>{LONG * 2}n</p></div>'
    links = '<div class="related"><a href="/a">Another story</a> <a href="/b">One more story</a></div>'
    lines = got(f'<article><header class="entry-header"><h1>Title</h1></header>{body}{more}{links}</article>')
    assert lines == ["Title", *[f"{LONG * 2}{i}" for i in range(4)], "Related work", f"{LONG * 2}d", f"{LONG * 2}n"]
