"""Text expressions against Python's own string methods and hand-written cases."""

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from vouchwell.functions import text as T
from vouchwell.functions.gate import gate, has_any, missing_numbers, numbers
from vouchwell.functions.guard import sendable_kind, without_quotes
from vouchwell.functions.identity import one_person
from vouchwell.functions.overlap import skill_overlap, tokens
from vouchwell.sources.decode import unescape_html

ODD = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0  　  ab.,…\"'“”’-Éß1"


def applied(spark, rows, schema, *columns):
    """One tuple per row, in order."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {schema}")
    out = df.select("_i", *[c.alias(f"c{k}") for k, c in enumerate(columns)]).orderBy("_i").collect()
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in out]


@pytest.fixture(scope="module")
def odd_texts():
    draw = random.Random(4)
    return ["", *("".join(draw.choice(ODD) for _ in range(draw.randint(1, 25))) for _ in range(400))]


def test_white_space_is_pythons(spark, odd_texts):
    got = applied(spark, [(t,) for t in odd_texts], "t string", T.strip(F.col("t")), T.lines(F.col("t")), T.normalize(F.col("t")), T.word_count(F.col("t")))
    for t, (bare, lines, normal, words) in zip(odd_texts, got):
        assert bare == t.strip()
        assert lines == t.splitlines()
        straight = t.translate(str.maketrans("’‘“”", "''\"\""))
        assert normal == re.sub(r"\s+", " ", straight).strip()
        assert words == len(re.findall(r"\S+", t))


def test_canonical_is_idempotent(spark, odd_texts):
    once = applied(spark, [(t,) for t in odd_texts], "t string", T.canonical(F.col("t")))
    assert applied(spark, [(t,) for t in once], "t string", T.normalize(F.col("t"))) == once


VERIFY_SPAN = [
    ("built the harbour bridge", True),
    ("BUILT THE\n harbour   Bridge", True),
    ("“built the harbour bridge.”", True),
    ("...built the harbour bridge…", True),
    ("the harbour bridge in Lund, with care", True),
    ("the harbour bridge in Lund with care", False),  # the comma inside is kept
    ("built the harbor bridge", False),
    ("She built the harbour bridge with care", False),  # two passages spliced
    ("bridge", False),  # too short
    ("", False),
    (None, False),
]


def test_verify_span(spark):
    text = "In 2010 she built the harbour\nbridge in Lund, with care. Then she rested."
    got = applied(spark, [(quote, text) for quote, _ in VERIFY_SPAN], "q string, t string", T.verify_span(F.col("q"), F.col("t")))
    assert list(zip([quote for quote, _ in VERIFY_SPAN], got)) == VERIFY_SPAN


def test_planted_passages_verify(spark):
    draw = random.Random(1)
    rows = []
    for _ in range(200):
        words = ["".join(draw.choice("abcdé’-") for _ in range(draw.randint(1, 9))) for _ in range(60)]
        a = draw.randint(0, 40)
        rows.append((" ".join(words[a : a + 12]).upper() if draw.random() < 0.5 else "  ".join(words[a : a + 12]), "\n".join(words)))
    assert all(applied(spark, rows, "q string, t string", T.verify_span(F.col("q"), F.col("t"))))


def test_small_expressions(spark):
    rows = [(' “a  b” ', "<THINK>x\ny</think>left<think>z</think>", "<p>One<script>no</script><b> two</b></p>  <style>p{}</style>end")]
    assert applied(spark, rows, "a string, b string, c string", T.tidy_quote(F.col("a")), T.strip_thinking(F.col("b")), T.html_text(F.col("c"))) == [
        ("a b", "left", "One two end")
    ]


def test_entities(spark):
    rows = [("a &amp; b &nbsp;&eacute; &#39;x&#x27; &unknown;",), (None,)]
    assert applied(spark, rows, "t string", unescape_html(F.col("t"))) == [html.unescape(rows[0][0]), None]


GATE = [
    ("Wants to teach", "I want to teach one day", "ok"),
    ("Seeking a research post", "Wrote papers on soil", "intent"),
    ("Left banking", "Worked in banking", "departure"),
    ("Left banking", "I left banking", "ok"),
    ("Managed ten people", "Worked with ten people", "leadership"),
    ("Burned out by audits", "Did audits for years", "consequence"),
    ("Sold 1,000 boats", "sold 1000 boats", "ok"),
    ("Sold 30 boats in 07", "sold 30 boats in 7", "numbers"),
    ("", "anything", "empty"),
    ("anything", None, "empty"),
    ("Seeking to leave and lead 9", "nothing of it", "intent"),  # the first rule that fails
    ("The tour was cancelled", "no tour took place", "leadership"),  # substrings count
]


def test_gate(spark):
    got = applied(spark, [case[:2] for case in GATE], "c string, q string", gate(F.col("c"), F.col("q")))
    assert [(*case[:2], g.rule) for case, g in zip(GATE, got)] == GATE
    assert all(g.ok == (g.rule == "ok") for g in got)


def test_gate_on_whole_words(spark):
    rows = [("The tour was cancelled", "no tour took place"), ("He led it", "he was there")]
    got = applied(spark, rows, "c string, q string", gate(F.col("c"), F.col("q"), whole_words=True)["rule"], has_any(F.col("c"), ("led",)))
    assert got == [("ok", True), ("leadership", True)]


def test_numbers(spark):
    got = applied(spark, [("1,000 and 07, 7 of 1000", "7 of 9")], "a string, b string", numbers(F.col("a")), missing_numbers(F.col("a"), F.col("b")))
    assert got == [(["1000", "07", "7"], ["07", "1000"])]


GUARD = [
    ("Hi Ada, a note", "salutation"),
    ("first line\n  dear all", "salutation"),
    ("with\nBest,\nM", "sign-off"),
    ("Kind regards", "sign-off"),
    ("I'd love to chat about it", "second-person pitch"),
    ("Would you be open to it?", "second-person pitch"),
    ("I'm reaching out since", "outreach opener"),
    ("I came across your work", "outreach opener"),
    ("Let me know if you agree", "second-person pitch"),
    ("Ask about the move; say what the role lacks.", None),
    ("The best, by far", None),
    (None, None),
]


def test_guard(spark):
    got = applied(spark, [(text,) for text, _ in GUARD], "t string", sendable_kind(F.col("t")))
    assert list(zip([text for text, _ in GUARD], got)) == GUARD


def test_guard_exempts_quotes(spark):
    rows = [("It rests on: I'd love to chat.", ["I'd love to chat", "", None])]
    got = applied(spark, rows, "t string, e array<string>", sendable_kind(F.col("t"), F.col("e")), without_quotes(F.col("t"), F.col("e")))
    assert got == [(None, "It rests on:  [quoted] .")]


ONE_PERSON = [
    ("linkedin.com/in/ada-x and LINKEDIN.com/in/bo_y a@b.org c@d.org", "handles", ["linkedin.com/in/ada-x", "linkedin.com/in/bo_y"]),
    ("Mail a@b.org or C@d.org", "emails", ["a@b.org", "c@d.org"]),
    ("a@b.org A@B.org", None, []),
    ("Experience\nx\nEducation:\ny\nexperience\nz\neducation", "sections", ["education", "experience"]),
    ("Experience\nx\nexperience\ny", None, []),
    (None, None, []),
]


def test_one_person(spark):
    got = applied(spark, [(text,) for text, *_ in ONE_PERSON], "t string", one_person(F.col("t")))
    assert [(text, g.reason, g.evidence) for (text, *_), g in zip(ONE_PERSON, got)] == ONE_PERSON
    assert all(g.ok == (g.reason is None) for g in got)


def test_overlap(spark):
    rows = [("Knows Python, c++ and soil chemistry.", "We want python and C++ for the chemistry. Maps too."), ("x", "")]
    got = applied(spark, rows, "p string, r string", skill_overlap(F.col("p"), F.col("r")), tokens(F.col("r")))
    assert got[0][1] == ["want", "python", "c++", "chemistry.", "maps", "too."]  # a full stop sticks
    assert (got[0][0].matched, got[0][0].matched_count, got[0][0].role_term_count, got[0][0].ratio) == (["c++", "chemistry.", "python"], 3, 6, 0.5)
    assert (got[1][0].matched_count, got[1][0].ratio) == (0, 0.0)


LONG = 1_000_000


def test_very_long_texts_take_seconds(spark):
    """Characters that a pattern could retry from every place, or recurse on, a million of them."""
    from vouchwell.functions.responses import json_object
    from vouchwell.functions.timeline import spans
    from vouchwell.operators.profile_lines import is_furniture

    blanks = f"a{' ' * LONG}b"
    assert applied(spark, [(blanks,), ("." * LONG + "a" + "." * LONG + "b",), (f"January{' ' * LONG}x 2010 -",), ("1" + " " * LONG + "x",)], "t string",
                   F.length(T.strip(F.col("t"))), F.length(T.canonical(F.col("t"))), F.size(spans(F.col("t"))), is_furniture(F.col("t"))) == [
        (LONG + 2, 3, 0, False), (2 * LONG + 2, LONG + 2, 0, False), (LONG + 15, 14, 0, False), (LONG + 2, 3, 0, False)
    ]
    plain, escapes = "x" * LONG, '\\"' * (LONG // 2)
    rows = [(f'{{"a": "{body}"{end}',) for body in (plain, escapes) for end in ("}", "")] + [(f'{{"a": "{escapes}',)]
    got = applied(spark, rows, "t string", json_object(F.col("t"))["failure"])
    assert got == [None, "unterminated", None, "unterminated", "unterminated"]


def _worst():
    from vouchwell.functions.guard import sendable_kind
    from vouchwell.functions.identity import emails, handles
    from vouchwell.functions.timeline import direction, spans

    n = F.length
    marks, lines_, words = "<" * LONG, "\n" * LONG, "from " * (LONG // 5)
    return {
        "letters without an at sign": ("a" * LONG, lambda t: F.size(emails(t)), 0),
        "an at sign, then letters": ("a@" + "b" * LONG, lambda t: F.size(emails(t)), 0),
        "full stops after an at sign": ("a@b" + ".c" * (LONG // 2), lambda t: F.size(emails(t)), 0),
        "addresses in a row": ("a@b.cd_" * (LONG // 7), lambda t: F.size(emails(t)), 2),
        "handles": ("linkedin.com/in/" * (LONG // 16), lambda t: F.size(handles(t)), 1),
        "tags without end": (marks, lambda t: n(T.html_text(t)), LONG),
        "scripts without end": ("<script" * (LONG // 7), lambda t: n(T.html_text(t)), LONG // 7 * 7),
        "styles without end after a script": ("<script></script>" + "<style" * (LONG // 6), lambda t: n(T.html_text(t)), LONG // 6 * 6),
        "scripts without end after a style": ("<STYLE></style>" + "<script" * (LONG // 7), lambda t: n(T.html_text(t)), LONG // 7 * 7),
        "thoughts without end": ("<think>" * (LONG // 7), lambda t: n(T.strip_thinking(t)), LONG // 7 * 7),
        "line ends": (lines_ + "x", lambda t: sendable_kind(t), None),
        "blanks": (" " * LONG + "x", lambda t: sendable_kind(t), None),
        "salutations": ("hi 1 " * (LONG // 5), lambda t: sendable_kind(F.concat(F.lit("1"), t)), None),
        "sign-offs": ("thanks," + "\t " * (LONG // 2), lambda t: sendable_kind(t), None),
        "moves from nowhere": (words, lambda t: direction(t, spans(F.lit(""))), None),
    }


WORST = ("letters without an at sign", "an at sign, then letters", "full stops after an at sign", "addresses in a row", "handles", "tags without end",
         "scripts without end", "styles without end after a script", "scripts without end after a style", "thoughts without end", "line ends", "blanks",
         "salutations", "sign-offs", "moves from nowhere")


@pytest.mark.parametrize("name", WORST)
def test_worst_inputs_take_two_seconds(spark, name):
    import time

    text, of, want = _worst()[name]
    applied(spark, [("x",)], "t string", of(F.col("t")))  # compiled once
    began = time.perf_counter()
    assert applied(spark, [(text,)], "t string", of(F.col("t"))) == [want]
    assert time.perf_counter() - began < 4  # two seconds, and the session's own


CODE = [
    "a<script>b</script>c<style>d</style>e",
    "<style>a<script>b</style>c</script>d",
    "<script>a<style>b</script>c</style>d<script>e",
    "a<STYLE>b</style>c<style>d<script>e</Script >f</script>g<style>h",
    "<script<script></script></script><style",
    "\ufdd0<style>a</style>\ufdd0<script>b",
    "<><a><<b>>c>",
    "no tags",
    "",
]


def test_code_is_left_out_as_the_plain_pattern_has_it(spark):
    def plain(page):
        bare = re.sub(r"<script.*?</script>|<style.*?</style>", " ", page, flags=re.I | re.S)
        return re.sub(r"\s{2,}", " ", re.sub(r"<[^>]+>", " ", bare)).strip(" ")

    assert applied(spark, [(c,) for c in CODE], "t string", T.html_text(F.col("t"))) == [plain(c) for c in CODE]


def test_addresses_are_those_of_the_plain_pattern(spark):
    from vouchwell.functions.identity import EMAIL, emails

    texts = ["a@b.com_x@y.org", "a.b@c.de,f@g.h.ij k@l", "@a@b.cc@d.ee", "x@y..zz a@b.c1 a+b%c@d-e.fgh1", "a@b.cdz@e.fg"]
    assert applied(spark, [(t,) for t in texts], "t string", emails(F.col("t"))) == [list(dict.fromkeys(re.findall(EMAIL, t))) for t in texts]


def test_salutations_at_the_start_of_a_line(spark):
    from vouchwell.functions.guard import sendable_kind

    texts = ["x\n \n\t hey 1", "x hey 1", "\r\n dear 1", "x\rhello", "say\n1 hi"]
    assert applied(spark, [(t,) for t in texts], "t string", sendable_kind(F.col("t"))) == ["salutation", None, "salutation", None, None]
