"""PDFs, likeness, rounding, entities, quotes by filters, nested records, names, addresses, landing
tables and the two sets of rules: against Python's own library, hand-written values and SQL."""

import html
import json
import random
import zlib
from difflib import SequenceMatcher
from html.entities import html5

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vouchwell.functions.entities import unescape
from vouchwell.functions.rounding import round_half_even
from vouchwell.functions.urls import normal_url
from vouchwell.operators import containment, dialects, named, records
from vouchwell.operators.drops import verdicts
from vouchwell.operators.likeness import Indexed, likeness, longest_run
from vouchwell.plans import data_queries as D
from vouchwell.plans.made_pdfs import make_pdf
from vouchwell.sources import accounts, decode, files
from vouchwell.sources.pdf import CodeTable, pdf_text

DATA = "/root/testdata/sf0.001"


def column(spark, values, kind, expression):
    rows = spark.createDataFrame(list(enumerate(values)), f"_i int, x {kind}").repartition(4)
    return [r.y for r in rows.select("_i", expression(F.col("x")).alias("y")).orderBy("_i").collect()]


# --- PDF ---

TEXT = "Hello (world) \\ back\n\n  two  spaces\tü\nlast line " + "\n".join(f"line {i}" for i in range(150))


@pytest.mark.parametrize("style", ["literal", "hex", "array", "packed"])
@pytest.mark.parametrize("text", [TEXT, "one", "a\n\n\nb"])
def test_made_pdfs_read_back(style, text):
    assert pdf_text(make_pdf(text, style)) == text.strip()


@settings(max_examples=100, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=200), st.sampled_from(["hex", "array", "packed"]))
def test_any_text_reads_back(text, style):
    assert (pdf_text(make_pdf(text, style)) or "") == text.strip()


@pytest.mark.parametrize("style", ["scan", "damaged"])
def test_unreadable_pdfs(style):
    assert pdf_text(make_pdf(TEXT, style)) is None


def pdf(content, font=b"<< /Type /Font /Subtype /Type1 >>", more=b"", stream=b""):
    page = b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Kids [3 0 R] >> endobj 3 0 obj << /Type /Page /Contents 4 0 R /Resources << /Font << /F 5 0 R >> /XObject << /X 6 0 R >> >> >> endobj\n"
    return b"%PDF-1.4\n" + page + b"4 0 obj << /Length %d%s >> stream\n%s\nendstream endobj 5 0 obj %s endobj\n%s" % (len(content), stream, content, font, more)


PDFS = [
    (pdf(b"BT /F 9 Tf (a\\(b\\051\\\nc) Tj 0 -10 Td (d) ' ET"), "a(b)c\n\nd"),
    (pdf(b"BT /F 9 Tf (one) Tj 1 0 0 1 50 700 Tm (two) Tj 1 0 0 1 90 700 Tm (three) Tj 1 0 0 1 40 690 Tm (four) Tj ET"), "one\ntwo three\nfour"),
    (pdf(b"BT /F 9 Tf [(wo) -40 (rd) -400 (next)] TJ T* 1 2 (last) \" ET"), "word next\n\nlast"),
    (pdf(b"BT /F 9 Tf <4142> Tj (\\101\\12B) Tj ET"), "ABA\nB"),
    (pdf(b"BT /F 9 Tf (\223x\224\351) Tj ET"), "“x”é"),
    (pdf(b"BT /F 9 Tf (\351\200) Tj ET", b"<< /Encoding /MacRomanEncoding >>"), "ÈÄ"),
    (pdf(b"BT /F 9 Tf (abcde) Tj ET", b"<< /Encoding << /Differences [97 /fi /eacute 100 /uni20AC /Scaron.alt] >> >>"), "ﬁéc€Š"),
    (pdf(b"BT /F 9 Tf (ab) Tj ET BI /W 1 ID (( \xff EI BT (c) Tj ET"), "ab\nc"),
    (pdf(b"/X Do", more=b"6 0 obj << /Subtype /Form /Length 21 >> stream\nBT (in a form) Tj ET /X Do\nendstream endobj"), "in a form"),
    (pdf(zlib.compress(b"BT (packed) Tj ET"), stream=b" /Filter [/FlateDecode]"), "packed"),
    (pdf(b"4254202868657829 20546a 204554>", stream=b" /Filter /ASCIIHexDecode"), "hex"),
    (pdf(b"BT (wrong length) Tj ET").replace(b"/Length 23", b"/Length 7"), "wrong length"),
    (pdf(b"BT (length elsewhere) Tj ET").replace(b"/Length 27", b"/Length 9 0 R") + b"9 0 obj 27 endobj", "length elsewhere"),
    (b"%PDF 3 0 obj << /Type /Page /Contents [4 0 R 4 0 R] >> endobj 4 0 obj << >> stream\nBT (no tree) Tj ET\nendstream endobj", "no tree\nno tree"),
    (pdf(b"BT (x) Tj ET") + b"\ntrailer << /Root 1 0 R /Encrypt 9 0 R >>", None),
    (pdf(b"BT (says /Encrypt here) Tj ET"), "says /Encrypt here"),
    (pdf(b"BT (never closed"), None),
    (b"", None),
    (b"%PDF-1.4", None),
]


@pytest.mark.parametrize("n", range(len(PDFS)))
def test_pdf(n):
    data, want = PDFS[n]
    assert pdf_text(data) == want


def test_code_tables():
    t = CodeTable(b"1 begincodespacerange <00> <7f> <8000> <ffff> endcodespacerange 2 beginbfrange <8001> <8003> <0041> <20> <21> [<0062> <00630064>] endbfrange 1 beginbfchar <22> <d83dde00> endbfchar")
    assert t.decode(b"\x80\x02\x20\x21\x22\x80\x09\x20") == "Bbcd\U0001f600b"


@pytest.mark.parametrize("unit", [b"1 0 obj << ", b"1 0 obj (", b"[", b"<<", b"trailer << ", b"1 0 obj << >> stream\n", b"(((", b"<41", b"/A#41", b"%x\n"])
def test_pdf_time_grows_with_length(unit):
    import time

    began = time.perf_counter()
    pdf_text(b"%PDF " + unit * (1_000_000 // len(unit)))
    pdf_text(pdf(unit * (1_000_000 // len(unit))))
    assert time.perf_counter() - began < 10


def test_pdfs_as_a_browser_tidies_them(spark):
    rows = ["ﬁnd  the ﬅone,\t‘so’ “they” say\n\n\n\n once  and for all of us", "too short", None]
    assert column(spark, rows, "string", decode.tidy_pdf) == ["find the stone, 'so' \"they\" say\n\nonce and for all of us", None, None]


# --- likeness ---


def test_likeness_of_random_pairs():
    draw = random.Random(3)
    for _ in range(10_000):
        letters = draw.choice(["ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJ0123456789é\U0001f600"])
        text = "".join(draw.choice(letters) for _ in range(draw.choice([0, 5, 50, 199, 200, 201, 400])))
        quote = "".join(draw.choice(letters) for _ in range(draw.choice([1, 12, 30, 90])))
        if text and draw.random() < 0.5:
            at = draw.randrange(len(text))
            quote = quote[:5] + text[at : at + draw.randrange(60)] + quote[5:]
        m = SequenceMatcher(a=quote, b=text)
        run = m.find_longest_match()
        assert longest_run(quote, Indexed(text)) == (run.b, run.size), (quote, text)
        assert likeness(quote, text) == m.ratio(), (quote, text)


def test_drop_verdicts_of_the_tables_texts(spark):
    rows = [r.text.lower() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if r.text][:60]

    def plain(quote, text):
        if len(quote) < 12:
            return {"overlap": 1.0, "reason": "too_short"}
        m = SequenceMatcher(a=quote, b=text).find_longest_match()
        near = round(SequenceMatcher(a=quote, b=text[max(m.b - len(quote) // 2, 0) : m.b + 3 * len(quote) // 2]).ratio(), 3)
        return {"overlap": near, "reason": "near_miss" if m.size >= len(quote) / 2 else "paraphrase" if near >= 0.55 else "fabricated"}

    for i, text in enumerate(rows):
        other = rows[i - 1]
        quotes = [text[3:40] + "zz" + text[40:60], other[:80], text[10:90:2], "short", "an invented passage that nobody wrote 1234", text[20:50][::-1]]
        assert verdicts(quotes, text) == [plain(q, text) for q in quotes]


# --- rounding ---


def test_rounding_of_a_million_doubles(spark):
    draw = np.random.default_rng(1)
    x = np.concatenate([
        draw.random(400_000), draw.integers(0, 200_000, 200_000) / 2000, -(draw.integers(0, 10**6, 200_000) + 0.5) / 1000,
        draw.uniform(-1e6, 1e6, 100_000), draw.random(100_000) * 2.0 ** draw.integers(-60, 60, 100_000), [0.0, -0.0, 2.675, 0.0005, 1e300, 5e-324, np.inf, 0.075],
    ])
    rows = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(4)
    got = rows.select("x", *[round_half_even(F.col("x"), d).alias(f"r{d}") for d in (0, 2, 3, 7)]).toPandas()
    for d in (0, 2, 3, 7):
        assert all(round(a, d) == b for a, b in zip(got.x, got[f"r{d}"]))
    assert np.isnan(column(spark, [float("nan"), 1.0], "double", lambda c: round_half_even(c, 2))[0])
    with pytest.raises(ValueError):
        round_half_even(F.lit(1.0), 8)


# --- entities ---


def test_every_entity(spark):
    rows = [f"a &{n}b &{n} c &{n};d" for n in html5]
    rows += [f"x&#{i};y&#x{i:x}z&#X{i:X};" for i in [*range(300), 0xD7FF, 0xD800, 0xFDD0, 0xFFFE, 0x1FFFE, 0x10FFFF, 0x110000, 10**9, 10**30]]
    rows += ["&", "&&amp;&", "&#;", "&#x;", "&notit; &notin; &ampamp; & amp;", "no", "", "&" * 50, "&amp" * 50]
    assert column(spark, rows, "string", unescape) == [html.unescape(r) for r in rows]
    assert column(spark, [None, "&lt;"], "string", unescape) == [None, "<"]


# --- quotes ---


@pytest.mark.parametrize("keys", [1 << 23, 40])
def test_quotes_by_one_filter_or_by_many(spark, monkeypatch, keys):
    monkeypatch.setattr(containment, "KEYS_A_FILTER", keys)
    draw = random.Random(6)
    rows = [(i, " ".join("".join(draw.choice("abcde") for _ in range(4)) for _ in range(60))) for i in range(60)]
    texts = dict(rows)
    quotes = [(i, t[9 * (i % 7) : 9 * (i % 7) + 13 + i % 20]) for i, t in rows] + [(100 + i, t[5:40][::-1]) for i, t in rows] + [(7, texts[3][20:50])]
    found = containment.find_quotes(spark.createDataFrame(quotes, "q long, t string"), spark.createDataFrame(rows, "d long, t string"), "q", "t", "d", "t")
    want = [(q, d) for q, t in quotes for d, hay in rows if len(t.strip()) >= 12 and t.strip() in hay]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_filters_hold_their_keys_and_little_else():
    draw = np.random.default_rng(2)
    keys = draw.integers(0, 2**64, 20_000, np.uint64)
    bloom = containment.Bloom(keys)
    assert len(bloom.passing(keys)) == len(keys)
    assert len(bloom.passing(draw.integers(0, 2**64, 100_000, np.uint64))) < 300


# --- nested records ---


def nest(n):
    return {"a": n, "b.c": None, "d": [1, {"x": 2}], "e": nest(n - 1), "s": "{not one}", "none": {}} if n else {"end": 0.5}


def plain_fields(value, path=""):
    for k, v in value.items():
        if isinstance(v, dict):
            yield from plain_fields(v, f"{path}{k}.")
        else:
            yield f"{path}{k}", v if isinstance(v, str) or v is None else json.dumps(v, separators=(",", ":"))


def test_records_of_any_depth(spark):
    rows = [(1, json.dumps(nest(24))), (2, json.dumps({"a": 1})), (3, "[1]"), (4, "no"), (5, None), (6, "{}")]
    got = records.flatten_json(spark.createDataFrame(rows, "id long, body string"), "id", "body").collect()
    want = [(i, p, v) for i, body in rows[:2] for p, v in plain_fields(json.loads(body))]
    assert sorted((r.id, r.path, r.value) for r in got if r.value) == sorted(x for x in want if x[2])
    assert sorted((r.id, r.path) for r in got) == sorted(x[:2] for x in want)


# --- names ---


def test_naming(spark):
    claims = [(1, "Moved into teaching"), (1, "Moved into teaching"), (2, "the work of it"), (3, None), (None, "a teacher"), (4, "Bakers and millers")]
    spans = spark.createDataFrame([("Teacher — North School",), ("Teachers' union",), ("Miller",), ("Baker",), ("Baker, again",), (None,)], "label string")
    got = named.naming(spark.createDataFrame(claims, "id long, said string"), "id", "said", spans, "label").collect()
    assert sorted((r.id, r.stem, r.spans) for r in got) == [(1, "teach", 2), (1, "teach", 2), (4, "mill", 1)]
    assert named.naming(spark.createDataFrame(claims, "id long, said string"), "id", "said", spans.limit(0), "label").collect() == []


# --- addresses ---

ADDRESSES = [
    ("http://Example.org", "example.org"), ("HTTPS://www.Example.org:443/", "example.org"), ("example.org/a/b/#c", "example.org/a/b"),
    ("http://example.org/A?q=1#x", "example.org/A?q=1"), ("example.org:8080/", "example.org:8080"), ("example.org/?", "example.org"), ("", None), ("  //", None), (None, None),
]


def test_addresses(spark):
    assert column(spark, [a for a, _ in ADDRESSES], "string", normal_url) == [b for _, b in ADDRESSES]


def test_requests_meet_pages(spark):
    said = "<p>" + "word " * 30 + "</p>"
    pages = spark.createDataFrame([(2, "http://a.org/x", said), (1, "https://www.a.org/x/", said), (3, "b.org", "<p>short</p>"), (4, None, said)], "page_id long, url string, html string")
    asked = files.parse_requests(spark.createDataFrame([(9, "ada, a.org/x#y, B.org, c.org")], "k long, entry string"), "k", "entry")
    found, refused = files.meet_pages(asked, pages, "page_id", "url", "html")
    assert [(r.pos, r.page_id) for r in found.collect()] == [(1, 1)]
    assert sorted((r.pos, r.reason) for r in refused.collect()) == [(2, "no readable text on the page"), (3, "not fetched")]


# --- landing tables ---


def test_landing_folder(spark, tmp_path):
    rows = [("ada", "account", 200, '{"name": "Ada", "followers": 3}'), ("ada", "repos", 200, '[{"name": "a", "fork": false, "pushed_at": "2020"}, {"name": "b", "fork": true, "pushed_at": "2021"}]'),
            ("bo", "account", 404, None), ("cy", "account", 200, '{"name": null}'), ("cy", "repos", 403, "{}"), ("di", "account", 200, "{}"), ("di", "repos", 200, "[]")]
    path = str(tmp_path / "landing")
    spark.createDataFrame(rows, accounts.LANDING).write.partitionBy("kind").json(path)
    landing = accounts.read_landing(spark, path)
    assert "PartitionFilters: [isnotnull(kind" in landing.filter("kind = 'repos'")._jdf.queryExecution().toString()
    people, repos, failures = accounts.accounts_of(landing)
    assert sorted((r.login, r.name, r.followers) for r in people.collect()) == [("ada", "Ada", 3), ("di", None, None)]
    assert [(r.login, r.name) for r in repos.collect()] == [("ada", "a")]
    assert sorted(map(tuple, failures.collect())) == [("bo", "no such account"), ("cy", "rate limit reached")]
    texts = {r.login: r.raw_text for r in accounts.profile_texts(people, repos, F.lit("2026-01-01")).collect()}
    assert texts["ada"].startswith("Ada (ada)\n") and "- a (? to 2020)" in texts["ada"]


# --- two sets of rules ---


def test_dialects(spark):
    text = "I have built ovens, and I like to write about them. In March I built ovens for a school. Nothing else is of note here."
    body = {
        "throughline": "Builds", "throughline_evidence": ["I have built ovens, and", "I have built ovens, and"],
        "departures": [{"description": "Built a team", "evidence": "In March I built ovens for a school"}, {"description": "Writes", "evidence": "I like to write about them", "confidence": 0}],
        "pursuits": [{"description": "Is pursuing a degree", "evidence": "Nothing else is of note here"}, {"description": "Seek them", "evidence": "Nothing else is of note here", "confidence": -1}],
    }
    profiles = spark.createDataFrame([(1, text)], "profile_id long, raw_text string")
    said = spark.createDataFrame([(1, json.dumps(body))], "profile_id long, content string")
    got = {r.field: (r.before, r.now) for r in dialects.differences_between(profiles, said).collect()}
    # by the text rules only "Writes" stands, at 0; the page's miss "built a team" and "seek "
    assert got == {
        "departures.0": (None, "0.5"), "departures.1": ("0.0", "0.5"), "pursuits.1": (None, "-1.0"),
        "headline": ("I have built ovens, and", "I have built ovens, and|I have built ovens, and"),
    }


# --- queries ---


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "events", "pages", "customer", "orders", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def shown(rows):
    return sorted(tuple("" if v is None or v != v else repr(float(v)) if isinstance(v, (int, float)) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", D.QUERIES)
def test_queries_equal_their_sql(spark, duck, name):
    found = D.QUERIES[name](spark, DATA)
    columns = ", ".join(f'"{c}"' for c in found.columns)
    rows = found.collect()
    assert rows
    assert shown(rows) == shown(duck.execute(f"SELECT {columns} FROM ({D.ORACLE_SQL[name]})").fetchall())


def test_careers_have_every_outcome(spark):
    found = {(r.kind, r.pos, r.outcome) for r in D.career_claims(spark, "/root/testdata/sf0.01").collect()}
    assert {(k, p) for k, p, o in found if o == "kept"} == {("departures", 0), ("departures", 1), ("pursuits", 0), ("pursuits", 1)}
    assert ("departures", 0, "contradicts_dates") in found and ("departures", 1, "unsupported") in found and ("pursuits", 1, "unsupported") in found
