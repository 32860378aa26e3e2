"""Files, intake, accounts, line classes, records, sinks, streams and the driver's queries."""

import io
import json
from collections import Counter
import zipfile

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tests.conftest import DATA
from tests.test_text import applied
from vouchwell.operators import containment, profile_lines, records
from vouchwell.plans import case_queries as made
from vouchwell.plans import oracle
from vouchwell.plans import queries as core
from vouchwell.sources import accounts, decode, files, intake, sinks
from vouchwell.streaming import gates


def docx(xml):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    return out.getvalue()


def test_read_sources(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("Grüße aus Lund", encoding="utf-8")
    (folder / "b.txt").write_bytes(b"\xff\xfe bad")
    (folder / "c.pdf").write_bytes(b"  \n%PDF-1.4 nothing")
    (folder / "d.docx").write_bytes(docx("<w:p><w:t>One &amp; two</w:t></w:p><w:p><w:t>three</w:t></w:p>"))
    (folder / "e.docx").write_bytes(b"not a zip")
    name = F.element_at(F.split("path", "/"), -1).alias("path")
    texts, rejects = files.read_sources(files.scan(spark, str(folder)), by_name=True)
    assert {r.path: r.text for r in texts.select(name, "text").collect()} == {"a.txt": "Grüße aus Lund", "d.docx": "One & two\nthree"}
    assert {r.path for r in rejects.select(name).collect()} == {"b.txt", "c.pdf", "e.docx"}
    texts, rejects = files.read_sources(files.scan(spark, str(folder)).filter("path not like '%docx'"))
    assert [r.text for r in texts.collect()] == ["Grüße aus Lund"]
    assert rejects.count() == 2


def test_pdf_is_known_by_content(spark):
    rows = [(b"%PDF-1.7",), (b"\r\n %PDF",), (b"text %PDF",), (b"",), (None,), (b" " * 1022 + b"%PDF",)]
    assert applied(spark, rows, "c binary", decode.looks_like_pdf(F.col("c"))) == [True, True, False, False, False, False]


def test_joined_sources(spark):
    rows = spark.createDataFrame([(1, "b", "two"), (1, "a", "one"), (2, "c", "x")], "owner long, path string, text string")
    assert {r.owner: r.raw_text for r in files.joined_sources(rows, "owner").collect()} == {1: "one\n\ntwo", 2: "x"}


def test_requests(spark):
    rows = spark.createDataFrame([(1, "ada-x, https://github.com/Bo/\nhttps://example.org/p ,, two words")], "k long, entry string")
    got = files.parse_requests(rows, "k", "entry").orderBy("pos").collect()
    assert [(r.token, r.kind, r.login) for r in got] == [
        ("ada-x", "account", "ada-x"),
        ("https://github.com/Bo/", "account", "Bo"),
        ("https://example.org/p", "url", None),
        ("two words", "url", None),
    ]


def test_fetched_pages(spark):
    pages = spark.createDataFrame([(1, "<p>" + "word " * 30 + "</p>"), (2, "<script>" + "x" * 200 + "</script>"), (3, None)], "k long, html string")
    texts, rejects = files.fetched_pages(pages, "k", "html")
    assert [r.k for r in texts.collect()] == [1] and sorted(r.k for r in rejects.collect()) == [2, 3]


def test_intake(spark):
    rows = spark.createDataFrame(
        [(1, " " + "x" * 80 + "\n", " ", [" a ", " "], "n"), (2, "x" * 79, None, None, None), (3, "  ", "A", None, None), (4, None, None, None, None)],
        "profile_id long, raw_text string, name string, known_roles array<string>, source_notes string",
    )
    kept, rejects = intake.load_profiles(rows)
    assert [tuple(r) for r in kept.collect()] == [(1, "x" * 80, None, ["a"], "n")]
    assert {r.profile_id: r.reason for r in rejects.collect()} == {2: "short", 3: "empty", 4: "empty"}
    roles = spark.createDataFrame(
        [(1, " ", "A role for bakers\nmore", ""), (2, "T", "y" * 81, "c"), (3, None, "z" * 90, None), (4, None, "short", None)],
        "role_id long, title string, raw_description string, company_context string",
    )
    kept, rejects = intake.load_roles(roles)
    assert {r.role_id: r.title for r in kept.collect()} == {1: "A role for bakers", 2: "T", 3: "z" * 77 + "..."}
    assert [r.role_id for r in rejects.collect()] == [4]


def test_accounts(spark):
    bodies = spark.createDataFrame([(json.dumps({"login": "ada", "bio": " bakes ", "created_at": "2009-01-02T00:00:00Z", "public_repos": 3, "followers": 1, "name": ""}),)], "body string")
    repo = lambda i, **x: json.dumps({"name": f"r{i}", "language": "Go", "stargazers_count": 0, "fork": False, "created_at": "2015-01-01", "pushed_at": f"2016-01-{i:02d}", "description": None} | x)
    landed = [repo(1), repo(2, language="C", created_at="2016-02-01", stargazers_count=4, description=" d "), repo(3, fork=True), *[repo(i, fork=True) for i in range(10, 19)], repo(20)]
    repos = accounts.landed(spark.createDataFrame([("ada", x) for x in landed], "login string, body string"), "body", accounts.REPO_JSON)
    recent = accounts.recent_repos(repos)
    assert [r.name for r in recent.orderBy("pos").collect()] == ["r20", "r2"]  # forks take their places on the page
    got = accounts.profile_texts(accounts.landed(bodies, "body", accounts.ACCOUNT_JSON), recent, F.lit("2026-01-01")).collect()[0]
    assert got.name == "ada" and got.source_notes.endswith("landed 2026-01-01")
    lines = got.raw_text.split("\n")
    assert lines[:2] == ["ada (ada)", "Bio: bakes"]
    assert "Written in: Go, C" in lines
    assert "- r20 (2015 to 2016), Go" in lines and "- r2 (2016), C, 4 stars" in lines and "  d" in lines
    assert lines[-1] == "Pushed to in a later year than begun: r20"


PROFILE = """Contact
ada@example.org
+46 (0)70-123 45 67
12-34-56-78
Top Skills
Baking
Teaching others

Summary
She bakes and teaches and writes about both each day.
Page 1 of 2
Experience
Baker
January 2010 - March 2014
2010 - 2014
www.example.org/ada
500+ connections
see example.org for more
Recommendations
Ada is great.

She really is.
Education
North School
"""


def test_line_classes(spark):
    docs = spark.createDataFrame([(1, PROFILE), (2, ""), (3, None)], "k long, t string")
    got = {r.k: r for r in profile_lines.strip_furniture(docs, "k", "t").collect()}
    assert got[1].text.split("\n") == [
        "12-34-56-78",
        "",
        "Summary",
        "She bakes and teaches and writes about both each day.",
        "Experience",
        "Baker",
        "January 2010 - March 2014",
        "2010 - 2014",
        "see example.org for more",
        "Education",
        "North School",
    ]
    assert got[1].removed == [
        "Contact", "ada@example.org", "+46 (0)70-123 45 67", "Top Skills", "Baking", "Teaching others", "Page 1 of 2", "www.example.org/ada",
        "500+ connections", "Recommendations", "Ada is great.", "She really is.",
    ]
    assert (got[2].text, got[2].removed, got[3].text) == ("", [], "")
    kept = [x for x in got[1].text.split("\n") if x.strip()]
    assert sorted(kept + got[1].removed) == sorted(x for x in PROFILE.split("\n") if x.strip())


def test_containment(spark):
    docs = spark.createDataFrame([(1, "One two three four five six."), (2, "five   SIX\nseven eight nine"), (3, None), (4, "short")], "d long, t string")
    quotes = spark.createDataFrame([(1, "two three four"), (2, "“six seven eight”"), (3, "five six"), (4, "nothing of the kind"), (5, None), (6, "Five six seven")], "q long, t string")
    want = [(1, 1), (2, 2), (6, 2)]
    assert sorted(tuple(r) for r in containment.find_quotes(quotes, docs, "q", "t", "d", "t").collect()) == want
    again = docs.unionByName(docs.filter("d = 1")).unionByName(docs.filter("d = 2").withColumn("d", F.lit(None).cast("long")))
    got = [tuple(r) for r in containment.find_quotes(quotes, again, "q", "t", "d", "t").collect()]
    assert Counter(got) == Counter([*want, (1, 1), (2, None), (6, None)])  # repeated rows and null ids are rows of their own
    assert containment.find_quotes(quotes.limit(0), docs, "q", "t", "d", "t").collect() == []
    keyed = quotes.withColumn("d", F.lit(2).cast("long")).withColumnRenamed("t", "e")
    got = containment.verify_keyed(keyed, docs, "d", "e", "t")
    assert {r.q for r in got.filter("verbatim").collect()} == {2, 6}


def test_records(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", None)], "k string, v int")
    b = spark.createDataFrame([("x", 1), ("y", 3), ("w", None), ("z", None)], "k string, v int")
    assert {tuple(r) for r in records.differences(a, b, "k", "v").collect()} == {("y", 2, 3)}
    flat = spark.createDataFrame([(1, '{"a": {"b": 1, "c": "x"}, "d": 2}')], "k int, body string")
    assert {(r.path, r.value) for r in records.flatten_json(flat, "k", "body").collect()} == {("a.b", "1"), ("a.c", "x"), ("d", "2")}
    graded = spark.createDataFrame([("on", 1, True), ("on", 1, False), ("on", 2, True), ("off", 3, False), ("none", 4, None)], "condition string, profile int, verbatim boolean")
    got = {r.condition: r for r in records.condition_rollup(graded).collect()}
    assert (got["on"].claims, got["on"].fabricated, got["on"].fully_clean, got["on"].fabrication_rate) == (3, 1, 1, pytest.approx(0.333))
    assert got["off"].fully_invented == 1 and got["none"].fabrication_rate is None
    entries = spark.createDataFrame([(f"l{i % 10}", i, f"v{i}") for i in range(40)], "label string, at int, v string")
    assert [r.v for r in records.keep_latest(entries, "label", "at").collect()] == [f"v{i}" for i in range(39, 31, -1)]
    nodes, edges = records.graph(spark.createDataFrame([(1, "departures", 0, 0.0), (1, "pursuits", 0, 1.0)], "profile_id long, kind string, pos int, confidence double"))
    assert sorted((r.confidence, round(r.x), round(r.y)) for r in nodes.collect()) == [(0.15, 387, 0), (1.0, -200, 0)]
    assert [(r.a, r.b) for r in edges.orderBy("b").collect()] == [(0, 1), (0, 2)]


def test_owner_and_later_start(spark):
    points = spark.createDataFrame([(1, 5, "a"), (1, 1, "b"), (2, 9, "c")], "k int, at int, p string")
    owners = spark.createDataFrame([(1, 2, "s"), (1, 5, "t"), (1, 6, "u")], "k int, since int, owner string")
    got = records.owner_before(points, owners, "k", "at", "since", ["owner"]).collect()
    assert {(r.p, r.owner) for r in got} == {("a", "t"), ("b", None), ("c", None)}
    spans = spark.createDataFrame(
        [(1, "a", 2000, 2005), (1, "b", 2005, None), (2, "c", 2000, 2000), (3, "d", 2000, 2000), (3, "e", 2000, 2000), (None, "f", 2000, 2000), (None, "g", 2001, 2001)],
        "k int, i string, s int, e int",
    )
    got = records.later_start_exists(spans, "k", "s", "e", "i").collect()
    assert sorted((r.i, r.followed) for r in got) == [("a", True), ("b", False), ("c", False), ("d", True), ("e", True), ("f", False), ("g", False)]


def test_sinks_and_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Managed ten people", "Worked with ten people here", "He worked with ten people here"), (2, "Hi Ada, see", "invented words", "other text")], "id long, description string, evidence string, raw_text string")
    rows.write.parquet(str(tmp_path / "claims"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "claims"))
    query = gates.gate_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.id: (r.verbatim, r.rule, r.sendable) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: (True, "leadership", None), 2: (False, "ok", "salutation")}
    sinks.write_by(rows, "id", str(tmp_path / "by"))
    assert sorted(p.name for p in (tmp_path / "by").glob("id=*")) == ["id=1", "id=2"]
    sinks.write_json(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def shown(v):
    if not isinstance(v, list) and pd.isna(v):
        return "null"
    return f"{v:.9g}" if isinstance(v, float | int) and not isinstance(v, bool) else str(v)


def rows_of(df):
    return sorted(tuple(map(shown, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


SQL = {**oracle.ORACLE_SQL, **made.ORACLE_SQL}


@pytest.mark.parametrize("name", list(SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    folder = f"{DATA}/sf0.001"
    for t in ("documents", "benchmark", "labels", "pages", "conversations", "events", "orders", "customer", "nation", "supplier", "region", "part"):
        con.sql(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    got, want = {**core.QUERIES, **made.QUERIES}[name](spark, folder).toPandas(), con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["item_id", "doc_id"]
    assert set(core.QUERIES) | set(made.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
