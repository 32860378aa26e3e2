"""Language ID, HTML extraction, quotation linking and the quality classifier: planted cases,
held-out accuracy, and plain restatements."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.test_sources import rows_of
from vouchwell.llm import extraction, language, quality, queries, quoting
from vouchwell.llm._shared import materialize

DATA = "/root/testdata/sf0.01"


# --- language ID ---


def test_language_accuracy(spark):
    """Models fitted on the rows of even id, scored on those of odd id, whose declaration is taken away."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("length(text) > 60")
    evidence = language.document_evidence(docs.filter("doc_id % 2 = 1")).withColumn("declared", F.lit(None).cast("string"))
    labelled = language.labelled_documents(docs.filter("doc_id % 2 = 0"))
    found = {r.doc_id: r.language for r in language.identify(evidence, labelled).collect()}
    said = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    right = np.mean([found[d] == said[d] for d in found])
    assert right > 0.97, right


def test_priors_and_declarations_decide_unclear_texts(spark):
    rows = [(i, "the cat and the dog of the house", "en", "en.example.org") for i in range(40)]
    rows += [(100 + i, "der hund und die katze mit dem haus", "de", "de.example.de") for i in range(40)]
    rows += [(200, "xq", None, "de.example.de"), (201, "xq", None, "en.example.org"), (202, "12 34", "en", "en.example.org"), (203, "vv", "de", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in language.identify_documents(docs).collect()}
    assert [got[i].language for i in (0, 100, 200, 201, 203)] == ["en", "de", "de", "en", "de"]
    assert (got[202].language, got[202].kept) == ("und", False)


def test_keep_identified_rejects_what_it_says(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r.doc_id for r in language.keep_identified(docs).select("doc_id").collect()}
    said = {r.doc_id: r.kept for r in queries.op4_language_id(spark, DATA).collect()}
    assert kept == {d for d, k in said.items() if k}


def test_page_evidence(spark):
    pages = spark.createDataFrame(
        [(1, "https://A.Example.de/x", '<html lang="de-AT"><script>var a</script><p>Haus &amp; Hof</p>'), (2, None, None), (3, "bad url", "<p>x")], "page_id long, url string, html string"
    )
    got = {r.page_id: r for r in language.page_evidence(pages).collect()}
    assert (got[1].declared, got[1].host, got[1].suffix, got[1].text.split()) == ("de", "a.example.de", "de", ["Haus", "Hof"])
    assert (got[2].declared, got[2].host, got[2].text) == (None, None, None)


# --- HTML extraction ---

LONG = "Here is a paragraph of the article, which has several clauses, and goes on; it says something. "


def page(article):
    return (
        '<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><a href="/">Home</a></header>'
        '<nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav><div class="ad">Buy this thing now, it is cheap.</div>'
        f'{article}<aside>Related: other things.</aside><div id="comments"><p>I agree with all of it, really. So well said!</p></div>'
        '<form><p>Sign up for the letter, please.</p></form><footer>&copy; 2020 Someone, somewhere.</footer></body></html>'
    )


@pytest.mark.parametrize("tag", ["article", "div", 'div class="content main-text"', "main"])
def test_extraction(tag):
    body = [f"{LONG * k}Part {k}." for k in (2, 1, 3)]
    inner = f"<h1>The title</h1><p>{body[0]}</p><p>{body[1]}<br>after a break</p><ul><li>short</li><li>items</li></ul><blockquote>{body[2]}</blockquote><p>Fin &eacute;t&eacute;&nbsp;  ok</p>"
    got = extraction.extract(page(f"<{tag}>{inner}</{tag.split()[0]}>"))
    assert got.split("\n") == ["The title", body[0], f"{body[1]} after a break", "short", "items", body[2], "Fin été ok"]


def test_extraction_of_odd_pages():
    assert extraction.extract("") == ""
    assert extraction.extract("<script>x</script><!-- y -->") == ""
    assert extraction.extract("plain words only") == "plain words only"
    assert extraction.extract("<p>a < b &lt;c&gt;") == "a < b <c>"
    assert extraction.extract(f"<p>{LONG}<p>{LONG}") == f"{LONG.strip()}\n{LONG.strip()}"


def test_extraction_of_the_tables_pages(spark):
    """The article element of these pages holds the main text; it is found without being looked for
    by name."""
    rows = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    got = {r.page_id: r.text for r in queries.op8_extraction(spark, DATA).collect()}
    right = 0
    for r in rows:
        renamed = re.sub(r"(</?)(article|main)\b", r"\1div", r.html or "")
        right += extraction.extract(renamed) == got[r.page_id]
    assert right >= 0.95 * len(rows)


# --- quotation linking ---


def threads_of(spark, rows):
    talk = spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(rows)], "conv_id long, turn long, role string, text string")
    return {r.turn: r for r in quoting.format_messages(talk).collect()}


def test_quotes_are_linked_and_removed(spark):
    got = threads_of(
        spark,
        [
            "What is the price of the blue boat?\n\nAnd who sells it in the harbour?",
            "> What is the price of  the BLUE boat?\nTen crowns, no more.",
            "On Monday someone wrote:\n>> What is the price of the blue boat?\n> Ten crowns, no more.\n\nThat is cheap.",
            "Something else altogether.",
            "> nobody ever said this sentence\nWho said so?",
            "> And who sells it in the harbour?\r\nThe old man.\r\n",
            "> That is cheap.",
        ],
    )
    assert {t: r.parent_turn for t, r in got.items()} == {0: None, 1: 0, 2: 1, 3: None, 4: None, 5: 0, 6: 2}
    assert {t: r.root_turn for t, r in got.items()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 0, 6: 0}
    assert {t: r.depth for t, r in got.items()} == {0: 0, 1: 1, 2: 2, 3: 0, 4: 0, 5: 1, 6: 3}
    assert got[1].text == "Ten crowns, no more."
    assert got[2].text == "That is cheap."
    assert (got[2].n_quotes, got[2].n_linked) == (2, 2)
    assert got[4].text == "Who said so?"
    assert (got[6].text, got[6].markup) == ("", "<|user|>\n\n<|end|>\n")
    assert all(not re.search(r"(?m)^\s*>", r.text) for r in got.values())


def test_messages_without_quotes_stay(spark):
    rows = spark.read.parquet(f"{DATA}/conversations.parquet").collect()
    want = Counter((r.conv_id, r.turn, r.role, r.text) for r in rows)
    assert Counter((r.conv_id, r.turn, r.role, r.text) for r in queries.op9_quotation(spark, DATA).collect()) == want


@pytest.mark.parametrize("name", ["op9_quotation", "quoted_replies"])
def test_quotation_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{DATA}/conversations.parquet'")
    want = con.sql(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, DATA).toPandas()
    assert (got["parent_turn"].notna().sum() > 40) == (name == "quoted_replies")
    assert rows_of(got) == rows_of(want)


def test_parts_of_messages_are_linked(spark):
    got = threads_of(
        spark,
        [
            "We met at the harbour. The old man sold\nhis boat there. Nobody else came by that day.\n\nNo.\nYes.",
            "Yes.",
            "> The old man sold his boat\n> there.\nDid he?",  # wrapped anew, a sentence of a longer paragraph
            "> No.\nWhy not?",  # short, and said by one message alone
            "> Yes.\nWhy?",  # the whole of a message; a line of an earlier one has it first
            "> old man sold\nWho?",  # part of a sentence
            "> We met at the harbour. The old man sold\n> his boat there. Nobody else\n> came by that day.\n>\n> No.\n> Yes.\nAll?",
        ],
    )
    assert {t: r.parent_turn for t, r in got.items()} == {0: None, 1: None, 2: 0, 3: 0, 4: 0, 5: None, 6: 0}


def test_planted_quotes_in_the_tables_conversations(spark):
    """Every message from the third on quotes the one two before it; a plain loop names its parent."""
    talk = spark.read.parquet(f"{DATA}/conversations.parquet")
    own = {(r.conv_id, r.turn): r.text for r in talk.collect()}
    planted = {k: "> " + own[k[0], k[1] - 2].replace("\n", "\n> ") + "\n\n" + t if (k[0], k[1] - 2) in own else t for k, t in own.items()}
    rows = spark.createDataFrame([(*k, "user", t) for k, t in planted.items()], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in quoting.format_messages(rows).collect()}
    first: dict = {}
    for (conv, turn), t in sorted(own.items()):
        first.setdefault((conv, " ".join(t.lower().split())), turn)
    for (conv, turn), t in own.items():
        assert got[conv, turn].text.strip() == t.strip()
        quoted = own.get((conv, turn - 2))
        assert got[conv, turn].parent_turn == (first[conv, " ".join(quoted.lower().split())] if quoted is not None else None)


def test_quotation_sql_links_quotes_of_the_table(spark, tmp_path):
    """Quotes in the table itself: levels, wrapping, parts, announcements, odd rows."""
    tiny = random.Random(4)
    said = ["Yes.", "No.", "The old man sold\nhis boat there. Nobody came.", "What is the price?\n\nAnd who sells it in the harbour?", "Ten crowns, no more.", "ÄRGER ist groß…  Was nun? ", "a\r\nb\r\rc"]
    rows = []
    for conv in range(60):
        texts = []
        for turn in range(12):
            text = tiny.choice(said)
            for _ in range(tiny.randint(0, 2)):
                old = tiny.choice([*texts, *said, "nobody said this sentence at all"])
                if tiny.random() < 0.5:
                    old = tiny.choice(re.split(r"(?<=[.?]) |\n\n|\n", old))
                if tiny.random() < 0.3:
                    old = old.replace(" ", "\n").upper()
                mark = tiny.choice(["> ", ">", " >  ", "> > ", ">>\t"])
                head = tiny.choice(["", "", "On Monday X wrote:\n", "am 3. schrieb Y:\n", "Le 3 il a écrit :\n", "El 3 Z escribió:\n"])
                text = tiny.choice(["", "Hm.\n"]) + head + mark + old.replace("\n", tiny.choice(["\n", "\r\n"]) + mark) + tiny.choice(["\n", "\n\n", "\r"]) + text
            texts.append(text)
            rows.append((conv, turn, tiny.choice(["user", "assistant", None]), text))
    rows += [(0, 3, "user", "> Yes.\n> No."), (None, 1, "user", "> Yes."), (1, None, "user", "> Yes."), (2, 20, "user", None), (2, 21, "user", ""), (2, 22, "user", "x\u2028> y \n")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(queries.OP9_SQL).df()
    got = queries.op9_quotation(spark, str(tmp_path)).toPandas()
    assert len(got) == len(rows) and (got["parent_turn"].notna().sum() > 200) and got["depth"].max() > 2
    assert rows_of(got) == rows_of(want)


# --- quality ---


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    sited = docs.select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))
    scored = quality.classify(sited, labels.filter("doc_id % 3 <> 0"))
    held = scored.join(labels, "doc_id").filter("doc_id % 3 = 0").toPandas()
    for t in ("quality", "toxic"):
        y, s = held[t].to_numpy(), held[f"{t}_score"].to_numpy()
        right = np.mean((s >= 0.5) == (y == 1))
        assert right > max(0.93, y.mean(), 1 - y.mean()), (t, right)


def test_rates_shrink_towards_parents(spark):
    rows = [(i, float(np.log(0.9 / 0.1)) if i % 10 else 5.0, "big", "a") for i in range(200)]
    rows += [(300, -5.0, "tiny", "a"), (301, -5.0, None, None)]
    evidence = spark.createDataFrame(rows, "doc_id long, quality double, host string, path string")
    got = {(r.h, r.p): r.rate_quality for r in quality.site_rates(evidence, "quality", 0.0).collect()}
    plain = 1 / (1 + np.exp(5.0))
    overall = (sum(1 / (1 + np.exp(-r[1])) for r in rows) + 0.5) / (len(rows) + 1)
    assert plain < got["tiny", "a"] < overall and plain < got[None, None] < overall
    assert overall < got["big", "a"] < 0.95


# --- pipeline ---


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, texts = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, DATA), name)
        assert docs.columns == columns
        texts[name] = {r.doc_id: r.text for r in docs.collect()}
    a, b, c, d = texts.values()
    assert set(a) > set(b) >= set(c) and set(d) <= set(c)
    assert {i: t for i, t in a.items() if i in b} == b
    assert sum(c[i] != b[i] for i in c) > 0
    assert all(c[i] == t for i, t in d.items())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {p.doc_id for p in pieces} == set(d)
