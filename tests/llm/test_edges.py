"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from vouchwell.llm import extraction, language, media, mixing, near_copies, packing, quality, queries, quoting, simhash, spotsigs, substrings

CLASHES = ["size", "bytes", "row", "key", "part", "rank", "kept", "copies", "fp", "_rest", "_size", "_id", "label", "host", "n_bytes"]
LONG = "the quick brown fox jumps over the lazy dog " * 9000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)


def odd_documents(spark):
    rows = [
        (1, None, "en", "a", None),
        (2, "", "en", "a", 0),
        (3, LONG, "en", "a", len(LONG)),
        (4, LONG, "en", None, len(LONG)),
        (5, "  \n\t ", None, "b", 5),
        (6, "the same words in the same order and more of the same", "en", "b", 53),
        (6, "the same words in the same order and more of the same", "en", "b", 53),
        (7, "Käse über Straßen 日本語 \U0001f600 the end of it", "de", "b", 40),
        (None, "a text without any number but with words in it", "en", "b", 46),
        (8, "one", "fr", "c", 3),
        (9, "x" * 5000, None, "c", 5000),
    ]
    return spark.createDataFrame([(*r, *["z"] * len(CLASHES)) for r in rows], SCHEMA)


OPERATORS = {
    "media": lambda d: media.text_media(d),
    "spotsigs": lambda d: spotsigs.compare_neighbours(d),
    "similar_sets": lambda d: spotsigs.similar_sets(d),
    "packing": lambda d: packing.pack_documents(d, queries.tokenizer_path()),
    "language": lambda d: language.identify_documents(d),
    "keep_identified": lambda d: language.keep_identified(d),
    "substrings": lambda d: substrings.cut_repeats(d),
    "remove_repeats": lambda d: substrings.remove_repeats(d),
    "simhash": lambda d: simhash.components(d),
    "keep_one": lambda d: simhash.keep_one(d),
    "mixing": lambda d: mixing.mix(d),
    "mix_documents": lambda d: mixing.mix_documents(d),
    "quality": lambda d: quality.classify_documents(d, d.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 2).alias("toxic"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    docs = odd_documents(spark)
    out = OPERATORS[name](docs)
    rows = out.collect()
    assert rows
    if name in ("keep_identified", "remove_repeats", "keep_one", "mix_documents"):
        assert out.columns == docs.columns


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](odd_documents(spark).limit(0)).collect() == []


def test_rows_per_document(spark):
    docs = odd_documents(spark)
    n = docs.count()
    for name in ("media", "substrings", "simhash", "language", "mixing", "quality", "spotsigs", "similar_sets"):
        assert OPERATORS[name](docs).count() == n, name


def test_pages_and_messages(spark):
    pages = spark.createDataFrame(
        [(1, "u", None, "z"), (2, None, "", "z"), (3, "u", "<p>one<p>two", "z"), (3, "u", "<p>one<p>two", "z"), (None, "u", "<div>" * 3000 + "deep", "z")],
        "page_id long, url string, html string, text string",
    )
    got = extraction.extract_pages(pages).orderBy("_row.page_id").collect()
    assert [r.text for r in got] == ["deep", "", "", "one\ntwo", "one\ntwo"]
    assert extraction.extract_pages(pages.limit(0)).collect() == []
    assert media.parse_sequences(pages, "page_id").count() == 5
    talk = spark.createDataFrame(
        [(1, 0, "user", None, "z"), (1, 1, None, "", "z"), (None, 0, "user", "> q", "z"), (1, None, "user", "> q\nx", "z"), (2, 0, "user", "a", "z"), (2, 0, "user", "a", "z"), (3, 0, "user", "> " * 4000 + "x", "z")],
        "conv_id long, turn long, role string, text string, level string",
    )
    assert quoting.format_messages(talk).count() == 7
    assert quoting.format_messages(talk.limit(0)).collect() == []


def test_pipeline_on_odd_rows(spark):
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == odd_documents(spark).columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0


def test_pipeline_on_an_empty_table(spark, tmp_path):
    odd_documents(spark).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("keep", [simhash.keep_one, near_copies.keep_one])
def test_null_ids_are_kept_once_at_most(spark, keep):
    a, b, c = ("the quick brown fox jumps over the lazy dog today", "an altogether different text on boats and their harbours", "a third one of some other matter, say bread")
    rows = [(1, a), (None, a), (None, b), (None, b), (None, c), (2, c), (2, c)]
    got = sorted((r.doc_id or 0, r.text) for r in keep(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(1, a), (0, b), (2, c)])


def test_repeated_rows_are_drawn_one_by_one(spark):
    """Sources of equal rows come within one document of their target."""
    rows = [(i % n, "four words of text " * 4, s) for s, n in (("a", 1), ("b", 3), ("c", 400), ("d", 1)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    for seed in (1, 2, 3):
        got = mixing.mix(docs, seed=seed).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("_copies") * 16).alias("taken"), F.first("_target").alias("target")).collect()
        assert {r.source: r["n"] for r in got} == dict.fromkeys("abcd", 400)
        for r in got:
            assert abs(r.taken - r.target) <= 16, r


def test_ids_of_other_kinds(spark):
    docs = odd_documents(spark)
    for kind in ("smallint", "decimal(20,0)"):
        cast = docs.withColumn("doc_id", F.col("doc_id").cast(kind))
        for name in ("spotsigs", "packing", "similar_sets", "substrings"):
            assert OPERATORS[name](cast).count() >= docs.count(), (kind, name)


def test_values_of_odd_rows(spark):
    """What nulls, repeats and blank texts give, row by row."""
    docs = odd_documents(spark).filter("doc_id is null or doc_id not in (3, 4)")
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    marks = {r.doc_id: r for r in spotsigs.compare_neighbours(docs).collect()}
    assert (marks[1].n_chars, marks[1].near_edited) == (0, 1.0) and marks[1].fingerprint == marks[2].fingerprint
    assert marks[6].fingerprint and marks[8].n_chars == 3
    same = [r for r in spotsigs.compare_neighbours(docs).collect() if r.doc_id == 6]
    assert len(same) == 2 and max(r.near_next for r in same) == 1.0
    pieces = sorted(packing.pack_documents(docs, queries.tokenizer_path()).collect(), key=key)
    assert [(r.doc_id, r.length, r.doc_tokens) for r in pieces][:2] == [(1, 1, 1), (2, 1, 1)]
    assert sum(r.doc_id == 6 for r in pieces) == 2 and pieces[-1].doc_id is None
    prints = {r.doc_id: r for r in simhash.components(docs).collect()}
    assert prints[1].fp == prints[2].fp == prints[5].fp == 0 and {prints[i].component_id for i in (1, 2, 5)} == {1}
    assert prints[6].component_id == 6 and prints[None].component_id is None
    sets = [r for r in spotsigs.similar_sets(docs).collect()]
    assert len({r.class_key for r in sets if r.doc_id in (1, 2, 5)}) == 1
    assert len({r.component_key for r in sets}) > 4 and all(r.class_key is not None for r in sets)
