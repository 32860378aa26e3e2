"""Dated spans, stems, and what the order of spans proves."""

import pytest
from pyspark.sql import functions as F

from tests.test_text import applied
from vouchwell.functions import timeline as L


SPANS = [
    ("Baker\nCorner Bakery\nJanuary 2010 - March 2014", [("Baker — Corner Bakery", 2010, 2014, 2)]),
    ("Baker\n2010 – Present", [("Baker", 2010, None, 1)]),
    ("Baker\n3/2010 to 12.2014", [("Baker", 2010, 2014, 1)]),
    ("Baker\n1/2/2010 until 3/4/2012", [("Baker", 2010, 2012, 1)]),
    ("Baker\n'98 - '04", [("Baker", 1998, 2004, 1)]),
    ("Baker\nSince May 2015", [("Baker", 2015, None, 1)]),
    ("Miller, Old Mill, 2001 - 2003", [("Miller, Old Mill", 2001, 2003, 0)]),
    ("In 2010 we moved and by 2014 - so it goes - we left.", []),
    ("2010 - 2014", []),  # no label
    ("Experience\n2010 - 2014", []),  # a heading is no label
    ("This is a sentence.\n2010 - 2014", []),
    ("Baker\n\n\n2010 - 2012\nCook\n2008 - 2009", [("Cook", 2008, 2009, 5), ("Baker", 2010, 2012, 3)]),
    ("Cook\n2010 - now\nBaker\n2010 - 2011", [("Baker", 2010, 2011, 3), ("Cook", 2010, None, 1)]),
    ("2019-2023  Baker, Corner Bakery", []),  # leading dates are none of the forms
    ("", []),
    (None, []),
]


def test_spans(spark):
    got = applied(spark, [(text,) for text, _ in SPANS], "t string", L.spans(F.col("t")))
    assert [(text, [tuple(x) for x in found]) for (text, _), found in zip(SPANS, got)] == SPANS


def test_summary(spark):
    text = "Cook\n2010 - now\nBaker\n2008 - 2010"
    assert applied(spark, [(text,)], "t string", L.summary(L.spans(F.col("t")))) == ["2008-2010: Baker\n2010-present: Cook"]


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("teaching", "teacher", True), ("teach", "teachers", True), ("engineering", "engine", True), ("baker", "baking", True), ("cook", "book", False), ("used", "uses", False)],
)
def test_stems(spark, a, b, same):
    assert applied(spark, [(a, b)], "a string, b string", L.same_word(F.col("a"), F.col("b"))) == [same]


def test_distinctive_words(spark):
    assert applied(spark, [("Senior Baker of the C++ and go Ovens, ovens",)], "t string", L.distinctive_words(F.col("t"))) == [["baker", "c++", "ovens"]]


RECORD = "Baker\nCorner Bakery\n2005 - 2010\nFirst up at four every day\nTeacher\nNorth School\n2010 - Present\nWrote the maths course"


DEPARTURE = [
    ("First up at four every day", True),  # stands under a role that ended before the next began
    ("Wrote the maths course", False),  # still held
    ("I baked bread", True),  # not in the text: by words
    ("something else", False),
    ("", False),
    (None, False),
]


def test_departure(spark):
    rows = [(quote, RECORD) for quote, _ in DEPARTURE]
    got = applied(spark, rows, "q string, t string", L.proves_departure(F.col("q"), L.spans(F.col("t")), F.col("t")))
    assert list(zip([quote for quote, _ in DEPARTURE], got)) == DEPARTURE


ORDER = [
    ("Moved from baking to teaching", True, False),
    ("Moved from teaching into the bakery", False, True),
    ("Moved from teaching to sailing", False, False),
    ("Bakes and teaches", False, False),
    (None, False, False),
]


def test_order(spark):
    s = L.spans(F.col("t"))
    rows = [(claim, RECORD) for claim, *_ in ORDER]
    got = applied(spark, rows, "c string, t string", L.confirms_order(F.col("c"), s), L.contradicts_order(F.col("c"), s))
    assert [(claim, *found) for (claim, *_), found in zip(ORDER, got)] == ORDER


def test_equal_years_give_no_order(spark):
    text = "Baker\n2005 - 2010\nTeacher\n2005 - 2012"
    s = L.spans(F.col("t"))
    assert applied(spark, [("from baker to teacher", text)], "c string, t string", L.confirms_order(F.col("c"), s), L.contradicts_order(F.col("c"), s)) == [(False, False)]
