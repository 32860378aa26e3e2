"""Dated spans of a text, and what their order proves, as expressions inside one row.

Spans are an array of STRUCT<label, start, end, line>, oldest first; a null end is still running.
Nothing here shuffles: arrays are worked on with higher-order functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vouchwell.functions.lexicon import NOT_A_LABEL, SUFFIXES, WEAK_WORDS
from vouchwell.functions.text import SPACE, SPACE_CLASS, collapse, let, lines, strip

# The forms of a date line.
MONTHS = (
    "January|February|March|April|May|June|July|August|September|October|November|December|"
    "Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
)
OPEN_WORDS = "Present|Current|Now|Today|Ongoing"
_YEAR = r"(?:19|20)[0-9]{2}"
# possessive white space: a long run of it isn't parted in every way between two neighbours
_BEFORE_YEAR = rf"(?:(?:{MONTHS}){SPACE}++|[0-9]{{1,2}}[/.][0-9]{{1,2}}[/.]|[0-9]{{1,2}}[/.])?{SPACE}*+"
_TO = rf"{SPACE}*+(?:[-–—]|to|until){SPACE}*+"
_CLOSE = rf"[{SPACE_CLASS})\]·•]*+$"
RANGE = rf"(?iu)^[{SPACE_CLASS}·•\-–(\[]*+{_BEFORE_YEAR}({_YEAR}){_TO}{_BEFORE_YEAR}({_YEAR}|{OPEN_WORDS}){_CLOSE}"
SINCE = rf"(?iu)^[{SPACE_CLASS}·•(\[]*+(?:since|from){SPACE}++{_BEFORE_YEAR}({_YEAR}){_CLOSE}"
INLINE = rf"(?iu)^(.{{3,90}}?)[,;·•{SPACE_CLASS}]++{_BEFORE_YEAR}({_YEAR}){_TO}{_BEFORE_YEAR}({_YEAR}|{OPEN_WORDS}){_CLOSE}"
MAX_LABEL_CHARS = 90
LABEL_LINES = 2
#: Lines above a date that are looked at first; all of them only where these don't settle its label.
NEAR_LINES = 16
#: What a text with a dated span holds somewhere.
ANY_YEAR = rf"{_YEAR}|'[0-9]{{2}}"
MIN_STEM = 3
OPEN_END = 9999

SPAN = "struct<label: string, start: int, end: int, line: int>"
_NO_LABEL = list(NOT_A_LABEL)


def four_digit_years(line: Column) -> Column:
    """``'15`` as 2015 and ``'87`` as 1987: two digits above 40 are of the last century."""
    late = F.regexp_replace(line, r"'(4[1-9]|[5-9][0-9])\b", "19$1")
    return F.regexp_replace(late, r"'([0-9]{2})\b", "20$1")


def _label_above(every: Column, i: Column) -> Column:
    """The one or two short lines above line ``i`` that name its role, joined oldest first."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("stop"))

    def step(state, raw):
        out, n = state["out"], F.size(state["out"])
        bad = lambda line: (
            F.btrim(F.lower(line), F.lit(":")).isin(_NO_LABEL)
            | (F.length(line) > MAX_LABEL_CHARS)
            | line.rlike(r"[.!?]\z")
            | line.rlike(RANGE)
        )
        read = lambda line: (
            F.when(line == "", F.struct(out.alias("out"), (n > 0).alias("stop")))
            .when(bad(line), F.struct(out.alias("out"), F.lit(True).alias("stop")))
            .otherwise(F.struct(F.concat(F.array(line), out).alias("out"), F.lit(False).alias("stop")))
        )
        done = state["stop"] | (n >= LABEL_LINES)
        return F.when(done, F.struct(out.alias("out"), F.lit(True).alias("stop"))).otherwise(let(F.btrim(raw, F.lit(" ·•\t")), read))

    scan = lambda first, n: F.aggregate(F.reverse(F.slice(every, first, n)), start, step)
    n = F.least(i, F.lit(NEAR_LINES))
    near = lambda s: F.when(s["stop"] | (F.size(s["out"]) >= LABEL_LINES) | (n == i), s).otherwise(scan(F.lit(1), i))
    return let(scan(i - n + 1, n), lambda s: F.array_join(near(s)["out"], " — "))


def spans(text: Column) -> Column:
    """All dated spans: a range line or a since line under its label, or a role and its years on
    one line. A range or since line without a label gives none."""
    every = lines(F.when(F.coalesce(text, F.lit("")).rlike(ANY_YEAR), text).otherwise(F.lit("")))

    def of_line(every, raw, i):
        return F.when(~raw.rlike(ANY_YEAR), F.lit(None).cast(SPAN)).otherwise(let(four_digit_years(strip(raw)), lambda bare: dated(every, bare, i)))

    def dated(every, bare, i):
        end = lambda group, pattern: F.regexp_extract(bare, pattern, group).try_cast("int")
        inline = lambda: F.btrim(F.regexp_extract(bare, INLINE, 1), F.lit(" ,;·•-–"))
        span = lambda label, start, stop: F.struct(
            label.alias("label"), start.cast("int").alias("start"), stop.cast("int").alias("end"), i.cast("int").alias("line")
        )
        ranged, since = bare.rlike(RANGE), bare.rlike(SINCE)
        labelled = lambda label: F.when(ranged, span(label, end(1, RANGE), end(2, RANGE))).otherwise(span(label, end(1, SINCE), F.lit(None)))
        return F.when(ranged | since, let(_label_above(every, i), labelled)).when(
            bare.rlike(INLINE), let(inline(), lambda label: F.when(~F.lower(label).isin(_NO_LABEL), span(label, end(2, INLINE), end(3, INLINE))))
        )

    found = let(every, lambda all_: F.transform(all_, lambda raw, i: of_line(all_, raw, i)))
    keyed = F.transform(
        F.filter(found, lambda s: s.isNotNull() & (s["label"] != "")), lambda s: F.struct(s["start"].alias("a"), F.coalesce(s["end"], F.lit(OPEN_END)).alias("b"), s["line"].alias("c"), s.alias("s"))
    )
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def summary(found: Column) -> Column:
    """One ``start-end: label`` line per span."""
    line = lambda s: F.concat(
        s["start"].cast("string"), F.lit("-"), F.coalesce(s["end"].cast("string"), F.lit("present")), F.lit(": "), s["label"]
    )
    return F.array_join(F.transform(found, line), "\n")


def distinctive_words(text: Column) -> Column:
    every = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9+#]+"), F.lit(0))
    weak = F.array(*[F.lit(w) for w in WEAK_WORDS])
    return F.array_except(F.filter(every, lambda w: F.length(w) > 2), weak)


def stem(word: Column) -> Column:
    """One ending less, if three characters stay, then no e at the end."""
    cut = F.regexp_replace(word, rf"^(.{{{MIN_STEM},}}?)(?:{'|'.join(SUFFIXES)})$", "$1")
    return let(cut, lambda c: F.coalesce(F.nullif(F.rtrim(c, F.lit("e")), F.lit("")), c))


def stems(text: Column) -> Column:
    return F.array_distinct(F.transform(distinctive_words(text), stem))


def same_word(a: Column, b: Column) -> Column:
    return (a == b) | (stem(a) == stem(b))


def with_stems(found: Column) -> Column:
    """Spans with the stems of their labels, for a row whose spans are asked more than once."""
    return F.transform(found, lambda s: F.struct(s["label"], s["start"], s["end"], s["line"], stems(s["label"]).alias("stems")))


def matching(text: Column, found: Column) -> Column:
    """The spans whose label shares a distinctive word with the text."""
    return F.filter(found, lambda s: F.arrays_overlap(stems(s["label"]), stems(text)))


def _meeting(text: Column, stemmed: Column) -> Column:
    """``matching`` on spans that carry their stems."""
    return let(stems(text), lambda asked: F.filter(stemmed, lambda s: F.arrays_overlap(s["stems"], asked)))


def owning_span(quote: Column, found: Column, text: Column) -> Column:
    """The span whose date line is nearest above the place where the quote stands in the text."""
    place = lambda sought: F.when((sought != "") & (F.coalesce(text, F.lit("")) != ""), F.instr(text, sought))
    line = lambda at: F.when(at > 0, F.regexp_count(F.substring(text, F.lit(1), at - 1), F.lit("\n")))
    above = lambda last: F.filter(found, lambda s: (s["line"] >= 0) & (s["line"] <= last))
    latest = lambda last: F.array_max(F.transform(above(last), lambda s: F.struct(s["line"].alias("line"), s.alias("span"))))
    return let(let(let(strip(F.coalesce(quote, F.lit(""))), place), line), latest)["span"]


def departure_shown(quote: Column, stemmed: Column, text: Column) -> Column:
    """``proves_departure`` on spans that carry their stems."""
    candidates = lambda owner: F.when(owner.isNotNull(), F.array(owner)).otherwise(_meeting(quote, stemmed))
    followed = lambda s: F.exists(
        stemmed, lambda o: (o["line"] != s["line"]) & F.coalesce(o["start"] >= s["end"], F.lit(False))
    )
    shown = let(owning_span(quote, stemmed, text), lambda o: F.exists(candidates(o), lambda s: s["end"].isNotNull() & followed(s)))
    return F.coalesce(shown, F.lit(False))


def proves_departure(quote: Column, found: Column, text: Column) -> Column:
    """Did the quote's role end, and another span start at or after its end?"""
    return let(with_stems(found), lambda s: departure_shown(quote, s, text))


# the first "from" alone: where nothing follows it, nothing follows a later one
_MOVE = r"(?U)^(?>.*?\bfrom\b)(.+?)\b(?:to|into|toward|towards)\b(.+)"


def stated_move(claim: Column, stemmed: Column) -> Column:
    """``direction`` on spans that carry their stems."""

    def of(said):
        first = lambda group: F.array_min(
            F.transform(_meeting(F.regexp_extract(said, _MOVE, group), stemmed), lambda s: s["start"])
        )
        ends = let(
            F.struct(first(1).alias("before"), first(2).alias("after")),
            lambda d: F.when(d["before"].isNotNull() & d["after"].isNotNull(), d),
        )
        return F.when(F.contains(said, F.lit("from")), ends)

    return let(F.concat(F.lit(" "), collapse(F.lower(F.coalesce(claim, F.lit("")))), F.lit(" ")), of)


def direction(claim: Column, found: Column) -> Column:
    """STRUCT<before, after>: the earliest starts of what a claimed move names on each side; null
    where the claim states no move between two things in the record."""
    return let(with_stems(found), lambda s: stated_move(claim, s))


def confirms_order(claim: Column, found: Column) -> Column:
    d = direction(claim, found)
    return F.coalesce(d["before"] < d["after"], F.lit(False))


def contradicts_order(claim: Column, found: Column) -> Column:
    d = direction(claim, found)
    return F.coalesce(d["after"] < d["before"], F.lit(False))
