"""Text normalisation and verbatim checks as Column expressions.

Python's Unicode white space is spelled out, since ``\\s`` means other characters in each regex
engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, trimmed marks and limits that the results depend on.
SPACE_CLASS = r"\t-\r\x{1c}-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE = f"[{SPACE_CLASS}]"
OTHER_SPACE = f"[{SPACE_CLASS}&&[^ ]]"
#: Characters that are no white space are passed by one range test, not by one for each of its kinds.
NO_LETTER = r"(?![!-~\x{a1}-\x{167f}])"
LINE_END = r"\r\n|[\n\x0b\x0c\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
TRIMMED_MARKS = " \t\r\n\"'“”‘’.,;:-—–"
ELLIPSES = r"^(?:\.\.\.|…)++"  # possessive: Java's stack would grow with the marks
MIN_SPAN_CHARS = 12


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also inside another lambda."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.btrim(text, F.lit(SPACES))


def collapse(text: Column) -> Column:
    """Runs of white space as one space; the single spaces that a text mostly has are left alone."""
    return F.regexp_replace(text, f"{NO_LETTER}(?: {SPACE}++|{OTHER_SPACE}{SPACE}*+)", " ")


def normalize(text: Column) -> Column:
    """Straight quotes, single spaces, no spaces at the ends; null counts as empty."""
    straight = lambda some: F.when(some.rlike("[’‘“”]"), F.translate(some, "’‘“”", "''\"\"")).otherwise(some)
    return F.btrim(collapse(let(F.coalesce(text, F.lit("")), straight)))


def _without_ellipses(text: Column) -> Column:
    """Without ellipses at the ends. The end is read backwards, so that no run of full stops is
    tried from each of its places."""
    ahead = lambda t: F.regexp_replace(t, ELLIPSES, "")
    both = lambda t: F.when(F.endswith(t, F.lit("...")) | F.endswith(t, F.lit("…")), F.reverse(ahead(F.reverse(ahead(t))))).otherwise(ahead(t))
    return let(text, both)


def canonical(span: Column) -> Column:
    """Normalised, without ellipses and marks at the ends, in lower case."""
    return F.lower(F.btrim(_without_ellipses(normalize(span)), F.lit(TRIMMED_MARKS)))


def haystack(raw_text: Column) -> Column:
    """What a canonical span is looked for in. Compute it once per document, before exploding."""
    return F.lower(normalize(raw_text))


def is_verbatim(needle: Column, hay: Column) -> Column:
    """A canonical span long enough to mean something that stands in the haystack as it is."""
    return (F.length(needle) >= MIN_SPAN_CHARS) & F.contains(hay, needle)


def verify_span(evidence: Column, raw_text: Column) -> Column:
    return is_verbatim(canonical(evidence), haystack(raw_text))


def tidy_quote(evidence: Column) -> Column:
    """A citation as it is stored: single spaces, no quotation marks or spaces at the ends."""
    return F.btrim(F.btrim(collapse(evidence)), F.lit('"“” '))


def lines(text: Column) -> Column:
    """Lines as Python's splitlines gives them; an empty text has none."""
    closed = lambda whole: F.regexp_replace(whole, r"\n\z", "")
    parted = lambda whole: F.when(F.length(whole) == 0, F.array().cast("array<string>")).otherwise(F.split(closed(whole), "\n"))
    return let(F.regexp_replace(text, LINE_END, "\n"), parted)


def _last_end(text: Column, mark: str) -> Column:
    """Where the last ``mark`` (in lower case; any ASCII case in the text) ends, 0 if there is none."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    at = F.instr(F.reverse(lowered), F.lit(mark[::-1]))
    return F.when(at > 0, F.length(text) - at + 1).otherwise(0)


def _up_to(text: Column, end: Column, change) -> Column:
    """``change`` applied to the first ``end`` characters alone. A pattern that needs an end mark is
    tried only where one follows, so openings without an end don't each read all that comes after."""
    whole = F.substring(text, F.lit(1), end)
    return F.when(end > 0, F.concat(change(whole), F.substring(text, end + 1, F.length(text)))).otherwise(text)


def strip_thinking(text: Column) -> Column:
    """Without the parts between thinking marks; one that never ends stays."""
    without = lambda t: let(_last_end(t, "</think>"), lambda end: _up_to(t, end, lambda u: F.regexp_replace(u, r"(?is)<think>.*?</think>", "")))
    return let(text, lambda t: F.when(F.contains(t, F.lit("</")), without(t)).otherwise(t))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+"))


#: Stands in an opening that has no end, while the others are looked for.
_SHUT = "\ufdd0"


def _without_code(page: Column) -> Column:
    """Each script and style block as a space. After the last end of the one kind, its openings are
    shut, so that only openings with an end ahead are tried."""
    block = r"(?is)<script.*?</script>|<style.*?</style>"

    def of(t):
        ends = F.struct(_last_end(t, "</script>").alias("script"), _last_end(t, "</style>").alias("style"))

        def cut(e):
            first, last = F.least(e["script"], e["style"]), F.greatest(e["script"], e["style"])
            kind = F.when(e["script"] < e["style"], F.lit("(?i)<(?=script)")).otherwise(F.lit("(?i)<(?=style)"))
            between = F.regexp_replace(F.substring(t, first + 1, last - first), kind, F.lit("<" + _SHUT))
            bare = F.regexp_replace(F.concat(F.substring(t, F.lit(1), first), between), F.lit(block), F.lit(" "))
            return F.concat(F.replace(bare, F.lit(_SHUT), F.lit("")), F.substring(t, last + 1, F.length(t)))

        return F.when(e_none(ends), t).when(F.contains(t, F.lit(_SHUT)), F.regexp_replace(t, block, " ")).otherwise(let(ends, cut))

    e_none = lambda e: F.greatest(e["script"], e["style"]) == 0
    return let(page, of)


def html_text(html: Column) -> Column:
    """Page text the plain way: no scripts, styles or tags, runs of spaces made one."""
    bare = let(_without_code(html), lambda t: _up_to(t, _last_end(t, ">"), lambda u: F.regexp_replace(u, "<[^>]++>", " ")))
    return F.btrim(F.regexp_replace(bare, f"{SPACE}{{2,}}", " "))
