"""Does a quote support a claim in the mode in which the claim is made?"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from vouchwell.functions.lexicon import MODES
from vouchwell.functions.text import collapse, let, strip

RULES = ("empty", *(name for name, _ in MODES), "numbers", "ok")


def padded(text: Column) -> Column:
    """What entries are looked for in."""
    return F.concat(F.lit(" "), collapse(F.lower(text)), F.lit(" "))


def holds(padded_text: Column, entries, whole_words: bool = False) -> Column:
    """Whether the text holds one of the entries: as a substring (so "cancelled" holds "led"), or
    only between word boundaries."""
    if whole_words:
        either = "|".join(re.escape(e.strip()) for e in entries)
        return padded_text.rlike(rf"\b(?:{either})\b")
    return padded_text.rlike("|".join(map(re.escape, entries)))  # one pass


def has_any(text: Column, entries, whole_words: bool = False) -> Column:
    return holds(padded(text), entries, whole_words)


def numbers(text: Column) -> Column:
    """Distinct digit runs as strings; a comma inside a number doesn't part it."""
    return F.array_distinct(F.regexp_extract_all(F.replace(text, F.lit(","), F.lit("")), F.lit("[0-9]+"), F.lit(0)))


def missing_numbers(claim: Column, quote: Column) -> Column:
    missing = lambda said: F.when((F.size(said) == 0) & quote.isNotNull(), said).otherwise(F.array_sort(F.array_except(said, numbers(quote))))
    return let(numbers(claim), missing)


def gate(claim: Column, quote: Column, modes=MODES, whole_words: bool = False) -> Column:
    """STRUCT<ok, rule, missing>: the first rule that fails, in the order of RULES, or "ok"."""
    said, cited = (strip(F.coalesce(x, F.lit(""))) for x in (claim, quote))

    def of(s):
        rule = F.when((s["c"] == "") | (s["q"] == ""), F.lit("empty"))
        for name, entries in modes:
            rule = rule.when(holds(s["claim"], entries, whole_words) & ~holds(s["quote"], entries, whole_words), F.lit(name))
        rule = rule.when(F.size(s["missing"]) > 0, F.lit("numbers")).otherwise(F.lit("ok"))
        return let(rule, lambda r: F.struct((r == "ok").alias("ok"), r.alias("rule"), F.when(r == "numbers", s["missing"]).alias("missing")))

    texts = F.struct(said.alias("c"), cited.alias("q"))
    looked = lambda t: F.struct(
        t["c"].alias("c"), t["q"].alias("q"), padded(t["c"]).alias("claim"), padded(t["q"]).alias("quote"), missing_numbers(t["c"], t["q"]).alias("missing")
    )
    return let(let(texts, looked), of)
