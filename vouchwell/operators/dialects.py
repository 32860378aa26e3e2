"""Two sets of rules for the same evidence, side by side.

Claims can be judged by the text rules, which are the library's own, or by those of a page's script,
which has shorter word lists, another reading of a confidence and another score. A set of rules is a
value; ``differences_between`` says where two of them come to different results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchwell.functions import responses as R
from vouchwell.functions.confidence import CEILING_SUBSTANTIVE, CEILING_THIN, SUBSTANTIVE_SPAN_CHARS, TARGET_DISTINCT_SPANS, beat_confidence
from vouchwell.functions.lexicon import MODES
from vouchwell.functions.rounding import round_half_even
from vouchwell.functions.text import canonical, normalize, strip, tidy_quote
from vouchwell.operators.claims import gated, read_responses, supporting_quotes
from vouchwell.operators.records import differences


@dataclass(frozen=True)
class Rules:
    """``modes``: the gate's word lists. ``unread``: the confidence of a claim that states none;
    ``clamped``: within 0 and 1, and zero is a confidence. ``survival``: the score counts the share
    of claims that held. ``distinct``: a headline's quotes are listed once, and without quotation
    marks. ``half_even``: how halves are rounded; otherwise upwards."""

    name: str
    modes: tuple
    unread: float
    clamped: bool
    survival: bool
    distinct: bool
    half_even: bool


# The entries that the page's lists lack, and its confidence for what states none.
_PAGE_LACKS = {"intent": ("seek ", "pursuing a"), "leadership": ("built a team",)}
TEXT = Rules("text", MODES, CEILING_THIN, True, True, True, True)
PAGE = Rules("page", tuple((n, tuple(e for e in entries if e not in _PAGE_LACKS.get(n, ()))) for n, entries in MODES), 0.5, False, False, False, False)


def rounded(value: Column, rules: Rules) -> Column:
    return round_half_even(value, 2) if rules.half_even else F.floor(value * 100 + 0.5) / 100


def confidence_of(reported: Column, evidence: Column, rules: Rules) -> Column:
    if rules.clamped:
        return beat_confidence(reported, evidence)
    stated = F.when(F.isnan(reported) | (reported == 0), F.lit(None)).otherwise(reported)
    ceiling = F.when(F.length(canonical(evidence)) >= SUBSTANTIVE_SPAN_CHARS, F.lit(CEILING_SUBSTANTIVE)).otherwise(F.lit(CEILING_THIN))
    return rounded(F.least(F.coalesce(stated, F.lit(rules.unread)), ceiling), rules)


def results(profiles: DataFrame, responses: DataFrame, rules: Rules) -> DataFrame:
    """profile_id, kept (STRUCT<kind, pos, description, confidence> of the claims that stand), headline
    (the quotes of the headline that do) and score."""
    read = gated(read_responses(profiles, responses), modes=rules.modes).filter("failure is null")
    standing = F.filter("claims", lambda c: c["outcome"] == "kept")
    row = lambda c: F.struct(
        c["kind"].alias("kind"), c["pos"].alias("pos"), c["description"].alias("description"),
        confidence_of(c["reported"], c["evidence"], rules).alias("confidence"), canonical(c["evidence"]).alias("needle"),
    )
    quotes = supporting_quotes(R.strings(F.col("data"), "throughline_evidence"), F.col("hay"), strip(F.col("throughline")), rules.modes)
    headline = F.array_distinct(F.transform(quotes, tidy_quote)) if rules.distinct else F.transform(quotes, normalize)
    found = read.select("profile_id", F.transform(standing, row).alias("kept"), headline.alias("headline"), F.size("claims").alias("proposed"))
    n = F.size("kept")
    mean = F.aggregate("kept", F.lit(0.0), lambda a, k: a + k["confidence"]) / F.nullif(n, F.lit(0))
    cover = F.least(F.lit(1.0), F.size(F.array_distinct(F.transform("kept", lambda k: k["needle"]))) / F.lit(TARGET_DISTINCT_SPANS))
    score = n / F.nullif("proposed", F.lit(0)) * cover * mean if rules.survival else cover * mean
    return found.select("profile_id", "kept", "headline", F.coalesce(rounded(score, rules), F.lit(0.0)).alias("score"))


def fields(found: DataFrame) -> DataFrame:
    """profile_id, field and value: one row per kept claim with its confidence, one for the headline's
    quotes and one for the score."""
    rows = F.concat(
        F.transform("kept", lambda k: F.struct(F.concat_ws(".", k["kind"], k["pos"].cast("string")).alias("field"), k["confidence"].cast("string").alias("value"))),
        F.array(
            F.struct(F.lit("headline").alias("field"), F.array_join("headline", "|").alias("value")),
            F.struct(F.lit("score").alias("field"), F.col("score").cast("string").alias("value")),
        ),
    )
    return found.select("profile_id", F.explode(rows).alias("r")).select("profile_id", "r.*")


def differences_between(profiles: DataFrame, responses: DataFrame, one: Rules = TEXT, other: Rules = PAGE) -> DataFrame:
    """profile_id, field, before (by ``one``) and now (by ``other``) of what the two disagree on; null
    where a claim doesn't stand."""
    a, b = (
        fields(results(profiles, responses, r)).select(F.struct("profile_id", "field").alias("k"), "value") for r in (one, other)
    )
    return differences(a, b, "k", "value").select("k.*", "before", "now")
