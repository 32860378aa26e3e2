"""Confidence from evidence: what a claim said of itself only ever lowers it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vouchwell.functions.rounding import round_half_even
from vouchwell.functions.text import canonical

# Fixed values.
SUBSTANTIVE_SPAN_CHARS = 40
CEILING_SUBSTANTIVE = 0.9
CEILING_THIN = 0.6
TARGET_DISTINCT_SPANS = 4


def beat_confidence(reported: Column, evidence: Column) -> Column:
    """``reported`` (a double; null if it was no number) within 0 and 1, under a ceiling that a
    short quote lowers."""
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(reported, F.lit(CEILING_THIN))))
    ceiling = F.when(F.length(canonical(evidence)) >= SUBSTANTIVE_SPAN_CHARS, F.lit(CEILING_SUBSTANTIVE)).otherwise(F.lit(CEILING_THIN))
    return round_half_even(F.least(value, ceiling), 2)


def arc_confidence(kept: Column, proposed: Column, distinct: Column, mean: Column) -> Column:
    """Share of claims that held x coverage by distinct quotes x their mean confidence."""
    score = (kept / proposed) * F.least(F.lit(1.0), distinct / F.lit(TARGET_DISTINCT_SPANS)) * mean
    return F.when((proposed > 0) & (kept > 0), round_half_even(score, 2)).otherwise(F.lit(0.0))


def coverage_score(kept: Column, distinct: Column, mean: Column) -> Column:
    """The variant without the share of claims that held."""
    return F.when(kept > 0, F.least(F.lit(1.0), distinct / F.lit(TARGET_DISTINCT_SPANS)) * mean).otherwise(F.lit(0.0))


def drop_rate(dropped: Column, proposed: Column) -> Column:
    return F.when(proposed > 0, round_half_even(dropped / proposed, 3)).otherwise(F.lit(0.0))
