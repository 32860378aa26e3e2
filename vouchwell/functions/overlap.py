"""Skill terms that a role and a profile share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vouchwell.functions.lexicon import STOPWORDS
from vouchwell.functions.rounding import round_half_even
from vouchwell.functions.text import let

# Fixed value: the shape of a term. A full stop sticks to the word before it.
TERM = r"[a-z][a-z+#.]{2,}"


def tokens(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))
    return F.array_except(found, F.array(*[F.lit(w) for w in STOPWORDS]))


def shared_terms(role_terms: Column, profile_terms: Column) -> Column:
    """STRUCT<matched, matched_count, role_term_count, ratio> of two token arrays. The ratio is to
    the role's terms."""
    met = lambda role: F.struct(F.array_sort(F.array_intersect(role, profile_terms)).alias("both"), F.size(role).alias("n"))
    told = lambda x: F.struct(
        x["both"].alias("matched"),
        F.size(x["both"]).alias("matched_count"),
        x["n"].alias("role_term_count"),
        F.when(x["n"] > 0, round_half_even(F.size(x["both"]) / x["n"], 3)).otherwise(F.lit(0.0)).alias("ratio"),
    )
    return let(let(role_terms, met), told)


def skill_overlap(profile_text: Column, role_text: Column) -> Column:
    return shared_terms(tokens(role_text), tokens(profile_text))
