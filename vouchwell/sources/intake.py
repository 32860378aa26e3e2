"""Profiles and roles as they enter: trimmed, with a floor, refused rows in a table of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchwell.functions.text import lines, strip

# Fixed values.
MIN_PROFILE_CHARS = 80
MIN_ROLE_CHARS = 8
MAX_TITLE_CHARS = 80
CUT_TITLE_CHARS = 77


def _blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def refusal(text: Column, floor: int) -> Column:
    """"empty", "short" or null of a trimmed text."""
    return F.when(text == "", F.lit("empty")).when(F.length(text) < floor, F.lit("short"))


def load_profiles(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profiles, rejects) of rows (profile_id, raw_text, name, known_roles, source_notes)."""
    text = strip(F.coalesce(F.col("raw_text"), F.lit("")))
    roles = F.filter(F.transform("known_roles", strip), lambda r: r != "")
    read = rows.select(
        "profile_id",
        text.alias("raw_text"),
        _blank_to_null(F.col("name")).alias("name"),
        roles.alias("known_roles"),
        _blank_to_null(F.col("source_notes")).alias("source_notes"),
    )
    reason = refusal(F.col("raw_text"), MIN_PROFILE_CHARS)
    return read.filter(reason.isNull()), read.filter(reason.isNotNull()).select("profile_id", reason.alias("reason"), F.length("raw_text").alias("n_chars"))


def derive_title(description: Column) -> Column:
    """The first line, or its beginning with an ellipsis."""
    first = strip(F.try_element_at(lines(description), F.lit(1)))
    cut = F.concat(F.regexp_replace(F.substring(first, 1, CUT_TITLE_CHARS), r"\s+$", ""), F.lit("..."))
    return F.when(F.length(first) <= MAX_TITLE_CHARS, first).otherwise(cut)


def load_roles(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(roles, rejects) of rows (role_id, title, raw_description, company_context)."""
    read = rows.withColumn("raw_description", strip(F.coalesce(F.col("raw_description"), F.lit(""))))
    reason = refusal(F.col("raw_description"), MIN_ROLE_CHARS)
    kept = read.filter(reason.isNull()).select(
        "role_id",
        F.coalesce(_blank_to_null(F.col("title")), derive_title(F.col("raw_description"))).alias("title"),
        "raw_description",
        _blank_to_null(F.col("company_context")).alias("company_context"),
    )
    return kept, read.filter(reason.isNotNull()).select("role_id", reason.alias("reason"), F.length("raw_description").alias("n_chars"))
