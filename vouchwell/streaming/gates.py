"""The gates over a stream of claims: they need one row each, so they run unchanged and stateless."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchwell.functions.gate import gate
from vouchwell.functions.guard import sendable_kind
from vouchwell.functions.text import canonical, haystack, is_verbatim


def gate_stream(claims: DataFrame) -> DataFrame:
    """``claims`` (a stream or not) with description, evidence and raw_text in each row: adds
    verbatim, rule and sendable."""
    verdict = gate(F.col("description"), F.col("evidence"))
    return (
        claims.withColumn("verbatim", is_verbatim(canonical(F.col("evidence")), haystack(F.col("raw_text"))))
        .withColumn("rule", verdict["rule"])
        .withColumn("sendable", sendable_kind(F.col("description")))
    )


def gate_keyed_stream(claims: DataFrame, profiles: DataFrame) -> DataFrame:
    """A stream of claims by profile_id against a static table of profiles."""
    texts = profiles.select("profile_id", "raw_text")
    return gate_stream(claims.join(texts, "profile_id"))
