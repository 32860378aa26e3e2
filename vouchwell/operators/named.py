"""Claims that name something in the record, looked up across all profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchwell.functions.timeline import stems

#: A stem's one row of the index stands in so many places, so that a stem of very many claims is
#: looked up by as many tasks.
SALTS = 16


def index_of(spans: DataFrame, label: str) -> DataFrame:
    """stem and spans: each stem of the labels with the number of rows that hold it."""
    return spans.select(F.explode(stems(F.col(label))).alias("stem")).groupBy("stem").agg(F.count("*").alias("spans"))


def naming(claims: DataFrame, claim_id: str, said: str, spans: DataFrame, label: str) -> DataFrame:
    """The claims (all their columns, rows with one id alike) that share a distinctive word, in any of
    its forms, with some span's label; with ``stem``, the rarest word that they share (of equally
    rare ones the first), and ``spans``, how many spans hold it. Null ids name no claim.

    The index has one row a stem, whatever the number of spans; no pair of a claim and a span is made."""
    index = index_of(spans, label).select("stem", "spans", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    asked = claims.select(F.col(claim_id).alias("_id"), F.explode(stems(F.col(said))).alias("stem"), F.pmod(F.xxhash64(claim_id), F.lit(SALTS)).cast("int").alias("_salt"))
    met = asked.join(index, ["stem", "_salt"]).groupBy("_id").agg(F.min(F.struct("spans", "stem")).alias("_rarest"))
    joined = claims.join(met, F.col(claim_id) == F.col("_id"))
    return joined.select(*claims.columns, F.col("_rarest.stem").alias("stem"), F.col("_rarest.spans").alias("spans"))
