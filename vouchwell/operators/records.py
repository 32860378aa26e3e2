"""Comparing and keeping records: differences by key, rollups of runs, histories, rows to text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vouchwell.functions.rounding import round_half_even

# Fixed value.
HISTORY = 8


def differences(before: DataFrame, now: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose values differ or that only one side has: key, before, now."""
    a = before.select(F.col(key), F.col(value).alias("before"))
    b = now.select(F.col(key), F.col(value).alias("now"))
    return a.join(b, key, "full_outer").filter(~F.col("before").eqNullSafe(F.col("now")))


_FLAT = """
WITH RECURSIVE opened (k, path, value) AS (
  SELECT k, '', value FROM {bodies}
  UNION ALL
  SELECT k, concat_ws('.', nullif(path, ''), e.key), e.value
  FROM opened, LATERAL variant_explode(opened.value) AS e WHERE schema_of_variant(opened.value) LIKE 'OBJECT<%')
SELECT k, path, try_variant_get(value, '$', 'string') AS value FROM opened WHERE schema_of_variant(value) NOT LIKE 'OBJECT<%'
"""


def flatten_json(rows: DataFrame, key: str, body: str) -> DataFrame:
    """key, path (dotted) and value, as text, of the fields of each row's JSON object. Each step
    opens the objects found by the one before, down to where there are none (at most as many steps
    as ``spark.sql.cteRecursionLevelLimit`` says, beyond which the query fails). Rows that hold no
    object, and empty objects, give none."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # it bounds all rows of a query together
    bodies = rows.select(F.col(key).alias("k"), F.try_parse_json(F.col(body)).alias("value")).filter("schema_of_variant(value) LIKE 'OBJECT<%'")
    return spark.sql(_FLAT, bodies=bodies).withColumnRenamed("k", key)


def condition_rollup(graded: DataFrame) -> DataFrame:
    """Graded quotes (condition, profile, verbatim) by run, then by condition: claims, verbatim,
    fabricated, rate (null without claims), fully clean and fully invented profiles."""
    yes = F.col("verbatim").cast("int")
    runs = graded.groupBy("condition", "profile").agg(F.count("verbatim").alias("claims"), F.coalesce(F.sum(yes), F.lit(0)).alias("good"))
    some = F.col("claims") > 0
    return (
        runs.groupBy("condition")
        .agg(
            F.sum("claims").alias("claims"),
            F.sum("good").alias("verbatim"),
            F.count_if(some & (F.col("good") == F.col("claims"))).alias("fully_clean"),
            F.count_if(some & (F.col("good") == 0)).alias("fully_invented"),
        )
        .withColumn("fabricated", F.col("claims") - F.col("verbatim"))
        .withColumn("fabrication_rate", round_half_even(F.col("fabricated") / F.nullif("claims", F.lit(0)), 3))
    )


def keep_latest(entries: DataFrame, label: str, when: str, most: int = HISTORY) -> DataFrame:
    """The newest entry of each label, and of these the newest ``most``. The latest per label is an
    aggregation, so a hot label costs one row per task."""
    rest = [c for c in entries.columns if c != label]
    latest = entries.groupBy(label).agg(F.max_by(F.struct(*rest), F.struct(when, *[c for c in rest if c != when])).alias("e"))
    return latest.select(label, "e.*").orderBy(F.col(when).desc(), F.col(label)).limit(most)


def group_text(rows: DataFrame, group: str, order: str, line: str, sep: str = "\n") -> DataFrame:
    """One text per group: its lines in order."""
    item = F.struct(F.col(order).alias("o"), F.col(line).alias("l"))
    return rows.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("t")).select(group, F.array_join("t.l", sep).alias("text"))


def owner_before(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, carry: list[str]) -> DataFrame:
    """As-of join: for each point the last span of its key that starts at or before it; null where
    there is none. Union and a running window: each row is read once and no pairs are made."""
    none = lambda t: F.lit(None).cast(t)
    kinds = {c: spans.schema[c].dataType for c in carry}
    a = spans.select(F.col(key), F.col(start).alias("_at"), F.lit(0).alias("_side"), F.struct(F.col(start).alias("_at"), *carry).alias("_span"), none(points.schema.simpleString()).alias("_point"))
    b = points.select(F.col(key), F.col(at).alias("_at"), F.lit(1).alias("_side"), none(a.schema["_span"].dataType).alias("_span"), F.struct(*points.columns).alias("_point"))
    run = Window.partitionBy(key).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = a.unionByName(b).withColumn("_last", F.last("_span", ignorenulls=True).over(run)).filter("_side = 1")
    return held.select("_point.*", *[F.col(f"_last.{c}").cast(kinds[c]).alias(c) for c in carry])


def later_start_exists(spans: DataFrame, key: str, start: str, end: str, span_id: str) -> DataFrame:
    """``spans`` with followed: does another span of the key start at or after this one's end? Two
    latest starts per key answer it for all its spans. Spans with a null key, id, start or end stay;
    those without a key or an end are never followed."""
    top = spans.groupBy(key).agg(
        F.max(F.struct(F.col(start).alias("s"), F.col(span_id).alias("i"))).alias("a"),
    )
    first = spans.join(top, key, "left")
    differs = ~F.col(span_id).eqNullSafe(F.col("a.i"))
    other = first.filter(differs).groupBy(key).agg(F.max(start).alias("_second"))
    best = F.when(differs, F.col("a.s")).otherwise(F.col("_second"))
    joined = first.join(other, key, "left")
    return joined.withColumn("followed", F.coalesce(best >= F.col(end), F.lit(False))).select(*spans.columns, "followed")


def graph(kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of an arc: a centre per profile and a node per kept claim, placed by
    confidence (nearer the centre) and by rank around it."""
    rank = Window.partitionBy("profile_id").orderBy("kind", "pos")
    total = Window.partitionBy("profile_id")
    conf = F.greatest(F.lit(0.15), F.least(F.lit(1.0), F.col("confidence")))
    placed = (
        kept.withColumn("node", F.row_number().over(rank))
        .withColumn("angle", 2 * F.pi() * (F.col("node") - 1) / F.count("*").over(total))
        .withColumn("radius", 200 + (1 - conf) * 220)
    )
    nodes = placed.select(
        "profile_id", "node", "kind", conf.alias("confidence"), (F.col("radius") * F.cos("angle")).alias("x"), (F.col("radius") * F.sin("angle")).alias("y")
    )
    return nodes, placed.select("profile_id", F.lit(0).alias("a"), F.col("node").alias("b"))
