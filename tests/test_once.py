"""Plans in which what is dear is computed once, and by as many tasks as there are cores."""

import re
import time

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from vouchwell.functions import entities, guard, identity, rounding
from vouchwell.functions import responses as R
from vouchwell.functions import text as T
from vouchwell.operators import fit
from vouchwell.plans import case_queries as cases
from vouchwell.plans import data_queries as data

SF = f"{DATA}/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def nodes(plan):
    """The plan's nodes, a text each, with the lines that belong to it."""
    return re.split(r"\n(?=[ :]*[:+]- )", plan)


ONCE = {
    "canonical": T.canonical,
    "strip_thinking": T.strip_thinking,
    "json_object": R.json_object,
    "as_text": lambda c: R.as_text(F.try_parse_json(c)),
    "one_person": identity.one_person,
    "round_half_even": lambda c: rounding.round_half_even(F.length(c) / 7, 2),
    "sendable_kind": lambda c: guard.sendable_kind(F.lit("a"), F.array(c)),
}


@pytest.mark.parametrize("name", ONCE)
def test_an_expression_holds_its_argument_once(spark, name):
    argument = F.concat(F.col("id").cast("string"), F.lit("zqx"))
    plan = optimized(spark.range(2).select(ONCE[name](argument).alias("x")))
    assert plan.count("zqx") == 1


def test_few_bytes_stay_on_all_cores(spark):
    profiles, said, *_ = cases._profiles(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = profiles.join(said, "profile_id")
        assert met.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pairs_are_not_computed_for_each_partition_of_the_roles(spark):
    assert "Cartesian" not in cases.fit_cases(spark, SF)._jdf.queryExecution().sparkPlan().toString()


def test_fit_responses_are_read_before_a_filter_on_them(spark):
    rows = spark.range(5).select(F.col("id").alias("profile_id"), F.lit(1).alias("role_id"), F.concat(F.lit('{"reasoning": "zqx'), "id", F.lit('"}')).alias("content"))
    arcs, profiles = rows.select("profile_id", F.lit(0.5).alias("confidence")), rows.select("profile_id", F.lit("x").alias("raw_text"))
    fits, _ = fit.assess(arcs, rows.select("role_id", F.lit("x").alias("raw_description")).limit(1), profiles, rows)
    assert not any(re.match(r"[ :+-]*(Filter|Join) ", n) and "zqx" in n for n in nodes(optimized(fits)))


def test_prompts_compute_arcs_once(spark):
    df = cases.fit_prompt_cases(spark, SF)
    assert sum("Generate inline" in n for n in nodes(optimized(df))) == 1
    assert "Cartesian" not in df._jdf.queryExecution().sparkPlan().toString()


def test_fits_and_failures_come_out_of_one_pass(spark):
    plan = optimized(data.career_fits(spark, SF))
    assert "Union" not in plan and len(re.findall("Relation", plan)) == 4  # profiles twice, both kinds of responses


def test_careers_are_dealt_out_once_a_table(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = data.career_briefs(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = re.findall(r"Exchange hashpartitioning\((\w+)#.*?(ENSURE_REQUIREMENTS|REPARTITION_BY_NUM)", plan)
    assert {k for k, why in dealt if why == "ENSURE_REQUIREMENTS"} == {"o_custkey"}  # only to make the profiles


def test_references_take_time_by_their_number(spark):
    n = 6000
    text = spark.range(1).select(F.repeat(F.lit("a &amp; &eacute; &#232; "), n).alias("t"))
    began = time.perf_counter()
    (got,) = text.select(entities.unescape(F.col("t")).alias("t")).collect()
    assert got.t == "a & é è " * n and time.perf_counter() - began < 60
