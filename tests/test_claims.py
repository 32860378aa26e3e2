"""Recorded responses to arcs, drops, fits and briefs."""

import json

import pytest
from pyspark.sql import functions as F

from tests.test_text import applied
from vouchwell.functions import confidence as C
from vouchwell.functions import responses as R
from vouchwell.operators import brief, drops, fit, prompts
from vouchwell.plans import pipeline

PROFILE = (
    "Ada Placeholder\nExperience\nBaker\nCorner Bakery\n2005 - 2010\nFirst up at four every day for the sourdough line\n"
    "Teacher\nNorth School\n2010 - Present\nWrote the maths course that three schools use today"
)


def response(**over):
    body = {
        "throughline": "Makes things others use",
        "throughline_evidence": ["Wrote the maths course that three schools use today", 5, "invented words here"],
        "unresolved_tension": "",
        "tension_evidence": "",
        "departures": [
            {"description": "Left baking", "evidence": "First up at four every day for the sourdough line", "confidence": 0.95},
            {"description": "Moved from teaching to baking", "evidence": "Wrote the maths course", "confidence": 0.9},
            "not an object",
        ],
        "pursuits": [
            {"description": "Writes courses", "evidence": "Wrote the maths course that three schools use today", "confidence": "0.7"},
            {"description": "Manages a school", "evidence": "Wrote the maths course that three schools", "confidence": None},
            {"description": "Sails", "evidence": "sails the seven seas each and every year", "confidence": 1},
            {"description": "Bakes", "evidence": "day", "confidence": 1},
        ],
        "confidence": 1.0,
    }
    return json.dumps(body | over)


def tables(spark, *contents):
    profiles = spark.createDataFrame([(i, PROFILE, "Ada", None, None) for i in range(len(contents))], "profile_id long, raw_text string, name string, known_roles array<string>, source_notes string")
    responses = spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "profile_id long, content string")
    return profiles, responses


def test_verify(spark):
    profiles, responses = tables(spark, f"<think>{{</think>So: {response()} and more }}")
    out = pipeline.verify(profiles, responses)
    arc = out.arcs.collect()[0]
    assert (arc.proposed, arc.kept) == (6, 2)
    assert [b.description for b in arc.departures] == ["Left baking"]  # the record's dates rescue it
    assert [b.description for b in arc.pursuits] == ["Writes courses"]
    assert [b.confidence for b in (*arc.departures, *arc.pursuits)] == [0.9, 0.7]
    assert arc.throughline_evidence == ["Wrote the maths course that three schools use today"]
    assert arc.confidence == pytest.approx(2 / 6 * 2 / 4 * 0.8, abs=0.01)
    assert arc.drop_rate == pytest.approx(0.667)
    reasons = {(r.kind, r.pos): r.reason for r in out.drops.collect()}
    assert reasons == {
        ("departures", 1): "contradicts_dates",
        ("pursuits", 1): "unsupported",
        ("pursuits", 2): "fabricated",
        ("pursuits", 3): "too_short",
    }
    assert out.failures.count() == 0


@pytest.mark.parametrize(
    ("content", "failure"),
    [
        ("no object here", "no_object"),
        ('{"throughline": "x"', "unterminated"),
        ('{"throughline": "x}', "unterminated"),
        ("{throughline}", "malformed"),
        ('{"throughline": "  "}', "no_throughline"),
        (None, "no_response"),
    ],
)
def test_unusable_responses(spark, content, failure):
    out = pipeline.verify(*tables(spark, content))
    assert [r.failure for r in out.failures.collect()] == [failure]
    assert out.arcs.count() == out.kept.count() == out.drops.count() == 0


def test_kept_and_dropped_are_all(spark):
    out = pipeline.verify(*tables(spark, response(), response(pursuits=[]), response(departures=7), '{"throughline": "x"}'))
    kept = {r.profile_id: r["n"] for r in out.kept.groupBy("profile_id").agg(F.count("*").alias("n")).collect()}
    lost = {r.profile_id: r["n"] for r in out.drops.groupBy("profile_id").agg(F.count("*").alias("n")).collect()}
    arcs = {r.profile_id: r for r in out.arcs.collect()}
    assert {i: a.proposed for i, a in arcs.items()} == {0: 6, 1: 2, 2: 4, 3: 0}
    for i, a in arcs.items():
        assert kept.get(i, 0) + lost.get(i, 0) == a.proposed
    assert arcs[3].confidence == 0.0


@pytest.mark.parametrize(
    ("field", "text", "number", "strings", "verdict"),
    [
        ('"a "', "a ", None, ["a "], None),
        ("0", "", 0.0, [], None),
        ("7", "7", 7.0, [], None),
        ("true", "true", 1.0, [], True),
        ("false", "", 0.0, [], False),
        ('" YES"', " YES", None, [" YES"], True),
        ('"unclear"', "unclear", None, ["unclear"], None),
        ("null", "", None, [], None),
        ('["a", 1, "b"]', '["a",1,"b"]', None, ["a", "b"], None),
        ("{}", "", None, [], None),
    ],
)
def test_fields(spark, field, text, number, strings, verdict):
    data = R.json_object(F.col("t"))["data"]
    value = R.field(data, "x")
    got = applied(spark, [(f'{{"x": {field}}}',)], "t string", R.as_text(value), R.number(value), R.strings(data, "x"), R.verdict(value))
    assert got == [(text, number, strings, verdict)]


@pytest.mark.parametrize(("reported", "evidence", "want"), [(2.0, "x" * 40, 0.9), (2.0, "x" * 39, 0.6), (None, "x" * 50, 0.6), (-1.0, "x", 0.0), (0.3, "x" * 50, 0.3)])
def test_beat_confidence(spark, reported, evidence, want):
    assert applied(spark, [(reported, evidence)], "r double, e string", C.beat_confidence(F.col("r"), F.col("e"))) == [want]


def test_arc_confidence(spark):
    rows = [(4, 4, 4, 0.8), (2, 4, 1, 0.8), (0, 3, 0, 0.0), (0, 0, 0, 0.0), (8, 8, 6, 0.5)]
    c = [F.col(x) for x in "kpdm"]
    got = applied(spark, rows, "k int, p int, d int, m double", C.arc_confidence(*c), C.coverage_score(c[0], c[2], c[3]))
    assert got == [(0.8, 0.8), (0.1, 0.2), (0.0, 0.0), (0.0, 0.0), (0.5, 0.5)]


def test_drop_classes():
    hay = "the quick brown fox jumps over the lazy dog and runs away into the woods"
    asked = ["short", "quick brown fox jumps above all things", "the quikc brwon fxo jumsp over teh lzay dog", "zzzz yyyy xxxx 1234 5678"]
    got = drops.verdicts(asked, hay)
    assert got[0] == {"overlap": 1.0, "reason": "too_short"}
    assert [v["reason"] for v in got] == ["too_short", "near_miss", "paraphrase", "fabricated"]
    assert drops.verdicts(["the quick brown fox"], "") == [{"overlap": 0.0, "reason": "fabricated"}]


def fits(spark, confidence, content):
    profiles, _ = tables(spark, "")
    arcs = spark.createDataFrame([(0, confidence)], "profile_id long, confidence double")
    roles = spark.createDataFrame([(1, "Baker", "Sourdough baker wanted at four", None)], "role_id long, title string, raw_description string, company_context string")
    said = spark.createDataFrame([(0, 1, content)], "profile_id long, role_id long, content string")
    return fit.assess(arcs, roles, profiles, said)


@pytest.mark.parametrize(
    ("confidence", "said", "verdict", "flags"),
    [(0.45, "true", True, ["a"]), (0.44, "true", None, 2), (0.9, '"No"', False, ["a"]), (0.9, '"ambiguous"', None, ["a"]), (0.1, "null", None, ["a"]), (0.9, "3", None, ["a"])],
)
def test_fit(spark, confidence, said, verdict, flags):
    good, bad = fits(spark, confidence, f'{{"continues_arc": {said}, "reasoning": "r", "risk_flags": [" a ", "", "  "]}}')
    row = good.collect()[0]
    assert bad.count() == 0
    assert row.continues_arc is verdict
    assert row.risk_flags == flags if isinstance(flags, list) else len(row.risk_flags) == flags
    assert "sourdough" in row.skill_overlap.matched


def test_fit_without_reasoning(spark):
    good, bad = fits(spark, 0.9, '{"continues_arc": true, "reasoning": " "}')
    assert good.count() == 0
    assert [r.failure for r in bad.collect()] == ["no_reasoning"]


def briefs(spark, content, fit_content):
    profiles, responses = tables(spark, content)
    roles = spark.createDataFrame([(1, "Baker", "Sourdough baker wanted", None)], "role_id long, title string, raw_description string, company_context string")
    said = spark.createDataFrame([(0, 1, fit_content)], "profile_id long, role_id long, content string")
    return pipeline.run(profiles, responses, roles, said).briefs


def test_brief(spark):
    fit_content = json.dumps({"continues_arc": None, "reasoning": "Hi Ada, come to us", "risk_flags": ["Let me know if you agree", "long commute"]})
    made = briefs(spark, response(), fit_content)
    b = made.collect()[0]
    assert (b.candidate_name, b.why_this_role, b.draft_status) == ("Ada", brief.WITHHELD, brief.STATUS)
    assert b.open_question == brief.NO_QUESTION
    assert "salutation" in b.cautions[0]
    assert b.cautions[-1] == "long commute" and "withheld" in b.cautions[-2]
    assert not any("Let me know" in c for c in b.cautions)
    assert b.violations == []
    text = brief.render(made).collect()[0].text
    assert text.startswith("Ada [needs_human_message]\n1. ")
    assert text.index("\n2. ") < text.index("\nStory: ") < text.index("\nRole: ") < text.index("\nAsk: ")


def test_brief_that_reads_as_a_message_fails(spark):
    body = response(
        pursuits=[{"description": "I'd love to chat about courses", "evidence": "Wrote the maths course that three schools use today", "confidence": 0.1}], departures=[]
    )
    made = briefs(spark, body, '{"continues_arc": true, "reasoning": "r"}')
    assert len(made.collect()[0].violations) == 1
    with pytest.raises(Exception, match="sendable text"):
        brief.reject_violations(made).collect()


def test_prompts(spark):
    profiles, responses = tables(spark, response())
    prompt = prompts.story_prompts(profiles).collect()[0].prompt
    assert "2005-2010: Baker — Corner Bakery\n2010-present: Teacher — North School" in prompt
    assert "[who]\nAda" in prompt and "[roles]" not in prompt and f"=\n{PROFILE}\n=" in prompt
    arcs = pipeline.verify(profiles, responses).arcs
    roles = spark.createDataFrame([(1, "Baker", "Sourdough baker wanted", None)], "role_id long, title string, raw_description string, company_context string")
    asked = prompts.fit_prompts(arcs, roles, fit.pair_up(profiles, roles)).collect()
    assert len(asked) == 1 and "0.9 | Left baking | " in asked[0].prompt and "[where]" not in asked[0].prompt


@pytest.mark.parametrize(
    ("status", "body", "failure"),
    [
        (500, "x", "http"),
        (200, "x", "unreadable"),
        (200, '{"choices": [{"message": {"content": "<think>a</think> ", "reasoning_content": "b"}}]}', "reasoning_only"),
        (200, '{"choices": [{"message": {"content": null}}]}', "empty"),
        (200, '{"choices": [{"message": {"content": "<think>a</think> b"}}]}', None),
    ],
)
def test_completions(spark, status, body, failure):
    got = applied(spark, [(status, body)], "s int, b string", prompts.completion_failure(F.col("s"), F.col("b")), prompts.completion_content(F.col("b")))
    assert got[0][0] == failure
    assert failure is not None or got[0][1] == "b"
