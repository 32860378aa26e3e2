"""Claims of recorded responses: read, gated in order, kept or dropped with the reason.

Responses meet their profile by key once. After that nothing is joined, grouped or shuffled: a
profile's claims stay an array in its row and are gated there, against a haystack and spans that are
computed once per profile. Kept claims, dropped claims and arcs are read off that array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchwell.functions import responses as R
from vouchwell.functions.confidence import arc_confidence, beat_confidence, drop_rate
from vouchwell.functions.gate import gate
from vouchwell.functions.identity import one_person
from vouchwell.functions.lexicon import MODES
from vouchwell.functions.text import canonical, haystack, is_verbatim, let, strip, strip_thinking, tidy_quote
from vouchwell.functions.timeline import departure_shown, spans, stated_move, with_stems
from vouchwell.operators.drops import drop_verdicts

KINDS = ("departures", "pursuits")


def _answered(profiles: DataFrame, responses: DataFrame) -> DataFrame:
    """Profiles with their response's data, failure and throughline. They come out of a generator of
    one row, since a filter on the failure would otherwise move below it and have the response read
    again, once for each time that the expression names it."""
    joined = profiles.join(responses.select("profile_id", "content"), "profile_id", "left")
    rest = [F.col(f"`{c}`") for c in joined.columns if c != "content"]

    def read(j):
        said = F.coalesce(strip(R.as_text(R.field(j["data"], "throughline"))), F.lit(""))
        failure = F.when(F.col("content").isNull(), F.lit("no_response")).otherwise(j["failure"])
        thin = F.when(said == "", F.lit("no_throughline"))
        return F.struct(said.alias("throughline"), j["data"].alias("data"), F.coalesce(failure, thin).alias("failure"))

    return joined.select(*rest, F.inline_outer(F.array(let(R.json_object(strip_thinking(F.col("content"))), read))))


def read_failures(profiles: DataFrame, responses: DataFrame) -> DataFrame:
    """profile_id and failure ("no_object", "unterminated", "malformed", "no_throughline" or
    "no_response") of those without a usable response; of the profiles, only the key is read."""
    found = _answered(profiles.select("profile_id"), responses)
    return found.filter("failure is not null").select("profile_id", "failure")


def read_responses(profiles: DataFrame, responses: DataFrame) -> DataFrame:
    """Profiles with their response's data, failure (as in ``read_failures``, or null), throughline,
    haystack and spans."""
    return _answered(profiles, responses).withColumns(
        {"hay": haystack(F.col("raw_text")), "spans": with_stems(spans(F.col("raw_text")))}
    )


def proposed(data: Column) -> Column:
    """The claims of a response: kind, pos, description, evidence, needle (canonical evidence) and
    reported (confidence as a double)."""
    beat = lambda kind: lambda x, i: F.struct(
        F.lit(kind).alias("kind"),
        i.alias("pos"),
        strip(R.as_text(R.field(x, "description"))).alias("description"),
        R.as_text(R.field(x, "evidence")).alias("evidence"),
        R.number(R.field(x, "confidence")).alias("reported"),
    )
    every = F.concat(*[F.transform(R.objects(data, k), beat(k)) for k in KINDS])
    return F.transform(every, lambda c: c.withField("needle", canonical(c["evidence"])))


def judged(claim: Column, hay: Column, stemmed: Column, raw_text: Column, whole_words: bool, modes=MODES) -> Column:
    """``claim`` with outcome ("kept", "unverified", "contradicts_dates" or "unsupported"), and the
    gate's rule and missing numbers for one that stands in the text. A claim of departure that its
    quote doesn't voice stands if the record's dates prove it; later rules aren't asked then."""
    said, quote = claim["description"], claim["evidence"]
    stands = (said != "") & is_verbatim(claim["needle"], hay)
    asked = F.when(
        stands, F.struct(gate(said, quote, modes, whole_words).alias("gate"), stated_move(said, stemmed).alias("move"))
    )

    def outcome(a):
        before, after = a["move"]["before"], a["move"]["after"]
        rescued = lambda: (a["gate"]["rule"] == "departure") & (
            F.coalesce(before < after, F.lit(False)) | departure_shown(quote, stemmed, raw_text)
        )
        verdict = (
            F.when(a.isNull(), F.lit("unverified"))
            .when(after < before, F.lit("contradicts_dates"))
            .when(a["gate"]["ok"] | rescued(), F.lit("kept"))
            .otherwise(F.lit("unsupported"))
        )
        return F.struct(
            *[claim[c].alias(c) for c in ("kind", "pos", "description", "evidence", "reported", "needle")],
            verdict.alias("outcome"),
            a["gate"]["rule"].alias("rule"),
            a["gate"]["missing"].alias("missing"),
        )

    return let(asked, outcome)


def gated(read: DataFrame, whole_words: bool = False, modes=MODES) -> DataFrame:
    """``read`` with claims, the array of judged claims; null where the response wasn't usable. What all
    of a profile's claims are judged by is bound once, since an expression within a lambda would be
    computed for each of them."""
    record = F.struct("hay", "spans", "raw_text")
    each = lambda r: F.transform(proposed(F.col("data")), lambda c: judged(c, r["hay"], r["spans"], r["raw_text"], whole_words, modes))
    return read.withColumn("claims", F.when(F.col("failure").isNull(), let(record, each)))


def _kept(claims: Column) -> Column:
    beat = lambda c: F.struct(
        c["kind"].alias("kind"),
        c["pos"].alias("pos"),
        c["description"].alias("description"),
        tidy_quote(c["evidence"]).alias("evidence"),
        beat_confidence(c["reported"], c["evidence"]).alias("confidence"),
    )
    return F.transform(F.filter(claims, lambda c: c["outcome"] == "kept"), beat)


def _rows(df: DataFrame, array: str) -> DataFrame:
    """A row per element. The outer form, since the plain one would have Spark compute the array a
    second time in a filter of its own."""
    return df.select("profile_id", F.explode_outer(array).alias("_c")).filter("_c is not null").select("profile_id", "_c.*")


def kept_claims(tested: DataFrame) -> DataFrame:
    return _rows(tested.select("profile_id", _kept(F.col("claims")).alias("_k")), "_k")


def dropped_claims(tested: DataFrame) -> DataFrame:
    """Every claim that isn't kept, with overlap and reason. The likeness search gets a profile's
    unverified claims in one call, and only these."""
    unverified = F.filter("claims", lambda c: c["outcome"] == "unverified")
    rest = F.filter("claims", lambda c: c["outcome"].isin("contradicts_dates", "unsupported"))
    row = lambda c, overlap, reason: F.struct(
        *[c[x].alias(x) for x in ("kind", "pos", "description", "evidence")],
        overlap.alias("overlap"),
        reason.alias("reason"),
        c["rule"].alias("rule"),
        c["missing"].alias("missing"),
    )
    parts = tested.filter("failure is null").select("profile_id", "hay", unverified.alias("_u"), rest.alias("_r"))
    searched = parts.select("profile_id", "_u", "_r", drop_verdicts(F.transform("_u", lambda c: c["needle"]), F.col("hay")).alias("_v"))
    every = F.concat(
        F.zip_with("_u", "_v", lambda c, v: row(c, v["overlap"], v["reason"])),
        F.transform("_r", lambda c: row(c, F.lit(1.0), c["outcome"])),
    )
    return _rows(searched.select("profile_id", every.alias("_d")), "_d")


def supporting_quotes(raw: Column, hay: Column, claim: Column, modes=MODES) -> Column:
    """The strings of ``raw`` that stand in the text and, where there is a claim, support it."""
    return F.filter(raw, lambda q: is_verbatim(canonical(q), hay) & ((claim == "") | gate(claim, q, modes)["ok"]))


def verified_quotes(raw: Column, hay: Column, claim: Column) -> Column:
    """``supporting_quotes``, tidied, without repeats, in their order."""
    return F.array_distinct(F.transform(supporting_quotes(raw, hay, claim), tidy_quote))


def arcs(tested: DataFrame) -> DataFrame:
    """One row per profile with a usable response: headline texts with their verified quotes, kept
    beats by kind, counts, warnings and the derived confidence."""
    data = F.col("data")
    tension = F.coalesce(strip(R.as_text(R.field(data, "unresolved_tension"))), F.lit(""))
    base = tested.filter("failure is null").select(
        "profile_id", "data", "hay", "throughline",
        tension.alias("unresolved_tension"), one_person(F.col("raw_text")).alias("who"), F.size("claims").alias("proposed"), _kept(F.col("claims")).alias("beats"),
    )
    of = lambda kind: F.transform(
        F.filter("beats", lambda b: b["kind"] == kind), lambda b: F.struct(*[b[c].alias(c) for c in ("pos", "description", "evidence", "confidence")])
    )
    total = F.aggregate("beats", F.lit(0.0), lambda a, b: a + b["confidence"])
    quotes = lambda hay: F.struct(
        verified_quotes(R.strings(data, "throughline_evidence"), hay, F.col("throughline")).alias("throughline_evidence"),
        verified_quotes(R.strings(data, "tension_evidence"), hay, F.col("unresolved_tension")).alias("tension_evidence"),
    )
    counted = base.select(
        "*",
        let(F.col("hay"), quotes).alias("headline"),
        F.size("beats").alias("kept"),
        F.size(F.array_distinct(F.transform("beats", lambda b: canonical(b["evidence"])))).alias("distinct_quotes"),
        total.alias("total"),
    )
    none = F.array().cast("array<struct<ok: boolean, reason: string, evidence: array<string>>>")
    out = counted.select(
        "profile_id",
        "throughline",
        "unresolved_tension",
        *[F.col("headline")[c].alias(c) for c in ("throughline_evidence", "tension_evidence")],
        *[of(k).alias(k) for k in KINDS],
        "proposed",
        "kept",
        drop_rate(F.col("proposed") - F.col("kept"), F.col("proposed")).alias("drop_rate"),
        F.when(~F.col("who.ok"), F.array("who")).otherwise(none).alias("warnings"),
        arc_confidence(F.col("kept"), F.col("proposed"), F.col("distinct_quotes"), F.coalesce(F.col("total") / F.nullif("kept", F.lit(0)), F.lit(0.0))).alias("confidence"),
    )
    return out.withColumn("throughline_anchored", F.size("throughline_evidence") > 0).withColumn("tension_anchored", F.size("tension_evidence") > 0)
