"""Does a role continue an arc? Recorded verdicts, held back where the arc is thin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchwell.functions import responses as R
from vouchwell.functions.overlap import skill_overlap
from vouchwell.functions.text import let, strip, strip_thinking

# Fixed value: below this arc confidence no verdict stands.
AMBIGUITY_FLOOR = 0.45


#: Roles up to this count are broadcast to the pairs. Beyond it they meet the pairs by a shuffle.
MAX_BROADCAST_ROLES = 5_000


def broadcast_roles(roles: DataFrame) -> DataFrame:
    """Marked for broadcast where they are few: a shuffle by role would put all pairs of a role into one task."""
    return F.broadcast(roles) if roles.limit(MAX_BROADCAST_ROLES + 1).count() <= MAX_BROADCAST_ROLES else roles


def pair_up(profiles: DataFrame, roles: DataFrame) -> DataFrame:
    """Every profile with every role, where that is asked for; else give a table of pairs."""
    return profiles.select("profile_id").crossJoin(broadcast_roles(roles.select("role_id")))


def read_fits(fit_responses: DataFrame) -> DataFrame:
    """Responses with said (the verdict), flags, reasoning and failure in place of their content. They
    come out of a generator of one row, since a filter on the failure would otherwise move below it, to
    the rows that the content is made from, and have each response read again for it."""
    rest = [F.col(f"`{c}`") for c in fit_responses.columns if c != "content"]

    def read(j):
        data = j["data"]
        flags = F.filter(F.transform(R.items(data, "risk_flags"), lambda x: strip(F.try_variant_get(x, "$", "string"))), lambda x: x != "")
        told = lambda reasoning: F.struct(
            R.verdict(R.field(data, "continues_arc")).alias("said"),
            flags.alias("flags"),
            reasoning.alias("reasoning"),
            F.coalesce(j["failure"], F.when(reasoning == "", F.lit("no_reasoning"))).alias("failure"),
        )
        return let(F.coalesce(strip(R.as_text(R.field(data, "reasoning"))), F.lit("")), told)

    return fit_responses.select(*rest, F.inline_outer(F.array(let(R.json_object(strip_thinking(F.col("content"))), read))))


def judge(arcs: DataFrame, roles: DataFrame, profiles: DataFrame, fit_responses: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Responses (profile_id, role_id, content) on arcs, each with its failure, or null and a fit:
    continues_arc (null: no clear answer), reasoning, risk_flags, withheld (a verdict was there but
    didn't stand) and skill_overlap; and the columns of arcs and profiles that ``carry`` names."""
    kept = [c for c in carry if c in arcs.columns]
    more = [c for c in carry if c in profiles.columns]
    read = (
        read_fits(fit_responses.select("profile_id", "role_id", "content"))
        .join(arcs.select("profile_id", F.col("confidence").alias("arc_confidence"), *kept), "profile_id")
        .join(profiles.select("profile_id", "raw_text", *more), "profile_id")
        .join(broadcast_roles(roles.select("role_id", "raw_description")), "role_id")
    )
    withheld = F.col("said").isNotNull() & (F.col("arc_confidence") < AMBIGUITY_FLOOR)
    notice = F.concat(
        F.lit("No verdict stands on an arc with confidence "), F.col("arc_confidence").cast("string"), F.lit(f" (the floor is {AMBIGUITY_FLOOR}); one was offered.")
    )
    return read.select(
        "profile_id",
        "role_id",
        "failure",
        F.when(~withheld, F.col("said")).alias("continues_arc"),
        "reasoning",
        F.when(withheld, F.array_prepend("flags", notice)).otherwise(F.col("flags")).alias("risk_flags"),
        withheld.alias("withheld"),
        skill_overlap(F.col("raw_text"), F.col("raw_description")).alias("skill_overlap"),
        *carry,
    )


def assess(
    arcs: DataFrame, roles: DataFrame, profiles: DataFrame, fit_responses: DataFrame, carry: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """(fits, failures) of responses: the rows that ``judge`` gives, by their failure."""
    return parted(judge(arcs, roles, profiles, fit_responses, carry))


def parted(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    return judged.filter("failure is null").drop("failure"), judged.filter("failure is not null").select("profile_id", "role_id", "failure")
