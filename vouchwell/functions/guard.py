"""Finds text that reads as a message to a person rather than a note about one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vouchwell.functions.text import let

# The patterns in the order they are tried, and what each finds.
PATTERNS = (
    (r"(?iu)\b(hi|hey|hello|dear)\b[ ,]+[A-Z][a-z]+", "salutation"),
    (r"(?iumd)^[ \t\r\x0b\f]*(hi|hey|hello|dear)\b", "salutation"),  # lines above it of white space change nothing
    (r"(?iu)\b(best|regards|cheers|thanks|sincerely|warmly)\s*,\s*\n", "sign-off"),
    (r"(?iu)\b(best|kind) regards\b", "sign-off"),
    (r"(?iu)\bi(?:'d| would) love to (chat|talk|connect|hear)\b", "second-person pitch"),
    (r"(?iu)\bwould you be (open|interested|available)\b", "second-person pitch"),
    (r"(?iu)\bi(?:'m| am)?\s+reaching out\b", "outreach opener"),
    (r"(?iu)\bcame across your (profile|background|work)\b", "outreach opener"),
    (r"(?iu)\b(are|were) you (open|interested|looking)\b", "second-person pitch"),
    (r"(?iu)\blet me know if you\b", "second-person pitch"),
)
QUOTED = " [quoted] "


def without_quotes(text: Column, exempt: Column) -> Column:
    """The text with each exempt citation blanked out."""
    return F.aggregate(
        F.filter(exempt, lambda s: s.isNotNull() & (s != "")), F.coalesce(text, F.lit("")), lambda a, s: F.replace(a, s, F.lit(QUOTED))
    )


def sendable_kind(text: Column, exempt: Column | None = None) -> Column:
    """The kind of sendable text that the first matching pattern finds, or null."""

    def of(looked):
        found = F.when(looked.rlike(PATTERNS[0][0]), F.lit(PATTERNS[0][1]))
        for pattern, kind in PATTERNS[1:]:
            found = found.when(looked.rlike(pattern), F.lit(kind))
        return found

    return of(F.coalesce(text, F.lit(""))) if exempt is None else let(without_quotes(text, exempt), of)


def reject_sendable(text: Column, exempt: Column | None = None) -> Column:
    """The text itself; the query fails where it reads as a message."""
    kind = sendable_kind(text, exempt)
    return F.when(kind.isNotNull(), F.raise_error(F.concat(F.lit("sendable text: "), kind))).otherwise(text)


def quarantine(text: Column, fallback: str) -> Column:
    """STRUCT<value, kind>: the fallback in place of a text that reads as a message."""
    kind = sendable_kind(text)
    return F.struct(F.when(kind.isNotNull(), F.lit(fallback)).otherwise(text).alias("value"), kind.alias("kind"))
