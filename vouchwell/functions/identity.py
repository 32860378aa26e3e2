"""Does a text look like two profiles in one? A warning, never a refusal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vouchwell.functions.lexicon import PROFILE_SECTIONS
from vouchwell.functions.text import let, lines, strip

# Fixed values.
HANDLE = r"(?i)linkedin\.com/in/([A-Za-z0-9\-_%]+)"
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = _LOCAL + r"+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
# The same addresses, looked for only where a run of their first characters begins or an address has ended:
# a run without an at sign is read once, not from each of its places.
_EMAIL_ONCE = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}"


def handles(text: Column) -> Column:
    """Distinct profile handles in lower case, in first-seen order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(HANDLE), F.lit(1)), F.lower))


def emails(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_EMAIL_ONCE), F.lit(0)), F.lower))


def repeated_sections(text: Column) -> Column:
    """Once-per-profile headings that stand twice or more, sorted."""
    bare = F.transform(lines(text), lambda x: F.lower(F.btrim(strip(x), F.lit(":"))))
    twice = lambda found: F.filter(found, lambda x: F.size(F.filter(found, lambda y: y == x)) > 1)
    return F.array_sort(F.array_distinct(let(F.filter(bare, lambda x: x.isin(*PROFILE_SECTIONS)), twice)))


def one_person(raw_text: Column) -> Column:
    """STRUCT<ok, reason, evidence>: two handles, else two addresses, else two repeated headings."""
    none = F.array().cast("array<string>")
    named = lambda reason, evidence: F.struct(F.lit(reason).alias("reason"), evidence.alias("evidence"))
    full = lambda h: F.transform(h, lambda x: F.concat(F.lit("linkedin.com/in/"), x))
    sections = lambda t: let(repeated_sections(t), lambda r: F.when(F.size(r) > 1, named("sections", r)))
    mails = lambda t: let(emails(t), lambda e: F.when(F.size(e) > 1, named("emails", e)).otherwise(sections(t)))
    people = lambda t: let(handles(t), lambda h: F.when(F.size(h) > 1, named("handles", full(h))).otherwise(mails(t)))
    told = lambda f: F.struct(f.isNull().alias("ok"), f["reason"].alias("reason"), F.coalesce(f["evidence"], none).alias("evidence"))
    return let(let(F.coalesce(raw_text, F.lit("")), people), told)
