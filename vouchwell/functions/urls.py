"""Addresses in one form, so that two spellings of a page's address are one join key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[wW]{3}\.)?([^/?#\s]*)([^?#\s]*)(\?[^#\s]*)?"


def normal_url(address: Column) -> Column:
    """Host in lower case without "www." and a plain port, path without slashes at its end, and the
    query; scheme and fragment don't count. Null where there is no host."""
    part = lambda i: F.regexp_extract(address, _PARTS, i)
    host = F.regexp_replace(F.lower(part(1)), ":(?:80|443)?$", "")
    query = F.regexp_replace(part(3), r"^\?$", "")
    return F.when(host != "", F.concat(host, F.rtrim(part(2), F.lit("/")), query))
