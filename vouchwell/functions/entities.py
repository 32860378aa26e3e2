"""HTML character references decoded by column expressions: numbers, names, and the names that need
no semicolon, of which the longest that begins a reference counts."""

from __future__ import annotations

import html
import json
import zlib
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from vouchwell.functions.text import let

_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_REPLACED = "�"
#: Places of the table of names: a map is searched from its start, so each holds few names.
_PLACES = 4096


@lru_cache(maxsize=1)
def _tables() -> tuple[str, int, int]:
    """The standard's names, each at the place that its checksum comes to, as JSON, and the lengths of
    the shortest and the longest name without semicolon."""
    places: list[dict[str, str]] = [{} for _ in range(_PLACES)]
    for name, text in html5.items():
        places[zlib.crc32(name.encode()) % _PLACES][name] = text
    bare = [len(n) for n in html5 if not n.endswith(";")]
    return json.dumps(places), min(bare), max(bare)


def _numbered(digits: Column, base: int) -> Column:
    """The character of a number; those that no document may hold give none, those of an old code
    page give what it has there."""
    bare = F.ltrim(digits, F.lit("0"))
    sized = F.when(F.length(bare) > 7, F.lit(0x110000)).when(bare == "", F.lit(0)).otherwise(F.conv(bare, base, 10).cast("int"))

    def of(n):
        # the control codes that the standard reads as that code page's characters
        page = {i: html.unescape(f"&#{i};") for i in [0, 13, *range(0x80, 0xA0)]}
        old = F.try_element_at(F.create_map(*[F.lit(x) for pair in page.items() for x in pair]), n)
        low = n.bitwiseAND(0xFFFF)
        none = n.between(1, 8) | (n == 11) | n.between(14, 31) | n.between(127, 159) | n.between(0xFDD0, 0xFDEF) | (low >= 0xFFFE)
        lone = n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
        plain = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        return F.coalesce(old, F.when(lone, F.lit(_REPLACED)).when(none, F.lit("")).otherwise(plain))

    return let(sized, of)


def _named(name: Column, table: Column, shortest: int, longest: int) -> Column:
    """The text of a name, or of the longest part from its start that is one, with the rest."""
    place = lambda part: F.get(table, (F.crc32(part.cast("binary")) % _PLACES).cast("int"))
    of = lambda part: F.try_element_at(place(part), part)

    def begun(whole: Column, n: int) -> Column:
        found = let(F.substring(whole, 1, n), of)
        return F.when(F.length(whole) > n, F.concat(found, F.substring(whole, F.lit(n + 1), F.length(whole))))

    return let(name, lambda w: F.coalesce(of(w), *[begun(w, n) for n in range(longest, shortest - 1, -1)], F.concat(F.lit("&"), w)))


def _decoded(reference: Column, table: Column, shortest: int, longest: int) -> Column:
    digits = lambda first: F.rtrim(F.substring(reference, F.lit(first), F.length(reference)), F.lit(";"))
    return (
        F.when(reference.rlike("^&#[xX]"), _numbered(digits(4), 16))
        .when(F.startswith(reference, F.lit("&#")), _numbered(digits(3), 10))
        .otherwise(_named(F.substring(reference, F.lit(2), F.length(reference)), table, shortest, longest))
    )


def unescape(text: Column) -> Column:
    """All references decoded; texts without an ampersand are left as they are."""
    names, shortest, longest = _tables()
    table = F.from_json(F.lit(names), "array<map<string, string>>")  # a constant: parsed once

    def of(t):
        found = F.transform(F.regexp_extract_all(t, F.lit(_REFERENCE), F.lit(0)), lambda r: _decoded(r, table, shortest, longest))
        return let(found, lambda f: _woven(F.split(t, _REFERENCE, -1), f))  # bound: once a text, not once a reference

    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), of(t)).otherwise(t))


def _woven(between: Column, found: Column) -> Column:
    """The parts of a text with what stands between them, in turn."""
    return F.array_join(F.transform(between, lambda part, i: F.concat(part, F.coalesce(F.get(found, i), F.lit("")))), "")
