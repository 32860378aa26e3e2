"""Reading recorded model responses: the first JSON object of a text, as a VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vouchwell.functions.lexicon import AMBIGUOUS
from vouchwell.functions.text import let, strip

# a string, a brace, a string without end and all after it, or other text; possessive, since Java's
# stack would grow with the characters of a string
_PARTS = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}]|".*|[^"{}]+'


def json_object(content: Column) -> Column:
    """STRUCT<data VARIANT, failure>: the first balanced object; failure is "no_object",
    "unterminated" or "malformed". What the parser reads from the first brace is that object, since
    valid JSON closes its braces outside of strings; the braces are counted where it reads nothing."""
    none = F.lit(None)
    found = lambda data, failure: F.struct(data.cast("variant").alias("data"), failure.cast("string").alias("failure"))
    read = lambda rest: let(F.try_parse_json(rest), lambda data: F.when(data.isNotNull(), found(data, none)).otherwise(_counted(rest)))

    def of(text):
        at = F.instr(text, F.lit("{"))
        rest = F.substring(text, at, F.length(text))
        return F.when(F.coalesce(at, F.lit(0)) == 0, found(none, F.lit("no_object"))).otherwise(let(rest, read))

    return let(content, of)


def _counted(rest: Column) -> Column:
    """``json_object`` of a text that begins with a brace, by counting braces outside of strings."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("done"))

    def step(s, part):
        depth = s["depth"] + F.when(part == "{", 1).when(part == "}", -1).otherwise(0)
        return F.when(s["done"], s).otherwise(
            F.struct(
                depth.alias("depth"),
                (s["size"] + F.length(part)).alias("size"),
                ((part == "}") & (depth == 0)).alias("done"),
            )
        )

    scan = F.aggregate(F.regexp_extract_all(rest, F.lit("(?s)" + _PARTS), F.lit(0)), start, step)
    parsed = lambda s: F.struct(s["done"].alias("done"), F.when(s["done"], F.try_parse_json(F.substring(rest, F.lit(1), s["size"]))).alias("data"))
    failure = lambda p: F.when(~p["done"], F.lit("unterminated")).when(p["data"].isNull(), F.lit("malformed"))
    return let(let(scan, parsed), lambda p: F.struct(p["data"].alias("data"), failure(p).alias("failure")))


def kind_of(value: Column) -> Column:
    """VOID, BOOLEAN, STRING, BIGINT, ..., ARRAY<...> or OBJECT<...>; null for an absent field."""
    return F.schema_of_variant(value)


def as_text(value: Column) -> Column:
    """A field as text: null, false, zero and empty values are the empty string."""

    def of(x):
        kind, text = x["kind"], x["text"]
        falsy = (kind == "BOOLEAN") & (text == "false")
        number = kind.rlike("^(BIGINT|DECIMAL.*|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)$") & (text.try_cast("double") == 0)
        bare = text.isNull() | text.isin("[]", "{}")
        return F.when(bare | ((kind != "STRING") & (falsy | number)), F.lit("")).otherwise(text)

    told = lambda v: F.struct(kind_of(v).alias("kind"), F.try_variant_get(v, "$", "string").alias("text"))
    return let(let(value, told), of)


def field(data: Column, name: str) -> Column:
    return F.try_variant_get(data, f"$.{name}", "variant")


def items(data: Column, name: str) -> Column:
    """The elements of an array field, or none."""
    return F.coalesce(F.try_variant_get(data, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))


def objects(data: Column, name: str) -> Column:
    """The elements that are objects."""
    return F.filter(items(data, name), lambda x: kind_of(x).startswith("OBJECT"))


def number(value: Column) -> Column:
    """A number, a numeric text or a boolean as a double, else null."""
    text = lambda v: F.try_variant_get(v, "$", "string")
    return let(value, lambda v: F.when(kind_of(v) == "BOOLEAN", (text(v) == "true").cast("double")).otherwise(strip(text(v)).try_cast("double")))


def strings(data: Column, name: str) -> Column:
    """A field that is a string or an array, as an array of its strings."""
    some = F.transform(F.filter(items(data, name), lambda x: kind_of(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))
    return let(field(data, name), lambda one: F.when(kind_of(one) == "STRING", F.array(F.try_variant_get(one, "$", "string"))).otherwise(some))


def verdict(value: Column) -> Column:
    """true, false, or null for everything that isn't a clear answer."""

    def of(x):
        said = x["said"]
        return (
            F.when(~x["plain"] | said.isin(*AMBIGUOUS), F.lit(None).cast("boolean"))
            .when(said.isin("true", "yes"), F.lit(True))
            .when(said.isin("false", "no"), F.lit(False))
        )

    told = lambda v: F.struct(F.lower(strip(F.try_variant_get(v, "$", "string"))).alias("said"), kind_of(v).isin("BOOLEAN", "STRING").alias("plain"))
    return let(let(value, told), of)
