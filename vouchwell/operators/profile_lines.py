"""Line classes of a profile export, and the text without its furniture.

A document's lines are numbered and its headings carried down with windows over the document; no
window crosses documents. Every non-blank line ends up either kept or removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vouchwell.functions.lexicon import HEADINGS, LIST_SECTIONS, PROSE_SECTIONS
from vouchwell.functions.text import SPACE, SPACE_CLASS, lines, strip, word_count
from vouchwell.sources.decode import unescape_html

# What furniture looks like.
PROSE_WORDS = 8
PHONE_DIGITS = 9
PHONE = rf"^{SPACE}*\+?[0-9][0-9{SPACE_CLASS}().-]{{7,}}$"
FURNITURE = (
    rf"(?iu)^{SPACE}*page{SPACE}+[0-9]+{SPACE}+of{SPACE}+[0-9]+{SPACE}*$",
    rf"^{SPACE}*[0-9]{{1,3}}{SPACE}*$",
    rf"(?U)^{SPACE}*[\w.+-]+@[\w-]+\.[\w.]+{SPACE}*$",
)
FURNITURE_AFTER_PHONE = (
    rf"(?iu)^{SPACE}*(www\.|https?://)[^{SPACE_CLASS}]+",
    rf"(?iu)^{SPACE}*[0-9][0-9,+]*{SPACE}+(connections|followers){SPACE}*$",
    rf"(?iu)^{SPACE}*contact{SPACE}*$",
    rf"(?iu)^{SPACE}*\(linkedin\){SPACE}*$",
    rf"(?U)^{SPACE}*[\w.+-]+@[\w-]+{SPACE}*$",
    rf"(?iu)^{SPACE}*\.[a-z]{{2,6}}{SPACE}*$",
    rf"(?iu)^{SPACE}*[^{SPACE_CLASS}]+\.[a-z]{{2,6}}{SPACE}*\((other|personal|company|portfolio)\){SPACE}*$",
)
DATE_LINE = (
    rf"(?iUu)^{SPACE}*(\w+{SPACE}+)?[0-9]{{4}}{SPACE}*[-–—to]+{SPACE}*((\w+{SPACE}+)?[0-9]{{4}}|present|current){SPACE}*$"
)


def is_prose(line: Column) -> Column:
    return word_count(line) >= PROSE_WORDS


def heading(line: Column) -> Column:
    """The recognised heading that a line is, or null."""
    key = F.lower(F.btrim(strip(line), F.lit(":")))
    return F.when(key.isin(*HEADINGS), key)


def is_furniture(line: Column) -> Column:
    """Page numbers, addresses, phone numbers and other lines of an export's layout. A phone number
    has nine digits at least; where its shape matches with fewer, no later form is tried."""
    digits = F.length(F.regexp_replace(line, "[^0-9]", ""))
    found = F.when(line.rlike(FURNITURE[0]), F.lit(True))
    for pattern in FURNITURE[1:]:
        found = found.when(line.rlike(pattern), F.lit(True))
    found = found.when(line.rlike(PHONE), digits >= PHONE_DIGITS)
    for pattern in FURNITURE_AFTER_PHONE:
        found = found.when(line.rlike(pattern), F.lit(True))
    return found.otherwise(F.lit(False))


def is_date_line(line: Column) -> Column:
    return line.rlike(DATE_LINE)


def classify_lines(docs: DataFrame, key: str, text: str, unescape: bool = True) -> DataFrame:
    """key, pos, line and action: "kept", "removed", or "skipped" (a blank line in a section of
    other people's prose, which is in neither output)."""
    raw = F.coalesce(F.col(text), F.lit(""))
    whole = docs.select(F.col(key), (unescape_html(raw) if unescape else raw).alias("_text"))
    apart = whole.select(key, F.posexplode(lines(F.col("_text"))).alias("pos", "line"))
    by_line = Window.partitionBy(key).orderBy("pos")
    so_far = by_line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = (
        apart.withColumn("head", heading(F.col("line")))
        .withColumn("section", F.last("head", ignorenulls=True).over(so_far))
        .withColumn("segment", F.count("head").over(so_far))
        .withColumn("blank", strip(F.col("line")) == "")
        .withColumn("ends", F.col("head").isNull() & (F.col("blank") | is_prose(F.col("line"))))
    )
    in_segment = Window.partitionBy(key, "segment").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = F.max(F.col("ends").cast("int")).over(in_segment) == 1
    seen = seen.withColumn("ended", ended)
    dropped_heads = [*LIST_SECTIONS, *PROSE_SECTIONS, "contact"]
    furniture = ~F.col("blank") & ~is_date_line(F.col("line")) & is_furniture(F.col("line"))
    action = (
        F.when(F.col("head").isin(*dropped_heads), F.lit("removed"))
        .when(F.col("head").isNotNull(), F.lit("kept"))
        .when(F.col("section").isin(*LIST_SECTIONS) & ~F.col("ended"), F.lit("removed"))
        .when(F.col("section").isin(*PROSE_SECTIONS) & F.col("blank"), F.lit("skipped"))
        .when(F.col("section").isin(*PROSE_SECTIONS), F.lit("removed"))
        .when(furniture, F.lit("removed"))
        .otherwise(F.lit("kept"))
    )
    return seen.select(key, "pos", "line", action.alias("action"))


def strip_furniture(docs: DataFrame, key: str, text: str, unescape: bool = True) -> DataFrame:
    """key, text (the kept lines) and removed (the removed ones, in order) per document."""
    item = F.struct("pos", "line")
    per_doc = classify_lines(docs, key, text, unescape).groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(F.col("action") == "kept", item))).alias("kept"),
        F.array_sort(F.collect_list(F.when(F.col("action") == "removed", item))).alias("gone"),
    )
    joined = docs.select(key).join(per_doc, key, "left")
    return joined.select(
        key,
        strip(F.coalesce(F.array_join("kept.line", "\n"), F.lit(""))).alias("text"),
        F.coalesce("gone.line", F.array().cast("array<string>")).alias("removed"),
    )
