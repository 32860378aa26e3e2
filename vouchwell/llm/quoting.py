"""Chat formatting by quotation linking, in DataFrame functions only.

Lines that start with ``>`` are quotations, nested by the number of marks. Runs of one level are
passages. A passage as a whole, its paragraphs (their lines folded, so wrapping doesn't matter), its
lines and its sentences are normalised (lower case, single spaces), hashed, and joined to the message
of the same conversation that first said them: as its whole text, a paragraph, a line or a sentence.
Short lines and sentences count only where one message alone of the conversation says them. A part of
a sentence links nothing. The shallowest linked passage names a message's parent; parents give threads. The output has
the messages without quotations and without the line that announces one, with the keys that order
them: ``root_turn`` (the thread's first message), then ``turn``; a reply comes after what it quotes.

Units of the originals are reduced to their first turn per (conversation, hash) before the join, so
a common line costs one row however often it occurs, and no two messages are paired but by a quote.

Edge cases: null and empty texts stay as they are and link nothing; a message that only quotes has
an empty text; a null conversation or turn links nothing; repeated (conversation, turn) rows share
their links; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vouchwell.llm._shared import materialize

QUOTE = r"^[ \t]*>"
_QUOTES = r"(?:^|[\r\n])[ \t]*>"  # a line that lines are split into, not one of Java's own kinds
_PREFIX = r"^[ \t>]*>[ \t]?"  # no repeated group: Java's stack would grow with the marks
_ANNOUNCES = r"(?i)^[ \t]*(on\b.*\bwrote|am\b.*\bschrieb\b.*|le\b.*\ba écrit|el\b.*\bescribió)[ \t]*:[ \t]*$"
#: Normalised lines and sentences shorter than this are a link only where no other message says them.
LEAST_LINE = 12
_BLANKS = " \t\n"
#: Pointer jumping doubles the depth it has seen each round.
MAX_ROUNDS = 40


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n]+", " "))


def _lines(text: Column) -> Column:
    return F.split(text, "\r\n|\n|\r")


def own_text(text: Column) -> Column:
    """The text without quotations and the lines that announce them."""
    lines = _lines(text)
    following = lambda i: F.coalesce(F.try_element_at(lines, i + 2), F.lit(""))
    kept = F.filter(lines, lambda x, i: ~x.rlike(QUOTE) & ~(x.rlike(_ANNOUNCES) & following(i).rlike(QUOTE)))
    return F.when(text.rlike(_QUOTES), F.btrim(F.array_join(kept, "\n"), F.lit(_BLANKS))).otherwise(text)


def passages(messages: DataFrame) -> DataFrame:
    """Quoted passages: conv_id, turn, passage (its number), level, lines (without marks)."""
    quoting = messages.filter(F.col("text").rlike(_QUOTES)).select("conv_id", "turn", F.xxhash64("text").alias("said"), "text").distinct()
    apart = quoting.select("conv_id", "turn", "said", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    prefix = F.regexp_extract("line", _PREFIX, 0)
    levelled = apart.select(
        "conv_id", "turn", "said", "pos", F.length(F.regexp_replace(prefix, "[^>]", "")).alias("level"), F.regexp_replace("line", _PREFIX, "").alias("body")
    )
    along = Window.partitionBy("conv_id", "turn", "said").orderBy("pos")  # one message
    turned = F.coalesce(F.lag("level").over(along) != F.col("level"), F.lit(True)).cast("int")
    numbered = levelled.withColumn("new", turned).withColumn("passage", F.sum("new").over(along))
    return (
        numbered.filter("level > 0")
        .groupBy("conv_id", "turn", "said", "passage", "level")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "body"))).alias("l"))
        .select("conv_id", "turn", "said", "passage", "level", F.col("l.body").alias("lines"))
    )


def _keys(text: Column) -> Column:
    """Hashes with a weight: the characters that a match explains; a whole text or paragraph counts
    double. ``short`` ones must be said by one message alone."""
    part = lambda x, times, short: F.struct(
        F.xxhash64(x).alias("hash"), (F.length(x) * times).alias("weight"), short.alias("short")
    )
    paragraphs = F.transform(F.split(text, r"\r?\n[ \t]*\r?\n"), normalised)
    sentences = F.flatten(F.transform(paragraphs, lambda p: F.split(p, "(?<=[.!?…]) ")))
    small = F.concat(F.transform(_lines(text), normalised), sentences)
    every = F.concat(
        F.array(part(normalised(text), 2, F.lit(False))),
        F.transform(paragraphs, lambda x: part(x, 2, F.lit(False))),
        F.transform(small, lambda x: part(x, 1, F.length(x) < LEAST_LINE)),
    )
    return F.array_distinct(F.filter(every, lambda x: x["weight"] > 0))


def links(messages: DataFrame) -> DataFrame:
    """Linked passages: conv_id, turn, passage, level, quoted_turn, weight."""
    quoted = materialize(passages(messages), "quotes")
    asked = quoted.select("conv_id", "turn", "said", "passage", "level", F.explode(_keys(F.array_join("lines", "\n"))).alias("k"))
    asked = asked.select("conv_id", "turn", "said", "passage", "level", "k.hash", "k.weight", "k.short")
    where = quoted.select("conv_id").distinct()
    own = messages.filter("text is not null").join(where, "conv_id", "left_semi").select("conv_id", "turn", own_text(F.col("text")).alias("text"))
    units = own.select("conv_id", "turn", F.explode(_keys(F.col("text"))).alias("k"))
    first = units.groupBy("conv_id", F.col("k.hash").alias("hash")).agg(F.min("turn").alias("quoted_turn"), F.max("turn").alias("last_turn"))
    found = asked.join(first, ["conv_id", "hash"]).filter("quoted_turn < turn and (not short or quoted_turn = last_turn)")
    weighed = found.groupBy("conv_id", "turn", "said", "passage", "level", "quoted_turn").agg(F.sum("weight").alias("weight"))
    best = weighed.groupBy("conv_id", "turn", "said", "passage", "level").agg(F.max(F.struct("weight", "quoted_turn")).alias("b"))
    return best.select("conv_id", "turn", "passage", "level", "b.quoted_turn", "b.weight")


def threads(linked: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn, root_turn and depth of the messages that reply to a quoted one."""
    parent = linked.groupBy("conv_id", "turn").agg(
        F.max(F.struct((-F.col("level")).alias("l"), "weight", "quoted_turn")).alias("b"), F.count("*").alias("n_linked")
    )
    state = parent.select(
        "conv_id", "turn", F.col("b.quoted_turn").alias("parent_turn"), F.col("b.quoted_turn").alias("root_turn"), F.lit(1).alias("depth"), "n_linked"
    )
    state = materialize(state, "threads")
    for _ in range(MAX_ROUNDS):
        above = state.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("up"), F.col("depth").alias("more"))
        moved = state.join(above, ["conv_id", "root_turn"], "left")
        if moved.filter("up is not null").limit(1).count() == 0:
            return state
        state = materialize(
            moved.select(
                "conv_id", "turn", "parent_turn", F.coalesce("up", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), "n_linked"
            ),
            "threads",
        )
    raise RuntimeError("threads did not settle")


def format_messages(messages: DataFrame) -> DataFrame:
    """Per message: conv_id, turn, role, text without quotations, n_quotes (quoted lines), n_linked
    (linked passages), parent_turn, root_turn, depth, and the message as chat markup."""
    slim = messages.select("conv_id", "turn", "role", "text")
    found = threads(links(slim)).select("conv_id", "turn", "parent_turn", "root_turn", "depth", "n_linked")
    own = own_text(F.col("text"))
    quoted = F.when(F.col("text").rlike(_QUOTES), F.size(F.filter(_lines(F.col("text")), lambda x: x.rlike(QUOTE)))).otherwise(F.lit(0))
    clean = slim.select("conv_id", "turn", "role", own.alias("text"), quoted.alias("n_quotes"))
    return clean.join(found, ["conv_id", "turn"], "left").select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.col("n_quotes").cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "parent_turn",
        F.coalesce("root_turn", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n<|end|>\n")).alias("markup"),
    )
