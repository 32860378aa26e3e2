"""Mixing sources to target weights: Pareto order sampling.

Every document's expected number of copies is its source's target over its source's size. The whole
part is allocated for certain. The rest is a sample of a fixed number of words: each document has
inclusion odds of its own, those of its source times the root of the mean size over its size, so that
long texts, which would spend the words on few documents, come in less often; documents are ranked by
random odds divided by inclusion odds, and the lowest ranks are taken until the words are spent. One
document more is taken where it fills what is left up to the target better than nothing would.

The cut is found in two levels: words are summed per (source, rank bin) with map-side combining, with
as many bins as the root of the source's documents, and only the bin with the cut is ordered. So a
source with a third of all rows is never ordered in one task, at any size.

Edge cases: null and empty texts have size 0 and are never taken; a null source is a source of its
own, ordered last; repeated rows are drawn each on their own, by their turn among equal rows; equal
or null ids are told apart by their texts; an empty table gives no row; extra columns are dropped by
``mix`` and kept by ``mix_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vouchwell.llm._shared import WORD, materialize, packed, partitions, unpacked, whole_text

#: The weights that the sources take in turn.
WEIGHTS = (5, 2, 1)
_HEX = 12
#: Above this many rows of small tables (a row per source, or per repeated row) they are joined by a
#: shuffle, not broadcast.
MAX_BROADCAST_ROWS = 50_000


def uniform(seed: int) -> Column:
    """A draw from (0, 1) fixed by seed, document id, text and turn among equal rows."""
    said = [F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(str(seed)), F.col("tie"), F.col("turn").cast("string")]
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *said)), 1, _HEX), 16, 10).cast("double") + 0.5) / float(16**_HEX)


def source_turns(per_source: DataFrame) -> DataFrame:
    """The rows with ``turn``, their source's number from 0 on, by code point, null last: sources are
    ordered in ranges, numbered within their range, and ranges by their counts before."""
    spark, name = per_source.sparkSession, F.col("source").asc_nulls_last()
    ranged = per_source.repartitionByRange(partitions(spark), name).sortWithinPartitions(name)
    at = materialize(ranged.withColumn("at", F.monotonically_increasing_id()), "ranged")
    at = at.withColumn("range", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    held = at.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("held"))
    return at.join(F.broadcast(held), "range").withColumn("turn", F.col("held") + F.col("at")).drop("range", "at", "held")


def fill_level(weighted: DataFrame, share: float) -> float | None:
    """The level ``t`` with sum(min(cap, t * weight)) = share * total; None if no level reaches that.

    Newton's steps from below: each takes the sources whose cap lies under the level as full and deals
    the rest to the others, one sum over all sources. The sum is concave in the level, so steps never
    pass it, and end where no source fills up any more: in some steps, or at worst about as many as
    the total has binary digits.
    """
    total, weight = weighted.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return None
    want, full = share * total, 0
    level = want / weight
    while True:
        under = F.col("ratio") <= F.lit(level)
        sums = [F.count_if(under), F.sum(F.when(under, F.col("cap"))), F.sum(F.when(~under, F.col("weight")))]
        now, filled, open_weight = weighted.agg(*sums).first()
        if open_weight is None:
            return None
        if now <= full:
            return level
        full, level = now, (want - (filled or 0.0)) / open_weight


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """Per source: size, number of documents with words, and target. ``share`` of all words is dealt
    by weight; a target stops at ``most`` times its source's size and the excess is dealt again by
    weight. Sources are rows of a table of any length."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("worded"))
    place = (F.pmod("turn", F.lit(len(weights))) + 1).cast("int")
    weighted = (
        source_turns(materialize(per_source, "sources"))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place))
        .withColumn("cap", F.lit(most) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    weighted = materialize(weighted, "weighted")
    level = fill_level(weighted, share)
    target = F.col("cap") if level is None else F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    return weighted.select("source", "source_size", "worded", target.alias("target"))


def _bounded(small: DataFrame) -> DataFrame:
    """Marked for broadcast if it has no more than MAX_BROADCAST_ROWS rows."""
    return F.broadcast(small) if small.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else small


def _with_source(df: DataFrame, per_source: DataFrame, how: str) -> DataFrame:
    """Join on the source, null to null."""
    small = _bounded(per_source.withColumnRenamed("source", "_source"))
    return df.join(small, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def repeats(sizes: DataFrame) -> DataFrame:
    """_at (the row) and again (its turn from 1 on) of the rows with the same id and text as another,
    but the first of each group. Rows are numbered within their input task and tasks by their counts
    before, so a group of any size is dealt with in parts."""
    group = ["_id", "_tie"]
    some = sizes.groupBy(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie")).count().filter("count > 1").drop("count")
    some = _bounded(materialize(some, "repeated"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie"))
    rows = sizes.join(some, same).select("row", *group, F.shiftright("row", 33).alias("task"))  # ids of a task share their upper bits
    before = Window.partitionBy(*group).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*group, "task").count().withColumn("held", F.coalesce(F.sum("count").over(before), F.lit(0)))
    counts = _bounded(materialize(counts.select(F.col("_id").alias("_i"), F.col("_tie").alias("_t"), F.col("task").alias("_k"), "held"), "held"))
    within = F.row_number().over(Window.partitionBy(*group, "task").orderBy("row"))
    met = rows.withColumn("n", within).join(counts, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_tie") == F.col("_t")) & (F.col("task") == F.col("_k")))
    turned = met.select(F.col("row").alias("_at"), (F.col("held") + F.col("n") - 1).alias("again")).filter("again > 0")
    return _bounded(materialize(turned, "turns"))


def _rank() -> Column:
    """Random odds over inclusion odds; ties are ordered by document, text and turn."""
    odds = F.col("inclusion") / (1 - F.col("inclusion")) * F.sqrt(F.col("source_size") / F.col("worded") / F.col("size"))
    return F.struct(((F.col("u") / (1 - F.col("u"))) / odds).alias("rank"), F.col("doc_id"), F.col("tie"), F.col("turn"))


def _bin(rank: Column) -> Column:
    """Which of the source's bins a rank falls in: each step of the formula keeps the ranks' order."""
    middle = (1 - F.col("inclusion")) / F.col("inclusion")
    return F.floor(F.col("bins") / (1 + middle / rank)).cast("long")


def sampling_plan(drawn: DataFrame, share: float, most: float, weights) -> DataFrame:
    """One row per source: target, certain copies, inclusion odds, and the last rank taken."""
    targets = source_targets(drawn, share, most, weights)
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    per_source = materialize(
        targets.withColumn("sure", F.floor(expected + 1e-12).cast("long"))
        .withColumn("inclusion", F.greatest(expected - F.col("sure"), F.lit(0.0)))
        .withColumn("want", F.col("target") - F.col("sure") * F.col("source_size"))
        .withColumn("bins", F.ceil(F.sqrt(F.col("worded").cast("double")))),
        "targets",
    )
    ranked = _with_source(drawn.filter("size > 0"), per_source.filter("inclusion > 0"), "inner").withColumn("key", _rank())
    ranked = ranked.select("source", "want", "size", "key", _bin(F.col("key.rank")).alias("bin"))
    run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cut_bins = (
        ranked.groupBy("source", "bin")
        .agg(F.sum("size").alias("in_bin"), F.max("want").alias("bin_want"))
        .withColumn("held", F.sum("in_bin").over(run) - F.col("in_bin"))
        .filter((F.col("held") < F.col("bin_want")) & (F.col("held") + F.col("in_bin") >= F.col("bin_want")))
        .select("source", F.col("bin").alias("cut_bin"), "held")
    )
    cut_bins = materialize(cut_bins, "cuts")
    exact = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        _with_source(ranked, cut_bins, "inner")
        .filter(F.col("bin") == F.col("cut_bin"))
        .withColumn("upto", F.col("held") + F.sum("size").over(exact))
        .filter(F.col("upto") <= F.col("want"))
        .groupBy("source")
        .agg(F.max("key").alias("last_key"), F.max("upto").alias("spent"))
    )
    cut = materialize(_with_source(cut_bins, last, "left"), "cut")
    # one more document, the one that fills the gap up to the target best
    gap = F.col("want") - F.coalesce("spent", "held")
    top = (
        _with_source(ranked, cut, "inner")
        .filter("bin > cut_bin or (bin = cut_bin and (last_key is null or key > last_key))")
        .filter(F.abs(gap - F.col("size")) < gap)
        .groupBy("source")
        .agg(F.min(F.struct(F.abs(gap - F.col("size")).alias("off"), "key")).alias("best"))
        .select("source", F.col("best.key").alias("top_key"))
    )
    return materialize(_with_source(_with_source(per_source, cut, "left"), materialize(top, "top"), "left"), "plan")


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS, seed: int = 7) -> DataFrame:
    """doc_id, text, source, the other columns in the struct _rest, and _size, _source_size,
    _target and _copies.

    The documents are written once with a number per row, which tells repeated rows apart for good;
    after that a document's decision needs the broadcast row of its source alone.
    """
    words = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.regexp_count(F.col("text"), F.lit(WORD)))
    rows = packed(docs, "doc_id", "text", "source").select(
        "*", words.cast("long").alias("size"), F.md5(whole_text()).alias("tie"), F.monotonically_increasing_id().alias("row")
    )
    rows = materialize(rows, "rows")
    turns = repeats(rows.select("doc_id", "tie", "row"))

    def drawn(of: DataFrame) -> DataFrame:
        turned = of.join(turns, F.col("row") == F.col("_at"), "left").withColumn("turn", F.coalesce("again", F.lit(0)).cast("long"))
        return turned.withColumn("u", uniform(seed)).drop("_at", "again")

    narrow = materialize(drawn(rows.select("doc_id", "source", "size", "tie", "row")), "sizes")
    plan = sampling_plan(narrow, share, most, weights)
    joined = _with_source(drawn(rows), plan, "left")
    key = _rank()
    at = _bin(key["rank"])
    extra = (F.col("size") > 0) & (F.col("inclusion") > 0) & (
        F.col("cut_bin").isNull()
        | (at < F.col("cut_bin"))
        | ((at == F.col("cut_bin")) & F.col("last_key").isNotNull() & (key <= F.col("last_key")))
        | (F.col("top_key").isNotNull() & key.eqNullSafe(F.col("top_key")))
    )
    copies = F.when(F.col("size") > 0, F.col("sure") + F.coalesce(extra, F.lit(False)).cast("long")).otherwise(F.lit(0))
    return joined.select(
        "doc_id",
        "text",
        "source",
        "_rest",
        F.col("size").alias("_size"),
        F.col("source_size").alias("_source_size"),
        F.col("target").alias("_target"),
        copies.cast("long").alias("_copies"),
    )


def mix_documents(docs: DataFrame, **params) -> DataFrame:
    """The documents themselves, each repeated as often as the mix takes it."""
    return (
        mix(docs, **params)
        .filter(F.col("_copies") > 0)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
        .select(*unpacked(docs, "doc_id", "text", "source"))
    )
