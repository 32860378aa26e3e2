"""The library's queries over the test tables. Each has its SQL in ``vouchwell.plans.oracle`` unless
SQL can't express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchwell.functions import responses, timeline
from vouchwell.functions.confidence import arc_confidence, drop_rate
from vouchwell.functions.gate import gate, numbers
from vouchwell.functions.guard import sendable_kind
from vouchwell.functions.identity import emails
from vouchwell.functions.overlap import shared_terms, tokens
from vouchwell.functions.text import canonical, html_text, lines, normalize, strip, tidy_quote
from vouchwell.operators import containment, profile_lines, records
from vouchwell.plans.pipeline import verify
from vouchwell.sources import intake

#: Word lists for the gate over invented prose: words that it has.
TURN_MODES = (("alpha", ("thing", "edth")), ("beta", ("ation", "lich")), ("gamma", ("eaux", "ción")))


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns or "*")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores, where the file's layout would leave most of them idle: a table of a
    few splits is dealt out anew, a larger one is read as it lies."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def keyed(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt out by their key over all cores. What is joined by that key stays where it lies,
    and rows of few bytes but much work aren't put into few tasks."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def texts(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents", "doc_id", "text", *more))


def verify_containment(spark, sf_dir):
    """Benchmark passages that stand word for word in documents."""
    return containment.find_quotes(read(spark, sf_dir, "benchmark"), texts(spark, sf_dir), "item_id", "text", "doc_id", "text")


def canonical_text(spark, sf_dir):
    """P1, P2, P15 of whole texts, as digests."""
    d = texts(spark, sf_dir)
    t = F.col("text")
    return d.select("doc_id", F.md5(normalize(t)).alias("normal"), F.md5(canonical(t)).alias("canonical"), F.md5(tidy_quote(t)).alias("tidy"))


def intake_floor(spark, sf_dir):
    """Trimmed lengths and refusals."""
    d = texts(spark, sf_dir).select("doc_id", strip(F.coalesce("text", F.lit(""))).alias("t"))
    return d.select("doc_id", F.length("t").cast("long").alias("n"), intake.refusal(F.col("t"), intake.MIN_PROFILE_CHARS).alias("reason"))


def derived_titles(spark, sf_dir):
    """A title from the first line."""
    d = texts(spark, sf_dir).select("doc_id", strip("text").alias("t")).filter("t <> ''")
    return d.select("doc_id", intake.derive_title(F.col("t")).alias("title"))


def line_classes(spark, sf_dir):
    """Lines kept, removed and skipped per document."""
    c = profile_lines.classify_lines(texts(spark, sf_dir), "doc_id", "text", unescape=False)
    return c.groupBy("doc_id", "action").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))


def html_plain(spark, sf_dir):
    """Page text the plain way, as a digest, with its floor."""
    p = spread(read(spark, sf_dir, "pages", "page_id", "html")).select("page_id", html_text(F.col("html")).alias("t"))
    return p.select("page_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"), (F.length("t") >= 80).alias("readable"))


def _turns(spark, sf_dir):
    """Each user turn with the assistant's next."""
    c = read(spark, sf_dir, "conversations")
    u = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("claim"))
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("quote"))
    return u.join(a, ["conv_id", "turn"])


def gate_turns(spark, sf_dir):
    """The gate with given word lists over consecutive turns."""
    g = gate(F.col("claim"), F.col("quote"), modes=TURN_MODES)
    return _turns(spark, sf_dir).select("conv_id", "turn", g["rule"].alias("rule"), g["ok"].alias("ok"))


def guard_turns(spark, sf_dir):
    """What reads as a message, over turns with an opening put before every third."""
    c = read(spark, sf_dir, "conversations")
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Hi Ada, "), F.col("text"))).when(
        F.col("turn") % 3 == 1, F.concat(F.col("text"), F.lit(" I'd love to chat"))
    ).otherwise(F.col("text"))
    return c.select("conv_id", "turn", sendable_kind(said).alias("kind"))


def overlap_turns(spark, sf_dir):
    """O1, O2: terms that two consecutive turns share."""
    o = shared_terms(tokens(F.col("claim")), tokens(F.col("quote")))
    return _turns(spark, sf_dir).select(
        "conv_id", "turn", o["matched_count"].cast("long").alias("shared"), o["role_term_count"].cast("long").alias("terms"), F.array_join(o["matched"], " ").alias("words")
    )


def source_emails(spark, sf_dir):
    """Distinct addresses by source."""
    d = texts(spark, sf_dir, "source").select("source", F.explode(emails(F.coalesce("text", F.lit("")))).alias("email"))
    return d.groupBy("source").agg(F.count_distinct("email").alias("emails"), F.count("*").alias("mentions"))


def repeated_lines(spark, sf_dir):
    """Lines that stand twice or more in a document."""
    d = texts(spark, sf_dir).select("doc_id", F.explode(lines(F.coalesce("text", F.lit("")))).alias("line"))
    n = d.filter(strip("line") != "").groupBy("doc_id", "line").count().filter("count > 1")
    return n.groupBy("doc_id").agg(F.count("*").alias("repeated"), F.sum("count").alias("copies"))


def number_sets(spark, sf_dir):
    """P5: the distinct numbers of each document."""
    d = texts(spark, sf_dir).select("doc_id", numbers(F.coalesce("text", F.lit(""))).alias("n")).filter(F.size("n") > 0)
    return d.select("doc_id", F.size("n").cast("long").alias("numbers"), F.array_join(F.array_sort("n"), " ").alias("sorted"))


def stem_counts(spark, sf_dir):
    """Distinct stems per turn."""
    c = read(spark, sf_dir, "conversations")
    s = timeline.stems(F.col("text"))
    return c.select("conv_id", "turn", F.size(s).cast("long").alias("stems"), F.md5(F.array_join(F.array_sort(s), " ")).alias("digest"))


def event_props(spark, sf_dir):
    """P20: a field of the first object in the events' JSON, by type."""
    j = responses.json_object(F.concat(F.lit("props: "), F.col("props"), F.lit(" as sent")))
    e = read(spark, sf_dir, "events", "event_type", "props").select("event_type", j.alias("j"))
    e = e.select("event_type", responses.number(responses.field(F.col("j.data"), "k")).cast("long").alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.min("k").alias("least"), F.max("k").alias("most"))


def _order_spans(spark, sf_dir):
    """A span of years per customer and order status."""
    year = F.year("o_orderdate")
    return read(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.min(year).alias("start"), F.max(year).alias("end"))


def span_followed(spark, sf_dir):
    """Does another span of the customer start at or after this one's end?"""
    return records.later_start_exists(_order_spans(spark, sf_dir), "o_custkey", "start", "end", "o_orderstatus")


def span_summaries(spark, sf_dir):
    """Each customer's spans in order, as text."""
    s = F.struct("start", "end", F.col("o_orderstatus").alias("label"))
    c = _order_spans(spark, sf_dir).groupBy("o_custkey").agg(F.array_sort(F.collect_list(s)).alias("spans"))
    return c.select("o_custkey", timeline.summary(F.col("spans")).alias("summary"))


def event_owner(spark, sf_dir):
    """The user's last signup at or before each purchase."""
    e = read(spark, sf_dir, "events")
    points = e.filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    owners = e.filter("event_type = 'signup'").select("user_id", F.col("ts").alias("since"), F.col("event_id").alias("owner_id"))
    return records.owner_before(points, owners, "user_id", "ts", "since", ["owner_id"]).select("event_id", "user_id", "owner_id")


def evidence_rollup(spark, sf_dir):
    """A1, A2: share that held x coverage x mean confidence, and the drop rate, by source."""
    d = read(spark, sf_dir, "documents", "doc_id", "source", "lang").join(read(spark, sf_dir, "labels"), "doc_id")
    kept = F.col("quality") == 1
    per = d.groupBy("source").agg(
        F.count("*").alias("proposed"), F.count_if(kept).alias("kept"), F.count_distinct(F.when(kept, F.col("lang"))).alias("distinct_kept")
    )
    p, k = F.col("proposed"), F.col("kept")
    return per.select("source", "proposed", "kept", arc_confidence(k, p, F.col("distinct_kept"), F.lit(0.875)).alias("confidence"), drop_rate(p - k, p).alias("drop_rate"))


def condition_rollup(spark, sf_dir):
    """Graded rows by run and condition."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    g = d.select(F.col("lang").alias("condition"), F.col("source").alias("profile"), (F.col("quality") == 1).alias("verbatim"))
    return records.condition_rollup(g).select("condition", "claims", "verbatim", "fabricated", "fully_clean", "fully_invented", "fabrication_rate")


def region_text(spark, sf_dir):
    """Rows of a group as one ordered text: the nations of a region."""
    n = read(spark, sf_dir, "nation")
    return records.group_text(n, "n_regionkey", "n_nationkey", "n_name", ", ")


def latest_events(spark, sf_dir):
    """K5: the newest event of each user, and the newest eight of these."""
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return records.keep_latest(e, "user_id", "ts").select("user_id", "event_id", "event_type")


def label_differences(spark, sf_dir):
    """Keys whose values differ between two tables or that one lacks."""
    a = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("v"))
    b = read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 500).cast("long").alias("v"))
    return records.differences(a, b, "doc_id", "v")


def _made_responses(spark, sf_dir):
    """Profiles and recorded responses made from documents: a verbatim quote, an invented one and a
    quote too short."""
    d = texts(spark, sf_dir).filter(F.length("text") >= intake.MIN_PROFILE_CHARS)
    none = F.lit(None)
    p = d.select(
        F.col("doc_id").alias("profile_id"), F.col("text").alias("raw_text"), none.cast("string").alias("name"), none.cast("array<string>").alias("known_roles"), none.cast("string").alias("source_notes")
    )
    beat = lambda said, quote, conf: F.struct(F.lit(said).alias("description"), quote.alias("evidence"), F.lit(conf).alias("confidence"))
    body = F.to_json(
        F.struct(
            F.lit("Moves between fields").alias("throughline"),
            F.array(beat("Works with words", F.substring("raw_text", 5, 60), 0.95), beat("Counts", F.substring("raw_text", 3, 6), 0.9)).alias("departures"),
            F.array(beat("Builds a thing", F.lit("an invented passage that nobody wrote 1234"), 0.5)).alias("pursuits"),
        )
    )
    return p, p.select("profile_id", F.concat(F.lit("So: "), body, F.lit(" as asked")).alias("content"))


def claim_verification(spark, sf_dir):
    """The whole run from recorded responses to arcs."""
    profiles, responses = _made_responses(spark, sf_dir)
    arcs = verify(profiles, responses).arcs
    return arcs.select("profile_id", F.col("proposed").cast("long").alias("proposed"), F.col("kept").cast("long").alias("kept"), "confidence")


def claim_drops(spark, sf_dir):
    """Why each dropped claim failed."""
    profiles, responses = _made_responses(spark, sf_dir)
    return verify(profiles, responses).drops.select("profile_id", "kind", "pos", "reason", "overlap")


def dated_spans(spark, sf_dir):
    """Dated spans of texts with an order's years put under its customer's name."""
    o = _order_spans(spark, sf_dir).join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    text = F.concat(F.col("c_name"), F.lit("\n"), F.col("start").cast("string"), F.lit(" - "), F.col("end").cast("string"), F.lit("\nOther words\n"))
    s = o.select("o_custkey", "o_orderstatus", F.explode(timeline.spans(text)).alias("s"))
    return s.select("o_custkey", "o_orderstatus", "s.label", "s.start", "s.end", "s.line")


QUERIES = {
    f.__name__: f
    for f in (
        verify_containment,
        canonical_text,
        intake_floor,
        derived_titles,
        line_classes,
        html_plain,
        gate_turns,
        guard_turns,
        overlap_turns,
        source_emails,
        repeated_lines,
        number_sets,
        stem_counts,
        event_props,
        span_followed,
        span_summaries,
        event_owner,
        evidence_rollup,
        condition_rollup,
        region_text,
        latest_events,
        label_differences,
        claim_verification,
        claim_drops,
        dated_spans,
    )
}
