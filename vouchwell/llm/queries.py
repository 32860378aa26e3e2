"""The queries of the numbered operators over the tables of a scale factor, and their SQL.

SQL stands here where it can express the operator on whole tables; the others are tested against
brute force on small fixtures in ``tests/llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vouchwell.llm import bestfit, extraction, language, media, mixing, packing, periodic, quality, quoting, simhash, spotsigs, substrings, whitening
from vouchwell.llm._shared import table

PACK_TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = PACK_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.text_media(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.col("caption").cast("long").alias("n_bytes"),
        "media.payload_bytes",
        "media.payload_sha256",
        "media.tail_crc32",
        "media.media_bytes",
        "media.media_sha256",
        "media.feature",
    )


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_neighbours(table(spark, sf_dir, "documents").select("doc_id", "text"))


def similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second operator's search: classes and components of documents by their signature sets."""
    return spotsigs.similar_sets(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("_row.page_id", "_row.url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_quotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quoting.format_messages(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def planted_replies(talk: DataFrame) -> DataFrame:
    """The conversations with every message from the third on quoting the one two before it, since the
    tables' messages quote little. Of rows with one (conv_id, turn) the first by text is quoted."""
    order = Window.partitionBy("conv_id").orderBy("turn", "text", "role")
    before = F.lag("text", 2).over(order)
    replied = F.concat(F.lit("> "), F.regexp_replace(before, "\n", "\n> "), F.lit("\n\n"), F.col("text"))
    return talk.select("conv_id", "turn", "role", F.coalesce(replied, F.col("text")).alias("text"))


def quoted_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ninth operator over the conversations with replies planted in them."""
    return quoting.format_messages(planted_replies(table(spark, sf_dir, "conversations")))


OP9_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT DISTINCT text FROM conversations WHERE text IS NOT NULL),
lines AS (
  SELECT text, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT text, string_split_regex(text, '\r\n|\n|\r') AS l FROM texts)),
levels AS (
  SELECT *, regexp_extract(line, '^[ \t>]*>[ \t]?') AS prefix, length(prefix) - length(replace(prefix, '>', '')) AS level, substr(line, length(prefix) + 1) AS body,
         regexp_matches(line, '(?i)^[ \t]*(on\b.*\bwrote|am\b.*\bschrieb\b.*|le\b.*\ba (?-i:é)crit|el\b.*\bescribi(?-i:ó))[ \t]*:[ \t]*$') AS announces
  FROM lines),
marked AS (
  SELECT *, coalesce(lag(level) OVER along <> level, TRUE) AS starts, announces AND coalesce(lead(level) OVER along > 0, FALSE) AS before_quote
  FROM levels WINDOW along AS (PARTITION BY text ORDER BY pos)),
own AS (
  SELECT text, count(*) FILTER (level > 0) AS n_quotes,
         CASE WHEN count(*) FILTER (level > 0) = 0 THEN text
              ELSE trim(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (level = 0 AND NOT before_quote), ''), ' ' || chr(9) || chr(10)) END AS said
  FROM marked GROUP BY text),
passages AS (
  SELECT text, passage, level, string_agg(body, chr(10) ORDER BY pos) AS quote
  FROM (SELECT *, sum(CAST(starts AS INT)) OVER (PARTITION BY text ORDER BY pos) AS passage FROM marked) WHERE level > 0 GROUP BY text, passage, level),
talk AS (
  SELECT DISTINCT conv_id, turn, text FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations JOIN passages USING (text))),
contents AS (
  SELECT quote AS content FROM passages UNION SELECT own.said FROM talk JOIN own USING (text)),
paragraphs AS (
  SELECT content, trim(regexp_replace(lower(unnest(string_split_regex(content, '\r?\n[ \t]*\r?\n'))), '[ \t\r\n]+', ' ', 'g'), ' ') AS unit FROM contents),
small AS (
  SELECT content, trim(regexp_replace(lower(unnest(string_split_regex(content, '\r\n|\n|\r'))), '[ \t\r\n]+', ' ', 'g'), ' ') AS unit FROM contents
  UNION SELECT content, unnest(string_split(regexp_replace(unit, '([.!?…]) ', '\1' || chr(0) || chr(1), 'g'), chr(0) || chr(1))) FROM paragraphs),
units AS (
  SELECT content, trim(regexp_replace(lower(content), '[ \t\r\n]+', ' ', 'g'), ' ') AS unit, 2 * length(unit) AS weight, FALSE AS short FROM contents WHERE unit <> ''
  UNION SELECT content, unit, 2 * length(unit), FALSE FROM paragraphs WHERE unit <> ''
  UNION SELECT content, unit, length(unit), length(unit) < 12 FROM small WHERE unit <> ''),
first AS (
  SELECT conv_id, unit, min(turn) AS quoted_turn, max(turn) AS last_turn
  FROM talk JOIN own USING (text) JOIN units ON units.content = own.said GROUP BY conv_id, unit),
found AS (
  SELECT conv_id, turn, text, passage, level, quoted_turn, sum(weight) AS weight
  FROM talk JOIN passages USING (text) JOIN units ON units.content = passages.quote JOIN first USING (conv_id, unit)
  WHERE quoted_turn < turn AND (NOT short OR quoted_turn = last_turn) GROUP BY ALL),
linked AS (
  SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY conv_id, turn, text, passage, level ORDER BY weight DESC, quoted_turn DESC) = 1),
parents AS (
  SELECT conv_id, turn, quoted_turn AS parent, count(*) OVER (PARTITION BY conv_id, turn) AS n_linked
  FROM linked QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, weight DESC, quoted_turn DESC) = 1),
up AS (
  SELECT conv_id, turn, parent AS root, 1 AS depth FROM parents
  UNION ALL SELECT up.conv_id, up.turn, p.parent, depth + 1 FROM up JOIN parents p ON p.conv_id = up.conv_id AND p.turn = up.root),
roots AS (
  SELECT conv_id, turn, arg_max(root, depth) AS root, max(depth) AS depth FROM up GROUP BY conv_id, turn)
SELECT c.conv_id, c.turn, role, own.said AS text, CAST(coalesce(n_quotes, 0) AS BIGINT) AS n_quotes, CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked,
       parent AS parent_turn, coalesce(root, c.turn) AS root_turn, CAST(coalesce(depth, 0) AS BIGINT) AS depth,
       '<|' || coalesce(role, 'user') || '|>' || chr(10) || coalesce(own.said, '') || chr(10) || '<|end|>' || chr(10) AS markup
FROM conversations c LEFT JOIN own ON own.text = c.text
LEFT JOIN parents ON parents.conv_id = c.conv_id AND parents.turn = c.turn LEFT JOIN roots ON roots.conv_id = c.conv_id AND roots.turn = c.turn
"""

REPLIES_SQL = r"""
WITH RECURSIVE own AS (
  SELECT conv_id, turn, role, text, lag(text, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS quoted FROM conversations),
paragraphs AS (
  SELECT conv_id, turn, trim(regexp_replace(lower(unnest(string_split(regexp_replace(text, '\n[ \t]*\n', chr(0) , 'g'), chr(0)))), '[ \t\r\n]+', ' ', 'g')) AS said FROM own),
units AS (
  SELECT conv_id, turn, trim(regexp_replace(lower(text), '[ \t\r\n]+', ' ', 'g')) AS said FROM own
  UNION SELECT conv_id, turn, trim(regexp_replace(lower(unnest(string_split(text, chr(10)))), '[ \t\r\n]+', ' ', 'g')) FROM own
  UNION SELECT * FROM paragraphs
  UNION SELECT conv_id, turn, unnest(string_split(regexp_replace(said, '([.!?…]) ', '\1' || chr(0), 'g'), chr(0))) FROM paragraphs),
first AS (SELECT conv_id, said, min(turn) AS turn FROM units WHERE said <> '' GROUP BY ALL),
parents AS (
  SELECT own.conv_id, own.turn, first.turn AS parent FROM own
  JOIN first ON first.conv_id = own.conv_id AND first.said = trim(regexp_replace(lower(quoted), '[ \t\r\n]+', ' ', 'g')) AND first.turn < own.turn),
up AS (
  SELECT conv_id, turn, parent AS root, 1 AS depth FROM parents
  UNION ALL SELECT up.conv_id, up.turn, p.parent, depth + 1 FROM up JOIN parents p ON p.conv_id = up.conv_id AND p.turn = up.root),
roots AS (SELECT conv_id, turn, arg_max(root, depth) AS root, max(depth) AS depth FROM up GROUP BY ALL),
every AS (
  SELECT own.conv_id, own.turn, role, CASE WHEN quoted IS NULL THEN text ELSE trim(text, ' ' || chr(9) || chr(10)) END AS text,
         CASE WHEN quoted IS NULL THEN 0 ELSE len(string_split(quoted, chr(10))) END AS n_quotes, CASE WHEN parent IS NULL THEN 0 ELSE 1 END AS n_linked,
         parent, coalesce(root, own.turn) AS root, coalesce(depth, 0) AS depth
  FROM own LEFT JOIN parents USING (conv_id, turn) LEFT JOIN roots USING (conv_id, turn))
SELECT conv_id, turn, role, text, CAST(n_quotes AS BIGINT) AS n_quotes, CAST(n_linked AS BIGINT) AS n_linked, parent AS parent_turn, root AS root_turn,
       CAST(depth AS BIGINT) AS depth, '<|' || coalesce(role, 'user') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10) AS markup
FROM every
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", F.col("host").alias("source"), F.col("path").alias("lang"), "quality_score", "toxic_score", "rate_quality", "rate_toxic", "keep")


def packed_pieces(docs: DataFrame) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "continued", "continues"
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "language", "posterior", "text_language", "declared", F.col("host").alias("source"), "kept")


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourth operator over ``pages``, which have hosts, suffixes and declared markup languages;
    its text models are fitted on documents, so no page's declaration is its own label."""
    pages, docs = table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents")
    found = language.identify(language.page_evidence(pages), language.labelled_documents(docs))
    return found.select("page_id", "language", "posterior", "text_language", "declared", "host", "suffix", "kept")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_bits(F.col("fp")).alias("fingerprint"), "component_id")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_copies") * F.col("_size")).alias("taken"),
    )


OP7_SQL = r"""
WITH counted AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS tie, row_number() OVER (PARTITION BY doc_id, coalesce(text, '')) - 1 AS turn,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size
  FROM documents),
sized AS (
  SELECT *, (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':7:' || tie || ':' || turn), 1, 12) AS BIGINT) + CAST(0.5 AS DOUBLE))
           / CAST(281474976710656 AS DOUBLE) AS u
  FROM counted),
per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) FILTER (size > 0) AS worded FROM sized GROUP BY source),
weighted AS (
  SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight
  FROM per_source),
capped AS (
  SELECT *, CAST(2 AS DOUBLE) * source_size AS cap, CAST(2 AS DOUBLE) * source_size / weight AS ratio FROM weighted),
levels AS (
  SELECT *,
         (CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS BIGINT)
           - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own_level
  FROM capped),
levelled AS (
  SELECT *, first_value(CASE WHEN ratio > own_level THEN own_level END IGNORE NULLS)
              OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS level
  FROM levels),
targets AS (
  SELECT source, source_size, worded, coalesce(least(cap, level * weight), cap) AS target FROM levelled),
plans AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS expected FROM targets),
split AS (
  SELECT *, CAST(floor(expected + 1e-12) AS BIGINT) AS sure FROM plans),
drawn AS (
  SELECT d.doc_id, d.size, d.u, d.tie, d.turn, p.source, p.source_size, p.worded, p.target, p.sure,
         greatest(p.expected - p.sure, 0) AS inclusion, p.target - p.sure * p.source_size AS want
  FROM sized d JOIN split p ON d.source IS NOT DISTINCT FROM p.source),
ranked AS (
  SELECT *, CASE WHEN inclusion > 0 AND size > 0 THEN (u / (1 - u)) / (inclusion / (1 - inclusion) * sqrt(source_size / worded / size)) END AS rank FROM drawn),
summed AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, tie, turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM ranked),
gaps AS (
  SELECT *, want - coalesce(max(CASE WHEN upto <= want THEN upto END) OVER (PARTITION BY source), 0) AS gap FROM summed),
picked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY
              CASE WHEN inclusion > 0 AND upto > want AND abs(gap - size) < gap THEN 0 ELSE 1 END, abs(gap - size), rank, doc_id, tie, turn) AS place
  FROM gaps)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE size * (sure + CASE WHEN inclusion > 0
         AND (upto <= want OR (place = 1 AND upto > want AND abs(gap - size) < gap)) THEN 1 ELSE 0 END) END AS BIGINT) AS taken
FROM picked
"""

def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", periodic.planted_text(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic.collapse_runs(docs).withColumn("top", periodic.longest(F.col("runs")))
    listed = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.select(
        "_rest.doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "top.start",
        "top.length",
        "top.period",
        F.floor(F.col("top.length") * 1000 / F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.array_join(listed, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = bestfit.pack_best_fit(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    each = found.select("_rest.vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("white").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        "n",
        "deviation",
        "whitened",
        F.get("explained", F.col("at")).alias("explained"),
        "identity_error",
    )


QUERIES = {
    "op1_media": op1_media,
    "op2_spotsigs": op2_spotsigs,
    "op3_packing": op3_packing,
    "op4_language_id": op4_language_id,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_simhash": op6_simhash,
    "op7_mixing": op7_mixing,
    "op8_extraction": op8_extraction,
    "op9_quotation": op9_quotation,
    "op10_quality": op10_quality,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_best_fit": op12_best_fit,
    "op13_whitening": op13_whitening,
    "page_languages": page_languages,
    "quoted_replies": quoted_replies,
    "similar_documents": similar_documents,
}

ORACLE_SQL = {
    "op7_mixing": OP7_SQL,
    "op9_quotation": OP9_SQL,
    "quoted_replies": REPLIES_SQL,
}
