"""Language identification by Bayesian evidence fusion.

Three kinds of evidence multiply: the text's likelihood under byte-trigram models of the languages
and of a background that stands for all others; the declared markup language, weighed by how often
the corpus's declarations agree with its texts; and the prior of the host, smoothed towards its
address suffix and that towards the whole corpus. Host, suffix and declaration counts are grouped
sums of text posteriors, so a hot host is pre-aggregated in every task.

Every label that any row has is a language. Its trigram model is fitted on a bounded sample
(``SAMPLE_ROWS`` of its own rows, those with the lowest hash of their id), so a rare language has
all its rows in it; scoring reads every text whole, and the counts cover all rows.

Edge cases: a null, empty or letterless text has no language (``und``) and is rejected; null host,
suffix or declaration add no evidence beyond the level above; repeated rows are scored each; empty
tables give no row; without any labelled row all is ``und``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vouchwell.llm._shared import materialize, packed, small_batches, unpacked, whole_text

UNKNOWN = "und"
#: Labelled rows of each language that its text model is fitted on, at most. Spark cuts to such a
#: rank in each task up to spark.sql.optimizer.windowGroupLimitThreshold, 1,000 unless set.
SAMPLE_ROWS = 1000
BUCKETS = 1 << 16
#: Trigrams overlap: three of them are worth about one independent observation.
EVIDENCE_SCALE = 1 / 3
SMOOTHING = 0.5
#: Rows that a parent level's shares count for in a host's or suffix's prior.
PRIOR_ROWS = 20.0
UNKNOWN_PRIOR = 1e-4
#: Hosts up to this count are broadcast with their priors.
MAX_BROADCAST_HOSTS = 50_000
#: Trigrams times models that are looked up at once.
SLAB_CELLS = 1 << 20


def trigram_buckets(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.uint32)
    gram = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    return (gram * np.uint32(2654435761)) >> np.uint32(16)


# numbers, addresses and keys belong to no language
_CODE = re.compile(r"[\d@]")
_CODE_WORD = re.compile(r"(?<!\S)\S*[\d@]\S*")
_LETTER = re.compile(r"[^\W\d_]")


def prose(text: str) -> str:
    """The text without the words that hold digits or an at sign."""
    return _CODE_WORD.sub(" ", text) if _CODE.search(text) else text


def _bytes(text: str) -> bytes:
    return b" " + text.lower().encode() + b" "


def _count_batches(batches):
    for batch in batches:
        counts: dict[str, np.ndarray] = {}
        for text, lang in zip(batch.column("text"), batch.column("label")):
            raw = np.frombuffer(_bytes(prose(text.as_py())), np.uint8)
            held = counts.setdefault(lang.as_py(), np.zeros(BUCKETS, np.int64))
            held += np.bincount(trigram_buckets(raw), minlength=BUCKETS)
        for lang, held in counts.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(held[at])],
                names=["label", "bucket", "n"],
            )


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages, and the log likelihood of each trigram bucket under each and under the background
    (last column). ``labelled``: doc_id, text, label."""
    usable = labelled.filter("label is not null and text is not null and length(text) > 0")
    slim = usable.select(F.col("label").alias("_label"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"), F.xxhash64("doc_id").alias("_h"))
    along = Window.partitionBy("_label").orderBy("_h", "_id", "_text")
    ids = slim.withColumn("_n", F.row_number().over(along)).filter(F.col("_n") <= sample_rows).select("_label", "_id", "_text").distinct()
    same = (F.col("label") == F.col("_label")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_text"))
    sample = usable.join(F.broadcast(materialize(ids, "sample")), same, "left_semi")  # sample_rows a language
    counted = sample.select("text", "label").mapInArrow(_count_batches, "label string, bucket int, n long")
    rows = counted.groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()  # languages x buckets at most
    coded = rows.column("label").combine_chunks().dictionary_encode()
    found = coded.dictionary.to_pylist()
    names = sorted(found)
    counts = np.zeros((BUCKETS, len(names)))
    if names:
        place = np.array([names.index(x) for x in found])
        counts[rows.column("bucket").to_numpy(), place[coded.indices.to_numpy()]] = rows.column("n").to_numpy()
    likely = (counts + SMOOTHING / 64) / (counts.sum(0) + SMOOTHING / 64 * BUCKETS)
    background = np.full((BUCKETS, 1), 1 / BUCKETS)
    return names, np.log(np.concatenate([likely, background], axis=1)).astype(np.float32)


def _score(table: np.ndarray):
    slab = SLAB_CELLS // table.shape[1] + 1

    def run(batches):
        for batch in small_batches(batches):
            texts = [prose(t) for t in batch.column("text").to_pylist()]
            out = np.zeros((len(texts), table.shape[1]))
            at, lettered = 0, [_LETTER.search(t) is not None for t in texts]
            while at < len(texts):
                end, parts, size = at, [], 0
                while end < len(texts) and (end == at or size < slab):
                    parts.append(_bytes(texts[end]))
                    size += len(parts[-1])
                    end += 1
                ends = np.cumsum([len(p) for p in parts])
                grams = trigram_buckets(np.frombuffer(b"".join(parts) + b"  ", np.uint8))
                within = np.ones(len(grams), bool)
                within[ends - 1] = within[ends - 2] = False  # trigrams across two texts
                starts = np.append(0, ends[:-1])
                for low in range(0, len(grams), slab):
                    rows = table[grams[low : low + slab]]
                    rows[~within[low : low + slab]] = 0
                    first, last = np.searchsorted(ends, [low, low + len(rows) - 1], "right")
                    cuts = np.maximum(starts[first : last + 1] - low, 0)
                    out[at + first : at + last + 1] += np.add.reduceat(rows, cuts, axis=0, dtype=np.float64)
                at = end
            flat = pa.array(out.ravel())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_evidence"),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * table.shape[1]), flat),
                    pa.array(lettered),
                ],
                names=["_evidence", "loglik", "lettered"],
            )

    return run


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def _added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _log_shares(counts: list[Column], parent: Column | None = None) -> Column:
    """Log of the counts' shares; with a parent's shares, smoothed by PRIOR_ROWS rows of them."""
    total = sum(counts[1:], counts[0])
    if parent is None:
        return F.array(*[F.log((c + 1.0) / (total + float(len(counts)))) for c in counts])
    return F.array(*[F.log((c + PRIOR_ROWS * F.exp(parent[i])) / (total + PRIOR_ROWS)) for i, c in enumerate(counts)])


def identify(evidence: DataFrame, labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``evidence``: text, declared, host, suffix and any id columns. Returns all columns but text,
    and language, posterior, text_language (from the text alone) and kept."""
    names, table = fit(labelled, sample_rows)
    k = len(names) + 1
    rest = [c for c in evidence.columns if c != "text"]
    kinds = {f.name: f.dataType.simpleString() for f in evidence.schema}
    struct = "struct<" + ", ".join(f"`{c}`: {kinds[c]}" for c in rest) + ">"
    scored = evidence.select(whole_text().alias("text"), F.struct(*rest).alias("_evidence")).mapInArrow(
        _score(table), f"_evidence {struct}, loglik array<double>, lettered boolean"
    )
    logs = F.transform(F.col("loglik"), lambda x: x * EVIDENCE_SCALE)
    start = F.array(*[F.lit(float(x)) for x in [np.log((1 - UNKNOWN_PRIOR) / max(1, k - 1))] * (k - 1) + [np.log(UNKNOWN_PRIOR)]])
    code = F.lower(F.regexp_extract(F.col("_evidence.declared"), r"^\s*([A-Za-z]{2,3})\b", 1))
    rows = materialize(
        scored.select("_evidence", "lettered", logs.alias("logs"), F.nullif(code, F.lit("")).alias("code")).withColumn(
            "post", _softmax(_added(F.col("logs"), start))
        ),
        "evidence",
    )
    sums = [F.sum(F.when(F.col("lettered"), F.col("post")[i])).alias(f"n{i}") for i in range(k)]
    zeros = [F.coalesce(F.col(f"n{i}"), F.lit(0.0)) for i in range(k)]
    hosts = rows.groupBy(F.col("_evidence.host").alias("h"), F.col("_evidence.suffix").alias("s")).agg(*sums)
    hosts = materialize(hosts, "hosts")
    suffixes = hosts.groupBy(F.col("s").alias("s2")).agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(k)])
    everywhere = hosts.agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(k)]).select(_log_shares(zeros).alias("top"))
    by_suffix = suffixes.crossJoin(F.broadcast(everywhere)).select("s2", _log_shares(zeros, F.col("top")).alias("mid"))
    priors = materialize(
        hosts.join(by_suffix, F.col("s").eqNullSafe(F.col("s2"))).select("h", "s", _log_shares(zeros, F.col("mid")).alias("prior")),
        "priors",
    )
    # two or three letters: some 18,000 codes at most
    declared = rows.filter("code is not null").groupBy(F.col("code").alias("c")).agg(*sums)
    said = declared.agg(*[F.sum(f"n{i}").alias(f"t{i}") for i in range(k)], F.count("*").alias("codes"))
    agree = declared.crossJoin(F.broadcast(said)).select(
        "c",
        F.array(*[F.log((z + SMOOTHING) / (F.coalesce(F.col(f"t{i}"), F.lit(0.0)) + SMOOTHING * F.col("codes"))) for i, z in enumerate(zeros)]).alias("agree"),
    )
    agree = materialize(agree, "declared")
    if priors.limit(MAX_BROADCAST_HOSTS + 1).count() <= MAX_BROADCAST_HOSTS:
        priors = F.broadcast(priors)
    fused = rows.join(
        priors, F.col("_evidence.host").eqNullSafe(F.col("h")) & F.col("_evidence.suffix").eqNullSafe(F.col("s")), "left"
    ).join(F.broadcast(agree), F.col("code") == F.col("c"), "left")
    none = F.array(*[F.lit(0.0)] * k)
    logpost = _added(_added(F.col("logs"), F.col("prior")), F.coalesce(F.col("agree"), none))
    labels = F.array(*[F.lit(x) for x in [*names, UNKNOWN]])
    best = lambda c: F.element_at(labels, F.array_position(c, F.array_max(c)).cast("int"))
    language = F.when(F.col("lettered"), best(F.col("final"))).otherwise(F.lit(UNKNOWN))
    return (
        fused.withColumn("final", _softmax(logpost))
        .select(
            "_evidence.*",
            language.alias("language"),
            F.when(F.col("lettered"), F.array_max("final")).otherwise(F.lit(0.0)).alias("posterior"),
            F.when(F.col("lettered"), best(F.col("post"))).otherwise(F.lit(UNKNOWN)).alias("text_language"),
        )
        .withColumn("kept", F.col("language") != UNKNOWN)
    )


def document_evidence(docs: DataFrame) -> DataFrame:
    """Documents carry their declared language in ``lang`` and their address in ``source``."""
    suffix = F.nullif(F.regexp_extract(F.col("source"), r"\.([A-Za-z]+)$", 1), F.lit(""))
    return docs.select(
        "doc_id", F.xxhash64(whole_text()).alias("row"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"), suffix.alias("suffix")
    )


def page_evidence(pages: DataFrame) -> DataFrame:
    """Web pages: the html element's lang, the URL's host and its last label, the text of the tags."""
    host = F.lower(F.try_parse_url(F.col("url"), F.lit("HOST")))
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")
    said = F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1)
    return pages.select(
        "page_id",
        text.alias("text"),
        F.nullif(said, F.lit("")).alias("declared"),
        host.alias("host"),
        F.nullif(F.regexp_extract(host, r"([^.]+)$", 1), F.lit("")).alias("suffix"),
    )


def labelled_documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.col("lang").alias("label"))


def identify_documents(docs: DataFrame) -> DataFrame:
    return identify(document_evidence(docs), labelled_documents(docs))


#: Rejected documents up to this count are broadcast to the filter.
MAX_BROADCAST_REJECTS = 100_000


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents that have a language."""
    out = identify_documents(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"))
    out = materialize(out.distinct(), "rejected")
    if out.limit(MAX_BROADCAST_REJECTS + 1).count() <= MAX_BROADCAST_REJECTS:
        out = F.broadcast(out)
    slim = packed(docs, "doc_id", "text")
    same = slim["doc_id"].eqNullSafe(out["_id"]) & (F.xxhash64(whole_text()) == out["_row"])
    return slim.join(out, same, "left_anti").select(*unpacked(docs, "doc_id", "text"))
