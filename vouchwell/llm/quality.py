"""Quality classifier: hierarchical empirical Bayes.

A logistic model of present words and of the text's make-up (length, repetition, marks, lines) gives
each document a Bayes factor: how much its text speaks for the label.
The document's prior comes from where it stands: grouped sums of the classifier's probabilities give
rates per path, host and corpus; a host's rate is shrunk towards the corpus's and a path's towards
its host's, each by a strength that the method of moments finds in the spread of the rates, so
sparse sites stay near the global prior. Posterior odds = odds of the path's rate x Bayes factor.

The text model is fitted on a bounded sample (``SAMPLE_ROWS``) of the labelled
rows, those with the lowest hash of their id; every text is scored whole, and the rates cover all
rows.

Edge cases: a null or empty text has Bayes factor 1, so its prior decides; a null host or path is a
site of its own; repeated rows count each; without labelled rows of both classes all documents get
0.5; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchwell.llm._shared import materialize, whole_text

#: Labelled rows that the classifier is fitted on, at most.
SAMPLE_ROWS = 8000
BUCKETS = 1 << 18
#: Features whose share differs between the classes by fewer standard errors are left out, and of the
#: others all but the MAX_FEATURES that differ most.
LEAST_Z = 4.0
MAX_FEATURES = 512
RIDGE = 1.0
#: Bounds of the shrinkage strength, in rows.
STRENGTHS = (5.0, 10_000.0)
MAX_BROADCAST_SITES = 50_000

_WORD = re.compile(r"\w+|[^\w\s]+")


def shapes(words: list[str], text: str) -> list[bytes]:
    """What the text is made of, each share in tenths."""
    n, counts, lines = len(words), Counter(words), text.split("\n")
    if not n:
        return []
    size = n.bit_length()
    share = lambda test: 10 * sum(k for w, k in counts.items() if test(w)) // n
    return [
        b"\0size%d" % size,
        b"\0distinct%d:%d" % (size, 10 * len(counts) // n),
        b"\0most%d" % (10 * max(counts.values()) // n),
        b"\0marks%d" % share(lambda w: not w[0].isalnum()),
        b"\0upper%d" % share(lambda w: len(w) > 1 and w.isupper()),
        b"\0digits%d" % share(str.isdigit),
        b"\0lines%d" % (10 * len(set(lines)) // len(lines)),
        b"\0letters%d" % min(20, sum(len(w) * k for w, k in counts.items()) // n),
    ]


def features(text: str) -> np.ndarray:
    """Hash buckets of the distinct words and runs of marks, and of the text's shapes."""
    words = _WORD.findall(text)
    found = {zlib.crc32(w.lower().encode()) for w in set(words)}
    found.update(map(zlib.crc32, shapes(words, text)))
    return np.unique(np.fromiter(found, np.int64, len(found)) & (BUCKETS - 1))


def _presence_batches(batches):
    for batch in batches:
        counts: dict[int, np.ndarray] = {}
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
            held = counts.setdefault(y, np.zeros(BUCKETS, np.int32))
            held[features(text)] += 1
        for y, held in counts.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), y, np.int32)), pa.array(at.astype(np.int32)), pa.array(held[at].astype(np.int64))], names=["y", "bucket", "n"]
            )


def telling(n0: np.ndarray, n1: np.ndarray, docs0: int, docs1: int) -> np.ndarray:
    """The buckets whose presence differs most between the classes, in standard errors."""
    p0, p1 = (n0 + 0.5) / (docs0 + 1), (n1 + 0.5) / (docs1 + 1)
    pooled = (n0 + n1 + 1) / (docs0 + docs1 + 2)
    z = np.abs(p1 - p0) / np.sqrt(pooled * (1 - pooled) * (1 / docs0 + 1 / docs1))
    order = np.argsort(-z, kind="stable")[:MAX_FEATURES]
    return np.sort(order[z[order] >= LEAST_Z])


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge-penalised logistic fit by Newton steps; the last column isn't penalised."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """Weights per bucket and an offset give log odds; ``base`` is the sample's own log odds, taken
    out again to leave the Bayes factor."""

    def __init__(self, weights: np.ndarray, offset: float, base: float):
        self.weights, self.offset, self.base = weights, offset, base

    def log_bayes_factor(self, at: np.ndarray) -> float:
        return float(self.weights[at].sum()) + self.offset - self.base


def fit(docs: DataFrame, labels: DataFrame, label: str, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """The text model of one 0/1 label; None where the sample lacks one of its values."""
    usable = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).cast("int").alias("y"))
    picked = usable.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    sample = docs.join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select(whole_text().alias("text"), "y")
    sample = materialize(sample, "sample")  # sample_rows texts
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return None
    counts = np.zeros((2, BUCKETS))
    counted = sample.mapInArrow(_presence_batches, "y int, bucket int, n long").groupBy("y", "bucket").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # 2 x BUCKETS rows at most
        counts[r["y"], r["bucket"]] = r["n"]
    chosen = telling(counts[0], counts[1], sizes[0], sizes[1])
    held = sample.mapInArrow(_held(chosen), "at array<int>, y int").collect()  # sample_rows rows
    x = np.zeros((len(held), len(chosen) + 1))
    x[:, -1] = 1
    for row, r in zip(x, held):
        row[r["at"]] = 1
    w = logistic(x, np.array([r["y"] for r in held], float))
    weights = np.zeros(BUCKETS, np.float32)
    weights[chosen] = w[:-1]
    return Model(weights, float(w[-1]), float(np.log(sizes[1] / sizes[0])))


def _held(chosen: np.ndarray):
    """Places in ``chosen`` of the features that each text has."""

    def run(batches):
        for batch in batches:
            out = [np.flatnonzero(np.isin(chosen, features(t), assume_unique=True)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32())), batch.column("y")], names=["at", "y"])

    return run


def _evidence(models: dict[str, Model | None]):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            cols = {n: np.zeros(len(texts)) for n in models}
            for i, t in enumerate(texts):
                if not t.strip():
                    continue
                at = features(t)
                for n, m in models.items():
                    if m is not None:
                        cols[n][i] = m.log_bayes_factor(at)
            keep = ["doc_id", "host", "path"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(c) for c in cols.values()]], names=[*keep, *cols])

    return run


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _strength(groups: DataFrame, n: str, s: str, mean: Column) -> Column:
    """Beta strength by the method of moments: the spread of the groups' rates beyond what their
    sizes explain. One row."""
    rate = F.col(s) / F.col(n)
    spread = F.sum(F.col(n) * (rate - mean) * (rate - mean)) / F.sum(n)
    noise = F.avg(mean * (1 - mean)) * F.count("*") / F.sum(n)
    between = F.greatest(spread - noise, F.lit(1e-9))
    return F.least(F.greatest(F.avg(mean * (1 - mean)) / between - 1, F.lit(STRENGTHS[0])), F.lit(STRENGTHS[1]))


def site_rates(evidence: DataFrame, label: str, base: float) -> DataFrame:
    """Shrunk rate of the label per (host, path): columns h, p and rate_<label>."""
    p = _sigmoid(F.col(label) + F.lit(base))
    paths = materialize(
        evidence.groupBy(F.col("host").alias("h"), F.col("path").alias("p")).agg(F.count("*").cast("double").alias("n"), F.sum(p).alias("s")), "paths"
    )
    hosts = paths.groupBy(F.col("h").alias("h2")).agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    overall = paths.agg(((F.sum("s") + 0.5) / (F.sum("n") + 1)).alias("mean"))
    hosts = hosts.crossJoin(F.broadcast(overall))
    strong = hosts.agg(_strength(hosts, "hn", "hs", F.col("mean")).alias("host_rows"))
    hosts = hosts.crossJoin(F.broadcast(strong)).withColumn("host_rate", (F.col("hs") + F.col("host_rows") * F.col("mean")) / (F.col("hn") + F.col("host_rows")))
    both = materialize(paths.join(hosts, F.col("h").eqNullSafe(F.col("h2"))), "sites")
    strong = both.agg(_strength(both, "n", "s", F.col("host_rate")).alias("path_rows"))
    rate = (F.col("s") + F.col("path_rows") * F.col("host_rate")) / (F.col("n") + F.col("path_rows"))
    return both.crossJoin(F.broadcast(strong)).select("h", "p", rate.alias(f"rate_{label}"))


def classify(docs: DataFrame, labels: DataFrame, targets: tuple[str, ...] = ("quality", "toxic"), sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs``: doc_id, text, host, path. Per document: doc_id, host, path, and for each target its
    posterior <target>_score and its site's rate_<target>."""
    models = {t: fit(docs, labels, t, sample_rows) for t in targets}
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in ("doc_id", "host", "path")), *(f"{t} double" for t in targets)])
    texts = docs.select("doc_id", "host", "path", whole_text().alias("text"))
    evidence = materialize(texts.mapInArrow(_evidence(models), schema), "evidence")
    out = evidence
    for t in targets:
        rates = materialize(site_rates(evidence, t, models[t].base if models[t] else 0.0), "rates")
        if rates.limit(MAX_BROADCAST_SITES + 1).count() <= MAX_BROADCAST_SITES:
            rates = F.broadcast(rates)
        out = out.join(rates, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")), "left").drop("h", "p")
    scores = [
        (_sigmoid(_logit(F.col(f"rate_{t}")) + F.col(t)) if models[t] else F.lit(0.5)).alias(f"{t}_score") for t in targets
    ]
    return out.select("doc_id", "host", "path", *scores, *[f"rate_{t}" for t in targets])


def classify_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents stand under their source (host), in the section of their language (path)."""
    sited = docs.select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))
    scored = classify(sited, labels)
    return scored.withColumn("keep", (F.col("quality_score") >= 0.5) & (F.col("toxic_score") < 0.5))
