"""The language and quality queries against plain restatements, row by row."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from vouchwell.llm import language, quality, queries

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (9000, None, "en", "src0"),
    (9001, "", None, None),
    (9002, "  12 34 a1b2 x@y.example ", "en", "docs.example.org"),
    (9003, "die katze und der hund sind im haus", None, "seite.example.de"),
    (9003, "die katze und der hund sind im haus", None, "seite.example.de"),
    (9004, "le chat est dans la maison", "DE-at", "seite.example.de"),
    (9005, "x", "not a language", "other.example.de"),
    (None, "the house of the cat", " en_GB", "docs.example.org"),
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The smallest tables with odd rows, as a folder of their own, and the documents' rows."""
    place = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rows = [tuple(r) for r in docs.collect()] + [(*r, len(r[1] or "")) for r in ODD]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{place}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    labels.write.parquet(f"{place}/labels.parquet")
    return str(place), [r[:4] for r in rows], [r.asDict() for r in labels.collect()]


def softmax(logs):
    top = max(logs)
    raised = [math.exp(x - top) for x in logs]
    return [x / sum(raised) for x in raised]


# --- language ID ---


def letters_only(text):
    """The text without the words that hold a digit or an at sign."""
    parts = re.split(r"(\s+)", text or "")
    return "".join(" " if any(c.isdecimal() or c == "@" for c in p) else p for p in parts)


def trigrams(text):
    raw = b" " + letters_only(text).lower().encode() + b" "
    return Counter(((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> 16 for a, b, c in zip(raw, raw[1:], raw[2:]))


def plain_languages(rows):
    """Per row: language, posterior and the language by the text alone."""
    names = sorted({lang for _, text, lang, _ in rows if lang is not None and text})
    k = len(names) + 1
    models = {n: Counter() for n in names}
    for _, text, lang, _ in rows:
        if lang is not None and text:
            models[lang].update(trigrams(text))
    totals = {n: sum(m.values()) for n, m in models.items()}

    def loglik(grams):
        own = [sum(c * math.log((models[n][g] + 0.5 / 64) / (totals[n] + 0.5 * 1024)) for g, c in grams.items()) for n in names]
        return [x / 3 for x in [*own, -sum(grams.values()) * math.log(65536)]]

    start = [math.log((1 - 1e-4) / (k - 1))] * (k - 1) + [math.log(1e-4)]
    logs = [loglik(trigrams(t)) for _, t, _, _ in rows]
    alone = [softmax([a + b for a, b in zip(x, start)]) for x in logs]
    lettered = [any(c.isalpha() for c in letters_only(t)) for _, t, _, _ in rows]

    def place(source):
        found = re.search(r"\.([A-Za-z]+)$", source or "")
        return source, found and found[1]

    def code(lang):
        found = re.match(r"\s*([A-Za-z]{2,3})\b", lang or "")
        return found and found[1].lower()

    by_host, by_suffix, by_code = (defaultdict(lambda: [0.0] * k) for _ in range(3))
    overall = [0.0] * k
    for (_, _, lang, source), post, has in zip(rows, alone, lettered):
        tables = [by_host[place(source)], by_suffix[place(source)[1]]] + ([by_code[code(lang)]] if code(lang) else [])
        for i, p in enumerate(post if has else []):
            overall[i] += p
            for t in tables:
                t[i] += p
    top = [(c + 1) / (sum(overall) + k) for c in overall]
    shrunk = lambda own, up: [(c + 20 * u) / (sum(own) + 20) for c, u in zip(own, up)]
    said = [sum(c[i] for c in by_code.values()) for i in range(k)]
    out = []
    for (_, _, lang, source), x, post, has in zip(rows, logs, alone, lettered):
        prior = shrunk(by_host[place(source)], shrunk(by_suffix[place(source)[1]], top))
        declared = by_code.get(code(lang)) if code(lang) else None
        agree = [(c + 0.5) / (s + 0.5 * len(by_code)) for c, s in zip(declared, said)] if declared else [1.0] * k
        final = softmax([a + math.log(p) + math.log(g) for a, p, g in zip(x, prior, agree)])
        best = lambda p: [*names, "und"][p.index(max(p))]
        out.append((best(final), max(final), best(post)) if has else ("und", 0.0, "und"))
    return out


def test_language_query(spark, tables):
    place, rows, _ = tables
    got = queries.op4_language_id(spark, place).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(((doc, *found) for (doc, *_), found in zip(rows, plain_languages(rows))), key=key)
    got = sorted(((r.doc_id, r.language, r.posterior, r.text_language) for r in got), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert (a[0], a[1], a[3]) == (b[0], b[1], b[3])
        assert a[2] == pytest.approx(b[2], abs=1e-3)


# --- quality ---


def plain_features(text):
    words = re.findall(r"\w+|[^\w\s]+", text)
    if not words:
        return set()
    n, lines, size = len(words), text.split("\n"), len(words).bit_length()
    tenths = lambda test: 10 * sum(map(test, words)) // n
    shapes = [
        f"size{size}",
        f"distinct{size}:{10 * len(set(words)) // n}",
        f"most{10 * Counter(words).most_common(1)[0][1] // n}",
        f"marks{tenths(lambda w: not w[0].isalnum())}",
        f"upper{tenths(lambda w: len(w) > 1 and w.isupper())}",
        f"digits{tenths(str.isdigit)}",
        f"lines{10 * len(set(lines)) // len(lines)}",
        f"letters{min(20, sum(map(len, words)) // n)}",
    ]
    return {zlib.crc32(x.encode()) % quality.BUCKETS for x in [*(w.lower() for w in words), *("\0" + s for s in shapes)]}


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def plain_strength(groups):
    """``groups``: size, sum and parent's rate of each."""
    rows = sum(n for n, _, _ in groups)
    within = sum(m * (1 - m) for _, _, m in groups) / len(groups)
    spread = sum(n * (s / n - m) ** 2 for n, s, m in groups) / rows
    between = max(spread - within * len(groups) / rows, 1e-9)
    return min(max(within / between - 1, 5.0), 10_000.0)


def plain_scores(rows, factors, base):
    """Per row: posterior and rate of its site."""
    paths, hosts = defaultdict(lambda: [0, 0.0]), defaultdict(lambda: [0, 0.0])
    for (_, _, lang, source), x in zip(rows, factors):
        for held in (paths[source, lang], hosts[source]):
            held[0] += 1
            held[1] += sigmoid(x + base)
    mean = (sum(s for _, s in hosts.values()) + 0.5) / (len(rows) + 1)
    host_rows = plain_strength([(n, s, mean) for n, s in hosts.values()])
    host_rate = {h: (s + host_rows * mean) / (n + host_rows) for h, (n, s) in hosts.items()}
    path_rows = plain_strength([(n, s, host_rate[h]) for (h, _), (n, s) in paths.items()])
    rate = {k: (s + path_rows * host_rate[k[0]]) / (n + path_rows) for k, (n, s) in paths.items()}
    own = [rate[source, lang] for _, _, lang, source in rows]
    return [(sigmoid(math.log(r / (1 - r)) + x), r) for r, x in zip(own, factors)]


def labelled(rows, labels, name):
    """Features and label of the rows that the text model is fitted on."""
    said = {r["doc_id"]: r[name] for r in labels if r[name] in (0, 1)}
    return [(plain_features(t or ""), said[d]) for d, t, _, _ in rows if d in said]


@pytest.mark.parametrize("name", ["quality", "toxic"])
def test_quality_query(spark, tables, name):
    place, rows, labels = tables
    docs = spark.read.parquet(f"{place}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{place}/labels.parquet"), name)
    sample = labelled(rows, labels, name)

    # the fit: it holds the features that tell the classes apart, and its penalised slope is zero
    ones = sum(y for _, y in sample)
    size = (len(sample) - ones, ones)
    counts = [Counter(f for x, y in sample if y == c for f in x) for c in (0, 1)]
    z = {}
    for f in set(counts[0]) | set(counts[1]):
        p = [(counts[c][f] + 0.5) / (size[c] + 1) for c in (0, 1)]
        pooled = (counts[0][f] + counts[1][f] + 1) / (len(sample) + 2)
        z[f] = abs(p[1] - p[0]) / math.sqrt(pooled * (1 - pooled) * (1 / size[0] + 1 / size[1]))
    telling = sorted(f for f in z if z[f] >= 4)
    assert 0 < len(telling) <= quality.MAX_FEATURES
    assert set(np.flatnonzero(model.weights)) <= set(telling)
    assert model.base == pytest.approx(math.log(ones / size[0]))
    weight = dict(zip(telling, map(float, model.weights[telling])))
    off = [y - sigmoid(model.offset + sum(weight.get(f, 0) for f in x)) for x, y in sample]
    for f in telling:
        assert sum(o for (x, _), o in zip(sample, off) if f in x) - weight[f] == pytest.approx(0, abs=1e-2)
    assert sum(off) - 1e-3 * model.offset == pytest.approx(0, abs=1e-2)

    # the fusion, row by row
    factors = [sum(weight.get(f, 0) for f in plain_features(t)) + model.offset - model.base if (t or "").strip() else 0.0 for _, t, _, _ in rows]
    want = plain_scores(rows, factors, model.base)
    key = lambda r: (r[0] is None, r[0] or 0)
    want = sorted(((doc, *w) for (doc, *_), w in zip(rows, want)), key=key)
    got = sorted(((r.doc_id, r[f"{name}_score"], r[f"rate_{name}"]) for r in queries.op10_quality(spark, place).collect()), key=key)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-4)
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-4)
