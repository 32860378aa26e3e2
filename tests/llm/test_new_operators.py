"""Periodic runs, best-fit packing and whitening against plain restatements of what they compute."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vouchwell.llm import bestfit, periodic, queries, whitening

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- periodic runs ---


def plain_runs(words):
    """All runs, each period tried at each place."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def found_runs(texts):
    codes, sizes, names = [], [], {}
    for words in texts:
        codes += [names.setdefault(w, len(names)) for w in words]
        sizes.append(len(words))
    start, stop, period = periodic.find_runs(np.array(codes, np.int64), np.array(sizes, np.int64))
    ends = np.cumsum(sizes)
    out = [[] for _ in texts]
    for s, e, q in zip(start.tolist(), stop.tolist(), period.tolist()):
        doc = int(np.searchsorted(ends, s, side="right"))
        begin = int(ends[doc] - sizes[doc])
        out[doc].append((s - begin, e - s, q))
    return out


pieces = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=7), st.integers(1, 9), st.integers(0, 6)), max_size=5)


@settings(max_examples=400, deadline=None)
@given(st.lists(pieces, min_size=1, max_size=4))
def test_runs_of_random_texts(docs):
    texts = [[w for base, times, extra in doc for w in (base * times + base[:extra])] for doc in docs]
    assert found_runs(texts) == [plain_runs(t) for t in texts]


@pytest.mark.parametrize("words", [["a"] * 5, ["a"] * 6, ["a"] * 300, ["a", "b"] * 500, ["a", "b", "a"] * 40 + ["a"] * 9, list("abaababaabaab" * 8)])
def test_runs_of_periodic_words(words):
    assert found_runs([words, ["x"], words]) == [plain_runs(words), [], plain_runs(words)]


def test_long_texts_of_one_word_are_one_run():
    n = 1_000_000
    start, stop, period = periodic.find_runs(np.zeros(n, np.int64), np.array([n]))
    assert (start.tolist(), stop.tolist(), period.tolist()) == ([0], [n], [1])


def test_names_above_the_top_level(monkeypatch):
    monkeypatch.setattr(periodic, "TOP", 2)
    words = list("abcde" * 60) + list("xyz" * 30)
    assert found_runs([words]) == [plain_runs(words)]


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_op11(spark):
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, DATA).collect()}
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    some = 0
    for doc, text in rows:
        words = planted(doc, text)
        runs = plain_runs(words) if len(words) < 3000 else found_runs([words])[0]
        r, some = got[doc], some + bool(runs)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *top)
        assert r.exponent_milli == (top[1] and 1000 * top[1] // top[2])
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert r.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapse(words, runs).encode()).hexdigest()
    assert some > len(rows) / 20


def test_odd_texts_collapse(spark):
    rows = [(1, None, "x"), (1, "", "x"), (None, " \t\n\v\f\r ", None), (2, "\va\x1cb  c\n", "x"), (3, "no no no no no no no", "x"), (3, "no no no no no no no", "x"), (4, "ä ö " * 4 + "é è", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumn("collapsed", F.lit(1))
    got = sorted((r._rest.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.collapse_runs(docs).collect())
    assert got == [
        (0, 0, [], ""),
        (1, 0, [], ""),
        (1, 0, [], ""),
        (2, 2, [], "a\x1cb c"),
        (3, 7, [(0, 7, 1)], "no"),
        (3, 7, [(0, 7, 1)], "no"),
        (4, 9, [(0, 8, 2)], "ä ö é è"),
    ]
    assert periodic.collapse_runs(docs.limit(0)).collect() == []
    ids = spark.createDataFrame([(None, "a b c"), (1, None)], "doc_id long, text string")
    assert {r.t for r in ids.select(periodic.planted_text(F.col("doc_id"), F.col("text")).alias("t")).collect()} == {"a b c", None}


# --- best-fit packing ---


def plain_best_fit(lengths, window):
    """Each length, in falling order, into the fullest sequence that takes it."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(window - n)
    return len(room)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 64))
def test_plan_is_best_fit(lengths, window):
    counts = {n: lengths.count(n) for n in set(lengths)}
    plans, total = bestfit.plan(counts, window)
    assert total == plain_best_fit(lengths, window)
    used = {}
    for n, count in counts.items():
        segments = plans[n]
        assert segments[0].first == 0 and [s.first for s in segments] == sorted({s.first for s in segments})
        for rank in range(count):
            s = [s for s in segments if s.first <= rank][-1]
            row, place = divmod(rank - s.first, s.each)
            used.setdefault(s.sequence + row, []).append((s.offset + place * n, n))
    assert sorted(used) == list(range(total))
    for places in used.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= window


def test_plan_stays_small_for_any_counts():
    rng = np.random.default_rng(1)
    counts = {n: int(rng.integers(1, 10**9)) for n in range(1, 2049)}
    plans, total = bestfit.plan(counts, 2048)
    assert sum(map(len, plans.values())) < 4 * 11 * 2048
    assert total < 1.02 * sum(n * c for n, c in counts.items()) / 2048


def check_pieces(rows, texts, window, coder):
    """Every id once, in pieces that fill sequences without gaps; the number of sequences."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by_doc.keys() == texts.keys()
    for doc, parts in by_doc.items():
        parts.sort()
        ids = coder.encode(texts[doc] or "", add_special_tokens=False).ids + [0]
        assert [p[0] for p in parts] == list(range(-(-len(ids) // window)))
        assert [p[1] for p in parts] == [window * i for i in range(len(parts))]
        assert b"".join(p[3] for p in parts) == np.array(ids, "<u4").tobytes()
        assert all(4 * p[2] == len(p[3]) for p in parts)
    for places in by_seq.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= window
    return len(by_seq), [n for places in by_seq.values() for _, n in places]


@pytest.mark.parametrize("broadcast", [True, False])
def test_best_fit_packing(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(bestfit, "MAX_BROADCAST_GROUPS", 0)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").repartition(5)
    rows = bestfit.pack_best_fit(docs, queries.tokenizer_path(), window=256).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    n, lengths = check_pieces(rows, texts, 256, Tokenizer.from_file(queries.tokenizer_path()))
    assert n == plain_best_fit(lengths, 256)


def test_op12(spark):
    got = queries.op12_best_fit(spark, DATA).collect()
    whole = bestfit.pack_best_fit(spark.read.parquet(f"{DATA}/documents.parquet"), queries.tokenizer_path()).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in got) == sorted((r.doc_id, r.piece, zlib.crc32(r.ids)) for r in whole)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    n, lengths = check_pieces(whole, texts, 2048, Tokenizer.from_file(queries.tokenizer_path()))
    assert n == plain_best_fit(lengths, 2048)


def test_odd_rows_pack_best(spark):
    rows = [(1, None, 0), (1, "", 0), (None, "one two", 0), (2, "three " * 5000, 0), (2, "three " * 5000, 0)]
    docs = spark.createDataFrame(rows, "doc_id smallint, text string, pid int").withColumn("length", F.lit("z"))
    got = bestfit.pack_best_fit(docs, queries.tokenizer_path())
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length) for r in got.collect()) == sorted(
        [(0, 0, 0, 3), (1, 0, 0, 1), (1, 0, 0, 1)] + 2 * [(2, 0, 0, 2048), (2, 1, 2048, 2048), (2, 2, 4096, 905)]
    )
    assert bestfit.assemble_sequences(got).agg(F.sum("n")).first()[0] == 5 + 2 * 5001
    assert bestfit.pack_best_fit(docs.limit(0), queries.tokenizer_path()).collect() == []


# --- whitening ---


def plain_whitening(vectors, k):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    cov = centred.T @ centred / n
    values, parts = np.linalg.eigh(cov)
    values, parts = values[::-1][:k], parts[:, ::-1][:, :k]
    return centred @ parts / np.sqrt(values), values / np.trace(cov), [sum(int(n * int(a) - int(s)) ** 2 for a, s in zip(r, sums)) for r in x]


def test_op13(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    found = queries.op13_whitening(spark, DATA)
    assert dict(found.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    got = {}
    for r in found.collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    white, explained, deviation = plain_whitening([r.embedding for r in rows], 32)
    assert len(got) == len(rows)
    mine = np.array([[got[r.vec_id][c].whitened for c in range(1, 33)] for r in rows])
    signs = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine - white * signs).max() < 1e-9
    for r, d in zip(rows, deviation):
        one = got[r.vec_id]
        assert {(x.n, x.deviation) for x in one.values()} == {(len(rows), d)}
        assert [one[c].explained for c in range(1, 33)] == pytest.approx(explained, rel=1e-9)
    errors = {x.identity_error for one in got.values() for x in one.values()}
    assert len(errors) == 1 and errors.pop() < 1e-9


@pytest.mark.parametrize("width", [3, 60, 400])
def test_eigenpairs_of_wide_and_narrow_matrices(width):
    rng = np.random.default_rng(width)
    basis = np.linalg.qr(rng.standard_normal((width, width)))[0]
    want = np.sort(np.append(np.repeat([9.0, 5.0], 1 + width // 50), np.exp(-np.arange(width - 2 * (1 + width // 50)) / 20)))[::-1]
    matrix = basis @ np.diag(want) @ basis.T
    wanted = min(width, 10)
    values, vectors, sure, steps = whitening.lobpcg(lambda b: matrix @ b, width, wanted)
    assert values == pytest.approx(want[:wanted], rel=1e-11)
    assert np.abs(vectors.T @ vectors - np.eye(wanted)).max() < 1e-13
    assert np.linalg.norm(matrix @ vectors - vectors * values, axis=0).max() < 1e-11
    assert sure <= 2e-13


def test_odd_vectors(spark):
    rng = np.random.default_rng(5)
    good = rng.standard_normal((30, 4)).tolist()
    bad = [None, [1.0, None, 2.0, 3.0], [1.0, float("nan"), 2.0, 3.0], [float("inf"), 0.0, 0.0, 0.0], [], [1.0, 2.0]]
    rows = [(i, v, "z") for i, v in enumerate([*good, good[0], *bad])] + [(None, good[1], None)]
    data = spark.createDataFrame(rows, "vec_id long, vec array<double>, white string").withColumn("x", F.lit(1))
    found, model = whitening.whiten(data, "vec", components=9)
    got = found.collect()
    assert model.n == 32 and len(got) == 32 and {len(r.white) for r in got} == {4}
    white, _, deviation = plain_whitening([*good, good[0], good[1]], 4)
    assert sorted(r.deviation for r in got) == sorted(deviation)
    mine = np.array([r.white for r in sorted(got, key=lambda r: 99 if r._rest.vec_id is None else r._rest.vec_id)])
    assert np.abs(np.abs(mine) - np.abs(white)).max() < 1e-9


@pytest.mark.parametrize("rows", [[], [None, None], [[1.0, 2.0]], [[1.0, 2.0]] * 9])
def test_no_variance_gives_no_components(spark, rows):
    data = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")
    found, model = whitening.whiten(data)
    assert found.collect() == [] and model.vectors.shape[1] == 0


def test_components_without_variance_are_left_out(spark):
    rng = np.random.default_rng(2)
    flat = rng.standard_normal((50, 2)) @ rng.integers(-9, 9, (2, 6))
    vectors = (np.floor(flat * 4) / 4).round(2)
    vectors[:, 5] = vectors[:, 4]
    data = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")
    found, model = whitening.whiten(data)
    assert model.vectors.shape[1] == 5
    assert found.first().identity_error < 1e-9


# --- rows told apart ---


def test_ranges_of_clashing_hashes(spark, monkeypatch):
    """With keys of few bits for one half, the other half still tells rows apart."""
    from vouchwell.llm import substrings

    plain = substrings._row_keys
    monkeypatch.setattr(substrings, "_row_keys", lambda: [F.lit(1).cast("long").alias("row"), plain()[1]])
    rng = np.random.default_rng(9)
    a, b = ("".join(map(chr, rng.integers(97, 123, 256))) for _ in range(2))
    rows = [(None, a + a[:250]), (None, b)]
    got = {r.n_bytes: r.n_removed for r in substrings.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {506: 500, 256: 0}
