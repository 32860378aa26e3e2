"""The operators against plain restatements of what they compute, on small corpora."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from vouchwell.llm import bwt, media, mixing, packing, queries, simhash, spotsigs, substrings

DATA = "/root/testdata/sf0.001"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def texts(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}


# --- media ---


def test_media_payloads(spark):
    got = {r.doc_id: r for r in queries.op1_media(spark, DATA).collect()}
    want = texts(spark)
    assert got.keys() == want.keys()
    for doc, text in want.items():
        raw = text.encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        r = got[doc]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-16:])
        stored = media.encode_png(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r.feature == media.feature(payload)


@given(st.binary(min_size=1, max_size=2000))
def test_png_round_trip(raw):
    payload = raw + b" " * (-len(raw) % media.WIDTH)
    assert media.decode_png(media.encode_png(payload)) == payload


def test_damaged_png_raises():
    stored = bytearray(media.encode_png(b"x" * media.WIDTH))
    stored[45] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.decode_png(bytes(stored))


def test_interleaved_sequence(spark):
    digest = hashlib.sha256(b"a").hexdigest()
    html = f'<p>Before</p><figure><img src="sha256:{digest}" alt="alt"><figcaption>The <b>caption</b></figcaption></figure><p>After<img src="/b.png" alt="b"> it'
    page = spark.createDataFrame([(1, html), (2, html), (3, "")], "page_id long, html string")
    stored = spark.createDataFrame([(digest, 7)], "digest string, size int")
    got = {r.id: r["items"] for r in media.resolve(media.parse_sequences(page, "page_id"), stored).collect()}
    assert got[3] == []
    assert got[1] == got[2]
    assert [(i.pos, i.kind, i.text or i.ref, i.caption, i.media and i.media.size) for i in got[1]] == [
        (0, "text", "Before", None, None),
        (1, "media", f"sha256:{digest}", "The caption", 7),
        (2, "text", "After", None, None),
        (3, "media", "/b.png", "b", None),
        (4, "text", "it", None, None),
    ]


# --- spotsigs ---


def plain_signatures(text):
    words = re.findall(r"\w+", text.lower())
    found = set()
    for i, w in enumerate(words):
        if w in spotsigs.ANCHORS:
            chain = [x for x in words[i + 1 :] if x not in spotsigs.ANCHORS][: spotsigs.CHAIN]
            if len(chain) == spotsigs.CHAIN:
                found.add(" ".join([w, *chain]))
    return {xxhash.xxh32_intdigest(x) for x in found or {" ".join(words)}}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_spotsigs_query(spark):
    rows = {d: t[:3000] for d, t in texts(spark).items()}
    rows |= {1000: "", 1001: "x", 1002: rows[3], 1003: None}
    docs = documents(spark, [(d, t, "a") for d, t in rows.items()])
    got = {r.doc_id: r for r in spotsigs.compare_neighbours(docs).collect()}
    ids = sorted(rows, reverse=True)
    assert sorted(got, reverse=True) == ids
    for doc, after in zip(ids, [*ids[1:], ids[0]]):
        own, other = rows[doc] or "", rows[after] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + other[:half]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = plain_signatures(own), plain_signatures(edited), plain_signatures(other)
        assert r.fingerprint == "".join(f"{x:08x}" for x in sorted(a))
        assert r.edited_fingerprint == "".join(f"{x:08x}" for x in sorted(b))
        assert r.near_edited == pytest.approx(jaccard(a, b))
        assert r.near_next == pytest.approx(jaccard(a, c))


def linked_sets(sets):
    """Each document's least reachable one over links at 0.8 or more."""
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and jaccard(sets[a], sets[b]) >= 0.8:
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return {d: top(d) for d in sets}


def signature_texts():
    """Texts of chains, near ones, and a crowd around one text, all of which share signatures."""
    rng = np.random.default_rng(11)
    texts = {}
    for n in (1, 3, 5, 9, 10, 30, 90, 91):
        chain = [f"the a{i}x{n} b{i}" for i in range(n)]
        for off in (0, 1, 2, n // 5, n // 4 + 1):
            texts[len(texts)] = " ".join(chain[off:] + [f"the y{len(texts)} z" for _ in range(off // 2)])
    for _ in range(60):
        own = [f"the c{i} d{i}" for i in range(40)]
        for i in rng.choice(40, 4, replace=False):
            own[i] = f"the q{rng.integers(10**6)} d{i}"
        texts[len(texts)] = " ".join(own)
    return texts | {900: "", 901: None, 902: texts[60], 903: "one two", 904: "One, two"}


@pytest.mark.parametrize("part", [512, 5])
def test_similar_sets_lose_no_link(spark, monkeypatch, part):
    monkeypatch.setattr(spotsigs.near_copies, "PART", part)
    rows = signature_texts()
    sets = {d: plain_signatures(t or "") for d, t in rows.items()}
    docs = documents(spark, [(d, t, "a") for d, t in rows.items()]).repartition(4)
    got = {r.doc_id: r for r in spotsigs.similar_sets(docs).collect()}
    want = linked_sets(sets)
    assert len(set(want.values())) < len({frozenset(s) for s in sets.values()}) < len(rows)
    for d in rows:
        assert got[d].n_signatures == len(sets[d])
        assert got[d].class_id == min(x for x in sets if sets[x] == sets[d])
        assert got[d].component_id == want[d], d


def test_similar_documents_query(spark):
    sets = {d: plain_signatures(t) for d, t in texts(spark).items()}
    got = {r.doc_id: r.component_id for r in queries.similar_documents(spark, DATA).collect()}
    assert got == linked_sets(sets)


def test_lengths_that_may_be_alike_are_beside_each_other():
    starts = spotsigs._partition_starts(0.8)
    for n in range(1, 3000):
        top = int(n / 0.8 + 1e-9)
        assert np.searchsorted(starts, top, "right") - np.searchsorted(starts, n, "right") <= 1


# --- packing ---


def test_packing_is_a_partition_of_all_ids(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for d, t in texts(spark).items()}
    pieces = queries.op3_packing(spark, DATA).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = want[p.doc_id][p.start : p.start + p.length]
        assert p.doc_tokens == len(want[p.doc_id]) and len(ids) == p.length > 0
        assert p.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        by_doc[p.doc_id].append((p.start, p.length))
        by_seq[p.sequence_id].append((p.offset, p.length))
    for spans, total in [*((by_doc[d], len(x)) for d, x in want.items()), *((s, None) for s in by_seq.values())]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == total or (total is None and at <= 2048)
    sizes = sorted(sum(n for _, n in s) for s in by_seq.values())
    assert sizes[1:] == [2048] * (len(sizes) - 1)
    assert sorted(by_seq) == list(range(len(by_seq)))


def test_word_cache_equals_the_tokenizer(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer, coder = Tokenizer.from_file(path), packing.WordIds(path)
    odd = ["", " ", "a\x1cb", "a\x85b\xa0c d　e", "﻿x ​ y", "don't  stop\n\n", "\U0001f600́ ẞß", "a\tb\x0bc\x0cd\re", "İ ı \x00 \x7f"]
    odd += ["\x01", "a \x01 b", "x<|endoftext|>y z", "a\u2003b\u200bc", " \u0301e", "ΣΑΣ Σ"]
    odd += ["A<|ENDOFTEXT|>b <|EndOfText|>", "İ. I. é. É, e\u0301. x.y..z,.'s it's. o'.s A,B ß. ÿ,\u0301 1.5, Ü.", "word." * 50]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, coder.dtype).tobytes() for t in odd]
    assert coder.by_word and coder.encode(odd) == want


def test_tokenizers_that_join_words_get_whole_texts():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    tokenizer, coder = Tokenizer.from_file(path), packing.WordIds(path)
    texts = ["one two  three", "", " x\n\ny"]
    assert not coder.by_word
    assert coder.encode(texts) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, coder.dtype).tobytes() for t in texts]


@settings(deadline=None, max_examples=200)
@given(st.one_of(st.text(max_size=80), st.text("aEé.,' s_-{[~$\u0301İß1\t\u2003<|", max_size=60)))
def test_word_cache_on_any_text(text):
    path = queries.tokenizer_path()
    coder = _coder(path)
    want = np.array(coder.tokenizer.encode(text, add_special_tokens=False).ids, coder.dtype).tobytes()
    assert coder.encode([text]) == [want]


_coders = {}


def _coder(path):
    if path not in _coders:
        _coders[path] = packing.WordIds(path)
    return _coders[path]


def test_assembled_sequences(spark):
    docs = documents(spark, [(1, "one two three " * 2000, "a"), (2, None, "a"), (3, "last", "a")])
    pieces = packing.pack_documents(docs, queries.tokenizer_path(), window=512)
    rows = packing.assemble_sequences(pieces, window=512).collect()
    assert all(len(r.ids) == 4 * r.n for r in rows)
    assert all(r.padding in (0, 512 - r.n) and (r.n + r.padding) & (r.n + r.padding - 1) == 0 for r in rows)


# --- suffix dedup ---


def plain_removed(raws, length):
    places = defaultdict(list)
    for d, raw in enumerate(raws):
        for i in range(len(raw) - length + 1):
            places[raw[i : i + length]].append((d, i))
    covered = [np.zeros(len(raw), bool) for raw in raws]
    for found in places.values():
        if len(found) > 1:
            for d, i in found:
                covered[d][i : i + length] = True
    return covered


def cut_facts(raw, covered):
    edges = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    kept = np.frombuffer(raw, np.uint8)[~covered].tobytes()
    return len(raw), int(covered.sum()), int((edges == 1).sum()), kept


def test_suffix_dedup_query(spark):
    want = texts(spark)
    ids = sorted(want)
    raws = [want[d].encode() for d in ids]
    facts = {d: cut_facts(raw, c) for d, raw, c in zip(ids, raws, plain_removed(raws, 200))}
    got = {r.doc_id: r for r in queries.op5_suffix_dedup(spark, DATA).collect()}
    assert got.keys() == facts.keys()
    for d, (n, removed, spans, kept) in facts.items():
        r = got[d]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("group_bytes", [1 << 20, 300])
def test_suffix_dedup_levels(spark, monkeypatch, group_bytes):
    """Also with so small a group bound that crowded keys go through every level."""
    monkeypatch.setattr(substrings, "GROUP_BYTES", group_bytes)
    rng = np.random.default_rng(5)
    letters = lambda n, k=4: "".join(rng.choice(list("abcdéf 日"[:k]), n))
    passage, other = letters(60), letters(45)
    rows = [letters(200)[:k] + passage + letters(int(rng.integers(1, 90))) for k in range(0, 40)]
    rows += [letters(30) + other + letters(20) + other, "a" * 400, "ab" * 150, "a" * 39, "", None, rows[0], rows[1][3:], letters(300, 8)]
    docs = documents(spark, [(i, t, "a") for i, t in enumerate(rows)])
    raws = [(t or "").encode() for t in rows]
    facts = [cut_facts(raw, c) for raw, c in zip(raws, plain_removed(raws, 40))]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.cut_repeats(docs, 40).collect()}
    assert got == dict(enumerate(facts))


@settings(deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.text("ab\x00", max_size=40), max_size=8), st.integers(1, 9))
def test_interval_expansion(spans, length):
    raws = [s.encode() for s in spans if len(s) >= length]
    starts = np.array([len(r) - length + 1 for r in raws], np.int64)
    count = Counter(r[i : i + length] for r, n in zip(raws, starts) for i in range(n))
    want = [[i for i in range(n) if count[r[i : i + length]] > 1] for r, n in zip(raws, starts)]
    assert [x.tolist() for x in bwt.repeated_starts(raws, starts, length)] == want


# --- simhash ---


def plain_simhash(text):
    lower = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, limit):
    ids = sorted(prints)
    root = {d: d for d in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= limit:
                ra, rb = sorted((top(a), top(b)))
                root[rb] = ra
    return {d: top(d) for d in ids}


def test_simhash_query(spark):
    prints = {d: plain_simhash(t) for d, t in texts(spark).items()}
    want = plain_components(prints, 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op6_simhash(spark, DATA).collect()}
    assert got == {d: (f"{p:016x}", want[d]) for d, p in prints.items()}


@pytest.mark.parametrize("crowd", [20_000, 3])
def test_near_links_of_planted_patterns(spark, monkeypatch, crowd):
    """Chains of patterns two bits apart, bits near block edges, and crowds of one block value."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = np.random.default_rng(3)
    found = set()
    for base in rng.integers(0, 1 << 63, 25, dtype=np.uint64).tolist() + [0, (1 << 64) - 1]:
        x = base
        for _ in range(6):
            found.add(x)
            for b in rng.integers(0, 64, int(rng.integers(1, 4))).tolist():
                x ^= 1 << b
    prefix = 0x123456 << 42
    found |= {prefix | int(x) for x in rng.integers(0, 1 << 42, 40)}
    prints = {i: p for i, p in enumerate(sorted(found))}
    want = plain_components(prints, 2)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    links = simhash.near_links(spark.createDataFrame([(signed(p),) for p in prints.values()], "fp long"), 2).collect()
    at = {signed(p): i for i, p in prints.items()}
    root = {i: i for i in prints}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        ra, rb = sorted((top(at[r.a]), top(at[r.b])))
        root[rb] = ra
    assert {i: top(i) for i in prints} == want


@settings(deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1), min_size=1, max_size=60), st.integers(0, 6))
def test_gray_index_finds_all(patterns, limit):
    x = np.array(patterns, np.uint64)
    q, e = simhash.GrayIndex(x).search(x, limit)
    want = {(i, j) for i, a in enumerate(patterns) for j, b in enumerate(patterns) if (a ^ b).bit_count() <= limit}
    assert set(zip(q.tolist(), e.tolist())) == want


# --- mixing ---


@pytest.mark.parametrize("rows", ["table", "odd"])
def test_mixing_equals_its_sql(spark, rows):
    con = duckdb.connect()
    if rows == "table":
        docs = spark.read.parquet(f"{DATA}/documents.parquet")
    else:
        docs = documents(spark, [(i, "w " * (i % 7) if i % 5 else None, [None, "", "b", "ä", "big"][i % 5 if i % 3 else 4]) for i in range(300)])
    con.register("documents", docs.toPandas())
    names = ["doc_id", "size", "source_size", "target", "taken"]
    want = con.sql(queries.OP7_SQL).df()[names].sort_values("doc_id").values.tolist()
    m = mixing.mix(docs)
    got = m.selectExpr("doc_id", "_size", "_source_size", "_target", "_copies * _size").toPandas().sort_values("doc_id").values.tolist()
    assert np.allclose(np.array(got, float), np.array(want, float), rtol=1e-12)
    by_source = defaultdict(float)
    sources = {r.doc_id: r.source for r in docs.collect()}
    for d, size, _, target, taken in got:
        assert taken in (0, size, 2 * size)
        by_source[sources[d], target] += taken
    largest = max(size for _, size, *_ in got)
    assert all(abs(taken - target) <= largest for (_, target), taken in by_source.items())


def test_mix_documents_repeats_rows(spark):
    docs = documents(spark, [(i, "w " * (i % 7), "ab"[i % 2]) for i in range(100)])
    taken = {r.doc_id: r._copies for r in mixing.mix(docs).collect() if r._copies}
    assert Counter(r.doc_id for r in mixing.mix_documents(docs).collect()) == taken


def plain_targets(sizes, share, most, weights):
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [None] * (None in sizes)
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    target, full = {}, set()
    while True:
        rest = share * sum(sizes.values()) - sum(most * sizes[n] for n in full)
        open_weight = sum(weight[n] for n in names if n not in full)
        target = {n: most * sizes[n] if n in full else rest * weight[n] / open_weight for n in names}
        over = {n for n in names if target[n] > most * sizes[n]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("share", [1.5, 0.01, 1.99])
def test_targets_of_many_sources(spark, share):
    """Sizes from nothing to a third of all words, in more ranges than one."""
    rng = np.random.default_rng(3)
    sizes = {f"s{i}" if i % 3 else f"\u00e9{i}\U0001f600": int(x) for i, x in enumerate(rng.pareto(0.7, 3000) * 20)}
    sizes |= {None: 40, "": 7, "hot": sum(sizes.values()) // 2, "\uff5e": 0}
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long").repartition(5)
    got = {r.source: r.target for r in mixing.source_targets(rows, share).collect()}
    want = plain_targets(sizes, share, 2.0, mixing.WEIGHTS)
    assert got.keys() == want.keys()
    assert all(got[n] == pytest.approx(want[n], rel=1e-9, abs=1e-9) for n in want)


def test_targets_that_no_level_reaches(spark):
    rows = spark.createDataFrame([("a", 10), ("b", 4), (None, 0)], "source string, size long")
    assert {r.source: r.target for r in mixing.source_targets(rows, 2.5).collect()} == {"a": 20.0, "b": 8.0, None: 0.0}
    assert mixing.source_targets(rows.filter("false")).count() == 0
    assert [r.target for r in mixing.source_targets(rows.filter("size = 0")).collect()] == [0.0]
