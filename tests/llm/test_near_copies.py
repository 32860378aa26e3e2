"""The pipeline's near-copy stage against all pairs."""

import random
from itertools import combinations

import corpus_pipeline
import pytest

from vouchwell.llm import near_copies


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(texts):
    sets = {d: plain_set(t) for d, t in texts.items()}
    root = {d: d for d in texts}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if x == y or len(x & y) >= 0.8 * len(x | y):
            low, high = sorted((top(a), top(b)))
            root[high] = low
    return {top(d) for d in texts}


def planted(groups):
    """Texts of 200 words, each with copies in which 1 to 5 words apart are others: likeness 0.95,
    0.90, 0.86, 0.81 and 0.77 to the text."""
    rng = random.Random(5)
    texts = {}
    for _ in range(groups):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts[len(texts)] = " ".join(words)
        k = rng.randint(1, 5)
        for i in rng.sample(range(10, 190, 20), k):
            words[i] = f"x{rng.randrange(5000)}"
        texts[len(texts)] = " ".join(words).upper() if k == 2 else " ".join(words)
    return texts


@pytest.mark.parametrize(("crowd", "part"), [(0, 512), (60, 512), (60, 7)])
def test_stage_keeps_one_of_near_copies(spark, monkeypatch, crowd, part):
    monkeypatch.setattr(near_copies, "PART", part)  # parts that one band has several of
    texts = planted(60)
    rng = random.Random(6)
    base = [f"c{i}" for i in range(200)]
    for _ in range(crowd):  # one group; most of them are alike to some only
        words = list(base)
        for i in rng.sample(range(10, 190, 10), 3):
            words[i] = f"y{rng.randrange(5000)}"
        texts[len(texts)] = " ".join(words)
    texts |= {900: "a b c", 901: "A  b C", 902: "a b d", 903: "", 904: " ", 905: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(got) == sorted(plain_kept(texts))


def test_ranges_of_a_large_band_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "RANGE", 7)
    rng = random.Random(7)
    texts = {}
    for d in range(60):
        words = [f"c{i}" for i in range(200)]
        for i in rng.sample(range(10, 190, 10), 3):
            words[i] = f"y{rng.randrange(5000)}"
        texts[d] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(got) == sorted(plain_kept(texts))


def test_likeness_is_of_sets():
    assert len(near_copies.shingle_set("a b c d e " * 20)) == 5


def test_alike_is_exact():
    import numpy as np

    rng = random.Random(8)
    base = list(range(0, 3000, 10))
    sets = [np.array(sorted(rng.sample(base, rng.randint(200, 300)) + rng.sample(range(100_000, 200_000), rng.randint(0, 40))), np.uint64) for _ in range(60)]
    want = {(i, j) for i, j in combinations(range(60), 2) if 5 * len(set(sets[i]) & set(sets[j])) >= 4 * len(set(sets[i]) | set(sets[j]))}
    assert want and set(zip(*(x.tolist() for x in near_copies.alike(sets, 0)))) == want
    assert set(zip(*(x.tolist() for x in near_copies.alike(sets, 25)))) == {(i, j) for i, j in want if i < 25 <= j}


@pytest.mark.parametrize("held", [1 << 20, 40])
def test_index_connects_what_lies_within_the_limit(monkeypatch, held):
    import numpy as np

    from vouchwell.llm.simhash import forest, gray_ranks

    monkeypatch.setattr(near_copies, "HELD", held)
    rng = np.random.default_rng(9)
    bands = []
    for size in [1, 2, 2, 3, 9, 70, 200, 1, 8]:
        seeds = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
        fp = seeds[rng.integers(0, 4, size)]
        for _ in range(8):
            fp = fp ^ (np.uint64(1) << rng.integers(0, 64, size).astype(np.uint64))
        bands.append(fp[np.argsort(gray_ranks(fp))])
    ends = np.cumsum([len(b) for b in bands])
    fp, after, n = np.concatenate(bands), np.repeat(ends, [len(b) for b in bands]), rng.integers(80, 120, ends[-1])
    i, j = near_copies.near_pairs(fp, n, after)
    near = [
        (a, b)
        for a in range(len(fp))
        for b in range(a + 1, after[a])
        if (fp[a] ^ fp[b]).bit_count() <= near_copies.LIMIT and min(n[a], n[b]) >= 0.8 * max(n[a], n[b])
    ]
    assert set(zip(i.tolist(), j.tolist())) <= set(near) and len(i) < len(fp)
    a, b = (np.array(x) for x in zip(*near))
    assert (forest(i, j, len(fp)) == forest(a, b, len(fp))).all()


def test_index_links_what_is_apart_in_gray_order(spark, monkeypatch):
    """Alike sets whose fingerprints differ in the leading bit, with unlike ones between them; what
    compares the rest is left out."""
    monkeypatch.setattr(near_copies, "_across", lambda rest, sets: rest.select(rest["node"].alias("a"), rest["node"].alias("b")).limit(0))
    rng = random.Random(10)
    rows, own = [], []
    for k in range(12):
        fp = rng.getrandbits(63)
        for m in range(2):
            rows.append((100 * m + k, fp - (m << 63), 20, 1))
            own.append((100 * m + k, [1000 * k + x for x in range(19 + m)]))
    met = spark.createDataFrame(rows, "node long, fp long, n int, band long")
    sets = spark.createDataFrame(own, "node long, shingles array<long>")
    got = {(r.node, r.root) for r in near_copies.linked(met, sets).collect()}
    assert got == {(100 + k, k) for k in range(12)}
