"""Near copies: documents whose sets of five-word shingles have a Jaccard likeness of 0.8 or more.

A bit limit on 64-bit SimHash fingerprints that holds such pairs (about 10 bits at 0.8, 16 and more
for the tail) leaves blocks of three or four bits, so all would meet all. Documents are dealt by bands of
min-hashes instead: two sets with likeness s share one of ``BANDS`` bands of ``ROWS`` with
probability 1 - (1 - s^ROWS)^BANDS, 0.9998 at 0.8. The fingerprints of a band are searched through the
hierarchical index in Gray order of ``simhash``, at ``LIMIT`` bits; of the pairs found, those that connect
a band's fingerprints, nearest first, are confirmed by the exact likeness of their sets. Bands that are
connected by then are done. What is left apart is compared exactly inside tasks, in parts of bounded
size, by counting common shingles in bit sets, so the limit loses no link; of the links found only
a forest leaves a task. A large group of near copies so costs some rows per member, and a part of a
band as many rows as it has other parts to be compared with.

Edge cases: a null, empty or blank text has the empty set, and all of these are copies of each
other; fewer than ``SHINGLE`` words form one shingle; repeated rows and texts with one set are one
node; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vouchwell.llm._shared import give_back, materialize, partitions, small_batches, whole_text
from vouchwell.llm.components import connected_components
from vouchwell.llm.simhash import GROUP_ROWS, GrayIndex, first_of, forest, gray_ranks, keep_named, majority, shingle_hashes

SHINGLE = 5
LIKENESS = 0.8
BANDS, ROWS = 16, 4
#: Differing bits up to which the index is searched: the mean at a likeness of 0.8 (9.7) and three deviations.
LIMIT = 18
#: Fingerprints of one band that one index holds; a larger band has one per range of Gray ranks.
RANGE = 8192
#: Pairs that a search may hold at once.
HELD = 1 << 20
#: Sets of usual size of one band that are compared at once with each other or with as many others;
#: of long texts, fewer.
PART = 512
_USUAL, _ANY = 500, 200  # shingles of such a set, and what a set of any size counts for
#: Shingles that are counted at once in such a comparison, a multiple of 64.
SLICE = 4096
#: Nodes up to this count are broadcast to the scan of the texts.
MAX_BROADCAST_NODES = 200_000

_RANDOM = np.random.default_rng(20250101)
_MIX = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_TIMES = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEEDS = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str) -> np.ndarray:
    return np.unique(shingle_hashes(text, SHINGLE))


def _node(found: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(found.tobytes())


def bands(found: np.ndarray) -> np.ndarray:
    """One key per band."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(found), 4096):
        mixed = (found[at : at + 4096, None] ^ _MIX) * _TIMES
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(0))
    keys = _SEEDS.copy()
    for part in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ part) * np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(32)
    return keys


def _sketches(batches):
    for batch in small_batches(batches):
        sets = [shingle_set(t.as_py()) for t in batch.column("text")]
        keys = np.concatenate([bands(s) for s in sets]) if sets else np.zeros(0, np.uint64)
        signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        ends = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("row"),
                signed([_node(s) for s in sets]),
                signed([majority(s) for s in sets]),
                pa.array([len(s) for s in sets], pa.int32()),
                pa.ListArray.from_arrays(ends, signed(keys)),
            ],
            names=["doc_id", "row", "node", "fp", "n", "bands"],
        )


def _sets(batches):
    for batch in small_batches(batches):
        sets = [shingle_set(t.as_py()) for t in batch.column("text")]
        nodes = pa.array(np.array([_node(s) for s in sets], np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([nodes, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "shingles"])


def gray_rank(fp: Column) -> Column:
    for step in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, step))
    return fp


def spanning(i: np.ndarray, j: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs (i, j) connect nodes that ``root`` doesn't, without a circle, earlier pairs
    first; and the roots then."""
    taken, at = [np.zeros(0, np.int64)], np.arange(len(i))
    while True:
        low, high = np.minimum(root[i[at]], root[j[at]]), np.maximum(root[i[at]], root[j[at]])
        at, low, high = (x[low < high] for x in (at, low, high))
        if not len(at):
            return np.concatenate(taken), root
        hung, first = np.unique(high, return_index=True)
        taken.append(at[first])
        up = np.arange(len(root))
        up[hung] = low[first]
        while (further := up[up]).tobytes() != up.tobytes():
            up = further
        root = up[root]


def near_pairs(fp: np.ndarray, n: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) that connect, nearest first, the fingerprints at most LIMIT bits apart whose sets'
    sizes allow the likeness. ``fp`` stands in Gray order within each band; ``after`` is the end of a
    row's band."""
    index, own = GrayIndex(fp), np.arange(len(fp))
    root, found = own, []
    meets = np.cumsum(after - own + index.fanout * 2 * len(index.levels))
    start = 0
    while start < len(fp):
        end = max(start + 1, int(np.searchsorted(meets, (meets[start - 1] if start else 0) + HELD, side="right")))
        i, j = index.search(fp[start:end], LIMIT, (own[start:end] + 1, after[start:end]))
        i = i + start
        may = np.minimum(n[i], n[j]) >= np.maximum(n[i], n[j]) * LIKENESS
        i, j = i[may], j[may]
        nearest = np.argsort(np.bitwise_count(fp[i] ^ fp[j]), kind="stable")
        i, j = i[nearest], j[nearest]
        taken, root = spanning(i, j, root)
        found.append((i[taken], j[taken]))
        start = end
    if not found:
        return own, own
    return tuple(np.concatenate(x) for x in zip(*found))


def _searched(rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs within the bands (or ranges of large ones) of one group, through one index of them all."""
    fp = rows["fp"].to_numpy().view(np.uint64)
    band, part = rows["band"].to_numpy(), rows["range"].to_numpy()
    order = np.lexsort((rows["node"].to_numpy(), gray_ranks(fp), part, band))
    band, part = band[order], part[order]
    ends = np.append(np.flatnonzero((band[1:] != band[:-1]) | (part[1:] != part[:-1])) + 1, len(band))
    after = np.repeat(ends, np.diff(ends, prepend=0))
    i, j = near_pairs(fp[order], rows["n"].to_numpy()[order], after)
    node = rows["node"].to_numpy()[order]
    return pd.DataFrame({"a": np.minimum(node[i], node[j]), "b": np.maximum(node[i], node[j])})


def _index_pairs(met: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of nodes that the indexes of the bands find."""
    sizes = met.groupBy("band").agg(F.count("*").alias("members"))
    large = F.broadcast(sizes.filter(F.col("members") > RANGE).select("band", F.lit(True).alias("large")))  # one in RANGE rows at most
    marked = met.join(large, "band", "left")
    order = Window.partitionBy("band").orderBy(gray_rank(F.col("fp")), "node")
    whole = marked.filter("large is null").withColumn("range", F.lit(0))
    ranged = marked.filter("large").withColumn("range", F.floor((F.row_number().over(order) - 1) / RANGE).cast("int"))
    groups = max(partitions(met.sparkSession), met.count() // GROUP_ROWS + 1)
    dealt = whole.unionByName(ranged).select(F.pmod(F.xxhash64("band", "range"), F.lit(groups)).alias("group"), "band", "range", "node", "fp", "n")
    return dealt.groupBy("group").applyInPandas(_searched, "a long, b long").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are alike."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    alike = both >= F.lit(LIKENESS) * (F.size("x") + F.size("y") - both)
    return pairs.join(left, "a").join(right, "b").filter(alike).select("a", "b")


def alike(sets: list[np.ndarray], split: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of alike sets, one below and one from ``split`` on; of all where it is 0. Only
    shingles that two sets share are counted, a slice of them at a time."""
    sizes = np.array([len(s) for s in sets])
    whose = np.repeat(np.arange(len(sets)), sizes)
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times > 1
    column = (np.cumsum(common) - 1)[place]
    held = common[place]
    whose, column = whose[held], column[held]
    order = np.argsort(column, kind="stable")
    whose, column = whose[order], column[order]
    left, right = (np.arange(split), np.arange(split, len(sets))) if split else (np.arange(len(sets)),) * 2
    both = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, int(common.sum()), SLICE):
        lo, hi = np.searchsorted(column, [at, at + SLICE])
        has = np.zeros((len(sets), SLICE), bool)
        has[whose[lo:hi], column[lo:hi] - at] = True
        bits = np.packbits(has, axis=1).view(np.uint64)
        for k in left:
            both[k] += np.bitwise_count(bits[right] & bits[k]).sum(1, dtype=np.int64)
    i, j = np.nonzero(both * (1 + 1 / LIKENESS) >= sizes[left][:, None] + sizes[right][None, :])
    i, j = left[i], right[j]
    return i[i < j], j[i < j]


def _unit_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Links within the units (a band, or two parts of a large one) of one group: a forest each."""
    found = []
    for (_, lo, hi), unit in rows.groupby(["band", "lo", "hi"], sort=False):
        unit = unit.sort_values("part", kind="stable")
        split = int((unit["part"] == lo).sum()) if lo != hi else 0
        nodes, same = unit["node"].to_numpy(), unit["root"].to_numpy()
        if split == len(unit):
            continue
        i, j = alike(list(unit["shingles"]), split)
        other = same[i] != same[j]
        root = forest(i[other], j[other], len(nodes))
        hung = np.flatnonzero(root != np.arange(len(nodes)))
        found.append(np.stack([nodes[hung], nodes[root[hung]]], axis=1))
    give_back()
    links = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    return pd.DataFrame(links, columns=["a", "b"])


def _across(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between sets of one band that hang on different roots. A band is compared in one
    task; a large one in parts of PART sets, each two of which meet in a task of their own unless all
    of both hang on one root already. No pairs leave the tasks but a forest of links."""
    by_root = Window.partitionBy("band").orderBy("root", "node").rowsBetween(Window.unboundedPreceding, 0)
    weight = F.col("n") + F.lit(_ANY)
    placed = rest.withColumn("part", F.floor((F.sum(weight).over(by_root) - weight) / (PART * _USUAL)).cast("int"))
    parts = placed.groupBy("band", "part").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    held = materialize(placed, "parts")
    other = parts.select(F.col("band").alias("_band"), F.col("part").alias("_part"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    own = held.join(parts, ["band", "part"])
    met = own.join(other, (F.col("band") == F.col("_band")) & ~((F.col("low") == F.col("high")) & (F.col("_low") == F.col("_high")) & (F.col("low") == F.col("_low"))))
    units = met.select("band", F.least("part", "_part").alias("lo"), F.greatest("part", "_part").alias("hi"), "part", "node", "root")
    large = parts.filter("part > 0").select("band").distinct().withColumn("large", F.lit(True))
    groups = (held.agg(F.sum(weight)).first()[0] or 0) // (PART * _USUAL) + 1
    key = F.when(F.col("large"), F.xxhash64("band", "lo", "hi")).otherwise(F.pmod(F.xxhash64("band"), F.lit(groups)))
    keyed = units.join(large, "band", "left").withColumn("unit", key)
    return keyed.join(sets, "node").select("unit", "band", "lo", "hi", "part", "node", "root", "shingles").groupBy("unit").applyInPandas(_unit_links, "a long, b long")


def linked(met: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, root) of every node whose component has a smaller one. ``met``: node, fp, n (its set's
    size) and band, one row for each band a node meets others by; ``sets``: node and shingles.
    Nodes of one band are linked if their sets are alike."""
    beside = materialize(_index_pairs(met), "beside")
    links = materialize(_confirmed(beside, sets), "links")
    roots = connected_components(links).select(F.col("node").alias("_node"), "root")

    rooted = met.join(roots, met["node"] == roots["_node"], "left").select("band", "node", "n", F.coalesce("root", "node").alias("root"))
    apart = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("band")
    rest = materialize(rooted.join(apart, "band"), "rest")
    return connected_components(links.unionByName(_across(rest, sets)))


def components(docs: DataFrame) -> DataFrame:
    """doc_id, row, component_id (the smallest document id reachable over links) and chosen (the id
    and row of the component's one document to keep)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.xxhash64(whole_text()).alias("row"), whole_text().alias("text"))
    sketches = materialize(texts.mapInArrow(_sketches, f"doc_id {kind}, row long, node long, fp long, n int, bands array<long>"), "sketches")
    nodes = sketches.groupBy("node").agg(F.min(first_of()).alias("text_of"))
    nodes = materialize(nodes, "nodes")
    banded = sketches.filter("n > 0").select("node", "fp", "n", F.explode("bands").alias("band")).distinct()
    shared = banded.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1").select("band")
    met = materialize(banded.join(shared, "band"), "bands")

    chosen = nodes.join(met.select("node").distinct(), "node", "left_semi").select(F.col("text_of.doc_id").alias("_id"), F.col("text_of.row").alias("_row"))
    chosen = materialize(chosen, "chosen")
    if chosen.limit(MAX_BROADCAST_NODES + 1).count() <= MAX_BROADCAST_NODES:
        chosen = F.broadcast(chosen)
    read = texts.join(chosen, (F.col("row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")
    sets = materialize(read.mapInArrow(_sets, "node long, shingles array<long>").dropDuplicates(["node"]), "sets")

    roots = linked(met, sets)
    named = nodes.join(roots, "node", "left").select("node", "text_of", F.coalesce("root", "node").alias("root"))
    names = named.groupBy("root").agg(F.min("text_of").alias("chosen"))
    by_node = materialize(named.join(names, "root").select(F.col("node").alias("_node"), "chosen"), "members")
    found = sketches.select("doc_id", "row", "node").join(by_node, F.col("node") == F.col("_node"))
    return found.select("doc_id", "row", F.col("chosen.doc_id").alias("component_id"), "chosen")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents of which each group of near copies keeps one, as in ``simhash.keep_one``."""
    return keep_named(docs, components(docs))
