"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are sorted by Gray rank, so neighbours in the order share long bit patterns. Nodes of a
few neighbours each factor the bits that all their members share, level upon level. A search adds up
differing bits from the top down and leaves a whole group of patterns as soon as the sum passes the
limit. Equal fingerprints are one entry, so a group of copies of any size costs one row; a search
reports links as a local spanning forest, never as all pairs of a group; components come from star
steps over these links. Patterns meet in a task by a block of equal bits, so each is sent a fixed
number of times, whatever the size of the corpus.

Edge cases: a null, empty or blank text has fingerprint zero and is linked like any other; fewer
than ``shingle`` words form one shingle; repeated rows share their component; a null ``doc_id`` is
reported but never a component's name unless it has no other; an empty table gives no row.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchwell.llm._shared import materialize, packed, partitions, unpacked, whole_text
from vouchwell.llm.components import connected_components

#: Patterns of one group, about.
GROUP_ROWS = 50_000
#: Patterns with one block value above which they are split further.
CROWD = 20_000
FANOUT = 8


def shingle_hashes(text: str, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """One hash per shingle, in the text's order."""
    import xxhash

    words = text.encode().lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=-1))[1:]
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(flat, seed)], np.uint64)
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    return np.fromiter((digest(flat[s:e], seed) for s, e in zip(starts, ends[shingle - 1 :])), np.uint64, n)


def majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 8192):
        ones += np.unpackbits(h[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def simhash(text: str, shingle: int = 3, seed: int = 42) -> int:
    return majority(shingle_hashes(text, shingle, seed))


def _fingerprint_batches(shingle: int, seed: int):
    def run(batches):
        for batch in batches:
            found = [simhash(t.as_py(), shingle, seed) for t in batch.column("text")]
            fp = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), fp], names=["doc_id", "row", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, row (the text's hash) and fp, the fingerprint's 64 bits as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.xxhash64(whole_text()).alias("row"), whole_text().alias("text"))
    return texts.mapInArrow(_fingerprint_batches(shingle, seed), f"doc_id {kind}, row long, fp long")


def hex_bits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


class GrayIndex:
    """Patterns (with the mask of their fixed bits) in Gray order, under nodes of shared bits.

    Level 0 holds the entries; each upper node covers ``fanout`` neighbours and holds the bits that
    all of them share. A level keeps only the bits that its parents have not compared yet.
    """

    def __init__(self, patterns: np.ndarray, masks: np.ndarray | None = None, fanout: int = FANOUT):
        pattern = patterns.astype(np.uint64)
        mask = np.full(len(pattern), ~np.uint64(0)) if masks is None else masks.astype(np.uint64)
        self.fanout, self.levels = fanout, []
        while len(pattern) > fanout:
            at = np.arange(0, len(pattern), fanout)
            same = np.bitwise_and.reduceat(mask, at)
            differ = np.bitwise_or.reduceat(pattern ^ np.repeat(pattern[at], np.diff(np.append(at, len(pattern)))), at)
            up_mask = same & ~differ
            self.levels.append((pattern, mask & ~np.repeat(up_mask, fanout)[: len(mask)]))
            pattern, mask = pattern[at] & up_mask, up_mask
        self.levels.append((pattern, mask))

    def search(self, queries: np.ndarray, limit: int, within: tuple[np.ndarray, np.ndarray] | None = None):
        """Index pairs (query, entry) that differ in at most ``limit`` of the entry's fixed bits.
        ``within``: each query's first entry and the one after its last; by default it meets all."""
        width = self.fanout ** (len(self.levels) - 1)  # entries under a node
        pattern, mask = self.levels[-1]
        q = np.repeat(np.arange(len(queries)), len(pattern))
        node = np.tile(np.arange(len(pattern)), len(queries))
        q, node = _meeting(q, node, width, within)
        spent = np.bitwise_count((queries[q] ^ pattern[node]) & mask[node])
        near = spent <= limit
        q, node, spent = q[near], node[near], spent[near]
        for pattern, mask in reversed(self.levels[:-1]):
            width //= self.fanout
            child = (node[:, None] * self.fanout + np.arange(self.fanout)).ravel()
            q, spent = np.repeat(q, self.fanout), np.repeat(spent, self.fanout)
            inside = child < len(pattern)
            q, child, spent = _meeting(q[inside], child[inside], width, within, spent[inside])
            spent = spent + np.bitwise_count((queries[q] ^ pattern[child]) & mask[child])
            near = spent <= limit
            q, node, spent = q[near], child[near], spent[near]
        return q, node


def _meeting(q: np.ndarray, node: np.ndarray, width: int, within, *more: np.ndarray):
    """The (query, node) pairs whose node covers entries that the query meets."""
    if within is None:
        return q, node, *more
    first, after = within
    kept = (node * width < after[q]) & ((node + 1) * width > first[q])
    return q[kept], node[kept], *(m[kept] for m in more)


def gray_ranks(patterns: np.ndarray) -> np.ndarray:
    rank = patterns.copy()
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(step)
    return rank


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of ``n`` nodes reaches through the links (a, b)."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        low = np.minimum(ra, rb)
        new = root.copy()
        np.minimum.at(new, ra, low)
        np.minimum.at(new, rb, low)
        while (jumped := new[new]).tobytes() != new.tobytes():
            new = jumped
        if (new == root).all():
            return root
        root = new


def _cuts(n: int, parts: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each of ``parts`` blocks of ``n`` bits."""
    at = [n * i // parts for i in range(parts + 1)]
    return [(lo, hi - lo) for lo, hi in zip(at, at[1:])]


def _bits(fp: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def _turned(fp: Column, by: int) -> Column:
    """The bits turned right by ``by``."""
    return F.shiftrightunsigned(fp, by).bitwiseOR(F.shiftleft(fp, 64 - by)) if by else fp


def _links(limit: int, chunk: int = 1024):
    """Links within one group of patterns that were turned alike: a search for each among all."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        fp = rows["fp"].to_numpy().view(np.uint64)
        turned = rows["turned"].to_numpy().view(np.uint64)
        order = np.argsort(gray_ranks(turned), kind="stable")
        fp, turned = fp[order], turned[order]
        index = GrayIndex(turned)
        root = np.arange(len(fp))
        for at in range(0, len(fp), chunk):
            q, e = index.search(turned[at : at + chunk], limit)
            apart = q + at < e  # a pair once
            if apart.any():
                a, b = q[apart] + at, e[apart]
                root = forest(root[a], root[b], len(fp))[root]
        hung = root != np.arange(len(fp))
        return pd.DataFrame({"a": fp[hung].view(np.int64), "b": fp[root[hung]].view(np.int64)})

    return run


def near_links(distinct: DataFrame, limit: int = 2) -> DataFrame:
    """Edges (a, b) that connect all entries of ``distinct`` (column fp, no repeats) at most
    ``limit`` bits apart.

    Two such patterns agree on one of limit + 1 blocks of their bits, so each pattern goes to one
    group per block, turned so that the block's bits lead: in Gray order, patterns with the same
    block are neighbours. A block value that more than CROWD patterns have is split by a block of
    the remaining bits, on one of which its near patterns agree again.
    """
    spark = distinct.sparkSession
    blocks = _cuts(64, limit + 1)
    part = lambda i, low, width: F.struct(
        F.lit(i).alias("block"), _bits(F.col("fp"), low, width).alias("value"), _turned(F.col("fp"), (low + width) % 64).alias("turned")
    )
    dealt = distinct.select("fp", F.explode(F.array(*[part(i, *c) for i, c in enumerate(blocks)])).alias("p")).select("fp", "p.*")
    crowds = dealt.groupBy("block", "value").count().filter(F.col("count") > CROWD).select(F.col("block").alias("_b"), F.col("value").alias("_v"))
    crowds = materialize(crowds, "crowds")
    if crowds.limit(1).count():
        rest = 64 - blocks[0][1] - 1  # bits below the leading block, whose width may be one more
        sub = F.array(*[F.struct(F.lit(j).alias("j"), _bits(F.col("turned"), low, width).alias("w")) for j, (low, width) in enumerate(_cuts(rest, limit + 1))])
        whole = F.array(F.struct(F.lit(-1).alias("j"), F.lit(0).cast("long").alias("w")))
        marked = dealt.join(crowds, (F.col("block") == F.col("_b")) & (F.col("value") == F.col("_v")), "left")
        dealt = marked.withColumn("s", F.explode(F.when(F.col("_b").isNull(), whole).otherwise(sub)))
        key = F.xxhash64("block", "value", "s.j", "s.w")
    else:
        key = F.xxhash64("block", "value")
    groups = max(partitions(spark), distinct.count() // GROUP_ROWS + 1)
    grouped = dealt.select("fp", "turned", (F.pmod(key, F.lit(groups)) * len(blocks) + F.col("block")).alias("group"))
    return grouped.groupBy("group").applyInPandas(_links(limit), "a long, b long")


def components(docs: DataFrame, limit: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, row, fp, component_id (the smallest document id reachable over links) and chosen (the
    id and row of the component's one document to keep)."""
    prints = materialize(fingerprints(docs, shingle, seed), "simhash")
    least = materialize(prints.groupBy("fp").agg(F.min(first_of()).alias("least")), "classes")
    roots = connected_components(near_links(least.select("fp"), limit))
    grouped = least.join(roots, least["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    names = grouped.groupBy("root").agg(F.min("least").alias("chosen"))
    by_fp = materialize(grouped.join(names, "root").select(F.col("fp").alias("_fp"), "chosen"), "members")
    return prints.join(by_fp, prints["fp"] == by_fp["_fp"]).select("doc_id", "row", "fp", F.col("chosen.doc_id").alias("component_id"), "chosen")


def first_of() -> Column:
    """What orders a component's documents: those with an id first, by id, then by text."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")


#: Kept documents up to this count (16 bytes each) are broadcast to the scan of the texts.
MAX_BROADCAST_KEPT = 1_000_000


def keep_named(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The document that each component of ``found`` (doc_id, row, chosen) keeps: the one with the
    smallest id, or where none has an id, that with the least hash of its text. Rows that repeat it
    go."""
    one = (F.col("row") == F.col("chosen.row")) & F.col("doc_id").eqNullSafe(F.col("chosen.doc_id"))
    kept = materialize(found.filter(one).groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).count(), "kept")
    bounded = lambda t: F.broadcast(t) if t.limit(MAX_BROADCAST_KEPT + 1).count() <= MAX_BROADCAST_KEPT else t
    slim = packed(docs, "doc_id", "text").withColumn("_text", F.xxhash64(whole_text()))
    same = lambda t: slim["doc_id"].eqNullSafe(t["_id"]) & (slim["_text"] == t["_row"])
    once, more = (bounded(kept.filter(f"count {op} 1")) for op in ("=", ">"))
    out = slim.join(once, same(once), "left_semi")
    if more.limit(1).count():  # only rows that repeat are shuffled
        out = out.unionByName(slim.join(more, same(more), "left_semi").dropDuplicates(["doc_id", "_text"]))
    return out.select(*unpacked(docs, "doc_id", "text"))


def keep_one(docs: DataFrame, limit: int = 2) -> DataFrame:
    """The documents of which each component keeps one, as ``keep_named`` does."""
    return keep_named(docs, components(docs, limit))
