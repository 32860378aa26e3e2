"""Periodic runs of words, by power-of-two naming (Karp, Miller and Rosenberg).

A run is a stretch of words with smallest period ``q`` and a length of at least ``max(6, 4 q)`` that
no neighbouring word extends. Stretches of 1, 2, 4, ... words get names, equal ones the same: a name
of one level is given to a pair of names of the level below, by sorting pairs of numbers. How far two
places agree, forwards or backwards, is read off by going down the levels. For each period a grid of
places is laid so that every run holds one at which a whole named stretch agrees with the one a period
on; only those are extended. Nothing is hashed to be compared and no suffixes are sorted.

Words are named together with their document, so many documents share one pass of NumPy and no match
crosses them. Places whose name is shared by no other drop out of the next level, and periods end
where no stretch of the needed length is shared, so texts without repeats cost a few passes.

Edge cases: a null or empty text, or one of white space, has no words and no runs, and collapses to
the empty text; repeated rows are judged each; a null ``doc_id`` is a row like others; texts of any
length are judged whole; an empty table gives no row; columns other than text are kept in ``_rest``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchwell.llm._shared import WORD, small_batches, whole_text

SHORTEST = 6
EXPONENT = 4
#: Names are made for stretches of up to 2**16 words; beyond it the top level is walked step by step.
TOP = 16
#: Text that is named at a time; a longer text is named alone.
SLAB_BYTES = 1 << 20

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _shared_names(key: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """A name per place: equal numbers for equal keys, a negative number of its own where no other
    place has the key or the place isn't among those given. One more stands for the end."""
    names = -1 - np.arange(n + 1, dtype=np.int32)
    order = np.argsort(key, kind="stable")
    key, place = key[order], place[order]
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    alone = new & np.append(new[1:], True)[: len(key)]
    names[place[~alone]] = (np.cumsum(new) - 1)[~alone]
    return names


def name_levels(codes: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """Names of stretches of 1, 2, 4, ... words, up to the last level at which any are shared."""
    n = len(codes)
    key = doc.astype(np.int64) * (int(codes.max(initial=0)) + 1) + codes
    levels = [_shared_names(key, np.arange(n), n)]
    while len(levels) <= TOP:
        step, below = 1 << len(levels) - 1, levels[-1]
        place = np.flatnonzero((below[: max(0, n - step)] >= 0) & (below[step:n] >= 0))
        if not len(place):
            break
        above = _shared_names(below[place].astype(np.int64) * n + below[place + step], place, n)
        if above.max() < 0:
            break
        levels.append(above)
    return levels


def agreement(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words agree from places ``i`` and ``j`` (i < j) on, or before them."""
    reach = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        names, step = levels[k], 1 << k
        at = np.arange(len(i))
        while len(at):
            if back:
                at = at[i[at] - reach[at] >= step]
                shift = -reach[at] - step
            else:
                shift = reach[at]
            at = at[names[i[at] + shift] == names[j[at] + shift]]
            reach[at] += step
            if k < len(levels) - 1:
                break  # below the top level a second step would have been one of the level above
    return reach


def find_runs(codes: np.ndarray, sizes: np.ndarray, shortest: int = SHORTEST, exponent: int = EXPONENT):
    """Runs of documents that lie side by side in ``codes`` with ``sizes`` words each: arrays of
    start, stop and period, by start and then period."""
    n = len(codes)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, none
    levels = name_levels(codes, np.repeat(np.arange(len(sizes)), sizes))
    covered = np.zeros(n + 1, np.int64)  # the period of a run found at a place, and its end
    until = np.zeros(n + 1, np.int64)
    found: dict[tuple[int, int], int] = {}
    for q in range(1, int(sizes.max()) // exponent + 1):
        same = max(shortest, exponent * q) - q  # so many places in a row agree with those q on
        level = min((same // 2 or 1).bit_length() - 1, TOP)
        if level >= len(levels):
            break
        names, grid = levels[level], same - (1 << level) + 1
        later = names[q:n:grid]
        i = np.flatnonzero((names[: n - q : grid] == later) & (later >= 0)) * grid
        if not len(i):
            continue
        known = covered[i]
        i = i[(known == 0) | (q % np.maximum(known, 1) != 0) | (i + q >= until[i])]
        if not len(i):
            continue
        start = i - agreement(levels, i, i + q, back=True)
        stop = i + q + agreement(levels, i, i + q)
        for s, e in set(zip(start.tolist(), stop.tolist())):
            if e - s >= max(shortest, exponent * q) and (s, e) not in found:
                found[s, e] = q  # a stretch found again has a multiple of its smallest period
                covered[s:e], until[s:e] = q, e
    if not found:
        return none, none, none
    runs = np.array([(s, e, q) for (s, e), q in found.items()])
    return tuple(runs[np.lexsort((runs[:, 2], runs[:, 0]))].T)


def _slabs(sizes: np.ndarray):
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + SLAB_BYTES, side="right")))
        yield at, end
        at = end


def _collapse(texts: pa.Array, shortest: int, exponent: int):
    """n_words, runs and collapsed text of each text."""
    trimmed = pc.ascii_trim_whitespace(texts)
    words = pc.ascii_split_whitespace(trimmed)
    blank = np.asarray(pc.equal(pc.binary_length(trimmed), 0))
    flat = words.flatten()
    sizes = np.asarray(pc.list_value_length(words), np.int64)
    if blank.any():
        flat = flat.filter(pa.array(np.repeat(~blank, sizes)))
        sizes = np.where(blank, 0, sizes)
    codes = np.asarray(flat.dictionary_encode().indices, np.int64)
    start, stop, period = find_runs(codes, sizes, shortest, exponent)
    ends = np.cumsum(sizes)
    doc = np.searchsorted(ends, start, side="right")
    depth = np.zeros(len(codes) + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, stop, -1)
    kept = np.cumsum(depth)[: len(codes)] == 0
    left = np.append(0, np.cumsum(kept))[np.append(0, ends)]
    lists = pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), flat.filter(pa.array(kept)))
    fields = [pa.array(x) for x in (start - (ends - sizes)[doc], stop - start, period)]
    spans = np.searchsorted(doc, np.arange(len(sizes) + 1)).astype(np.int32)
    runs = pa.ListArray.from_arrays(pa.array(spans), pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))
    return pa.array(sizes), runs, pc.binary_join(lists, " ")


def _batches(shortest: int, exponent: int):
    def run(batches):
        for batch in small_batches(batches):
            texts = batch.column("text")
            for at, end in _slabs(np.asarray(pc.binary_length(texts), np.int64)):
                found = _collapse(texts.slice(at, end - at), shortest, exponent)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_rest").slice(at, end - at), *found], names=["_rest", "n_words", "runs", "collapsed"]
                )

    return run


def collapse_runs(docs: DataFrame, shortest: int = SHORTEST, exponent: int = EXPONENT) -> DataFrame:
    """_rest (the columns other than text), n_words, runs (start, length and period in words, by start
    and then period) and collapsed: the words, joined by single spaces, without those that a run holds
    after its first period."""
    rest = F.struct(F.lit(True).alias("_any"), *[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    shaped = docs.select(whole_text().alias("text"), rest.alias("_rest"))
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in shaped.schema["_rest"].dataType)
    return shaped.mapInArrow(_batches(shortest, exponent), f"_rest struct<{fields}>, n_words long, runs {RUNS}, collapsed string")


def planted_text(doc_id: Column, text: Column) -> Column:
    """The text with a repetition planted in one document of ten: with h the checksum of the id's
    decimal form and g = h / 10, where h ends in 0 each word from word g % n on is that of a place in
    the first period, of 1 + (n - a) / (3 + g % 8) words. A null id plants nothing."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % F.greatest(n, F.lit(1))).cast("int")
        p = (F.floor((n - a) / (g % 8 + 3)) + 1).cast("int")
        ahead = F.transform(F.sequence(F.lit(0), n - a - 1), lambda i: F.get(words, a + i % p))
        return F.when(n > 0, F.concat_ws(" ", F.slice(words, 1, a), ahead)).otherwise("")

    found = F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), repeated)[0]
    return F.when((h % 10 == 0) & text.isNotNull(), found).otherwise(text)


def longest(runs: Column) -> Column:
    """The run of greatest length; of several the first, and of those that start together the one
    with the shortest period. Null where there is none."""
    keyed = F.transform(runs, lambda r: F.struct((-r["length"]).alias("shortness"), r["start"], r["period"], r["length"]))
    return F.array_min(keyed)
