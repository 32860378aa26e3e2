"""Suffix-array deduplication of repeated byte strings, by threshold-bounded interval expansion.

Equal strings of the minimum length must meet in one task. Each such window is keyed by the least
hash of the ``k``-byte grams in it, which depends on its bytes alone; consecutive windows that have
their key from the same (the last least) gram form a run, and runs are what is shuffled: keys only, no text. Runs of a key that occurs
once are done. Equal runs are pre-aggregated: where all runs of a key are equal, they are repeats
as a whole. The distinct runs of the remaining keys are gathered in blocks of bounded size, and a
breadth-first expansion on each block's Burrows-Wheeler transform finds the windows that repeat.
A key with more distinct runs than a block holds (a short passage that very many documents share)
is keyed anew with longer grams, down to the window itself, at which equal keys are equal windows.

Edge cases: null and empty texts, and texts shorter than the minimum, lose nothing; repeated rows
are copies of each other and lose all their windows; rows with one ``doc_id``, or none, are
documents of their own where their texts differ;
an empty table gives no row; extra columns are ignored by ``cut_repeats`` and kept by
``remove_repeats``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchwell.llm._shared import give_back, materialize, packed, small_batches, unpacked, whole_text
from vouchwell.llm.bwt import repeated_starts

LENGTH = 200
#: Text that a block of distinct runs holds, about, and the most that one key may bring to it.
BLOCK_BYTES = 1 << 20
GROUP_BYTES = 1 << 20
#: Text whose windows are hashed at a time.
SLAB_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xD6E8FEB86659FD93)


def gram_sizes(length: int) -> tuple[int, ...]:
    """Gram lengths of the levels: about a third of the window, two more, and the window itself."""
    return tuple(dict.fromkeys(max(1, round(length * x)) for x in (0.32, 0.68, 0.92, 1)))


class _Powers:
    """Powers of the hash's base and of its inverse, modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int):
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (
                np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, np.uint64(b))]))
                for b in (_BASE, pow(_BASE, -1, 1 << 64))
            )
        return self.up[:n], self.down[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def window_runs(raw: bytes, ends: np.ndarray, gram: int, length: int, powers: _Powers):
    """Runs of windows with the same last least gram, in texts that lie side by side in ``raw`` and
    end at ``ends``: first start, last start, key and content hash of each run."""
    n = len(raw)
    if n < length:
        return (np.zeros(0, np.int64),) * 4
    up, down = powers.get(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = _mixed((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    w = length - gram + 1
    pad = -len(h) % w
    blocks = np.concatenate([h, np.full(pad, ~np.uint64(0))]).reshape(-1, w)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    key = np.minimum(tail[: n - length + 1], head[w - 1 : w - 1 + n - length + 1])
    inside = np.zeros(n + 1, np.int64)
    begins = np.append(0, ends[:-1])
    long_ = ends - begins >= length
    np.add.at(inside, begins[long_], 1)
    np.add.at(inside, ends[long_] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(inside)[: len(key)])
    if not len(start):
        return (np.zeros(0, np.int64),) * 4
    new = np.append(True, (np.diff(start) != 1) | (key[start[1:]] != key[start[:-1]]))
    new |= h[start + w - 1] == key[start]  # the least gram comes in anew: equal windows of one text lie in two runs
    first = start[new]
    last = start[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]
    content = _mixed((sums[last + length] - sums[first]) * down[first]) + (last - first).astype(np.uint64) * _MIX
    return first, last, key[first].view(np.int64), content.view(np.int64)


def _slabs(sizes: list[int]):
    at = 0
    while at < len(sizes):
        end, total = at, 0
        while end < len(sizes) and (end == at or total + sizes[end] <= SLAB_BYTES):
            total += sizes[end]
            end += 1
        yield at, end
        at = end


def _run_batches(gram: int, length: int):
    def run(batches):
        powers = _Powers()
        for batch in small_batches(batches):
            raw = [x.as_py() for x in batch.column("bytes")]
            base = np.asarray(batch.column("base"))
            for at, end in _slabs([len(x) for x in raw]):
                ends = np.cumsum([len(x) for x in raw[at:end]])
                first, last, key, content = window_runs(b"".join(raw[at:end]), ends, gram, length, powers)
                whose = np.searchsorted(ends, first, side="right")
                shift = base[at:end][whose] - np.append(0, ends[:-1])[whose]
                take = pa.array(whose + at)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").take(take),
                        batch.column("row2").take(take),
                        batch.column("copies").take(take),
                        pa.array(key),
                        pa.array(content),
                        pa.array((first + shift).astype(np.int32)),
                        pa.array((last + shift).astype(np.int32)),
                    ],
                    names=["row", "row2", "copies", "key", "content", "first", "last"],
                )

    return run


def _runs(texts: DataFrame, gram: int, length: int) -> DataFrame:
    return texts.mapInArrow(
        _run_batches(gram, length), "row long, row2 long, copies int, key long, content long, first int, last int"
    )


def _slice(batches):
    """Cut the asked spans out of each document."""
    for batch in small_batches(batches):
        out = []
        for text, row, row2, spans in zip(*(batch.column(c) for c in ("bytes", "row", "row2", "spans"))):
            raw, row, row2 = text.as_py(), row.as_py(), row2.as_py()
            out += [(row, row2, s["first"], s["copies"], s["key"], s["block"], raw[s["first"] : s["stop"]]) for s in spans.as_py()]
        cols = list(zip(*out)) if out else [()] * 7
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        names = ["row", "row2", "base", "copies", "key", "block", "bytes"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def _expand(length: int):
    """Repeated byte ranges of one block of distinct runs."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        give_back()
        spans = rows["bytes"].tolist()
        starts = np.array([len(s) - length + 1 for s in spans], np.int64)
        base, out = rows["base"].to_numpy(), []
        for i, hit in enumerate(repeated_starts(spans, starts, length)):
            if len(hit):
                cut = np.flatnonzero(np.diff(hit) > 1)
                lo, hi = hit[np.append(0, cut + 1)], hit[np.append(cut, len(hit) - 1)] + length
                out.append((np.full(len(lo), i), lo + base[i], hi + base[i]))
        who, lo, hi = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        return pd.DataFrame(
            {
                "row": rows["row"].to_numpy()[who],
                "row2": rows["row2"].to_numpy()[who],
                "start": lo.astype(np.int32),
                "stop": hi.astype(np.int32),
            }
        )

    return run


def _row_keys() -> list[Column]:
    """128 bits that tell rows apart by their id and text, in two numbers: equal ones are the same
    row twice, which is cut alike."""
    text, named = whole_text(), [F.col("doc_id"), F.col("doc_id").isNull()]
    return [F.xxhash64(*named, text).alias("row"), F.xxhash64(text, F.lit(1), *named).alias("row2")]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*_row_keys(), F.lit(0).alias("base"), F.lit(1).alias("copies"), F.encode(whole_text(), "UTF-8").alias("bytes"))


def repeated_ranges(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Byte ranges (row, row2, start, stop) that hold all bytes of ``length``-byte strings which
    start more than once in the corpus. Ranges of a document may overlap. ``row`` and ``row2`` are
    those of ``_row_keys``."""
    spark = docs.sparkSession
    texts = source = _texts(docs)
    found: list[DataFrame] = []
    for gram in gram_sizes(length):
        runs = _runs(texts, gram, length)
        stop = (F.col("last") + length).alias("stop")
        keys = runs.groupBy("key").agg(
            F.sum("copies").alias("n"), F.min("content").alias("low"), F.max("content").alias("high")
        )
        keys = materialize(
            keys.filter("n > 1").select(F.col("key").alias("_key"), (F.col("low") == F.col("high")).alias("uniform")), "keys"
        )
        repeats = materialize(runs.join(keys, F.col("key") == F.col("_key")).drop("_key"), "repeats")
        found.append(repeats.filter("uniform").select("row", "row2", F.col("first").alias("start"), stop))
        mixed = repeats.filter("not uniform")
        if gram == length or mixed.limit(1).count() == 0:
            if gram == length:  # the key is the window: all runs of a key are repeats
                found.append(mixed.select("row", "row2", F.col("first").alias("start"), stop))
            break
        classes = mixed.groupBy("key", "content").agg(
            F.sum("copies").alias("copies"), F.min(F.struct("row", "row2", "first", stop)).alias("one")
        ).select("key", "content", F.least("copies", F.lit(2)).cast("int").alias("copies"), "one.*")
        classes = materialize(classes, "classes")
        again = classes.filter("copies > 1").select(F.col("key").alias("_key"), F.col("content").alias("_content"))
        copied = mixed.join(again, (F.col("key") == F.col("_key")) & (F.col("content") == F.col("_content")), "left_semi")
        found.append(copied.select("row", "row2", F.col("first").alias("start"), stop))
        span = F.col("stop") - F.col("first")
        total = classes.agg(F.sum(span)).first()[0]
        blocks = total // BLOCK_BYTES + 1
        crowded = classes.groupBy("key").agg(F.sum(span).alias("size")).filter(F.col("size") > GROUP_BYTES)
        crowded = materialize(crowded.select(F.col("key").alias("_key")), "crowded")
        asked = classes.join(crowded, F.col("key") == F.col("_key"), "left").withColumn(
            "block", F.when(F.col("_key").isNull(), F.pmod("key", F.lit(blocks))).otherwise(F.lit(-1))
        )
        per_doc = asked.groupBy("row", "row2").agg(
            F.collect_list(F.struct("first", "stop", "copies", "key", "block")).alias("spans")
        )
        sliced = source.join(per_doc, ["row", "row2"]).mapInArrow(
            _slice, "row long, row2 long, base int, copies int, key long, block long, bytes binary"
        )
        # rows that occur twice would be sliced twice
        sliced = materialize(sliced.dropDuplicates(["row", "row2", "base", "key"]), "spans")
        expanded = sliced.filter("block >= 0").groupBy("block").applyInPandas(
            _expand(length), "row long, row2 long, start int, stop int"
        )
        found.append(materialize(expanded, "ranges"))
        texts = sliced.filter("block < 0").select("row", "row2", "base", "copies", "bytes")
        if texts.limit(1).count() == 0:
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(stop, out[-1][1])
        else:
            out.append([start, stop])
    return out


def _cut(as_text: bool):
    def run(batches):
        for batch in small_batches(batches):
            rows = []
            for text, spans in zip(batch.column("bytes"), batch.column("spans")):
                raw = text.as_py()
                runs = merged([(s["start"], s["stop"]) for s in spans.as_py() or []])
                kept, at = [], 0
                for start, stop in runs:
                    kept.append(raw[at:start])
                    at = stop
                left = b"".join([*kept, raw[at:]])
                rows.append((len(raw), sum(b - a for a, b in runs), len(runs), left.decode(errors="ignore") if as_text else left))
            n, removed, count, left = zip(*rows) if rows else [()] * 4
            cols = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64())]
            cols += [pa.array(left, pa.string() if as_text else pa.binary()), batch.column("_rest")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "_rest"]
            )

    return run


def cut_repeats(docs: DataFrame, length: int = LENGTH, as_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes, or as
    text without the characters that lost some of their bytes) and _rest, a struct of the columns
    other than doc_id and text."""
    ranges = repeated_ranges(docs, length).distinct()
    per_doc = ranges.groupBy("row", "row2").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    texts = packed(docs, "doc_id", "text").select("doc_id", "_rest", *_row_keys(), F.encode(whole_text(), "UTF-8").alias("bytes"))
    joined = texts.join(per_doc, ["row", "row2"], "left")
    shape = joined.select("doc_id", "_rest", "bytes", "spans")
    kinds = {f.name: f.dataType.simpleString() for f in shape.schema}
    return shape.mapInArrow(
        _cut(as_text),
        f"doc_id {kinds['doc_id']}, n_bytes long, n_removed long, n_spans long, "
        f"kept {'string' if as_text else 'binary'}, _rest {_quoted(shape.schema['_rest'].dataType)}",
    )


def _quoted(struct) -> str:
    return "struct<" + ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in struct) + ">"


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with the repeated bytes cut from their text and ``n_chars``, where there is
    one, counted anew. Documents of which nothing is left go; texts that lose nothing stay as they
    are, except that a null text becomes an empty one."""
    cut = cut_repeats(docs, length, as_text=True).filter("n_removed = 0 or length(kept) > 0").withColumnRenamed("kept", "text")
    out = cut.select("n_removed", *unpacked(docs, "doc_id", "text"))
    if "n_chars" in docs.columns:
        n = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
