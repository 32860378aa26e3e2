"""Best-fit packing, planned on a histogram of lengths.

Pass one tokenises each partition once, cuts documents into pieces (whole windows and what is left
over) and numbers the pieces of each length inside the partition. Their counts per length, 2,048 at
most, are all that reaches the driver: best fit by falling length runs over the counts and gives
segments, each of them ``k`` places a sequence for a range of sequences. A piece's rank is its number
plus the count of its length in the partitions before; the rank falls into a segment of its length,
and that is its slot. Segments are laid on the ranks of a partition and length first, so a piece meets
the few segments of its own group by an equality join and no token is shuffled.

The number of segments has a bound of its own, ``window`` times its logarithm and a small factor,
whatever the corpus holds: each length leaves four new ranges of sequences at most, and a range that
takes pieces keeps less than half of its room.

Edge cases: a null or empty text packs as the end id alone; repeated rows are packed once each; a
null ``doc_id`` is kept; an empty table gives no piece; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchwell.llm._shared import arrow_type, materialize, small_batches, whole_text
from vouchwell.llm.packing import ROWS, word_ids

#: Above this many (partition, length) groups their slots are joined by a shuffle, not broadcast.
MAX_BROADCAST_GROUPS = 300_000

_PIECES = "pid int, local_rank long, doc_id {id}, piece int, start long, length int, ids binary"


def _cut_pieces(path: str, end_id: int, window: int, out: pa.Schema):
    def run(batches):
        coder = word_ids(path)
        tail, counts = np.array([end_id], coder.dtype).tobytes(), np.zeros(window + 1, np.int64)
        pid = TaskContext.get().partitionId()
        for batch in small_batches(batches, ROWS):
            texts = [ids + tail for ids in coder.encode(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(_pieces(texts, batch.column("doc_id"), coder.dtype, window, counts, pid), schema=out)

    return run


def _pieces(texts: list[bytes], doc_id: pa.Array, kind: np.dtype, window: int, counts: np.ndarray, pid: int) -> list[pa.Array]:
    """The pieces of a batch's documents, with their numbers per length after ``counts`` so far."""
    n = np.array([len(x) for x in texts], np.int64) // kind.itemsize
    per_doc = -(-n // window)
    doc = np.repeat(np.arange(len(n)), per_doc)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    start = piece * window
    length = np.minimum(n[doc] - start, window)
    order = np.argsort(length, kind="stable")
    sorted_ = length[order]
    rank = np.empty(len(doc), np.int64)
    rank[order] = np.arange(len(doc)) - np.searchsorted(sorted_, sorted_) + counts[sorted_]
    counts += np.bincount(length, minlength=window + 1)
    ids = np.frombuffer(b"".join(texts), kind).astype("<u4")
    place = np.append(0, np.cumsum(length)) * 4
    values = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(place.astype(np.int64)), pa.py_buffer(ids)])
    return [
        pa.array(np.full(len(doc), pid, np.int32)),
        pa.array(rank),
        doc_id.take(pa.array(doc)),
        pa.array(piece.astype(np.int32)),
        pa.array(start),
        pa.array(length.astype(np.int32)),
        values.cast(pa.binary()),
    ]


@dataclass
class Segment:
    """Ranks of one length from ``first`` on: ``each`` a sequence, in sequences from ``sequence`` on,
    at ``offset``."""

    first: int
    each: int
    sequence: int
    offset: int


def plan(counts: dict[int, int], window: int) -> tuple[dict[int, list[Segment]], int]:
    """Best fit by falling length over counts: segments per length, and the number of sequences.

    Open sequences with the same fill lie in ranges. The fullest that still take a length get it, as
    often as it fits, before less full ones do; what is left over opens new sequences.
    """
    open_: dict[int, list[tuple[int, int]]] = {}  # room left: ranges of sequences (first, how many)
    total, plans = 0, {}
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        left, done, segments = counts[length], 0, []
        for room in sorted(r for r in open_ if r >= length):
            while left and open_[room]:
                first, size = open_[room].pop()
                each = room // length
                full = min(size, left // each)
                rest = left - full * each if full < size else 0
                segments.append(Segment(done, each, first, window - room))
                used = full * each + rest
                left, done = left - used, done + used
                _leave(open_, room - each * length, first, full)
                if rest:
                    _leave(open_, room - rest * length, first + full, 1)
                _leave(open_, room, first + full + (rest > 0), size - full - (rest > 0))
            if not left:
                break
        if left:
            each = window // length
            full, rest = divmod(left, each)
            segments.append(Segment(done, each, total, 0))
            _leave(open_, window - each * length, total, full)
            if rest:
                _leave(open_, window - rest * length, total + full, 1)
            total += full + (rest > 0)
        plans[length] = segments
    return plans, total


def _leave(open_: dict[int, list[tuple[int, int]]], room: int, first: int, size: int) -> None:
    if size > 0 and room > 0:
        open_.setdefault(room, []).append((first, size))


def _lay(plans: dict[int, list[Segment]]):
    """The segments that the ranks of each partition of one length fall into, the first one's ranks
    counted from the group's own number 0."""

    def run(rows):
        rows = rows.sort_values("pid")
        segments = plans[int(rows["length"].iloc[0])]
        first = np.array([s.first for s in segments])
        count = rows["n"].to_numpy()
        base = np.cumsum(count) - count
        lo = np.searchsorted(first, base, side="right") - 1
        hi = np.searchsorted(first, base + count, side="left")
        slots = [
            [{"first": int(s.first - b), "each": s.each, "sequence": s.sequence, "place": s.offset} for s in segments[a:z]]
            for a, z, b in zip(lo, hi, base)
        ]
        return rows[["pid", "length"]].assign(slots=slots)

    return run


def pack_best_fit(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces in sequences of at most ``window`` tokens: only documents that are longer are cut.

    Columns: doc_id, piece, start, length, sequence_id, offset, ids (little-endian unsigned 32-bit).
    """
    pieces = cut_documents(docs, tokenizer_path, window, end_id)
    groups = materialize(pieces.groupBy("pid", "length").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # window rows at most
    plans, _ = plan(counts, window)
    slots = materialize(
        groups.groupBy("length").applyInPandas(
            _lay(plans), "pid int, length int, slots array<struct<first: bigint, each: bigint, sequence: bigint, place: bigint>>"
        ),
        "slots",
    )
    if slots.count() <= MAX_BROADCAST_GROUPS:
        slots = F.broadcast(slots)
    met = pieces.join(slots, ["pid", "length"]).withColumn(
        "slot", F.element_at(F.filter("slots", lambda s: s["first"] <= F.col("local_rank")), -1)
    )
    turn = F.col("local_rank") - F.col("slot.first")
    return met.select(
        "doc_id",
        "piece",
        "start",
        F.col("length").cast("long").alias("length"),
        (F.col("slot.sequence") + F.floor(turn / F.col("slot.each"))).alias("sequence_id"),
        (F.col("slot.place") + turn % F.col("slot.each") * F.col("length")).alias("offset"),
        "ids",
    )


def cut_documents(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 0) -> DataFrame:
    """Each document's ids and ``end_id``, cut only where they are longer than ``window``, with the
    piece's number among those of its length in its partition. Written to the shared folder."""
    kind = docs.schema["doc_id"].dataType
    out = pa.schema(
        [("pid", pa.int32()), ("local_rank", pa.int64()), ("doc_id", arrow_type(kind)), ("piece", pa.int32())]
        + [("start", pa.int64()), ("length", pa.int32()), ("ids", pa.binary())]
    )
    texts = docs.select("doc_id", whole_text().alias("text"))
    return materialize(texts.mapInArrow(_cut_pieces(tokenizer_path, end_id, window, out), _PIECES.format(id=kind.simpleString())), "pieces")


def assemble_sequences(pieces: DataFrame) -> DataFrame:
    """One row per sequence: its pieces' ids in order, ``window`` at most, and their number."""
    joined = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    ids = F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))")
    return joined.select("sequence_id", ids.alias("ids")).withColumn("n", (F.octet_length("ids") / 4).cast("int"))
