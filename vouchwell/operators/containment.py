"""Which quotes stand word for word in which documents.

Keyed (the quote names its document) it is an equi-join and a substring test. Unkeyed, a document
that holds a quote holds all of its 12-byte grams, so quotes and documents meet on one gram of the
quote, the one with the least hash: every true match has at least the least span length, which makes
it lossless, and quotes that begin alike still have keys of their own.

Each task looks a document's grams up in a Bloom filter of the quotes' keys, sized by their number.
What passes are rows of a text's digest and a gram, without the text; they meet the quotes by the
gram. Only then do texts that had a hit meet their candidates, by the digest, for the substring test:
a text moves once, however many of its grams hit, and not at all where none does. More quotes than
one filter is meant for are dealt into ranges of their keys, each with a filter and a pass of its own,
so a task's memory has the same bound for any number of quotes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchwell.functions.text import MIN_SPAN_CHARS, canonical, haystack, is_verbatim

#: Keys that one filter is made for, with FILTER_BITS bits each: 32 MB at most in a task.
KEYS_A_FILTER = 1 << 23
FILTER_BITS = 32
PROBES = 3
#: Bytes of text whose grams are hashed at a time.
SLAB_BYTES = 1 << 20
_MIX = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9], np.uint64)


def gram_hashes(raw: bytes) -> np.ndarray:
    """A hash per gram of MIN_SPAN_CHARS bytes (three words of four)."""
    if len(raw) < MIN_SPAN_CHARS:
        return np.zeros(0, np.uint64)
    x = np.frombuffer(raw, np.uint8).astype(np.uint32)
    word = (x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16) | x[3:] << np.uint32(24)).astype(np.uint64)
    n = len(raw) - MIN_SPAN_CHARS + 1
    h = (word[:n] + np.uint64(1)) * _MIX[0] ^ (word[4 : 4 + n] + np.uint64(1)) * _MIX[1] ^ (word[8 : 8 + n] + np.uint64(1)) * _MIX[2]
    return (h ^ (h >> np.uint64(31))) * _MIX[1]


class Bloom:
    """A set of hashes that says yes to all of its own, and to about one other in a thousand."""

    def __init__(self, keys: np.ndarray):
        bits = max(10, int(np.ceil(np.log2(max(1, len(keys)) * FILTER_BITS))))
        self.shift, self.bits = np.uint64(64 - bits), np.zeros(1 << bits - 3, np.uint8)
        for k in range(PROBES):
            at = self._place(keys, k)
            np.bitwise_or.at(self.bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def _place(self, h: np.ndarray, k: int) -> np.ndarray:
        return (h * _MIX[k]) >> self.shift

    def passing(self, h: np.ndarray) -> np.ndarray:
        for k in range(PROBES):
            at = self._place(h, k)
            h = h[(self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0]
        return h

    def of_text(self, raw: bytes) -> np.ndarray:
        found = []
        for at in range(0, len(raw), SLAB_BYTES):
            found.append(self.passing(gram_hashes(raw[at : at + SLAB_BYTES + MIN_SPAN_CHARS - 1])))
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _key_batches(batches):
    for batch in batches:
        keys = [int(gram_hashes(t.as_py().encode()).min()) for t in batch.column("needle")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("_q"), batch.column("needle"), pa.array(np.array(keys, np.uint64).view(np.int64))], names=["_q", "needle", "gram"]
        )


def _gram_batches(bloom: Bloom):
    """Of each text its digest and the grams that pass."""

    def run(batches):
        for batch in batches:
            found = [bloom.of_text(t.as_py().encode()) for t in batch.column("hay")]
            whose = np.repeat(np.arange(len(found)), [len(x) for x in found])
            flat = np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(whose)), pa.array(flat)], names=["key", "gram"])

    return run


def _text_batches(bloom: Bloom):
    """The texts with a gram that passes."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([len(bloom.of_text(t.as_py().encode())) > 0 for t in batch.column("hay")], pa.bool_()))

    return run


def verify_keyed(claims: DataFrame, profiles: DataFrame, key: str = "profile_id", evidence: str = "evidence", text: str = "raw_text") -> DataFrame:
    """``claims`` with ``verbatim``: does the evidence stand in the keyed profile's text?"""
    hay = profiles.select(F.col(key), haystack(F.col(text)).alias("_hay"))
    needle = canonical(F.col(evidence))
    joined = claims.join(hay, key, "left")
    return joined.withColumn("verbatim", F.coalesce(is_verbatim(needle, F.col("_hay")), F.lit(False))).drop("_hay")


def key_filters(keyed: DataFrame) -> list[Bloom]:
    """A filter per range of the quotes' keys. Keys come to the driver one range at a time, and
    about KEYS_A_FILTER of them at most."""
    grams = keyed.select("gram").distinct()
    n = grams.count()
    ranges = -(-n // KEYS_A_FILTER)
    within = lambda r: grams.filter(F.pmod(F.hash("gram"), F.lit(ranges)) == r) if ranges > 1 else grams
    return [Bloom(within(r).toArrow().column("gram").to_numpy().view(np.uint64)) for r in range(ranges)]


def find_quotes(quotes: DataFrame, docs: DataFrame, quote_id: str, quote: str, doc_id: str, text: str) -> DataFrame:
    """(quote_id, doc_id) of every quote and document where the quote stands in the document, a row
    per pair of rows: repeated rows and null ids count as rows of their own."""
    kinds = {c: t.schema[c].dataType.simpleString() for t, c in ((quotes, quote_id), (docs, doc_id))}
    needles = quotes.select(F.col(quote_id).alias("_q"), canonical(F.col(quote)).alias("needle")).filter(F.length("needle") >= MIN_SPAN_CHARS)
    keyed = needles.mapInArrow(_key_batches, f"_q {kinds[quote_id]}, needle string, gram long")
    hays = docs.select(F.col(doc_id).alias("_d"), haystack(F.col(text)).alias("hay")).withColumn("key", F.unhex(F.md5("hay")))

    def met(bloom: Bloom) -> DataFrame:
        grams = hays.select("key", "hay").mapInArrow(_gram_batches(bloom), "key binary, gram long").distinct()
        held = hays.mapInArrow(_text_batches(bloom), f"_d {kinds[doc_id]}, hay string, key binary")
        pairs = held.join(grams.join(keyed, "gram").select("key", "_q", "needle"), "key")
        return pairs.filter(F.contains("hay", F.col("needle"))).select(F.col("_q").alias(quote_id), F.col("_d").alias(doc_id))

    none = keyed.limit(0).select(F.col("_q").alias(quote_id), F.lit(None).cast(kinds[doc_id]).alias(doc_id))
    return reduce(DataFrame.unionByName, map(met, key_filters(keyed)), none)
