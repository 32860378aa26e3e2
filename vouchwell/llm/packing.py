"""Packing: concatenate and cut.

Pass one tokenises each partition once and keeps running token offsets inside the partition; the
partitions' totals get a prefix sum; pass two adds a partition's base to its rows and cuts the
endless token stream into fixed windows. No row is shuffled: only one total per input partition is.

Edge cases: a null or empty text packs as the end id alone; repeated rows are packed once each; a
null ``doc_id`` is kept; an empty table gives no piece; extra columns are ignored. Documents longer
than a window continue in the next one, with the boundary flagged on both pieces.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vouchwell.llm._shared import arrow_type, materialize, small_batches, whole_text

#: Above this many input partitions the base offsets are joined by a shuffle, not broadcast.
MAX_BROADCAST_BASES = 100_000
#: Words that a worker remembers with their ids. Beyond it stay those that came up again since they
#: were learned, and beyond that none.
WORD_CACHE = 300_000
#: Bytes of text that are split into words at a time.
SLAB_BYTES = 1 << 23
#: Rows that are tokenised at a time.
ROWS = 8000
#: Words that go through the tokenizer as one text.
WORDS_AT_ONCE = 2000
_BREAK = "\x01"
# ASCII marks (but the apostrophe, which may begin an ending) after a plain letter
_MARKS = r"!-&(-/:-@\[-`{-~"
_MARKED = f"([a-zß-öø-ÿ])([{_MARKS}])"
_PROBE = "one two's  Three\tfour\n5 six,seven . été 12ab\r\n(x) #y"


class WordIds:
    """Token ids of whole texts, each distinct word going through the tokenizer once.

    Texts are split at ASCII white space and their words numbered by Arrow; new words are joined to
    one text with a mark between them that the tokenizer keeps apart, so its cost per call is shared;
    words of letters alone need no mark where the vocabulary itself tells a word's last token.
    That holds for tokenizers that never join text across white space; a probe tells, and texts go
    through any other tokenizer whole. Where it also tells that ASCII case and the marks after a
    word make no difference to the word's ids, words are counted without them. Texts that
    hold one of the tokenizer's added tokens, in any case, go through it whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        self.again: dict[str, bytes] = {}
        mark = self._raw([f" {_BREAK} "])[0]
        self.mark = np.frombuffer(mark, self.dtype)[0]
        same = lambda parts, whole: b"".join(self._raw(parts)) == self._raw([whole])[0]
        self.by_word = len(mark) == self.dtype.itemsize and same(_PROBE.split(), _PROBE)
        self.lowers = same([_PROBE.upper()], _PROBE)
        marks = re.findall(f"[{_MARKS}]", "".join(map(chr, range(33, 127))))
        self.parts = same([x for m in marks for x in ("ab", f"{m}cd", "é", m * 2)], " ".join(f"ab{m}cd é{m}{m}" for m in marks))
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        self.last = None  # which ids end a word
        if suffix:
            self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.last[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _raw(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        out: list[bytes] = []
        at, ends = 0, np.cumsum(np.asarray(pc.binary_length(texts), np.int64))
        while at < len(texts):
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + SLAB_BYTES, side="right")))
            slab = texts.slice(at, end - at)
            out += self._slab(slab) if self.by_word else self._raw(slab.to_pylist())
            at = end
        return out

    def _slab(self, texts: pa.Array) -> list[bytes]:
        whole = pa.array([False] * len(texts))
        for token in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, token, ignore_case=True))
        out = self._by_word(pc.if_else(whole, "", texts) if whole.true_count else texts)
        for i in np.flatnonzero(whole) if whole.true_count else ():
            out[i] = self._raw([texts[int(i)].as_py()])[0]
        return out

    def _by_word(self, texts: pa.Array) -> list[bytes]:
        if self.lowers:
            texts = pc.ascii_lower(texts)
            if self.parts:
                texts = pc.replace_substring_regex(texts, _MARKED, r"\1 \2")
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        ids = pa.array(self._words(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
        place = np.append(0, np.cumsum(np.asarray(pc.binary_length(ids), np.int64)))
        ends = place[np.append(0, np.cumsum(np.asarray(pc.list_value_length(words), np.int64)))].tolist()
        joined = memoryview(ids.buffers()[2] or b"")
        return [bytes(joined[a:b]) for a, b in zip(ends, ends[1:])]

    def _words(self, words: list[str]) -> list[bytes]:
        if len(self.known) > WORD_CACHE:
            self.known = self.again if len(self.again) <= WORD_CACHE // 2 else {}
            self.again = {}
        known = self.known
        met = {w: known[w] for w in words if w in known}
        new = [w for w in words if w not in met] if met else words
        for at in range(0, len(new), 16 * WORDS_AT_ONCE):
            self._learn(new[at : at + 16 * WORDS_AT_ONCE])
        self.again |= met
        return [known[w] for w in words]

    def _learn(self, new: list[str]) -> None:
        odd = [w for w in new if _BREAK in w]
        new = [w for w in new if _BREAK not in w] if odd else new
        width = self.dtype.itemsize
        if self.last is not None:
            letters = [w for w in new if w.lower().isalpha()]
            new = [w for w in new if not w.lower().isalpha()]
            for group, raw in self._together(letters, " "):
                ends = ((np.flatnonzero(self.last[np.frombuffer(raw, self.dtype)]) + 1) * width).tolist()
                if len(ends) == len(group) and ends[-1] == len(raw):
                    self.known.update((w, raw[a:b]) for w, a, b in zip(group, [0, *ends], ends))
                else:
                    new += group
        for group, raw in self._together(new, f" {_BREAK} "):
            cut = np.flatnonzero(np.frombuffer(raw, self.dtype) == self.mark) * width
            if len(cut) + 1 == len(group):
                cut = cut.tolist()
                self.known.update((w, raw[a:b]) for w, a, b in zip(group, [0, *(c + width for c in cut)], [*cut, len(raw)]))
            else:
                odd += group
        if odd:
            self.known.update(zip(odd, self._raw(odd)))

    def _together(self, words: list[str], between: str):
        """Groups of words with the ids of their joined text."""
        groups = [words[i : i + WORDS_AT_ONCE] for i in range(0, len(words), WORDS_AT_ONCE)]
        return zip(groups, self._raw([between.join(g) for g in groups]))


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """The worker's own, kept from task to task."""
    return WordIds(path)


_TOKEN_SCHEMA = "pid int, local_start long, doc_id {id}, n long, ids binary"


def _tokenize(path: str, end_id: int, out: pa.Schema):
    def run(batches):
        coder, start = word_ids(path), 0
        width, tail = coder.dtype.itemsize, np.array([end_id], coder.dtype).tobytes()
        pid = TaskContext.get().partitionId()
        for batch in small_batches(batches, ROWS):
            ids = [x + tail for x in coder.encode(batch.column("text"))]
            n = np.array([len(x) // width for x in ids], np.int64)
            ends = start + np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(n), pid, np.int32)),
                    pa.array(ends - n),
                    batch.column("doc_id"),
                    pa.array(n),
                    pa.array(ids, pa.binary()),
                ],
                schema=out,
            )
            start = int(ends[-1]) if len(n) else start

    return run


def tokenize_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Each document's ids followed by ``end_id``, with its offset inside its partition.

    The result is written to the shared folder, so that both passes see the same partitions.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", whole_text().alias("text"))
    arrow_id = arrow_type(docs.schema["doc_id"].dataType)
    out = pa.schema(
        [("pid", pa.int32()), ("local_start", pa.int64()), ("doc_id", arrow_id), ("n", pa.int64()), ("ids", pa.binary())]
    )
    df = texts.mapInArrow(_tokenize(tokenizer_path, end_id, out), _TOKEN_SCHEMA.format(id=kind))
    return materialize(df, "tokens")


def _cut(window: int, width: int, out: pa.Schema):
    def run(batches):
        for batch in small_batches(batches):
            rows: list[tuple] = []
            start = np.asarray(batch.column("start_at")).tolist()
            for doc, g, raw in zip(batch.column("doc_id").to_pylist(), start, batch.column("ids")):
                ids = np.frombuffer(raw.as_py(), f"<u{width}").astype("<u4")
                n, pos = len(ids), 0
                while pos < n:
                    seq, offset = divmod(g + pos, window)
                    size = min(n - pos, window - offset)
                    rows.append((doc, pos, size, n, seq, offset, pos > 0, pos + size < n, ids[pos : pos + size].tobytes()))
                    pos += size
            cols = list(zip(*rows)) if rows else [()] * len(out)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, out.types)], schema=out)

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of ``window``-token sequences: every id of every document lies in exactly one piece.

    Columns: doc_id, start, length, doc_tokens, sequence_id, offset, continued (an earlier piece
    holds the document's start), continues, ids (little-endian unsigned 32-bit). All sequences but
    the last are full, so the padding of the whole corpus is below one window.
    """
    tokens = tokenize_documents(docs, tokenizer_path, end_id)
    totals = tokens.groupBy("pid").agg(F.max(F.col("local_start") + F.col("n")).alias("total"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(
        totals.select("pid", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), "bases"
    )
    if bases.count() <= MAX_BROADCAST_BASES:
        bases = F.broadcast(bases)
    placed = tokens.join(bases, "pid").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start_at"), "ids"
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    arrow_id = arrow_type(docs.schema["doc_id"].dataType)
    out = pa.schema(
        [("doc_id", arrow_id)]
        + [(c, pa.int64()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")]
        + [("continued", pa.bool_()), ("continues", pa.bool_()), ("ids", pa.binary())]
    )
    schema = (
        f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, "
        "continued boolean, continues boolean, ids binary"
    )
    width = 2 if _vocab_size(tokenizer_path) <= 1 << 16 else 4
    return placed.mapInArrow(_cut(window, width, out), schema)


def _vocab_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def assemble_sequences(pieces: DataFrame, window: int = 2048, pad_id: int = 0) -> DataFrame:
    """One row per sequence: its ids as an array. A sequence whose length is a power of two stays
    as it is, any other is padded to ``window``; a group holds at most ``window`` ids."""
    joined = (
        pieces.groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
        .select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))
        .withColumn("n", (F.octet_length("ids") / 4).cast("int"))
    )
    power = F.expr("(n & (n - 1)) = 0")
    return joined.select(
        "sequence_id", "n", F.when(power, F.lit(0)).otherwise(window - F.col("n")).alias("padding"), "ids"
    ).withColumn("pad_id", F.lit(pad_id))
