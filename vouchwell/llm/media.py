"""Media columns: interleaved document sequences with resolved payloads.

HTML becomes an ordered array of text and media-reference structs; references carry the payload's
SHA-256. Payloads are stored as lossless 8-bit grayscale PNG, one per digest however many documents
refer to it, and joined to the references by digest; what comes back keeps every element's position
and its caption. The join's key is the digest's bytes, dealt out anew on both sides, so that
adaptive execution may split the references to a hot payload.

Edge cases: null or empty html gives an empty sequence; a reference without a digest, or to a
payload that isn't there, keeps its place with null media; repeated rows give a sequence each; an
empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchwell.llm.markup import BLOCK, attributes, tokens

#: Samples in a row of the stored image, and what a payload's length is a multiple of.
WIDTH = 192
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_MEDIA = {"img": "src", "video": "src", "audio": "src", "embed": "src", "source": "src"}
_DIGEST = re.compile(r"(?i)\b([0-9a-f]{64})\b")

ITEM = "struct<pos: int, kind: string, text: string, ref: string, digest: string, caption: string>"


def sequence(html: str) -> list[dict]:
    """Text blocks and media references in page order. A reference's caption is its figure's
    figcaption, else its alternative text."""
    items: list[dict] = []
    text: list[str] = []
    figure: list[dict] | None = None
    caption: list[str] | None = None

    def flush():
        joined = " ".join("".join(text).split())
        text.clear()
        if joined:
            items.append({"kind": "text", "text": joined, "ref": None, "digest": None, "caption": None})

    for kind, value, raw in tokens(html):
        if kind == "text":
            (text if caption is None else caption).append(value)
        elif kind == "open":
            if value in BLOCK or value in _MEDIA:
                if caption is None:
                    flush()
            if value == "figure":
                figure = []
            elif value == "figcaption" and figure is not None:
                caption = []
            elif value in _MEDIA:
                attrs = attributes(raw)
                ref = attrs.get(_MEDIA[value])
                if ref:
                    found = _DIGEST.search(ref)
                    item = {"kind": "media", "text": None, "ref": ref, "digest": found[1].lower() if found else None, "caption": attrs.get("alt") or None}
                    items.append(item)
                    if figure is not None:
                        figure.append(item)
        else:
            if value == "figcaption" and caption is not None:
                said = " ".join("".join(caption).split())
                for item in figure or []:
                    item["caption"] = said or item["caption"]
                caption = None
            elif value in BLOCK and caption is None:
                flush()
            if value == "figure":
                figure = None
    if caption is not None:  # the page ends inside a caption
        text.extend(caption)
    flush()
    return [{"pos": i, **item} for i, item in enumerate(items)]


_ITEM_ARROW = pa.list_(
    pa.struct([("pos", pa.int32()), *((c, pa.string()) for c in ("kind", "text", "ref", "digest", "caption"))])
)


def _sequence_batches(batches):
    for batch in batches:
        made = [sequence(h or "") for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made, _ITEM_ARROW)], names=["id", "items"])


def parse_sequences(pages: DataFrame, id_column: str) -> DataFrame:
    """id and items: the ordered structs of each page."""
    kind = pages.schema[id_column].dataType.simpleString()
    return pages.select(F.col(id_column).alias("id"), "html").mapInArrow(_sequence_batches, f"id {kind}, items array<{ITEM}>")


def encode_png(payload: bytes) -> bytes:
    """8-bit grayscale, WIDTH samples a row, no filter."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    body = np.zeros((len(rows), WIDTH + 1), np.uint8)
    body[:, 1:] = rows
    chunks = [(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(body.tobytes(), 1)), (b"IEND", b"")]
    return _SIGNATURE + b"".join(struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d)) for t, d in chunks)


def decode_png(stored: bytes) -> bytes:
    """The samples of what ``encode_png`` stores; damaged data raises."""
    if stored[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, data, size = 8, [], None
    while at < len(stored):
        (n,) = struct.unpack_from(">I", stored, at)
        tag, body = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + n]
        if zlib.crc32(tag + body) != struct.unpack_from(">I", stored, at + 8 + n)[0]:
            raise ValueError("PNG chunk is damaged")
        if tag == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif tag == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, WIDTH + 1)
    if size is None or size[:3] != (WIDTH, len(rows), 8) or rows[:, 0].any():
        raise ValueError("PNG of another kind")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Histogram of the samples in 16 bins, each as a share of 255 in hex, and their mean and
    spread in hundredths."""
    x = np.frombuffer(payload, np.uint8)
    bins = np.bincount(x >> 4, minlength=16) * 255 // len(x)
    return bins.astype(np.uint8).tobytes().hex() + f":{int(x.mean() * 100)}:{int(x.std() * 100)}"


def _store_batches(batches):
    for batch in batches:
        stored = [encode_png(p.as_py()) for p in batch.column("payload")]
        yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(stored, pa.binary())], names=["digest", "media"])


def store_payloads(payloads: DataFrame) -> DataFrame:
    """digest and media, one row per digest. ``payloads``: digest (lowercase hex SHA-256), payload
    (bytes). Copies are dropped in each task before the shuffle."""
    stored = payloads.mapInArrow(_store_batches, "digest string, media binary")
    return stored.groupBy("digest").agg(F.first("media").alias("media"))


_FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read_batches(batches):
    for batch in batches:
        rows = []
        for digest, media in zip(batch.column("digest").to_pylist(), batch.column("media")):
            stored = media.as_py()
            p = decode_png(stored)
            rows.append((digest, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(p)))
        names = [c.split()[0] for c in _FEATURES.split(", ")]
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        cols = list(zip(*rows)) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def read_payloads(stored: DataFrame) -> DataFrame:
    """The stored bytes read back: lengths, digests and features per payload."""
    return stored.mapInArrow(_read_batches, _FEATURES)


def resolve(sequences: DataFrame, payloads: DataFrame) -> DataFrame:
    """``sequences`` (id, items) with each item's ``media``: the row of ``payloads`` (one per
    digest) that its digest names, or null. Items keep their order."""
    columns = [c for c in payloads.columns if c != "digest"]
    known = payloads.select(F.unhex("digest").alias("_key"), F.struct(*columns).alias("media"))
    apart = sequences.select("id", F.xxhash64(F.to_json("items")).alias("_seq"), F.explode_outer("items").alias("item"))
    keyed = apart.withColumn("_digest", F.unhex("item.digest"))
    joined = keyed.join(known, F.col("_digest") == F.col("_key"), "left")
    item = F.struct("item.*", "media")
    whole = joined.groupBy("id", "_seq").agg(F.array_sort(F.collect_set(F.when(F.col("item").isNotNull(), item))).alias("items"), F.count("*").alias("n"))
    # equal rows are gathered as one: every item came once per row, an empty sequence as one null
    rows = (F.col("n") / F.greatest(F.size("items"), F.lit(1))).cast("int")
    return whole.withColumn("_row", F.explode(F.sequence(F.lit(1), rows))).select("id", "items")


def padded(text: Column) -> Column:
    """UTF-8 bytes with spaces up to a positive multiple of WIDTH."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    n = F.octet_length(raw)
    fill = F.greatest(F.ceil(n / WIDTH), F.lit(1)) * WIDTH - n
    return F.concat(raw, F.encode(F.repeat(F.lit(" "), fill.cast("int")), "UTF-8"))


def text_media(docs: DataFrame) -> DataFrame:
    """Each document as a figure whose picture is its text, through the whole operator: doc_id,
    caption (the unpadded length) and media."""
    payload = padded(F.col("text"))
    digest = F.sha2(payload, 256)
    n = F.octet_length(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    page = F.format_string('<figure><img src="sha256:%s"><figcaption>%d</figcaption></figure>', digest, n)
    sequences = parse_sequences(docs.select("doc_id", page.alias("html")), "doc_id")
    stored = store_payloads(docs.select(digest.alias("digest"), payload.alias("payload")))
    whole = resolve(sequences, read_payloads(stored))
    return whole.select(F.col("id").alias("doc_id"), F.explode("items").alias("i")).select("doc_id", "i.caption", "i.media")
