"""Document fingerprints by SpotSigs.

Wherever a common word stands, it and the next content words form a signature; a document's
fingerprint is the set of its signatures' 32-bit hashes. Likeness is the Jaccard coefficient of two
sets. ``compare_neighbours`` compares given pairs; ``similar_sets`` searches a corpus: sets are classed
by equality, partitioned by their length so that only lengths whose ratio allows the threshold meet,
indexed by their rarest signatures within that, and compared exactly.

Edge cases: a null text is an empty one; a text without a complete chain has one signature, that of
all its words; equal texts have equal sets; repeated rows follow each other in the order of ids; a
single document is its own next one; a null ``doc_id`` comes last; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchwell.llm import near_copies
from vouchwell.llm._shared import arrow_type, materialize, partitions, small_batches, whole_text
from vouchwell.llm.simhash import first_of, majority

# Very common words of English, German, French and Spanish.
ANCHORS = frozenset(
    "a an and are as at be by for from in is it of on or that the this to was were with "
    "auf auch das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "au aux ce dans des du elle en est et il la le les ne pas par pour que qui sur un une "
    "al como con de del el es esta los las no para por se su una y".split()
)
CHAIN = 2
#: Places of the table that tells common signatures from rare ones.
PLACES = 1 << 16
_WORDS = re.compile(r"\w+")


def signatures(text: str, chain: int = CHAIN, anchors: frozenset = ANCHORS) -> frozenset[int]:
    import xxhash

    words = _WORDS.findall(text.lower())
    content = [w for w in words if w not in anchors]
    last, k, found = len(content) - chain, 0, set()
    add = found.add
    if chain == 2:
        for w in words:
            if w not in anchors:
                k += 1
            elif k <= last:
                add(f"{w} {content[k]} {content[k + 1]}")
            else:
                break
    else:
        for w in words:
            if w not in anchors:
                k += 1
            elif k <= last:
                add(" ".join([w, *content[k : k + chain]]))
            else:
                break
    digest = xxhash.xxh32_intdigest
    return frozenset(map(digest, found or [" ".join(words)]))


def likeness(a: frozenset[int], b: frozenset[int], threshold: float = 0.0) -> float:
    """Jaccard coefficient; below the threshold by the sets' lengths alone, 0 without a look."""
    small, large = sorted((len(a), len(b)))
    if small < threshold * large:
        return 0.0
    both = len(a & b)
    return both / (small + large - both)


def as_text(found: frozenset[int]) -> str:
    return np.sort(np.fromiter(found, np.uint32, len(found))).astype(">u4").tobytes().hex()


_OUT = (
    "doc_id {id}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, n_signatures int"
)


def _compare(id_type: pa.DataType):
    types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32()]
    names = [c.split()[0] for c in _OUT.split(", ")]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches):
        held, rows = None, []
        for batch in batches:
            for part, guest, doc, text in zip(*(batch.column(c).to_pylist() for c in ("part", "guest", "doc_id", "text"))):
                found = signatures(text)
                if held is not None and held[0] == part:
                    _, own_id, own, own_found = held
                    half = len(own) // 2
                    edited = own[: len(own) - half] + text[:half]
                    changed = own_found if edited == own else signatures(edited)
                    rows.append(
                        (
                            own_id,
                            len(own),
                            hashlib.sha256(edited.encode()).hexdigest(),
                            as_text(own_found),
                            as_text(changed),
                            likeness(own_found, changed),
                            likeness(own_found, found),
                            len(own_found),
                        )
                    )
                    if len(rows) >= 256:
                        yield batch_of(rows)
                        rows = []
                # a guest is only ever the next one: its own pair is made in its own range
                held = None if guest else (part, doc, text, found)
        if rows:
            yield batch_of(rows)

    return run


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Each document against its edited text and against the next document by descending id (a
    whole number).

    Ids are cut into ranges at approximate quantiles; a range's first document also goes to the
    range before, and the very first to the last, so each task finds all its pairs in its own rows.
    """
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select(
        "doc_id",
        whole_text().alias("text"),
        F.xxhash64(whole_text()).alias("tie"),
        F.coalesce(-F.col("doc_id").cast("double"), F.lit(float("inf"))).alias("place"),
        F.bitwise_not(F.col("doc_id").cast("long")).alias("down"),  # exact where the double isn't
    )
    ranges = 4 * partitions(spark)
    at = [i / ranges for i in range(1, ranges)]
    cuts = docs.select(F.percentile_approx(-F.col("doc_id").cast("double"), at, F.lit(100 * ranges))).first()[0] or []
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    if len(splits) > 2:
        keyed = Bucketizer(splits=splits, inputCol="place", outputCol="_part").transform(keyed)
        keyed = keyed.withColumn("part", F.col("_part").cast("int"))
    else:
        keyed = keyed.withColumn("part", F.lit(0))
    order = F.struct("place", "down", "tie")
    heads = keyed.groupBy("part").agg(F.min(order).alias("head")).orderBy("part").collect()  # one row per range
    if not heads:
        return spark.createDataFrame([], _OUT.format(id=kind))
    guests = [(r["part"], heads[i - 1]["part"], *r["head"]) for i, r in enumerate(heads)]
    guests = spark.createDataFrame(guests, "_own int, _before int, _place double, _down long, _tie long")
    seen = keyed.join(F.broadcast(guests), F.col("part") == F.col("_own"))
    first = (F.col("place") == F.col("_place")) & F.col("down").eqNullSafe(F.col("_down")) & (F.col("tie") == F.col("_tie"))
    stay = F.struct(F.col("part").alias("part"), F.lit(0).alias("guest"))
    go = F.struct(F.col("_before").alias("part"), F.lit(1).alias("guest"))
    dealt = seen.withColumn("to", F.explode(F.when(first, F.array(stay, go)).otherwise(F.array(stay))))
    sent = dealt.select("to.part", "to.guest", "place", "down", "tie", "doc_id", "text").repartition(partitions(spark), "part")
    sent = sent.sortWithinPartitions("part", "guest", "place", "down", "tie").select("part", "guest", "doc_id", "text")
    return sent.mapInArrow(_compare(arrow_type(docs.schema["doc_id"].dataType)), _OUT.format(id=kind))


def _partition_starts(threshold: float) -> np.ndarray:
    """The least set length of each partition: a set of one reaches the threshold with sets of the
    partitions beside its own at most."""
    starts = [0, 1]
    while starts[-1] < 1 << 31:
        starts.append(int(starts[-1] / threshold + 1e-9) + 1)
    return np.array(starts[1:])


def _set_batches(batches):
    import xxhash

    for batch in small_batches(batches):
        sets = [np.sort(np.fromiter(f, np.uint32, len(f)).view(np.int32)) for f in map(signatures, batch.column("text").to_pylist())]
        nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row"), pa.array(nodes), pa.array(sets, pa.list_(pa.int32()))], names=["doc_id", "row", "node", "shingles"]
        )


def _key_batches(common: np.ndarray, threshold: float):
    """Per set the keys under which it may meet others: each of its rarest n - ceil(threshold * n) + 1
    signatures, with its own length partition and with the one above."""
    starts = _partition_starts(threshold)

    def run(batches):
        for batch in small_batches(batches):
            ns, fps, keys, ends = [], [], [], [0]
            for found in batch.column("shingles"):
                s = found.values.to_numpy().astype(np.int64)
                n = len(s)
                rare = s[np.lexsort((s, common[s % len(common)]))][: n - int(np.ceil(threshold * n - 1e-9)) + 1].astype(np.uint64)
                part = np.uint64(np.searchsorted(starts, n, "right"))
                keys += [(rare << np.uint64(8)) + part, (rare << np.uint64(8)) + part + np.uint64(1)]
                ends.append(ends[-1] + 2 * len(rare))
                ns.append(n)
                fps.append(majority(s.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            flat = pa.array((np.concatenate(keys) if keys else np.zeros(0, np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node"),
                    pa.array(np.array(fps, np.uint64).view(np.int64)),
                    pa.array(ns, pa.int32()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat),
                ],
                names=["node", "fp", "n", "keys"],
            )

    return run


def similar_sets(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_signatures, class_id (the least id of the documents with an equal
    set), component_id (the least id reachable over links, at a likeness of 0.8 or more), class_key
    and component_key (hashes that name the class and the component also where no document of
    theirs has an id).

    By the prefix principle, two sets that reach the threshold share one of their rarest signatures,
    and their lengths lie in one partition or in two beside each other, so sets meet by (partition,
    signature) and no link is lost. Which signatures are common is counted over all sets in a table
    of fixed size; where two share a place in it, only the order changes, which is the same for all
    sets. What meets is compared as near copies are: neighbours first, then, if its sets aren't
    linked yet, in parts of bounded size within tasks, of which only a forest of links comes out. So a
    signature that a third of the sets have is split, and no pairs are emitted.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.xxhash64(whole_text()).alias("row"), whole_text().alias("text"))
    sets = materialize(texts.mapInArrow(_set_batches, f"doc_id {kind}, row long, node long, shingles array<int>"), "sets")
    distinct = materialize(sets.select("node", "shingles").dropDuplicates(["node"]), "distinct")
    place = F.explode("shingles").alias("sig")
    counts = distinct.select(place).groupBy(F.pmod("sig", F.lit(PLACES)).alias("place")).agg(F.count("*").alias("n")).toArrow()  # PLACES rows at most
    common = np.zeros(PLACES, np.int64)
    common[counts.column("place").to_numpy()] = counts.column("n").to_numpy()
    keyed = distinct.mapInArrow(_key_batches(common, near_copies.LIKENESS), "node long, fp long, n int, keys array<long>")
    keyed = materialize(keyed, "keys").select("node", "fp", "n", F.explode("keys").alias("band"))
    shared = keyed.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1").select("band")
    roots = near_copies.linked(materialize(keyed.join(shared, "band"), "met"), distinct)

    classes = sets.groupBy("node").agg(F.min(first_of()).alias("least"))
    rooted = materialize(classes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "rooted")
    names = rooted.groupBy("root").agg(F.min("least").alias("chosen"))
    named = rooted.join(names, "root").select("node", F.col("least.doc_id").alias("class_id"), F.col("chosen.doc_id").alias("component_id"), F.col("root").alias("component_key"))
    own = sets.select("doc_id", "node", F.size("shingles").alias("n_signatures"))
    return own.join(named, "node").select("doc_id", "n_signatures", "class_id", "component_id", F.col("node").alias("class_key"), "component_key")
