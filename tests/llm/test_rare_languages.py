"""Languages with few rows are found, scored and kept."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from vouchwell.llm import language

EN = "the cat and the dog sat by the fire of the old house and talked about the weather "
FI = "kissa ja koira istuivat vanhan talon takan ääressä ja puhuivat pitkään säästä "


def test_a_language_with_few_rows_is_identified_and_kept(spark):
    """Its rows have the highest hashes of 6,000, so a sample over all rows would leave them out."""
    ids = [r.id for r in spark.range(6000).orderBy(F.xxhash64("id").desc()).limit(3).collect()]
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id").isin(ids), F.lit(FI)).otherwise(F.lit(EN)).alias("text"),
        F.when(F.col("id").isin(ids), F.lit("fi")).otherwise(F.lit("en")).alias("lang"),
        F.lit("a.example.org").alias("source"),
    )
    rare = language.identify_documents(docs).filter(F.col("doc_id").isin(ids)).collect()
    assert [(r.language, r.kept) for r in rare] == [("fi", True)] * 3
    assert language.keep_identified(docs).count() == 6000


def test_no_language_is_left_out(spark):
    rows = [(i, f"{chr(0x4E00 + i % 70) * 5} text", f"l{i % 70}") for i in range(140)]
    names, table = language.fit(spark.createDataFrame(rows, "doc_id long, text string, label string"))
    assert names == sorted({r[2] for r in rows})
    assert table.shape == (language.BUCKETS, 71)


def test_scores_do_not_depend_on_the_slab(monkeypatch):
    rng = np.random.default_rng(1)
    table = rng.random((language.BUCKETS, 3), np.float32)
    texts = [EN * k for k in (3, 0, 1, 20, 2)] + ["", "x", FI]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([{"i": i} for i in range(len(texts))])], names=["text", "_evidence"])
    want = []
    for t in texts:
        grams = language.trigram_buckets(np.frombuffer(b" " + t.lower().encode() + b" ", np.uint8)) if t else []
        want.append(table[grams].sum(0, dtype=np.float64) if len(grams) else np.zeros(3))
    for cells in (30, 600, 1 << 21):
        monkeypatch.setattr(language, "SLAB_CELLS", cells)
        (got,) = language._score(table)([batch])
        np.testing.assert_allclose(np.array(got.column("loglik").to_pylist()), np.array(want), rtol=1e-5)
