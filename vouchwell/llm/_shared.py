"""Small helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

# ASCII white space, the word separator of every word-based operator here.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, a session whose executors are threads of the driver gets a folder
    in its warehouse; a cluster is refused, because its executors could not read each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + f"/vouchwell-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    It cuts the lineage and fixes what was computed, so a lost executor costs no more than the
    tasks that read its part. The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with _small_arrow_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    place, system = _place(spark, path)
    system.deleteOnExit(place)
    for tables in _watched:
        tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of rows that go to a Python task at once; a task holds them on both sides, and as much again
#: while they grow.
ARROW_BYTES = 8 << 20
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def _small_arrow_batches(spark: SparkSession):
    """Batches of ARROW_BYTES at most, while a table is written; the session's own setting after."""
    before = spark.conf.get(_ARROW, None)
    spark.conf.set(_ARROW, str(ARROW_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(_ARROW) if before is None else spark.conf.set(_ARROW, before)


#: Lists that note what is materialised while ``settled`` runs.
_watched: list[list[str]] = []


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def settled(spark: SparkSession, make: Callable[[], DataFrame], tag: str) -> tuple[DataFrame, str]:
    """What ``make`` gives, written, and its folder. The tables materialised on the way there go as
    soon as it is written, so that a long run's steps don't pile up."""
    tables: list[str] = []
    _watched.append(tables)
    try:
        out = materialize(make(), tag)
    finally:
        _watched.remove(tables)
    for path in tables[:-1]:
        discard(spark, path)
    return out, tables[-1]


def discard(spark: SparkSession, path: str) -> None:
    place, system = _place(spark, path)
    system.delete(place, True)


#: Rows that a Python task works on at once, whatever the size of Arrow's batches.
ROWS_AT_ONCE = 1000


def give_back() -> None:
    """Free memory of a Python worker goes back to the system. Workers outlive their tasks, and those
    that wait would hold what their largest task took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows: what a task makes of texts in memory is bounded by
    these, and goes back to the system at the end."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        batch = None
    give_back()


def arrow_type(kind: DataType) -> pa.DataType:
    """The Arrow type that a Spark column of this type has in a Python task."""
    return to_arrow_type(kind)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_text(name: str = "text") -> Column:
    """The text with null as the empty string."""
    return F.coalesce(F.col(name), F.lit(""))


def row_key(*names: str) -> Column:
    """A 64-bit key of the named columns; nulls differ from empty strings."""
    parts = [c for n in names for c in (F.col(n), F.col(n).isNull())]
    return F.xxhash64(*parts)


def packed(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and all others in one struct: whatever they are called, they can't
    clash with a name that an operator adds."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in needed]
    return docs.select(*needed, F.struct(F.lit(True).alias("_any"), *rest).alias("_rest"))


def unpacked(docs: DataFrame, *needed: str) -> list[Column]:
    """What selects the columns of ``docs`` again, in their order, from a packed frame."""
    return [F.col(c) if c in needed else F.col("_rest").getField(c).alias(c) for c in docs.columns]
