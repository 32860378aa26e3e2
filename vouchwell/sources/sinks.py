"""Writing results: briefs as text, tables by condition, records as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame

from vouchwell.operators.brief import reject_violations, render


def write_briefs(briefs: DataFrame, path: str) -> None:
    """One text record per brief. A brief that holds sendable text fails the write."""
    render(reject_violations(briefs)).select("text").write.option("lineSep", "\n\n").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def write_by(rows: DataFrame, column: str, path: str) -> None:
    """Parquet with a folder per value of ``column``, which later reads prune by."""
    rows.write.partitionBy(column).parquet(path)
