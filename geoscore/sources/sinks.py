"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "error") -> None:
    """CSV (with header) or any other file format Spark writes."""
    writer = df.write.mode(mode).format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def write_chunked(df: DataFrame, path: str, rows: int, fmt: str = "csv", mode: str = "error") -> None:
    """No output file with more than ``rows`` rows."""
    writer = df.write.mode(mode).format(fmt).option("maxRecordsPerFile", rows)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def snapshot(df: DataFrame, path: str, mode: str = "error") -> DataFrame:
    """Save an intermediate table and go on from the saved copy, which also ends its lineage."""
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
