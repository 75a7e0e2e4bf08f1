"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from geoscore.session import scratch_path

# What separates words: a space and the control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a table that this package wrote to the shared folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Tables:
    """Tables written to the shared folder, so that lost executors cost nothing that was already worked out."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}

    def store(self, df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(self.spark, f"llm-{label}-{uuid.uuid4().hex[:6]}")
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *stored: DataFrame) -> None:
        for df in stored:
            path = self.paths.pop(id(df), None)
            if path:
                drop_path(self.spark, path)

    def keep_only(self, *stored: DataFrame) -> None:
        """Remove all tables but those that the caller's lazy result still reads."""
        for key in [k for k in self.paths if k not in {id(df) for df in stored}]:
            drop_path(self.spark, self.paths.pop(key))


@contextmanager
def tables(spark: SparkSession) -> Iterator[Tables]:
    """Removes its tables if the block fails; otherwise the block says which to keep."""
    own = Tables(spark)
    try:
        yield own
    except BaseException:
        own.keep_only()
        raise


def by_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``fn`` over Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def grouped_by_size(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` characters in all, so that what is held at once is bounded by one text."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > most:
            yield first, i
            first, held = i, 0
        held += len(text)
    if first < len(texts):
        yield first, len(texts)
