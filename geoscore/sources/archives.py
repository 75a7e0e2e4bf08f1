"""Station files per year, and yearly archives of them."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from geoscore.sources.delimited import typed

YEAR_FOLDER = r"/(\d{4})/([^/]+)\.csv(?:\.gz)?$"  # {root}/{year}/{station}.csv
_LINES_PER_BATCH = 50_000
MOST_IDS = 100_000  # wanted stations whose files are named one by one


def read_station_years(spark: SparkSession, root: str, years: Sequence[int], schema: T.StructType,
                       stations: DataFrame | Sequence[str], layout: str = YEAR_FOLDER,
                       folder: str = "{root}/{year}/*.csv", header: bool = True,
                       null_tokens: Sequence[str] = ("", "NA"), most: int = MOST_IDS) -> DataFrame:
    """Rows of the wanted years and stations, with ``year`` and ``station`` from the file's path.

    Only the wanted years' folders are listed, and only the files of wanted stations are read: Spark leaves the others out
    by their paths while it plans. ``layout`` finds year and station in a path; ``stations`` is a list or a one-column table
    of ids. A table of up to ``most`` ids is looked up first; of a longer one, rows are kept by a semi-join instead.
    """
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = (
        spark.read.schema(text).option("header", header).option("recursiveFileLookup", True)
        .csv([folder.format(root=root, year=y) for y in years])
        .withColumn("_path", F.col("_metadata.file_path"))
    )
    keyed = raw.withColumns({
        "year": F.regexp_extract("_path", layout, 1).cast("int"), "station": F.regexp_extract("_path", layout, 2),
    })
    if isinstance(stations, DataFrame):
        wanted = stations.toDF("station").distinct()
        # The driver holds the list of all files anyway; the ids of a station catalogue are fewer.
        found = wanted.where("station IS NOT NULL").limit(most + 1).collect()
        names = [str(r["station"]) for r in found] if len(found) <= most else None
        kept = keyed.join(wanted, "station", "left_semi") if names is None else keyed.where(F.col("station").isin(names))
    else:
        kept = keyed.where(F.col("station").isin(list(stations)))
    full = T.StructType([T.StructField("year", T.IntegerType()), T.StructField("station", T.StringType()), *schema.fields])
    return typed(kept.withColumn("year", F.col("year").cast("string")), full, null_tokens)


def _members(content: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """Runs of lines of all text members of one archive, in order, without unpacking it to disk: the member's name, the
    number of the run's first line, the lines."""
    with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as archive:
        for member in archive:
            if member.isfile():
                text, number = io.TextIOWrapper(archive.extractfile(member), encoding="utf-8", errors="replace"), 1
                while lines := list(islice(text, _LINES_PER_BATCH)):
                    yield member.name, number, [line.rstrip("\r\n") for line in lines]
                    number += len(lines)


def _batch(path: str, runs: list[tuple[str, int, list[str]]]) -> pa.RecordBatch:
    """The columns of some runs of one archive; names are written once per run and spread by number."""
    sizes = np.array([len(lines) for _, _, lines in runs], np.int64)
    rows = int(sizes.sum())
    of_run = pa.array(np.repeat(np.arange(len(runs)), sizes))
    starts = np.array([first for _, first, _ in runs], np.int64) - (np.cumsum(sizes) - sizes)
    return pa.RecordBatch.from_arrays([
        pa.array([path], pa.string()).take(pa.array(np.zeros(rows, np.int64))),
        pa.array([name for name, _, _ in runs], pa.string()).take(of_run),
        pa.array((np.repeat(starts, sizes) + np.arange(rows)).astype(np.int32)),
        pa.array([line for _, _, lines in runs for line in lines], pa.string()),
    ], names=["archive", "member", "line_no", "line"])


def expand_archive_rows(archives: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One row per line of every member of every archive: ``archive, member, line_no, line``."""
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column(0), batch.column(1)):
                runs: list[tuple[str, int, list[str]]] = []
                held = 0
                for run in _members(body.as_py()):
                    runs.append(run)
                    held += len(run[2])
                    if held >= _LINES_PER_BATCH:
                        yield _batch(name.as_py(), runs)
                        runs, held = [], 0
                if runs:
                    yield _batch(name.as_py(), runs)

    return archives.select(path, content).mapInArrow(
        lines, "archive string, member string, line_no int, line string"
    )


def expand_archives(spark: SparkSession, pattern: str) -> DataFrame:
    """Archives matching a path pattern (tar, tar.gz), one archive per task at the most fine."""
    return expand_archive_rows(spark.read.format("binaryFile").load(pattern).select("path", "content"))
