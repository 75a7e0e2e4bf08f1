"""Fixed-width text: general layouts, the daily-summary record and the station history."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F



@dataclass(frozen=True)
class Field:
    """A column at 1-based, inclusive positions. ``kind`` is a Spark type or ``yyyymmdd``."""

    name: str
    start: int
    end: int
    kind: str = "string"
    missing: tuple[str, ...] = ("",)

    def value(self, line: Column) -> Column:
        text = F.trim(F.substring(line, self.start, self.end - self.start + 1))
        text = F.when(~text.isin(list(self.missing)), text)
        if self.kind == "string":
            return text
        if self.kind == "yyyymmdd":
            return F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date")
        return text.try_cast(self.kind)


# Positions, types and missing codes of the daily-summary record.
DAILY_RECORD = (
    Field("stn", 1, 6), Field("wban", 8, 12), Field("date", 15, 22, "yyyymmdd"),
    Field("temp", 25, 30, "double", ("", "9999.9")), Field("temp_cnt", 32, 33, "int"),
    Field("dewp", 36, 41, "double", ("", "9999.9")), Field("dewp_cnt", 43, 44, "int"),
    Field("slp", 47, 52, "double", ("", "9999.9")), Field("slp_cnt", 54, 55, "int"),
    Field("stp", 58, 63, "double", ("", "9999.9")), Field("stp_cnt", 65, 66, "int"),
    Field("visib", 69, 73, "double", ("", "999.9")), Field("visib_cnt", 75, 76, "int"),
    Field("wdsp", 79, 83, "double", ("", "999.9")), Field("wdsp_cnt", 85, 86, "int"),
    Field("mxspd", 89, 93, "double", ("", "999.9")), Field("gust", 96, 100, "double", ("", "999.9")),
    Field("max", 103, 108, "double", ("", "9999.9")), Field("max_flag", 109, 109),
    Field("min", 111, 116, "double", ("", "9999.9")), Field("min_flag", 117, 117),
    Field("prcp", 119, 123, "double", ("", "99.99")), Field("prcp_flag", 124, 124),
    Field("sndp", 126, 130, "double", ("", "999.9")), Field("frshtt", 133, 138),
)

# Positions of the station history list.
STATION_RECORD = (
    Field("usaf", 1, 6), Field("wban", 8, 12), Field("station", 14, 42), Field("ctry", 44, 47), Field("st", 49, 50),
    Field("call", 52, 56), Field("lat", 58, 64, "double"), Field("lon", 66, 73, "double"),
    Field("elev", 75, 81, "double", ("", "-999.0")), Field("begin", 83, 90, "yyyymmdd"), Field("end", 92, 99, "yyyymmdd"),
)


def parse_fixed_width(lines: DataFrame, layout: Sequence[Field], column: str = "value",
                      record: str | None = None) -> DataFrame:
    """Lines of text to typed columns. ``record`` is the pattern of a data line; header lines do not match it.

    Headers are told by content: a file may be split among tasks, so there are no line numbers to skip by.
    """
    kept = lines if record is None else lines.where(F.col(column).rlike(record))
    return kept.select(*[f.value(F.col(column)).alias(f.name) for f in layout])


def read_fixed_width(spark: SparkSession, paths: str | Sequence[str], layout: Sequence[Field],
                     record: str | None = None) -> DataFrame:
    """Fixed-width files (gzip is read as it is)."""
    return parse_fixed_width(spark.read.text(paths), layout, record=record)


def read_station_history(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Station list; the text before and the title line are left out."""
    return read_fixed_width(spark, paths, STATION_RECORD, r"^[0-9A-Z]{6} [0-9]{5} ")


def read_daily_records(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Daily-summary records with each field's own missing code turned to NULL."""
    return read_fixed_width(spark, paths, DAILY_RECORD, r"^[0-9A-Z]{6} [0-9]{5}")
