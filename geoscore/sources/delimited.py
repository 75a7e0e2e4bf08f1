"""Delimited text and JSON records with declared types."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from geoscore.operators.reshape import stack
from geoscore.session import store_once


def _as_text(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])


def typed(df: DataFrame, schema: T.StructType, null_tokens: Sequence[str] = ("",),
          field_tokens: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Text columns to their declared types: trimmed null tokens and unreadable values become NULL."""
    own = field_tokens or {}
    columns = []
    for f in schema.fields:
        text = F.col(f"`{f.name}`")
        tokens = list(own.get(f.name, null_tokens))
        kept = F.when(~F.trim(text).isin(tokens), text) if tokens else text
        columns.append((kept if isinstance(f.dataType, T.StringType) else F.trim(kept).try_cast(f.dataType)).alias(f.name))
    return df.select(*columns)


def read_table_csv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType,
                   null_tokens: Sequence[str] = ("", "NA"), header: bool = True, sep: str = ",",
                   encoding: str = "UTF-8", trim: bool = False,
                   field_tokens: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Delimited scan. The schema names headerless files too; null tokens may differ per column."""
    raw = (
        spark.read.schema(_as_text(schema))
        .option("header", header).option("sep", sep).option("encoding", encoding).option("mode", "PERMISSIVE")
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", trim).option("ignoreTrailingWhiteSpace", trim)
        .option("enforceSchema", True)
        .csv([paths] if isinstance(paths, str) else list(paths))
    )
    return typed(raw, schema, null_tokens, field_tokens)


def read_columns(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, columns: Sequence[str],
                 **options: object) -> DataFrame:
    """Only some columns of a delimited file; the others are never turned into values."""
    return read_table_csv(spark, paths, schema, **options).select(*columns)


def read_union(spark: SparkSession, sources: Mapping[str, T.StructType], **options: object) -> DataFrame:
    """Files with differing columns, stacked by name."""
    return stack(*[read_table_csv(spark, path, schema, **options) for path, schema in sources.items()])


def read_tsv_latin1(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType,
                    columns: Sequence[str] | None = None, header: bool = False,
                    null_tokens: Sequence[str] = ("",)) -> DataFrame:
    """Tab-separated Latin-1 text, values trimmed, unwanted columns skipped."""
    table = read_table_csv(spark, paths, schema, null_tokens, header, "\t", "ISO-8859-1", trim=True)
    return table.select(*columns) if columns else table


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark)))


def _nesting(text: Column) -> Column:
    """How many more brackets a text opens than it closes, strings left out; it begins outside a string."""
    bare = F.regexp_replace(text, r'"[^"]*(?:"|\z)', "")
    return _count(bare, "{") + _count(bare, "[") - _count(bare, "]")


def read_json_array(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """Objects of JSON arrays, however large one array is: files are split, and records cut where a top-level object ends.

    Files are read as pieces that end in ``}``. Whether a piece begins inside a string, and how deep it is nested, follows
    from sums over the pieces before it: inside each split of a file, and over the splits (one row each). Pieces up to the
    closing of a top-level object are one record; a record may cross from one split into the next. A file may hold several
    arrays one after another. Text is UTF-8. A record that does not fit the schema becomes NULLs, as Spark's reader has it.
    Rows come in no order.
    """
    raw = spark.read.option("lineSep", "}").text([paths] if isinstance(paths, str) else list(paths)).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"),
    )
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    # Past the first quote of a piece that begins inside a string.
    after = F.regexp_replace("plain", r'\A[^"]*(?:"|\z)', "")
    pieces = store_once(raw.withColumn("plain", plain).select(
        "file", "split", "row", "value", (_count(F.col("plain"), '"') % 2).cast("int").alias("odd"),
        _nesting(F.col("plain")).alias("deeper"), _nesting(after).alias("deeper_inside"),
    ), "pieces")
    here = Window.partitionBy("file", "split").orderBy("row")
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)

    def ahead(rows: DataFrame, column: str) -> DataFrame:
        """``column`` summed over all pieces before each one, in all splits of its file."""
        sums = rows.groupBy("file", "split").agg(F.sum(column).alias("_all")).select(
            "file", "split", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_ahead")
        )
        return rows.join(sums, ["file", "split"]).withColumn("_ahead", F.col("_ahead") + F.coalesce(F.sum(column).over(before), F.lit(0)))

    inside = F.col("_ahead") % 2 == 1
    quoted = ahead(pieces, "odd").withColumn("closes", (F.col("_ahead") + F.col("odd")) % 2 == 0).withColumn(
        # A piece ends in a bracket that closes, unless it ends inside a string.
        "net", F.when(inside, F.col("deeper_inside")).otherwise(F.col("deeper")) - F.col("closes").cast("int")
    ).drop("_ahead", "odd", "deeper", "deeper_inside")
    nested = ahead(store_once(quoted, "quoted"), "net")
    ended = nested.withColumn("ends", (F.col("closes") & (F.col("_ahead") + F.col("net") == 1)).cast("int")).drop("_ahead", "net", "closes")
    numbered = ahead(store_once(ended, "ended"), "ends").withColumnRenamed("_ahead", "record")
    records = numbered.groupBy("file", "record").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("split", "row", "value"))), lambda p: p["value"]), "}").alias("text"),
        F.max("ends").alias("whole"),
    ).where("whole = 1")
    body = F.concat(F.regexp_replace("text", r"\A[\s\[\],]*", ""), F.lit("}"))
    return records.select(F.from_json(body, schema).alias("record")).select("record.*")


def read_json_records(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType,
                      one_per_line: bool = False) -> DataFrame:
    """JSON objects: an array per file, or one object per line (which lets Spark split large files).

    An array is read by one task per file, in order; :func:`read_json_array` splits large ones.
    """
    return spark.read.schema(schema).option("multiLine", not one_per_line).json(
        [paths] if isinstance(paths, str) else list(paths)
    )
