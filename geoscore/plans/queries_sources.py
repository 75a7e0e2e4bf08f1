"""Readers and writers: tables are written in the reference's file forms to the shared folder and read back."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from geoscore.operators.spatial import box_rings
from geoscore.plans.bindings import NATION_BOX
from geoscore.plans.registry import bound, query, table
from geoscore.session import scratch_path
from geoscore.sources import archives, delimited, fixed_width, polygons, sinks

CUSTOMER = T.StructType([
    T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()), T.StructField("c_nationkey", T.IntegerType()),
    T.StructField("c_acctbal", T.DoubleType()), T.StructField("c_mktsegment", T.StringType()),
])


@query("csv_scan", """SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_nationkey <> 3 THEN c_acctbal END AS c_acctbal,
CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS c_mktsegment FROM customer""")
def csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    """No header, names from the schema, one null token for all columns and another for one."""
    path = scratch_path(spark, "csv")
    marked = table(spark, sf, "customer").withColumns({
        "c_acctbal": F.when(F.col("c_nationkey") == 3, "-999.0").otherwise(F.col("c_acctbal").cast("string")),
        "c_mktsegment": F.when(F.col("c_mktsegment") == "BUILDING", "\\N").otherwise(F.col("c_mktsegment")),
    })
    marked.write.option("escape", '"').csv(path)
    return delimited.read_table_csv(
        spark, path, CUSTOMER, null_tokens=("", "\\N"), header=False, field_tokens={"c_acctbal": ("", "-999.0")}
    )


@query("read_union", """SELECT c_custkey AS id, c_acctbal AS bal, c_mktsegment AS segment, NULL::INT AS nation FROM customer
UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_nationkey FROM supplier""")
def read_union(spark: SparkSession, sf: str) -> DataFrame:
    a, b = scratch_path(spark, "union"), scratch_path(spark, "union")
    sinks.write_table(table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_acctbal AS bal", "c_mktsegment AS segment"), a)
    sinks.write_table(table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_nationkey AS nation", "s_acctbal AS bal"), b)
    return delimited.read_union(spark, {
        a: T.StructType.fromDDL("id BIGINT, bal DOUBLE, segment STRING"), b: T.StructType.fromDDL("id BIGINT, nation INT, bal DOUBLE"),
    })


def daily_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as daily-summary records."""
    def put(text: Column, width: int) -> Column:
        return F.lpad(text, width, " ")

    q, n, key = F.col("l_quantity"), F.col("l_linenumber"), F.col("l_orderkey")
    missing = F.lit("9999.9")
    temp = F.when(key % 7 == 0, missing).otherwise(F.format_string("%.1f", q))
    low = F.when(key % 5 == 0, missing).otherwise(F.format_string("%.1f", q - n))
    rain = F.when(key % 3 == 0, "99.99").otherwise(F.format_string("%.2f", n.cast("double") / 4))
    line = F.concat(
        F.lpad(F.col("l_suppkey").cast("string"), 6, "0"), F.lit(" "), F.lpad(F.col("l_partkey").cast("string"), 5, "0"), F.lit("  "),
        F.date_format(F.col("l_shipdate").cast("date"), "yyyyMMdd"), F.lit("  "),  # 1-24
        put(temp, 6), F.lit(" "), put(n.cast("string"), 2), F.lit("  "),  # 25-35
        put(missing, 6), F.lit("  0  "), put(missing, 6), F.lit("  0  "), put(missing, 6), F.lit("  0  "),  # 36-68
        F.lit(" 999.9  0  "), put(F.format_string("%.1f", n.cast("double")), 6), F.lit("  8  "),  # 69-89
    )
    return table(spark, sf, "lineitem").select(
        F.concat(
            F.rpad(line, 88, " "), F.lit("999.9  999.9  "), put(F.format_string("%.1f", q + n), 6), F.lit("* "), put(low, 6), F.lit("  "),
            put(rain, 5), F.substring(F.lit("ABCDEFGHI"), n, F.lit(1)), F.lit(" 999.9  010000"),
        ).alias("value")
    )


@query("fixed_width", """SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS stn, lpad(CAST(l_partkey AS VARCHAR), 5, '0') AS wban, CAST(l_shipdate AS DATE) AS date,
CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS temp, l_linenumber AS temp_cnt, NULL::DOUBLE AS dewp, CAST(l_linenumber AS DOUBLE) AS wdsp,
l_quantity + l_linenumber AS max, '*' AS max_flag, CASE WHEN l_orderkey % 5 <> 0 THEN l_quantity - l_linenumber END AS min,
CASE WHEN l_orderkey % 3 <> 0 THEN round(l_linenumber / 4, 2) END AS prcp, substr('ABCDEFGHI', l_linenumber, 1) AS prcp_flag, '010000' AS frshtt FROM lineitem""")
def fixed_width_query(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "op")
    title = spark.range(1).select(F.lit("STN--- WBAN   YEARMODA    TEMP       DEWP      SLP").alias("value"))
    title.unionByName(daily_lines(spark, sf)).write.option("compression", "gzip").text(path)
    return fixed_width.read_daily_records(spark, path).select(
        "stn", "wban", "date", "temp", "temp_cnt", "dewp", "wdsp", "max", "max_flag", "min", "prcp", "prcp_flag", "frshtt"
    )


@query("station_history", """SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS usaf, s_name AS station, 'US' AS ctry,
round((s_suppkey * 59 + 3) % 180 - 90, 3)::DOUBLE AS lat, CASE WHEN s_suppkey % 9 <> 0 THEN CAST(s_nationkey * 10 AS DOUBLE) END AS elev,
CAST(DATE '1990-01-01' + CAST(s_suppkey % 365 AS INT) AS DATE) AS begin, CASE WHEN s_suppkey % 5 <> 0 THEN DATE '2018-12-31' END AS "end" FROM supplier""")
def station_history(spark: SparkSession, sf: str) -> DataFrame:
    """A station list with text and a title before its records, blank and coded missing values."""
    path = scratch_path(spark, "history")
    key = F.col("s_suppkey")
    put = lambda c, width: F.rpad(c.cast("string"), width, " ")
    line = F.concat(
        F.lpad(key.cast("string"), 6, "0"), F.lit(" 99999 "), put(F.col("s_name"), 29), F.lit(" US   CA KXXX  "),
        F.format_string("%+07.3f", ((key * 59 + 3) % 180 - 90).cast("double")), F.lit(" "), F.format_string("%+08.3f", key.cast("double") % 180), F.lit(" "),
        F.when(key % 9 == 0, "-999.0 ").otherwise(F.format_string("%+07.1f", (F.col("s_nationkey") * 10).cast("double"))), F.lit(" "),
        F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), (key % 365).cast("int")), "yyyyMMdd"), F.lit(" "), F.when(key % 5 == 0, " " * 8).otherwise("20181231"),
    )
    head = spark.createDataFrame([("Integrated Surface Database Station History",), ("",), ("USAF   WBAN  STATION NAME",)], "value string")
    head.unionByName(table(spark, sf, "supplier").select(line.alias("value"))).write.text(path)
    return fixed_width.read_station_history(spark, path).select("usaf", "station", "ctry", "lat", "elev", "begin", "end")


@query("station_years", """SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(c_nationkey AS VARCHAR) AS station, o_orderkey AS id, o_totalprice AS price
FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) BETWEEN 1996 AND 1998 AND c_nationkey < 10""")
def station_years(spark: SparkSession, sf: str) -> DataFrame:
    """Files in folders by year and station; only the wanted years are listed and only the wanted stations' files read."""
    path = scratch_path(spark, "stations")
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("station"))
    filed = table(spark, sf, "orders").join(people, "o_custkey").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.year("o_orderdate").alias("year"), "station"
    )
    filed.repartition("year", "station").write.partitionBy("year", "station").option("header", True).csv(path)
    wanted = table(spark, sf, "nation").where("n_nationkey < 10").select(F.col("n_nationkey").cast("string"))
    return archives.read_station_years(
        spark, path, [1996, 1997, 1998], T.StructType.fromDDL("id BIGINT, price DOUBLE"), wanted,
        layout=r"/year=(\d+)/station=([^/]+)/", folder="{root}/year={year}/*",
    )


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each batch of lines as one small archive with a member per station."""
    for number, batch in enumerate(batches):
        body = io.BytesIO()
        with tarfile.open(fileobj=body, mode="w:gz") as archive:
            for station, lines in batch.groupby("station")["line"]:
                data = "\n".join(lines).encode()
                info = tarfile.TarInfo(f"{station}.op")
                info.size = len(data)
                archive.addfile(info, io.BytesIO(data))
        yield pd.DataFrame({"path": [f"archive-{number}"], "content": [body.getvalue()]})


@query("expand_archives", """SELECT 's' || l_suppkey || '.op' AS member, l_orderkey, l_partkey, l_quantity FROM lineitem""")
def expand_archives(spark: SparkSession, sf: str) -> DataFrame:
    """Lines packed into archives by Spark tasks and expanded again."""
    lines = table(spark, sf, "lineitem").select(
        F.concat(F.lit("s"), "l_suppkey").alias("station"), F.concat_ws(",", "l_orderkey", "l_partkey", "l_quantity").alias("line")
    )
    # A station's lines lie together, so that a member holds many of them; a long station spans ranges and archives.
    together = lines.repartitionByRange("station", "line").sortWithinPartitions("station")
    packed = together.mapInPandas(_packed, "path string, content binary")
    field = F.split("line", ",")
    return archives.expand_archive_rows(packed).select(
        "member", field[0].cast("bigint").alias("l_orderkey"), field[1].cast("bigint").alias("l_partkey"), field[2].cast("double").alias("l_quantity")
    )


@query("json_records", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def json_records(spark: SparkSession, sf: str) -> DataFrame:
    """Arrays of up to 1,000 objects each, written by key range and read back."""
    path = scratch_path(spark, "json")
    wanted = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    wanted.groupBy((F.col("c_custkey") / 1000).cast("bigint").alias("range")).agg(
        F.to_json(F.collect_list(F.struct(*wanted.columns))).alias("value")
    ).select("value").write.text(path)
    return delimited.read_json_array(spark, path, wanted.schema)


@query("json_lines", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def json_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "json")
    wanted = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    wanted.write.json(path)
    return delimited.read_json_records(spark, path, wanted.schema, one_per_line=True)


@query("tsv_latin1", "SELECT s_suppkey, 'Málaga ' || s_name AS s_name, s_acctbal FROM supplier")
def tsv_latin1(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "tsv")
    named = table(spark, sf, "supplier").select(
        "s_suppkey", F.concat(F.lit("  Málaga "), "s_name", F.lit(" ")).alias("s_name"), "s_nationkey", "s_acctbal"
    )
    named.write.option("sep", "\t").option("encoding", "ISO-8859-1").option("ignoreLeadingWhiteSpace", False) \
        .option("ignoreTrailingWhiteSpace", False).csv(path)
    return delimited.read_tsv_latin1(
        spark, path, T.StructType.fromDDL("s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE"), ["s_suppkey", "s_name", "s_acctbal"]
    )


@query("polygons", "SELECT n_nationkey AS nation_id, n_name AS nation_name, " + NATION_BOX["x0"] + " AS xmin, " + NATION_BOX["y1"] + " AS ymax, 5 AS points FROM nation")
def polygons_query(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "features")
    boxes = bound(table(spark, sf, "nation"), NATION_BOX)
    outlined = boxes.withColumn("rings", box_rings(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]))
    outlined.select(polygons.feature_json(["nation_id", "nation_name"])).write.text(path)
    read = polygons.read_polygons(spark, path, T.StructType.fromDDL("nation_id INT, nation_name STRING"))
    ring = F.col("rings")[0]
    return read.select(
        "nation_id", "nation_name", F.array_min(F.transform(ring, lambda p: p["x"])).alias("xmin"),
        F.array_max(F.transform(ring, lambda p: p["y"])).alias("ymax"), F.size(ring).alias("points"),
    )


@query("write_chunked", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def write_chunked(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "chunks")
    wanted = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    sinks.write_chunked(wanted, path, 4000)
    return delimited.read_table_csv(spark, path, wanted.schema)


@query("subset_scan", "SELECT c_custkey, c_acctbal FROM customer")
def subset_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "subset")
    sinks.write_table(table(spark, sf, "customer"), path)
    return delimited.read_columns(spark, path, CUSTOMER, ["c_custkey", "c_acctbal"])


@query("write_table", "SELECT p_partkey, p_name, p_retailprice FROM part")
def write_table(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "table")
    wanted = table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice")
    sinks.write_table(wanted, path)
    return delimited.read_table_csv(spark, path, wanted.schema)


@query("snapshot", "SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS date FROM orders")
def snapshot(spark: SparkSession, sf: str) -> DataFrame:
    closed = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("date"))
    return sinks.snapshot(closed, scratch_path(spark, "snapshot"))
