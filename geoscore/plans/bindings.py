"""The test tables seen as the library's inputs.

Measures are whole numbers held as doubles, so sums are exact and do not depend on the order rows are added in.
Each binding is one dictionary of expressions that both engines read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from geoscore.operators.spatial import box_rings
from geoscore.plans.composites import classified_days, daily_by_location
from geoscore.plans.registry import bound, bound_sql, table

STATION_DAY = {
    "stnid": "l_suppkey",
    "date": "CAST(l_shipdate AS DATE)",
    "temp": "CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity - 18 END",
    "temp_min": "CASE WHEN l_orderkey % 5 <> 0 THEN l_quantity - 18 - l_linenumber END",
    "temp_max": "CASE WHEN l_orderkey % 11 <> 0 THEN l_quantity - 18 + 2 * l_linenumber END",
    "wdsp": "CASE WHEN l_orderkey % 17 <> 0 THEN round(l_discount * 100) END",
    "rh": "CASE WHEN l_orderkey % 13 <> 0 THEN round(l_tax * 1000) END",
    "prcp": "CASE WHEN l_orderkey % 3 <> 0 THEN CAST(floor(l_extendedprice / 10000) AS DOUBLE) END",
    "sndp": "CASE WHEN l_returnflag = 'A' THEN CAST(l_linenumber * 10 AS DOUBLE) END",
    "i_rain_drizzle": "CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS DOUBLE)",
    "i_snow_ice": "CAST(CASE WHEN l_linestatus = 'F' AND l_linenumber = 7 THEN 1 ELSE 0 END AS DOUBLE)",
}
METRICS = ["temp_max", "temp_min", "temp_mean", "wdsp", "prcp", "sndp", "i_rain_drizzle", "i_snow_ice", "rh"]

CUSTOMER_POINT = {
    "cid": "c_custkey", "nation": "c_nationkey", "segment": "c_mktsegment", "bal": "c_acctbal",
    "lon": "CAST((c_custkey * 37) % 3600 AS DOUBLE) / 10 - 180",
    "lat": "CAST((c_custkey * 53) % 1800 AS DOUBLE) / 10 - 90",
}
SUPPLIER_POINT = {
    "sid": "s_suppkey", "s_nation": "s_nationkey", "s_bal": "s_acctbal",
    "lon": "CAST((s_suppkey * 41 + 7) % 3600 AS DOUBLE) / 10 - 180",
    "lat": "CAST((s_suppkey * 59 + 3) % 1800 AS DOUBLE) / 10 - 90",
}
# One box per nation on a 5 by 5 grid, with gaps between the boxes.
NATION_BOX = {
    "nation_id": "n_nationkey", "nation_name": "n_name", "region_key": "n_regionkey",
    "x0": "CAST(-180 + (n_nationkey % 5) * 72 AS DOUBLE)",
    "x1": "CAST(-180 + (n_nationkey % 5) * 72 + 60 AS DOUBLE)",
    "y0": "CAST(-90 + CAST(floor(n_nationkey / 5) AS INT) * 36 AS DOUBLE)",
    "y1": "CAST(-90 + CAST(floor(n_nationkey / 5) AS INT) * 36 + 30 AS DOUBLE)",
}
# A supplier's days with one value a day, for the gap-filling queries.
SUPPLIER_DAY_SQL = """
SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS qty,
       CAST(year(l_shipdate) AS INT) AS year, CAST(dayofyear(l_shipdate) AS INT) AS yday,
       CASE WHEN (l_suppkey + dayofyear(l_shipdate) + year(l_shipdate)) % 7 <> 0 THEN sum(l_quantity) END AS value
FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE), year(l_shipdate), dayofyear(l_shipdate)
"""


def station_days(spark: SparkSession, sf: str) -> DataFrame:
    return bound(table(spark, sf, "lineitem"), STATION_DAY)


def station_places(spark: SparkSession, sf: str, place: str = "s_nationkey") -> DataFrame:
    """Station to location; by nation, (through the nation table) by region, or each station by itself."""
    if place == "stnid":
        return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("stnid"), F.col("s_suppkey").alias("place"))
    stations = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("stnid"), "s_nationkey")
    if place == "s_nationkey":
        return stations.withColumnRenamed("s_nationkey", "place")
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("place"))
    return stations.join(nations, "s_nationkey").drop("s_nationkey")


def daily(spark: SparkSession, sf: str, place: str = "s_nationkey") -> DataFrame:
    days = station_days(spark, sf).withColumnRenamed("temp", "temp_mean")
    return daily_by_location(days, station_places(spark, sf, place), "place", "stnid", "date", METRICS)


def class_days(spark: SparkSession, sf: str, place: str = "s_nationkey") -> DataFrame:
    return classified_days(daily(spark, sf, place))


def supplier_days(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    day = F.col("l_shipdate").cast("date")
    return (
        lines.groupBy(F.col("l_suppkey").alias("entity"), day.alias("date")).agg(F.sum("l_quantity").alias("qty"))
        .withColumns({"year": F.year("date"), "yday": F.dayofyear("date")})
        .withColumn("value", F.when((F.col("entity") + F.col("yday") + F.col("year")) % 7 != 0, F.col("qty")))
    )


def customers(spark: SparkSession, sf: str) -> DataFrame:
    return bound(table(spark, sf, "customer"), CUSTOMER_POINT)


def suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return bound(table(spark, sf, "supplier"), SUPPLIER_POINT)


def nation_boxes(spark: SparkSession, sf: str) -> DataFrame:
    boxes = bound(table(spark, sf, "nation"), NATION_BOX)
    return boxes.withColumn("rings", box_rings(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]))


WX_SQL = "wx AS (" + bound_sql("lineitem", STATION_DAY) + ")"
CUST_SQL = "cust AS (" + bound_sql("customer", CUSTOMER_POINT) + ")"
SUPP_SQL = "supp AS (" + bound_sql("supplier", SUPPLIER_POINT) + ")"
BOX_SQL = "box AS (" + bound_sql("nation", NATION_BOX) + ")"
SDAY_SQL = f"sday AS ({SUPPLIER_DAY_SQL})"


def daily_sql(place: str = "s_nationkey") -> str:
    """Common tables ``wx``, ``raw_daily`` and ``daily``."""
    source = "wx JOIN supplier ON stnid = s_suppkey"
    key = "s_nationkey"
    if place == "stnid":
        source, key = "wx", "stnid"
    elif place != "s_nationkey":
        source, key = source + " JOIN nation ON s_nationkey = n_nationkey", "n_regionkey"
    means = ", ".join(f"avg({'temp' if m == 'temp_mean' else m}) AS {m}" for m in METRICS)
    return (
        f"{WX_SQL}, raw_daily AS (SELECT {key} AS place, date, {means} FROM {source} GROUP BY 1, 2), "
        "half AS (SELECT * REPLACE (coalesce(temp_max, 2*temp_mean - temp_min) AS temp_max) FROM raw_daily), "
        "daily AS (SELECT * REPLACE (coalesce(temp_min, 2*temp_mean - temp_max) AS temp_min) FROM half)"
    )


def fahrenheit_sql(t: str) -> str:
    return f"round_even(1.8::DOUBLE * ({t}) + 32, 2)"


def celsius_sql(f: str) -> str:
    return f"round_even((({f}) - 32) * 5::DOUBLE / 9, 2)"


def heat_index_sql(t: str, rh: str) -> str:
    f, h = fahrenheit_sql(t), f"({rh})"
    full = (
        f"(-42.379::DOUBLE + 2.04901523::DOUBLE*{f} + 10.14333127::DOUBLE*{h} - 0.22475541::DOUBLE*{f}*{h}"
        f" - 6.83783e-3*{f}*{f} - 5.481717e-2*{h}*{h} + 1.22874e-3*{f}*{f}*{h} + 8.5282e-4*{f}*{h}*{h}"
        f" - 1.99e-6*{f}*{f}*{h}*{h})"
    )
    simple = f"(0.5::DOUBLE * (61 + ({f} - 68) * 1.2::DOUBLE + {h} * 0.094::DOUBLE + {f}))"
    index = (
        f"CASE WHEN {f} <= 40 THEN {f} WHEN {simple} > 79 THEN "
        f"CASE WHEN {h} <= 13 AND {f} BETWEEN 80 AND 112 THEN {full} - (13 - {h})/4 * sqrt((17 - abs({f} - 95))/17) "
        f"WHEN {h} > 85 AND {f} BETWEEN 80 AND 87 THEN {full} + ({h} - 85)/10 * ((87 - {f})/5) ELSE {full} END "
        f"ELSE {simple} END"
    )
    return f"(CASE WHEN {h} BETWEEN 0 AND 100 THEN {celsius_sql(index)} END)"


def feels_like_sql(t: str, rh: str = "rh", w: str = "wdsp") -> str:
    f = fahrenheit_sql(t)
    chill = celsius_sql(
        f"35.74::DOUBLE + 0.6215::DOUBLE*{f} - 35.75::DOUBLE*pow({w}, 0.16) + 0.4275::DOUBLE*{f}*pow({w}, 0.16)"
    )
    return (
        f"(CASE WHEN {t} < 10 AND {w} > 3 THEN {chill} WHEN {t} > 27 THEN "
        f"CASE WHEN {rh} IS NULL THEN {t} ELSE {heat_index_sql(t, rh)} END ELSE {t} END)"
    )


def classed_sql(place: str = "s_nationkey", hot_day: int = 28, prcp: int = 5, sndp: int = 50) -> str:
    """Adds ``felt``, ``classed`` (flags, class, degree days) to :func:`daily_sql`."""
    feel = ", ".join(f"{feels_like_sql(t)} AS {t}_feel" for t in ("temp_max", "temp_min", "temp_mean"))
    return daily_sql(place) + f""",
felt AS (SELECT *, {feel} FROM daily),
f1 AS (SELECT *, CASE WHEN temp_min_feel > 18 OR temp_max_feel > {hot_day} THEN 1
                      WHEN NOT (temp_min_feel > 18 OR temp_max_feel > {hot_day}) THEN 0 END AS h0 FROM felt),
f2 AS (SELECT *, CASE WHEN h0 = 0 AND (temp_min_feel < 0 OR temp_max_feel < 12) THEN 1
                      WHEN NOT (h0 = 0 AND (temp_min_feel < 0 OR temp_max_feel < 12)) THEN 0 END AS c0 FROM f1),
f3 AS (SELECT *, CASE WHEN h0 = 0 AND c0 = 0 AND (prcp > {prcp} OR sndp > {sndp} OR i_rain_drizzle >= 0.5 OR i_snow_ice >= 0.5)
                 THEN 1 ELSE 0 END AS elements, coalesce(h0, 0) AS hot, coalesce(c0, 0) AS cold FROM f2),
classed AS (SELECT *, CASE WHEN hot + cold + elements > 0 THEN 0 ELSE 1 END AS pleasant,
  CASE WHEN hot + cold + elements = 0 THEN 'pleasant' WHEN hot = 1 THEN 'hot' WHEN cold = 1 THEN 'cold'
       ELSE 'elements' END AS class,
  {degree_days_sql('temp_min_feel', 'temp_max_feel')} FROM f3)"""


def degree_days_sql(lo: str, hi: str, base: float = 18.0) -> str:
    a, mid = f"(({hi} - {lo})/2)", f"({lo} + ({hi} - {lo})/2 - {base}::DOUBLE)"
    theta = f"acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {mid} / nullif({a}, 0))))"
    crossing = f"(({mid} * (pi() - {theta}) + {a} * sin({theta})) / pi())"
    none = f"{lo} IS NULL OR {hi} IS NULL"
    hot = f"(CASE WHEN {none} THEN NULL WHEN {lo} >= {base} THEN {mid} WHEN {hi} <= {base} THEN 0 ELSE {crossing} END)"
    cold = (f"(CASE WHEN {none} THEN NULL WHEN {lo} >= {base} THEN 0 WHEN {hi} <= {base} THEN -{mid} "
            f"ELSE {crossing} - {mid} END)")
    return (f"round_even({hot}, 2) AS edd_hot, round_even({cold}, 2) AS edd_cold, "
            f"round_even({hot} + {cold}, 2) AS edd_total")
