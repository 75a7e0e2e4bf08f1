"""Plain verbs, text, dates, coded fields and day classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from geoscore.functions import binning as B, dates as D, geo as G, gsod as N, text as H
from geoscore.functions.weather import day_curve, excess_degree_days, excess_degree_hours, heat_index
from geoscore.operators import classify as C, columns as P, rank as R
from geoscore.operators.classify import WORLD_LIMITS
from geoscore.operators.impute import missing_flag
from geoscore.operators.series import hourly_expand
from geoscore.plans.bindings import (
    CUST_SQL, WX_SQL, class_days, classed_sql, customers, daily, daily_sql, degree_days_sql, feels_like_sql,
    heat_index_sql, station_days,
)
from geoscore.plans.composites import classified_days, felt
from geoscore.plans.registry import query, r, rounded, table


# --- plain verbs -----------------------------------------------------------------------------------------------

@query("project", "SELECT s_nationkey AS nation, s_suppkey AS supplier, s_name AS name FROM supplier")
def project(spark: SparkSession, sf: str) -> DataFrame:
    renamed = table(spark, sf, "supplier").withColumnsRenamed({"s_nationkey": "nation", "s_suppkey": "supplier", "s_name": "name"})
    return renamed.drop("s_acctbal").select("nation", "supplier", "name")


@query("lower_names", "SELECT r_regionkey AS regionkey, r_name AS regionname FROM region")
def lower_names(spark: SparkSession, sf: str) -> DataFrame:
    return P.lower_names(table(spark, sf, "region").toDF("REGIONKEY", "RegionName"))


@query("clean_names", """SELECT n_nationkey AS region_id, n_name AS region_name, n_regionkey AS region_name_2 FROM nation""")
def clean_names(spark: SparkSession, sf: str) -> DataFrame:
    return P.clean_names(table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("RegionID"), F.col("n_name").alias("Region Name"), F.col("n_regionkey").alias("region_name")
    ))


@query("derived", """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity,
  round(CAST(round(l_extendedprice*100) AS BIGINT) * (100 - CAST(round(l_discount*100) AS BIGINT)) / 10000.0::DOUBLE, 6) AS net FROM lineitem""")
def derived(spark: SparkSession, sf: str) -> DataFrame:
    net = F.round(F.col("l_extendedprice") * 100).cast("bigint") * (100 - F.round(F.col("l_discount") * 100).cast("bigint"))
    return table(spark, sf, "lineitem").withColumns({"net": r(net / F.lit(10000.0))}).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "net"
    )


@query("filter_nulls", f"""WITH {WX_SQL} SELECT stnid, date, temp, prcp FROM wx
WHERE temp IS NOT NULL AND (prcp > 5 OR prcp IS NULL) AND NOT (temp < 0)""")
def filter_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return station_days(spark, sf).where(
        F.col("temp").isNotNull() & ((F.col("prcp") > 5) | F.col("prcp").isNull()) & ~(F.col("temp") < 0)
    ).select("stnid", "date", "temp", "prcp")


@query("bbox_filter", f"""WITH {CUST_SQL} SELECT cid, lon, lat FROM cust WHERE lon BETWEEN -125.0011 AND -66.9326 AND lat BETWEEN 24.9493 AND 49.5904""")
def bbox_filter(spark: SparkSession, sf: str) -> DataFrame:
    lower_48 = (-125.0011, 24.9493, -66.9326, 49.5904)
    return customers(spark, sf).where(G.in_box(F.col("lon"), F.col("lat"), lower_48)).select("cid", "lon", "lat")


@query("membership", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def membership(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_mktsegment")


@query("pattern_filter", r"SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(red|blue) .*t$') AND contains(p_type, 'S')")
def pattern_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where(F.col("p_name").rlike("^(red|blue) .*t$") & F.col("p_type").contains("S")).select("p_partkey", "p_name")


@query("safe_cast", "SELECT p_partkey, TRY_CAST(substr(p_brand, 7) AS INT) AS brand_no, TRY_CAST(p_name AS DOUBLE) AS none FROM part")
def safe_cast(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        "p_partkey", F.expr("substring(p_brand, 7)").try_cast("int").alias("brand_no"), F.col("p_name").try_cast("double").alias("none")
    )


@query("across", f"WITH {WX_SQL} SELECT stnid, date, temp*2 AS temp, wdsp*2 AS wdsp, rh*2 AS rh FROM wx")
def across(spark: SparkSession, sf: str) -> DataFrame:
    return P.across(station_days(spark, sf).select("stnid", "date", "temp", "wdsp", "rh"), ["temp", "wdsp", "rh"], lambda c: c * 2)


@query("fill_null", f"WITH {WX_SQL} SELECT stnid, date, coalesce(prcp, 0) AS prcp, coalesce(sndp, 0) AS sndp, temp FROM wx")
def fill_null(spark: SparkSession, sf: str) -> DataFrame:
    return P.fill_null(station_days(spark, sf).select("stnid", "date", "prcp", "sndp", "temp"), {"prcp": 0, "sndp": 0})


@query("nan_to_null", """SELECT p_partkey, CASE WHEN p_size % 3 <> 0 AND p_size % 5 <> 0 THEN CAST(p_size AS DOUBLE) END AS v FROM part""")
def nan_to_null(spark: SparkSession, sf: str) -> DataFrame:
    v = F.when(F.col("p_size") % 3 == 0, F.lit(float("nan"))).when(F.col("p_size") % 5 == 0, F.lit(float("-inf"))) \
        .otherwise(F.col("p_size").cast("double"))
    return P.nan_to_null(table(spark, sf, "part").select("p_partkey", v.alias("v")))


@query("any_null_flag", f"""WITH {WX_SQL} SELECT stnid, date, temp, prcp, rh,
CASE WHEN temp IS NULL OR prcp IS NULL OR rh IS NULL THEN 1 ELSE 0 END AS is_na FROM wx""")
def any_null_flag(spark: SparkSession, sf: str) -> DataFrame:
    return P.any_null_flag(station_days(spark, sf).select("stnid", "date", "temp", "prcp", "rh"), ["temp", "prcp", "rh"])


@query("struct_expand", """SELECT doc_id, substr(text, 1, 8) AS kind, substr(text, 10) AS number FROM documents""")
def struct_expand(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("text")
    return P.expand_struct(table(spark, sf, "documents").select("doc_id", "text"), F.struct(
        F.substring(name, 1, 8).alias("kind"), F.substring(name, F.lit(10), F.length(name)).alias("number")
    )).drop("text")


@query("ordinal", """SELECT o_orderkey, CAST(list_position(['1-URGENT','2-HIGH','3-MEDIUM','5-LOW'], o_orderpriority) AS INT) AS urgency,
CAST(5 - list_position(['1-URGENT','2-HIGH','3-MEDIUM','5-LOW'], o_orderpriority) AS INT) AS reverse_urgency FROM orders""")
def ordinal(spark: SparkSession, sf: str) -> DataFrame:
    levels = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]
    p = F.col("o_orderpriority")
    return table(spark, sf, "orders").select(
        "o_orderkey", B.ordinal(p, levels).alias("urgency"), B.ordinal(p, levels, reverse=True).alias("reverse_urgency")
    )


@query("ordinal_by", """SELECT o_orderkey, priority_rank FROM orders JOIN (SELECT o_orderpriority,
row_number() OVER (ORDER BY avg(o_custkey), o_orderpriority) AS priority_rank FROM orders GROUP BY 1) USING (o_orderpriority)""")
def ordinal_by(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return R.ordinal_by(orders, "o_orderpriority", F.avg("o_custkey"), "priority_rank").select("o_orderkey", "priority_rank")


# --- text ------------------------------------------------------------------------------------------------------

PLACE_NAME = "CASE n_nationkey % 4 WHEN 0 THEN n_name || '-' || r_name || '--X, ' || n_nationkey WHEN 1 THEN n_name || ', ' || r_name WHEN 2 THEN n_name || '--' || r_name || ', S' ELSE n_name END"


def named_places(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return nations.selectExpr("n_nationkey", f"{PLACE_NAME} AS name")


NAMED_SQL = f"named AS (SELECT n_nationkey, {PLACE_NAME} AS name FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query("short_name", f"""WITH {NAMED_SQL} SELECT n_nationkey, CASE WHEN instr(name, '-') > 0 THEN left(name, instr(name, '-') - 1)
WHEN instr(name, ',') > 0 THEN left(name, instr(name, ',') - 1) END AS name_short FROM named""")
def short_name(spark: SparkSession, sf: str) -> DataFrame:
    return named_places(spark, sf).select("n_nationkey", H.short_name(F.col("name")).alias("name_short"))


@query("city_state", f"""WITH {NAMED_SQL}, c AS (SELECT n_nationkey, CASE WHEN instr(name, ',') > 0 THEN left(name, instr(name, ',') - 1) END AS city,
CASE WHEN instr(name, ',') > 0 THEN substr(name, instr(name, ',') + 2) END AS state FROM named),
e AS (SELECT *, CASE WHEN contains(city, '--') THEN replace(city, '--', ' – ') ELSE replace(city, '-', ' – ') END || ', ' || state AS name_edited FROM c)
SELECT *, replace(name_edited, ' – ', '/' || chr(10)) AS name_wrapped FROM e""")
def city_state(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("name")
    return named_places(spark, sf).select(
        "n_nationkey", H.city_part(name).alias("city"), H.state_part(name).alias("state"),
        H.display_name(name).alias("name_edited"), H.wrapped_name(name).alias("name_wrapped"),
    )


@query("fips5", "SELECT c_custkey, right('00' || CAST(c_custkey * 7 AS VARCHAR), 5) AS fips FROM customer")
def fips5(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", H.fips5((F.col("c_custkey") * 7).cast("string")).alias("fips"))


@query("labels", """SELECT s_suppkey, s_suppkey || '. ' || s_name || ', ' || n_name AS label,
replace(replace(s_name || '--' || n_name || '-x', '-', '- '), '- - ', '-- ') AS spaced,
CAST(s_suppkey AS VARCHAR) || '-' || CAST(s_nationkey AS VARCHAR) AS stnid FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def labels(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select(
        "s_suppkey", H.ranked_label(F.col("s_suppkey"), F.col("s_name"), F.col("n_name")).alias("label"),
        H.spaced_hyphens(F.concat("s_name", F.lit("--"), "n_name", F.lit("-x"))).alias("spaced"),
        F.concat_ws("-", "s_suppkey", "s_nationkey").alias("stnid"),
    )


@query("suffix_strip", r"""SELECT p_partkey, regexp_replace(p_name || ' M.S.A.' || p_type, ' M.S.A.*', '') AS msa,
trim(left(p_name || ' ' || p_type, greatest(length(p_name || ' ' || p_type) - 10, 0))) AS head, trim(right(p_name || ' ' || p_type, 10)) AS tail FROM part""")
def suffix_strip(spark: SparkSession, sf: str) -> DataFrame:
    head, tail = H.split_at_end(F.concat_ws(" ", "p_name", "p_type"), 10)
    return table(spark, sf, "part").select(
        "p_partkey", H.strip_first(F.concat("p_name", F.lit(" M.S.A."), "p_type"), " M.S.A.*").alias("msa"),
        head.alias("head"), tail.alias("tail"),
    )


# --- coordinates -----------------------------------------------------------------------------------------------

@query("snap", f"""WITH {CUST_SQL} SELECT cid, round_even(lat, 0) AS lat0, round_even(lon/0.5, 0)*0.5 AS lon05, round_even(lat/0.25, 0)*0.25 AS lat025 FROM cust""")
def snap(spark: SparkSession, sf: str) -> DataFrame:
    return customers(spark, sf).select(
        "cid", G.snap(F.col("lat")).alias("lat0"), G.snap(F.col("lon"), 0.5).alias("lon05"), G.snap(F.col("lat"), 0.25).alias("lat025")
    )


@query("shift_region", f"""WITH {CUST_SQL} SELECT cid, CASE WHEN lon < -125 AND lat > 48 THEN lat - 50 ELSE lat END AS lat,
CASE WHEN lon < -125 AND lat > 48 THEN lon + 50 ELSE lon END AS lon FROM cust""")
def shift_region(spark: SparkSession, sf: str) -> DataFrame:
    lat, lon = G.shifted(F.col("lat"), F.col("lon"), (F.col("lon") < -125) & (F.col("lat") > 48), -50.0, 50.0)
    return customers(spark, sf).select("cid", lat.alias("lat"), lon.alias("lon"))


@query("haversine", f"""WITH {CUST_SQL} SELECT cid, round(2*6378.137::DOUBLE*asin(least(1.0::DOUBLE, sqrt(
sin(radians(40.0-lat)/2)*sin(radians(40.0-lat)/2) + cos(radians(lat))*cos(radians(40.0::DOUBLE))*sin(radians(-75.0-lon)/2)*sin(radians(-75.0-lon)/2)))), 6) AS km FROM cust""")
def haversine(spark: SparkSession, sf: str) -> DataFrame:
    km = G.haversine_km(F.col("lat"), F.col("lon"), F.lit(40.0), F.lit(-75.0))
    return customers(spark, sf).select("cid", r(km).alias("km"))


# --- dates -----------------------------------------------------------------------------------------------------

@query("date_parts", """SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, CAST(day(o_orderdate) AS INT) AS day,
CAST(dayofyear(o_orderdate) AS INT) AS yday, strftime(o_orderdate, '%b') AS label, CAST(strptime(strftime(o_orderdate, '%Y%m%d'), '%Y%m%d') AS DATE) AS parsed FROM orders""")
def date_parts(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.year(d).alias("year"), F.month(d).alias("month"), F.dayofmonth(d).alias("day"), F.dayofyear(d).alias("yday"),
        D.month_label(d).alias("label"), F.to_date(F.date_format(d, "yyyyMMdd"), "yyyyMMdd").alias("parsed"),
    )


@query("months_back", """SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start,
CAST(datediff('month', o_orderdate, DATE '2001-08-15') AS DOUBLE) AS months,
CAST(o_orderdate AS DATE) >= DATE '2001-08-01' - INTERVAL 3 YEAR AS recent FROM orders""")
def months_back(spark: SparkSession, sf: str) -> DataFrame:
    d, as_of = F.col("o_orderdate").cast("date"), F.lit("2001-08-15").cast("date")
    return table(spark, sf, "orders").select(
        "o_orderkey", D.month_floor(d).alias("month_start"), D.months_old(d, as_of).alias("months"),
        D.within_years(d, as_of, 3).alias("recent"),
    )


@query("leap_normalize", """WITH d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem)
SELECT d, CASE WHEN month(d) = 2 AND day(d) = 29 THEN d - 1 ELSE d END AS merged,
CAST(CASE WHEN year(d) % 4 = 0 AND dayofyear(d) > 60 THEN dayofyear(d) - 1 ELSE dayofyear(d) END AS INT) AS yday_after,
CAST(CASE WHEN year(d) % 4 = 0 AND dayofyear(d) >= 60 THEN dayofyear(d) - 1 ELSE dayofyear(d) END AS INT) AS yday_from,
(month(d) = 2 AND day(d) = 29) AS leap_day FROM d WHERE dayofyear(d) <> 366""")
def leap_normalize(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("d")).distinct().where(F.dayofyear("d") != 366)
    d = F.col("d")
    return days.select(
        "d", D.merge_leap_day(d).alias("merged"), D.leap_yday(d, 61).alias("yday_after"), D.leap_yday(d, 60).alias("yday_from"),
        D.is_leap_day(d).alias("leap_day"),
    )


# --- coded fields ----------------------------------------------------------------------------------------------

READING = "CAST(CAST(l_quantity AS INT) AS {text}) || CASE WHEN l_linenumber <= 6 THEN substr('ABCDEFGHI', l_linenumber + CAST(l_orderkey % 4 AS INT), 1) ELSE '*' END"


def readings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_partkey", "l_linenumber", READING.format(text="STRING") + " AS t")


READINGS_SQL = f"readings AS (SELECT l_orderkey, l_partkey, l_linenumber, {READING.format(text='VARCHAR')} AS t FROM lineitem)"


@query("strip_flags", f"WITH {READINGS_SQL} SELECT l_orderkey, l_partkey, TRY_CAST(translate(t, 'ABCDEFGHI*', '') AS DOUBLE) AS v FROM readings")
def strip_flags(spark: SparkSession, sf: str) -> DataFrame:
    return readings(spark, sf).select("l_orderkey", "l_partkey", N.strip_flags(F.col("t")).alias("v"))


HOURS_SQL = "CASE " + " ".join(f"WHEN contains(t, '{k}') THEN {v}" for k, v in N.PRECIP_HOURS.items()) + " ELSE {default} END"


@query("precip_hours", f"WITH {READINGS_SQL} SELECT l_orderkey, l_partkey, {HOURS_SQL.format(default=1)} AS h, {HOURS_SQL.format(default='NULL')} AS h_or_null FROM readings")
def precip_hours(spark: SparkSession, sf: str) -> DataFrame:
    return readings(spark, sf).select(
        "l_orderkey", "l_partkey", N.precip_hours(F.col("t")).alias("h"), N.precip_hours(F.col("t"), None).alias("h_or_null")
    )


@query("weather_bits", "SELECT l_orderkey, l_partkey, " + ", ".join(
    f"CAST((l_orderkey // {2 ** i}) % 2 AS INT) AS is_{b}" for i, b in enumerate(N.WEATHER_BITS)) + " FROM lineitem")
def weather_bits(spark: SparkSession, sf: str) -> DataFrame:
    code = F.concat(*[F.expr(f"CAST((l_orderkey DIV {2 ** i}) % 2 AS STRING)") for i in range(6)])
    coded = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", code.alias("frshtt"))
    return coded.withColumns(N.weather_bits(F.col("frshtt"))).drop("frshtt")


@query("sentinels", """SELECT l_orderkey, l_partkey, CASE WHEN l_quantity <> 50 THEN l_quantity END AS q,
CASE WHEN l_linenumber NOT IN (3, 7) THEN CAST(l_linenumber AS DOUBLE) END AS n FROM lineitem""")
def sentinels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", N.sentinel_to_null(F.col("l_quantity"), 50).alias("q"),
        N.sentinel_to_null(F.col("l_linenumber").cast("double"), (3, 7)).alias("n"),
    )


@query("zero_if_dry", f"""WITH {WX_SQL} SELECT stnid, date, prcp, i_rain_drizzle,
CASE WHEN prcp IS NULL AND i_rain_drizzle = 0 THEN 0 ELSE prcp END AS filled FROM wx""")
def zero_if_dry(spark: SparkSession, sf: str) -> DataFrame:
    return station_days(spark, sf).select(
        "stnid", "date", "prcp", "i_rain_drizzle", N.zero_if_dry(F.col("prcp"), F.col("i_rain_drizzle")).alias("filled")
    )


@query("hourly_rate", f"""WITH {READINGS_SQL} SELECT l_orderkey, l_partkey,
round(TRY_CAST(translate(t, 'ABCDEFGHI*', '') AS DOUBLE) / ({HOURS_SQL.format(default='NULL')}), 6) AS rate FROM readings""")
def hourly_rate(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("t")
    return readings(spark, sf).select(
        "l_orderkey", "l_partkey", r(N.hourly_rate(N.strip_flags(t), N.precip_hours(t, None))).alias("rate")
    )


@query("binned", """SELECT p_partkey, CASE WHEN p_size >= 40 THEN 'Over 40' WHEN p_size >= 20 THEN '20 - 39' WHEN p_size >= 10 THEN '10 - 19' ELSE 'Less than 10' END AS cat FROM part""")
def binned(spark: SparkSession, sf: str) -> DataFrame:
    steps = [(40, "Over 40"), (20, "20 - 39"), (10, "10 - 19")]
    return table(spark, sf, "part").select("p_partkey", B.labelled(F.col("p_size"), steps, "Less than 10").alias("cat"))


@query("fixed_breaks", """SELECT o_orderkey, CASE WHEN o_totalprice BETWEEN 25000 AND 400000 THEN 1 + CAST(o_totalprice >= 50000 AS INT)
+ CAST(o_totalprice >= 100000 AS INT) + CAST(o_totalprice >= 250000 AS INT) END AS class FROM orders""")
def fixed_breaks(spark: SparkSession, sf: str) -> DataFrame:
    breaks = [25_000, 50_000, 100_000, 250_000, 400_000]
    return table(spark, sf, "orders").select("o_orderkey", B.fixed_breaks(F.col("o_totalprice"), breaks).alias("class"))


@query("adjusted_price", "SELECT p_partkey, round(p_retailprice * 365 / nullif(p_size - 1, 0), 6) AS adjusted FROM part")
def adjusted_price(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", r(B.adjusted_price(F.col("p_retailprice"), F.col("p_size") - 1)).alias("adjusted"))


@query("threshold_flags", f"""WITH {WX_SQL} SELECT stnid, date, CASE WHEN prcp > 5 THEN 1 WHEN prcp <= 5 THEN 0 END AS rainy,
CASE WHEN i_rain_drizzle < 0.1 THEN 0 ELSE 1 END AS is_rain FROM wx""")
def threshold_flags(spark: SparkSession, sf: str) -> DataFrame:
    return station_days(spark, sf).select(
        "stnid", "date", B.flag(F.col("prcp") > 5).alias("rainy"), F.when(F.col("i_rain_drizzle") < 0.1, 0).otherwise(1).alias("is_rain")
    )


# --- weather ---------------------------------------------------------------------------------------------------

@query("day_curve", f"""WITH {WX_SQL}, low AS (SELECT s_nationkey, min(temp_min) AS lo, max(temp_max) AS hi FROM wx JOIN supplier ON stnid = s_suppkey GROUP BY 1)
SELECT s_nationkey, CAST(h AS INT) AS hour, round(lo + (hi - lo)/2 - (hi - lo)/2 * cos(h * (2*pi()) / 24), 6) AS temp
FROM low, generate_series(0, 24) g(h)""")
def day_curve_query(spark: SparkSession, sf: str) -> DataFrame:
    places = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("stnid"), "s_nationkey")
    ends = station_days(spark, sf).join(places, "stnid").groupBy("s_nationkey").agg(F.min("temp_min").alias("lo"), F.max("temp_max").alias("hi"))
    return hourly_expand(ends).select("s_nationkey", "hour", r(day_curve(F.col("lo"), F.col("hi"), F.col("hour"))).alias("temp"))


@query("excess_degree_days", f"WITH {daily_sql()} SELECT place, date, {degree_days_sql('temp_min', 'temp_max')} FROM daily")
def excess_degree_days_query(spark: SparkSession, sf: str) -> DataFrame:
    days = daily(spark, sf).select("place", "date", "temp_min", "temp_max")
    return P.expand_struct(days, excess_degree_days(F.col("temp_min"), F.col("temp_max"))).drop("temp_min", "temp_max")


@query("excess_degree_hours", f"""WITH {daily_sql()}, e AS (SELECT place, date, (temp_max - temp_min) / 2 AS a, temp_min AS lo, temp_max AS hi,
temp_min + (temp_max - temp_min) / 2 - 18 AS mid FROM daily), t AS (SELECT *, acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, mid / nullif(a, 0)))) AS theta FROM e),
h AS (SELECT *, CASE WHEN lo >= 18 THEN mid WHEN hi <= 18 THEN 0 ELSE (mid * (pi() - theta) + a * sin(theta)) / pi() END AS hot FROM t WHERE lo IS NOT NULL AND hi IS NOT NULL)
SELECT place, date, round_even((hot + CASE WHEN lo >= 18 THEN 0 WHEN hi <= 18 THEN -mid ELSE hot - mid END) * 24, 2) AS edh FROM daily LEFT JOIN h USING (place, date)""")
def excess_degree_hours_query(spark: SparkSession, sf: str) -> DataFrame:
    return daily(spark, sf).select("place", "date", excess_degree_hours(F.col("temp_min"), F.col("temp_max")).alias("edh"))


@query("classify_world", f"WITH {classed_sql('stnid', 30, 3, 30)} SELECT place, date, hot, cold, elements, pleasant, class FROM classed")
def classify_world(spark: SparkSession, sf: str) -> DataFrame:
    """Every station by itself, by the limits for the whole world."""
    days = classified_days(daily(spark, sf, "stnid"), WORLD_LIMITS)
    return days.select("place", "date", "hot", "cold", "elements", "pleasant", "class")


@query("feels_like", f"WITH {daily_sql()} SELECT place, date, " + ", ".join(
    f"{feels_like_sql(t)} AS {t}_feel" for t in ("temp_max", "temp_min", "temp_mean")) + " FROM daily")
def feels_like_query(spark: SparkSession, sf: str) -> DataFrame:
    return felt(daily(spark, sf)).select("place", "date", "temp_max_feel", "temp_min_feel", "temp_mean_feel")


@query("heat_index", f"WITH {WX_SQL} SELECT stnid, date, temp_max, rh, {heat_index_sql('temp_max', '(rh * 1.25::DOUBLE)')} AS hi FROM wx")
def heat_index_query(spark: SparkSession, sf: str) -> DataFrame:
    return station_days(spark, sf).select("stnid", "date", "temp_max", "rh", heat_index(F.col("temp_max"), F.col("rh") * 1.25).alias("hi"))


@query("classify_day", f"WITH {classed_sql()} SELECT place, date, hot, cold, elements, pleasant, class FROM classed")
def classify_day(spark: SparkSession, sf: str) -> DataFrame:
    return class_days(spark, sf).select("place", "date", "hot", "cold", "elements", "pleasant", "class")


@query("classify_bands", f"""WITH {daily_sql()},
a AS (SELECT place, date, CASE WHEN temp_max IS NULL OR temp_mean IS NULL OR temp_min IS NULL THEN 'unknown'
  WHEN temp_min > 15 THEN 'hot' WHEN temp_min < -10 THEN 'cold' WHEN temp_max > 35 THEN 'hot' WHEN temp_max < 5 THEN 'cold'
  WHEN temp_mean > 24 THEN 'hot' WHEN temp_mean < 0 THEN 'cold' ELSE 'pleasant' END AS t,
  CASE WHEN sndp IS NULL AND rh IS NULL THEN 'unknown' WHEN prcp <= 6 AND i_snow_ice <= 1 AND sndp <= 50 AND rh <= 50 THEN 'pleasant' ELSE 'elements' END AS w FROM daily),
b AS (SELECT *, CASE WHEN t = 'unknown' AND w = 'unknown' THEN NULL WHEN t = 'pleasant' AND w = 'pleasant' THEN 1 ELSE 0 END AS pleasant FROM a)
SELECT place, date, t AS temp_class, w AS weather_class, pleasant,
  coalesce(settled, CASE WHEN t = 'hot' THEN t END, bad, off) AS distinct_class,
  coalesce(settled, nullif(concat_ws(' & ', off, bad), '')) AS double_class
FROM (SELECT *, CASE WHEN t IN ('hot', 'cold') THEN t END AS off, CASE WHEN w = 'elements' THEN w END AS bad,
      CASE WHEN pleasant IS NULL THEN 'unknown' WHEN pleasant = 1 THEN 'pleasant' END AS settled FROM b)""")
def classify_bands(spark: SparkSession, sf: str) -> DataFrame:
    bands = C.Bands(low=(-10, 15), high=(5, 35), mean=(0, 24), prcp=6, sndp=1, indicator=50)
    out = C.classify_bands(daily(spark, sf), bands, prcp="prcp", sndp="i_snow_ice", rain="sndp", snow="rh")
    return out.select("place", "date", "temp_class", "weather_class", "pleasant", "distinct_class", "double_class")


@query("classify_flags", f"""WITH {daily_sql()}, f AS (SELECT place, date,
  CASE WHEN temp_min > 15 OR temp_max > 35 OR temp_mean > 24 THEN 1 WHEN NOT (temp_min > 15 OR temp_max > 35 OR temp_mean > 24) THEN 0 END AS hot,
  CASE WHEN temp_min < 5 OR temp_max < 20 OR temp_mean < 13 THEN 1 WHEN NOT (temp_min < 5 OR temp_max < 20 OR temp_mean < 13) THEN 0 END AS cold,
  CASE WHEN prcp > 10 OR sndp > 10 OR i_rain_drizzle > 0.66 OR i_snow_ice > 0.66 THEN 1
       WHEN NOT (prcp > 10 OR sndp > 10 OR i_rain_drizzle > 0.66 OR i_snow_ice > 0.66) THEN 0 END AS elements,
  CASE WHEN wdsp > 10 THEN 1 WHEN wdsp <= 10 THEN 0 END AS wind FROM daily),
g AS (SELECT *, CASE WHEN hot + cold + elements + wind = 0 THEN 1 WHEN hot + cold + elements + wind <> 0 THEN 0 END AS pleasant FROM f)
SELECT *, CASE WHEN pleasant = 1 THEN 'pleasant' WHEN hot = 1 THEN 'hot' WHEN cold = 1 THEN 'cold' WHEN elements = 1 THEN 'elements' WHEN wind = 1 THEN 'wind' END AS distinct_class,
  CASE WHEN pleasant = 1 THEN 'pleasant' WHEN hot = 1 AND elements = 1 THEN 'hot & elements' WHEN cold = 1 AND elements = 1 THEN 'cold & elements'
       WHEN hot = 1 THEN 'hot' WHEN cold = 1 THEN 'cold' WHEN elements = 1 THEN 'elements' WHEN wind = 1 THEN 'wind' END AS double_class FROM g""")
def classify_flags(spark: SparkSession, sf: str) -> DataFrame:
    return C.classify_flags(daily(spark, sf)).select(
        "place", "date", "hot", "cold", "elements", "wind", "pleasant", "distinct_class", "double_class"
    )


@query("classify_strict", f"""WITH {daily_sql()}, f AS (SELECT place, date,
  CASE WHEN temp_min >= -20 AND temp_max <= 40 AND temp_mean >= -10 AND temp_mean <= 30 AND prcp <= 6 AND i_rain_drizzle < 0.5 THEN 1
       WHEN NOT (temp_min >= -20 AND temp_max <= 40 AND temp_mean >= -10 AND temp_mean <= 30 AND prcp <= 6 AND i_rain_drizzle < 0.5) THEN 0 END AS pleasant,
  CASE WHEN temp_max > 40 OR temp_mean > 30 THEN 1 WHEN NOT (temp_max > 40 OR temp_mean > 30) THEN 0 END AS hot,
  CASE WHEN temp_min < -20 OR temp_mean < -10 THEN 1 WHEN NOT (temp_min < -20 OR temp_mean < -10) THEN 0 END AS cold,
  CASE WHEN i_rain_drizzle >= 0.5 OR prcp > 8 OR sndp > 60 THEN 1 WHEN NOT (i_rain_drizzle >= 0.5 OR prcp > 8 OR sndp > 60) THEN 0 END AS elements FROM daily)
SELECT *, CASE WHEN pleasant = 1 THEN 'pleasant' WHEN hot = 1 THEN 'hot' WHEN elements = 1 THEN 'elements' WHEN cold = 1 THEN 'cold' END AS distinct_class FROM f""")
def classify_strict(spark: SparkSession, sf: str) -> DataFrame:
    limits = C.StrictLimits(high=40, low=-20, mean=(-10, 30), prcp=6, heavy_prcp=8, sndp=60)
    out = C.classify_strict(daily(spark, sf), limits, prcp="prcp", sndp="sndp", element="i_rain_drizzle")
    return out.select("place", "date", "pleasant", "hot", "cold", "elements", "distinct_class")


@query("min_max_mean_fill", """WITH h AS (SELECT l_orderkey, l_partkey, l_linenumber,
  CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS m, CASE WHEN l_orderkey % 5 <> 0 THEN l_quantity - 3 END AS lo,
  CASE WHEN l_orderkey % 2 <> 0 THEN l_quantity + 3 END AS hi FROM lineitem),
g AS (SELECT *, coalesce(hi, 2*m - lo) AS hi1, coalesce(hi, CASE WHEN lo IS NULL THEN m ELSE 2*m - lo END) AS hi2 FROM h)
SELECT l_orderkey, l_partkey, l_linenumber, m AS temp_mean, hi1 AS temp_max, coalesce(lo, 2*m - hi1) AS temp_min,
  hi2 AS temp_max_old, coalesce(lo, 2*m - hi2) AS temp_min_old FROM g""")
def min_max_mean_fill(spark: SparkSession, sf: str) -> DataFrame:
    q, key = F.col("l_quantity"), F.col("l_orderkey")
    days = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", F.when(key % 7 != 0, q).alias("temp_mean"),
        F.when(key % 5 != 0, q - 3).alias("temp_min"), F.when(key % 2 != 0, q + 3).alias("temp_max"),
    ).withColumns({"temp_min_old": F.col("temp_min"), "temp_max_old": F.col("temp_max")})
    return C.fill_min_max(C.fill_min_max(days), "temp_min_old", "temp_max_old", both_from_mean=True)


@query("missing_flags", f"""WITH {WX_SQL} SELECT stnid, date, temp, prcp, rh, CASE WHEN temp IS NULL THEN 'missing'
WHEN prcp IS NULL OR rh IS NULL THEN 'partial' ELSE 'existing' END AS flag FROM wx""")
def missing_flags(spark: SparkSession, sf: str) -> DataFrame:
    return station_days(spark, sf).select(
        "stnid", "date", "temp", "prcp", "rh", missing_flag([F.col("prcp"), F.col("rh")], F.col("temp")).alias("flag")
    )
