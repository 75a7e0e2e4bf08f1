"""Aggregates over the daily series and the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from geoscore.functions.dates import is_leap_day, leap_yday
from geoscore.functions.geo import snap
from geoscore.operators import aggregate as A
from geoscore.operators.columns import nan_to_null
from geoscore.operators.skew import dealt
from geoscore.plans.bindings import (
    CUST_SQL, SDAY_SQL, WX_SQL, class_days, classed_sql, customers, daily, daily_sql, station_days, supplier_days,
)
from geoscore.plans.registry import query, r, rounded, table
from geoscore.session import store_once

AS_OF = "DATE '2001-08-01'"


@query("group_stats", """SELECT l_suppkey, l_returnflag, sum(l_quantity) AS total, round(avg(l_quantity), 6) AS mean,
  min(l_extendedprice) AS low, max(l_extendedprice) AS high, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def group_stats(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(
        F.sum("l_quantity").alias("total"), r(F.avg("l_quantity")).alias("mean"),
        F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), F.count(F.lit(1)).alias("n"),
    )


@query("agg_all", """SELECT s_nationkey, round(avg(s_suppkey), 6) AS s_suppkey,
  round(avg(CAST(round(s_acctbal*100) AS BIGINT)), 6) AS cents FROM supplier GROUP BY 1""")
def agg_all(spark: SparkSession, sf: str) -> DataFrame:
    suppliers = table(spark, sf, "supplier").select(
        "s_suppkey", "s_nationkey", "s_name", F.round(F.col("s_acctbal") * 100).cast("bigint").alias("cents")
    )
    return rounded(A.agg_all(suppliers, ["s_nationkey"]), "s_suppkey", "cents")


@query("mean_and_max", f"""WITH {WX_SQL} SELECT stnid, CAST(year(date) AS INT) AS year, round(avg(temp), 6) AS temp,
  round(avg(wdsp), 6) AS wdsp, max(prcp) AS prcp, max(sndp) AS sndp FROM wx GROUP BY 1, 2""")
def mean_and_max(spark: SparkSession, sf: str) -> DataFrame:
    days = station_days(spark, sf).withColumn("year", F.year("date"))
    return rounded(A.mean_and_max(days, ["stnid", "year"], ["temp", "wdsp"], ["prcp", "sndp"]), "temp", "wdsp")


@query("weighted_mean", f"""WITH {WX_SQL} SELECT stnid,
  round(sum(temp * wdsp) / sum(CASE WHEN temp IS NOT NULL THEN wdsp END), 6) AS temp FROM wx GROUP BY 1""")
def weighted_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.weighted_mean(station_days(spark, sf), ["stnid"], "temp", "wdsp"), "temp")


@query("decay_weighted_mean", f"""WITH m AS (SELECT o_custkey, o_orderdate, CAST(round(o_totalprice) AS DOUBLE) AS price,
  pow(0.9::DOUBLE, datediff('month', date_trunc('month', o_orderdate), {AS_OF})) AS w FROM orders
  WHERE CAST(o_orderdate AS DATE) >= {AS_OF} - INTERVAL 5 YEAR)
SELECT o_custkey, round(sum(price * w)/sum(w), 4) AS price FROM m GROUP BY 1""")
def decay_weighted_mean(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(
        "o_custkey", F.col("o_orderdate").cast("date").alias("date"), F.round("o_totalprice").alias("price")
    )
    out = A.decay_weighted_mean(orders, ["o_custkey"], "price", "date", F.expr(AS_OF), 0.9, 5)
    return rounded(out, "price", digits=4)


@query("tally", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def tally(spark: SparkSession, sf: str) -> DataFrame:
    return A.tally(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("distinct_rows", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus").distinct()


@query("count_if", f"""WITH {WX_SQL} SELECT stnid, count(*) AS total, count(temp_min) AS exist,
  count(*) FILTER (WHERE prcp > 5) AS wet FROM wx GROUP BY 1""")
def count_if(spark: SparkSession, sf: str) -> DataFrame:
    return station_days(spark, sf).groupBy("stnid").agg(
        F.count(F.lit(1)).alias("total"), F.count("temp_min").alias("exist"), F.count_if(F.col("prcp") > 5).alias("wet")
    )


@query("global_bounds", f"WITH {WX_SQL} SELECT min(date) AS first, max(date) AS last, min(temp) AS low, max(temp) AS high FROM wx")
def global_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return station_days(spark, sf).agg(
        F.min("date").alias("first"), F.max("date").alias("last"), F.min("temp").alias("low"), F.max("temp").alias("high")
    )


def coverage_sql(place: str = "region", value: str = "temp_min") -> str:
    return f"""{daily_sql(place)},
bounds AS (SELECT min(date) AS d0, max(date) AS d1 FROM daily),
cal AS (SELECT CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS date FROM bounds),
skel AS (SELECT place, date FROM (SELECT DISTINCT place FROM daily), cal),
cov AS (SELECT place, CAST(year(date) AS INT) AS year, count(*) AS total, count({value}) AS known
  FROM skel LEFT JOIN daily USING (place, date) GROUP BY 1, 2)"""


@query("completeness_filter", f"""WITH {coverage_sql()}
SELECT place, round(avg(known / total), 6) AS avg_ratio FROM cov GROUP BY 1 HAVING avg(known / total) >= 0.85""")
def completeness_filter(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.completeness_filter(daily(spark, sf, "region"), "place", "date", "temp_min"), "avg_ratio")


@query("stable_years", f"""WITH {coverage_sql()}, good AS (SELECT place, year, known, total FROM cov WHERE (total - known)/total < 0.05)
SELECT place, year, known, total, n_years FROM good JOIN (SELECT place, count(*) AS n_years FROM good GROUP BY 1) USING (place)
WHERE n_years >= 3""")
def stable_years(spark: SparkSession, sf: str) -> DataFrame:
    out = A.stable_years(daily(spark, sf, "region"), "place", "date", "temp_min")
    return out.select("place", "year", "known", "total", "n_years")


@query("coverage_days", f"""WITH {WX_SQL} SELECT s_nationkey, CAST(year(date) AS INT) AS year, count(DISTINCT date) AS n_days
FROM wx JOIN supplier ON stnid = s_suppkey GROUP BY 1, 2 HAVING count(DISTINCT date) > 365 * 0.3""")
def coverage_days(spark: SparkSession, sf: str) -> DataFrame:
    places = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("stnid"), "s_nationkey")
    days = station_days(spark, sf).select("stnid", "date").join(places, "stnid")
    return A.coverage_days(days, ["s_nationkey"], "date", 0.3)


@query("worst_year", """WITH y AS (SELECT l_suppkey, year(l_shipdate) AS y, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, min(n) AS min_n FROM y GROUP BY 1 HAVING min(n) > 365 * 0.15""")
def worst_year(spark: SparkSession, sf: str) -> DataFrame:
    return A.worst_year(table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate"), ["l_suppkey"], "l_shipdate", 0.15)


@query("cell_coverage", f"""WITH {CUST_SQL}, c AS (SELECT round_even(lat/30, 0)*30 AS lat_cell, round_even(lon/30, 0)*30 AS lon_cell,
  CAST(year(o_orderdate) AS INT) AS year, count(DISTINCT CAST(o_orderdate AS DATE)) AS n_days
  FROM cust JOIN orders ON cid = o_custkey GROUP BY 1, 2, 3)
SELECT * FROM c WHERE n_days >= 365 * 0.05""")
def cell_coverage(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("cid"), F.col("o_orderdate").cast("date").alias("date"))
    placed = orders.join(customers(spark, sf).select(
        "cid", snap(F.col("lat"), 30.0).alias("lat_cell"), snap(F.col("lon"), 30.0).alias("lon_cell")
    ), "cid")
    return A.coverage_days(placed, ["lat_cell", "lon_cell"], "date", 0.05, strict=False)


@query("recency", """SELECT o_custkey, CAST(max(year(o_orderdate)) AS INT) AS year_max, count(*) AS n FROM orders
WHERE year(o_orderdate) >= 1998 GROUP BY 1 HAVING count(*) > 4""")
def recency(spark: SparkSession, sf: str) -> DataFrame:
    return A.recency(table(spark, sf, "orders"), ["o_custkey"], F.year("o_orderdate"), 1998)


@query("year_then_mean", f"""WITH {classed_sql("region")},
y AS (SELECT place, year(date) AS y, sum(edd_total) AS edd_total, sum(pleasant) AS pleasant, count(*) AS days
  FROM classed WHERE year(date) < 2001 GROUP BY 1, 2)
SELECT place, round(avg(edd_total), 4) AS edd_total, round(avg(pleasant), 6) AS pleasant FROM y
WHERE greatest(365 - days, 0) < 36.5 GROUP BY 1""")
def year_then_mean(spark: SparkSession, sf: str) -> DataFrame:
    out = A.year_then_mean(
        class_days(spark, sf, "region"), ["place"], "date",
        {"edd_total": F.sum("edd_total"), "pleasant": F.sum("pleasant")}, running_year=2001,
    )
    return out.select("place", r("edd_total", 4).alias("edd_total"), r("pleasant").alias("pleasant"))


@query("normalized_composition", f"""WITH {classed_sql()},
y AS (SELECT place, year(date) AS y, sum(pleasant) AS pleasant, sum(elements) AS elements, sum(cold) AS cold, sum(hot) AS hot
  FROM classed GROUP BY 1, 2),
t AS (SELECT place, sum(pleasant) AS p, sum(elements) AS e, sum(cold) AS c, sum(hot) AS h,
  sum(greatest(365 - (pleasant + elements + cold + hot), 0)) AS u FROM y GROUP BY 1),
n AS (SELECT place, round_even(p/(p+e+c+h+u)*365, 0) AS p, round_even(e/(p+e+c+h+u)*365, 0) AS e,
  round_even(c/(p+e+c+h+u)*365, 0) AS c, round_even(h/(p+e+c+h+u)*365, 0) AS h, round_even(u/(p+e+c+h+u)*365, 0) AS u FROM t),
m AS (SELECT *, p + e + c + h + u - 365 AS rem FROM n)
SELECT place, CAST(CASE WHEN u = 0 AND rem > 0 THEN p - rem ELSE p END AS INT) AS pleasant, CAST(e AS INT) AS elements,
  CAST(c AS INT) AS cold, CAST(h AS INT) AS hot, CAST(CASE WHEN u = 0 AND rem > 0 THEN u ELSE u - rem END AS INT) AS unknown FROM m""")
def normalized_composition(spark: SparkSession, sf: str) -> DataFrame:
    days = class_days(spark, sf).withColumn("year", F.year("date"))
    return A.normalized_composition(days, "place", "year", ["pleasant", "elements", "cold", "hot"])


@query("class_share", f"""WITH {classed_sql()}, k AS (SELECT place, class, count(*) AS n FROM classed GROUP BY 1, 2)
SELECT place, class, round(365.0::DOUBLE * n / sum(n) OVER (PARTITION BY place), 6) AS n FROM k""")
def class_share(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.class_share(class_days(spark, sf), "place", "class"), "n")


@query("grid_rollup", f"""WITH {CUST_SQL} SELECT round_even(lat/0.5, 0)*0.5 AS lat_cell, round_even(lon/0.5, 0)*0.5 AS lon_cell,
  round(avg(CAST(round(bal*100) AS BIGINT)), 6) AS cents, count(*) AS n FROM cust GROUP BY 1, 2""")
def grid_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return A.grid_rollup(customers(spark, sf), "lat", "lon", 0.5, {
        "cents": r(F.avg(F.round(F.col("bal") * 100).cast("bigint"))), "n": F.count(F.lit(1)),
    })


@query("concat_group", """WITH x AS (SELECT c_nationkey, c_name, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) - 1) // 50 AS part FROM customer)
SELECT c_nationkey, CAST(part AS INT) AS part, string_agg(c_name, ', ' ORDER BY c_name) AS text FROM x GROUP BY 1, 2""")
def concat_group(spark: SparkSession, sf: str) -> DataFrame:
    return A.concat_group(
        table(spark, sf, "customer").select("c_nationkey", "c_name"), ["c_nationkey"], "c_name", [F.col("c_name").asc()], part_size=50
    )


@query("representative", f"""WITH {CUST_SQL} SELECT nation, max(segment) AS segment, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon
FROM (SELECT nation, segment, round(lat*10) AS lat, round(lon*10) AS lon FROM cust) GROUP BY 1""")
def representative(spark: SparkSession, sf: str) -> DataFrame:
    tenths = customers(spark, sf).withColumns({"lat": F.round(F.col("lat") * 10), "lon": F.round(F.col("lon") * 10)})
    return rounded(A.representative(tenths, ["nation"], ["segment"], ["lat", "lon"]), "lat", "lon")


@query("histogram", """WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
SELECT CAST(least(floor((value - lo)/((hi - lo)/30)), 29) AS INT) AS bin, count(*) AS n FROM events, b WHERE value IS NOT NULL GROUP BY 1""")
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    return A.histogram(table(spark, sf, "events").select("value"), "value")


@query("frequency_of_counts", "SELECT n, count(*) AS count FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
def frequency_of_counts(spark: SparkSession, sf: str) -> DataFrame:
    return A.frequency_of_counts(table(spark, sf, "orders").select("o_custkey"), ["o_custkey"])


@query("category_mean", """SELECT c_mktsegment, round(avg(CAST(round(c_acctbal*100) AS BIGINT)), 6) AS cents FROM customer GROUP BY 1""")
def category_mean(spark: SparkSession, sf: str) -> DataFrame:
    cents = table(spark, sf, "customer").select("c_mktsegment", F.round(F.col("c_acctbal") * 100).cast("bigint").alias("cents"))
    return rounded(A.agg_all(cents, ["c_mktsegment"]), "cents")


@query("region_dissolve", """SELECT r_name, CAST(sum(pop) AS BIGINT) AS pop, count(*) AS country_n FROM
(SELECT n_regionkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS pop FROM nation)
JOIN region ON r_regionkey = n_regionkey GROUP BY 1""")
def region_dissolve(spark: SparkSession, sf: str) -> DataFrame:
    people = A.tally(table(spark, sf, "customer"), ["c_nationkey"], "pop").withColumnRenamed("c_nationkey", "n_nationkey")
    members = table(spark, sf, "nation").join(people, "n_nationkey", "left").fillna(0, ["pop"])
    named = members.join(table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    return A.region_dissolve(named, "r_name", ["pop"])


@query("collapse_max", f"""WITH {SDAY_SQL}, both_ AS (SELECT entity, date, value AS v FROM sday UNION ALL
SELECT entity, date, CASE WHEN value IS NULL THEN 10.0::DOUBLE END FROM sday)
SELECT entity, date, max(v) AS v FROM both_ GROUP BY 1, 2""")
def collapse_max(spark: SparkSession, sf: str) -> DataFrame:
    days = store_once(supplier_days(spark, sf))
    observed = days.select("entity", "date", F.col("value").alias("v"))
    predicted = days.select("entity", "date", F.when(F.col("value").isNull(), 10.0).alias("v"))
    # A key has two rows at most, so keys are dealt to as many tasks as the rows need and are not combined before.
    both = dealt(nan_to_null(observed.unionByName(predicted)), ["entity", "date"], 2 * days.count())
    return A.collapse_max(both, ["entity", "date"], ["v"])


@query("month_totals", """SELECT l_suppkey, CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month,
  sum(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2, 3""")
def month_totals(spark: SparkSession, sf: str) -> DataFrame:
    return A.month_totals(table(spark, sf, "lineitem"), ["l_suppkey"], "l_shipdate", "l_quantity")


@query("climatology", f"""WITH {daily_sql()}
SELECT place, CAST(month(date) AS INT) AS month, CAST(day(date) AS INT) AS day,
  CAST(CASE WHEN year(date) % 4 = 0 AND dayofyear(date) > 60 THEN dayofyear(date) - 1 ELSE dayofyear(date) END AS INT) AS yday,
  round(avg(temp_mean), 4) AS temp_mean, round(avg(prcp), 4) AS prcp FROM daily
WHERE NOT (month(date) = 2 AND day(date) = 29) GROUP BY 1, 2, 3, 4""")
def climatology(spark: SparkSession, sf: str) -> DataFrame:
    days = daily(spark, sf).where(~is_leap_day(F.col("date")))
    out = A.climatology(days, ["place"], "date", ["temp_mean", "prcp"], leap_yday(F.col("date")))
    return rounded(out, "temp_mean", "prcp", digits=4)
