"""Joins, set operations, reshaping, daily series and gap filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from geoscore.functions.geo import snap
from geoscore.operators import impute as I, reshape as S, series as T
from geoscore.operators.skew import attach
from geoscore.operators.spatial import cell_join as cell_join_op, region_lookup
from geoscore.plans.bindings import (
    BOX_SQL, CUST_SQL, SDAY_SQL, SUPP_SQL, customers, nation_boxes, supplier_days, suppliers,
)
from geoscore.plans.composites import assemble
from geoscore.plans.registry import query, r, rounded, table
from geoscore.session import store_once


# --- joins -----------------------------------------------------------------------------------------------------

@query("assemble_left", """SELECT c_custkey, c_name, n_name, r_name, n_orders FROM customer
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def assemble_left(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    regions = table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    # Many customers share a nation and a region, so those lookups are attached with hot keys cut; a customer is unique.
    placed = attach(table(spark, sf, "customer"), attach(nations, regions, ["n_regionkey"]), ["c_nationkey"])
    return assemble(placed, orders, key="c_custkey").select("c_custkey", "c_name", "n_name", "r_name", "n_orders")


@query("inner_composite", """SELECT a.l_orderkey, a.l_partkey, a.l_suppkey, b.n FROM lineitem a JOIN
(SELECT l_suppkey AS s, l_partkey AS p, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) b ON l_suppkey = s AND l_partkey = p""")
def inner_composite(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    returned = lines.where(F.col("l_returnflag") == "R").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    matched = attach(lines, returned, ["l_suppkey", "l_partkey"], how="inner")
    return matched.select("l_orderkey", "l_partkey", "l_suppkey", "n")


@query("semi", """SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate = o_orderdate + INTERVAL 10 DAY)""")
def semi(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.date_sub(F.col("l_shipdate").cast("date"), 10).alias("day")
    )
    orders = table(spark, sf, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    return orders.join(lines, ["o_orderkey", "day"], "left_semi").select("o_orderkey", "o_custkey")


@query("anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti(spark: SparkSession, sf: str) -> DataFrame:
    urgent = table(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(urgent, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("full_outer", """WITH a AS (SELECT o_custkey AS k, count(*) AS orders FROM orders GROUP BY 1),
b AS (SELECT l_suppkey AS k, count(*) AS lines FROM lineitem GROUP BY 1)
SELECT k, orders, lines FROM a FULL JOIN b USING (k)""")
def full_outer(spark: SparkSession, sf: str) -> DataFrame:
    """Two numbered parties, some numbers on one side only."""
    a = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("orders"))
    b = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count(F.lit(1)).alias("lines"))
    return a.join(b, "k", "full")


@query("cross_join", """SELECT s_suppkey, CAST(h AS INT) AS hour FROM supplier, generate_series(0, 23) g(h)""")
def cross_join(spark: SparkSession, sf: str) -> DataFrame:
    return S.times_values(table(spark, sf, "supplier").select("s_suppkey"), "hour", F.sequence(F.lit(0), F.lit(23)))


@query("cartesian_keys", """SELECT y || '/' || s_suppkey || '.csv' AS file FROM supplier, (SELECT unnest([1995, 1996, 1997]) AS y)""")
def cartesian_keys(spark: SparkSession, sf: str) -> DataFrame:
    keyed = S.times_values(table(spark, sf, "supplier").select("s_suppkey"), "year", [1995, 1996, 1997])
    return keyed.select(F.concat("year", F.lit("/"), "s_suppkey", F.lit(".csv")).alias("file"))


@query("prefer_exact", """WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_returnflag = 'A'),
b AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem)
SELECT s, p, 'exact' AS match FROM e UNION ALL SELECT s, p, 'buffer' FROM b WHERE (s, p) NOT IN (SELECT (s, p) FROM e)""")
def prefer_exact(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"), "l_returnflag")
    exact = lines.where(F.col("l_returnflag") == "A").select("s", "p").distinct()
    return S.prefer_exact(exact, lines.select("s", "p").distinct(), ["s", "p"])


@query("cell_join", f"""WITH {CUST_SQL}, {SUPP_SQL}, cells AS (SELECT round_even(lat/5, 0)*5 AS lat_cell, round_even(lon/5, 0)*5 AS lon_cell, count(*) AS n FROM supp GROUP BY 1, 2)
SELECT cid, round_even(lat/5, 0)*5 AS lat_cell, round_even(lon/5, 0)*5 AS lon_cell, n FROM cust LEFT JOIN cells ON lat_cell = round_even(lat/5, 0)*5 AND lon_cell = round_even(lon/5, 0)*5""")
def cell_join(spark: SparkSession, sf: str) -> DataFrame:
    cells = suppliers(spark, sf).groupBy(
        snap(F.col("lat"), 5.0).alias("lat_cell"), snap(F.col("lon"), 5.0).alias("lon_cell")
    ).agg(F.count(F.lit(1)).alias("n"))
    return cell_join_op(customers(spark, sf).select("cid", "lat", "lon"), cells, 5.0).select("cid", "lat_cell", "lon_cell", "n")


@query("crosswalk", """WITH m AS (SELECT DISTINCT l_partkey AS part, l_suppkey % 10 AS grp FROM lineitem)
SELECT p_partkey, p_size, grp FROM part LEFT JOIN m ON part = p_partkey""")
def crosswalk(spark: SparkSession, sf: str) -> DataFrame:
    mapping = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), (F.col("l_suppkey") % 10).alias("grp"))
    return S.crosswalk(table(spark, sf, "part").select("p_partkey", "p_size"), mapping, "p_partkey")


# --- sets ------------------------------------------------------------------------------------------------------

@query("union_by_name", "SELECT c_custkey AS id, c_mktsegment AS segment, NULL::INT AS nation FROM customer UNION ALL SELECT s_suppkey, NULL, s_nationkey FROM supplier")
def union_by_name(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"))
    return S.stack(a, b)


@query("union_all", "SELECT c_nationkey AS k, c_acctbal AS bal FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier")
def union_all(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("bal"))
    return S.stack(a, table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("bal")))


@query("union_distinct", "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def union_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return S.stack_distinct(
        table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    )


@query("set_difference", """SELECT 'both' AS side, * FROM (SELECT p_partkey AS k FROM part INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity = 50)
UNION ALL SELECT 'missing', * FROM (SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity = 50)""")
def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    full = table(spark, sf, "lineitem").where(F.col("l_quantity") == 50).select(F.col("l_partkey").alias("k"))
    return parts.intersect(full).select(F.lit("both").alias("side"), "k").unionByName(
        parts.join(full, "k", "left_anti").distinct().select(F.lit("missing").alias("side"), "k")
    )


# --- reshaping -------------------------------------------------------------------------------------------------

MONTHS = [f"m{i}" for i in range(1, 13)]
WIDE_SQL = "wide AS (SELECT o_custkey, " + ", ".join(
    f"sum(round(o_totalprice)) FILTER (WHERE month(o_orderdate) = {i}) AS m{i}" for i in range(1, 13)) + " FROM orders GROUP BY 1)"


def wide_months(spark: SparkSession, sf: str) -> DataFrame:
    monthly = table(spark, sf, "orders").groupBy("o_custkey", F.concat(F.lit("m"), F.month("o_orderdate")).alias("name")).agg(
        F.sum(F.round("o_totalprice")).alias("value")
    )
    return S.pivot(monthly, ["o_custkey"], "name", "value", MONTHS)


@query("unpivot_months", f"WITH {WIDE_SQL} SELECT o_custkey, name, value FROM wide UNPIVOT INCLUDE NULLS (value FOR name IN ({', '.join(MONTHS)}))")
def unpivot_months(spark: SparkSession, sf: str) -> DataFrame:
    return S.unpivot(wide_months(spark, sf), ["o_custkey"], MONTHS)


@query("pivot_class", f"WITH {WIDE_SQL} SELECT * FROM wide")
def pivot_class(spark: SparkSession, sf: str) -> DataFrame:
    return wide_months(spark, sf)


# --- calendars and gaps ----------------------------------------------------------------------------------------

SKELETON_SQL = """sb AS (SELECT min(date) AS d0, max(date) AS d1 FROM sday),
skel AS (SELECT entity, CAST(d AS DATE) AS date FROM (SELECT DISTINCT entity FROM sday), (SELECT unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS d FROM sb))"""


@query("date_skeleton", f"WITH {SDAY_SQL}, {SKELETON_SQL} SELECT entity, date, qty FROM skel LEFT JOIN sday USING (entity, date)")
def date_skeleton(spark: SparkSession, sf: str) -> DataFrame:
    return T.full_series(supplier_days(spark, sf).select("entity", "date", "qty"), ["entity"], "date")


@query("missing_days", f"""WITH {SDAY_SQL}, {SKELETON_SQL} SELECT entity, date, qty, CASE WHEN qty IS NULL THEN 'missing' ELSE 'existing' END AS flag
FROM skel LEFT JOIN sday USING (entity, date) WHERE qty IS NOT NULL OR NOT (month(date) = 2 AND day(date) = 29)""")
def missing_days(spark: SparkSession, sf: str) -> DataFrame:
    return T.missing_days(supplier_days(spark, sf).select("entity", "date", "qty"), ["entity"], "date", leap_days=False)


@query("grid_skeleton", f"""WITH {BOX_SQL}, g AS (SELECT CAST(-90 + a*5 AS DOUBLE) AS lat, CAST(-180 + b*5 AS DOUBLE) AS lon FROM generate_series(0, 36) x(a), generate_series(0, 72) y(b))
SELECT lat, lon, min(nation_name) AS nation_name FROM g JOIN box ON lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1 GROUP BY 1, 2""")
def grid_skeleton(spark: SparkSession, sf: str) -> DataFrame:
    grid = T.grid_skeleton(spark, 5.0).withColumn("gid", F.concat_ws("/", "lat", "lon"))
    land = region_lookup(grid, nation_boxes(spark, sf), "gid", "nation_name")
    return land.where(F.col("nation_name").isNotNull()).select("lat", "lon", "nation_name")


W = "OVER (PARTITION BY entity ORDER BY date"


@query("fill_down", f"""WITH {SDAY_SQL} SELECT entity, date, last_value(value IGNORE NULLS) {W} ROWS UNBOUNDED PRECEDING) AS value FROM sday""")
def fill_down(spark: SparkSession, sf: str) -> DataFrame:
    return T.fill_down(supplier_days(spark, sf).select("entity", "date", "value"), ["entity"], [F.col("date").asc()], ["value"])


@query("fill_up", f"""WITH {SDAY_SQL} SELECT entity, date, first_value(value IGNORE NULLS) {W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM sday""")
def fill_up(spark: SparkSession, sf: str) -> DataFrame:
    return T.fill_up(supplier_days(spark, sf).select("entity", "date", "value"), ["entity"], [F.col("date").asc()], ["value"])


@query("fill_mean", f"""WITH {SDAY_SQL}, f AS (SELECT entity, date, value, last_value(value IGNORE NULLS) {W} ROWS UNBOUNDED PRECEDING) AS d,
first_value(value IGNORE NULLS) {W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS u FROM sday)
SELECT entity, date, CASE WHEN value IS NOT NULL THEN value WHEN d IS NULL THEN u WHEN u IS NULL THEN d ELSE (d + u)/2 END AS value FROM f""")
def fill_mean(spark: SparkSession, sf: str) -> DataFrame:
    return T.fill_mean_of_neighbours(
        supplier_days(spark, sf).select("entity", "date", "value"), ["entity"], [F.col("date").asc()], ["value"], F.col("value").isNull()
    )


# --- models ----------------------------------------------------------------------------------------------------

FIT_SQL = """fit AS (SELECT entity, avg(value) AS my, avg(yday) AS ma, avg(year) AS mb, var_pop(yday) AS vaa, var_pop(year) AS vbb,
covar_pop(yday, year) AS vab, covar_pop(yday, value) AS vay, covar_pop(year, value) AS vby FROM sday WHERE value IS NOT NULL GROUP BY 1),
slope AS (SELECT *, (vay*vbb - vby*vab)/(vaa*vbb - vab*vab) AS sa, (vby*vaa - vay*vab)/(vaa*vbb - vab*vab) AS sb FROM fit),
pred AS (SELECT entity, date, round(my + sa*(yday - ma) + sb*(year - mb), 5) AS predicted FROM sday JOIN slope USING (entity) WHERE value IS NULL)"""


@query("impute_linear", f"WITH {SDAY_SQL}, {FIT_SQL} SELECT * FROM pred")
def impute_linear(spark: SparkSession, sf: str) -> DataFrame:
    out = I.impute_linear(store_once(supplier_days(spark, sf)), ["entity"], "value")
    return out.select("entity", "date", r("predicted", 5).alias("predicted"))


KNN_SQL = """pairs AS (SELECT m.entity, m.date, t.value, rank() OVER (PARTITION BY m.entity, m.date ORDER BY (m.yday - t.yday)*(m.yday - t.yday) + (m.year - t.year)*(m.year - t.year)) AS k
FROM sday m JOIN sday t ON m.entity = t.entity AND m.value IS NULL AND t.value IS NOT NULL)"""


@query("impute_knn", f"WITH {SDAY_SQL}, {KNN_SQL} SELECT entity, date, round(avg(value), 6) AS predicted FROM pairs WHERE k <= 4 GROUP BY 1, 2")
def impute_knn(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(I.impute_knn(store_once(supplier_days(spark, sf)), ["entity"], "value").select("entity", "date", "predicted"), "predicted")


MONTHLY_SQL = """SELECT l_suppkey AS station, CAST(month(l_shipdate) AS DOUBLE) * 30 AS yday, CAST(year(l_shipdate) AS DOUBLE) AS year,
CAST(count(*) AS DOUBLE) AS n, CAST(sum(round(l_quantity)) AS DOUBLE) AS total FROM lineitem GROUP BY 1, 2, 3"""
POOLED_SQL = f"""mon AS (SELECT *, CAST((station * 3) % 180 - 90 AS DOUBLE) AS lat, CAST((station * 7) % 360 - 180 AS DOUBLE) AS lon,
CASE WHEN (station + CAST(yday AS INT)//30 + CAST(year AS INT)) % 29 <> 0 THEN n END AS a,
CASE WHEN (station + CAST(yday AS INT)//30 + CAST(year AS INT)) % 31 <> 0 THEN total END AS b FROM ({MONTHLY_SQL}))"""


def pooled_knn_sql(target: str) -> str:
    return f"""{target}_rank AS (SELECT m.station, m.yday, m.year, t.{target} AS v, rank() OVER (PARTITION BY m.station, m.yday, m.year ORDER BY
(m.lat-t.lat)*(m.lat-t.lat) + (m.lon-t.lon)*(m.lon-t.lon) + (m.yday-t.yday)*(m.yday-t.yday) + (m.year-t.year)*(m.year-t.year)) AS k
FROM mon m, mon t WHERE m.{target} IS NULL AND t.{target} IS NOT NULL),
{target}_mean AS (SELECT station, yday, year, avg(v) AS p_{target} FROM {target}_rank WHERE k <= 5 GROUP BY 1, 2, 3)"""


@query("impute_knn_pooled", f"""WITH {POOLED_SQL}, {pooled_knn_sql('a')}, {pooled_knn_sql('b')}
SELECT station, yday, year, round(coalesce(a, p_a), 4) AS a, round(coalesce(b, p_b), 4) AS b FROM mon LEFT JOIN a_mean USING (station, yday, year) LEFT JOIN b_mean USING (station, yday, year)""")
def impute_knn_pooled(spark: SparkSession, sf: str) -> DataFrame:
    """Months of all stations as one pool, which grows with the stations."""
    monthly = table(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("station"), (F.month("l_shipdate") * 30).cast("double").alias("yday"), F.year("l_shipdate").cast("double").alias("year")
    ).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.round("l_quantity")).alias("total"))
    key = F.col("station") + (F.col("yday") / 30).cast("int") + F.col("year").cast("int")
    holes = monthly.withColumns({
        "lat": ((F.col("station") * 3) % 180 - 90).cast("double"), "lon": ((F.col("station") * 7) % 360 - 180).cast("double"),
        "a": F.when(key % 29 != 0, F.col("n")), "b": F.when(key % 31 != 0, F.col("total")),
    }).drop("n", "total")
    out = I.impute_knn_pooled(holes, ["a", "b"])
    return rounded(out.select("station", "yday", "year", "a", "b"), "a", "b", digits=4)


@query("merge_predicted", f"""WITH {SDAY_SQL}, {FIT_SQL} SELECT entity, date, value, 'observed' AS flag FROM sday WHERE value IS NOT NULL
UNION ALL SELECT entity, date, predicted, 'predicted' FROM pred""")
def merge_predicted(spark: SparkSession, sf: str) -> DataFrame:
    days = store_once(supplier_days(spark, sf))
    predicted = I.impute_linear(days, ["entity"], "value").withColumn("predicted", r("predicted", 5))
    return I.merge_predicted(days, predicted, ["entity", "date"], "value")
