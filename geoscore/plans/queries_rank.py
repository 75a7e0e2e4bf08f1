"""Ranks, shares, rescaling, top-n."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from geoscore.functions.text import ranked_label
from geoscore.operators import rank as R
from geoscore.plans.registry import query, r, rounded, table

REVENUE_SQL = """rev AS (SELECT o_custkey AS custkey,
  CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT) * (100 - CAST(round(l_discount*100) AS BIGINT))) AS DOUBLE)/10000 AS revenue,
  count(DISTINCT CAST(o_orderdate AS DATE)) AS days, CAST(count(*) AS BIGINT) AS lines
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1),
place AS (SELECT c_custkey, c_name, c_nationkey, c_mktsegment, c_acctbal, n_regionkey, revenue, days, lines
  FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN rev ON c_custkey = custkey)"""


def customer_totals(spark: SparkSession, sf: str) -> DataFrame:
    """One row per customer with exact revenue, active days and line count (NULL without orders)."""
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        (F.round(F.col("l_extendedprice") * 100).cast("bigint")
         * (100 - F.round(F.col("l_discount") * 100).cast("bigint"))).alias("units"),
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    # Lines first meet in their own order (a small group), so a busy customer costs one row per order from there on.
    per_order = lines.groupBy("o_orderkey").agg(F.sum("units").alias("units"), F.count(F.lit(1)).alias("lines"))
    totals = orders.join(per_order, "o_orderkey").groupBy("o_custkey").agg(
        (F.sum("units").cast("double") / 10000).alias("revenue"), F.count_distinct("day").alias("days"),
        F.sum("lines").alias("lines"),
    )
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    return (
        table(spark, sf, "customer").join(nations, "c_nationkey")
        .join(totals.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")
        .select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal", "n_regionkey", "revenue", "days", "lines")
    )


def by_revenue() -> list:
    return [F.col("revenue").desc_nulls_last(), F.col("c_custkey").asc()]


def by_revenue_up() -> list:
    return [F.col("revenue").asc_nulls_last(), F.col("c_custkey").asc()]


@query("global_rank", f"""WITH {REVENUE_SQL}
SELECT c_custkey, revenue, CASE WHEN revenue IS NOT NULL THEN row_number() OVER (ORDER BY revenue DESC NULLS LAST, c_custkey) END AS rank,
  CASE WHEN revenue IS NOT NULL THEN row_number() OVER (ORDER BY revenue NULLS LAST, c_custkey) END AS rank_rev FROM place""")
def global_rank(spark: SparkSession, sf: str) -> DataFrame:
    known = F.col("revenue").isNotNull()
    ranked = R.global_rank(customer_totals(spark, sf), by_revenue(), "rank", known)
    return R.global_rank(ranked, by_revenue_up(), "rank_rev", known).select("c_custkey", "revenue", "rank", "rank_rev")


@query("group_rank", f"""WITH {REVENUE_SQL}
SELECT c_custkey, c_nationkey, n_regionkey,
  row_number() OVER (PARTITION BY c_nationkey ORDER BY revenue DESC NULLS LAST, c_custkey) AS rank_country,
  row_number() OVER (PARTITION BY n_regionkey ORDER BY revenue DESC NULLS LAST, c_custkey) AS rank_region
FROM place WHERE revenue IS NOT NULL""")
def group_rank(spark: SparkSession, sf: str) -> DataFrame:
    totals = customer_totals(spark, sf).where(F.col("revenue").isNotNull())
    ranked = R.group_rank(totals, ["c_nationkey"], by_revenue(), "rank_country")
    return R.group_rank(ranked, ["n_regionkey"], by_revenue(), "rank_region").select(
        "c_custkey", "c_nationkey", "n_regionkey", "rank_country", "rank_region"
    )


@query("conditional_rank", f"""WITH {REVENUE_SQL},
big AS (SELECT c_custkey, row_number() OVER (ORDER BY revenue DESC, c_custkey) AS rank_1,
  row_number() OVER (PARTITION BY n_regionkey ORDER BY revenue DESC, c_custkey) AS rank_region1
  FROM place WHERE lines >= 40 AND revenue IS NOT NULL)
SELECT c_custkey, lines, rank_1, rank_region1 FROM place LEFT JOIN big USING (c_custkey)""")
def conditional_rank(spark: SparkSession, sf: str) -> DataFrame:
    big = (F.col("lines") >= 40) & F.col("revenue").isNotNull()
    ranked = R.global_rank(customer_totals(spark, sf), by_revenue(), "rank_1", big)
    return R.group_rank(ranked, ["n_regionkey"], by_revenue(), "rank_region1", big).select(
        "c_custkey", "lines", "rank_1", "rank_region1"
    )


@query("share_of_group", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  round(365 * l_quantity / sum(l_quantity) OVER (PARTITION BY l_suppkey), 6) AS share FROM lineitem""")
def share_of_group(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    return rounded(R.share_of_group(lines, ["l_suppkey"], "l_quantity", 365.0), "share").drop("l_quantity")


@query("group_mean_attached", """SELECT event_id, user_id, event_type,
  round(avg(CAST(round(value*100) AS BIGINT)) OVER (PARTITION BY event_type), 6) AS avg_cents,
  count(*) OVER (PARTITION BY event_type) AS n FROM events""")
def group_mean_attached(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    out = R.group_stats_attached(events, ["event_type"], {"avg_cents": F.avg("cents"), "n": F.count(F.lit(1))})
    return rounded(out.drop("cents"), "avg_cents")


@query("rescale_range", f"""WITH {REVENUE_SQL}, b AS (SELECT min(revenue) r0, max(revenue) r1, min(c_acctbal) a0, max(c_acctbal) a1 FROM place)
SELECT c_custkey, round((revenue - r0)/(r1 - r0)*100, 6) AS revenue_points,
  round((c_acctbal - a0)/(a1 - a0)*(-100) + 100, 6) AS balance_points FROM place, b""")
def rescale_range(spark: SparkSession, sf: str) -> DataFrame:
    out = R.rescale(customer_totals(spark, sf), {
        "revenue_points": ("revenue", (0, 100)), "balance_points": ("c_acctbal", (100, 0)),
    })
    return rounded(out, "revenue_points", "balance_points").select("c_custkey", "revenue_points", "balance_points")


@query("percent_of_max", """SELECT p_partkey, round(p_retailprice / max(p_retailprice) OVER () * 100, 6) AS points,
  round(CAST(p_size AS DOUBLE) / 365 * 100, 6) AS share_of_year FROM part""")
def percent_of_max(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size")
    out = R.percent_of_max(parts, "p_retailprice").withColumn("share_of_year", F.col("p_size") / F.lit(365.0) * 100)
    return rounded(out, "points", "share_of_year").select("p_partkey", "points", "share_of_year")


@query("top_n", f"""WITH {REVENUE_SQL}
SELECT c_custkey, revenue, row_number() OVER (ORDER BY revenue DESC NULLS LAST, c_custkey) AS rank
FROM place QUALIFY rank <= 25""")
def top_n(spark: SparkSession, sf: str) -> DataFrame:
    return R.top_n(customer_totals(spark, sf).select("c_custkey", "revenue"), by_revenue(), 25)


@query("bottom_n", f"""WITH {REVENUE_SQL}
SELECT c_custkey, revenue, row_number() OVER (ORDER BY revenue NULLS LAST, c_custkey) AS rank
FROM place QUALIFY rank <= 25""")
def bottom_n(spark: SparkSession, sf: str) -> DataFrame:
    return R.top_n(customer_totals(spark, sf).select("c_custkey", "revenue"), by_revenue_up(), 25)


@query("detail_for_top", f"""WITH {REVENUE_SQL},
top AS (SELECT c_custkey, row_number() OVER (ORDER BY revenue DESC, c_custkey) AS rank, c_name FROM place
  WHERE lines >= 20 AND revenue IS NOT NULL QUALIFY rank <= 25)
SELECT o_orderkey, c_custkey, o_totalprice, rank, rank || '. ' || c_name AS label
FROM orders JOIN top ON o_custkey = c_custkey""")
def detail_for_top(spark: SparkSession, sf: str) -> DataFrame:
    detail = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    places = customer_totals(spark, sf).select("c_custkey", "c_name", "revenue", "lines")
    out = R.detail_for_top(
        places, "c_custkey", detail, by_revenue(), 25, (F.col("lines") >= 20) & F.col("revenue").isNotNull(),
        ranked_label(F.col("rank"), F.col("c_name")),
    )
    return out.select("o_orderkey", "c_custkey", "o_totalprice", "rank", "label")


@query("best_worst", f"""WITH {REVENUE_SQL}, x AS (SELECT c_custkey,
  row_number() OVER (ORDER BY revenue DESC, c_custkey) AS rank, row_number() OVER (ORDER BY revenue, c_custkey) AS rank_rev
  FROM place WHERE revenue IS NOT NULL)
SELECT *, CASE WHEN rank <= 25 THEN 'Best 25' WHEN rank_rev <= 25 THEN 'Worst 25' END AS top FROM x""")
def best_worst(spark: SparkSession, sf: str) -> DataFrame:
    totals = customer_totals(spark, sf).where(F.col("revenue").isNotNull()).select("c_custkey", "revenue")
    ranked = R.global_rank(R.global_rank(totals, by_revenue(), "rank"), by_revenue_up(), "rank_rev")
    return R.best_worst(ranked, "rank", "rank_rev", 25).drop("revenue")


@query("last_by_rank", """WITH x AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer)
SELECT * FROM x WHERE rank >= (SELECT count(*) FROM x) - 25""")
def last_by_rank(spark: SparkSession, sf: str) -> DataFrame:
    balances = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    ranked = R.global_rank(balances, [F.col("c_acctbal").desc(), F.col("c_custkey").asc()])
    return R.last_by_rank(ranked, "rank", 25).select("c_custkey", "rank")


@query("row_index", """SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_name, p_partkey) AS ind FROM part""")
def row_index(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    return R.add_index(parts, [F.col("p_name").asc(), F.col("p_partkey").asc()])


@query("top_by_text_number", """SELECT p_partkey, CAST(p_size AS VARCHAR) AS size_text,
  row_number() OVER (ORDER BY p_size DESC, p_partkey) AS rank FROM part QUALIFY rank <= 25""")
def top_by_text_number(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("string").alias("size_text"))
    return R.top_n(parts, [F.col("size_text").try_cast("int").desc_nulls_last(), F.col("p_partkey").asc()], 25)


@query("closest_one", """SELECT o_custkey, arg_min(o_orderkey, (abs(o_totalprice - 100000), o_orderkey)) AS o_orderkey,
  round(min(abs(o_totalprice - 100000)), 6) AS gap FROM orders GROUP BY 1""")
def closest_one(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumn("gap", F.abs(F.col("o_totalprice") - 100000))
    return orders.groupBy("o_custkey").agg(
        F.min_by("o_orderkey", F.struct("gap", "o_orderkey")).alias("o_orderkey"), r(F.min("gap")).alias("gap")
    )


@query("sorted_rows", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def sorted_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment").orderBy(
        F.col("c_acctbal").desc(), "c_custkey"
    )


@query("merge_batch", """WITH done AS (SELECT c_custkey, c_name FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'))
SELECT * FROM done UNION SELECT * FROM (SELECT c_custkey, c_name FROM customer
WHERE c_custkey NOT IN (SELECT c_custkey FROM done) ORDER BY c_custkey LIMIT 100)""")
def merge_batch(spark: SparkSession, sf: str) -> DataFrame:
    todo = table(spark, sf, "customer").select("c_custkey", "c_name")
    closed = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    done = todo.join(closed, "c_custkey", "left_semi")
    return R.merge_batch(done, R.pending_batch(todo, done, ["c_custkey"], [F.col("c_custkey").asc()], 100))


@query("pending_batch", """SELECT c_custkey, c_name FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') ORDER BY c_custkey LIMIT 100""")
def pending_batch(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("c_custkey"))
    todo = table(spark, sf, "customer").select("c_custkey", "c_name")
    return R.pending_batch(todo, done, ["c_custkey"], [F.col("c_custkey").asc()], 100)
