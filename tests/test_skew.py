"""Hot keys: a third of the rows and more under one key, with the floor set low so that every path runs."""

from __future__ import annotations

import pytest
from pyspark.sql import Window, functions as F

from geoscore.operators import rank as R, series as T
from geoscore.operators.aggregate import concat_group
from geoscore.operators.skew import attach, block_join, dealt, global_index, salted_join, spread_join


def skewed(spark, n=3000):
    """Two thirds of the rows under key 0, a tenth under NULL."""
    key = F.when(F.col("id") % 10 == 9, None).when(F.col("id") % 3 != 0, 0).otherwise(F.col("id") % 37)
    return spark.range(n).select(
        "id", key.alias("k"), ((F.col("id") * 7919) % 1009).cast("double").alias("v"),
        F.when((F.col("id") * 31) % 11 < 3, (F.col("id") % 97).cast("double")).alias("gappy"),
    )


def sets(df):
    return sorted(map(repr, df.collect()))


def test_salted_join_equals_join_on_both_hot_sides(spark):
    left = skewed(spark, 600).select("id", "k")
    right = skewed(spark, 300).select(F.col("id").alias("other"), "k")
    expected = sets(left.join(right, "k").select("id", "other", "k"))
    assert sets(salted_join(left, right, ["k"], floor=20).select("id", "other", "k")) == expected
    assert sets(salted_join(left, right, ["k"], floor=20, right_bounded=True).select("id", "other", "k")) == expected


def test_five_thousand_hot_keys_are_spread(spark):
    """Each key is cut without being counted, so there is no list of hot keys; a third of all rows lies under one."""
    days = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).alias("k"), "id")
    places = spark.range(5100).select(F.col("id").alias("k"), (F.col("id") % 9).alias("place")).unionByName(
        spark.createDataFrame([(7, 100), (None, 1)], "k long, place long")
    )
    got = spread_join(days, places, ["k"], ["id"], pieces=16)
    assert got.columns == ["k", "id", "place"]
    assert sets(got.select("id", "place")) == sets(days.join(places, "k").select("id", "place"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Range (0, 60000") == 1


def test_attach_matches_null_keys_and_keeps_all_rows(spark):
    df = skewed(spark)
    stats = df.groupBy("k").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    expected = sets(df.withColumn("s", F.sum("v").over(Window.partitionBy("k"))).select("id", "s"))
    assert sets(attach(df, stats, ["k"], count="n", floor=50).select("id", "s")) == expected
    assert sets(attach(df, stats.drop("n"), ["k"], floor=50).select("id", "s")) == expected


def test_global_index_is_a_permutation_in_order(many_ranges):
    got = global_index(skewed(many_ranges), [F.col("v").desc(), F.col("id").asc()]).orderBy("_g").collect()
    assert [r["_g"] for r in got] == list(range(3000))
    assert [(-r["v"], r["id"]) for r in got] == sorted((-r["v"], r["id"]) for r in got)


def test_group_rank_across_ranges(many_ranges):
    df = skewed(many_ranges)
    order = [F.col("v").desc(), F.col("id").asc()]
    expected = df.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(*order)).cast("bigint"))
    got = R.group_rank(df, ["k"], order, floor=100)
    assert sets(got.select("id", "rank")) == sets(expected.select("id", "rank"))


def test_ranks_leave_excluded_rows_unranked(many_ranges):
    got = R.global_rank(skewed(many_ranges), [F.col("v").asc(), F.col("id").asc()], "rank", F.col("gappy") > 50).collect()
    ranked = [r for r in got if r["rank"] is not None]
    assert len(got) == 3000 and sorted(r["rank"] for r in ranked) == list(range(1, len(ranked) + 1))
    assert all(r["gappy"] is not None and r["gappy"] > 50 for r in ranked)


def test_share_of_group(spark):
    got = R.share_of_group(skewed(spark), ["k"], "v", 100.0, floor=100).groupBy("k").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r["s"] - 100) < 1e-6 for r in got if r["s"] is not None)


def test_carried_values_cross_range_cuts(many_ranges):
    df = skewed(many_ranges)
    per = Window.partitionBy("k").orderBy("id")
    expected = df.select(
        "id", F.last("gappy", True).over(per.rowsBetween(Window.unboundedPreceding, 0)).alias("gappy_down"),
        F.first("gappy", True).over(per.rowsBetween(0, Window.unboundedFollowing)).alias("gappy_up"),
    )
    got = T.carried(df, ["k"], [F.col("id").asc()], ["gappy"], True, True).select("id", "gappy_down", "gappy_up")
    assert sets(got) == sets(expected)


def test_one_known_value_crosses_many_ranges(many_ranges):
    df = many_ranges.range(2000).select("id", F.when(F.col("id") == 3, 5.0).alias("v"))
    got = {r["id"]: r["v"] for r in T.fill_down(df, [], [F.col("id").asc()], ["v"]).collect()}
    assert got[2] is None and all(got[i] == 5.0 for i in range(3, 2000))


def test_concat_group_keeps_every_member_in_parts(many_ranges):
    df = skewed(many_ranges, 500).select("k", F.format_string("%04d", "id").alias("c"))
    got = concat_group(df, ["k"], "c", [F.col("c").asc()], part_size=40).collect()
    members = [(r["k"], m) for r in sorted(got, key=lambda r: (str(r["k"]), r["part"])) for m in r["text"].split(", ")]
    assert sorted(members, key=str) == sorted(((r["k"], r["c"]) for r in df.collect()), key=str)
    assert max(len(r["text"].split(", ")) for r in got) <= 40
    hot = "".join(r["text"] + ", " for r in sorted(got, key=lambda r: r["part"]) if r["k"] == 0).split(", ")[:-1]
    assert hot == sorted(hot)


def test_batches_end_with_everything_done_once(spark):
    todo, done = spark.range(25), spark.range(0).select("id")
    while not (batch := R.pending_batch(todo, done, ["id"], [F.col("id").asc()], 10)).isEmpty():
        ids = [r["id"] for r in R.merge_batch(done, batch).collect()]
        done = spark.createDataFrame([(i,) for i in ids], "id long")
    assert sorted(r["id"] for r in done.collect()) == list(range(25))


def test_rescale_edges(spark):
    df = spark.createDataFrame([(1.0, 7.0), (3.0, 7.0), (None, 7.0)], "a double, b double")
    got = R.rescale(df, {"x": ("a", (100, 0)), "y": ("b", (0, 100))}).collect()
    assert [r["x"] for r in got] == [100.0, 0.0, None]
    assert [r["y"] for r in got] == [50.0, 50.0, 50.0]


def test_dealt_takes_as_many_tasks_as_the_rows_need(spark):
    df = spark.range(4_000).selectExpr("id % 2000 AS k", "id")
    assert dealt(df, ["k"], 4_000, most=100).rdd.getNumPartitions() == 40
    once = dealt(df, ["k"], 4_000, most=100).groupBy("k").agg(F.max("id").alias("id"))
    assert once.count() == 2_000 and once.agg(F.sum("id")).first()[0] == sum(range(2_000, 4_000))


@pytest.mark.parametrize("most", [1, 50, 10**9])
def test_block_join_deals_pairs(spark, most):
    a = spark.range(300).selectExpr("CASE WHEN id % 10 = 0 THEN id ELSE 0 END AS k", "id AS a", "id % 3 AS wa")
    b = spark.range(60).selectExpr("CASE WHEN id % 2 = 0 THEN 0 ELSE id END AS k", "id AS b")
    pairs = block_join(a, b, ["k"], F.col("wa"), F.lit(1), most)
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, a.join(b, "k").collect()))
    largest = pairs.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest < pairs.count() / 4 or most > 1000
