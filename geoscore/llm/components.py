"""Connected components of a table of links, by alternating large and small stars.

Every round gathers, for each node, the least of its neighbours (combined before the shuffle) and hangs the node's other
neighbours on it. The links are written to the shared folder after each round, so the plan stays short and a lost
executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from geoscore.llm.common import Tables


def _hang(directed: DataFrame, take: str) -> DataFrame:
    """Links (a, b) grouped by a: every b that ``take`` names hangs on the least node of the group."""
    least = directed.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = directed.join(least.withColumnRenamed("a", "_a"), F.col("a") == F.col("_a"))
    out = joined.where(take).select(F.col("b").alias("x"), F.col("m").alias("y"))
    return out.where("x <> y")


def components(links: DataFrame, tables: Tables) -> DataFrame:
    """``(node, component)`` for every node with a link; the component is its least node.

    ``links`` has two columns ``a`` and ``b`` of one ordered type, without nulls, in any direction, repeated or not.
    """
    now = tables.store(links.where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct(), "links")
    mark = None
    while True:
        both = now.selectExpr("x AS a", "y AS b").unionAll(now.selectExpr("y AS a", "x AS b"))
        large = _hang(both, "b > a").distinct()
        # Small star: each node's smaller neighbours, and the node itself, hang on the least of them.
        down = large.selectExpr("x AS a", "y AS b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            down.join(least.withColumnRenamed("a", "_a"), F.col("a") == F.col("_a"))
            .select(F.explode(F.array("a", "b")).alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        )
        then = tables.store(small, "links")
        tables.drop(now)
        now = then
        # Two numbers say whether the round changed anything.
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(20,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return now.selectExpr("x AS node", "y AS component").unionAll(
        now.selectExpr("y AS node", "y AS component").distinct()
    )
