"""Outlines of areas put together from their members' outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from geoscore.operators.skew import global_index
from geoscore.session import store_once


def _turned_left(ring: Column) -> Column:
    """Twice the signed area of a ring: positive if it runs against the clock."""
    n = F.size(ring)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda s, i: s + (
        ring[i - 1]["x"] * ring[i % n]["y"] - ring[i % n]["x"] * ring[i - 1]["y"]
    ))


def _sides(members: DataFrame, region: str, rings: str) -> DataFrame:
    """All sides of all rings, with the inside to their left."""
    ring = members.select(region, F.posexplode(rings).alias("_at", "_ring")).where(F.size("_ring") > 2)
    outer = F.col("_at") == 0
    onward = (_turned_left(F.col("_ring")) > 0) == outer
    n = F.size("_ring")
    sides = ring.select(region, onward.alias("_onward"), F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
        F.col("_ring")[i - 1].alias("a"), F.col("_ring")[i % n].alias("b")
    ))).alias("_s"))
    first, last = F.when(F.col("_onward"), F.col("_s.a")).otherwise(F.col("_s.b")), F.when(F.col("_onward"), F.col("_s.b")).otherwise(F.col("_s.a"))
    # Adding zero turns -0.0 into 0.0, so that equal spots are equal keys.
    return sides.select(
        region, *[(p[c] + F.lit(0.0)).alias(n) for p, ends in ((first, ("x1", "y1")), (last, ("x2", "y2"))) for c, n in zip("xy", ends)]
    ).where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))


def outer_sides(members: DataFrame, region: str, rings: str = "rings") -> DataFrame:
    """``region, x1, y1, x2, y2``: the sides of the members that no neighbour of the same region shares, inside to the left."""
    sides = _sides(members, region, rings)
    swap = (F.col("x1") > F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") > F.col("y2")))
    ends = {n: F.when(swap, F.col(b)).otherwise(F.col(a)) for n, a, b in (("_ax", "x1", "x2"), ("_ay", "y1", "y2"), ("_bx", "x2", "x1"), ("_by", "y2", "y1"))}
    # A side that two members share is passed once in each direction, so its directions cancel.
    net = sides.select(region, F.when(swap, -1).otherwise(1).alias("_way"), *[c.alias(n) for n, c in ends.items()]).groupBy(
        region, *ends
    ).agg(F.sum("_way").alias("_way")).where("_way <> 0")
    back = F.col("_way") < 0
    return net.select(region, *[F.when(back, F.col(b)).otherwise(F.col(a)).alias(n) for n, a, b in (
        ("x1", "_ax", "_bx"), ("y1", "_ay", "_by"), ("x2", "_bx", "_ax"), ("y2", "_by", "_ay")
    )])


def region_outline(members: DataFrame, region: str, rings: str = "rings") -> DataFrame:
    """The union of the members of each region, as rows ``region, ring, seq, x, y``: the corners of each ring in order.

    Sides shared by two members vanish; what is left is chained into rings by doubling pointers, so no region and no ring
    is gathered in one task. Rings run with the inside to the left (outer ones against the clock, holes with it), start at
    their smallest corner and are numbered over all regions in order of that corner. Rings that touch at a corner stay apart.

    A member's first ring is its outline, the others are holes; members in several parts are given as several rows.
    Members do not overlap, and neighbours have the same corners along the border that they share. Corners in the middle
    of a straight border stay. Rings of fewer than three corners and NULL outlines are left out.
    """
    ordered = [F.col(region).asc_nulls_last(), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")]
    sides = store_once(global_index(outer_sides(members, region, rings), ordered, "_id"), "sides")
    # After each side comes the one that leaves its end by the sharpest turn to the left.
    leaving = sides.select(F.col(region).alias("_r"), F.col("x1").alias("_x1"), F.col("y1").alias("_y1"), F.col("x2").alias("_x2"), F.col("y2").alias("_y2"), F.col("_id").alias("_then"))
    met = sides.join(leaving, F.col(region).eqNullSafe(F.col("_r")) & (F.col("x2") == F.col("_x1")) & (F.col("y2") == F.col("_y1")))
    dx, dy, ex, ey = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("_x2") - F.col("_x1"), F.col("_y2") - F.col("_y1")
    turn = F.atan2(dx * ey - dy * ex, dx * ex + dy * ey)
    chained = store_once(met.groupBy("_id").agg(F.max_by("_then", F.struct(turn, "_then")).alias("_next")), "chain")

    # The smallest side of each ring, by looking twice as far ahead in every turn.
    state = chained.select("_id", F.col("_next").alias("_p"), F.least("_id", "_next").alias("_ring"))
    while True:
        ahead = state.select(F.col("_id").alias("_p"), F.col("_p").alias("_pp"), F.col("_ring").alias("_seen"))
        state = store_once(state.join(ahead, "_p").select(
            "_id", F.col("_pp").alias("_p"), F.least("_ring", "_seen").alias("_ring"), (F.col("_seen") < F.col("_ring")).alias("_changed")
        ), "rings")
        if state.where("_changed").isEmpty():
            break
    first = state.select("_id", "_ring")
    # How many sides follow each one before its ring is back at its start, in the same way.
    last = F.col("_next") == F.col("_ring")
    state = chained.join(first, "_id").select(
        "_id", F.when(~last, F.col("_next")).alias("_p"), F.when(last, 0).otherwise(1).cast("bigint").alias("_left")
    )
    while True:
        state = store_once(state, "places")
        if state.where("_p IS NOT NULL").isEmpty():
            break
        ahead = state.select(F.col("_id").alias("_q"), F.col("_p").alias("_pp"), F.col("_left").alias("_more"))
        state = state.join(ahead, F.col("_p") == F.col("_q"), "left").select(
            "_id", F.col("_pp").alias("_p"), (F.col("_left") + F.coalesce("_more", F.lit(0))).alias("_left")
        )
    lengths = state.join(first, "_id").where(F.col("_id") == F.col("_ring")).select("_ring", F.col("_left").alias("_all"))
    numbered = global_index(lengths, [F.col("_ring")], "ring")
    return (
        sides.join(state.select("_id", "_left"), "_id").join(first, "_id").join(numbered, "_ring")
        .select(region, "ring", (F.col("_all") - F.col("_left")).alias("seq"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    )
