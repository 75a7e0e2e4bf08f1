"""Points in areas, points near points.

Every join here turns its geometric condition into an equi-join on grid cells first, so no side is compared row by
row with the whole of the other. Hot cells are salted on both sides. A polygon's cell holds only the sides that touch it
and whether one spot in it lies inside, which decides for all its points; cells with many sides are cut in four until
they hold few, so an outline of any length costs a few sides per point.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from geoscore.functions.geo import EARTH_RADIUS_KM, finite, haversine_km, snap, unit_vector
from geoscore.operators.skew import HOT_FLOOR, PAIRS_PER_PIECE, attach, block_join, salted_join, with_scalars
from geoscore.session import store_once

_CELLS_ACROSS = 4  # a polygon's box spans at most this many cells (plus one) of its own grid level, each way
_SIDES = 16  # a cell with more sides is cut in four
_HALVINGS = 24  # how often at most: where very many sides meet in one spot, its cell keeps them all
_IDS = 256  # ids of one spot that are held in one row
# The spot whose state a cell knows: odd fractions of its width and height, so that no real outline runs through it.
_SPOT = (0.41421356237309503, 0.2360679774997897)


def box_rings(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """A rectangle as a list of one ring."""
    def corner(x: Column, y: Column) -> Column:
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    return F.array(F.array(
        corner(xmin, ymin), corner(xmax, ymin), corner(xmax, ymax), corner(xmin, ymax), corner(xmin, ymin)
    ))


def _edges(rings: Column) -> Column:
    """All sides of all rings; a ring that is not closed gets its closing side."""
    def of_ring(ring: Column) -> Column:
        n = F.size(ring)
        return F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
            ring[i - 1]["x"].alias("x1"), ring[i - 1]["y"].alias("y1"),
            ring[i % n]["x"].alias("x2"), ring[i % n]["y"].alias("y2"),
        ))

    return F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) > 0), of_ring))


def _on_edge(e: Column, x: Column, y: Column) -> Column:
    turn = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
    return (
        (turn == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    )


def _crosses(e: Column, x: Column, y: Column) -> Column:
    """A ray to the right of the point meets this side."""
    at = e["x1"] + F.try_divide((y - e["y1"]) * (e["x2"] - e["x1"]), e["y2"] - e["y1"])
    return ((e["y1"] > y) != (e["y2"] > y)) & F.coalesce(x < at, F.lit(False))


def _squared_distance(e: Column, x: Column, y: Column) -> Column:
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    along = F.coalesce(F.try_divide((x - e["x1"]) * dx + (y - e["y1"]) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    px, py = x - (e["x1"] + t * dx), y - (e["y1"] + t * dy)
    return px * px + py * py


def _with_box(polygons: DataFrame, rings: str, margin: float) -> DataFrame:
    edges = F.col("_edges")
    x1, y1 = F.transform(edges, lambda e: e["x1"]), F.transform(edges, lambda e: e["y1"])
    grow = F.lit(float(margin))
    boxed = polygons.withColumn("_edges", _edges(F.col(rings))).withColumns({
        "_xmin": F.array_min(x1) - grow, "_ymin": F.array_min(y1) - grow,
        "_xmax": F.array_max(x1) + grow, "_ymax": F.array_max(y1) + grow,
    })
    span = F.greatest(F.col("_xmax") - F.col("_xmin"), F.col("_ymax") - F.col("_ymin"), F.lit(1e-9))
    return boxed.where(F.col("_xmin").isNotNull()).withColumn(
        "_level", F.ceil(F.log2(span / _CELLS_ACROSS)).cast("int")
    )


def _cell(c: Column, level: Column) -> Column:
    return F.floor(c / F.pow(F.lit(2.0), level)).cast("bigint")


def _near_sides(edges: Column, margin: float) -> Column:
    """The sides that come within ``margin`` of the row's cell, found by its grown square; a few too many at most."""
    width = F.pow(F.lit(2.0), F.col("_level"))
    x0, y0 = F.col("_cx") * width, F.col("_cy") * width
    # The square is a little larger than the cell, so that rounding loses no side that touches it.
    grow = F.lit(float(margin)) * (1 + 1e-9) + width * 1e-9 + (F.abs(x0) + F.abs(y0)) * 1e-14
    left, right, bottom, top = x0 - grow, x0 + width + grow, y0 - grow, y0 + width + grow

    def touches(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        # Where the corners lie to one hand of the side's line, it passes by.
        turns = [dx * (y - e["y1"]) - dy * (x - e["x1"]) for x in (left, right) for y in (bottom, top)]
        return (
            (F.greatest(e["x1"], e["x2"]) >= left) & (F.least(e["x1"], e["x2"]) <= right)
            & (F.greatest(e["y1"], e["y2"]) >= bottom) & (F.least(e["y1"], e["y2"]) <= top)
            & (F.greatest(*turns) >= 0) & (F.least(*turns) <= 0)
        )

    return F.filter(edges, touches)


def _spot() -> tuple[Column, Column]:
    width = F.pow(F.lit(2.0), F.col("_level"))
    return (F.col("_cx") + _SPOT[0]) * width, (F.col("_cy") + _SPOT[1]) * width


def _changes(edges: Column, from_x: Column, from_y: Column, x: Column, y: Column) -> Column:
    """Whether going from one point up or down, then sideways to another, crosses the outline an odd number of times.

    Heights are those just above y, as in :func:`_crosses`, and places those just right of x.
    """
    def upright(e: Column) -> Column:
        at = e["y1"] + F.try_divide((from_x - e["x1"]) * (e["y2"] - e["y1"]), e["x2"] - e["x1"])
        return ((e["x1"] > from_x) != (e["x2"] > from_x)) & F.coalesce((from_y < at) != (y < at), F.lit(False))

    def level(e: Column) -> Column:
        at = e["x1"] + F.try_divide((y - e["y1"]) * (e["x2"] - e["x1"]), e["y2"] - e["y1"])
        return ((e["y1"] > y) != (e["y2"] > y)) & F.coalesce((from_x < at) != (x < at), F.lit(False))

    return F.aggregate(edges, F.lit(False), lambda odd, e: (odd != upright(e)) != level(e))


def polygon_cells(polygons: DataFrame, polygon_id: str, rings: str = "rings", margin: float = 0.0, most: int = _SIDES,
                  halvings: int = _HALVINGS) -> DataFrame:
    """Cells that cover the polygons, grown by ``margin``: ``_level``, ``_cx``, ``_cy``, the sides ``_edges`` that come
    within the margin of the cell, and whether its spot is ``_inside``. Cells far outside are left out; one far inside has
    no sides and is taken whole. No cell overlaps another of its polygon.
    """
    boxed = _with_box(polygons.select(polygon_id, rings), rings, margin).drop(rings)
    level = F.col("_level")
    x, y = _spot()

    def useful(cells: DataFrame) -> DataFrame:
        return cells.where(F.col("_inside") | (F.size("_edges") > 0))

    whole = F.col("_edges")
    cells = (
        boxed
        .withColumn("_cx", F.explode(F.sequence(_cell(F.col("_xmin"), level), _cell(F.col("_xmax"), level))))
        .withColumn("_cy", F.explode(F.sequence(_cell(F.col("_ymin"), level), _cell(F.col("_ymax"), level))))
        .select(
            polygon_id, level, "_cx", "_cy", _near_sides(whole, margin).alias("_edges"),
            (F.aggregate(whole, F.lit(0), lambda n, e: n + F.when(_crosses(e, x, y), 1).otherwise(0)) % 2 == 1).alias("_inside"),
        )
    )
    # One number says whether any outline is long; short ones stay one lazy step.
    longest = boxed.agg(F.max(F.size("_edges"))).first()[0] or 0
    if longest <= most:
        return useful(cells)
    done: list[DataFrame] = []
    for _ in range(halvings):
        # Stored before useless cells go, since a filter on what a lambda makes would make it twice.
        cells = useful(store_once(cells, "cells"))
        # Cells narrower than the margin would all keep the same sides.
        crowded = (F.size("_edges") > most) & (F.pow(F.lit(2.0), level) > F.lit(float(margin)))
        busy = cells.where(crowded)
        if busy.isEmpty():
            break
        done.append(cells.where(~crowded))
        parent_x, parent_y = _spot()
        quarters = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
        split = busy.withColumns({"_sx": parent_x, "_sy": parent_y, "_q": quarters}).withColumn("_q", F.explode("_q")).select(
            polygon_id, (level - 1).alias("_level"), (F.col("_cx") * 2 + F.col("_q.a")).alias("_cx"),
            (F.col("_cy") * 2 + F.col("_q.b")).alias("_cy"), F.col("_edges").alias("_all"), "_inside", "_sx", "_sy",
        )
        x, y = _spot()
        cells = split.select(
            polygon_id, "_level", "_cx", "_cy", _near_sides(F.col("_all"), margin).alias("_edges"),
            # The way from the parent's spot to the child's stays in the parent, so only the parent's sides can cross it.
            (F.col("_inside") != _changes(F.col("_all"), F.col("_sx"), F.col("_sy"), x, y)).alias("_inside"),
        )
    done.append(useful(cells))
    return reduce(lambda a, b: a.unionByName(b), done)


def polygon_point_pairs(points: DataFrame, polygons: DataFrame, point_id: str, polygon_id: str, lon: str = "lon",
                        lat: str = "lat", rings: str = "rings", margin: float = 0.0,
                        floor: int = HOT_FLOOR) -> DataFrame:
    """(polygon id, point id) for every point inside a polygon, on its edge, or within ``margin`` of it.

    Inside is by the even-odd rule, so rings within rings are holes. Each polygon starts from the grid level at which its box is a few cells wide, whatever its size; a point is looked up
    once per level in use (at most a few dozen). A point's cell says in or out by the few sides in it.
    """
    covered = polygon_cells(polygons, polygon_id, rings, margin)
    level = F.col("_level")
    located = points.select(point_id, F.col(lon).cast("double").alias("_px"), F.col(lat).cast("double").alias("_py")) \
        .where(finite(F.col("_px")).isNotNull() & finite(F.col("_py")).isNotNull())
    per_level = with_scalars(located, F.collect_set("_level").alias("_levels"), source=covered)
    placed = per_level.withColumn("_level", F.explode("_levels")).drop("_levels") \
        .withColumn("_cx", _cell(F.col("_px"), level)).withColumn("_cy", _cell(F.col("_py"), level))
    candidates = salted_join(placed, covered, ["_level", "_cx", "_cy"], floor)
    x, y, edges = F.col("_px"), F.col("_py"), F.col("_edges")
    inside = F.col("_inside") != _changes(edges, *_spot(), x, y)
    hit = inside | F.exists(edges, lambda e: _on_edge(e, x, y))
    if margin:
        hit = hit | F.exists(edges, lambda e: _squared_distance(e, x, y) <= F.lit(float(margin) ** 2))
    return candidates.where(hit).select(polygon_id, point_id)


def point_in_polygon_join(points: DataFrame, polygons: DataFrame, point_id: str, polygon_id: str, how: str = "left",
                          margin: float = 0.0, **columns: str) -> DataFrame:
    """Polygons with the points in them. ``left`` keeps polygons without points, with a NULL point."""
    pairs = polygon_point_pairs(points, polygons, point_id, polygon_id, margin=margin, **columns)
    if how == "inner":
        return pairs
    pairs = store_once(pairs, "pairs")
    empty = polygons.select(polygon_id).join(pairs.select(polygon_id).distinct(), polygon_id, "left_anti")
    return pairs.unionByName(empty, allowMissingColumns=True)


def buffer_join(points: DataFrame, polygons: DataFrame, point_id: str, polygon_id: str, dist: float,
                **columns: str) -> DataFrame:
    """Points inside a polygon or within a margin of it (planar, in the coordinates' unit)."""
    return polygon_point_pairs(points, polygons, point_id, polygon_id, margin=dist, **columns)


def polygon_tag(points: DataFrame, regions: DataFrame, point_id: str, region_id: str, attributes: Sequence[str] = (),
                **columns: str) -> DataFrame:
    """Points with the region they lie in and its attributes; points in no region are dropped."""
    pairs = polygon_point_pairs(points, regions, point_id, region_id, **columns)
    if not attributes:
        return pairs
    return attach(store_once(pairs, "pairs"), regions.select(region_id, *attributes), [region_id], how="inner")


def region_lookup(points: DataFrame, regions: DataFrame, point_id: str, region_name: str, **columns: str) -> DataFrame:
    """Every point with its region's name, NULL for none; of several regions the first by name.

    Filtering on the result is the land/water test.
    """
    named = polygon_point_pairs(points, regions, point_id, region_name, **columns) \
        .groupBy(point_id).agg(F.min(region_name).alias(region_name))
    return points.join(named, point_id, "left")


def _spots(df: DataFrame, key: str, lat: str, lon: str, side: str) -> DataFrame:
    """Distinct coordinates, their place on the unit sphere, and lists of the ids there, of about ``_IDS`` each.

    A spot with more ids has several rows, told apart by a hash of the id.
    """
    at = ["_lat" + side, "_lon" + side]
    located = df.select(F.struct(key).alias("_id"), *[finite(F.col(c).cast("double")).alias(n) for c, n in zip((lat, lon), at)]).dropna(subset=at)
    crowded = located.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / F.lit(_IDS)).alias("_lists")).where(F.col("_lists") > 1)
    listed = located.join(crowded, at, "left").withColumn("_list", F.coalesce(F.pmod(F.xxhash64("_id"), F.col("_lists")), F.lit(0)))
    return listed.groupBy(*at, "_list").agg(F.collect_list("_id").alias("_ids" + side)).drop("_list").withColumns(
        {n + side: v for n, v in unit_vector(F.col(at[0]), F.col(at[1])).items()}
    )


def radius_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, km: float, lat: str = "lat",
                lon: str = "lon", floor: int = PAIRS_PER_PIECE, digits: int | None = None) -> DataFrame:
    """All (left id, right id, distance) within a great-circle distance.

    Cells are cubes around the globe, twice the radius wide: a right point reaches at most two per axis, and the
    poles and the date line are nothing special. Points at one spot are compared once, and the work of a cell is cut into
    pieces of about ``floor`` pairs of points. Pairs well within the straight-line limit need no further test.
    ``digits`` rounds the distances.
    """
    half = math.sin(min(km / (2 * EARTH_RADIUS_KM), math.pi / 2))
    chord, sure = 2 * half * (1 + 1e-9) + 1e-12, 2 * half * (1 - 1e-9) - 1e-12
    width = F.lit(2 * chord)
    axes = ("_x", "_y", "_z")
    cells = [f"_c{a}" for a in axes]
    spots_left = store_once(_spots(left, left_id, lat, lon, "1"), "spots")
    spots_right = store_once(_spots(right, right_id, lat, lon, "2"), "spots")
    in_left = spots_left.withColumns({c: F.floor(F.col(a + "1") / width) for c, a in zip(cells, axes)})
    in_right = spots_right
    for c, a in zip(cells, axes):
        reach = F.sequence(F.floor((F.col(a + "2") - chord) / width), F.floor((F.col(a + "2") + chord) / width))
        in_right = in_right.withColumn(c, F.explode(reach))
    pairs = block_join(in_left, in_right, cells, F.size("_ids1"), F.size("_ids2"), floor)
    straight = reduce(lambda a, b: a + b, [(F.col(a + "1") - F.col(a + "2")) * (F.col(a + "1") - F.col(a + "2")) for a in axes])
    distance = haversine_km(F.col("_lat1"), F.col("_lon1"), F.col("_lat2"), F.col("_lon2"))
    within = (straight <= F.lit(chord * chord)) & (distance <= F.lit(float(km)))
    if sure > 0:
        within = (straight <= F.lit(sure * sure)) | within
    stated = distance if digits is None else F.round(distance, digits)
    return pairs.where(within).select("_ids1", "_ids2", stated.alias("distance")) \
        .select(F.explode("_ids1").alias("_id1"), "_ids2", "distance") \
        .select("_id1", F.explode("_ids2").alias("_id2"), "distance") \
        .select(F.col("_id1")[left_id].alias(left_id), F.col("_id2")[right_id].alias(right_id), "distance")


def cell_join(left: DataFrame, right: DataFrame, step: float, how: str = "left", lat: str = "lat",
              lon: str = "lon") -> DataFrame:
    """Join on rounded coordinates; ``right`` already has one row per cell (``lat_cell``, ``lon_cell``)."""
    celled = left.withColumn("lat_cell", snap(F.col(lat), step)).withColumn("lon_cell", snap(F.col(lon), step))
    return attach(celled, right, ["lat_cell", "lon_cell"], how=how)

