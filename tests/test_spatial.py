"""Spatial joins and neighbour searches against brute force."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from geoscore.functions.geo import EARTH_RADIUS_KM
from geoscore.operators import impute as I, neighbours as K, spatial as S


def haversine(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * EARTH_RADIUS_KM * math.asin(min(1.0, math.sqrt(h)))


def points(n, seed, cluster=0.5):
    """Points all over the globe, half of them in one small town, some at the very same place."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if rng.random() < cluster:
            lat, lon = 40 + round(rng.random() * 0.3, 2), -75 + round(rng.random() * 0.3, 2)
        else:
            lat, lon = round(rng.uniform(-90, 90), 1), round(rng.uniform(-180, 180), 1)
        out.append((i, lat, lon))
    return out


def frame(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, lat double, lon double")


def test_concave_outline_with_hole_and_edges(spark):
    outer = [(0, 0), (10, 0), (10, 10), (5, 4), (0, 10), (0, 0)]
    hole = [(1, 1), (3, 1), (3, 3), (1, 3)]  # not closed on purpose
    shape = spark.createDataFrame([(1, [[{"x": float(x), "y": float(y)} for x, y in r] for r in (outer, hole)])],
                                  "area long, rings array<array<struct<x:double,y:double>>>")
    cases = {0: (5.0, 3.0, True), 1: (5.0, 8.0, False), 2: (2.0, 2.0, False), 3: (10.0, 5.0, True), 4: (0.0, 0.0, True),
             5: (3.0, 2.0, True), 6: (-0.1, 5.0, False), 7: (9.0, 8.0, True), 8: (5.0, 4.0, True)}
    pts = spark.createDataFrame([(i, y, x) for i, (x, y, _) in cases.items()], "p long, lat double, lon double")
    got = {r["p"] for r in S.point_in_polygon_join(pts, shape, "p", "area").collect()}
    assert got == {i for i, c in cases.items() if c[2]}
    near = {r["p"] for r in S.buffer_join(pts, shape, "p", "area", 0.2).collect()}
    assert near == got | {6}


def test_left_join_keeps_polygons_without_points(spark):
    boxes = spark.createDataFrame([(1, 0.0), (2, 50.0)], "area long, x double").withColumn(
        "rings", S.box_rings(F.col("x"), F.lit(0), F.col("x") + 1, F.lit(1)))
    pts = spark.createDataFrame([(7, 0.5, 0.5)], "p long, lat double, lon double")
    assert sorted(map(tuple, S.point_in_polygon_join(pts, boxes, "p", "area").collect()), key=str) == [(1, 7), (2, None)]


@pytest.mark.parametrize("floor", [20, 10**6])
def test_polygons_of_all_sizes(spark, floor):
    rng = random.Random(5)
    boxes = [(i, (x := rng.uniform(-170, 150)), (y := rng.uniform(-80, 60)), x + w, y + w / 2)
             for i, w in enumerate([0.01, 0.3, 2, 15, 40, 170] * 5)]
    pts = points(500, 6)
    areas = spark.createDataFrame(boxes, "area long, a double, b double, c double, d double").withColumn(
        "rings", S.box_rings(*[F.col(c) for c in "abcd"]))
    got = {tuple(r) for r in S.polygon_point_pairs(frame(spark, pts, "p"), areas, "p", "area", floor=floor).collect()}
    assert got == {(i, p) for i, a, b, c, d in boxes for p, lat, lon in pts if a <= lon <= c and b <= lat <= d}


@pytest.mark.parametrize("km, floor", [(20, 15), (300, 10**6), (9000, 10**6), (21000, 50)])
def test_radius_join(spark, km, floor):
    a = points(120, 1) + [(900, 89.9, 10.0), (901, 0.0, 179.95), (902, -90.0, 0.0)]
    b = points(120, 2) + [(900, 89.9, -170.0), (901, 0.0, -179.95), (902, -89.95, 120.0)]
    got = {(r["a"], r["b"]) for r in S.radius_join(frame(spark, a, "a"), frame(spark, b, "b"), "a", "b", km, floor=floor).collect()}
    assert got == {(i, j) for i, la, lo in a for j, lb, lp in b if haversine(la, lo, lb, lp) <= km}


def test_radius_join_deals_a_crowded_cell(spark):
    """All points in one cell, many at one spot and one id given twice: right pairs, in no single task."""
    a = [(i, 10.0, 20.0) for i in range(1200)] + [(i, 10.0 + i / 1e5, 20.0) for i in range(1200, 1500)] + [(3, 10.0, 20.0), (None, 10.0, 20.0), (-1, None, 1.0)]
    b = [(i, 10.0, 20.0 + i / 1e4) for i in range(40)] + [(99, 60.0, 20.0)]
    pairs = S.radius_join(frame(spark, a, "a"), frame(spark, b, "b"), "a", "b", 100.0, floor=2000, digits=3)
    assert pairs.count() == 1502 * 40 and pairs.where("a = 3").count() == 80 and pairs.where("a IS NULL").count() == 40
    assert pairs.select("a", "b").distinct().count() == 1501 * 40
    far = pairs.where("a = 1499 AND b = 39").first()["distance"]
    assert far == round(haversine(10.01499, 20.0, 10.0, 20.0039), 3)
    assert pairs.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 1502 * 20


@pytest.mark.parametrize("k, leaf, floor", [(1, 2, 10), (5, 4, 10**6), (3, None, 10**6), (500, 8, 10**6)])
def test_knn_join(spark, k, leaf, floor):
    q, p = points(80, 3), points(300, 4)
    got = {}
    for r in K.knn_join(frame(spark, q, "q"), frame(spark, p, "p"), "q", "p", k, ["lat", "lon"], leaf=leaf, floor=floor).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["p"]))
    for i, lat, lon in q:
        best = sorted(((lat - b) ** 2 + (lon - c) ** 2, j) for j, b, c in p)[:k]
        assert [j for _, j in sorted(got[i])] == [j for _, j in best]


def test_knn_with_everything_in_one_place(spark):
    p = [(i, 1.0, 1.0) for i in range(400)] + [(1000, 2.0, 2.0)]
    got = K.knn_join(frame(spark, [(0, 1.0, 1.0), (1, 5.0, 5.0)], "q"), frame(spark, p, "p"), "q", "p", 2, ["lat", "lon"], leaf=4).collect()
    assert sorted((r["q"], r["rank"], r["p"]) for r in got) == [(0, 1, 0), (0, 2, 1), (1, 1, 1000), (1, 2, 0)]


@pytest.mark.parametrize("radius", [0.15, 5.0, 60.0])
def test_bbox_nearest(spark, radius):
    q, p = points(80, 7), points(200, 8)
    got = {r["q"]: r["p"] for r in K.bbox_nearest_join(frame(spark, q, "q"), frame(spark, p, "p"), "q", "p", radius, leaf=4).collect()}
    for i, lat, lon in q:
        inside = [(haversine(lat, lon, b, c), j) for j, b, c in p if abs(b - lat) <= radius and abs(c - lon) <= radius]
        assert (i in got) == bool(inside)
        if inside:
            assert min(inside)[0] == pytest.approx(dict((j, d) for d, j in inside)[got[i]], abs=1e-6)


def test_expanding_nearest(spark):
    q, p, radii = points(60, 9, 0.2), points(40, 10, 0.2), [0.1, 1.1, 2.1, 9.1]
    got = {r["q"]: (r["p"], r["radius"]) for r in K.expanding_nearest_join(frame(spark, q, "q"), frame(spark, p, "p"), "q", "p", radii, leaf=4).collect()}
    for i, lat, lon in q:
        for radius in radii:
            inside = [(haversine(lat, lon, b, c), j) for j, b, c in p if abs(b - lat) <= radius and abs(c - lon) <= radius]
            if inside:
                assert got[i][1] == radius
                assert min(inside)[0] == pytest.approx(dict((j, d) for d, j in inside)[got[i][0]], abs=1e-6)
                break
        else:
            assert i not in got


def test_nearest_zone_on_empty_points(spark):
    assert K.knn_join(frame(spark, points(3, 1), "q"), frame(spark, [], "p"), "q", "p", 1, ["lat", "lon"]).count() == 0


def test_knn_impute_averages_all_ties(spark):
    rows = [("a", 10, 2000, 1.0), ("a", 12, 2000, 3.0), ("a", 9, 2000, 5.0), ("a", 13, 2000, 7.0), ("a", 8, 2000, 9.0),
            ("a", 14, 2000, 100.0), ("a", 11, 2000, None), ("b", 1, 2000, None)]
    df = spark.createDataFrame(rows, "e string, yday int, year int, v double")
    got = I.impute_knn(df, ["e"], "v", k=3).collect()
    # distances 1,1,2,2,3,3: the third place is a tie, so four values count
    assert [(r["e"], r["yday"], r["predicted"]) for r in got] == [("a", 11, 4.0)]


def test_pooled_impute_keeps_all_rows(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1, 1.0, None), (1.0, 0.0, 1, None, 2.0), (5.0, 5.0, 9, 4.0, 8.0)],
                               "lat double, lon double, yday int, a double, b double")
    got = {r["lat"]: (r["a"], r["b"]) for r in I.impute_knn_pooled(df, ["a", "b"], ["lat", "lon", "yday"], k=1).collect()}
    assert got == {0.0: (1.0, 2.0), 1.0: (1.0, 2.0), 5.0: (4.0, 8.0)}


@pytest.mark.parametrize("metric, k", [("euclid", 5), ("chebyshev", 3), ("euclid", 1700)])
@pytest.mark.parametrize("limited", [False, True])
def test_wide_pools_are_one_node_with_cells(spark, metric, k, limited):
    """Four dimensions: nothing is walked, and cells that are left out hold no neighbour, ties and far queries included."""
    import numpy as np

    rng = np.random.default_rng(8)
    dims = ["lat", "lon", "yday", "year"]
    p = np.unique(np.stack([rng.integers(-9, 9, 1800), rng.integers(-18, 18, 1800), rng.integers(1, 5, 1800) * 30, rng.integers(2000, 2004, 1800)], 1), axis=0)
    q = np.unique(np.concatenate([p[:70], p[:70] + [0, 0, 7, 0], rng.integers(-500, 3000, (30, 4))]), axis=0)
    kinds = "lat double, lon double, yday double, year double"
    points_ = spark.createDataFrame([(*map(float, x), 1) for x in p], kinds + ", _n long")
    queries_ = spark.createDataFrame([(*map(float, x), 0.5 + n % 3) for n, x in enumerate(q)], kinds + ", most double")
    tree = K.quantile_tree(points_, [], dims)
    assert len(p) > K.LEAF and len(tree.levels) == 1
    found = K.search(tree, queries_, k, dims, metric, {"year": "most"} if limited else None).collect()
    got = {}
    for r in found:
        got.setdefault(tuple(r["_q_" + c] for c in dims), set()).add(tuple(r["_l_" + c] for c in dims))
    for n, x in enumerate(q):
        gaps = np.abs(p - x)
        inside = gaps[:, 3] <= 0.5 + n % 3 if limited else np.ones(len(p), bool)
        far = gaps[inside].max(axis=1) if metric == "chebyshev" else (gaps[inside] ** 2).sum(axis=1)
        upto = np.sort(far)[k - 1] if len(far) >= k else np.inf
        assert got.get(tuple(map(float, x)), set()) == {tuple(map(float, y)) for y in p[inside][far <= upto]}


def test_linear_fit_and_its_degenerate_forms(spark):
    import numpy as np

    rng = random.Random(3)
    full = [("full", rng.randint(1, 365), rng.randint(1990, 2020), rng.random() * 30) for _ in range(200)]
    one_year = [("year", d, 2000, 2.0 * d) for d in (1, 5, 9)]
    one_day = [("day", 7, y, float(y)) for y in (1999, 2000, 2003)]
    same = [("mean", 7, 2000, v) for v in (1.0, 4.0)]
    df = spark.createDataFrame(full + one_year + one_day + same, "e string, yday int, year int, v double")
    fits = {r["e"]: r for r in I.linear_coefficients(df, ["e"], "v", "yday", "year").collect()}
    x = np.array([[1, d, y] for _, d, y, _ in full], dtype=float)
    want = np.linalg.lstsq(x, np.array([v for *_, v in full]), rcond=None)[0]
    got = fits["full"]
    assert np.allclose([got["intercept"], got["slope_1"], got["slope_2"]], want, rtol=1e-6)
    assert (fits["year"]["slope_1"], fits["year"]["slope_2"]) == (pytest.approx(2.0), 0.0)
    assert (fits["day"]["slope_1"], fits["day"]["slope_2"]) == (0.0, pytest.approx(1.0))
    assert (fits["mean"]["intercept"], fits["mean"]["slope_1"], fits["mean"]["slope_2"]) == (2.5, 0.0, 0.0)


def test_far_and_unknown_points_do_not_crowd_the_search(spark):
    """One far outlier, NaN and infinities: right answers, and cells stay as fine as without them."""
    spread = spark.range(600).select(
        "id", ((F.col("id") * 37) % 601 / 7).alias("x"), ((F.col("id") * 53) % 599 / 5).alias("y")
    )
    odd = spark.createDataFrame(
        [(1000, 1e12, 0.0), (1001, float("nan"), 1.0), (1002, 2.0, float("inf")), (1003, None, 1.0)], "id long, x double, y double"
    )
    points = spread.unionByName(odd).withColumnRenamed("id", "pid")
    queries = spread.where("id % 20 = 0").unionByName(odd)
    got = {(r["id"], r["rank"]): r["pid"] for r in K.knn_join(queries, points, "id", "pid", 3, ["x", "y"]).collect()}
    known = [(r["id"], r["x"], r["y"]) for r in spread.collect()] + [(1000, 1e12, 0.0)]
    for qid, x, y in [k for k in known if k[0] % 20 == 0]:
        near = sorted(((x - a) ** 2 + (y - b) ** 2, p) for p, a, b in known)[:3]
        assert [got[qid, k + 1] for k in range(3)] == [p for _, p in near]
    assert {q for q, _ in got} == {k[0] for k in known if k[0] % 20 == 0}


def stored_tables(monkeypatch):
    """Counts the tables that a search stores."""
    seen = []
    real = K.store_once
    monkeypatch.setattr(K, "store_once", lambda df, label="stored": seen.append(label) or real(df, label))
    return seen


@pytest.mark.parametrize("dims", [["x", "y"], ["x"]])
def test_outliers_far_in_every_dimension_are_cut_too(spark, monkeypatch, dims):
    """Ninety distinct points far out in all dimensions, 0.9 in a thousand, cost no more stored tables than none."""
    n = 20_000
    near = spark.range(n).select("id", ((F.col("id") * 7919) % 20_011 / 7).alias("x"), ((F.col("id") * 104_729) % 19_997 / 5).alias("y"))
    far = spark.range(18).select((F.col("id") + 10**6).alias("id"), (1e9 + F.col("id") * 1e6).alias("x"), (3e9 + F.col("id") * 7e5).alias("y"))
    points = near.unionByName(far).withColumnRenamed("id", "pid")
    queries = near.where("id % 1000 = 0").unionByName(far)
    seen = stored_tables(monkeypatch)
    K.knn_join(queries, near.withColumnRenamed("id", "pid"), "id", "pid", 3, dims, leaf=8).count()
    without = len(seen)
    seen.clear()
    got = {(r["id"], r["rank"]): r["pid"] for r in K.knn_join(queries, points, "id", "pid", 3, dims, leaf=8).collect()}
    assert len(seen) <= without + 2
    rows = [tuple(r) for r in points.collect()]
    for q, x, y in map(tuple, queries.collect()):
        best = sorted(((x - a) ** 2 + ((y - b) ** 2 if "y" in dims else 0), p) for p, a, b in rows)[:3]
        assert [got[q, i + 1] for i in range(3)] == [p for _, p in best]


def test_tree_of_ties_and_lines(spark):
    """All on one line, most at one value, and locations that differ in the limited columns alone."""
    rows = [(i, 5.0, float(i % 40), float(i // 40)) for i in range(400)] + [(1000 + i, 5.0 + 2.0**i, 0.0, 0.0) for i in range(60)]
    df = spark.createDataFrame(rows, "p long, x double, y double, w double")
    tree = K.point_tree(df, "p", 2, ["x", "y"], also=["w"], leaf=4)
    leaves = tree.places.groupBy("_path").count().agg(F.max("count")).first()[0]
    assert leaves <= 4 and tree.places.count() == 460 and len(tree.levels) < 16
    queries = df.where("p % 7 = 0").select(F.col("p").alias("q"), "x", "y", "w", F.lit(1.0).alias("r"))
    got = {}
    for r in K.knn_join(queries, tree, "q", "p", 2, ["x", "y"], within={"w": "r"}).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["p"]))
    for q, x, y, w, _ in map(tuple, queries.collect()):
        best = sorted(((x - a) ** 2 + (y - b) ** 2, p) for p, a, b, c in rows if abs(c - w) <= 1)[:2]
        assert [p for _, p in sorted(got[q])] == [p for _, p in best]


def test_groups_with_trees_of_their_own(spark):
    """One group of most points, many of one point, and a query group without points."""
    rows = [(i, "big", float(i * 37 % 501), float(i * 11 % 503)) for i in range(900)] + [(1000 + i, f"g{i}", 1.0, 2.0) for i in range(50)]
    df = spark.createDataFrame(rows, "p long, g string, x double, y double")
    queries = df.where("p % 9 = 0").select(F.col("p").alias("q"), "g", "x", "y").unionByName(
        spark.createDataFrame([(-1, "none", 0.0, 0.0), (-2, None, 0.0, 0.0)], "q long, g string, x double, y double")
    )
    got = {}
    for r in K.knn_join(queries, df, "q", "p", 3, ["x", "y"], by=["g"], leaf=4, floor=10).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["p"]))
    for q, g, x, y in map(tuple, queries.collect()):
        best = sorted(((x - a) ** 2 + (y - b) ** 2, p) for p, h, a, b in rows if h == g)[:3]
        assert [p for _, p in sorted(got.get(q, []))] == [p for _, p in best]


def shapes(rng):
    """Stars of many sides with a star-shaped hole, a comb, a ring of one spot repeated, and a plain triangle."""
    def star(cx, cy, size, n):
        return [(cx + size * (0.5 + 0.5 * rng.random()) * math.cos(2 * math.pi * i / n), cy + size * (0.5 + 0.5 * rng.random()) * math.sin(2 * math.pi * i / n))
                for i in range(n)]

    comb = [(0.0, -9.0), (40.0, -9.0)] + [(40 - i * 0.5, -8.0 if i % 2 else 8.0) for i in range(81)]
    return {1: [star(0, 0, 20, 700), star(0, 0, 5, 90)], 2: [star(30.3, 5.1, 3, 2000)], 3: [comb], 4: [[(7.0, 7.0)] * 5], 5: [[(-30, -30), (-10, -30), (-20, -12)]],
            6: [star(-25, 20, 2, 40), star(-15, 20, 2, 40)], 7: []}


def inside(rings, x, y):
    odd = False
    for ring in rings:
        for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]):
            if (c - a) * (y - b) - (d - b) * (x - a) == 0 and min(a, c) <= x <= max(a, c) and min(b, d) <= y <= max(b, d):
                return True
            if (b > y) != (d > y) and x < a + (y - b) * (c - a) / (d - b):
                odd = not odd
    return odd


def gap(rings, x, y):
    best = math.inf
    for ring in rings:
        for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]):
            length = (c - a) ** 2 + (d - b) ** 2
            t = max(0.0, min(1.0, ((x - a) * (c - a) + (y - b) * (d - b)) / length)) if length else 0.0
            best = min(best, math.hypot(x - a - t * (c - a), y - b - t * (d - b)))
    return best


@pytest.mark.parametrize("margin", [0.0, 0.75])
def test_long_outlines(spark, margin):
    """Outlines of up to 2,000 sides: right answers, and few sides in each cell."""
    rng = random.Random(11)
    outlines = shapes(rng)
    areas = spark.createDataFrame(
        [(i, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]) for i, rings in outlines.items()],
        "area long, rings array<array<struct<x:double,y:double>>>",
    )
    spots = [(rng.uniform(-35, 45), rng.uniform(-35, 30)) for _ in range(1500)] + [(rng.uniform(26, 34), rng.uniform(1, 9)) for _ in range(300)]
    spots += [p for rings in outlines.values() for ring in rings for p in ring[::17]] + [(x / 2, float(y)) for x in range(0, 80) for y in (-9, -8, 0, 8)]
    spots += [(float("nan"), 0.0), (0.0, float("inf"))]
    points = spark.createDataFrame([(i, float(y), float(x)) for i, (x, y) in enumerate(spots)], "p long, lat double, lon double")
    got = {tuple(r) for r in S.polygon_point_pairs(points, areas, "p", "area", margin=margin).collect()}
    sure, maybe = set(), set()
    for a, rings in outlines.items():
        for i, (x, y) in enumerate(spots):
            if math.isfinite(x) and math.isfinite(y):
                near = gap(rings, x, y) if margin else 1.0
                (maybe if margin and abs(near - margin) < 1e-9 else sure).update({(a, i)} if inside(rings, x, y) or near <= (margin or -1) else ())
    assert got - maybe == sure - maybe
    cells = S.polygon_cells(areas, "area", margin=margin)
    if not margin:
        assert cells.agg(F.max(F.size("_edges"))).first()[0] <= 16
    assert cells.groupBy("area", "_level", "_cx", "_cy").count().where("count > 1").isEmpty()


def test_sides_that_meet_in_one_spot(spark):
    """A fan of 200 sides through one spot cannot be cut apart; its cell keeps them."""
    fan = [p for k in range(100) for p in ((0.1, 0.1), (10 * math.cos(k / 20), 10 * math.sin(k / 20)))]
    areas = spark.createDataFrame([(1, [[{"x": x, "y": y} for x, y in fan]])], "area long, rings array<array<struct<x:double,y:double>>>")
    rng = random.Random(2)
    spots = [(rng.uniform(-10, 10), rng.uniform(-10, 10)) for _ in range(400)] + [(0.1 + rng.uniform(-1e-6, 1e-6), 0.1 + rng.uniform(-1e-6, 1e-6)) for _ in range(50)]
    points = spark.createDataFrame([(i, float(y), float(x)) for i, (x, y) in enumerate(spots)], "p long, lat double, lon double")
    got = {r["p"] for r in S.polygon_point_pairs(points, areas, "p", "area").collect()}
    assert got == {i for i, (x, y) in enumerate(spots) if inside([fan], x, y)}


def test_groups_that_fit_a_node_are_compared_in_blocks(spark):
    """No cuts and no way down for them; a spot without a group is met by no query; ties at the end all stay."""
    rows = [(g, i % 37, i // 37, float(i % 5)) for g in (1, 2, None) for i in range(500)]
    known = spark.createDataFrame(rows, "g long, x int, y int, v double").withColumn("_n", F.lit(1))
    tree = K.quantile_tree(known, ["g"], ["x", "y"], payload=["v"])
    assert len(tree.levels) == 1 and tree.places.where("g IS NULL").isEmpty()
    queries = spark.createDataFrame([(1, 5, 5), (2, -9, 40), (3, 1, 1), (None, 1, 1)], "g long, x int, y int")
    got = sorted(tuple(r) for r in K.search(tree, queries, 4, ["x", "y"], floor=1).select("_q_g", "_l_x", "_l_y", "v", "_d").collect())
    want = []
    for g, x, y in ((1, 5, 5), (2, -9, 40)):
        near = sorted((b - x) ** 2 + (c - y) ** 2 for a, b, c, _ in rows if a == g)
        want += [(g, b, c, v, (b - x) ** 2 + (c - y) ** 2) for a, b, c, v in rows if a == g and (b - x) ** 2 + (c - y) ** 2 <= near[3]]
    assert got == sorted(want)
