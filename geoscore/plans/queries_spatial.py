"""Points in areas and points near points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from geoscore.operators import neighbours as K, outlines as O, spatial as S
from geoscore.operators.spatial import box_rings
from geoscore.plans.bindings import BOX_SQL, CUST_SQL, SUPP_SQL, customers, nation_boxes, suppliers
from geoscore.plans.registry import query, r, table
from geoscore.session import scratch_path
from geoscore.sources.polygons import feature_json, read_polygons

KM_SQL = """2*6378.137::DOUBLE*asin(least(1.0::DOUBLE, sqrt(sin(radians(s.lat - c.lat)/2)*sin(radians(s.lat - c.lat)/2)
+ cos(radians(c.lat))*cos(radians(s.lat))*sin(radians(s.lon - c.lon)/2)*sin(radians(s.lon - c.lon)/2))))"""


@query("point_in_polygon", f"""WITH {BOX_SQL}, {CUST_SQL} SELECT nation_id, cid FROM box LEFT JOIN cust ON lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1""")
def point_in_polygon(spark: SparkSession, sf: str) -> DataFrame:
    return S.point_in_polygon_join(customers(spark, sf), nation_boxes(spark, sf), "cid", "nation_id")


# Per nation box: an outline of 963 sides whose top is a saw with a deep notch, and a hole.
OUTLINE_SQL = f"""{BOX_SQL}, verts AS (SELECT nation_id, 0 AS ring, 0 AS i, x0 AS x, y0 AS y FROM box UNION ALL SELECT nation_id, 0, 1, x1, y0 FROM box
UNION ALL SELECT nation_id, 0, 2 + k, x1 - k * 0.0625::DOUBLE, y0 + 30 - (k % 2) * 1.25::DOUBLE - CASE WHEN k BETWEEN 320 AND 640 THEN 12.5::DOUBLE ELSE 0 END
FROM box, generate_series(0, 960) g(k)
UNION ALL SELECT nation_id, 1, j, x0 + CASE WHEN j IN (0, 3) THEN 6 ELSE 15 END, y0 + CASE WHEN j < 2 THEN 3 ELSE 9 END FROM box, generate_series(0, 3) g(j)),
sides AS (SELECT nation_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny
FROM verts WINDOW w AS (PARTITION BY nation_id, ring ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


def nation_outlines(spark: SparkSession, sf: str) -> DataFrame:
    """Written as GeoJSON features and read back."""
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, x1, y0 = F.col("x0"), F.col("x1"), F.col("y0")
    saw = F.transform(F.sequence(F.lit(0), F.lit(960)), lambda k: point(
        x1 - k * 0.0625, y0 + 30 - (k % 2) * 1.25 - F.when(k.between(320, 640), 12.5).otherwise(0.0)
    ))
    outer = F.concat(F.array(point(x0, y0), point(x1, y0)), saw)
    hole = F.array(*[point(x0 + dx, y0 + dy) for dx, dy in ((6, 3), (15, 3), (15, 9), (6, 9))])
    path = scratch_path(spark, "outlines")
    nation_boxes(spark, sf).withColumn("rings", F.array(outer, hole)).select(feature_json(["nation_id"]).alias("value")).write.text(path)
    return read_polygons(spark, path, T.StructType([T.StructField("nation_id", T.IntegerType())]))


@query("point_in_outline", f"""WITH {OUTLINE_SQL}, {CUST_SQL} SELECT nation_id, cid FROM cust JOIN box ON lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y0 + 30
JOIN sides USING (nation_id) GROUP BY 1, 2
HAVING count(*) FILTER (WHERE (y > lat) <> (ny > lat) AND lon < x + (lat - y) * (nx - x) / nullif(ny - y, 0)) % 2 = 1
OR count(*) FILTER (WHERE (nx - x) * (lat - y) - (ny - y) * (lon - x) = 0 AND lon BETWEEN least(x, nx) AND greatest(x, nx) AND lat BETWEEN least(y, ny) AND greatest(y, ny)) > 0""")
def point_in_outline(spark: SparkSession, sf: str) -> DataFrame:
    return S.point_in_polygon_join(customers(spark, sf), nation_outlines(spark, sf), "cid", "nation_id", how="inner")


@query("polygon_tag", f"""WITH {BOX_SQL}, {CUST_SQL} SELECT cid, nation_id, nation_name, r_name FROM cust JOIN box ON lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1
JOIN region ON region_key = r_regionkey""")
def polygon_tag(spark: SparkSession, sf: str) -> DataFrame:
    regions = nation_boxes(spark, sf).join(table(spark, sf, "region").withColumnRenamed("r_regionkey", "region_key"), "region_key")
    return S.polygon_tag(customers(spark, sf), regions, "cid", "nation_id", ["nation_name", "r_name"])


@query("region_lookup", f"""WITH {BOX_SQL}, {SUPP_SQL} SELECT sid, min(nation_name) AS nation_name FROM supp LEFT JOIN box ON lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1 GROUP BY 1""")
def region_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return S.region_lookup(suppliers(spark, sf), nation_boxes(spark, sf), "sid", "nation_name").select("sid", "nation_name")


@query("buffer_join", f"""WITH {BOX_SQL}, {CUST_SQL} SELECT nation_id, cid FROM box JOIN cust
ON pow(greatest(x0 - lon, 0, lon - x1), 2) + pow(greatest(y0 - lat, 0, lat - y1), 2) <= 2.55*2.55""")
def buffer_join(spark: SparkSession, sf: str) -> DataFrame:
    return S.buffer_join(customers(spark, sf), nation_boxes(spark, sf), "cid", "nation_id", 2.55)


@query("radius_join", f"""WITH {CUST_SQL}, {SUPP_SQL}, p AS (SELECT cid, sid, {KM_SQL} AS km FROM cust c, supp s)
SELECT cid, sid, round(km, 6) AS distance FROM p WHERE km <= 600""")
def radius_join(spark: SparkSession, sf: str) -> DataFrame:
    return S.radius_join(customers(spark, sf), suppliers(spark, sf), "cid", "sid", 600.0, digits=6)


@query("knn_join", f"""WITH {CUST_SQL}, {SUPP_SQL}, p AS (SELECT cid, sid, (s.lat - c.lat)*(s.lat - c.lat) + (s.lon - c.lon)*(s.lon - c.lon) AS d FROM cust c, supp s),
q AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY d, sid) AS rank FROM p)
SELECT cid, sid, round(sqrt(d), 6) AS distance, CAST(rank AS INT) AS rank FROM q WHERE rank <= 5""")
def knn_join(spark: SparkSession, sf: str) -> DataFrame:
    out = K.knn_join(customers(spark, sf), suppliers(spark, sf), "cid", "sid", 5, ["lat", "lon"])
    return out.withColumn("distance", r("distance"))


@query("nearest_feature", f"""WITH {CUST_SQL}, {SUPP_SQL}, p AS (SELECT cid, sid, (s.lon - c.lon)*(s.lon - c.lon) + (s.lat - c.lat)*(s.lat - c.lat) AS d FROM cust c, supp s)
SELECT cid, sid, round(sqrt(d), 6) AS distance FROM p QUALIFY row_number() OVER (PARTITION BY cid ORDER BY d, sid) = 1""")
def nearest_feature(spark: SparkSession, sf: str) -> DataFrame:
    return K.nearest_feature(customers(spark, sf), suppliers(spark, sf), "cid", "sid").withColumn("distance", r("distance"))


@query("bbox_nearest", f"""WITH {CUST_SQL}, {SUPP_SQL}, p AS (SELECT cid, sid, {KM_SQL} AS km FROM cust c, supp s WHERE abs(s.lat - c.lat) <= 8 AND abs(s.lon - c.lon) <= 8)
SELECT cid, sid, round(km, 6) AS distance FROM p QUALIFY row_number() OVER (PARTITION BY cid ORDER BY km, sid) = 1""")
def bbox_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return K.bbox_nearest_join(customers(spark, sf), suppliers(spark, sf), "cid", "sid", 8.0).withColumn("distance", r("distance"))


RADII = [0.1 + i for i in range(10)]


@query("expanding_nearest", f"""WITH {CUST_SQL}, {SUPP_SQL}, steps AS (SELECT unnest([{', '.join(f'{x!r}::DOUBLE' for x in RADII)}]) AS radius),
g AS (SELECT cid, min(greatest(abs(s.lat - c.lat), abs(s.lon - c.lon))) AS gap FROM cust c, supp s GROUP BY 1),
f AS (SELECT cid, min(radius) AS radius FROM g JOIN steps ON radius >= gap GROUP BY 1),
p AS (SELECT cid, sid, radius, {KM_SQL} AS km FROM f JOIN cust c USING (cid), supp s WHERE abs(s.lat - c.lat) <= radius AND abs(s.lon - c.lon) <= radius)
SELECT cid, sid, round(km, 6) AS distance, radius FROM p QUALIFY row_number() OVER (PARTITION BY cid ORDER BY km, sid) = 1""")
def expanding_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return K.expanding_nearest_join(customers(spark, sf), suppliers(spark, sf), "cid", "sid", RADII).withColumn("distance", r("distance"))


# The nations as adjoining boxes on a 5 by 5 grid, in three regions around each other: two of them have a hole.
TILE_SQL = """tile AS (SELECT n_nationkey AS nation_id, greatest(abs(n_nationkey % 5 - 2), abs(n_nationkey // 5 - 2)) AS belt,
CAST(-180 + (n_nationkey % 5) * 72 AS DOUBLE) AS x0, CAST(-90 + (n_nationkey // 5) * 36 AS DOUBLE) AS y0 FROM nation)"""


@query("region_outline", f"""WITH RECURSIVE {TILE_SQL}, s AS (SELECT belt, x0 AS x1, y0 AS y1, x0 + 72 AS x2, y0 AS y2 FROM tile
UNION ALL SELECT belt, x0 + 72, y0, x0 + 72, y0 + 36 FROM tile UNION ALL SELECT belt, x0 + 72, y0 + 36, x0, y0 + 36 FROM tile UNION ALL SELECT belt, x0, y0 + 36, x0, y0 FROM tile),
e AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.belt = s.belt AND t.x1 = s.x2 AND t.y1 = s.y2 AND t.x2 = s.x1 AND t.y2 = s.y1)),
walk AS (SELECT belt, x1 AS sx, y1 AS sy, x1 AS x, y1 AS y, x2 AS nx, y2 AS ny, 0 AS seq FROM e
UNION ALL SELECT w.belt, sx, sy, e.x1, e.y1, e.x2, e.y2, seq + 1 FROM walk w JOIN e ON e.belt = w.belt AND e.x1 = w.nx AND e.y1 = w.ny WHERE (w.nx, w.ny) > (sx, sy)),
r AS (SELECT belt, sx, sy, row_number() OVER (ORDER BY belt, sx, sy) - 1 AS ring FROM walk WHERE nx = sx AND ny = sy)
SELECT CAST(belt AS INT) AS belt, ring, CAST(seq AS BIGINT) AS seq, x, y FROM walk JOIN r USING (belt, sx, sy)""")
def region_outline(spark: SparkSession, sf: str) -> DataFrame:
    column, row = F.col("n_nationkey") % 5, F.floor(F.col("n_nationkey") / 5)
    x0, y0 = (column * 72 - 180).cast("double"), (row * 36 - 90).cast("double")
    tiles = table(spark, sf, "nation").select(
        F.greatest(F.abs(column - 2), F.abs(row - 2)).cast("int").alias("belt"), box_rings(x0, y0, x0 + 72, y0 + 36).alias("rings")
    )
    return O.region_outline(tiles, "belt")
