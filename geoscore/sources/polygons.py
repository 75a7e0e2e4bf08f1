"""Area outlines with attributes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def _schema(attributes: T.StructType) -> tuple[T.StructType, T.DataType, T.DataType]:
    point = T.ArrayType(T.DoubleType())
    return T.StructType([
        T.StructField("properties", attributes),
        T.StructField("geometry", T.StructType([
            T.StructField("type", T.StringType()),
            T.StructField("coordinates", T.StringType()),
        ])),
    ]), T.ArrayType(T.ArrayType(point)), T.ArrayType(T.ArrayType(T.ArrayType(point)))


def _rings(kind: Column, coordinates: Column, polygon: T.DataType, multi: T.DataType) -> Column:
    nested = F.when(kind == "Polygon", F.from_json(coordinates, polygon)).when(
        kind == "MultiPolygon", F.flatten(F.from_json(coordinates, multi))
    )
    return F.transform(nested, lambda ring: F.transform(
        ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    ))


def read_polygons(spark: SparkSession, paths: str | Sequence[str], attributes: T.StructType,
                  one_per_line: bool = True) -> DataFrame:
    """GeoJSON features as attribute columns plus ``rings`` (list of lists of x, y).

    One feature per line is the form that splits; a whole FeatureCollection per file is read too.
    """
    feature, polygon, multi = _schema(attributes)
    if one_per_line:
        features = spark.read.schema(feature).json(paths)
    else:
        whole = T.StructType([T.StructField("features", T.ArrayType(feature))])
        features = spark.read.schema(whole).option("multiLine", True).json(paths).select(F.inline("features"))
    return features.select(
        "properties.*", _rings(F.col("geometry.type"), F.col("geometry.coordinates"), polygon, multi).alias("rings")
    )


def feature_json(attributes: Sequence[str], rings: str = "rings") -> Column:
    """A row as one GeoJSON feature."""
    outline = F.transform(F.col(rings), lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.struct(*attributes).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), outline.alias("coordinates")).alias("geometry"),
    ))
