"""Long and wide forms, stacking, set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from geoscore.operators.skew import attach


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    """Wide to long."""
    return df.unpivot(list(ids), list(values), name, value)


def pivot(df: DataFrame, keys: Sequence[str], name: str, value: str, values: Sequence[str]) -> DataFrame:
    """Long to wide; the new columns are stated, so no extra pass looks for them."""
    return df.groupBy(*keys).pivot(name, list(values)).agg(F.first(value, ignorenulls=True))


def stack(*frames: DataFrame) -> DataFrame:
    """All rows, matched by name; columns missing on one side are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def stack_distinct(*frames: DataFrame) -> DataFrame:
    return stack(*frames).distinct()


def times_values(df: DataFrame, name: str, values: Sequence[object] | Column) -> DataFrame:
    """Every row paired with every value of a short list (or of an array column)."""
    array = values if isinstance(values, Column) else F.array(*[F.lit(v) for v in values])
    return df.withColumn(name, F.explode(array))


def prefer_exact(exact: DataFrame, approximate: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact matches plus the approximate ones that are not among them; ``match`` says which."""
    extra = approximate.join(exact.select(*keys).distinct(), list(keys), "left_anti")
    return exact.withColumn("match", F.lit("exact")).unionByName(extra.withColumn("match", F.lit("buffer")))


def crosswalk(df: DataFrame, mapping: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join through a key map after taking its repeated rows out (a key may still map to several places)."""
    return attach(df, mapping.distinct(), [key], how=how)
