"""Models that fill missing values of daily series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from geoscore.operators.columns import known as known_values
from geoscore.operators.neighbours import nearest_locations
from geoscore.operators.skew import HOT_FLOOR, attach
from geoscore.session import store_once


def linear_coefficients(df: DataFrame, by: Sequence[str], value: str, x1: str, x2: str) -> DataFrame:
    """Least squares ``value ~ x1 + x2`` per group, from moments gathered in one aggregate.

    A predictor that is constant, or ``x2`` when it is a multiple of ``x1``, drops out; with neither left the fit is
    the mean. NaN and infinities count as unknown.
    """
    df = known_values(df, value, x1, x2)
    y, a, b = F.col(value).cast("double"), F.col(x1).cast("double"), F.col(x2).cast("double")
    moments = df.where(y.isNotNull() & a.isNotNull() & b.isNotNull()).groupBy(*by).agg(
        F.avg(y).alias("_my"), F.avg(a).alias("_ma"), F.avg(b).alias("_mb"),
        F.var_pop(a).alias("_vaa"), F.var_pop(b).alias("_vbb"), F.covar_pop(a, b).alias("_vab"),
        F.covar_pop(a, y).alias("_vay"), F.covar_pop(b, y).alias("_vby"),
    )
    vaa, vbb, vab, vay, vby = (F.col(c) for c in ("_vaa", "_vbb", "_vab", "_vay", "_vby"))
    det = vaa * vbb - vab * vab
    full = det > 1e-9 * vaa * vbb
    only_a, only_b = vaa > 0, vbb > 0
    slope_a = F.when(full, F.try_divide(vay * vbb - vby * vab, det)).when(only_a, F.try_divide(vay, vaa)).otherwise(0.0)
    slope_b = F.when(full, F.try_divide(vby * vaa - vay * vab, det)).when(only_a, 0.0) \
        .when(only_b, F.try_divide(vby, vbb)).otherwise(0.0)
    return moments.withColumns({"_sa": slope_a, "_sb": slope_b}).select(
        *by, (F.col("_my") - F.col("_sa") * F.col("_ma") - F.col("_sb") * F.col("_mb")).alias("intercept"),
        F.col("_sa").alias("slope_1"), F.col("_sb").alias("slope_2"),
    )


def impute_linear(df: DataFrame, by: Sequence[str], value: str, x1: str = "yday", x2: str = "year",
                  name: str = "predicted", floor: int = HOT_FLOOR) -> DataFrame:
    """Missing rows with the value their group's linear fit predicts; groups without known values are left out.

    NaN and infinities count as unknown.
    """
    df = known_values(df, value, x1, x2)
    fits = linear_coefficients(df, by, value, x1, x2)
    missing = df.where(F.col(value).isNull())
    return attach(missing, fits, by, how="inner", floor=floor).withColumn(
        name, F.col("intercept") + F.col("slope_1") * F.col(x1) + F.col("slope_2") * F.col(x2)
    ).drop("intercept", "slope_1", "slope_2")


def impute_knn(df: DataFrame, by: Sequence[str], value: str, dims: Sequence[str] = ("yday", "year"), k: int = 4,
               name: str = "predicted", leaf: int | None = None, floor: int = HOT_FLOOR, how: str = "inner") -> DataFrame:
    """Missing rows with the mean of the k nearest known ones of their group, all ties at the k-th place included.

    ``df`` is read three times: store it first if it is costly to work out.

    Distance is straight-line on the unscaled columns. Without ``by`` the whole table is one pool. Groups without
    known values are left out (``how="left"`` keeps them, with NULL), as are rows with an unknown place. NaN and
    infinities count as unknown.
    """
    df = known_values(df, value, *dims)
    at = [*by, *dims]
    v = F.col(value)
    known = df.where(v.isNotNull()).dropna(subset=list(dims)).groupBy(*at).agg(F.sum(v).alias("_sum"), F.count(v).alias("_n"))
    missing = df.where(v.isNull())
    found = nearest_locations(missing.select(*at).dropna(subset=list(dims)).distinct(), known, k, dims, by, payload=["_sum"], leaf=leaf, floor=floor)
    q = ["_q_" + c for c in at]
    means = found.groupBy(*q).agg((F.sum("_sum") / F.sum("_n")).alias(name))
    return attach(missing, means.withColumnsRenamed(dict(zip(q, at))), at, how=how, floor=floor)


def impute_knn_pooled(df: DataFrame, targets: Sequence[str], dims: Sequence[str] = ("lat", "lon", "yday", "year"),
                      k: int = 5, leaf: int | None = None, floor: int = HOT_FLOOR) -> DataFrame:
    """Fill each target column from the k nearest rows, over all places, where that column is known."""
    for target in targets:
        df = store_once(df, "pool")  # read as known and as missing rows, and the base of the next target
        filled = impute_knn(df, [], target, dims, k, "_p", leaf, floor, "left").withColumn(target, F.col("_p")).drop("_p")
        df = df.where(F.col(target).isNotNull()).unionByName(filled)
    return df


def merge_predicted(observed: DataFrame, predicted: DataFrame, keys: Sequence[str], value: str,
                    name: str = "predicted") -> DataFrame:
    """Observed rows where known, predicted ones for the rest, flagged."""
    known = observed.where(F.col(value).isNotNull()).withColumn("flag", F.lit("observed"))
    filled = predicted.select(
        *keys, F.col(name).alias(value), F.lit("predicted").alias("flag")
    )
    return known.select(*keys, value, "flag").unionByName(filled)


def missing_flag(needed: Sequence[Column], main: Column) -> Column:
    """``existing`` when all needed values are known, ``partial`` when only the main one is, else ``missing``."""
    any_missing = needed[0].isNull()
    for c in needed[1:]:
        any_missing = any_missing | c.isNull()
    return F.when(main.isNull(), "missing").when(any_missing, "partial").otherwise("existing")
