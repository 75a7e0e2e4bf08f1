"""Daily series: calendars, gaps, carried values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from geoscore.functions.dates import is_leap_day
from geoscore.operators.skew import range_sorted, with_scalars
from geoscore.session import store_once


def date_skeleton(df: DataFrame, entity: Sequence[str], date: str, leap_days: bool = True) -> DataFrame:
    """Every entity on every day between the table's first and last date."""
    spans = store_once(  # one row per entity; the only pass over the table
        df.groupBy(*entity).agg(F.min(date).alias("_from"), F.max(date).alias("_to")), "spans"
    )
    bounded = with_scalars(spans, F.min("_from").alias("_first"), F.max("_to").alias("_last"))
    days = bounded.select(*entity, F.explode(F.sequence("_first", "_last")).alias(date))
    return days if leap_days else days.where(~is_leap_day(F.col(date)))


def full_series(df: DataFrame, entity: Sequence[str], date: str, leap_days: bool = True) -> DataFrame:
    """The skeleton with the known rows filled in; everything else NULL."""
    return date_skeleton(df, entity, date, leap_days).join(df, [*entity, date], "left")


def missing_days(df: DataFrame, entity: Sequence[str], date: str, leap_days: bool = True) -> DataFrame:
    """Known rows flagged ``existing`` plus a ``missing`` row for each absent day."""
    absent = date_skeleton(df, entity, date, leap_days).join(df.select(*entity, date), [*entity, date], "left_anti")
    return df.withColumn("flag", F.lit("existing")).unionByName(
        absent.withColumn("flag", F.lit("missing")), allowMissingColumns=True
    )


def grid_skeleton(spark: SparkSession, step: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Lattice over the whole globe, edges included, numbered by one distributed range."""
    n_lat, n_lon = int(round(180 / step)) + 1, int(round(360 / step)) + 1
    cell = F.col("id")
    return spark.range(n_lat * n_lon).select(
        (F.floor(cell / n_lon) * F.lit(step) - 90).cast("double").alias(lat),
        ((cell % n_lon) * F.lit(step) - 180).cast("double").alias(lon),
    )


def hourly_expand(df: DataFrame, hour: str = "hour") -> DataFrame:
    """Each row for hours 0 to 24."""
    return df.withColumn(hour, F.explode(F.sequence(F.lit(0), F.lit(24))))


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(and_, [left[k].eqNullSafe(right["_c_" + k]) for k in keys])


def carried(df: DataFrame, by: Sequence[str], order: Sequence[Column], cols: Sequence[str],
            down: bool = True, up: bool = False) -> DataFrame:
    """Adds ``<col>_down`` (last known value up to the row) and ``<col>_up`` (next known value from it on).

    An entity of any length is fine: the table is cut into sorted ranges, values are carried inside each range, and
    what one range hands to the next is worked out on the few entities that lie across a cut (at most one per range).
    ``order`` must end in a key that is unique within the entity. Without ``by`` the whole table is one series.
    """
    wanted = list(df.columns)
    by = list(by) or ["_all"]
    df = df if "_all" not in by else df.withColumn("_all", F.lit(0))
    ranged = range_sorted(df, [*[F.col(c).asc_nulls_first() for c in by], *order])
    inside = Window.partitionBy("_part", *by).orderBy("_pos")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    from_here = inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    local = {}
    for c in cols:
        if down:
            local[c + "_down"] = F.last(c, ignorenulls=True).over(so_far)
        if up:
            local[c + "_up"] = F.first(c, ignorenulls=True).over(from_here)

    cut = (  # the entity at the head of each later range
        ranged.where(F.col("_part") > 0).groupBy("_part")
        .agg(F.min_by(F.struct(*by), F.col("_pos")).alias("_e"))
        .select(*[F.col("_e")[c].alias("_c_" + c) for c in by]).distinct()
    )
    edges = ranged.join(F.broadcast(cut), _same(ranged, cut, by), "left_semi").groupBy("_part", *by).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_pos"))).alias("_last_" + c) for c in cols],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_pos"))).alias("_first_" + c) for c in cols],
    )
    across = Window.partitionBy(*by).orderBy("_part")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    later = across.rowsBetween(1, Window.unboundedFollowing)
    handed = edges.select(
        F.col("_part").alias("_c__part"), *[F.col(c).alias("_c_" + c) for c in by],
        *[F.last("_last_" + c, ignorenulls=True).over(earlier).alias("_in_" + c + "_down") for c in cols],
        *[F.first("_first_" + c, ignorenulls=True).over(later).alias("_in_" + c + "_up") for c in cols],
    )
    filled = ranged.withColumns(local)
    joined = filled.join(F.broadcast(handed), _same(filled, handed, ["_part", *by]), "left")
    return joined.select(*wanted, *[F.coalesce(n, "_in_" + n).alias(n) for n in local])


def fill_down(df: DataFrame, by: Sequence[str], order: Sequence[Column], cols: Sequence[str]) -> DataFrame:
    """Carry the last known value forward inside each entity."""
    out = carried(df, by, order, cols, down=True)
    return out.withColumns({c: F.col(c + "_down") for c in cols}).drop(*[c + "_down" for c in cols])


def fill_up(df: DataFrame, by: Sequence[str], order: Sequence[Column], cols: Sequence[str]) -> DataFrame:
    """Carry the next known value backward inside each entity."""
    out = carried(df, by, order, cols, down=False, up=True)
    return out.withColumns({c: F.col(c + "_up") for c in cols}).drop(*[c + "_up" for c in cols])


def fill_mean_of_neighbours(df: DataFrame, by: Sequence[str], order: Sequence[Column], cols: Sequence[str],
                            missing: Column) -> DataFrame:
    """On rows marked missing, each column becomes the mean of its carried-forward and carried-back values.

    A column that is known on such a row keeps its value, and one known neighbour is enough.
    """
    out = carried(df, by, order, cols, down=True, up=True)
    mean = {}
    for c in cols:
        d, u = F.col(c + "_down"), F.col(c + "_up")
        both = F.when(d.isNull(), u).when(u.isNull(), d).otherwise((d + u) / 2)
        mean[c] = F.when(missing, both).otherwise(F.col(c))
    return out.withColumns(mean).drop(*[c + e for c in cols for e in ("_down", "_up")])
