"""Grouped aggregates. All of them combine inside each task before they shuffle."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from geoscore.functions.dates import months_old, within_years
from geoscore.functions.geo import snap
from geoscore.operators.columns import known as known_values
from geoscore.operators.columns import numeric_columns
from geoscore.operators.rank import group_rank
from geoscore.operators.skew import with_scalars
from geoscore.session import store_once

YEAR_DAYS = 365


def agg_all(df: DataFrame, keys: Sequence[str], fn: Callable[[str], Column] = F.avg,
            cols: Sequence[str] | None = None) -> DataFrame:
    """The same aggregate over every remaining numeric column (or the given ones), names kept."""
    cols = numeric_columns(df, keys) if cols is None else cols
    return df.groupBy(*keys).agg(*[fn(c).alias(c) for c in cols])


def mean_and_max(df: DataFrame, keys: Sequence[str], mean: Sequence[str], maximum: Sequence[str]) -> DataFrame:
    """Mean of some columns and maximum of others in one pass."""
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in mean], *[F.max(c).alias(c) for c in maximum])


def weighted_mean_of(value: Column, weight: Column) -> Column:
    """Weighted mean; a missing value takes its weight out of the divisor too."""
    return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


def weighted_mean(df: DataFrame, keys: Sequence[str], value: str, weight: str, name: str | None = None) -> DataFrame:
    return df.groupBy(*keys).agg(weighted_mean_of(F.col(value), F.col(weight)).alias(name or value))


def decay_weighted_mean(df: DataFrame, keys: Sequence[str], value: str, date: str, as_of: Column,
                        base: float = 0.9, years: int = 10, name: str | None = None) -> DataFrame:
    """Mean over the last years, each month back weighing ``base`` times the next."""
    weight = F.pow(F.lit(base), months_old(F.col(date), as_of))
    return (
        df.where(within_years(F.col(date), as_of, years))
        .groupBy(*keys).agg(weighted_mean_of(F.col(value), weight).alias(name or value))
    )


def tally(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def _days_in_year(first: Column, last: Column, year: Column) -> Column:
    """Calendar days of a year that lie between two dates."""
    start = F.greatest(first, F.make_date(year, F.lit(1), F.lit(1)))
    end = F.least(last, F.make_date(year, F.lit(12), F.lit(31)))
    return F.datediff(end, start) + 1


def yearly_coverage(df: DataFrame, entity: str, date: str, value: str, distinct_days: bool = False) -> DataFrame:
    """Known days, calendar days and their ratio for every entity and year between the table's first and last date.

    The calendar is counted, not joined: one row per entity and year is all that is built. Needs one row per
    (entity, date), or ``distinct_days``. A day whose value is NaN or infinite is not known.
    """
    df = known_values(df, value)
    known = F.count_distinct(F.when(F.col(value).isNotNull(), F.col(date))) if distinct_days else F.count(value)
    seen = store_once(  # one row per entity and year; the only pass over the table
        df.groupBy(entity, F.year(date).alias("year")).agg(
            known.alias("known"), F.min(date).alias("_from"), F.max(date).alias("_to")
        ), "coverage",
    )
    entities = with_scalars(
        seen.select(entity).distinct(), F.min("_from").alias("_first"), F.max("_to").alias("_last"), source=seen
    )
    years = entities.withColumn("year", F.explode(F.sequence(F.year("_first"), F.year("_last"))))
    return years.join(seen.select(entity, "year", "known"), [entity, "year"], "left").select(
        entity, "year", F.coalesce("known", F.lit(0)).alias("known"),
        _days_in_year(F.col("_first"), F.col("_last"), F.col("year")).cast("bigint").alias("total"),
    ).withColumn("ratio", F.col("known") / F.col("total"))


def completeness_filter(df: DataFrame, entity: str, date: str, value: str, min_ratio: float = 0.85,
                        distinct_days: bool = False) -> DataFrame:
    """Entities whose yearly coverage, averaged over all years, reaches ``min_ratio``."""
    coverage = yearly_coverage(df, entity, date, value, distinct_days)
    return coverage.groupBy(entity).agg(F.avg("ratio").alias("avg_ratio")).where(F.col("avg_ratio") >= min_ratio)


def stable_years(df: DataFrame, entity: str, date: str, value: str, max_missing: float = 0.05,
                 min_years: int = 3, distinct_days: bool = False) -> DataFrame:
    """(entity, year) pairs with little missing, for entities that have enough such years."""
    good = yearly_coverage(df, entity, date, value, distinct_days).where(
        (F.col("total") - F.col("known")) / F.col("total") < max_missing
    )
    per_entity = Window.partitionBy(entity)  # one row per year
    return good.withColumn("n_years", F.count(F.lit(1)).over(per_entity)).where(F.col("n_years") >= min_years)


def coverage_days(df: DataFrame, keys: Sequence[str], date: str, min_share: float = 0.8,
                  strict: bool = True, distinct_days: bool = True) -> DataFrame:
    """(keys, year) groups with more (or at least) that share of 365 days."""
    days = F.count_distinct(date) if distinct_days else F.count(F.lit(1))
    counted = df.groupBy(*keys, F.year(date).alias("year")).agg(days.alias("n_days"))
    limit = F.lit(YEAR_DAYS * min_share)
    return counted.where(F.col("n_days") > limit if strict else F.col("n_days") >= limit)


def worst_year(df: DataFrame, keys: Sequence[str], date: str, min_share: float = 0.9) -> DataFrame:
    """Groups whose poorest year still has more than that share of 365 rows."""
    per_year = df.groupBy(*keys, F.year(date).alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return per_year.groupBy(*keys).agg(F.min("n").alias("min_n")).where(F.col("min_n") > YEAR_DAYS * min_share)


def recency(df: DataFrame, keys: Sequence[str], year: Column, since: int, more_than: int = 4) -> DataFrame:
    """Latest year and row count since a year, for groups with more than so many rows."""
    return (
        df.where(year >= since).groupBy(*keys)
        .agg(F.max(year).alias("year_max"), F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than)
    )


def year_then_mean(df: DataFrame, keys: Sequence[str], date: str, measures: Mapping[str, Column],
                   running_year: int | Column | None = None, max_unknown: float | None = 0.1,
                   days: Column | None = None) -> DataFrame:
    """Aggregate per year, drop the running year and poorly covered years, then average the years.

    ``measures`` are aggregates per year. A year's unknown days are 365 less its rows, never below 0.
    """
    source = df if running_year is None else df.where(F.year(date) < running_year)
    days = F.count(F.lit(1)) if days is None else days
    per_year = source.groupBy(*keys, F.year(date).alias("_year")).agg(
        *[c.alias(n) for n, c in measures.items()], days.alias("_days")
    )
    if max_unknown is not None:
        per_year = per_year.where(F.greatest(YEAR_DAYS - F.col("_days"), F.lit(0)) < YEAR_DAYS * max_unknown)
    return per_year.groupBy(*keys).agg(*[F.avg(n).alias(n) for n in measures])


def normalized_composition(df: DataFrame, entity: str, year: str, classes: Sequence[str],
                           absorbs: str = "pleasant") -> DataFrame:
    """Class days over all years scaled to a picture of 365 whole days, unknown days included.

    ``classes`` are 0/1 columns. Rounding leaves a remainder: with no unknown days and a surplus it is taken from
    ``absorbs``, else from the unknown days, so a row always totals 365.
    """
    per_year = df.groupBy(entity, year).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in classes])
    known = sum((F.col(c) for c in classes[1:]), F.col(classes[0]))
    parts = [*classes, "unknown"]
    totals = (
        per_year.withColumn("unknown", F.greatest(YEAR_DAYS - known, F.lit(0)))
        .groupBy(entity).agg(*[F.sum(c).alias(c) for c in parts])
    )
    everything = sum((F.col(c) for c in parts[1:]), F.col(parts[0]))
    scaled = totals.withColumn("_sum", everything).withColumns(
        {c: F.rint(F.col(c) / F.col("_sum") * YEAR_DAYS) for c in parts}
    )
    surplus = (F.col("unknown") == 0) & (F.col("remainder") > 0)
    return scaled.withColumn("remainder", everything - YEAR_DAYS).withColumns({
        absorbs: F.when(surplus, F.col(absorbs) - F.col("remainder")).otherwise(F.col(absorbs)),
        "unknown": F.when(surplus, F.col("unknown")).otherwise(F.col("unknown") - F.col("remainder")),
    }).select(entity, *[F.col(c).cast("int").alias(c) for c in parts])


def class_share(df: DataFrame, entity: str, cls: str, name: str = "n") -> DataFrame:
    """Days per class scaled to 365 per entity; rows without a class are left out."""
    # The NULL group is dropped by its count: a test on the class itself would be pushed down and worked out twice.
    counts = df.groupBy(entity, cls).agg(F.count(cls).alias("_n")).where(F.col("_n") > 0)
    per_entity = Window.partitionBy(entity)  # one row per class
    return counts.select(entity, cls, (F.lit(float(YEAR_DAYS)) * F.col("_n") / F.sum("_n").over(per_entity)).alias(name))


def grid_rollup(df: DataFrame, lat: str, lon: str, step: float, measures: Mapping[str, Column],
                keys: Sequence[str] = ()) -> DataFrame:
    """Aggregates per rounded coordinate cell."""
    return df.groupBy(
        snap(F.col(lat), step).alias("lat_cell"), snap(F.col(lon), step).alias("lon_cell"), *keys
    ).agg(*[c.alias(n) for n, c in measures.items()])


def concat_group(df: DataFrame, keys: Sequence[str], col: str, order: Sequence[Column], part_size: int,
                 sep: str = ", ", name: str = "text") -> DataFrame:
    """Parts of ``part_size`` strings of a group, joined in a stated order and numbered by ``part`` from 0.

    Every group comes as parts, so no text is built from an unbounded group and no member is lost.
    """
    ranked = group_rank(df.where(F.col(col).isNotNull()), keys, order, "_r")
    parted = ranked.withColumn("part", F.floor((F.col("_r") - 1) / part_size).cast("int"))
    members = F.sort_array(F.collect_list(F.struct("_r", F.col(col).alias("_c"))))
    return parted.groupBy(*keys, "part").agg(
        F.array_join(F.transform(members, lambda m: m["_c"]), sep).alias(name)
    )


def representative(df: DataFrame, keys: Sequence[str], maximum: Sequence[str], mean: Sequence[str]) -> DataFrame:
    """One row per id: largest label, mean position."""
    return mean_and_max(df, keys, mean, maximum)


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Rows per equal-width bin between the column's minimum and maximum; bins without rows are absent."""
    ranged = with_scalars(df.where(F.col(col).isNotNull()), F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.floor(F.coalesce(F.try_divide(F.col(col) - F.col("_lo"), width), F.lit(0.0)))
    binned = ranged.withColumn("bin", F.least(place, F.lit(bins - 1)).cast("int"))
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def frequency_of_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many groups have each row count."""
    return tally(tally(df, keys, "n"), ["n"], "count")


def region_dissolve(df: DataFrame, region: str, totals: Sequence[str], members: str = "country_n") -> DataFrame:
    """Sums and member count per region. Member outlines keep their own rows, tagged with the region."""
    return df.groupBy(region).agg(*[F.sum(c).alias(c) for c in totals], F.count(F.lit(1)).alias(members))


def collapse_max(df: DataFrame, keys: Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    """One row per key from observed and predicted rows, by maximum."""
    return agg_all(df, keys, F.max, cols)


def month_totals(df: DataFrame, keys: Sequence[str], date: str, value: str) -> DataFrame:
    return df.groupBy(*keys, F.year(date).alias("year"), F.month(date).alias("month")).agg(F.sum(value).alias(value))


def climatology(df: DataFrame, keys: Sequence[str], date: str, cols: Sequence[str], yday: Column) -> DataFrame:
    """Mean over years for every calendar day of every key; 29 February is left out by the caller if wanted."""
    return df.groupBy(
        *keys, F.month(date).alias("month"), F.dayofmonth(date).alias("day"), yday.alias("yday")
    ).agg(*[F.avg(c).alias(c) for c in cols])
