"""What a user asks for: indices per place, and the ranked table made of them. Each is a chain of operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from geoscore.functions.text import fips5, strip_first
from geoscore.functions.weather import excess_degree_days, feels_like
from geoscore.operators.aggregate import decay_weighted_mean, weighted_mean_of, year_then_mean
from geoscore.operators.classify import DayLimits, classify_day, fill_min_max
from geoscore.operators.columns import expand_struct, finite
from geoscore.operators.neighbours import nearest_feature
from geoscore.operators.rank import global_rank, group_rank, percent_of_max, rescale
from geoscore.operators.reshape import crosswalk, stack, unpivot
from geoscore.operators.series import fill_down
from geoscore.operators.skew import attach, salted_join, spread_join
from geoscore.session import store_once

TEMPERATURES = ("temp_max", "temp_min", "temp_mean")


def daily_by_location(weather: DataFrame, mapping: DataFrame, entity: str, station: str, date: str,
                      metrics: Sequence[str], distance: str | None = None) -> DataFrame:
    """Station days to location days by mean (inverse-distance weighted with ``distance``), then low/high filled.

    The weather is read once: a station's days are spread by date, and ``mapping``, a row per station and location, is copied.
    """
    joined = spread_join(weather, mapping, [station], [date])
    if distance is None:
        means = [F.avg(finite(F.col(m))).alias(m) for m in metrics]
    else:
        means = [weighted_mean_of(finite(F.col(m)), F.try_divide(F.lit(1.0), F.col(distance))).alias(m) for m in metrics]
    return fill_min_max(joined.groupBy(entity, date).agg(*means))


def felt(df: DataFrame, rh: str = "rh", wind: str = "wdsp") -> DataFrame:
    """Felt low, high and mean beside the measured ones."""
    return df.withColumns({f"{t}_feel": feels_like(F.col(t), F.col(rh), F.col(wind)) for t in TEMPERATURES})


def classified_days(daily: DataFrame, limits: DayLimits = DayLimits()) -> DataFrame:
    """Location days with felt temperatures, day class and degree days."""
    days = classify_day(felt(daily), limits)
    return expand_struct(days, excess_degree_days(F.col("temp_min_feel"), F.col("temp_max_feel")))


def exact_or_approx(weather: DataFrame, exact: DataFrame, approximate: DataFrame, entity: str, station: Sequence[str],
                    date: str, metrics: Sequence[str]) -> DataFrame:
    """Mean over a location's own stations; metric by metric, the mean over its wider set where that is unknown.

    The wider set includes the exact stations, so one join and one aggregate give both means.
    """
    flagged = approximate.select(entity, *station).unionByName(exact.select(entity, *station)).distinct().join(
        exact.select(entity, *station).distinct().withColumn("_own", F.lit(True)), [entity, *station], "left"
    )
    joined = spread_join(weather, flagged, list(station), [date])
    own = F.coalesce(F.col("_own"), F.lit(False))
    return joined.groupBy(entity, date).agg(*[
        F.coalesce(F.avg(F.when(own, finite(F.col(m)))), F.avg(finite(F.col(m)))).alias(m) for m in metrics
    ])


def price_index(frames: Sequence[DataFrame], ids: Sequence[str], region: str, name: str, as_of: Column,
                mapping: DataFrame | None = None, exclude: str = "United States", base: float = 0.9,
                years: int = 10) -> DataFrame:
    """Wide monthly files to one decay-weighted price per region (the mean of the files month by month)."""
    long = [
        unpivot(f, ids, [c for c in f.columns if c not in ids], "date", "zhvi") for f in frames
    ]
    monthly = (
        stack(*long).where(F.col(name) != exclude).withColumn("date", F.col("date").try_cast("date"))
        .groupBy(*ids, "date").agg(F.avg("zhvi").alias("zhvi"))
    )
    index = decay_weighted_mean(monthly, [region], "zhvi", "date", as_of, base, years)
    return index if mapping is None else crosswalk(index, mapping, region)


def connectivity_index(routes: DataFrame, airport_places: DataFrame, place: Sequence[str],
                       weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> DataFrame:
    """Non-stop routes scored per place.

    ``routes`` (origin, destination, stops); ``airport_places`` (origin, place columns, wanted). Wanted belongs to
    the origin airport and counts once per pair, and a destination reached from two airports counts twice.
    """
    pairs = routes.where(F.col("stops") == 0).groupBy("origin", "destination").agg(F.count(F.lit(1)).alias("n"))
    wanted, direct, total = weights
    return (
        salted_join(pairs, airport_places, ["origin"]).groupBy(*place).agg(
            F.count(F.lit(1)).alias("destinations"), F.sum("n").alias("total_routes"),
            F.coalesce(F.sum("wanted"), F.lit(0)).alias("wanted_dests"),
        ).withColumn(
            "dest_index",
            F.lit(wanted) * F.col("wanted_dests") + F.lit(direct) * F.col("destinations")
            + F.lit(total) * F.col("total_routes"),
        )
    )


def walk_composite(df: DataFrame, key: str, weights: Mapping[str, float], name: str = "walkscore") -> DataFrame:
    """Weighted sum of the scores over all of a place's rows; a missing score adds nothing."""
    parts = [F.coalesce(F.lit(w) * F.col(c), F.lit(0.0)) for c, w in weights.items()]
    return df.groupBy(key).agg(F.sum(sum(parts[1:], parts[0])).alias(name))


def group_rates(df: DataFrame, label: str, order: Sequence[Column], kind: str, rate: str, lookup: DataFrame,
                violent: str = "violent_crime", property_: str = "property_crime", pattern: str = "M.S.A.",
                suffix: str = " M.S.A.*", dedupe: bool = True) -> DataFrame:
    """Rates per place from a report whose group label stands only on a group's first line.

    ``order`` is the report's line order. Repeated lookup rows would repeat a place; ``dedupe=False`` keeps that.
    """
    rows = fill_down(df, [], order, [label]).where((F.col(kind) == rate) & F.col(label).rlike(pattern))
    named = rows.withColumn(label, strip_first(F.col(label), suffix))
    total, weighted = F.col(violent) + F.col(property_), 3 * F.col(violent) + F.col(property_)
    return attach(named, lookup.distinct() if dedupe else lookup, [label], how="inner").withColumns(
        {"total_crime": total, "total_crime_weighted": weighted}
    )


def area_quality(counties: DataFrame, mapping: DataFrame, years: Sequence[str], code: str = "fips",
                 place: Sequence[str] = ("cbsafp", "name"), name: str = "pm25") -> DataFrame:
    """County values, one column per year, to a place's mean over years.

    Missing counties are ignored within a year, but a place with a year that is missing altogether gets NULL.
    """
    keyed = counties.withColumn(code, fips5(F.col(code).cast("string")))
    yearly = keyed.join(mapping, code).groupBy(*place).agg(*[F.avg(y).alias(y) for y in years])
    long = unpivot(yearly, place, years, "year", "_v")
    whole = F.count(F.lit(1)) == F.count("_v")
    return long.groupBy(*place).agg(F.when(whole, F.avg("_v")).alias(name))


def latest_variable(df: DataFrame, variable: str = "POP", name: str = "population", key: str = "variable",
                    value: str = "value") -> DataFrame:
    """One variable of a long table as a named column."""
    return df.where(F.col(key) == variable).drop(key).withColumnRenamed(value, name)


@dataclass(frozen=True)
class Scoring:
    """Limits, scales and weights of the final table. ``limits`` are closed; ``positive`` columns must exceed 0."""

    limits: Mapping[str, tuple[float | None, float | None]]
    scales: Mapping[str, tuple[str, tuple[float, float]]]
    copies: Mapping[str, str]
    weights: Mapping[str, float]
    positive: Sequence[str] = ()


# The published limits and weights for places to live.
PLACES = Scoring(
    limits={"dest_index": (30, None), "weather": (100, None), "population": (750_000, None),
            "zhvi": (200_000, 1_000_000), "walkscore": (25, None)},
    scales={"weather_points": ("weather", (0, 100)), "zhvi_points": ("zhvi", (100, 0)),
            "dest_points": ("dest_index", (0, 100))},
    copies={"walkscore_points": "walkscore"},
    weights={"zhvi_points": 0.3, "weather_points": 0.25, "dest_points": 0.2, "walkscore_points": 0.15,
             "preference_points": 0.1},
    positive=("preference_points",),
)


def assemble(base: DataFrame, *indicators: DataFrame, key: str) -> DataFrame:
    """One wide row per place: left joins of tables that have one row per place."""
    for table in indicators:
        base = base.join(table, key, "left")
    return base


def score_and_rank(df: DataFrame, key: str, scoring: Scoring = PLACES) -> DataFrame:
    """Filter by limits, rescale what is left (so scores depend on which places remain), weigh, rank."""
    kept = df
    for column, (low, high) in scoring.limits.items():
        if low is not None:
            kept = kept.where(F.col(column) >= low)
        if high is not None:
            kept = kept.where(F.col(column) <= high)
    for column in scoring.positive:
        kept = kept.where(F.col(column) > 0)
    kept = store_once(kept, "kept")  # one row per place; read for its bounds and for its scores
    scaled = rescale(kept, scoring.scales).fillna(0, list(scoring.scales))
    pointed = scaled.withColumns({out: F.col(c) for out, c in scoring.copies.items()})
    points = list(scoring.weights)
    plain = sum((F.col(c) for c in points[1:]), F.col(points[0])) / len(points)
    terms = [F.lit(w) * F.col(c) for c, w in scoring.weights.items()]
    totals = pointed.withColumns({"total_not_weighted": plain, "total_weighted": sum(terms[1:], terms[0])})
    return global_rank(totals, [F.col("total_weighted").desc_nulls_last(), F.col(key).asc()])


def degree_day_summary(days: DataFrame, entity: str, date: str, running_year: int | Column | None = None,
                       max_unknown: float = 0.1) -> DataFrame:
    """Mean yearly degree days and pleasant days per place, ranked both ways, with points against the worst."""
    yearly = year_then_mean(
        days, [entity], date,
        {c: F.sum(c) for c in ("edd_total", "edd_cold", "edd_hot", "pleasant")}, running_year, max_unknown,
    )
    by_total = [F.col("edd_total").asc_nulls_last(), F.col(entity).asc()]
    reverse = [F.col("edd_total").desc_nulls_last(), F.col(entity).asc()]
    ranked = global_rank(global_rank(yearly, by_total, "rank"), reverse, "rank_rev")
    return percent_of_max(ranked, "edd_total")


def zone_tag(places: DataFrame, zones: DataFrame, place_id: str, zone_id: str, zone: str, measure: str) -> DataFrame:
    """Each place with the zone of its nearest zone cell and its rank within that zone."""
    near = nearest_feature(places, zones, place_id, zone_id).select(place_id, zone_id)
    placed = store_once(places.join(near, place_id), "placed")
    tagged = attach(placed, zones.select(zone_id, zone), [zone_id], how="inner")
    return group_rank(tagged, [zone], [F.col(measure).desc_nulls_last(), F.col(place_id).asc()], "rank_zone")
