"""Ranks, shares, rescaling and top-n."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from geoscore.operators.skew import HOT_FLOOR, attach, global_index, with_scalars
from geoscore.session import store_once


def _ranked_first(df: DataFrame, where: Column | None) -> DataFrame:
    return df.withColumn("_ok", F.lit(True) if where is None else F.coalesce(where, F.lit(False)))


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank", where: Column | None = None) -> DataFrame:
    """Rank 1..n over the whole table. Rows that fail ``where`` (for one: a NULL measure) get a NULL rank.

    ``order`` must end in a unique key, which breaks ties. Unranked rows sort behind the ranked ones, so one pass
    serves both.
    """
    indexed = global_index(_ranked_first(df, where), [F.col("_ok").desc(), *order])
    return indexed.select(*df.columns, F.when(F.col("_ok"), F.col("_g") + 1).alias(name))


def group_rank(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank",
               where: Column | None = None, floor: int = HOT_FLOOR) -> DataFrame:
    """Rank 1..n inside each group, for groups of any size.

    The table is ordered by (group, order) as a whole; a row's rank is its position less its group's first one.
    """
    by = list(by)
    groups = [F.col(c).asc_nulls_first() for c in by]
    indexed = global_index(_ranked_first(df, where), [*groups, F.col("_ok").desc(), *order])
    starts = indexed.groupBy(*by).agg(F.min("_g").alias("_first"), F.count(F.lit(1)).alias("_n"))
    placed = attach(indexed, starts, by, count="_n", floor=floor)
    return placed.select(*df.columns, F.when(F.col("_ok"), F.col("_g") - F.col("_first") + 1).alias(name))


def ordinal_by(df: DataFrame, category: str, by: Column, name: str = "ordinal", floor: int = HOT_FLOOR) -> DataFrame:
    """Position of each category, from 1, when categories are put in the order of an aggregate of another column.

    Equal aggregates go by the category. A NULL category has no position.
    """
    levels = df.where(F.col(category).isNotNull()).groupBy(category).agg(by.alias("_by"))
    placed = global_rank(levels, [F.col("_by").asc(), F.col(category).asc()], name)
    return attach(df, placed.select(category, name), [category], floor=floor)


def add_index(df: DataFrame, order: Sequence[Column], name: str = "ind") -> DataFrame:
    """Row index from 1 in a stated order (a stored table has no row order of its own)."""
    return global_rank(df, order, name)


def share_of_group(df: DataFrame, by: Sequence[str], col: str, scale: float = 1.0, name: str = "share",
                   floor: int = HOT_FLOOR) -> DataFrame:
    """``scale * value / sum of the group``; the sums are combined before any shuffle, then attached."""
    sums = df.groupBy(*by).agg(F.sum(col).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    return (
        attach(df, sums, by, count="_n", floor=floor)
        .withColumn(name, F.try_divide(F.lit(scale) * F.col(col), F.col("_sum")))
        .drop("_sum")
    )


def group_stats_attached(df: DataFrame, by: Sequence[str], aggregates: Mapping[str, Column],
                         floor: int = HOT_FLOOR) -> DataFrame:
    """Group aggregates on every row of the group."""
    stats = df.groupBy(*by).agg(*[c.alias(n) for n, c in aggregates.items()], F.count(F.lit(1)).alias("_n"))
    return attach(df, stats, by, count="_n", floor=floor)


def rescale(df: DataFrame, columns: Mapping[str, tuple[str, tuple[float, float]]]) -> DataFrame:
    """Linear min-max rescale: ``{output: (input, (to_low, to_high))}``; a reversed range flips the scale.

    A column with no spread maps to the middle of the range; NULL stays NULL. The bounds are gathered while ``df`` is
    stored, so it is worked out once.
    """
    bounds = []
    for out, (col, _) in columns.items():
        bounds += [F.min(col).alias(f"lo_{out}"), F.max(col).alias(f"hi_{out}")]
    seen = Observation()
    stored = store_once(df.observe(seen, *bounds), "rescaled")
    added = {}
    for out, (col, (low, high)) in columns.items():
        lo, hi = (F.lit(seen.get[f"{end}_{out}"]) for end in ("lo", "hi"))
        spread = F.try_divide(F.col(col) - lo, hi - lo) * F.lit(float(high - low)) + F.lit(float(low))
        added[out] = F.when(F.col(col).isNull(), F.lit(None).cast("double")) \
            .when(lo == hi, F.lit((low + high) / 2.0)).otherwise(spread)
    return stored.withColumns(added)


def percent_of_max(df: DataFrame, col: str, name: str = "points", scale: float = 100.0) -> DataFrame:
    """Value as a share of the table's maximum."""
    return (
        with_scalars(df, F.max(col).alias("_max"))
        .withColumn(name, F.try_divide(F.col(col), F.col("_max")) * F.lit(scale))
        .drop("_max")
    )


def top_n(df: DataFrame, order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """First ``n`` rows with a fresh rank. The limit is pushed into each task; only ``n`` rows meet in one."""
    return df.orderBy(*order).limit(n).withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def best_worst(df: DataFrame, rank: str, rank_rev: str, n: int, name: str = "top") -> DataFrame:
    """Label the n best and n worst; the best label wins; all other rows stay with a NULL label."""
    return df.withColumn(
        name, F.when(F.col(rank) <= n, F.lit(f"Best {n}")).when(F.col(rank_rev) <= n, F.lit(f"Worst {n}"))
    )


def last_by_rank(df: DataFrame, rank: str, n: int) -> DataFrame:
    """Rows whose rank is at least (row count - n): n+1 rows for ranks 1..count."""
    return with_scalars(df, F.count(F.lit(1)).alias("_rows")).where(F.col(rank) >= F.col("_rows") - n).drop("_rows")


def detail_for_top(df: DataFrame, key: str, detail: DataFrame, order: Sequence[Column], n: int,
                   where: Column | None = None, label: Column | None = None) -> DataFrame:
    """Top n places (after ``where``) with a fresh rank and label, joined to their detail rows."""
    top = top_n(df if where is None else df.where(where), order, n)
    if label is not None:
        top = top.withColumn("label", label)
    return detail.join(top, key)  # Spark knows the size of the limited table at run time


def pending_batch(todo: DataFrame, done: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """Next ``n`` rows of ``todo`` that are not in ``done``."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti").orderBy(*order).limit(n)


def merge_batch(done: DataFrame, batch: DataFrame) -> DataFrame:
    """Put finished rows together, each once."""
    return done.unionByName(batch, allowMissingColumns=True).distinct()
