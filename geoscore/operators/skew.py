"""Building blocks that keep one hot key from landing in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from geoscore.session import store_once

# A key with more rows than this floor is hot. Only the MAX_HOT largest are looked at, so the list of them may be
# broadcast; any key that holds more than 1/MAX_HOT of a table is among them.
HOT_FLOOR = 1_000_000
MAX_HOT = 1024
MAX_PIECES = 4096
PAIRS_PER_PIECE = 20_000_000  # that a join dealt by its pairs makes in one piece of a key
ROWS_PER_TASK = 500_000  # where rows are dealt to a stated number of tasks
SPREAD = 32  # pieces of every key in a join that does not count keys

_POSITION_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits


def with_scalars(df: DataFrame, *aggregates: Column, source: DataFrame | None = None) -> DataFrame:
    """Attach table-wide aggregates to every row; what is broadcast is always exactly one row."""
    return df.crossJoin(F.broadcast((source if source is not None else df).agg(*aggregates)))


def _same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], null_safe: bool) -> Column:
    condition = F.lit(True)
    for key in keys:
        a, b = left[key], right["_k_" + key]
        condition = condition & (a.eqNullSafe(b) if null_safe else a == b)
    return condition


def _key_named(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({k: "_k_" + k for k in keys})


def _fan(count: Column, floor: int) -> Column:
    return F.least(F.ceil(count / F.lit(floor)), F.lit(MAX_PIECES)).cast("int")


def fan_out(counts: DataFrame, keys: Sequence[str], count: str, name: str, floor: int = HOT_FLOOR,
            then_by: Sequence[Column] = ()) -> DataFrame:
    """The hot keys of a key/count table (at most MAX_HOT) with the number of pieces each should be cut into."""
    hot = counts.where(F.col(count) > floor).orderBy(F.col(count).desc(), *then_by).limit(MAX_HOT)
    return hot.select(*keys, _fan(F.col(count), floor).alias(name))


def _pieces(df: DataFrame, hot: DataFrame, keys: Sequence[str], null_safe: bool) -> DataFrame:
    named = _key_named(hot, keys)
    joined = df.join(F.broadcast(named), _same_keys(df, named, keys, null_safe), "left")
    return joined.drop(*["_k_" + k for k in keys])


def attach(df: DataFrame, lookup: DataFrame, keys: Sequence[str], count: str | None = None,
           how: str = "left", floor: int = HOT_FLOOR) -> DataFrame:
    """Join a lookup table (one row per key, or a few) onto ``df``; NULL keys match NULL keys.

    Rows of a hot key are cut into pieces and the key's one lookup row is copied to each piece. ``count`` names a
    column of ``lookup`` that already holds the key's row count in ``df``; without it the keys are counted here.
    """
    keys = list(keys)
    if count is None:
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        hot = fan_out(counts, keys, "_n", "_fan", floor)
        right = _pieces(lookup, hot, keys, True)
    else:
        # Sorting by the other columns too makes this read of the lookup the same as the one below, so Spark shuffles
        # the aggregate behind it once.
        others = [F.col(c) for c in lookup.columns if c not in [*keys, count]]
        hot = fan_out(lookup, keys, count, "_fan", floor, others)
        right = lookup.withColumn("_fan", _fan(F.col(count), floor)).drop(count)
    left = _pieces(df, hot, keys, True).withColumn(
        "_piece", F.coalesce(F.pmod(F.xxhash64(*df.columns), F.col("_fan")).cast("int"), F.lit(0))
    ).drop("_fan")
    right = right.withColumn(
        "_copy", F.explode(F.sequence(F.lit(0), F.coalesce("_fan", F.lit(1)) - 1))
    ).drop("_fan")
    right = _key_named(right, keys)
    condition = _same_keys(left, right, keys, True) & (left["_piece"] == right["_copy"])
    return left.join(right, condition, how).drop("_piece", "_copy", *["_k_" + k for k in keys])


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], floor: int = HOT_FLOOR,
                right_bounded: bool = False) -> DataFrame:
    """Inner equi-join whose hot keys are cut into independent pieces.

    A key with ``a`` pieces on the left and ``b`` on the right becomes ``a*b`` tasks. ``right_bounded`` says that the
    right side has few rows per key, so only the left is counted. Counting reads the key columns once more, so a
    costly input should be stored first. The two sides must not share column names other than the keys.
    """
    keys = list(keys)

    def hot(df: DataFrame, name: str) -> DataFrame:
        return fan_out(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys, "_n", name, floor)

    def salt(df: DataFrame, pieces: str, name: str) -> DataFrame:
        own = F.pmod(F.xxhash64(*df.columns), F.col(pieces)).cast("int")
        return df.withColumn(name, F.coalesce(own, F.lit(0)))

    def copies(df: DataFrame, pieces: str, name: str) -> DataFrame:
        return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.coalesce(pieces, F.lit(1)) - 1)))

    if right_bounded:
        cut = hot(left, "_fl")
        a = salt(_pieces(left, cut, keys, False), "_fl", "_sl").drop("_fl")
        b = copies(_pieces(right, cut, keys, False), "_fl", "_sl").drop("_fl")
        return a.join(b, [*keys, "_sl"]).drop("_sl")
    cut = hot(left, "_fl").join(hot(right, "_fr"), keys, "full")
    a = copies(salt(_pieces(left, cut, keys, False), "_fl", "_sl"), "_fr", "_sr").drop("_fl", "_fr")
    b = copies(salt(_pieces(right, cut, keys, False), "_fr", "_sr"), "_fl", "_sl").drop("_fl", "_fr")
    return a.join(b, [*keys, "_sl", "_sr"]).drop("_sl", "_sr")


def block_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_weight: Column, right_weight: Column,
               most: int = PAIRS_PER_PIECE) -> DataFrame:
    """Inner equi-join that is dealt by the pairs it makes, for keys that have many rows on both sides.

    A row's weight says for how many it stands; a pair of rows is worth the product. A key is cut into pieces of about ``most`` pairs:
    as many on the left as it has rows there, the rest on the right. The pieces are dealt to a stated number of tasks, since
    the pairs, not the bytes read, are the work. Both sides are read twice: store them first. They must not share
    column names other than the keys.
    """
    keys = list(keys)

    def sizes(df: DataFrame, weight: Column, side: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_r" + side), F.sum(weight.cast("double")).alias("_w" + side))

    pieces = F.greatest(F.lit(1.0), F.ceil(F.col("_wl") * F.col("_wr") / F.lit(float(most))))
    cuts = sizes(left, left_weight, "l").join(sizes(right, right_weight, "r"), keys).withColumn(
        "_fl", F.least(pieces, F.col("_rl"), F.lit(MAX_PIECES)).cast("int")
    ).withColumn("_fr", F.least(F.ceil(pieces / F.col("_fl")), F.col("_rr"), F.lit(MAX_PIECES)).cast("int")).select(*keys, "_fl", "_fr")

    def cut(df: DataFrame, own: str, other: str) -> DataFrame:
        at = F.pmod(F.xxhash64(*df.columns), F.col("_f" + own)).cast("int")
        copied = df.join(cuts, keys).withColumn("_s" + own, at).withColumn(
            "_s" + other, F.explode(F.sequence(F.lit(0), F.col("_f" + other) - 1))
        )
        return copied.drop("_fl", "_fr").repartition(tasks, *keys, "_sl", "_sr")

    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(left, "l", "r").join(cut(right, "r", "l"), [*keys, "_sl", "_sr"]).drop("_sl", "_sr")


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], by: Sequence[str], pieces: int = SPREAD) -> DataFrame:
    """Inner equi-join of a large table with one that has few rows per key and little of the left's size in all.

    Every key, however many there are, is cut into ``pieces`` by a hash of the left's columns ``by``, which should tell
    its rows apart, and the right side is copied to each piece. So the left is read once and no keys are counted. What is
    still uneven after that is left to the adaptive skew join.
    """
    at = F.pmod(F.xxhash64(*by), F.lit(pieces)).cast("int")
    copies = right.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    return left.withColumn("_piece", at).join(copies, [*keys, "_piece"]).drop("_piece")


def dealt(df: DataFrame, keys: Sequence[str], rows: int, most: int = ROWS_PER_TASK) -> DataFrame:
    """``df`` dealt by its keys to so many tasks that one gets about ``most`` of its ``rows``, for keys of few rows each.

    The number of tasks is stated, so it grows with the rows and is not lowered to the number of cores."""
    tasks = max(math.ceil(rows / most), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


def range_sorted(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Rows in one total order, cut into sorted ranges; adds ``_part`` (range number) and ``_pos`` (row in range).

    ``order`` should end in a unique key, so that no range holds a long run of equal rows. The split comes from a
    sample, so it is written out once and every later step reads the same split.
    """
    split = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    stored = store_once(split, "ranges")
    return stored.select(
        *df.columns,
        F.shiftright("_row", _POSITION_BITS).cast("int").alias("_part"),
        F.col("_row").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).alias("_pos"),
    )


def global_index(df: DataFrame, order: Sequence[Column], name: str = "_g") -> DataFrame:
    """0-based position of every row in the total order, without sorting in one task."""
    ranged = range_sorted(df, order)
    # One row per range: the window below and the broadcast see as many rows as there are shuffle partitions.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_pos"))
        .select(*df.columns, name)
    )
