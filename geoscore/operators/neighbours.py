"""Exact nearest neighbours without comparing every query with every point.

Points are held in a tree that is cut at quantiles of the points themselves: a crowded node is cut in each dimension at its
own quarters (or half), and what equals a cut is a part of its own, so every crowded node gets smaller, however unevenly
its points lie. All queries then walk down the tree together, one join per level: from the nodes still in play, the counts
and tight boxes give a distance within which k points certainly lie, and every node whose nearest corner is farther is
dropped. What is finally compared is a few nodes per query: a block of queries with all locations of a node, in arrays,
from which only the candidates come back as rows. Inside a large block, bunches of queries are compared with cells of
locations, nearest cells first, and only with the cells that the distance found there leaves. Groups that fit one node are
not cut or walked at all. Repeated coordinates are one location with a count.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from geoscore.functions.geo import haversine_km, unit_vector
from geoscore.operators.columns import known
from geoscore.operators.skew import HOT_FLOOR, salted_join
from geoscore.session import store_once

LEVELS_PER_STORE = 2  # steps down between two written frontiers, which keeps plans short
LEAF = 1024  # a node with no more locations than this is not cut
BLOCK = 512  # queries that are compared with a node at once
WIDE_DIMS = 4  # from here on boxes prune so little that walking costs more than comparing: nodes and blocks are larger
WIDE_LEAF, WIDE_BLOCK = 32_768, 2048
CELL, BUNCH = 256, 64  # locations and queries that are looked at together inside a large block
ACCURACY = 200  # of the quantiles; a part holds up to half a hundredth of its node more than its share


def _total(terms: Sequence[Column], metric: str) -> Column:
    """Combined distance: squared for straight-line, largest for Chebyshev."""
    if metric == "chebyshev":
        return F.greatest(*terms) if len(terms) > 1 else terms[0]
    return reduce(lambda a, b: a + b, [t * t for t in terms])


def _nearest(dims: Sequence[str], metric: str) -> Column:
    gaps = [F.greatest(F.col(f"_min_{d}") - F.col(f"_q_{d}"), F.col(f"_q_{d}") - F.col(f"_max_{d}"), F.lit(0.0))
            for d in dims]
    return _total(gaps, metric)


def _farthest(dims: Sequence[str], metric: str) -> Column:
    gaps = [F.greatest(F.abs(F.col(f"_q_{d}") - F.col(f"_min_{d}")), F.abs(F.col(f"_max_{d}") - F.col(f"_q_{d}")))
            for d in dims]
    return _total(gaps, metric)


@dataclass
class Tree:
    """``levels``: the nodes of each depth with their counts and boxes; ``places``: every location with its leaf's path."""

    by: list[str]
    boxed: list[str]
    payload: list[str]
    leaf: int
    step: int  # characters of a path per level
    levels: list[DataFrame]
    places: DataFrame

    @property
    def node_columns(self) -> list[str]:
        return ["_path", "_n", "_locs", *[f"_{e}_{c}" for c in self.boxed for e in ("min", "max")]]


def quantile_tree(locations: DataFrame, by: Sequence[str], dims: Sequence[str], also: Sequence[str] = (), payload: Sequence[str] = (),
                  count: str = "_n", leaf: int | None = None) -> Tree:
    """A tree per group ``by`` over locations that are distinct in (by, dims, also), each with a point ``count``.

    Nodes are cut along ``dims``, and along ``also`` where all locations of a node agree in ``dims``. Boxes cover both.
    A location is read again only as long as its node is crowded, so the number of stored tables grows with the logarithm
    of the largest group.
    """
    by, dims = list(by), list(dict.fromkeys(dims))
    also = [c for c in dict.fromkeys(also) if c not in dims]
    boxed = [*dims, *also]
    payload = [c for c in payload if c not in [*by, *boxed]]
    leaf = leaf or (LEAF if len(dims) < WIDE_DIMS else WIDE_LEAF)
    marks = [0.25, 0.5, 0.75] if len(dims) <= 3 else [0.5]
    left = locations.select(*by, *boxed, F.col(count).cast("bigint").alias("_n"), *payload, F.lit("").alias("_path"))
    left = store_once(left.dropna(subset=by) if by else left, "locations")  # no query finds a group without a name
    columns = left.columns
    levels: list[DataFrame] = []
    placed: list[DataFrame] = []
    node = [*by, "_path"]
    while True:
        now = store_once(left.groupBy(*node).agg(
            F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_locs"),
            *[F.min(c).alias("_min_" + c) for c in boxed], *[F.max(c).alias("_max_" + c) for c in boxed],
        ), "nodes")
        levels.append(now)
        crowded = now.where(F.col("_locs") > leaf)
        if crowded.isEmpty():
            placed.append(left)
            break
        differ = F.lit(False)
        for c in dims:
            differ = differ | (F.col("_min_" + c) < F.col("_max_" + c))
        none = F.lit(None).cast("array<double>")
        cuts = left.join(crowded.select(*node), node, "left_semi").groupBy(*node).agg(
            *[F.percentile_approx(F.col(c).cast("double"), marks, ACCURACY).alias("_cuts_" + c) for c in boxed]
        )
        split = crowded.join(cuts, node).select(
            *[F.col(c).alias("_k_" + c) for c in node], F.lit(True).alias("_cut"), *["_cuts_" + c for c in dims],
            *[F.when(~differ, F.col("_cuts_" + c)).otherwise(none).alias("_cuts_" + c) for c in also],
        )
        same = F.lit(True)
        for c in node:
            same = same & (left[c] == split["_k_" + c])

        def part(c: str) -> Column:
            """Twice the cuts below the value, and one more if it equals a cut: a digit."""
            x = F.col(c).cast("double")
            below = F.size(F.filter(F.array_distinct("_cuts_" + c), lambda cut: cut < x))
            equal = F.array_contains(F.coalesce("_cuts_" + c, F.array().cast("array<double>")), x)
            return F.when(F.col("_cuts_" + c).isNull(), "0").otherwise((2 * below + equal.cast("int")).cast("string"))

        # A hot node is split by the adaptive skew join, unless the cuts are few enough to be broadcast by Spark.
        stepped = store_once(left.join(split, same, "left").select(
            *[c for c in columns if c != "_path"],
            F.when(F.col("_cut"), F.concat("_path", *[part(c) for c in boxed])).otherwise(F.col("_path")).alias("_path"),
            F.coalesce("_cut", F.lit(False)).alias("_cut"),
        ), "parts")
        placed.append(stepped.where(~F.col("_cut")).drop("_cut"))
        left = stepped.where("_cut").drop("_cut")
    places = reduce(lambda a, b: a.unionByName(b), placed)
    return Tree(by, boxed, payload, leaf, len(boxed), levels, places)


def _together(row: Sequence[np.ndarray], most: int) -> list[np.ndarray]:
    """The places of the points with these coordinates, cut at medians of the widest dimension into parts of up to ``most``."""
    out, left = [], [np.arange(len(row[0]))]
    while left:
        part = left.pop()
        if len(part) <= most:
            out.append(part)
            continue
        widest = max((x[part] for x in row), key=np.ptp)
        order = np.argpartition(widest, len(part) // 2)
        left += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
    return out


def _candidates(k: int, dims: int, limited: int, metric: str) -> Callable[..., Column]:
    """The places ``query * locations + location`` of the pairs in a block that may be among a query's k nearest.

    Columns: the queries' coordinates, the locations', then per limited dimension the queries', the locations' and the limit.
    A few pairs too many stay where a double does not hold a coordinate exactly; the caller tests them again.
    """
    def combined(gaps: Sequence[np.ndarray]) -> np.ndarray:
        return reduce(np.maximum, gaps) if metric == "chebyshev" else np.sqrt(reduce(np.add, [g * g for g in gaps]))

    def part(row: Sequence[np.ndarray], queries: np.ndarray, locations: np.ndarray) -> list[np.ndarray]:
        """The block's columns for some of its queries and locations."""
        of = [queries] * dims + [locations] * dims + [queries, locations, queries] * limited
        return [x[places] for x, places in zip(row, of)]

    def compare(row: Sequence[np.ndarray], slack: float) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs may be wanted, and up to which distance those of each query lie."""
        total = combined([np.abs(q[:, None] - p) for q, p in zip(row[:dims], row[dims : 2 * dims])])
        inside, counted = None, total
        for i in range(2 * dims, 2 * dims + 3 * limited, 3):
            q, p, most = row[i][:, None], row[i + 1], row[i + 2][:, None]
            gap, spare = np.abs(q - p), 1e-9 * (np.abs(q) + np.abs(p) + np.abs(most))
            counted = np.where(gap <= most - spare, counted, np.inf)
            fits = gap <= most + spare
            inside = fits if inside is None else inside & fits
        if total.shape[1] > k:
            upto = np.partition(counted, k - 1, axis=1)[:, k - 1 : k] * (1 + 1e-12) + 4 * slack
            near = total <= upto
        else:
            upto = np.full((len(total), 1), np.inf)
            near = np.ones(total.shape, bool)
        return near if inside is None else near & inside, upto

    def pick(row: Sequence[np.ndarray]) -> np.ndarray:
        n_locations = len(row[dims])
        slack = 1e-15 * dims * max(float(np.abs(x).max()) for x in row[: 2 * dims])
        if n_locations <= LEAF:
            return np.flatnonzero(compare(row, slack)[0])
        at = row[dims : 2 * dims]
        cells = _together(at, CELL)
        boxes = [(np.array([x[c].min() for c in cells]), np.array([x[c].max() for c in cells])) for x in at]
        out = []
        for bunch in _together(row[:dims], BUNCH):
            near = combined([np.maximum(np.maximum(low - q[bunch, None], q[bunch, None] - high), 0.0)
                             for q, (low, high) in zip(row[:dims], boxes)])
            first = np.argsort(near.max(axis=0))
            enough = 1 + int(np.searchsorted(np.cumsum([len(cells[c]) for c in first]), k, side="right"))
            upto = compare(part(row, bunch, np.concatenate([cells[c] for c in first[:enough]])), slack)[1]
            reached = np.flatnonzero((near <= upto + 4 * slack).any(axis=0))
            some = np.concatenate([cells[c] for c in reached])
            q, p = np.nonzero(compare(part(row, bunch, some), slack)[0])
            out.append(bunch[q] * n_locations + some[p])
        return np.concatenate(out)

    def picked(*columns: pd.Series) -> pd.Series:
        return pd.Series([pick(row) for row in zip(*columns)], dtype=object)

    picked.__annotations__ = {"columns": pd.Series, "return": pd.Series}
    return F.pandas_udf(picked, "array<bigint>")


def _compared(at_leaf: DataFrame, tree: Tree, q_cols: Sequence[str], k: int, dims: Sequence[str], metric: str,
              within: Mapping[str, str], most: int) -> DataFrame:
    """Pairs of a query and a location of its nodes, without those that have k nearer locations in the node.

    Blocks are dealt to a stated number of tasks, since the comparisons, not the bytes read, are the work.
    """
    at = ["_q_" + c for c in tree.by] + ["_path"]
    coordinates = list(dict.fromkeys([*dims, *within]))
    tasks = int(at_leaf.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = at_leaf.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias("_blocks")).where(F.col("_blocks") > 1)
    whole = F.coalesce("_blocks", F.lit(1))
    queries = at_leaf.join(many, at, "left").withColumn("_block", F.pmod(F.xxhash64(*q_cols), whole).cast("int")) \
        .repartition(tasks, *at, "_block").groupBy(*at, "_block").agg(F.collect_list(F.struct(*q_cols)).alias("_qs"))
    placed = tree.places.select(
        *[F.col(c).alias("_q_" + c) for c in tree.by], "_path",
        F.struct(*[F.col(c).alias("_l_" + c) for c in coordinates], "_n", *[F.col(c).alias("_pl_" + c) for c in tree.payload]).alias("_l"),
    )
    locations = placed.join(many, at, "left").withColumn("_block", F.explode(F.sequence(F.lit(0), whole - 1))) \
        .repartition(tasks, *at, "_block").groupBy(*at, "_block").agg(F.collect_list("_l").alias("_ls"))

    def values(side: str, c: str) -> Column:
        return F.col(f"_{side}s")[f"_{side}_{c}"].cast("array<double>")

    columns = [values(side, c) for side in "ql" for c in dims]
    for c, limit in within.items():
        columns += [values("q", c), values("l", c), values("q", limit)]
    blocks = queries.join(locations, [*at, "_block"]).withColumn("_hits", _candidates(k, len(dims), len(within), metric)(*columns))
    size = F.size("_ls")
    return blocks.select(F.explode(F.transform("_hits", lambda h: F.struct(
        F.get("_qs", ((h - h % size) / size).cast("int")).alias("q"), F.get("_ls", (h % size).cast("int")).alias("l")
    ))).alias("_pair")).select("_pair.q.*", "_pair.l.*")


def search(tree: Tree, queries: DataFrame, k: int, dims: Sequence[str], metric: str = "euclid",
           within: Mapping[str, str] | None = None, floor: int = HOT_FLOOR) -> DataFrame:
    """Per query location: every location with fewer than ``k`` points strictly nearer, so ties at the end all stay.

    ``queries`` has one row per (by, dims), where ``dims`` are among the tree's columns. ``within``
    maps extra coordinate columns, present on both sides, to the query column that limits the gap in them (closed);
    those columns and limits belong to the query's key. Result: the query's key columns prefixed ``_q_``, the
    payload of the location and its coordinates prefixed ``_l_``, ``_d`` (squared distance, or the largest gap for ``chebyshev``) and the count.
    """
    by, dims, within = tree.by, list(dims), dict(within or {})
    boxed = list(dict.fromkeys([*dims, *within]))
    q_key = list(dict.fromkeys([*by, *boxed, *within.values()]))
    q_cols = ["_q_" + c for c in q_key]
    start = queries.select(*[F.col(c).alias("_q_" + c) for c in q_key])
    start = store_once(start.repartition(start.sparkSession.sparkContext.defaultParallelism, *q_cols), "queries")
    node_cols = tree.node_columns
    tasks = int(start.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def prune(frontier: DataFrame) -> DataFrame:
        """Drop the nodes that cannot hold one of a query's k nearest. The bound found one level up already drops most
        of them before the rows of a query are brought together."""
        sure = F.lit(True)
        for c, limit in within.items():
            lo, hi, q, r = (F.col(n) for n in (f"_min_{c}", f"_max_{c}", f"_q_{c}", f"_q_{limit}"))
            frontier = frontier.where(F.greatest(lo - q, q - hi, F.lit(0.0)) <= r)
            sure = sure & (F.greatest(F.abs(q - lo), F.abs(hi - q)) <= r)
        scored = frontier.withColumns({
            "_near": _nearest(dims, metric), "_far": F.when(sure, _farthest(dims, metric)).otherwise(F.lit(float("inf"))),
        }).where(F.col("_near") <= F.col("_limit")).repartition(tasks, *q_cols)  # few bytes, much work
        by_far = Window.partitionBy(*q_cols).orderBy("_far")
        reached = scored.withColumn("_cum", F.sum("_n").over(by_far)).withColumn(
            "_bound", F.min(F.when(F.col("_cum") >= k, F.col("_far"))).over(Window.partitionBy(*q_cols))
        )
        limit = F.least("_limit", "_bound")  # ignores a NULL bound: fewer than k points are in play
        return reached.where(F.col("_near") <= limit).select(*q_cols, *node_cols, limit.alias("_limit"))

    def walk(frontier: DataFrame) -> DataFrame:
        """Down from the tops to the leaves."""
        frontier = prune(frontier)
        depth = len(tree.levels) - 1
        for level, below in enumerate(tree.levels[1:]):
            # A hot parent (at the top all queries share one) meets a bounded number of children. The child side is small
            # at the top, where Spark broadcasts it; below that a skewed parent is split by the adaptive skew join.
            children = below.select(
                *[F.col(c).alias("_k_" + c) for c in by], F.left("_path", F.lit(level * tree.step)).alias("_parent"),
                F.lit(True).alias("_open"), *[F.col(c).alias("_n_" + c) for c in node_cols],
            )
            opened = frontier.withColumn("_open", (F.length("_path") == level * tree.step) & (F.col("_locs") > tree.leaf))
            same = (opened["_open"] == children["_open"]) & (opened["_path"] == children["_parent"])
            for c in by:
                same = same & (opened["_q_" + c] == children["_k_" + c])
            frontier = prune(opened.join(children, same, "left").select(
                *q_cols, *[F.coalesce("_n_" + c, c).alias(c) for c in node_cols], "_limit"
            ))
            if level % LEVELS_PER_STORE == LEVELS_PER_STORE - 1 or level == depth - 1:
                frontier = store_once(frontier, "frontier")
        return frontier

    def compared(at_leaf: DataFrame) -> DataFrame:
        most = BLOCK if len(dims) < WIDE_DIMS else WIDE_BLOCK
        pairs = _compared(at_leaf, tree, q_cols, k, dims, metric, within, min(floor, most))
        for c, limit in within.items():
            pairs = pairs.where(F.abs(F.col("_l_" + c) - F.col("_q_" + c)) <= F.col("_q_" + limit))
        return pairs.withColumn("_d", _total([F.abs(F.col("_l_" + d) - F.col("_q_" + d)) for d in dims], metric))

    by_distance = Window.partitionBy(*q_cols).orderBy("_d")
    upto = by_distance.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    at_leaf = start.withColumn("_path", F.lit(""))
    if len(tree.levels) > 1:
        tops = tree.levels[0]
        if by:
            roots = start.join(tops.withColumnsRenamed({c: "_q_" + c for c in by}), ["_q_" + c for c in by])
        else:
            roots = start.crossJoin(F.broadcast(tops))  # without groups the top of the tree is one row
        crowded = F.col("_locs") > tree.leaf
        tall = roots.where(crowded)
        left = walk(tall.withColumn("_limit", F.lit(float("inf"))))
        at_leaf = roots.where(~crowded).select(*q_cols, "_path").unionByName(left.select(*q_cols, "_path"))
    pairs = compared(at_leaf)
    # Every location stands for at least one point, so one with k nearer locations is out. Spark applies this rank limit
    # inside each task before the shuffle; the exact test on point counts is left to the few rows that remain.
    pairs = pairs.withColumn("_r", F.rank().over(by_distance)).where(F.col("_r") <= k).drop("_r")
    level_with = Window.partitionBy(*q_cols, "_d")
    closer = F.sum("_n").over(upto) - F.sum("_n").over(level_with)
    return pairs.withColumn("_closer", closer).where(F.col("_closer") < k).select(
        *q_cols, *["_l_" + c for c in boxed], *[F.col("_pl_" + c).alias(c) for c in tree.payload], "_d", "_n"
    )


def nearest_locations(queries: DataFrame, locations: DataFrame, k: int, dims: Sequence[str], by: Sequence[str] = (),
                      metric: str = "euclid", within: Mapping[str, str] | None = None, payload: Sequence[str] = (),
                      count: str = "_n", leaf: int | None = None, floor: int = HOT_FLOOR) -> DataFrame:
    """:func:`search` in a :func:`quantile_tree` built for it."""
    tree = quantile_tree(locations, by, dims, list(within or {}), payload, count, leaf)
    return search(tree, queries, k, dims, metric, within, floor)


def _first_ids(points: DataFrame, at: Sequence[str], point_id: str, k: int) -> DataFrame:
    """One row per location with its count and its k smallest ids. The rank limit is applied inside each task before
    the shuffle, so a location that holds a large part of the table sends on k ids per task."""
    order = Window.partitionBy(*at).orderBy(point_id)
    few = (
        points.select(*at, point_id).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
        .groupBy(*at).agg(F.sort_array(F.collect_list(point_id)).alias("_ids"))
    )
    return points.groupBy(*at).agg(F.count(F.lit(1)).alias("_n")).join(few, list(at))


def point_tree(points: DataFrame, point_id: str, k: int, dims: Sequence[str], by: Sequence[str] = (), also: Sequence[str] = (),
               leaf: int | None = None) -> Tree:
    """A tree that :func:`knn_join` can search for up to ``k`` neighbours by any of its coordinates, as often as wanted."""
    at = list(dict.fromkeys([*by, *dims, *also]))
    known_p = known(points.select(point_id, *at), *at).dropna(subset=at)
    return quantile_tree(_first_ids(known_p, at, point_id, k), by, dims, also, ["_ids"], leaf=leaf)


def knn_join(queries: DataFrame, points: DataFrame | Tree, query_id: str, point_id: str, k: int, dims: Sequence[str],
             by: Sequence[str] = (), metric: str = "euclid", within: Mapping[str, str] | None = None,
             leaf: int | None = None, floor: int = HOT_FLOOR, coordinates: bool = False) -> DataFrame:
    """(query id, point id, distance, rank): the k nearest points of every query, ties by point id.

    Plain straight-line distance on the unscaled columns. Queries with no point at all are absent, and so are queries
    and points with a NULL, NaN or infinite coordinate. ``points`` may be a :func:`point_tree`. ``coordinates``
    adds the query's (``_q_``) and the point's (``_l_``) coordinate columns.
    """
    by, dims, within = list(by), list(dims), dict(within or {})
    at = list(dict.fromkeys([*by, *dims, *within]))
    key = list(dict.fromkeys([*at, *within.values()]))
    known_q = store_once(known(queries.select(query_id, *key), *key).dropna(subset=key), "queries")
    tree = points if isinstance(points, Tree) else point_tree(points, point_id, k, dims, by, list(within), leaf)
    found = search(tree, known_q.select(*key).distinct(), k, dims, metric, within, floor)
    best = Window.partitionBy(*["_q_" + c for c in key]).orderBy("_d", point_id)
    ranked = (
        found.withColumn(point_id, F.explode("_ids"))
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .withColumn("distance", F.sqrt("_d") if metric == "euclid" else F.col("_d"))
        .select(*["_q_" + c for c in key], *["_l_" + c for c in at if c not in by], point_id, "distance", "rank")
    )
    keyed = known_q.withColumnsRenamed({c: "_q_" + c for c in key})
    return salted_join(keyed, ranked, ["_q_" + c for c in key], floor, right_bounded=True).select(
        query_id, point_id, "distance", "rank", *(["_q_" + c for c in key] + ["_l_" + c for c in at if c not in by] if coordinates else [])
    )


def nearest_feature(queries: DataFrame, points: DataFrame, query_id: str, point_id: str,
                    dims: Sequence[str] = ("lon", "lat")) -> DataFrame:
    """The nearest point of every query."""
    return knn_join(queries, points, query_id, point_id, 1, dims).drop("rank")


def _on_sphere(df: DataFrame, lat: str, lon: str) -> DataFrame:
    return df.withColumns({n: c.cast("double") for n, c in unit_vector(F.col(lat), F.col(lon)).items()})


def _closest_in_box(queries: DataFrame, points: DataFrame | Tree, query_id: str, point_id: str, radius: str, lat: str,
                    lon: str, leaf: int | None) -> DataFrame:
    if not isinstance(points, Tree):
        points = _on_sphere(points, lat, lon)
    near = knn_join(
        _on_sphere(queries, lat, lon), points, query_id, point_id, 1, ["_x", "_y", "_z"],
        within={lat: radius, lon: radius}, leaf=leaf, coordinates=True,
    )
    distance = haversine_km(F.col("_q_" + lat), F.col("_q_" + lon), F.col("_l_" + lat), F.col("_l_" + lon))
    return near.select(query_id, point_id, distance.alias("distance"), F.col("_q_" + radius).alias("radius"))


def bbox_nearest_join(queries: DataFrame, points: DataFrame, query_id: str, point_id: str, radius_deg: float,
                      lat: str = "lat", lon: str = "lon", leaf: int | None = None) -> DataFrame:
    """Of the points in a square of ``radius_deg`` around each query, the closest along the great circle."""
    limited = queries.withColumn("_radius", F.lit(float(radius_deg)))
    return _closest_in_box(limited, points, query_id, point_id, "_radius", lat, lon, leaf).drop("radius")


def expanding_nearest_join(queries: DataFrame, points: DataFrame, query_id: str, point_id: str,
                           radii: Sequence[float], lat: str = "lat", lon: str = "lon", leaf: int | None = None) -> DataFrame:
    """Closest point in the first square of the growing list of radii that holds any point.

    The first square that holds a point is known from the nearest point by largest coordinate gap, so there are two
    searches in all, not one per radius, and both go down the same tree. Queries with nothing inside the last square are
    absent.
    """
    tree = point_tree(_on_sphere(points, lat, lon), point_id, 1, [lat, lon], also=["_x", "_y", "_z"], leaf=leaf)
    gap = knn_join(queries, tree, query_id, point_id, 1, [lat, lon], metric="chebyshev") \
        .select(query_id, F.col("distance").alias("_gap"))
    steps = F.array(*[F.lit(float(r)) for r in sorted(radii)])
    limited = store_once(queries.select(query_id, lat, lon).join(gap, query_id).withColumn(
        "_radius", F.array_min(F.filter(steps, lambda r: r >= F.col("_gap")))
    ).where(F.col("_radius").isNotNull()), "limited")
    return _closest_in_box(limited, tree, query_id, point_id, "_radius", lat, lon, leaf)
