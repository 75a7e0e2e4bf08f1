"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

Equal vectors are one. Each vector is normalised, so a cosine of at least ``least`` is a distance of at most
``sqrt(2 - 2 * least)``. A table of hashes is a group of random projections, each shifted, divided by a width and
rounded down; vectors that agree in all of a table's hashes share a bucket. Only vectors of one bucket (and label) are
compared. A bucket is cut into blocks and each pair of blocks is compared on its own, so a crowded bucket is many small
tasks. A pair that shares several buckets counts in the first one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

from geoscore.llm.common import tables as scratch
from geoscore.llm.components import components

TABLES, HASHES, WIDTH = 24, 6, 1.2
BLOCK = 256
SEED = 20_01


def _projections(size: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng([SEED, size])
    return random.standard_normal((size, TABLES * HASHES)), random.random(TABLES * HASHES) * WIDTH


def _scaled(matrix: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest value near one, so that no square is too large or small."""
    return np.ldexp(matrix, -np.frexp(np.abs(matrix).max(axis=1, keepdims=True))[1])


def _signatures(matrix: np.ndarray) -> np.ndarray:
    """One 64-bit bucket name per row and table."""
    matrix = _scaled(matrix)
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    along, shift = _projections(matrix.shape[1])
    cells = np.floor((unit @ along + shift) / WIDTH).astype(np.int64).reshape(len(matrix), TABLES, HASHES)
    out = np.full(cells.shape[:2], 0x9E3779B97F4A7C15, np.uint64)
    for k in range(HASHES):
        out = (out ^ cells[:, :, k].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("embedding")
        sizes = np.asarray(lists.value_lengths())
        values = np.asarray(lists.flatten())
        ends = np.cumsum(sizes)
        out = np.empty((batch.num_rows, TABLES), np.int64)
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            out[rows] = _signatures(values[(ends[rows] - size)[:, None] + np.arange(size)].astype(np.float64))
        flat = pa.ListArray.from_arrays(np.arange(0, out.size + 1, TABLES, dtype=np.int32), out.reshape(-1))
        yield pa.RecordBatch.from_arrays([*batch.columns, flat], names=[*batch.schema.names, "buckets"])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each one's group, for the links (a, b) among n members."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _compare(least: float):
    def one(ids, reps, copies, unit, buckets, side, table, within) -> pd.DataFrame | None:
        order = np.lexsort((ids, side))
        ids, reps, copies = ids[order], reps[order], copies[order]
        unit, buckets, side = unit[order], buckets[order], side[order]
        cut = len(ids) if within else int((side == 0).sum())
        left, right = (slice(None), slice(None)) if within else (slice(0, cut), slice(cut, None))
        linked = unit[left] @ unit[right].T >= least
        if within:
            linked = np.triu(linked, 1)
        a, b = np.nonzero(linked)
        if not within:
            b = b + cut
        for earlier in range(table):
            new = buckets[a, earlier] != buckets[b, earlier]
            a, b = a[new], b[new]
        if not len(a):
            return None
        others = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
        # Roots are taken in the order of the representatives, so that each is its group's least.
        place = np.argsort(np.argsort(reps))
        root = np.sort(reps)[_roots(len(ids), place[a], place[b])][place]
        found = np.flatnonzero(others)
        return pd.DataFrame(
            {"cid": ids[found], "rep": reps[found], "others": others[found].astype(np.int64), "root": root[found]}
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = ["table", "bucket", "bi", "bj", "label", "size"]
        held: pd.DataFrame | None = None

        def finish(frame: pd.DataFrame) -> pd.DataFrame | None:
            out = []
            for names, rows in frame.groupby(key, sort=False):
                if len(rows) < 2:
                    continue
                matrix = _scaled(np.stack(rows["embedding"].to_numpy()).astype(np.float64))
                matrix /= np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]
                found = one(
                    rows["cid"].to_numpy(), rows["rep"].to_numpy(), rows["copies"].to_numpy(), matrix, np.stack(rows["buckets"].to_numpy()),
                    rows["side"].to_numpy(), names[0], names[2] == names[3],
                )
                if found is not None:
                    out.append(found)
            return pd.concat(out) if out else None

        for frame in batches:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = (frame[key] == frame[key].iloc[-1]).all(axis=1).to_numpy()
            begin = len(last) if not last.any() else len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
            held = frame.iloc[begin:]
            done = finish(frame.iloc[:begin]) if begin else None
            if done is not None:
                yield done
        if held is not None and len(held):
            done = finish(held)
            if done is not None:
                yield done

    return run


def linked_vectors(vectors: DataFrame, least: float = 0.98, key: str = "vec_id", vector: str = "embedding",
                   label: str = "label") -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Two vectors link if their labels are equal and not null and their cosine, in double precision, is at least
    ``least``. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of
    different lengths never link. A row with a null key links with nothing. Rows repeated with one key are one vector
    if they are equal, else vectors of one component; each gives a row. With the default tables a pair at the very threshold is missed with a chance of
    about two in a million, closer pairs less often.
    """
    # Vectors of 32-bit floats stay so until they are compared, all others become doubles: nothing is rounded.
    given = vectors.select(vector).schema[0].dataType
    kind = "float" if isinstance(given, ArrayType) and isinstance(given.elementType, FloatType) else "double"
    rows = vectors.select(
        F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast(f"array<{kind}>").alias("embedding")
    )
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & finite
        & F.exists("embedding", lambda x: x != 0), F.lit(False)
    )
    with scratch(vectors.sparkSession) as own:
        distinct = rows.where(usable).distinct().groupBy("label", "embedding").agg(
            F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")
        )
        kinds = distinct.schema["label"].dataType.simpleString()
        # The number of a class is read from the stored table only, where it no longer changes.
        named = distinct.select(F.monotonically_increasing_id().alias("cid"), "rep", "copies", "label", "embedding")
        hashed = own.store(named.mapInArrow(
            _hash, f"cid long, rep long, copies long, label {kinds}, embedding array<{kind}>, buckets array<long>"
        ), "hashed")
        entries = hashed.select(
            "cid", "label", F.size("embedding").alias("size"), F.posexplode("buckets").alias("table", "bucket")
        )
        place = ["label", "size", "table", "bucket"]
        shared = entries.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
            *place, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")
        )
        crowded = entries.join(shared, place)
        mine = F.pmod(F.xxhash64("cid", "table"), F.col("blocks")).cast("int")
        against = crowded.withColumn("mine", mine).withColumn(
            "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        ).select(
            "cid", "table", "bucket", F.least("mine", "other").alias("bi"), F.greatest("mine", "other").alias("bj"),
            F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"), "size",
        )
        pairs = (
            against.join(hashed, "cid")
            .select("table", "bucket", "bi", "bj", "label", "size", "side", "cid", "rep", "copies", "embedding", "buckets")
            .repartition("table", "bucket", "bi", "bj", "label", "size")
            .sortWithinPartitions("table", "bucket", "bi", "bj", "label", "size")
        )
        found = own.store(pairs.mapInPandas(_compare(least), "cid long, rep long, others long, root long"), "found")
        counts = found.groupBy("cid").agg(F.sum("others").alias("others"))
        joined = components(found.selectExpr("rep AS a", "root AS b"), own)
        of_rep = own.store(
            hashed.select("label", "embedding", "cid", "rep", "copies").join(counts, "cid", "left")
            .join(joined.withColumnRenamed("node", "rep"), "rep", "left")
            .selectExpr("label AS _l", "embedding AS _e", "copies - 1 + coalesce(others, 0) AS n", "coalesce(component, rep) AS c"),
            "classes",
        )
        own.keep_only(of_rep)
    out = rows.withColumn("_u", usable).join(
        of_rep, F.col("_u") & (F.col("label") == F.col("_l")) & (F.col("embedding") == F.col("_e")), "left"
    )
    component = F.coalesce("c", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
