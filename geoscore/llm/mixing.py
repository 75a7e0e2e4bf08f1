"""Mixing of sources to target weights, in blocks of words.

The words of each source, in the order of its documents, are cut into blocks of a fixed number of words. A source's
target says how many of its blocks the mix takes, which may be several rounds (epochs) over the source. Every output shard
draws from a multinomial how many of its slots each source gets. A source's slots are numbered over the shards, and slot
number k of an epoch is the block at place k of a pseudorandom permutation of the source's blocks; so an epoch takes no
block twice. Slots and blocks are joined by the block's number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType

from geoscore.llm.common import WORD, Tables, fresh
from geoscore.operators.skew import global_index, range_sorted

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3  # times that a source's words may be taken
BLOCK = 512  # words
SLOTS = 1024  # of a shard
FAN = 64  # children of a node in the tree of sources
SEED = 31_337

U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def permuted(place: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a pseudorandom permutation of 0..n-1, chosen by ``key``, sends ``place``; all three go row by row.

    Four Feistel rounds permute the next even power of two; a value outside is sent on until it is inside. That ends for
    places inside only, so a place outside 0..n-1 stays where it is.
    """
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask, key = (U(1) << half) - U(1), key.astype(np.uint64)
    at, todo = place.astype(np.uint64), np.flatnonzero((n > 1) & (place >= 0) & (place < n))
    n = n.astype(np.uint64)
    while len(todo):
        left, right = at[todo] >> half[todo], at[todo] & mask[todo]
        for k in range(4):
            turn = _mix(right + _mix(key[todo] + U(k + 1))) & mask[todo]
            left, right = right, left ^ turn
        at[todo] = (left << half[todo]) | right
        todo = todo[at[todo] >= n[todo]]
    return at.astype(np.int64)


@F.pandas_udf(LongType())
def _block_of(place: pd.Series, n: pd.Series, source: pd.Series, epoch: pd.Series) -> pd.Series:
    key = _mix(_mix(source.to_numpy().astype(np.uint64) + U(SEED)) + epoch.to_numpy().astype(np.uint64))
    return pd.Series(permuted(place.to_numpy(), n.to_numpy(), key))


def _split(seed: int):
    """Multinomial draws of one node's slots among its children, each row from a generator of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, nodes, n = [], [], []
            for i, (shard, level, node, slots, children, sizes) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                p = np.array(sizes, np.float64)
                got = np.random.default_rng([seed, level, node, shard]).multinomial(slots, p / p.sum())
                for k in np.flatnonzero(got).tolist():
                    rows.append(i)
                    nodes.append(children[k])
                    n.append(int(got[k]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(nodes, pa.int64()), pa.array(n, pa.int64())],
                names=["shard", "idx", "n"],
            )

    return run


def shard_draws(quota: DataFrame, own: Tables, seed: int) -> tuple[DataFrame, int]:
    """How many slots of each shard every source gets: ``(shard, idx, n)``, and the number of shards.

    One multinomial over all sources is drawn as conditional ones down a tree of FAN children a node, whose leaves are
    the sources, so no list of all sources exists anywhere. ``quota``: ``idx`` and ``k_all``, the slots a source should get.
    """
    spark = quota.sparkSession
    slots, last = quota.agg(F.coalesce(F.sum("k_all"), F.lit(0)), F.coalesce(F.max("idx"), F.lit(0))).first()
    shards = -(-slots // SLOTS)
    drawn = spark.range(shards).select(F.col("id").alias("shard"), F.lit(0).cast("long").alias("idx"), F.lit(SLOTS).cast("long").alias("n"))
    levels, below = [], quota.select("idx", "k_all")
    while True:
        node = F.expr(f"idx DIV {FAN}")
        tree = below.groupBy(node.alias("_node")).agg(
            F.sort_array(F.collect_list(F.struct("idx", "k_all"))).alias("children"), F.sum("k_all").alias("k_all")
        )
        levels.append(own.store(tree, "tree"))
        below, last = levels[-1].select(F.col("_node").alias("idx"), "k_all"), last // FAN
        if not last:
            break
    for level in range(len(levels) - 1, -1, -1):
        # Near the root these are a few rows, which Spark broadcasts; further down a node has its share of the shards.
        met = drawn.join(levels[level], F.col("idx") == F.col("_node")).select(
            "shard", F.lit(level).alias("level"), "idx", "n", F.col("children.idx").alias("children"), F.col("children.k_all").alias("sizes")
        )
        drawn = met.mapInArrow(_split(seed), "shard long, idx long, n long")
    return own.store(drawn, "drawn"), shards


def source_targets(sized: DataFrame, own: Tables, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source: ``idx`` in order of code points (null last), ``source_size`` and ``target`` in words."""
    sums = own.store(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ranked = global_index(sums, [F.col("source").asc_nulls_last()], "idx")
    chosen = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("idx") % len(weights) + 1).cast("int"))
    weighed = own.store(ranked.withColumn("w", chosen).withColumn("cap", F.col("source_size") * float(most)), "weights")
    level, capped = 0.0, -1
    while True:  # each turn reads one row of sums; the level only rises
        is_full = F.col("w") * level >= F.col("cap")
        whole, taken, free, n = weighed.agg(
            F.sum("source_size"), F.sum(F.when(is_full, F.col("cap")).otherwise(0.0)),
            F.sum(F.when(~is_full, F.col("w")).otherwise(0.0)), F.count(F.when(is_full, 1)),
        ).first()
        if n == capped or not free:
            break
        level, capped = (whole - taken) / free, n
    return weighed.withColumn("target", F.least(F.col("w") * level, F.col("cap"))).drop("w", "cap")


class Mix:
    """The parts of a mix: ``docs`` (documents with their place in the source's words), ``slots`` and ``pieces``."""

    def __init__(self, documents: DataFrame, own: Tables, key: str, text: str, source: str, weights: Sequence[float],
                 most: int, block: int, seed: int):
        spark = documents.sparkSession
        sized = own.store(documents.select(
            F.col(key).alias("doc_id"), F.col(source).alias("source"), F.xxhash64(key, source, text).alias("row_hash"),
            F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ), "sized")
        targets = own.store(source_targets(sized, own, weights, most), "targets")
        # Word offsets without a task per source: sums inside each sorted range, and sums over the ranges before.
        ranged = range_sorted(sized, [F.col("source").asc_nulls_last(), F.col("doc_id"), F.col("row_hash")])
        inside = Window.partitionBy("_part", "source").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
        before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = ranged.groupBy("source", "_part").agg(F.sum("size").alias("n")).select(
            F.col("source").alias("_s"), F.col("_part").alias("_p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")
        )
        placed = ranged.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
            offsets, (F.col("_part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s"))
        ).drop("_s", "_p", "_part", "_pos")
        of = targets.withColumnRenamed("source", "_s")
        self.docs = own.store(
            placed.join(of, F.col("source").eqNullSafe(F.col("_s"))).withColumn("start", F.col("ahead") + F.col("own"))
            .drop("_s", "ahead", "own"), "placed"
        )
        quota = targets.where("source_size > 0").select(
            "idx", "source_size", F.round("target").cast("long").alias("take"),
            F.expr(f"source_size DIV {block}").alias("full"), F.expr(f"(source_size + {block - 1}) DIV {block}").alias("blocks"),
        ).withColumns({
            "epochs": F.expr("take DIV source_size"), "rest": F.expr("take % source_size"),
        }).withColumn("k_all", F.col("epochs") * F.col("blocks") + F.ceil(F.col("rest") / block))
        quota = own.store(quota.where("k_all > 0"), "quota")
        drawn, shards = shard_draws(quota, own, seed)
        up_to = Window.partitionBy("idx").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
        runs = drawn.withColumn("stop", F.sum("n").over(up_to)).select("shard", "idx", F.expr("stop - n").alias("begin"), "stop")
        short = quota.select("idx", "k_all").join(drawn.groupBy("idx").agg(F.sum("n").alias("n")), "idx", "left").select(
            "idx", F.explode(F.expr(
                f"CASE WHEN k_all > coalesce(n, 0) THEN sequence(coalesce(n, 0), k_all - 1, {SLOTS}L) "
                "ELSE CAST(array() AS array<bigint>) END"
            )).alias("begin"), "k_all", F.coalesce("n", F.lit(0)).alias("n"),
        ).select(
            (F.lit(shards) + F.expr(f"(begin - n) DIV {SLOTS}")).alias("shard"), "idx", "begin",
            F.least(F.col("begin") + SLOTS, F.col("k_all")).alias("stop"),
        )
        # Draws beyond a source's quota are left out; what the draws fell short of fills shards of its own at the end.
        filled = runs.unionByName(short).join(quota, "idx").withColumn("stop", F.least("stop", "k_all")).where("begin < stop")
        numbered = filled.withColumn("k", F.explode(F.expr("sequence(begin, stop - 1)"))).withColumns({
            "epoch": F.expr("k DIV blocks"), "place": F.expr("k % blocks"),
        })
        last = F.col("epoch") == F.col("epochs")
        length = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
        self.slots = own.store(
            numbered.withColumn("block", F.when(F.col("place") < F.col("full"), _block_of("place", "full", "idx", "epoch"))
                                .otherwise(F.col("full")))
            .select("shard", F.xxhash64("shard", "idx", "k").alias("slot"), "idx", "epoch", "block", (F.col("block") * block).alias("first"),
                    F.when(last, F.least(length, F.col("rest") - F.col("place") * block)).otherwise(length).alias("words")),
            "slots",
        )
        blocks = self.docs.where("size > 0").select(
            "idx", "start", "size", F.explode(F.expr(f"sequence(start DIV {block}, (start + size - 1) DIV {block})")).alias("block")
        )
        self.pieces = blocks.join(self.slots, ["idx", "block"]).select(
            "shard", "slot", "idx", "epoch", "start", (F.greatest("first", "start") - F.col("start")).alias("from"),
            (F.least(F.col("first") + F.col("words"), F.col("start") + F.col("size")) - F.col("start")).alias("to"),
        ).where("from < to")


def mix(documents: DataFrame, own: Tables, key: str = "doc_id", text: str = "text", source: str = "source",
        weights: Sequence[float] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = SEED) -> Mix:
    """Plan a mix. ``weights`` repeat over the sources in order of code points, null last.

    A null source is a source, a null text has no words, a document without words is never taken. The words taken of a
    source are its target, rounded to a word. No word is taken more than ``most`` times. The same rows give the same mix.
    The block at the end of a source, if shorter than the others, is the last of its epoch.
    """
    return Mix(documents, own, key, text, source, weights, most, block, seed)


def taken_per_document(parts: Mix) -> DataFrame:
    taken = parts.pieces.groupBy(F.col("idx").alias("_i"), F.col("start").alias("_b")).agg(F.sum(F.expr("to - from")).alias("n"))
    docs = parts.docs
    joined = docs.join(taken, (docs["idx"] == taken["_i"]) & (docs["start"] == taken["_b"]) & (docs["size"] > 0), "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("n", F.lit(0)).alias("taken"))


def _slice(text: str, ranges: list[dict]) -> str:
    """The words of ``ranges`` with what stands between neighbours; a line feed where words are left out."""
    spans = [m.span() for m in re.finditer(WORD, text)]
    out, ranges = [], sorted((r["from"], r["to"]) for r in ranges)
    if ranges[0][0] == 0 and ranges[-1][1] == len(spans) and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:])):
        return text
    begin, end = ranges[0]
    for a, b in ranges[1:]:
        if a != end:
            out.append(text[spans[begin][0] : spans[end - 1][1]])
            begin = a
        end = b
    out.append(text[spans[begin][0] : spans[end - 1][1]])
    return "\n".join(out)


def mixed_documents(documents: DataFrame, parts: Mix, key: str = "doc_id", text: str = "text", source: str = "source",
                    chars: str = "n_chars") -> DataFrame:
    """The mix as documents: one row per document and epoch that takes words of it, with the words taken as its text.

    A document taken whole keeps its text as it is. The other columns stay; ``chars`` is the new length if there is one.
    """
    h, j, e, ranges = (fresh(documents, x) for x in ("_h", "_j", "_epoch", "_ranges"))
    # Rows that are equal throughout are told apart by a number, so each meets its own place in the source.
    same = lambda order: F.row_number().over(Window.partitionBy(h).orderBy(order))
    takes = parts.pieces.groupBy(F.col("idx").alias("_i"), F.col("start").alias("_b"), F.col("epoch").alias(e)).agg(
        F.collect_list(F.struct("from", "to")).alias(ranges)
    )
    docs = parts.docs.where("size > 0").select(F.col("row_hash").alias(h), "idx", "start").withColumn(j, same(F.col("start")))
    wanted = docs.join(takes, (F.col("idx") == F.col("_i")) & (F.col("start") == F.col("_b"))).select(h, j, e, ranges)
    numbered = documents.withColumn(h, F.xxhash64(key, source, text)).withColumn(j, same(F.lit(1)))
    joined = numbered.join(wanted, [h, j]).select(*documents.columns, ranges)
    at = documents.columns.index(text)
    count = documents.columns.index(chars) if chars in documents.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_slice(t, r) for t, r in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())]
            columns = batch.columns[:-1]
            columns[at] = pa.array(made, pa.string())
            if count is not None:
                columns[count] = pa.array(map(len, made), pa.int64()).cast(batch.schema.types[count])
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.mapInArrow(run, documents.schema)
