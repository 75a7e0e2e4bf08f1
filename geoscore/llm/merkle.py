"""Merkle manifest of a table: a tree per group over its rows in order, and a tree over the groups' roots.

Nodes of a tree are cut into aligned blocks of ``fanout ** low`` and each block is hashed up in one task to its one root.
What lies above is found by a butterfly exchange. In round r a block holds the node of its ancestor at height low + r; it
swaps it with the blocks that have the same place below the sibling ancestors, and all of them hash the same parent. After
the last round every block knows the root and all siblings on its way there, so nothing has to be passed down again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from geoscore.llm.common import Tables
from geoscore.llm.runs import by_runs
from geoscore.operators.skew import range_sorted

FANOUT = 3
LOW = 6  # levels hashed inside a task: blocks of at most FANOUT ** LOW nodes


def _hash(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Digest of a row: of ``-`` for a null field, else of the field's UTF-8 bytes after their number and a colon."""
    marked = []
    for field in fields:
        text = field.cast("string")
        marked.append(F.when(field.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*marked), 256)


def folded(node: Column, lefts: Column, rights: Column) -> Column:
    """The root that a node leads to with the siblings on its left and right, level by level."""
    return F.aggregate(
        F.arrays_zip(lefts.alias("l"), rights.alias("r")), node, lambda got, level: F.sha2(F.concat(level["l"], got, level["r"]), 256)
    )


def proof_digest(lefts: Column, rights: Column) -> Column:
    """Digest of all siblings on the way to the root, level by level, left to right."""
    return F.sha2(F.array_join(F.zip_with(lefts, rights, lambda a, b: F.concat(a, b)), ""), 256)


def _grow(nodes: list[str], fanout: int, levels: int) -> tuple[list[list[str]], list[list[str]], str]:
    """Hash a block up ``levels`` levels: for each node its siblings on the left and right by level, and the last hash."""
    lefts, rights = [[] for _ in nodes], [[] for _ in nodes]
    now, width = nodes, 1
    for _ in range(levels):
        then = []
        for begin in range(0, len(now), fanout):
            run = now[begin : begin + fanout]
            then.append(_hash(*run))
            for k in range(len(run)):
                left, right = "".join(run[:k]), "".join(run[k + 1 :])
                first = (begin + k) * width
                for leaf in range(first, min(first + width, len(nodes))):
                    lefts[leaf].append(left)
                    rights[leaf].append(right)
        now, width = then, width * fanout
    return lefts, rights, now[0]


def _height(n: int, fanout: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def _block_roots(fanout: int, low: int):
    def fn(rows: pa.Table, edges: list[int]) -> pa.RecordBatch:
        tree, block, n, node = (rows.column(c).to_pylist() for c in ("tree", "block", "n", "node"))
        out = []
        for a, b in zip(edges, edges[1:]):
            now = node[a:b]
            for _ in range(min(low, _height(n[a], fanout))):
                now = [_hash(*now[i : i + fanout]) for i in range(0, len(now), fanout)]
            out.append((tree[a], block[a], n[a], now[0]))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["tree", "block", "n", "node"]
        )

    return by_runs(["tree", "block"], fn)


def _leaf_proofs(fanout: int, low: int):
    def fn(rows: pa.Table, edges: list[int]) -> pa.RecordBatch:
        n, node = rows.column("n").to_pylist(), rows.column("node").to_pylist()
        all_lefts, all_rights = [], []
        for a, b in zip(edges, edges[1:]):
            lefts, rights, _ = _grow(node[a:b], fanout, min(low, _height(n[a], fanout)))
            all_lefts += lefts
            all_rights += rights
        kept = rows.combine_chunks().to_batches()[0]
        strings = pa.list_(pa.string())
        return pa.RecordBatch.from_arrays(
            [*kept.columns, pa.array(all_lefts, strings), pa.array(all_rights, strings)], names=[*kept.schema.names, "low_lefts", "low_rights"]
        )

    return by_runs(["tree", "block"], fn)


def butterfly(blocks: DataFrame, own: Tables, fanout: int, width: int) -> DataFrame:
    """Upper proofs of all blocks: ``tree``, ``block``, ``root``, ``lefts``, ``rights``.

    ``blocks``: ``tree``, ``block`` (0, 1, ... in each tree), ``n`` (nodes of the tree, ``width`` of them a block) and
    ``node`` (the block's own root). Each round is one shuffle in which a group is at most ``fanout`` blocks. Where the last
    subtree of a tree is short, its blocks also stand in for the places that it lacks, shared out evenly among them.
    """
    empty = F.expr("CAST(array() AS array<string>)")
    now = own.store(blocks.select(
        "tree", "block", F.expr(f"(n + {width - 1}) DIV {width}").alias("blocks"), "node", empty.alias("lefts"), empty.alias("rights")
    ), "blocks")
    most = now.agg(F.coalesce(F.max("blocks"), F.lit(1))).first()[0]
    for r in range(_height(most, fanout)):
        span = fanout**r  # blocks under one node of this round
        going = F.col("blocks") > span
        place = F.expr(f"block % {span}L")
        # Blocks under this node: fewer than span only in the last subtree of a tree.
        under = F.least(F.lit(span), F.col("blocks") - (F.col("block") - place))
        sent = now.where(going).select(
            "tree", F.expr(f"block DIV {span * fanout}L").alias("above"), F.expr(f"block DIV {span}L % {fanout}").cast("int").alias("digit"),
            "node", F.explode(F.sequence(place, F.lit(span - 1), under)).alias("place"), place.alias("home"),
            F.struct("block", "blocks", "lefts", "rights").alias("member"),
        )
        met = sent.groupBy("tree", "above", "place").agg(
            F.sort_array(F.collect_list(F.struct("digit", "node"))).alias("swapped"),
            F.collect_list(F.when(F.col("place") == F.col("home"), F.struct("digit", "member"))).alias("members"),
        ).select("tree", "swapped", F.explode("members").alias("m"))
        nodes = F.col("swapped.node")
        digit = F.col("m.digit")
        left = F.array_join(F.slice(nodes, F.lit(1), digit), "")
        right = F.array_join(F.slice(nodes, digit + 2, F.lit(fanout)), "")
        parents = met.select(
            "tree", F.col("m.member.block").alias("block"), F.col("m.member.blocks").alias("blocks"),
            F.sha2(F.array_join(nodes, ""), 256).alias("node"),
            F.concat("m.member.lefts", F.array(left)).alias("lefts"), F.concat("m.member.rights", F.array(right)).alias("rights"),
        )
        then = own.store(parents.unionByName(now.where(~going)), "round")
        own.drop(now)
        now = then
    return now.select("tree", "block", F.col("node").alias("root"), "lefts", "rights")


def _dealt(nodes: DataFrame, fanout: int, low: int) -> DataFrame:
    """Nodes with their ``block``, each block in one task and in order."""
    return nodes.withColumn("block", F.expr(f"place DIV {fanout**low}L")).repartition("tree", "block").sortWithinPartitions("tree", "block", "place")


def upper_proofs(nodes: DataFrame, own: Tables, fanout: int, low: int) -> DataFrame:
    """:func:`butterfly` over the blocks of ``nodes``: ``tree``, ``place``, ``n`` (nodes of that tree), ``node``."""
    blocks = _dealt(nodes.select("tree", "place", "n", "node"), fanout, low).select("tree", "block", "n", "node").mapInArrow(
        _block_roots(fanout, low), "tree long, block long, n long, node string"
    )
    return own.store(butterfly(blocks, own, fanout, fanout**low), "upper")


def with_proofs(nodes: DataFrame, upper: DataFrame, fanout: int, low: int) -> DataFrame:
    """``nodes`` with the columns of ``upper``, where ``lefts`` and ``rights`` now begin at the node itself.

    They hold its siblings level by level; a level at which it has none has two empty texts, a tree of one node no level.
    """
    dealt = _dealt(nodes, fanout, low)
    schema = "{}, low_lefts array<string>, low_rights array<string>".format(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema))
    grown = dealt.mapInArrow(_leaf_proofs(fanout, low), schema)
    return grown.join(upper, ["tree", "block"]).withColumns({
        "lefts": F.concat("low_lefts", "lefts"), "rights": F.concat("low_rights", "rights")
    }).drop("low_lefts", "low_rights", "block")


@dataclass
class Manifest:
    """``leaves``: one row per row of the table with its proof; ``groups``: one row per group; both are lazy over stored tables."""

    leaves: DataFrame
    groups: DataFrame


def manifest(docs: DataFrame, own: Tables, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id",
             group: str = "source", extra: dict[str, Column] | None = None, fanout: int = FANOUT, low: int = LOW) -> Manifest:
    """Hash every row of ``docs`` into a tree per ``group``, and the groups' roots, null first, into one tree.

    ``leaves`` has ``doc_id`` (the key), ``leaf``, ``subroot``, ``root``, ``lefts`` and ``rights`` (digests of the siblings at
    each level from the leaf to the root, see :func:`folded`), and the columns of ``extra``, worked out from the row when it
    is read. ``groups`` has ``source`` (the group), ``n`` and ``subroot``.

    Leaves ascend by key, null first; rows of one key by their digest, so equal rows have places of their own in the tree.
    A null group is a group. A null field is hashed apart from every text. An empty table has no groups and no root.
    Other columns of ``docs`` are left alone, whatever their names. Texts are hashed where they are read and never shuffled.
    """
    extra = extra or {}
    read = docs.select(
        F.col(key).alias("doc_id"), F.col(group).alias("source"), leaf_digest([F.col(f) for f in fields]).alias("node"),
        *[c.alias(n) for n, c in extra.items()],
    )
    ranged = range_sorted(read, [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("node")])
    # Places without a task per group: rows per group and range, then sums over the ranges before.
    counts = own.store(ranged.groupBy("source", "_part").agg(F.count(F.lit(1)).alias("rows"), F.min("_pos").alias("first")), "counts")
    sums = counts.groupBy("source").agg(F.sum("rows").alias("n"))
    groups = range_sorted(sums, [F.col("source").asc_nulls_first()])
    before_part = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    ahead = groups.groupBy("_part").agg(F.count(F.lit(1)).alias("g")).select(
        F.col("_part").alias("_p"), F.coalesce(F.sum("g").over(before_part), F.lit(0)).alias("groups_before")
    )
    numbered = own.store(groups.join(F.broadcast(ahead), F.col("_part") == F.col("_p")).select(
        "source", "n", (F.col("groups_before") + F.col("_pos")).alias("tree")
    ), "groups")
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("ahead", F.coalesce(F.sum("rows").over(before), F.lit(0))).join(
        numbered.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))
    ).select(F.col("source").alias("_s"), F.col("_part").alias("_p"), (F.col("ahead") - F.col("first")).alias("shift"), "n", "tree")
    placed = ranged.join(offsets, (F.col("_part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s"))).select(
        "doc_id", "tree", (F.col("_pos") + F.col("shift")).alias("place"), "n", "node", *extra
    )
    placed = own.store(placed, "placed")
    upper = upper_proofs(placed, own, fanout, low)
    # The trees' roots are the nodes of one more tree; its proofs go to the blocks, not to the leaves.
    subroots = own.store(upper.where("block = 0").select("tree", F.col("root").alias("node")), "subroots")
    count = numbered.agg(F.count(F.lit(1)).alias("n"))
    tops = subroots.crossJoin(F.broadcast(count)).select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), "n", "node")
    top = with_proofs(tops, upper_proofs(tops, own, fanout, low), fanout, low).select(
        F.col("place").alias("tree"), F.col("root").alias("top"), F.col("lefts").alias("top_lefts"), F.col("rights").alias("top_rights")
    )
    whole = own.store(upper.join(top, "tree").select(
        "tree", "block", F.col("root").alias("subroot"), F.col("top").alias("root"),
        F.concat("lefts", "top_lefts").alias("lefts"), F.concat("rights", "top_rights").alias("rights"),
    ), "whole")
    leaves = with_proofs(placed, whole, fanout, low).select(
        "doc_id", F.col("node").alias("leaf"), "subroot", "root", "lefts", "rights", *extra
    )
    groups = numbered.join(subroots, "tree").select("source", "n", F.col("node").alias("subroot"))
    own.keep_only(placed, whole, numbered, subroots)
    return Manifest(leaves, groups)


def _sql(docs_levels: int = 12, group_levels: int = 5) -> str:
    """The query's SQL, level by level; trees of up to 3 ** 12 rows and 3 ** 5 groups."""
    crc = (
        "list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), "
        "lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), "
        "lambda c, v: xor(xor(c, v) >> 1, CASE WHEN xor(c, v) & 1 = 1 THEN 3988292384 ELSE 0 END))"
    )

    def digest(text: str) -> str:
        fields = ", ".join(
            f"CASE WHEN {f} IS NULL THEN '-' ELSE strlen({v}::VARCHAR) || ':' || {v}::VARCHAR END"
            for f, v in (("doc_id", "doc_id"), ("source", "source"), ("lang", "lang"), ("n_chars", "n_chars"), ("text", text))
        )
        return f"sha256(concat({fields}))"

    def tree(name: str, levels: int) -> list[str]:
        out = []
        for i in range(levels):
            now, above = f"{name}{i}", f"{name}{i + 1}"
            run = "PARTITION BY tree, place // 3 ORDER BY place ROWS BETWEEN"
            out.append(f"""{now}s AS (
    SELECT *, CASE WHEN n > 1 THEN coalesce(string_agg(node, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS l,
           CASE WHEN n > 1 THEN coalesce(string_agg(node, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS r FROM {now}
), {above} AS (
    SELECT tree, place // 3 AS place, (n + 2) // 3 AS n,
           CASE WHEN n > 1 THEN sha256(string_agg(node, '' ORDER BY place)) ELSE min(node) END AS node
    FROM {now} GROUP BY tree, place // 3, n
)""")
        return out

    def climb(name: str, levels: int, source: str, out: str) -> str:
        """From each row of ``source``, level by level: its siblings' text and the node folded from ``fold``."""
        steps, now = [], source
        for i in range(levels):
            then = out if i == levels - 1 else f"{out}_{i}"
            steps.append(f"""{then} AS (
    SELECT a.* EXCLUDE (pos, proof, fold), a.pos // 3 AS pos, a.proof || coalesce(s.l || s.r, '') AS proof,
           CASE WHEN s.l IS NULL THEN a.fold ELSE sha256(s.l || a.fold || s.r) END AS fold
    FROM {now} a JOIN {name}{i}s s ON s.tree = a.tree AND s.place = a.pos
)""")
            now = then
        return ", ".join(steps)

    return f"""
WITH leaves AS (
    SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, {digest("text")} AS leaf,
           CASE WHEN doc_id IS NOT NULL AND xor({crc}, 4294967295) % 2 = 0 THEN {digest("replace(text, chr(10), '')")} ELSE {digest("text")} END AS given
    FROM documents
), d AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM leaves
), d0 AS (SELECT tree, place, n, leaf AS node FROM d), {", ".join(tree("d", docs_levels))},
g0 AS (SELECT 0 AS tree, tree AS place, count(*) OVER () AS n, node FROM d{docs_levels}), {", ".join(tree("g", group_levels))},
begin AS (SELECT doc_id, tree, leaf, place AS pos, '' AS proof, given AS fold FROM d),
{climb("d", docs_levels, "begin", "inside")},
between_trees AS (SELECT * EXCLUDE (tree, pos), 0 AS tree, tree AS pos, tree AS own_tree FROM inside),
{climb("g", group_levels, "between_trees", "done")}
SELECT doc_id, leaf, s.node AS subroot, t.node AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = t.node AS verified
FROM done JOIN d{docs_levels} s ON s.tree = done.own_tree JOIN g{group_levels} t ON true
"""


ORACLE_SQL = _sql()
