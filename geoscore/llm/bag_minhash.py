"""Near-duplicate documents by BagMinHash signatures over multisets of word shingles.

A shingle that occurs w times has weight w. The weight axis is cut at 1, 2, 4, 8, ...; every shingle has an independent
Poisson process of points (time, weight) on each of these intervals, made from the shingle's hash alone and in ascending
time. A point counts if it lies below the shingle's weight, and falls on one of the signature's components; each
component keeps its earliest point. Two documents keep the same point with a probability equal to their weighted Jaccard
similarity. Points are only made up to a time by which every component is likely filled; the few documents where one is
not go on to twice that time.

Equal word sequences are one class. Documents that agree in a band of components meet in a bucket. First every member
is compared with the bucket's leader; then, only in buckets whose members are not yet one group, the members of
different groups are compared with each other, block against block inside a task, so pairs are never rows. Blocks belong
to the largest group that is met and not to a bucket, so two that meet in many bands are compared once. All links are
exact overlaps of the multisets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geoscore.llm.common import grouped_by_size, tables as scratch
from geoscore.llm.components import components

SHINGLE = 5
BANDS, ROWS = 24, 5
SIZE = BANDS * ROWS
BLOCK = 128  # documents
SEED = 7_919
U = np.uint64
GOLDEN = 0x9E3779B97F4A7C15
_GOLD, _M1, _M2 = U(GOLDEN), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def _salt(k: int) -> np.uint64:
    return U(k * GOLDEN % (1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


@lru_cache(1)
def _constants() -> tuple[np.ndarray, np.ndarray, int]:
    random = np.random.default_rng(SEED)
    draw = lambda n: random.integers(0, 1 << 63, n, dtype=np.uint64) * U(2) + U(1)
    return draw(256), draw(SHINGLE + 2), int(draw(1)[0])


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = _constants()[2]
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document numbers and hashes of all shingles in order; per document its number of words and a hash of them all."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    letters, factors, _ = _constants()
    size = 1 << 21
    while size < len(joined):
        size *= 2
    up, down = _powers(size)
    inside = (joined != 0x20) & ((joined < 0x09) | (joined > 0x0D))
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
    starts, stops = edges[::2], edges[1::2]
    total = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum(letters[joined] * up[: len(joined)], out=total[1:])
    words = _mix((total[stops] - total[starts]) * down[starts])
    borders = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    doc = np.searchsorted(borders, starts, side="right")
    n_words = np.bincount(doc, minlength=len(texts))
    begin = np.cumsum(n_words) - n_words
    place = (np.arange(len(words)) - begin[doc]).astype(np.uint64)
    whole = np.zeros(len(texts), np.uint64)
    np.add.at(whole, doc, _mix(words + place * _GOLD + factors[SHINGLE]))
    padded = np.concatenate([words, np.zeros(SHINGLE - 1, np.uint64)])
    grams = np.zeros(len(words), np.uint64)
    for k in range(SHINGLE):
        same = place + U(k) < n_words[doc].astype(np.uint64)
        grams += np.where(same, padded[k : k + len(words)], U(0)) * factors[k]
    # The first shingle of a text stays even where the text is shorter than a shingle.
    keep = (place.astype(np.int64) + SHINGLE <= n_words[doc]) | (place == 0)
    return doc[keep], _mix(grams[keep]), n_words, _mix(whole + n_words.astype(np.uint64))


def _bags(doc: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document with their weights."""
    tag = grams ^ _mix(doc.astype(np.uint64) + _GOLD)
    order = np.argsort(tag)
    tag = tag[order]
    first = np.flatnonzero(np.append(True, tag[1:] != tag[:-1])) if len(tag) else np.zeros(0, np.int64)
    return doc[order[first]], grams[order[first]], np.diff(np.append(first, len(tag)))


def _signatures(doc: np.ndarray, grams: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n * SIZE, np.inf)
    heavy = weights.max(initial=0)
    parts = []
    strip, low, width = 0, 0, 1
    while low < heavy:
        chosen = np.flatnonzero(weights > low)
        parts.append((doc[chosen], _mix(grams[chosen] + _salt(strip + 1)), weights[chosen], low, width))
        low, width, strip = low + width, max(1, low + width), strip + 1
    totals = np.bincount(doc, weights, n)
    horizon = SIZE * (np.log(SIZE) + 4) / np.maximum(totals, 1)
    todo = totals > 0
    while todo.any():
        for of, key, weight, low, width in parts:
            mine = np.flatnonzero(todo[of])
            of, key, weight = of[mine], key[mine], weight[mine]
            until, time = horizon[of], np.zeros(len(of))
            k = 0
            while len(of):
                k += 1
                bits = _mix(key + _salt(2 * k))
                time = time - np.log(((bits >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
                soon = np.flatnonzero(time <= until)
                if len(soon) < len(of):
                    of, key, weight, until, time = of[soon], key[soon], weight[soon], until[soon], time[soon]
                if not len(of):
                    break
                more = _mix(key + _salt(2 * k + 1))
                at = of * SIZE + (more % U(SIZE)).astype(np.int64)
                if width > 1:
                    # The point's height above the interval's foot, from bits that the component does not use much.
                    counts = low + ((more >> U(11)).astype(np.float64) * 2.0**-53) * width < weight
                    np.minimum.at(out, at[counts], time[counts])
                else:
                    np.minimum.at(out, at, time)
        grid = out.reshape(n, SIZE)
        todo = todo & np.isinf(grid).any(axis=1)
        horizon = np.where(todo, horizon * 2, horizon)
        out = out.copy()
        out.reshape(n, SIZE)[todo] = np.inf
    return out.reshape(n, SIZE)


def _bands(signatures: np.ndarray) -> np.ndarray:
    bits = signatures.view(np.uint64).reshape(len(signatures), BANDS, ROWS)
    out = np.zeros(bits.shape[:2], np.uint64)
    for k in range(ROWS):
        out = _mix(out + bits[:, :, k] + _GOLD)
    return out.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [x or b"" for x in batch.column(1).to_pylist()]
        for a, b in grouped_by_size(texts, 1 << 20):
            doc, grams, n_words, whole = _shingles(texts[a:b])
            bands = _bands(_signatures(*_bags(doc, grams), b - a))
            lists = pa.ListArray.from_arrays(np.arange(0, bands.size + 1, BANDS, dtype=np.int32), bands.reshape(-1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[a:b], pa.array(n_words.astype(np.int64)), pa.array(whole.view(np.int64)), lists],
                names=["doc", "words", "whole", "bands"],
            )


def _with_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [x or b"" for x in batch.column(1).to_pylist()]
        for a, b in grouped_by_size(texts, 1 << 20):
            _, _, n_words, whole = _shingles(texts[a:b])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[a:b], pa.array(n_words.astype(np.int64)), pa.array(whole.view(np.int64)), batch.column(1)[a:b]],
                names=["doc", "words", "whole", "text"],
            )


def overlap(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sorted multisets."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both, len(a) + len(b) - both


def _items(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The multisets as sets: the first, second, ... occurrence of a shingle are items of their own. With list offsets."""
    parts, sizes = [], []
    for a, b in grouped_by_size(texts, 1 << 20):
        doc, grams, _, _ = _shingles(texts[a:b])
        order = np.lexsort((grams, doc))
        doc, grams = doc[order], grams[order]
        new = np.append(True, (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, bool)
        first = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
        parts.append(_mix(grams + (np.arange(len(doc)) - first).astype(np.uint64) * _GOLD))
        sizes.append(np.bincount(doc, minlength=b - a))
    return np.concatenate(parts), np.append(0, np.cumsum(np.concatenate(sizes)))


def _overlaps(items: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sizes of all intersections among a few sets, as a product of their incidence matrix with itself."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    _, column, often = np.unique(items, return_inverse=True, return_counts=True)
    shared = often[column] > 1
    row, column = row[shared], (np.cumsum(often > 1) - 1)[column[shared]]
    out = np.zeros((len(sizes), len(sizes)), np.float32)
    columns = int(column.max(initial=-1)) + 1
    for low in range(0, columns, 1 << 14):
        now = (column >= low) & (column < low + (1 << 14))
        matrix = np.zeros((len(sizes), min(columns - low, 1 << 14)), np.float32)
        matrix[row[now], column[now] - low] = 1
        out += matrix @ matrix.T
    return out


def _linked(least: float, items: np.ndarray, offsets: np.ndarray, side: np.ndarray, group: np.ndarray, within: bool):
    """Rows (a, b) that link: of different groups and, unless ``within``, of different sides."""
    sizes = np.diff(offsets)
    if len(sizes) == 2:
        small, large = sorted((int(sizes[0]), int(sizes[1])))
        if group[0] == group[1] or small < least * large or not (within or side[0] != side[1]):
            return np.zeros(0, int), np.zeros(0, int)
        cut = offsets[1] - offsets[0]
        both = len(np.intersect1d(items[:cut], items[cut:], assume_unique=True))
        hit = both >= least * (small + large - both)
        return np.zeros(int(hit), int), np.ones(int(hit), int)
    both = _overlaps(items, sizes)
    linked = both >= least * (sizes[:, None] + sizes[None, :] - both)
    linked &= group[:, None] != group[None, :]
    if not within:
        linked &= side[:, None] != side[None, :]
    return np.nonzero(np.triu(linked, 1))


def _compare(least: float):
    """Over rows sorted by ``k``: the links inside each run of one ``k``, as (document, least document it links to)."""

    def finish(rows: pa.Table) -> pa.RecordBatch | None:
        k, within, side, rep, group = (rows.column(c).to_numpy() for c in ("k", "within", "side", "rep", "g"))
        items, offsets = _items(rows.column("text").to_pylist())
        edges = np.flatnonzero(np.append(True, k[1:] != k[:-1])).tolist() + [len(k)]
        found_a, found_b = [], []
        for a, b in zip(edges, edges[1:]):
            if b - a < 2:
                continue
            x, y = _linked(least, items[offsets[a] : offsets[b]], offsets[a : b + 1], side[a:b], group[a:b], bool(within[a]))
            if len(x):
                # One link from each document to the least that it links to, and between those that are left.
                low, high = np.minimum(rep[a + x], rep[a + y]), np.maximum(rep[a + x], rep[a + y])
                for first, second in _spanning(low, high):
                    found_a.append(second)
                    found_b.append(first)
        if not found_a:
            return None
        return pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            k = table.column("k").to_numpy()
            other = np.flatnonzero(k != k[-1])
            begin = int(other[-1]) + 1 if len(other) else 0
            held = table.slice(begin)
            out = finish(table.slice(0, begin)) if begin else None
            if out is not None:
                yield out
        if held is not None and held.num_rows:
            out = finish(held)
            if out is not None:
                yield out

    return run


def _spanning(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that join the same documents as all links given, one fewer than there are documents in each group."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(low.tolist(), high.tolist()):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            yield a, b


def near_duplicates(docs: DataFrame, least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``class_id`` (the smallest id of its group), ``n_words``, ``kept``.

    Two documents link if the weighted Jaccard similarity of their multisets of five-word shingles is at least
    ``least``; groups are what links connect. A text of one to four words is one shingle; a text without words (null,
    empty, white space) links with nothing. A null key links with nothing, has a null class and is kept. Rows repeated
    with one key are one document if their words are equal, else documents of one group. A pair at the very threshold is
    missed with a chance of about seven in a hundred thousand, closer pairs less often.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.encode(F.col(text), "UTF-8").alias("text"))
    with scratch(docs.sparkSession) as own:
        signed = own.store(rows.mapInArrow(_sign, "doc long, words long, whole long, bands array<long>"), "signed")
        usable = signed.where("doc IS NOT NULL AND words > 0")
        classes = own.store(
            usable.groupBy("whole", "words").agg(F.min("doc").alias("rep"), F.any_value("bands").alias("bands"))
            .withColumn("cid", F.monotonically_increasing_id()), "classes"
        )
        members = classes.select("cid", "rep", F.posexplode("bands").alias("band", "bucket"))
        shared = members.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("leader")).where("n > 1")
        crowd = own.store(members.join(shared.drop("n"), ["band", "bucket"]), "crowd")

        wanted = classes.join(crowd.select("cid").distinct(), "cid").select("cid", "rep", "whole", "words")
        found = rows.join(wanted.select(F.col("rep").alias("doc")).distinct(), "doc", "left_semi").mapInArrow(
            _with_hash, "doc long, words long, whole long, text binary"
        )
        texts = own.store(
            found.join(wanted.withColumnRenamed("rep", "doc"), ["doc", "whole", "words"])
            .groupBy("cid").agg(F.any_value("doc").alias("rep"), F.any_value("text").alias("text")), "texts",
        )

        def compared(members: DataFrame, label: str) -> DataFrame:
            """Links inside the runs of ``k``; ``members``: k, within, side, cid, g."""
            full = members.join(texts, "cid").select("k", "within", "side", "rep", "g", "text")
            return own.store(
                full.repartition("k").sortWithinPartitions("k").mapInArrow(_compare(least), "a long, b long").distinct(), label
            )

        # Every member against the leaders of its buckets; a leader of many has a copy in each block of them.
        pairs = crowd.where("cid <> leader").select("leader", "cid").distinct()
        led = pairs.join(
            pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).withColumnRenamed("leader", "_l"),
            F.col("leader") == F.col("_l"),
        ).withColumn("k", F.xxhash64("leader", F.pmod(F.xxhash64("cid"), F.col("blocks"))))
        star = led.select("k", "cid", F.lit(1).alias("side")).unionByName(
            led.select("k", F.col("leader").alias("cid"), F.lit(0).alias("side")).distinct()
        )
        links = compared(star.select("k", F.lit(False).alias("within"), "side", "cid", F.col("cid").alias("g")), "links")
        groups = components(links, own)
        placed = own.store(
            crowd.join(groups.withColumnRenamed("node", "rep"), "rep", "left")
            .select("band", "bucket", "cid", F.coalesce("component", "rep").alias("g")), "placed"
        )
        # In buckets of several groups, the largest group (over all buckets) is the host. A host's guests and its own
        # members are cut into blocks: large groups have blocks of their own, small ones share the host's others.
        place = ["band", "bucket"]
        of_group = placed.groupBy(*place, "g").agg(F.count(F.lit(1)).alias("here"))
        total = placed.select("g", "cid").distinct().groupBy("g").agg(F.count(F.lit(1)).alias("n"))
        sized = own.store(of_group.join(total, "g"), "sized")
        hosts = sized.groupBy(*place).agg(
            F.max_by("g", F.struct("n", "g")).alias("host"), F.count(F.lit(1)).alias("groups")
        ).where("groups > 1").drop("groups")
        guests = own.store(sized.join(hosts, place).select(*place, "g", "n", "host"), "guests")
        shared = guests.where(F.col("n") < BLOCK).select("host", "g", "n").distinct().groupBy("host").agg(
            F.ceil(F.sum("n") / BLOCK).alias("shared")
        )
        kinds = guests.join(shared, "host", "left").select(*place, "g", "n", "host", F.coalesce("shared", F.lit(1)).alias("shared"))
        large = F.col("n") >= BLOCK
        blocked = own.store(
            placed.join(kinds, [*place, "g"]).select(
                *place, "cid", "g", "host", F.when(large, F.xxhash64("g", F.pmod(F.xxhash64("cid"), F.ceil(F.col("n") / BLOCK))))
                .otherwise(F.pmod(F.xxhash64("g"), F.col("shared"))).alias("block"), F.when(large, F.col("g")).alias("owner"),
            ), "blocked",
        )
        # Which blocks meet in any bucket, but for two of one group; then each member goes once to each meeting of its block.
        there = own.store(blocked.select(*place, "host", "block", "owner").distinct(), "blocks")
        other = there.select(*place, F.col("block").alias("second"), F.col("owner").alias("of"))
        met = there.withColumnRenamed("block", "first").join(other, place).where(
            (F.col("first") <= F.col("second")) & ~F.coalesce(F.col("owner") == F.col("of"), F.lit(False))
        ).select("host", "first", "second").distinct()
        meetings = own.store(met.withColumn("k", F.xxhash64("host", "first", "second")), "meetings")
        within = (F.col("first") == F.col("second")).alias("within")
        sides = meetings.select("host", F.col("first").alias("block"), "k", within, F.lit(0).alias("side")).unionByName(
            meetings.where("first <> second").select("host", F.col("second").alias("block"), "k", within, F.lit(1).alias("side"))
        )
        meeting = blocked.select("host", "block", "cid", "g").distinct().join(sides, ["host", "block"]).select("k", "within", "side", "cid", "g")
        all_links = links.unionAll(compared(meeting, "more-links"))
        found = components(all_links, own)
        of_class = own.store(
            classes.select("whole", "words", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
            .select("whole", "words", F.coalesce("component", "rep").alias("class_id")), "class-ids"
        )
        own.keep_only(signed, of_class)
    out = signed.select("doc", "words", "whole").join(
        of_class.withColumnsRenamed({"whole": "_h", "words": "_w"}),
        F.col("doc").isNotNull() & (F.col("words") > 0) & (F.col("whole") == F.col("_h")) & (F.col("words") == F.col("_w")), "left"
    )
    class_id = F.coalesce("class_id", "doc")
    return out.select(
        F.col("doc").alias("doc_id"), class_id.alias("class_id"), F.col("words").alias("n_words"),
        F.coalesce(F.col("doc") == class_id, F.lit(True)).alias("kept"),
    )
