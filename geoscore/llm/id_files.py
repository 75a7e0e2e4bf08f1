"""Token ids in files of coded blocks, written in the order of documents and read back block by block.

Documents are sorted by id over the cluster; each range of them becomes one file part. A part's ids run on without gaps
between documents and are cut into blocks of a fixed number of ids. A block's row holds its place in the part, its payload, the
CRC-32 of its ids, and which documents (number in the part, id, ids in this block) it holds. Every block is decoded by
itself, so any task can read any block, and a damaged block is found by its checksum and concerns no other.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from geoscore.llm.bpe import _byte_letters
from geoscore.llm.common import grouped_by_size
from geoscore.llm.id_coder import checksum, decode_blocks, encode_blocks, joined_crc
from geoscore.llm.pretokens import WHITE, pretokens

BLOCK = 4096  # ids
LANES = 2048  # blocks that are coded side by side
SPACES = frozenset(WHITE)
KEPT, KEPT_BYTES, LONGEST = 500_000, 1 << 26, 100  # chunks remembered by a task before half of them go, bytes of all and of one
FORMAT = (
    "part int, block int, first long, n_ids int, vocabulary int, crc32 long, doc_numbers array<long>, doc_ids array<long>, "
    "doc_sizes array<int>, payload binary"
)


class _Chunks:
    """The ids of chunks of text met so far, as columns: chunks, where their ids lie in ``tokens``, and how often they
    were met. When there are too many, those met most often stay."""

    def __init__(self, encode: Callable[[list[str]], tuple[list[int], list[int]]]):
        self.encode = encode
        self.keep(pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def keep(self, chunks: pa.Array, starts: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, met: np.ndarray) -> None:
        self.chunks, self.starts, self.sizes, self.tokens, self.met = chunks, starts, sizes, tokens, met

    def find(self, chunks: pa.Array) -> np.ndarray:
        """The places of chunks; new ones are encoded, each distinct one once."""
        at = pc.index_in(chunks, value_set=self.chunks).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            coded = chunks.take(pa.array(new)).dictionary_encode()
            fresh = coded.dictionary
            at[new] = len(self.chunks) + coded.indices.to_numpy()
            joined = pa.LargeListArray.from_arrays([0, len(fresh)], fresh)
            ids, lengths = self.encode(pc.binary_join(joined, pa.scalar(" ", pa.large_string()))[0].as_py().split(" "))
            sizes = np.array(lengths, np.int64)
            self.keep(
                pa.concat_arrays([self.chunks, fresh]), np.append(self.starts, len(self.tokens) + np.cumsum(sizes) - sizes),
                np.append(self.sizes, sizes), np.append(self.tokens, np.array(ids, np.uint32)), np.append(self.met, np.zeros(len(fresh), np.int64)),
            )
        self.met += np.bincount(at, minlength=len(self.met))
        return at

    def trim(self) -> None:
        if len(self.chunks) > KEPT or self.chunks.nbytes > KEPT_BYTES:
            short = np.flatnonzero(pc.binary_length(self.chunks).to_numpy() <= LONGEST)
            stay = np.sort(short[np.argsort(-self.met[short], kind="stable")[: KEPT // 2]])
            sizes = self.sizes[stay]
            ends = np.cumsum(sizes)
            tokens = self.tokens[np.repeat(self.starts[stay] - ends + sizes, sizes) + np.arange(sizes.sum())]
            self.keep(self.chunks.take(pa.array(stay)), ends - sizes, sizes, tokens, self.met[stay] // 2)


@lru_cache(2)
def _library(path: str):
    """The tokenizer, and the chunks it has encoded."""
    from tokenizers import Tokenizer

    book = Tokenizer.from_file(path)
    letters, model = _byte_letters(), book.model
    bytes_first = "ByteLevel" in json.dumps(json.loads(book.to_str())["pre_tokenizer"])

    def ids_of(word: str) -> list[int]:
        if not bytes_first:
            return book.encode(word, add_special_tokens=False).ids
        # A pretoken is normal and whole, so of the library's steps only the bytes' letters and the merges are left.
        return [t.id for t in model.tokenize(word if word.isalpha() and word.isascii() else word.encode().decode("latin-1").translate(letters))]

    def encode(chunks: list[str]) -> tuple[list[int], list[int]]:
        """All ids of distinct chunks, and how many each has. Pretokens are found in all mixed ones at once."""
        found = [ids_of(chunk) if chunk.isalpha() else None for chunk in chunks]
        mixed = [i for i, ids in enumerate(found) if ids is None]
        if mixed:
            words, begins = pretokens([chunks[i] for i in mixed], spaced=False)
            known = {w: [] if ord(w[0]) in SPACES else ids_of(w) for w in set(words)}
            begins = begins.tolist()
            for i, a, b in zip(mixed, begins, begins[1:]):
                found[i] = list(chain.from_iterable(map(known.__getitem__, words[a : b - 1])))
        return list(chain.from_iterable(found)), list(map(len, found))

    return book, _Chunks(encode)


def _split(pieces: list[str]) -> tuple[pa.Array, np.ndarray]:
    """All chunks of the pieces, and where the chunks of each piece begin (and the end).

    Chunks end at white space of ASCII and where a letter a-z is followed by another character of ASCII, which always is
    the end of a pretoken.
    """
    text = np.frombuffer("".join(pieces).encode(), np.uint8)
    ends = np.cumsum([len(p) if p.isascii() else len(p.encode()) for p in pieces], dtype=np.int64)
    letter, other = (text >= 97) & (text <= 122), (text > 32) & (text < 128)
    other &= ~letter
    cuts = np.flatnonzero(letter[:-1] & other[1:]) + 1
    text = np.insert(text, cuts, 32)
    # A cut between two pieces adds a space to the first one's end.
    offsets = np.append(0, ends + np.searchsorted(cuts, ends, side="right"))
    held = pa.LargeStringArray.from_buffers(len(pieces), pa.py_buffer(offsets), pa.py_buffer(text))
    split = pc.ascii_split_whitespace(held)
    return split.flatten(), split.offsets.to_numpy()


def encode_words(texts: list[str], path: str) -> list[np.ndarray]:
    """The ids that the tokenizer file's library gives for each whole text, without added special tokens.

    For lower-casing tokenizers that drop white space: texts are cut into chunks, and the library encodes new ones only.
    """
    book, known = _library(path)
    special = {t.content: i for i, t in book.get_added_tokens_decoder().items()}
    cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
    pieces: list[str] = []
    plans: list[list[int | np.ndarray]] = []
    for text in texts:
        plan: list[int | np.ndarray] = []
        for k, part in enumerate(cut.split(text) if any(map(text.__contains__, special)) else [text]):
            if k % 2:
                plan.append(np.array([special[part]], "<u4"))
            else:
                plan.append(len(pieces))
                plain = part if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ")
                pieces.append(plain.lower())
        plans.append(plan)
    chunks, begins = _split(pieces)
    at = known.find(chunks)
    taken = known.sizes[at]
    ends = np.append(0, np.cumsum(taken))
    shift = known.starts[at] - ends[:-1]
    ids = known.tokens[np.repeat(shift, taken) + np.arange(ends[-1])]
    known.trim()
    bounds = ends[begins].tolist()
    out = [[ids[bounds[x] : bounds[x + 1]] if isinstance(x, int) else x for x in plan] for plan in plans]
    return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]


class _Part:
    """Collects the ids of documents in order and gives out rows of coded blocks."""

    def __init__(self, part: int, vocabulary: int, size: int):
        self.part, self.vocabulary, self.size = part, vocabulary, size
        self.ids: list[np.ndarray] = []
        self.held, self.docs, self.first, self.block = 0, 0, 0, 0
        self.pieces: list[tuple[int, int | None, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.pieces.append((self.docs, doc_id, len(ids)))
        self.held += len(ids)
        self.docs += 1

    def rows(self, all_: bool) -> pa.RecordBatch | None:
        stream = np.concatenate(self.ids) if self.ids else np.zeros(0, np.uint32)
        n = len(stream) if all_ else len(stream) // self.size * self.size
        blocks = [stream[i : min(i + self.size, n)] for i in range(0, n, self.size)]
        out: dict[str, list] = {k.split()[0]: [] for k in FORMAT.split(", ")}
        payloads = encode_blocks(blocks, self.vocabulary) if blocks else []
        pieces, k, used = self.pieces, 0, 0
        for ids, payload in zip(blocks, payloads):
            mine, left = [], len(ids)
            while left:
                number, doc_id, size = pieces[k]
                take = min(left, size - used)
                mine.append((number, doc_id, take))
                left, used = left - take, used + take
                if used == size:
                    k, used = k + 1, 0
            row = (
                self.part, self.block, self.first, len(ids), self.vocabulary, checksum(ids), [m[0] for m in mine],
                [m[1] for m in mine], [m[2] for m in mine], payload,
            )
            for column, value in zip(out.values(), row):
                column.append(value)
            self.block, self.first = self.block + 1, self.first + len(ids)
        rest = pieces[k:]
        if rest and used:
            rest = [(rest[0][0], rest[0][1], rest[0][2] - used), *rest[1:]]
        self.pieces, self.ids, self.held = rest, [stream[n:]], len(stream) - n
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()),
                 pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out)) if blocks else None


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, vocabulary: int, key: str = "doc_id", text: str = "text",
          block: int = BLOCK) -> None:
    """Encode every whole text, append ``end_id``, and write the ids to ``path`` in ascending order of ``key``.

    A null text counts as empty and gives the end id alone. Null keys come first; rows repeated with one key are written
    one after the other, in the order of their text's hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = _Part(TaskContext.get().partitionId(), vocabulary, block)
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            for a, b in grouped_by_size(texts, 1 << 23):
                for name, ids in zip(names[a:b], encode_words(texts[a:b], tokenizer)):
                    part.add(name, np.append(ids, np.uint32(end_id)))
                if part.held >= block * LANES:
                    yield part.rows(False)
        out = part.rows(True)
        if out is not None:
            yield out

    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    ordered = source.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    ordered.mapInArrow(run, FORMAT).write.parquet(path)


def decoded(blocks: DataFrame) -> DataFrame:
    """The pieces of documents in each block with their ids: ``part``, ``doc_number``, ``doc_id``, ``at``, ``ids``.

    Raises if a block does not give the ids that were written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, LANES):
                rows = batch.slice(i, LANES).to_pylist()
                streams = decode_blocks([r["payload"] for r in rows], [r["n_ids"] for r in rows], rows[0]["vocabulary"])
                out: dict[str, list] = {k: [] for k in ("part", "doc_number", "doc_id", "at", "ids")}
                for r, ids in zip(rows, streams):
                    packed, at = ids.astype("<u4").tobytes(), 0
                    if zlib.crc32(packed) != r["crc32"]:
                        raise ValueError(f"part {r['part']}, block {r['block']}: wrong checksum")
                    for number, doc_id, n in zip(r["doc_numbers"], r["doc_ids"], r["doc_sizes"]):
                        values = (r["part"], number, doc_id, r["first"] + at, packed[4 * at : 4 * (at + n)])
                        for column, value in zip(out.values(), values):
                            column.append(value)
                        at += n
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    return blocks.mapInArrow(run, "part int, doc_number long, doc_id long, at long, ids binary")


def _join_pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        crc = []
        for pieces in frame["pieces"]:
            whole = pieces[0]["crc"]
            for p in pieces[1:]:
                whole = joined_crc(whole, p["crc"], 4 * p["n"])
            crc.append(whole)
        yield frame.drop(columns="pieces").assign(crc=crc)


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """Read the files back: per document its place in the stream of all ids, its number of ids and their CRC-32."""
    blocks = spark.read.schema(FORMAT).parquet(path)
    # One row per part.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")
    )
    pieces = decoded(blocks).select(
        "part", "doc_number", "doc_id", "at", (F.octet_length("ids") / 4).cast("long").alias("n"), F.crc32("ids").alias("crc")
    )
    # A document is cut only where blocks end, so its list of pieces is as short as its number of blocks.
    docs = pieces.groupBy("part", "doc_number", "doc_id").agg(
        F.min("at").alias("at"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("at", "n", "crc"))).alias("pieces")
    ).mapInPandas(
        _join_pieces, "part int, doc_number long, doc_id long, at long, n_tokens long, crc long"
    )
    return docs.join(offsets, F.col("part") == F.col("_part")).select(
        "doc_id", (F.col("ahead") + F.col("at")).alias("start"), "n_tokens", F.col("crc").alias("ids_crc32")
    )
