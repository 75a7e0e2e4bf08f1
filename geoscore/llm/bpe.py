"""BPE encoding and decoding: merges over a contiguous array of ranks, and text back from the ids.

A word's parts and the ranks of its adjacent pairs lie in two short arrays. The least rank is found by a scan, the
boundary between its two parts goes, and only the two neighbouring ranks are looked up anew. That is quadratic in the
word's length, so words of over ``SHORT`` bytes use a heap over linked parts with the same order of merges.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from geoscore.llm.common import by_batch, grouped_by_size
from geoscore.llm.pretokens import pretokens, sections

SHORT = 96  # bytes
NONE = 1 << 60
KEPT_WORDS = 500_000  # words remembered by a task; more are worked out again


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE vocabulary read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        ids = held["model"]["vocab"]
        letters = _byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.base = max([*ids.values(), *self.special.values()]) + 1
        self.of_byte = [ids[c] for c in letters]
        self.text_of = [b""] * self.base
        for token, i in ids.items():
            self.text_of[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.text_of[i] = token.encode()
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(held["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[ids[a] * self.base + ids[b]] = rank
            self.made.append(ids[a + b])
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def pieces(self, text: str) -> list[str]:
        """Ordinary text at even places, special strings at odd ones."""
        return self.specials.split(text) if self.special else [text]

    def encode_word(self, word: str) -> list[int]:
        parts = [self.of_byte[b] for b in word.encode()]
        return self._scan(parts) if len(parts) <= SHORT else self._heap(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        look, base = self.ranks.get, self.base
        ranks = [look(a * base + b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            parts[i] = self.made[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = look(parts[i - 1] * base + parts[i], NONE)
            if i < len(ranks):
                ranks[i] = look(parts[i] * base + parts[i + 1], NONE)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        look, base, n = self.ranks.get, self.base, len(parts)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        waiting = [(look(parts[i] * base + parts[i + 1], NONE), i) for i in range(n - 1)]
        waiting = [x for x in waiting if x[0] != NONE]
        heapq.heapify(waiting)
        while waiting:
            rank, i = heapq.heappop(waiting)
            j = after[i] if parts[i] is not None else n
            if j >= n or look(parts[i] * base + parts[j], NONE) != rank:
                continue
            parts[i], parts[j] = self.made[rank], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (new := look(parts[a] * base + parts[b], NONE)) != NONE:
                    heapq.heappush(waiting, (new, a))
        return [p for p in parts if p is not None]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.text_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Words(dict):
    """Remembers the outcome of ``work`` for words; ``trim`` forgets all when there are too many."""

    def __init__(self, work):
        super().__init__()
        self.work = work

    def __missing__(self, word):
        found = self[word] = self.work(word)
        return found

    def trim(self) -> None:
        if len(self) > KEPT_WORDS:
            self.clear()


@lru_cache(4)
def _packed_words(path: str) -> Words:
    book = vocabulary(path)
    return Words(lambda word: np.array(book.encode_word(word), "<u4").tobytes())


def split_all(texts: list[str], book: Vocabulary) -> tuple[list[str], list[tuple[int, int | None]]]:
    """Ordinary pieces of all texts, each with its text's number; a special id has an empty piece of its own."""
    pieces, owners = [], []
    for n, text in enumerate(texts):
        for k, part in enumerate(book.pieces(text)):
            if k % 2:
                pieces.append("")
                owners.append((n, book.special[part]))
            elif part:
                for section in sections(part):
                    pieces.append(section)
                    owners.append((n, None))
    return pieces, owners


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers."""
    book, known = vocabulary(path), _packed_words(path)
    pieces, owners = split_all(texts, book)
    out: list[list[bytes]] = [[] for _ in texts]
    if pieces:
        words, begins = pretokens(pieces, spaced=True)
        packed = list(map(known.__getitem__, words))
        places = begins.tolist()
        for (n, special), a, b in zip(owners, places, places[1:]):
            if special is None:
                out[n] += packed[a : b - 1]
            else:
                out[n].append(int(special).to_bytes(4, "little"))
        known.trim()
    return [b"".join(x) for x in out]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds the ids of every whole text as a binary column of little-endian unsigned 32-bit integers.

    A null text counts as empty and has no ids. All other columns stay; a column named as an output is replaced.
    With ``decoded``, the text decoded from those ids is added too.
    """
    names = [c for c in docs.columns if c not in (ids, decoded)]
    source = docs.select(*[docs[c] for c in names], docs[text].alias(ids))
    kinds = source.drop(ids).schema.simpleString()[len("struct<") : -1]
    schema = source.drop(ids).schema.add(ids, "binary")
    if decoded:
        schema = schema.add(decoded, "string")
    del kinds

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [x or "" for x in batch.column(batch.num_columns - 1).to_pylist()]
        found: list[bytes] = []
        for a, b in grouped_by_size(texts, 1 << 20):
            found += encode_texts(texts[a:b], path)
        columns = [*batch.columns[:-1], pa.array(found, pa.binary())]
        fields = [*batch.schema.names[:-1], ids]
        if decoded:
            book = vocabulary(path)
            columns.append(pa.array([book.decode(np.frombuffer(x, "<u4").tolist()) for x in found], pa.string()))
            fields.append(decoded)
        return pa.RecordBatch.from_arrays(columns, names=fields)

    return by_batch(source, run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document the count and the hash of its ids, and the hash of the text decoded from them."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        book = vocabulary(path)
        texts = [x or "" for x in batch.column(1).to_pylist()]
        n, of_ids, of_text = [], [], []
        for a, b in grouped_by_size(texts, 1 << 20):
            for packed in encode_texts(texts[a:b], path):
                n.append(len(packed) // 4)
                of_ids.append(hashlib.sha256(packed).hexdigest())
                decoded = book.decode(np.frombuffer(packed, "<u4").tolist())
                of_text.append(hashlib.sha256(decoded.encode()).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text)],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return by_batch(docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text"), run, schema)
