"""Token counts by compiled transducers.

One machine (:mod:`pretokens`) finds where words start; its chunks' state maps compose by a prefix scan. A second one
(:mod:`token_machine`) reads the bytes of a word, and each of its transitions carries how many tokens it adds. Sums of
words met before are remembered. The sums of all words go through one more prefix scan, whose differences at the text ends
are the counts of the texts. No ids are made.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from geoscore.llm.bpe import Words, split_all, vocabulary
from geoscore.llm.common import by_batch, grouped_by_size
from geoscore.llm.pretokens import pretokens
from geoscore.llm.token_machine import machine


@lru_cache(4)
def _emitted(path: str) -> Words:
    return Words(machine(path).tokens)


def count_texts(texts: list[str], path: str) -> np.ndarray:
    book, emitted = vocabulary(path), _emitted(path)
    pieces, owners = split_all(texts, book)
    out = np.zeros(len(texts), np.int64)
    if pieces:
        words, begins = pretokens(pieces, spaced=True)
        total = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.fromiter(map(emitted.__getitem__, words), np.int64, len(words)), out=total[1:])
        of_piece = total[begins[1:] - 1] - total[begins[:-1]]
        of_piece += np.fromiter((s is not None for _, s in owners), np.int64, len(owners))
        np.add.at(out, np.fromiter((n for n, _ in owners), np.int64, len(owners)), of_piece)
        emitted.trim()
        machine(path).trim()
    return out


def token_counts(docs: DataFrame, path: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its key, UTF-8 bytes, tokens, and whether it has more than ``limit`` tokens.

    A null text counts as empty: 0 bytes and 0 tokens. Rows with a null or repeated key each give a row.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [x or "" for x in batch.column(1).to_pylist()]
        size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
        runs = [count_texts(texts[a:b], path) for a, b in grouped_by_size(texts, 1 << 20)]
        n = np.concatenate(runs) if runs else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), size, pa.array(n), pa.array(n > limit)], names=[key, "n_bytes", "n_tokens", "over_limit"]
        )

    source = docs.select(docs[key], docs[text].cast("string"))
    kind = source.schema[0].dataType.simpleString()
    return by_batch(source, run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
