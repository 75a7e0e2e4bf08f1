"""A quality classifier by co-training on two views of a document.

One view sees only the text (byte trigrams and shares of kinds of characters), the other only the page's metadata
(language, source, stored length, layout of lines). Each is a logistic regression. In every round each view labels
the unlabelled documents that it is surest about, and those labels go to the other view's training rows. At last each
view's scores are calibrated on labelled rows kept back from training, and the calibrated views are added up.

The labelled rows are a bounded sample (``labelled``; by hash of the id). The unlabelled documents are all of them: their
features are stored once, every round scores all of them in tasks, each task keeps its surest, and only the features of the
whole table's surest come to the fit. Every document is then scored by every feature of its whole text.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geoscore.llm.common import Tables, grouped_by_size, tables

TRIGRAMS = 256
SOURCES, LANGS = 32, 8  # hashed
LABELLED = 6_000
ROUNDS, PER_ROUND = 5, 400
SEED = 4_711

_KINDS = np.zeros(256, np.int64)
for _kind, _bytes in enumerate((
    range(97, 123), range(65, 91), range(48, 58), (32, 9, 11, 12, 13), (10,), b".,;:'\"()-", b"!?", b"#*$%&|<>",
    range(128, 256),
), 1):
    _KINDS[list(_bytes)] = _kind
N_KINDS = 10
TEXT_WIDTH, META_WIDTH = TRIGRAMS + N_KINDS - 1 + 4 + 1, LANGS + SOURCES + 8


def text_view(texts: list[bytes]) -> np.ndarray:
    """Features of the content: trigrams of bytes, shares of kinds of characters, variety and length of words."""
    n = len(texts)
    joined = np.frombuffer(b"\0\0".join(texts) + b"\0\0", np.uint8)
    doc = np.repeat(np.arange(n), np.fromiter((len(t) + 2 for t in texts), np.int64, n))
    kinds = np.bincount(doc * N_KINDS + _KINDS[joined], minlength=n * N_KINDS).reshape(n, N_KINDS)[:, 1:]
    wide = joined.astype(np.uint32)
    grams = wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA77) + wide[2:] * np.uint32(0xC2B2AE3D)
    real = (joined[:-2] != 0) & (joined[1:-1] != 0) & (joined[2:] != 0)
    place = (grams[real] >> np.uint32(24)).astype(np.int64) * TRIGRAMS // 256
    counts = np.bincount(doc[:-2][real] * TRIGRAMS + place, minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
    counts = np.log1p(counts)
    counts /= np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-9)
    size = np.maximum(kinds.sum(axis=1, keepdims=True), 1)
    words = [t.split() for t in texts]
    n_words = np.array([len(w) for w in words], float)
    variety = np.array([len(set(w)) for w in words]) / np.maximum(n_words, 1)
    extra = np.column_stack([
        np.sqrt(kinds / size), variety, np.log1p(n_words) / 8, size[:, 0] / np.maximum(n_words, 1) / 20, n_words < 20,
    ])
    return np.column_stack([counts, np.clip(extra, 0, 4), np.ones(n)])


def metadata_view(lang: list, source: list, chars: list, texts: list[bytes]) -> np.ndarray:
    """Features of the page: hashed language and source (null has a place of its own), lengths, layout of lines."""
    n = len(texts)
    hashed = lambda v, size: 0 if v is None else 1 + zlib.crc32(str(v).encode()) % (size - 1)
    out = np.zeros((n, LANGS + SOURCES + 8))
    rows = np.arange(n)
    out[rows, [hashed(v, LANGS) for v in lang]] = 1
    out[rows, [LANGS + hashed(v, SOURCES) for v in source]] = 1
    size = np.array([len(t) for t in texts], float)
    lines = np.array([t.count(b"\n") + 1 for t in texts], float)
    stored = np.array([0 if v is None or v != v else v for v in chars], float)
    at = LANGS + SOURCES
    out[:, at] = np.log1p(np.maximum(stored, 0)) / 10
    out[:, at + 1] = stored < 200
    out[:, at + 2] = stored < 600
    out[:, at + 3] = np.log1p(size / lines) / 8
    out[:, at + 4] = np.log1p(lines) / 6
    out[:, at + 5] = lines == 1
    out[:, at + 6] = stored / np.maximum(size, 1)
    out[:, at + 7] = 1
    return np.clip(out, 0, 4)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, start: np.ndarray | None = None, steps: int = 12) -> np.ndarray:
    """Ridge logistic regression by Newton's method, classes weighed evenly."""
    positive = (weight * y).sum() / weight.sum()
    weight = weight * np.where(y == 1, 0.5 / max(positive, 1e-6), 0.5 / max(1 - positive, 1e-6))
    ridge = np.full(x.shape[1], 0.5)
    ridge[-1] = 1e-3
    w = np.zeros(x.shape[1]) if start is None else start.copy()
    for _ in range(steps):
        p = _sigmoid(x @ w)
        pull = x.T @ (weight * (y - p)) - ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, pull)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _calibrate(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn a raw score into log odds."""
    spread = max(scores.std(), 1e-6)
    x = np.column_stack([scores / spread, np.ones(len(scores))])
    w = np.zeros(2)
    for _ in range(25):
        p = _sigmoid(x @ w)
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), x.T @ (y - p) - 1e-2 * w)
    return float(w[0] / spread), float(w[1])


class Model(NamedTuple):
    text: np.ndarray | None
    meta: np.ndarray | None
    calibration: tuple[float, ...]
    prior: float
    cutoff: float

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good quality by the text, by the metadata, and by both."""
        if self.text is None:
            same = np.full(len(text), _sigmoid(np.array(self.prior)))
            return same, same, same
        a, b, c, d = self.calibration
        by_text, by_meta = a * (text @ self.text) + b, c * (meta @ self.meta) + d
        # Each view's log odds holds the prior once.
        return _sigmoid(by_text), _sigmoid(by_meta), _sigmoid(by_text + by_meta - self.prior)


Surest = Callable[[list[np.ndarray], float], list[tuple[np.ndarray, np.ndarray]]]


def train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, surest: Surest | None = None, lost: float = 0.005, rounds: int = ROUNDS) -> Model:
    """``y``: 1 good, 0 bad. A fifth of the rows is kept back for calibration.

    ``surest`` takes the views' weights and the share of good labels, and gives for each view the features (of both
    views) and the labels of the unlabelled documents that it is surest about.
    """
    known = np.arange(len(y))
    good = (y == 1).mean() if len(known) else 0.5
    prior = math.log((good + 1e-3) / (1 - good + 1e-3))
    random = np.random.default_rng(SEED)
    random.shuffle(known)
    held, base = known[: len(known) // 5], known[len(known) // 5 :]
    if min((y[held] == 1).sum(), (y[held] == 0).sum(), (y[base] == 1).sum(), (y[base] == 0).sum()) < 2:
        return Model(None, None, (), prior, 0.0)
    views = (text, meta)
    taught = [(view[base], y[base].astype(float)) for view in views]
    weights: list[np.ndarray | None] = [None, None]
    for turn in range(rounds + 1):
        for v in (0, 1):
            rows, labels = taught[v]
            trust = np.where(np.arange(len(rows)) < len(base), 1.0, 0.3)
            weights[v] = _fit(rows, labels, trust, weights[v])
        if turn == rounds or surest is None:
            break
        picked = surest(weights, good)
        if not any(len(labels) for _, labels in picked):
            break
        for v, (rows, labels) in enumerate(picked):
            other = rows[:, TEXT_WIDTH:] if v == 0 else rows[:, :TEXT_WIDTH]
            old_rows, old = taught[1 - v]
            taught[1 - v] = np.concatenate([old_rows, other]), np.concatenate([old, labels])
    truth = y[held].astype(float)
    calibration = (*_calibrate(text[held] @ weights[0], truth), *_calibrate(meta[held] @ weights[1], truth))
    model = Model(weights[0], weights[1], calibration, prior, 0.0)
    both = model.scores(text[held], meta[held])[2]
    # Few good documents may fall under the cutoff; rows that the model was trained on do not say how many will.
    return model._replace(cutoff=float(min(0.5, np.quantile(both[truth == 1], lost))))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.col("text"), "UTF-8").alias("text"), F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"), F.col("n_chars").cast("double").alias("n_chars"),
    )


def _views(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    texts = [x or b"" for x in batch.column("text").to_pylist()]
    lang, source, chars = (batch.column(c).to_pylist() for c in ("lang", "source", "n_chars"))
    for a, b in grouped_by_size(texts, 1 << 20):
        yield a, b, text_view(texts[a:b]), metadata_view(lang[a:b], source[a:b], chars[a:b], texts[a:b])


def _features(rows: DataFrame, carried: str, kind: str) -> DataFrame:
    """``doc_id``, the column ``carried``, and ``features``: both views as 32-bit floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, text, meta in _views(batch):
                both = np.column_stack([text, meta]).astype(np.float32)
                packed = pa.array([row.tobytes() for row in both], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[a:b], batch.column(carried)[a:b], packed], names=["doc_id", carried, "features"]
                )

    return rows.mapInArrow(run, f"doc_id long, {carried} {kind}, features binary")


def _unpacked(features: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(features), np.float32).reshape(len(features), TEXT_WIDTH + META_WIDTH).astype(float)


class Unlabelled:
    """All documents that ``labels`` does not name; what a round has taken is not taken again.

    ``stored`` has ``doc_id``, a number of its own for each ``row``, and ``features``. Of rows repeated with one id the
    surest counts. Only ids and scores meet the labels, so features are never shuffled.
    """

    def __init__(self, stored: DataFrame, labels: DataFrame, own: Tables, per_round: int = PER_ROUND):
        self.stored, self.labels, self.own, self.per_round = stored, labels.select("doc_id"), own, per_round
        self.left = self._unknown(stored.select("doc_id")).distinct().count()
        # At most twice ``per_round`` ids a round.
        self.taken: set[int] = set()

    def _unknown(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.labels, "doc_id", "left_anti")

    def surest(self, weights: list[np.ndarray], good: float) -> list[tuple[np.ndarray, np.ndarray]]:
        n = min(self.per_round, self.left // 4)
        n_bad = max(1, round(n * (1 - good))) if n else 0
        # View, sign of the score, how many.
        sides = [(v, sign, most) for v in (0, 1) for sign, most in ((-1, n_bad), (1, n - n_bad))]
        taken = np.array(sorted(self.taken), np.int64)

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                both = _unpacked(batch.column("features").to_pylist())
                raw = both[:, :TEXT_WIDTH] @ weights[0], both[:, TEXT_WIDTH:] @ weights[1]
                sure = _sigmoid(np.maximum(np.abs(raw[0]), np.abs(raw[1]))) > 0.9
                free = np.flatnonzero(sure & ~np.isin(np.asarray(batch.column("doc_id")), taken))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(free), batch.column("row").take(free), pa.array(raw[0][free]), pa.array(raw[1][free])],
                    names=["doc_id", "row", "by_text", "by_meta"],
                )

        def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(sides)
            for batch in batches:
                ids, rows = np.asarray(batch.column("doc_id")), np.asarray(batch.column("row"))
                raw = np.asarray(batch.column("by_text")), np.asarray(batch.column("by_meta"))
                for k, (v, sign, most) in enumerate(sides):
                    new = np.flatnonzero(_sigmoid(sign * raw[v]) > 0.9)
                    sure, i, r = (np.concatenate(x) for x in zip(held[k], (sign * raw[v][new], ids[new], rows[new])))
                    order = np.lexsort((i, -sure))
                    _, first = np.unique(i[order], return_index=True)
                    keep = order[np.sort(first)[:most]]
                    held[k] = sure[keep], i[keep], r[keep]
            for k, (sure, i, r) in enumerate(held):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(i), k, np.int32)), pa.array(sure), pa.array(i), pa.array(r)],
                    names=["side", "sure", "doc_id", "row"],
                )

        # Every id of the whole table's surest is among the surest of the task that holds its surest row.
        scores = self.stored.mapInArrow(scored, "doc_id long, row long, by_text double, by_meta double")
        of_tasks = self.own.store(self._unknown(scores).mapInArrow(top, "side int, sure double, doc_id long, row long"), "surest")
        chosen = []
        for k, (_, _, most) in enumerate(sides):
            best = of_tasks.where(F.col("side") == k).groupBy("doc_id").agg(F.max(F.struct("sure", "row")).alias("top"))
            chosen.append(best.orderBy(F.desc("top.sure"), "doc_id").limit(most).select("doc_id", "top.row").collect())
        self.own.drop(of_tasks)
        rows = {r["row"] for side in chosen for r in side}
        found = self.stored.where(F.col("row").isin(sorted(rows))).select("row", "features").collect() if rows else []
        features = {r["row"]: bytes(r["features"]) for r in found}
        new = {r["doc_id"] for side in chosen for r in side}
        self.taken |= new
        self.left -= len(new)
        out = []
        for v in (0, 1):
            mine = [(r["row"], float(sign > 0)) for (view, sign, _), side in zip(sides, chosen) if view == v for r in side]
            x = _unpacked([features[row] for row, _ in mine]) if mine else np.zeros((0, TEXT_WIDTH + META_WIDTH))
            out.append((x, np.array([label for _, label in mine])))
        return out


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> Model:
    """Fit on at most ``labelled`` labelled documents, chosen by hash of the id, and the surest of all others.

    In each of ``rounds`` rounds each view labels at most ``per_round`` documents, the surest of the whole table.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(labelled).select(
        "doc_id", F.col("y").cast("int").alias("y")
    )
    # At most labelled rows of two numbers, so every task may have them all.
    sample = _features(_rows(docs).join(F.broadcast(chosen), "doc_id"), "y", "int")
    # Rows repeated with one id would outgrow the bound; one of them is enough.
    rows = sample.groupBy("doc_id", "y").agg(F.min("features").alias("f")).orderBy("doc_id").collect()
    x = _unpacked([bytes(r["f"]) for r in rows]) if rows else np.zeros((0, TEXT_WIDTH + META_WIDTH))
    text, meta, y = x[:, :TEXT_WIDTH], x[:, TEXT_WIDTH:], np.array([r["y"] for r in rows], int)
    alone = train(text, meta, y)
    if alone.text is None:
        return alone
    with tables(docs.sparkSession) as own:
        # The number of a row is read from the stored table only, where it no longer changes.
        rows = _rows(docs).where("doc_id IS NOT NULL").withColumn("row", F.monotonically_increasing_id())
        stored = own.store(_features(rows, "row", "long"), "features")
        model = train(text, meta, y, Unlabelled(stored, labels, own, per_round).surest, rounds=rounds)
        own.keep_only()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``p_text``, ``p_meta``, ``score`` (both views) and ``kept`` for every document.

    Null texts count as empty; a null language or source has a weight of its own. Repeated rows each give a row. Without
    labels of both classes all scores are the share of good labels, and all documents are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, text, meta in _views(batch):
                by_text, by_meta, both = model.scores(text, meta)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[a:b], pa.array(by_text), pa.array(by_meta), pa.array(both), pa.array(both >= model.cutoff)],
                    names=["doc_id", "p_text", "p_meta", "score", "kept"],
                )

    return _rows(docs).mapInArrow(run, "doc_id long, p_text double, p_meta double, score double, kept boolean")
