"""Spelling variants: words one edit apart, found by dynamic programming down sorted lists.

A list of words is scanned in code-point order, once for each of its words as a query. The rows of the query's edit matrix,
three cells wide as one edit allows no more, are kept by depth: the next word of the list reuses those of the prefix that
it shares with the word before it, and where all cells of a row exceed one edit, all words that share this prefix are
skipped at once.

Which words share a list is a join by equal keys. Of two words at most one edit apart, of m and m or m + 1 code points, the
edit lies in one of two pieces of the shorter word, and all before and after that piece is equal. So words are grouped by
m, piece and what surrounds the piece, and only the pieces themselves are scanned. A group that is too large for one list
is dealt again by the two halves of its piece, down to pieces of one code point, where the alphabet bounds a group.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geoscore.llm.common import Tables
from geoscore.llm.runs import by_runs

LETTERS = r"[A-Za-zÀ-ÿ]"
SHORTEST = 6  # code points of a word
OFTEN = 5  # times that a word occurs at least
TIMES = 5  # how much more often a form occurs than its variant
DROP = 199  # one run in so many loses a letter
LIST = 512  # words scanned as one list
HELD = 200_000  # distinct words whose counts a task holds before it passes them on
PIECE = 1 << 16  # characters looked at at once

_RUNS = re.compile(LETTERS.replace("A-Z", "") + "+")  # after bytes.lower, which lowers A-Z alone
_NOT_LETTER = re.compile(LETTERS.replace("[", "[^"))


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces that end where a run ends, so that a long text never stands as one list of runs."""
    begin = 0
    while len(text) - begin > PIECE:
        cut = _NOT_LETTER.search(text, begin + PIECE)
        if not cut:
            break
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:]


def runs_of(text: str) -> Counter[str]:
    """How often each run of letters occurs in a text, A-Z lower-cased."""
    out: Counter[str] = Counter()
    for piece in _pieces(text):
        out.update(_RUNS.findall(piece.encode().lower().decode()))
    return out


def _observed(drop: int):
    """Words with their counts; a run whose checksum with the document's id is a multiple of ``drop`` loses a code point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def passed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                begin = zlib.crc32(b"%d:" % doc) if doc is not None else None
                for word, n in runs_of(text).items():
                    if begin is not None and (h := zlib.crc32(word.encode(), begin)) % drop == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    held[word] += n
                if len(held) > HELD:
                    yield passed_on()
        if held:
            yield passed_on()

    return run


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, often: int = OFTEN, drop: int = DROP) -> DataFrame:
    """``word`` and ``n``: all words of at least ``shortest`` code points that occur at least ``often`` times.

    A null text has no words; a row without key keeps its runs as they are.
    """
    observed = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(_observed(drop), "word string, n long")
    return observed.where(F.char_length("word") >= shortest).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def _shared(words: list[str]) -> list[int]:
    """Code points that each word of a sorted list shares with the word before it."""
    out = [0] * len(words)
    for i in range(1, len(words)):
        a, b, k = words[i - 1], words[i], 0
        for x, y in zip(a, b):
            if x != y:
                break
            k += 1
        out[i] = k
    return out


def near_pairs(words: list[str], queries: list[int]) -> list[tuple[int, int]]:
    """Pairs (query, other) of a sorted list of distinct words with exactly one edit between them.

    Row d of the matrix holds the edits between the first d code points of a list word and the first d - 1, d and d + 1 of
    the query; 2 stands for more than one, and for cells beside the matrix.
    """
    shared, out, n = _shared(words), [], len(words)
    # The next word that shares less with its predecessor than this one does, found from the end.
    onward, waiting = [n] * n, []
    for i in range(n - 1, -1, -1):
        while waiting and shared[waiting[-1]] >= shared[i]:
            waiting.pop()
        onward[i] = waiting[-1] if waiting else n
        waiting.append(i)
    for q in queries:
        query, m = words[q], len(words[q])
        rows = [(2, 0, 1 if m else 2)]
        i = 0
        while i < n:
            word = words[i]
            d = shared[i] if i else 0
            del rows[d + 1 :]
            before, here, after = rows[d]
            while d < len(word) and (before < 2 or here < 2 or after < 2):
                letter = word[d]
                d += 1
                x = y = z = 2
                if d == 1:
                    x = 1
                elif d <= m + 1:
                    x = min(before + (query[d - 2] != letter), here + 1)
                if d <= m:
                    y = min(here + (query[d - 1] != letter), after + 1, x + 1)
                if d < m:
                    z = min(after + (query[d] != letter), y + 1)
                before, here, after = min(x, 2), min(y, 2), min(z, 2)
                rows.append((before, here, after))
            alive = before < 2 or here < 2 or after < 2
            if d == len(word):
                edits = {m - 1: after, m: here, m + 1: before}.get(d, 2)
                if edits == 1:
                    out.append((q, i))
            i += 1
            if not alive:  # no word that goes on like this one can be near
                while i < n and shared[i] >= d:
                    i = onward[i]
    return out


def _scan(rows: pa.Table, edges: list[int]) -> pa.RecordBatch | None:
    word, m, begin, end = (rows.column(c).to_pylist() for c in ("word", "m", "begin", "end"))
    found_a, found_b = [], []
    for first, last in zip(edges, edges[1:]):
        size, a, b = m[first], begin[first], end[first]
        # What surrounds the piece is equal in the whole group, so edits are counted inside it.
        inner = sorted((w[a : len(w) - (size - b)], w) for w in word[first:last])
        shorter = [i for i, (_, w) in enumerate(inner) if len(w) == size]
        for i, j in near_pairs([x for x, _ in inner], shorter):
            found_a.append(inner[i][1])
            found_b.append(inner[j][1])
    return pa.RecordBatch.from_arrays([pa.array(found_a, pa.string()), pa.array(found_b, pa.string())], names=["a", "b"])


def near_words(words: DataFrame, own: Tables, most: int = LIST) -> DataFrame:
    """``a``, ``b``: every two words of the column ``word`` with exactly one edit between them, in both directions, once.

    ``words`` are distinct. Groups of up to ``most`` members, and those whose piece is one code point, are scanned in one
    task; the members of larger ones are dealt again by halves of the piece.
    """
    length = F.char_length("word")
    now = words.select("word", length.alias("length")).select(
        "word", "length", F.explode(F.array(F.col("length"), F.col("length") - 1)).alias("m")
    ).where("m > 0").withColumns({"begin": F.lit(0), "end": F.col("m")})
    key = ["m", "begin", "end", "head", "tail"]
    links, turn = [], 0
    while True:
        middle = F.expr("begin + (end - begin) DIV 2")
        halves = F.array(F.struct(F.col("begin"), middle.alias("end")), F.struct(middle.alias("begin"), F.col("end")))
        dealt = now.select("word", "length", "m", F.explode(halves).alias("piece")).select(
            "word", "length", "m", "piece.begin", "piece.end"
        ).where("begin < end").withColumns({
            "head": F.expr("left(word, begin)"), "tail": F.expr("right(word, m - end)")
        })
        dealt = own.store(dealt, f"dealt-{turn}")
        sized = dealt.groupBy(*key).agg(F.count(F.lit(1)).alias("size"), F.min("length").alias("least")).where("size > 1 AND least = m")
        fits = (F.col("size") <= most) | (F.col("end") - F.col("begin") <= 1)
        group = F.xxhash64(*key)
        scanned = dealt.join(sized.where(fits).drop("size", "least"), key).withColumn("group", group)
        links.append(own.store(
            scanned.repartition(*key).sortWithinPartitions("group", *key).mapInArrow(
                by_runs(["group", *key], _scan), "a string, b string"
            ), f"pairs-{turn}"
        ))
        large = sized.where(~fits).drop("size", "least")
        if large.isEmpty():
            break
        now, turn = dealt.join(large, key).select("word", "length", "m", "begin", "end"), turn + 1
    pairs = links[0]
    for more in links[1:]:
        pairs = pairs.unionAll(more)
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return own.store(both.distinct(), "near")


def variants(words: DataFrame, own: Tables, times: int = TIMES, most: int = LIST) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` for a vocabulary of distinct ``word`` with counts ``n``.

    ``form`` is the near word of largest ``n`` (of ties, the smallest in code-point order), if that is at least ``times`` the
    word's own; else null, and so is ``form_n``. ``root`` is where following forms ends, the word itself if it has none.
    ``n_near`` counts near words. An empty vocabulary gives no rows.
    """
    words = own.store(words.select("word", "n"), "words")
    near = near_words(words, own, most)
    best = near.join(words.withColumnRenamed("word", "b"), "b").groupBy("a").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), F.col("b").alias("form"))).alias("best")
    ).withColumnRenamed("a", "word")
    enough = -F.col("best.less") >= times * F.col("n")
    formed = own.store(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"),
    ), "formed")
    # Each turn doubles how far a word sees: counts rise with every step, so there is no cycle and few steps.
    sees = own.store(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "sees")
    while not sees.where("moved").isEmpty():
        onward = sees.select(F.col("word").alias("root"), F.col("root").alias("further"))
        then = own.store(sees.select("word", "root").join(onward, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
        ), "sees")
        own.drop(sees)
        sees = then
    own.keep_only(formed, sees)
    return formed.join(sees, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


# Checksums go bit by bit over the bytes; near words meet by what is left of them without one letter.
ORACLE_SQL = """
WITH runs AS (
    SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{00FF}]+')) AS run FROM documents)
), counted AS (
    SELECT doc_id, run, count(*) AS n, hex(doc_id::VARCHAR || ':' || run) AS bytes FROM runs GROUP BY ALL
), checked AS (
    SELECT run, n, CASE WHEN doc_id IS NULL THEN 1 ELSE xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, flatten(list_transform(range(0, length(bytes) // 2),
            lambda i: [('0x' || substr(bytes, 2 * i + 1, 2))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
        lambda c, v: xor(xor(c, v) >> 1, CASE WHEN xor(c, v) & 1 = 1 THEN 3988292384 ELSE 0 END))) END AS h
    FROM counted
), words AS (
    SELECT word, sum(n)::BIGINT AS n FROM (
        SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM checked
    ) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), less AS (
    SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
    SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), best AS (
    SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS most FROM near GROUP BY word
), formed AS (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * n THEN other END AS form, CASE WHEN most >= 5 * n THEN most END AS form_n
    FROM words LEFT JOIN best USING (word)
), walk AS (
    WITH RECURSIVE steps AS (
        SELECT word, word AS root, form AS next FROM formed
        UNION ALL SELECT s.word, f.word, f.form FROM steps s JOIN formed f ON s.next = f.word
    ) SELECT word, root FROM steps WHERE next IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN walk USING (word)
"""
