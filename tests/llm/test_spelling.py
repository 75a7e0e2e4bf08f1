"""Spelling variants against brute force."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoscore.llm import spelling
from geoscore.llm.common import tables


def near(a: str, b: str) -> bool:
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def all_near(words):
    """By what is left without one letter; words at a distance of one share that."""
    at: dict = {}
    for w in words:
        for k in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            at.setdefault(k, set()).add(w)
    return {(a, b) for group in at.values() for a in group for b in group if near(a, b)}


def vocabulary(rows):
    seen: Counter = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if doc is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 6 and n >= 5}


def expected(words):
    links: dict = {}
    for a, b in all_near(words):
        links.setdefault(a, []).append(b)
    form = {}
    for w, n in words.items():
        best = min(links.get(w, ()), key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        yield w, form[w], root, n, len(links.get(w, ())), words[form[w]] if form[w] else None


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdefgh"])
def test_scanned_lists_equal_brute_force(letters):
    random = np.random.default_rng(len(letters))
    for turn in range(150):
        sizes = random.integers(0, 7, random.integers(1, 40))
        words = sorted({"".join(random.choice(list(letters), n)) for n in sizes})
        queries = [i for i in range(len(words)) if turn % 2 or i % 3]
        got = spelling.near_pairs(words, queries)
        assert len(got) == len(set(got))
        assert set(got) == {(i, j) for i in queries for j in range(len(words)) if near(words[i], words[j])}, words


@pytest.mark.parametrize("most", [1, 3, 40, spelling.LIST])
def test_pairs_do_not_depend_on_the_size_of_lists(spark, most):
    random = np.random.default_rng(3)
    words = {"".join(random.choice(list("abé"), n)) for n in random.integers(1, 9, 700)} | {"x" * n for n in range(1, 30)}
    words |= {"q" * 2000 + "a", "q" * 2000 + "ab", "b" + "q" * 2000 + "a"}
    with tables(spark) as own:
        got = spelling.near_words(spark.createDataFrame([(w,) for w in words], "word string"), own, most).collect()
    pairs = {(r["a"], r["b"]) for r in got}
    assert len(pairs) == len(got) and pairs == all_near(words)


def test_variants(spark):
    """Ties, chains of forms, counts just at the limits, and words without near words."""
    words = {"aaaaaa": 1000, "aaaaab": 200, "aaaabb": 40, "aaabbb": 8, "bbbbbb": 6, "banana": 29, "bananas": 5, "bananaz": 26, "cherry": 500, "cherri": 101,
             "cherrx": 100, "chérry": 5, "tttttt": 50, "ttttta": 50, "tttttb": 10, "tttttà": 10}
    words |= {f"common{a}{b}": 5 + i for i, (a, b) in enumerate((a, b) for a in "abcdef" for b in "uvwxyz")}
    with tables(spark) as own:
        table = spark.createDataFrame(list(words.items()), "word string, n long").withColumns({"FORM": F.lit(1), "b": F.lit(2)})
        got = [tuple(r) for r in spelling.variants(table, own).collect()]
        assert spelling.variants(table.limit(0), own).count() == 0
    assert sorted(got, key=str) == sorted(expected(words), key=str)
    assert {w: r for w, _, r, *_ in got}["aaabbb"] == "aaaaaa"


def test_vocabulary(spark):
    random = np.random.default_rng(6)
    stems = ["".join(random.choice(list("aeinrstÉéß"), n)) for n in random.integers(4, 10, 60)]
    rows = [(int(i), " ".join(random.choice(stems, 80))) for i in range(200)] * 2
    rows += [(None, " ".join(stems)), (None, None), (7, None), (8, ""), (9, "x" * 200_000 + " " + "Word×÷Ÿ, " * 40_000), (10, "İſK ÀÿĀ" * 10), (11, "abcdef\ud83d".encode("utf-8", "ignore").decode() * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).withColumns({"word": F.lit("own"), "N": F.lit(1)})
    got = {r["word"]: r["n"] for r in spelling.vocabulary(docs).collect()}
    assert got == vocabulary(rows) and len(got) > 30
    assert spelling.vocabulary(docs.limit(0)).count() == 0
    text = "ab, " * 50_000 + "Ü" * 70_000 + " " + "end" * 30_000
    assert spelling.runs_of(text) == Counter(re.findall("[a-zÀ-ÿ]+", text))
