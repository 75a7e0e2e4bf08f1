"""Merkle manifests against brute force."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from geoscore.llm import merkle
from geoscore.llm.common import tables
from geoscore.llm.queries import QUERIES

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return h(*("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def climbed(nodes, fan=3):
    """Root, and per node its siblings (left, right) by level."""
    siblings, at, now = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(now) > 1:
        runs = [now[i : i + fan] for i in range(0, len(now), fan)]
        for k, place in enumerate(at):
            run = runs[place // fan]
            siblings[k].append((run[: place % fan], run[place % fan + 1 :]))
            at[k] = place // fan
        now = [h(*r) for r in runs]
    return now[0], siblings


def expected(rows, fan=3):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[3]].append((r[0] is not None, r[0] or 0, leaf(*r), r))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    parts = {s: sorted(by_source[s], key=lambda x: x[:3]) for s in order}
    trees = {s: climbed([x[2] for x in parts[s]], fan) for s in order}
    root, tops = climbed([trees[s][0] for s in order], fan) if order else (None, [])
    for k, s in enumerate(order):
        for (_, _, node, r), own in zip(parts[s], trees[s][1]):
            proof = own + tops[k]
            given = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None:
                given = (r[0], r[1].replace("\n", ""), *r[2:])
            fold = leaf(*given)
            for left, right in proof:
                fold = h(*left, fold, *right)
            yield r[0], node, trees[s][0], root, h(*(x for pair in proof for side in pair for x in side)), fold, fold == root


def run(spark, docs, folder, monkeypatch, **how):
    docs.write.parquet(f"{folder}/documents.parquet")
    if how:
        plain = merkle.manifest
        monkeypatch.setattr(merkle, "manifest", lambda *a, **k: plain(*a, **k, **how))
    return [tuple(r) for r in QUERIES["op12_merkle_manifest"](spark, str(folder)).collect()]


def rows_of(sizes):
    out, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            i += 1
            out.append((i * 7 % 100_003, f"text {i}\nof {s}" if i % 5 else None, "en" if i % 3 else None, s, i if i % 4 else None))
    return out


@pytest.mark.parametrize("low", [0, 1, 2, merkle.LOW])
def test_proofs_equal_brute_force(spark, tmp_path, monkeypatch, low):
    """Trees of one to 200 leaves, among them sizes just around powers of the fanout, in several rounds of the exchange."""
    sizes = {None: 4, "": 1, "a": 2, "b": 3, "c": 9, "d": 10, "é": 28, "f": 82, "z" * 50: 200, "hot": 244, "x": 27, "y": 81}
    rows = rows_of(sizes)
    rows += [(1, "same", "en", "a", 4)] * 5 + [(None, "x\ny", "en", "b", 3), (None, None, None, None, None), (None, None, None, None, None), (5, "", "en", "d", 0)]
    rows += [(9, "long \n" * 100_000, "en", "d", 1), (12, "other", "en", "a", 1), (12, "another", "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCUMENTS).repartition(5).withColumns({n: F.lit("own") for n in ("LEAF", "tree", "place", "n", "node", "given", "root")})
    assert Counter(run(spark, docs, tmp_path, monkeypatch, low=low)) == Counter(expected(rows))


def test_empty_and_single(spark, tmp_path, monkeypatch):
    assert run(spark, spark.createDataFrame([], DOCUMENTS), tmp_path / "none", monkeypatch) == []
    one = [(4, "a\nb", None, None, 1)]
    got = run(spark, spark.createDataFrame(one, DOCUMENTS), tmp_path / "one", monkeypatch)
    assert got == list(expected(one)) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == sha256().hexdigest()


def test_proofs_can_be_used_alone(spark):
    """What a manifest returns, another fanout, and one tree over many groups."""
    rows = [(i, f"t{i}", "en", f"s{i % 40:02}", i) for i in range(170)]
    with tables(spark) as own:
        made = merkle.manifest(spark.createDataFrame(rows, DOCUMENTS), own, fanout=4, low=1)
    groups = {r["source"]: (r["n"], r["subroot"]) for r in made.groups.collect()}
    want = {i: x for i, *x in expected(rows, 4)}
    assert len(groups) == 40 and sum(n for n, _ in groups.values()) == 170
    for r in made.leaves.collect():
        assert [r["leaf"], r["subroot"], r["root"]] == want[r["doc_id"]][:3] and groups[f"s{r['doc_id'] % 40:02}"][1] == r["subroot"]
        fold = r["leaf"]
        for left, right in zip(r["lefts"], r["rights"]):
            fold = h(left, fold, right)
        assert fold == r["root"]


def test_a_changed_row_is_found(spark):
    docs = spark.createDataFrame([(i, f"t\n{i}", "en", "s", i) for i in range(50)], DOCUMENTS)
    with tables(spark) as own:
        changed = F.when(F.col("doc_id") == 7, F.lit("other")).otherwise(F.col("text"))
        rows = merkle.manifest(docs, own, extra={"now": merkle.leaf_digest([F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [changed])}).leaves
    bad = rows.where(merkle.folded(F.col("now"), F.col("lefts"), F.col("rights")) != F.col("root"))
    assert [r["doc_id"] for r in bad.collect()] == [7]
