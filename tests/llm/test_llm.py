"""The operators on small hand-made tables and against brute force on the smallest test tables."""

from __future__ import annotations

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SMALL
from geoscore.llm import (
    bag_minhash, bpe, cotraining, embedding_dedup, id_coder, id_files, line_dedup, main_text, mixing, quality_rules,
    token_counts, token_machine,
)
from geoscore.llm.common import tables
from geoscore.llm.queries import ORACLES, QUERIES

BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    "", " ", "\n\n  \n", "a", "a b c", "'s't 've 'll'd''s", "x" * 3000, "word  \n two " * 2000, "<|endoftext|>a <|endoftext|>",
    "\x00\x1c\x85\xa0　 end ", "Ünïcödé 漢字 ½٣ 🙂́", "ΑΣ ΣΑΣ İ", "tab\tend\r\n", "1234567 8,9",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids."""
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(ODD)]
    rows += [(100, None, "en", "s0", None), (None, "text of no one", None, None, 3), (101, "z", None, "s1", 1), (101, "z", None, "s1", 1),
             (102, "same words here once", "de", None, 9), (102, "other words there", "de", None, 9), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def clashing(docs):
    """Columns named as the operators' own, in other letters too."""
    names = ("measures", "KEPT", "_t", "_gone", "n_removed", "_turn", "_epoch", "_ranges", "_h", "_j", "words", "doc", "size", "rep")
    return docs.withColumns({n: F.lit("own") for n in names})


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS FROM '{SMALL}/{t}.parquet'")
    theirs = con.sql(ORACLES[name])
    columns = sorted(theirs.columns)
    at = [theirs.columns.index(c) for c in columns]
    ours = QUERIES[name](spark, SMALL)
    assert sorted(ours.columns) == columns
    assert Counter(map(tuple, ours.select(*columns).collect())) == Counter(tuple(r[i] for i in at) for r in theirs.fetchall())


# Tokens


def test_ids_counts_and_decoding_are_the_librarys(spark, odd):
    book = Tokenizer.from_file(BYTE_BPE)
    rows = bpe.encode(clashing(odd), BYTE_BPE, ids="ids", decoded="decoded").collect()
    counts = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(odd, BYTE_BPE, limit=3).collect())
    digests = Counter((r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(odd, BYTE_BPE).collect())
    expected, hashes = Counter(), Counter()
    for r in rows:
        want = book.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == want
        assert r["decoded"] == book.decode(want, skip_special_tokens=False) and r["measures"] == "own"
        expected[r["doc_id"], len((r["text"] or "").encode()), len(want)] += 1
        hashes[r["doc_id"], hashlib.sha256(bytes(r["ids"])).hexdigest(), hashlib.sha256(r["decoded"].encode()).hexdigest()] += 1
    assert counts == expected and digests == hashes


def test_random_texts_split_like_the_library():
    random = np.random.default_rng(3)
    letters = list(" \t\n\r\x0b\x85\xa0　'''''stmdrevlREVLaZé漢字٣½1234!?.<|>—🙂́ ΣİÅ")
    texts = ["".join(random.choice(letters, random.integers(0, 50))) for _ in range(3000)]
    byte, word = Tokenizer.from_file(BYTE_BPE), Tokenizer.from_file(WORD_BPE)
    ids = [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_texts(texts, BYTE_BPE)]
    assert ids == [e.ids for e in byte.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.count_texts(texts, BYTE_BPE).tolist() == [len(x) for x in ids]
    assert [x.tolist() for x in id_files.encode_words(texts, WORD_BPE)] == [e.ids for e in word.encode_batch(texts, add_special_tokens=False)]


def test_machine_counts_what_merges_give():
    """Sums along transitions against the merges, over random words of many kinds, long ones, and prefixes in any order."""
    book, machine = bpe.vocabulary(BYTE_BPE), token_machine.Machine(bpe.vocabulary(BYTE_BPE))
    random = np.random.default_rng(9)
    kinds = [list("thanredingo'"), list("aab "), list("  \n\t"), list("éü漢字🙂a"), list("0123456789-=_")]
    words = ["".join(random.choice(kinds[k % 5], random.integers(1, 70))) for k in range(4000)] + ["x" * 3000, "ab" * 2000, " " * 999, "", "\x00\x7f"]
    for word in words:
        assert machine.tokens(word) == len(book.encode_word(word)), word
    machine.clear()
    assert [machine.tokens(w) for w in reversed(words)] == [len(book.encode_word(w)) for w in reversed(words)]
    assert min(machine.added) < 0  # a longer prefix may have fewer tokens


def test_scan_and_heap_merge_alike():
    book = bpe.vocabulary(BYTE_BPE)
    random = np.random.default_rng(4)
    for _ in range(300):
        word = "".join(random.choice(list("thanredingo"), random.integers(1, 80)))
        parts = [book.of_byte[b] for b in word.encode()]
        assert book._scan(list(parts)) == book._heap(list(parts))


def test_sections_are_cut_where_pretokens_start():
    text = "".join(np.random.default_rng(5).choice(list("ab '\n  s"), 5000))
    cut = list(bpe.sections(text, 200))
    assert "".join(cut) == text and len(cut) > 5
    whole = bpe.pretokens([text], True)[0][:-1]
    assert [w for c in cut for w in bpe.pretokens([c], True)[0][:-1]] == whole


def test_coder_round_trip_and_checksum(spark, tmp_path):
    random = np.random.default_rng(6)
    blocks = [random.integers(0, 49_408, n) for n in (1, 700, 1500)] + [np.tile([7, 49_407, 600], 400)]
    payloads = id_coder.encode_blocks(blocks, 49_408)
    for got, want in zip(id_coder.decode_blocks(payloads, [len(b) for b in blocks], 49_408), blocks):
        assert (got == want).all()
    # Predictions that were wrong for very long and are right at last, and ids that never leave one context.
    long = np.concatenate([np.stack([np.full(20_000, 5), random.integers(0, 49_408, 20_000)], 1).reshape(-1), np.tile([5, 6], 300), np.full(999, 8)])
    assert (id_coder.decode_blocks(id_coder.encode_blocks([long, long[:50]], 49_408), [len(long), 50], 49_408)[0] == long).all()
    # Each block alone gives the same ids.
    assert (id_coder.decode_blocks(payloads[1:2], [700], 49_408)[0] == blocks[1]).all()
    a, b = bytes(random.integers(0, 256, 90, dtype=np.uint8)), b"tail of it"
    assert id_coder.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    path = str(tmp_path / "ids")
    id_files.write(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), path, WORD_BPE, 2, 49_408)
    damaged = spark.read.parquet(path).withColumn("crc32", F.col("crc32") + 1)
    with pytest.raises(Exception, match="wrong checksum"):
        id_files.decoded(damaged).collect()


@pytest.mark.parametrize("block", [8192, 5])
def test_id_files(spark, odd, empty, tmp_path, block):
    book = Tokenizer.from_file(WORD_BPE)
    docs = odd.where("doc_id <> 6") if block == 5 else odd
    path = str(tmp_path / "ids")
    id_files.write(clashing(docs), path, WORD_BPE, end_id=2, vocabulary=49_408, block=block)
    got = sorted((r for r in id_files.document_digests(spark, path).collect()), key=lambda r: r["start"])
    at, want = 0, Counter()
    for r in docs.collect():
        ids = np.array([*book.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want[r["doc_id"], len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert keys == sorted(keys)
    none = str(tmp_path / "none")
    id_files.write(empty, none, WORD_BPE, 2, 49_408)
    assert id_files.document_digests(spark, none).count() == 0


def test_chunks_are_cut_where_the_library_cuts():
    book, random = Tokenizer.from_file(WORD_BPE), np.random.default_rng(12)
    letters = list("abz  \x1c\x1f\x00\x7f\t\n\u2003'.,-09½²éß×÷—ǅΣİ漢🙂\u0301") + ["don't", "<|endoftext|>", "<|ENDOFTEXT|>", "it's'", "x.1"]
    texts = ["".join(random.choice(letters, random.integers(0, 40))) for _ in range(2000)] + ["", " ", "\u3000", "x" * 3000]
    assert [x.tolist() for x in id_files.encode_words(texts, WORD_BPE)] == [e.ids for e in book.encode_batch(texts, add_special_tokens=False)]
    assert id_files.encode_words([], WORD_BPE) == [] and [len(x) for x in id_files.encode_words(["", " "], WORD_BPE)] == [0, 0]


def test_chunks_met_often_are_encoded_once(monkeypatch):
    monkeypatch.setattr(id_files, "KEPT", 200)
    book, known = id_files._library.__wrapped__(WORD_BPE)
    monkeypatch.setattr(id_files, "_library", lambda path: (book, known))
    often = ["the", "of", "water"]
    asked, encode = [], known.encode
    known.encode = lambda chunks: (asked.extend(chunks), encode(chunks))[1]
    for k in range(5):
        text = " ".join(often * 9 + [f"{'abcdefghij'[k]}{chr(97 + n // 26)}{chr(97 + n % 26)}" for n in range(150)] + ["y" * 500 + str(k)])
        assert id_files.encode_words([text], WORD_BPE)[0].tolist() == book.encode(text, add_special_tokens=False).ids
        assert len(known.chunks) <= 200 and max(map(len, known.chunks.to_pylist())) <= max(id_files.LONGEST, 501)
    assert Counter(asked)["the"] == Counter(asked)["water"] == 1


@pytest.mark.parametrize("vocabulary", [1, 256, 257, 49_408, 3_000_000])
def test_coder_at_its_bounds(vocabulary):
    random = np.random.default_rng(vocabulary)
    top = vocabulary - 1
    blocks = [
        random.integers(0, vocabulary, 3000), np.full(4096, top), np.zeros(2000, np.int64), np.tile([top, 0, top // 2], 900),
        # A long run, then what its contexts have never seen, over and over.
        np.concatenate([np.append(np.full(300, min(3, top)), x) for x in random.integers(0, vocabulary, 12)]), np.array([top]),
    ]
    payloads = id_coder.encode_blocks(blocks, vocabulary)
    for got, want in zip(id_coder.decode_blocks(payloads, [len(b) for b in blocks], vocabulary), blocks):
        assert (got == want).all()
    # What is foreseen takes next to nothing: of 4096 equal ids under a sixth of a bit each.
    assert len(payloads[1]) < 4096 // 8 // 6 * 1.5


def test_token_operators_on_an_empty_table(empty):
    assert token_counts.token_counts(empty, BYTE_BPE).count() == 0
    assert bpe.encode(empty, BYTE_BPE).count() == 0 and bpe.digests(empty, BYTE_BPE).count() == 0


# Pages


def test_main_text():
    page = (
        '<html><head><title>T</title><script>var a="</p>";</script></head><body class="has-sidebar"><header><h1>Site</h1></header>'
        '<nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies, sadly.</div><div id="content"><h2>Title &amp; more</h2>'
        '<div><p>First, with <b>bold</b> and\n  &#8220;quotes&#8221;, long enough to matter.<p>Second.<ul><li>one<li>two<br>lines</ul>'
        '<form>Name <input></form></div></div><div class="comments"><p>I, for one, like, this, very, much.</p></div>'
        '<aside>Side, bar, with, commas, many</aside><footer>&copy; x</footer><!-- gone <p>x</p> -->'
    )
    assert main_text.main_text(page).split("\n\n") == [
        "Title & more", "First, with bold and “quotes”, long enough to matter.", "Second.", "one", "two lines"
    ]
    assert main_text.main_text("<article><p>a<div>b</article><p>after") == "a\n\nb"
    assert main_text.main_text("<p>5 < 6 &lt;b&gt; <b unclosed") == "5 < 6 <b>"
    for nothing in (None, "", "<nav>x</nav>", "<!-- only", "<script>x"):
        assert main_text.main_text(nothing) == ""


def test_main_text_keeps_parts_of_an_article():
    join = lambda *x: "\n\n".join(x)
    assert main_text.main_text('<article><p>one</p><svg width="1"/><p>two</p><math/>three</article>') == join("one", "two", "three")
    kept = '<div class="social-science">a</div><p class="ad-hoc">b</p><p id="notice-how">c</p><p data=it\'s>d don\'t</p><p title="x>y">e</p>'
    gone = '<div class="ad-slot">x</div><div class="cookie-banner">x</div><p id="site-footer">x</p><div class="post-comments">x</div><div class="box ad">x</div>'
    assert main_text.main_text(f"<article>{kept}{gone}</article>") == join("a", "b", "c", "d don't", "e")
    long = "A long section, with commas, and more of it. " * 20
    page = f'<body><ul><li><a href="/">menu one</a><li><a href="/2">two</a></ul><div><h2>First</h2><div>{long}</div><h2>Last</h2><div>Short, too.</div><p>end</p></div></body>'
    assert main_text.main_text(page) == join("First", long.strip(), "Last", "Short, too.", "end")
    assert main_text.main_text(f"<div><div>{long}</div><div>More.</div></div><p>Last line.") == join(long.strip(), "More.", "Last line.")


ODD_PAGES = {
    "nested": "<div>" * 100_000 + "text", "nested texts": "<div>t, " * 100_000, "cut off": "<a " * 350_000, "quotes": "<a \"'>" * 170_000,
    "values": "<a b=\"'>" * 120_000, "spans": "<p>" + "<span>" * 100_000 + "<div>x", "signs": "<" * 1_000_000, "comments": "<!-" * 300_000,
    "buttons": "<p><button>" * 50_000 + "<div>" * 50_000, "closed": "<div>" * 50_000 + "</p></span>" * 50_000, "drawings": "<svg>" * 200_000,
    "data": "<![CDATA[" * 100_000, "spaces": "<a " + " " * 1_000_000, "lists": "<ul><li>" * 60_000, "raw": "<title></script>" * 60_000,
}


@pytest.mark.parametrize("name", sorted(ODD_PAGES))
def test_odd_pages_take_linear_time(name):
    """A megabyte of broken markup is read in one pass; quadratic work would take minutes."""
    begin = time.process_time()
    main_text.main_text(ODD_PAGES[name])
    assert time.process_time() - begin < 15
    assert main_text.main_text("<div>" * 100_000 + "text") == "text"


def test_extract_rows(spark):
    pages = spark.createDataFrame(
        [(1, "u", "<p>ab é</p>", 5), (1, "u", "<p>ab é</p>", 5), (None, None, None, 5), (2, "v", "", 5)],
        "page_id long, url string, html string, n_chars long",
    )
    rows = [tuple(r) for r in main_text.extract(pages).collect()]
    assert sorted(rows, key=str) == sorted([(1, "u", "ab é", 4)] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=str)
    assert main_text.extract(pages.limit(0)).count() == 0


def test_pages_of_the_test_table(spark):
    for r in QUERIES["op10_main_text"](spark, SMALL).join(spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = (" ".join(__import__("html").unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", inner))
        assert r["text"] == "\n\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


# Quality


def measures_of(text: str | None) -> tuple:
    text = text or ""
    words, lines = WORDS.findall(text), [x for x in text.split("\n") if WORDS.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(lines))


def test_measures(odd, documents):
    for docs in (clashing(odd), documents):
        for r in quality_rules.measured(docs, name="m").collect():
            assert tuple(r["m"]) == measures_of(r["text"])


def test_binomial_tail(spark):
    from math import comb, log

    rows = [(n, k) for n in (1, 5, 400, 3000) for k in (0, 1, 3, 11) if k <= n]
    got = spark.createDataFrame(rows, "n long, k long").withColumn("t", quality_rules.log_binomial_tail(F.col("n"), F.col("k"), 0.01))
    for r in got.collect():
        want = sum(comb(r["n"], i) * 0.01**i * 0.99 ** (r["n"] - i) for i in range(r["k"] + 1))
        assert r["t"] == pytest.approx(0.0 if r["k"] >= r["n"] * 0.01 else log(want), abs=1e-8)


def test_cutoffs_reject_few_good_documents(spark):
    words = lambda i, junk: " ".join(f"w{i}x{k}{'###' if k < junk else ''}" for k in range(60))
    rows = [(i, words(i, 0), "en" if i % 2 else None, "s", 1) for i in range(3000)]
    rows += [(5000 + i, words(i, 55), "en", "s", 1) for i in range(40)] + [(9000, words(1, 55), "xx", "s", 1)]
    docs = spark.createDataFrame(rows, DOCUMENTS).repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in range(3000)] + [(1, 1), (5001, 0), (None, 1)], "doc_id long, quality int")
    out, _, kept = quality_rules.judged(clashing(docs), labels)
    got = {r["doc_id"]: r[kept] for r in out.collect()}
    assert all(got[i] for i in range(3000)) and not any(got[5000 + i] for i in range(40))
    assert got[9000]  # no labels in its language, so no cutoff there
    none, _, kept = quality_rules.judged(docs, labels.limit(0))
    assert none.where(F.col(kept)).count() == 3041


def test_rules_fire_in_the_sql_too(spark):
    """Enough labels in two of three languages: rules reject beyond the base, and the SQL says the same row by row."""
    random = np.random.default_rng(12)
    rows = []
    for i in range(1700):
        junk = i % 10 == 3
        words = [f"w{x}" + ("#*" if junk and k % 2 else "") + "longer" * (i % 17 == 5) for k, x in enumerate(random.integers(0, 9999, 60))]
        lines = [" ".join(words[k : k + 6]) for k in range(0, 60, 6)] + ["again and again"] * (5 if i % 13 == 2 else 0)
        rows.append((i, "\n".join(lines), "en" if i < 800 else "de" if i < 1600 else None, "s", 1))
    labels = [(i, int(i % 10 != 3 and i % 13 != 2 and i % 17 != 5)) for i in range(1650)]
    docs, known = spark.createDataFrame(rows, DOCUMENTS).repartition(4), spark.createDataFrame(labels, "doc_id long, quality int")
    out, m, kept = quality_rules.judged(docs, known)
    ours = {r["doc_id"]: (r[kept], r["base"]) for r in out.withColumn("base", quality_rules.base_failed(F.col(m))).collect()}
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("labels", known.toPandas())
    theirs = con.sql(quality_rules.ORACLE_SQL)
    at = {c: k for k, c in enumerate(theirs.columns)}
    assert ours == {r[at["doc_id"]]: (r[at["kept"]], r[at["base_failed"]]) for r in theirs.fetchall()}
    rejected = [i for i, (k, base) in ours.items() if not k and not base]
    assert len(rejected) > 100 and not any(known for i, known in labels if known and i in set(rejected))
    # 459 good labels are enough for one stratum, 458 are not.
    for n, fires in ((458, False), (459, True)):
        clean = [r for r in rows if r[0] % 10 != 3 and r[0] % 13 != 2 and r[0] % 17 != 5][:n]
        few = spark.createDataFrame([(r[0], r[1], "en", r[3], r[4]) for r in clean] + [(9000, " ".join(f"#*#*{k}" for k in range(60)), "en", "s", 1)], DOCUMENTS)
        out, _, kept = quality_rules.judged(few, spark.createDataFrame([(r[0], 1) for r in clean], "doc_id long, quality int"))
        assert {r["doc_id"]: r[kept] for r in out.collect()}[9000] != fires


def test_quality_edge_rows(odd, empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out, m, kept = quality_rules.judged(odd, labels)
    assert out.count() == odd.count() and out.where(F.col(kept).isNull()).count() == 0
    assert out.where(F.col("text").isNull() & F.col(kept)).count() == 0
    assert quality_rules.judged(empty, labels)[0].count() == 0


def test_cotraining(spark, documents, odd, empty):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    assert cotraining.score(empty, cotraining.fit(empty, labels)).count() == 0
    no_labels = cotraining.score(odd, cotraining.fit(odd, labels.limit(0))).collect()
    assert len(no_labels) == odd.count() and all(r["kept"] for r in no_labels)
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = cotraining.fit(clashing(big), known.where("doc_id % 3 <> 0"))
    held = cotraining.score(big, model).join(known.where("doc_id % 3 = 0"), "doc_id").toPandas()
    assert ((held.score > 0.5) == (held.quality == 1)).mean() > 0.95 > 0.5 + (held.quality == 1).mean() / 10
    assert cotraining.score(odd, model).where("score IS NULL OR isnan(score)").count() == 0


def test_cotraining_searches_all_documents(spark):
    """Source "rare" is known from the last of 7,000 unlabelled documents alone, which any bounded pool by hash misses."""
    order = spark.range(1000, 8000).orderBy(F.xxhash64("id", F.lit(cotraining.SEED)), "id").collect()
    rare = {r["id"] for r in order[-100:]}
    text = lambda i, good: f"number {i % 7} of calm words, all of them good. " * 9 if good else f"BUY {i % 7} $$$ !!! " * 9
    rows = [(i, text(i, i % 2), "en", "common", 300) for i in range(200)]
    rows += [(i, text(i, True), "en", "rare", 300) if i in rare else (i, f"plain BUY words {i % 5} $ good", "en", "common", 300) for i in range(1000, 8000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    model = cotraining.fit(spark.createDataFrame(rows, DOCUMENTS), labels)
    assert model.meta[cotraining.LANGS + 1 + zlib.crc32(b"rare") % (cotraining.SOURCES - 1)] > 0


def test_surest_of_the_whole_table(spark):
    random = np.random.default_rng(5)
    x = random.normal(size=(8000, cotraining.TEXT_WIDTH + cotraining.META_WIDTH)).astype(np.float32)
    ids = random.integers(0, 7000, len(x))
    rows = [(int(i), n, bytearray(r.tobytes())) for n, (i, r) in enumerate(zip(ids, x))]
    stored = spark.createDataFrame(rows, "doc_id long, row long, features binary").repartition(7)
    labels = spark.range(0, 7000, 5).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    weights = [random.normal(size=cotraining.TEXT_WIDTH), random.normal(size=cotraining.META_WIDTH)]
    raw = [x[:, : cotraining.TEXT_WIDTH].astype(float) @ weights[0], x[:, cotraining.TEXT_WIDTH :].astype(float) @ weights[1]]
    known, taken = set(range(0, 7000, 5)), set()
    with tables(spark) as own:
        others = cotraining.Unlabelled(stored, labels, own)
        for _ in range(2):
            got, now = others.surest(weights, 0.75), set()
            for v in (0, 1):
                for sign, most in ((-1, 100), (1, 300)):
                    best = {}
                    for s, i, row in sorted(zip(sign * raw[v], ids.tolist(), range(len(ids))), reverse=True):
                        if i not in known | taken and i not in best and s > np.log(9):
                            best[i] = row
                    want = list(best.values())[:most]
                    assert np.array_equal(got[v][0][got[v][1] == (sign > 0)], x[want].astype(float))
                    now |= {int(ids[r]) for r in want}
            taken |= now
            assert others.taken == taken and others.left == len(set(ids.tolist()) - known - taken)


# Dedup


def components_of(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_vectors(spark):
    random = np.random.default_rng(7)
    rows, centre = [], random.standard_normal(24)
    for i in range(300):
        noise = random.standard_normal(24) * (0.08 if i < 120 else 1)
        rows.append((i, [float(np.float32(x)) for x in (centre + noise if i < 120 else noise)], i % 2))
    rows += [(400 + i, rows[3][1], 1) for i in range(30)] + [(500, [2 * x for x in rows[3][1]], 1), (500, [2 * x for x in rows[3][1]], 1)]
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [None, *[1.0] * 23], [float("inf")] * 24]
    rows += [(600 + i, v, 1) for i, v in enumerate(odd)] + [(700, rows[0][1], None), (None, rows[0][1], 0), (701, [1.0], 0), (702, [2.0], 0), (703, [-1.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.linked_vectors(table.withColumn("REP", F.lit(1)).withColumn("n", F.lit(1)))
    usable = {
        i: (np.array(v, np.float32).astype(float), lab) for i, v, lab in rows
        if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)
    }
    ids, links = sorted(usable), []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            (x, p), (y, q) = usable[a], usable[b]
            if p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links.append((a, b))
    degree = Counter(i for link in links for i in link)
    component = components_of([r[0] for r in rows if r[0] is not None], links)
    seen = got.collect()
    assert len(seen) == len(rows)
    for r in seen:
        i = r["vec_id"]
        assert (r["n_links"], r["component_id"], r["kept"]) == (degree[i] if i is not None else 0, component.get(i), i is None or component[i] == i), r
    assert embedding_dedup.linked_vectors(table.limit(0)).count() == 0


def test_double_vectors_are_not_rounded(spark):
    """Values that 32-bit floats cannot tell apart or hold."""
    x = [1.0, 2.0, 3.0]
    rows = [(1, x, 0), (2, [1.0, 2.0, 3.0 + 1e-12], 0), (3, [1e300, 2e300, 3e300], 0), (4, [1e-300, 2e-300, 3e-300], 0), (5, [1e300, -1e300, 0.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.linked_vectors(table).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5)}
    narrow = table.where("vec_id < 3").select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"), "label")
    assert {r["n_links"] for r in embedding_dedup.linked_vectors(narrow).collect()} == {1}


def bags_of(docs):
    return {i: (WORDS.findall(t or "")) for i, t in docs if i is not None}


def near_links(words, least=0.8):
    bags = {i: Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, w in words.items() if w}
    at = defaultdict(set)
    for i, bag in bags.items():
        for g in bag:
            at[g].add(i)
    pairs = {(a, b) for group in at.values() if len(group) < 400 for a in group for b in group if a < b}
    return [(a, b) for a, b in pairs if sum((bags[a] & bags[b]).values()) >= least * sum((bags[a] | bags[b]).values())]


def test_near_duplicates(spark, documents, odd, empty):
    random = np.random.default_rng(8)
    base = [f"w{x}" for x in random.integers(0, 500, 150)]
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    for i in range(60):  # near copies of one text, at all distances around the threshold
        copy = list(base)
        for k in random.integers(0, 150, i % 9):
            copy[k] = f"x{i}"
        rows.append((10_000 + i, " ".join(copy)))
    rows += [(20_000 + i, " \n".join(base)) for i in range(40)] + [(30_000, "na " * 500), (30_001, "na " * 480), (30_002, "na " * 300)]
    rows += [(40_000, "one two"), (40_001, "one\ttwo"), (40_002, "two one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = bags_of(rows)
    want = components_of(words, near_links(words))
    got = bag_minhash.near_duplicates(clashing(docs)).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) and r["n_words"] == len(words[r["doc_id"]]) for r in got)
    assert want[40_000] == want[40_001] != want[40_002] and want[30_000] == want[30_001] != want[30_002]
    out = bag_minhash.near_duplicates(odd).collect()
    assert len(out) == odd.count() and all(r["kept"] and r["class_id"] is None for r in out if r["doc_id"] is None)
    assert all(r["class_id"] == r["doc_id"] for r in out if not r["n_words"] and r["doc_id"] is not None)
    assert bag_minhash.near_duplicates(empty).count() == 0


def test_signatures_are_unbiased():
    a = " ".join(f"w{i}" for i in range(200))
    b = " ".join(f"w{i}" for i in range(30, 230))
    c, d = "x y z q r " * 50 + a, "x y z q r " * 25 + a
    doc, grams, _, _ = bag_minhash._shingles([t.encode() for t in (a, b, c, d)])
    of, key, weight = bag_minhash._bags(doc, grams)
    hits = []
    for turn in range(150):
        s = bag_minhash._signatures(of, bag_minhash._mix(key + np.uint64(turn * 7919 + 1)), weight, 4)
        hits.append([(s[0] == s[1]).mean(), (s[2] == s[3]).mean(), (s[0] == s[2]).mean()])
    for got, (i, j) in zip(np.mean(hits, 0), ((0, 1), (2, 3), (0, 2))):
        both, either = bag_minhash.overlap(np.sort(grams[doc == i]), np.sort(grams[doc == j]))
        assert got == pytest.approx(both / either, abs=0.02)


def test_line_dedup(spark, odd, empty):
    shared, rare = "  this line is everywhere ", "this line is on few sites"
    rows = [(i, f"own text of {i}\n{shared}\nok", "en", f"s{i % 12}", 1) for i in range(24)]
    rows += [(100 + i, f"{rare}\nmore of {i} here", "en", f"s{i % 9}", 1) for i in range(50)]
    rows += [(200, shared.strip(), "en", None, 1), (None, shared, "en", "s1", 1), (201, None, "en", "s1", 1)]
    docs = clashing(spark.createDataFrame(rows, DOCUMENTS))
    out, n = line_dedup.without_boilerplate(docs)
    assert out.columns == [*docs.columns, n]
    for r in out.collect():
        before = next(x[1] for x in rows if x[0] == r["doc_id"])
        if r["doc_id"] in (0, 201) or (r["doc_id"] or 0) in range(100, 200):
            assert r["text"] == before and r[n] == 0
        else:
            gone = {shared.strip(), "ok"}
            assert r["text"] == "\n".join(x for x in before.split("\n") if x.strip() not in gone) and r[n] == (2 if r["doc_id"] and r["doc_id"] < 100 else 1)
    for docs in (odd, empty):
        assert line_dedup.without_boilerplate(docs)[0].count() == docs.count()


def test_short_shared_lines(spark):
    """The pipeline's stage looks at lines of every length that have a word; lines without one stay."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, f"own text of {i}\n\nLes. \n \t\nAnd ornd.\n\nend of {i}", "en", f"s{i % 12}", 1) for i in range(24)]
    rows += [(100 + i, f"rare\nmore of {i} here", "en", f"s{i % 9}", 1) for i in range(20)]
    got = {r["doc_id"]: r["text"] for r in pipeline.drop_shared_lines(spark, spark.createDataFrame(rows, DOCUMENTS), "").collect()}
    for i, text, *_ in rows:
        gone = () if i == 0 or i >= 100 else ("Les.", "And ornd.")
        assert got[i] == "\n".join(x for x in text.split("\n") if x.strip() not in gone)


# Mixing


def test_permutations():
    for n in (1, 2, 3, 5, 64, 1000):
        for key in range(3):
            assert sorted(mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key))) == list(range(n))


def test_permutation_leaves_places_outside_alone():
    """Spark evaluates the permutation for all rows, also for the short block at the end of a source."""
    for n in range(1, 40):
        for key in range(20):
            for place in (-1, n, n + 1, 2 * n + 7):
                assert mixing.permuted(np.array([place]), np.array([n]), np.array([key])).tolist() == [place]


def test_mix_of_many_small_sources(spark):
    """Fifty sources of 1 to 12 blocks of the production size, most with a short last block."""
    rows = [(100 * s + b, " ".join(["w"] * (512 if b < s % 12 else 1 + 37 * s % 511)), "en", f"s{s:02}", 1) for s in range(50) for b in range(s % 12 + 1)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    with tables(spark) as own:
        parts = mixing.mix(docs, own)
        got = mixing.taken_per_document(parts).collect()
        # Blocks that one epoch takes of a source are different ones.
        slots = parts.slots.groupBy("idx", "epoch", "block").count().where("count > 1").count()
    assert slots == 0 and len(got) == len(rows)
    taken, target = Counter(), {}
    for r in got:
        s = r["doc_id"] // 100
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)


def test_draws_down_the_tree(spark):
    """Sources get slots in proportion, each shard is filled, and the tree has several levels."""
    quota = spark.range(5000).select(F.col("id").alias("idx"), F.when(F.col("id") == 4321, 50_000).otherwise(20).cast("long").alias("k_all"))
    with tables(spark) as own:
        drawn, shards = mixing.shard_draws(quota, own, 1)
        rows = drawn.collect()
        again = mixing.shard_draws(quota.repartition(7), own, 1)[0].collect()
    assert sorted(rows) == sorted(again) and shards == -(-(4999 * 20 + 50_000) // mixing.SLOTS)
    per_shard, per_source = Counter(), Counter()
    for r in rows:
        per_shard[r["shard"]] += r["n"]
        per_source[r["idx"]] += r["n"]
    assert set(per_shard.values()) == {mixing.SLOTS} and len(per_shard) == shards
    assert abs(per_source[4321] - 50_000) < 1500 and abs(sum(per_source[i] for i in range(2500)) - 50_000) < 1500


def test_mix(spark, documents, odd, empty):
    for docs in (documents, odd, empty):
        with tables(spark) as own:
            rows = mixing.taken_per_document(mixing.mix(docs, own, block=64)).collect()
        if docs is odd:
            with tables(spark) as own:
                again = mixing.taken_per_document(mixing.mix(docs.repartition(5), own, block=64)).collect()
            assert Counter(rows) == Counter(again)
        assert len(rows) == docs.count()
        source = {(r["doc_id"], r["source"]) for r in docs.select("doc_id", "source").collect()}
        size = Counter()
        for r in docs.collect():
            size[r["source"]] += len(WORDS.findall(r["text"] or ""))
        order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        target, full = {}, set()
        while len(target) < len(order):
            left = sum(size.values()) - sum(3 * size[s] for s in full)
            share = left / max(1, sum(weight[s] for s in order if s not in full))
            more = {s for s in order if s not in full and weight[s] * share > 3 * size[s]}
            if not more:
                target = {s: 3 * size[s] if s in full else weight[s] * share for s in order}
            full |= more
        taken = Counter()
        of = {i: s for i, s in source}
        for r in rows:
            assert r["taken"] <= 3 * r["size"] and r["target"] == pytest.approx(target[of[r["doc_id"]]])
            taken[of[r["doc_id"]]] += r["taken"]
        assert all(abs(taken[s] - target[s]) <= 1 for s in order)


def test_mixed_documents(spark, documents, odd):
    docs = clashing(odd.unionByName(documents))
    with tables(spark) as own:
        parts = mixing.mix(docs, own, block=64)
        out = mixing.mixed_documents(docs, parts)
        rows, words = out.collect(), sum(r["taken"] for r in mixing.taken_per_document(parts).collect())
    assert out.columns == docs.columns
    assert sum(len(WORDS.findall(r["text"])) for r in rows) == words
    texts = defaultdict(set)
    for r in docs.collect():
        texts[r["doc_id"]].add(r["text"])
    for r in rows:
        assert r["n_chars"] == len(r["text"])
        assert any(t and set(WORDS.findall(r["text"])) <= set(WORDS.findall(t)) for t in texts[r["doc_id"]])


# Pipeline


def test_pipeline(spark, odd, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = clashing(odd).withColumn("text", F.concat_ws(" ", "text", F.lit(" ".join(f"word{i}" for i in range(60)))))
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    now = docs
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, now, folder)
        if k < len(pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
            out.write.parquet(f"{folder}/{name}")
            now = spark.read.parquet(f"{folder}/{name}")
    assert all(r["round_trip"] for r in out.collect())
    done = pipeline.run(spark, SMALL).collect()
    assert done and all(r["round_trip"] and r["n_tokens"] > 0 for r in done)


def test_pipeline_stages_against_brute_force(spark, documents):
    pipeline = pytest.importorskip("corpus_pipeline")
    kept = pipeline.keep_good(spark, documents, SMALL)
    assert {r[0] for r in kept.select("doc_id").collect()} == {
        r["doc_id"] for r in QUERIES["op9_quality_rules"](spark, SMALL).where("kept").collect()
    }
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    words = bags_of(rows)
    want = components_of(words, near_links(words))
    got = pipeline.drop_near_copies(spark, kept.unionAll(kept.limit(5)), SMALL).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, c in want.items() if i == c)
