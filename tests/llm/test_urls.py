"""URL rules against brute force."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from geoscore.llm import url_filter
from geoscore.llm.queries import QUERIES

PAGES = "page_id long, url string"
ODD = [
    None, "", "no scheme", "http://", "://", "http://org", "http://org/", "http://ORG/x", "https://a.b.Example.org/en/1", "http://example.org/en/12",
    "http://example.org/en/", "http://xexample.org/es/", "http://example.org/es", "http://example.org/ES/", "http://example.org./es/x", "http://org.:80/",
    "ftp://x.com/fr/de/", "http://x.com/de/#/fr/", "http://x.com?/fr/", "http://x.com#/fr/", "http://com/fr/", "http://.com/fr/", "http://..com/fr/",
    "http://a\nb.org/x\ny", "http://ÉCOLE.org/é", "http://user@x.com/fr/", "x://y://z.org/", "http://😀.com/fr/😀",
    "http://" + "a." * 20_000 + "com/fr/" + "x" * 100_000, "http://com/" + "/" * 50_000,
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.split(c)[0]
    return "".join(x.lower() if x.isascii() else x for x in host), path


def verdict(url, rules, default="allow"):
    host, path = parts(url)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (max(fits)[2:] if fits else (None, default))


@pytest.mark.parametrize("small", [url_filter.SMALL_LIST, 0])
def test_odd_urls(spark, small):
    rows = [(i, u, "own", "own", i) for i, u in enumerate(ODD)] + [(3, "http://a.org/", "own", "own", 1)] * 5 + [(None, "http://a.org/", None, None, None)]
    pages = spark.createDataFrame(rows, PAGES + ", HOST string, judged string, _head long").repartition(4)
    rules = [*url_filter.RULES, ("a.b.example.org", "", "allow"), ("éCOLE.org", "/é", "block")]
    table = url_filter.rule_table(spark, [*rules, (None, "/", "block"), ("", "/", "block"), ("com", "fr", "block"), ("com", "/", None), ("com", "/", "odd")])
    out = url_filter.judged(pages, table, small=small)
    assert out.columns[:5] == pages.columns
    h, p, v = out.columns[-3:]
    lowered = [("".join(x.lower() if x.isascii() else x for x in h), p, v) for h, p, v in rules]
    want = Counter((r[0], r[1], *parts(r[1]), *verdict(r[1], lowered)) for r in rows)
    assert Counter((r["page_id"], r["url"], r[h], r[p], r[v]["rule"], r[v]["verdict"]) for r in out.collect()) == want
    assert url_filter.judged(pages.limit(0), table).count() == 0


def test_no_rules_and_repeated_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, None)], PAGES)
    none = url_filter.judged(pages, url_filter.rule_table(spark, [("b.org", "/", "allow")]).limit(0), default="block")
    assert [r["judged"].asDict() for r in none.collect()] == [{"rule": None, "verdict": "block"}] * 2
    both = url_filter.judged(pages, url_filter.rule_table(spark, [("org", "/", "allow"), ("ORG", "/", "block"), ("org", "/", "allow")]))
    assert {r["page_id"]: r["judged"]["verdict"] for r in both.collect()} == {1: "block", 2: "allow"}


def test_many_rules(spark):
    """A list beyond the broadcast bound, with one url of a third of all rows, cut into pieces."""
    rules = [(f"h{i % 40}.net", "/" + "ab"[i % 2] * (i % 5), "allow" if i % 3 else "block") for i in range(200)] + [("net", "/", "block")]
    urls = [f"http://{'w.' * (i % 3)}h{i % 50}.net/{'ab'[i % 2] * (i % 7)}" for i in range(400)] + ["http://h1.net/bb"] * 200
    pages = spark.createDataFrame(list(enumerate(urls)), PAGES)
    got = url_filter.judged(pages, url_filter.rule_table(spark, rules), small=10)
    best = {}
    for h, p, v in rules:
        best[h, p] = max(best.get((h, p), ""), v)
    rules = [(h, p, v) for (h, p), v in best.items()]
    for r in got.collect():
        assert (r["judged"]["rule"], r["judged"]["verdict"]) == verdict(r["url"], rules), r


def test_query_on_the_test_table(spark):
    rows = QUERIES["op11_url_filter"](spark, SMALL).join(spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url"), "page_id").collect()
    assert len(rows) == spark.read.parquet(f"{SMALL}/pages.parquet").count()
    for r in rows:
        assert ((r["host"], r["path"]), (r["rule"], r["verdict"])) == (parts(r["url"]), verdict(r["url"], url_filter.RULES))
    assert len({r["rule"] for r in rows}) > 3
