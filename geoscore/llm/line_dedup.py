"""Removal of lines that many sites share.

A line's key is two hashes of the line without its outer white space. For every key a HyperLogLog sketch of the sites is
built in each task and merged by the aggregation. A key whose estimate is clearly over or under the threshold is decided
by it; keys near the threshold get an exact count of distinct sites. A line of enough sites is boilerplate: it stays in
its home, the document of the smallest id that holds it, and goes from all others, so nothing is lost from the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from geoscore.llm.common import SPACES, fresh
from geoscore.session import store_once

MIN_SITES = 10
MIN_WORDS = 1
SKETCH_BITS = 12


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES))


def _is_long(trimmed: Column, min_words: int) -> Column:
    # A line without a word splits into one empty part.
    return (trimmed != "") & (F.size(F.split(trimmed, r"[\x20\x09-\x0D]+")) >= min_words)


def _keyed(docs: DataFrame, key: str, text: str, site: str, min_words: int) -> DataFrame:
    """One row per line of enough words: document, hash of its text, site, and the line's key."""
    lines = docs.select(
        F.col(key).alias("doc"), F.xxhash64(text).alias("t"), F.coalesce(F.col(site), F.lit("\0")).alias("site"),
        F.explode(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), _trimmed)).alias("line"),
    ).where(_is_long(F.col("line"), min_words))
    return lines.select("doc", "t", "site", F.xxhash64("line").alias("a"), F.xxhash64("line", F.lit(1)).alias("b"))


def boilerplate(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source",
                min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """Keys ``a, b`` of the lines of at least ``min_sites`` sites, and their ``home`` document."""
    lines = _keyed(docs, key, text, site, min_words)
    found = store_once(
        lines.groupBy("a", "b").agg(
            F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_BITS))).alias("about"), F.min("doc").alias("home"),
            F.count(F.lit(1)).alias("n"),
        ).where(F.col("n") >= min_sites).drop("n"), "line-sketches",
    )
    # Five standard errors of the sketch, and one site.
    margin = 1 + 5 * 1.04 / math.sqrt(1 << SKETCH_BITS) * min_sites
    near = found.where(F.abs(F.col("about") - min_sites) <= margin)
    exact = (
        lines.select("a", "b", "site").join(near.select("a", "b", "home"), ["a", "b"])
        .select("a", "b", "home", "site").distinct().groupBy("a", "b", "home").agg(F.count(F.lit(1)).alias("sites"))
        .where(F.col("sites") >= min_sites).drop("sites")
    )
    return found.where(F.col("about") > min_sites + margin).select("a", "b", "home").unionByName(exact.select("a", "b", "home"))


def without_boilerplate(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source",
                        min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> tuple[DataFrame, str]:
    """``docs`` with the lines removed from ``text``, and the name of a column that counts the lines removed.

    Lines of fewer than ``min_words`` words never go (1, the default: only lines without a word stay whatever they are). A null site is a site of its own. A text that loses nothing stays
    as it is, a null text null; one that loses all its lines becomes empty. A null key is nobody's home, and a line that
    only documents with null keys hold stays. Rows repeated with one key lose the same lines.
    """
    common = store_once(boilerplate(docs, key, text, site, min_sites, min_words), "boilerplate")
    lines = _keyed(docs, key, text, site, min_words).select("doc", "t", "a", "b")
    hits = (
        lines.join(common.withColumnsRenamed({"a": "_a", "b": "_b"}), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")))
        .where(F.col("home").isNotNull() & ~F.col("doc").eqNullSafe(F.col("home")))
        .groupBy("doc", "t").agg(F.collect_set("a").alias("gone"))
    )
    gone, n, mark = fresh(docs, "_gone"), fresh(docs, "n_removed"), fresh(docs, "_t")
    named = hits.select(F.col("doc").alias("_doc_of_hit"), F.col("t").alias(mark), F.col("gone").alias(gone))
    joined = docs.join(named, docs[key].eqNullSafe(named["_doc_of_hit"]) & (F.xxhash64(docs[text]) == named[mark]), "left")
    all_lines = F.split(docs[text], "\n")
    stays = F.filter(all_lines, lambda x: ~(F.array_contains(F.col(gone), F.xxhash64(_trimmed(x))) & _is_long(_trimmed(x), min_words)))
    kept = F.when(F.col(gone).isNull(), docs[text]).otherwise(F.array_join(stays, "\n"))
    removed = F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(all_lines) - F.size(stays))
    return joined.select(
        *[kept.alias(c) if c == text else docs[c] for c in docs.columns], removed.cast("long").alias(n)
    ), n


ORACLE_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, i, x, trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
  FROM (SELECT doc_id, source, unnest(range(1, CAST(len(l) + 1 AS BIGINT))) AS i, unnest(l) AS x
        FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents))
), long AS (SELECT *, len(regexp_extract_all(k, '[^\\x20\\x09-\\x0D]+')) >= {MIN_WORDS} AS ok FROM lines),
common AS (
  SELECT k, min(doc_id) AS home FROM long WHERE ok
  GROUP BY k HAVING count(DISTINCT coalesce(source, chr(0))) >= {MIN_SITES}
), marked AS (
  SELECT long.*, ok AND home IS NOT NULL AND home <> doc_id AS gone FROM long LEFT JOIN common USING (k)
), texts AS (
  SELECT doc_id, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT coalesce(gone, false)), '') AS text,
         count(*) FILTER (gone) AS n_removed FROM marked GROUP BY doc_id
)
SELECT doc_id, n_removed, length(text) AS n_chars, md5(text) AS text_md5 FROM texts
"""
