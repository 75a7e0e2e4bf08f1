"""URL rules by expressions: host suffixes times path prefixes, met by short hash prefixes and confirmed by full digests.

A rule names a host and the beginning of a path. A url fits it if the rule's host is the url's host or one of its parent
domains and the url's path begins with the rule's. So a url fits a rule exactly if one of the url's expressions, a suffix
of its host followed by a prefix of its path, equals the rule's text. Which suffixes (in labels) and prefixes (in
characters) can meet a rule is read off the rules; each url is expanded into those alone, however long it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from geoscore.llm.common import fresh
from geoscore.operators.skew import attach

SHORT = 8  # hexadecimal digits of a digest that are joined on
SMALL_LIST = 100_000  # rules that are broadcast; a longer list is shuffled
LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# The rules that the registered query judges by.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def _lowered(column: Column) -> Column:
    return F.translate(column, *LETTERS)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and for a url without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return _lowered(F.regexp_extract(rest, r"^[^/?#]*", 0)), path


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules as a table: host, path, verdict."""
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _labels(host: Column) -> Column:
    return F.char_length(host) - F.char_length(F.replace(host, F.lit("."))) + 1


def prepared(rules: DataFrame) -> DataFrame:
    """Usable rules, one per text: ``rule``, ``verdict``, ``digest``, ``short`` and the expression's ``labels`` and ``chars``.

    Hosts are lower-cased. A rule without host or verdict, or whose path is neither empty nor begins with ``/``, fits
    nothing and is left out; a null path is empty. Of rules of one text with different verdicts, block holds.
    """
    host, path = _lowered(F.col("host")), F.coalesce("path", F.lit(""))
    usable = rules.where(
        (F.coalesce("host", F.lit("")) != "") & F.col("verdict").isin("allow", "block") & ((path == "") | path.startswith("/"))
    )
    return usable.select(
        F.concat(host, path).alias("rule"), "verdict", _labels(host).alias("labels"), F.char_length(path).alias("chars"),
    ).groupBy("rule", "labels", "chars").agg(F.max("verdict").alias("verdict")).withColumn(
        "digest", F.sha2("rule", 256)
    ).withColumn("short", F.left("digest", F.lit(SHORT)))


def judged(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", small: int = SMALL_LIST) -> DataFrame:
    """``pages`` with three more columns, named in a way that clashes with none: host, path, and a struct (rule, verdict).

    The rule with the longest text that fits wins (of equally long ones, the one with the longer host; two different rules
    that fit cannot have both alike). A url that no rule fits has a null rule and the verdict ``default``; so have a null,
    an empty and a malformed url, whose host and path are empty. Repeated rows are each judged. The columns' names are
    ``judged(...).columns[-3:]``.

    Urls are first counted by host and by as much of the path as the longest rule looks at; only those heads are
    expanded. A list of up to ``small`` rules, counted first, is broadcast; a longer one is joined by shuffle, where a
    frequent expression is one row per head. A head of very many urls is cut into pieces when verdicts go back.
    """
    known = prepared(rules)
    n_rules, longest = known.agg(F.count(F.lit(1)), F.coalesce(F.max("chars"), F.lit(0))).first()
    # One row of the distinct (labels, characters) that rules have: what a url can be asked for.
    shapes = known.select("labels", "chars").distinct().agg(F.collect_list(F.struct("labels", "chars")).alias("shapes"))
    host, path = host_and_path(F.col(url))
    # The caller's columns travel as one struct, so none of their names can clash with the working columns.
    rows = pages.select(F.struct(*pages.columns).alias("row"), host.alias("_host"), path.alias("_path")).withColumn(
        "_head", F.left("_path", F.lit(longest)) if longest else F.lit("")
    )
    heads = rows.groupBy("_host", "_head").agg(F.count(F.lit(1)).alias("_n"))
    fitting = F.filter("shapes", lambda s: (s["labels"] <= _labels(F.col("_host"))) & (s["chars"] <= F.char_length("_head")))
    # Hosts are cut from the right, so a suffix is counted in labels; an empty host has no expression.
    expanded = heads.where("_host <> ''").crossJoin(F.broadcast(shapes)).select(
        "_host", "_head", F.explode(fitting).alias("s")
    ).select(
        "_host", "_head", F.length(F.expr("substring_index(_host, '.', -s.labels)")).alias("_from_host"),
        F.sha2(F.concat(F.expr("substring_index(_host, '.', -s.labels)"), F.expr("left(_head, s.chars)")), 256).alias("_digest"),
    ).withColumn("short", F.left("_digest", F.lit(SHORT)))
    rule_side = known.select("short", "digest", "rule", "verdict")
    if n_rules <= small:
        met = expanded.join(F.broadcast(rule_side), "short")
    else:
        met = attach(expanded, rule_side, ["short"], how="inner")
    best = met.where("digest = _digest").groupBy("_host", "_head").agg(F.max_by(
        F.struct("rule", "verdict"), F.struct(F.char_length("rule"), F.col("_from_host"), F.col("rule"))
    ).alias("found"))
    # Heads without a rule stay out of the table that is attached, but keep their urls.
    out = attach(rows, heads.join(best, ["_host", "_head"]), ["_host", "_head"], count="_n")
    return out.select(
        "row.*", F.col("_host").alias(fresh(pages, "host")), F.col("_path").alias(fresh(pages, "path")),
        F.struct(F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit(default)).alias("verdict")).alias(fresh(pages, "judged")),
    )


ORACLE_SQL = """
WITH rules(rule_host, rule_path, verdict) AS (
    VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
           ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), cut AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
    SELECT row_number() OVER () AS r, page_id,
           translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM cut
), best AS (
    SELECT r, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
           arg_max(verdict, length(rule_host || rule_path)) AS verdict
    FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY r
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (r)
"""
