"""Quality rules whose cutoffs are chosen so that few good documents are rejected, with a stated certainty.

Rules and candidate cutoffs are fixed beforehand. For every stratum, rule and cutoff, the good documents of a labelled
holdout that the cutoff would reject are counted; the exact binomial test says whether the true share of good documents
rejected is below ``limit``. The cutoffs of a rule are nested, so they are tested in a fixed order, from the most lenient
on, and the first that fails ends the rule; only rules and strata share ``error`` evenly (Bonferroni). So with probability
1 - ``error`` no chosen cutoff in any stratum rejects more than ``limit`` of that stratum's good documents. Of the cutoffs
that pass, the strictest is used; a rule without one is off in that stratum. Everything is a DataFrame expression.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from geoscore.llm.common import SPACES, fresh
from geoscore.session import store_once

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


class Rule(NamedTuple):
    """Rejects if ``1000 * above > cutoff * below``; every cutoff is tested, the smallest that passes is used."""

    name: str
    above: str
    below: str
    cutoffs: tuple[int, ...]


RULES = (
    Rule("symbols", "n_symbols", "word_chars", (20, 50, 100, 150, 200, 300)),
    Rule("dup_lines", "n_dup_lines", "n_lines", (100, 200, 300, 400, 500)),
    Rule("repeats", "n_repeat_words", "n_words", (100, 200, 300, 400)),
    Rule("long_words", "word_chars", "n_words", (8000, 9000, 10000, 12000, 15000)),
    Rule("short_words", "n_words", "word_chars", (250, 300, 400, 500)),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def measured(docs: DataFrame, text: str = "text", name: str = "measures") -> DataFrame:
    """Adds a struct of counts over the whole text (null: no words).

    Repeated three-word windows are found by sorting the hashes of all windows of the text, so a long text costs no
    more than its sort.
    """
    whole, words, lines, windows, ordered, starts = (
        fresh(docs, f"_{name}_{x}") for x in ("text", "words", "lines", "windows", "ordered", "starts")
    )
    word_at = lambda i, k: F.get(F.col(words), i + k)
    same = lambda i, k: F.get(F.col(ordered), i)["h"] == F.get(F.col(ordered), i + k)["h"]
    n_windows = F.size(words) - 2
    no_word = F.translate(F.col(whole), SPACES, "")
    out = (
        docs.withColumn(whole, F.coalesce(F.col(text), F.lit("")))
        .withColumn(words, F.filter(F.split(whole, r"[\x20\x09-\x0D]+"), lambda x: x != ""))
        .withColumn(lines, F.filter(F.split(whole, "\n"), lambda x: F.translate(x, SPACES, "") != ""))
        .withColumn(windows, F.when(n_windows > 0, F.transform(
            F.sequence(F.lit(0), n_windows - 1), lambda i: F.xxhash64(word_at(i, 0), word_at(i, 1), word_at(i, 2)),
        )).otherwise(F.array().cast("array<bigint>")))
        # Most texts repeat no window; only the others are sorted.
        .withColumn(ordered, F.when(
            F.size(F.array_distinct(windows)) < F.size(windows),
            F.sort_array(F.transform(F.col(windows), lambda h, i: F.struct(h.alias("h"), i.alias("at")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,at:int>>")))
        .withColumn(starts, F.sort_array(F.transform(
            F.filter(F.col(ordered), lambda x, i: F.coalesce(same(i, -1), F.lit(False)) | F.coalesce(same(i, 1), F.lit(False))),
            lambda x: x["at"],
        )))
    )
    # Each window adds the words that the window before it did not cover.
    covered = F.aggregate(
        F.col(starts), F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, at: F.struct(at.alias("last"), (a["n"] + F.least(F.lit(3), at - a["last"])).alias("n")), lambda a: a["n"],
    )
    counts = {
        "n_words": F.size(words),
        "word_chars": F.char_length(no_word),
        "n_symbols": F.char_length(whole) - F.char_length(F.translate(F.col(whole), SYMBOLS, "")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": covered,
        "n_lines": F.size(lines),
    }
    struct = F.struct(*[c.cast("long").alias(k) for k, c in counts.items()])
    return out.withColumn(name, struct).drop(whole, words, lines, windows, ordered, starts)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def _fires(rule: Rule, m: Column, cutoff: Column) -> Column:
    return 1000 * m[rule.above] > cutoff * m[rule.below]


def _log_factorial(x: Column) -> Column:
    z = x.cast("double") + 1
    far = z + 10
    shift = sum((F.log(z + k) for k in range(1, 10)), F.log(z))
    return (
        (far - 0.5) * F.log(far) - far + 0.5 * math.log(2 * math.pi) + 1 / (12 * far) - 1 / (360 * F.pow(far, 3))
        + 1 / (1260 * F.pow(far, 5)) - shift
    )


def log_binomial_tail(n: Column, k: Column, p: float) -> Column:
    """Logarithm of the chance of at most ``k`` successes in ``n`` tries; 0 where ``k`` is not below the mean.

    Terms below the largest one shrink from one to the next; those over twelve standard deviations away add nothing
    that a double can hold.
    """
    top = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    reach = F.least(k, F.ceil(12 * F.sqrt(n * p * (1 - p))) + 60).cast("int")
    sum_ = F.aggregate(
        F.sequence(F.lit(0), F.greatest(reach - 1, F.lit(0))),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, j: F.struct(
            (a["term"] * (k - j) / (n - k + j + 1) * ((1 - p) / p)).alias("term"),
            (a["sum"] + a["term"] * (k - j) / (n - k + j + 1) * ((1 - p) / p)).alias("sum"),
        ),
        lambda a: a["sum"],
    )
    return F.when(k >= n * p, F.lit(0.0)).otherwise(top + F.log(sum_))


def cutoffs(holdout: DataFrame, stratum: str, measures: str = "measures", rules: tuple[Rule, ...] = RULES,
            limit: float = 0.01, error: float = 0.05) -> DataFrame:
    """One row per stratum: the strictest cutoff of each rule that passes its test, or null.

    ``holdout`` holds the good documents of the labelled rows, measured. Documents that the base rules reject anyway do
    not count. A null stratum is a stratum of its own; one without labels has no row.
    """
    m = F.col(measures)
    candidates = [(rule, c) for rule in rules for c in rule.cutoffs]
    fired = [F.count(F.when(_fires(rule, m, F.lit(c)), 1)).alias(f"k{i}") for i, (rule, c) in enumerate(candidates)]
    counted = holdout.where(~base_failed(m)).groupBy(F.col(stratum).alias("stratum")).agg(
        F.count(F.lit(1)).alias("n"), *fired
    )
    # One row holds the number of strata; each rule in each of them gets an even share of the error.
    tests = counted.agg((F.count(F.lit(1)) * len(rules)).alias("tests"))
    rows = F.explode(F.array(*[
        F.struct(F.lit(rule.name).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"k{i}").alias("k"))
        for i, (rule, c) in enumerate(candidates)
    ]))
    tested = counted.crossJoin(F.broadcast(tests)).select("stratum", "n", "tests", rows.alias("r")).select(
        "stratum", F.col("r.rule").alias("rule"), F.col("r.cutoff").alias("cutoff"),
        (log_binomial_tail(F.col("n"), F.col("r.k"), limit) <= math.log(error) - F.log("tests")).alias("passes"),
    )
    # A more lenient cutoff rejects no more, so it passes wherever a stricter one does: the order never stops before it.
    chosen = [F.min(F.when((F.col("rule") == x.name) & F.col("passes"), F.col("cutoff"))).alias(x.name) for x in rules]
    return tested.groupBy("stratum").agg(*chosen)


def verdicts(docs: DataFrame, chosen: DataFrame, stratum: str, measures: str = "measures",
             rules: tuple[Rule, ...] = RULES, kept: str = "kept") -> DataFrame:
    """Adds ``kept``: not rejected by the base rules, nor by a rule at its stratum's cutoff."""
    named = chosen.select(F.col("stratum").alias("_of"), F.struct(*[x.name for x in rules]).alias("_cutoffs"))
    joined = docs.join(named, docs[stratum].eqNullSafe(named["_of"]), "left")
    m = F.col(measures)
    rejected = base_failed(m)
    for rule in rules:
        rejected = rejected | F.coalesce(_fires(rule, m, named["_cutoffs"][rule.name]), F.lit(False))
    return joined.withColumn(kept, ~rejected).drop("_of", "_cutoffs")


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", key: str = "doc_id", text: str = "text",
           limit: float = 0.01, error: float = 0.05, keep_text: bool = True) -> tuple[DataFrame, str, str]:
    """``docs`` with a struct of measures and a kept flag, and the names of the two columns.

    ``labels`` has ``key`` and ``quality`` (1: good). The measures are worked out once and written to the shared folder, with
    the other columns; ``keep_text=False`` leaves out the text.
    Null texts have no words and fail; null or unlabelled keys are judged like all others but are not in the holdout;
    repeated rows get the same verdict; an empty table gives an empty table.
    """
    measures, kept = fresh(docs, "measures"), fresh(docs, "kept")
    found = measured(docs, text, measures)
    stored = store_once(found if keep_text else found.drop(text), "measured")
    good = labels.where(F.col("quality") == 1).select(F.col(key).alias("_good")).where(F.col("_good").isNotNull())
    holdout = stored.select(key, stratum, measures).join(good, F.col(key) == F.col("_good"), "left_semi")
    # Stored, so Spark knows its size before the join and does not shuffle the texts by stratum.
    chosen = store_once(cutoffs(holdout, stratum, measures, limit=limit, error=error), "cutoffs")
    return verdicts(stored, chosen, stratum, measures, kept=kept), measures, kept


def _oracle(limit: float = 0.01, error: float = 0.05) -> str:
    candidates = [(rule, c) for rule in RULES for c in rule.cutoffs]
    rows = ", ".join(
        f"{{'rule': '{r.name}', 'cutoff': {c}, 'k': count(*) FILTER (1000 * {r.above} > {c} * {r.below})}}"
        for r, c in candidates
    )
    tail = (
        f"list_sum(list_transform(range(0, CAST(k + 1 AS BIGINT)), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) "
        f"- lgamma(n - i + 1) + i * ln({limit}::DOUBLE) + (n - i) * ln(1 - {limit}::DOUBLE))))"
    )
    chosen = ", ".join(f"min(cutoff) FILTER (rule = '{r.name}' AND passes) AS c_{r.name}" for r in RULES)
    fires = " OR ".join(f"coalesce(1000 * {r.above} > c_{r.name} * {r.below}, false)" for r in RULES)
    return f"""
WITH w AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents
), g AS (
  SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) - 1 AS BIGINT))) AS i FROM w WHERE len(w) >= 3)
), again AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY 1
), m AS (
  SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines
  FROM w LEFT JOIN covered USING (doc_id)
), f AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m
), counted AS (
  SELECT lang, count(*) AS n, [{rows}] AS r FROM f
  WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY lang
), flat AS (
  SELECT lang, n, (SELECT count(*) * {len(RULES)} FROM counted) AS tests, unnest(r, recursive := true) FROM counted
), tested AS (
  SELECT lang, rule, cutoff, CASE WHEN k >= n * {limit} THEN false ELSE {tail} <= {error} / tests END AS passes FROM flat
), chosen AS (SELECT lang, {chosen} FROM tested GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR {fires}) AS kept
FROM f LEFT JOIN chosen ON f.lang IS NOT DISTINCT FROM chosen.lang
"""


ORACLE_SQL = _oracle()
