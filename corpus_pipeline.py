"""From raw documents to token ids: quality rules, line dedup, near-dedup, source mixing, BPE.

Each stage takes the session, the documents that the stage before kept, and the folder of the tables; all but the last
give the columns of documents back.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from geoscore.llm import bag_minhash, bpe, line_dedup, mixing, quality_rules
from geoscore.llm.common import SPACES, fresh, table, tables
from geoscore.session import store_once

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    judged, _, kept = quality_rules.judged(docs, table(spark, sf_dir, "labels"))
    return judged.where(judged[kept]).select(*docs.columns)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of many sites go from all documents but their home; a document that loses all its words goes."""
    # Shared menu lines are mostly short, so lines of any length with a word count.
    out, n = line_dedup.without_boilerplate(docs, min_words=1)
    changed = F.col(n) > 0
    left = out.where(~(changed & (F.translate("text", SPACES, "") == "")))
    return left.withColumn("n_chars", F.when(changed, F.char_length("text")).otherwise(F.col("n_chars")).cast(
        docs.schema["n_chars"].dataType
    )).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    classes = bag_minhash.near_duplicates(docs, least=0.8)
    ids = classes.where(F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    turn = fresh(docs, "_turn")
    # Of rows repeated with one id, the first by content stays.
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    one_each = docs.join(ids, "doc_id", "left_semi").withColumn(turn, first).where(F.col(turn) == 1).drop(turn)
    return one_each.unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: again for each further epoch, cut where a block is not taken."""
    with tables(spark) as own:
        return mixing.mixed_documents(docs, mixing.mix(docs, own))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers), and whether they decode to the text."""
    out = bpe.encode(docs, TOKENIZER, ids="ids", decoded="decoded")
    return out.select(
        "doc_id", "lang", "source", "n_chars", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_good),
    ("line_dedup", drop_shared_lines),
    ("near_dedup", drop_near_copies),
    ("source_mix", mix_sources),
    ("bpe", encode),
]

# The mix is drawn from a pseudorandom generator, which SQL cannot repeat; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store_once(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
