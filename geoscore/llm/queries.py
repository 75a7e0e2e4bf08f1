"""One query per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from geoscore.llm import (
    bag_minhash, bpe, cotraining, embedding_dedup, id_files, line_dedup, main_text, merkle, mixing, quality_rules,
    spelling, token_counts, url_filter,
)
from geoscore.llm.common import table, tables
from geoscore.session import scratch_path

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), BYTE_BPE, limit=1024)


@query
def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), BYTE_BPE)


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    rows, measures, kept = quality_rules.judged(docs, table(spark, sf_dir, "labels"), keep_text=False)
    m = rows[measures]
    return rows.select(
        "doc_id", *[m[c].alias(c) for c in quality_rules.MEASURES if c != "n_lines"],
        quality_rules.base_failed(m).alias("base_failed"), rows[kept].alias("kept"),
    )


ORACLES["op9_quality_rules"] = quality_rules.ORACLE_SQL


@query
def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


@query
def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.linked_vectors(table(spark, sf_dir, "embeddings"), least=0.98)


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out, n = line_dedup.without_boilerplate(docs)
    return out.select("doc_id", F.col(n).alias("n_removed"), F.char_length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


ORACLES["op2_line_dedup"] = line_dedup.ORACLE_SQL


@query
def op5_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_minhash.near_duplicates(table(spark, sf_dir, "documents"), least=0.8)


@query
def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    with tables(spark) as own:
        parts = mixing.mix(table(spark, sf_dir, "documents"), own)
        return mixing.taken_per_document(parts)


@query
def op6_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "id-files")
    id_files.write(table(spark, sf_dir, "documents"), path, WORD_BPE, end_id=2, vocabulary=49_408)
    return id_files.document_digests(spark, path)


@query
def op8_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return cotraining.score(docs, cotraining.fit(docs, table(spark, sf_dir, "labels")))


@query
def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rows = url_filter.judged(pages, url_filter.rule_table(spark, url_filter.RULES))
    host, path, verdict = (rows[c] for c in rows.columns[-3:])
    return rows.select(
        "page_id", host.alias("host"), path.alias("path"), verdict["rule"].alias("rule"), verdict["verdict"].alias("verdict")
    )


ORACLES["op11_url_filter"] = url_filter.ORACLE_SQL


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # What is verified: texts without line feeds where the id's checksum is even, the rows as they are elsewhere.
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(tampered, F.replace("text", F.lit("\n"))).otherwise(F.col("text"))
    fields = [F.col(f) for f in ("doc_id", "source", "lang", "n_chars")]
    with tables(spark) as own:
        rows = merkle.manifest(docs, own, extra={"given": merkle.leaf_digest([*fields, text])}).leaves
    lefts, rights, root = F.col("lefts"), F.col("rights"), merkle.folded(F.col("given"), F.col("lefts"), F.col("rights"))
    return rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(lefts, rights).alias("proof_sha256"),
                       root.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLES["op12_merkle_manifest"] = merkle.ORACLE_SQL


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    with tables(spark) as own:
        return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents")), own)


ORACLES["op13_spelling_variants"] = spelling.ORACLE_SQL
