"""One query per operator, over the whole of its table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
import public_tokenizers

from vecloop.llm import align, classifier, decontaminate, fim, langid, lm, pieces, quality, secrets, sharding, simhash, sql, suffixes, warc
from vecloop.plans.views import table
from vecloop.session import fresh_path


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.component_digests(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 8)


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger's first run over all documents, joined back to them. The ledger adds no spans to the base ones."""
    docs = table(spark, sf_dir, "documents")
    ledger = secrets.update_ledger(docs, fresh_path(spark, "ledger"))
    found = secrets.findings(docs, ledger).withColumn("spans", secrets.span_text())
    return found.select(
        F.col("path").alias("doc_id"),
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(F.col("spans").cast("binary"), 256).alias("base_sha256"),
        "spans",
    )


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents")).drop("rejected_by")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_round_trip(spark, table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.restore(fim.fill_in_middle(table(spark, sf_dir, "documents")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align.count_links(table(spark, sf_dir, "documents"), *paths)


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    registered = [op1_simhash_near_dedup, op2_lm_scoring, op3_suffix_array_dedup, op4_sharding, op5_secret_scans, op6_benchmark_decontamination, op7_sentencepiece, op8_language_id, op9_quality_rules, op10_warc, op11_fill_in_middle, op12_cross_tokenizer_alignment, op13_quality_classifier, pipeline]
    return {q.__name__: q for q in registered}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_suffix_array_dedup": sql.OP3,
        "op4_sharding": sql.OP4,
        "op5_secret_scans": sql.OP5,
        "op6_benchmark_decontamination": sql.OP6,
        "op9_quality_rules": sql.OP9,
        "op10_warc": sql.OP10,
        "op11_fill_in_middle": sql.OP11,
    }
