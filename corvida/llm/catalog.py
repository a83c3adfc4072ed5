"""Registered queries of the corpus operators and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvida.llm import conversations, exact_dedup, fingerprints, html_main, lm, minhash, packing, passages, sentencepiece_scan, sharding, suffix_dedup, toxicity, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn
    return wrap


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_best_fit_packing")
def op1(spark, sf):
    return packing.pack(documents(spark, sf), tokenizer("word_bpe_49k.json"))


@query("op2_vector_sharding")
def op2(spark, sf):
    return sharding.shard(documents(spark, sf))


@query("op3_suffix_dedup")
def op3(spark, sf):
    return suffix_dedup.repeated_bytes(documents(spark, sf))


@query("op4_near_dedup")
def op4(spark, sf):
    return minhash.near_groups(documents(spark, sf))


@query("op5_toxic_spans")
def op5(spark, sf):
    return toxicity.document_scores(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


@query("op6_scaled_fingerprints")
def op6(spark, sf):
    return fingerprints.fingerprint_edits(documents(spark, sf))


@query("op7_bloom_lm")
def op7(spark, sf):
    return lm.score_documents(documents(spark, sf))


@query("op8_fuzzy_passages")
def op8(spark, sf):
    return passages.fuzzy_passages(documents(spark, sf))


@query("op9_sentencepiece_scan")
def op9(spark, sf):
    return sentencepiece_scan.round_trip(documents(spark, sf), tokenizer("piece_bpe_32k.model"))


@query("op10_exact_dedup", r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)""")
def op10(spark, sf):
    return exact_dedup.duplicate_groups(documents(spark, sf))


@query("op11_embedding_whitening")
def op11(spark, sf):
    return whitening.whitened_rows(spark.read.parquet(f"{sf}/embeddings.parquet"))


@query("op12_conversation_repair")
def op12(spark, sf):
    return conversations.repair_damaged(spark.read.parquet(f"{sf}/conversations.parquet"))


@query("op13_html_main_text")
def op13(spark, sf):
    return html_main.extract(spark.read.parquet(f"{sf}/pages.parquet")).select("page_id", "url", "text", "n_chars", "path")
