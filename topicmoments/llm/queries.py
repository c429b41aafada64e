"""The dealt operators as queries over the given tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicmoments.llm.bpe import encode_texts
from topicmoments.llm.decontaminate import decontaminate
from topicmoments.llm.language import identify_languages
from topicmoments.llm.lines import NEAR_FROM, dedupe_lines
from topicmoments.llm.near_dup import near_duplicates
from topicmoments.llm.ngram_join import ngram_join
from topicmoments.llm.oracles import ORACLES
from topicmoments.llm.prefix_trie import prefix_trie
from topicmoments.llm.quality import quality_rules
from topicmoments.llm.secrets import corpus_words, scan_secrets
from topicmoments.llm.token_counts import count_tokens
from topicmoments.llm.toxicity import score_toxicity
from topicmoments.llm.warc import capture_histories, sorted_runs, write_archives
from topicmoments.llm.whitening import whiten
from topicmoments.runtime import work_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def joined_sha(values: Column) -> Column:
    """SHA-256 of the values joined by commas, in lower-case hex."""
    return F.sha2(F.array_join(values.cast("array<string>"), ","), 256)


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        joined_sha(F.col("items")).alias("items_sha256"), "contaminated")


def op2_near_dup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), size=3, percent=85)


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return identify_languages(table(spark, folder, "pages"), table(spark, folder, "documents"))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    coded = encode_texts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), joined_sha(F.col("ids")).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = scan_secrets(docs, corpus_words(docs))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(table(spark, folder, "documents"))


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedupe_lines(table(spark, folder, "documents"), near_from=NEAR_FROM).select(
        "doc_id", "n_lines", "n_dropped", "n_near", "kept_in", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = work_path(spark, "archives")
    write_archives(table(spark, folder, "pages"), path)
    return capture_histories(sorted_runs(spark, path)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings"))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(table(spark, folder, "conversations")).drop("prefix_key")


def op13_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontaminate, op2_near_dup, op3_language_id, op4_toxicity, op5_bpe, op6_secrets, op7_quality, op8_line_dedup, op9_token_counts, op10_warc,
                               op11_whitening, op12_prefix_trie, op13_ngram_join)}

__all__ = ["ORACLES", "QUERIES"]
