"""A corpus cleaned in five stages; each stage's rows are written and read again for the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicmoments.llm.bpe import encode_texts
from topicmoments.llm.common import join_measured, written
from topicmoments.llm.decontaminate import scan_benchmark
from topicmoments.llm.lines import NEAR_FROM, without_repeats
from topicmoments.llm.near_dup import near_duplicates
from topicmoments.llm.toxicity import learn, scan_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic; the model is fitted on the labelled ones among them.

    Null and empty texts are kept, as are all where labels of one kind are missing; equal rows go or stay together.
    """
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scan_toxicity(docs, model, docs.columns).filter("predicted = 0").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without lines that stand elsewhere first; other columns, n_chars too, as they were.

    Null texts stay null, rows without an id stay as they are, equal rows are treated alike, and no rows give none.
    """
    return without_repeats(docs, near_from=NEAR_FROM).select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id. Rows that repeat an id go together."""
    found = written(near_duplicates(docs).select("doc_id", "kept").distinct(), "kept")
    gone = found.filter("not kept").select("doc_id").join(found.filter("kept").select("doc_id"), "doc_id", "left_anti")
    return join_measured(docs, gone, ["doc_id"], "left_anti", 60).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in benchmark windows.

    Null and empty texts have no words and are kept; equal rows go or stay together, rows without an id too.
    """
    found = scan_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), docs.columns)
    return found.filter("not contaminated").select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their number, and the SHA-256 of the decoded text.

    A null text has no ids and decodes as an empty one; every row gives one row.
    """
    coded = encode_texts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("near-dedup", near_dedup), ("decontamination", decontamination),
          ("tokens", tokens)]

#: Compression, near copies and byte pairs cannot be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents, writing each stage's rows to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
