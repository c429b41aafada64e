"""Text corpora: one document per file, or many documents gathered in one table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicmoments.operators.terms import assign_doc_ids


def _paths(paths: str | Sequence[str]) -> list[str]:
    """A list of paths, or one string with commas between them."""
    parts = paths.split(",") if isinstance(paths, str) else paths
    return [p for p in (q.strip() for q in parts) if p]


def read_text_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Whole files as `(path, text)`; paths may be folders or patterns."""
    return (spark.read.text(_paths(paths), wholetext=True)
            .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def compact_small_files(spark: SparkSession, paths: str | Sequence[str], out: str,
                        n_files: int | None = None) -> None:
    """Gather many small text files in one Parquet table `(path, text)`.

    Spark packs small files into splits by size, so without `n_files` the output files follow
    `spark.sql.files.maxPartitionBytes`.
    """
    texts = read_text_files(spark, paths)
    if n_files is not None:
        texts = texts.coalesce(n_files)
    texts.write.mode("errorifexists").parquet(out)


def read_compacted(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Tables written by `compact_small_files`; paths may be patterns."""
    return spark.read.schema("path string, text string").parquet(*_paths(paths))


def read_text_corpus(spark: SparkSession, paths: str | Sequence[str], compacted: bool = False) -> DataFrame:
    """Documents `(doc_id, path, text)`, numbered from 0 in the order of their paths."""
    texts = read_compacted(spark, paths) if compacted else read_text_files(spark, paths)
    return assign_doc_ids(texts, ["path"]).select("doc_id", "path", "text")
