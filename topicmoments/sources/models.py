"""Writing and reading fitted models and run figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rescaled_alpha(alpha: DataFrame, alpha0: float) -> DataFrame:
    """Prior weights `(topic, alpha)` scaled to sum to alpha0."""
    total = alpha.agg(F.sum("alpha").alias("total")).withColumn("one", F.lit(1))
    return (alpha.withColumn("one", F.lit(1)).join(total, "one")
            .select("topic", (F.col("alpha") / F.col("total") * F.lit(float(alpha0))).alias("alpha")))


def alpha_table(spark: SparkSession, alpha: Sequence[float]) -> DataFrame:
    return spark.createDataFrame([(t, float(a)) for t, a in enumerate(alpha)], "topic int, alpha double")


def topic_matrix(topic_word: DataFrame, k: int) -> DataFrame:
    """One row per term and one column `topic_0, topic_1, ...` per topic."""
    return (topic_word.groupBy("term_id").pivot("topic", list(range(k))).agg(F.sum("p"))
            .select("term_id", *[F.coalesce(F.col(str(t)), F.lit(0.0)).alias(f"topic_{t}") for t in range(k)]))


def write_model(topic_word: DataFrame, alpha: Sequence[float], alpha0: float, out: str) -> None:
    """The words as a space-separated matrix in term order and as a table, and the rescaled prior.

    `TD_beta_k<k>.txt` is a folder of part files which, read in name order, are the matrix's rows.
    """
    spark, k = topic_word.sparkSession, len(alpha)
    matrix = topic_matrix(topic_word, k).orderBy("term_id").drop("term_id")
    matrix.write.mode("errorifexists").csv(f"{out}/TD_beta_k{k}.txt", sep=" ")
    topic_word.write.mode("errorifexists").parquet(f"{out}/topic_word_k{k}.parquet")
    scaled = rescaled_alpha(alpha_table(spark, alpha), alpha0)
    line = scaled.agg(F.concat_ws(" \t", F.transform(F.array_sort(F.collect_list(F.struct("topic", "alpha"))),
                                                     lambda r: r["alpha"].cast("string"))).alias("value"))
    line.write.mode("errorifexists").text(f"{out}/alpha_k{k}.txt")


def read_topic_word(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("topic int, term_id int, p double").parquet(path)


def run_metrics(spark: SparkSession, k: int, n_docs: int, vocab_size: int, fit_seconds: float,
                total_seconds: float) -> DataFrame:
    """One row of run figures."""
    return spark.createDataFrame([(k, n_docs, vocab_size, fit_seconds, total_seconds)],
                                 "k int, n_docs bigint, vocab_size int, fit_seconds double, total_seconds double")


def write_metrics(metrics: DataFrame, out: str) -> None:
    k = metrics.first()["k"]
    metrics.write.mode("errorifexists").json(f"{out}/TD_runningTime_k{k}.json")
