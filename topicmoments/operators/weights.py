"""Per-term statistics: document frequency, inverse document frequency, the first moment."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicmoments.operators.terms import doc_length, with_length
from topicmoments.runtime import cut, fits_broadcast, join_sized, row_bytes

# Fixed value: slack below the bound when a fit looks for low-IDF terms.
IDF_SLACK = 1e-12


def all_terms(spark: SparkSession, vocab_size: int) -> DataFrame:
    return spark.range(vocab_size).select(F.col("id").cast("int").alias("term_id"))


def dense(values: DataFrame, vocab_size: int, *cols: str) -> DataFrame:
    """Fill the terms that have no row with zeros."""
    filled = all_terms(values.sparkSession, vocab_size).join(values, "term_id", "left")
    return filled.select("term_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in cols])


def doc_freq(docs: DataFrame) -> DataFrame:
    """In how many documents each term has a positive count."""
    return (docs.filter(F.col("cnt") > 0).groupBy("term_id")
            .agg(F.count("*").alias("df")))


def count_docs(docs: DataFrame) -> int:
    return docs.agg(F.count_distinct("doc_id")).first()[0]


def idf(docs: DataFrame, vocab_size: int, n_docs: int | None = None) -> DataFrame:
    """Documents over document frequency, a plain ratio; infinite for a term in no document.

    `n_docs` counts documents without any term too; by default those in the table are counted.
    """
    total = float(count_docs(docs) if n_docs is None else n_docs)
    freq = all_terms(docs.sparkSession, vocab_size).join(doc_freq(docs), "term_id", "left")
    ratio = F.when(F.col("df") > 0, F.lit(total) / F.col("df")).otherwise(F.lit(math.inf))
    return freq.select("term_id", ratio.alias("idf"))


def low_idf_terms(idf_table: DataFrame, lower_bound: float) -> DataFrame:
    """Terms that a fit leaves out of its moments."""
    return idf_table.filter(F.col("idf") <= lower_bound - IDF_SLACK)


def filter_idf(docs: DataFrame, vocab_size: int, lower_bound: float, n_docs: int | None = None) -> DataFrame:
    """Set the counts of terms below the bound to an explicit zero; a bound of 1 changes nothing."""
    if lower_bound <= 1.0 + IDF_SLACK:
        return docs
    ratios = idf(docs, vocab_size, n_docs)
    # each is in a share of all documents, so these are few, whatever the vocabulary
    low = cut(ratios.filter(F.col("idf") < lower_bound).select("term_id", F.lit(True).alias("low")))
    if fits_broadcast(docs.sparkSession, low.count() * row_bytes(2)):
        known = docs.filter(F.col("term_id").between(0, vocab_size - 1)).join(F.broadcast(low), "term_id", "left")
        return known.select("doc_id", "term_id", F.when(F.col("low"), 0.0).otherwise(F.col("cnt")).alias("cnt"))
    flags = ratios.select("term_id", (F.col("idf") < lower_bound).alias("low"))
    flagged = join_sized(docs, flags, "term_id", vocab_size * row_bytes(2), "doc_id", doc_freq(docs), "df")
    return flagged.select("doc_id", "term_id", F.when(F.col("low"), 0.0).otherwise(F.col("cnt")).alias("cnt"))


def first_moment(docs: DataFrame, vocab_size: int) -> DataFrame:
    """Mean over documents of at least three words of each term's share, for every term."""
    rows = with_length(docs).filter(F.col("len") >= 3)
    n = doc_length(docs).filter(F.col("len") >= 3).agg(F.count("*").alias("n"))
    sums = rows.groupBy("term_id").agg(F.sum(F.col("cnt") / F.col("len")).alias("total"))
    mean = (sums.withColumn("one", F.lit(1)).join(n.withColumn("one", F.lit(1)), "one")
            .select("term_id", (F.col("total") / F.col("n")).alias("m1")))
    return dense(mean, vocab_size, "m1")


def term_statistics(docs: DataFrame) -> DataFrame:
    """All per-term sums a fit needs, in one pass over documents that carry `len`.

    `df` counts every document; the others only those of at least three words: `share` = sum of
    cnt/len, `s2` = sum of cnt/(len(len-1)), `s1` = sum of cnt/(len(len-1)(len-2)).
    """
    length, cnt = F.col("len"), F.col("cnt")
    long_enough = length >= 3
    return docs.groupBy("term_id").agg(
        F.count_if(cnt > 0).alias("df"),
        F.sum(F.when(long_enough, cnt / length).otherwise(0.0)).alias("share"),
        F.sum(F.when(long_enough, cnt / (length * (length - 1))).otherwise(0.0)).alias("s2"),
        F.sum(F.when(long_enough, cnt / (length * (length - 1) * (length - 2))).otherwise(0.0)).alias("s1"))
