"""From texts to the document-term table: words, counts, vocabulary, document lengths.

Table shapes: texts `(doc_id, text)`, words `(doc_id, term)`, counts `(term, n)`, vocabulary
`(term_id, term, n)`, documents `(doc_id, term_id, cnt)` with one row per distinct term.
"""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructField, StructType

from topicmoments.functions.words import words as split_words
from topicmoments.operators.layout import bucketed
from topicmoments.runtime import (
    broadcast_limit, cut, fits_broadcast, hot_keys, join_sized, salted_join, shuffle_partitions, stored, table_bytes, with_dense_ids)

# A vocabulary of at most this many terms is numbered in one task; a larger one by ranges.
ONE_TASK_VOCAB = 200_000


def assign_doc_ids(texts: DataFrame, order: Collection[str], id_col: str = "doc_id") -> DataFrame:
    """Number documents 0, 1, 2, ... in the order of a key; every row is a document, whatever its key.

    Only the key columns are sorted and numbered. The other columns join back on the key, and stay
    where they are when the keys are few enough to broadcast. Where keys repeat, the rows are written
    once with a number of their own, which then takes the key's place; equal keys are numbered in the
    order in which they were read.
    """
    counts = texts.groupBy(*order).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()
    key = list(order)
    if (counts["n"] or 0) > 1 or texts.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in order])).limit(1).count():
        texts, key = stored(texts.withColumn("_row", F.monotonically_increasing_id()), "numbered"), ["_row"]
        keys = with_dense_ids(texts.select(*order, "_row"), [*[F.col(c) for c in order], F.col("_row")], id_col).select("_row", id_col)
    else:
        keys = with_dense_ids(texts.select(*order), [F.col(c) for c in order], id_col)
    if fits_broadcast(texts.sparkSession, table_bytes(keys)):
        keys = F.broadcast(keys)
    return texts.join(keys, key).drop("_row")


def tokenize(texts: DataFrame, stopwords: Collection[str] = (), doc_id: str = "doc_id",
             text: str = "text") -> DataFrame:
    """One row per word of each text, lower case, letters only, at least three of them."""
    return texts.select(F.col(doc_id).alias("doc_id"), F.explode(split_words(F.col(text), stopwords)).alias("term"))


def remove_stopwords(words: DataFrame, stopwords: DataFrame, max_list: int = 10_000) -> DataFrame:
    """Drop the words of a list held as a table.

    A list of at most `max_list` words is tested in place. A longer one is an anti join, broadcast
    when it is proven small enough; else Spark splits the words that come too often.
    """
    known = [r["term"] for r in stopwords.select("term").distinct().limit(max_list + 1).collect()]
    if not known:
        return words
    if len(known) <= max_list:
        return words.filter(~F.col("term").isin(known))
    listed = stopwords.select("term").distinct()
    if fits_broadcast(words.sparkSession, table_bytes(listed)):
        listed = F.broadcast(listed)
    return words.join(listed, "term", "left_anti")


def word_count(words: DataFrame) -> DataFrame:
    return words.groupBy("term").agg(F.count("*").alias("n"))


def count_words(texts: DataFrame, stopwords: Collection[str] = (), doc_id: str = "doc_id", text: str = "text",
                parts: int | None = None) -> DataFrame:
    """Each document's words and how often it has them: `(doc_id, term, cnt)`, placed by document.

    Texts, which are smaller than their words, are shuffled once, to `parts` tasks if given; counting then needs no shuffle,
    and what follows by document needs none either.
    """
    own = texts.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    placed = own.repartition("doc_id") if parts is None else own.repartition(parts, "doc_id")
    return tokenize(placed, stopwords).groupBy("doc_id", "term").agg(F.count("*").cast("double").alias("cnt"))


def counted_words(counted: DataFrame) -> DataFrame:
    """The corpus counts `(term, n)` of counted documents."""
    return counted.groupBy("term").agg(F.sum("cnt").cast("bigint").alias("n"))


def in_vocabulary(counted: DataFrame, vocab: DataFrame) -> DataFrame:
    """Counted documents by the vocabulary's numbers; other words fall away.

    A vocabulary that is too large to broadcast numbers the documents once for all: its most frequent words, as many as
    fit, are broadcast and their rows, nearly all, stay where they are; only rows of rarer words meet them by a shuffle
    and go back to their documents. The result is written in buckets by document.
    """
    spark, ids = counted.sparkSession, vocab.select("term", "term_id")
    size = table_bytes(ids)
    if fits_broadcast(spark, size):
        return counted.join(F.broadcast(ids), "term").select("doc_id", "term_id", "cnt")
    # words are numbered from the most frequent one down
    most = int(vocab.count() * broadcast_limit(spark) / size)
    while most and not fits_broadcast(spark, table_bytes(ids.filter(F.col("term_id") < most))):
        most //= 2
    near = F.broadcast(ids.filter(F.col("term_id") < most))
    head = counted.join(near, "term")
    rare = vocab.filter(F.col("term_id") >= most)
    tail = salted_join(counted.join(near.select("term"), "term", "left_anti"), rare.select("term", "term_id"), "term", F.col("doc_id"),
                       hot_keys(rare, "term", "n", shuffle_partitions(spark)))
    buckets = max(counted.rdd.getNumPartitions(), 1)
    back = tail.select("doc_id", "term_id", "cnt").repartition(buckets, "doc_id")
    return bucketed(head.select("doc_id", "term_id", "cnt").unionByName(back), "doc_id", buckets, placed=True)


def vocab_topk(counts: DataFrame, size: int = -1) -> DataFrame:
    """The `size` most frequent terms (-1 = all), numbered from 0 by count, then by term."""
    order = [F.desc("n"), F.asc("term")]
    if 0 < size <= ONE_TASK_VOCAB:
        top = counts.orderBy(*order).limit(size)
        ranked = top.withColumn("term_id", F.row_number().over(W.orderBy(*order)) - 1)
    else:
        ranked = with_dense_ids(counts, order, "term_id")
        if size > 0:
            ranked = ranked.filter(F.col("term_id") < size)
    return ranked.select(F.col("term_id").cast("int").alias("term_id"), "term", "n")


def vocab_stats(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """One row: all terms, selected terms, tokens the selected terms stand for."""
    full = counts.agg(F.count("*").alias("full_vocab_size"))
    chosen = vocab.agg(F.count("*").alias("vocab_size"), F.sum("n").alias("selected_tokens"))
    return full.crossJoin(F.broadcast(chosen))  # one row each


def doc_term(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """Counts of the vocabulary's terms in each document.

    Words outside the vocabulary fall away before the shuffle, and each document's equal words are
    added up before it as well.
    """
    ids = vocab.select("term", "term_id")
    hits = join_sized(words, ids, "term", table_bytes(ids), "doc_id", vocab.select("term", "n"), "n")
    return (hits.groupBy("doc_id", "term_id")
            .agg(F.count("*").cast("double").alias("cnt")))


def with_length(docs: DataFrame) -> DataFrame:
    """Add each document's total count as `len`, with one shuffle on the document."""
    return docs.withColumn("len", F.sum("cnt").over(W.partitionBy("doc_id")))


def doc_length(docs: DataFrame) -> DataFrame:
    return docs.groupBy("doc_id").agg(F.sum("cnt").alias("len"))


def min_words_filter(docs: DataFrame, min_words: float) -> DataFrame:
    """Keep documents of at least `min_words` words."""
    if min_words <= 0:
        return docs
    return with_length(docs).filter(F.col("len") >= min_words).drop("len")


def valid_docs(docs: DataFrame) -> DataFrame:
    """Documents long enough for a third moment, with their length."""
    return with_length(docs).filter(F.col("len") >= 3)


def term_distribution(docs: DataFrame) -> DataFrame:
    """Each document's counts divided by its length."""
    return with_length(docs).select("doc_id", "term_id", (F.col("cnt") / F.col("len")).alias("share"))


def token_total(docs: DataFrame) -> DataFrame:
    return docs.agg(F.sum("cnt").alias("tokens"))


def corpus_summary(docs: DataFrame) -> DataFrame:
    """One row: documents, documents long enough for a fit, distinct terms, tokens."""
    per_doc = doc_length(docs).agg(
        F.count("*").alias("n_docs"),
        F.count_if(F.col("len") >= 3).alias("n_valid_docs"),
        F.sum("len").alias("n_tokens"))
    terms = docs.select("term_id").distinct().agg(F.count("*").alias("n_terms"))
    return per_doc.crossJoin(F.broadcast(terms))  # one row each


def to_features(docs: DataFrame, vocab_size: int) -> DataFrame:
    """One sparse vector per document for `pyspark.ml`; a document has at most one entry per term.

    Columns put the vectors together in the layout that Spark ML stores (kind 0 is sparse). Arrow
    batches then pass unchanged through a step whose only work is to give them the vector type.
    """
    from pyspark.ml.linalg import VectorUDT

    pairs = docs.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("term_id", "cnt"))).alias("pairs"))
    stored = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(vocab_size).cast("int").alias("size"),
                      F.col("pairs.term_id").alias("indices"), F.col("pairs.cnt").alias("values"))
    rows = pairs.select("doc_id", stored.alias("features"))
    schema = StructType([rows.schema["doc_id"], StructField("features", VectorUDT())])
    return rows.mapInArrow(lambda batches: batches, schema)


def vector_entries(rows: DataFrame, vector: str) -> DataFrame:
    """The other columns with a sparse vector's `size`, `indices` and `values`; entries that it does not store are zero.

    The reverse of `to_features`: Arrow batches pass unchanged and lose the vector type.
    """
    kept = [f for f in rows.schema.fields if f.name != vector]
    plain = StructType([*kept, StructField(vector, rows.schema[vector].dataType.sqlType())])
    parts = rows.select(*[f.name for f in kept], vector).mapInArrow(lambda batches: batches, plain)
    return parts.select(*[f.name for f in kept], *[F.col(vector)[c].alias(c) for c in ("size", "indices", "values")])
