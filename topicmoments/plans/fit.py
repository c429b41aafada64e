"""Fitting a topic model: moments, whitening, decomposition, recovery of the topics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from topicmoments.config import MomentOptions
from topicmoments.operators import likelihood
from topicmoments.operators.layout import by_term
from topicmoments.operators.matrix import COLUMN_BLOCK, check_condition, columns, times_small
from topicmoments.operators.moments import (
    TermTable, top_eigen, top_eigen_exact, whitened_third_moment, whitening_matrix)
from topicmoments.operators.simplex import project_signed
from topicmoments.operators.tensor import decompose_small
from topicmoments.operators.terms import with_length
from topicmoments.operators.weights import IDF_SLACK, dense, term_statistics
from topicmoments.runtime import broadcast_limit, cut, fits_broadcast, row_bytes


@dataclass(frozen=True)
class Moments:
    """Whitened third moment (small), leading eigenpairs of the second, and the first moment."""

    third: np.ndarray
    eigenvectors: DataFrame
    eigenvalues: np.ndarray
    first: DataFrame


@dataclass(frozen=True)
class TopicModel:
    """Topics ordered by prior weight: words `(topic, term_id, p)` and one weight per topic."""

    topic_word: DataFrame
    alpha: list[float]
    vocab_size: int
    moments: Moments | None = None

    def __post_init__(self) -> None:
        likelihood.check_model(self.topic_word, self.alpha)

    def infer(self, docs: DataFrame, max_iter: int = 50, seed: int = 0) -> DataFrame:
        return likelihood.infer_topics(docs, self.topic_word, self.alpha, self.vocab_size, max_iter, seed=seed)

    def log_likelihood(self, docs: DataFrame, smoothing: float, max_iter: int, seed: int = 0) -> DataFrame:
        return likelihood.log_likelihood(docs, self.topic_word, self.alpha, self.vocab_size, smoothing,
                                         max_iter, seed)


def by_document(docs: DataFrame) -> DataFrame:
    """Documents with their length, each in one partition.

    Where the documents are not placed so yet, one shuffle does it; every later sum by document, and
    every join back to the documents, is then free of shuffles.
    """
    return with_length(docs.select("doc_id", "term_id", "cnt"))


def prepare(docs: DataFrame) -> DataFrame:
    """The same, kept for all later passes. A lost executor's part is rebuilt from the source."""
    return by_document(docs).persist(StorageLevel.MEMORY_AND_DISK)


def term_table(prepared: DataFrame, n_docs: int | None = None, idf_lb: float = 1.0) -> TermTable:
    """Per-term sums of the unmasked terms, from documents that `prepare` made.

    `n_docs` counts the documents for the IDF, those without any term included.
    """
    counts = (prepared.groupBy("doc_id").agg(F.max("len").alias("len"))
              .agg(F.count("*").alias("all"), F.count_if(F.col("len") >= 3).alias("valid")).first())
    valid = counts["valid"]
    if not valid:
        raise ValueError("no document has three words or more")
    total = float(counts["all"] if n_docs is None else n_docs)
    sums = term_statistics(prepared)
    # a term without any positive count has an infinite ratio and is never masked
    low = (F.col("df") > 0) & (F.lit(total) / F.greatest("df", F.lit(1)) <= idf_lb - IDF_SLACK)
    terms = cut(sums.filter(~low).select("term_id", "df", (F.col("share") / F.lit(float(valid))).alias("m1"),
                                         "s2", "s1"))
    return TermTable(terms, terms.count(), valid)


def with_layout(valid: DataFrame, table: TermTable, width: int) -> TermTable:
    """The table with the documents written by term, if matrices of so many columns are too large to broadcast.

    Rows of the most frequent terms, as many as fit, are broadcast all the same.
    """
    if fits_broadcast(valid.sparkSession, table.n_terms * row_bytes(min(width, COLUMN_BLOCK))):
        return table
    room = broadcast_limit(valid.sparkSession) // (row_bytes(min(width, COLUMN_BLOCK)) + row_bytes(1))
    return replace(table, layout=by_term(valid, table.terms.select("term_id", "df"), room))


def fit_moments(docs: DataFrame, options: MomentOptions, vocab_size: int, n_docs: int | None = None) -> Moments:
    """Moments of a document-term table whose terms are 0 .. vocab_size - 1."""
    prepared = prepare(docs)
    try:
        table = term_table(prepared, n_docs, options.idf_lb)
        valid = prepared.filter(F.col("len") >= 3)
        table = with_layout(valid, table, 2 * options.k)
        if options.randomised_svd:
            vectors, values = top_eigen(valid, table, vocab_size, options.k, options.alpha0, options.q, options.seed)
        else:
            vectors, values = top_eigen_exact(valid, table, vocab_size, options.k, options.alpha0)
        check_condition(values, options.m2_cond_ub)
        white = whitening_matrix(vectors, values)
        third = whitened_third_moment(valid, white, table, options.alpha0)
        if table.layout is not None:
            table.layout.close()
    finally:
        prepared.unpersist()
    return Moments(third, vectors, values, dense(table.terms.select("term_id", "m1"), vocab_size, "m1"))


def unwhiten(eigenvectors: DataFrame, eigenvalues: Sequence[float], factor: np.ndarray,
             weights: Sequence[float]) -> DataFrame:
    """Topics before projection: eigenvectors x roots of eigenvalues x factor x weights."""
    small = np.sqrt(np.asarray(eigenvalues))[:, None] * factor * np.asarray(weights)[None, :]
    return times_small(eigenvectors, ["term_id"], columns(eigenvectors), small)


def order_topics(alpha: DataFrame) -> DataFrame:
    """Number topics `(topic, alpha)` by descending weight: `(topic, alpha, place)`; one row per topic."""
    return alpha.withColumn("place", F.row_number().over(W.orderBy(F.desc("alpha"), F.asc("topic"))) - 1)


def long_topics(wide: DataFrame, vocab_size: int) -> DataFrame:
    """A tall table as `(vec_id, row, v)`, one vector per column, with every term present."""
    cols = columns(wide)
    filled = dense(wide, vocab_size, *cols)
    return filled.select(F.col("term_id").alias("row"), F.posexplode(F.array(*cols)).alias("vec_id", "v"))


def recover(moments: Moments, factor: np.ndarray, weights: np.ndarray, vocab_size: int) -> TopicModel:
    """Topics and prior weights from the decomposition of the whitened third moment."""
    if not np.all(np.abs(weights) > 0):
        raise ValueError("a topic vanished in the decomposition; use fewer topics")
    alpha = weights ** -2.0
    order = np.argsort(-alpha, kind="stable")
    wide = unwhiten(moments.eigenvectors, moments.eigenvalues, factor[:, order], weights[order])
    projected = project_signed(long_topics(wide, vocab_size))
    topic_word = cut(projected.select(F.col("vec_id").alias("topic"), F.col("row").alias("term_id"),
                                      F.col("v").alias("p")))
    return TopicModel(topic_word, [float(a) for a in alpha[order]], vocab_size, moments)


class TopicMoments:
    """The estimator: options in, `fit(docs)` out."""

    def __init__(self, k: int, alpha0: float, **options) -> None:
        self.options = MomentOptions(k=k, alpha0=alpha0, **options)

    def fit(self, docs: DataFrame, vocab_size: int | None = None, n_docs: int | None = None) -> TopicModel:
        """Fit to `(doc_id, term_id, cnt)`; the vocabulary is counted when its size is not given."""
        o = self.options
        if vocab_size is None:
            vocab_size = (docs.agg(F.max("term_id")).first()[0] or 0) + 1
        moments = fit_moments(docs, o, vocab_size, n_docs)
        factor, weights, _loss = decompose_small(docs.sparkSession, moments.third, o.max_iter, o.tol,
                                                 o.restarts, o.seed)
        return recover(moments, factor, weights, vocab_size)
