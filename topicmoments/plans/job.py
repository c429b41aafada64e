"""The end-to-end job: read a corpus, fit, write the model."""

from __future__ import annotations

import time
from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicmoments.config import JobConfig
from topicmoments.operators import terms
from topicmoments.plans.fit import TopicModel, TopicMoments
from topicmoments.runtime import cut, is_stored, let_go, stored
from topicmoments.sources import doc_tables, models, text
from topicmoments.sources.stopwords import default_stopwords, read_stopwords

# Bytes of text whose words a task counts, and rows of a table that a task takes.
PART_BYTES = 16 << 20
PART_ROWS = 2_000_000


@dataclass(frozen=True)
class Corpus:
    """A document-term table, its vocabulary, and the sizes that the table alone does not tell."""

    docs: DataFrame
    vocab: DataFrame | None
    vocab_size: int
    n_docs: int | None = None

    def with_min_words(self, min_words: float) -> "Corpus":
        """Drop short documents; then those without any word no longer count."""
        if min_words <= 0:
            return self
        return Corpus(terms.min_words_filter(self.docs, min_words), self.vocab, self.vocab_size)


def more_than_cores(rows: DataFrame, parts: int) -> int | None:
    """The parts, if they are more than the cores; else none, and adaptive execution gives each core its share."""
    return parts if parts > rows.sparkSession.sparkContext.defaultParallelism else None


def placed(docs: DataFrame) -> DataFrame:
    """Saved counts placed by document for a fit, which would shuffle them anyway, in parts that fit a task."""
    parts = more_than_cores(docs, -(-docs.count() // PART_ROWS))
    return docs if parts is None else docs.repartition(parts, "doc_id")


def corpus_from_texts(texts: DataFrame, vocab_size: int = -1, stopwords: Collection[str] | DataFrame = (),
                      doc_id: str = "doc_id", text_col: str = "text") -> Corpus:
    """Words, vocabulary and counts of `(doc_id, text)`; stopwords are a list, or a table of any length.

    Texts are split once, by as many tasks as their bytes ask for: adaptive execution would join parts up to 64 MiB as they are
    shuffled, whose words take a task's whole memory. The counted words are written, placed by document, and give the
    vocabulary and then the document-term table.
    """
    listed = () if isinstance(stopwords, DataFrame) else stopwords
    size = texts.agg(F.count("*").alias("n"), F.sum(F.octet_length(text_col)).alias("bytes")).first()
    parts = more_than_cores(texts, -(-(size["bytes"] or 0) // PART_BYTES))
    counted = terms.count_words(texts, listed, doc_id, text_col, parts)
    if isinstance(stopwords, DataFrame):
        counted = terms.remove_stopwords(counted, stopwords)
    counted = cut(counted)
    vocab = stored(terms.vocab_topk(terms.counted_words(counted), vocab_size), "vocabulary")
    docs = terms.in_vocabulary(counted, vocab)
    if is_stored(docs):
        let_go(counted)
    return Corpus(docs, vocab, vocab.count(), size["n"])


def corpus_from_config(spark: SparkSession, cfg: JobConfig) -> Corpus:
    inputs = list(cfg.inputs)
    if cfg.input_type == "libsvm":
        docs, vocab, size, n_docs = doc_tables.read_libsvm(spark, inputs, cfg.vocab_size)
        return Corpus(docs, vocab, size, n_docs)
    if cfg.input_type == "text":
        words = default_stopwords(spark) if cfg.stopword_file is None else read_stopwords(spark, cfg.stopword_file)
        return corpus_from_texts(text.read_text_corpus(spark, inputs), cfg.vocab_size, words)
    docs = doc_tables.read_docs(spark, inputs)
    size = cfg.vocab_size if cfg.vocab_size > 0 else (docs.agg(F.max("term_id")).first()[0] or 0) + 1
    return Corpus(placed(docs), None, size, doc_tables.count_docs(spark, inputs))


def fit_corpus(corpus: Corpus, cfg: JobConfig) -> TopicModel:
    o = cfg.options
    estimator = TopicMoments(o.k, o.alpha0, max_iter=o.max_iter, tol=o.tol, idf_lb=o.idf_lb,
                             m2_cond_ub=o.m2_cond_ub, q=o.q, seed=o.seed)
    return estimator.fit(corpus.docs, corpus.vocab_size, corpus.n_docs)


def run_job(spark: SparkSession, cfg: JobConfig) -> tuple[Corpus, TopicModel]:
    """Read, fit, and write the words, the prior and the run figures below `cfg.output_dir`."""
    started = time.monotonic()
    corpus = corpus_from_config(spark, cfg)
    kept = corpus.with_min_words(cfg.min_words)
    # the fit keeps its own copy of the documents, so none is kept here
    model = fit_corpus(kept, cfg)
    fitted = time.monotonic() - started
    n_docs = corpus.n_docs if corpus.n_docs is not None else corpus.docs.agg(F.count_distinct("doc_id")).first()[0]
    models.write_model(model.topic_word, model.alpha, cfg.alpha0, cfg.output_dir)
    models.write_metrics(models.run_metrics(spark, cfg.k, n_docs, corpus.vocab_size, fitted,
                                            time.monotonic() - started), cfg.output_dir)
    return corpus, model
