"""Queries over the given tables, one or more per operator.

Numbers are rounded so that the order of additions does not show; `+ 0` turns -0 into 0.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from topicmoments.config import JobConfig, MomentOptions
from topicmoments.functions import chance, special
from topicmoments.operators import layout, likelihood, matrix, moments, simplex, tensor, terms, weights
from topicmoments.plans import evaluate, fit, job
from topicmoments.runtime import cut, fits_broadcast, is_stored, let_go, spread, table_bytes, work_path
from topicmoments.sources import doc_tables, models, stopwords, text

# Parameters shared with the SQL.
TOP = 500  # of the queries whose feature is the limit
ALL = -1
MIN_WORDS = 50
IDF_BOUND = 2.0
ALPHA0 = 1.5
RANK = 3
WIDE = 8
SHAPES = (2.5, 0.3)
SIGMA = (4.0, 2.25, 1.0)
LAMBDA = (0.5, 2.0, 1.25)
FACTOR = ((0.8, 0.0, 0.6), (0.6, 0.0, -0.8), (0.0, 1.0, 0.0))
PRIOR = (0.1, 0.2, 0.3, 0.4)
SMOOTHING = 0.01
INFER_ITERATIONS = 50
ALS_ROUNDS = 3
ALS_STARTS = 2
FIT_TOPICS = 4
FIT_ALPHA0 = 0.4


def rounded(c: Column | str, digits: int = 8) -> Column:
    return F.round(c, digits) + F.lit(0.0)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def words(spark: SparkSession, sf: str, stop: bool = True) -> DataFrame:
    texts = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return terms.tokenize(texts, stopwords.ENGLISH if stop else ())


def built(spark: SparkSession, sf: str, vocab_size: int = ALL, stop: bool = True) -> job.Corpus:
    """The documents' counts of their words, with the vocabulary."""
    texts = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return job.corpus_from_texts(texts, vocab_size, stopwords.ENGLISH if stop else ())


def corpus(spark: SparkSession, sf: str, vocab_size: int = ALL, stop: bool = True) -> DataFrame:
    return built(spark, sf, vocab_size, stop).docs


def order_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as documents, suppliers as terms, quantities as counts."""
    return (table(spark, sf, "lineitem")
            .groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").cast("int").alias("term_id"))
            .agg(F.sum("l_quantity").alias("cnt")))


def order_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, moments.TermTable]:
    docs = fit.by_document(order_corpus(spark, sf))
    return docs.filter(F.col("len") >= 3), fit.term_table(docs)


def rule_matrix(keys: DataFrame, key: str, n_cols: int = RANK) -> DataFrame:
    """A matrix whose entries follow from the key and the column."""
    return keys.selectExpr(key, *[f"pmod({key} * 31 + {j} * 17, 101) / 101.0D - 0.5D as c{j}" for j in range(n_cols)])


def embedding_entries(spark: SparkSession, sf: str) -> DataFrame:
    return (table(spark, sf, "embeddings")
            .select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "v"))
            .withColumn("v", F.col("v").cast("double")))


def embedding_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_entries(spark, sf).toDF("vec_id", "row", "v")


def language_model(spark: SparkSession, sf: str, docs: DataFrame | None = None) -> DataFrame:
    """Word shares of each language: a topic model that follows from the tables."""
    counts = (corpus(spark, sf) if docs is None else docs).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    topic = F.expr("array_position(array('de', 'en', 'es', 'fr'), lang) - 1").cast("int")
    # written once: the totals, and whoever reads the model several times, do not count again
    by_topic = cut(counts.withColumn("topic", topic).groupBy("topic", "term_id").agg(F.sum("cnt").alias("n")))
    totals = by_topic.groupBy("topic").agg(F.sum("n").alias("total"))
    return by_topic.join(totals, "topic").select("topic", "term_id", (F.col("n") / F.col("total")).alias("p"))


def language_alpha(spark: SparkSession, sf: str) -> DataFrame:
    """Mean length of the documents of each language, as prior weights."""
    return (table(spark, sf, "documents")
            .groupBy(F.expr("array_position(array('de', 'en', 'es', 'fr'), lang) - 1").cast("int").alias("topic"))
            .agg((F.avg("n_chars") / 1000).alias("alpha")))


def line_tensor(spark: SparkSession, sf: str) -> DataFrame:
    """Quantities by line number, month and supplier, as tensor cells."""
    return (table(spark, sf, "lineitem")
            .groupBy(F.col("l_linenumber").alias("i"), (F.month("l_shipdate") - 1).alias("j"),
                     F.col("l_suppkey").cast("int").alias("l"))
            .agg(F.sum(F.col("l_quantity") / 100).alias("v")))


def flag(c: str = "l_returnflag") -> Column:
    return F.expr(f"array_position(array('A', 'N', 'R'), {c}) - 1").cast("int")


# --- sources and sinks -----------------------------------------------------------------------

def _text_files(spark: SparkSession, sf: str) -> str:
    path = work_path(spark, "texts")
    (table(spark, sf, "documents").select("text")
     .write.option("maxRecordsPerFile", 100).mode("errorifexists").text(path))
    return path


def read_text_corpus(spark, sf):
    docs = text.read_text_corpus(spark, _text_files(spark, sf))
    return terms.word_count(terms.tokenize(docs))


def compact_small_files(spark, sf):
    out = work_path(spark, "compacted")
    text.compact_small_files(spark, _text_files(spark, sf), out)
    docs = text.read_text_corpus(spark, out, compacted=True)
    return docs.agg(F.sum(F.length("text")).alias("n_chars"), (F.max("doc_id") + 1 == F.count("*")).alias("dense_ids"))


def write_docs(spark, sf):
    path = work_path(spark, "docs.parquet")
    doc_tables.write_docs(corpus(spark, sf), path)
    return doc_tables.read_docs(spark, path)


def idf_after_round_trip(spark, sf):
    """Inverse frequencies from saved documents, some of which have none of the vocabulary's words."""
    path = work_path(spark, "docs.parquet")
    doc_tables.write_docs(corpus(spark, sf, 20), path, table(spark, sf, "documents").select("doc_id"))
    ratios = weights.idf(doc_tables.read_docs(spark, path), 20, doc_tables.count_docs(spark, path))
    return ratios.withColumn("idf", rounded("idf"))


def read_docs(spark, sf):
    path = work_path(spark, "docs.parquet")
    doc_tables.write_docs(order_corpus(spark, sf), path)
    return doc_tables.read_docs(spark, path)


def read_docs_several(spark, sf):
    """Two saved tables with the same ids, suppliers and parts of the orders: twice as many documents."""
    lines = table(spark, sf, "lineitem")
    paths = []
    for term in ("l_suppkey", "l_partkey"):
        paths.append(work_path(spark, f"{term}.parquet"))
        docs = lines.groupBy(F.col("l_orderkey").alias("doc_id"), F.col(term).cast("int").alias("term_id")).agg(F.sum("l_quantity").alias("cnt"))
        doc_tables.write_docs(docs, paths[-1])
    n_docs = doc_tables.count_docs(spark, paths)
    return doc_tables.read_docs(spark, paths).withColumn("n_docs", F.lit(n_docs).cast("bigint"))


def read_libsvm(spark, sf):
    path = work_path(spark, "docs.libsvm")
    doc_tables.write_libsvm(corpus(spark, sf), path)
    return doc_tables.read_libsvm_lines(spark, path).select(F.col("label").cast("bigint").alias("doc_id"), F.inline("entries"))


def read_libsvm_class_labels(spark, sf):
    """Labels that many lines share: every line stays a document of its own, also one without a word."""
    path = work_path(spark, "classes.libsvm")
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("label"))
    doc_tables.write_libsvm(corpus(spark, sf), path, labels)
    lines = doc_tables.read_libsvm_lines(spark, path)
    docs, _vocab, _size, n_docs = doc_tables.read_libsvm(spark, path)
    sizes = docs.groupBy("doc_id").agg(F.sum("cnt").alias("len"), F.count("*").alias("n_terms"))
    return (lines.select("doc_id", F.col("label").cast("int").alias("label")).join(sizes, "doc_id", "left")
            .select("label", F.coalesce("len", F.lit(0.0)).alias("len"), F.coalesce("n_terms", F.lit(0).cast("bigint")).alias("n_terms"),
                    F.lit(n_docs).cast("bigint").alias("n_docs")))


def read_text_repeated_path(spark, sf):
    """A folder that is listed twice: each of its files is read, and numbered, twice."""
    path = _text_files(spark, sf)
    docs = text.read_text_corpus(spark, [path, path])
    numbers = docs.agg((F.max("doc_id") + 1 == F.count("*")).alias("dense"), (F.count_distinct("doc_id") == F.count("*")).alias("unique")).first()
    return terms.word_count(terms.tokenize(docs)).withColumn("numbered", F.lit(numbers["dense"] and numbers["unique"]))


def read_dok(spark, sf):
    path = work_path(spark, "docs.dok")
    doc_tables.write_dok(order_corpus(spark, sf), path)
    return doc_tables.read_dok(spark, path)


def read_stopwords(spark, sf):
    path = work_path(spark, "list")
    table(spark, sf, "benchmark").select("text").write.text(path)
    return stopwords.read_stopwords(spark, path)


def write_model(spark, sf):
    path = work_path(spark, "model")
    alpha = [r["alpha"] for r in language_alpha(spark, sf).orderBy("topic").collect()]
    models.write_model(language_model(spark, sf), alpha, FIT_ALPHA0, path)
    return models.read_topic_word(spark, f"{path}/topic_word_k{len(alpha)}.parquet").withColumn("p", rounded("p", 10))


def topic_matrix(spark, sf):
    wide = models.topic_matrix(language_model(spark, sf), len(PRIOR))
    return wide.select("term_id", *[rounded(f"topic_{t}", 10).alias(f"topic_{t}") for t in range(len(PRIOR))])


def rescaled_alpha(spark, sf):
    return models.rescaled_alpha(language_alpha(spark, sf), 5.0).withColumn("alpha", rounded("alpha"))


def run_metrics(spark, sf):
    path = work_path(spark, "job")
    docs = f"{path}/docs.parquet"
    made = corpus(spark, sf)
    doc_tables.write_docs(made, docs)
    if is_stored(made):
        let_go(made)
    cfg = JobConfig(k=FIT_TOPICS, alpha0=FIT_ALPHA0, inputs=(docs,), output_dir=path, min_words=3)
    job.run_job(spark, cfg)
    figures = spark.read.json(f"{path}/TD_runningTime_k{FIT_TOPICS}.json")
    return figures.select("k", "n_docs", "vocab_size", ((F.col("fit_seconds") > 0) & (F.col("total_seconds") >= F.col("fit_seconds"))).alias("timed"))


# --- words, counts, filters ------------------------------------------------------------------

def assign_doc_ids(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn")
    return terms.assign_doc_ids(turns, ["conv_id", "turn"])


def tokenize(spark, sf):
    return words(spark, sf, stop=False)


def remove_stopwords(spark, sf):
    said = terms.tokenize(table(spark, sf, "conversations"), (), "conv_id")
    return terms.remove_stopwords(said, stopwords.default_stopwords(spark))


def remove_long_stopword_list(spark, sf):
    """A list taken from another table, beyond the size that is tested in place."""
    listed = terms.tokenize(table(spark, sf, "benchmark"), (), "item_id").select("term").distinct()
    said = terms.tokenize(table(spark, sf, "conversations"), (), "conv_id")
    return terms.remove_stopwords(said, listed, max_list=0)


def word_count(spark, sf):
    return terms.word_count(words(spark, sf))


def vocab_topk(spark, sf):
    return terms.vocab_topk(terms.word_count(words(spark, sf)), TOP)


def vocab_all(spark, sf):
    return terms.vocab_topk(terms.word_count(words(spark, sf)), -1)


def vocab_stats(spark, sf):
    counts = terms.word_count(words(spark, sf))
    return terms.vocab_stats(counts, terms.vocab_topk(counts, TOP))


def doc_term(spark, sf):
    return corpus(spark, sf, TOP)


def doc_length(spark, sf):
    return terms.doc_length(corpus(spark, sf))


def min_words_filter(spark, sf):
    return terms.min_words_filter(corpus(spark, sf), MIN_WORDS)


def valid_docs(spark, sf):
    return terms.valid_docs(corpus(spark, sf)).select("doc_id", "term_id", "cnt", "len")


def term_distribution(spark, sf):
    return terms.term_distribution(corpus(spark, sf)).withColumn("share", rounded("share", 10))


def token_total(spark, sf):
    return terms.token_total(corpus(spark, sf))


def corpus_summary(spark, sf):
    return terms.corpus_summary(corpus(spark, sf))


def to_features(spark, sf):
    """Size and sums of each vector, from its entries alone: written out, it has a number for each term of the vocabulary."""
    made = built(spark, sf)
    rows = terms.vector_entries(terms.to_features(made.docs, made.vocab_size), "features")
    placed = F.zip_with("values", "indices", lambda v, i: v * (i + 1))
    return rows.select(
        "doc_id", "size", F.aggregate("values", F.lit(0.0), lambda a, b: a + b).alias("total"),
        F.aggregate(placed, F.lit(0.0), lambda a, b: a + b).alias("weighted"))


def doc_freq(spark, sf):
    return weights.doc_freq(corpus(spark, sf))


def idf(spark, sf):
    made = built(spark, sf)
    return weights.idf(made.docs, made.vocab_size, made.n_docs).withColumn("idf", rounded("idf"))


def low_idf_terms(spark, sf):
    made = built(spark, sf, stop=False)
    ratios = weights.idf(made.docs, made.vocab_size, made.n_docs)
    return weights.low_idf_terms(ratios, IDF_BOUND).withColumn("idf", rounded("idf"))


def filter_idf(spark, sf):
    made = built(spark, sf, stop=False)
    return weights.filter_idf(made.docs, made.vocab_size, IDF_BOUND, made.n_docs)


def m1(spark, sf):
    made = built(spark, sf)
    return weights.first_moment(made.docs, made.vocab_size).withColumn("m1", rounded("m1", 10))


# --- moments ---------------------------------------------------------------------------------

def m2_exact(spark, sf):
    """Every cell of the second moment over all words, summed up by its row: number, sum, squares and a sum by column."""
    made = built(spark, sf)
    docs = fit.by_document(made.docs)
    cells = moments.second_moment(docs.filter(F.col("len") >= 3), fit.term_table(docs), made.vocab_size, ALPHA0)
    return cells.groupBy("i").agg(F.count("*").alias("n_cells"), rounded(F.sum("v"), 10).alias("total"), rounded(F.sum(F.col("v") * F.col("v")), 12).alias("squares"),
                                  rounded(F.sum(F.col("v") * (F.col("j") % 101 + 1)), 8).alias("by_column"))


def m2_exact_orders(spark, sf):
    """The second moment of the orders' suppliers, cell by cell, in blocks of 32 terms."""
    docs = fit.by_document(order_corpus(spark, sf)).filter(F.col("len") >= 3)
    size = (docs.agg(F.max("term_id")).first()[0] or 0) + 1
    return moments.pair_moment(docs, size, block=32).withColumn("v", rounded("v", 10))


def m2_project(spark, sf):
    docs, sums = order_rows(spark, sf)
    out = moments.project_second_moment(docs, rule_matrix(sums.terms, "term_id"), sums, ALPHA0)
    return out.select("term_id", *[rounded(f"c{j}", 12).alias(f"c{j}") for j in range(RANK)])


def m2_project_by_term(spark, sf):
    """The way for matrices that cannot be broadcast: documents written by term, once for all passes."""
    docs, sums = order_rows(spark, sf)
    sums = replace(sums, layout=layout.by_term(docs, sums.terms))
    out = moments.project_second_moment(docs, rule_matrix(sums.terms, "term_id"), sums, ALPHA0)
    return out.select("term_id", *[rounded(f"c{j}", 12).alias(f"c{j}") for j in range(RANK)])


def m2_project_masked(spark, sf):
    made = built(spark, sf, stop=False)
    docs = fit.by_document(made.docs)
    sums, valid = fit.term_table(docs, made.n_docs, IDF_BOUND), docs.filter(F.col("len") >= 3)
    out = moments.project_second_moment(valid, rule_matrix(weights.all_terms(spark, made.vocab_size), "term_id"),
                                        fit.with_layout(valid, sums, RANK), ALPHA0)
    return out.select("term_id", *[rounded(f"c{j}", 12).alias(f"c{j}") for j in range(RANK)])


def whitening_matrix(spark, sf):
    keys = order_corpus(spark, sf).select("term_id").distinct()
    out = moments.whitening_matrix(rule_matrix(keys, "term_id"), SIGMA)
    return out.select("term_id", *[rounded(f"c{j}", 10).alias(f"c{j}") for j in range(RANK)])


def whiten_docs(spark, sf):
    docs, sums = order_rows(spark, sf)
    out = moments.project_docs(docs, rule_matrix(sums.terms, "term_id"), sums)
    return out.select("doc_id", "len", *[rounded(f"p{j}").alias(f"p{j}") for j in range(RANK)])


def whiten_first_moment(spark, sf):
    _docs, sums = order_rows(spark, sf)
    q = moments.whiten_first_moment(rule_matrix(sums.terms, "term_id"), sums)
    return spark.createDataFrame([(j, float(v)) for j, v in enumerate(q)], "j int, q double").withColumn(
        "q", rounded("q", 10))


def _third(spark, sf, part: Callable) -> DataFrame:
    docs, sums = order_rows(spark, sf)
    white = rule_matrix(sums.terms, "term_id")
    cells = moments.tensor_cells(docs, part(docs, sums, white, moments.whiten_first_moment(white, sums)))
    return cells.withColumn("v", rounded("v", 10))


def m3_first(spark, sf):
    return _third(spark, sf, lambda docs, sums, white, q: moments.third_moment_from_docs(
        moments.project_docs(docs, white, sums), RANK, q, ALPHA0, sums.n_docs))


def m3_second(spark, sf):
    return _third(spark, sf, lambda docs, sums, white, q: moments.third_moment_from_pairs(
        moments.third_moment_term_vectors(docs, moments.project_docs(docs, white, sums), RANK),
        white, sums, RANK, q, ALPHA0))


def m3_third(spark, sf):
    return _third(spark, sf, lambda docs, sums, white, q: moments.third_moment_from_triples(white, sums, RANK))


def m3_whitened(spark, sf):
    return _third(spark, sf, lambda docs, sums, white, q: moments.whitened_third_moment(docs, white, sums, ALPHA0))


def m3_wide(spark, sf):
    """The whitened third moment of eight columns, whose sums are packed per task."""
    docs, sums = order_rows(spark, sf)
    white = rule_matrix(sums.terms, "term_id", WIDE)
    return moments.tensor_cells(docs, moments.whitened_third_moment(docs, white, sums, ALPHA0)).withColumn("v", rounded("v", 9))


def orthonormalize_steep(spark, sf):
    """Powers of a price, columns that are nearly dependent: what must hold of their orthonormal basis."""
    x = F.col("o_totalprice") / 600000.0
    prices = table(spark, sf, "orders").select("o_orderkey", *[F.pow(x, F.lit(j)).alias(f"c{j}") for j in range(WIDE)])
    out = matrix.orthonormalize(prices, "o_orderkey")
    return matrix.gram(out, matrix.columns(out)).select("i", "j", rounded("v", 12).alias("v"))


def gaussian_matrix(spark, sf):
    vocab = terms.vocab_topk(terms.word_count(words(spark, sf)), ALL)
    out = matrix.gaussian_matrix(vocab, "term_id", RANK, 7)
    return out.select("term_id", *[rounded(f"c{j}").alias(f"c{j}") for j in range(RANK)])


def _eigen(made: job.Corpus, find: Callable) -> DataFrame:
    """What must hold of eigenpairs of the second moment, measured by another pass over the documents.

    For ranks i and j: u_i·u_j, and (M u_i)·(M u_j) over both eigenvalues (1 or 0); for i = j also |M u - s u| over s.
    """
    docs = fit.prepare(made.docs)
    try:
        valid = docs.filter(F.col("len") >= 3)
        sums = fit.with_layout(valid, fit.term_table(docs, made.n_docs), 2 * FIT_TOPICS)
        vectors, values = find(valid, sums, made.vocab_size)
        vectors = cut(vectors)
        image = moments.project_second_moment(valid, vectors, sums, FIT_ALPHA0)
        cols = matrix.columns(vectors)
        both = vectors.join(image.selectExpr("term_id", *[f"c{j} as m{j}" for j in range(len(cols))]), "term_id")
        products = matrix.gram_matrix(both, [*cols, *[f"m{j}" for j in range(len(cols))]])
    finally:
        docs.unpersist()
    k = len(cols)
    rows = [(i, j, float(products[i, j]), float(products[k + i, k + j] / values[i] / values[j]),
             float(np.sqrt(max(products[k + i, k + i] - 2 * values[i] * products[i, k + i] + values[i] ** 2, 0.0)) / values[i]) if i == j else None)
            for i in range(k) for j in range(k)]
    found = made.docs.sparkSession.createDataFrame(rows, "i int, j int, dot double, image_dot double, residual double")
    return found.select("i", "j", rounded("dot").alias("dot"), rounded("image_dot", 6).alias("image_dot"), "residual")


def topk_eigen_m2(spark, sf):
    """Randomised iteration: vectors and images are orthogonal; the residual hangs on the number of iterations."""
    found = _eigen(built(spark, sf), lambda docs, sums, n: moments.top_eigen(docs, sums, n, FIT_TOPICS, FIT_ALPHA0))
    return found.drop("residual")


def topk_eigen_exact(spark, sf):
    """Lanczos on the stored second moment of the conversations' words, all of them."""
    said = spread(table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), "text"))
    made = job.corpus_from_texts(said, ALL, stopwords.ENGLISH)
    found = _eigen(made, lambda docs, sums, n: moments.top_eigen_exact(docs, sums, n, FIT_TOPICS, FIT_ALPHA0))
    return found.withColumn("residual", rounded("residual", 6))


def topk_eigen_one(spark, sf):
    """The leading eigenvector, with its entries summing to a positive number."""
    made = built(spark, sf)
    docs = fit.prepare(made.docs)
    try:
        valid = docs.filter(F.col("len") >= 3)
        sums = fit.with_layout(valid, fit.term_table(docs, made.n_docs), 2)
        vectors, values = moments.top_eigen(valid, sums, made.vocab_size, 1, FIT_ALPHA0)
    finally:
        docs.unpersist()
    sign = float(np.sign(matrix.sums(vectors, ["c0"])[0]))
    return vectors.select("term_id", rounded(F.col("c0") * sign).alias("weight"),
                          rounded(F.lit(float(values[0])), 10).alias("eigenvalue"))


# --- matrices --------------------------------------------------------------------------------

def gram(spark, sf):
    wide = table(spark, sf, "embeddings").selectExpr(*[f"cast(embedding[{j}] as double) as c{j}" for j in range(64)])
    return matrix.gram(wide, matrix.columns(wide)).withColumn("v", rounded("v"))


def order_measures(spark, sf):
    """A tall matrix: sums of three measures by order."""
    return (table(spark, sf, "lineitem").groupBy("l_orderkey")
            .agg(F.sum("l_quantity").alias("c0"), F.sum("l_extendedprice").alias("c1"),
                 F.sum(F.col("l_discount") * 100).alias("c2")))


def gram_tall(spark, sf):
    out = matrix.gram(order_measures(spark, sf), ["c0", "c1", "c2"])
    return out.withColumn("v", rounded(F.col("v") / 1e9))


def orthonormalize(spark, sf):
    out = matrix.orthonormalize(order_measures(spark, sf), "l_orderkey")
    return out.select("l_orderkey", *[rounded(f"c{j}", 10).alias(f"c{j}") for j in range(3)])


def normalize_columns(spark, sf):
    return matrix.normalize_columns(embedding_entries(spark, sf)).withColumn("v", rounded("v"))


def frobenius_norm(spark, sf):
    return matrix.frobenius_norm(embedding_entries(spark, sf)).withColumn("norm", rounded("norm"))


def condition_number(spark, sf):
    values = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("v"))
    return matrix.condition_number(values).withColumn("condition", rounded("condition"))


def column_dots(spark, sf):
    old = matrix.normalize_columns(embedding_entries(spark, sf))
    new = matrix.normalize_columns(embedding_entries(spark, sf).withColumn("v", F.col("v") + F.abs("v")))
    return matrix.column_dots(old, new, 0.3).withColumn("dot", rounded("dot"))


# --- tensors ---------------------------------------------------------------------------------

def _line_vector(spark, sf, measure: str) -> DataFrame:
    return (table(spark, sf, "lineitem").groupBy(flag().alias("comp"), F.col("l_linenumber").alias("idx"))
            .agg(F.avg(measure).alias("v")))


def rank_one_tensor(spark, sf):
    vectors = [_line_vector(spark, sf, m) for m in ("l_quantity", "l_discount", "l_tax")]
    return tensor.rank_one(*vectors).withColumn("v", rounded("v"))


def unfold_tensor(spark, sf):
    return tensor.unfold(line_tensor(spark, sf), 12).withColumn("v", rounded("v"))


def fold_tensor(spark, sf):
    return tensor.fold(tensor.unfold(line_tensor(spark, sf), 12), 12).withColumn("v", rounded("v"))


def khatri_rao(spark, sf):
    lines = table(spark, sf, "lineitem")
    a = (lines.groupBy((F.col("l_linenumber") - 1).alias("row"), flag().alias("col"))
         .agg(F.avg("l_quantity").alias("v")))
    b = (lines.groupBy((F.month("l_shipdate") - 1).alias("row"), flag().alias("col"))
         .agg(F.avg("l_discount").alias("v")))
    return tensor.khatri_rao(a, b, 12).withColumn("v", rounded("v"))


def _rule_factor(cells: DataFrame, mode: str) -> DataFrame:
    return rule_matrix(cells.select(F.col(mode).alias("row")).distinct(), "row")


def mttkrp(spark, sf):
    cells = line_tensor(spark, sf)
    out = tensor.mttkrp(cells, ("i", "j", "l"), _rule_factor(cells, "j"), _rule_factor(cells, "l"))
    return out.select("row", *[rounded(f"c{r}").alias(f"c{r}") for r in range(RANK)])


def cp_loss(spark, sf):
    cells = line_tensor(spark, sf)
    factors = [_rule_factor(cells, m) for m in ("i", "j", "l")]
    return tensor.cp_loss(cells, *factors, LAMBDA).withColumn("loss", rounded("loss"))


def cp_loss_exact(spark, sf):
    """The loss of a tensor that is its decomposition, by line number, month and supplier: none beyond rounding."""
    lines = line_tensor(spark, sf)
    parts = [_rule_factor(lines, m) for m in ("i", "j", "l")]
    vectors = [f.select(F.posexplode(F.array("c0", "c1")).alias("comp", "v"), "row").select("comp", F.col("row").alias("idx"), "v") for f in parts]
    scaled = vectors[0].withColumn("v", F.col("v") * F.when(F.col("comp") == 0, 4.0).otherwise(0.5))
    cells = tensor.rank_one(scaled, *vectors[1:]).groupBy("i", "j", "l").agg(F.sum("v").alias("v"))
    loss = tensor.cp_loss(cells, *[f.select("row", "c0", "c1") for f in parts], (4.0, 0.5))
    whole = cells.agg(F.count("*").alias("n_cells"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))  # one row, as the loss
    return whole.crossJoin(F.broadcast(loss)).select("n_cells", (F.col("loss") <= 1e-12 * F.col("norm")).alias("exact"))


def cp_als(spark, sf):
    """Two components, from the better of two starts, after a fixed number of rounds."""
    a, _b, _c, values, loss = tensor.cp_als(line_tensor(spark, sf), 2, max_iter=ALS_ROUNDS, tol=1e-15,
                                            restarts=ALS_STARTS)
    found = [rounded(F.lit(float(v)), 6) for v in values]
    return a.select("row", rounded("c0", 6).alias("c0"), rounded("c1", 6).alias("c1"), found[0].alias("weight_0"),
                    found[1].alias("weight_1"), rounded(F.lit(float(loss)), 5).alias("loss"))


# --- simplex and recovery --------------------------------------------------------------------

def simplex_project(spark, sf):
    out = simplex.project(embedding_vectors(spark, sf))
    return out.select("vec_id", "row", rounded("v").alias("v"), rounded("theta").alias("theta"))


def simplex_project_long(spark, sf):
    """The way for vectors that are too long to sort in one task."""
    out = simplex.project(embedding_vectors(spark, sf), sort_limit=0)
    return out.select("vec_id", "row", rounded("v").alias("v"), rounded("theta").alias("theta"))


def simplex_project_signed(spark, sf):
    out = simplex.project_signed(embedding_vectors(spark, sf))
    return out.select("vec_id", "row", rounded("v").alias("v"), "sign")


def unwhiten(spark, sf):
    keys = order_corpus(spark, sf).select("term_id").distinct()
    out = fit.unwhiten(rule_matrix(keys, "term_id"), SIGMA, np.array(FACTOR), LAMBDA)
    return out.select("term_id", *[rounded(f"c{j}", 10).alias(f"c{j}") for j in range(RANK)])


def order_topics(spark, sf):
    return fit.order_topics(language_alpha(spark, sf)).withColumn("alpha", rounded("alpha"))


# --- models ----------------------------------------------------------------------------------

def smooth_beta(spark, sf):
    made = built(spark, sf)
    out = _smoothed(spark, sf, made)
    return out.withColumn("p", rounded("p", 12))


def validate_model(spark, sf):
    return likelihood.validate(language_model(spark, sf)).drop("least").withColumn("total", rounded("total"))


def augment_topics(spark, sf):
    made = built(spark, sf)
    model = language_model(spark, sf, made.docs)
    out, _alpha = likelihood.add_background_topic(model, PRIOR, weights.first_moment(made.docs, made.vocab_size), made.vocab_size)
    return out.withColumn("p", rounded("p", 12))


def _smoothed(spark, sf, made):
    return likelihood.smooth(language_model(spark, sf, made.docs), range(len(PRIOR)), made.vocab_size, SMOOTHING)


def infer_topics(spark, sf):
    made = built(spark, sf)
    out = likelihood.infer_topics(made.docs, _smoothed(spark, sf, made), PRIOR, made.vocab_size, INFER_ITERATIONS, seed=3)
    return out.withColumn("gamma", rounded("gamma", 6))


def doc_bounds(spark, sf):
    made = built(spark, sf)
    out = likelihood.doc_bounds(made.docs, _smoothed(spark, sf, made), PRIOR, made.vocab_size, INFER_ITERATIONS, seed=3)
    return out.select("doc_id", rounded("bound", 5).alias("bound"), "skipped")


def log_likelihood(spark, sf):
    made = built(spark, sf)
    out = likelihood.log_likelihood(made.docs, language_model(spark, sf, made.docs), PRIOR, made.vocab_size, SMOOTHING,
                                    INFER_ITERATIONS, seed=3)
    return out.select(rounded("log_likelihood", 3).alias("log_likelihood"), "skipped_tokens", "tokens")


def infer_topics_shaped(spark, sf):
    """Inference that starts from gamma numbers of shape 2.5, until it settles."""
    made = built(spark, sf)
    out = likelihood.infer_topics(made.docs, _smoothed(spark, sf, made), PRIOR, made.vocab_size, INFER_ITERATIONS, gamma_shape=2.5, seed=3)
    totals = out.groupBy("doc_id").agg(F.sum("gamma").alias("total"))
    return totals.join(made.docs.groupBy("doc_id").agg(F.sum("cnt").alias("len")), "doc_id").select(
        "doc_id", rounded(F.col("total") - F.col("len"), 6).alias("prior"))


def gamma_starts(spark, sf):
    """A number of each of two shapes that are not whole, for every order."""
    return table(spark, sf, "orders").select("o_orderkey", *[rounded(F.expr(chance.gamma(5, shape, "o_orderkey", k)), 8).alias(f"g{k}")
                                                             for k, shape in enumerate(SHAPES)])


def multinomial_loglik(spark, sf):
    docs = corpus(spark, sf)
    totals = docs.groupBy("term_id").agg(F.sum("cnt").alias("n"))
    whole = docs.agg(F.sum("cnt").alias("total"))  # one row
    p = totals.crossJoin(F.broadcast(whole)).select("term_id", (F.col("n") / F.col("total")).alias("p"))
    return likelihood.multinomial_log_likelihood(docs, p).withColumn("log_likelihood", rounded("log_likelihood", 6))


def log_gamma(spark, sf):
    x = F.col("o_totalprice") / 1000 + 0.25
    return table(spark, sf, "orders").select("o_orderkey", rounded(special.lgamma(x), 7).alias("log_gamma"))


def dirichlet_expectation(spark, sf):
    parts = F.transform("embedding", lambda v: F.abs(v.cast("double")) + 0.05)
    rows = table(spark, sf, "embeddings").select("vec_id", special.dirichlet_expectation(parts).alias("e"))
    return rows.select("vec_id", F.posexplode("e").alias("row", "v")).withColumn("v", rounded("v", 6))


def log_sum_exp(spark, sf):
    values = F.transform("embedding", lambda v: v.cast("double") * 500)
    return table(spark, sf, "embeddings").select("vec_id", rounded(special.log_sum_exp(values)).alias("v"))


def fit_moments(spark, sf):
    """What must hold of the moments of a fit: orthonormal eigenvectors, a whitened third moment equal to a pass of its own
    with the same vectors, and a first moment that sums to one."""
    options = MomentOptions(k=FIT_TOPICS, alpha0=FIT_ALPHA0)
    made = built(spark, sf)
    found = fit.fit_moments(made.docs, options, made.vocab_size, made.n_docs)
    docs = fit.prepare(made.docs)
    try:
        valid = docs.filter(F.col("len") >= 3)
        sums = fit.with_layout(valid, fit.term_table(docs, made.n_docs), FIT_TOPICS)
        white = moments.whitening_matrix(found.eigenvectors, found.eigenvalues)
        third = moments.whitened_third_moment(valid, white, sums, FIT_ALPHA0)
    finally:
        docs.unpersist()
    products = matrix.gram_matrix(found.eigenvectors, matrix.columns(found.eigenvectors))
    total = found.first.agg(F.sum("m1")).first()[0]
    even = np.abs(third - found.third).max() <= 1e-8 * np.abs(found.third).max()
    rows = [(i, j, float(products[i, j]), float(total), made.vocab_size, bool(even)) for i in range(FIT_TOPICS) for j in range(FIT_TOPICS)]
    out = spark.createDataFrame(rows, "i int, j int, dot double, first_total double, n_terms bigint, third_repeats boolean")
    return out.withColumns({"dot": rounded("dot"), "first_total": rounded("first_total")})


def fitted(spark, sf):
    """A fit of all words of the documents: words by topic with the topic's weight."""
    made = built(spark, sf)
    model = fit.TopicMoments(FIT_TOPICS, FIT_ALPHA0).fit(made.docs, made.vocab_size, made.n_docs)
    alpha = F.element_at(F.array(*[F.lit(a) for a in model.alpha]), F.col("topic") + 1)
    named = made.vocab.select("term_id", "term")
    if fits_broadcast(spark, table_bytes(named)):
        named = F.broadcast(named)
    return (model.topic_word.join(named, "term_id")
            .select("topic", alpha.alias("alpha"), "term_id", "term", "p"))


def fit_topics(spark, sf):
    """What must hold of the learned topics: all words, none negative, sums of one, weights from the largest down."""
    by_topic = fitted(spark, sf).groupBy("topic").agg(F.count("*").alias("n_terms"), rounded(F.sum("p")).alias("total"), F.min("p").alias("least"),
                                                      F.max("alpha").alias("alpha"))
    # one row for each topic, so this window is small
    falling = F.coalesce(F.col("alpha") <= F.lag("alpha").over(W.orderBy("topic")), F.lit(True)) & (F.col("alpha") > 0)
    return by_topic.select("topic", "n_terms", "total", (F.col("least") >= 0).alias("admissible"), falling.alias("falling"))


def fit_one_topic(spark, sf):
    """The whole fit for one topic, which has no choice of start."""
    made = built(spark, sf)
    model = fit.TopicMoments(1, FIT_ALPHA0).fit(made.docs, made.vocab_size, made.n_docs)
    return model.topic_word.select("term_id", rounded("p").alias("p"),
                                   rounded(F.lit(model.alpha[0]), 6).alias("alpha"))


# --- evaluation ------------------------------------------------------------------------------

def split_docs(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    both = [evaluate.with_split(docs, r, 11).withColumn("rep", F.lit(r)) for r in (0, 1)]
    return both[0].unionByName(both[1])


def _scores(found: DataFrame, vocab_size: int) -> DataFrame:
    """Scores as what must hold of them: finite, and of our method better than a guess among all words."""
    most = F.when(F.col("method") == "moments", float(np.log(vocab_size))).otherwise(1e6)
    return found.select("rep", "method", "tokens", F.col("log_perplexity").between(0.0, most).alias("sound"))


def heldout_perplexity(spark, sf):
    made = built(spark, sf)
    docs = made.docs.persist()
    try:
        return _scores(evaluate.heldout_perplexity(docs, made.vocab_size, FIT_TOPICS, FIT_ALPHA0), made.vocab_size)
    finally:
        docs.unpersist()


def cv_log_perplexity(spark, sf):
    made = built(spark, sf)
    return _scores(evaluate.cv_log_perplexity(made.docs, made.vocab_size, 2, FIT_TOPICS, FIT_ALPHA0, min_words=3), made.vocab_size)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    read_text_corpus, read_text_repeated_path, compact_small_files, write_docs, idf_after_round_trip, read_docs, read_docs_several, read_libsvm,
    read_libsvm_class_labels, read_dok, read_stopwords,
    write_model, topic_matrix, rescaled_alpha, run_metrics,
    assign_doc_ids, tokenize, remove_stopwords, remove_long_stopword_list, word_count, vocab_topk, vocab_all,
    vocab_stats, doc_term, doc_length, min_words_filter, valid_docs, term_distribution, token_total,
    corpus_summary, to_features, doc_freq, idf, low_idf_terms, filter_idf, m1,
    m2_exact, m2_exact_orders, m2_project, m2_project_by_term, m2_project_masked, whitening_matrix, whiten_docs, whiten_first_moment,
    m3_first, m3_second, m3_third, m3_whitened, m3_wide, gaussian_matrix, topk_eigen_m2, topk_eigen_exact, topk_eigen_one,
    gram, gram_tall, orthonormalize, orthonormalize_steep, normalize_columns, frobenius_norm, condition_number, column_dots,
    rank_one_tensor, unfold_tensor, fold_tensor, khatri_rao, mttkrp, cp_loss, cp_loss_exact, cp_als,
    simplex_project, simplex_project_long, simplex_project_signed, unwhiten, order_topics,
    smooth_beta, validate_model, augment_topics, infer_topics, infer_topics_shaped, gamma_starts, doc_bounds, log_likelihood, multinomial_loglik,
    log_gamma, dirichlet_expectation, log_sum_exp, fit_moments, fit_topics, fit_one_topic,
    split_docs, heldout_perplexity, cv_log_perplexity)}
