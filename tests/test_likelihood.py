import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import twins
from topicmoments import TopicModel, runtime
from topicmoments.functions import special
from topicmoments.functions.chance import gamma_integer
from topicmoments.operators import likelihood
from topicmoments.plans import evaluate

WORDS = "topic int, term_id int, p double"


def topic_frame(spark, beta):
    return spark.createDataFrame([(k, t, float(beta[t, k])) for t in range(beta.shape[0]) for k in range(beta.shape[1])], WORDS)


def random_model(seed, v=30, k=3):
    return np.random.default_rng(seed).dirichlet(np.full(v, 0.3), size=k).T


def test_special_functions(spark):
    xs = [1e-3, 0.1, 0.5, 1.0, 1.5, 2.0, 7.9, 8.0, 55.5, 1e4, 1e7]
    frame = spark.createDataFrame([(x,) for x in xs], "x double").select(
        "x", special.lgamma(F.col("x")).alias("lg"), special.digamma(F.col("x")).alias("dg"))
    rows = frame.collect()
    arr = np.array([r["x"] for r in rows])
    for r, lg, dg in zip(rows, special.lgamma_np(arr), special.digamma_np(arr)):
        assert r["lg"] == pytest.approx(math.lgamma(r["x"]), rel=1e-12, abs=1e-11) == lg
        step = 1e-5 * r["x"]
        slope = (math.lgamma(r["x"] + step) - math.lgamma(r["x"] - step)) / (2 * step)
        assert r["dg"] == pytest.approx(slope, rel=1e-4) and r["dg"] == pytest.approx(dg, rel=1e-14)
    assert special.digamma_np(np.array([1.0, 0.5])) == pytest.approx(
        [-0.5772156649015329, -0.5772156649015329 - 2 * math.log(2)], abs=1e-13)


def test_multinomial_log_likelihood(spark):
    docs = twins.doc_frame(spark, np.array([[20, 50, 30], [40, 40, 20]]), 1)
    p = spark.createDataFrame([(0, .2), (1, .5), (2, .3)], "term_id int, p double")
    got = {r["doc_id"]: r["log_likelihood"] for r in likelihood.multinomial_log_likelihood(docs, p).collect()}
    assert [got[1], got[2]] == pytest.approx([-4.6975456, -15.4203801], abs=1e-6)
    zero = spark.createDataFrame([(9, 0, 2.0), (9, 1, 0.0)], twins.SCHEMA)
    q = spark.createDataFrame([(0, 1.0), (1, 0.0)], "term_id int, p double")
    assert likelihood.multinomial_log_likelihood(zero, q).first()["log_likelihood"] == pytest.approx(0.0, abs=1e-12)


def infer_one(ids, counts, beta, gamma, alpha, max_iter):
    """One document at a time, straight from the definition."""
    words, steps, change = beta[ids], 0, 1.0
    while steps < max_iter and change > 1e-3:
        weight = np.exp(special.digamma_np(gamma) - special.digamma_np(np.array([gamma.sum()])))
        phi = words @ weight + 1e-100
        new = weight * (words.T @ (counts / phi)) + alpha
        change, gamma, steps = np.abs(new - gamma).mean(), new, steps + 1
    return gamma


def bound_one(ids, counts, beta, gamma, alpha):
    e = special.digamma_np(gamma) - special.digamma_np(np.array([gamma.sum()]))
    total = 0.0
    for t, n in zip(ids, counts):
        if (np.log(beta[t]) > -20).any():
            total += n * np.log(np.exp(e + np.log(beta[t])).sum())
    total += ((alpha - gamma) * e).sum() + sum(math.lgamma(g) for g in gamma) - sum(math.lgamma(a) for a in alpha)
    return total + math.lgamma(alpha.sum()) - math.lgamma(gamma.sum())


@pytest.mark.parametrize("limit", [None, "0"])
def test_inference_and_bound_equal_the_definition(spark, limit):
    rng = np.random.default_rng(1)
    beta, alpha = random_model(2) * 0.99 + 0.01 / 30, np.array([0.3, 0.8, 0.1])
    counts = rng.poisson(0.6, size=(40, 30)).astype(float)
    docs, words = twins.doc_frame(spark, counts, 0), topic_frame(spark, beta)
    starts = docs.select("doc_id").distinct().selectExpr(
        "doc_id", *[f"{gamma_integer(5, 1, 'doc_id', k)} as g{k}" for k in range(3)])
    start = {r["doc_id"]: np.array([r["g0"], r["g1"], r["g2"]]) for r in starts.collect()}
    if limit is not None:
        spark.conf.set(runtime.BROADCAST_CONF, limit)
    try:
        got = {}
        for r in likelihood.infer_topics(docs, words, alpha, 30, 50, seed=5).collect():
            got.setdefault(r["doc_id"], np.zeros(3))[r["topic"]] = r["gamma"]
        bounds = {r["doc_id"]: r["bound"] for r in likelihood.doc_bounds(docs, words, alpha, 30, 50, seed=5).collect()}
    finally:
        spark.conf.unset(runtime.BROADCAST_CONF)
    for d in range(40):
        ids = np.flatnonzero(counts[d])
        expect = infer_one(ids, counts[d, ids], beta, start[d], alpha, 50)
        assert np.allclose(got[d], expect, rtol=1e-9)
        assert bounds[d] == pytest.approx(bound_one(ids, counts[d, ids], beta, expect, alpha), rel=1e-9)


def test_gamma_starts_have_mean_one(spark):
    for shape in (1, 4):
        row = spark.range(20000).selectExpr(f"{gamma_integer(1, shape, 'id', 0)} as g").selectExpr(
            "avg(g) as m", "var_samp(g) as v").first()
        assert row["m"] == pytest.approx(1.0, abs=0.03) and row["v"] == pytest.approx(1 / shape, rel=0.1)


def test_words_that_no_topic_explains_are_left_out_and_reported(spark):
    beta = np.array([[0.7, 0.2], [0.3, 0.8], [0.0, 0.0]])
    docs = spark.createDataFrame([(1, 0, 3.0), (1, 2, 4.0), (2, 1, 1.0)], twins.SCHEMA)
    row = TopicModel(topic_frame(spark, beta), [0.5, 0.5], 3).log_likelihood(docs, 1e-12, 20).first()
    assert row["skipped_tokens"] == 4.0 and row["tokens"] == 8.0 and math.isfinite(row["log_likelihood"])


def test_smoothing_reaches_every_term(spark):
    words = spark.createDataFrame([(0, 0, 1.0), (1, 2, 1.0)], WORDS)
    rows = likelihood.smooth(words, [0, 1], 4, 0.2).collect()
    assert len(rows) == 8 and sum(r["p"] for r in rows) == pytest.approx(2.0)
    assert min(r["p"] for r in rows) == pytest.approx(0.05)
    likelihood.check_model(likelihood.smooth(words, [0, 1], 4, 0.2), [1.0, 1.0], smoothed=True)


@pytest.mark.parametrize("rows, alpha", [
    ([(0, 0, -0.1), (0, 1, 1.1)], [1.0]), ([(0, 0, 1.0)], [0.0]), ([(0, 0, 1.0)], [1.0, 1.0])])
def test_bad_models_are_refused(spark, rows, alpha):
    with pytest.raises(ValueError):
        TopicModel(spark.createDataFrame(rows, WORDS), alpha, 2)


def test_background_topic(spark):
    m1 = spark.createDataFrame([(0, 0.5), (1, 0.5), (2, 0.0)], "term_id int, m1 double")
    words, alpha = likelihood.add_background_topic(spark.createDataFrame([(0, 0, 1.0)], WORDS), [2.0], m1, 3)
    got = {r["term_id"]: r["p"] for r in words.filter("topic = 1").collect()}
    assert alpha == [2.0, 1.0] and sum(got.values()) == pytest.approx(1.0)
    assert got[2] == pytest.approx(0.1 / 3 / 1.1)


def test_splits_are_stable_and_by_document(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "explode(array(0, 1, 2)) as term_id", "1D as cnt")
    train, test = evaluate.split_docs(docs, 0, seed=1)
    held = {r["doc_id"] for r in test.select("doc_id").distinct().collect()}
    assert test.count() == 3 * len(held) and train.count() + test.count() == 12000
    assert 0.08 < len(held) / 4000 < 0.12
    assert {r["doc_id"] for r in evaluate.split_docs(docs.repartition(3), 0, seed=1)[1].collect()} == held
    assert {r["doc_id"] for r in evaluate.split_docs(docs, 1, seed=1)[1].collect()} != held


def test_held_out_documents_score_better_than_one_distribution(spark):
    rng = np.random.default_rng(3)
    topics = np.full((12, 2), 0.02)
    topics[:6, 0] = topics[6:, 1] = 0.98 / 6
    topics /= topics.sum(axis=0)
    counts = twins.simulate(rng, [0.3, 0.2], topics, 300, 60)
    docs = twins.doc_frame(spark, counts, 0)
    rows = {r["method"]: r["log_perplexity"] for r in evaluate.cv_log_perplexity(docs, 12, 1, 2, 0.5).collect()}
    share = counts.sum(axis=0) / counts.sum()
    one = -(counts @ np.log(share)).sum() / counts.sum()
    assert rows["moments"] < one and rows["moments"] < rows["online variational"] + 0.05


def test_multinomial_without_broadcast_is_equal(spark):
    counts = np.random.default_rng(4).poisson(1.0, size=(30, 8)).astype(float)
    docs = twins.doc_frame(spark, counts, 0)
    p = spark.createDataFrame([(t, (t + 1) / 36) for t in range(7)], "term_id int, p double")
    small = sorted(map(tuple, likelihood.multinomial_log_likelihood(docs, p).collect()))
    spark.conf.set(runtime.BROADCAST_CONF, "0")
    try:
        large = sorted(map(tuple, likelihood.multinomial_log_likelihood(docs, p).collect()))
    finally:
        spark.conf.unset(runtime.BROADCAST_CONF)
    assert [r[0] for r in small] == [r[0] for r in large]
    assert np.allclose([r[1] for r in small], [r[1] for r in large]) and -math.inf in [r[1] for r in small]


def test_negative_counts_are_refused(spark):
    p = spark.createDataFrame([(0, 0.5), (1, 0.5)], "term_id int, p double")
    with pytest.raises(Exception, match="negative"):
        likelihood.multinomial_log_likelihood(spark.createDataFrame([(1, 0, -1.0)], twins.SCHEMA), p).collect()


def test_smoothed_topics_must_sum_to_one(spark):
    docs = spark.createDataFrame([(1, 0, 2.0)], twins.SCHEMA)
    words = spark.createDataFrame([(0, 0, 0.6), (0, 1, 0.3)], "topic int, term_id int, p double")
    with pytest.raises(ValueError, match="sum to one"):
        likelihood.log_likelihood(docs, words, [1.0], 2, 0.01, 5)


def test_gamma_starts_in_a_task_are_those_of_the_expression(spark):
    from topicmoments.functions.chance import gamma_integer, gamma_integer_np

    rows = spark.range(20).selectExpr("id", f"{gamma_integer(3, 2, 'id', 1)} as g").collect()
    assert all(abs(r["g"] - gamma_integer_np(3, 2, r["id"], 1)) < 1e-12 for r in rows)


@pytest.mark.parametrize("shape", [0.3, 2.5, 7.25, 2.0])
def test_gamma_of_any_shape(spark, shape):
    from topicmoments.functions.chance import gamma, gamma_np

    rows = spark.range(8000).selectExpr("id", f"{gamma(4, shape, 'id', 2)} as g").repartition(5).collect()
    draws = np.array([r["g"] for r in rows])
    assert (draws > 0).all() and abs(draws.mean() - 1) < 4 / np.sqrt(shape * 8000) and abs(draws.var() * shape - 1) < 0.12
    assert all(r["g"] == pytest.approx(gamma_np(4, shape, r["id"], 2), rel=1e-11) for r in rows[:500])
    # the share below one quarter is that of a large plain sample
    plain = np.random.default_rng(1).gamma(shape, 1 / shape, 200_000)
    for at in (0.25, 1.0, 2.0):
        assert abs((draws < at).mean() - (plain < at).mean()) < 0.02


def test_inference_starts_of_any_shape_settle_alike(spark):
    docs = twins.doc_frame(spark, np.random.default_rng(2).poisson(2.0, size=(6, 30)).astype(float))
    words = topic_frame(spark, random_model(3))
    found = [{(r["doc_id"], r["topic"]): r["gamma"] for r in likelihood.infer_topics(docs, words, [0.4, 0.3, 0.3], 30, 200, gamma_shape=g).collect()} for g in (1, 100.5)]
    assert found[0].keys() == found[1].keys() and all(abs(found[0][k] - found[1][k]) < 0.2 for k in found[0])


def test_inference_shuffles_placed_documents_not_again(spark):
    from topicmoments.plans.fit import by_document

    docs = by_document(twins.doc_frame(spark, np.random.default_rng(2).poisson(1.0, size=(9, 20)).astype(float)))
    found = likelihood.infer_topics(docs, topic_frame(spark, random_model(3, v=20)), [0.4, 0.3, 0.3], 20)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # the one that places them
    loose = twins.doc_frame(spark, np.eye(3)).withColumn("term_id", F.col("term_id") + 18)  # two of three terms are unknown, one document each
    some = likelihood.infer_topics(loose, topic_frame(spark, random_model(3, v=19)), [0.4, 0.3, 0.3], 19).select("doc_id").distinct().collect()
    assert [r["doc_id"] for r in some] == [1000]


def test_inference_shares_the_frequent_words_where_all_do_not_fit(spark):
    rng = np.random.default_rng(3)
    counts = rng.poisson(np.linspace(2.0, 0.05, 30), size=(40, 30)).astype(float)
    counts[7], counts[8, :12] = 0, 0
    counts[7, 29] = 3  # a document of rare words alone
    docs, words = twins.doc_frame(spark, counts, 0), topic_frame(spark, random_model(2) * 0.99 + 0.01 / 30)
    docs = docs.unionByName(spark.createDataFrame([(7, 77, 2.0), (99, 78, 1.0)], docs.schema))  # words that the model does not know
    whole = {(r["doc_id"], r["topic"]): r["gamma"] for r in likelihood.infer_topics(docs, words, [0.3, 0.8, 0.1], 30, seed=5).collect()}
    spark.conf.set(runtime.BROADCAST_CONF, str(12 * (runtime.row_bytes(4) + runtime.row_bytes(1))))
    try:
        found = likelihood.infer_topics(docs, words, [0.3, 0.8, 0.1], 30, seed=5)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {(r["doc_id"], r["topic"]): r["gamma"] for r in found.collect()}
    finally:
        spark.conf.unset(runtime.BROADCAST_CONF)
    assert "FullOuter" in plan and got.keys() == whole.keys() and not any(d == 99 for d, _ in got)
    assert all(got[x] == pytest.approx(whole[x], rel=1e-9) for x in got)


def test_multinomial_shuffles_only_rows_of_rare_terms(spark):
    """Where probabilities do not fit a broadcast, those of frequent terms are broadcast all the same."""
    rng = np.random.default_rng(6)
    counts = rng.poisson(np.linspace(3.0, 0.02, 40), size=(30, 40)).astype(float)
    docs = twins.doc_frame(spark, counts, 0).unionByName(spark.createDataFrame([(77, 39, 2.0), (78, 50, 1.0)], twins.SCHEMA))
    p = spark.createDataFrame([(t, (t + 1) / 820) for t in range(40) if t != 3], "term_id int, p double")
    small = sorted(map(tuple, likelihood.multinomial_log_likelihood(docs, p).collect()))
    spark.conf.set(runtime.BROADCAST_CONF, str(12 * 2 * runtime.row_bytes(3)))
    try:
        found = likelihood.multinomial_log_likelihood(docs, p)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        large = sorted(map(tuple, found.collect()))
    finally:
        spark.conf.unset(runtime.BROADCAST_CONF)
    assert "Union" in plan and [r[0] for r in small] == [r[0] for r in large]
    assert np.allclose([r[1] for r in small], [r[1] for r in large]) and -math.inf in [r[1] for r in small]
