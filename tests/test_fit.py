import numpy as np
import pytest

import twins
from topicmoments import MomentOptions, TopicMoments

ALPHA = np.array([20.0, 10.0, 5.0])


def wide_topics(model):
    out = np.zeros((model.vocab_size, len(model.alpha)))
    for r in model.topic_word.collect():
        out[r["term_id"], r["topic"]] = r["p"]
    return out


def test_recovers_topics_by_the_exact_branch(spark):
    topics = np.full((6, 3), 0.05)
    for t in range(3):
        topics[2 * t:2 * t + 2, t] = 0.4
    counts = twins.simulate(np.random.default_rng(57), ALPHA, topics, 5000, 100)
    model = TopicMoments(3, 35.0, max_iter=200, randomised_svd=False).fit(twins.doc_frame(spark, counts), 6)
    error, order = twins.best_match(wide_topics(model), topics)
    assert error <= 0.2
    assert np.linalg.norm(np.array(model.alpha)[order] - ALPHA) <= 4.0
    assert model.alpha == sorted(model.alpha, reverse=True)


def test_recovers_topics_by_the_randomised_branch(spark):
    rng = np.random.default_rng(2347)
    topics = rng.uniform(size=(100, 3))
    for t in range(3):
        topics[10 * t:10 * t + 10, t] += 3.0
    topics /= topics.sum(axis=0)
    counts = twins.simulate(rng, ALPHA, topics, 5000, 500)
    model = TopicMoments(3, 35.0, max_iter=200).fit(twins.doc_frame(spark, counts), 100)
    error, order = twins.best_match(wide_topics(model), topics)
    assert error <= 0.025
    assert np.linalg.norm(np.array(model.alpha)[order] - ALPHA) <= 3.5
    assert np.allclose(wide_topics(model).sum(axis=0), 1.0)


@pytest.mark.parametrize("bad", [{"k": 0}, {"alpha0": 0.0}, {"max_iter": 0}, {"tol": 0.0}, {"idf_lb": 0.5},
                                 {"q": -1}, {"m2_cond_ub": 0.0}, {"restarts": 0}])
def test_options_are_checked(bad):
    with pytest.raises(ValueError):
        MomentOptions(**{"k": 2, "alpha0": 1.0, **bad})


def test_a_corpus_without_long_documents_is_refused(spark):
    docs = twins.doc_frame(spark, np.array([[1.0, 1.0], [2.0, 0.0]]))
    with pytest.raises(ValueError, match="three words"):
        TopicMoments(1, 1.0).fit(docs, 2)
