from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

import twins
from topicmoments import runtime
from topicmoments.operators import matrix, moments
from topicmoments.operators.layout import by_term
from topicmoments.plans import fit


def small_counts(seed=3, n_docs=100, v=5, tokens=100):
    topics = np.array([[.6, .1, .1], [.1, .1, .1], [.1, .6, .1], [.1, .1, .1], [.1, .1, .6]])
    return twins.simulate(np.random.default_rng(seed), [5, 10, 20], topics, n_docs, tokens)


def test_projected_second_moment_equals_formula(spark):
    rng = np.random.default_rng(7)
    counts = rng.uniform(size=(3, 100))
    q = rng.standard_normal((100, 50))
    docs, table = twins.prepared(spark, counts)
    got = twins.to_matrix(moments.project_second_moment(docs, twins.wide(spark, q), table, 2.5), 100)
    assert np.allclose(got, twins.second_moment(counts, 2.5) @ q, atol=1e-8)


def test_projection_without_broadcast_is_equal(spark):
    rng = np.random.default_rng(8)
    counts = rng.poisson(0.4, size=(60, 40)).astype(float)
    counts[:, 0] = 5  # one term in every document
    q = rng.standard_normal((40, 3))
    docs, table = twins.prepared(spark, counts)
    spark.conf.set(runtime.BROADCAST_CONF, "0")
    try:
        got = twins.to_matrix(moments.project_second_moment(docs, twins.wide(spark, q), table, 0.7), 40)
    finally:
        spark.conf.unset(runtime.BROADCAST_CONF)
    assert np.allclose(got, twins.second_moment(counts, 0.7) @ q, atol=1e-10)


def test_exact_second_moment_and_eigen(spark):
    counts = small_counts()
    docs, table = twins.prepared(spark, counts)
    cells = moments.second_moment(docs, table, 5, 35.0).collect()
    pairs = 35.0 * 36.0 * twins.pair_moment(counts)
    assert len(cells) == 15
    assert all(abs(r["v"] - pairs[r["i"], r["j"]]) < 1e-10 for r in cells)
    expect = twins.second_moment(counts, 35.0)
    vectors, values = moments.top_eigen_exact(docs, table, 5, 3, 35.0)
    assert np.allclose(values, np.linalg.eigvalsh(expect)[::-1][:3])
    u = twins.to_matrix(vectors, 5)
    assert np.allclose(expect @ u, u * values)


@pytest.mark.parametrize("block, products", [(7, 50), (16, 1 << 20), (64, 1)])
def test_second_moment_in_blocks(spark, monkeypatch, block, products):
    monkeypatch.setattr(moments, "BLOCK_TERMS", block)
    monkeypatch.setattr(moments, "PRODUCTS", products)
    rng = np.random.default_rng(8)
    counts = rng.poisson(np.linspace(2.0, 0.02, 60), size=(150, 60)).astype(float)  # the first terms are in all documents
    counts[:, 41] = 0
    docs, table = twins.prepared(spark, counts)
    cells = moments.second_moment(docs, table, 60, 1.5).collect()
    whole = np.zeros((60, 60))
    for r in cells:
        assert r["i"] <= r["j"] and r["v"] != 0 and whole[r["i"], r["j"]] == 0
        whole[r["i"], r["j"]] = whole[r["j"], r["i"]] = r["v"]
    assert np.allclose(whole, 1.5 * 2.5 * twins.pair_moment(counts), atol=1e-12)


def test_pairs_of_blocks_are_dealt_among_tasks_and_documents_stay(spark):
    rng = np.random.default_rng(8)
    docs, _table = twins.prepared(spark, rng.poisson(1.0, size=(80, 12)).astype(float))
    plan = moments.block_pairs(docs, 4, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("InMemoryRelation")[0]
    assert moments.pair_moment(docs.limit(0), 12).count() == 0


@pytest.mark.parametrize("size, k", [(80, 4), (30, 12), (12, 1), (6, 6)])
def test_lanczos_as_a_full_decomposition(spark, size, k):
    rng = np.random.default_rng(size)
    topics = rng.dirichlet(np.full(size, 0.2), max(k, 3)).T
    counts = np.vstack([twins.simulate(rng, np.full(max(k, 3), 0.3), topics, 300, 60), np.eye(size) * 3])
    docs, table = twins.prepared(spark, counts)
    expect = np.linalg.eigvalsh(twins.second_moment(counts, 5.0))[::-1][:k]
    if expect[-1] <= 0:
        with pytest.raises(ValueError, match="positive"):
            moments.top_eigen_exact(docs, table, size, k, 5.0)
        return
    vectors, values = moments.top_eigen_exact(docs, table, size, k, 5.0)
    u = twins.to_matrix(vectors, size)
    assert np.allclose(values, expect, rtol=1e-9, atol=1e-12) and np.allclose(u.T @ u, np.eye(k), atol=1e-11)
    assert np.abs(twins.second_moment(counts, 5.0) @ u - u * values).max() < 1e-9 * values[0]


def test_passes_by_term_shuffle_no_documents(spark):
    rng = np.random.default_rng(4)
    counts = rng.poisson(np.where(np.arange(40) < 2, 3.0, 0.05), size=(120, 40)).astype(float)
    docs, table = twins.prepared(spark, counts)
    written = replace(table, layout=by_term(docs, table.terms))
    assert 0 < written.layout.hot.count() < 8 and written.layout.others.count() + written.layout.common.count() == docs.count()
    q = rng.standard_normal((40, 2))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = written.layout.join(twins.wide(spark, q), ["c0", "c1"])
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "Exchange hashpartitioning" not in plan
        got = twins.to_matrix(moments.project_second_moment(docs, twins.wide(spark, q), written, 2.5), 40)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert np.allclose(got, twins.second_moment(counts, 2.5) @ q, atol=1e-10)
    # a fit takes this way when its matrices do not fit
    spark.conf.set("topicmoments.broadcast.maxBytes", "64")
    try:
        narrow = fit.with_layout(docs, table, 6)
        assert narrow.layout is not None
        vectors, values = moments.top_eigen(docs, narrow, 40, 1, 2.5, q=3)
    finally:
        spark.conf.unset("topicmoments.broadcast.maxBytes")
    same, known = moments.top_eigen(docs, table, 40, 1, 2.5, q=3)
    assert np.allclose(values, known, rtol=1e-8) and fit.with_layout(docs, table, 6).layout is None


def test_randomised_eigen_finds_a_low_rank_matrix(spark):
    counts = small_counts(seed=5, n_docs=400)
    docs, table = twins.prepared(spark, counts)
    vectors, values = moments.top_eigen(docs, table, 5, 3, 35.0, q=4)
    expect = twins.second_moment(counts, 35.0)
    assert np.allclose(values, np.linalg.eigvalsh(expect)[::-1][:3], rtol=1e-6)
    u = twins.to_matrix(vectors, 5)
    assert np.allclose(u.T @ u, np.eye(3), atol=1e-10)
    white = twins.to_matrix(moments.whitening_matrix(vectors, values), 5)
    assert np.allclose(white.T @ expect @ white, np.eye(3), atol=1e-4)


@pytest.mark.parametrize("limit", [64, 0])
def test_whitened_third_moment_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(moments, "MAX_EXPRESSIONS", limit)
    monkeypatch.setattr(matrix, "MAX_EXPRESSIONS", limit)
    counts = small_counts()
    docs, table = twins.prepared(spark, counts)
    vectors, values = moments.top_eigen_exact(docs, table, 5, 3, 35.0)
    white = moments.whitening_matrix(vectors, values)
    w = twins.to_matrix(white, 5)
    expect = np.einsum("abc,ai,bj,cl->ijl", twins.third_moment(counts, 35.0), w, w, w)
    got = moments.whitened_third_moment(docs, white, table, 35.0)
    assert np.allclose(got, expect, atol=1e-6)
    assert np.allclose(got, got.transpose(1, 0, 2)) and np.allclose(got, got.transpose(2, 1, 0))


def test_masked_terms_leave_all_moments(spark):
    rng = np.random.default_rng(2)
    counts = rng.poisson(0.8, size=(50, 6)).astype(float)
    counts[:, 2] = 3
    docs, table = twins.prepared(spark, counts, idf_lb=1.01)
    assert {r["term_id"] for r in table.terms.collect()} == {0, 1, 3, 4, 5}
    expect = twins.second_moment(counts, 1.5)
    expect[2, :] = expect[:, 2] = 0
    q = rng.standard_normal((6, 2))
    got = twins.to_matrix(moments.project_second_moment(docs, twins.wide(spark, q), table, 1.5), 6)
    assert np.allclose(got, expect @ q)
    assert np.allclose(moments.top_eigen_exact(docs, table, 6, 1, 1.5)[1], np.linalg.eigvalsh(expect)[-1])


def test_short_documents_do_not_count(spark):
    counts = np.array([[2, 2, 0], [1, 0, 1], [3, 1, 1]], dtype=float)
    docs, table = twins.prepared(spark, counts)
    assert table.n_docs == 2
    m1 = {r["term_id"]: r["m1"] for r in table.terms.collect()}
    assert np.allclose([m1[t] for t in range(3)], twins.first_moment(counts))
    assert docs.select("doc_id").distinct().count() == 2


def test_passes_over_documents_shuffle_once_by_term(spark):
    counts = small_counts()
    docs, table = twins.prepared(spark, counts)
    docs.count()
    mat = twins.wide(spark, np.eye(5)[:, :3])
    spread = moments.spread_to_terms(docs, moments.project_docs(docs, mat, table), 3, moments.PAIR)
    plan = spread._jdf.queryExecution().executedPlan().toString()
    live = "\n".join(line for line in plan.split("InMemoryRelation")[0].splitlines())
    assert "hashpartitioning(term_id" in live and "hashpartitioning(doc_id" not in live


def test_wide_matrices_go_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(moments, "COLUMN_BLOCK", 3)
    rng = np.random.default_rng(11)
    counts = rng.poisson(0.7, size=(30, 12)).astype(float)
    q = rng.standard_normal((12, 7))
    docs, table = twins.prepared(spark, counts)
    got = twins.to_matrix(moments.project_second_moment(docs, twins.wide(spark, q), table, 0.5), 12)
    assert np.allclose(got, twins.second_moment(counts, 0.5) @ q)


def test_same_answer_for_any_partitioning(spark):
    counts = small_counts(seed=9)
    results = []
    for parts in (1, 5):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            docs = twins.doc_frame(spark, counts).repartition(parts)
            results.append(fit.TopicMoments(3, 35.0, seed=4).fit(docs, 5))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert np.allclose(results[0].alpha, results[1].alpha)


def test_condition_bound_stops_the_fit(spark):
    docs = twins.doc_frame(spark, small_counts())
    with pytest.raises(ValueError, match="condition number"):
        fit.TopicMoments(3, 35.0, m2_cond_ub=1.0001).fit(docs, 5)


def test_whole_documents_regroups_batches():
    import pandas as pd

    ids = [1, 1, 1, 2, 3, 3, 4, 4, 4, 4, 5]
    frame = pd.DataFrame({"doc_id": ids, "x": range(len(ids))})
    for size in (1, 2, 3, 4, 20):
        batches = [frame.iloc[i:i + size] for i in range(0, len(ids), size)]
        out = list(moments.whole_documents(iter(batches)))
        assert pd.concat(out)["x"].tolist() == list(range(len(ids)))
        seen = [set(p["doc_id"]) for p in out]
        assert sum(len(s) for s in seen) == 5


def test_packed_third_moment_of_twelve_columns(spark):
    rng = np.random.default_rng(12)
    counts = rng.poisson(0.6, size=(90, 14)).astype(float)
    docs, table = twins.prepared(spark, counts)
    w = rng.standard_normal((14, 12))
    expect = np.einsum("abc,ai,bj,cl->ijl", twins.third_moment(counts, 2.0), w, w, w, optimize=True)
    got = moments.whitened_third_moment(docs, twins.wide(spark, w), table, 2.0)
    assert np.abs(got - expect).max() < 1e-9 * np.abs(expect).max()


def test_frequent_terms_stay_with_their_documents_as_far_as_there_is_room(spark):
    rng = np.random.default_rng(6)
    counts = rng.poisson(np.linspace(2.0, 0.05, 40), size=(120, 40)).astype(float)
    docs, table = twins.prepared(spark, counts)
    room = 15 * (runtime.row_bytes(2) + runtime.row_bytes(1))
    spark.conf.set(runtime.BROADCAST_CONF, str(room))
    try:
        written = fit.with_layout(docs, table, 2)
        assert 10 <= written.layout.hot.count() <= 15 and written.layout.common.count() > docs.count() / 2
        q = rng.standard_normal((40, 2))
        got = twins.to_matrix(moments.project_second_moment(docs, twins.wide(spark, q), written, 2.5), 40)
    finally:
        spark.conf.unset(runtime.BROADCAST_CONF)
    assert np.allclose(got, twins.second_moment(counts, 2.5) @ q, atol=1e-10)


def test_short_documents_in_a_large_vocabulary_list_their_products(spark, monkeypatch):
    rng = np.random.default_rng(12)
    counts = np.zeros((150, 60))
    for row in counts:
        row[rng.choice(60, 4, replace=False)] = rng.integers(1, 4, 4)
    docs, table = twins.prepared(spark, counts)

    def cells():
        return {(r["i"], r["j"]): r["v"] for r in moments.pair_moment(docs, 60, block=2).collect()}

    found = cells()
    monkeypatch.setattr(moments, "_few_products", lambda docs, block: False)
    blocks = cells()
    assert found.keys() == blocks.keys() and all(abs(found[x] - blocks[x]) < 1e-12 for x in found)
    monkeypatch.undo()
    assert "MapInArrow" not in moments.pair_moment(docs, 60, block=2)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in moments.pair_moment(docs, 60, block=60)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("held, products", [(25, 30), (400, 1 << 20)])
def test_rows_are_shuffled_once_for_each_even_block_whatever_the_vocabulary(spark, monkeypatch, held, products):
    for name, value in (("HELD", held), ("LEAST", 100), ("PRODUCTS", products), ("BLOCK_TERMS", 16)):
        monkeypatch.setattr(moments, name, value)
    monkeypatch.setattr(moments, "_few_products", lambda docs, block: False)
    rng = np.random.default_rng(21)
    size = 600
    counts = np.zeros((60, size))
    for row in counts:
        row[rng.choice(size, 25, replace=False)] = rng.integers(1, 4, 25)
    counts[:, 7] = 2  # a block of more rows than a task holds, dealt among tasks
    docs, table = twins.prepared(spark, counts)
    group, n_blocks = moments.even_blocks(docs)
    pairs = moments.block_pairs(docs, group, n_blocks).toPandas()
    sent = sum(len(t) for side in ("xt", "yt") for t in pairs[side] if t is not None)
    # blocks of a fixed number of terms, one for a word, would send each row with every other word
    assert sent <= docs.count() * (n_blocks + 1) and n_blocks <= max(-(-docs.count() // held), 7)
    found = {(r["i"], r["j"]): r["v"] for r in moments.pair_moment(docs, size).collect()}
    expect = len(counts) * twins.pair_moment(counts)
    i, j = np.nonzero(np.triu(expect))
    assert found.keys() == set(zip(i.tolist(), j.tolist()))
    assert all(abs(v - expect[cell]) < 1e-12 for cell, v in found.items())
