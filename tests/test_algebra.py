import numpy as np
import pytest

import twins
from topicmoments.operators import matrix, simplex, tensor

SIMPLEX = [
    ([.5, .5, .5], [1 / 3] * 3), ([.5, .5, -.5], [.5, .5, 0]),
    ([.3, .3, -.3, -.3, .1, .1], [.35, .35, 0, 0, .15, .15]),
    ([.3] * 4 + [-.3] * 4 + [.1] * 4, [.225] * 4 + [0] * 4 + [.025] * 4),
    ([.1] * 4 + [.3] * 4 + [-.3] * 4, [.025] * 4 + [.225] * 4 + [0] * 4),
    ([10] * 4 + [30] * 4 + [-30] * 4, [0] * 4 + [.25] * 4 + [0] * 4)]


def vectors(spark, rows):
    return spark.createDataFrame([(i, r, float(x)) for i, v in enumerate(rows) for r, x in enumerate(v)],
                                 "vec_id int, row int, v double")


@pytest.mark.parametrize("limit", [simplex.SORT_LIMIT, 0])
def test_simplex_projection(spark, limit):
    got = simplex.project(vectors(spark, [v for v, _ in SIMPLEX]), limit).collect()
    found = {(r["vec_id"], r["row"]): r["v"] for r in got}
    assert len(found) == sum(len(v) for v, _ in SIMPLEX)
    for i, (_, expect) in enumerate(SIMPLEX):
        assert [found[i, r] for r in range(len(expect))] == pytest.approx(expect, abs=1e-8)


def theta(v):
    u = np.sort(v)[::-1]
    t = (np.cumsum(u) - 1) / np.arange(1, len(u) + 1)
    return t[np.flatnonzero(u - t > 0)[-1]]


@pytest.mark.parametrize("limit", [simplex.SORT_LIMIT, 0])
def test_signed_projection_picks_the_smaller_shift(spark, limit):
    rng = np.random.default_rng(3)
    rows = [rng.normal(size=12) * s for s in (0.05, 1.0, 20.0)] + [np.array([1.0, -1.0])]
    got = {(r["vec_id"], r["row"]): r["v"] for r in simplex.project_signed(vectors(spark, rows), limit).collect()}
    for i, v in enumerate(rows):
        plus, minus = v - v.min(), -v - (-v).min()
        best = plus if theta(plus) < theta(minus) else minus
        assert [got[i, r] for r in range(len(v))] == pytest.approx(np.maximum(best - theta(best), 0), abs=1e-12)


@pytest.mark.parametrize("limit", [64, 0])
def test_products_and_small_multiplications(spark, monkeypatch, limit):
    monkeypatch.setattr(matrix, "MAX_EXPRESSIONS", limit)
    x = np.random.default_rng(1).normal(size=(200, 6))
    frame = twins.wide(spark, x)
    assert np.allclose(matrix.gram_matrix(frame, matrix.columns(frame)), x.T @ x)
    right = np.arange(12.0).reshape(6, 2)
    assert np.allclose(twins.to_matrix(matrix.times_small(frame, ["term_id"], matrix.columns(frame), right), 200), x @ right)


def test_orthonormal_columns(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 5)) @ np.diag([1, 1e-2, 1e-4, 1e2, 1]) @ rng.normal(size=(5, 5))
    q = twins.to_matrix(matrix.orthonormalize(twins.wide(spark, x), "term_id"), 300)
    assert np.allclose(q.T @ q, np.eye(5), atol=1e-12)
    expect, r = np.linalg.qr(x)
    assert np.allclose(q, expect * np.sign(np.diag(r)), atol=1e-6)


def test_orthonormal_columns_of_a_rank_deficient_matrix(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(100, 3)) @ rng.normal(size=(3, 6))
    q = twins.to_matrix(matrix.orthonormalize(twins.wide(spark, x), "term_id"), 100)
    assert q.shape == (100, 3) and np.allclose(q.T @ q, np.eye(3), atol=1e-10)
    assert np.allclose(q @ (q.T @ x), x)


def test_random_matrix_is_standard_normal_and_repeatable(spark):
    keys = spark.range(4000).selectExpr("cast(id as int) as term_id")
    a = twins.to_matrix(matrix.gaussian_matrix(keys, "term_id", 3, 5), 4000)
    b = twins.to_matrix(matrix.gaussian_matrix(keys.repartition(3), "term_id", 3, 5), 4000)
    assert np.array_equal(a, b)
    assert abs(a.mean()) < 0.05 and abs(a.std() - 1) < 0.05 and np.abs(np.corrcoef(a.T) - np.eye(3)).max() < 0.1
    assert not np.array_equal(a, twins.to_matrix(matrix.gaussian_matrix(keys, "term_id", 3, 6), 4000))


def test_condition_bound():
    assert matrix.check_condition(np.array([4.0, 2.0]), 2.0) == 2.0
    with pytest.raises(ValueError):
        matrix.check_condition(np.array([4.0, 1.0]), 2.0)


def entries(spark, m):
    return spark.createDataFrame([(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])],
                                 "row int, col int, v double")


def cells(spark, t):
    return spark.createDataFrame([(*map(int, i), float(v)) for i, v in np.ndenumerate(t)],
                                 "i int, j int, l int, v double")


def test_rank_one_tensor_and_its_unfolding(spark):
    rng = np.random.default_rng(6)
    x, y, z = rng.normal(size=(3, 20))
    named = [spark.createDataFrame([(0, n, float(a)) for n, a in enumerate(v)], "comp int, idx int, v double")
             for v in (x, y, z)]
    flat = tensor.unfold(tensor.rank_one(*named).drop("comp"), 20)
    rows = flat.collect()
    assert len(rows) == 8000
    assert all(abs(r["v"] - x[r["row"]] * y[r["col"] % 20] * z[r["col"] // 20]) < 1e-8 for r in rows)
    back = tensor.fold(flat, 20).collect()
    assert all(abs(r["v"] - x[r["i"]] * y[r["j"]] * z[r["l"]]) < 1e-8 for r in back)


def test_khatri_rao_product(spark):
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(4, 3)), rng.normal(size=(5, 3))
    got = {(r["row"], r["col"]): r["v"] for r in tensor.khatri_rao(entries(spark, a), entries(spark, b), 5).collect()}
    expect = np.stack([np.kron(a[:, c], b[:, c]) for c in range(3)], axis=1)
    assert len(got) == 60 and all(abs(got[i, c] - expect[i, c]) < 1e-12 for i in range(20) for c in range(3))


def test_mttkrp_and_loss(spark):
    rng = np.random.default_rng(8)
    t = rng.normal(size=(4, 5, 6)) * (rng.uniform(size=(4, 5, 6)) < 0.5)
    a, b, c = (rng.normal(size=(n, 3)) for n in (4, 5, 6))
    frames = [twins.wide(spark, m, "row") for m in (a, b, c)]
    sparse = cells(spark, t).filter("v <> 0")
    got = twins.to_matrix(tensor.mttkrp(sparse, ("i", "j", "l"), frames[1], frames[2]), 4, "row")
    assert np.allclose(got, np.einsum("ijl,jr,lr->ir", t, b, c))
    w = [2.0, 0.5, 1.0]
    loss = tensor.cp_loss(sparse, *frames, w).first()["loss"]
    assert loss == pytest.approx(np.linalg.norm(t - np.einsum("r,ir,jr,lr->ijl", w, a, b, c)))


def test_decomposition_finds_the_components(spark):
    rng = np.random.default_rng(9)
    a, b, c = (np.linalg.qr(rng.normal(size=(n, 2)))[0] for n in (5, 6, 7))
    t = np.einsum("r,ir,jr,lr->ijl", [5.0, 3.0], a, b, c)
    found, _, _, weights, loss = tensor.cp_als(cells(spark, t), 2, max_iter=30, tol=1e-8, restarts=1)
    assert sorted(weights) == pytest.approx([3.0, 5.0], abs=1e-3) and loss < 1e-2
    assert np.abs(np.abs(twins.to_matrix(found, 5, "row").T @ a).max(axis=0) - 1).max() < 1e-3


def test_small_decomposition_runs_every_restart(spark):
    q = np.linalg.qr(np.random.default_rng(10).normal(size=(4, 4)))[0]
    t = np.einsum("r,ir,jr,lr->ijl", [4.0, 3.0, 2.0, 1.0], q, q, q)
    factor, weights, loss = tensor.decompose_small(spark, t, restarts=5, tol=1e-12)
    assert sorted(weights) == pytest.approx([1.0, 2.0, 3.0, 4.0], abs=1e-4) and loss < 1e-4
    assert np.allclose(np.abs(factor.T @ q).max(axis=0), 1.0, atol=1e-4)
    again = tensor.decompose_small(spark, t, restarts=5, tol=1e-12)
    assert np.array_equal(again[0], factor)


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_no_vector_goes_missing(spark, limit):
    rows = [(0, i, 1e17) for i in range(2)] + [(1, i, 0.5) for i in range(3)]
    found = simplex.project(spark.createDataFrame(rows, "vec_id int, row int, v double"), limit).collect()
    assert sorted((r["vec_id"], r["row"]) for r in found) == [(v, i) for v, i, _ in rows]
    assert all(abs(r["v"] - 1 / 3) < 1e-12 for r in found if r["vec_id"] == 1)


def test_entries_of_a_vector_are_not_gathered(spark):
    vectors = spark.range(2000).selectExpr("cast(id % 2 as int) as vec_id", "cast(id as int) as row", "rand(1) as v")
    plan = simplex.project(vectors, 0)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_orthonormal_columns_of_a_steep_matrix(spark):
    x = np.linspace(0, 1, 400)
    steep = np.vander(x, 11, increasing=True) * np.logspace(0, 6, 11)
    assert np.linalg.cond(steep / np.linalg.norm(steep, axis=0)) > 1e7
    frame = twins.wide(spark, steep, "row").repartition(70)
    got = twins.to_matrix(matrix.orthonormalize(frame, "row"), 400, "row")
    assert np.abs(got.T @ got - np.eye(11)).max() < 1e-12
    q, r = np.linalg.qr(steep)
    assert np.abs(got - q * np.where(np.diag(r) < 0, -1, 1)).max() < 1e-7
    assert np.allclose(matrix.r_factor(frame, matrix.columns(frame)), r * np.where(np.diag(r) < 0, -1, 1)[:, None], rtol=1e-6)


def test_dependent_columns_are_left_out_with_a_warning(spark):
    rng = np.random.default_rng(6)
    full = rng.standard_normal((60, 3))
    low = np.column_stack((full, full @ [1.0, 2.0, -1.0], np.zeros(60)))
    with pytest.warns(UserWarning, match="2 of 5 columns"):
        got = twins.to_matrix(matrix.orthonormalize(twins.wide(spark, low, "row"), "row"), 60, "row")
    assert got.shape == (60, 3) and np.abs(got.T @ got - np.eye(3)).max() < 1e-12
    assert np.abs(got @ (got.T @ full) - full).max() < 1e-10


def test_loss_of_an_exact_and_of_a_sparse_decomposition(spark):
    rng = np.random.default_rng(9)
    a, b, c = (rng.standard_normal((n, 2)) for n in (9, 8, 7))
    w = np.array([3.0, 0.25])
    a[:3], b[4:], c[2:5, 1] = 0.0, 0.0, 0.0  # most cells are exactly zero, and absent
    full = np.einsum("r,ir,jr,lr->ijl", w, a, b, c)
    factors = [twins.wide(spark, m, "row") for m in (a, b, c)]

    def cells(values):
        return spark.createDataFrame([(int(i), int(j), int(l), float(values[i, j, l])) for i, j, l in np.argwhere(values)], "i int, j int, l int, v double")

    assert tensor.cp_loss(cells(full), *factors, w).first()["loss"] < 1e-14 * np.linalg.norm(full)
    other = full.copy()
    other[5, 1, 1], other[0, 0, 0], other[6, 2, 0] = 0.0, 2.0, other[6, 2, 0] + 1e-9
    got = tensor.cp_loss(cells(other).repartition(40), *factors, w).first()["loss"]
    assert got == pytest.approx(np.linalg.norm(other - full), rel=1e-12)
    assert tensor.cp_loss(cells(full).limit(0), *factors, w).first()["loss"] == pytest.approx(np.linalg.norm(full), rel=1e-12)
