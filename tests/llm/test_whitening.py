import math

import numpy as np
import pytest

from topicmoments.llm.whitening import Spectrum, joined, rank_one, secular_roots, spectra, whiten

RNG = np.random.default_rng(11)
COLUMNS = "vec_id long, embedding array<float>, x string, n string, component string, place int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c", 1) for i, v in rows], COLUMNS)


def brute_force(rows, top=4):
    """n, S, exact deviations by vector, eigenvalues, vectors and the trace, with plain numpy."""
    x = [tuple(math.floor(256 * float(np.float32(c))) for c in v) for v in rows]
    fit = np.array(sorted(set(x)), dtype=float)
    n, sums = len(fit), [sum(c) for c in zip(*set(x))]
    away = fit - fit.mean(axis=0)
    values, vectors = np.linalg.eigh(away.T @ away / n)
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    return n, np.array(sums) / n, np.array(x, dtype=float), deviation, values[::-1][:top], vectors[:, ::-1][:, :top], values.sum()


def check(got, rows, top=4):
    """Compare returned rows with numpy's, components up to their sign."""
    good = [v for _, v in rows]
    n, mean, x, deviation, values, vectors, trace = brute_force(good, top)
    by = {}
    for r in got:
        by.setdefault(r["component"], {}).setdefault(r["vec_id"], []).append(r)
    assert sorted(by) == list(range(1, len(values) + 1))
    for c, own in by.items():
        want = (x - mean) @ vectors[:, c - 1] / np.sqrt(values[c - 1])
        ours = np.array([own[i][0]["whitened"] for i, _ in rows])
        assert np.abs(ours * np.sign(ours @ want) - want).max() < 1e-8
        for k, (i, _) in enumerate(rows):
            r = own[i][0]
            assert (r["n"], r["deviation"]) == (n, deviation[k]) and abs(r["explained"] / (values[c - 1] / trace) - 1) < 1e-10
            assert r["identity_error"] < 1e-10
    assert len({r["identity_error"] for r in got}) == 1


def vectors(n, d=12):
    turn, _ = np.linalg.qr(RNG.normal(size=(d, d)))
    return (RNG.normal(size=(n, d)) * np.linspace(2, 0.3, d) @ turn + 0.7).astype(np.float32).astype(float)


def test_as_numpy(spark):
    rows = list(enumerate(vectors(600).tolist()))
    rows += [(1000 + k, rows[0][1]) for k in range(200)]
    bad = [(2000, None), (2001, []), (2002, [1.0] * 11 + [None]), (2003, [1.0] * 11 + [float("nan")]), (2004, [float("inf")] + [1.0] * 11),
           (2005, [1.0, 2.0]), (2006, [3e38] + [1.0] * 11)]
    got = whiten(frame(spark, rows + bad).repartition(20)).collect()
    assert len(got) == 4 * len(rows) and {r["vec_id"] for r in got} == {i for i, _ in rows}
    check(got, rows)


def test_repeated_rows_and_rows_without_an_id(spark):
    rows = list(enumerate(vectors(40, 5).tolist()))
    got = whiten(frame(spark, rows + [rows[0], (None, rows[1][1])])).collect()
    assert len(got) == 4 * 42 and sum(r["vec_id"] is None for r in got) == 4
    check([r for r in got if r["vec_id"] is not None], rows)


def test_few_dimensions_equal_vectors_and_no_rows(spark):
    rows = list(enumerate(vectors(30, 2).tolist()))
    check(whiten(frame(spark, rows)).collect(), rows)
    line = [(i, [0.5 * i, 0.25 * i, 0.0]) for i in range(20)]
    check(whiten(frame(spark, line)).collect(), line, 1)
    assert whiten(frame(spark, [(i, [0.5, 0.1]) for i in range(9)])).count() == 0
    empty = whiten(frame(spark, rows).limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviation_beyond_a_long_is_null(spark):
    big = [(1, [2.0 ** 40, 1.0]), (2, [-(2.0 ** 40), 3.0]), (3, [0.0, 2.0])]
    got = {r["vec_id"]: r["deviation"] for r in whiten(frame(spark, big)).filter("component = 1").collect()}
    assert got[1] is None and got[2] is None and got[3] == 0


@pytest.mark.parametrize("equal", [False, True])
def test_one_update_as_a_full_decomposition(equal):
    d = 9
    values = np.sort(RNG.uniform(0, 5, d)) if not equal else np.repeat([0.0, 1.0, 2.5], 3)
    basis, _ = np.linalg.qr(RNG.normal(size=(d, d)))
    for vector in (RNG.normal(size=d), basis[:, 2] * 3, np.zeros(d)):
        new, turned = rank_one(values, basis.copy(), vector, 0.8)
        whole = basis @ np.diag(values) @ basis.T + 0.8 * np.outer(vector, vector)
        assert np.abs(turned @ np.diag(new) @ turned.T - whole).max() < 1e-13 * 50
        assert np.abs(turned.T @ turned - np.eye(d)).max() < 1e-14 * 50 and (np.diff(new) >= 0).all()


def test_roots_lie_between_the_poles_even_when_these_are_close():
    poles = np.array([0.0, 1e-9, 1.0, 1.0 + 1e-7, 50.0])
    weights = np.array([0.5, 0.3, 1e-6, 0.4, 0.7])
    weights /= np.linalg.norm(weights)
    roots, apart = secular_roots(poles, weights, 2.0)
    # a root may be closer to its pole than doubles near it are to each other; the differences tell
    assert (np.diag(apart) < 0).all() and (np.diag(apart[:-1], 1) > 0).all() and poles[-1] < roots[-1] <= poles[-1] + 2.0
    terms = 2.0 * weights ** 2 / apart
    assert (np.abs(1 + terms.sum(axis=1)) <= 1e-13 * (1 + np.abs(terms).sum(axis=1))).all()


def test_spectra_of_parts_join_to_that_of_the_whole(spark):
    x = np.floor(vectors(500, 7) * 256).astype(np.int64)
    whole = joined(spectra(spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").repartition(40), 7))
    away = x - x.mean(axis=0)
    assert whole.n == 500 and whole.sums == x.sum(axis=0).tolist()
    assert np.allclose(whole.vectors @ np.diag(whole.values) @ whole.vectors.T, away.T @ away, rtol=1e-11, atol=1e-4)
    one = Spectrum(7)
    one.add(x)
    assert np.allclose(one.values, whole.values, rtol=1e-10)
