"""Whitening against a dense eigendecomposition in double precision, and the filter's own properties."""

import math
from fractions import Fraction

import numpy as np
import pytest

from vitrine.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, dim string, at long, value double, n long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "d", 1, 2.0, 3) for r in rows], SCHEMA).repartition(4)


def dense(rows, k=4):
    """Eigenvalues, vectors, S and n of the distinct integer vectors of the most frequent length."""
    x = np.array(sorted({tuple(math.floor(256 * c) for c in v) for _, v in rows}), dtype=np.int64)
    n, sums = len(x), [int(s) for s in x.astype(object).sum(0)]
    centred = x - np.array([float(Fraction(s, n)) for s in sums])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return n, sums, values[::-1][:k], vectors[:, ::-1][:, :k], values.sum()


def data(dim=40, n=700, seed=4):
    rnd = np.random.default_rng(seed)
    spread = np.concatenate([[3.0, 2.0, 1.7, 1.65], np.linspace(1.0, 0.3, dim - 4)])
    turn = np.linalg.qr(rnd.normal(size=(dim, dim)))[0]
    vectors = (rnd.normal(size=(n, dim)) * spread @ turn + 0.3).astype("f4")
    return [(i, v.tolist()) for i, v in enumerate(vectors)]


def test_whitening(spark):
    good = data()
    good += [(1000 + i, good[3][1]) for i in range(350)] + [(None, good[5][1])]  # a third of the rows is one vector
    bad = [(1, None), (2, [1.0] * 39 + [None]), (3, [math.nan] + [0.0] * 39), (4, [math.inf] + [0.0] * 39), (5, []), (6, [1.0, 2.0]), (7, [2.0, 1.0])]
    n, sums, values, vectors, trace = dense(good)
    got = whitening.whiten_vectors(frame(spark, good + bad)).collect()
    assert len(got) == 4 * len(good) and all(r["n"] == n for r in got)
    assert sorted(str(r["vec_id"]) for r in got) == sorted(str(i) for i, _ in good for _ in range(4))
    by_id = dict(good[:700])
    sign = None
    for i in range(700):
        x = [math.floor(256 * c) for c in by_id[i]]
        own = sorted((r for r in got if r["vec_id"] == i), key=lambda r: r["component"])
        assert [r["component"] for r in own] == [1, 2, 3, 4]
        assert own[0]["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x, sums))
        want = (np.array(x) - np.array(sums) / n) @ vectors / np.sqrt(values)
        mine = np.array([r["whitened"] for r in own])
        sign = np.sign(want * mine) if sign is None else sign
        np.testing.assert_allclose(mine * sign, want, atol=1e-10)
        np.testing.assert_allclose([r["explained"] for r in own], values / trace, rtol=1e-12)
        assert own[0]["identity_error"] < 1e-10
        if i > 20:
            break


def test_edges(spark):
    assert whitening.whiten_vectors(frame(spark, [])).count() == 0
    assert whitening.whiten_vectors(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # no spread, no component
    flat = whitening.whiten_vectors(frame(spark, [(1, [1.0, 2.0, 0.0]), (2, [2.0, 4.0, 0.0]), (3, [3.0, 6.0, 0.0])])).collect()
    assert [r["component"] for r in flat] == [1, 1, 1]  # eigenvalues of zero are no components
    assert sorted(round(r["whitened"] ** 2, 9) for r in flat) == [0.0, 1.5, 1.5] and flat[0]["explained"] == pytest.approx(1)
    huge = whitening.whiten_vectors(frame(spark, [(1, [1e30, 1.0]), (2, [-1e30, 2.0]), (3, [5.0, 1.5])])).collect()
    assert {r["deviation"] for r in huge if r["vec_id"] != 3} == {None}


def test_filter_damps_what_lies_below_the_cut():
    values = np.concatenate([[9.0, 7.0, 5.5, 5.0], np.linspace(4.0, 0.0, 96)])
    rnd = np.random.default_rng(1)
    turn = np.linalg.qr(rnd.normal(size=(100, 100)))[0]
    v = turn * values @ turn.T
    passes = []

    def times(q):
        passes.append(q.shape)
        return v @ q

    got, vectors, residual = whitening.leading(times, 100, 4, block=12, degree=8)
    np.testing.assert_allclose(got, values[:4], rtol=1e-13)
    assert np.abs(np.abs((vectors * turn[:, :4]).sum(0)) - 1).max() < 1e-12 and residual.max() < 1e-11
    assert len(passes) < 120
    start = np.linalg.qr(rnd.normal(size=(100, 12)))[0]
    block = whitening.filtered(lambda q: v @ q, start, v @ start, 4.0, 9.0, 8)
    share = lambda q: ((turn[:, :4].T @ q) ** 2).sum(1)  # noqa: E731  how much of each leading vector the block holds
    assert (share(start) < 0.5).all() and (share(block) > 0.99).all()


def test_equal_eigenvalues():
    v = np.diag([5.0, 5.0, 5.0, 2.0, 1.0, 1.0, 0.0, 0.0] + [0.5] * 40)
    got, vectors, _ = whitening.leading(lambda q: v @ q, 48, 4, block=8)
    np.testing.assert_allclose(got, [5, 5, 5, 2], rtol=1e-13)
    np.testing.assert_allclose(v @ vectors, vectors * got, atol=1e-10)


def test_exact_deviations():
    x = np.array([[1 << 40, -3], [7, 1 << 62]], dtype=np.int64)
    assert whitening.deviations(x, 3, [5, 6]) == [None, None]
    assert whitening.deviations(np.array([[2, 3]]), 10, [4, 5]) == [16 ** 2 + 25 ** 2]
    assert whitening.deviations(np.array([[2 ** 20]]), 2 ** 11, [1]) == [(2 ** 31 - 1) ** 2]
