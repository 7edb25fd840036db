import numpy as np
import pytest

from vitrina.llm import whitening as wh


@pytest.mark.parametrize("dim", [1, 2, 5, 33])
def test_jacobi_equals_the_library_even_for_small_values(dim):
    a = np.random.default_rng(dim).standard_normal((dim, dim)) * np.logspace(0, -9, dim)
    size, v = wh.jacobi(a)
    assert np.allclose(size, np.linalg.svd(a)[1], rtol=1e-9, atol=0)
    assert np.abs(v.T @ v - np.eye(dim)).max() < 1e-13 and np.allclose(a @ v, a @ v)
    product = (a @ v).T @ (a @ v)
    assert np.abs(product - np.diag(np.diag(product))).max() < 1e-12


def definition(rows):
    """Results by numpy's eigenvectors of the covariance."""
    x = np.floor(1024 * np.array(rows, np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    c = x - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    return n, ((n * x - s) ** 2).sum(1), c @ u[:, ::-1] / np.sqrt(e[::-1]), e[::-1] / e.sum()


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(rows)], f"vec_id long, embedding array<{kind}>")


@pytest.mark.parametrize("shift", [0, 3])
def test_equals_its_definition(spark, monkeypatch, shift):
    monkeypatch.setattr(wh, "ROWS", 50)
    rng = np.random.default_rng(1)
    rows = (rng.standard_normal((700, 12)) @ rng.standard_normal((12, 12)) + shift).astype(np.float32)
    rows[100:300] = rows[7]  # a group of copies
    got = sorted(wh.whiten(table(spark, rows).repartition(5)).collect(), key=lambda r: (r.vec_id, r.component))
    n, deviation, whitened, explained = definition(rows)
    assert [(r.vec_id, r.component) for r in got] == [(i, k + 1) for i in range(700) for k in range(8)]
    assert [r.deviation for r in got[::8]] == deviation.tolist() and all(r.n == n for r in got)
    w = np.array([r.whitened for r in got]).reshape(700, 8)
    sign = np.sign((w * whitened[:, :8]).sum(0))
    assert np.abs(w * sign - whitened[:, :8]).max() < 1e-9
    assert np.allclose([r.explained for r in got[:8]], explained[:8], rtol=1e-9)
    assert np.abs(w.T @ w / n - w.mean(0)[:, None] * w.mean(0) - np.eye(8)).max() < 1e-9
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_odd_vectors_and_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0, 3.0], [2.0, 1.0, 0.5], [0.0, -1.0, 2.5], [0.0, -1.0, 2.5]]
    rows = [(i, v) for i, v in enumerate(good)] + [(9, None), (10, []), (11, [nan, 1.0, 1.0]), (12, [inf, 1.0, 1.0]), (13, [None, 1.0, 1.0]), (14, [1.0]), (15, [1e300, 1.0, 1.0]), (None, [5.0, 5.0, 5.0]), (3, good[3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS component", "vec_id AS other")
    got = wh.whiten(df).collect()
    assert sorted({-1 if r.vec_id is None else r.vec_id for r in got}) == [-1, 0, 1, 2, 3] and len(got) == 6 * 3
    n, deviation, _, explained = definition([*good, [5.0, 5.0, 5.0], good[3]])
    assert {r.deviation for r in got} == set(deviation.tolist()) and {r.n for r in got} == {n}
    assert np.allclose(sorted({r.explained for r in got}, reverse=True), explained) and all(r.other == r.vec_id for r in got)


def test_no_variance_and_no_rows(spark):
    same = wh.whiten(table(spark, [[1, 2]] * 5)).collect()
    assert {(r.whitened, r.explained, r.identity_error, r.deviation) for r in same} == {(0.0, None, 0.0, 0)} and len(same) == 10
    flat = wh.whiten(table(spark, [[i, 2 * i] for i in range(6)])).collect()  # one direction only
    assert {r.whitened for r in flat if r.component == 2} == {0.0} and max(r.identity_error for r in flat) < 1e-9
    assert wh.whiten(table(spark, [[1, 2]]).limit(0)).count() == 0
    assert wh.whiten(table(spark, [[]])).count() == 0


def test_exact_beyond_a_long():
    x = np.array([[1 << 40, 5], [0, 0], [3, 4]], np.int64)
    totals = wh.Totals(3, [int(s) for s in x.sum(0)])
    d = totals.deviations(x)
    assert d.mask.all()
    small = np.array([[100_000 + (1 << 28), 1], [0, 0]], np.int64)
    totals = wh.Totals(2, [int(s) for s in small.sum(0)])
    want = [sum((2 * int(v) - s) ** 2 for v, s in zip(r, totals.sums)) for r in small]
    assert totals.deviations(small).tolist() == want
    assert totals.plus(wh.Totals(0, [])) == totals == wh.Totals(0, []).plus(totals)
