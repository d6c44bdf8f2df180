"""Whitening: components against a plain eigensolver, every column against plain numpy, odd vectors."""

import math

import numpy as np
import pytest

from cairn.llm import shared, whitening


def with_values(values, seed=1):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    a = (q * values) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("values", [[3.0], [1.0, -1.0], [5.0, 5.0, 5.0], [1.0, 1.0, 2.0, 2.0, 2.0], [0.0] * 20 + [7.0, 9.0], [0.0, 0.0], *(np.random.default_rng(n).lognormal(size=n).tolist() for n in (2, 7, 33, 96)), (10.0 ** -np.arange(14)).tolist()])
def test_components_are_eigenvectors(values):
    a = with_values(np.array(values))
    found, u = whitening.components_of(a)
    scale = max(1e-300, np.linalg.norm(a))
    assert np.abs(found - np.sort(values)[::-1]).max() <= 1e-13 * scale
    assert np.linalg.norm(a @ u - u * found) <= 1e-12 * scale and np.linalg.norm(u.T @ u - np.eye(len(a))) < 1e-12
    assert (np.diff(found) <= 1e-13 * scale).all()


def test_polar_factor_is_the_sign():
    a = with_values(np.array([4.0, 0.5, 1e-9, -1e-6, -2.0]))
    sign = whitening.polar(a)
    assert np.linalg.norm(sign @ sign - np.eye(5)) < 1e-12 and np.linalg.norm(sign @ a - a @ sign) < 1e-12
    assert round(float(np.trace(sign))) == 1


def plain(rows, k=32):
    x = np.floor(64 * np.array([v for _, v in rows], float)).astype(np.int64) + 1_000_000
    n, sums = len(x), [sum(map(int, c)) for c in x.T]
    off = x - np.array([s / n for s in sums])
    v = off.T @ off / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    return n, [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x], off @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def test_every_column_equals_plain_numpy(spark):
    r = np.random.default_rng(3)
    rows = [(i, (r.standard_normal(40) @ np.diag(np.linspace(0.2, 3, 40)) + 5).astype(np.float32).tolist()) for i in range(700)]
    bad = [(1000, None), (1001, [math.nan] * 40), (1002, [None] + [1.0] * 39), (1003, [math.inf] * 40), (1004, [1.0] * 39), (1005, []), (1006, [1e30] * 40)]
    frame = spark.createDataFrame([(k, v, "clash") for k, v in rows + bad], "vec_id long, embedding array<float>, component string").repartition(70)
    n, deviation, white, explained = plain(rows)
    found = whitening.whiten(frame).toPandas()
    assert len(found) == 700 * 32 and (found.n == n).all() and set(found.vec_id) == set(range(700))
    assert found.identity_error.nunique() == 1 and found.identity_error[0] < 1e-10
    table = found.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    signs = np.sign((table * white).sum(axis=0))
    assert np.abs(table - white * signs).max() < 1e-8
    assert found.drop_duplicates("vec_id").set_index("vec_id").deviation.sort_index().tolist() == deviation
    assert np.allclose(found.drop_duplicates("component").sort_values("component").explained, explained, rtol=1e-10)
    assert np.allclose(np.cov(table.T, bias=True), np.eye(32), atol=1e-10)


def test_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "id long, `v.x` array<double>")
    assert whitening.whiten(make([]), "id", "v.x").count() == 0
    assert whitening.whiten(make([(1, None), (2, [math.nan])]), "id", "v.x").count() == 0
    one = whitening.whiten(make([(1, [1.0, 2.0])]), "id", "v.x").collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    # Two dimensions that always agree, a null key, repeated rows: one component has no variance.
    flat = whitening.whiten(make([(1, [1.0, 1.0]), (1, [1.0, 1.0]), (None, [3.0, 3.0])]), "id", "v.x").collect()
    assert len(flat) == 6 and all((r.whitened is None) == (r.component == 2) for r in flat) and flat[0].identity_error < 1e-12
    huge = whitening.whiten(make([(1, [1e13]), (2, [-1e13])]), "id", "v.x").collect()
    assert [r.deviation for r in huge] == [None, None]


def test_sums_are_added_in_a_tree(spark):
    parts = spark.createDataFrame([(p, at, [p, at, 1]) for p in range(100) for at in (0, 5)], "part long, at long, values array<long>").repartition(7)
    assert {at: v.tolist() for at, v in shared.tree_sum(parts, 3).items()} == {0: [4950, 0, 100], 5: [4950, 500, 100]}
