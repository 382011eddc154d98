"""Broadcast axes that are kept as geometry."""

import itertools

import numpy as np

from cellframe import tensor
from cellframe.geometry import At, In, Of
from cellframe.operators import reduce  # noqa: F401
from cellframe.tensor import Expanded, fold
from tests.test_tensor import dense, sparse


def plan(t) -> str:
    return t.rows()._jdf.queryExecution().optimizedPlan().toString()


def test_elementwise_over_all_layouts(spark):
    draw = np.random.default_rng(3)
    x, row, column, one = (draw.integers(0, 3, s).astype(float) for s in ((4, 5), (5,), (4, 1), (1, 1)))
    for a, b in itertools.product((dense, sparse), repeat=2):
        t = a(spark, x.ravel(), shape=(4, 5))
        for y in (row, column, one):
            s = b(spark, y.ravel(), shape=y.shape).broadcast((4, 5))
            assert isinstance(s, Expanded)
            np.testing.assert_array_equal(s.to_numpy(), np.broadcast_to(y, (4, 5)))
            np.testing.assert_array_equal(t.add(s).to_numpy(), x + y)
            np.testing.assert_array_equal(s.mul_scalar(2.0).sub(t).to_numpy(), 2 * y - x)
            np.testing.assert_array_equal(t.ne(s).cond(s, t).to_numpy(), np.where(x != y, y, x))
        r, c = a(spark, row, shape=(5,)).broadcast((4, 5)), b(spark, column.ravel(), shape=(4, 1)).broadcast((4, 5))
        np.testing.assert_array_equal(r.add(c).to_numpy(), row + column)
        np.testing.assert_array_equal(fold("add", [t, r, c, r]).to_numpy(), x + row + column + row)
        np.testing.assert_array_equal(fold("add", [r, r, c.mul(c)]).to_numpy(), 2 * row + column**2)
    for v in (np.inf, np.nan):
        s = sparse(spark, [0, v], shape=(2,)).broadcast((2, 2))
        np.testing.assert_array_equal(sparse(spark, [1, 0, 0, 0], shape=(2, 2)).mul(s).to_numpy(), [[0, np.nan], [0, np.nan]])


def test_no_cells_before_a_join(spark):
    t, row = dense(spark, range(12), shape=(3, 4)), dense(spark, range(4), shape=(4,))
    spread = row.broadcast((3, 4))
    for out in (t.add(spread), spread.exp().sub(t), t.gt(spread).cond(t, spread), fold("add", [t, spread, spread])):
        assert not any(word in plan(out) for word in ("Cross", "Range")), plan(out)
    # Of expanded tensors alone only the axes that are there are joined; the rest stays geometry.
    both = row.broadcast((2, 3, 4)).mul(dense(spark, range(3), shape=(3, 1)).broadcast((2, 3, 4)))
    assert isinstance(both, Expanded) and both.real == (1, 2)
    np.testing.assert_array_equal(both.to_numpy(), np.broadcast_to(np.arange(3.0)[:, None] * np.arange(4.0), (2, 3, 4)))


def test_sparse_products_make_no_grid(spark):
    x, row = np.array([[0, 2, 0], [3, 0, 0]]), np.array([5, 0, 7])
    for dtype in ("i64", "f64", "u8"):
        t, s = sparse(spark, x.ravel(), dtype, (2, 3)), sparse(spark, row, dtype, (3,)).broadcast((2, 3))
        for out in (t.mul(s), s.mul(t)):
            np.testing.assert_array_equal(out.to_numpy(), x * row)
            assert dtype == "f64" or "Range" not in plan(out)
    x, y = np.array([[0, 2.0, 0], [np.inf, 0, 0]]), np.array([[0.0], [np.nan]])
    t, s = sparse(spark, x.ravel(), shape=(2, 3)), sparse(spark, y.ravel(), shape=(2, 1)).broadcast((2, 3))
    np.testing.assert_array_equal(t.mul(s).to_numpy(), np.where(np.isnan(y), np.nan, x * 0))
    np.testing.assert_array_equal(t.and_(s).to_numpy(), (x != 0) & (y != 0))


def test_large_sources_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(tensor, "MOST_BROADCAST", 3)
    t, row = dense(spark, range(12), shape=(3, 4)), dense(spark, range(4), shape=(4,))
    out = t.sub(row.broadcast((3, 4)))
    assert "strategy=broadcast" not in plan(out)
    np.testing.assert_array_equal(out.to_numpy(), np.arange(12.0).reshape(3, 4) - np.arange(4.0))


def test_geometry_of_expanded_tensors(spark):
    x = np.arange(6.0).reshape(2, 3)
    t, wanted = dense(spark, range(6), shape=(2, 1, 3)).broadcast((5, 2, 4, 3)), np.broadcast_to(x[:, None], (5, 2, 4, 3))
    checks = [
        (t.transpose([3, 0, 2, 1]), wanted.transpose(3, 0, 2, 1)),
        (t.slice(At(1), In(0, 2), In(0, 4, 3), In(1, 3)), wanted[1, :, ::3, 1:]),
        (t.slice(In(1, 3), At(1), At(0)), wanted[1:3, 1, 0]),
        (t.slice(In(0, 1), At(1), At(0), At(2)), wanted[:1, 1, 0, 2]),
        (t.slice(In(0, 5), In(0, 2), Of(3, 0)), wanted[:, :, [3, 0]]),
        (t.flip(1), wanted[:, ::-1]),
        (t.slice(In(0, 1)).broadcast((2, 3, 2, 4, 3)), np.broadcast_to(wanted[:1], (2, 3, 2, 4, 3))),
        (t.slice(In(0, 5), In(0, 1)).broadcast((5, 7, 4, 3)), np.broadcast_to(wanted[:, :1], (5, 7, 4, 3))),
        (t.squeeze([0]) if t.shape[0] == 1 else t.slice(In(0, 1)).squeeze([0]), wanted[0]),
    ]
    for got, w in checks:
        assert got.shape == w.shape and not got.supports_write_through
        np.testing.assert_array_equal(got.to_numpy(), w)
    assert t.read_value((4, 1, 2, 0)) == 3.0 and t.sum_all() == wanted.sum() and t.view().shape == t.shape
