"""Dense tensors in arrays against the same tensors in cells."""

import numpy as np
import pytest

from cellframe import errors
from cellframe.functions import dtypes as D
from cellframe.geometry import At, In, Of
from cellframe.operators import fourier, matrix, reduce  # noqa: F401
from cellframe.rows import RowTensor, from_arrays
from cellframe.sources.frames import from_values

VALUES = np.random.default_rng(3).normal(size=(3, 4, 6))


def both(spark, dtype="f64", values=VALUES):
    rows = [(i, j, values[i, j].tolist()) for i in range(3) for j in range(4)]
    t = from_arrays(spark.createDataFrame(rows, f"a long, b long, x array<{D.dtype(dtype).sql}>"), ["a", "b"], "x", values.shape, dtype)
    return t, from_values(spark, values.shape, values.ravel().tolist(), dtype)


def same(a, b):
    assert (a.shape, a.dtype) == (b.shape, b.dtype)
    np.testing.assert_allclose(a.to_numpy(), b.to_numpy(), rtol=1e-12)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_elementwise(spark):
    t, u = both(spark)
    for f in (lambda x: x.exp().add_scalar(2.0), lambda x: x.gt_scalar(0.0).cond(x, x.mul_scalar(-2.0)), lambda x: x.mul(x.flip(1)), lambda x: x.flip(0).sub(x), lambda x: x.cast("i32").cast("f64").add(x), lambda x: x.slice(In(0, 3, 2), At(1)).add_scalar(1.0)):
        out = f(t)
        assert isinstance(out, RowTensor)
        same(out, f(u))
    for f in (lambda x: x.flip(2), lambda x: x.transpose(), lambda x: x.slice(Of(2, 0), In(1, 4), In(0, 6, 2)), lambda x: x.slice(At(1), At(2)), lambda x: x.reshape((12, 6)), lambda x: x.unsqueeze([0]), lambda x: x.add(u)):
        same(f(t), f(u))
    with pytest.raises(errors.InvalidSchema):
        t.add(t.cast("f32"))
    with pytest.raises(errors.Unsupported):
        t.conj()


def test_rows_meet_as_rows(spark):
    """One explode, after the join of rows; one alone for tensors over the same rows."""
    t, _ = both(spark)
    text = plan(t.mul(t.flip(0)).rows())
    assert text.count("Generate posexplode") == 1 and text.index("Generate") < text.index("Join")
    assert "Join" not in plan(t.gt_scalar(0.0).cond(t, t.mul_scalar(-1.0)).rows())


@pytest.mark.parametrize("name", ["sum", "min", "max", "mean", "std", "norm", "product"])
def test_reductions(spark, name):
    t, u = both(spark)
    for over in ([2], [0], [0, 2], [0, 1, 2]):
        same(reduce.reduce(t.mul_scalar(2.0), name, over), reduce.reduce(u.mul_scalar(2.0), name, over))


def test_integers_and_complex_numbers(spark):
    t, u = both(spark, "i64", (VALUES * 2.0**60).astype(np.int64))
    same(t.mul(t).add(t.flip(1)), u.mul(u).add(u.flip(1)))
    same(t.pow_scalar(3), u.pow_scalar(3))
    t, u = both(spark)
    z, w = (x.map(lambda v: D.make(v, v * 2 + 1, D.DTYPES["c64"]), "c64") if isinstance(x, RowTensor) else x.like(x.frame, D.make(x.value, x.value * 2 + 1, D.DTYPES["c64"]), dtype="c64") for x in (t, u))
    for f in (lambda x: x.fft(), lambda x: x.ifft(), lambda x: x.fft().ifft(), lambda x: x.fft2(), lambda x: x.ifft2(), lambda x: x.mul(x).fft(), lambda x: x.exp(), lambda x: x.fft().abs(), lambda x: x.exp().fft(), lambda x: x.div(x.flip(1))):
        same(f(z), f(w))
    np.testing.assert_allclose(z.fft().to_numpy(), np.fft.fft(VALUES + 1j * (VALUES * 2 + 1)))
    np.testing.assert_allclose(z.ifft2().to_numpy(), np.fft.ifft2(VALUES + 1j * (VALUES * 2 + 1)) * 24)
    text = z.fft().ifft().rows()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and text.count("MapInArrow") == 2


def test_arrays_are_checked(spark):
    make = lambda rows, shape: from_arrays(spark.createDataFrame(rows, "a long, x array<double>"), ["a"], "x", shape)
    assert make([(0, [1.0, 2.0]), (1, [3.0, 4.0])], (2, 2)).to_numpy().tolist() == [[1, 2], [3, 4]]
    for rows in ([(0, [1.0, 2.0]), (1, [3.0])], [(0, [1.0, 2.0]), (1, None)], [(0, [1.0, None]), (1, [1.0, 1.0])]):
        with pytest.raises(errors.InvalidSchema):
            make(rows, (2, 2))
    with pytest.raises(errors.SparseIndex):
        make([(0, [1.0, 2.0]), (0, [3.0, 1.0])], (2, 2))
    with pytest.raises(errors.DataMismatch):
        make([(0, [1.0, 2.0])], (2, 2))
