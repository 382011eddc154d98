import math

import numpy as np
import pytest

from cellframe import errors, geometry as G
from cellframe.functions import dtypes as D
from cellframe.geometry import At, In, Of
from cellframe.operators import fourier, matrix, reduce  # noqa: F401
from cellframe.errors import InvalidLayout, InvalidSchema
from cellframe.sources import frames, store
from cellframe.sources.views import View
from cellframe.streaming import batches

NAN, INF = float("nan"), float("inf")


def dense(spark, values, dtype="f64", shape=None):
    return frames.from_values(spark, shape or (len(values),), values, dtype)


def sparse(spark, values, dtype="f64", shape=None, axis=None):
    return frames.from_values(spark, shape or (len(values),), values, dtype, True, axis)


def listed(t):
    return t.to_numpy().ravel().tolist()


def same(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == y or (math.isnan(x) and math.isnan(y)), (a, b)


U8 = {
    "add": [254, 0, 10, 9],
    "sub": [0, 0, 250, 253],
    "mul": [1, 0, 16, 18],
    "pow": [255, 1, 0, 217],
    "div": [1, 0, 0, 0],
    "rem": [0, 0, 2, 3],
}


@pytest.mark.parametrize("name", U8)
def test_u8_wraps(spark, name):
    left, right = [255, 0, 2, 3], [255, 0, 8, 6]
    assert listed(dense(spark, left, "u8").binary(name, dense(spark, right, "u8"))) == U8[name]


@pytest.mark.parametrize("name", ["u8", "u16", "u32", "u64", "i8", "i16", "i32", "i64"])
def test_integers_wrap_as_numpy(spark, name):
    d = D.dtype(name)
    high = (1 << d.bits) - 1 if d.kind == "u" else (1 << (d.bits - 1)) - 1
    low = 0 if d.kind == "u" else -(1 << (d.bits - 1))
    a, b = [high, low, 2, 0, high, 3, high, low], [high, high, 3, 5, 2, low, 1, 1]
    kind = np.dtype(("uint" if d.kind == "u" else "int") + str(d.bits))
    x, y = np.array(a, dtype=object), np.array(b, dtype=object)
    with np.errstate(all="ignore"):
        for op, f in (("add", lambda p, q: p + q), ("sub", lambda p, q: p - q), ("mul", lambda p, q: p * q)):
            wanted = [D.wrap_int(int(f(p, q)), d) for p, q in zip(x, y)]
            assert listed(dense(spark, a, name).binary(op, dense(spark, b, name))) == wanted, op
            assert listed(dense(spark, a, name).scalar(op, b[0])) == [D.wrap_int(int(f(p, b[0])), d) for p in x]
    whole = dense(spark, [high, low, 7, 9, low], name)
    other = dense(spark, [0, 0, 2, -2 if d.kind == "i" else 4, -1 if d.kind == "i" else 3], name)
    assert listed(whole.div(other)) == [0, 0, 3, -4 if d.kind == "i" else 2, low if d.kind == "i" else 0]
    assert listed(whole.rem(other)) == [0, 0, 1, 1, 0]
    assert listed(whole.abs())[1] == low
    assert listed(dense(spark, [high, low, 2, 0], name).sum([0])) == [D.wrap_int(high + low + 2, d)]
    assert dense(spark, [high, 3, 5], name).product_all() == D.wrap_int(high * 15, d)
    assert np.array(a, kind).tolist() == listed(dense(spark, a, name))


def test_integer_powers(spark):
    assert listed(dense(spark, [-128, -1, 2, 0], "i8").pow_scalar(-3)) == [0, -1, 0, 0]
    assert listed(dense(spark, [-128, -1, 2, 0], "i8").pow_scalar(-128)) == [0, 1, 0, 0]
    assert listed(dense(spark, [2], "u64").pow_scalar(2**32)) == [0]
    assert listed(dense(spark, [-1], "i64").pow_scalar(2**32 + 1)) == [-1]


def test_u8_scalars(spark):
    t = dense(spark, [0, 1, 127, 255], "u8")
    assert listed(t.add_scalar(1)) == [1, 2, 128, 0] and listed(t.sub_scalar(1)) == [255, 0, 126, 254]
    assert listed(t.mul_scalar(2)) == [0, 2, 254, 254] and listed(t.pow_scalar(2)) == [0, 1, 1, 1]
    assert listed(t.div_scalar(0)) == [0] * 4 and listed(t.rem_scalar(0)) == [0] * 4
    assert listed(t.and_scalar(127)) == [0, 1, 1, 1] and listed(t.xor_scalar(255)) == [1, 0, 0, 0] and listed(t.gt_scalar(127)) == [0, 0, 0, 1]


@pytest.mark.parametrize("name", ["f32", "f64"])
def test_ieee_arithmetic(spark, name):
    left = [0.0, -0.0, 5.5, -5.5, 0.0, 2.0, NAN, INF, -INF]
    right = [0.0, 2.0, 2.0, -2.0, 3.0, 0.0, 1.0, 2.0, 0.0]
    kind = np.float32 if name == "f32" else np.float64
    a, b = np.array(left, kind), np.array(right, kind)
    with np.errstate(all="ignore"):
        wanted = {"add": a + b, "sub": a - b, "mul": a * b, "div": a / b, "pow": a**b, "rem": np.fmod(a, b), "log": np.log(a) / np.log(b)}
        for op, w in wanted.items():
            got = dense(spark, left, name).binary(op, dense(spark, right, name)).to_numpy()
            np.testing.assert_allclose(got, w, rtol=1e-6, err_msg=op)
        for op, w in {"eq": a == b, "ne": a != b, "gt": a > b, "ge": a >= b, "lt": a < b, "le": a <= b}.items():
            assert listed(dense(spark, left, name).binary(op, dense(spark, right, name))) == w.astype(int).tolist(), op


@pytest.mark.parametrize("name", ["f32", "f64"])
def test_unary_on_special_values(spark, name):
    values = [-2, -1, -0.5, -0.0, 0, 0.2, 0.5, 1, 2, 2.5, -2.5, 1000, -1000, INF, -INF, NAN]
    x = np.array(values, np.float32 if name == "f32" else np.float64)
    with np.errstate(all="ignore"):
        wanted = {n: getattr(np, m)(x) for n, m in {"exp": "exp", "ln": "log", "abs": "abs", "sin": "sin", "asin": "arcsin", "sinh": "sinh", "cos": "cos", "acos": "arccos", "cosh": "cosh", "tan": "tan", "atan": "arctan", "tanh": "tanh"}.items()}
    wanted["round"] = np.where(np.isfinite(x), np.copysign(np.floor(np.abs(x) + 0.5), x), x)
    t = dense(spark, values, name)
    for n, w in wanted.items():
        np.testing.assert_allclose(t.unary(n).to_numpy(), w, rtol=2e-6 if name == "f32" else 1e-13, err_msg=n)
    assert listed(t.is_nan()) == np.isnan(x).astype(int).tolist() and listed(t.is_inf()) == np.isinf(x).astype(int).tolist()
    assert listed(t.not_()) == (x == 0).astype(int).tolist()
    assert math.copysign(1, dense(spark, [-0.4], name).round().read_value((0,))) == -1


def test_casts(spark):
    for source, target, value, wanted in (
        ("i64", "u8", -1, 255),
        ("f64", "u8", -1.0, 0),
        ("f64", "u8", 256.0, 0),
        ("i32", "f64", 16777217, 16777216.0),
        ("i32", "f64", -16777217, -16777216.0),
        ("i8", "u64", -1, 255),
        ("u32", "i64", 2**32 - 1, -1),
        ("f64", "i64", 1e300, 2**63 - 1),
        ("f64", "i64", NAN, 0),
        ("f64", "u64", 1.8e19, 18000000000000000000),
        ("f64", "i32", -3.9, -3),
        ("u64", "i64", 2**64 - 1, -1),
        ("i64", "u64", -2, 2**64 - 2),
        ("f64", "f32", 0.1, float(np.float32(0.1))),
        ("c64", "f32", 1.5 + 2j, 1.5),
        ("u8", "c32", 7, 7 + 0j),
    ):
        assert dense(spark, [value], source).cast(target).read_value((0,)) == wanted, (source, target, value)


DENSIFY = "exp ln cos acos cosh not".split()


def test_operations_that_would_densify(spark):
    t = sparse(spark, [2, 0, 0, 0], "f32", (1, 4))
    for n in DENSIFY:
        with pytest.raises(errors.WouldDensify):
            t.unary(n)
    for n in ("div", "pow", "log", "rem", "eq", "ge", "le"):
        with pytest.raises(errors.WouldDensify, match=n):
            t.binary(n, t)
    bad = [("add", 1), ("sub", 1), ("mul", NAN), ("mul", INF), ("div", 0), ("div", NAN), ("pow", 0), ("pow", -1), ("pow", NAN), ("log", 2), ("rem", 0), ("rem", NAN)]
    bad += [("eq", 0), ("ne", 1), ("gt", -1), ("ge", 0), ("lt", 1), ("le", 0), ("or", 1), ("xor", 1)]
    for n, s in bad:
        with pytest.raises(errors.WouldDensify):
            t.scalar(n, float(s))
    for n, s in [("add", 0), ("div", INF), ("pow", 2), ("rem", 3), ("eq", 2), ("ne", 0), ("gt", 0), ("gt", NAN), ("ge", 1), ("lt", 0), ("le", -1), ("and", 5), ("or", 0), ("xor", 0)]:
        t.scalar(n, float(s))
    assert listed(t.abs().mul_scalar(3.0).div_scalar(2.0).pow_scalar(2.0)) == [9, 0, 0, 0]
    i = sparse(spark, [2, 0, 0, 0], "i32", (1, 4))
    assert listed(i.div(i)) == [1, 0, 0, 0] and listed(i.rem(i)) == [0] * 4 and listed(i.div_scalar(2)) == [1, 0, 0, 0]
    same(listed(sparse(spark, [2, 0, 0, 0]).mul(sparse(spark, [0, INF, NAN, 0]))), [0, NAN, NAN, 0])
    assert listed(t.into_dense().exp())[1:] == [1, 1, 1]


def test_cond(spark):
    for make in (dense, sparse):
        c, a, b = make(spark, [0, 0, 0, 1], "u8"), make(spark, [0, 2, 0, 0]), make(spark, [0, 0, 3, 0])
        assert listed(c.cond(a, b)) == [0, 0, 3, 0]
    mixed = sparse(spark, [0, 1, 127, 255, 0, 0], "u8").cond(dense(spark, [1, 2, 3, 4, 5, 6]), sparse(spark, [9, 0, 0, 0, 0, 9]))
    assert listed(mixed) == [9, 2, 3, 4, 0, 9] and not mixed.sparse


def test_reductions_count_implied_zeros(spark):
    t = sparse(spark, [0, 0, 0, 2, 0, 3], shape=(2, 3))
    assert listed(t.sum([1])) == [0, 5] and listed(t.product([1])) == [0, 0] and listed(t.min([1])) == [0, 0] and listed(t.max([1])) == [0, 3]
    assert not t.all() and t.any()
    for make in (dense, sparse):
        s = make(spark, [2, 0, 4, 0, 0, 0], shape=(2, 3))
        assert s.mean_all() == 1 and abs(s.std_all() - math.sqrt(7 / 3)) < 1e-12 and abs(s.norm_all() - math.sqrt(20)) < 1e-12
        assert s.mean([1], True).to_numpy().tolist() == [[2], [0]]
    n = 1_000_000_007
    big = frames.from_sparse_elements(spark, (2, n), [((0, 1), 2.0), ((0, n - 1), 3.0)])
    assert big.sum_all() == 5 and big.product_all() == 0 and big.min_all() == 0 and big.max_all() == 3
    assert abs(big.mean_all() - 5 / (2 * n)) < 1e-20 and abs(big.norm_all() - math.sqrt(13)) < 1e-12
    assert sparse(spark, [0, 0]).sum_all() == 0 and sparse(spark, [0, 0]).min_all() == 0 and not sparse(spark, [0, 0]).any()


def test_dense_reductions(spark):
    t = dense(spark, range(1, 13), shape=(2, 3, 2))
    assert listed(t.sum([1])) == [9, 12, 27, 30]
    assert listed(t.sum([1]).transpose()) == [9, 27, 12, 30]
    assert listed(t.sum([1]).slice(At(1), Of(1, 0, 1))) == [30, 27, 30]
    x = np.arange(1, 13.0).reshape(2, 3, 2)
    np.testing.assert_allclose(t.std([0, 2], True).to_numpy(), x.std((0, 2), keepdims=True))
    assert t.sum([0, 1, 2]).shape == (1,) and listed(t.sum([])) == list(range(1, 13))
    assert dense(spark, [255] * 4097, "u8").sum_all() == 255 and dense(spark, [255] * 4097, "u8").product_all() == 255
    s = dense(spark, [1.0, NAN])
    assert all(math.isnan(f()) for f in (s.min_all, s.max_all, s.sum_all, s.product_all)) and s.all()
    assert dense(spark, [1e308, 1e308]).mean_all() == 1e308 and abs(dense(spark, [1e-200]).norm_all() / 1e-200 - 1) < 1e-14
    assert abs(dense(spark, [1e200, -1e200]).norm_all() / (1e200 * math.sqrt(2)) - 1) < 1e-14 and abs(dense(spark, [1e200, -1e200]).std_all() / 1e200 - 1) < 1e-14
    assert dense(spark, [1.0, INF]).norm_all() == INF and math.isnan(dense(spark, [1.0, INF]).std_all())
    z = dense(spark, [1 + 2j, 3 + 4j], "c64")
    assert z.mean_all() == 2 + 3j and abs(z.std_all() - math.sqrt(2)) < 1e-12 and abs(z.norm_all() - math.sqrt(30)) < 1e-12
    assert z.product_all() == (1 + 2j) * (3 + 4j) and z.sum_all() == 4 + 6j
    with pytest.raises(errors.Unsupported):
        z.min_all()
    with pytest.raises(errors.InvalidSchema):
        t.sum([3])
    for n in ("u8", "i32", "f32", "i64", "u64"):
        s = dense(spark, [1, 2, 3, 4], n, (2, 2))
        assert s.mean_all() == 2.5 and abs(s.std_all() - math.sqrt(1.25)) < 1e-12 and listed(s.mean([1]))[1] == 3.5


def test_transforms(spark):
    x = np.arange(60.0).reshape(3, 4, 5)
    t = dense(spark, range(60), shape=(3, 4, 5))
    checks = [
        (t.transpose(), x.T),
        (t.transpose([1, 2, 0]), x.transpose(1, 2, 0)),
        (t.slice(In(0, 3, 2), At(1), Of(4, 0, 4)), x[::2, 1][:, [4, 0, 4]]),
        (t.flip(2), x[:, :, ::-1]),
        (t.reshape((12, 5)), x.reshape(12, 5)),
        (t.slice(In(1, 3)).reshape((40,)), x[1:].reshape(40)),
        (t.unsqueeze([0, 2]), x[None, :, :, None]),
        (t.unsqueeze([1]).squeeze([1]), x),
        (t.unsqueeze([1]).reshape((60,)), x.reshape(60)),
        (t.slice(In(0, 1)).broadcast((2, 3, 4, 5)), np.broadcast_to(x[:1], (2, 3, 4, 5))),
    ]
    for got, wanted in checks:
        assert got.shape == wanted.shape
        np.testing.assert_array_equal(got.to_numpy(), wanted)
    assert t.slice(At(1), At(2), At(3)).read_value(()) == x[1, 2, 3]
    for bad in (lambda: t.flip(0).reshape((60,)), lambda: t.slice(In(0, 1)).broadcast((1, 1, 4, 5)).reshape((20,)), lambda: t.transpose().reshape((60,))):
        with pytest.raises(errors.Unsupported):
            bad()
    for bad in (lambda: t.reshape((7,)), lambda: t.slice(In(1, 1)), lambda: t.squeeze([0]), lambda: t.squeeze([]), lambda: t.unsqueeze([3]), lambda: t.transpose([0, 0, 1]), lambda: t.broadcast((3, 4, 6)), lambda: t.add(t.transpose())):
        with pytest.raises(errors.InvalidSchema):
            bad()
    with pytest.raises(errors.InvalidCoord):
        t.slice(At(3))
    with pytest.raises(errors.InvalidSchema):
        t.add(t.cast("f32"))
    assert not t.slice(Of(0, 0)).supports_write_through and t.flip(0).supports_write_through


def test_matrices(spark):
    draw = np.random.default_rng(1)
    for m, k, n in ((1, 1, 1), (2, 3, 2), (9, 17, 7)):
        a, b = np.arange(m * k).reshape(m, k) % 3.0, (np.arange(k * n) + 1).reshape(k, n) % 4.0
        for left in (dense, sparse):
            for right in (dense, sparse):
                p, q = left(spark, a.ravel(), shape=(m, k)), right(spark, b.ravel(), shape=(k, n))
                np.testing.assert_array_equal(p.matmul(q).to_numpy(), a @ b)
        np.testing.assert_allclose(dense(spark, a.ravel(), shape=(m, k)).matmul(dense(spark, b.ravel(), shape=(k, n)), "tiles").to_numpy(), a @ b)
    x, y = draw.random((150, 200)), draw.random((200, 140))
    np.testing.assert_allclose(dense(spark, x.ravel(), shape=x.shape).matmul(dense(spark, y.ravel(), shape=y.shape), "tiles").to_numpy(), x @ y)
    for v in (INF, -INF, NAN):
        out = sparse(spark, [0, 1, 0, 0], shape=(2, 2)).matmul(sparse(spark, [v, 0, 0, 2], shape=(2, 2))).to_numpy()
        with np.errstate(all="ignore"):
            np.testing.assert_array_equal(out, np.array([[0, 1], [0, 0.0]]) @ np.array([[v, 0], [0, 2]]))
    assert dense(spark, [255] * 129, "u8", (1, 129)).matmul(dense(spark, [2] * 129, "u8", (129, 1))).read_value((0, 0)) == 254
    eye = dense(spark, [1, 0, 0, 1], shape=(1, 2, 2)).broadcast((2, 2, 2))
    assert listed(dense(spark, range(1, 9), shape=(2, 2, 2)).matmul(eye)) == list(range(1, 9))
    z = dense(spark, [1 + 2j, 3, 1j, 4 - 1j], "c64", (2, 2))
    w = np.array([[1 + 2j, 3], [1j, 4 - 1j]])
    np.testing.assert_allclose(z.matmul(z).to_numpy(), w @ w)
    np.testing.assert_allclose(z.mh().to_numpy(), w.conj().T)
    np.testing.assert_allclose(z.diag().to_numpy(), w.diagonal())
    for bad in (lambda: dense(spark, [1, 2]).matmul(dense(spark, [1, 2])), lambda: z.slice(At(0)).diag(), lambda: dense(spark, range(6), shape=(2, 3)).diag(), lambda: z.matmul(z.slice(In(0, 1)))):
        with pytest.raises(errors.InvalidSchema):
            bad()


def test_complex_functions(spark):
    w = np.array([1 + 2j, -3 + 0.5j, 0.25j, 2 - 1j])
    z = dense(spark, w, "c64")
    for name, f in {"exp": np.exp, "ln": np.log, "sin": np.sin, "asin": np.arcsin, "sinh": np.sinh, "cos": np.cos, "acos": np.arccos, "cosh": np.cosh, "tan": np.tan, "atan": np.arctan, "tanh": np.tanh, "abs": np.abs, "angle": np.angle, "conj": np.conj, "re": np.real, "im": np.imag}.items():
        np.testing.assert_allclose(z.unary(name).to_numpy(), f(w), err_msg=name)
    other = dense(spark, w[::-1], "c64")
    for name, f in {"add": np.add, "sub": np.subtract, "mul": np.multiply, "div": np.divide, "pow": np.power}.items():
        np.testing.assert_allclose(z.binary(name, other).to_numpy(), f(w, w[::-1]), err_msg=name)
    assert listed(z.eq(z)) == [1] * 4 and listed(z.ne(other)) == [1] * 4
    assert dense(spark, [complex(-1, -0.0)], "c64").angle().read_value((0,)) == -math.pi
    with pytest.raises(errors.Unsupported):
        z.gt(other)


@pytest.mark.parametrize("n", [1, 3, 8, 17])
def test_fourier(spark, n):
    w = np.array([complex(i % 7 - 3, i % 5 - 2) for i in range(3 * n)]).reshape(3, n)
    for make in (dense, sparse):
        z = make(spark, w.ravel(), "c64", (3, n))
        np.testing.assert_allclose(z.fft().to_numpy(), np.fft.fft(w), atol=1e-9)
        np.testing.assert_allclose(z.ifft().to_numpy(), np.fft.ifft(w) * n, atol=1e-9)
        np.testing.assert_allclose(fourier.dft_join(z).to_numpy(), np.fft.fft(w), atol=1e-9)
        np.testing.assert_allclose(z.fft2().to_numpy(), np.fft.fft2(w), atol=1e-9)
        np.testing.assert_allclose(z.ifft2().to_numpy(), np.fft.ifft2(w) * 3 * n, atol=1e-9)
    with pytest.raises(errors.Unsupported):
        frames.create(spark, (2, 5000), "c64").fft()
    with pytest.raises(errors.Unsupported):
        frames.create(spark, (2, 5)).fft()


def test_store(spark, tmp_path):
    t = sparse(spark, [i % 3 for i in range(60)], "i32", (3, 4, 5), axis=1)
    for kind in ("parquet", "orc", "json"):
        s = store.write(t, f"file://{tmp_path}/{kind}", 4, kind)
        s.validate()
        s.sync()
        back = store.load(spark, s.path)
        assert (back.shape, back.dtype, back.sparse, back.axis) == (t.shape, t.dtype, True, 1)
        np.testing.assert_array_equal(back.to_numpy(), t.to_numpy())
    z = store.write(dense(spark, [1j, 2], "c32"), f"file://{tmp_path}/z")
    assert listed(z) == [1j, 2]
    with pytest.raises(errors.InvalidSchema):
        store.load(spark, f"file://{tmp_path}/none")
    with pytest.raises(Exception, match="(?i)exists"):
        store.write(t, f"file://{tmp_path}/parquet")
    with pytest.raises(errors.InvalidLayout):
        store.copy_from(t, f"file://{tmp_path}/d", sparse=False)
    d = store.copy_from_values(t, f"file://{tmp_path}/dense")
    d.validate()
    assert not d.sparse and d.df.count() == 60
    bad = t.like(t.df.union(t.df.limit(1)), axis=1)
    with pytest.raises(errors.SparseIndex):
        store.write(bad, f"file://{tmp_path}/bad").validate()
    with pytest.raises(errors.InvalidSchema):
        store.check_metadata({"shape": [1]})


def test_updates(spark):
    t = dense(spark, [0] * 6, "u8")
    w = store.write_values(t, [Of(5, 1, 5)], [3, 4, 7])
    assert listed(w) == [0, 4, 0, 0, 0, 7] and listed(t) == [0] * 6
    with pytest.raises(errors.DataMismatch):
        store.write_values(t, [In(0, 2)], [1])
    assert listed(store.write_value(sparse(spark, [1, 0, 2]), (1,), 9.0)) == [1, 9, 2]
    assert listed(frames.fill(sparse(spark, [1, 0, 2]), 0.0)) == [0, 0, 0] and listed(frames.fill(t, 3)) == [3] * 6
    m = sparse(spark, range(15), "u8", (3, 5), axis=0)
    r = store.replace_logical_block(m, 1, [9, 0, 9, 0, 9])
    assert listed(r)[5:10] == [9, 0, 9, 0, 9]
    assert [x.block for x in store.occupied_blocks(store.replace_logical_block(m, 1, [0] * 5)).collect()] == [0, 2]
    rows = store.read_logical_blocks(m, [0, 2]).orderBy("block", "offset").collect()
    assert [x.v for x in rows] == [0, 1, 2, 3, 4, 10, 11, 12, 13, 14]
    with pytest.raises(errors.InvalidCoord):
        store.read_logical_blocks(m, [2, 0])
    with pytest.raises(errors.DataMismatch):
        store.replace_logical_block(m, 1, [1])
    with pytest.raises(errors.InvalidLayout):
        store.occupied_blocks(t)
    base = dense(spark, range(12), shape=(3, 4))
    steps = [("slice", (In(0, 3, 2), In(1, 4))), ("flip", (1,)), ("transpose", ())]
    view = base.slice(In(0, 3, 2), In(1, 4)).flip(1).transpose()
    for c in G.row_major_coords(view.shape):
        assert base.read_value(store.resolve_base_coord(base, steps, c)) == view.read_value(c)
    assert store.plan_updates(base, [("flip", (0,))], [7, 8], capacity=4) == {2: [(0, 7), (1, 8)]}
    assert store.logical_block_range(base, [("slice", (In(1, 3),))], 4) == (1, 3)


def test_construction(spark):
    for bad in ((), (0,), (2, -1), (2**40, 2**40)):
        with pytest.raises(errors.InvalidSchema):
            frames.create(spark, bad)
    for values in ([1], [1, 2, 3]):
        with pytest.raises(errors.DataMismatch):
            dense(spark, values, shape=(2,))
    for cells in ([((1,), 1), ((0,), 2)], [((1,), 1), ((1,), 2)]):
        with pytest.raises(errors.SparseIndex):
            frames.from_sparse_elements(spark, (3,), cells)
    with pytest.raises(errors.InvalidCoord):
        frames.from_sparse_elements(spark, (3,), [((3,), 1)])
    with pytest.raises(errors.InvalidSchema):
        frames.create(spark, (2,), "bool")
    rows = spark.createDataFrame([(0, 1, 2.0), (0, 1, 3.0)], "a int, b int, x double")
    with pytest.raises(errors.SparseIndex):
        frames.from_dataframe(rows, ["a", "b"], "x", (2, 2))
    with pytest.raises(errors.InvalidCoord):
        frames.from_dataframe(rows.limit(1), ["a", "b"], "x", (2, 1))
    huge = frames.from_sparse_elements(spark, (2**62,), [((2**61,), 3)], "u8")
    assert huge.read_value((2**61,)) == 3 and huge.read_value((5,)) == 0


def test_batches(spark):
    t = sparse(spark, [i % 4 for i in range(9000)], shape=(90, 100))
    blocks = list(batches.read_blocks(t))
    assert [len(b) for b in blocks] == [4096, 4096, 808] and sum(blocks, []) == [i % 4 for i in range(9000)]
    cells = sum(batches.read_coordinate_blocks(t), [])
    assert len(cells) == 9000 and len({c for c, _ in cells}) == 9000
    found = sum(batches.read_sparse_elements_in_order(t, [Of(3, 1, 3), In(0, 9)]), [])
    assert found == [((r, c), float((r * 100 + c) % 4)) for r in (1, 3) for c in range(9) if c % 4]
    assert list(batches.read_sparse_elements_in_order(t, [In(5, 5)])) == []
    with pytest.raises(errors.UnsupportedSparseIterationOrder):
        batches.sparse_elements_frame(t, order=[1, 0])
    with pytest.raises(errors.InvalidLayout):
        batches.sparse_elements_frame(t.into_dense())


def test_geometry():
    assert [G.StorageGeometry((2, 3, 5), True, a, 16).block_capacity for a in (None, 0, 1, 2)] == [1, 15, 5, 1]
    g = G.StorageGeometry((3, 5), False, None, 4)
    assert g.block_count == 4 and g.block_range(3) == (12, 15) and g.block_len(3) == 3 and g.block_position((2, 4)) == (3, 2)
    with pytest.raises(errors.InvalidCoord):
        g.validate_block(4)
    assert G.broadcast_shape((3, 1), (2, 1, 4)) == (2, 3, 4) and G.broadcast_reduce_axes((3, 1), (2, 3, 4)) == [0, 2]
    assert G.matmul_output_shape((2, 3, 4), (2, 4, 5)) == (2, 3, 5) and G.matmul_broadcast_shapes((3, 4), (2, 4, 5)) == ((2, 3, 4), (2, 4, 5))
    assert list(G.row_major_coords((2, 2))) == [(0, 0), (0, 1), (1, 0), (1, 1)] and G.contiguous_strides((2, 3, 4)) == (12, 4, 1)


def test_no_join_between_expressions_of_one_frame(spark):
    t = dense(spark, range(6))
    plan = t.add(t.mul_scalar(2.0)).gt_scalar(3.0).cond(t, t.sub_scalar(1.0)).df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_block_range_of_gathers(spark):
    base = dense(spark, range(48), shape=(8, 6))
    assert store.logical_block_range(base, [("slice", (Of(5, 1, 7, 3),))], 6) == (1, 8)
    cases = [
        [("slice", (Of(5, 1, 7, 3), Of(2, 0, 5, 1)))],
        [("slice", (Of(5, 1, 7, 3),)), ("flip", (0,)), ("transpose", ())],
        [("slice", (Of(5, 1, 7, 3), In(1, 4))), ("slice", (In(1, 4), Of(2, 0, 1)))],
        [("slice", (In(1, 7),)), ("reshape", ((4, 9),)), ("slice", (Of(2, 0, 3, 1), In(2, 5)))],
        [("reshape", ((6, 8),)), ("slice", (Of(3, 1, 4, 2), In(2, 5)))],
    ]
    for steps in cases:
        view = base
        for name, args in steps:
            view = getattr(view, name)(*args)
        for capacity in (4, 5, 7):
            g = store.geometry_of(base, capacity)
            blocks = {g.block_position(store.resolve_base_coord(base, steps, c))[0] for c in G.row_major_coords(view.shape)}
            assert store.logical_block_range(base, steps, capacity) == (min(blocks), max(blocks) + 1), (steps, capacity)


def test_block_reads_reach_the_files(spark, tmp_path):
    t = store.write(sparse(spark, [1, 0, 2, 0, 3, 4, 5, 6, 0], shape=(3, 3)), f"file://{tmp_path}/blocks")
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (store.read_logical_blocks(t, [1, 4]), store.occupied_blocks(t, [In(1, 2)]))]
    assert "In(block, [1,4])" in plans[0] and "GreaterThanOrEqual(block,3)" in plans[1]
    assert [r.block for r in store.occupied_blocks(t, [In(1, 2)]).collect()] == [4, 5]
    seen = []
    store.visit_blocks(t, [1, 4], lambda block, values: seen.append((block, values)))
    assert seen == [(1, [0]), (4, [3])]


def test_writes_through_views(spark):
    base = sparse(spark, [1, 2, 3, 4, 5, 6], shape=(2, 3))
    view = View(base).transpose().flip(0)
    out = view.write(view.tensor.mul_scalar(10.0))
    assert out.source.to_numpy().tolist() == [[10, 20, 30], [40, 50, 60]] and out.tensor.read_value((0, 1)) == 60
    with pytest.raises(InvalidLayout):
        View(base).slice(Of(0, 0)).updates_from(base)
    with pytest.raises(InvalidSchema):
        View(base).slice(At(0)).updates_from(base)
    values = spark.createDataFrame([(0, 7.0), (1, 8.0), (2, 9.0)], "seq long, v double")
    assert store.write_values(base, [At(1), Of(2, 0, 2)], values).to_numpy().tolist() == [[1, 2, 3], [8, 5, 9]]
