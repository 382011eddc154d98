"""Products in one pass, split and tiled; sums of many tensors; reductions over several sets of axes; early ends."""

import itertools

import numpy as np
import pytest

from cellframe import errors
from cellframe.functions import dtypes as D
from cellframe.operators import matrix, reduce
from cellframe.sources.frames import from_sparse_elements, from_values
from cellframe.tensor import fold

DRAW = np.random.default_rng(11)


def tensor(spark, x, dtype="f64", sparse=True):
    return from_values(spark, x.shape, x.ravel().tolist(), dtype, sparse)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("method,most", [("join", 1 << 24), ("join", 0), ("split", 0)])
def test_non_finite_values_meet_absent_ones(spark, monkeypatch, method, most):
    monkeypatch.setattr(matrix, "MOST_MARKS", most)
    a, b = (np.where(DRAW.random(s) < 0.4, np.round(DRAW.normal(size=s), 2), 0) for s in ((2, 5, 6), (2, 6, 4)))
    a[0, 1, 2], a[1, 0, 0], b[0, 3, 3], b[1, 5, 1], b[1, 2, 2] = np.inf, np.nan, -np.inf, np.inf, np.nan
    with np.errstate(all="ignore"):
        wanted = a @ b
    np.testing.assert_allclose(tensor(spark, a).matmul(tensor(spark, b), method).to_numpy(), wanted, rtol=1e-9)
    np.testing.assert_allclose(tensor(spark, a, sparse=False).matmul(tensor(spark, b), method).to_numpy(), wanted, rtol=1e-9)
    with np.errstate(all="ignore"):
        z = tensor(spark, a[0].astype(complex), "c64").matmul(tensor(spark, b[0].astype(complex), "c64"), method).to_numpy()
    assert (np.isnan(z.real) == np.isnan(wanted[0])).all()


def test_one_pass_over_each_side(spark, tmp_path):
    spark.range(50).selectExpr("id AS c0", "id % 7 AS c1", "id * 1.5D AS v").write.parquet(f"file://{tmp_path}/x")
    from cellframe.sources.frames import from_dataframe

    t = from_dataframe(spark.read.parquet(f"file://{tmp_path}/x"), ["c0", "c1"], "v", (50, 7), check=False)
    text = t.mt().matmul(t).rows()._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 2 and "NestedLoop" not in text and "Cartesian" not in text


def test_one_inner_coordinate_with_half_of_all_cells(spark):
    cells = sorted({(i, 3) for i in range(400)} | {(int(i), int(k)) for i, k in zip(DRAW.integers(0, 400, 400), DRAW.integers(0, 50, 400))})
    a = from_sparse_elements(spark, (400, 50), [(c, float(1 + sum(c) % 5)) for c in cells])
    b = tensor(spark, np.round(DRAW.normal(size=(50, 3)), 3))
    np.testing.assert_allclose(a.matmul(b, "split").to_numpy(), a.to_numpy() @ b.to_numpy())
    left = a.df.selectExpr("c0 AS i", "c1 AS k", "v AS x")
    split, _, keys = matrix._split(left, b.df.selectExpr("c0 AS k", "c1 AS j", "v AS y"), ["k"])
    sizes = sorted(r["count"] for r in split.groupBy(*keys).count().collect())
    assert keys == ["k", "salt"] and sizes[-1] < len(cells) / 4  # of four partitions, instead of half


@pytest.mark.parametrize("dtype", ["i64", "u64", "i32", "u8", "c64", "f32"])
def test_tiles_of_every_kind(spark, monkeypatch, dtype):
    monkeypatch.setattr(matrix, "TILE", 4)
    d = D.dtype(dtype)
    shape = [(2, 5, 6), (2, 6, 7)]
    if d.integer:
        a, b = (DRAW.integers(0, 2**63 - 1, s, dtype=np.int64) * 2 + 1 for s in shape)
        a, b = ([[[D.wrap_int(int(v), d) for v in r] for r in m] for m in x] for x in (a, b))
        wanted = [[[D.wrap_int(sum(a[n][i][k] * b[n][k][j] for k in range(6)), d) for j in range(7)] for i in range(5)] for n in range(2)]
    else:
        a, b = (DRAW.normal(size=s) + (1j * DRAW.normal(size=s) if d.kind == "c" else 0) for s in shape)
        wanted = (a @ b).tolist()
        a, b = a.tolist(), b.tolist()
    flat = lambda x: [v for m in x for r in m for v in r]
    x, y = from_values(spark, shape[0], flat(a), dtype), from_values(spark, shape[1], flat(b), dtype)
    for method in ("tiles", "join"):
        found = x.matmul(y, method).to_numpy()
        if d.integer:
            assert found.tolist() == wanted
        else:
            np.testing.assert_allclose(found, np.array(wanted), rtol=1e-5)


def test_diagonals_of_products_make_no_product(spark):
    a, b = np.round(DRAW.normal(size=(2, 4, 6)), 2), np.round(DRAW.normal(size=(2, 6, 4)), 2)
    for sparse in (True, False):
        p = tensor(spark, a, sparse=sparse).matmul(tensor(spark, b, sparse=sparse))
        np.testing.assert_allclose(p.diag().to_numpy(), np.einsum("nik,nki->ni", a, b), rtol=1e-9)
    ints = tensor(spark, np.full((3, 3), 2**62), "i64").matmul(tensor(spark, np.full((3, 3), 3), "i64")).diag()
    assert ints.to_numpy().tolist() == [D.wrap_int(9 * 2**62, D.dtype("i64"))] * 3


def test_many_tensors_meet_at_once(spark):
    parts = [np.where(DRAW.random((6, 5)) < 0.4, np.round(DRAW.normal(size=(6, 5)), 2), 0) for _ in range(4)]
    tensors = [tensor(spark, p) for p in parts]
    out = fold("add", tensors)
    np.testing.assert_allclose(out.to_numpy(), sum(parts))
    text = out.rows()._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and text.count("Exchange hashpartitioning") == 1
    mixed = [*tensors[:3], tensor(spark, parts[3], sparse=False)]
    np.testing.assert_allclose(fold("sub", mixed).to_numpy(), parts[0] - parts[1] - parts[2] - parts[3])
    mask = tensors[0].ne_scalar(0.0)
    np.testing.assert_allclose(mask.cond(tensors[1], tensors[2]).to_numpy(), np.where(parts[0] != 0, parts[1], parts[2]))
    z = fold("mul", [tensor(spark, p.astype(complex) * (1 + 1j), "c64") for p in parts[:3]])
    np.testing.assert_allclose(z.to_numpy(), parts[0] * parts[1] * parts[2] * (1 + 1j) ** 3)
    with pytest.raises(errors.WouldDensify):
        fold("div", tensors)
    with pytest.raises(errors.InvalidSchema):
        fold("add", [tensors[0], tensors[1].cast("f32")])


@pytest.mark.parametrize("name", ["sum", "min", "max", "mean", "std", "norm", "product"])
def test_several_sets_of_axes_from_one_scan(spark, name):
    x = np.where(DRAW.random((3, 4, 5)) < 0.8, np.round(DRAW.normal(size=(3, 4, 5)), 2), 0)
    t = tensor(spark, x)
    sets = [list(s) for n in range(1, 4) for s in itertools.combinations(range(3), n)]
    rows = reduce.reduce_sets(t, name, sets).collect()
    for k, over in enumerate(sets):
        alone = reduce.reduce(t, name, over)
        wanted = {c: v for *c, v in map(tuple, alone.df.collect()) for c in [tuple(c)]}
        kept = [i for i in range(3) if i not in over]
        found = {tuple(r[f"c{i}"] for i in kept) or (0,): r["v"] for r in rows if r["set"] == k}
        assert found.keys() == wanted.keys() and all(abs(found[c] - wanted[c]) < 1e-9 for c in found), over
        assert all(r[f"c{i}"] is None for r in rows if r["set"] == k for i in over)


def test_truth_ends_early(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    many = spark.range(0, 400_000, 1, 40).selectExpr("id AS c0", "CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END AS v").mapInPandas(count, "c0 long, v int")
    from cellframe.tensor import Tensor

    t = Tensor(many, "v", (400_000,), "i32")
    assert t.any() is True and t.all() is False
    assert seen.value < 100_000
    assert reduce.truth_frame(t, "any").first()["v"] is True and reduce.truth_frame(t, "all").first()["v"] is False
    full = from_values(spark, (4,), [1, 2, 3, 4], "i32", True)
    assert full.all() and not from_values(spark, (4,), [1, 0, 3, 4], "i32", True).all() and not full.sub(full).any()


def test_chains_of_long_products_stay_short(spark):
    t = from_values(spark, (3,), [2**63 - 1, -(2**63), 12345678901234567], "i64")
    out, wanted = t, [2**63 - 1, -(2**63), 12345678901234567]
    lengths = []
    for n in range(50):
        out = out.mul_scalar(3 + n).add_scalar(n)
        wanted = [D.wrap_int(v * (3 + n) + n, D.dtype("i64")) for v in wanted]
        lengths.append(len(plan(out.rows())))
    assert out.to_numpy().tolist() == wanted
    assert lengths[49] - lengths[39] < 2 * (lengths[19] - lengths[9])
    u = from_values(spark, (2,), [2**64 - 1, 5], "u64").mul_scalar(2**63 + 7).sub_scalar(9)
    assert u.to_numpy().tolist() == [D.wrap_int((2**64 - 1) * (2**63 + 7) - 9, D.dtype("u64")), D.wrap_int(5 * (2**63 + 7) - 9, D.dtype("u64"))]


@pytest.mark.parametrize("side,fine,strip", [(4, 2, 8), (4, 2, 1 << 20), (8, 1024, 1 << 20)])
def test_tiles_of_stored_integers_move_no_absent_cells(spark, monkeypatch, side, fine, strip):
    for name, value in (("TILE", side), ("MOST_SIDE", 2 * side), ("FINE", fine), ("STRIP", strip), ("CELLS", 5)):
        monkeypatch.setattr(matrix, name, value)
    a, b = (np.where(DRAW.random(s) < 0.2, DRAW.integers(-(2**62), 2**62, s), 0) for s in ((2, 21, 17), (2, 17, 30)))
    a[:, 4:9], b[0, :, 3] = 0, 0
    with np.errstate(all="ignore"):
        wanted = a @ b
    x, y = tensor(spark, a, "i64"), tensor(spark, b, "i64")
    monkeypatch.setattr(type(x), "full", None)  # nothing is filled in
    found = x.matmul(y, "tiles")
    assert found.sparse
    rows = {tuple(r[:3]): r[3] for r in found.rows().collect()}
    assert rows == {c: v for c, v in np.ndenumerate(wanted) if v}


@pytest.mark.parametrize("strip,cells", [(8, 3), (1 << 20, 1 << 20)])
def test_tiles_grow_with_the_product(spark, monkeypatch, strip, cells):
    for name, value in (("TILE", 2), ("MOST_SIDE", 16), ("FINE", 2), ("STRIP", strip), ("CELLS", cells)):
        monkeypatch.setattr(matrix, name, value)
    assert matrix._side(40, 30, 4) == 16 and matrix._side(2, 2, 4) == 2 and matrix._side(10**6, 10**6, 4) == 16
    a, b = DRAW.normal(size=(40, 9)), DRAW.normal(size=(9, 30))
    a[3, 4] = np.inf
    with np.errstate(all="ignore"):
        np.testing.assert_allclose(tensor(spark, a).matmul(tensor(spark, b), "tiles").to_numpy(), a @ b, rtol=1e-9)


def test_a_tensor_turned_back_meets_itself_without_a_join(spark):
    x = np.where(DRAW.random((4, 6, 5)) < 0.5, np.round(DRAW.normal(size=(4, 6, 5)), 2), 0)
    t = tensor(spark, x)
    np.testing.assert_array_equal(t.transpose([2, 0, 1]).transpose([2, 0, 1]).to_numpy(), x.transpose(2, 0, 1).transpose(2, 0, 1))
    assert t.transpose([2, 0, 1]).transpose([1, 2, 0]).frame is t.frame and t.transpose([2, 0, 1]).transpose([2, 0, 1]).frame is not t.frame
    d = t.matmul(t.mt()).diag()
    np.testing.assert_allclose(d.to_numpy(), (x * x).sum(2), rtol=1e-9)
    assert "Join" not in plan(d.rows())


def test_products_with_many_cells_are_made_behind_the_exchange(spark):
    from test_filled import moved

    draw = np.random.default_rng(3)
    x = np.zeros((64, 300))
    for row in x:
        row[draw.choice(300, 30, replace=False)] = draw.integers(1, 9, 30)
    t = tensor(spark, x)
    for method in ("join", "split"):
        p = t.mt().matmul(t, method)
        rows = {tuple(r[:2]): r[2] for r in p.rows().collect()}
        assert rows == {c: v for c, v in np.ndenumerate(x.T @ x) if v}
        assert moved(spark, p.rows()) < 10 * np.count_nonzero(x) < len(rows) / 2
    text = p.rows()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text[: text.index("Generate")]  # sums and products are in one stage


@pytest.mark.parametrize("method", ["join", "split"])
@pytest.mark.parametrize("least,row,most", [(1, 2, 1 << 24), (2, 1 << 12, 0), (1 << 6, 1 << 12, 1 << 24)])
def test_runs_of_outer_coordinates(spark, monkeypatch, method, least, row, most):
    for name, value in (("HELD", 0), ("LEAST_RUN", least), ("ROW", row), ("MOST_MARKS", most)):
        monkeypatch.setattr(matrix, name, value)
    a, b = (np.where(DRAW.random(s) < 0.4, np.round(DRAW.normal(size=s), 2), 0) for s in ((2, 9, 6), (2, 6, 7)))
    ints = [np.where(DRAW.random(s) < 0.4, DRAW.integers(-(2**62), 2**62, s), 0) for s in ((2, 9, 6), (2, 6, 7))]
    a[0, 3:5] = 0
    a[0, 1, 2], a[1, 0, 0], b[0, 3, 3], b[1, 5, 1], b[1, 2, 2] = np.inf, np.nan, -np.inf, np.inf, np.nan
    with np.errstate(all="ignore"):
        wanted = a @ b
        for sparse in itertools.product((True, False), repeat=2):
            x, y = (tensor(spark, v, sparse=s) for v, s in zip((a, b), sparse))
            np.testing.assert_allclose(x.matmul(y, method).to_numpy(), wanted, rtol=1e-9)
        x, y = (tensor(spark, v, "i64") for v in ints)
        np.testing.assert_array_equal(x.matmul(y, method).to_numpy(), ints[0] @ ints[1])
        z = tensor(spark, a[0].astype(complex), "c64").matmul(tensor(spark, b[0].astype(complex), "c64"), method).to_numpy()
    assert (np.isnan(z.real) == np.isnan(wanted[0])).all()


def test_one_run_with_half_of_all_cells(spark, monkeypatch):
    monkeypatch.setattr(matrix, "HELD", 0)
    monkeypatch.setattr(matrix, "LEAST_RUN", 8)
    x = np.where(DRAW.random((64, 400)) < 0.02, DRAW.integers(1, 9, (64, 400)), 0).astype(float)
    x[5] = 1
    x[6, 3] = np.inf
    a, b = tensor(spark, x), tensor(spark, np.round(DRAW.normal(size=(400, 3)), 3))
    with np.errstate(all="ignore"):
        np.testing.assert_allclose(a.matmul(b, "split").to_numpy(), x @ b.to_numpy())
    met, groups = matrix._dealt(a.df.selectExpr("c0 AS i", "c1 AS k", "v AS x"), b.df.selectExpr("c0 AS k", "c1 AS j", "v AS y"), [], (64,), True)
    sizes = sorted(r["count"] for r in met.groupBy("run").count().collect())
    assert groups == [["run", "i", "j"], ["i", "j"]] and sizes[-1] < sum(sizes) / 3  # of four runs, instead of more than half


@pytest.mark.parametrize("method", ["join", "split"])
@pytest.mark.parametrize("most,row", [(5, 3), (64, 4), (1 << 20, 1 << 8)])
def test_sums_are_made_some_products_at_a_time(spark, monkeypatch, method, most, row):
    for name, value in (("HELD", 0), ("LEAST_RUN", 4), ("CELLS", most), ("ROW", row)):
        monkeypatch.setattr(matrix, name, value)
    draw = np.random.default_rng(7)
    a, b = (np.where(draw.random(s) < 0.3, np.round(draw.normal(size=s), 2), 0) for s in ((2, 12, 15), (2, 15, 400)))
    ints = [np.where(draw.random(s) < 0.3, draw.integers(-(2**62), 2**62, s), 0) for s in (a.shape, b.shape)]
    a[0, 3], a[1, 5] = 0, 1.5  # a row without cells, and one with more products than are made at a time
    x, y = tensor(spark, a), tensor(spark, b)
    p = x.matmul(y, method).rows()
    np.testing.assert_allclose(x.matmul(y, method).to_numpy(), a @ b, rtol=1e-9, atol=1e-12)
    text = p._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in text[: text.index("Exchange")]  # no product is a row
    np.testing.assert_array_equal(tensor(spark, ints[0], "i64").matmul(tensor(spark, ints[1], "i64"), method).to_numpy(), ints[0] @ ints[1])
    a[0, 1, 2], a[1, 0, 0], b[0, 4, 3], b[1, 5, 1] = np.inf, np.nan, -np.inf, np.inf
    with np.errstate(all="ignore"):
        np.testing.assert_allclose(tensor(spark, a).matmul(tensor(spark, b), method).to_numpy(), a @ b, rtol=1e-9, atol=1e-12)
    a, b = np.nan_to_num(a, posinf=2, neginf=3), np.nan_to_num(b, posinf=2, neginf=3)
    z = tensor(spark, a * (1 + 2j), "c64").matmul(tensor(spark, b * (3 - 1j), "c64"), method).to_numpy()
    np.testing.assert_allclose(z, (a * (1 + 2j)) @ (b * (3 - 1j)), rtol=1e-9, atol=1e-12)


def test_marks_of_a_run_that_is_dealt_out_are_in_other_tasks(spark, monkeypatch):
    for name, value in (("HELD", 0), ("LEAST_RUN", 4), ("CELLS", 50)):
        monkeypatch.setattr(matrix, name, value)
    draw = np.random.default_rng(9)
    x, y = (np.where(draw.random(s) < 0.05, draw.integers(1, 9, s), 0).astype(float) for s in ((32, 60), (60, 9)))
    x[2], y[7] = 1, 2
    x[2, 7], x[9, 7], x[2, 30], y[30, 4], y[7, 2] = np.inf, -np.inf, np.nan, np.inf, np.inf
    with np.errstate(all="ignore"):
        np.testing.assert_allclose(tensor(spark, x).matmul(tensor(spark, y), "split").to_numpy(), x @ y)
    ints = [np.nan_to_num(v, posinf=5, neginf=6).astype(np.int64) * (2**60 + 1) for v in (x, y)]
    with np.errstate(all="ignore"):
        np.testing.assert_array_equal(tensor(spark, ints[0], "i64").matmul(tensor(spark, ints[1], "i64"), "split").to_numpy(), ints[0] @ ints[1])


def test_cells_far_apart_travel_in_one_array(spark, monkeypatch):
    monkeypatch.setattr(matrix, "ROW", 4)
    left = spark.createDataFrame([(i, k, 1.0) for k in range(30) for i in (k % 3, 3)], "i long, k long, x double")
    right = spark.createDataFrame([(k, 1000 * n + k, 2.0) for k in range(30) for n in range(8)], "k long, j long, y double")
    met, _ = matrix._dealt(left, right, [], (4,), False)
    rows = met.selectExpr("size(js) AS n").collect()
    assert len(rows) == 30 * 2 and {r["n"] for r in rows} == {4}  # of eight cells for each k, all in one run


def test_products_with_their_own_transpose_deal_out_half_of_the_cells_in_bytes(spark):
    draw = np.random.default_rng(4)
    cells = [(i, k, float(draw.integers(1, 99))) for k in range(40) for i in draw.choice(500, 30, replace=False).tolist()]
    left = spark.createDataFrame(cells, "i long, k long, x double")
    right = left.selectExpr("k", "i AS j", "x AS y")
    sent = {}
    for half in (False, True):
        met, _ = matrix._dealt(left, right, [], (500,), False, 500, half)
        assert dict(met.dtypes)["js"] == "array<smallint>" and dict(met.dtypes)["small"] == "array<tinyint>"
        sent[half], wide = met.selectExpr("sum(size(js))", "sum(size(ys))").first()
        assert wide == 0
    assert sent[True] < 0.7 * sent[False]  # of four runs


@pytest.mark.parametrize("method", ["join", "split"])
@pytest.mark.parametrize("most,row", [(50, 3), (1 << 20, 1 << 8)])
def test_products_with_their_own_transpose(spark, monkeypatch, method, most, row):
    for name, value in (("HELD", 0), ("LEAST_RUN", 4), ("CELLS", most), ("ROW", row)):
        monkeypatch.setattr(matrix, name, value)
    draw = np.random.default_rng(8)
    small = np.where(draw.random((17, 40)) < 0.3, draw.integers(-127, 128, (17, 40)), 0).astype(float)
    mixed, odd = small.copy(), small.copy()
    mixed[3:9] = np.where(mixed[3:9] != 0, mixed[3:9] * 3.5 + 200, 0)
    small[5] = 1  # a row that is dealt out by split
    odd[2, 7], odd[4, 30], odd[4, 31], odd[9, 0] = np.inf, np.nan, -np.inf, 1e300
    for x in (small, mixed, odd):
        t = tensor(spark, x)
        with np.errstate(all="ignore"):
            np.testing.assert_allclose(t.mt().matmul(t, method).to_numpy(), x.T @ x, rtol=1e-9)
            np.testing.assert_allclose(t.matmul(t.mt(), method).to_numpy(), x @ x.T, rtol=1e-9)
    ints = np.where(small != 0, draw.integers(-(2**62), 2**62, small.shape), 0)
    t = tensor(spark, ints, "i64")
    with np.errstate(all="ignore"):
        np.testing.assert_array_equal(t.mt().matmul(t, method).to_numpy(), ints.T @ ints)
    z = tensor(spark, mixed * (1 + 2j), "c64")
    np.testing.assert_allclose(z.mt().matmul(z, method).to_numpy(), (mixed.T * (1 + 2j)) @ (mixed * (1 + 2j)), rtol=1e-9)
    # Turned, but not of the same values.
    t = tensor(spark, small)
    np.testing.assert_allclose(t.mt().matmul(t.mul_scalar(2.5), method).to_numpy(), small.T @ small * 2.5, rtol=1e-9)


def test_tiles_of_few_stored_integers_shuffle_no_products(spark, monkeypatch):
    from test_filled import moved

    monkeypatch.setattr(matrix, "FINE", 8)
    monkeypatch.setattr(matrix, "STRIP", 1 << 7)  # a tile has its inner coordinates in strips
    draw = np.random.default_rng(6)
    x = np.zeros((64, 300), np.int64)
    for r in x:
        r[draw.choice(300, 30, replace=False)] = draw.integers(-(2**62), 2**62, 30)
    a, b = tensor(spark, x, "i64"), tensor(spark, x % 90, "i64")
    p = a.mt().matmul(b, "tiles")
    with np.errstate(all="ignore"):
        wanted = x.T @ (x % 90)
    assert p.sparse and {tuple(r[:2]): r[2] for r in p.rows().collect()} == {c: v for c, v in np.ndenumerate(wanted) if v}
    assert moved(spark, p.rows()) < 10 * np.count_nonzero(x) < np.count_nonzero(wanted) / 2
