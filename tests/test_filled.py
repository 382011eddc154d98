"""Cells between the rows of sparse tensors: made where they are read, and never shuffled."""

import numpy as np
import pytest

from cellframe import tensor as T
from cellframe.geometry import At, In, Of
from cellframe.sources import frames, store
from cellframe.streaming import batches


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def moved(spark, df):
    """Rows that the exchanges of a run of this frame wrote."""
    df = df.select("*")
    df.collect()

    def walk(plan):
        name = plan.nodeName()
        found = [plan] if "Exchange" in name and "Broadcast" not in name and "Reused" not in name else []
        inner = [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if "QueryStage" in name else []
        children = plan.children()
        for p in inner + [children.apply(i) for i in range(children.size())]:
            found += walk(p)
        return found

    return sum(p.metrics().apply("shuffleRecordsWritten").value() for p in walk(df._jdf.queryExecution().executedPlan()))


@pytest.fixture
def sparse(spark):
    draw = np.random.default_rng(5)
    x = np.where(draw.random((40, 7, 90)) < 0.02, draw.integers(1, 9, (40, 7, 90)), 0).astype(float)
    x[0, 0, 0] = x[-1, -1, -1] = 5
    x[10:20] = 0  # longer than a part
    cells = [(tuple(map(int, c)), float(x[tuple(c)])) for c in np.argwhere(x)]
    return frames.from_sparse_elements(spark, x.shape, cells), x


@pytest.mark.parametrize("run,part", [(1, 3), (64, 100), (1 << 12, 1 << 20)])
def test_every_cell_once(spark, monkeypatch, sparse, run, part):
    monkeypatch.setattr(T, "RUN", run)
    monkeypatch.setattr(T, "PART", part)
    t, x = sparse
    rows = t.into_dense().rows().collect()
    assert len(rows) == x.size and {tuple(r[:3]): r[3] for r in rows} == dict(np.ndenumerate(x))
    assert [r["v"] for r in t.row_major().collect()] == x.ravel().tolist()
    assert [v for b in batches.read_blocks(t) for v in b] == x.ravel().tolist()


@pytest.mark.parametrize("lane,part", [(4, 100), (9, 1 << 20), (64, 1 << 20)])
def test_every_cell_once_in_lanes(spark, monkeypatch, sparse, lane, part):
    for name, value in (("LANE", lane), ("LANES_FROM", 2), ("RUN", 64), ("PART", part)):
        monkeypatch.setattr(T, name, value)
    t, x = sparse
    rows = t.into_dense().rows().collect()
    assert len(rows) == x.size and {tuple(r[:3]): r[3] for r in rows} == dict(np.ndenumerate(x))
    assert [r["v"] for r in t.row_major().collect()] == x.ravel().tolist()


def test_files_of_filled_cells_hold_few_bytes_for_a_cell(spark, tmp_path):
    shape = (40, 20011)
    t = frames.from_sparse_elements(spark, shape, sorted(((i % 40, i * 37 % 20011), float(i)) for i in range(1, 900)))
    t.into_dense().gt_scalar(2.0).rows().write.parquet(f"{tmp_path}/out")
    stored = store.copy_from_values(t, f"{tmp_path}/stored")
    assert stored.df.count() == t.size and {tuple(r) for r in stored.df.where("v <> 0").collect()} == {tuple(r) for r in t.rows().collect()}
    for name in ("out", "stored"):
        assert sum(p.stat().st_size for p in (tmp_path / name).rglob("*.parquet")) < 0.6 * t.size


def test_cells_that_are_made_are_not_shuffled(spark, sparse):
    t, x = sparse
    for df in (t.into_dense().rows(), t.into_dense().gt_scalar(2.0).rows(), frames.fill(frames.create(spark, t.shape), 1.0).add(t).rows(), t.row_major()):
        assert "Join" not in executed(df) and moved(spark, df) < x.size / 8
    text = executed(t.row_major())
    assert text.count("rangepartitioning") == 1 and "Sort [c0" not in text


def test_constants_meet_sparse_and_dense_tensors(spark, sparse):
    t, x = sparse
    one = frames.fill(frames.create(spark, t.shape), 1.0).mul_scalar(2.0)
    dense = frames.from_values(spark, t.shape, (x + 3).ravel().tolist())
    np.testing.assert_array_equal(one.add(t).to_numpy(), x + 2)
    np.testing.assert_array_equal(t.sub(one).to_numpy(), x - 2)
    np.testing.assert_array_equal(one.add(dense).to_numpy(), x + 5)
    np.testing.assert_array_equal(one.add(one.mul_scalar(-1.0)).to_numpy(), x * 0)
    np.testing.assert_array_equal(T.fold("add", [t, one, t.mul_scalar(2.0), dense]).to_numpy(), 4 * x + 5)
    np.testing.assert_array_equal(t.into_dense().gt_scalar(4.0).cond(one, t).to_numpy(), np.where(x > 4, 2, x))


def test_slices_and_single_values_of_filled_tensors_make_their_cells_only(spark, sparse):
    t, x = sparse
    d = t.into_dense()
    np.testing.assert_array_equal(d.slice(In(3, 30, 4), At(2)).to_numpy(), x[3:30:4, 2])
    np.testing.assert_array_equal(d.slice(Of(5, 1, 5)).to_numpy(), x[[5, 1, 5]])
    assert len(d.slice(At(3), At(2)).rows().collect()) == x.shape[2]
    assert d.read_value((0, 0, 0)) == 5 and d.read_value((12, 0, 0)) == 0


def test_rows_outside_the_shape_fall_away(spark):
    df = spark.createDataFrame([(0, 1, 2.0), (5, 0, 3.0), (1, -1, 4.0), (None, 0, 5.0), (1, 2, 6.0)], "a long, b long, v double")
    t = frames.from_dataframe(df, ["a", "b"], "v", (2, 3), check=False)
    assert [r["v"] for r in t.row_major().collect()] == [0, 2, 0, 0, 0, 6]


@pytest.mark.parametrize("name", ["p11_ne_scalar", "p12_gt_scalar", "p13_ge_scalar", "p14_lt_scalar", "p15_le_scalar"])
def test_predicates_of_the_grid_move_rows_and_not_cells(spark, name):
    from cellframe.plans import queries as Q
    from cellframe.plans import tables

    sf = "/root/testdata/sf0.01"
    df, q = Q.QUERIES[name](spark, sf), tables.quantity(spark, sf)
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    # The lines to their cells, the cells to their parts, a mark for each part of 4,096 cells or more.
    assert "Join" not in executed(df) and moved(spark, df) <= 2 * lines + -(-q.size // T.RUN)
    assert df.count() == q.size > 3 * lines
