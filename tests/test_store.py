"""Updates in the files of stored tensors, and their ordered reads."""

import re

import numpy as np
import pytest

from cellframe.errors import DataMismatch
from cellframe.geometry import At, In, Of
from cellframe.sources import frames, store
from cellframe.streaming import batches


def dense(spark, tmp_path, name="t", shape=(6, 8), **kw):
    values = np.arange(np.prod(shape)).reshape(shape) + 1.0
    return store.write(frames.from_values(spark, shape, values.ravel()), f"file://{tmp_path}/{name}", 4, band_blocks=2, **kw), values


def files(tmp_path, name="t"):
    return {str(p.relative_to(tmp_path)): p.stat().st_mtime_ns for p in (tmp_path / name).rglob("*.parquet")}


def test_an_update_writes_its_bands_only(spark, tmp_path):
    t, values = dense(spark, tmp_path)
    before = files(tmp_path)
    u = t.write_values([Of(5, 1, 5), At(2)], [3.0, 4.0, 7.0])
    values[5, 2], values[1, 2] = 7, 4
    assert (u.to_numpy() == values).all() and (store.load(spark, t.path).to_numpy() == values).all()
    after = files(tmp_path)
    assert {k: after[k] for k in before} == before  # nothing that was there is touched
    new = {k.split("/")[2] for k in set(after) - set(before)}
    assert new == {f"band={store._band_of(t, c)}" for c in ((5, 2), (1, 2))} and all(k.split("/")[1] == "v=1" for k in set(after) - set(before))
    u.validate()
    # What was opened before keeps its cells, and does not write over later ones.
    assert t.read_value((5, 2)) == 43
    with pytest.raises(DataMismatch):
        t.write_value((0, 0), 1.0)
    w = u.write_value((5, 3), -1.0).replace_block(0, [9.0] * 4)
    values[5, 3], values[0, :4] = -1, 9
    assert (w.to_numpy() == values).all() and w.meta["version"] == 3
    w.vacuum()
    assert (store.load(spark, t.path).to_numpy() == values).all()
    assert sorted(k.split("/")[2] for k in {k.rsplit("/", 1)[0] for k in files(tmp_path)}) == [f"band={b}" for b in w.stored_bands()]


def test_updates_through_views_and_of_sparse_tensors(spark, tmp_path):
    t, values = dense(spark, tmp_path)
    steps = [("flip", (1,)), ("slice", (In(0, 6, 2),))]
    u = t.write_through(steps, frames.from_values(spark, (3, 8), np.arange(24.0)))
    values[::2, ::-1] = np.arange(24.0).reshape(3, 8)
    assert (u.to_numpy() == values).all()
    s = store.write(frames.from_sparse_elements(spark, (4, 5), [((0, 1), 2.0), ((3, 3), 4.0)]), f"file://{tmp_path}/s", 1, band_blocks=5)
    assert s.stored_bands() == [0, 3]
    s = s.write_values([At(3)], [0.0] * 5).write_value((2, 2), 8.0)
    assert s.stored_bands() == [0, 2] and sorted(map(tuple, s.rows().collect())) == [(0, 1, 2.0), (2, 2, 8.0)]
    s.validate()
    assert store.load(spark, s.path).update(s.df.where("v > 100")).meta["version"] == s.meta["version"]


@pytest.mark.parametrize("kind", store.FORMATS)
def test_every_format_is_updated(spark, tmp_path, kind):
    t, values = dense(spark, tmp_path, kind, kind=kind)
    values[2, 2] = 5
    assert (t.write_value((2, 2), 5.0).to_numpy() == values).all()


def test_stored_tensors_are_read_in_order_without_a_shuffle(spark, tmp_path):
    t, values = dense(spark, tmp_path)
    frames_ = list(t.in_order())
    assert len(frames_) == 6 and not any("Exchange" in f._jdf.queryExecution().executedPlan().toString() for f in frames_)
    assert [v for b in batches.read_blocks(t) for v in b] == values.ravel().tolist()
    s = store.copy_from_values(frames.from_values(spark, (6, 8), [v if v % 5 == 0 else 0 for v in range(48)]), f"file://{tmp_path}/s", sparse=True, axis=0)
    assert [v for b in batches.read_blocks(s) for v in b] == [v if v % 5 == 0 else 0 for v in range(48)]
    found = [x for b in batches.read_sparse_elements_in_order(s, [Of(4, 2, 4), In(1, 8)]) for x in b]
    assert found == [((i, j), 8.0 * i + j) for i in (2, 4) for j in range(1, 8) if (8 * i + j) % 5 == 0]
    plan = batches.sparse_elements_frame(s, [In(2, 4)])._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"block#\d+L? >= ", plan) and re.search(r"block#\d+L? <= ", plan)


def test_bands_are_bounded_and_values_are_kept(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MOST_BANDS", 5)
    cells = [((i, (7 * i) % 40), 1.0 + i) for i in range(60)]
    s = store.write(frames.from_sparse_elements(spark, (60, 40), cells), f"file://{tmp_path}/s", band_blocks=3)
    assert s.meta["band_blocks"] == 480 and s.stored_bands() == [0, 1, 2, 3, 4]
    s = s.write_value((2, 3), 77.0)
    assert len(s.meta["bands"]) == 1
    assert sorted(map(tuple, store.load(spark, s.path).rows().collect())) == sorted([(*c, v) for c, v in cells] + [(2, 3, 77.0)])
    s.validate()


@pytest.mark.parametrize("most", [1, 16])
def test_filled_cells_are_written_without_a_shuffle_of_cells(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(store, "OPEN_BANDS", most)
    monkeypatch.setattr(store, "BAND_CELLS", 256)
    seen = []
    monkeypatch.setattr(store, "_save", lambda out, *a, save=store._save: (seen.append(out._jdf.queryExecution().executedPlan().toString()), save(out, *a)))
    x = np.zeros((60, 40))
    x[::7, 3] = 4
    t = frames.from_sparse_elements(spark, x.shape, [(tuple(map(int, c)), 4.0) for c in np.argwhere(x)])
    s = store.copy_from_values(t, f"file://{tmp_path}/s", capacity=64)
    assert (s.to_numpy() == x).all() and not s.sparse and len(s.stored_bands()) == 10
    s.validate()
    assert [v for b in batches.read_blocks(s) for v in b] == x.ravel().tolist()
    assert len(seen) == 1 and "Join" not in seen[0] and seen[0].count("rangepartitioning") == 1 and seen[0].count("Sort [") == 1
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
