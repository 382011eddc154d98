"""Sums of the products of one run of outer coordinates, in one task: cells come as Arrow arrays, sums go as such."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return pc.list_flatten(batch.column(name)).to_numpy(zero_copy_only=False)


def _sum(at: np.ndarray, size: int, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The different numbers of ``at`` (below ``size``) in order, and the sums of each column's values there. By an
    array of all numbers where they are near each other, else by a sort."""
    if size <= 4 * at.size:
        seen = np.zeros(size, bool)
        seen[at] = True
        found, sums = np.flatnonzero(seen), []
        for v in values:
            if v.dtype == np.float64:
                z = np.bincount(at, v, size)
            else:
                z = np.zeros(size, v.dtype)
                np.add.at(z, at, v)
            sums.append(z[found])
        return found, sums
    order = np.argsort(at)
    at = at[order]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return at[first], [np.add.reduceat(v[order], first) for v in values]


def _cells(o: np.ndarray, j: np.ndarray, values: list[np.ndarray], row: int, names: list[str]) -> pa.RecordBatch:
    """Rows of arrays: one for each outer coordinate, and so many cells at most."""
    cuts = (o[1:] != o[:-1]) | (np.arange(1, o.size) % row == 0)
    begins = np.concatenate(([0], np.flatnonzero(cuts) + 1)) if o.size else np.zeros(0, np.int64)
    offsets = pa.array(np.append(begins, o.size).astype(np.int32))
    lists = (pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (j, *values))
    return pa.RecordBatch.from_arrays([pa.array(o[begins]), *lists], names=names)


def _values(batch: pa.RecordBatch, name: str, sizes: np.ndarray) -> np.ndarray:
    """The right side's values: bytes of the rows that have some in ``small``, else those of ``name``."""
    if "small" not in batch.schema.names:
        return _flat(batch, name)
    here = pc.list_value_length(batch.column("small")).to_numpy(zero_copy_only=False) > 0
    if here.all() or not here.any():
        return _flat(batch, "small" if here.all() else name)
    rest, here = _flat(batch, name), np.repeat(here, sizes)
    out = np.empty(here.size, rest.dtype)
    out[here], out[~here] = _flat(batch, "small"), rest
    return out


def sums(batches: Iterator[pa.RecordBatch], parts: list[str], names: list[str], most: int, row: int, shift: int = 0, half: bool = False) -> Iterator[pa.RecordBatch]:
    """``batches`` have a row for each inner coordinate: the left side's cells (``os``, ``x`` and a part's name), the right
    side's (``js``, ``y`` and a part's name), and whether it is one of marks. Cells of the left side are taken in the order
    of their outer coordinates, about ``most`` products at a time; the sums of a coordinate that goes on are kept. So the
    cells of the run are held, and never its products. With ``missed`` among the ``names``, marks less the values that met
    them come along, for sums that are added up once more; without, cells with some left are NaN. ``shift`` is added to
    ``js``. ``half``: the cells from the diagonal on, and once more without it as those to be turned (``swap``)."""
    lefts, rights, sizes, marks, rows = [], [], [], [], 0
    for b in batches:
        b = b.filter(pc.greater(pc.list_value_length(b.column("js")), 0)) if half else b
        if b.num_rows:
            n, m = (pc.list_value_length(b.column(c)).to_numpy(zero_copy_only=False) for c in ("os", "js"))
            lefts.append((_flat(b, "os"), np.repeat(np.arange(rows, rows + b.num_rows), n), *(_flat(b, f"x{p}") for p in parts)))
            rights.append((_flat(b, "js"), *(_values(b, f"y{p}", m) for p in parts)))
            sizes.append(m)
            marks.append(b.column("mark").to_numpy(zero_copy_only=False))
            rows += b.num_rows
    if not rows:
        return
    (o, at, *x), (j, *y) = ([np.concatenate(c) for c in zip(*side)] for side in (lefts, rights))
    size, mark = np.concatenate(sizes).astype(np.int64), np.concatenate(marks)
    del lefts, rights
    order = np.argsort(o, kind="stable")
    o, at, x = o[order], at[order], [v[order] for v in x]
    n, begin = size[at], (np.cumsum(size) - size)[at]
    ends = np.cumsum(n)
    # Where all of a sum meet, there is nothing to count unless marks have met; else the marks may be in another task.
    partial = "missed" in names
    bad = [~np.logical_and.reduce([np.isfinite(v) for v in side]) for side in (x, y)] if partial or mark.any() else None
    marked = bool(mark.any()) or bad is not None and bool(bad[0].any() or bad[1].any())

    def done(held: int, pieces: list) -> tuple[np.ndarray, list[np.ndarray]]:
        js, *values = (np.concatenate(c) for c in zip(*pieces))
        low = js.min()
        js, values = _sum(js - low, int(js.max() - low) + 1, values)
        return js + low, values

    def shown(o: np.ndarray, j: np.ndarray, values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if marked and not partial:
            *values, missed = values
            values = [np.where(missed > 0, np.nan, v) for v in values]
        elif partial and not marked:
            values = [*values, np.zeros(o.size, np.int64)]
        if not half:
            yield _cells(o, j, values, row, names)
            return
        for swap, kept in ((False, j >= o), (True, j > o)):
            kept = np.flatnonzero(kept)
            cells = _cells(o[kept], j[kept], [v[kept] for v in values], row, names)
            yield cells.append_column("swap", pa.array(np.full(cells.num_rows, swap)))

    held, pieces, room, start = None, [], 4 * most, 0
    while start < o.size:
        before = ends[start] - n[start]
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        part, count = slice(start, stop), n[start:stop]
        other = np.arange(ends[stop - 1] - before) + np.repeat(begin[part] - (ends[part] - count - before), count)
        outer, met = o[part], j[other].astype(np.int64) + shift
        xs, ys = [np.repeat(v[part], count) for v in x], [v[other] for v in y]
        with np.errstate(all="ignore"):
            values = [xs[0] * ys[0]] if len(parts) == 1 else [xs[0] * ys[0] - xs[1] * ys[1], xs[0] * ys[1] + xs[1] * ys[0]]
            if marked:
                is_mark = np.repeat(mark[at[part]], count)
                missed = np.where(is_mark, 1, -(np.repeat(bad[0][part], count).astype(np.int64) + bad[1][other]))
                values = [*(np.where(is_mark, 0, v) for v in values), missed]
            rank = np.concatenate(([0], np.cumsum(outer[1:] != outer[:-1])))
            low = int(met.min())
            width = int(met.max()) - low + 1
            found, values = _sum(np.repeat(rank * width - low, count) + met, (int(rank[-1]) + 1) * width, values)
        fo = outer[np.flatnonzero(np.concatenate(([True], outer[1:] != outer[:-1])))][found // width]
        fj = found % width + low
        goes_on = stop < o.size and o[stop] == o[stop - 1]
        head = int(np.searchsorted(fo, held, "right")) if held is not None else 0
        tail = int(np.searchsorted(fo, o[stop - 1])) if goes_on else fo.size
        if held is not None:
            pieces.append((fj[:head], *(v[:head] for v in values)))
            if not goes_on or held != o[stop - 1]:
                js, kept = done(held, pieces)
                yield from shown(np.full(js.size, held), js, kept)
                held = None
            elif sum(p[0].size for p in pieces) > room:
                js, kept = done(held, pieces)
                pieces, room = [(js, *kept)], 2 * js.size + 4 * most
        if head < tail:
            yield from shown(fo[head:tail], fj[head:tail], [v[head:tail] for v in values])
        if goes_on and held is None:
            held, pieces, room = o[stop - 1], [(fj[tail:], *(v[tail:] for v in values))], 4 * most
        start = stop
