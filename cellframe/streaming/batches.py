"""Reading in bounded batches: partitions come to the driver one at a time, each batch has at most 4096 values.

A stored tensor is read in order by its blocks, some at a time, without a shuffle; other expressions are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .. import geometry as G
from ..errors import InvalidSchema, UnsupportedSparseIterationOrder
from ..functions import dtypes as D
from ..sources.store import Stored, blocks_of
from ..tensor import Tensor, python_value, require_sparse


def _rows(frames: Iterator[DataFrame]) -> Iterator[Row]:
    for df in frames:
        yield from df.toLocalIterator(prefetchPartitions=True)


def _batches(rows, size: int = G.BATCH) -> Iterator[list]:
    held: list = []
    for row in rows.toLocalIterator(prefetchPartitions=True) if isinstance(rows, DataFrame) else rows:
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def _streamable(t: Tensor) -> None:
    if t.ndim == 0:
        raise InvalidSchema("a tensor without axes has one value, read by read_value(())")


def read_blocks(t: Tensor) -> Iterator[list]:
    """All values, zeros too, row-major."""
    _streamable(t)
    if isinstance(t, Stored):
        yield from _batches(_filled(t))
        return
    for rows in _batches(t.row_major()):
        yield [python_value(r["v"], t.dtype) for r in rows]


def _filled(t: Stored) -> Iterator:
    """Every value of a stored tensor, row-major; zeros between the stored ones are made here."""
    at = 0
    for row in _rows(t.in_order()):
        flat = G.flat_index(t.shape, [row[c] for c in t.axes])
        while at < flat:
            yield t._zero
            at += 1
        yield python_value(row["v"], t.dtype)
        at += 1
    while at < t.size:
        yield t._zero
        at += 1


def read_coordinate_blocks(t: Tensor) -> Iterator[list[tuple]]:
    """(coordinate, value) of every cell once, in no given order."""
    _streamable(t)
    for rows in _batches(t.full()):
        yield [(tuple(r[:-1]), python_value(r["v"], t.dtype)) for r in rows]


def sparse_elements_frame(t: Tensor, ranges=(), order=None) -> DataFrame:
    """Rows other than zero of a selection, row-major; indices of ``Of`` are sorted and count once."""
    rows = t.frame.select(*t.axes, "v", "block") if isinstance(t, Stored) else t.df
    return _selected(t, rows, ranges, order).select(*t.axes, "v").orderBy(*t.axes)


def _selected(t: Tensor, rows: DataFrame, ranges, order) -> DataFrame:
    require_sparse(t, "read_sparse_elements_in_order")
    if order is not None and list(order) != list(range(t.ndim)):
        raise UnsupportedSparseIterationOrder(f"order {list(order)}; only {list(range(t.ndim))}: transpose and copy first")
    ranges = list(ranges) + [G.In(0, n) for n in t.shape[len(ranges) :]]
    rows = rows.where(D.not_zero(F.col("v"), t.dtype))
    if isinstance(t, Stored) and not any(isinstance(r, G.In) and r.start >= r.stop for r in ranges):
        # The blocks' statistics in the files leave out those before and after the selection.
        rows = rows.where(F.col("block").between(*blocks_of(t.geometry, G.check_range(t.shape, ranges)))) if "block" in rows.columns else rows
    for i, r in enumerate(ranges):
        c = F.col(f"c{i}")
        if isinstance(r, G.In) and r.start >= r.stop:
            rows = rows.where(F.lit(False))
            continue
        r = G.check_range(t.shape[i : i + 1], [r])[0]
        if isinstance(r, G.At):
            rows = rows.where(c == r.index)
        elif isinstance(r, G.Of):
            rows = rows.where(c.isin(sorted(set(r.indices))))
        else:
            rows = rows.where(c.between(r.start, r.stop - 1) & ((c - r.start) % r.step == 0))
    return rows


def read_sparse_elements_in_order(t: Tensor, ranges=(), order=None) -> Iterator[list[tuple]]:
    if isinstance(t, Stored):
        frames = (_selected(t, f, ranges, order).select(*t.axes, "v") for f in t.in_order())
        found = _batches(_rows(frames))
    else:
        found = _batches(sparse_elements_frame(t, ranges, order))
    for rows in found:
        yield [(tuple(r[:-1]), python_value(r["v"], t.dtype)) for r in rows]


def into_blocks(t: Tensor) -> Iterator[list]:
    """``read_blocks``; tensors are immutable, so there is no owned form of its own."""
    return read_blocks(t)


def into_sparse_elements(t: Tensor, ranges=(), order=None) -> Iterator[list[tuple]]:
    return read_sparse_elements_in_order(t, ranges, order)
