"""Dense tensors whose last axis lies in arrays: one row for each vector.

Elementwise operations over the same rows compose one expression, which is applied to cells (after one explode, within
generated code) or to whole arrays, as what reads them needs. Tensors over different rows meet by a join of rows, with
one row for each vector instead of one for each cell. Transforms along the last axis read whole Arrow batches of
vectors and need no shuffle. All else works on the cells, which are a view.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import geometry as G
from .errors import InvalidSchema
from .functions import dtypes as D
from .functions import kernels
from .functions import scalar as S
from .tensor import Tensor, axes


class Packed:
    """Rows with the axis columns before the last, and arrays of equal lengths under ``names``."""

    def __init__(self, frame: DataFrame, names: list[str], n_axes: int):
        self.frame, self.names, self.n_axes = frame, names, n_axes
        self._cells = None

    @property
    def keys(self) -> list[str]:
        return axes(self.n_axes - 1)

    @property
    def cells(self) -> DataFrame:
        """One frame for all tensors over these rows, so that they combine without a join."""
        if self._cells is None:
            last = f"c{self.n_axes - 1}"
            zipped = F.posexplode(F.arrays_zip(*self.names)) if len(self.names) > 1 else F.posexplode(self.names[0])
            out = self.frame.select(*self.keys, zipped.alias(last, "_cell"))
            fields = [F.col(f"_cell.{n}").alias(n) for n in self.names] if len(self.names) > 1 else [F.col("_cell").alias(self.names[0])]
            self._cells = out.select(*self.keys, F.col(last).cast("long").alias(last), *fields)
        return self._cells


class RowTensor(Tensor):
    """``of``: the value of a cell, from the columns of its entries in the packed arrays."""

    def __init__(self, packed: Packed, of: Callable[..., Column], shape, dtype):
        super().__init__(packed.cells, of(*map(F.col, packed.names)), shape, dtype, False)
        self.packed, self.of = packed, of

    def _new(self, of: Callable[..., Column], dtype) -> "RowTensor":
        out = RowTensor(self.packed, of, self.shape, dtype)
        out.writable = False
        return out

    def arrays(self, *parts: Callable[[Column], Column]) -> list[Column]:
        """Array columns of functions of the values, over the packed rows."""
        names = self.packed.names

        def one(part: Callable[[Column], Column]) -> Column:
            if len(names) == 1:
                return F.transform(names[0], lambda x: part(self.of(x)))
            return F.transform(F.arrays_zip(*names), lambda z: part(self.of(*(z[n] for n in names))))

        return [one(p) for p in parts]

    # Elementwise operations compose ``of``; the checks are the tensor's.

    def map(self, f: Callable[[Column], Column], dtype) -> "RowTensor":
        """Any expression of the values."""
        return self._new(lambda *v: f(self.of(*v)), D.dtype(dtype))

    def _in_python(self, name: str) -> bool:
        """Functions with a kernel in Python work on columns of cells, not within arrays."""
        return name in ("pow",) and self.dtype.kind != "f" or name in ("div", "log") and self.dtype.kind == "c"

    def unary(self, name: str) -> Tensor:
        f = S.UNARY[name]
        if self.dtype.kind not in f.on or self.dtype.kind == "c" and name in kernels.COMPLEX:
            return super().unary(name)
        return self._new(lambda *v: f.column(self.of(*v), self.dtype), f.out(self.dtype))

    def cast(self, target) -> Tensor:
        target = D.dtype(target)
        return self._new(lambda *v: D.cast(self.of(*v), self.dtype, target), target)

    def scalar(self, name: str, value) -> Tensor:
        f = S.BINARY[name]
        if self._in_python(name) or self.dtype.kind not in f.on:
            return super().scalar(name, value)
        if self.dtype.integer:
            value = D.wrap_int(int(value), self.dtype)
        return self._new(lambda *v: f.column(self.of(*v), D.literal(value, self.dtype), self.dtype), f.out(self.dtype))

    def binary(self, name: str, other: Tensor) -> Tensor:
        f = S.BINARY[name]
        if not isinstance(other, RowTensor) or other.shape != self.shape or other.dtype != self.dtype or self._in_python(name) or self.dtype.kind not in f.on:
            return super().binary(name, other)
        packed, (a, b) = met([self, other])
        return RowTensor(packed, lambda *v: f.column(a(v), b(v), self.dtype), self.shape, f.out(self.dtype))

    def cond(self, then: Tensor, other: Tensor) -> Tensor:
        parts = [self, then, other]
        if self.dtype.name != "u8" or any(not isinstance(t, RowTensor) or t.shape != self.shape for t in parts) or then.dtype != other.dtype:
            return super().cond(then, other)
        packed, (c, a, b) = met(parts)
        return RowTensor(packed, lambda *v: F.when(c(v) != 0, a(v)).otherwise(b(v)), self.shape, then.dtype)

    # Transforms of the axes before the last keep the rows.

    def _rows(self, frame: DataFrame, columns: list[Column], shape, strides, writable: bool) -> "RowTensor":
        frame = frame.select(*(c.alias(f"c{i}") for i, c in enumerate(columns)), *self.packed.names)
        out = RowTensor(Packed(frame, self.packed.names, len(columns) + 1), self.of, tuple(shape), self.dtype)
        out.strides, out.writable = tuple(strides), writable
        return out

    def flip(self, axis: int) -> Tensor:
        G.check_axis(self.shape, axis)
        if axis == self.ndim - 1:
            return super().flip(axis)
        columns = [F.lit(n - 1) - F.col(c) if i == axis else F.col(c) for i, (c, n) in enumerate(zip(self.packed.keys, self.shape))]
        strides = [-s if i == axis and s is not None else s for i, s in enumerate(self.strides)]
        return self._rows(self.packed.frame, columns, self.shape, strides, self.writable)

    def slice(self, *ranges) -> Tensor:
        given = G.check_range(self.shape, ranges)
        n = self.ndim - 1
        whole = G.In(0, self.shape[n])
        if n == 0 or given[n] != whole or any(isinstance(r, G.Of) for r in given):
            return super().slice(*ranges)
        frame, columns, shape, strides = self.packed.frame, [], [], []
        for i, r in enumerate(given[:n]):
            c = F.col(f"c{i}")
            if isinstance(r, G.At):
                frame = frame.where(c == r.index)
                continue
            if (r.start, r.stop) != (0, self.shape[i]):
                frame = frame.where(c.between(r.start, r.stop - 1))
            if r.step > 1:
                frame = frame.where((c - r.start) % r.step == 0)
            columns.append(F.call_function("div", c - r.start, F.lit(r.step)) if r.step > 1 else c - r.start if r.start else c)
            shape.append(-(-(r.stop - r.start) // r.step))
            strides.append(None if self.strides[i] is None else self.strides[i] * r.step)
        return self._rows(frame, columns, [*shape, self.shape[n]], [*strides, self.strides[n]], self.writable)


def met(parts: list[RowTensor]) -> tuple[Packed, list[Callable]]:
    """Packed rows that have the arrays of all, and the value of each as a function of the entries. Tensors over the
    same rows need no join."""
    packs = list({id(t.packed): t.packed for t in parts}.values())
    if len(packs) == 1:
        return packs[0], [lambda v, t=t: t.of(*v) for t in parts]
    keys, frame, names, place = packs[0].keys, None, [], {}
    for k, p in enumerate(packs):
        renamed = [f"x{k}_{i}" for i in range(len(p.names))]
        side = p.frame.select(*keys, *(F.col(n).alias(r) for n, r in zip(p.names, renamed)))
        frame = side if frame is None else frame.join(side, keys) if keys else frame.crossJoin(side)
        place[id(p)] = (len(names), len(names) + len(renamed))
        names += renamed
    return Packed(frame, names, packs[0].n_axes), [lambda v, t=t: t.of(*v[slice(*place[id(t.packed)])]) for t in parts]


def from_arrays(df: DataFrame, axis_columns: list[str], array: str, shape, dtype="f64", check: bool = True) -> RowTensor:
    """A dense tensor of rows with the axes before the last and an array along it. ``check`` runs a job: coordinates lie
    in the shape and occur once, all of them, and every array is as long as the last axis and without nulls."""
    shape, d = G.check_shape(shape), D.dtype(dtype)
    if len(axis_columns) != len(shape) - 1:
        raise InvalidSchema(f"{len(axis_columns)} axis columns and an array for {shape}")
    frame = df.select(*(F.col(c).cast("long").alias(f"c{i}") for i, c in enumerate(axis_columns)), F.col(array).cast(f"array<{d.sql}>").alias("v"))
    out = RowTensor(Packed(frame, ["v"], len(shape)), lambda v: v, shape, d)
    if check:
        from .sources.frames import check_cells

        if not frame.where(F.col("v").isNull() | (F.size("v") != shape[-1]) | F.exists("v", lambda x: x.isNull())).isEmpty():
            raise InvalidSchema(f"arrays that are not {shape[-1]} values")
        keys = out.packed.keys
        if keys:
            check_cells(Tensor(frame.select(*keys, F.lit(1).alias("v")), "v", shape[:-1], "i32", False))
    return out
