"""Unnormalised discrete Fourier transforms of complex tensors along their last axes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..errors import InvalidSchema, Unsupported
from ..functions import dtypes as D
from ..rows import Packed, RowTensor
from ..tensor import Tensor, axes

#: Longest axis. Fixed value.
LONGEST = 4096


def _transform(t: Tensor, inverse: bool) -> Tensor:
    """Along the last axis. Vectors come as arrays, those of an Arrow batch are transformed by one call; tensors that lie
    in arrays already need no shuffle, others are packed by one."""
    if t.dtype.kind != "c":
        raise Unsupported(f"fft of {t.dtype.name}")
    n, r = t.shape[-1], t.ndim
    if n > LONGEST:
        raise Unsupported(f"fft over an axis of {n}; at most {LONGEST}")
    keys = axes(r - 1)
    double = [lambda v: v["re"].cast("double"), lambda v: v["im"].cast("double")]
    if isinstance(t, RowTensor):
        at = F.sequence(F.lit(0), F.lit(n - 1))
        rows = t.packed.frame.select(*keys, at.alias("at"), *(x.alias(p) for x, p in zip(t.arrays(*double), ("re", "im"))))
    else:
        # At most n values for each vector.
        cells = F.collect_list(F.struct(F.col(f"c{r - 1}").cast("int").alias("at"), *(f(F.col("v")).alias(p) for f, p in zip(double, ("re", "im")))))
        rows = t.df.groupBy(*keys).agg(cells.alias("x")).select(*keys, "x.at", "x.re", "x.im")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, re, im = (batch.column(i) for i in range(len(keys), len(keys) + 3))
            vector = np.repeat(np.arange(len(batch)), np.diff(np.asarray(at.offsets)))
            z = np.zeros((len(batch), n), complex)
            z[vector, np.asarray(at.flatten())] = np.asarray(re.flatten()) + 1j * np.asarray(im.flatten())
            z = np.fft.ifft(z, axis=1) * n if inverse else np.fft.fft(z, axis=1)
            offsets = pa.array(np.arange(0, z.size + 1, n), pa.int32())
            out = [pa.ListArray.from_arrays(offsets, pa.array(part.ravel())) for part in (z.real, z.imag)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *out], [*keys, "re", "im"])

    schema = ", ".join([*(f"{c} long" for c in keys), "re array<double>", "im array<double>"])
    out = Packed(rows.mapInArrow(run, schema), ["re", "im"], r)
    # Vectors without any value transform to zeros, which a sparse result leaves out.
    found = RowTensor(out, lambda re, im: D.make(re, im, t.dtype), t.shape, t.dtype)
    return t.like(found.frame, found.value) if t.sparse else found


def fft(t: Tensor) -> Tensor:
    return _transform(t, False)


def ifft(t: Tensor) -> Tensor:
    """The inverse times the axis length."""
    return _transform(t, True)


def _two(t: Tensor, inverse: bool) -> Tensor:
    if t.ndim < 2:
        raise InvalidSchema("a transform over two axes needs two axes")
    if t.shape[-2] > LONGEST:
        raise Unsupported(f"fft over an axis of {t.shape[-2]}; at most {LONGEST}")
    swap = [*range(t.ndim - 2), t.ndim - 1, t.ndim - 2]
    return _transform(_transform(t, inverse).transpose(swap), inverse).transpose(swap)


def fft2(t: Tensor) -> Tensor:
    return _two(t, False)


def ifft2(t: Tensor) -> Tensor:
    return _two(t, True)


def dft_join(t: Tensor, inverse: bool = False) -> Tensor:
    """The transform as a join with a table of twiddle factors: all in the JVM, for short axes."""
    n, r = t.shape[-1], t.ndim
    if t.dtype.kind != "c" or n > LONGEST:
        raise Unsupported(f"fft of {t.dtype.name} over {n}")
    keys = [f"c{i}" for i in range(r - 1)]
    angle = (2.0 if inverse else -2.0) * np.pi / n
    turn = F.col(f"c{r - 1}") * F.col("f") % n * F.lit(angle)
    rows = t.df.crossJoin(F.broadcast(t.spark.range(n).select(F.col("id").alias("f"))))
    re, im = F.col("v.re").cast("double"), F.col("v.im").cast("double")
    out = rows.groupBy(*keys, "f").agg(F.sum(re * F.cos(turn) - im * F.sin(turn)).alias("re"), F.sum(re * F.sin(turn) + im * F.cos(turn)).alias("im"))
    kind = t.dtype.part.sql
    v = F.struct(F.col("re").cast(kind).alias("re"), F.col("im").cast(kind).alias("im"))
    return t.like(out.select(*keys, F.col("f").alias(f"c{r - 1}"), v.alias("v")))


Tensor.fft, Tensor.ifft, Tensor.fft2, Tensor.ifft2 = fft, ifft, fft2, ifft2
