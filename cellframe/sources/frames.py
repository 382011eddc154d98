"""Tensors from DataFrames, values and constants."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import geometry as G
from ..errors import DataMismatch, InvalidCoord, InvalidSchema, SparseIndex
from ..functions import dtypes as D
from ..tensor import Tensor, axes, from_flat, grid


def from_dataframe(df: DataFrame, axis_columns: list[str], value: str, shape, dtype="f64", sparse: bool = True, axis: int | None = None, check: bool = True) -> Tensor:
    """Any frame with integer axis columns. ``check`` runs a job: coordinates lie in the shape and occur once."""
    shape, d = G.check_shape(shape), D.dtype(dtype)
    if len(axis_columns) != len(shape):
        raise InvalidSchema(f"{len(axis_columns)} axis columns for {shape}")
    frame = df.select(*(F.col(c).cast("long").alias(f"c{i}") for i, c in enumerate(axis_columns)), F.col(value).cast(d.sql).alias("v"))
    out = Tensor(frame, "v", shape, d, sparse, axis)
    if check:
        check_cells(out)
    return out


def check_cells(t: Tensor) -> None:
    out_of = F.lit(False)
    for i, n in enumerate(t.shape):
        out_of = out_of | F.col(f"c{i}").isNull() | ~F.col(f"c{i}").between(0, n - 1)
    df = t.df
    if not df.where(out_of).isEmpty():
        raise InvalidCoord(f"coordinates outside {t.shape}")
    if not df.groupBy(*t.axes).count().where("count > 1").isEmpty():
        raise SparseIndex("coordinates that occur twice")
    if not t.sparse and df.count() != t.size:
        raise DataMismatch(f"a dense tensor of {t.shape} needs {t.size} values")


def create(spark: SparkSession, shape, dtype="f64", sparse: bool = False, axis: int | None = None) -> Tensor:
    """All zeros."""
    shape, d = G.check_shape(shape), D.dtype(dtype)
    if axis is not None:
        G.check_axis(shape, axis)
    if sparse:
        return Tensor(grid(spark, shape).withColumn("v", D.zero(d)).where(F.lit(False)), "v", shape, d, sparse, axis)
    return _constant(spark, D.zero(d), shape, d, axis)


def _constant(spark: SparkSession, value: Column, shape, d: D.DType, axis: int | None) -> Tensor:
    out = Tensor(grid(spark, shape), value, shape, d, axis=axis)
    out.constant = True
    return out


def fill(t: Tensor, value) -> Tensor:
    """Every cell the same."""
    out = create(t.spark, t.shape, t.dtype, t.sparse, t.axis)
    v = D.literal(value, t.dtype)
    if not t.sparse:
        return _constant(t.spark, v, t.shape, t.dtype, t.axis)
    return Tensor(out.frame if t.sparse and value == 0 else t.grid().withColumn("v", v), "v", t.shape, t.dtype, t.sparse, t.axis)


def _sql_value(v, d: D.DType):
    import decimal

    if d.kind == "c":
        z = complex(v)
        return {"re": float(z.real), "im": float(z.imag)}
    if d.name == "u64":
        return decimal.Decimal(D.wrap_int(int(v), d))
    return D.wrap_int(int(v), d) if d.integer else float(v)


def from_values(spark: SparkSession, shape, values: Iterable, dtype="f64", sparse: bool = False, axis: int | None = None) -> Tensor:
    """One value for each cell, row-major."""
    shape, d = G.check_shape(shape), D.dtype(dtype)
    rows = [(i, _sql_value(v, d)) for i, v in enumerate(values)]
    if len(rows) != G.size(shape):
        raise DataMismatch(f"{len(rows)} values for {G.size(shape)} cells")
    flat = spark.createDataFrame(rows, f"flat long, v {d.sql}")
    frame = flat.select(*(c.alias(f"c{i}") for i, c in enumerate(from_flat(F.col("flat"), shape))), "v")
    return Tensor(frame.where(D.not_zero(F.col("v"), d)) if sparse else frame, "v", shape, d, sparse, axis)


def from_sparse_elements(spark: SparkSession, shape, elements: Iterable, dtype="f64", axis: int | None = None) -> Tensor:
    """(coordinate, value) pairs in strictly rising row-major order; zeros are dropped."""
    shape, d = G.check_shape(shape), D.dtype(dtype)
    rows, last = [], None
    for coord, v in elements:
        coord = G.check_coord(shape, coord)
        if last is not None and coord <= last:
            raise SparseIndex(f"{coord} after {last}")
        last = coord
        rows.append((*coord, _sql_value(v, d)))
    schema = ", ".join([*(f"{c} long" for c in axes(len(shape))), f"v {d.sql}"])
    frame = spark.createDataFrame(rows, schema).where(D.not_zero(F.col("v"), d))
    return Tensor(frame, "v", shape, d, True, axis)
