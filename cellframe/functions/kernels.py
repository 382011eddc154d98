"""The few functions that Spark has no expression for, as Arrow-batched pandas UDFs on numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dtypes import DType, narrow, wide

_PAIR = T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])


def _frame(z: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"re": z.real, "im": z.imag})


def _out(pair: Column, d: DType) -> Column:
    return F.struct(pair["re"].cast(d.part.sql).alias("re"), pair["im"].cast(d.part.sql).alias("im"))


COMPLEX = {"ln": np.log, "asin": np.arcsin, "acos": np.arccos, "atan": np.arctan} | {n: getattr(np, n) for n in ("exp", "sin", "sinh", "cos", "cosh", "tan", "tanh")}


def complex_unary(name: str, v: Column, d: DType) -> Column:
    def run(re: pd.Series, im: pd.Series) -> pd.DataFrame:
        with np.errstate(all="ignore"):
            return _frame(COMPLEX[name](re.to_numpy(float) + 1j * im.to_numpy(float)))

    return _out(F.pandas_udf(run, _PAIR)(v["re"].cast("double"), v["im"].cast("double")), d)


_COMPLEX_BINARY = {"div": np.divide, "pow": np.power, "log": lambda a, b: np.log(a) / np.log(b)}


def complex_binary(name: str, a: Column, b: Column, d: DType) -> Column:
    def run(ar: pd.Series, ai: pd.Series, br: pd.Series, bi: pd.Series) -> pd.DataFrame:
        with np.errstate(all="ignore"):
            return _frame(_COMPLEX_BINARY[name](ar.to_numpy(float) + 1j * ai.to_numpy(float), br.to_numpy(float) + 1j * bi.to_numpy(float)))

    return _out(F.pandas_udf(run, _PAIR)(*(x.cast("double") for x in (a["re"], a["im"], b["re"], b["im"]))), d)


def wrapping_power(base: np.ndarray, exponent: np.ndarray, signed: bool) -> np.ndarray:
    """64-bit powers by repeated squaring; negative exponents leave only the bases 1 and -1."""
    out, b, e = np.ones(len(base), np.uint64), base.astype(np.uint64), exponent.astype(np.uint64)
    while e.any():
        out = np.where(e & np.uint64(1), out * b, out)
        b, e = b * b, e >> np.uint64(1)
    out = out.view(np.int64)
    if signed:
        odd = np.where(exponent & 1, -1, 1)
        out = np.where(exponent >= 0, out, np.where(base == 1, 1, np.where(base == -1, odd, 0)))
    return out


def int_pow(a: Column, b: Column, d: DType) -> Column:
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(wrapping_power(x.to_numpy(np.int64), y.to_numpy(np.int64), d.kind == "i"))

    return narrow(F.pandas_udf(run, "bigint")(wide(a, d), wide(b, d)), d)


def wrapping_product(df, keys: list[str], v: str, d: DType):
    """Product of ``v`` modulo 2**64 by keys: within each Arrow batch first, then of the batches' products."""
    import pyarrow as pa

    names = [*keys, v]

    def part(batches):
        for batch in batches:
            frame = batch.to_pandas()
            if len(frame):
                yield pa.RecordBatch.from_pandas(_products(frame, keys, v), preserve_index=False)

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        return _products(frame, keys, v)

    shape = T.StructType([T.StructField(k, T.LongType()) for k in keys] + [T.StructField(v, T.LongType())])
    some = df.select(*keys, wide(F.col(v), d).alias(v)).mapInArrow(part, shape)
    out = some.groupBy(*keys).applyInPandas(whole, shape)
    return out.select(*keys, narrow(F.col(v), d).alias(v)).select(*names)


def _products(frame: pd.DataFrame, keys: list[str], v: str) -> pd.DataFrame:
    order = frame.sort_values(keys) if keys else frame
    values = order[v].to_numpy(np.int64)
    if keys:
        k = order[keys].to_numpy(np.int64)
        new = np.concatenate([[True], (k[1:] != k[:-1]).any(1)])
    else:
        new = np.arange(len(values)) == 0
    first = np.flatnonzero(new)
    out = order.iloc[first][keys].copy() if keys else pd.DataFrame(index=range(1))
    with np.errstate(over="ignore"):
        out[v] = np.multiply.reduceat(values, first)
    return out.reset_index(drop=True)




def complex_product(df, keys: list[str], v: str, d: DType):
    """Product of complex numbers by keys: within each Arrow batch first, then of the batches' products."""
    import pyarrow as pa

    shape = T.StructType([T.StructField(k, T.LongType()) for k in keys] + [T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        z = frame["re"].to_numpy(float) + 1j * frame["im"].to_numpy(float)
        if not keys:
            return _frame(np.array([np.multiply.reduce(z)]))
        at, of = pd.MultiIndex.from_frame(frame[keys]).factorize()[::-1]
        order = np.argsort(of, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(of[order]) > 0]))
        out = at.to_frame(index=False)
        out.columns = keys
        return pd.concat([out, _frame(np.multiply.reduceat(z[order], first))], axis=1)

    def part(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pandas(whole(batch.to_pandas()), preserve_index=False)

    some = df.select(*keys, F.col(f"{v}.re").cast("double").alias("re"), F.col(f"{v}.im").cast("double").alias("im")).mapInArrow(part, shape)
    out = some.groupBy(*keys).applyInPandas(whole, shape)
    return out.select(*keys, F.struct(F.col("re").cast(d.part.sql).alias("re"), F.col("im").cast(d.part.sql).alias("im")).alias(v))
