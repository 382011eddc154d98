"""Reductions over axes or whole tensors. Absent cells of sparse tensors are zeros that count: their number in
a group is arithmetic on the group's size, so nothing is filled in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import geometry as G
from ..errors import InvalidSchema, Unsupported
from ..functions import dtypes as D
from ..functions import kernels
from ..functions.dtypes import DTYPES
from ..tensor import Tensor, python_value

#: Powers of two by which very large or small values are scaled before they are squared or summed.
DOWN, UP = 2.0**-600, 2.0**600
LARGE, SMALL = 1e150, 1e-150
INF, NAN = float("inf"), float("nan")

NAMES = ("sum", "product", "min", "max", "mean", "std", "norm")


def _sum_int(v: Column, d: D.DType) -> Column:
    if d.bits < 64:
        return D.narrow(F.coalesce(F.sum(D.wide(v, d)), F.lit(0).cast("long")), d)
    w = D.wide(v, d)
    low = F.coalesce(F.sum(w.bitwiseAND(F.lit(D.LOW))), F.lit(0).cast("long"))
    high = F.coalesce(F.sum(F.shiftright(w, 32)), F.lit(0).cast("long"))
    return D.narrow(D.add64(F.shiftleft(high, 32), low), d)


def _mean(x: Column, n: Column) -> Column:
    plain, scaled = F.coalesce(F.sum(x), F.lit(0.0)), F.coalesce(F.sum(x * 2.0**-100), F.lit(0.0))
    finite = F.coalesce(F.max(F.abs(x)) < INF, F.lit(True))
    return F.when(finite & (F.isnan(plain) | (F.abs(plain) == INF)), scaled / n * 2.0**100).otherwise(plain / n)


def _by_size(m: Column, plain: Column, down: Column, up: Column) -> Column:
    return F.when((m > LARGE) & (m < INF), down / DOWN).when((m < SMALL) & (m > 0), up / UP).otherwise(plain)


def _norm(parts: list[Column]) -> Column:
    def root(scale: float) -> Column:
        total = F.lit(0.0)
        for x in parts:
            total = total + F.coalesce(F.sum((x * scale) * (x * scale)), F.lit(0.0))
        return F.sqrt(total)

    m = F.coalesce(F.greatest(*(F.max(F.abs(x)) for x in parts), F.lit(0.0)), F.lit(0.0))
    return _by_size(m, root(1.0), root(DOWN), root(UP))


def _std(parts: list[Column], rows: Column, n: Column) -> Column:
    """Population deviation of the rows together with n - rows zeros: moments of the two sets combined."""

    def root(scale: float) -> Column:
        total = F.lit(0.0)
        for x in parts:
            moment = F.coalesce(F.var_pop(x * scale), F.lit(0.0)) * rows
            mean = F.coalesce(F.avg(x * scale), F.lit(0.0))
            total = total + moment + F.when(n > rows, mean * mean * rows * (n - rows) / n).otherwise(0.0)
        return F.sqrt(total / n)

    m = F.coalesce(F.greatest(*(F.max(F.abs(x)) for x in parts), F.lit(0.0)), F.lit(0.0))
    broken = F.lit(False)
    for x in parts:
        broken = broken | F.coalesce(F.bool_or(F.isnan(x) | (F.abs(x) == INF)), F.lit(False))
    return F.when(broken, NAN).otherwise(_by_size(m, root(1.0), root(DOWN), root(UP)))


def _least(name: str, v: Column, d: D.DType, gap: Column) -> Column:
    agg, pick = (F.min, F.least) if name == "min" else (F.max, F.greatest)
    m = agg(v)
    out = F.coalesce(F.when(gap > 0, pick(m, D.zero(d))).otherwise(m), D.zero(d))
    if d.kind == "f":
        out = F.when(F.coalesce(F.bool_or(F.isnan(v)), F.lit(False)), F.lit(NAN).cast(d.sql)).otherwise(out)
    return out


def reduce(t: Tensor, name: str, over=None, keepdims: bool = False) -> Tensor:
    """Reduce some axes; none of the shape's axes left makes shape (1,). ``over`` None: all axes."""
    if t.ndim == 0:
        raise InvalidSchema("a tensor without axes cannot be reduced")
    if name in ("min", "max") and not t.dtype.real:
        raise Unsupported(f"{name} of {t.dtype.name}")
    over = list(range(t.ndim)) if over is None else G.reduction_axes(t.shape, over)
    kept = [i for i in range(t.ndim) if i not in over]
    n = G.size([t.shape[i] for i in over])
    if name == "product":
        return _product(t, over, kept, n, keepdims)
    keys = [f"c{i}" for i in kept]
    value, out = _value(t, name, F.lit(n).cast("long"))
    grouped = t.df.groupBy(*keys).agg(value.alias("v")) if keys else t.df.agg(value.alias("v"))
    return _shaped(t, grouped, over, kept, keepdims, out)


def _value(t: Tensor, name: str, n: Column) -> tuple[Column, D.DType]:
    """The aggregate and its dtype, over groups of ``n`` cells of which some may be absent."""
    d, out = t.dtype, t.dtype
    rows, size = F.count(F.lit(1)), n.cast("double")
    gap = (n - rows) if t.sparse else F.lit(0)
    v = F.col("v")
    parts = [F.col("v.re").cast("double"), F.col("v.im").cast("double")] if d.kind == "c" else [D.cast(v, d, DTYPES["f64"]) if d.kind == "f" else v.cast("double")]
    if name == "sum":
        if d.integer:
            value = _sum_int(v, d)
        elif d.kind == "f":
            value = F.coalesce(F.sum(parts[0]), F.lit(0.0)).cast(d.sql)
        else:
            value = D.make(*(F.coalesce(F.sum(p), F.lit(0.0)) for p in parts), d)
    elif name == "product":
        p = F.coalesce(F.product(parts[0]), F.lit(1.0))
        value = F.when(rows < n, p * 0.0).otherwise(p).cast(d.sql)
    elif name in ("min", "max"):
        value = _least(name, v, d, gap)
    elif name == "mean":
        out = DTYPES["c64" if d.kind == "c" else "f64"]
        value = D.make(*(_mean(p, size) for p in parts), out) if d.kind == "c" else _mean(parts[0], size)
    elif name == "std":
        out = DTYPES["f64"]
        value = _std(parts, rows.cast("double"), size)
    elif name == "norm":
        out = DTYPES["f64"]
        value = _norm(parts)
    else:
        raise Unsupported(name)
    return value, out


def _shaped(t: Tensor, grouped, over: list[int], kept: list[int], keepdims: bool, out: D.DType) -> Tensor:
    shape = G.reduced_shape(t.shape, over, keepdims)
    columns = [F.col(f"c{i}") if i in kept else F.lit(0).cast("long") for i in range(t.ndim) if keepdims or i in kept] or [F.lit(0).cast("long")]
    frame = grouped.select(*(c.alias(f"c{i}") for i, c in enumerate(columns)), "v")
    return t.like(frame, shape=shape, dtype=out, sparse=t.sparse and bool(kept))


def _product(t: Tensor, over, kept, n: int, keepdims: bool) -> Tensor:
    """Floats: Spark's product. Integers and complex numbers: batches first, then the batches' products."""
    d, keys = t.dtype, [f"c{i}" for i in kept]
    df = t.df
    if d.kind == "f":
        value, _ = _value(t, "product", F.lit(n).cast("long"))
        grouped = df.groupBy(*keys).agg(value.alias("v")) if keys else df.agg(value.alias("v"))
        return _shaped(t, grouped, over, kept, keepdims, d)
    values = kernels.wrapping_product(df, keys, "v", d) if d.integer else kernels.complex_product(df, keys, "v", d)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")) if keys else df.agg(F.count(F.lit(1)).alias("rows"))
    if t.sparse or not keys:
        both = counts.join(values, keys, "left") if keys else counts.crossJoin(values) if not t.sparse else counts.join(values, F.lit(True), "left")
        if d.integer:
            v = F.when(F.col("rows") < n, D.zero(d)).otherwise(F.col("v"))
        else:
            times = [F.when(F.col("rows") < n, F.coalesce(F.col(f"v.{p}"), F.lit(0.0)) * 0.0).otherwise(F.col(f"v.{p}")) for p in ("re", "im")]
            v = D.make(*times, d)
        values = both.select(*keys, v.alias("v"))
    return _shaped(t, values, over, kept, keepdims, d)


def reduce_all(t: Tensor, name: str):
    """Of the whole tensor, as a Python number."""
    out = reduce(t, name)
    return python_value(out.df.first()["v"], out.dtype)


def _counterexample(t: Tensor, name: str):
    """A row that settles ``any`` (one other than zero) or refutes ``all`` (a zero): at most one, and each task ends at
    its first."""
    true = D.not_zero(F.col("v"), t.dtype)
    return t.df.where(true if name == "any" else ~true).select(F.lit(1).alias("one")).limit(1)


def truth_frame(t: Tensor, name: str):
    """One row: whether all or any cells are other than zero."""
    found = _counterexample(t, name).agg(F.count(F.lit(1)).alias("n"))
    if name == "any" or not t.sparse:
        return found.select((F.col("n") > 0 if name == "any" else F.col("n") == 0).alias("v"))
    # Absent cells are zeros: all rows are counted.
    true = D.not_zero(F.col("v"), t.dtype)
    return t.df.agg((F.coalesce(F.bool_and(true), F.lit(True)) & (F.count(F.lit(1)) == t.size)).alias("v"))


def all_true(t: Tensor) -> bool:
    """Ends with the first partitions that hold a zero; only a sparse tensor without one is counted."""
    if not _counterexample(t, "all").isEmpty():
        return False
    return not t.sparse or t.df.count() == t.size


def any_true(t: Tensor) -> bool:
    """Ends with the first partitions that hold another value than zero."""
    return not _counterexample(t, "any").isEmpty()


def reduce_sets(t: Tensor, name: str, sets: list[list[int]]):
    """Reductions over several sets of axes from one scan: ``set`` (its number), the axes (null where reduced), v. Each
    set's absent cells are counted by its own size. Results that are zero for want of rows are left out, as in sparse tensors."""
    if t.ndim == 0 or not sets:
        raise InvalidSchema("no axes to reduce")
    if name == "product" and t.dtype.kind != "f":
        raise Unsupported(f"product of {t.dtype.name} over several sets")
    sets = [G.reduction_axes(t.shape, s) for s in sets]
    names = t.axes
    numbers = [sum(1 << (t.ndim - 1 - i) for i in over) for over in sets]
    if len(set(numbers)) != len(sets):
        raise InvalidSchema(f"sets {sets}")
    # The size of the group that a row of the result stands for, by which axes are gone.
    size = F.lit(0).cast("long")
    for number, over in zip(numbers, sets):
        size = F.when(F.grouping_id() == number, F.lit(G.size([t.shape[i] for i in over])).cast("long")).otherwise(size)
    value, out = _value(t, name, size)
    kept = [[F.col(c) for i, c in enumerate(names) if i not in over] for over in sets]
    found = t.df.groupingSets(kept, *names).agg(value.alias("v"), F.grouping_id().alias("g"))
    number = F.lit(None).cast("int")
    for k, g in enumerate(numbers):
        number = F.when(F.col("g") == g, F.lit(k)).otherwise(number)
    return found.select(number.alias("set"), *names, "v")


def _bind() -> None:
    def one(name: str):
        setattr(Tensor, name, lambda self, over, keepdims=False: reduce(self, name, over, keepdims))
        setattr(Tensor, f"{name}_all", lambda self: reduce_all(self, name))

    for name in NAMES:
        one(name)
    Tensor.all, Tensor.any = all_true, any_true


_bind()
