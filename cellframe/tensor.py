"""Lazy n-dimensional tensors: a DataFrame with one BIGINT column for each axis, and a value expression over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import geometry as G
from .errors import InvalidLayout, InvalidSchema, Unsupported, WouldDensify
from .functions import dtypes as D
from .functions import scalar as S


#: Indices of a gather that are broadcast at most (16 bytes each); Spark chooses beyond.
MOST_BROADCAST = 1 << 20
#: Cells that one generated array makes at most, and cells of a part in which the cells of a sparse tensor are filled up.
RUN, PART = 1 << 12, 1 << 20
#: Cells of a lane, in which cells without an order are made where the last axis has ``LANES_FROM`` places: files of them
#: hold runs of a coordinate and a short round of the last one, instead of all its numbers again and again.
LANE, LANES_FROM = 1 << 6, 1 << 12
#: Operations that are zero where one side is, but for a product of zero and a value that is not finite.
ABSORBING = ("mul", "and")


def axes(n: int) -> list[str]:
    return [f"c{i}" for i in range(n)]


class Tensor:
    """Immutable. Dense: every cell has its row. Sparse: cells without a row are zero; rows of zeros are allowed
    within a plan and left out at its end. Tensors over one frame combine without a join."""

    #: Dense, of one value for all cells: ``value`` reads no column, and ``frame`` is the grid.
    constant = False
    #: Of a dense tensor made of a sparse one, that one.
    unfilled: "Tensor | None" = None
    #: Of a transpose, the tensor that was turned and its axes in the order they have here.
    turned: "tuple[Tensor, list[int]] | None" = None

    def __init__(self, frame: DataFrame, value: Column | str, shape, dtype, sparse: bool = False, axis: int | None = None, strides=None, writable: bool = True):
        self.frame, self.value = frame, F.col(value) if isinstance(value, str) else value
        self.shape, self.dtype = tuple(shape), D.dtype(dtype)
        self.sparse, self.axis = sparse, axis
        self.strides = tuple(strides) if strides is not None else G.contiguous_strides(self.shape)
        self.writable = writable

    # What a tensor is

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return G.size(self.shape)

    @property
    def axes(self) -> list[str]:
        return axes(self.ndim)

    @property
    def spark(self) -> SparkSession:
        return self.frame.sparkSession

    @property
    def is_base_tensor(self) -> bool:
        return self.writable and self.strides == G.contiguous_strides(self.shape)

    @property
    def supports_write_through(self) -> bool:
        """Gathers and expansions have several cells for one stored value."""
        return self.writable

    @property
    def df(self) -> DataFrame:
        """Axis columns and ``v``, rows of implied zeros not filled in."""
        return self.frame.select(*self.axes, self.value.alias("v"))

    def like(self, frame: DataFrame, value: Column | str = "v", **changes) -> "Tensor":
        given = {"shape": self.shape, "dtype": self.dtype, "sparse": self.sparse, "strides": None, "writable": False} | changes
        return Tensor(frame, value, **given)

    def rows(self) -> DataFrame:
        """The end of a plan: every cell of a dense tensor, the other than zero ones of a sparse one."""
        return self.df.where(D.not_zero(F.col("v"), self.dtype)) if self.sparse else self.df

    def grid(self) -> DataFrame:
        return grid(self.spark, self.shape)

    def full(self) -> DataFrame:
        """Every cell, zeros filled in."""
        if not self.sparse:
            return self.df
        return filled(self.df, self.shape).select(*self.axes, F.coalesce("v", D.zero(self.dtype)).alias("v"))

    def row_major(self, tasks: int | None = None) -> DataFrame:
        """Every cell, row-major over the partitions in their order; the rows that are there are sorted, not the cells made."""
        if not self.sparse:
            return self.df.orderBy(*self.axes)
        return filled(self.df, self.shape, ordered=True, tasks=tasks).select(*self.axes, F.coalesce("v", D.zero(self.dtype)).alias("v"))

    def view(self) -> "Tensor":
        return Tensor(self.frame, self.value, self.shape, self.dtype, self.sparse, self.axis, self.strides, self.writable)

    def into_dense(self) -> "Tensor":
        out = self.like(self.full(), sparse=False)
        out.unfilled = self if self.sparse else None
        return out

    def _elementwise(self, value: Column, dtype=None) -> "Tensor":
        out = self.like(self.frame, value, dtype=dtype or self.dtype, strides=self.strides)
        out.constant = self.constant
        return out

    def into_sparse(self, axis: int | None = None) -> "Tensor":
        return self.like(self.df, sparse=True, axis=axis)

    def checkpoint(self) -> "Tensor":
        """Cut a deep plan with files in the shared checkpoint folder."""
        return self.like(self.df.checkpoint(), strides=self.strides, axis=self.axis, writable=self.writable)

    # Elementwise operations

    def _same(self, *others: "Tensor") -> None:
        for o in others:
            if o.shape != self.shape:
                raise InvalidSchema(f"shapes {self.shape} and {o.shape}")

    def _kind(self, name: str, on: str) -> None:
        if self.dtype.kind not in on:
            raise Unsupported(f"{name} of {self.dtype.name}")

    @property
    def _zero(self):
        return 0j if self.dtype.kind == "c" else 0.0 if self.dtype.kind == "f" else 0

    def _keeps_zero(self, name: str, result) -> None:
        if result != 0:
            raise WouldDensify(f"{name} turns absent zeros into {result}; use into_dense() first")

    def unary(self, name: str) -> "Tensor":
        f = S.UNARY[name]
        self._kind(name, f.on)
        if self.sparse:
            self._keeps_zero(name, f.value(self._zero))
        return self._elementwise(f.column(self.value, self.dtype), f.out(self.dtype))

    def cast(self, target) -> "Tensor":
        target = D.dtype(target)
        return self._elementwise(D.cast(self.value, self.dtype, target), target)

    def scalar(self, name: str, value) -> "Tensor":
        f = S.BINARY[name]
        self._kind(name, f.on)
        if self.dtype.integer:
            value = D.wrap_int(int(value), self.dtype)
        if self.sparse:
            self._keeps_zero(f"{name}_scalar", f.value(self._zero, value, self.dtype))
        column = f.column(self.value, D.literal(value, self.dtype), self.dtype)
        return self._elementwise(column, f.out(self.dtype))

    def binary(self, name: str, other: "Tensor") -> "Tensor":
        f = S.BINARY[name]
        self._same(other)
        if other.dtype != self.dtype:
            raise InvalidSchema(f"dtypes {self.dtype.name} and {other.dtype.name}")
        self._kind(name, f.on)
        sparse = self.sparse and other.sparse
        if sparse:
            self._keeps_zero(name, f.value(self._zero, self._zero, self.dtype))
        if narrow := _narrowed([self, other]):
            (a, b), real = narrow
            return Expanded(a.binary(name, b), real, self.shape)
        absorbs = sparse and name in ABSORBING and isinstance(self, Expanded) != isinstance(other, Expanded)
        frame, (a, b) = _joined_on_cells(self, other, name) if absorbs else joined([self, other])
        return self.like(frame, f.column(a, b, self.dtype), dtype=f.out(self.dtype), sparse=sparse, strides=_common([self, other]))

    def cond(self, then: "Tensor", other: "Tensor") -> "Tensor":
        """``then`` where this mask (u8) is other than zero, else ``other``."""
        if self.dtype.name != "u8":
            raise InvalidSchema(f"a condition of {self.dtype.name}")
        self._same(then, other)
        if then.dtype != other.dtype:
            raise InvalidSchema(f"dtypes {then.dtype.name} and {other.dtype.name}")
        if narrow := _narrowed([self, then, other]):
            (c, a, b), real = narrow
            return Expanded(c.cond(a, b), real, self.shape)
        frame, (c, a, b) = joined([self, then, other])
        sparse = self.sparse and then.sparse and other.sparse
        return then.like(frame, F.when(c != 0, a).otherwise(b), sparse=sparse, strides=_common([self, then, other]))

    # Geometric transforms

    def slice(self, *ranges) -> "Tensor":
        ranges = G.check_range(self.shape, ranges)
        if self.unfilled is not None:  # only the cells of the slice are made
            return self.unfilled.slice(*ranges).into_dense()
        frame, columns, shape, strides, writable = self.frame, [], [], [], self.writable
        keep = [F.lit(True)]
        for i, r in enumerate(ranges):
            c = F.col(f"c{i}")
            if isinstance(r, G.At):
                keep.append(c == r.index)
                continue
            if isinstance(r, G.In):
                if (r.start, r.stop) != (0, self.shape[i]):
                    keep.append(c.between(r.start, r.stop - 1))
                if r.step > 1:
                    keep.append((c - r.start) % r.step == 0)
                    c = F.call_function("div", c - r.start, F.lit(r.step))
                elif r.start:
                    c = c - r.start
                columns.append(c)
                shape.append(-(-(r.stop - r.start) // r.step))
                strides.append(None if self.strides[i] is None else self.strides[i] * r.step)
            else:
                columns.append(F.col(f"g{i}"))
                shape.append(len(r.indices))
                strides.append(None)
                writable = False
        for k in keep[1:]:
            frame = frame.where(k)
        for i, r in enumerate(ranges):
            if isinstance(r, G.Of):  # the indices are part of the plan, a driver-side list
                picks = self.spark.createDataFrame(list(zip(r.indices, range(len(r.indices)))), f"p{i} long, g{i} long")
                picks = F.broadcast(picks) if len(r.indices) <= MOST_BROADCAST else picks
                frame = frame.join(picks, F.col(f"c{i}") == F.col(f"p{i}"))
        frame = frame.select(*(c.alias(f"c{k}") for k, c in enumerate(columns)), self.value.alias("v"))
        return self.like(frame, shape=tuple(shape), strides=strides, writable=writable)

    def _moved(self, columns: list[Column], shape, strides, writable: bool | None = None) -> "Tensor":
        frame = self.frame.select(*(c.alias(f"c{i}") for i, c in enumerate(columns)), self.value.alias("v"))
        return self.like(frame, shape=tuple(shape), strides=strides, writable=self.writable if writable is None else writable)

    def transpose(self, permutation=None) -> "Tensor":
        p = G.check_permutation(self.ndim, permutation)
        source, order = self.turned or (self, range(self.ndim))
        order = [order[i] for i in p]
        if self.turned and order == list(range(self.ndim)):  # turned back: the same frame, which meets itself without a join
            return source.view()
        out = self._moved([F.col(f"c{i}") for i in p], [self.shape[i] for i in p], [self.strides[i] for i in p])
        out.turned = source, order
        return out

    def reshape(self, shape) -> "Tensor":
        shape = G.check_reshape(self.shape, self.strides, shape)
        flat = flat_index(self.shape)
        return self._moved(from_flat(flat, shape), shape, G.contiguous_strides(shape))

    def broadcast(self, shape) -> "Tensor":
        shape = G.check_shape(shape)
        extra = len(shape) - self.ndim
        if extra < 0 or any(a != b and a != 1 for a, b in zip(self.shape, shape[extra:])):
            raise InvalidSchema(f"{self.shape} does not expand to {shape}")
        if shape == self.shape:
            return self.view()
        real = [k for k, n in enumerate(self.shape) if n == shape[k + extra]]
        source = self
        if len(real) < self.ndim:
            frame = self.frame.select(*(F.col(f"c{k}").alias(f"c{i}") for i, k in enumerate(real)), self.value.alias("v"))
            source = self.like(frame, shape=tuple(self.shape[k] for k in real), strides=[self.strides[k] for k in real])
        return Expanded(source, [k + extra for k in real], shape)

    def flip(self, axis: int) -> "Tensor":
        G.check_axis(self.shape, axis)
        columns = [F.lit(n - 1) - F.col(f"c{i}") if i == axis else F.col(f"c{i}") for i, n in enumerate(self.shape)]
        strides = [-s if i == axis and s is not None else s for i, s in enumerate(self.strides)]
        return self._moved(columns, self.shape, strides)

    def squeeze(self, drop) -> "Tensor":
        drop = list(drop)
        for a in drop:
            G.check_axis(self.shape, a)
        if not drop or len(set(drop)) != len(drop) or len(drop) == self.ndim or any(self.shape[a] != 1 for a in drop):
            raise InvalidSchema(f"squeeze {drop} of {self.shape}")
        left = [i for i in range(self.ndim) if i not in drop]
        return self._moved([F.col(f"c{i}") for i in left], [self.shape[i] for i in left], [self.strides[i] for i in left])

    def unsqueeze(self, before) -> "Tensor":
        """A unit axis before each of the given axes."""
        before = list(before)
        for a in before:
            G.check_axis(self.shape, a)
        if not before or len(set(before)) != len(before):
            raise InvalidSchema(f"unsqueeze {before} of {self.shape}")
        columns, shape, strides = [], [], []
        for i in range(self.ndim):
            if i in before:
                columns.append(F.lit(0).cast("long"))
                shape.append(1)
                strides.append(G.size(self.shape[i:]))
            columns.append(F.col(f"c{i}"))
            shape.append(self.shape[i])
            strides.append(self.strides[i])
        return self._moved(columns, shape, strides)

    # Reading

    def read_value(self, coord):
        coord = G.check_coord(self.shape, coord)
        df = (self.unfilled or self).df
        for i, c in enumerate(coord):
            df = df.where(F.col(f"c{i}") == c)
        row = df.select("v").first()
        value = self._zero if row is None else row["v"]
        return python_value(value, self.dtype)

    def to_numpy(self):
        """All cells on the driver; for tests and small results."""
        import numpy as np

        kind = {"u": "uint", "i": "int", "f": "float"}.get(self.dtype.kind)
        out = np.zeros(self.shape, f"{kind}{self.dtype.bits}" if kind else f"complex{2 * self.dtype.bits}")
        for row in self.rows().collect():
            out[tuple(row[:-1])] = python_value(row[-1], self.dtype)
        return out


class Expanded(Tensor):
    """A tensor spread along further axes, which are kept as geometry alone: ``source`` has the axes at ``real`` of the
    shape. Elementwise operations work on the source, joins on the real axes; cells are made where they are read."""

    def __init__(self, source: Tensor, real, shape):
        self.source, self.real = source, tuple(real)
        self.shape, self.dtype, self.sparse, self.axis = tuple(shape), source.dtype, source.sparse, None
        places = dict(zip(self.real, source.strides))
        self.strides = tuple(places.get(i) for i in range(self.ndim))
        self.writable, self.value, self._cells = False, F.col("v"), None

    @property
    def spark(self) -> SparkSession:
        return self.source.spark

    @property
    def frame(self) -> DataFrame:
        if self._cells is None:
            out = self.side({"v": self})
            for i, n in enumerate(self.shape):
                if i not in self.real:
                    out = out.crossJoin(self.spark.range(n).select(F.col("id").alias(f"c{i}")))
            self._cells = out.select(*self.axes, "v")
        return self._cells

    def side(self, values: dict[str, "Expanded"]) -> DataFrame:
        """The real axes under their names in the shape, and values over the source's frame."""
        renamed = (F.col(f"c{k}").alias(f"c{i}") for k, i in enumerate(self.real))
        return self.source.frame.select(*renamed, *(t.source.value.alias(n) for n, t in values.items()))

    def onto(self, kept: list[int]) -> Tensor:
        """The same with some of the axes, all the real ones among them."""
        real = [kept.index(i) for i in self.real]
        return self.source if real == list(range(len(kept))) else Expanded(self.source, real, [self.shape[i] for i in kept])

    def view(self) -> Tensor:
        return Expanded(self.source, self.real, self.shape)

    def unary(self, name: str) -> Tensor:
        return Expanded(self.source.unary(name), self.real, self.shape)

    def cast(self, target) -> Tensor:
        return Expanded(self.source.cast(target), self.real, self.shape)

    def scalar(self, name: str, value) -> Tensor:
        return Expanded(self.source.scalar(name, value), self.real, self.shape)

    def slice(self, *ranges) -> Tensor:
        given = G.check_range(self.shape, ranges)
        left = [i for i, r in enumerate(given) if not isinstance(r, G.At)]
        if any(isinstance(r, G.Of) for r in given):
            return super().slice(*ranges)
        source = self.source.slice(*(given[i] for i in self.real)) if self.real else self.source
        shape = [-(-(given[i].stop - given[i].start) // given[i].step) for i in left]
        return Expanded(source, [left.index(i) for i in self.real if i in left], shape)

    def transpose(self, permutation=None) -> Tensor:
        p = list(G.check_permutation(self.ndim, permutation))
        return Expanded(self.source, [p.index(i) for i in self.real], [self.shape[i] for i in p])

    def broadcast(self, shape) -> Tensor:
        shape = G.check_shape(shape)
        extra = len(shape) - self.ndim
        unit = any(self.shape[i] == 1 and i + extra < len(shape) and shape[i + extra] != 1 for i in self.real)
        if extra < 0 or unit or any(a != b and a != 1 for a, b in zip(self.shape, shape[extra:])):
            return super().broadcast(shape)
        return Expanded(self.source, [i + extra for i in self.real], shape)


def _method(kind: str, name: str):
    def run(self: Tensor, *args) -> Tensor:
        return getattr(self, kind)(name, *args)

    run.__name__ = name
    return run


for _name in S.UNARY:
    setattr(Tensor, {"not": "not_"}.get(_name, _name), _method("unary", _name))
for _name in S.BINARY:
    setattr(Tensor, {"and": "and_", "or": "or_"}.get(_name, _name), _method("binary", _name))
    setattr(Tensor, f"{_name}_scalar", _method("scalar", _name))


def python_value(value, d: D.DType):
    if d.kind == "c":
        return value if isinstance(value, complex) else complex(value["re"], value["im"])
    return int(value) if d.integer else float(value)


def grid(spark: SparkSession, shape) -> DataFrame:
    """Every coordinate of a shape."""
    return spark.range(G.size(shape)).select(*(c.alias(f"c{i}") for i, c in enumerate(from_flat(F.col("id"), shape))))


def filled(df: DataFrame, shape, ordered: bool = False, tasks: int | None = None) -> DataFrame:
    """Every cell of a shape with the columns of ``df`` (axis columns and others), nulls where it has no row. Its rows are
    dealt out by parts of the flat index, sorted there, and each makes the cells up to the next one; so what is moved
    is the rows and one mark for each part, and never the cells. The flat index is row-major if ``ordered``, else by lanes
    of the last axis where that is long."""
    spark, names = df.sparkSession, axes(len(shape))
    others = [c for c in df.columns if c not in names]
    lanes = not ordered and len(shape) > 1 and shape[-1] >= LANES_FROM
    tall = (-(-shape[-1] // LANE), *shape[:-1], LANE) if lanes else tuple(shape)
    n, last = G.size(tall), F.col(names[-1])
    at = [F.call_function("div", last, F.lit(LANE).cast("long")), *map(F.col, names[:-1]), last % LANE] if lanes else [*map(F.col, names)]
    flat = F.lit(0).cast("long")
    for c, s in zip(at, G.contiguous_strides(tall)):
        flat = flat + c * F.lit(s)
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = min(max(-(-n // (16 * tasks)), RUN), PART)
    inside = F.lit(True)
    for c, k in zip(names, shape):
        inside = inside & F.col(c).between(0, k - 1)
    cells = df.where(inside).select(flat.alias("first"), F.lit(True).alias("stored"), *others)
    # Each part begins with a mark, which makes the cells before its first row.
    marks = spark.range(-(-n // size)).select((F.col("id") * size).alias("first"), F.lit(False).alias("stored"))
    rows = cells.unionByName(marks, allowMissingColumns=True).withColumn("part", F.call_function("div", F.col("first"), F.lit(size).cast("long")))
    rows = rows.repartitionByRange(tasks, "part") if ordered else rows.repartition(tasks, "part")
    stop = F.lead("first").over(Window.partitionBy("part").orderBy("first", "stored"))
    rows = rows.withColumn("stop", F.coalesce(stop, F.least((F.col("part") + 1) * size, F.lit(n).cast("long"))))
    rows = rows.where(F.col("stored") | (F.col("stop") > F.col("first"))).withColumn("last", F.greatest("first", F.col("stop") - 1)).drop("part", "stop", "stored")
    rows = rows.withColumn("run", F.explode(F.sequence("first", "last", F.lit(RUN).cast("long"))))
    rows = rows.withColumn("at", F.explode(F.sequence("run", F.least(F.col("run") + (RUN - 1), F.col("last")))))
    places = from_flat(F.col("at"), tall)
    if lanes:
        places = [*places[1:-1], places[0] * LANE + places[-1]]
        rows = rows.where(places[-1] < shape[-1]) if shape[-1] % LANE else rows
    return rows.select(*(c.alias(a) for a, c in zip(names, places)), *(F.when(F.col("at") == F.col("first"), F.col(c)).alias(c) for c in others))


def flat_index(shape) -> Column:
    out = F.lit(0).cast("long")
    for i, s in enumerate(G.contiguous_strides(shape)):
        out = out + F.col(f"c{i}") * F.lit(s)
    return out


def from_flat(flat: Column, shape) -> list[Column]:
    out = []
    for i, (s, n) in enumerate(zip(G.contiguous_strides(shape), shape)):
        c = flat if s == 1 else F.call_function("div", flat, F.lit(s).cast("long"))
        out.append((c if i == 0 else c % n).cast("long"))
    return out


def _common(parts: list[Tensor]):
    """An expression is as contiguous as its operands are."""
    return next((t.strides for t in parts if t.strides != G.contiguous_strides(t.shape)), None)


def joined(parts: list[Tensor]) -> tuple[DataFrame, list[Column]]:
    """One frame with the values of all, absent sparse cells as zeros. Tensors over the same frame need no join;
    dense ones meet by an inner join, a dense one keeps its rows, sparse ones keep all."""
    first = parts[0]
    if any(isinstance(t, Expanded) for t in parts) and (found := _joined_on_real(parts)):
        return found
    if all(t.frame is first.frame for t in parts):
        return first.frame, [t.value for t in parts]
    if any(t.constant for t in parts):
        rest = [t for t in parts if not t.constant]
        if not rest:
            return first.frame, [t.value for t in parts]
        frame, values = joined(rest)
        frame = frame.select(*first.axes, *(v.alias(f"v{k}") for k, v in enumerate(values)))
        values = [F.col(f"v{k}") for k in range(len(rest))]
        if all(t.sparse for t in rest):
            frame = filled(frame, first.shape)
            values = [F.coalesce(v, D.zero(t.dtype)) for v, t in zip(values, rest)]
        given = iter(values)
        return frame, [t.value if t.constant else next(given) for t in parts]
    frames: list[list] = []
    for k, t in enumerate(parts):
        for f in frames:
            if f[0] is t.frame:
                f[1].append((k, t))
                break
        else:
            frames.append([t.frame, [(k, t)]])
    values = [F.coalesce(F.col(f"v{k}"), D.zero(t.dtype)) if t.sparse else F.col(f"v{k}") for k, t in enumerate(parts)]
    if len(frames) > 2 and all(t.sparse for t in parts):
        # One aggregate over the rows of all: each frame is dealt out once.
        sides = [frame.select(*first.axes, *(t.value.alias(f"v{k}") for k, t in own)) for frame, own in frames]
        out = sides[0]
        for side in sides[1:]:
            out = out.unionByName(side, allowMissingColumns=True)
        return out.groupBy(*first.axes).agg(*(F.max(f"v{k}").alias(f"v{k}") for k in range(len(parts)))), values
    # Dense frames come first, so that sparse ones join to rows that are there.
    frames.sort(key=lambda f: all(t.sparse for _, t in f[1]))
    out, out_dense = None, False
    for frame, own in frames:
        dense = any(not t.sparse for _, t in own)
        side = frame.select(*first.axes, *(t.value.alias(f"v{k}") for k, t in own))
        if out is None:
            out, out_dense = side, dense
        else:
            out = out.join(side, first.axes, "inner" if dense and out_dense else "left" if out_dense else "full")
    return out, values


def _narrowed(parts: list[Tensor]) -> tuple[list[Tensor], list[int]] | None:
    """The parts with those axes only that one of them really has, if that leaves any out."""
    if not all(isinstance(t, Expanded) for t in parts):
        return None
    real = sorted({i for t in parts for i in t.real})
    return ([t.onto(real) for t in parts], real) if 0 < len(real) < parts[0].ndim else None


def _joined_on_real(parts: list[Tensor]) -> tuple[DataFrame, list[Column]] | None:
    """As ``joined``, expanded tensors by their real axes; None where dense ones do not give every cell, and cells have
    to be made. A source is broadcast if its shape bounds it."""
    ndim, every = parts[0].ndim, range(parts[0].ndim)
    plain = [k for k, t in enumerate(parts) if not isinstance(t, Expanded)]
    covered = {i for t in parts if not t.sparse for i in (t.real if isinstance(t, Expanded) else every)}
    if len(covered) < ndim:
        return None
    sides: list[tuple] = []
    if plain:
        frame, own = joined([parts[k] for k in plain])
        dense = any(not parts[k].sparse for k in plain)
        sides.append((tuple(every), dense, frame.select(*axes(ndim), *(v.alias(f"v{k}") for k, v in zip(plain, own))), False))
    sources: dict[tuple, dict[str, Expanded]] = {}
    for k, t in enumerate(parts):
        if k not in plain:
            sources.setdefault((id(t.source.frame), t.real, t.sparse), {})[f"v{k}"] = t
    for (_, real, sparse), own in sources.items():
        t = next(iter(own.values()))
        sides.append((real, not sparse, t.side(own), t.source.size <= MOST_BROADCAST))
    sides.sort(key=lambda s: (not s[1], -len(s[0])))
    have, _, out, _ = sides[0]
    have = set(have)
    for real, dense, side, small in sides[1:]:
        shared = [f"c{i}" for i in real if i in have]
        side = F.broadcast(side) if small else side
        if shared:
            out = out.join(side, shared, "inner" if dense else "left")
        else:
            out = out.crossJoin(side) if dense else out.join(side, F.lit(True), "left")
        have |= set(real)
    return out, [F.coalesce(F.col(f"v{k}"), D.zero(t.dtype)) if t.sparse else F.col(f"v{k}") for k, t in enumerate(parts)]


def _joined_on_cells(left: Tensor, right: Tensor, name: str) -> tuple[DataFrame, list[Column]]:
    """A sparse tensor and a sparse expanded one under an absorbing operation: the cells that the former has, and those
    of the latter's values that are not finite."""
    cells, spread = (right, left) if isinstance(left, Expanded) else (left, right)
    own, other = ("v1", "v0") if cells is right else ("v0", "v1")
    side = spread.side({other: spread})
    side = F.broadcast(side) if spread.source.size <= MOST_BROADCAST else side
    here = cells.frame.select(*cells.axes, cells.value.alias(own))
    out = here.join(side, [f"c{i}" for i in spread.real], "left") if spread.real else here.join(side, F.lit(True), "left")
    if name == "mul" and not spread.dtype.integer:
        parts = [F.col("v.re"), F.col("v.im")] if spread.dtype.kind == "c" else [F.col("v")]
        odd = F.lit(False)
        for x in parts:
            odd = odd | F.isnan(x) | (F.abs(x) == float("inf"))
        odd = Expanded(spread.source.like(spread.source.df.where(odd), strides=spread.source.strides), spread.real, spread.shape).df
        odd = odd.join(cells.df, cells.axes, "left_anti")
        out = out.select(*cells.axes, "v0", "v1").union(odd.select(*cells.axes, *(F.col("v") if c == other else D.zero(cells.dtype) for c in ("v0", "v1"))))
    return out, [F.coalesce(F.col(c), D.zero(cells.dtype)) for c in ("v0", "v1")]


def fold(name: str, parts: list[Tensor]) -> Tensor:
    """``name`` over any number of tensors from the left, as a chain of binary operations gives it; the tensors meet
    at once, and not one after another."""
    first, f = parts[0], S.BINARY[name]
    first._same(*parts[1:])
    if any(t.dtype != first.dtype for t in parts):
        raise InvalidSchema(f"dtypes {[t.dtype.name for t in parts]}")
    first._kind(name, f.on)
    if len(parts) > 1 and f.out(first.dtype) != first.dtype:
        raise Unsupported(f"fold of {name}")
    sparse = all(t.sparse for t in parts)
    if sparse:
        first._keeps_zero(name, f.value(first._zero, first._zero, first.dtype))
    if narrow := _narrowed(parts):
        return Expanded(fold(name, narrow[0]), narrow[1], first.shape)
    frame, values = joined(parts)
    out = values[0]
    for v in values[1:]:
        out = f.column(out, v, first.dtype)
    return first.like(frame, out, sparse=sparse, strides=_common(parts))


def require_sparse(t: Tensor, what: str) -> None:
    if not t.sparse:
        raise InvalidLayout(f"{what} needs a sparse tensor")
