"""Matrix products, transposes and diagonals over the last two axes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import geometry as G
from ..errors import InvalidSchema, Unsupported
from ..functions import dtypes as D
from ..functions import scalar as S
from ..session import without_shuffles
from ..tensor import Tensor, axes, grid
from .runs import sums as run_sums

#: Side of the square tiles of the blocked product, and that of larger ones where there are many.
TILE, MOST_SIDE = 128, 1 << 12
#: Inner coordinates in one row of a tile, cells of a strip of a tile at most, and cells that are made at a time.
FINE, STRIP, CELLS = 1 << 10, 1 << 23, 1 << 20
#: Rows of marks (one for each place of the outer axes) up to which a sparse product is made in one pass.
MOST_MARKS = 1 << 24
#: Cells of a product up to which every task holds the sums of all. Beyond, sums are dealt out by runs of outer
#: coordinates, of so many at least and at most; a row of arrays has so many cells of the right side, or of sums, at most.
HELD, LEAST_RUN, MOST_RUN, ROW = 1 << 16, 1 << 6, 1 << 10, 1 << 8


def _contract(a: Column, b: Column, d: D.DType) -> Column:
    """Sum of products of a group, in the dtype."""
    if d.kind == "f":
        return F.sum(a.cast("double") * b.cast("double")).cast(d.sql)
    if d.kind == "c":
        p = S.ARITHMETIC["mul"].column(a, b, D.DTYPES["c64"])
        return D.make(F.sum(p["re"]), F.sum(p["im"]), d)
    from .reduce import _sum_int

    return _sum_int(D.int_mul(a, b, d), d)


def _summed(d: D.DType) -> Column:
    """Sum of the partial sums ``v`` of a group, in the dtype."""
    if d.integer:
        from .reduce import _sum_int

        return _sum_int(F.col("v"), d)
    return D.make(F.sum("v.re"), F.sum("v.im"), d) if d.kind == "c" else F.sum(F.col("v").cast("double")).cast(d.sql)


def _finite(v: Column, d: D.DType) -> Column:
    one = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    return one(v["re"]) & one(v["im"]) if d.kind == "c" else one(v)


def _absent_times_non_finite(a: Tensor, b: Tensor, left: DataFrame, right: DataFrame, batch: list[str]) -> DataFrame:
    """Products of a non-finite value with an absent zero of the other side: each is NaN."""
    d, n, m = a.dtype, b.shape[-1], a.shape[-2]
    nan = D.make(F.lit(float("nan")), F.lit(float("nan")), d) if d.kind == "c" else F.lit(float("nan")).cast(d.sql)
    spark = a.spark
    bad = left.where(~_finite(F.col("x"), d)).crossJoin(spark.range(n).select(F.col("id").alias("j")))
    rows = bad.join(right.select(*batch, "k", "j"), [*batch, "k", "j"], "left_anti").select(*batch, "i", "j")
    bad = right.where(~_finite(F.col("y"), d)).crossJoin(spark.range(m).select(F.col("id").alias("i")))
    columns = bad.join(left.select(*batch, "k", "i"), [*batch, "k", "i"], "left_anti").select(*batch, "i", "j")
    return rows.union(columns).distinct().withColumn("v", nan)


def _marked(side: DataFrame, v: str, mine: int, other: int, batch: list[str], own: str, shape, d: D.DType) -> DataFrame:
    """A side of a sparse product with marks: each non-finite value once more at the inner coordinate ``mine``, where
    every place of the other side's outer axis has a mark; and this side's own marks at ``other``, one for each place."""
    k = F.array(F.col("k"), F.lit(mine).cast("long"))
    rows = side.select(*batch, own, v, F.explode(F.when(_finite(F.col(v), d), F.slice(k, 1, 1)).otherwise(k)).alias("k"))
    marks = grid(side.sparkSession, shape).toDF(*batch, own)
    return rows.unionByName(marks.select("*", D.zero(d).alias(v), F.lit(other).cast("long").alias("k")))


def _with_marks(a: Tensor, b: Tensor, left: DataFrame, right: DataFrame, batch: list[str]) -> DataFrame:
    """The contraction in one pass over each side. A cell is NaN if a non-finite value of its row or column met no
    value of the other side: if it has more marks than such values that met."""
    d = a.dtype
    left = _marked(left, "x", -1, -2, batch, "i", a.shape[:-1], d)
    right = _marked(right, "y", -2, -1, batch, "j", (*b.shape[:-2], b.shape[-1]), d)
    real = F.col("k") >= 0
    if d.kind == "c":
        p = S.ARITHMETIC["mul"].column(F.col("x"), F.col("y"), D.DTYPES["c64"])
        sums = {x: F.when(real, p[x]) for x in ("re", "im")}
    else:
        sums = {"sum": F.when(real, F.col("x").cast("double") * F.col("y").cast("double"))}
    # Marks of a cell less the values that met: none are left where each met one.
    odd = lambda v: F.when(_finite(F.col(v), d), 0).otherwise(1)
    sums["missed"] = F.when(real, -(odd("x") + odd("y"))).otherwise(1)
    out = left.join(right, [*batch, "k"]).groupBy(*batch, "i", "j").agg(*(F.sum(x).alias(name) for name, x in sums.items()))
    nan = lambda c: F.when(F.col("missed") > 0, float("nan")).otherwise(F.col(c))
    return out.select(*batch, "i", "j", (D.make(nan("re"), nan("im"), d) if d.kind == "c" else nan("sum").cast(d.sql)).alias("v"))


def _split(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with a salt, so that the values of inner coordinates with many cells on the left meet in many tasks.
    Counted by a job: of all coordinates, no more than four times the partitions hold a share that large."""
    spark = left.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = left.count()
    heavy = counts.where(F.col("n") * (4 * parts) > total).select(*keys, F.lit(True).alias("heavy")).collect()
    if not heavy:
        return left, right, keys
    heavy = F.broadcast(spark.createDataFrame(heavy, ", ".join([*(f"{k} long" for k in keys), "heavy boolean"])))
    salt = F.pmod(F.xxhash64("i"), F.lit(parts))
    left = left.join(heavy, keys, "left").withColumn("salt", F.when(F.col("heavy"), salt).otherwise(0).cast("long")).drop("heavy")
    every = F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))
    right = right.join(heavy, keys, "left").withColumn("salt", F.explode(F.when(F.col("heavy"), every).otherwise(F.array(F.lit(0).cast("long"))))).drop("heavy")
    return left, right, [*keys, "salt"]


def _turned(a: Tensor, b: Tensor) -> bool:
    """Whether one of two matrices is the other with its axes swapped, so that their product is its own transpose."""
    return a.ndim == 2 and any(x.turned is not None and x.turned[0] is y and list(x.turned[1]) == [1, 0] for x, y in ((a, b), (b, a)))


def _lean(n: int | None) -> tuple[str, int]:
    """The least integer type for the numbers below n less half of its range, and that half."""
    for bits, kind in ((8, "tinyint"), (16, "smallint"), (32, "int")):
        if n is not None and n <= 1 << bits:
            return kind, 1 << bits - 1
    return "bigint", 0


def _dealt(left: DataFrame, right: DataFrame, batch: list[str], outer, counted: bool, n: int | None = None, half: bool = False) -> tuple[DataFrame, list[list[str]]]:
    """The cells that meet, dealt out by runs of the left side's outer coordinates (``outer``: their shape, with that of
    the batch), so that all of a sum come to one task; and the groups in which to add them up. The cells of both sides at
    an inner coordinate travel as arrays, once for each run that has some there; those of the right side, which are
    most of what travels, in the least type for their coordinates (below ``n``) and in bytes where all values of an
    array are small integers (``small``, else ``ys``). ``counted``: a job counts the cells of
    the runs; those with more than twice an even share are dealt out by the inner coordinate too, and their sums added
    up once more. ``half``: only the cells from a run's least outer coordinate on. A partition holds whole runs."""
    tasks, size, keys = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), G.size(outer), [*batch, "k"]
    side = max(min(max(-(-size // tasks), LEAST_RUN), MOST_RUN), -(-size // (16 * tasks)))
    runs = max(1, -(-size // side))
    flat = F.lit(0).cast("long")
    for c, s in zip([*batch, "i"], G.contiguous_strides(outer)):
        flat = flat + F.col(c) * F.lit(s)
    left = left.withColumn("o", flat).withColumn("run", F.call_function("div", F.col("o"), F.lit(side).cast("long")).cast("int"))
    groups = [["run", "i", "j"]]
    if counted:
        with without_shuffles(left.sparkSession):
            counts = dict(map(tuple, left.groupBy("run").count().collect()))
        if heavy := [run for run, n_cells in counts.items() if n_cells * runs > 2 * sum(counts.values())]:
            further = F.pmod(F.col("run") + F.pmod(F.xxhash64(*keys), F.lit(runs)), F.lit(runs)).cast("int")
            left = left.withColumn("run", F.when(F.col("run").isin(heavy), further).otherwise(F.col("run")))
            groups.append(["i", "j"])
    kind, shift = _lean(n)
    lefts = left.repartition(tasks, *keys).groupBy(*keys, "run").agg(F.collect_list(F.struct("o", "x")).alias("l"), (F.min("o") - shift).alias("least"))
    # By their number, for cells that are far apart; by far larger ranges before, so that no array holds a whole row.
    far = F.call_function("div", F.col("j"), F.lit(ROW << 12).cast("long")).alias("far")
    rights = right.repartition(tasks, *keys).groupBy(*keys, far).agg(F.collect_list(F.struct((F.col("j") - shift).cast(kind).alias("j"), "y")).alias("r"))
    cut = F.transform(F.sequence(F.lit(1), F.size("r"), F.lit(ROW)), lambda at: F.slice("r", at, F.lit(ROW)))
    rights = rights.select(*keys, F.explode(F.when(F.size("r") <= ROW, F.array("r")).otherwise(cut)).alias("r"))
    values = {"ys": F.col("r")}
    if plain := not isinstance(right.schema["y"].dataType, StructType):
        few = F.forall("r", lambda c: c["y"].between(-127, 127) & (c["y"] == F.floor(c["y"])))
        rights = rights.withColumn("few", few)
        # Empty and not null where they do not hold: Arrow's writer goes through all nulls before a row once more.
        given = lambda yes: F.when(yes, F.col("r")).otherwise(F.slice("r", 1, 0))
        byte = lambda c: F.struct(c["j"].alias("j"), c["y"].try_cast("tinyint").alias("y"))
        values = {"small": F.transform(given(F.col("few")), byte), "ys": given(~F.col("few"))}
    rights = rights.select(*keys, *(["few"] if plain else []), *(v.alias(name) for name, v in values.items()))
    met = lefts.join(rights, keys)
    if half:
        met = met.withColumns({name: F.filter(name, lambda c: c["j"] >= F.col("least")) for name in values})
    j = F.when(F.col("few"), F.col("small.j")).otherwise(F.col("ys.j")) if plain else F.col("ys.j")
    met = met.select("run", (F.col("k") < 0).alias("mark"), *(F.col(c).alias(name) for c, name in (("l.o", "os"), ("l.x", "xs"))), j.alias("js"), *(F.col(f"{name}.y").alias(name) for name in values))
    return met.repartitionById(runs, F.col("run")), groups


def _by_runs(a: Tensor, b: Tensor, left: DataFrame, right: DataFrame, batch: list[str], counted: bool, marked: bool) -> DataFrame:
    """The contraction with products made and added up behind the exchange of ``_dealt``. ``marked``: as in ``_with_marks``.
    Of a product that is its own transpose, the cells from the diagonal on are made, and shown twice."""
    d, outer = a.dtype, a.shape[:-1]
    wide = D.DTYPES["i64" if d.integer else "f64" if d.kind == "f" else "c64"]
    number = lambda v: D.wide(v, d) if d.integer else v.cast("double") if d.kind == "f" else D.make(v["re"], v["im"], wide)
    left, right = (side.where(F.col(v).isNotNull()).withColumn(v, number(F.col(v))) for side, v in ((left, "x"), (right, "y")))
    if marked:
        left = _marked(left, "x", -1, -2, batch, "i", outer, wide)
        right = _marked(right, "y", -2, -1, batch, "j", (*b.shape[:-2], b.shape[-1]), wide)
    half = _turned(a, b)
    met, groups = _dealt(left, right, batch, outer, counted, b.shape[-1], half)
    partial, parts = len(groups) > 1, ["re", "im"] if d.kind == "c" else ["v"]
    sides = [(F.col(f"{v}s.{p}") if d.kind == "c" else F.col(f"{v}s")).alias(f"{v}{p}") for v in "xy" for p in parts]
    values = [*parts, *(["missed"] if partial and marked else [])]
    kind = {p: wide.sql if d.kind != "c" else "double" for p in parts} | {"missed": "long"}
    names, most, row, shift = ["o", "j", *values], CELLS, ROW, _lean(b.shape[-1])[1]

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run_sums(batches, parts, names, most, row, shift, half)

    schema = ", ".join(["o long", "j array<long>", *(f"{v} array<{kind[v]}>" for v in values), *(["swap boolean"] if half else [])])
    out = met.select("mark", "os", "js", *sides, *([] if d.kind == "c" else ["small"])).mapInArrow(product, schema)
    out = out.select("*", F.posexplode("j").alias("at", "to")).select("o", F.col("to").alias("j"), *(F.col(v)[F.col("at")].alias(v) for v in values), *(["swap"] if half else []))
    if half:
        out = out.select(F.when(F.col("swap"), F.col("j")).otherwise(F.col("o")).alias("o"), F.when(F.col("swap"), F.col("o")).otherwise(F.col("j")).alias("j"), *values)
    places = [F.pmod(F.call_function("div", F.col("o"), F.lit(s).cast("long")), F.lit(n).cast("long")) for n, s in zip(outer, G.contiguous_strides(outer))]
    out = out.select(*(c.alias(name) for c, name in zip(places, [*batch, "i"])), "j", *values)
    if partial:
        from .reduce import _sum_int

        out = out.groupBy(*batch, "i", "j").agg(*((_sum_int(F.col(v), wide) if d.integer else F.sum(v)).alias(v) for v in values))
        if marked:
            out = out.select(*batch, "i", "j", *(F.when(F.col("missed") > 0, float("nan")).otherwise(F.col(p)).alias(p) for p in parts))
    v = D.narrow(F.col("v"), d) if d.integer else F.col("v").cast(d.sql) if d.kind == "f" else D.make(F.col("re"), F.col("im"), d)
    return out.select(*batch, "i", "j", v.alias("v"))


def matmul(a: Tensor, b: Tensor, method: str = "join") -> Tensor:
    """[..., M, K] @ [..., K, N]. ``join`` contracts by an equi-join on K; of products with many cells, all of a sum meet
    in one task. ``split`` does so after it has counted the cells at each k (of such products, those of each run of
    outer coordinates), and deals out those with a large share. ``tiles`` multiplies tiles with numpy, which moves
    each value once for every tile row or column instead of every product; integers wrap there as well, and those of
    two sparse sides stay sparse, and go by runs as in ``join`` where the product has many cells."""
    shape = G.matmul_output_shape(a.shape, b.shape)
    if a.dtype != b.dtype:
        raise InvalidSchema(f"dtypes {a.dtype.name} and {b.dtype.name}")
    d, r = a.dtype, a.ndim
    batch = axes(r - 2)
    if method not in ("join", "split", "tiles"):
        raise Unsupported(f"matmul by {method}")
    if method == "tiles":
        stored = d.integer and a.sparse and b.sparse
        if not stored or shape[-2] * shape[-1] <= HELD:
            out = a.like(_tiled(a, b, batch, stored), shape=shape, sparse=stored)
            out.factors = (a, b)
            return out
        # A tile of few stored cells has hardly two products of a sum, so tiles would move nearly every product.
    left = a.df.select(*batch, F.col(f"c{r - 2}").alias("i"), F.col(f"c{r - 1}").alias("k"), F.col("v").alias("x"))
    right = b.df.select(*batch, F.col(f"c{r - 2}").alias("k"), F.col(f"c{r - 1}").alias("j"), F.col("v").alias("y"))
    finite = d.integer or not (a.sparse or b.sparse)
    many = shape[-2] * shape[-1] > HELD
    marked = not finite and (many or method == "join") and G.size(a.shape[:-1]) + G.size(shape[:-2]) * shape[-1] <= MOST_MARKS
    if many:
        out = _by_runs(a, b, left, right, batch, method == "split", marked)
    elif marked:
        out = _with_marks(a, b, left, right, batch)
    else:
        keys = [*batch, "k"]
        sides = _split(left, right, keys) if method == "split" else (left, right, keys)
        out = sides[0].join(sides[1], sides[2]).groupBy(*batch, "i", "j").agg(_contract(F.col("x"), F.col("y"), d).alias("v"))
    if not finite and not marked:
        parts = out.select(*batch, "i", "j", "v").unionByName(_absent_times_non_finite(a, b, left, right, batch))
        out = parts.groupBy(*batch, "i", "j").agg(_summed(d).alias("v"))
    out = out.select(*batch, F.col("i").alias(f"c{r - 2}"), F.col("j").alias(f"c{r - 1}"), "v")
    # A product with a sparse side may lack cells.
    found = a.like(out, shape=shape, sparse=a.sparse or b.sparse)
    found = found if a.sparse and b.sparse or not found.sparse else found.into_dense()
    found.factors = (a, b)
    return found


def _side(m: int, n: int, tasks: int) -> int:
    """Side of the tiles of a product of m by n: as small as gives every task some, since a value goes to each tile row
    or column, and larger ones move less."""
    side = TILE
    while side < MOST_SIDE and -(-m // side) * -(-n // side) > 4 * tasks:
        side *= 2
    return side


def _tiled(a: Tensor, b: Tensor, batch: list[str], stored: bool) -> DataFrame:
    """``stored``: integers of two sparse sides, of which only the cells that are there are moved, to the tiles where
    the other side has some, and only sums other than zero come back."""
    r, d, (m, depth), n = a.ndim, a.dtype, a.shape[-2:], b.shape[-1]
    tasks = int(a.spark.conf.get("spark.sql.shuffle.partitions"))
    side = _side(m, n, tasks)
    # Inner coordinates of a group: strips that fit into memory, and more than one where there are few tiles.
    most = max(1, (STRIP * (8 if stored else 1)) // (side * FINE))
    fine_of = max(1, min(most, -(-depth // FINE) * -(-m // side) * -(-n // side) // tasks))
    chunk = FINE * fine_of
    i, k = F.col(f"c{r - 2}"), F.col(f"c{r - 1}")
    # Integers as longs, which wrap; complex numbers by their parts.
    kind, number = ("long", np.int64) if d.integer else ("double", np.float64)
    v = F.col("v")
    values = {"v": D.wide(v, d)} if d.integer else {"v": v.cast("double")} if d.kind == "f" else {p: v[p].cast("double") for p in ("re", "im")}
    names, keys = list(values), [*batch, "ti", "tj", "tc"]
    to = lambda c, by: F.call_function("div", c, F.lit(by).cast("long"))

    def packed(t: Tensor, outer: Column, inner: Column, tile: str) -> DataFrame:
        """A row for each outer coordinate and short run of inner ones."""
        cell = F.struct((inner % chunk).cast("int").alias("c"), *(x.alias(name) for name, x in values.items()))
        cells = (t.df if stored else t.full()).select(*batch, to(outer, side).alias(tile), to(inner, FINE).alias("tk"), (outer % side).cast("int").alias("o"), cell.alias("x"))
        return cells.groupBy(*batch, tile, "tk", "o").agg(F.collect_list("x").alias("x"))

    left, right = packed(a, i, k, "ti"), packed(b, k, i, "tj")
    if stored:
        at = [*batch, "tk"]
        sides = left.join(right.select(*at, "tj").distinct(), at), right.join(left.select(*at, "ti").distinct(), at)
    else:
        places = lambda size: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-(-size // side) - 1).cast("long")))
        sides = left.withColumn("tj", places(n)), right.withColumn("ti", places(m))
    rows = [x.select(*batch, "ti", "tj", to(F.col("tk"), fine_of).alias("tc"), F.lit(is_left).alias("l"), "o", *(F.col(f"x.{name}").alias(name) for name in ("c", *names))) for x, is_left in zip(sides, (True, False))]

    def product(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bool, list] = {True: [], False: []}
        for x in batches:
            for is_left, kept in found.items():
                y = x.filter(x.column("l") if is_left else pc.invert(x.column("l")))
                if y.num_rows:
                    o = np.repeat(y.column("o").to_numpy(zero_copy_only=False), pc.list_value_length(y.column("c")).to_numpy(zero_copy_only=False))
                    kept.append((o, *(pc.list_flatten(y.column(name)).to_numpy(zero_copy_only=False) for name in ("c", *names))))
        if not found[True] or not found[False]:
            return
        (lo, lc, *lv), (ro, rc, *rv) = ([np.concatenate(x) for x in zip(*found[s])] for s in (True, False))
        high, wide = int(lo.max()) + 1, int(ro.max()) + 1
        if stored:
            z = _added(lo, lc, lv[0], ro, rc, rv[0], high, wide)
        else:
            inner = max(int(lc.max()), int(rc.max())) + 1
            x, y = (_dense(o, c, v, shape, number) for o, c, v, shape in ((lo, lc, lv, (high, inner)), (rc, ro, rv, (inner, wide))))
            with np.errstate(all="ignore"):
                z = x @ y
        outer, (ti, tj) = [x.as_py() for x in key[: len(batch)]], (key[-3].as_py(), key[-2].as_py())
        slab = max(1, CELLS // wide)
        for top in range(0, high, slab):
            part = z[top : top + slab]
            at = np.nonzero(part) if stored else tuple(x.ravel() for x in np.indices(part.shape))
            cells = part[at]
            columns = [np.full(cells.size, c, np.int64) for c in outer] + [ti * side + top + at[0], tj * side + at[1]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, *((cells.real, cells.imag) if len(names) == 2 else (cells,)))], names=[*batch, "i", "j", *names])

    schema = ", ".join([*(f"{c} long" for c in batch), "i long", "j long", *(f"{name} {kind}" for name in names)])
    parts = rows[0].unionByName(rows[1]).groupBy(*keys).applyInArrow(product, schema)
    if depth > chunk:
        from .reduce import _sum_int

        add = (lambda name: _sum_int(F.col(name), D.DTYPES["i64"])) if d.integer else F.sum
        parts = parts.groupBy(*batch, "i", "j").agg(*(add(name).alias(name) for name in names))
    v = D.narrow(F.col("v"), d) if d.integer else F.col("v").cast(d.sql) if d.kind == "f" else D.make(F.col("re"), F.col("im"), d)
    return parts.select(*batch, F.col("i").alias(f"c{r - 2}"), F.col("j").alias(f"c{r - 1}"), v.alias("v"))


def _dense(row: np.ndarray, column: np.ndarray, values: list[np.ndarray], shape: tuple[int, int], number) -> np.ndarray:
    parts = np.zeros((len(values), *shape), number)
    for p, v in zip(parts, values):
        p[row, column] = v
    return parts[0] + 1j * parts[1] if len(values) == 2 else parts[0]


def _added(lo, lc, lv, ro, rc, rv, high: int, wide: int) -> np.ndarray:
    """Sums of the products of cells that meet at an inner coordinate, some millions of them at a time."""
    z = np.zeros(high * wide, np.int64)
    order = np.argsort(rc, kind="stable")
    ro, rv = ro[order], rv[order]
    size = max(int(lc.max()), int(rc.max())) + 1
    counts = np.bincount(rc, minlength=size)
    begins = np.cumsum(counts) - counts
    met = counts[lc]
    ends = np.cumsum(met)
    start = 0
    while start < lc.size:
        done = ends[start] - met[start]
        stop = max(start + 1, int(np.searchsorted(ends, done + CELLS, "right")))
        n = met[start:stop]
        own = np.repeat(np.arange(start, stop), n)
        other = np.arange(own.size) - np.repeat(ends[start:stop] - n - done, n) + begins[lc[own]]
        np.add.at(z, lo[own].astype(np.int64) * wide + ro[other], lv[own] * rv[other])
        start = stop
    return z.reshape(high, wide)


def mt(t: Tensor) -> Tensor:
    """The last two axes swapped."""
    if t.ndim < 2:
        raise InvalidSchema("mt needs two axes")
    return t.transpose([*range(t.ndim - 2), t.ndim - 1, t.ndim - 2])


def mh(t: Tensor) -> Tensor:
    """Conjugate transpose."""
    if t.dtype.kind != "c":
        raise Unsupported(f"mh of {t.dtype.name}")
    return mt(t).conj()


def diag(t: Tensor) -> Tensor:
    if t.ndim < 2 or t.shape[-1] != t.shape[-2]:
        raise InvalidSchema(f"diag of {t.shape}")
    r = t.ndim
    if factors := getattr(t, "factors", None):
        # Of a product only the cells of its diagonal: products of equal places, added up.
        wide = {"f": "f64", "c": "c64"}.get(t.dtype.kind, t.dtype.name)
        a, b = factors
        found = a.cast(wide).mul(mt(b).cast(wide)).sum([a.ndim - 1]).cast(t.dtype)
        return found.like(found.df, sparse=True) if t.sparse else found
    frame = t.df.where(F.col(f"c{r - 2}") == F.col(f"c{r - 1}")).drop(f"c{r - 1}")
    return t.like(frame, shape=t.shape[:-1])


Tensor.matmul, Tensor.mt, Tensor.mh, Tensor.diag = matmul, mt, mh, diag
