"""Stored tensors: files sorted by block, with a sidecar of their geometry; and updates, functional or in the files.

The blocks of a stored tensor are grouped in bands, each a folder. An update in the files writes the bands that it
touches anew, under the next version, and then the sidecar, which names the version of each changed band: so it costs
its bands and not the tensor, a failed one leaves nothing to be seen, and tensors that were opened before keep what
they saw, until ``vacuum`` removes what no band needs. Of two updates of one version the later fails.

The sidecar is written last, so a folder without one is not a tensor.
"""

from __future__ import annotations

import json
from itertools import groupby

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import geometry as G
from ..errors import DataMismatch, InvalidCoord, InvalidLayout, InvalidSchema
from ..functions import dtypes as D
from ..session import hadoop_path
from ..tensor import Tensor, axes, flat_index, from_flat, python_value, require_sparse
from .frames import _sql_value, check_cells, create

SIDECAR = "_tensor.json"
FIELDS = ("dtype", "shape", "sparse", "axis", "capacity", "format", "band_blocks", "version", "bands")
FORMATS = ("parquet", "orc", "json")
#: Cells of a band, and bands of a tensor at most; larger tensors have larger bands, asked for or not, since each is a
#: folder that is made, committed and listed by itself.
BAND_CELLS = 1 << 22
MOST_BANDS = 1 << 8
#: Bands that a task whose rows are in their order keeps open; with more it sorts.
OPEN_BANDS = 16


def geometry_of(t: Tensor, capacity: int = G.BATCH) -> G.StorageGeometry:
    return G.StorageGeometry(t.shape, t.sparse, t.axis, capacity)


def block_columns(g: G.StorageGeometry) -> tuple[Column, Column]:
    """Block and offset of the axis columns."""
    region = F.lit(g.region).cast("long")
    flat, div = flat_index(g.shape), lambda a, b: F.call_function("div", a, b)
    within, capacity = flat % region, F.lit(g.block_capacity).cast("long")
    return div(flat, region) * F.lit(g.blocks_per_region).cast("long") + div(within, capacity), within % capacity


# Files


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = hadoop_path(spark, path)
    new = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    out = fs.create(new, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE  # a reader finds the old text or the new one
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()).rename(new, p, how)


def _read_text(spark: SparkSession, path: str) -> str:
    fs, p = hadoop_path(spark, path)
    if not fs.exists(p):
        raise InvalidSchema(f"no tensor at {path}")
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def metadata(t: Tensor, capacity: int, kind: str, band_blocks: int | None = None) -> dict:
    g = geometry_of(t, capacity)
    band = max(band_blocks or max(1, BAND_CELLS // g.block_capacity), -(-g.block_count // MOST_BANDS))
    return {"dtype": t.dtype.name, "shape": list(t.shape), "sparse": t.sparse, "axis": t.axis, "capacity": capacity, "format": kind, "band_blocks": band, "version": 0, "bands": {}}


def _band(band_blocks: int) -> Column:
    return F.call_function("div", F.col("block"), F.lit(band_blocks).cast("long"))


def check_metadata(found: dict) -> dict:
    if sorted(found) != sorted(FIELDS):
        raise InvalidSchema(f"metadata fields {sorted(found)}")
    if found["format"] not in FORMATS:
        raise InvalidSchema(f"format {found['format']}")
    D.dtype(found["dtype"])
    G.StorageGeometry(tuple(found["shape"]), found["sparse"], found["axis"], found["capacity"])
    return found


def _band_of(t: "Stored", coord) -> int:
    return t.geometry.block_position(coord)[0] // t.meta["band_blocks"]


def write(t: Tensor, path: str, capacity: int = G.BATCH, kind: str = "parquet", partitions: int | None = None, band_blocks: int | None = None) -> "Stored":
    """Store the rows, ranged and sorted by block, into a folder that does not exist. A band has ``band_blocks``, or as
    many as keep the bands to ``MOST_BANDS``."""
    if kind not in FORMATS:
        raise InvalidSchema(f"format {kind}")
    meta = metadata(t, capacity, kind, band_blocks)
    fs, p = hadoop_path(t.spark, path)
    if fs.exists(p):
        raise AnalysisException(f"{path} exists")
    g = geometry_of(t, capacity)
    if t.unfilled is not None:
        tasks = max(partitions or _tasks(t.spark), -(-g.block_count // meta["band_blocks"]))
        _write_in_order(t.unfilled.row_major(tasks).withColumn("block", block_columns(g)[0]), t.axes, meta, path)
    else:
        _write_bands(t.rows().withColumn("block", block_columns(g)[0]), t.axes, meta, path, partitions)
    _write_text(t.spark, f"{path}/{SIDECAR}", json.dumps(meta))
    return load(t.spark, path)


def _write_bands(rows: DataFrame, names: list[str], meta: dict, path: str, partitions: int | None = None) -> None:
    out = rows.select(*names, "v", "block", _band(meta["band_blocks"]).alias("band"))
    out = out.repartitionByRange(partitions or _tasks(rows.sparkSession), "band", "block").sortWithinPartitions("band", "block", *names)
    _save(out, meta, path)


def _write_in_order(rows: DataFrame, names: list[str], meta: dict, path: str) -> None:
    """Rows that are row-major already go to their bands without a shuffle or a sort; their coordinates, which rise by
    one, as differences, of which files hold next to nothing."""
    conf, key = rows.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(key)
    conf.set(key, str(OPEN_BANDS))
    try:
        rising = {f"parquet.enable.dictionary#{c}": "false" for c in (*names, "block")} | {"parquet.writer.version": "PARQUET_2_0"}
        _save(rows.select(*names, "v", "block", _band(meta["band_blocks"]).alias("band")), meta, path, rising)
    finally:
        conf.set(key, before)


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _save(out: DataFrame, meta: dict, path: str, options: dict[str, str] = {}) -> None:
    out.write.options(**options).mode("errorifexists").partitionBy("band").format(meta["format"]).save(f"{path}/v={meta['version']}")


def copy_from(t: Tensor, path: str, sparse: bool = False, axis: int | None = None, capacity: int = G.BATCH, kind: str = "parquet") -> "Stored":
    """Materialise an expression in a layout of its own kind."""
    if t.sparse != sparse:
        raise InvalidLayout("copy_from keeps dense tensors dense and sparse ones sparse; copy_from_values goes between")
    return write(t.like(t.df, axis=axis), path, capacity, kind)


def copy_from_values(t: Tensor, path: str, sparse: bool = False, axis: int | None = None, capacity: int = G.BATCH, kind: str = "parquet") -> "Stored":
    """Materialise every cell in any layout."""
    if t.sparse and not sparse and axis is None:
        return write(t.into_dense(), path, capacity, kind)
    return write(t.like(t.full(), sparse=sparse, axis=axis), path, capacity, kind)


def load(spark: SparkSession, path: str) -> "Stored":
    """Open a stored tensor; the files' columns are checked, not their rows."""
    meta = check_metadata(json.loads(_read_text(spark, f"{path}/{SIDECAR}")))
    names = axes(len(meta["shape"]))
    d = D.dtype(meta["dtype"])
    wanted = ", ".join([*(f"{c} bigint" for c in names), f"v {d.sql}", "block bigint", "band bigint"])
    fs, _ = hadoop_path(spark, path)
    versions = sorted({0, *meta["bands"].values()})
    folders = [(k, f"{path}/v={k}") for k in versions if fs.exists(hadoop_path(spark, f"{path}/v={k}")[1])]
    out = None
    for k, folder in folders:
        reader = spark.read.format(meta["format"]).option("pathGlobFilter", f"*.{meta['format']}*")
        empty = not any(s.isDirectory() for s in fs.listStatus(hadoop_path(spark, folder)[1]))
        df = spark.createDataFrame([], wanted) if empty else reader.schema(wanted).load(folder)
        if not empty and meta["format"] == "parquet":
            found = {f.name: f.dataType.simpleString() for f in reader.load(folder).schema if f.name != "band"}
            kind = spark.createDataFrame([], f"v {d.sql}").schema["v"].dataType.simpleString()
            if found != {c: "bigint" for c in [*names, "block"]} | {"v": kind}:
                raise InvalidSchema(f"columns {found} of {path}")
        # Bands of other versions are left out by their folders' names.
        newer = [int(b) for b, v in meta["bands"].items() if v != k] if k == 0 else []
        mine = [int(b) for b, v in meta["bands"].items() if v == k] if k else []
        df = df.where(F.col("band").isin(mine)) if k else df.where(~F.col("band").isin(newer)) if newer else df
        out = df if out is None else out.unionByName(df)
    return Stored(out, meta, path)


class Stored(Tensor):
    """A tensor over files; ``block`` is a column of its frame, so that block reads are pushed down."""

    def __init__(self, df: DataFrame, meta: dict, path: str):
        super().__init__(df, "v", tuple(meta["shape"]), meta["dtype"], meta["sparse"], meta["axis"])
        self.meta, self.path = meta, path

    @property
    def geometry(self) -> G.StorageGeometry:
        return geometry_of(self, self.meta["capacity"])

    def validate(self) -> None:
        """Cells in bounds, once, all of a dense tensor, no stored zeros of a sparse one, blocks as computed."""
        check_cells(self)
        if self.sparse and not self.df.where(~D.not_zero(F.col("v"), self.dtype)).isEmpty():
            raise DataMismatch("stored zeros in a sparse tensor")
        block, _ = block_columns(self.geometry)
        if not self.frame.where(F.col("block") != block).isEmpty():
            raise DataMismatch("cells in the wrong block")

    def sync(self) -> None:
        """Nothing to do: a finished write is durable by Spark's commit protocol."""

    # Updates in the files: each returns the tensor as it is now.

    def update(self, updates: DataFrame) -> "Stored":
        """Cells (axis columns and v, each cell once) in place of the stored ones. Only their bands are written."""
        meta = dict(self.meta)
        updates = updates.select(*self.axes, F.col("v").cast(self.dtype.sql).alias("v")).withColumn("block", block_columns(self.geometry)[0])
        # No more numbers than there are bands.
        touched = sorted(r[0] for r in updates.select(_band(meta["band_blocks"])).distinct().collect())
        if not touched:
            return self
        own = self.frame.where(F.col("band").isin(touched)).select(*self.axes, "v", "block")
        rows = own.join(updates.select(*self.axes), self.axes, "left_anti").select(*self.axes, "v", "block").unionByName(updates)
        rows = rows.where(D.not_zero(F.col("v"), self.dtype)) if self.sparse else rows
        if json.loads(_read_text(self.spark, f"{self.path}/{SIDECAR}"))["version"] != meta["version"]:
            raise DataMismatch(f"{self.path} was changed since it was opened")
        meta["version"] += 1
        meta["bands"] = meta["bands"] | {str(b): meta["version"] for b in touched}
        _write_bands(rows, self.axes, meta, self.path)
        _write_text(self.spark, f"{self.path}/{SIDECAR}", json.dumps(meta))
        return load(self.spark, self.path)

    def write_value(self, coord, value) -> "Stored":
        coord = G.check_coord(self.shape, coord)
        return self.update(_updates(self, [(*coord, _sql_value(value, self.dtype))]))

    def write_values(self, ranges, values) -> "Stored":
        """As the function of this name."""
        return self.update(_selected(self, ranges, values))

    def write_through(self, steps: list[tuple], values: Tensor) -> "Stored":
        """An expression's values into the cells of a view of this tensor."""
        return self.update(updates_from(self, steps, values).select(*self.axes, "v"))

    def replace_block(self, block: int, values) -> "Stored":
        return self.update(_block_cells(self, self.geometry, block, list(values)))

    def stored_bands(self) -> list[int]:
        """Numbers of the bands with files, in order; from the folders' names."""
        fs, out = hadoop_path(self.spark, self.path)[0], set()
        for k in {0, *self.meta["bands"].values()}:
            _, folder = hadoop_path(self.spark, f"{self.path}/v={k}")
            names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
            out |= {int(n[5:]) for n in names if n.startswith("band=") and self.meta["bands"].get(n[5:], 0) == k}
        return sorted(out)

    def in_order(self, first: int = 0, last: int | None = None):
        """Frames of the rows from block ``first`` to ``last``, row-major over all of them: each has as many blocks as
        a band of usual size and is sorted in the one task that reads it, so nothing is shuffled."""
        size, run = self.meta["band_blocks"], max(1, BAND_CELLS // self.geometry.block_capacity)
        last = self.geometry.block_count - 1 if last is None else last
        for band in self.stored_bands():
            for a in range(max(first, band * size), min(last, (band + 1) * size - 1) + 1, run):
                b = min(a + run - 1, last, (band + 1) * size - 1)
                rows = self.frame.where((F.col("band") == band) & F.col("block").between(a, b))
                yield rows.coalesce(1).sortWithinPartitions("block", *self.axes)

    def vacuum(self) -> None:
        """Remove the folders of bands that this version does not read; tensors opened before lose theirs."""
        fs, _ = hadoop_path(self.spark, self.path)
        for version in fs.listStatus(hadoop_path(self.spark, self.path)[1]):
            name = version.getPath().getName()
            if not name.startswith("v="):
                continue
            for band in fs.listStatus(version.getPath()):
                b = band.getPath().getName()
                if b.startswith("band=") and self.meta["bands"].get(b[5:], 0) != int(name[2:]):
                    fs.delete(band.getPath(), True)


def sync_all(tensors) -> None:
    for t in tensors:
        t.sync()


def create_with_geometry(spark: SparkSession, path: str, shape, dtype="f64", sparse: bool = False, axis: int | None = None, capacity: int = G.BATCH, kind: str = "parquet") -> "Stored":
    """A stored tensor of zeros with blocks of a given capacity."""
    return write(create(spark, shape, dtype, sparse, axis), path, capacity, kind)


# Updates


def _updates(t: Tensor, rows: list) -> DataFrame:
    schema = ", ".join([*(f"{c} long" for c in t.axes), f"v {t.dtype.sql}"])
    return t.spark.createDataFrame(rows, schema)


def replaced(t: Tensor, updates: DataFrame) -> Tensor:
    """The tensor with the updates' cells in place of its own."""
    kept = t.df.join(updates.select(*t.axes), t.axes, "left_anti")
    return Tensor(kept.unionByName(updates.select(*t.axes, "v")), "v", t.shape, t.dtype, t.sparse, t.axis)


def write_value(t: Tensor, coord, value) -> Tensor:
    coord = G.check_coord(t.shape, coord)
    return replaced(t, _updates(t, [(*coord, _sql_value(value, t.dtype))]))


def _selection(shape, ranges) -> tuple[list[tuple[int, object]], int]:
    """(size, index of the k-th entry as a function of a column) of each axis of a selection, and its size."""
    from math import prod

    out = []
    for r in G.check_range(shape, ranges):
        if isinstance(r, G.At):
            out.append((1, lambda k, r=r: F.lit(r.index).cast("long")))
        elif isinstance(r, G.Of):
            out.append((len(r.indices), lambda k, r=r: F.element_at(F.array(*(F.lit(i).cast("long") for i in r.indices)), (k + 1).cast("int"))))
        else:
            out.append((-(-(r.stop - r.start) // r.step), lambda k, r=r: F.lit(r.start).cast("long") + k * r.step))
    return out, prod(n for n, _ in out)


def write_values(t: Tensor, ranges, values) -> Tensor:
    """Values in row-major order of the selection: a list, or a frame of ``seq`` (from 0) and ``v``. Of cells
    selected twice the later value holds."""
    return replaced(t, _selected(t, ranges, values))


def _selected(t: Tensor, ranges, values) -> DataFrame:
    """The cells of a selection with their values, each once."""
    parts, n = _selection(t.shape, ranges)
    if isinstance(values, DataFrame):
        given, found = values.select(F.col("seq").cast("long").alias("seq"), F.col("v").cast(t.dtype.sql).alias("v")), values.count()
    else:
        values = [(i, _sql_value(v, t.dtype)) for i, v in enumerate(values)]
        given, found = t.spark.createDataFrame(values, f"seq long, v {t.dtype.sql}"), len(values)
    if found != n:
        raise DataMismatch(f"{found} values for {n} cells")
    index = from_flat(F.col("seq"), [size for size, _ in parts])
    updates = given.select(*(of(k).alias(c) for c, k, (_, of) in zip(t.axes, index, parts)), "v", "seq")
    return updates.groupBy(*t.axes).agg(F.max_by("v", "seq").alias("v"))


def _shapes(base: Tensor, steps: list[tuple]) -> list[tuple[int, ...]]:
    shapes = [base.shape]
    t = base
    for name, args in steps:
        t = getattr(t, name)(*args)
        shapes.append(t.shape)
    return shapes


def resolve_base_coord(base: Tensor, steps: list[tuple], coord) -> tuple[int, ...]:
    """Coordinate in ``base`` of a coordinate of the view that ``steps`` make: (name, arguments) in order."""
    return _resolve(_shapes(base, steps), steps, coord)


def _resolve(shapes: list[tuple[int, ...]], steps: list[tuple], coord) -> tuple[int, ...]:
    coord = list(G.check_coord(shapes[-1], coord))
    for (name, args), shape in zip(reversed(steps), reversed(shapes[:-1])):
        if name == "transpose":
            p = G.check_permutation(len(shape), args[0] if args else None)
            coord = [coord[p.index(i)] for i in range(len(shape))]
        elif name == "flip":
            coord[args[0]] = shape[args[0]] - 1 - coord[args[0]]
        elif name == "squeeze":
            rest = iter(coord)
            coord = [0 if i in args[0] else next(rest) for i in range(len(shape))]
        elif name == "unsqueeze":
            at = [i + k for k, i in enumerate(sorted(args[0]))]
            coord = [c for i, c in enumerate(coord) if i not in at]
        elif name == "reshape":
            coord = list(G.coord_of(shape, G.flat_index(G.check_shape(args[0]), coord)))
        elif name == "broadcast":
            extra = len(coord) - len(shape)
            coord = [0 if n == 1 else c for n, c in zip(shape, coord[extra:])]
        elif name == "slice":
            rest = iter(coord)
            coord = [r.index if isinstance(r, G.At) else r.indices[next(rest)] if isinstance(r, G.Of) else r.start + next(rest) * r.step for r in G.check_range(shape, args)]
        else:
            raise InvalidSchema(f"no transform {name}")
    return tuple(coord)


def plan_updates(base: Tensor, steps: list[tuple], values, start: int = 0, capacity: int = G.BATCH) -> dict[int, list[tuple]]:
    """{block: [(offset, value)]} of row-major values of the view from flat index ``start`` on."""
    t = base
    for name, args in steps:
        t = getattr(t, name)(*args)
    if not t.supports_write_through:
        raise InvalidLayout("a gather or an expansion cannot be written through")
    g, out = geometry_of(base, capacity), {}
    for i, v in enumerate(values):
        if start + i >= t.size:
            raise DataMismatch(f"{start + i} of {t.size} cells")
        block, offset = g.block_position(resolve_base_coord(base, steps, G.coord_of(t.shape, start + i)))
        out.setdefault(block, []).append((offset, v))
    return out


def _base_columns(shapes: list[tuple[int, ...]], steps: list[tuple], columns: list[Column]) -> list[Column]:
    """Columns of the coordinate in the base, from those in the view; as ``_resolve`` for one coordinate."""
    for (name, args), shape in zip(reversed(steps), reversed(shapes[:-1])):
        if name == "transpose":
            p = G.check_permutation(len(shape), args[0] if args else None)
            columns = [columns[p.index(i)] for i in range(len(shape))]
        elif name == "flip":
            columns = [F.lit(n - 1) - c if i == args[0] else c for i, (c, n) in enumerate(zip(columns, shape))]
        elif name == "squeeze":
            rest = iter(columns)
            columns = [F.lit(0) if i in args[0] else next(rest) for i in range(len(shape))]
        elif name == "unsqueeze":
            at = [i + k for k, i in enumerate(sorted(args[0]))]
            columns = [c for i, c in enumerate(columns) if i not in at]
        elif name == "reshape":
            flat = sum((c * F.lit(s) for c, s in zip(columns, G.contiguous_strides(G.check_shape(args[0])))), F.lit(0).cast("long"))
            columns = from_flat(flat, shape)
        elif name == "slice":
            rest = iter(columns)
            columns = [F.lit(r.index) if isinstance(r, G.At) else F.lit(r.start) + next(rest) * r.step for r in G.check_range(shape, args)]
        elif name != "broadcast":
            raise InvalidSchema(f"no transform {name}")
    return columns


def updates_from(base: Tensor, steps: list[tuple], values: Tensor, capacity: int | None = None) -> DataFrame:
    """The cells of ``base`` that writing an expression through a view changes: axis columns, v, block, offset."""
    t = base
    for name, args in steps:
        t = getattr(t, name)(*args)
    if not t.supports_write_through:
        raise InvalidLayout("a gather or an expansion cannot be written through")
    if values.shape != t.shape or values.dtype != base.dtype:
        raise InvalidSchema(f"{values.dtype.name} {values.shape} through a view of {base.dtype.name} {t.shape}")
    columns = _base_columns(_shapes(base, steps), steps, [F.col(c) for c in values.axes])
    cells = values.full().select(*(c.cast("long").alias(f"b{i}") for i, c in enumerate(columns)), "v")
    cells = cells.toDF(*base.axes, "v")
    block, offset = block_columns(_geometry(base, capacity))
    return cells.withColumns({"block": block, "offset": offset})


def write_from(base: Tensor, steps: list[tuple], values: Tensor) -> Tensor:
    """``base`` with an expression's values in the cells of a view."""
    return replaced(base, updates_from(base, steps, values))


def logical_block_range(base: Tensor, steps: list[tuple], capacity: int = G.BATCH) -> tuple[int, int]:
    """Least and largest block that a view has cells in, the latter plus one.

    Axes add up to the flat index, as only contiguous views are reshaped; so each is looked at by itself: gathered
    ones at all indices, others at both ends.
    """
    shapes, g = _shapes(base, steps), geometry_of(base, capacity)
    # A gathered axis is no longer than its indices.
    longest = max((len(r.indices) for name, args in steps if name == "slice" for r in args if isinstance(r, G.Of)), default=0)
    low, high = [0] * len(shapes[-1]), [0] * len(shapes[-1])
    for i, n in enumerate(shapes[-1]):
        at = range(n) if n <= longest else (0, n - 1)
        by = {k: G.flat_index(base.shape, _resolve(shapes, steps, [k if j == i else 0 for j in range(len(low))])) for k in at}
        low[i], high[i] = min(by, key=by.get), max(by, key=by.get)
    first, last = (g.block_position(_resolve(shapes, steps, c))[0] for c in (low, high))
    return first, last + 1


# Blocks


def _geometry(t: Tensor, capacity: int | None) -> G.StorageGeometry:
    return geometry_of(t, capacity or (t.meta["capacity"] if isinstance(t, Stored) else G.BATCH))


def _numbered(t: Tensor, g: G.StorageGeometry) -> DataFrame:
    """Axis columns, v and block; of a stored tensor with these blocks its own column, which filters reach in the files."""
    if isinstance(t, Stored) and g == t.geometry:
        return t.frame.select(*t.axes, "v", "block")
    return t.df.withColumn("block", block_columns(g)[0])


def read_logical_blocks(t: Tensor, ids, capacity: int | None = None) -> DataFrame:
    """(block, offset, v) of the given blocks, zeros filled in."""
    g = _geometry(t, capacity)
    ids = [g.validate_block(b) for b in ids]
    if ids != sorted(set(ids)):
        raise InvalidCoord("block numbers must rise")
    wanted = t.spark.createDataFrame([(b, g.block_len(b)) for b in ids], "block long, n int")
    wanted = wanted.select("block", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("n") - 1).cast("long"))).alias("offset"))
    stored = _numbered(t, g).where(F.col("block").isin(ids)).select("block", block_columns(g)[1].alias("offset"), "v")
    return wanted.join(stored, ["block", "offset"], "left").select("block", "offset", F.coalesce("v", D.zero(t.dtype)).alias("v"))


def visit_blocks(t: Tensor, ids, visit, capacity: int | None = None) -> None:
    """Call visit(block, values) for each of the given blocks, one after another; a block has at most 4096 values."""
    rows = read_logical_blocks(t, ids, capacity).orderBy("block", "offset").toLocalIterator(prefetchPartitions=True)
    for block, group in groupby(rows, key=lambda r: r["block"]):
        visit(block, [python_value(r["v"], t.dtype) for r in group])


def _block_cells(t: Tensor, g: G.StorageGeometry, block: int, values: list) -> DataFrame:
    start, stop = g.block_range(block)
    if len(values) != stop - start:
        raise DataMismatch(f"{len(values)} values for a block of {stop - start}")
    return _updates(t, [(*G.coord_of(t.shape, start + i), _sql_value(v, t.dtype)) for i, v in enumerate(values)])


def replace_logical_block(t: Tensor, block: int, values, capacity: int | None = None) -> Tensor:
    g = _geometry(t, capacity)
    new = _block_cells(t, g, block, list(values))
    new = new.where(D.not_zero(F.col("v"), t.dtype)) if t.sparse else new
    kept = _numbered(t, g).where(F.col("block") != block).select(*t.axes, "v")
    return Tensor(kept.unionByName(new), "v", t.shape, t.dtype, t.sparse, t.axis)


def blocks_of(g: G.StorageGeometry, ranges) -> tuple[int, int]:
    """First and last block of a selection."""
    ends = [(r.index, r.index) if isinstance(r, G.At) else (min(r.indices), max(r.indices)) if isinstance(r, G.Of) else (r.start, r.stop - 1) for r in ranges]
    first, last = (g.block_position([e[k] for e in ends])[0] for k in (0, 1))
    return first, last


def occupied_blocks(t: Tensor, ranges=(), capacity: int | None = None) -> DataFrame:
    """Numbers of the blocks with a value other than zero within a selection, in order."""
    require_sparse(t, "occupied_blocks")
    g, ranges = _geometry(t, capacity), G.check_range(t.shape, ranges)
    first, last = blocks_of(g, ranges)
    rows = _numbered(t, g).where(F.col("block").between(first, last) & D.not_zero(F.col("v"), t.dtype))
    for i, r in enumerate(ranges):
        c = F.col(f"c{i}")
        if isinstance(r, G.At):
            rows = rows.where(c == r.index)
        elif isinstance(r, G.Of):
            rows = rows.where(c.isin(list(r.indices)))
        elif (r.start, r.stop, r.step) != (0, t.shape[i], 1):
            rows = rows.where(c.between(r.start, r.stop - 1) & ((c - r.start) % r.step == 0))
    return rows.select("block").distinct().orderBy("block")
