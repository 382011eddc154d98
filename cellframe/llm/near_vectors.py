"""Near-duplicate vectors by a pigeonhole join of subspaces.

Vectors are normalised and rotated (random signs and a Hadamard transform), so that their distance spreads evenly over
the components, and cut into blocks of ``BLOCK_DIMS``. Of two vectors with a cosine of t or more the squared distance
is at most 2 - 2t; so in one block at least it is within the block's share of that. Each block is range-joined by
itself: its rows are sorted along a space-filling curve and cut into chunks with bounding boxes; chunks meet by an
equi-join on the cells of a grid over their first two components and by the distance of their boxes; within a pair of
chunks the boxes of tiles are compared, then the block's distances. A pair counts in the first block that finds it,
which every task can tell from the two vectors; it is then verified by its exact cosine. Equal vectors are one class
with a count before all this.

Disk: so many blocks are dealt out at a time, and then so many pairs of chunks, as their vectors keep to ``ROUND_BYTES``,
or to what one block takes if that is more; what a round moved is gone before the next one. So the bytes moved grow with
the pairs that are compared, and those that lie on disk with the rows.

Nothing is emitted by pair: a pair of chunks gives its rows' numbers of links and one edge for each row into its part
of a component, so a group of near copies of any size gives as many rows as it has members. A chunk has at most
``CHUNK_ROWS`` rows, whatever group they are of. How much is compared depends on the vectors: clusters apart are not
compared, and evenly spread vectors are found apart only where there are many more of them than 2**BLOCK_DIMS chunks.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are kept;
vectors of different lengths do not link; repeated rows are links of each other; a null id takes part, and is no
smallest id unless all of a component are null; an empty table gives no rows; other columns are ignored. Components of
any size are scaled by powers of two, which is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components, kernels, scratch, skew

BLOCK_DIMS = 8
#: Rows of a chunk, and of a tile within it.
CHUNK_ROWS = 16384
TILE_ROWS = 1024
#: Candidates that are looked at together.
PAIRS = 1 << 16
#: Bytes of vectors that are under way to the pairs of chunks at a time, at least.
ROUND_BYTES = 512 << 20
#: By how much the squared distance's budget is widened, for rounding.
SLACK = 1e-9
#: By how much more the budget is widened where distances are first looked at as floats.
COARSE = 1e-5
#: Least side of a grid cell.
LEAST_SIDE = 0.05

_ROWS = "vec_id long, width int, key binary"
_PARTS = "width int, block int, curve long, node long, copies long, key binary"
_CHUNK = "chunk long, width int, block int, low array<double>, high array<double>, payload binary"
_MET = "node long, label long, links long"


def _usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """Rows of _ROWS; ``key`` (the components' bytes, doubles or floats as they come) is null if a vector cannot link."""
    kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    item = np.float32 if kind == "array<float>" else np.float64

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            sizes = np.asarray(lists.value_lengths().fill_null(0), np.int64)
            values = np.asarray(flat.fill_null(float("nan")), item) + item(0)  # no negative zero
            stop = np.cumsum(sizes)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            some = np.concatenate([[0], np.cumsum(values != 0)])
            good = (bad[stop] == bad[stop - sizes]) & (some[stop] > some[stop - sizes])
            data, size = values.tobytes(), item().itemsize
            keys = [data[(b - n) * size : b * size] if g else None for b, n, g in zip(stop.tolist(), sizes.tolist(), good.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int32)), pa.array(keys, pa.binary())], ["vec_id", "width", "key"])

    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("v")).mapInArrow(clean, _ROWS)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near 1."""
    _, power = np.frexp(np.abs(x).max(1, initial=0))
    return np.ldexp(x, -power[:, None])


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean; one component after another, so that a row's is the same in any company."""
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        total += x[:, k] * x[:, k]
    return np.sqrt(total)


def rotated(unit: np.ndarray) -> np.ndarray:
    """Signs and a Hadamard transform, after zeros to the next power of two; a row's is the same in any company."""
    n = 1 << max(0, unit.shape[1] - 1).bit_length()
    out = np.zeros((len(unit), n))
    out[:, : unit.shape[1]] = unit
    out *= np.random.default_rng(n).choice([-1.0, 1.0], n)
    half = 1
    while half < n:
        pairs = out.reshape(len(out), n // (2 * half), 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(out), n)
        half *= 2
    return out / np.sqrt(n)


def spans(n: int) -> list[tuple[int, int]]:
    """Blocks of a rotated vector of n components."""
    return [(a, min(n, a + BLOCK_DIMS)) for a in range(0, n, BLOCK_DIMS)]


def curve(x: np.ndarray) -> np.ndarray:
    """Place on a space-filling curve: the components' upper bits in turn."""
    bits = 56 // x.shape[1]
    cell = np.clip(((x + 0.5) * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1)
    out = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for k in range(x.shape[1]):
            out = out << 1 | (cell[:, k] >> b & 1)
    return out


def _numbers(keys: list[bytes], width: int) -> np.ndarray:
    kind = np.float32 if width and len(keys[0]) == 4 * width else np.float64
    return np.frombuffer(b"".join(keys), kind).reshape(len(keys), width).astype(np.float64)


def _split(classes: DataFrame, first: int, last: int) -> DataFrame:
    """Rows of _PARTS: each vector once for each block from ``first`` up to ``last``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths).tolist():
                part = batch.take(pa.array(np.flatnonzero(widths == width)))
                x = scaled(_numbers(part.column("key").to_pylist(), width))
                y = rotated(x / lengths(x)[:, None])
                for b, (a, z) in list(enumerate(spans(y.shape[1])))[first:last]:
                    n = len(y)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, width, np.int32)), pa.array(np.full(n, b, np.int32)), pa.array(curve(y[:, a:z])), part.column("node"), part.column("copies"), part.column("key")],
                        ["width", "block", "curve", "node", "copies", "key"],
                    )

    return classes.mapInArrow(run, _PARTS)


def _chunks(parts: DataFrame, rows: int) -> DataFrame:
    """Rows of _CHUNK, of parts that are sorted within their partitions."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, held, of = TaskContext.get().partitionId(), 0, [], None

        def flush() -> pa.RecordBatch:
            nonlocal count, held
            table, held = pa.Table.from_batches(held).select(["node", "copies", "key"]), []
            width, b = of
            x = scaled(_numbers(table.column("key").to_pylist(), width))
            y = rotated(x / lengths(x)[:, None])
            y = y[:, slice(*spans(y.shape[1])[b])]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as w:
                w.write_table(table)
            count += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + count]), pa.array([width], pa.int32()), pa.array([b], pa.int32()), pa.array([y.min(0).tolist()]), pa.array([y.max(0).tolist()]), pa.array([sink.getvalue().to_pybytes()])],
                ["chunk", "width", "block", "low", "high", "payload"],
            )

        for batch in batches:
            key = batch.column("width").to_numpy().astype(np.int64) << 32 | batch.column("block").to_numpy()
            at = 0
            while at < len(key):
                here = (int(key[at]) >> 32, int(key[at]) & 0xFFFFFFFF)
                if held and (here != of or sum(map(len, held)) >= rows):
                    yield flush()
                of = here
                other = np.flatnonzero(key[at:] != key[at])
                stop = min(at + (int(other[0]) if len(other) else len(key)), len(key), at + rows - sum(map(len, held)))
                held.append(batch.slice(at, stop - at))
                at = stop
        if held:
            yield flush()
        kernels.release()

    return parts.mapInArrow(cut, _CHUNK)


def budget(n: int, a: int, z: int, threshold: float) -> float:
    """Share of the squared distance that a block of a rotated vector of n components has."""
    return (2.0 - 2.0 * threshold + SLACK) * (z - a) / n


def _met(chunks: DataFrame, threshold: float) -> DataFrame:
    """(pair, a, b): pairs of chunks of a block whose boxes are near enough, a <= b."""
    n = F.expr("shiftleft(1, cast(ceil(log2(greatest(width, 1)) - 1e-9) as int))")
    dims = F.size("low")
    reach = F.lit(2.0 - 2.0 * threshold + SLACK) * dims / n
    c = chunks.select("chunk", "width", "block", "low", "high", reach.alias("reach"))
    side, half = F.greatest(F.sqrt("reach"), F.lit(LEAST_SIDE)), F.sqrt("reach") / 2 + 1e-6

    def cells(k: int, name: str):
        first, last = (F.floor((F.coalesce(F.get(e, F.lit(k)), F.lit(0.0)) + s * half) / side) for e, s in (("low", -1), ("high", 1)))
        return first.alias(f"{name}_from"), last.alias(f"{name}_to")

    c = c.select("*", *cells(0, "x"), *cells(1, "y"))
    c = c.withColumn("x", F.explode(F.sequence("x_from", "x_to"))).withColumn("y", F.explode(F.sequence("y_from", "y_to")))
    other = c.select("width", "block", "x", "y", F.col("chunk").alias("b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"), F.col("x_from").alias("xb"), F.col("y_from").alias("yb"))
    both = c.join(other, ["width", "block", "x", "y"]).where("chunk <= b and x = greatest(x_from, xb) and y = greatest(y_from, yb)")
    gap = F.expr(
        "aggregate(sequence(0, size(low) - 1), 0D, (s, i) -> s + pow(greatest(0D, low[i] - high_b[i], low_b[i] - high[i]), 2))"
    )
    return both.where(gap <= F.col("reach") + 1e-9).select(F.col("chunk").alias("a"), "b")


class _Side:
    """A chunk's classes, with all that their comparison needs."""

    def __init__(self, payload, width: int, block: int):
        table = pa.ipc.open_stream(payload.as_buffer()).read_all()
        self.node, self.copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        self.x = scaled(_numbers(table.column("key").to_pylist(), width))
        self.length = lengths(self.x)
        self.unit = self.x / self.length[:, None]
        self.y = rotated(self.unit)
        a, z = spans(self.y.shape[1])[block]
        self.part = np.ascontiguousarray(self.y[:, a:z])
        square, one = (self.part * self.part).sum(1), np.ones(len(self.part))
        # Squared distances by one product; rounding to floats is far below COARSE.
        self.rows = np.column_stack([-2.0 * self.part, square, one]).astype(np.float32)
        self.columns = np.column_stack([self.part, one, square]).astype(np.float32)
        self.starts = range(0, len(self.x), TILE_ROWS)
        self.low, self.high = (np.array([f(self.part[s : s + TILE_ROWS], axis=0) for s in self.starts]) for f in (np.min, np.max))


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of rows, one component after another."""
    total = np.zeros(len(p))
    for k in range(p.shape[1]):
        d = p[:, k] - q[:, k]
        total += d * d
    return total


def _verified(a: _Side, b: _Side, i: np.ndarray, j: np.ndarray, block: int, threshold: float, cosines: np.ndarray | None) -> np.ndarray:
    """Which candidates count here (no earlier block finds them) and have the cosine."""
    n = a.y.shape[1]
    shares = spans(n)
    here = np.flatnonzero(_apart(a.part[i], b.part[j]) <= budget(n, *shares[block], threshold))
    for s, z in shares[:block]:
        here = here[_apart(a.y[i[here], s:z], b.y[j[here], s:z]) > budget(n, s, z, threshold)]
    cos = np.einsum("ij,ij->i", a.unit[i[here]], b.unit[j[here]]) if cosines is None else cosines[here]
    near = np.flatnonzero(np.abs(cos - threshold) < 1e-9)
    if len(near):
        p, q = i[here[near]], j[here[near]]
        dot = np.zeros(len(near))
        for k in range(a.x.shape[1]):
            dot += a.x[p, k] * b.x[q, k]
        cos[near] = dot / (a.length[p] * b.length[q])
    return here[cos >= threshold]


def _hook(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of i and j; a set's label is its least member."""
    while True:
        p, q = label[i], label[j]
        differ = p != q
        if not differ.any():
            return
        least = np.minimum(p, q)[differ]
        np.minimum.at(label, p[differ], least)
        np.minimum.at(label, q[differ], least)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def _where(at: np.ndarray) -> np.ndarray:
    """Flat places of what is true, which is seldom: eight are looked at together."""
    flat = np.ascontiguousarray(at).ravel()
    whole = len(flat) // 8 * 8
    some = (np.flatnonzero(flat[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([some[flat[some]], np.flatnonzero(flat[whole:]) + whole])


def compare(a: _Side, b: _Side, block: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (counted with copies) and labels of a's rows and then b's; with itself, those of a."""
    own = a is b
    shift = 0 if own else len(a.x)
    links, label = np.zeros(shift + len(b.x), np.int64), np.arange(shift + len(b.x))
    n = a.y.shape[1]
    reach = budget(n, *spans(n)[block], threshold)
    for s, start in enumerate(a.starts):
        gap = np.maximum(0, np.maximum(a.low[s] - b.high, b.low - a.high[s]))
        for t in np.flatnonzero((gap * gap).sum(1) <= reach + 1e-9).tolist():
            if own and t < s:
                continue
            r, c = slice(start, start + TILE_ROWS), slice(b.starts[t], b.starts[t] + TILE_ROWS)
            at = a.rows[r] @ b.columns[c].T <= np.float32(reach + COARSE)
            if own and t == s:
                at = np.triu(at, 1)
            i, j = np.divmod(_where(at), at.shape[1])
            # Where much of a tile is near, one product gives all cosines.
            cosines = (a.unit[r] @ b.unit[c].T)[i, j] if len(i) * 16 > at.size else None
            for k in range(0, len(i), PAIRS):
                p, q = i[k : k + PAIRS] + start, j[k : k + PAIRS] + b.starts[t]
                found = _verified(a, b, p, q, block, threshold, None if cosines is None else cosines[k : k + PAIRS])
                p, q = p[found], q[found]
                links += np.bincount(p, b.copies[q], len(links)).astype(np.int64)
                links += np.bincount(q + shift, a.copies[p], len(links)).astype(np.int64)
                _hook(label, p, q + shift)
    return links, label


def _found(chunks: DataFrame, threshold: float, most: int, name: str) -> list[scratch.Table]:
    """Tables of _MET: links and labels of the pairs of chunks that meet. A table is made of as many pairs as have
    ``most`` bytes of vectors."""
    met = scratch.Table(_met(chunks, threshold).withColumn("pair", F.monotonically_increasing_id()), name)
    sides = met.df.select("pair", F.explode(F.array_distinct(F.array("a", "b"))).alias("chunk"))
    sizes = chunks.select("chunk", F.octet_length("payload").alias("size"))
    total, pairs = sides.join(sizes, "chunk").agg(F.sum("size"), F.count_distinct("pair")).first()
    rounds = max(1, -(-(total or 0) // most))

    def match(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("chunk").to_numpy())
        width, block = table.column("width")[0].as_py(), table.column("block")[0].as_py()
        of = [_Side(table.column("payload")[int(k)], width, block) for k in order]
        links, label = compare(of[0], of[-1], block, threshold)
        node = np.concatenate([s.node for s in of])
        some = np.flatnonzero(links)
        kernels.release()
        return pa.table({"node": node[some], "label": node[label[some]], "links": links[some]})

    out = []
    for k in range(rounds):
        own = sides.where(F.pmod(F.xxhash64("pair"), F.lit(rounds)) == k) if rounds > 1 else sides
        # A round has few rows of sides, so chunks go to their pairs at once; a pair has mostly a task of its own.
        own = (F.broadcast(own) if rounds > 1 else own).join(chunks.select("chunk", "width", "block", "payload"), "chunk")
        own = own.repartition(4 * -(-pairs // rounds), "pair") if rounds > 1 else own
        out.append(scratch.Table(own.groupBy("pair").applyInArrow(match, _MET), name))
    met.drop()
    return out


def near_vectors(vectors: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", vector: str = "embedding", name: str = "vectors", rows: int = CHUNK_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    given = _usable(vectors, vec_id, vector)
    spark = vectors.sparkSession
    salted = given.where("key is not null").withColumn("_salt", skew.salt("vec_id"))
    classes = salted.groupBy("width", "key").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), skew.salts_used().alias("used"))
    classes = scratch.Table(classes.withColumn("node", F.monotonically_increasing_id()), name).df
    size = F.octet_length("key") + 16
    n, most, width = classes.agg(F.count(F.lit(1)), F.sum(size), F.max("width")).first()
    together = max(1, ROUND_BYTES // (most or 1))
    blocks = len(spans(1 << max(0, (width or 1) - 1).bit_length()))
    found = []
    for first in range(0, blocks, together):
        last = min(first + together, blocks)
        # As many partitions as there are chunks, if those are fewer than usual.
        parts = max(1, min(scratch.partitions(spark), -(-n * (last - first) // rows)))
        sorted_ = _split(classes.select("width", "node", "copies", "key"), first, last).repartitionByRange(parts, "width", "block", "curve", "node").sortWithinPartitions("width", "block", "curve", "node")
        chunks = scratch.Table(_chunks(sorted_, rows), name, batch=8192)
        found += _found(chunks.df, threshold, max(ROUND_BYTES, most or 0), name)
        chunks.drop()
    found = scratch.together(found, spark, _MET)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    label = components.components(found.select(F.col("node").alias("a"), F.col("label").alias("b")), name)
    known = classes.join(links, "node", "left").join(label, "node", "left")
    known = known.withColumn("root", F.coalesce("label", "node"))
    known = skew.with_groups(known, ["root"], ["node"], component_id=F.min("least"))
    known = known.select("width", "key", "used", "component_id", (F.coalesce("links", F.lit(0).cast("long")) + F.col("copies") - 1).alias("n_links"))
    linked = skew.same(salted, skew.spread(known, "used"), ["width", "key"]).select("vec_id", "n_links", "component_id")
    alone = given.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op13_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP13_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
),
reach AS (
  SELECT vec_id AS a, vec_id AS c FROM embeddings
  UNION
  SELECT links.a, reach.c FROM reach JOIN links ON links.b = reach.a
),
least AS (SELECT a, min(c) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON least.a = vec_id
"""
