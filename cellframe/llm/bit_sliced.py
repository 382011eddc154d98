"""Exact top-k inner products on a bit-sliced index.

Vectors are scaled and floored to integers. The index is a table of blocks of rows; a block keeps the most significant
bits of each component as bitmaps over its rows (slices), from its least to its largest number, and the whole vectors
and ids beside them. For a query, the slices are added up with its bits as weights by bitmap arithmetic (carry-save adders), components with a
negative weight by their complements; that gives a lower bound of each row's score, again as slices, and the
error has a known bound. The k-th best bound is found from the most significant slice downward, and the rows that
can still reach it are resolved exactly with the whole integers. Queries meet all rows, in blocks of both: the
queries are broadcast up to ``BROADCAST_BYTES``; more of them meet the index on a grid of parts of both sides.

Edge cases: vectors that are null, or have null or non-finite components, take no part; all finite ones do, and
are compared as exact integers of any size; vectors meet only those of their own length; ties go to the smaller id; a
row is not its own candidate, but others with its id are; repeated query rows each get their rows; fewer candidates
give fewer rows; a score past the range of a long is ranked by what it is and shown as the end of that range; an
empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks, scratch

#: Rows of an index block, and queries that meet it at a time.
BLOCK_ROWS = 8192
QUERY_ROWS = 256
#: Most significant bits of a component that are sliced.
SLICES = 6
#: Bytes of queries that are broadcast at most.
BROADCAST_BYTES = 64 << 20

_TABLE = "block long, width int, n int, ids binary, vectors binary, low string, shift int, bits int, slices binary"
_ASKED = "block long, width int, n int, ids binary, vectors binary, own_block binary, own_row binary"
_FOUND = "query long, query_id long, vec_id long, score long, key binary"


def _blocks(vectors: DataFrame, rows: int, scale: int) -> DataFrame:
    """Rows of _TABLE: ids, components (as doubles) and slices of up to ``rows`` vectors of one length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, held = TaskContext.get().partitionId(), 0, {}

        def flush(width: int) -> pa.RecordBatch:
            nonlocal count
            ids, data = zip(*held.pop(width))
            ids, data = np.concatenate(ids), np.concatenate(data)
            count += 1
            low, shift, bits, slices = sliced(whole(data, scale))
            return blocks.rows(_TABLE, [[(part << 32) + count], [width], [len(ids)], [ids.tobytes()], [data.tobytes()], [str(low)], [shift], [bits], [slices.tobytes()]])

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            offsets = np.asarray(lists.offsets)
            flat = np.asarray(lists.values.slice(0, len(lists.values)))
            sizes = np.diff(offsets)
            for width in np.unique(sizes).tolist():
                of = np.flatnonzero(sizes == width)
                data = flat[offsets[of][:, None] + np.arange(width)].astype(np.float64).reshape(len(of), width)
                for a in range(0, len(of), rows):
                    held.setdefault(width, []).append((ids[of[a : a + rows]], data[a : a + rows]))
                    if sum(len(x) for x, _ in held[width]) >= rows:
                        yield flush(width)
        for width in list(held):
            yield flush(width)

    return vectors.mapInArrow(cut, _TABLE)


def _queries(index: DataFrame, every: int, rows: int) -> DataFrame:
    """Rows of _ASKED: the vectors of the index whose id is divisible by ``every``, and the place of each in the index."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, held = TaskContext.get().partitionId(), 0, {}

        def flush(width: int) -> pa.RecordBatch:
            nonlocal count
            parts = [np.concatenate(x) for x in zip(*held.pop(width))]
            count += 1
            return blocks.rows(_ASKED, [[(part << 32) + count], [width], [len(parts[0])], *([x.tobytes()] for x in parts)])

        for batch in batches:
            for block, width, ids, data in zip(*(batch.column(i) for i in range(4))):
                width, ids = width.as_py(), np.frombuffer(ids.as_buffer(), np.int64)
                of = np.flatnonzero(ids % every == 0)
                data = np.frombuffer(data.as_buffer(), np.float64).reshape(len(ids), width)
                for a in range(0, len(of), rows):
                    some = of[a : a + rows]
                    held.setdefault(width, []).append((ids[some], data[some], np.full(len(some), block.as_py()), some))
                    if sum(len(x[0]) for x in held[width]) >= rows:
                        yield flush(width)
        for width in list(held):
            yield flush(width)

    return index.select("block", "width", "ids", "vectors").mapInArrow(cut, _ASKED)


def sliced(values: np.ndarray) -> tuple[int, int, int, np.ndarray]:
    """Least number, lower bits that are left out, bits that are kept, and these as slices."""
    low, high = (int(f(values.ravel())) if values.size else 0 for f in (np.min, np.max))
    total = max(1, (high - low).bit_length())
    bits = min(SLICES, total)
    return low, total - bits, bits, _slices(values, low, total - bits, bits)


def _slices(values: np.ndarray, low: int, shift: int, bits: int) -> np.ndarray:
    """[component, bit, word]: bitmaps over the rows of the upper bits of value - low."""
    n, width = values.shape
    upper = ((values - low) >> shift).T.astype(np.int64)
    words = -(-n // 64)
    out = np.zeros((width, bits, words * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits(((upper >> b) & 1).astype(np.uint8), axis=1, bitorder="little")
        out[:, b, : packed.shape[1]] = packed
    return out.view(np.uint64)


def _add_up(columns: dict[int, list[np.ndarray]], words: int) -> list[np.ndarray]:
    """Sum of bitmaps by weight: full adders turn three of a weight into one and a carry."""
    out, at = [], 0
    while columns and at <= max(columns):
        rows = columns.pop(at, [])
        stack = np.concatenate([r.reshape(-1, words) for r in rows]) if rows else np.zeros((0, words), np.uint64)
        while len(stack) > 1:
            m = len(stack) // 3
            if m:
                a, b, c = stack[:m], stack[m : 2 * m], stack[2 * m : 3 * m]
                half = a ^ b
                carry, stack = (a & b) | (half & c), np.concatenate([half ^ c, stack[3 * m :]])
            else:
                carry, stack = (stack[:1] & stack[1:]), stack[:1] ^ stack[1:]
            columns.setdefault(at + 1, []).append(carry)
        out.append(stack[0] if len(stack) else np.zeros(words, np.uint64))
        at += 1
    return out


def _count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def kth_largest(sums: list[np.ndarray], rows: np.ndarray, k: int) -> int:
    """The k-th largest of the sliced numbers of ``rows``, from the most significant slice downward."""
    value = 0
    for i in range(len(sums) - 1, -1, -1):
        ones = rows & sums[i]
        if (n := _count(ones)) >= k:
            value, rows = value | 1 << i, ones
        else:
            k, rows = k - n, rows & ~sums[i]
    return value


def at_least(sums: list[np.ndarray], rows: np.ndarray, limit: int) -> np.ndarray:
    """The rows whose sliced number is not below ``limit``."""
    if limit <= 0:
        return rows
    if limit >> len(sums):
        return rows & np.uint64(0)
    more, same = np.zeros_like(rows), rows
    for i in range(len(sums) - 1, -1, -1):
        if limit >> i & 1:
            same = same & sums[i]
        else:
            more, same = more | (same & sums[i]), same & ~sums[i]
    return more | same


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles: int64 if all are below 2**62, else Python integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(vectors * scale)
    if not (np.abs(scaled) >= 2.0**62).any():
        return scaled.astype(np.int64)
    return np.array([int(y) if np.isfinite(y) else int(x) * scale for x, y in zip(vectors.ravel().tolist(), scaled.ravel().tolist())], object).reshape(vectors.shape)


def products(values: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products as they are: int64 where no sum can leave its range, else Python integers."""
    bound = int(abs(values).max(initial=0)) * int(abs(q).sum()) if len(q) else 0
    if values.dtype == q.dtype == np.int64 and bound < 2**63:
        return values @ q
    return values.astype(object) @ q.astype(object) if len(q) else np.zeros(len(values), np.int64)


def sort_key(score: int) -> bytes:
    """Bytes in the order of the integers."""
    n = max(1, -(-abs(score).bit_length() // 8))
    size = n.to_bytes(3, "big") + abs(score).to_bytes(n, "big")
    return b"\1" + size if score >= 0 else b"\0" + bytes(255 - x for x in size)


def top_of_block(values: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, shift: int, plain: np.ndarray):
    """(query number, ids, scores) of each query's k best rows of the block. own: the query's row here, or -1."""
    n = len(values)
    bits, words = plain.shape[1:]
    flipped = ~plain
    rows = np.zeros(words * 8, np.uint8)
    rows[: -(-n // 8)] = np.packbits(np.ones(n, np.uint8), bitorder="little")
    rows = rows.view(np.uint64)
    for j, q in enumerate(queries):
        size = abs(q)
        columns: dict[int, list[np.ndarray]] = {}
        for bit in range(int(size.max(initial=0)).bit_length()):
            on = ((size >> bit) & 1).astype(bool)
            for sign, slices in ((q > 0, plain), (q < 0, flipped)):
                of = np.flatnonzero(sign & on)
                if len(of):
                    for b in range(bits):
                        columns.setdefault(bit + b, []).append(slices[of, b])
        sums = _add_up(columns, words)
        # In units of 2**shift, each component's bound is low by less than one.
        slack = sum(map(int, size)) if shift else 0
        wanted = min(n, k + int(own[j] >= 0))
        found = at_least(sums, rows, kth_largest(sums, rows, wanted) - slack)
        of = np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little")[:n])
        of = of[of != own[j]]
        score = products(values[of], q)
        best = np.array(sorted(range(len(of)), key=lambda i: (-score[i], ids[of[i]]))[:k], int) if score.dtype == object else np.lexsort((ids[of], -score))[:k]
        yield j, ids[of][best], score[best]


def _met(index: DataFrame, queries: DataFrame, n_bytes: int, n_blocks: int) -> DataFrame:
    """Every block of rows with every block of queries of its width."""
    if n_bytes <= BROADCAST_BYTES:
        spread = index.repartition(max(1, min(scratch.partitions(index.sparkSession), n_blocks)), "block")
        return spread.join(F.broadcast(queries), "width")
    parts, groups = scratch.partitions(index.sparkSession), -(-n_bytes // max(1, BROADCAST_BYTES))
    left = index.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts))).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = queries.withColumn("group", F.pmod(F.xxhash64("qb"), F.lit(groups)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return left.join(right, ["width", "part", "group"])


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, vec_id: str = "vec_id", vector: str = "embedding", name: str = "topk") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of each vector whose id is divisible by ``every``."""
    number = F.col(vector).cast("array<double>")
    good = ~F.exists(number, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(vector).isNotNull() & F.col(vec_id).isNotNull()).where(good)
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), number.alias("v"))
    index = scratch.Table(_blocks(rows, BLOCK_ROWS, scale), name).df
    asked = scratch.Table(_queries(index, every, QUERY_ROWS), name).df
    n_bytes = asked.agg(F.sum(3 * F.octet_length("ids") + F.octet_length("vectors")).alias("n")).first()["n"] or 0

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, width, here, ids, data, shift, bits, slices, theirs, ours, own_block, own_row in zip(*(batch.column(i) for i in range(12))):
                width = width.as_py()
                # Ids and vectors of queries are "theirs" and "ours"; those of the index block are "ids" and "data".
                ids, theirs, own_block, own_row = (np.frombuffer(x.as_buffer(), np.int64) for x in (ids, theirs, own_block, own_row))
                data, ours = (whole(np.frombuffer(x.as_buffer(), np.float64).reshape(n, width), scale) for x, n in ((data, len(ids)), (ours, len(theirs))))
                plain = np.frombuffer(slices.as_buffer(), np.uint64).reshape(width, bits.as_py(), -1 if width else 8 * -(-len(ids) // 64) // 8)
                out = []
                for j, best, score in top_of_block(data, ids, ours, np.where(own_block == here.as_py(), own_row, -1), k, shift.as_py(), plain):
                    out += [(block.as_py() * QUERY_ROWS + j, theirs[j], i, max(-(2**63), min(2**63 - 1, s)), sort_key(s)) for i, s in zip(best.tolist(), score.tolist())]
                columns = list(zip(*out)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())], ["query", "query_id", "vec_id", "score", "key"])

    queries = asked.select(F.col("block").alias("qb"), "width", F.col("ids").alias("qi"), F.col("vectors").alias("qv"), "own_block", "own_row")
    met = _met(index, queries, n_bytes, index.count()).select("qb", "width", "block", "ids", "vectors", "shift", "bits", "slices", "qi", "qv", "own_block", "own_row")
    # A row of these is as large as a block of vectors.
    found = scratch.Table(met.mapInArrow(search, _FOUND), name, batch=8).df
    best = Window.partitionBy("query", "query_id").orderBy(F.desc("key"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP7_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score
FROM (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank
  FROM (
    SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.r <> c.r AND len(q.e) = len(c.e)
  )
)
WHERE rank <= 10
"""
