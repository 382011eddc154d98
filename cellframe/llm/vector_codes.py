"""Product codes of vectors, fitted on distinct parts.

Vectors become integers and are cut into ``PARTS`` parts. The parts of each position are deduplicated, first within a
block of vectors and then over all, into distinct rows with counts; Lloyd's rounds run over these rows with their
counts as weights: each chunk of distinct rows finds the nearest entries of its position's codebook and adds up its
own, and a codebook takes the sums of all chunks. Codes and errors are then joined back: a block of vectors asks for
each of its distinct parts once, so a part that a third of all vectors share is asked for once by each block.

Codebooks have at most ``ENTRIES`` entries for each position; they meet the chunks by a join on the position and a
salt, and only their numbers of rows, never those of the data, decide what a task holds.

Edge cases: vectors that are null or hold null or non-finite components are left out; vectors of each length are
coded by themselves, with codebooks and their hash of their own; the parts of a length that 16 does not divide differ
by one component, and may be empty; of fewer vectors than entries each starts one; null ids come last among the
first, and vectors with one id in the order of their components; repeated rows each count; integers of any size are
exact, an error past the range of a long is shown as its end; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks, kernels, scratch, skew
from .bit_sliced import whole

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Vectors of a block, and distinct parts of a chunk.
BLOCK_ROWS = 8192
CHUNK_ROWS = 1 << 16
#: Integers below are multiplied as doubles, and below the other as longs, without rounding or overflow.
EXACT, SMALL = 1 << 20, 1 << 27
_MOST = 2**63 - 1

_BLOCK = "block long, width int, n int, rows binary, vectors binary"
_ASKED = "block long, width int, pos int, part binary, at int, n long"
_CHUNK = "chunk long, width int, pos int, rows binary"
_SUMS = "width int, pos int, entry int, value string, n long"
_CODED = "width int, pos int, part binary, used long, code int, dist string"
_OUT = "vec_id long, label string, code string, error string, width int"


def cuts(width: int, parts: int = PARTS) -> list[tuple[int, int]]:
    return [(i * width // parts, (i + 1) * width // parts) for i in range(parts)]


def encode(x: np.ndarray) -> list[bytes]:
    """Rows of integers as bytes, the same for equal rows: longs, or where one is too large a text whose length no
    row of longs has."""
    if x.dtype != object:
        data, size = np.ascontiguousarray(x, np.int64).tobytes(), 8 * x.shape[1]
        return [data[i * size : (i + 1) * size] for i in range(len(x))]
    return [np.array(r, np.int64).tobytes() if all(abs(v) < SMALL for v in r) else _text(r) for r in x.tolist()]


def _text(row: list[int]) -> bytes:
    out = ",".join(map(str, row)).encode()
    return out + b" " * (len(out) % 8 == 0)


def decode(rows: list[bytes], size: int) -> np.ndarray:
    """Integers of ``encode``; as Python's if any row has large ones."""
    if all(len(r) % 8 == 0 for r in rows):
        return np.frombuffer(b"".join(rows), np.int64).reshape(len(rows), size)
    out = [list(map(int, r.split(b","))) if len(r) % 8 else np.frombuffer(r, np.int64).tolist() for r in rows]
    return np.array(out, object).reshape(len(rows), size)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest row of ``entries`` (the lowest of equals) and the squared distance, exact."""
    most = max((int(abs(a).max(initial=0)) for a in (x, entries)), default=0)
    if most < EXACT and x.shape[1] < 1 << 10:
        p, q = x.astype(np.float64), entries.astype(np.float64)
        far = (p * p).sum(1)[:, None] + (q * q).sum(1)[None] - 2.0 * (p @ q.T)
        code = far.argmin(1)
        return code, far[np.arange(len(x)), code].astype(np.int64)
    kind = np.int64 if most < SMALL and x.shape[1] < 64 else object
    p, q = x.astype(kind), entries.astype(kind)
    far = np.zeros((len(p), len(q)), kind)
    for k in range(p.shape[1]):
        d = p[:, k, None] - q[None, :, k]
        far = far + d * d
    code = np.array([min(range(len(r)), key=r.__getitem__) for r in far.tolist()], np.int64) if kind is object else far.argmin(1)
    return code, far[np.arange(len(p)), code]


def _blocks(rows: DataFrame, n_rows: int) -> DataFrame:
    """Rows of _BLOCK: ids, labels and components of up to ``n_rows`` usable vectors of one length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, held = TaskContext.get().partitionId(), 0, {}

        def flush(width: int) -> pa.RecordBatch:
            nonlocal count
            tables, data = zip(*held.pop(width))
            table = pa.Table.from_batches(tables)
            count += 1
            return blocks.rows(_BLOCK, [[(part << 32) + count], [width], [table.num_rows], [blocks.pack(table)], [np.concatenate(data).tobytes()]])

        for batch in batches:
            lists = batch.column(2)
            offsets = np.asarray(lists.offsets)
            flat = np.asarray(lists.values.slice(0, len(lists.values)))
            sizes = np.diff(offsets)
            for width in np.unique(sizes).tolist():
                of = np.flatnonzero(sizes == width)
                for a in range(0, len(of), n_rows):
                    some = of[a : a + n_rows]
                    data = flat[offsets[some][:, None] + np.arange(width)].astype(np.float64).reshape(len(some), width)
                    held.setdefault(width, []).append((batch.take(pa.array(some)).select(["vec_id", "label"]), data))
                    if sum(len(x) for _, x in held[width]) >= n_rows:
                        yield flush(width)
        for width in list(held):
            yield flush(width)

    return rows.mapInArrow(cut, _BLOCK)


def _vectors(width: int, n: int, data, scale: int) -> np.ndarray:
    return whole(np.frombuffer(data.as_buffer(), np.float64).reshape(n, width), scale)


def _distinct(x: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct rows in the order of their bytes, the place of each row among them, their counts."""
    keys = np.array(encode(x), object)
    if not len(keys):
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    known, at, n = np.unique(keys, return_inverse=True, return_counts=True)
    return known.tolist(), at, n


def _asked(index: DataFrame, parts: int, scale: int) -> DataFrame:
    """Rows of _ASKED: a block's distinct parts of each position."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, width, n, data in zip(*(batch.column(c) for c in ("block", "width", "n", "vectors"))):
                block, width = block.as_py(), width.as_py()
                x = _vectors(width, n.as_py(), data, scale)
                for pos, (a, z) in enumerate(cuts(width, parts)):
                    known, _, count = _distinct(x[:, a:z])
                    m = len(known)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block] * m, pa.int64()), pa.array([width] * m, pa.int32()), pa.array([pos] * m, pa.int32()), pa.array(known, pa.binary()), pa.array(range(m), pa.int32()), pa.array(count, pa.int64())],
                        ["block", "width", "pos", "part", "at", "n"],
                    )

    return index.mapInArrow(ask, _ASKED)


def _chunked(distinct: DataFrame) -> DataFrame:
    """Rows of _CHUNK, of distinct parts that are sorted by position within their partitions."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, held, of = TaskContext.get().partitionId(), 0, [], None

        def flush() -> pa.RecordBatch:
            nonlocal count, held
            table, held = pa.Table.from_batches(held).select(["part", "n", "used"]), []
            count += 1
            return blocks.rows(_CHUNK, [[(part << 32) + count], [of[0]], [of[1]], [blocks.pack(table)]])

        for batch in batches:
            key = batch.column("width").to_numpy().astype(np.int64) << 32 | batch.column("pos").to_numpy()
            at = 0
            while at < len(key):
                here = (int(key[at]) >> 32, int(key[at]) & 0xFFFFFFFF)
                if held and (here != of or sum(map(len, held)) >= CHUNK_ROWS):
                    yield flush()
                of = here
                other = np.flatnonzero(key[at:] != key[at])
                stop = at + int(other[0]) if len(other) else len(key)
                held.append(batch.slice(at, stop - at))
                at = stop
        if held:
            yield flush()

    return distinct.mapInArrow(cut, _CHUNK)


def _first(index: DataFrame, parts: int, entries: int, scale: int) -> DataFrame:
    """width, pos, entry, value: the parts of the vectors with the smallest ids. Each block names its own smallest."""

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, n, rows, data in zip(*(batch.column(c) for c in ("width", "n", "rows", "vectors"))):
                n, width = n.as_py(), width.as_py()
                ids = blocks.unpack(rows).column("vec_id").to_pylist()
                x = np.frombuffer(data.as_buffer(), np.float64).reshape(n, width)
                order = sorted(range(n), key=lambda i: (ids[i] is None, ids[i] or 0, x[i].tolist()))[:entries]
                yield pa.RecordBatch.from_arrays([pa.array([width] * len(order), pa.int32()), pa.array([ids[i] for i in order], pa.int64()), pa.array([x[i].tolist() for i in order], pa.list_(pa.float64()))], ["width", "vec_id", "v"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for width, entry, v in zip(*(batch.column(c).to_pylist() for c in ("width", "entry", "v"))):
                x = whole(np.array([v], np.float64).reshape(1, width), scale)[0]
                out += [(width, pos, entry - 1, ",".join(map(str, x[a:z].tolist()))) for pos, (a, z) in enumerate(cuts(width, parts))]
            yield blocks.rows("width int, pos int, entry int, value string", list(zip(*out)) if out else [[]] * 4)

    order = Window.partitionBy("width").orderBy(F.col("vec_id").asc_nulls_last(), "v")
    some = index.mapInArrow(few, "width int, vec_id long, v array<double>").withColumn("entry", F.row_number().over(order)).where(F.col("entry") <= entries)
    return some.mapInArrow(cut, "width int, pos int, entry int, value string")


def _entries(values: list[str], size: int) -> np.ndarray:
    rows = [list(map(int, v.split(","))) if v else [] for v in values]
    big = any(abs(x) >= SMALL for r in rows for x in r)
    return np.array(rows, object if big else np.int64).reshape(len(rows), size)


def _with_books(chunks: DataFrame, book: DataFrame) -> DataFrame:
    """Each chunk with the entries of its position in order: ``values``."""
    packed = book.groupBy("width", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("entry", "value"))), lambda e: e["value"]).alias("values"))
    salted = chunks.withColumn("_salt", skew.salt("chunk"))
    return skew.same(salted, skew.spread(packed), ["width", "pos"]).select("width", "pos", "rows", "values")


def _moved(chunks: DataFrame, book: DataFrame, parts: int, name: str) -> DataFrame:
    """The codebooks after a round."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, pos, rows, values in zip(*(batch.column(c) for c in ("width", "pos", "rows", "values"))):
                width, pos, table = width.as_py(), pos.as_py(), blocks.unpack(rows)
                a, z = cuts(width, parts)[pos]
                x, n = decode(table.column("part").to_pylist(), z - a), table.column("n").to_numpy()
                entries = _entries(values.as_py(), z - a)
                code, _ = nearest(x, entries)
                out = []
                for e in np.unique(code).tolist():
                    of = code == e
                    total = (x[of].astype(object) * n[of].astype(object)[:, None]).sum(0) if x.dtype == object or abs(x).max(initial=0) >= EXACT else (x[of] * n[of][:, None]).sum(0)
                    out.append((width, pos, e, ",".join(map(str, total.tolist())), int(n[of].sum())))
                yield blocks.rows(_SUMS, list(zip(*out)) if out else [[]] * 5)

    def mean(table: pa.Table) -> pa.Table:
        rows = [list(map(int, v.split(","))) if v else [] for v in table.column("value").to_pylist()]
        n = sum(table.column("n").to_pylist())
        value = ",".join(str(sum(c) // n) for c in zip(*rows))
        return pa.table({c: table.column(c)[:1] for c in ("width", "pos", "entry")} | {"moved": pa.array([value])})

    sums = _with_books(chunks, book).mapInArrow(add_up, _SUMS)
    new = sums.groupBy("width", "pos", "entry").applyInArrow(mean, "width int, pos int, entry int, moved string")
    return scratch.Table(book.join(new, ["width", "pos", "entry"], "left").select("width", "pos", "entry", F.coalesce("moved", "value").alias("value")), name).df


def _coded(chunks: DataFrame, book: DataFrame, parts: int) -> DataFrame:
    """Rows of _CODED: every distinct part's code and squared distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, pos, rows, values in zip(*(batch.column(c) for c in ("width", "pos", "rows", "values"))):
                width, pos, table = width.as_py(), pos.as_py(), blocks.unpack(rows)
                a, z = cuts(width, parts)[pos]
                code, far = nearest(decode(table.column("part").to_pylist(), z - a), _entries(values.as_py(), z - a))
                m = table.num_rows
                yield blocks.rows(_CODED, [[width] * m, [pos] * m, table.column("part").combine_chunks(), table.column("used").combine_chunks(), code.astype(np.int32), list(map(str, far.tolist()))])

    return _with_books(chunks, book).mapInArrow(run, _CODED)


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", name: str = "codes") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable row."""
    number = F.col(vector).cast("array<double>")
    good = ~F.exists(number, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(vector).isNotNull()).where(good).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), number.alias("v"))
    index = scratch.Table(_blocks(rows, BLOCK_ROWS), name).df
    asked = scratch.Table(_asked(index, parts, scale), name)
    salted = asked.df.withColumn("_salt", skew.salt("block"))
    distinct = salted.groupBy("width", "pos", "part").agg(F.sum("n").alias("n"), skew.salts_used().alias("used"))
    chunks = scratch.Table(_chunked(distinct.sortWithinPartitions("width", "pos")), name)
    book = scratch.Table(_first(index, parts, entries, scale), name).df
    for _ in range(rounds):
        book = _moved(chunks.df, book, parts, name)
    coded = _coded(chunks.df, book, parts)
    replies = skew.same(salted, skew.spread(coded, "used"), ["width", "pos", "part"]).select("block", "pos", "at", "code", "dist")

    def put_back(left: pa.Table, right: pa.Table) -> pa.Table:
        kept = blocks.unpack(left.column("rows")[0])
        n, width = kept.num_rows, left.column("width")[0].as_py()
        x = _vectors(width, n, left.column("vectors")[0], scale)
        pos, at, code = (right.column(c).to_numpy() for c in ("pos", "at", "code"))
        far = np.array(list(map(int, right.column("dist").to_pylist())), object)
        text, error = np.full(n, "", object), np.zeros(n, object)
        for p, (a, z) in enumerate(cuts(width, parts)):
            _, place, _ = _distinct(x[:, a:z])
            of = np.flatnonzero(pos == p)
            of = of[np.argsort(at[of])][place]
            text = text + np.array([f"{c:02x}" for c in code[of].tolist()], object)
            error = error + far[of]
        kernels.release()
        return pa.table({"vec_id": kept.column("vec_id"), "label": kept.column("label"), "code": pa.array(text.tolist(), pa.string()), "error": pa.array(list(map(str, error.tolist())), pa.string()), "width": pa.array([width] * n, pa.int32())})

    found = scratch.Table(index.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(put_back, _OUT), name)
    asked.drop()
    chunks.drop()
    # Errors of up to 38 digits add up as decimals; no vector of doubles that a long's error fits has more.
    exact = F.coalesce(F.expr("try_cast(error as decimal(38,0))"), F.lit(str(_MOST)).cast("decimal(38,0)"))
    long = lambda c: F.least(c, F.lit(str(_MOST)).cast("decimal(38,0)")).cast("long")
    out = found.df.withColumn("error", exact)
    out = skew.with_groups(out, ["label"], ["vec_id", "code"], label_error=F.coalesce(F.expr("try_sum(error)"), F.lit(str(_MOST)).cast("decimal(38,0)")))
    sha = book.where("value != ''").groupBy("width").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("pos", "entry", "value"))), lambda e: e["value"])).alias("text"))
    sha = book.select("width").distinct().join(sha, "width", "left").select("width", F.sha2(F.coalesce("text", F.lit("")), 256).alias("codebooks_sha256"))
    out = skew.same(out.withColumn("_salt", skew.salt("vec_id", "code")), skew.spread(sha), ["width"])
    return out.select("vec_id", "code", long(F.col("error")).alias("error"), long(F.col("label_error")).alias("label_error"), "codebooks_sha256")


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _round_sql(book: str, k: int) -> str:
    return f"""
a{k} AS (
  SELECT vec_id, pos, part, min_by(entry, (dist, entry)) AS entry, min(dist) AS dist
  FROM (SELECT p.vec_id, p.pos, p.part, b.entry, list_sum(list_transform(list_zip(p.part, b.part), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist FROM p JOIN {book} b USING (pos))
  GROUP BY vec_id, pos, part
)"""


def _book_sql(old: str, k: int) -> str:
    return f"""
b{k} AS (
  SELECT o.pos, o.entry, coalesce(n.part, o.part) AS part
  FROM {old} o LEFT JOIN (
    SELECT pos, entry, list(m ORDER BY j) AS part
    FROM (SELECT pos, entry, j, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m FROM (SELECT pos, entry, unnest(part) AS x, unnest(range(1, len(part) + 1)) AS j FROM a{k}) GROUP BY pos, entry, j)
    GROUP BY pos, entry
  ) n USING (pos, entry)
)"""


OP11_SQL = f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
p AS (SELECT vec_id, pos, e[pos * (len(e) // 16) + 1:(pos + 1) * (len(e) // 16)] AS part FROM v CROSS JOIN (SELECT range AS pos FROM range(16))),
b0 AS (SELECT pos, row_number() OVER (PARTITION BY pos ORDER BY vec_id) - 1 AS entry, part FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64)),
{_round_sql("b0", 1)},{_book_sql("b0", 1)},{_round_sql("b1", 2)},{_book_sql("b1", 2)},{_round_sql("b2", 3)},
done AS (SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY pos) AS code, sum(dist)::BIGINT AS error FROM a3 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY pos, entry)) FROM b2) AS codebooks_sha256
FROM done JOIN v USING (vec_id)
"""
