"""Blocks of documents, and the exchange in which blocks ask the owners of hash ranges about their hashes.

A block is a bounded run of documents, written once, so that its number and content hold when a task is
run again. Each block sends every owner the sorted distinct hashes of the owner's range, Golomb-coded;
the owner answers each block with a few bits for each hash, in the same order. A hash that a third of all
rows share is thus sent once by each block, and no task sees more than a range of hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golomb, kernels, scratch

BLOCK = "block long, n_docs long, n_bytes long, payload binary"
#: Bytes of text in a block (a longer document is a block of its own), and hashes that one owner gets at most, about:
#: for workers with some 500 MB. Sessions with larger executors set more by ``cellframe.blockBytes`` and
#: ``cellframe.ownerHashes``; messages are blocks times owners, so both grow with the square root of the corpus.
BLOCK_BYTES = 3 << 20
OWNER_HASHES = 8 << 20


def pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(payload) -> pa.Table:
    payload = payload.as_buffer() if hasattr(payload, "as_buffer") else payload
    return pa.ipc.open_stream(payload).read_all()


def rows(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def build(docs: DataFrame, name: str, text: str = "text", block_bytes: int | None = None) -> scratch.Table:
    """Write ``docs`` as blocks: the rows of each in ``payload``, compressed."""
    block_bytes = block_bytes or int(docs.sparkSession.conf.get("cellframe.blockBytes", str(BLOCK_BYTES)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal count, held, size
            table = pa.Table.from_batches(held)
            out = rows(BLOCK, [[(part << 32) + count], [table.num_rows], [size], [pack(table)]])
            count, held, size = count + 1, [], 0
            return out

        for batch in batches:
            sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0))
            total, at = np.cumsum(sizes.astype(np.int64)), 0
            while at < len(total):
                before = int(total[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(total, before + block_bytes - size, "right")))
                held.append(batch.slice(at, to - at))
                size, at = size + int(total[to - 1]) - before, to
                if at < len(total) or size >= block_bytes:
                    yield flush()
        if held:
            yield flush()
        kernels.release()

    return scratch.Table(docs.mapInArrow(cut, BLOCK), name)


def numbered(docs: DataFrame, text: str) -> list:
    """The columns of ``docs`` but the text, under names that clash with no other."""
    return [docs[c].alias(f"_c{i}") for i, c in enumerate(docs.columns) if c != text]


def picked(blocks: DataFrame, stays: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The rows (block, row) of blocks that hold ``text`` and the ``numbered`` columns, as rows of ``docs``."""
    names = ["text" if c == text else f"_c{i}" for i, c in enumerate(docs.columns)]
    schema = docs.schema

    def pick(left: pa.Table, right: pa.Table) -> pa.Table:
        rows_ = np.sort(right.column("row").to_numpy()) if left.num_rows else []
        table = unpack(left.column("payload")[0]) if left.num_rows else None
        out = to_arrow(schema)
        if table is None:
            return out.empty_table()
        return pa.table([table.column(n).take(pa.array(rows_)).cast(f.type) for n, f in zip(names, out)], schema=out)

    return blocks.select("block", "payload").groupBy("block").cogroup(stays.groupBy("block")).applyInArrow(pick, schema)


def to_arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def owners_for(spark, hashes: int) -> int:
    """Owners of equal hash ranges: some for each shuffle partition, and enough that none gets too much."""
    return max(2 * scratch.partitions(spark), -(-hashes // int(spark.conf.get("cellframe.ownerHashes", str(OWNER_HASHES)))))


def totals(blocks: DataFrame) -> tuple[int, int]:
    """Documents and bytes of text."""
    row = blocks.agg(F.sum("n_docs").alias("n"), F.sum("n_bytes").alias("b")).first()
    return row["n"] or 0, row["b"] or 0


#: Sent to an owner: hashes by Golomb code, and whatever else goes with them.
SENT = "owner int, block long, body binary, extra binary"
REPLY = "block long, owner int, reply binary"


def send(block: int, h: np.ndarray, bits: int, owners: int, extra: Callable[[int, int], bytes] | None = None) -> pa.RecordBatch:
    """Rows of SENT for the sorted distinct hashes of a block; extra(start, stop) goes with a range of them."""
    out = [(o, block, golomb.encode(h[a:b], o, bits, owners), extra(a, b) if extra else None) for o, a, b in golomb.by_owner(h, bits, owners)]
    return rows(SENT, list(zip(*out)) if out else [[], [], [], []])


def ask(sent: DataFrame, bits: int, owners: int, answer: Callable) -> DataFrame:
    """Rows of REPLY. answer(hashes, sender, extras) gets all that an owner was sent, and the number of the
    row that each hash came with; it returns for each hash one small unsigned integer array or bool array,
    which goes back by row."""

    def own(table: pa.Table) -> pa.Table:
        owner = table.column("owner")[0].as_py()
        parts = [golomb.decode(x.as_py(), owner, bits, owners) for x in table.column("body")]
        sender = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        told = answer(np.concatenate(parts), sender, table.column("extra").to_pylist())
        cuts = np.cumsum([0, *map(len, parts)])
        kernels.release()
        replies = [zlib.compress(np.packbits(x) if x.dtype == bool else planes(x), 1) for x in (told[a:b] for a, b in zip(cuts[:-1], cuts[1:]))]
        return pa.Table.from_batches([rows(REPLY, [table.column("block").to_pylist(), [owner] * len(parts), replies])])

    return sent.groupBy("owner").applyInArrow(own, REPLY)


def heard(h: np.ndarray, bits: int, owners: int, replies: pa.Table, dtype=bool) -> np.ndarray:
    """What the owners answered on the sorted distinct hashes of a block, in their order."""
    out = np.zeros(len(h), dtype)
    by = dict(zip(replies.column("owner").to_pylist(), replies.column("reply").to_pylist()))
    for o, a, b in golomb.by_owner(h, bits, owners):
        out[a:b] = said(by[o], b - a, dtype)
    return out


def said(reply: bytes, n: int, dtype=bool) -> np.ndarray:
    """The n values of one reply."""
    data = zlib.decompress(reply)
    return np.unpackbits(np.frombuffer(data, np.uint8))[:n].astype(bool) if dtype == bool else from_planes(data, dtype)


def planes(x: np.ndarray) -> bytes:
    """All lowest bytes, then all next ones, and so on: small numbers leave long runs of zeros."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def from_planes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def same_as_before(sorted_values: np.ndarray) -> np.ndarray:
    return np.concatenate([[False], sorted_values[1:] == sorted_values[:-1]]) if len(sorted_values) else np.zeros(0, bool)
