"""Removal of repeated substrings: suffixes sorted bucket by bucket, with the help of a difference-cover sample.

Whether two suffixes agree for ``length`` bytes is decided as in blockwise suffix sorting with a difference
cover. The positions whose remainder modulo v lies in a perfect difference set D are the sample: for any two
positions i and j there is a k < v for which i + k and j + k both belong to it. Each block sends the sample's
substrings of length - v + 1 bytes, as sorted hashes, to the owners of hash ranges; an owner sorts its range
and answers which of them have rank mates in another document (of a rank no more is asked than whether it is shared).
Two suffixes can tie for ``length`` bytes only if a sample position within the first v has such a mate, so all but the
repeated suffixes are settled by the sample alone; a chance match of hashes only sends a suffix on.

The tied suffixes go to buckets by the least hash of their short substrings, so that neighbours, which mostly have
the same one, go together as one string, and equal suffixes meet. One part of the buckets is sorted after another, and
in a bucket one range of first bytes after another, by all ``length`` bytes; equal neighbours in that order tie, and
the least doc_id of each tie keeps its bytes. No decision depends on a hash, but for that on whole texts: a document
whose text also stands under a smaller doc_id is found first, by SHA-256, and needs no suffixes.

An owner may be sent more suffixes than a task should hold: every block sends it a notice that all documents have, or
many texts go on differently around one short string. The blocks that send to such an owner are dealt out to racks, by
its load. A rack merges equal strings of its blocks under their least doc_id (whoever has a larger one is settled by
that), cuts what is left into single suffixes and deals these out to parts by a hash of all their bytes; a part sorts
them like a bucket, and the answers go back by rack to the blocks. A suffix that all blocks have thus reaches its part
once for each rack. No task sees more than a block of text, or about ``limit`` suffixes.

Edge cases: null text is empty; texts shorter than ``length`` keep all bytes; equal doc_ids are one document
as to what is smaller, but rows stay rows; a null doc_id is larger than all others; an empty table gives no
rows; other columns are ignored. A text is never split: one that is longer than a block is a block of its own and takes
some 40 bytes of memory for each of its bytes.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks, golomb, kernels, scratch

_U = np.uint64
#: Perfect difference sets by modulus. Fixed values.
COVERS = {
    1: (0,),
    3: (0, 1),
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
    31: (0, 1, 3, 8, 12, 18),
}
#: Parts of the blocks, and of the buckets of suffixes, that are handled one after another.
ROUNDS = 4
#: Suffixes that are sorted at a time, about, and neighbours that go as one string at most.
SORTED = 1 << 19
STRING = 1 << 12
#: An owner that is sent more than so many times the suffixes it should get is split.
HOT = 2
#: Hot owners that are broadcast at most (16 bytes each).
FEW = 100_000
_LAST = np.iinfo(np.int64).max


def cover(length: int) -> int:
    """Modulus of the cover: a sample substring has over half of the bytes."""
    return max((v for v in COVERS if 2 * (v - 1) < length), default=0)


class _Text:
    """Documents of a block in order of doc_id, with the places of their bytes."""

    def __init__(self, table: pa.Table):
        self.table = table.take(pc.sort_indices(table, [("doc_id", "ascending")])) if table.num_rows else table
        self.buf, self.offsets = kernels.text_buffer(self.table.column("text"))
        self.ids = np.asarray(self.table.column("doc_id").combine_chunks().fill_null(_LAST), np.int64)
        self.sizes = np.diff(self.offsets)
        self.doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        self.end = self.offsets[1:]

    def sample(self, v: int, size: int) -> np.ndarray:
        at = np.sort(np.concatenate([np.arange(d, len(self.buf), v) for d in COVERS[v]]))
        return at[self.end[self.doc[at]] - at >= size]

    def suffixes(self, mates: np.ndarray, v: int, length: int) -> np.ndarray:
        """Positions with a sample position of ``mates`` within the first v bytes, and ``length`` bytes to go."""
        count = np.zeros(len(self.buf) + v + 1, np.int32)
        count[mates + 1] = 1
        np.cumsum(count, out=count)
        at = np.flatnonzero(count[v : v + len(self.buf)] > count[: len(self.buf)])
        return at[self.end[self.doc[at]] - at >= length]


def _least(h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, the least id of each, whether it has others, and the place of each of h."""
    order = np.argsort(h)
    new = ~blocks.same_as_before(h[order])
    first = np.flatnonzero(new)
    place = np.empty(len(h), np.int64)
    place[order] = np.cumsum(new) - 1
    if not len(h):
        return h, ids, np.zeros(0, bool), place
    low, high = np.minimum.reduceat(ids[order], first), np.maximum.reduceat(ids[order], first)
    return h[order][first], low, low < high, place


def _has_mates(h: np.ndarray, sender: np.ndarray, extras: list[bytes]) -> np.ndarray:
    sizes = np.bincount(sender, minlength=len(extras))
    several = np.concatenate([blocks.said(x, n) for x, n in zip(extras, sizes)])
    _, at, count = np.unique(h, return_inverse=True, return_counts=True)
    any_several = np.zeros(len(count), bool)
    any_several[at[several]] = True
    return (any_several | (count > 1))[at]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after another."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class _Strings:
    """Tied suffixes of a block as strings: runs of neighbours whose bucket key is the same. Strings with the same
    bytes are sent once, under their least doc_id."""

    def __init__(self, text: _Text, tied: np.ndarray, length: int, owners: int):
        new = np.ones(len(tied), bool)
        new[1:] = (np.diff(tied) > 1) | (text.doc[tied[1:]] != text.doc[tied[:-1]])
        run = np.flatnonzero(new)
        sizes = np.diff(run, append=len(tied))
        gram = max(1, length // 3)
        width = length - gram + 1
        of_run = sizes + width - 1
        key = _sliding_least(kernels.window_hashes(text.buf, _ranges(tied[run], of_run), gram), width)
        key = key[_ranges(np.cumsum(of_run) - of_run, sizes)]
        new[1:] |= key[1:] != key[:-1]
        new[::STRING] = True
        first = np.flatnonzero(new)
        #: By string: its number of suffixes.
        self.n = np.diff(first, append=len(tied))
        ids = text.ids[text.doc[tied[first]]]
        known: dict[bytes, int] = {}
        data, least, same = memoryview(text.buf), [], []
        for a, size, d in zip(tied[first].tolist(), (self.n + length - 1).tolist(), ids.tolist()):
            u = known.setdefault(bytes(data[a : a + size]), len(known))
            if u == len(least):
                least.append(d)
            elif d < least[u]:
                least[u] = d
            same.append(u)
        same, self.texts = np.array(same, np.int64), list(known)
        self.least = np.array(least, np.int64)
        where = np.zeros(len(known), np.int64)
        where[same[::-1]] = first[::-1]
        owner = golomb.owner_of(kernels.mix(key[where]), 64, owners)
        #: Sent strings in order of their owners.
        self.order = np.argsort(owner, kind="stable")
        self.owner = owner[self.order]
        place = np.empty(len(known), np.int64)
        place[self.order] = np.arange(len(known))
        self.place, self.later = place[same], ids > self.least[same]

    def sent(self, block: int, length: int) -> pa.RecordBatch:
        """Rows of blocks.SENT."""
        out = []
        for o, a, b in self.by_owner():
            texts = [self.texts[i] for i in self.order[a:b].tolist()]
            about = np.array(list(map(len, texts)), np.uint32).tobytes() + self.least[self.order[a:b]].tobytes()
            n = sum(map(len, texts)) - len(texts) * (length - 1)
            out.append((o, block, zstandard.compress(b"".join(texts), 1), zstandard.compress(about, 1), n))
        return blocks.rows(f"{blocks.SENT}, size long", list(zip(*out)) if out else [[]] * 5)

    def by_owner(self):
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(self.owner)) + 1, [len(self.owner)]]) if len(self.owner) else [0]
        for a, b in zip(cuts[:-1].tolist() if len(self.owner) else (), cuts[1:].tolist() if len(self.owner) else ()):
            yield int(self.owner[a]), a, b

    def repeated(self, replies: pa.Table, length: int) -> np.ndarray:
        """By tied suffix, whether it stands in a document of smaller id."""
        sizes = np.array([len(self.texts[i]) - length + 1 for i in self.order.tolist()], np.int64)
        by = dict(zip(replies.column("owner").to_pylist(), replies.column("reply").to_pylist()))
        parts = [blocks.said(by[o], int(sizes[a:b].sum())) for o, a, b in self.by_owner()]
        told = np.concatenate(parts) if parts else np.zeros(0, bool)
        start = np.cumsum(sizes) - sizes
        return told[_ranges(start[self.place], self.n)] | np.repeat(self.later, self.n)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    span = 1
    out = values
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    n = len(values) - width + 1
    return np.minimum(out[:n], out[width - span : width - span + n])


def _bucket(table: pa.Table, length: int) -> pa.Table:
    """Rows of blocks.REPLY: of all suffixes in the strings that one owner was sent, whether a smaller doc_id has
    the same ``length`` bytes."""
    plain = zstandard.ZstdDecompressor()
    texts = [plain.decompress(x.as_buffer()) for x in table.column("body")]
    about = [plain.decompress(x.as_buffer()) for x in table.column("extra")]
    counts = [len(x) // 12 for x in about]
    sizes = np.concatenate([np.frombuffer(x, np.uint32, n) for x, n in zip(about, counts)]).astype(np.int64)
    ids = np.concatenate([np.frombuffer(x, np.int64, n, 4 * n) for x, n in zip(about, counts)])
    # Eight bytes more can be read from each place; the last word of a suffix begins so that it ends with it.
    buf = np.frombuffer(b"".join([*texts, bytes(8)]), np.uint8)
    words = np.ndarray((len(buf) - 7,), ">u8", buf, 0, (1,))
    at = _ranges(np.cumsum(sizes) - sizes, sizes - length + 1)
    own = np.repeat(ids, sizes - length + 1)
    steps = [*range(0, max(0, length - 8), 8), max(0, length - 8)]
    cut = np.uint64(8 * max(0, 8 - length))

    def word(i: np.ndarray, step: int) -> np.ndarray:
        return words[i + step].astype(np.uint64) >> cut

    out = np.zeros(len(at), bool)
    first = word(at, 0)
    order = np.argsort(first, kind="stable")
    head = np.flatnonzero(np.diff(first[order], prepend=first[order][:1] ^ np.uint64(1))) if len(at) else order
    low = 0
    while low < len(at):
        # One range of first words at a time.
        high = int(head[np.searchsorted(head, low + SORTED)]) if np.searchsorted(head, low + SORTED) < len(head) else len(at)
        part = order[low:high]
        keys = [word(at[part], k) for k in steps[1:]][::-1] + [first[part]]
        inner = np.lexsort(keys)
        part = part[inner]
        new = np.zeros(len(part), bool)
        new[:1] = True
        for k in keys:
            new[1:] |= k[inner][1:] != k[inner][:-1]
        begin = np.flatnonzero(new)
        least = np.minimum.reduceat(own[part], begin)
        out[part] = own[part] > np.repeat(least, np.diff(begin, append=len(part)))
        low = high
    ends = np.cumsum(sizes - length + 1)
    cuts = np.concatenate([[0], ends])[np.cumsum([0, *counts])]
    replies = [zlib.compress(np.packbits(out[a:b]), 1) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    kernels.release()
    return pa.Table.from_batches([blocks.rows(blocks.REPLY, [table.column("block").to_pylist(), table.column("owner").to_pylist(), replies])])


class _Rack:
    """The strings that some blocks sent to one owner, equal ones merged; and their suffixes, in order of their parts.
    The order of the rows, one for each block, makes no difference: a rack is read twice."""

    def __init__(self, table: pa.Table, length: int, parts: int):
        plain = zstandard.ZstdDecompressor()
        known: dict[bytes, int] = {}
        least: list[int] = []
        table = table.sort_by("block")
        self.length, self.block, self.sent = length, table.column("block").to_pylist(), []
        for body, extra in zip(table.column("body"), table.column("extra")):
            data, about = plain.decompress(body.as_buffer()), plain.decompress(extra.as_buffer())
            n = len(about) // 12
            ids, same, a = np.frombuffer(about, np.int64, n, 4 * n), [], 0
            for size, d in zip(np.frombuffer(about, np.uint32, n).tolist(), ids.tolist()):
                u = known.setdefault(data[a : a + size], len(known))
                if u == len(least):
                    least.append(d)
                elif d < least[u]:
                    least[u] = d
                same.append(u)
                a += size
            self.sent.append((np.array(same, np.int64), ids))
        self.least = np.array(least, np.int64)
        sizes = np.array([len(x) for x in known], np.int64)
        self.buf = np.frombuffer(b"".join(known), np.uint8)
        #: By string: its number of suffixes, and the place of the first among all.
        self.n = sizes - length + 1
        self.start = np.cumsum(self.n) - self.n
        self.at = _ranges(np.cumsum(sizes) - sizes, self.n)
        part = (kernels.mix(kernels.window_hashes(self.buf, self.at, length)) % _U(parts)).astype(np.int64)
        self.order = np.argsort(part, kind="stable")
        names, first = np.unique(part[self.order], return_index=True)
        self.parts = list(zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(part)]))

    def dealt(self) -> Iterator[tuple[int, bytes, bytes]]:
        """Part, and its suffixes as strings of their own."""
        own = np.repeat(self.least, self.n)
        for part, a, b in self.parts:
            of = self.order[a:b]
            data = self.buf[self.at[of][:, None] + np.arange(self.length)].tobytes()
            about = np.full(b - a, self.length, np.uint32).tobytes() + own[of].tobytes()
            yield part, zstandard.compress(data, 1), zstandard.compress(about, 1)

    def answers(self, replies: pa.Table) -> list[bytes]:
        """By block: for all suffixes that it sent, whether a smaller doc_id has them."""
        by = dict(zip(replies.column("part").to_pylist(), replies.column("reply").to_pylist()))
        told = np.zeros(len(self.at), bool)
        for part, a, b in self.parts:
            told[self.order[a:b]] = blocks.said(by[part], b - a)
        out = []
        for same, ids in self.sent:
            bits = told[_ranges(self.start[same], self.n[same])] | np.repeat(ids > self.least[same], self.n[same])
            out.append(zlib.compress(np.packbits(bits), 1))
        return out


_DEALT = "owner int, rack int, part int, body binary, extra binary"
_TOLD = "owner int, rack int, part int, reply binary"


def _split(sent: DataFrame, hot: DataFrame, length: int, name: str) -> tuple[scratch.Table, DataFrame]:
    """Rows of blocks.REPLY to what the hot owners (owner, racks) were sent, and a table to drop after them."""
    sent = sent.join(hot, "owner").withColumn("rack", F.pmod(F.xxhash64("block"), F.col("racks")).cast("int"))

    def deal(table: pa.Table) -> pa.Table:
        kernels.release()
        owner, rack, racks = (table.column(c)[0].as_py() for c in ("owner", "rack", "racks"))
        out = [(owner, rack, *x) for x in _Rack(table, length, racks * length).dealt()]
        return pa.Table.from_batches([blocks.rows(_DEALT, list(zip(*out)) if out else [[]] * 5)])

    def sort(table: pa.Table) -> pa.Table:
        told = _bucket(table.rename_columns(["owner", "block", "part", "body", "extra"]), length)
        return pa.Table.from_batches([blocks.rows(_TOLD, [told.column("owner").to_pylist(), table.column("rack").to_pylist(), table.column("part").to_pylist(), told.column("reply").to_pylist()])])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        kernels.release()
        rack = _Rack(left, length, left.column("racks")[0].as_py() * length)
        return pa.Table.from_batches([blocks.rows(blocks.REPLY, [rack.block, left.column("owner").to_pylist(), rack.answers(right)])])

    dealt = sent.groupBy("owner", "rack").applyInArrow(deal, _DEALT)
    told = scratch.Table(dealt.groupBy("owner", "part").applyInArrow(sort, _TOLD), name)
    return told, sent.groupBy("owner", "rack").cogroup(told.df.groupBy("owner", "rack")).applyInArrow(answer, blocks.REPLY)


_PASSED = "_payload binary, _owner int, _block long, _body binary, _extra binary, _size long"
_FOUND = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


WHOLE = "block long, row int, doc_id long, sha binary"
#: The rows of one text meet its least id in up to so many tasks.
SALTS = 64


def _copies(whole: DataFrame) -> DataFrame:
    """block and copies: the rows of each block whose whole text stands under a smaller doc_id."""
    salt = F.pmod(F.xxhash64("block", "row"), F.lit(SALTS)).cast("int")
    whole = whole.withColumn("salt", salt)
    least = whole.groupBy("sha").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts")).where("n > 1")
    least = least.select("sha", "least", F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit("salts", i) == 1)).alias("salt"))
    return whole.join(least, ["sha", "salt"]).where("doc_id > least").groupBy("block").agg(F.collect_list("row").alias("copies"))


def removed(docs: DataFrame, length: int = 50, carry: dict[str, str] | None = None, name: str = "substrings", limit: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, for the removal of all bytes that some
    ``length`` bytes cover which also start in a document of smaller doc_id. With ``carry`` (new names by
    column): these columns of ``docs`` as well, and as ``_text`` the text without the removed bytes (and
    without halves of characters). ``limit``: suffixes that one owner sorts at most, more are split; by default HOT
    times ``cellframe.ownerHashes``. It changes no result."""
    extra = [F.col(c).alias(new) for c, new in (carry or {}).items()]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *extra)
    carried = [f for f in docs.schema if f.name in (carry or {}).values()]
    if carry is not None:
        carried.append(T.StructField("_text", T.StringType()))
    v = cover(length)
    size = length - v + 1
    table = blocks.build(docs, name)
    samples = blocks.totals(table.df)[1] * len(COVERS[v]) // v
    bits, owners = min(64, max(40, samples.bit_length() + 8)), blocks.owners_for(docs.sparkSession, samples)
    cut = _U(64 - bits)
    buckets = blocks.owners_for(docs.sparkSession, blocks.totals(table.df)[1])

    def tell_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                text = _Text(blocks.unpack(payload))
                long_ = np.flatnonzero(text.sizes >= length)
                digests = [hashlib.sha256(text.buf[text.offsets[i] : text.end[i]]).digest() for i in long_.tolist()]
                yield blocks.rows(WHOLE, [np.full(len(long_), block), long_, text.ids[long_], digests])
        kernels.release()

    def copies_of(text: _Text, rows: pa.Table) -> np.ndarray:
        """Rows whose whole text stands under a smaller doc_id."""
        out = np.zeros(len(text.ids), bool)
        out[[i for x in rows.column("copies").to_pylist() for i in x or ()]] = True
        return out

    def sampled(text: _Text, copy: np.ndarray):
        at = text.sample(v, size)
        at = at[~copy[text.doc[at]]]
        return at, *_least(kernels.window_hashes(text.buf, at, size) >> cut, text.doc[at])

    def tell_sample(left: pa.Table, right: pa.Table) -> pa.Table:
        kernels.release()
        text = _Text(blocks.unpack(left.column("payload")[0]))
        _, h, _, several, _ = sampled(text, copies_of(text, right))
        return pa.Table.from_batches([blocks.send(left.column("block")[0].as_py(), h, bits, owners, lambda a, b: zlib.compress(np.packbits(several[a:b]), 1))])

    shape = T.StructType([*docs.select("doc_id").schema, *carried, *T._parse_datatype_string(_FOUND)])
    mid = T.StructType([*shape, *T._parse_datatype_string(_PASSED)])
    arrow_mid, arrow_shape = _arrow(mid), _arrow(shape)

    def result(text: _Text, rows: np.ndarray, gone: np.ndarray) -> dict:
        """Columns of ``shape`` of some rows; gone: by byte."""
        total = np.zeros(len(gone) + 1, np.int64)
        np.cumsum(gone, out=total[1:])
        head = gone.copy()
        head[1:] &= ~gone[:-1]
        inner = text.offsets[:-1][text.sizes > 0]
        head[inner] = gone[inner]
        spans = np.zeros(len(gone) + 1, np.int64)
        np.cumsum(head, out=spans[1:])
        start, end = text.offsets[:-1][rows], text.end[rows]
        lost = total[end] - total[start]
        kept = [text.buf[a:b] if not n else text.buf[a:b][~gone[a:b]] for a, b, n in zip(start.tolist(), end.tolist(), lost.tolist())]
        part = text.table.take(pa.array(rows))
        out = {"doc_id": part.column("doc_id"), "n_bytes": end - start, "n_removed": lost, "n_spans": spans[end] - spans[start]}
        out["kept_sha256"] = [hashlib.sha256(x).hexdigest() for x in kept]
        for f in carried[:-1]:
            out[f.name] = part.column(f.name)
        if carried:
            out["_text"] = [x.tobytes().decode("utf-8", "ignore") if n else t for x, n, t in zip(kept, lost.tolist(), part.column("text").to_pylist())]
        return out

    def tie(left: pa.Table, right: pa.Table) -> pa.Table:
        """Settle the rows without tied suffixes; pass the others on, and send their suffixes to the buckets."""
        kernels.release()
        text = _Text(blocks.unpack(left.column("payload")[0]))
        block = left.column("block")[0].as_py()
        copy = copies_of(text, right)
        at, h, _, _, place = sampled(text, copy)
        mates = blocks.heard(h, bits, owners, right.filter(pc.is_valid(right.column("owner"))))[place]
        tied = text.suffixes(at[mates], v, length)
        tied = tied[~copy[text.doc[tied]]]
        busy = np.bincount(text.doc[tied], minlength=len(text.ids)) > 0
        gone = copy[text.doc] & (text.sizes >= length)[text.doc]
        out = [pa.table(result(text, np.flatnonzero(~busy), gone))]
        if busy.any():
            marks = np.zeros(len(text.buf), bool)
            marks[tied] = True
            rows = np.flatnonzero(busy)
            table = text.table.take(pa.array(rows)).append_column("tied", pa.array([np.packbits(marks[a:b]).tobytes() for a, b in zip(text.offsets[rows].tolist(), text.end[rows].tolist())], pa.binary()))
            out.append(pa.table({"_block": pa.array([block], pa.int64()), "_payload": pa.array([blocks.pack(table)], pa.binary())}))
            sent = _Strings(text, tied, length, buckets).sent(block, length)
            out.append(pa.Table.from_batches([sent.rename_columns([f"_{c}" for c in sent.schema.names])]))
        return pa.concat_tables([_conform(t, arrow_mid) for t in out])

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        kernels.release()
        text = _Text(blocks.unpack(left.column("payload")[0]))
        marks = [np.unpackbits(np.frombuffer(m.as_buffer(), np.uint8))[:n].astype(bool) for m, n in zip(text.table.column("tied"), text.sizes)]
        tied = np.flatnonzero(np.concatenate(marks))
        repeated = tied[_Strings(text, tied, length, buckets).repeated(right, length)]
        edge = np.zeros(len(text.buf) + 1, np.int32)
        edge[repeated] += 1
        np.add.at(edge, repeated + length, -1)
        gone = np.cumsum(edge[:-1]) > 0
        return _conform(pa.table(result(text, np.arange(len(text.ids)), gone)), arrow_shape)

    def bucket(sent: pa.Table) -> pa.Table:
        return _bucket(sent, length)

    def met(left: DataFrame, right: DataFrame, f, schema) -> DataFrame:
        return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(f, schema)

    copies = scratch.Table(_copies(table.df.mapInArrow(tell_whole, WHOLE)), name)
    mates = scratch.Table(blocks.ask(met(table.df, copies.df, tell_sample, blocks.SENT), bits, owners, _has_mates), name)
    replies = mates.df.select("block", "owner", "reply", F.lit(None).cast("array<int>").alias("copies")).union(copies.df.select("block", F.lit(None).cast("int"), F.lit(None).cast("binary"), "copies"))
    # One part of the blocks, and then one bucket of suffixes at a time: that bounds what is in shuffle files.
    part = F.pmod(F.xxhash64("block"), F.lit(ROUNDS))
    first = [scratch.Table(met(table.df.where(part == r), replies.where(part == r), tie, mid), name) for r in range(ROUNDS)]
    used = [*first]
    for t in (table, copies, mates):
        t.drop()
    first = functools.reduce(DataFrame.union, [t.df for t in first])
    sent = first.where("_owner is not null")
    limit = limit or HOT * int(docs.sparkSession.conf.get("cellframe.ownerHashes", str(blocks.OWNER_HASHES)))
    load = sent.groupBy(F.col("_owner").alias("owner")).agg(F.sum("_size").alias("n")).where(F.col("n") > limit)
    hot = scratch.Table(load.select("owner", F.ceil(F.col("n") / limit).cast("int").alias("racks")), name)
    used.append(hot)
    n_hot = hot.df.count()
    hot = F.broadcast(hot.df) if n_hot <= FEW else hot.df
    sent = sent.select(*(F.col(f"_{c}").alias(c) for c in ("owner", "block", "body", "extra")))
    every = sent
    if n_hot:
        sent = sent.join(hot, "owner", "left_anti")
    parts = [sent.where(F.col("owner").between(r * buckets // ROUNDS, (r + 1) * buckets // ROUNDS - 1)) for r in range(ROUNDS)]
    ties = [scratch.Table(x.groupBy("owner").applyInArrow(bucket, blocks.REPLY), name) for x in parts]
    used += ties
    if n_hot:
        told, split = _split(every, hot, length, name)
        ties.append(scratch.Table(split, name))
        used += [told, ties[-1]]
    ties = functools.reduce(DataFrame.union, [t.df for t in ties])
    waiting = first.where("_payload is not null").select(F.col("_block").alias("block"), F.col("_payload").alias("payload"))
    done = first.where("_block is null").select(*shape.names)
    out = scratch.materialize(done.union(met(waiting, ties, settle, shape)), name)
    for t in used:
        t.drop()
    return out


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _conform(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """The columns of the schema, null where the table has none."""
    return pa.table([table.column(f.name).cast(f.type) if f.name in table.column_names else pa.nulls(table.num_rows, f.type) for f in schema], schema=schema)


def drop_substrings(docs: DataFrame, length: int = 50) -> DataFrame:
    """``docs`` with all its columns, the repeated bytes taken out of ``text`` (and ``n_chars`` counted again)."""
    carry = {c: f"_c{i}" for i, c in enumerate(docs.columns) if c != "text"}
    out = removed(docs, length, carry).withColumnsRenamed({"n_removed": "_n"})
    columns = {c: F.col(carry.get(c, "_text")) for c in docs.columns}
    if dict(docs.dtypes).get("n_chars") in ("int", "bigint"):
        columns["n_chars"] = F.when(F.col("_n") > 0, F.length("_text")).otherwise(columns["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*(e.alias(c) for c, e in columns.items()))


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return removed(spark.read.parquet(f"{sf_dir}/documents.parquet"), length=50)
