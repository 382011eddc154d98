"""Packing of documents into training sequences by non-negative least squares over length combinations.

Each document's ids (with an end id) are cut into whole windows and one rest. The rests of all documents
are a histogram of lengths below the window. Shallow combinations of up to ``DEPTH`` length classes that fill
the window are enumerated, and non-negative least squares finds how often to use each so that the histogram
is met. The counts are rounded down, and what is left is packed greedily: a window opens with the longest rest left
and takes the longest that fits, until none does. All of this is done on the histogram (at most ``window`` numbers), so the plan has a bounded size; rests get their places by
their rank among those of equal length, which is counted by salted groups and never sorted in one task.

Edge cases: null text is empty, a document of no text is its end id alone; repeated rows are packed as often
as they occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, kernels, scratch

WINDOW = 4096
END_ID = 2
#: Lengths in one class of the least-squares problem; a piece counts as the class's largest.
CLASS = 32
#: Lengths in a combination.
DEPTH = 3


class LibraryEncoder:
    """Ids of the tokenizers library. Distinct pieces of a chunk go to it many at once: words of Latin letters,
    the most of them, to a tokenizer with the same model that only splits at spaces, all others to the whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix, vocab = spec["model"]["end_of_word_suffix"], spec["model"]["vocab"]
        self.plain = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": None, "added_tokens": [], "truncation": None, "padding": None}))
        self.plain.pre_tokenizer = WhitespaceSplit()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.symbols = {b: c for c, b in bpe.byte_symbols().items()}
        # Other pieces stand between the string of a special token.
        self.mark, self.mark_id = next(((t.content, i) for i, t in self.whole.get_added_tokens_decoder().items() if t.special), (None, None))

    def encode_words(self, new: list[str]) -> bpe.Runs:
        spelled = [w if w.isascii() else w.encode().decode("latin-1").translate(self.symbols) for w in new]
        runs = [" ".join(spelled[i : i + 1000]) for i in range(0, len(new), 1000)]
        found = [np.array(x.ids, np.uint32) for x in self.plain.encode_batch_fast(runs, add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, np.uint32), *found])
        return bpe.Runs(ids, np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1]))

    def encode_pieces(self, new: list[str]) -> bpe.Runs:
        alone = [i for i, p in enumerate(new) if self.mark is None or "<" in p]
        rest = [i for i, p in enumerate(new) if self.mark is not None and "<" not in p]
        out: list = [None] * len(new)
        for i, found in zip(alone, self.whole.encode_batch_fast([new[i] for i in alone], add_special_tokens=False)):
            out[i] = found.ids
        runs = [rest[i : i + 500] for i in range(0, len(rest), 500)]
        for run, found in zip(runs, self.whole.encode_batch_fast([self.mark.join(new[i] for i in r) for r in runs], add_special_tokens=False)):
            ids = found.ids
            cuts = [i for i, x in enumerate(ids) if x == self.mark_id]
            for i, a, b in zip(run, [0, *(c + 1 for c in cuts)], [*cuts, len(ids)]):
                out[i] = ids[a:b]
        return bpe.Runs.of(out)

    def encode(self, texts) -> bpe.Runs:
        """Of an Arrow column of texts."""
        return bpe.encode_texts(texts, self.encode_words, self.encode_pieces)


_encoders: dict[str, LibraryEncoder] = {}


def _encoder(path: str) -> LibraryEncoder:
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, path: str | None, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every document's ids, cut into whole windows and a rest. With ``with_ids`` also the ids of each piece."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(bpe.VOCABULARY)
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            for part in bpe.chunks(batch, "text"):
                out: list[tuple] = []
                ids = encoder.encode(part.column("text"))
                flat, cuts = ids.ids.tobytes(), (4 * ids.offsets).tolist()
                for doc, a, b in zip(part.column("doc_id").to_pylist(), cuts[:-1], cuts[1:]):
                    data = memoryview(flat[a:b] + end)
                    total = len(data) // 4
                    for start in range(0, total, window):
                        piece = data[4 * start : 4 * (start + window)]
                        out.append((doc, start, len(piece) // 4, zlib.crc32(piece), total, *([bytes(piece)] if with_ids else [])))
                columns = list(zip(*out))
                kinds = [pa.int64()] * 5 + [pa.binary()] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(kinds)])
        kernels.release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES + ", ids binary" * with_ids)


def combinations(units: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Non-increasing tuples of up to ``depth`` positive integers with sum ``units``."""
    out = [(units,)]
    for a in range(1, units):
        if depth >= 2 and a >= units - a:
            out.append((a, units - a))
        for b in range(1, a + 1) if depth >= 3 else ():
            c = units - a - b
            if 0 < c <= b:
                out.append((a, b, c))
    return out


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """x >= 0 that makes |a x - b| least: an active-set method that frees one column at a time."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    gram_b = a.T @ b
    for _ in range(3 * min(a.shape)):
        gain = gram_b - a.T @ (a[:, free] @ x[free])
        gain[free] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= tolerance * max(1.0, float(np.abs(gram_b).max())):
            break
        free[best] = True
        while True:
            of = np.flatnonzero(free)
            z = np.linalg.lstsq(a[:, of], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[of] = z
                break
            bad = z <= 0
            step = np.min(x[of][bad] / np.maximum(x[of][bad] - z[bad], 1e-300))
            x[of] += step * (z - x[of])
            drop = of[(x[of] <= 1e-12) & bad]
            drop = drop if len(drop) else of[bad][:1]
            x[drop] = 0
            free[drop] = False
            if not free.any():
                break
    return x


def plan(histogram: np.ndarray, window: int = WINDOW, unit: int = CLASS, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Patterns of lengths with their repeats, for a histogram of lengths 0 to window - 1.

    Returns rows (pattern, length, offset) and the repeats of each pattern; every length occurs in the
    patterns, times repeats, as often as in the histogram.
    """
    left = histogram.astype(np.int64).copy()
    units = -(-window // unit)
    of_class = [np.arange(max(1, c * unit - unit + 1), min(window - 1, c * unit) + 1) for c in range(1, units + 1)]
    count = np.array([left[c].sum() for c in of_class], float)
    patterns: list[list[int]] = []
    repeats: list[int] = []

    def use(lengths: list[int], times: int) -> None:
        patterns.append(lengths)
        repeats.append(times)
        for n in lengths:
            left[n] -= times

    if count.sum():
        full = combinations(units, depth)
        full = [c for c in full if all(count[k - 1] for k in c)]
        if full:
            a = np.zeros((units, len(full)))
            for j, c in enumerate(full):
                for k in c:
                    a[k - 1, j] += 1
            wanted = np.floor(nonnegative_least_squares(a, count) + 1e-6).astype(np.int64)
            # A class's count is met with its own lengths, longest first.
            for j in np.argsort(-wanted, kind="stable"):
                times = int(wanted[j])
                while times > 0:
                    took: list[int] = []
                    spare = left.copy()
                    for k in full[j]:
                        some = [n for n in of_class[k - 1][::-1] if spare[n] > 0]
                        if not some:
                            break
                        took.append(int(some[0]))
                        spare[some[0]] -= 1
                    if len(took) < len(full[j]):
                        break
                    each = min(int(left[n]) // took.count(n) for n in set(took))
                    each = min(each, times)
                    use(took, each)
                    times -= each
        # Greedily: open with the longest length left, then fill with the longest that fits.
        while left.any():
            room, took, spare = window, [], left.copy()
            while True:
                some = np.flatnonzero(spare[: room + 1] > 0)
                if not len(some):
                    break
                n = int(some[-1])
                took.append(n)
                spare[n] -= 1
                room -= n
            use(took, max(1, min(int(left[n]) // took.count(n) for n in set(took))))
    rows = [(p, n, sum(lengths[:i])) for p, lengths in enumerate(patterns) for i, n in enumerate(lengths)]
    return np.array(rows, np.int64).reshape(-1, 3), np.array(repeats, np.int64)


def places(rows: np.ndarray, repeats: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the ranks at which its slots begin, the sequence of each slot's first use, its offset."""
    first = np.cumsum(repeats) - repeats
    out: dict[int, list] = {}
    for p, n, offset in rows.tolist():
        out.setdefault(n, []).append((int(repeats[p]), int(first[p]), offset))
    return {n: (np.cumsum([0, *(s[0] for s in slots[:-1])]), np.array([s[1] for s in slots]), np.array([s[2] for s in slots])) for n, slots in out.items()}


def packed(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False, name: str = "packing") -> DataFrame:
    """PIECES of all documents with sequence_id and offset; sequences are padded to the window by the reader."""
    table = scratch.Table(pieces(docs, path, window, end_id, with_ids), name)
    # A length's pieces are ranked in groups, and the groups' sizes summed: as many groups as pieces in one.
    salt = F.pmod(F.xxhash64("doc_id", "start"), F.lit(math.isqrt(table.df.count()) + 1))
    cut = table.df.withColumn("salt", salt)
    sizes = scratch.Table(cut.groupBy("length", "salt").count(), name)
    # At most window lengths: the histogram.
    counts = {r["length"]: r["n"] for r in sizes.df.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    whole = counts.pop(window, 0)
    histogram = np.zeros(window, np.int64)
    for n, c in counts.items():
        histogram[n] = c
    rows, repeats = plan(histogram, window)
    at = places(rows, repeats)
    at[window] = (np.array([0]), np.array([int(repeats.sum())]), np.array([0]))
    total = int(repeats.sum()) + whole
    sent = docs.sparkSession.sparkContext.broadcast(at)

    from pyspark.sql import Window

    before = sizes.df.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("count")).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(order) - 1).join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "salt")
    shape = ranked.drop("rank").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).select(*table.df.columns, "sequence_id", "offset").schema

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length).tolist():
                of = length == n
                starts, firsts, offsets = sent.value[n]
                slot = np.searchsorted(starts, rank[of], "right") - 1
                sequence[of] = firsts[slot] + rank[of] - starts[slot]
                offset[of] = offsets[slot]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in shape.names[:-2]), pa.array(sequence), pa.array(offset)], shape.names)

    out = ranked.mapInArrow(place, shape)
    out.sequences = total
    return out


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
