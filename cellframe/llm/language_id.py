"""Language identification of mixed text: script ranges, word scores, and Viterbi with a switching penalty.

A language's model is the log frequency of hashed byte trigrams of lower-cased words, fitted on a bounded
sample of labelled rows, and the scripts that its words use. A word scores the sum of its trigrams in each
language that has its script. Viterbi over a document's words, with a penalty for each change of language,
labels its spans; the prediction is the language with most letters, its score their share.

Edge cases: null text and text without a letter are "und" with score 0; without any labelled row all others
are "und" too; a word in a script that no language uses has no weight, and a text of such words alone gets the first
language with score 0; equal weights go to the first language in order of name; rows stay rows, so repeated
ones repeat; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, kernels

#: Labelled rows of a language that are used, about; hashed trigrams; cost of a change of language, in nats.
SAMPLE = 1500
TRIGRAMS = 1 << 15
PENALTY = 12.0
#: A language has a script if so much of its words are in it.
SCRIPT_SHARE = 0.01
CHUNK = 8 << 20
#: First code points of script ranges, and the script's number. Fixed values.
SCRIPT_RANGES = (
    (0x0000, 0),  # Latin
    (0x0370, 1),  # Greek
    (0x0400, 2),  # Cyrillic
    (0x0530, 3),  # Armenian
    (0x0590, 4),  # Hebrew
    (0x0600, 5),  # Arabic
    (0x0900, 6),  # Devanagari
    (0x0980, 7),  # other Indic
    (0x0E00, 8),  # Thai
    (0x0E80, 9),  # other South-East Asian
    (0x10A0, 10),  # Georgian
    (0x1100, 11),  # Hangul
    (0x1200, 9),
    (0x1E00, 0),
    (0x1F00, 1),
    (0x2000, 0),
    (0x3040, 12),  # Kana
    (0x3130, 11),
    (0x3190, 13),  # Han
    (0xAC00, 11),
    (0xD7B0, 9),
    (0xF900, 13),
    (0xFB00, 0),
    (0x10000, 9),
    (0x1D400, 0),
    (0x20000, 13),
    (0x40000, 0),
)
SCRIPTS = 14


def _word_table() -> np.ndarray:
    """Bytes of words stay, all other ASCII becomes a space."""
    table = np.arange(256, dtype=np.uint8)
    table[:128] = 32
    table[97:123] = np.arange(97, 123)
    return table


_WORD_BYTES = _word_table()
_FIRSTS = np.array([a for a, _ in SCRIPT_RANGES])
_NUMBERS = np.array([s for _, s in SCRIPT_RANGES])


class Words:
    """Words of some texts: their trigram buckets, scripts and places."""

    def __init__(self, texts: list[str]):
        data = [(t or "").lower().encode("utf-8", "replace") for t in texts]
        sizes = np.array([len(d) + 1 for d in data], np.int64)
        buf = np.frombuffer(b" " + b" ".join(data) + b" ", np.uint8)
        self.buf = _WORD_BYTES[buf]
        offsets = np.concatenate([[1], 1 + np.cumsum(sizes)])
        self.starts, self.ends, self.by_doc = kernels.words(self.buf[: offsets[-1]], offsets)
        self.size = self.ends - self.starts

    def buckets(self, at: np.ndarray) -> np.ndarray:
        """Of the trigrams round the given bytes."""
        b = self.buf
        code = b[at - 1].astype(np.uint32) << 16 | b[at].astype(np.uint32) << 8 | b[at + 1]
        return (code * np.uint32(2654435761)) >> np.uint32(17)

    def scripts(self) -> np.ndarray:
        """The highest script number of each word's characters beyond ASCII, else Latin."""
        b = self.buf.astype(np.int32)
        mark = np.zeros(len(b) + 1, np.uint8)
        two = np.flatnonzero((b[:-1] >= 0xC0) & (b[:-1] < 0xE0))
        three = np.flatnonzero((b[:-2] >= 0xE0) & (b[:-2] < 0xF0))
        four = np.flatnonzero(b[:-3] >= 0xF0)
        codes = (
            (two, (b[two] & 31) << 6 | b[two + 1] & 63),
            (three, (b[three] & 15) << 12 | (b[three + 1] & 63) << 6 | b[three + 2] & 63),
            (four, (b[four] & 7) << 18 | (b[four + 1] & 63) << 12 | (b[four + 2] & 63) << 6 | b[four + 3] & 63),
        )
        for at, code in codes:
            mark[at] = _NUMBERS[np.searchsorted(_FIRSTS, code, "right") - 1]
        return np.maximum.reduceat(mark, np.stack([self.starts, self.ends], 1).ravel())[::2] if len(self.starts) else np.zeros(0, np.uint8)

    def positions(self, first: int, last: int) -> np.ndarray:
        """The bytes of words first to last - 1."""
        size = self.size[first:last]
        return np.repeat(self.starts[first:last] - np.cumsum(size) + size, size) + np.arange(size.sum())


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray):
        """counts: [language, TRIGRAMS + SCRIPTS]."""
        self.languages = languages
        grams, scripts = counts[:, :TRIGRAMS] + 0.5, counts[:, TRIGRAMS:]
        self.logs = np.ascontiguousarray(np.log(grams / grams.sum(1, keepdims=True)).T, np.float32)
        has = scripts > SCRIPT_SHARE * scripts.sum(1, keepdims=True)
        #: Scripts that some language has.
        self.used = has.any(0)
        has[:, ~self.used] = True
        self.allowed = np.where(has.T, 0, -1000).astype(np.float32)

    def scores(self, words: Words) -> np.ndarray:
        out = np.zeros((len(words.starts), len(self.languages)), np.float32)
        step = 1 << 17
        for a in range(0, len(out), step):
            b = min(len(out), a + step)
            size = words.size[a:b]
            out[a:b] = np.add.reduceat(self.logs[words.buckets(words.positions(a, b))], np.cumsum(size) - size, axis=0)
        return out + self.allowed[words.scripts()]


def viterbi(scores: np.ndarray, by_doc: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word, all documents in step; by_doc: n + 1 word offsets."""
    sizes = np.diff(by_doc)
    order = np.argsort(-sizes, kind="stable")
    first, sizes = by_doc[:-1][order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), "left")
    best_before = np.zeros(len(scores), np.int16)
    changed = np.zeros(scores.shape, bool)
    value = np.zeros((len(sizes), scores.shape[1]), np.float32)
    for t in range(longest):
        k = active[t]
        at, v = first[:k] + t, value[:k]
        if t:
            best = v.argmax(1)
            best_before[at] = best
            switch = v[np.arange(k), best][:, None] - np.float32(penalty)
            changed[at] = v < switch
            v = np.maximum(v, switch)
        value[:k] = v + scores[at]
    label = np.zeros(len(scores), np.int16)
    now = value.argmax(1).astype(np.int16)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at = first[:k] + t
        here = now[:k]
        label[at] = here
        now[:k] = np.where(changed[at, here], best_before[at], here)
    return label


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def fit(docs: DataFrame, doc_id: str, text: str, lang: str, sample: int = SAMPLE) -> Model:
    """Count trigrams and scripts of a sample of about ``sample`` rows of each language, outside the held-out
    fold. What comes to the driver is a count for each language and bucket."""
    rows = docs.where(F.col(lang).isNotNull() & F.coalesce(~held_out(doc_id), F.lit(True)))
    sizes = {r[lang]: r["count"] for r in rows.groupBy(lang).count().collect()}
    part = F.coalesce(*[F.when(F.col(lang) == k, F.lit(min(1.0, sample / n))) for k, n in sizes.items()], F.lit(0.0))
    rows = rows.where(F.pmod(F.xxhash64(F.col(doc_id), F.lit(1)), F.lit(1 << 30)) < part * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in bpe.chunks(batch, "text", CHUNK):
                names, of = np.unique(np.array(piece.column("lang").to_pylist(), object).astype(str), return_inverse=True)
                words = Words(piece.column("text").to_pylist())
                lang_of = of[np.repeat(np.arange(len(of)), np.diff(words.by_doc))]
                key = np.concatenate([np.repeat(lang_of, words.size) * (TRIGRAMS + SCRIPTS) + words.buckets(words.positions(0, len(words.starts))), lang_of * (TRIGRAMS + SCRIPTS) + TRIGRAMS + words.scripts()])
                key, n = np.unique(key.astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names[key // (TRIGRAMS + SCRIPTS)].tolist(), pa.string()), pa.array(key % (TRIGRAMS + SCRIPTS)), pa.array(n)], ["lang", "bucket", "n"])

    counted = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).mapInArrow(count, "lang string, bucket long, n long")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(map(str, sizes))
    counts = np.zeros((len(languages), TRIGRAMS + SCRIPTS))
    at = {k: i for i, k in enumerate(languages)}
    counts[[at[k] for k in table.column("lang").to_pylist()], table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return Model(languages, counts)


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", penalty: float = PENALTY, spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score; with ``spans`` also the runs of words of one language: first word, number of
    words, language."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    shape = "doc_id long, lang_pred string, score double" + ", spans array<struct<first: int, words: int, lang: string>>" * spans

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for piece in bpe.chunks(batch, "text", CHUNK):
                texts = piece.column("text").to_pylist()
                words = Words(texts)
                n = len(model.languages)
                labels = viterbi(model.scores(words), words.by_doc, penalty) if n else np.zeros(len(words.starts), np.int16)
                doc = np.repeat(np.arange(len(texts)), np.diff(words.by_doc))
                size = words.size * model.used[words.scripts()]
                weight = np.bincount(doc * max(1, n) + labels, size, len(texts) * max(1, n)).reshape(len(texts), -1)
                total, best = weight.sum(1), weight.argmax(1)
                known = np.array([bool(n) and any(map(str.isalpha, t or "")) for t in texts], bool)
                share = np.where(known, weight.max(1, initial=0) / np.maximum(total, 1), 0.0)
                columns = [piece.column("doc_id"), pa.array([model.languages[b] if k else "und" for b, k in zip(best, known)], pa.string()), pa.array(share)]
                if spans:
                    runs = []
                    for a, b, k in zip(words.by_doc[:-1].tolist(), words.by_doc[1:].tolist(), known):
                        own = labels[a:b]
                        cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), b - a] if k else [0]
                        runs.append([{"first": x, "words": y - x, "lang": model.languages[own[x]]} for x, y in zip(cuts[:-1], cuts[1:])])
                    columns.append(pa.array(runs, pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "spans"][: len(columns)])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(label, shape)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, fit(docs, "doc_id", "text", "lang"), spans=False)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
