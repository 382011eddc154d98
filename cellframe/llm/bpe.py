"""BPE encoding by backtracking over longest token matches, decoding by an offset table.

An Aho-Corasick automaton over all tokens gives the longest token that starts at each place of a word. The
encoder takes it if it is compatible with the token before, else the next shorter token that starts there;
where none is left it goes one token back and marks the place as a dead end, so each place is left at most
once and the result is exactly that of the merges. Two tokens are compatible if merging their joined text
gives these two tokens again, which a walk down the seam between them decides; answers are kept in a table.

The vocabulary is a tokenizers file with a BPE model, byte-level symbols and a word-end suffix. The driver
reads it and sends its few MB to the executors. Text is cut at ASCII white space, and each distinct piece is
encoded once in each chunk of text.

Edge cases: null text is empty, an empty text has no ids; the strings of special tokens become their ids;
rows and their order stay as they are; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import string
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels

VOCABULARY = "word_bpe_49k.json"
#: Words that a worker keeps encoded, and pairs of tokens that it keeps judged.
KEPT_WORDS = 250_000
#: Text bytes that a worker handles at a time.
CHUNK = 8 << 20

_END = "\xff"  # word end; no UTF-8 byte


def byte_symbols() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for U+0100 onwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """What the driver sends: the model of a tokenizers file."""

    def __init__(self, path: str | None = None):
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        with open(path, encoding="utf-8") as f:
            data = f.read()
        spec, self.key = json.loads(data), hashlib.sha256(data.encode()).hexdigest()
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.spec = json.dumps(spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": []})


class Encoder:
    """Exact merges of words, and of pieces of text without white space."""

    def __init__(self, v: Vocabulary):
        symbols, suffix = byte_symbols(), v.suffix

        def spelled(token: str) -> str:
            end = token.endswith(suffix) and len(token) > len(suffix)
            return "".join(chr(symbols[c]) for c in (token[: -len(suffix)] if end else token)) + _END * end

        size = max([*v.vocab.values(), *v.special.values()]) + 1
        self.length = [0] * size
        self.ids: dict[str, int] = {}
        for token, i in v.vocab.items():
            s = spelled(token)
            self.ids[s], self.length[i] = i, len(s)
        self.halves: list[tuple[int, int] | None] = [None] * size
        self.rank = [-1] * size
        self.pairs: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(v.merges):
            i = v.vocab[a + b]
            self.halves[i], self.rank[i], self.pairs[v.vocab[a], v.vocab[b]] = (v.vocab[a], v.vocab[b]), r, i
        self.automaton = ahocorasick.Automaton()
        for s, i in self.ids.items():
            self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()
        self.shorter: list[int | None] = [None] * size
        for s, i in self.ids.items():
            self.shorter[i] = next((self.ids[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in self.ids), None)
        self.fit: dict[int, bool] = {}
        self.known: dict[str, list[int]] = {}
        self.spec, self.library = v.spec, None
        self.split = regex.compile(v.pattern)
        self.special = v.special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(v.special, key=len, reverse=True))) + ")") if v.special else None

    def compatible(self, left: int, right: int) -> bool:
        """Merging the joined text of two tokens leaves the seam between them."""
        key = left << 32 | right
        rank, halves = self.rank, self.halves
        until_left = until_right = len(rank)  # ranks of the merges that take the tokens at the seam away
        good = True
        while True:
            joined = self.pairs.get((left, right))
            if joined is not None and rank[joined] < until_left and rank[joined] <= until_right:
                good = False
                break
            if rank[left] > rank[right]:
                until_left, left = rank[left], halves[left][1]
            elif halves[right]:
                until_right, right = rank[right], halves[right][0]
            else:
                break
        if len(self.fit) >= KEPT_WORDS:
            self.fit.clear()
        self.fit[key] = good
        return good

    def word(self, word: bytes) -> list[int]:
        s = word.decode("latin-1") + _END
        if (one := self.ids.get(s)) is not None:
            return [one]
        longest: dict[int, int] = {}
        for last, (i, n) in self.automaton.iter(s):
            longest[last + 1 - n] = i  # ends only grow, so the longest comes last
        total, length, shorter = len(s), self.length, self.shorter
        dead = {total - 1}  # a word end by itself is no token
        fit = self.fit
        out: list[int] = []
        at, token = 0, longest[0]
        while at < total:
            after = at + length[token]
            if after not in dead and (not out or (self.compatible(out[-1], token) if (good := fit.get(out[-1] << 32 | token)) is None else good)):
                out.append(token)
                at = after
                token = longest.get(at, -1)
            elif shorter[token] is not None:
                token = shorter[token]
            else:
                dead.add(at)
                token = out.pop()
                at -= length[token]
        return out

    def cut_words(self, part: str) -> list[str]:
        """Normalised words. For letters past U+017F by the library, whose Unicode tables are its own."""
        if part.isascii():
            return self.split.findall(part.lower())
        if max(part) < "\u0180":
            return self.split.findall(unicodedata.normalize("NFC", part).lower())
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.spec)
        normal = self.library.normalizer.normalize_str(part)
        return [normal[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def _kept(self, word: str) -> list[int]:
        ids = self.known.get(word)
        if ids is None:
            ids = self.word(word.encode())
            if len(self.known) >= KEPT_WORDS:
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode_words(self, new: list[str]) -> "Runs":
        """Of lower-case words of Latin letters."""
        return Runs.of([self._kept(w) for w in new])

    def encode_pieces(self, new: list[str]) -> "Runs":
        """Of any pieces."""
        out = []
        for piece in new:
            ids: list[int] = []
            for part in self.cut.split(piece) if self.cut and "<" in piece else (piece,):
                if part in self.special:
                    ids.append(self.special[part])
                else:
                    for w in self.cut_words(part):
                        ids += self._kept(w)
            out.append(ids)
        return Runs.of(out)

    def encode(self, texts) -> "Runs":
        """Of an Arrow column of texts."""
        return encode_texts(texts, self.encode_words, self.encode_pieces)


class Runs:
    """Runs of ids end to end, and where each starts."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray):
        self.ids, self.offsets = ids, offsets

    @staticmethod
    def of(lists: list[list[int]]) -> "Runs":
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))])
        return Runs(np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(offsets[-1])), offsets)

    @staticmethod
    def joined(parts: list["Runs"]) -> "Runs":
        shifts = np.cumsum([0, *(len(p.ids) for p in parts)])
        return Runs(np.concatenate([p.ids for p in parts]), np.concatenate([[0], *(p.offsets[1:] + s for p, s in zip(parts, shifts))]).astype(np.int64))

    def take(self, which: np.ndarray) -> "Runs":
        size = np.diff(self.offsets)[which]
        offsets = np.concatenate([[0], np.cumsum(size)])
        return Runs(self.ids[np.repeat(self.offsets[:-1][which] - offsets[:-1], size) + np.arange(offsets[-1])], offsets)

    def binary(self) -> pa.Array:
        """Each run as little-endian 32-bit integers."""
        return pa.Array.from_buffers(pa.binary(), len(self.offsets) - 1, [None, pa.py_buffer((4 * self.offsets).astype(np.int32)), pa.py_buffer(self.ids)])


#: Marks at the end of a word that are a run of their own.
_MARKS = string.punctuation
#: Words of Latin letters up to U+017F, without U+0130, which has no lower-case letter of its own.
_LATIN = "^[A-Za-zªµº\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+$"


def encode_texts(column, words, others) -> Runs:
    """One run for each text. ``words`` encodes lower-case words of Latin letters, ``others`` any pieces
    without ASCII white space; each is asked once for each distinct one of the column."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).fill_null("")
    split = pc.ascii_split_whitespace(column)
    coded = split.flatten().dictionary_encode()
    pieces, at = coded.dictionary, coded.indices.to_numpy()
    core = pc.utf8_rtrim(pieces, characters=_MARKS)
    latin = pc.match_substring_regex(core, _LATIN)
    plain = np.flatnonzero(latin.to_numpy(zero_copy_only=False))
    rest = np.flatnonzero(~latin.to_numpy(zero_copy_only=False))
    low = pc.utf8_lower(core.take(pa.array(plain))).dictionary_encode()
    marks = pc.replace_substring_regex(pieces.take(pa.array(plain)), "^[^!-/:-@\\[-`{-~]+", "").dictionary_encode()
    parts = [words(low.dictionary.to_pylist()), others(marks.dictionary.to_pylist()), others(pieces.take(pa.array(rest)).to_pylist()), Runs.of([[]])]
    base = np.cumsum([0, *(len(p.offsets) - 1 for p in parts)])
    pair = np.full((len(pieces), 2), base[3])
    pair[plain, 0] = low.indices.to_numpy()
    pair[plain, 1] = marks.indices.to_numpy() + base[1]
    pair[rest, 0] = np.arange(len(rest)) + base[2]
    found = Runs.joined(parts).take(pair[at].ravel())
    first = np.asarray(split.offsets, np.int64) - split.offsets[0].as_py()
    return Runs(found.ids, found.offsets[2 * first])


class Decoder:
    """All tokens end to end, and where each starts."""

    def __init__(self, v: Vocabulary):
        names = {i: s for s, i in [*v.vocab.items(), *v.special.items()]}
        data = [(names.get(i, "") + " ").encode() for i in range(max(names) + 1)]
        self.bytes = np.frombuffer(b"".join(data), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The tokens' text with spaces between them, and one at the end."""
        start, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        end = np.cumsum(size)
        return self.bytes[np.repeat(start - end + size, size) + np.arange(end[-1] if len(end) else 0)]


_made: dict[tuple, object] = {}


def worker(kind: type, key: str, sent):
    """The worker's own encoder or decoder for the broadcast vocabulary that ``key`` names."""
    if (kind, key) not in _made:
        _made[kind, key] = kind(sent.value)
    return _made[kind, key]


def chunks(batch: pa.RecordBatch, column: str, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of some bytes of a text column."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    total = np.cumsum(np.asarray(lengths, np.int64))
    at = 0
    while at < len(total):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, to - at)
        at = to


def encode(docs: DataFrame, text: str = "text", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep`` (default doc_id), and ``ids``: binary, unsigned little-endian 32-bit integers."""
    keep = ["doc_id"] if keep is None else keep
    vocabulary = Vocabulary(path)
    key, sent = vocabulary.key, docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker(Encoder, key, sent)
        for batch in batches:
            for part in chunks(batch, "_text"):
                ids = encoder.encode(part.column("_text")).binary()
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), ids], [*keep, "ids"])

    source = docs.select(*keep, F.col(text).alias("_text"))
    return source.mapInArrow(run, docs.select(*keep, F.lit(b"").alias("ids")).schema)


def _texts(ids: Runs, decoder: Decoder) -> pa.Array:
    size = decoder.offsets[ids.ids + 1] - decoder.offsets[ids.ids]
    total = np.concatenate([[0], np.cumsum(size)])[ids.offsets]
    data = decoder.decode(ids.ids.astype(np.int64))
    # Each text ends with a space that is not its own.
    keep = np.ones(len(data), bool)
    some = np.diff(total) > 0
    keep[total[1:][some] - 1] = False
    offsets = np.concatenate([[0], np.cumsum(np.diff(total) - some)])
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[keep])]).cast(pa.string())


def _runs(column) -> Runs:
    buf, offsets = kernels.byte_buffer(column)
    return Runs(np.frombuffer(buf.tobytes(), np.uint32), offsets // 4)


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """All columns, and ``decoded``: the text of ``ids``, as tokens without a decoder are joined."""
    vocabulary = Vocabulary(path)
    key, sent = vocabulary.key, coded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = worker(Decoder, key, sent)
        for batch in batches:
            for part in chunks(batch, "ids"):
                texts = _texts(_runs(part.column("ids")), decoder)
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, "decoded"])

    return coded.mapInArrow(run, coded.withColumn("decoded", F.lit("")).schema)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, decoded: encoding and decoding in one worker, so that ids do not cross to the JVM between."""
    vocabulary = Vocabulary(path)
    key, sent = vocabulary.key, docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = worker(Encoder, key, sent), worker(Decoder, key, sent)
        for batch in batches:
            for part in chunks(batch, "text"):
                ids = encoder.encode(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids.binary(), _texts(ids, decoder)], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id", F.lit(b"").alias("ids"), F.lit("").alias("decoded")).schema)


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    both = round_trip(docs)
    return both.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
