"""Stupid-backoff language-model scores of a corpus by its own n-gram counts.

The counts of all n-grams of orders 1 to n are partitioned by hash range. Blocks of documents send their distinct
n-grams with counts to the owners of the ranges, who add them up over the whole corpus; the totals are joined back to
each block's n-grams, and a token's score is that of the longest n-gram that the corpus has often enough:
count(n-gram) / count(context), times ``backoff`` for each order given up. Scores are summed by document. The n-gram
of no words counts all tokens. A word that a third of all rows repeat is sent once by each block. N-grams travel as
coded lists, one for each block and owner, and not as one row each: the README says why. A block is worked off in
``PARTS`` parts, whose n-grams are merged before they are sent, so that messages are fewer and shorter.

A corpus that is its own model has every n-gram at least once, where a document has it; so a document is scored by the
counts of all others: its own occurrences are taken off each n-gram, each context and the number of words. A word that
no other document has counts as if it had been seen there once.

Edge cases: null or blank text has no tokens, a sum of 0 and no mean; the first tokens of a text have the
contexts they have; repeated rows count and are scored as rows; an empty table gives no rows; other columns
are ignored. N-grams are told apart by 64 bits of hash. A text is never split: it takes some 150 bytes of memory for each of its words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, kernels, scratch

ORDER = 3
BACKOFF = 0.4
#: Occurrences in other documents from which an n-gram of two or more words is known to the model.
LEAST_COUNT = 1
#: Bits of a hash.
BITS = 64
#: Parts of a block, of ``cellframe.blockBytes`` each, whose n-grams are told to an owner as one list; of the rest of
#: the work one part is in memory at a time.
PARTS = 4
_U = np.uint64
SCORES = "doc_id long, n_tokens long, log10_sum double"


class _Grams:
    """The n-grams of a block's documents."""

    def __init__(self, table: pa.Table, order: int):
        self.table = table
        buf, offsets = kernels.text_buffer(table.column("text"))
        starts, ends, self.by_doc = kernels.words(buf, offsets)
        h = kernels.word_hashes(buf, starts, ends)
        self.n = len(h)
        sizes = np.diff(self.by_doc)
        end = np.repeat(self.by_doc[1:], sizes)
        #: Words from each word to the end of its document.
        self.room = end - np.arange(self.n)
        self.order = order
        empty = np.full(self.n, kernels.ngram_hashes(np.zeros(0, _U), 0)[0])
        hashes = [empty] + [np.where(self.room >= o, np.pad(kernels.ngram_hashes(h, o), (0, min(o - 1, self.n))), _U(0)) for o in range(1, order + 1)]
        self.valid = [np.ones(self.n, bool)] + [self.room >= o for o in range(1, order + 1)]
        self.flat = np.concatenate([x[v] for x, v in zip(hashes, self.valid)])

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams, sorted, and their counts."""
        h = np.sort(self.flat)
        first = np.flatnonzero(~blocks.same_as_before(h))
        return h[first], np.diff(first, append=len(h)).astype(np.uint32)

    def place(self) -> np.ndarray:
        """The distinct n-grams; ``at``: by order the place among them of the n-gram that begins at each word, or -1."""
        self.distinct, at = np.unique(self.flat, return_inverse=True)
        self.at, stop = [], 0
        for v in self.valid:
            place = np.full(self.n, -1, np.int64)
            place[v] = at[stop : stop + v.sum()]
            stop += v.sum()
            self.at.append(place)
        return self.distinct

    def _others(self, at: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """Occurrences outside its own document of the n-gram that begins at each word (where one does)."""
        here = np.flatnonzero(at >= 0)
        out = np.zeros(self.n)
        doc = np.repeat(np.arange(len(self.by_doc) - 1), np.diff(self.by_doc))[here]
        _, where, own = np.unique(doc * (len(self.distinct) + 1) + at[here], return_inverse=True, return_counts=True)
        out[here] = totals[at[here]] - own[where]
        return out

    def scores(self, totals: np.ndarray, backoff: float, least: int) -> np.ndarray:
        """log10 of each word's score; totals: of the distinct n-grams in the corpus."""
        others = [self._others(at, totals) for at in self.at]
        before = np.repeat(np.diff(self.by_doc), np.diff(self.by_doc)) - self.room
        word = np.arange(self.n)
        out, open_ = np.zeros(self.n), np.ones(self.n, bool)
        given_up = np.zeros(self.n)
        for o in range(self.order, 0, -1):
            can = np.flatnonzero(open_ & (before >= o - 1))
            first = word[can] - o + 1
            count = others[o][first]
            if o == 1:
                count = np.maximum(count, 1)
            known = count >= (least if o > 1 else 1)
            of = can[known]
            context = np.maximum(others[o - 1][first[known]], 1)
            out[of] = np.log10(count[known] / context) + given_up[of] * np.log10(backoff)
            open_[of] = False
            given_up[can[~known]] += 1
        return out


def _parts(table: pa.Table, size: int) -> list[pa.Table]:
    """Runs of rows with some ``size`` bytes of text, and what the last row has beyond."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(table.column("text")), 0)).astype(np.int64)
    first = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // size, prepend=-1))
    return [table.slice(a, b - a) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(sizes)])]


def _counts(parts: list[pa.Table], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of all parts and their counts."""
    found = [_Grams(p, order).counts() for p in parts]
    if len(found) == 1:
        return found[0]
    h, count = (np.concatenate(x) for x in zip(*found))
    order_ = np.argsort(h, kind="stable")  # runs that are sorted already are merged
    h = h[order_]
    first = np.flatnonzero(~blocks.same_as_before(h))
    return h[first], np.add.reduceat(count[order_], first, dtype=np.uint32) if len(first) else count


def scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, least: int = LEAST_COUNT, doc_id: str = "doc_id", text: str = "text", name: str = "ngrams") -> DataFrame:
    """doc_id, n_tokens, log10_sum, mean_log10, perplexity of every row."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = int(docs.sparkSession.conf.get("cellframe.blockBytes", str(blocks.BLOCK_BYTES)))
    table = blocks.build(docs, name, block_bytes=PARTS * size)
    grams = order * blocks.totals(table.df)[1] // 4
    bits, owners = BITS, blocks.owners_for(docs.sparkSession, grams)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                distinct, count = _counts(_parts(blocks.unpack(payload), size), order)
                yield blocks.send(block, distinct, bits, owners, lambda a, b: zlib.compress(blocks.planes(count[a:b]), 1))

    def add_up(h: np.ndarray, sender: np.ndarray, extras: list[bytes]) -> np.ndarray:
        count = np.concatenate([blocks.from_planes(zlib.decompress(x), np.uint32) for x in extras])
        _, at = np.unique(h, return_inverse=True)
        return np.bincount(at, count).astype(np.uint64)[at]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = _parts(blocks.unpack(left.column("payload")[0]), size)
        distinct, _ = _counts(parts, order)
        totals = blocks.heard(distinct, bits, owners, right, np.uint64)
        return pa.concat_tables([scored(p, distinct, totals) for p in parts])

    def scored(part: pa.Table, distinct: np.ndarray, totals: np.ndarray) -> pa.Table:
        grams = _Grams(part, order)
        each = grams.scores(totals[np.searchsorted(distinct, grams.place())].astype(np.float64), backoff, least)
        size = np.diff(grams.by_doc)
        total = np.zeros(len(size))
        if len(each):
            total[size > 0] = np.add.reduceat(each, grams.by_doc[:-1][size > 0])
        return pa.table({"doc_id": grams.table.column("doc_id"), "n_tokens": size, "log10_sum": total})

    replies = scratch.Table(blocks.ask(table.df.mapInArrow(tell, blocks.SENT), bits, owners, add_up), name)
    out = table.df.groupBy("block").cogroup(replies.df.groupBy("block")).applyInArrow(score, SCORES)
    mean = F.when(F.col("n_tokens") > 0, F.col("log10_sum") / F.col("n_tokens"))
    return out.withColumn("mean_log10", mean).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("mean_log10")))


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    found = scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_tokens", (F.round("log10_sum", 4) + F.lit(0.0)).alias("log10_sum"), (F.round("mean_log10", 4) + F.lit(0.0)).alias("mean_log10"))


OP3_SQL = """
WITH texts AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM texts),
words AS (SELECT doc_id, i, w[i] AS a, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS c FROM places),
one AS (SELECT a, count(*) AS n FROM words GROUP BY a),
two AS (SELECT b, a, count(*) AS n FROM words WHERE i > 1 GROUP BY b, a),
three AS (SELECT c, b, a, count(*) AS n FROM words WHERE i > 2 GROUP BY c, b, a),
own0 AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
own1 AS (SELECT doc_id, a, count(*) AS n FROM words GROUP BY doc_id, a),
own2 AS (SELECT doc_id, b, a, count(*) AS n FROM words WHERE i > 1 GROUP BY doc_id, b, a),
own3 AS (SELECT doc_id, c, b, a, count(*) AS n FROM words WHERE i > 2 GROUP BY doc_id, c, b, a),
counts AS (
  SELECT t.doc_id, t.i, three.n - own3.n AS n3, before.n - own_before.n AS n_before, two.n - own2.n AS n2, last.n - own_last.n AS n_last,
    one.n - own1.n AS n1, (SELECT count(*) FROM words) - own0.n AS n0
  FROM words t
  JOIN one ON one.a = t.a JOIN own0 ON own0.doc_id = t.doc_id JOIN own1 ON own1.doc_id = t.doc_id AND own1.a = t.a
  LEFT JOIN two ON two.b = t.b AND two.a = t.a LEFT JOIN own2 ON own2.doc_id = t.doc_id AND own2.b = t.b AND own2.a = t.a
  LEFT JOIN three ON three.c = t.c AND three.b = t.b AND three.a = t.a LEFT JOIN own3 ON own3.doc_id = t.doc_id AND own3.c = t.c AND own3.b = t.b AND own3.a = t.a
  LEFT JOIN one AS last ON last.a = t.b LEFT JOIN own1 AS own_last ON own_last.doc_id = t.doc_id AND own_last.a = t.b
  LEFT JOIN two AS before ON before.b = t.c AND before.a = t.b LEFT JOIN own2 AS own_before ON own_before.doc_id = t.doc_id AND own_before.b = t.c AND own_before.a = t.b
),
scored AS (
  SELECT doc_id,
    CASE WHEN n3 >= 1 THEN log10(n3 / n_before)
         WHEN n2 >= 1 THEN log10(n2 / n_last) + CASE WHEN i > 2 THEN log10(0.4) ELSE 0 END
         ELSE log10(greatest(n1, 1) / greatest(n0, 1)) + (least(i, 3) - 1) * log10(0.4) END AS s
  FROM counts
)
SELECT texts.doc_id, len(w)::BIGINT AS n_tokens, round(coalesce(x, 0), 4) + 0.0 AS log10_sum, round(x / len(w), 4) + 0.0 AS mean_log10
FROM texts LEFT JOIN (SELECT doc_id, sum(s) AS x FROM scored GROUP BY doc_id) AS y USING (doc_id)
"""
