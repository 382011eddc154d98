"""Exact n-gram Jaccard join by grouped prefixes, with the connected components of its links.

A document is the set of its distinct word n-grams. The n-grams are ordered by document frequency (rarest
first), which blocks learn from the owners of hash ranges. Two sets at or above the threshold share an
n-gram within their prefixes; sets with one size and one prefix make a group. Groups that meet at a prefix
n-gram are first compared with the best-placed group of that n-gram only, a linear number of pairs. Where
that joins all, no other pair of the n-gram can add to the components; only pairs of groups in different
components go on, by bands of sizes, filtered by size and position, then expanded to their members.
Candidates come from 64-bit hashes; every link is verified on the words themselves. Sets count as equal by two
independent 64-bit hashes of all their n-grams.

Edge cases: null or blank text is an empty set with component doc_id; with fewer than n words all words
are one n-gram; equal sets are one item however many rows have them; rows stay rows, also those that share
an id, and each has the component of its own text; an empty table gives no rows; other columns are ignored. A
null doc_id is the smallest component only of itself: least ids ignore nulls. When near duplicates are dropped,
one row of each component stays: that of the least doc_id, nulls last, and of several such rows the first that was
written; rows without words all stay. A long text is one row of a block, and takes some 40 bytes of memory for
each of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import math
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, kernels, scratch
from .components import components

_U = np.uint64
SALTS = 64
DOCS = "doc_id long, block long, row int, n long, item binary, grp binary, tokens array<long>, ranks array<int>, body binary"


def _sets(table: pa.Table, n: int, twice: bool = False) -> list:
    buf, offsets = kernels.text_buffer(table.column("text"))
    starts, ends, by_doc = kernels.words(buf, offsets)
    other = kernels.word_hashes(buf, starts, ends, seed=1) if twice else None
    return kernels.shingle_sets(kernels.word_hashes(buf, starts, ends), by_doc, n, other)


def _cat(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, _U)


def _bits(n_bytes: int) -> int:
    """Bits of the hashes sent for frequencies; a chance match only makes an n-gram look shared."""
    return min(64, max(40, n_bytes.bit_length() + 8))


def least_overlap(size, percent: int):
    """Least intersection of a set of that size with any set at the threshold."""
    return (size * percent + 99) // 100


def described(docs: DataFrame, n: int, percent: int, name: str) -> tuple[scratch.Table, scratch.Table]:
    """DOCS: each document's set size, set and group keys, and the shared n-grams of its prefix with their ranks.
    And the blocks of the documents."""
    table = blocks.build(docs, name)
    n_bytes = blocks.totals(table.df)[1]
    bits, owners = _bits(n_bytes), blocks.owners_for(docs.sparkSession, n_bytes // 6)
    cut = _U(64 - bits)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                h, count = np.unique(_cat(_sets(blocks.unpack(payload), n)) >> cut, return_counts=True)
                count = np.minimum(count, 255).astype(np.uint8)
                yield blocks.send(block, h, bits, owners, lambda a, b: zlib.compress(count[a:b], 1))
        kernels.release()

    def answer(h: np.ndarray, sender: np.ndarray, extras: list[bytes]) -> np.ndarray:
        count = np.concatenate([np.frombuffer(zlib.decompress(x), np.uint8) for x in extras])
        _, at = np.unique(h, return_inverse=True)
        return np.log2(np.bincount(at, count)).astype(np.uint8)[at]

    def describe(left: pa.Table, right: pa.Table) -> pa.Table:
        kernels.release()
        docs = blocks.unpack(left.column("payload")[0])
        sets = _sets(docs, n, twice=True)
        sizes = np.array([len(s) for s, _ in sets], np.int64)
        flat, other = _cat([s for s, _ in sets]), _cat([s for _, s in sets])
        short, at = np.unique(flat >> cut, return_inverse=True)
        level = blocks.heard(short, bits, owners, right, np.uint8)[at]
        doc = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(doc * 256 + level, kind="stable")
        ranked, level = flat[order], level[order]
        rank = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        prefix = sizes - least_overlap(sizes, percent) + 1
        inside = rank < prefix[doc]
        starts = np.cumsum(sizes) - sizes

        def fold(values: np.ndarray, key: int) -> np.ndarray:
            total = np.zeros(len(values) + 1, _U)
            np.cumsum(kernels.mix(values ^ _U(key)), out=total[1:])
            return kernels.mix(total[starts + sizes] - total[starts] + sizes.astype(_U))

        item = np.stack([fold(flat, 1), fold(other, 2)], 1)
        hidden = np.where(inside, ranked, _U(0))
        grp = np.stack([fold(hidden, 3), fold(hidden, 4)], 1)
        emit = inside & (level > 0)
        found = np.bincount(doc[emit], minlength=len(sets))
        tokens, ranks = np.split(ranked[emit].astype(np.int64), np.cumsum(found)[:-1]), np.split(rank[emit].astype(np.int32), np.cumsum(found)[:-1])
        has = [bool(c) for c in found]
        small = zstandard.ZstdCompressor(level=1)
        texts = docs.column("text").combine_chunks().cast(pa.large_binary())
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "block": np.full(len(sets), left.column("block")[0].as_py()),
                "row": np.arange(len(sets), dtype=np.int32),
                "n": sizes,
                "item": pa.array([x.tobytes() for x in item], pa.binary()),
                "grp": pa.array([x.tobytes() for x in grp], pa.binary()),
                "tokens": pa.array([t if c else None for t, c in zip(tokens, has)], pa.list_(pa.int64())),
                "ranks": pa.array([t if c else None for t, c in zip(ranks, has)], pa.list_(pa.int32())),
                "body": pa.array([small.compress(t.as_buffer()) if c else None for t, c in zip(texts, has)], pa.binary()),
            }
        )

    sent = table.df.mapInArrow(tell, blocks.SENT)
    replies = scratch.Table(blocks.ask(sent, bits, owners, answer), name)
    out = scratch.Table(table.df.groupBy("block").cogroup(replies.df.groupBy("block")).applyInArrow(describe, DOCS), name)
    replies.drop()
    return out, table


def verified(pairs: DataFrame, bodies: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of items at or above the threshold, by the n-grams of their texts."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor()
        last, one = None, set()
        for batch in batches:
            a, b, x, y = (batch.column(i) for i in range(4))
            keep = []
            for key, s, t in zip(a.to_pylist(), x, y):
                if key != last:
                    last, one = key, kernels.shingles(plain.decompress(s.as_buffer()), n)
                two = kernels.shingles(plain.decompress(t.as_buffer()), n)
                both = len(one & two)
                keep.append(100 * both >= percent * (len(one) + len(two) - both))
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = bodies.toDF("a", "x"), bodies.toDF("b", "y")
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(check, "a binary, b binary")


def _fits(percent: int, a: str, b: str) -> str:
    """Sizes, and the overlap that the ranks of a common n-gram leave possible, allow the threshold."""
    return (
        f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) and "
        f"{100 + percent} * least({a}.n - {a}.rank, {b}.n - {b}.rank) >= {percent} * ({a}.n + {b}.n)"
    )


def _links(described: DataFrame, n: int, percent: int, name: str) -> DataFrame:
    """(node, label) of the items that are linked with a lesser one."""
    found = described.where("tokens is not null")
    used = [
        scratch.Table(found.select("item", "body").dropDuplicates(["item"]), name),
        scratch.Table(found.select("item", "grp", "n", "tokens", "ranks").dropDuplicates(["item"]), name),
    ]
    bodies, items = (t.df for t in used)
    members = items.select("grp", "item")
    groups = items.groupBy("grp").agg(F.min("item").alias("head"))
    lone = items.join(groups.select("head"), items["item"] == F.col("head"), "left_semi")
    tokens = lone.select("grp", F.col("item").alias("head"), "n", F.explode(F.arrays_zip("tokens", "ranks")).alias("t"))
    tokens = scratch.Table(tokens.select("grp", "head", "n", F.col("t.tokens").alias("token"), F.col("t.ranks").alias("rank")), name)
    used.append(tokens)
    tokens = tokens.df

    # Stars: by n-gram and band of sizes (two families of bands, so that near sizes share one), the group
    # whose n-gram ranks first against all others; and in each group its head against the other members.
    width = -math.log(percent / 100) or 1.0
    band = F.floor(F.log("n") / F.lit(width) + F.col("family") / 2)
    placed = tokens.withColumn("family", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("band", band)
    best = placed.groupBy("token", "family", "band").agg(F.min(F.struct("rank", "head", "n")).alias("c"), F.count(F.lit(1)).alias("size")).where("size > 1")
    best = best.select("token", "family", "band", F.col("c.rank").alias("rank"), F.col("c.n").alias("n"), F.col("c.head").alias("centre"))
    stars = placed.alias("p").join(best.alias("c"), ["token", "family", "band"]).where(F.expr("p.head != c.centre and " + _fits(percent, "p", "c"))).select("centre", "grp").distinct()
    pairs = stars.join(members, "grp").select(F.col("centre").alias("a"), F.col("item").alias("b"))
    pairs = pairs.union(groups.join(members, "grp").where("head != item").select(F.col("head").alias("a"), F.col("item").alias("b")))
    edges = scratch.Table(verified(pairs.distinct(), bodies, n, percent), name)
    used.append(edges)
    labels = scratch.materialize(components(edges.df, name), name)

    # What is left: n-grams at which groups of different components meet.
    named = members.join(labels, F.col("item") == F.col("node"), "left").select("grp", "item", F.coalesce("label", "item").alias("label"))
    named = scratch.Table(named, name)
    used.append(named)
    named = named.df
    spans = named.groupBy("grp").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    met = scratch.Table(tokens.join(spans, "grp"), name)
    used.append(met)
    met = met.df
    open_ = met.groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo != hi").select("token")
    common = met.where("lo = hi").groupBy("token", "lo").count().groupBy("token").agg(F.max(F.struct("count", "lo")).alias("top")).select("token", F.col("top.lo").alias("main"))
    rest = met.join(open_, "token", "left_semi").join(common, "token", "left")
    # Sizes at the threshold lie in the same or in neighbouring bands (a little wider than it, for rounding).
    step = F.floor(F.log("n") / F.lit(width * 1.0001)).cast("int")
    rest = scratch.Table(rest.withColumn("odd", ~((F.col("lo") == F.col("hi")) & F.col("lo").eqNullSafe(F.col("main")))).withColumn("step", step), name)
    used.append(rest)
    odd = rest.df.where("odd").withColumn("step", F.explode(F.array(*(F.col("step") + k for k in (-1, 0, 1)))))
    meet = odd.alias("p").join(rest.df.alias("c"), ["token", "step"]).where(F.expr(_fits(percent, "p", "c") + " and not (p.lo = p.hi and c.lo = c.hi and p.lo = c.lo)"))
    meet = meet.select(F.least("p.grp", "c.grp").alias("g"), F.greatest("p.grp", "c.grp").alias("k")).distinct()
    one, two = named.toDF("g", "a", "la"), named.toDF("k", "b", "lb")
    pairs = meet.join(one, "g").join(two, "k").where("la != lb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = scratch.Table(verified(pairs, bodies, n, percent), name).df
    if not more.isEmpty():
        labels = components(labels.toDF("a", "b").union(more), name)
    for table in used:
        table.drop()
    return labels


def _items(sets: DataFrame, n: int, percent: int, name: str, **extra) -> DataFrame:
    """item, label (the same for all items of a component) and aggregates over the rows of each item."""
    labels = _links(sets.where("n > 0"), n, percent, name)
    items = sets.where("n > 0").groupBy("item").agg(*(e.alias(k) for k, e in extra.items()))
    return items.join(labels, F.col("item") == F.col("node"), "left").select("item", *extra, F.coalesce("label", "item").alias("label"))


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90, doc_id: str = "doc_id", text: str = "text", name: str = "jaccard") -> DataFrame:
    """doc_id, n_shingles and component_id of every row: the least doc_id that links of at least ``percent``
    per cent similarity of n-word shingle sets reach."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets, table = described(docs, n, percent, name)
    table.drop()
    sets = sets.df
    mask = F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {SALTS}) as int))"))
    items = scratch.Table(_items(sets, n, percent, name, first=F.min("doc_id"), salts=mask), name).df
    least = items.groupBy("label").agg(F.min("first").alias("component"))
    items = items.join(least, "label").select("item", "component", F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit("salts", i) == 1)).alias("salt"))
    rows = sets.select("doc_id", "n", "item", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    out = rows.join(items, ["item", "salt"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", name: str = "near") -> DataFrame:
    """One row of each component, with all columns of ``docs``: that of the least doc_id (nulls last)."""
    held = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *blocks.numbered(docs, text))
    described_, table = described(held, n, percent, name)
    sets = described_.df
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "block", "row")
    items = _items(sets, n, percent, name, first=F.min(first))
    stays = items.groupBy("label").agg(F.min("first").alias("f")).select("f.block", "f.row")
    stays = scratch.materialize(stays.union(sets.where("n = 0").select("block", "row")), name)
    # What the stage's rows are read from is the blocks alone.
    described_.drop()
    return blocks.picked(table.df, stays, docs, text)


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, percent=90)


OP8_SQL = """
WITH RECURSIVE texts AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM texts
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= 90 * (x.n + y.n - c.n)),
reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, b FROM reached r JOIN links ON a = r.other)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) LEFT JOIN sizes USING (doc_id)
"""
