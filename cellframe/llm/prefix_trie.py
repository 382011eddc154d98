"""The trie of conversations' prefixes, by prefix-doubling names.

Each distinct turn gets a dense number. Blocks of 2**(k + 1) turns, at multiples of their length, are named by the
numbers of their two halves, round by round; a prefix of d turns is named by the blocks of d's binary digits, in as
many rounds again: what is left without the lowest digit, and that digit's block. Two prefixes have the same name
exactly if they have the same turns. Rows with equal names are a node; a node's key is its depth and its smallest
member. Sums over subtrees double their reach: after round k a node holds what lies up to 2**k levels below it, and
each node adds that to its ancestor 2**k levels above, which its smallest member's own prefix names. So no step takes
more rounds than the logarithm of the longest conversation, and none meets a whole conversation, node or subtree in
one place: turns are numbered in ranges of the sorted table, and names are joined back under salts (``skew``).

The ids of the conversations that end at a node are hashed in order as a stream; they come packed in runs, so the one
task that must read them all (SHA-256 has no other way) holds one run at a time.

Edge cases: turns without a conversation id belong to none and are left out; null turns come first, turns with equal
numbers are ordered by role and then by the SHA-256 of their text; null role or text is empty; repeated rows are turns
of their own; a text is known by its SHA-256 and never split; conversations that are rebuilt without turns end at the
root; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, skew

#: Conversations whose ids share this whole part take their first turns from its conversation.
FAMILY = 100
#: One more than the most turns that are taken over.
SHARED = 6
#: Ids in a run that is hashed at a time.
RUN = 1 << 16


def _lit(n: int):
    return F.lit(n).cast("long")


def numbered(turns: DataFrame, conv_id: str, turn: str, role: str, text: str, name: str) -> DataFrame:
    """conv, at (from 0), key, size of every turn: its place in its conversation, what it says, its code points."""
    said = F.coalesce(F.col(text), F.lit(""))
    by = F.coalesce(F.col(role), F.lit(""))
    rows = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), by.alias("role"), F.unhex(F.sha2(said, 256)).alias("sha"), F.length(said).cast("long").alias("size")
    )
    order = ["conv", "turn", "role", "sha"]
    spread = rows.repartitionByRange(scratch.partitions(turns.sparkSession), *order).withColumn("part", F.spark_partition_id())
    held = scratch.Table(spread, name).df
    within = Window.partitionBy("part", "conv").orderBy(F.col("turn").asc_nulls_first(), "role", "sha")
    # Conversations that go over several ranges: fewer than there are ranges.
    pieces = held.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = pieces.withColumn("before", F.sum("n").over(earlier)).where("before > 0").select("conv", "part", "before")
    at = F.row_number().over(within) - 1 + F.coalesce("before", _lit(0))
    key = F.unhex(F.sha2(F.concat(F.encode("role", "utf-8"), F.lit(bytearray(1)), "sha"), 256))
    return held.join(F.broadcast(before), ["conv", "part"], "left").select("conv", at.cast("long").alias("at"), key.alias("key"), "size")


def rebuilt(turns: DataFrame, family: int = FAMILY, shared: int = SHARED) -> DataFrame:
    """The same columns, after each conversation took its first turns from its family's first."""
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % shared
    own = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).withColumn("h", taken).withColumn("base", F.col("conv") - F.col("conv") % family)
    # No more than shared - 1 turns of a conversation, and no more conversations than a family has.
    heads = turns.where((F.col("conv") % family == 0) & (F.col("at") < shared - 1)).groupBy(F.col("conv").alias("base"))
    heads = heads.agg(F.array_sort(F.collect_list(F.struct("at", "key", "size"))).alias("head"))
    own = own.join(heads, "base", "left").select("conv", "h", F.filter("head", lambda t: t["at"] < F.col("h")).alias("head"))
    first = own.select("conv", F.explode("head").alias("t")).select("conv", "t.at", "t.key", "t.size")
    own = own.select("conv", "h", F.greatest(F.coalesce(F.size("head"), F.lit(0)), F.lit(0)).alias("lead"))
    # A conversation may hold a third of all turns: it meets its one row under salts.
    salted = turns.withColumn("_salt", skew.salt("at"))
    used = salted.groupBy("conv").agg(skew.salts_used().alias("_used"))
    rest = skew.same(salted, skew.spread(own.join(used, "conv"), "_used"), ["conv"]).where("at >= h")
    return first.union(rest.select("conv", (F.col("at") - F.col("h") + F.col("lead")).alias("at"), "key", "size"))


def _ends(ends: DataFrame) -> DataFrame:
    """depth, top, sha of the nodes at which conversations end."""
    parts = scratch.partitions(ends.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, top, conv = (batch.column(i).to_numpy() for i in range(3))
            cut = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (top[1:] != top[:-1])])) if len(d) else []
            stops = [*cut[1:], len(d)]
            runs = [(a, b) for s, e in zip(cut, stops) for a in range(s, e, RUN) for b in [min(e, a + RUN)]]
            ids = [",".join(map(str, conv[a:b].tolist())) for a, b in runs]
            first = np.array([a for a, _ in runs], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(d[first]), pa.array(top[first]), pa.array(conv[first]), pa.array(ids)], ["depth", "top", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha = None, None
        for batch in batches:
            out = []
            for d, top, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "top", "ids"))):
                if (d, top) == at:
                    sha.update(b"," + ids.encode())
                    continue
                if at:
                    out.append((*at, sha.hexdigest()))
                at, sha = (d, top), hashlib.sha256(ids.encode())
            yield _named(out)
        if at:
            yield _named([(*at, sha.hexdigest())])

    runs = ends.repartitionByRange(parts, "depth", "top", "conv").sortWithinPartitions("depth", "top", "conv").mapInArrow(pack, "depth long, top long, first long, ids string")
    return runs.repartition(parts, "depth", "top").sortWithinPartitions("depth", "top", "first").mapInArrow(digest, "depth long, top long, sha string")


def _named(rows: list[tuple]) -> pa.RecordBatch:
    d, top, sha = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(top, pa.int64()), pa.array(sha, pa.string())], ["depth", "top", "sha"])


def prefixes(turns: DataFrame, name: str = "trie") -> DataFrame:
    """conv, depth, size (of the last turn), top, n of every prefix of one turn or more; top is the smallest and n the
    number of the conversations with that prefix."""
    level = scratch.Table(skew.dense_names(turns, ["key"], ["conv", "at"], "name").select("conv", "at", "name"), name).df
    levels = [level]
    while True:  # as often as the longest conversation can be halved
        half = F.shiftright("at", 1)
        pairs = level.groupBy("conv", half.alias("half")).agg(F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("a"), F.max(F.when(F.col("at") % 2 == 1, F.col("name"))).alias("b"))
        pairs = pairs.where("b is not null").withColumnRenamed("half", "at")
        level = scratch.Table(skew.dense_names(pairs, ["a", "b"], ["conv", "at"], "name").select("conv", "at", "name"), name).df
        if level.isEmpty():
            break
        levels.append(level)
    found = None
    for k in range(len(levels) - 1, -1, -1):
        # A block at an even place is the lowest digit of the prefix that ends with it.
        last = levels[k].where("at % 2 = 0").select("conv", ((F.col("at") + 1) * (1 << k)).alias("depth"), (F.col("at") * (1 << k)).alias("before"), F.col("name").alias("b"))
        if found is None:
            last = last.withColumn("a", _lit(-1))
        else:
            head = found.select(F.col("conv"), F.col("depth").alias("before"), F.col("name").alias("a"))
            last = last.join(head, ["conv", "before"], "left").withColumn("a", F.coalesce("a", _lit(-1)))
        here = skew.dense_names(last.select("conv", "depth", "a", "b"), ["depth", "a", "b"], ["conv"], "name", top=F.min("conv"), n=F.count(F.lit(1)))
        here = scratch.Table(here.select("conv", "depth", "name", "top", "n"), name).df
        found = here if found is None else found.union(here)
    last_turn = turns.select("conv", (F.col("at") + 1).alias("depth"), "size")
    return found.join(last_turn, ["conv", "depth"]).select("conv", "depth", "size", "top", "n")


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", family: int = FAMILY, shared: int = SHARED, name: str = "trie") -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    spark = conversations.sparkSession
    turns = scratch.Table(numbered(conversations, conv_id, turn, role, text, name), name).df
    convs = turns.select("conv").distinct()
    turns = scratch.Table(rebuilt(turns, family, shared), name).df
    total = convs.agg(F.min("conv"), F.count(F.lit(1))).first()
    root, n_convs = total
    if root is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    paths = scratch.Table(prefixes(turns, name), name).df
    # The node at each place of each path, and that of the root.
    place = paths.select("conv", "depth", "top")
    own = paths.where("conv = top")
    above = place.select(F.col("conv").alias("top"), (F.col("depth") + 1).alias("depth"), F.col("top").alias("parent"))
    nodes = own.select("top", "depth", "n", "size").join(above, ["top", "depth"], "left")
    nodes = nodes.withColumn("parent", F.coalesce("parent", _lit(root)))
    nodes = nodes.union(spark.range(1).select(_lit(root).alias("top"), _lit(0).alias("depth"), _lit(n_convs).alias("n"), _lit(0).alias("size"), F.lit(None).cast("long").alias("parent")))
    nodes = scratch.Table(nodes, name).df
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("top"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, ["top", "depth"], "left").withColumn("n_children", F.coalesce("n_children", _lit(0)))
    state = scratch.Table(nodes.withColumn("leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n") - 1) * F.col("size")), name)
    deepest = state.df.agg(F.max("depth")).first()[0]
    for k in range(deepest.bit_length()):
        up = state.df.where(F.col("depth") >= (1 << k)).select(F.col("top").alias("conv"), (F.col("depth") - (1 << k)).alias("depth"), "leaves", "saved")
        to = up.join(place, ["conv", "depth"], "left").select(F.coalesce("top", _lit(root)).alias("top"), "depth", "leaves", "saved")
        more = to.groupBy("top", "depth").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        after = state.df.join(more, ["top", "depth"], "left")
        after = after.withColumn("leaves", F.col("leaves") + F.coalesce("more_leaves", _lit(0))).withColumn("saved", F.col("saved") + F.coalesce("more_saved", _lit(0)))
        after = scratch.Table(after.drop("more_leaves", "more_saved"), name)
        state.drop()
        state = after
    lengths = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("depth"))
    lengths = convs.join(lengths, "conv", "left").select("conv", F.coalesce("depth", _lit(0)).alias("depth"))
    ends = lengths.join(place, ["conv", "depth"], "left").select("depth", F.coalesce("top", _lit(root)).alias("top"), "conv")
    out = state.df.join(_ends(ends), ["depth", "top"], "left")
    return out.select(
        F.col("top").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        "n_children",
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_CRC = "xor(list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda s, x: list_reduce(range(8), lambda z, i: xor(z >> 1, 3988292384 * (z & 1)), xor(s, x)), 4294967295), 4294967295)"
OP12_SQL = f"""
WITH own AS (
  SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS w
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
shared AS (SELECT c, w, {_CRC} % 6 AS h FROM own),
conv AS (SELECT s.c, list_concat(coalesce(b.w[1:s.h], []), s.w[s.h + 1:]) AS w FROM shared s LEFT JOIN own b ON b.c = s.c - s.c % 100),
paths AS (SELECT c, d, w[1:d] AS p, len(w) AS n FROM (SELECT c, w, unnest(range(0, len(w) + 1)) AS d FROM conv)),
nodes AS (
  SELECT d, p, min(c) AS top, count(*) AS n_convs,
    coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '') AS ends
  FROM paths GROUP BY d, p
),
place AS (SELECT paths.c, paths.d, nodes.top, nodes.n_convs FROM paths JOIN nodes USING (d, p)),
kids AS (SELECT u.top, v.top AS parent, v.d FROM nodes u JOIN place v ON v.c = u.top AND v.d = u.d - 1),
weights AS (
  SELECT d, top, (n_convs - 1) * CASE WHEN d = 0 THEN 0 ELSE length(p[d].t) END AS saved,
    (SELECT count(*) FROM kids WHERE kids.parent = nodes.top AND kids.d = nodes.d) AS n_children
  FROM nodes
),
below AS (
  SELECT v.top, v.d, sum(u.saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE u.n_children = 0) AS n_leaves
  FROM weights u JOIN place v ON v.c = u.top AND v.d <= u.d GROUP BY 1, 2
)
SELECT nodes.top AS conv_id, nodes.d AS depth, up.top AS parent_conv_id, nodes.n_convs, weights.n_children, below.n_leaves, below.saved_tokens, sha256(ends) AS ends_sha256
FROM nodes JOIN weights USING (d, top) JOIN below USING (d, top) LEFT JOIN place up ON up.c = nodes.top AND up.d = nodes.d - 1
"""
