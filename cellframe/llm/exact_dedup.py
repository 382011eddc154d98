"""Exact dedup by an exchange of Golomb-coded fingerprints.

Partitions send the sorted fingerprints of their texts to the owners of hash ranges and get a bitmap of
those that occur elsewhere. The suspects that this leaves are shuffled once for a comparison of their
bytes; a scan finds them by a bitmap with ``SLOTS`` slots for each suspect fingerprint, which is broadcast as long as
it has at most ``FILTER_BYTES``, and by a salted join on the fingerprint beyond. With the bitmap, all but one in
``SLOTS`` of the other texts are never moved; the join moves every text once. Of equal texts the row with the largest id stays.

Edge cases: null text counts as empty; null ids are the smallest; repeated rows count as rows, and those
with the id that stays are all marked as kept; an empty table gives no rows; other columns are ignored. When
duplicates are dropped, exactly one row of each text stays, with all its columns and a null text as null; rows that
share an id but not a text do not touch each other. A text has to fit in a row of Spark, up to some hundred MB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, golomb, scratch, skew

#: Bits of a fingerprint that are sent; a chance match only costs a comparison of bytes.
BITS = 48
#: Rows in one message round of a partition.
ROUND = 1 << 17
#: Slots of the bitmap for each suspect fingerprint, and the bytes up to which it is broadcast.
SLOTS = 16
FILTER_BYTES = 32 << 20
#: A group's rows meet its decision in up to so many tasks.
SALTS = 64


def _fingerprints(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"))


def suspects(docs: DataFrame, text: str = "text") -> DataFrame:
    """Fingerprints (their upper bits, as ``fp``) that more than one row has."""
    spark = docs.sparkSession
    owners = blocks.owners_for(spark, docs.count())

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, held = TaskContext.get().partitionId(), 0, []

        def flush():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return blocks.send((part << 32) + count, h, BITS, owners, lambda a, b: np.packbits(n[a:b] > 1).tobytes())

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - BITS))
            if sum(map(len, held)) >= ROUND:
                yield flush()
                held, count = [], count + 1
        if held:
            yield flush()

    def answer(h: np.ndarray, sender: np.ndarray, extras: list[bytes]) -> np.ndarray:
        sizes = np.bincount(sender, minlength=len(extras))
        twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8))[:n] for x, n in zip(extras, sizes)]).astype(bool)
        order = np.argsort(h, kind="stable")
        again = blocks.same_as_before(h[order])
        again[:-1] |= again[1:]
        out = np.empty(len(h), bool)
        out[order] = again
        return out | twice

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, body, reply = (batch.column(i).to_pylist() for i in range(3))
            found = [golomb.decode(b, o, BITS, owners) for o, b in zip(owner, body)]
            found = [h[blocks.said(r, len(h))] for h, r in zip(found, reply)]
            yield blocks.rows("fp long", [np.concatenate(found or [np.zeros(0, np.uint64)]).astype(np.int64)])

    sent = scratch.materialize(_fingerprints(docs, text).mapInArrow(tell, blocks.SENT), "fingerprints")
    replies = blocks.ask(sent, BITS, owners, answer)
    return sent.drop("extra").join(replies, ["block", "owner"]).select("owner", "body", "reply").mapInArrow(pick, "fp long").distinct()


def marked(docs: DataFrame, text: str, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with a column ``maybe``: true if the text's fingerprint is suspect, false for nearly all others."""
    found = scratch.Table(suspects(docs, text), "suspects")
    fp = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), 64 - BITS)
    slots = 1 << max(16, (SLOTS * found.df.count() - 1).bit_length())
    if slots // 8 > FILTER_BYTES:
        # The copies of one text meet its fingerprint by salts; which ones it needs, partial aggregates of numbers tell.
        salted = docs.withColumn("fp", fp).withColumn("_salt", skew.salt(doc_id))
        used = salted.groupBy("fp").agg(skew.salts_used().alias("_used"))
        known = skew.spread(used.join(found.df, "fp"), "_used").withColumn("known", F.lit(True))
        return skew.same(salted, known, ["fp"], "left").select(*docs.columns, F.coalesce("known", F.lit(False)).alias("maybe"))
    bits = found.df.select(F.pmod("fp", F.lit(slots)).alias("slot"))
    bits = bits.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    bits = scratch.materialize(bits, "suspects")
    slot = docs.withColumn("slot", F.pmod(fp, F.lit(slots))).withColumn("bucket", F.bitmap_bucket_number("slot")).withColumn("at", F.bitmap_bit_position("slot"))
    one = F.conv(F.hex(F.substring(F.col("bits"), (F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.getbit(one.cast("long"), (F.col("at") % 8).cast("int")) == 1
    return slot.join(F.broadcast(bits), "bucket", "left").select(*docs.columns, F.coalesce(bit, F.lit(False)).alias("maybe"))


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    groups = (
        marked(docs, "text")
        .where("maybe")
        .groupBy("text")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {SALTS}) as int))")).alias("salts"))
        .where("group_size > 1")
        .select(F.unhex(F.sha2("text", 256)).alias("sha"), "keep_id", "group_size", "salts")
    )
    groups = groups.select("sha", "keep_id", "group_size", F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit("salts", i) == 1)).alias("salt"))
    out = docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha"), salt.alias("salt")).join(groups, ["sha", "salt"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` of each text, that of the largest id, with all columns."""
    names = ["text" if c == text else f"_c{i}" for i, c in enumerate(docs.columns)]
    held = marked(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *blocks.numbered(docs, text)), "text")
    order = F.struct(F.col("doc_id").isNotNull(), "doc_id")
    # Suspects meet by the bytes of their texts; a group becomes one row before it is shuffled.
    best = held.where("maybe").groupBy(F.coalesce("text", F.lit("")).alias("bytes")).agg(F.max_by(F.struct(*names), order).alias("row"))
    out = held.where("not maybe").select(*names).union(best.select("row.*"))
    return out.toDF(*docs.columns)


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
