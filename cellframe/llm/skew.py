"""Joins of rows with one row for each of their groups, when a group may be a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

#: A group's rows meet what is known of the group in up to so many tasks.
SALTS = 64


def salt(*by: str | Column) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")


def salts_used(of: str = "_salt") -> Column:
    """Aggregate: the salts that a group's rows have, as bits."""
    return F.bit_or(F.expr(f"shiftleft(1L, {of})"))


def spread(groups: DataFrame, used: str | None = None) -> DataFrame:
    """One row of ``groups`` for each salt: of those in the bits ``used``, or for all."""
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    some = every if used is None else F.filter(every, lambda i: F.getbit(used, i) == 1)
    out = groups.withColumn("_salt", F.explode(some))
    return out if used is None else out.drop(used)


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join of salted frames on the keys (nulls are equal) and the salt; keeps the keys of the left."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in [*keys, "_salt"]})
    on = left["_salt"] == renamed["_r__salt"]
    for k in keys:
        on = on & left[k].eqNullSafe(renamed[f"_r_{k}"])
    return left.join(renamed, on, how).drop("_salt", *(f"_r_{k}" for k in [*keys, "_salt"]))


def with_groups(rows: DataFrame, keys: list[str], by: list[str | Column], **aggregates: Column) -> DataFrame:
    """``rows`` with aggregates of their groups. ``by``: what tells the rows of a group apart."""
    salted = rows.withColumn("_salt", salt(*by))
    groups = salted.groupBy(*keys).agg(*(a.alias(n) for n, a in aggregates.items()), salts_used().alias("_used"))
    return same(salted, spread(groups, "_used"), keys)


def dense_names(rows: DataFrame, keys: list[str], by: list[str | Column], name: str, **aggregates: Column) -> DataFrame:
    """``rows`` with ``name``: a number from 0 without gaps, the same for equal keys; and aggregates of the groups.

    The distinct keys are written with their place in their file's partition; a partition's first number is the
    count of those before it, of which there are as many as partitions.
    """
    salted = rows.withColumn("_salt", salt(*by))
    groups = salted.groupBy(*keys).agg(*(a.alias(n) for n, a in aggregates.items()), salts_used().alias("_used"))
    known = scratch.Table(groups.withColumn("_at", F.monotonically_increasing_id()), "names").df
    part, first, starts = F.shiftright("_at", 33), 0, []
    for p, n in sorted(map(tuple, known.groupBy(part.alias("p")).count().collect())):  # one row for each partition
        starts.append((p, first))
        first += n
    starts = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part long, _first long"))
    known = known.withColumn("_part", part).join(starts, "_part")
    known = known.withColumn(name, F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_first", "_at")
    return same(salted, spread(known, "_used"), keys)
