"""Connected components by alternating large and small stars, without any whole component in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Connect to the least neighbour m of u: all larger neighbours (large), or u and all smaller ones."""
    around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    near = around.join(least, around["a"] == least["u"])
    if large:
        out = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """edges (a, b) of any one ordered type -> (node, label) of all nodes but those that are their own label:
    the least node of their component. Null ends and loops are ignored; no edges give no rows."""
    now = scratch.Table(edges.select("a", "b").where("a != b").distinct(), name)
    seen = None
    while True:
        after = scratch.Table(_star(_star(now.df, True), False), name)
        now.drop()
        now = after
        row = now.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (mark := tuple(row)) == seen:
            return now.df.select(F.col("a").alias("node"), F.col("b").alias("label"))
        seen = mark
