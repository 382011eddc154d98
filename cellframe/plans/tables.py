"""The test tables as tensors, and the same as SQL common table expressions.

E: embeddings, dense [vectors, 64]. Q: quantity by part and supplier, R: the same of returned lines, both
sparse. L: lines by ship day and line number, sparse. U: events by user, type and day, sparse. N: nation by
region, sparse 0/1 integers. Sizes come from counts and bounds, which Parquet's footers answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fourier, matrix, reduce  # noqa: F401  they give Tensor its methods
from ..rows import from_arrays
from ..sources.frames import from_dataframe
from ..tensor import Tensor

EVENT_TYPES = "(SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM events))"
FIRST_DAY = "1992-01-01"

SQL = {
    "e": "SELECT vec_id AS c0, unnest(range(len(embedding))) AS c1, unnest(embedding)::DOUBLE AS v FROM embeddings",
    "q": "SELECT l_partkey AS c0, l_suppkey AS c1, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2",
    "r": "SELECT l_partkey AS c0, l_suppkey AS c1, sum(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2",
    "l": f"SELECT date_diff('day', DATE '{FIRST_DAY}', l_shipdate::DATE) AS c0, (l_linenumber - 1)::BIGINT AS c1, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2",
    "u": f"SELECT user_id AS c0, code::BIGINT AS c1, date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE) AS c2, count(*)::DOUBLE AS v FROM events JOIN {EVENT_TYPES} t USING (event_type) GROUP BY 1, 2, 3",
    "n": "SELECT n_nationkey::BIGINT AS c0, n_regionkey::BIGINT AS c1, 1 AS v FROM nation",
    "parts": "SELECT range AS c0 FROM range((SELECT count(*) FROM part))",
    "supps": "SELECT range AS c1 FROM range((SELECT count(*) FROM supplier))",
    "grid": "SELECT c0, c1, coalesce(v, 0) AS v FROM parts CROSS JOIN supps LEFT JOIN q USING (c0, c1)",
}
ORDER = ("e", "q", "r", "l", "u", "n", "parts", "supps", "grid")
NEEDS = {"grid": ("q", "parts", "supps")}


def sql(body: str) -> str:
    """The body with the tables that it names in front."""
    import re

    used = {t for t in ORDER if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", body)}
    used |= {t for u in used for t in NEEDS.get(u, ())}
    return ("WITH " + ",\n".join(f"{t} AS ({SQL[t]})" for t in ORDER if t in used) + "\n" if used else "") + body


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def embeddings(spark: SparkSession, d: str, dtype: str = "f64") -> Tensor:
    rows = _read(spark, d, "embeddings")
    return from_arrays(rows, ["vec_id"], "embedding", (rows.count(), 64), dtype, check=False)


def _quantity(spark: SparkSession, d: str, rows: DataFrame) -> Tensor:
    shape = (_read(spark, d, "part").count(), _read(spark, d, "supplier").count())
    flat = rows.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("v"))
    return from_dataframe(flat, ["l_partkey", "l_suppkey"], "v", shape, "f64", check=False)


def quantity(spark: SparkSession, d: str) -> Tensor:
    return _quantity(spark, d, _read(spark, d, "lineitem"))


def returned(spark: SparkSession, d: str, flag: str = "R") -> Tensor:
    return _quantity(spark, d, _read(spark, d, "lineitem").where(F.col("l_returnflag") == flag))


def lines(spark: SparkSession, d: str) -> Tensor:
    day = F.datediff(F.to_date("l_shipdate"), F.lit(FIRST_DAY).cast("date")).cast("long")
    flat = _read(spark, d, "lineitem").groupBy(day.alias("day"), (F.col("l_linenumber") - 1).cast("long").alias("line")).agg(F.sum("l_quantity").alias("v"))
    return from_dataframe(flat, ["day", "line"], "v", (4000, 7), "f64", check=False)


def events(spark: SparkSession, d: str) -> Tensor:
    rows = _read(spark, d, "events")
    row = rows.agg(F.min(F.to_date("ts")).alias("first"), F.max(F.to_date("ts")).alias("last"), F.max("user_id").alias("user")).first()
    kinds = sorted(r[0] for r in rows.select("event_type").distinct().collect())
    code = F.array_position(F.array(*map(F.lit, kinds)), F.col("event_type")) - 1
    day = F.datediff(F.to_date("ts"), F.lit(row["first"])).cast("long")
    flat = rows.groupBy("user_id", code.alias("code"), day.alias("day")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    return from_dataframe(flat, ["user_id", "code", "day"], "v", (row["user"] + 1, len(kinds), (row["last"] - row["first"]).days + 1), "f64", check=False)


def nations(spark: SparkSession, d: str) -> Tensor:
    flat = _read(spark, d, "nation").select("n_nationkey", "n_regionkey", F.lit(1).alias("v"))
    return from_dataframe(flat, ["n_nationkey", "n_regionkey"], "v", (25, 5), "i32", check=False)
