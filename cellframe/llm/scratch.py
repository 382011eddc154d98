"""Intermediate tables in the cluster's shared checkpoint folder."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession

from ..session import hadoop_path, scratch_path

#: Shuffle files of a finished job are of no use once its result is a written table.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def _settings(spark: SparkSession, batch: int):
    wanted = {_CLEANUP: "true", _BATCH: str(batch)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Table:
    """A DataFrame written to the shared folder and read back; ``drop``, or the end of the application, removes
    the files."""

    def __init__(self, df: DataFrame, name: str, batch: int = 2000):
        """batch: rows that an Arrow batch on the way to Python has at most."""
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, name)
        with _settings(self.spark, batch):
            df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        file_system, path = hadoop_path(self.spark, self.path)
        file_system.delete(path, True)


def together(tables: list[Table], spark: SparkSession, schema: str) -> DataFrame:
    """The rows of tables of one schema."""
    return spark.read.schema(schema).parquet(*(t.path for t in tables)) if tables else spark.createDataFrame([], schema)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df`` with a written table."""
    return Table(df, name).df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
