"""The register of runnable queries and their ANSI SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


MIN_BYTES = 1 << 20
#: Bytes of a table, as stored, that one task is dealt at most.
PART_BYTES = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a table that landed in fewer files than there are cores.

    There are as many parts as cores, more of a large table: a task holds the rows that it
    sorts or sends on, so its share must not grow with the table. A table in many files, as on
    a cluster, is returned untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size < MIN_BYTES or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(max(cores, size // PART_BYTES))


class Tables:
    """The parquet tables of one data folder, opened on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._kept: dict[str, DataFrame] = {}

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A frame that several parts of one query read, built once."""
        if name not in self._kept:
            self._kept[name] = make()
        return self._kept[name]

    def as_stored(self, name: str) -> DataFrame:
        """A table as its files are split, for what is dealt by a key next anyway."""
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        return spread(self.as_stored(name))


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``, with the SQL that must agree."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap
