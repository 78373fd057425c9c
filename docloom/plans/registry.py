"""The registry of queries, and small fixtures that both engines read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """The table's narrow rows dealt out by key to all tasks, for work that is
    dear by the row: a small file would be read, and worked on, by one task."""
    read = table(spark, sf_dir, name)
    return read.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def placed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table with `place`: ascending in the order of its files' names and
    of the rows in each, however Spark deals the files out to its tasks."""
    read = table(spark, sf_dir, name)
    files = F.array(*(F.lit(f.rpartition("/")[2]) for f in sorted(read.inputFiles())))
    file = F.array_position(files, F.col("_metadata.file_name")) - 1
    return read.select("*", (F.shiftleft(file, 40) + F.col("_metadata.row_index")).alias("place"))


def rows(spark: SparkSession, values: str) -> DataFrame:
    """`VALUES ... AS t(columns)`, as Spark reads it and DuckDB does."""
    return spark.sql(f"SELECT * FROM ({values.partition(' AS t(')[0]}) AS t({values.partition(' AS t(')[2]}")


def values(text: str) -> str:
    """The same fixture as a SQL relation."""
    return f"({text.partition(' AS t(')[0]}) AS t({text.partition(' AS t(')[2]}"
