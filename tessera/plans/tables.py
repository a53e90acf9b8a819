"""Reading of the tables that queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ship

#: what a task of `read_keyed` gets of the files, in bytes: some 100,000 rows of narrow columns
PART_BYTES = 2 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with much work for each row, spread over all cores where it is read as fewer parts than there are cores: a file of one row group is one
    part. So many parts hold little, hence what is moved is small; larger tables are left as they are.
    Filters and column choice reach the scan all the same.
    """
    rows = read(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows._jdf.rdd().getNumPartitions() < cores else rows


def read_keyed(spark: SparkSession, sf_dir: str, keys: dict[str, str]) -> tuple[list[DataFrame], int]:
    """Tables, each by its key in partitions of one and the same number, which grows with the files: joins and aggregates by that key move nothing
    more, and what one of their tasks holds is bounded. keys: table -> column; the number comes along."""
    tables = {name: read(spark, sf_dir, name) for name in keys}
    size = sum(int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) for df in tables.values())
    parts = max(spark.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    return [df.repartition(parts, keys[name]) for name, df in tables.items()], parts
