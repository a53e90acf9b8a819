"""What the operators of this subpackage share on the Spark side."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of all texts: one pass in the JVM that reads a single column."""
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage by a reliable checkpoint in the folder that the session names."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


@contextmanager
def small_batches(spark: SparkSession, size: int = 8 << 20) -> Iterator[None]:
    """For what runs inside: batches of about `size` bytes go to Python. By default they are cut by rows alone, and the JVM
    holds a group of large values whole, outside its heap and up to three times while its buffer doubles."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def power_of_two(x: float) -> int:
    return 1 << max(0, int(x) - 1).bit_length()


def free_name(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have."""
    taken = {c.lower() for c in df.columns}
    while f"__{name}" in taken:
        name += "_"
    return f"__{name}"


def stored(df: DataFrame, name: str, rows_a_file: int = 0) -> DataFrame:
    """The rows, written as Parquet in the shared folder and read again.

    rows_a_file: rows of a file at most, so that narrow rows, which Parquet makes very short, don't come to one task in tens of millions.
    """
    return stored_at(df, folder(df.sparkSession, name), rows_a_file)


def folder(spark: SparkSession, name: str) -> str:
    """A new name in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored_at(df: DataFrame, path: str, rows_a_file: int = 0) -> DataFrame:
    df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
