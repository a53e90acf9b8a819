"""Sessions: settings for tests and small machines, and shipping of this package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine; on a cluster the session comes from outside."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Makes the package importable in Python workers, once per application, where nothing else does."""
    context = spark.sparkContext
    paths = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if str(ROOT.parent) in {os.path.realpath(p) for p in paths if p} or getattr(context, "_tessera_shipped", False):
        return
    name = Path(SparkFiles.getRootDirectory()) / "package" / "tessera.zip"  # Spark sends it to executors and deletes it
    name.parent.mkdir(exist_ok=True)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent))
    context.addPyFile(str(name))
    context._tessera_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: what the session names in spark.checkpoint.dir; on one machine a new one where it names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context = spark.sparkContext
        if not hasattr(context, "_tessera_folder"):
            context._tessera_folder = tempfile.mkdtemp(prefix="tessera-")
        named = context._tessera_folder
    return named.rstrip("/")


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet in the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
