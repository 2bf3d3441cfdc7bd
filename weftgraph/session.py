"""Session helpers: the shared working folder and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where neither the setting nor a checkpoint folder exists and all runs on one
    machine, as in tests, a temporary folder is set; a cluster has to name its folder.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None and current.isDefined():
        path = current.get()
    if path is None:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="weftgraph-")
    if not current.isDefined():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/weftgraph/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    A lost executor then costs only the tasks it ran, never the stages before.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder, whatever its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Shuffle files of a query go when it ends; a setting of Spark's, off by default.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries that are written in here leave no shuffle files behind."""
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREED)
        else:
            spark.conf.set(_FREED, before)


class Scratch:
    """Tables of one step, removed together once what comes from them is written."""

    def __init__(self):
        self.paths: list[str] = []

    def table(self, df: DataFrame, tag: str) -> DataFrame:
        """As ``materialize``; the shuffles behind the table go at once."""
        spark = df.sparkSession
        path = new_path(spark, tag)
        with shuffles_freed(spark):
            df.write.option("compression", "zstd").parquet(path)
        self.paths.append(path)
        return spark.read.schema(df.schema).parquet(path)

    def drop(self, spark: SparkSession) -> None:
        for path in self.paths:
            remove(spark, path)
        self.paths = []


class Rounds:
    """The tables of a loop that needs its last one only: a new table removes the one before."""

    def __init__(self, tag: str):
        self.tag, self.path = tag, None

    def next(self, df: DataFrame) -> DataFrame:
        spark, before = df.sparkSession, self.path
        self.path = new_path(spark, self.tag)
        df.write.option("compression", "zstd").parquet(self.path)
        if before is not None:
            remove(spark, before)
        return spark.read.schema(df.schema).parquet(self.path)


class Buckets:
    """Tables bucketed by a key, so that joins and aggregates by it need no shuffle.

    There are as many buckets as shuffle partitions: what a shuffle by the key gives fits them.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.count, self.kept = spark, shuffle_partitions(spark), []

    def write(self, df: DataFrame, key: str, tag: str) -> DataFrame:
        name = f"weftgraph_{uuid.uuid4().hex}"
        path = new_path(self.spark, tag)
        df.write.format("parquet").bucketBy(self.count, key).sortBy(key).option("path", path).option("compression", "zstd").saveAsTable(name)
        self.kept.append((name, path))
        return self.spark.table(name)

    def drop(self, last: int) -> None:
        """Remove all but the ``last`` tables."""
        gone, self.kept = self.kept[: len(self.kept) - last], self.kept[len(self.kept) - last :]
        for name, path in gone:
            self.spark.sql(f"DROP TABLE {name}")
            remove(self.spark, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
