"""Session matters that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local mode one of our own where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and cut off from its lineage."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is executed within lets go of its shuffle files at its end; a table that has been written doesn't need them any more."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


class Scratch:
    """Tables in the shared folder; drop() removes those that no result reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.top, self.n = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}", 0

    def written(self, df: DataFrame, **options) -> DataFrame:
        self.n += 1
        with shuffles_removed(self.spark):
            df.write.options(compression="zstd", **options).parquet(at := f"{self.top}/{self.n}")
        out = self.spark.read.schema(df.schema).parquet(at)
        out._at = at
        return out

    def bucketed(self, df: DataFrame, key: str) -> DataFrame:
        """Written in as many buckets of the key as shuffles have partitions, so a join or group by it doesn't move its rows."""
        self.n += 1
        name, n = f"bucketed_{uuid.uuid4().hex}", int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        with shuffles_removed(self.spark):
            df.write.format("parquet").option("compression", "zstd").option("path", at := f"{self.top}/{self.n}").bucketBy(n, key).saveAsTable(name)
        out = self.spark.table(name)
        out.schema  # resolved, so the files alone are needed from now on
        self.spark.sql(f"DROP TABLE {name}")
        out._at = at
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(t._at)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(v, least): the least vertex of v's component for each vertex of edges (a, b) but the least ones, by alternating large and small stars."""
    from pyspark.sql import functions as F

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    at = scratch.written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = None
    while (now := state(at)) != was:
        was = now
        both = at.union(at.select("b", "a"))
        low = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("v")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        mid = scratch.written(large)
        low = mid.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
        tied = mid.join(low, F.col("a") == F.col("v")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        new = scratch.written(tied.union(low.select("v", "m")).distinct())
        scratch.drop(at, mid)
        at = new
    return at.select(F.col("a").alias("v"), F.col("b").alias("least"))
