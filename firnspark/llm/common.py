"""What the corpus operators share: the shared folder, written intermediates, plain table reads."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import os
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnspark.sources.catalog import shared


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: spark.checkpoint.dir (``catalog.shared``)."""
    return shared(spark)


class Scratch:
    """Intermediate tables of one operator call, written below the shared folder.

    A written table cuts the lineage and survives the loss of executors. ``drop`` removes
    what later steps no longer read.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.tables: dict[str, str] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and return the written table."""
        df.write.option("compression", "zstd").mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def keep_bucketed(self, df: DataFrame, name: str, by: str, buckets: int) -> DataFrame:
        """Write df as a table in so many buckets of `by`, which later joins on it read without a shuffle."""
        self.tables[name] = table = f"{os.path.basename(self.root)}_{name}".replace("-", "_")
        out = df.write.format("parquet").option("compression", "zstd").option("path", self.path(name)).bucketBy(buckets, by)
        out.mode("overwrite").saveAsTable(table)
        return self.spark.table(table)

    def free(self) -> None:
        """Let Spark's cleaner delete the shuffle files of steps that nothing refers to any more.

        Twice, since the driver's references go first and what they kept alive goes after them.
        """
        for _ in range(2):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.3)

    def drop(self, *names: str) -> None:
        """Delete the named tables, or all of them, bucketed ones from the catalog too."""
        jvm = self.spark.sparkContext._jvm
        for name in names or list(self.tables):
            if name in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
        for path in [self.path(n) for n in names] or [self.root]:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def trimmed(f):
    """f over a task's batches, after which the worker gives the memory it has freed back to the machine.

    Workers are kept for later tasks, beside an executor that may need that memory itself.
    """

    @functools.wraps(f)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # no glibc, nothing to trim
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col):
    """A-Z to a-z, nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that df reads, as the optimizer knows them; no job is run."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)  # what has no known size says that it is huge
