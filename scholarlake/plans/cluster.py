"""What plans need to know of the cluster: where lineage may be cut, how wide shuffles are."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder all executors share: the session's `spark.checkpoint.dir`.

    A folder of our own is made only where that is unset and driver and executors are one process, and is removed at the end; on a
    cluster nothing is written to a machine's own disk, so that an unset folder is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            own = tempfile.mkdtemp(prefix="scholarlake-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            named = f"file://{own}"
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """`df` written to the shared checkpoint folder, so that a lost executor costs no recomputation and later reads are stable."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager)


class Scratch:
    """Steps of a query, written as compressed columns to a folder of their own beside the checkpoints."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.steps = spark, f"{shared_folder(spark)}/{uuid.uuid4()}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.steps += 1
        df.write.option("compression", "zstd").parquet(to := f"{self.folder}/{self.steps}")
        return self.spark.read.schema(df.schema).parquet(to)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Scratch for what runs within: shuffles go as soon as the step that made them is written, the steps when all is done."""
    before, steps = spark.conf.get(CLEANUP, None), Scratch(spark)
    spark.conf.set(CLEANUP, "true")
    try:
        yield steps
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
        steps.drop()


def parallelism(spark: SparkSession) -> int:
    """Partitions for CPU-heavy Python stages: the shuffle width or twice the cores, whichever is more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 2 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """`df`, a scan with narrow steps on it, as it is split; only one with fewer partitions than there are cores is dealt out anew.

    A large input is split by the scan (`spark.sql.files.maxPartitionBytes`) and its rows stay where they are read.
    """
    if df.rdd.getNumPartitions() >= df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(parallelism(df.sparkSession))
