"""Session helpers: lineage cuts in shared storage, table paths, partition counts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of input that one task is meant to hold.
TASK_BYTES = 128 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for lineage cuts.

    A cluster names a shared folder in ``spark.checkpoint.dir``; it is used as it is. Only a local
    master, where driver and executors are one machine, gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    known = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", "")
    if not known:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="stratalog-ckpt-")
        remove_at_end(spark, known)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(known)
    return known


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that later reads do not recompute it and
    survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_partitioned(df: DataFrame, by: str) -> DataFrame:
    """As cut(), spread by the hash of a column, which later joins and groups by it take as it is. The plan must not be adapted for that, as an
    adapted plan does not say how its result is spread."""
    conf, key = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    was = conf.get(key)
    spread = df.repartition(parts(df), by)
    conf.set(key, "false")
    try:
        return cut(spread)
    finally:
        conf.set(key, was)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove_at_end(spark: SparkSession, folder: str) -> None:
    """Delete ``folder`` when the driver's JVM ends; until then results may be read from it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which driver and executors share. It is deleted when the driver ends."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    remove_at_end(spark, folder)
    return folder


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def parts(df: DataFrame) -> int:
    """Tasks over which the rows of ``df`` are to be spread: one for each TASK_BYTES of what it reads, and no fewer than the session's
    shuffle partitions."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # what has no known size counts as the largest number there is; it says nothing
    return max(least, -(-size // TASK_BYTES)) if size < 1 << 62 else least
