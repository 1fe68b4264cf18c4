"""Session helpers: lineage cuts and size-checked broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


# Settings the operators count on or profit from; a session may choose its own.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hash joins where every partition of the smaller side is known to be small.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.session.timeZone": "UTC",
}


# Tables written by this process under the checkpoint folder.
_written: list[str] = []


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``.

    A private folder is chosen only for a local master with the setting unset
    (tests); on a cluster a missing setting is an error, because a folder on
    one machine is lost with it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        configured = tempfile.mkdtemp(prefix="netstate-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` under the checkpoint folder and read it back.

    Unlike an RDD checkpoint the written table has a known size, so later joins
    with it are planned well; it is computed once and survives lost executors.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/netstate-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_lineage(spark: SparkSession) -> int:
    """Delete what ``cut_lineage`` has written so far, once nothing reads it any more."""
    n, conf = 0, spark._jsc.hadoopConfiguration()
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def broadcast_if_small(df: DataFrame, limit_bytes: int = 64 << 20) -> DataFrame:
    """Hint a broadcast only where the optimizer's size estimate is below the limit."""
    return F.broadcast(df) if estimated_bytes(df) <= limit_bytes else df


def shuffle_if_large(df: DataFrame, limit_bytes: int = 64 << 10) -> DataFrame:
    """Hint a join by shuffle unless the optimizer's size estimate is within the limit.

    A broadcast passes through the driver, at several times the size of compressed
    files; an operator that joins its tables again in every round sums that up.
    """
    return df if estimated_bytes(df) <= limit_bytes else df.hint("merge")


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size of ``df``."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
