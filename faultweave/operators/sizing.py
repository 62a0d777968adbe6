"""Size checks: what may be broadcast, and where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Estimates count compressed file bytes; a hash table of them takes several times more.
BROADCAST_LIMIT_BYTES = 8 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of `df`; None where the session hides it."""
    plan = getattr(df, "_jdf", None)
    if plan is None:
        return None
    return int(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(spark: SparkSession) -> int:
    """Largest side to broadcast; nothing where the session turned broadcasts off."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    return 0 if threshold.startswith("-") else BROADCAST_LIMIT_BYTES


def fits_broadcast(*dfs: DataFrame) -> bool:
    """Whether each frame is estimated to stay within the limit."""
    limit = broadcast_limit(dfs[0].sparkSession)
    sizes = [estimated_bytes(df) for df in dfs]
    return all(size is not None and size <= limit for size in sizes)


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Hint a broadcast only while the size estimate is within the limit.

    Beyond it the frame is returned as it is and the join shuffles.
    """
    return F.broadcast(df) if fits_broadcast(df) else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df` computed once, so that later steps don't plan and run it again.

    It is written to the shared folder that the session names in
    spark.checkpoint.dir. Without one it is cached, and a lost executor repeats
    the steps that led to its part.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors see: below spark.checkpoint.dir.

    Only a local session, where all share one machine, may leave that unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="models-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"
