"""The run manifest: which runs were submitted, and how they ended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultweave.sources.schemas import MANIFEST, columns

# A run in one of these states has its log and is not repeated.
DONE_STATES = ("FINISHED", "FAILED")
TIMEOUT = "TIMEOUT"
ERROR_PREFIX = "ERROR"

# Runs of each failure type in a full campaign, 80 in all.
CAMPAIGN_RUNS = {
    "BASELINE": 12,
    "OOM": 12,
    "DISK": 11,
    "NET": 11,
    "SKEW": 12,
    "SER": 11,
    "META": 11,
}


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows, trimmed; rows with fewer than seven fields are dropped."""
    raw = spark.read.schema(MANIFEST.replace("Label int", "Label string")).csv(
        path, header=True
    )
    trimmed = raw.select(*[F.trim(c).alias(c) for c in columns(MANIFEST)])
    return trimmed.filter(F.col("Status").isNotNull()).withColumn(
        "Label", F.col("Label").try_cast("int")
    )


def append_runs(runs: DataFrame, path: str, fmt: str = "csv") -> None:
    """Add run rows; earlier rows are never rewritten. Writes."""
    rows = runs.select(*columns(MANIFEST))
    writer = rows.write.mode("append").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def plan_runs(spark: SparkSession, totals: dict[str, int] | None = None) -> DataFrame:
    """Planned runs (failure_type, run_id), ids counted from 001 per failure type."""
    totals = CAMPAIGN_RUNS if totals is None else totals
    types = spark.createDataFrame(list(totals.items()), "failure_type string, total int")
    numbered = types.filter("total > 0").select(
        "failure_type", F.explode(F.sequence(F.lit(1), "total")).alias("run")
    )
    return numbered.select("failure_type", F.format_string("%03d", "run").alias("run_id"))


def pending_runs(planned: DataFrame, manifest: DataFrame) -> DataFrame:
    """Planned runs (failure_type, run_id) that are not done; failed submissions repeat."""
    done = manifest.filter(F.col("Status").isin(*DONE_STATES)).select(
        F.col("FailureType").alias("failure_type"), F.col("RunId").alias("run_id")
    )
    return planned.join(done, ["failure_type", "run_id"], "left_anti")


def run_summary(manifest: DataFrame) -> DataFrame:
    """Runs per failure type and final state."""
    status = F.col("Status")
    return (
        manifest.groupBy(F.col("FailureType").alias("failure_type"))
        .agg(
            F.count("*").alias("total_runs"),
            F.count_if(status == "FINISHED").alias("finished"),
            F.count_if(status == "FAILED").alias("failed"),
            F.count_if(status == TIMEOUT).alias("timed_out"),
            F.count_if(status.startswith(ERROR_PREFIX)).alias("errors"),
        )
        .orderBy("failure_type")
    )
