"""The 25 features of an application: two partial aggregates and one join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultweave.functions.labels import GROUND_TRUTH_NAMES, label_name
from faultweave.functions.scalars import guarded_ratio

# Feature columns in vector order.
FEATURE_COLUMNS = [
    "mean_task_duration",
    "std_task_duration",
    "max_task_duration",
    "total_memory_spilled",
    "total_disk_spilled",
    "total_shuffle_read",
    "total_shuffle_write",
    "total_gc_time",
    "total_stages",
    "failed_stages",
    "max_stage_parallelism",
    "stage_depth_of_failure",
    "completed_stage_ratio",
    "failed_stage_ratio",
    "spill_per_stage",
    "gc_per_stage",
    "skew_index",
    "duration_variance",
    "max_min_duration_ratio",
    "spill_ratio",
    "disk_spill_ratio",
    "peak_memory_ratio",
    "gc_time_ratio",
    "task_failure_rate",
    "retry_count",
]


def task_aggregates(tasks: DataFrame) -> DataFrame:
    """Per application sums, extremes and moments over all its tasks.

    The label rides along, so labels need no second pass over the tasks.
    """
    duration = F.when(F.col("duration_ms") > 0, F.col("duration_ms")).otherwise(
        F.col("executor_run_time")
    )
    return (
        tasks.withColumn("duration", duration)
        .groupBy("app_id")
        .agg(
            F.min("label").alias("label"),
            F.avg("duration").alias("mean_task_duration"),
            F.stddev_samp("duration").alias("std_task_duration"),
            F.var_samp("duration").alias("duration_variance"),
            F.min("duration").alias("min_task_duration"),
            F.max("duration").alias("max_task_duration"),
            F.sum("memory_bytes_spilled").alias("total_memory_spilled"),
            F.sum("disk_bytes_spilled").alias("total_disk_spilled"),
            F.sum("shuffle_bytes_read").alias("total_shuffle_read"),
            F.sum("shuffle_bytes_written").alias("total_shuffle_write"),
            F.sum("jvm_gc_time").alias("total_gc_time"),
            F.avg("peak_execution_memory").alias("avg_peak_memory"),
            F.max("peak_execution_memory").alias("max_peak_memory"),
            F.sum("executor_run_time").alias("total_run_time"),
            F.sum("input_bytes_read").alias("total_input"),
            F.count_if(~F.col("success")).alias("failed_tasks"),
            F.count("*").alias("total_tasks"),
            F.count_if(F.col("task_attempt") > 0).alias("retry_count"),
        )
    )


def stage_aggregates(stages: DataFrame) -> DataFrame:
    """Per application counts over stage attempts."""
    completed = F.count_if(F.col("status") == "COMPLETED")
    return stages.groupBy("app_id").agg(
        F.count("*").alias("total_stages"),
        F.count_if(F.col("status") == "FAILED").alias("failed_stages"),
        completed.alias("completed_stages"),
        F.max("num_tasks").alias("max_stage_parallelism"),
        completed.alias("stage_depth_of_failure"),
    )


def app_features(
    tasks: DataFrame, stages: DataFrame, ground_truth: DataFrame | None = None
) -> DataFrame:
    """(app_id, label, 25 doubles), no NULLs.

    Labels come from `ground_truth` (app_id, label) when given, else from the
    tasks themselves.
    """
    per_task = task_aggregates(tasks)
    if ground_truth is None:
        per_task = per_task.filter(F.col("app_id").isNotNull())
    else:
        per_task = per_task.drop("label").join(ground_truth.select("app_id", "label"), "app_id")
    base = per_task.join(stage_aggregates(stages), "app_id", "left").na.fill(0.0)

    def per_stage(value):
        return guarded_ratio(value, F.col("total_stages"))

    derived = base.withColumns(
        {
            "completed_stage_ratio": per_stage(F.col("completed_stages")),
            "failed_stage_ratio": per_stage(F.col("failed_stages")),
            "spill_per_stage": per_stage(
                F.col("total_memory_spilled") + F.col("total_disk_spilled")
            ),
            "gc_per_stage": per_stage(F.col("total_gc_time")),
            "skew_index": guarded_ratio(
                F.col("max_task_duration"), F.col("mean_task_duration"), 1.0
            ),
            "max_min_duration_ratio": guarded_ratio(
                F.col("max_task_duration"), F.col("min_task_duration"), 1.0
            ),
            "spill_ratio": guarded_ratio(F.col("total_memory_spilled"), F.col("total_input")),
            "disk_spill_ratio": guarded_ratio(F.col("total_disk_spilled"), F.col("total_input")),
            "peak_memory_ratio": guarded_ratio(
                F.col("max_peak_memory"), F.col("avg_peak_memory"), 1.0
            ),
            "gc_time_ratio": guarded_ratio(F.col("total_gc_time"), F.col("total_run_time")),
            "task_failure_rate": guarded_ratio(F.col("failed_tasks"), F.col("total_tasks")),
        }
    )
    features = [F.col(c).cast("double").alias(c) for c in FEATURE_COLUMNS]
    return derived.select("app_id", "label", *features).na.fill(0.0)


def ground_truth(tasks: DataFrame) -> DataFrame:
    """(app_id, label); the label is constant per application, so any one will do."""
    return tasks.groupBy("app_id").agg(F.min("label").alias("label"))


def named_ground_truth(features: DataFrame) -> DataFrame:
    """(app_id, label, label_name)."""
    return features.select(
        "app_id", "label", label_name(F.col("label"), GROUND_TRUTH_NAMES).alias("label_name")
    )


def label_distribution(df: DataFrame, names=GROUND_TRUTH_NAMES) -> DataFrame:
    """Rows per class."""
    return (
        df.groupBy("label")
        .agg(F.count("*").alias("count"))
        .select("label", label_name(F.col("label"), names).alias("label_name"), "count")
        .orderBy("label")
    )


def feature_stats(features: DataFrame, cols: list[str] = FEATURE_COLUMNS) -> DataFrame:
    """Count, mean, stddev, min and max of each column, one row per column.

    One pass over the data; the single wide row is turned in the plan.
    """
    stats = {"count": F.count, "mean": F.avg, "stddev": F.stddev_samp, "min": F.min, "max": F.max}
    wide = features.agg(
        *[F.struct(*[fn(c).alias(s) for s, fn in stats.items()]).alias(c) for c in cols]
    )
    rows = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("s")) for c in cols]
    return wide.select(F.inline(F.array(*rows))).select("feature", "s.*")
