"""Task, stage, log-line, manifest and prediction tables derived from the given tables.

Each user of `events` plays an application, each day one of its stages and each
event a task. `registry/oracles.py` derives the same tables in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Milliseconds since 1970 of a zone-less timestamp, in any session zone.
_EPOCH_MS = """
    unix_date(to_date({0})) * 86400000L + hour({0}) * 3600000L + minute({0}) * 60000L
    + floor(extract(SECOND FROM {0}) * 1000)
"""

#: Stage ids lie this far apart, so that those of an application span several chunks.
ID_STEP = 300

_APP = "'app_' || user_id"
_LABEL = "int(user_id % 7)"


def _stage_rows(spark: SparkSession, sf_dir: str, attempt: str) -> DataFrame:
    keyed = table(spark, sf_dir, "events").selectExpr(
        "user_id", "event_type", "ts", "day(ts) AS day", f"{attempt} AS attempt"
    )
    rows = keyed.groupBy("user_id", "day", "attempt").agg(
        F.expr("int(count(*))").alias("num_tasks"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.expr("bool_or(event_type = 'error')").alias("failed"),
    )
    return rows.selectExpr(
        f"{_APP} AS app_id",
        f"{_LABEL} AS label",
        f"int(day * {ID_STEP}) AS stage_id",
        "int(attempt) AS stage_attempt_id",
        "'stage ' || day AS stage_name",
        "num_tasks",
        f"{_EPOCH_MS.format('first_ts')} AS submission_time",
        f"{_EPOCH_MS.format('last_ts')} AS completion_time",
        "if(failed, 'FAILED', 'COMPLETED') AS status",
        """if(failed, CASE (user_id + day) % 3
            WHEN 0 THEN 'Job was cancelled by operator'
            WHEN 1 THEN 'ExecutorLostFailure: heartbeat timed out'
            ELSE 'OOM' END, NULL) AS failure_reason""",
    )


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stage_rows(spark, sf_dir, "0")


def graph_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, some of those that did not fail as skipped."""
    skipped = "if(status = 'COMPLETED' AND (label + num_tasks) % 3 = 0, 'SKIPPED', status)"
    return stages(spark, sf_dir).withColumn("status", F.expr(skipped))


def stage_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two attempts per stage: its events before and after noon."""
    return _stage_rows(spark, sf_dir, "hour(ts) div 12")


def lineage_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages with `parent_ids`: ordinals o-1 and o/2 of the o-th stage.

    An application has at most 31 stages here (days of a month).
    """
    by_app = Window.partitionBy("app_id").orderBy("stage_id")
    all_ids = by_app.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parents = """
        transform(filter(array_distinct(array(_o - 1, int(_o div 2))), p -> p >= 1 AND p < _o),
                  p -> element_at(_ids, p))
    """
    return (
        graph_stages(spark, sf_dir)
        .withColumns(
            {"_o": F.row_number().over(by_app), "_ids": F.collect_list("stage_id").over(all_ids)}
        )
        .withColumn("parent_ids", F.expr(parents))
        .drop("_o", "_ids")
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        f"{_APP} AS app_id",
        f"{_LABEL} AS label",
        f"int(day(ts) * {ID_STEP}) AS stage_id",
        "0 AS stage_attempt_id",
        "event_id AS task_id",
        "int(event_id % 3) AS task_attempt",
        "'exec_' || (event_id % 4) AS executor_id",
        "'host_' || (event_id % 2) AS host",
        "event_type <> 'error' AS success",
        "if(event_id % 5 = 0, 0L, floor(value * 100D)) AS duration_ms",
        "floor(value * 90D) + 1 AS executor_run_time",
        "floor(value * 3D) AS jvm_gc_time",
        "if(event_type = 'purchase', (event_id % 1000) * 1024, 0L) AS memory_bytes_spilled",
        "if(event_type = 'purchase', (event_id % 500) * 1024, 0L) AS disk_bytes_spilled",
        "(event_id % 64) * 1048576 AS peak_execution_memory",
        "(event_id % 100) * 1000 AS input_bytes_read",
        "(event_id % 977) * 10 AS shuffle_bytes_read",
        "(event_id % 877) * 10 AS shuffle_bytes_written",
        "event_id % 13 AS shuffle_fetch_wait_time",
    )


def known_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(app_id, label) of the applications of even users, one class on from their tasks'."""
    users = table(spark, sf_dir, "events").filter("user_id % 2 = 0").select("user_id").distinct()
    return users.selectExpr(f"{_APP} AS app_id", "int((user_id + 1) % 7) AS label")


# ---------------------------------------------------------------- log lines


def _as_json(df: DataFrame, event: Column, *kept: str) -> DataFrame:
    """Write the event of each row as one JSON `value`.

    `explode` keeps the text a column of its own; as a plain alias it would be
    put in wherever the lines are tested or parsed, and written each time.
    """
    return df.select("app_id", "label", *kept, F.explode(F.array(F.to_json(event))).alias("value"))


def task_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task-end events as JSON; a share of lines is broken or odd, by event id.

    Of every 23 events one is cut short and one is no JSON at all; of every 29
    one has no `Task Metrics` and one has text where a number belongs.
    """
    t = tasks(spark, sf_dir)
    local = F.floor(F.col("shuffle_bytes_read") / 20).cast("bigint") * 10
    event = F.struct(
        F.lit("SparkListenerTaskEnd").alias("Event"),
        F.col("stage_id").alias("Stage ID"),
        F.col("stage_attempt_id").alias("Stage Attempt ID"),
        F.struct(
            F.when(F.col("success"), "Success").otherwise("TaskKilled").alias("Reason")
        ).alias("Task End Reason"),
        F.struct(
            F.col("task_id").alias("Task ID"),
            F.col("task_attempt").alias("Attempt"),
            F.col("executor_id").alias("Executor ID"),
            F.col("host").alias("Host"),
            F.col("duration_ms").alias("Duration"),
        ).alias("Task Info"),
        F.when(
            F.col("task_id") % 29 != 3,
            F.struct(
                F.col("executor_run_time").alias("Executor Run Time"),
                F.col("jvm_gc_time").alias("JVM GC Time"),
                F.col("memory_bytes_spilled").alias("Memory Bytes Spilled"),
                F.col("disk_bytes_spilled").alias("Disk Bytes Spilled"),
                F.col("peak_execution_memory").alias("Peak Execution Memory"),
                F.struct(F.col("input_bytes_read").alias("Bytes Read")).alias("Input Metrics"),
                F.struct(
                    (F.col("shuffle_bytes_read") - local).alias("Remote Bytes Read"),
                    local.alias("Local Bytes Read"),
                    F.col("shuffle_fetch_wait_time").alias("Fetch Wait Time"),
                ).alias("Shuffle Read Metrics"),
                F.struct(F.col("shuffle_bytes_written").alias("Shuffle Bytes Written")).alias(
                    "Shuffle Write Metrics"
                ),
            ),
        ).alias("Task Metrics"),
    )
    text = F.col("value")
    odd = F.regexp_replace(text, '"JVM GC Time":[0-9]+', '"JVM GC Time":"slow"')
    value = (
        F.when(F.col("task_id") % 23 == 7, F.substring(text, 1, 120))
        .when(F.col("task_id") % 23 == 8, F.concat(F.lit("not json "), text))
        .when(F.col("task_id") % 29 == 4, odd)
        .otherwise(text)
    )
    return _as_json(t, event, "task_id").select("app_id", "label", value.alias("value"))


def stage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage-completed events as JSON."""
    info = F.struct(
        F.col("stage_id").alias("Stage ID"),
        F.col("stage_attempt_id").alias("Stage Attempt ID"),
        F.col("stage_name").alias("Stage Name"),
        F.col("num_tasks").alias("Number of Tasks"),
        F.col("submission_time").alias("Submission Time"),
        F.col("completion_time").alias("Completion Time"),
        F.col("failure_reason").alias("Failure Reason"),
    )
    event = F.struct(F.lit("SparkListenerStageCompleted").alias("Event"), info.alias("Stage Info"))
    return _as_json(stage_attempts(spark, sf_dir), event)


def decoy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other events that merely mention the two event names in a text."""
    named = F.when(F.col("event_id") % 2 == 0, "SparkListenerTaskEnd").otherwise(
        "SparkListenerStageCompleted"
    )
    event = F.struct(
        F.lit("SparkListenerLogStart").alias("Event"),
        F.concat(F.lit("saw "), named).alias("Note"),
    )
    owned = table(spark, sf_dir, "events").withColumns(
        {"app_id": F.expr(_APP), "label": F.expr(_LABEL)}
    )
    return _as_json(owned, event)


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole logs: task ends, stage ends and decoys."""
    lines = task_lines(spark, sf_dir).unionByName(stage_lines(spark, sf_dir))
    return lines.unionByName(decoy_lines(spark, sf_dir))


def log_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log path per event: flat, compressed or rolled, in class and other folders."""
    folder = """element_at(array('baseline', 'oom', 'skew', 'serialization', 'network', 'disk',
        'metadata', 'archive'), int(user_id % 8 + 1))"""
    name = """CASE event_id % 4
        WHEN 0 THEN 'application_' || user_id
        WHEN 1 THEN 'application_' || user_id || '.zstd'
        WHEN 2 THEN 'eventlog_v2_application_' || user_id || '/events_1_x.zstd'
        ELSE 'notes_' || user_id || '.txt' END"""
    path = f"'hdfs://logs/project/' || {folder} || '/' || {name} AS log_path"
    return table(spark, sf_dir, "events").selectExpr(path)


# ---------------------------------------------------------------- runs, predictions


def planned_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("failure_type"),
        F.col("o_orderkey").cast("string").alias("run_id"),
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs from `orders`; half of those not done failed to submit at all."""
    key, state = F.col("o_orderkey"), F.col("o_orderstatus")
    status = (
        F.when(state == "F", "FINISHED")
        .when(state == "O", "FAILED")
        .when(key % 2 == 0, "TIMEOUT")
        .otherwise(F.concat(F.lit("ERROR: run "), key.cast("string")))
    )
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("run_"), key.cast("string")).alias("AppName"),
        F.col("o_orderpriority").alias("FailureType"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("Label"),
        key.cast("string").alias("RunId"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Timestamp"),
        F.concat(F.lit("application_"), key.cast("string")).alias("AppId"),
        status.alias("Status"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prediction per application, wrong for every fifth user."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.selectExpr(
        f"{_APP} AS app_id",
        f"{_LABEL} AS label",
        "double(if(user_id % 5 <> 0, user_id % 7, (user_id % 7 + 1) % 7)) AS prediction",
    )


def partsupp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to four suppliers of each part, spread over all suppliers; lines of others don't match."""
    suppliers = table(spark, sf_dir, "supplier").agg(F.count("*")).scalar()
    parts = table(spark, sf_dir, "part").select("p_partkey", suppliers.alias("s"))
    return parts.selectExpr(
        "p_partkey AS ps_partkey",
        """explode(array_distinct(transform(sequence(0, 3),
            i -> (p_partkey + i * (s div 4 + p_partkey div s)) % s))) AS ps_suppkey""",
    )
