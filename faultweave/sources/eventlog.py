"""Event logs: newline-delimited JSON to task and stage tables.

One scan covers all class folders, so the plan does not grow with the number of
files. Plain files are split among tasks; `.zstd`, `.zst`, `.gz` and Spark's own
`.lz4` files are decoded in the tasks as streams. Each file is read once and
gives its lines and its state.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import BinaryIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultweave.functions.labels import FOLDER_LABELS
from faultweave.sources.logstream import (
    DECODERS,
    NOT_SUPPORTED,
    READ,
    UNREADABLE,
    open_file,
    stream_files,
)
from faultweave.sources.schemas import STAGE_METRICS, TASK_METRICS, columns

# The two event kinds that are read, and the success marker.
TASK_END = "SparkListenerTaskEnd"
STAGE_COMPLETED = "SparkListenerStageCompleted"
SUCCESS = "Success"

# JSON paths of the two events. INT and BIGINT mark whole numbers.
_TASK_FIELDS = """
    `Stage ID` INT, `Stage Attempt ID` INT,
    `Task Info` STRUCT<
        `Task ID`: BIGINT, `Attempt`: INT, `Executor ID`: STRING, `Host`: STRING,
        `Duration`: BIGINT, `Launch Time`: BIGINT, `Finish Time`: BIGINT>,
    `Task End Reason` STRUCT<`Reason`: STRING>,
    `Task Metrics` STRUCT<
        `Executor Run Time`: BIGINT, `JVM GC Time`: BIGINT,
        `Memory Bytes Spilled`: BIGINT, `Disk Bytes Spilled`: BIGINT,
        `Peak Execution Memory`: BIGINT,
        `Input Metrics`: STRUCT<`Bytes Read`: BIGINT>,
        `Shuffle Read Metrics`: STRUCT<
            `Remote Bytes Read`: BIGINT, `Local Bytes Read`: BIGINT,
            `Fetch Wait Time`: BIGINT>,
        `Shuffle Write Metrics`: STRUCT<`Shuffle Bytes Written`: BIGINT>>
"""
_STAGE_FIELDS = """
    `Stage Info` STRUCT<
        `Stage ID`: INT, `Stage Attempt ID`: INT, `Stage Name`: STRING,
        `Number of Tasks`: INT, `Submission Time`: BIGINT, `Completion Time`: BIGINT,
        `Failure Reason`: STRING, `Parent IDs`: ARRAY<INT>>
"""
_BAD = "_unparsed"

_APP_DIR = "eventlog_v2_"
_COMPRESSION_SUFFIX = r"\.(zstd|zst|lz4|gz|lzf|snappy)"
# A log file directly inside a class folder, or a rolled part in its own folder.
_LOG_PATH = rf"([^/]+)/(?:application_[^/]*|{_APP_DIR}[^/]+/events_[^/]*)$"


# ---------------------------------------------------------------- paths


def app_id_from_path(path: Column) -> Column:
    """Application id: the rolled-log folder if there is one, else the file name."""
    rolled = F.regexp_extract(path, rf"/{_APP_DIR}([^/]+)/[^/]*$", 1)
    file_name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), _COMPRESSION_SUFFIX, "")
    return F.when(rolled != "", rolled).otherwise(file_name)


def folder_from_path(path: Column) -> Column:
    """Class folder of a log file; empty when the path is no log of a class."""
    return F.regexp_extract(path, _LOG_PATH, 1)


def label_from_path(path: Column) -> Column:
    """Class id of a log file, NULL outside the seven class folders."""
    labels = F.create_map(*(F.lit(x) for pair in FOLDER_LABELS.items() for x in pair))
    return F.try_element_at(labels, folder_from_path(path))


def plain_path(path: Column) -> Column:
    """A file path as it was given, without URL escapes."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def with_path_labels(df: DataFrame, path_col: str) -> DataFrame:
    """Add `app_id` and `label` from a path column; drop paths of no class."""
    path = F.col(path_col)
    return df.withColumns(
        {"app_id": app_id_from_path(path), "label": label_from_path(path)}
    ).filter(F.col("label").isNotNull())


# ---------------------------------------------------------------- scan


#: Name ends of files that Spark writes and that are not read.
UNSUPPORTED = (".lzf", ".snappy")


def _log_glob(base_dir: str) -> str:
    """The logs right below the class folders, and the parts of rolled logs there."""
    folders = ",".join(FOLDER_LABELS)
    return f"{base_dir.rstrip('/')}/{{{folders}}}/{{application_*,{_APP_DIR}*/events_*}}"


def _ends(path: Column, ends: tuple[str, ...]) -> Column:
    return path.rlike("({})$".format("|".join(map(re.escape, ends))))


def scan_logs(
    spark: SparkSession,
    base_dir: str,
    fail: bool = False,
    opener: Callable[[str], BinaryIO] = open_file,
) -> DataFrame:
    """(file, app_id, label, value, state) of every log in `base_dir/<class folder>/`.

    Each line is a row with its value; each file has one more row with its state:
    read, unreadable (it breaks off; its lines up to there are given all the same)
    or not supported. With `fail` a file that breaks off ends the job. Missing class
    folders are simply absent, and folders further down are not searched.

    Files are listed without their content, dealt to tasks by size, and compressed ones
    read there once through `opener`, which opens a path as Spark names it.
    """
    where = _log_glob(base_dir)
    file = F.col("_metadata.file_path")
    listed = spark.read.format("binaryFile").load(where).select(file.alias("file"))
    streamed = _ends(F.col("file"), tuple(DECODERS))
    packed = listed.filter(streamed).mapInArrow(
        stream_files(opener, fail), "file string, value string, state string"
    )
    skipped = _ends(F.col("file"), UNSUPPORTED)
    states = listed.filter(~streamed).select(
        "file",
        F.lit(None).cast("string").alias("value"),
        F.when(skipped, NOT_SUPPORTED).otherwise(READ).alias("state"),
    )
    plain = spark.read.text(where).filter(~_ends(file, (*DECODERS, *UNSUPPORTED)))
    plain = plain.select(file.alias("file"), "value", F.lit(None).cast("string").alias("state"))
    rows = plain.unionByName(packed).unionByName(states)
    named = with_path_labels(rows.withColumn("log_path", plain_path(F.col("file"))), "log_path")
    return named.select("file", "app_id", "label", "value", "state")


def scan_event_logs(spark: SparkSession, base_dir: str) -> DataFrame:
    """Lines of every log as (app_id, label, value). A file that breaks off fails the job."""
    rows = scan_logs(spark, base_dir, fail=True)
    return rows.filter("state IS NULL").select("app_id", "label", "value")


def log_files(rows: DataFrame) -> DataFrame:
    """(log_path, app_id, label, state) of the files of a scan, or of events parsed from it."""
    path = plain_path(F.col("file")).alias("log_path")
    return rows.filter("state IS NOT NULL").select(path, "app_id", "label", "state")


def without_broken(rows: DataFrame) -> DataFrame:
    """The rows of all files but those that break off, which are left out whole."""
    broken = rows.filter(F.col("state") == UNREADABLE).select("file")
    return rows.join(broken, "file", "left_anti")


def read_event_log(spark: SparkSession, path: str, label: int) -> DataFrame:
    """Lines of one log file or rolled-log folder with a given label."""
    file = plain_path(F.col("_metadata.file_path"))
    lines = spark.read.text(path).select(file.alias("log_path"), "value")
    named = F.element_at(F.split("log_path", "/"), -1).startswith("appstatus_")
    return lines.filter(~named).select(
        app_id_from_path(F.col("log_path")).alias("app_id"),
        F.lit(label).alias("label"),
        "value",
    )


# ---------------------------------------------------------------- parse


def _decode(lines: DataFrame, events: tuple[str, ...], fields: str) -> DataFrame:
    """Parse the lines of the given events; drop lines that are not JSON. Rows that give the
    state of a file instead of a line stay as they are.

    `inline` stands between the parse and the filters below it: a filter on a
    plain parsed column would be pushed under the projection and parse each
    line a second time. Lines the typed parse could not fully take (a string or
    a fraction where a whole number is expected) are rare; only they are parsed
    again, with doubles, to tell broken JSON from odd values.
    """
    schema = f"`Event` STRING, {fields}, `{_BAD}` STRING"
    is_state = F.col("state").isNotNull() if "state" in lines.columns else F.lit(False)
    mentioned = is_state
    for event in events:
        mentioned = mentioned | F.col("value").contains(event)
    parsed = lines.filter(mentioned).select(
        *lines.columns,
        F.inline(F.array(F.from_json("value", schema, {"columnNameOfCorruptRecord": _BAD}))),
    )
    odd = F.col(_BAD).isNotNull()
    wide = re.sub(r"\b(BIGINT|INT)\b", "DOUBLE", fields)
    return (
        parsed.filter(F.col("Event").isin(*events) | is_state)
        .filter(F.when(odd, F.try_parse_json("value").isNotNull()).otherwise(True))
        .withColumn("wide", F.when(odd, F.from_json("value", wide)))
    )


def _number(path: str, default: int, kind: str = "bigint") -> Column:
    """A whole number; fractions are cut, anything but a number is `default`."""
    cut = F.col(f"wide.{path}").try_cast(kind)
    return F.coalesce(F.col(path), cut, F.lit(default).cast(kind))


def _text(path: str, default: str = "") -> Column:
    return F.coalesce(F.col(path), F.lit(default))


def _task_columns(duration_from_times: bool) -> dict[str, Column]:
    duration = _number("`Task Info`.`Duration`", 0)
    if duration_from_times:
        span = _number("`Task Info`.`Finish Time`", 0) - _number("`Task Info`.`Launch Time`", 0)
        duration = F.when(duration > 0, duration).otherwise(F.greatest(span, F.lit(0)))
    read = "`Task Metrics`.`Shuffle Read Metrics`"
    return {
        "stage_id": _number("`Stage ID`", -1, "int"),
        "stage_attempt_id": _number("`Stage Attempt ID`", 0, "int"),
        "task_id": _number("`Task Info`.`Task ID`", -1),
        "task_attempt": _number("`Task Info`.`Attempt`", 0, "int"),
        "executor_id": _text("`Task Info`.`Executor ID`"),
        "host": _text("`Task Info`.`Host`"),
        "success": _text("`Task End Reason`.`Reason`", SUCCESS) == SUCCESS,
        "duration_ms": duration,
        "executor_run_time": _number("`Task Metrics`.`Executor Run Time`", 0),
        "jvm_gc_time": _number("`Task Metrics`.`JVM GC Time`", 0),
        "memory_bytes_spilled": _number("`Task Metrics`.`Memory Bytes Spilled`", 0),
        "disk_bytes_spilled": _number("`Task Metrics`.`Disk Bytes Spilled`", 0),
        "peak_execution_memory": _number("`Task Metrics`.`Peak Execution Memory`", 0),
        "input_bytes_read": _number("`Task Metrics`.`Input Metrics`.`Bytes Read`", 0),
        "shuffle_bytes_read": _number(f"{read}.`Remote Bytes Read`", 0)
        + _number(f"{read}.`Local Bytes Read`", 0),
        "shuffle_bytes_written": _number(
            "`Task Metrics`.`Shuffle Write Metrics`.`Shuffle Bytes Written`", 0
        ),
        "shuffle_fetch_wait_time": _number(f"{read}.`Fetch Wait Time`", 0),
    }


def _stage_columns() -> dict[str, Column]:
    reason = F.col("`Stage Info`.`Failure Reason`")
    return {
        "stage_id": _number("`Stage Info`.`Stage ID`", -1, "int"),
        "stage_attempt_id": _number("`Stage Info`.`Stage Attempt ID`", 0, "int"),
        "stage_name": _text("`Stage Info`.`Stage Name`"),
        "num_tasks": _number("`Stage Info`.`Number of Tasks`", 0, "int"),
        "submission_time": _number("`Stage Info`.`Submission Time`", 0),
        "completion_time": _number("`Stage Info`.`Completion Time`", 0),
        "status": F.when(reason.isNotNull(), "FAILED").otherwise("COMPLETED"),
        "failure_reason": reason,
        "parent_ids": F.col("`Stage Info`.`Parent IDs`"),
    }


def parse_task_events(lines: DataFrame, duration_from_times: bool = False) -> DataFrame:
    """Task metrics (19 columns) from (app_id, label, value) lines.

    Current logs carry no task `Duration`; it is then 0 and the feature stage
    falls back to the run time. `duration_from_times` takes finish minus launch
    instead.
    """
    decoded = _decode(lines, (TASK_END,), _TASK_FIELDS)
    parsed = [c.alias(name) for name, c in _task_columns(duration_from_times).items()]
    return decoded.select("app_id", "label", *parsed)


def parse_stage_events(lines: DataFrame, with_parents: bool = False) -> DataFrame:
    """Stage metrics (10 columns; plus `parent_ids` on request) from log lines."""
    decoded = _decode(lines, (STAGE_COMPLETED,), _STAGE_FIELDS)
    parsed = [c.alias(name) for name, c in _stage_columns().items()]
    table = decoded.select("app_id", "label", *parsed)
    return table if with_parents else table.drop("parent_ids")


def parse_events(lines: DataFrame, duration_from_times: bool = False) -> DataFrame:
    """Both kinds from one pass: `kind` plus the structs `task` and `stage`.

    Written partitioned by `kind`, so that the raw logs are read once and each
    table later reads only its own part. Rows of `scan_logs` keep their file, and those
    with the state of a file are of the kind `file`.
    """
    decoded = _decode(lines, (TASK_END, STAGE_COMPLETED), f"{_TASK_FIELDS}, {_STAGE_FIELDS}")
    is_task = F.col("Event") == TASK_END
    task = F.struct(*[c.alias(n) for n, c in _task_columns(duration_from_times).items()])
    stage = F.struct(*[c.alias(n) for n, c in _stage_columns().items()])
    kept = [c for c in ("file", "state") if c in lines.columns]
    kind = F.when(is_task, "task").when(F.col("Event") == STAGE_COMPLETED, "stage")
    return decoded.select(
        "app_id",
        "label",
        *kept,
        kind.otherwise("file").alias("kind"),
        F.when(kind == "task", task).alias("task"),
        F.when(kind == "stage", stage).alias("stage"),
    )


def task_table(events: DataFrame) -> DataFrame:
    """Task metrics out of a `parse_events` table."""
    rows = events.filter(F.col("kind") == "task").select("app_id", "label", "task.*")
    return rows.select(*columns(TASK_METRICS))


def stage_table(events: DataFrame, with_parents: bool = False) -> DataFrame:
    """Stage metrics out of a `parse_events` table."""
    rows = events.filter(F.col("kind") == "stage").select("app_id", "label", "stage.*")
    extra = ["parent_ids"] if with_parents else []
    return rows.select(*columns(STAGE_METRICS), *extra)
