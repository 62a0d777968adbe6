"""Hand-written logs: every file form, and every way a line can be off."""

from __future__ import annotations

import gzip
import io
import json

import pyarrow as pa
import pytest
import xxhash
import zstandard

from faultweave.plans import preprocess
from faultweave.sources import eventlog, logstream


def task(stage=1, task_id=1, **over):
    event = {
        "Event": "SparkListenerTaskEnd",
        "Stage ID": stage,
        "Stage Attempt ID": 0,
        "Task End Reason": {"Reason": "Success"},
        "Task Info": {
            "Task ID": task_id,
            "Attempt": 0,
            "Executor ID": "1",
            "Host": "h",
            "Launch Time": 1000,
            "Finish Time": 1700,
        },
        "Task Metrics": {
            "Executor Run Time": 50,
            "JVM GC Time": 5,
            "Memory Bytes Spilled": 10,
            "Disk Bytes Spilled": 20,
            "Peak Execution Memory": 30,
            "Input Metrics": {"Bytes Read": 40},
            "Shuffle Read Metrics": {
                "Remote Bytes Read": 3,
                "Local Bytes Read": 4,
                "Fetch Wait Time": 6,
            },
            "Shuffle Write Metrics": {"Shuffle Bytes Written": 8},
        },
    }
    event.update(over)
    return json.dumps(event)


def stage(stage_id=1, attempt=0, reason=None, parents=(), **over):
    info = {
        "Stage ID": stage_id,
        "Stage Attempt ID": attempt,
        "Stage Name": f"s{stage_id}",
        "Number of Tasks": 2,
        "Submission Time": 10,
        "Completion Time": 20 + attempt,
        "Parent IDs": list(parents),
    }
    if reason is not None:
        info["Failure Reason"] = reason
    info.update(over)
    return json.dumps({"Event": "SparkListenerStageCompleted", "Stage Info": info})


def as_lines(spark, lines):
    schema = "app_id string, label int, value string"
    return spark.createDataFrame([("a", 1, line) for line in lines], schema)


def parsed_tasks(spark, *lines, **params):
    df = as_lines(spark, lines)
    return [r.asDict() for r in eventlog.parse_task_events(df, **params).collect()]


def parsed_stages(spark, *lines, **params):
    df = as_lines(spark, lines)
    return [r.asDict() for r in eventlog.parse_stage_events(df, **params).collect()]


def test_task_fields(spark):
    (row,) = parsed_tasks(spark, task(7, 9))
    assert row == {
        "app_id": "a",
        "label": 1,
        "stage_id": 7,
        "stage_attempt_id": 0,
        "task_id": 9,
        "task_attempt": 0,
        "executor_id": "1",
        "host": "h",
        "success": True,
        "duration_ms": 0,
        "executor_run_time": 50,
        "jvm_gc_time": 5,
        "memory_bytes_spilled": 10,
        "disk_bytes_spilled": 20,
        "peak_execution_memory": 30,
        "input_bytes_read": 40,
        "shuffle_bytes_read": 7,
        "shuffle_bytes_written": 8,
        "shuffle_fetch_wait_time": 6,
    }


def test_duration_from_times(spark):
    (row,) = parsed_tasks(spark, task(), duration_from_times=True)
    assert row["duration_ms"] == 700


def test_defaults_of_missing_fields(spark):
    (row,) = parsed_tasks(spark, '{"Event":"SparkListenerTaskEnd"}')
    assert (row["stage_id"], row["task_id"], row["host"]) == (-1, -1, "")
    assert row["success"] is True
    assert row["executor_run_time"] == row["shuffle_bytes_read"] == 0


def test_failed_task(spark):
    (row,) = parsed_tasks(spark, task(**{"Task End Reason": {"Reason": "TaskKilled"}}))
    assert row["success"] is False


def test_odd_numbers(spark):
    metrics = {"Executor Run Time": "12", "JVM GC Time": 7.9, "Peak Execution Memory": 3}
    (row,) = parsed_tasks(spark, task(**{"Task Metrics": metrics, "Stage ID": 2.5}))
    assert row["executor_run_time"] == 0
    assert row["jvm_gc_time"] == 7
    assert row["peak_execution_memory"] == 3
    assert row["stage_id"] == 2


def test_object_of_wrong_kind(spark):
    (row,) = parsed_tasks(spark, task(**{"Task Metrics": 5}))
    assert (row["task_id"], row["executor_run_time"]) == (1, 0)


def test_broken_and_foreign_lines_are_dropped(spark):
    decoy = json.dumps({"Event": "SparkListenerLogStart", "Note": "SparkListenerTaskEnd"})
    escaped = json.dumps({"Event": "Other", "Text": '{"Event":"SparkListenerTaskEnd"}'})
    lines = [task()[:80], "no json SparkListenerTaskEnd", "", decoy, escaped, task(3)]
    assert [r["stage_id"] for r in parsed_tasks(spark, *lines)] == [3]


def test_stage_fields(spark):
    ok, bad = parsed_stages(spark, stage(1), stage(2, 1, "boom", [1]), with_parents=True)
    assert (ok["status"], ok["failure_reason"], ok["parent_ids"]) == ("COMPLETED", None, [])
    assert (bad["status"], bad["failure_reason"], bad["parent_ids"]) == ("FAILED", "boom", [1])
    assert (bad["stage_name"], bad["num_tasks"], bad["completion_time"]) == ("s2", 2, 21)


def test_empty_failure_reason_is_a_failure(spark):
    (row,) = parsed_stages(spark, stage(reason=""))
    assert (row["status"], row["failure_reason"]) == ("FAILED", "")


def test_one_pass_equals_two(spark):
    lines = [task(i, i) for i in range(5)]
    lines += [stage(i, reason="x" if i % 2 else None) for i in range(4)]
    lines += [task(9)[:50], task(8, **{"Stage ID": "text"})]
    df = as_lines(spark, lines)
    events = eventlog.parse_events(df)
    assert sorted(eventlog.task_table(events).collect()) == sorted(
        eventlog.parse_task_events(df).collect()
    )
    assert sorted(map(str, eventlog.stage_table(events).collect())) == sorted(
        map(str, eventlog.parse_stage_events(df).collect())
    )


def test_each_line_is_parsed_once(spark):
    df = as_lines(spark, [task()])
    plan = eventlog.parse_task_events(df)._jdf.queryExecution().optimizedPlan().toString()
    # The typed parse, and the wide parse of odd lines.
    assert plan.count("from_json(") == 2


@pytest.fixture(scope="module")
def log_dir(tmp_path_factory):
    base = tmp_path_factory.mktemp("logs")

    def put(path, lines, kind=""):
        target = base / path
        target.parent.mkdir(parents=True, exist_ok=True)
        data = "\n".join(lines).encode()
        if kind == "zstd":
            data = zstandard.ZstdCompressor().compress(data)
        elif kind == "gz":
            data = gzip.compress(data)
        target.write_bytes(data)

    put("baseline/application_1", [task(0), task(1), stage(0), stage(1)])
    put("oom/application_2.zstd", [task(0), stage(0, reason="OOM: heap space lost")], "zstd")
    put("skew/application_3.gz", [task(0), stage(0)], "gz")
    put("network/eventlog_v2_app-4/events_1_app-4.zstd", [task(0), stage(0, 0, "lost")], "zstd")
    put("network/eventlog_v2_app-4/events_2_app-4", [task(1), stage(0, 1), stage(1)])
    put("network/eventlog_v2_app-4/appstatus_app-4", [])
    put("archive/application_5", [task(0)])
    put("disk/notes.txt", [task(0)])
    put("metadata/deep/er/application_6", [task(0)])
    return str(base)


def test_scan(spark, log_dir):
    counts = eventlog.scan_event_logs(spark, log_dir).groupBy("app_id", "label").count()
    seen = {(r.app_id, r.label): r["count"] for r in counts.collect()}
    assert seen == {
        ("application_1", 0): 4,
        ("application_2", 1): 2,
        ("application_3", 2): 2,
        ("app-4", 4): 5,
    }


def test_single_log(spark, log_dir):
    lines = eventlog.read_event_log(spark, f"{log_dir}/network/eventlog_v2_app-4", 4)
    assert {r.app_id for r in lines.collect()} == {"app-4"}
    assert eventlog.parse_task_events(lines).count() == 2


def lz4_block(data: bytes, packed: bool = True) -> bytes:
    body = pa.Codec("lz4_raw").compress(data, asbytes=True) if packed and data else data
    check = xxhash.xxh32_intdigest(data, 0x9747B28C) & 0x0FFFFFFF if data else 0
    head = [len(body), len(data), check]
    method = (0x20 if packed and data else 0x10) | 6
    return b"LZ4Block" + bytes([method]) + b"".join(n.to_bytes(4, "little") for n in head) + body


def lz4_stream(data: bytes, size: int = 1 << 16) -> bytes:
    """As Spark's own writer frames it: blocks, some of them plain, and a mark at the end."""
    parts = [data[i : i + size] for i in range(0, len(data), size)]
    return b"".join(lz4_block(p, i % 3 != 1) for i, p in enumerate(parts)) + lz4_block(b"")


PACKERS = {
    ".gz": gzip.compress,
    ".zst": lambda data: zstandard.ZstdCompressor().compress(data),
    ".lz4": lz4_stream,
}


@pytest.mark.parametrize("end", PACKERS)
def test_streams_end_where_their_codec_says(end, monkeypatch):
    monkeypatch.setattr(logstream, "PIECE", 777)
    monkeypatch.setattr(logstream, "STEP", 1000)
    monkeypatch.setattr(logstream, "FED", 100)
    text = "".join(f"line {i} of ünïcode text\r\n"[: 30 - i % 3] for i in range(9000)).encode()
    packed = PACKERS[end](text)

    def lines(data):
        pieces = logstream.decoded("log" + end, io.BytesIO(data))
        return [line for own in logstream.line_batches(pieces) for line in own]

    want = text.decode().replace("\r\n", "\n").removesuffix("\n").split("\n")
    assert lines(packed) == want
    assert lines(packed + packed) == (text + text).decode().replace("\r\n", "\n").removesuffix(
        "\n"
    ).split("\n")
    assert lines(b"") == []
    for broken in (packed[:-1], packed[: len(packed) // 2], packed[:3], packed + b"x", b"plain"):
        with pytest.raises(logstream.BrokenLog):
            lines(broken)


def test_a_log_is_not_held_whole(spark, tmp_path):
    """A log of 200 MB packed into few bytes comes in bounded pieces."""
    line = task(1, 1).encode() + b"\n"
    packer = zstandard.ZstdCompressor().compressobj()
    (tmp_path / "oom").mkdir()
    times = 200_000_000 // len(line) // 1000
    with open(tmp_path / "oom" / "application_1.zstd", "wb") as file:
        for _ in range(times):
            file.write(packer.compress(line * 1000))
        file.write(packer.flush())
    with open(tmp_path / "oom" / "application_1.zstd", "rb") as file:
        pieces = logstream.decoded("application_1.zstd", file)
        assert max(map(len, pieces)) < 100_000_000
    assert eventlog.scan_event_logs(spark, str(tmp_path)).count() == times * 1000


def test_files_are_listed_without_content(spark, log_dir):
    plan = eventlog.scan_logs(spark, log_dir)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "ReadSchema: struct<>" in plan


@pytest.fixture
def mixed_logs(tmp_path):
    """Whole logs beside ones that break off, one of an unknown codec and one out of place."""
    lines = "\n".join(task(i, i) for i in range(3000)).encode()
    for path, data in {
        "oom/application_1 a+b%c": lines,
        "oom/application_2.gz": gzip.compress(lines) + gzip.compress(b"\n" + lines),
        "oom/application_3.gz": gzip.compress(lines)[:-3000],
        "skew/application_4.zstd": zstandard.ZstdCompressor().compress(lines)[:-500],
        "skew/application_5.zstd": b"this is not zstd at all",
        "skew/application_6.lz4": b"LZ4Block" + bytes(range(256)) * 40,
        "skew/application_10.lz4": lz4_stream(lines),
        "skew/application_11.lz4": lz4_stream(lines)[:-30],
        "skew/application_12.snappy": b"anything",
        "disk/eventlog_v2_app 7/events_1_app.zst": zstandard.ZstdCompressor().compress(lines),
        "archive/old/oom/application_8": lines,
        "oom/old/application_9": lines,
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    return str(tmp_path)


def test_broken_logs_are_left_out_whole_and_named(spark, mixed_logs):
    rows = eventlog.scan_logs(spark, mixed_logs)
    outcome = eventlog.log_files(rows)
    lines = eventlog.without_broken(rows).filter("state IS NULL")
    counts = {r.app_id: r["count"] for r in lines.groupBy("app_id").count().collect()}
    assert counts == {"application_1 a+b%c": 3000, "application_2": 6000, "app 7": 3000, "application_10": 3000}
    states = {r.app_id: (r.label, r.state) for r in outcome.collect()}
    assert states == {
        "application_1 a+b%c": (1, "read"),
        "application_2": (1, "read"),
        "application_3": (1, "unreadable"),
        "application_4": (2, "unreadable"),
        "application_5": (2, "unreadable"),
        "application_6": (2, "unreadable"),
        "application_10": (2, "read"),
        "application_11": (2, "unreadable"),
        "application_12": (2, "not supported"),
        "app 7": (5, "read"),
    }


def test_broken_logs_fail_unless_skipped(spark, mixed_logs, tmp_path):
    with pytest.raises(Exception, match="a log breaks off"):
        eventlog.scan_event_logs(spark, mixed_logs).count()
    with pytest.raises(ValueError, match="breaks off"):
        preprocess.run_preprocessing(spark, mixed_logs, str(tmp_path / "out"))
    tables = preprocess.run_preprocessing(
        spark, mixed_logs, str(tmp_path / "out"), skip_unreadable=True
    )
    assert tables[preprocess.TASK_METRICS].count() == 15_000
    assert tables[preprocess.LOG_FILES].count() == 10


def test_preprocessing(spark, log_dir, tmp_path):
    tables = preprocess.run_preprocessing(spark, log_dir, str(tmp_path))
    assert tuple(tables) == preprocess.OUTPUTS
    counts = {r.table_name: r.row_count for r in preprocess.row_counts(tables).collect()}
    assert counts[preprocess.TASK_METRICS] == 6
    assert counts[preprocess.STAGE_METRICS] == 7
    assert counts[preprocess.DAG_EDGES] == 6
    assert counts[preprocess.TRAIN] + counts[preprocess.TEST] == counts[preprocess.FEATURES] == 4
    causes = {r.app_id: r for r in tables[preprocess.ROOT_CAUSES].collect()}
    assert causes["application_1"].failure_reason == "NO_FAILURE"
    assert causes["application_2"].failure_reason == "OOM: heap space lost"
    # The second attempt of the stage succeeded.
    assert causes["app-4"].failure_reason == "NO_FAILURE"
    truth = [tuple(r) for r in tables[preprocess.GROUND_TRUTH].orderBy("label").collect()]
    assert truth[1] == ("application_2", 1, "OOM")
