from __future__ import annotations

import math

import pytest

from faultweave.operators import features
from faultweave.sources.schemas import STAGE_METRICS, TASK_METRICS, columns


def task(app="a", label=0, **over):
    base = dict.fromkeys(columns(TASK_METRICS), 0)
    base.update(app_id=app, label=label, executor_id="1", host="h", success=True)
    base.update(over)
    return tuple(base.values())


def stage(app="a", label=0, **over):
    base = dict.fromkeys(columns(STAGE_METRICS), 0)
    base.update(app_id=app, label=label, stage_name="s", status="COMPLETED", failure_reason=None)
    base.update(over)
    return tuple(base.values())


def run(spark, tasks, stages, truth=None):
    t = spark.createDataFrame(tasks, TASK_METRICS)
    s = spark.createDataFrame(stages, STAGE_METRICS)
    g = None if truth is None else spark.createDataFrame(truth, "app_id string, label int")
    return {r.app_id: r.asDict() for r in features.app_features(t, s, g).collect()}


def test_layout(spark):
    got = run(spark, [task()], [stage()])["a"]
    assert list(got) == ["app_id", "label", *features.FEATURE_COLUMNS]
    assert len(features.FEATURE_COLUMNS) == 25


def test_values(spark):
    tasks = [
        task(duration_ms=10, executor_run_time=99, jvm_gc_time=4, memory_bytes_spilled=60,
             disk_bytes_spilled=20, peak_execution_memory=30, input_bytes_read=100),
        task(duration_ms=0, executor_run_time=30, success=False, task_attempt=1,
             peak_execution_memory=10),
    ]
    stages = [stage(num_tasks=2), stage(num_tasks=5, status="FAILED", failure_reason="x")]
    got = run(spark, tasks, stages)["a"]
    assert got["mean_task_duration"] == 20 and got["max_task_duration"] == 30
    assert math.isclose(got["std_task_duration"], math.sqrt(200))
    assert got["duration_variance"] == 200
    assert got["skew_index"] == 1.5 and got["max_min_duration_ratio"] == 3
    assert got["spill_ratio"] == 0.6 and got["disk_spill_ratio"] == 0.2
    assert got["peak_memory_ratio"] == 1.5
    assert math.isclose(got["gc_time_ratio"], 4 / 129)
    assert got["task_failure_rate"] == 0.5 and got["retry_count"] == 1
    assert got["total_stages"] == 2 and got["failed_stages"] == 1
    assert got["max_stage_parallelism"] == 5 and got["stage_depth_of_failure"] == 1
    assert got["completed_stage_ratio"] == got["failed_stage_ratio"] == 0.5
    assert got["spill_per_stage"] == 40 and got["gc_per_stage"] == 2


def test_empty_denominators(spark):
    got = run(spark, [task()], [stage("other")])["a"]
    assert got["std_task_duration"] == got["duration_variance"] == 0  # one task only
    assert got["skew_index"] == got["max_min_duration_ratio"] == got["peak_memory_ratio"] == 1
    assert got["spill_ratio"] == got["gc_time_ratio"] == got["total_stages"] == 0
    assert got["completed_stage_ratio"] == got["spill_per_stage"] == 0


def test_given_ground_truth_selects_and_labels(spark):
    got = run(spark, [task("a"), task("b")], [stage()], [("b", 4)])
    assert {a: r["label"] for a, r in got.items()} == {"b": 4}


def test_stats_equal_describe(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.5, 5.0)], "x double, y double")
    got = {r.feature: r for r in features.feature_stats(df, ["x", "y"]).collect()}
    want = {r.summary: r for r in df.describe("x", "y").collect()}
    for stat in ("count", "mean", "stddev", "min", "max"):
        for c in ("x", "y"):
            assert got[c][stat] == pytest.approx(float(want[stat][c]))


def test_names(spark):
    df = spark.createDataFrame([("b", 4), ("a", 4), ("c", 9)], "app_id string, label int")
    got = sorted(tuple(r) for r in features.named_ground_truth(df).collect())
    assert got == [("a", 4, "Network Failure"), ("b", 4, "Network Failure"), ("c", 9, "Unknown")]
    counts = [tuple(r) for r in features.label_distribution(df).collect()]
    assert counts == [(4, "Network Failure", 2), (9, "Unknown", 1)]
