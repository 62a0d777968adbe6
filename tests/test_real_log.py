"""A log written by Spark itself, from a session of its own."""

from __future__ import annotations

import subprocess
import sys

from faultweave.operators import graph, rootcause
from faultweave.operators.features import app_features
from faultweave.sources import eventlog

JOB = """
import sys
from pyspark.sql import SparkSession, functions as F
spark = (SparkSession.builder.master("local[2]").appName("logged")
    .config("spark.ui.enabled", "false").config("spark.eventLog.enabled", "true")
    .config("spark.eventLog.dir", sys.argv[1]).config("spark.sql.shuffle.partitions", "2")
    .getOrCreate())
spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().collect()
try:
    spark.range(10).select(F.raise_error(F.lit("broken on purpose"))).collect()
except Exception:
    pass
spark.stop()
"""


def test_log_of_a_failing_application(spark, tmp_path):
    folder = tmp_path / "serialization"
    folder.mkdir()
    subprocess.run([sys.executable, "-c", JOB, f"file://{folder}"], check=True, timeout=300)

    lines = eventlog.scan_event_logs(spark, str(tmp_path)).cache()
    tasks = eventlog.parse_task_events(lines, duration_from_times=True).cache()
    stages = eventlog.parse_stage_events(lines, with_parents=True).cache()
    assert tasks.count() > 3
    assert tasks.filter("stage_id < 0 OR task_id < 0 OR duration_ms < 0 OR host = ''").count() == 0
    assert tasks.filter("executor_run_time > 0").count() > 0
    assert tasks.filter("NOT success").count() >= 1

    nodes = graph.stage_nodes(stages)
    (cause,) = rootcause.chain_root_causes(nodes).collect()
    assert "broken on purpose" in cause.failure_reason
    assert cause.analysis_confidence > 0.5
    assert nodes.filter("size(parent_ids) > 0").count() >= 1
    (row,) = app_features(tasks, stages).collect()
    assert row.label == 3 and row.failed_stages == 1 and row.task_failure_rate > 0
