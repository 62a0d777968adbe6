"""Plans that must stay as they are to hold at scale."""

from __future__ import annotations

import pytest

from faultweave.operators import features, graph, rootcause, sizing
from faultweave.sources.schemas import STAGE_METRICS, TASK_METRICS


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    """Empty task and stage tables on disk: plans only."""
    base = tmp_path_factory.mktemp("plans")
    for name, layout in (("tasks", TASK_METRICS), ("stages", STAGE_METRICS)):
        spark.createDataFrame([], layout).write.parquet(f"{base}/{name}")
    return spark.read.parquet(f"{base}/tasks"), spark.read.parquet(f"{base}/stages")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_root_cause_takes_three_shuffles_and_no_join(logs):
    causes = rootcause.chain_root_causes(graph.stage_nodes(logs[1]))
    plan = plan_of(causes)
    assert plan.count("Exchange hashpartitioning") == 3
    assert "Join" not in plan and "Exchange SinglePartition" not in plan


def test_features_scan_each_table_once(logs, no_broadcast):
    plan = plan_of(features.app_features(*logs))
    assert plan.count("FileScan parquet") == 2
    assert plan.count("Exchange") == 2  # the join reuses the shuffles of the sums
    assert "partial_sum" in plan


def test_only_needed_columns_are_read(logs):
    plan = plan_of(features.ground_truth(logs[0]))
    assert "ReadSchema: struct<app_id:string,label:int>" in plan


class Frame:
    """Just enough of a frame and its session to see where its lineage is cut."""

    def __init__(self, folder=None):
        self.folder, self.chosen, self.cut = folder, None, None
        self.sparkSession = self.sparkContext = self.conf = self

    def get(self, key, default):
        return self.folder or default

    def getCheckpointDir(self):
        return self.chosen

    def setCheckpointDir(self, path):
        self.chosen = path

    def checkpoint(self, eager):
        return "written"

    def persist(self):
        return "cached"


def test_lineage_is_cut_where_the_session_says():
    frame = Frame("hdfs:///checkpoints")
    assert sizing.cut_lineage(frame) == "written"
    assert frame.chosen == "hdfs:///checkpoints"


def test_lineage_is_cached_without_a_shared_folder():
    frame = Frame()
    assert sizing.cut_lineage(frame) == "cached"
    assert frame.chosen is None
