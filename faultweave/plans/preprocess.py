"""Event logs to diagnosis: the ten tables of the preprocessing job.

Raw logs are read once. Every later step starts from the Parquet of the step
before it, so a lost executor repeats only its own step, and nothing but file
paths passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultweave.operators.features import app_features, named_ground_truth
from faultweave.operators.graph import chain_edges, stage_nodes
from faultweave.operators.rootcause import chain_root_causes, path_text, propagation_path
from faultweave.operators.split import random_split
from faultweave.sources.eventlog import (
    log_files,
    parse_events,
    scan_logs,
    stage_table,
    task_table,
    without_broken,
)
from faultweave.sources.logstream import UNREADABLE

# Names of the output tables.
LOG_FILES = "log_files.parquet"
TASK_METRICS = "task_metrics.parquet"
STAGE_METRICS = "stage_metrics.parquet"
DAG_EDGES = "dag_edges.parquet"
ROOT_CAUSES = "root_causes.parquet"
PATHS = "propagation_paths.parquet"
FEATURES = "features.parquet"
GROUND_TRUTH = "ground_truth.parquet"
TRAIN = "train.parquet"
TEST = "test.parquet"
OUTPUTS = (
    LOG_FILES,
    TASK_METRICS,
    STAGE_METRICS,
    DAG_EDGES,
    ROOT_CAUSES,
    PATHS,
    FEATURES,
    GROUND_TRUTH,
    TRAIN,
    TEST,
)

PARSED = "parsed_events.parquet"


def run_preprocessing(
    spark: SparkSession,
    log_dir: str,
    out_dir: str,
    strict_abort: bool = False,
    duration_from_times: bool = False,
    skip_unreadable: bool = False,
) -> dict[str, DataFrame]:
    """Run all steps and return the written tables by file name. Writes.

    A log that breaks off fails the run; with `skip_unreadable` it is left out whole.
    Either way the state of each file is written as `log_files.parquet`.
    """
    tables: dict[str, DataFrame] = {}

    def save(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out_dir}/{name}")
        tables[name] = spark.read.parquet(f"{out_dir}/{name}")
        return tables[name]

    events_path = f"{out_dir}/{PARSED}"
    parse_events(scan_logs(spark, log_dir), duration_from_times).write.mode(
        "overwrite"
    ).partitionBy("kind").parquet(events_path)
    events = spark.read.schema(_event_schema(spark)).parquet(events_path)
    files = save(LOG_FILES, log_files(events.filter(F.col("kind") == "file")))
    broken = files.filter(F.col("state") == UNREADABLE).limit(1).collect()
    if broken and not skip_unreadable:
        path = broken[0]["log_path"]
        raise ValueError(f"a log breaks off: {path}; skip_unreadable leaves such logs out")
    if broken:
        events = without_broken(events)
    tasks = save(TASK_METRICS, task_table(events))
    stages = save(STAGE_METRICS, stage_table(events))

    nodes = stage_nodes(stages)
    save(DAG_EDGES, chain_edges(nodes))
    save(ROOT_CAUSES, chain_root_causes(nodes, strict_abort))
    save(PATHS, path_text(propagation_path(nodes, strict_abort)))

    features = save(FEATURES, app_features(tasks, stages))
    save(GROUND_TRUTH, named_ground_truth(features))
    train, test = random_split(features)
    save(TRAIN, train)
    save(TEST, test)
    return tables


def _event_schema(spark: SparkSession):
    columns = "file string, app_id string, label int, value string, state string"
    return parse_events(spark.createDataFrame([], columns)).schema


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per written table."""
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        counts = one if counts is None else counts.unionByName(one)
    return counts
