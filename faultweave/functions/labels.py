"""The seven failure classes: folder names, display names and scenarios."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Class id of each log folder.
FOLDER_LABELS = {
    "baseline": 0,
    "oom": 1,
    "skew": 2,
    "serialization": 3,
    "network": 4,
    "disk": 5,
    "metadata": 6,
}

# Names in the ground-truth table.
GROUND_TRUTH_NAMES = {
    0: "Baseline",
    1: "OOM",
    2: "Data Skew",
    3: "Serialization Failure",
    4: "Network Failure",
    5: "Disk Spill Overload",
    6: "Metadata Failure",
}

# Names in the classification reports.
CLASS_NAMES = {
    0: "Baseline",
    1: "OOM",
    2: "Data Skew",
    3: "Serialization Failure",
    4: "Network Timeout",
    5: "Disk Space Failure",
    6: "Metadata Failure",
}


class Scenario(NamedTuple):
    label: int
    name: str
    description: str
    tpch_query: str
    injection_method: str


# One scenario per class.
SCENARIOS = (
    Scenario(0, "BASELINE", "Normal execution - no injected failures", "Q21", "None"),
    Scenario(
        1,
        "OUT_OF_MEMORY",
        "Container killed by YARN for exceeding memory limits",
        "Q9",
        "Forced BROADCAST hint on lineitem (largest table)",
    ),
    Scenario(
        2,
        "DATA_SKEW",
        "Executor becomes a straggler due to skewed data distribution",
        "Q18",
        "Salt join key to create 99% skew",
    ),
    Scenario(
        3,
        "SERIALIZATION_FAILURE",
        "Task not serializable exception during map stage",
        "Q2",
        "UDF with non-serializable Socket in closure",
    ),
    Scenario(
        4,
        "NETWORK_TIMEOUT",
        "ExecutorLost due to missed heartbeats",
        "Q1",
        "UDF with sleep exceeding heartbeat timeout",
    ),
    Scenario(
        5,
        "DISK_SPACE_FAILURE",
        "No space left on device during shuffle spill",
        "Cartesian Product",
        "crossJoin causing massive shuffle spill to /tmp/hadoop-yarn",
    ),
    Scenario(
        6,
        "METADATA_FAILURE",
        "FileNotFoundException or MetadataFetchFailed",
        "Iterative Join",
        "External thread drops/renames HDFS path before execution",
    ),
)

SCENARIO_SCHEMA = (
    "label int, name string, description string, tpch_query string, injection_method string"
)


def lookup(key: Column, mapping: Mapping, default: Column) -> Column:
    """`mapping[key]` as one CASE expression, `default` for any other key."""
    expr = F
    for k, v in mapping.items():
        expr = expr.when(key == F.lit(k), F.lit(v))
    return expr.otherwise(default)


def label_name(label: Column, names: Mapping[int, str] = CLASS_NAMES) -> Column:
    """Display name of a class id, `Unknown` outside the seven classes."""
    return lookup(label, names, F.lit("Unknown"))


def scenario_name(label: Column) -> Column:
    """Scenario name of a class id, `UNKNOWN(id)` outside the seven classes."""
    names = {s.label: s.name for s in SCENARIOS}
    unknown = F.concat(F.lit("UNKNOWN("), label.cast("string"), F.lit(")"))
    return lookup(label, names, unknown)


def scenarios(spark: SparkSession) -> DataFrame:
    """The scenario dimension: always seven rows, so safe to broadcast."""
    return spark.createDataFrame(SCENARIOS, SCENARIO_SCHEMA)


def scenarios_by_label(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Attach the scenario of `label_col`; rows of no known class are dropped."""
    dim = scenarios(df.sparkSession)
    return df.join(F.broadcast(dim), df[label_col] == dim["label"]).drop(dim["label"])


def scenarios_by_name(df: DataFrame, name_col: str) -> DataFrame:
    """Attach the scenario called `name_col`, ignoring case; others are dropped."""
    dim = scenarios(df.sparkSession)
    return df.join(F.broadcast(dim), F.lower(df[name_col]) == F.lower(dim["name"]))
