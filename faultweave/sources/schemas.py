"""Column layouts of the persisted tables."""

from __future__ import annotations

# One row per finished task.
TASK_METRICS = """
    app_id string, label int, stage_id int, stage_attempt_id int,
    task_id bigint, task_attempt int, executor_id string, host string,
    success boolean, duration_ms bigint, executor_run_time bigint,
    jvm_gc_time bigint, memory_bytes_spilled bigint, disk_bytes_spilled bigint,
    peak_execution_memory bigint, input_bytes_read bigint,
    shuffle_bytes_read bigint, shuffle_bytes_written bigint,
    shuffle_fetch_wait_time bigint
"""

# One row per finished stage attempt.
STAGE_METRICS = """
    app_id string, label int, stage_id int, stage_attempt_id int,
    stage_name string, num_tasks int, submission_time bigint,
    completion_time bigint, status string, failure_reason string
"""

# The pipe-delimited benchmark tables. Dates are kept as text.
TABLES = {
    "customer": """
        c_custkey bigint, c_name string, c_address string, c_nationkey bigint,
        c_phone string, c_acctbal double, c_mktsegment string, c_comment string
    """,
    "lineitem": """
        l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,
        l_quantity double, l_extendedprice double, l_discount double, l_tax double,
        l_returnflag string, l_linestatus string, l_shipdate string,
        l_commitdate string, l_receiptdate string, l_shipinstruct string,
        l_shipmode string, l_comment string
    """,
    "nation": "n_nationkey bigint, n_name string, n_regionkey bigint, n_comment string",
    "orders": """
        o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
        o_orderdate string, o_orderpriority string, o_clerk string,
        o_shippriority int, o_comment string
    """,
    "part": """
        p_partkey bigint, p_name string, p_mfgr string, p_brand string, p_type string,
        p_size int, p_container string, p_retailprice double, p_comment string
    """,
    "partsupp": """
        ps_partkey bigint, ps_suppkey bigint, ps_availqty int,
        ps_supplycost double, ps_comment string
    """,
    "region": "r_regionkey bigint, r_name string, r_comment string",
    "supplier": """
        s_suppkey bigint, s_name string, s_address string, s_nationkey bigint,
        s_phone string, s_acctbal double, s_comment string
    """,
}

# The run manifest, one row per submitted run.
MANIFEST = """
    AppName string, FailureType string, Label int, RunId string,
    Timestamp string, AppId string, Status string
"""


def columns(layout: str) -> list[str]:
    """Column names of a layout, in order."""
    return [field.split()[0] for field in layout.split(",")]
