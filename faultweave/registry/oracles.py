"""The same queries as plain SQL over the given tables, written independently.

Where the Spark side uses a closed form (chain root cause, cross-join totals,
quantities per order), the SQL takes the literal route instead.
"""

from __future__ import annotations

from faultweave.functions.labels import SCENARIOS
from faultweave.operators.features import FEATURE_COLUMNS

ORACLES: dict[str, str] = {}

# ---------------------------------------------------------------- derived tables

_REASON = """
CASE (user_id + day(ts)) % 3
    WHEN 0 THEN 'Job was cancelled by operator'
    WHEN 1 THEN 'ExecutorLostFailure: heartbeat timed out'
    ELSE 'OOM' END
"""


def _stages(name: str, attempt: str) -> str:
    return f"""
{name} AS (
    SELECT 'app_' || user_id AS app_id, CAST(user_id % 7 AS INTEGER) AS label,
           CAST(day(ts) * 300 AS INTEGER) AS stage_id, CAST(attempt AS INTEGER) AS stage_attempt_id,
           'stage ' || day(ts) AS stage_name, CAST(count(*) AS INTEGER) AS num_tasks,
           epoch_us(min(ts)) // 1000 AS submission_time,
           epoch_us(max(ts)) // 1000 AS completion_time,
           CASE WHEN bool_or(event_type = 'error') THEN 'FAILED' ELSE 'COMPLETED' END AS status,
           CASE WHEN bool_or(event_type = 'error') THEN {_REASON} END AS failure_reason
    FROM (SELECT *, {attempt} AS attempt FROM events) GROUP BY user_id, day(ts), attempt
)"""


STAGES = _stages("stages", "0")
GRAPH = f"""{_stages("all_stages", "0")},
stages AS (
    SELECT * REPLACE (CASE WHEN status = 'COMPLETED' AND (label + num_tasks) % 3 = 0
                           THEN 'SKIPPED' ELSE status END AS status)
    FROM all_stages
)"""
ATTEMPTS = _stages("attempts", "hour(ts) // 12")

TASKS = """
tasks AS (
    SELECT 'app_' || user_id AS app_id, CAST(user_id % 7 AS INTEGER) AS label,
           CAST(day(ts) * 300 AS INTEGER) AS stage_id, 0 AS stage_attempt_id,
           event_id AS task_id, CAST(event_id % 3 AS INTEGER) AS task_attempt,
           'exec_' || (event_id % 4) AS executor_id, 'host_' || (event_id % 2) AS host,
           event_type <> 'error' AS success,
           CASE WHEN event_id % 5 = 0 THEN 0
                ELSE CAST(floor(value * 100) AS BIGINT) END AS duration_ms,
           CAST(floor(value * 90) AS BIGINT) + 1 AS executor_run_time,
           CAST(floor(value * 3) AS BIGINT) AS jvm_gc_time,
           CASE WHEN event_type = 'purchase' THEN (event_id % 1000) * 1024 ELSE 0 END
               AS memory_bytes_spilled,
           CASE WHEN event_type = 'purchase' THEN (event_id % 500) * 1024 ELSE 0 END
               AS disk_bytes_spilled,
           (event_id % 64) * 1048576 AS peak_execution_memory,
           (event_id % 100) * 1000 AS input_bytes_read,
           (event_id % 977) * 10 AS shuffle_bytes_read,
           (event_id % 877) * 10 AS shuffle_bytes_written,
           event_id % 13 AS shuffle_fetch_wait_time
    FROM events
)"""

APPS = """
apps AS (
    SELECT DISTINCT 'app_' || user_id AS app_id, CAST(user_id % 7 AS INTEGER) AS label
    FROM events
)"""

LINKED = """
linked AS (
    SELECT *, lag(stage_id) OVER w AS prev_id, lead(stage_id) OVER w AS next_id,
           lag(status) OVER w AS prev_status, lag(failure_reason) OVER w AS prev_reason,
           lag(stage_name) OVER w AS prev_name, lead(stage_name) OVER w AS next_name,
           lead(status) OVER w AS next_status
    FROM stages WINDOW w AS (PARTITION BY app_id ORDER BY stage_id)
)"""


def _abort(reason: str, words: tuple[str, ...]) -> str:
    tests = [f"contains(lower(coalesce({reason}, '')), '{w}')" for w in words]
    return "(" + " OR ".join(tests) + ")"


def _chain(words: tuple[str, ...] = ("cancelled", "aborted")) -> str:
    """CTEs up to `causes` and `walk`: a literal walk, parent by parent."""
    return f"""
WITH RECURSIVE {GRAPH}, {LINKED},
ends AS (
    SELECT app_id, max(stage_id) AS leaf,
           max(CASE WHEN status = 'FAILED' THEN stage_id END) AS terminal,
           count(*) FILTER (status = 'FAILED'
                            AND coalesce(prev_status, '') <> 'FAILED') AS candidates
    FROM linked GROUP BY app_id
),
walk AS (
    SELECT app_id, coalesce(terminal, leaf) AS stage_id FROM ends
    UNION ALL
    SELECT l.app_id, l.prev_id FROM walk w
    JOIN linked l ON l.app_id = w.app_id AND l.stage_id = w.stage_id
    WHERE l.status = 'FAILED' AND l.prev_status = 'FAILED'
      AND NOT {_abort("l.prev_reason", words)}
),
roots AS (
    SELECT app_id, min(stage_id) AS root, string_agg(CAST(stage_id AS VARCHAR), ','
           ORDER BY stage_id) AS path
    FROM walk GROUP BY app_id
),
causes AS (
    SELECT e.app_id, r.root AS root_cause_stage_id, l.stage_name AS root_cause_stage_name,
           CASE WHEN e.terminal IS NULL THEN 'NO_FAILURE'
                ELSE coalesce(l.failure_reason, 'Unknown') END AS failure_reason,
           coalesce(e.terminal, e.leaf) AS terminal_stage_id, r.path,
           CASE WHEN e.terminal IS NULL THEN 1.0::DOUBLE
                ELSE greatest(0, least(100,
                    50 + CASE WHEN length(l.failure_reason) > 10 THEN 20 ELSE 0 END + 15
                    + CASE WHEN coalesce(l.prev_status, 'COMPLETED') = 'COMPLETED'
                           THEN 15 ELSE 0 END
                    - 10 * greatest(e.candidates - 1, 0))) / 100.0::DOUBLE
           END AS analysis_confidence
    FROM ends e JOIN roots r USING (app_id)
    JOIN linked l ON l.app_id = e.app_id AND l.stage_id = r.root
)"""


_CAUSE_COLUMNS = "app_id, root_cause_stage_id, root_cause_stage_name, failure_reason"

_CAUSES = f"""
SELECT {_CAUSE_COLUMNS}, terminal_stage_id,
       CAST(len(string_split(path, ',')) AS BIGINT) AS path_length, analysis_confidence
FROM causes"""

ORACLES["root_cause_chain"] = _chain() + _CAUSES
ORACLES["root_cause_strict"] = _chain(("cancelled",)) + _CAUSES

ORACLES["root_cause_path_text"] = f"""{_chain()}
SELECT w.app_id, w.stage_id // 4096 AS part,
       string_agg(CAST(w.stage_id AS VARCHAR), ',' ORDER BY w.stage_id) AS propagation_path,
       coalesce(string_agg(CASE WHEN w.stage_id <> c.root_cause_stage_id
                                THEN CAST(w.stage_id AS VARCHAR) END, ','
                           ORDER BY w.stage_id), '') AS victim_stages
FROM walk w JOIN causes c USING (app_id) GROUP BY 1, 2"""

ORACLES["propagation_path"] = f"""{_chain()}
SELECT w.app_id, w.stage_id, w.stage_id <> c.root_cause_stage_id AS is_victim
FROM walk w JOIN causes c USING (app_id)"""

ORACLES["root_cause_summary"] = f"""{_chain()}
SELECT failure_reason, substring(failure_reason, 1, 30) AS reason_start,
       count(*) AS occurrences
FROM causes GROUP BY 1, 2"""

# ---------------------------------------------------------------- graph

ORACLES["dag_nodes"] = f"""WITH {ATTEMPTS}
SELECT app_id, stage_id, stage_name, status, failure_reason FROM attempts
QUALIFY row_number() OVER (PARTITION BY app_id, stage_id ORDER BY stage_attempt_id DESC) = 1"""

ORACLES["dag_edges"] = f"""WITH {GRAPH}, {LINKED}
SELECT app_id, stage_id, coalesce(prev_id, -1) AS parent_stage_id, stage_name, status
FROM linked"""

ORACLES["dag_edges_inner"] = f"""WITH {GRAPH}, {LINKED}
SELECT app_id, prev_id AS parent_stage_id, stage_id AS child_stage_id
FROM linked WHERE prev_id IS NOT NULL"""

ORACLES["dag_shape"] = f"""WITH {GRAPH}
SELECT app_id, count(*) AS total_stages, min(stage_id) AS root_stage_id,
       max(stage_id) AS leaf_stage_id, count(*) AS depth, true AS is_acyclic
FROM stages GROUP BY app_id"""

ORACLES["dag_neighbours"] = f"""WITH {GRAPH}, {LINKED}
SELECT app_id, stage_id,
       CASE status WHEN 'COMPLETED' THEN '✓' WHEN 'FAILED' THEN '✗'
            WHEN 'SKIPPED' THEN '○' ELSE '?' END AS icon, status,
       coalesce(CAST(prev_id AS VARCHAR), 'none') AS parents,
       coalesce(CAST(next_id AS VARCHAR), 'none') AS children,
       failure_reason, substring(failure_reason, 1, 50) AS reason_start
FROM linked"""

ORACLES["dag_parents"] = f"""WITH {GRAPH}, {LINKED}
SELECT app_id, stage_id AS child_stage_id, prev_id AS parent_stage_id,
       prev_name AS parent_name, prev_status AS parent_status
FROM linked WHERE prev_id IS NOT NULL"""

ORACLES["dag_children"] = f"""WITH {GRAPH}, {LINKED}
SELECT app_id, stage_id AS parent_stage_id, next_id AS child_stage_id,
       next_name AS child_name, next_status AS child_status
FROM linked WHERE next_id IS NOT NULL"""

ORACLES["dag_ancestors"] = f"""{_chain()}
SELECT s.app_id, c.root_cause_stage_id AS seed_stage_id, s.stage_id AS ancestor_stage_id
FROM stages s JOIN causes c ON s.app_id = c.app_id AND s.stage_id < c.root_cause_stage_id"""

ORACLES["dag_descendants"] = f"""{_chain()}
SELECT s.app_id, c.root_cause_stage_id AS seed_stage_id, s.stage_id AS descendant_stage_id
FROM stages s JOIN causes c ON s.app_id = c.app_id AND s.stage_id > c.root_cause_stage_id"""

# ---------------------------------------------------------------- lineage

_LINEAGE = f"""{GRAPH},
ordered AS (
    SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY stage_id) AS o FROM stages
),
edges AS (
    SELECT c.app_id, c.stage_id AS child, p.stage_id AS parent
    FROM ordered c JOIN ordered p ON p.app_id = c.app_id AND p.o = c.o - 1
    UNION
    SELECT c.app_id, c.stage_id, p.stage_id
    FROM ordered c JOIN ordered p ON p.app_id = c.app_id AND p.o = c.o // 2 AND p.o < c.o
)"""

_ABORTED = _abort("failure_reason", ("cancelled", "aborted"))

ORACLES["root_cause_lineage"] = f"""WITH RECURSIVE {_LINEAGE},
parents AS (
    SELECT e.app_id, e.child AS stage_id, count(*) AS parents,
           bool_or(s.status = 'FAILED') AS any_failed,
           bool_or(s.status = 'FAILED' AND NOT {_ABORTED}) AS any_cause,
           bool_and(s.status = 'COMPLETED') AS clean
    FROM edges e JOIN stages s ON s.app_id = e.app_id AND s.stage_id = e.parent
    GROUP BY 1, 2
),
children AS (
    SELECT e.app_id, e.parent AS stage_id, bool_or(s.status = 'FAILED') AS any_failed
    FROM edges e JOIN stages s ON s.app_id = e.app_id AND s.stage_id = e.child
    GROUP BY 1, 2
),
info AS (
    SELECT s.*, {_ABORTED} AS abort, coalesce(p.parents, 0) AS parents,
           coalesce(p.any_failed, false) AS parent_failed,
           coalesce(p.any_cause, false) AS cause_above, coalesce(p.clean, true) AS clean,
           c.stage_id IS NULL AS is_leaf, coalesce(c.any_failed, false) AS child_failed
    FROM stages s LEFT JOIN parents p USING (app_id, stage_id)
    LEFT JOIN children c USING (app_id, stage_id)
),
ends AS (
    SELECT app_id,
           coalesce(max(CASE WHEN status = 'FAILED' AND is_leaf THEN stage_id END),
                    max(CASE WHEN status = 'FAILED' AND NOT child_failed THEN stage_id END),
                    max(CASE WHEN status = 'FAILED' THEN stage_id END)) AS terminal,
           max(CASE WHEN is_leaf THEN stage_id END) AS leaf,
           count(*) FILTER (status = 'FAILED' AND NOT parent_failed) AS candidates
    FROM info GROUP BY app_id
),
walk AS (
    SELECT app_id, coalesce(terminal, leaf) AS stage_id FROM ends
    UNION
    SELECT e.app_id, e.parent FROM walk w
    JOIN info c ON c.app_id = w.app_id AND c.stage_id = w.stage_id AND c.status = 'FAILED'
    JOIN edges e ON e.app_id = w.app_id AND e.child = w.stage_id
    JOIN info p ON p.app_id = e.app_id AND p.stage_id = e.parent
               AND p.status = 'FAILED' AND NOT p.abort
),
summed AS (
    SELECT w.app_id,
           max(CASE WHEN i.status = 'FAILED' AND NOT i.cause_above THEN w.stage_id END) AS root,
           bool_and(i.parents <= 1) AS single
    FROM walk w JOIN info i USING (app_id, stage_id) GROUP BY w.app_id
),
texts AS (
    SELECT w.app_id, w.stage_id // 4096 AS part,
           string_agg(CAST(w.stage_id AS VARCHAR), ',' ORDER BY w.stage_id) AS path,
           string_agg(CASE WHEN i.status = 'FAILED' AND i.cause_above
                           THEN CAST(w.stage_id AS VARCHAR) END, ',' ORDER BY w.stage_id) AS victims
    FROM walk w JOIN info i USING (app_id, stage_id) GROUP BY 1, 2
)
SELECT e.app_id, i.stage_id AS root_cause_stage_id, i.stage_name AS root_cause_stage_name,
       CASE WHEN e.terminal IS NULL THEN 'NO_FAILURE'
            ELSE coalesce(i.failure_reason, 'Unknown') END AS failure_reason,
       coalesce(e.terminal, e.leaf) AS terminal_stage_id,
       CASE WHEN e.terminal IS NULL THEN 1.0::DOUBLE
            ELSE greatest(0, least(100,
                50 + CASE WHEN length(i.failure_reason) > 10 THEN 20 ELSE 0 END
                + CASE WHEN s.single THEN 15 ELSE 0 END + CASE WHEN i.clean THEN 15 ELSE 0 END
                - 10 * greatest(e.candidates - 1, 0))) / 100.0::DOUBLE
       END AS analysis_confidence,
       t.part, t.path AS propagation_path, coalesce(t.victims, '') AS victim_stages
FROM ends e JOIN summed s USING (app_id) JOIN texts t USING (app_id)
JOIN info i ON i.app_id = e.app_id AND i.stage_id = coalesce(s.root, e.terminal, e.leaf)"""

ORACLES["dag_shape_lineage"] = f"""WITH RECURSIVE {_LINEAGE},
layers AS (
    SELECT app_id, stage_id, 1 AS depth FROM ordered WHERE o = 1
    UNION
    SELECT e.app_id, e.child, l.depth + 1
    FROM layers l JOIN edges e ON e.app_id = l.app_id AND e.parent = l.stage_id
)
SELECT s.app_id, count(*) AS total_stages,
       count(*) FILTER (NOT EXISTS (SELECT 1 FROM edges e
                                    WHERE e.app_id = s.app_id AND e.child = s.stage_id))
           AS root_stages,
       count(*) FILTER (NOT EXISTS (SELECT 1 FROM edges e
                                    WHERE e.app_id = s.app_id AND e.parent = s.stage_id))
           AS leaf_stages,
       max(d.depth) AS depth, true AS is_acyclic
FROM stages s JOIN (SELECT app_id, stage_id, max(depth) AS depth FROM layers GROUP BY ALL) d
     USING (app_id, stage_id)
GROUP BY s.app_id"""


def _reachable(pick: str, source: str, target: str, name: str) -> str:
    return f"""WITH RECURSIVE {_LINEAGE},
seeds AS (SELECT app_id, {pick}(stage_id) AS seed FROM stages GROUP BY app_id),
walk AS (
    SELECT app_id, seed, seed AS stage_id FROM seeds
    UNION
    SELECT e.app_id, w.seed, e.{target} FROM walk w
    JOIN edges e ON e.app_id = w.app_id AND e.{source} = w.stage_id
)
SELECT app_id, seed AS seed_stage_id, stage_id AS {name} FROM walk WHERE stage_id <> seed"""


ORACLES["lineage_ancestors"] = _reachable("max", "child", "parent", "ancestor_stage_id")
ORACLES["lineage_descendants"] = _reachable("min", "parent", "child", "descendant_stage_id")

# ---------------------------------------------------------------- features

_FEATURES = f"""{STAGES}, {TASKS},
timed AS (
    SELECT *, CASE WHEN duration_ms > 0 THEN duration_ms ELSE executor_run_time END AS d
    FROM tasks
),
t AS (
    SELECT app_id, min(label) AS label, avg(d) AS mean_d, stddev_samp(d) AS std_d,
           var_samp(d) AS var_d, min(d) AS min_d, max(d) AS max_d,
           sum(memory_bytes_spilled)::DOUBLE AS mem, sum(disk_bytes_spilled)::DOUBLE AS disk,
           sum(shuffle_bytes_read)::DOUBLE AS sread, sum(shuffle_bytes_written)::DOUBLE AS swrite,
           sum(jvm_gc_time)::DOUBLE AS gc, avg(peak_execution_memory) AS avg_peak,
           max(peak_execution_memory) AS max_peak, sum(executor_run_time)::DOUBLE AS run,
           sum(input_bytes_read)::DOUBLE AS input, count(*) FILTER (NOT success) AS failed,
           count(*) AS total, count(*) FILTER (task_attempt > 0) AS retries
    FROM timed GROUP BY app_id
),
s AS (
    SELECT app_id, count(*) AS stages, count(*) FILTER (status = 'FAILED') AS failed_stages,
           count(*) FILTER (status = 'COMPLETED') AS completed, max(num_tasks) AS parallelism
    FROM stages GROUP BY app_id
),
features AS (
    SELECT t.app_id, t.label,
           mean_d AS mean_task_duration, coalesce(std_d, 0) AS std_task_duration,
           max_d::DOUBLE AS max_task_duration,
           mem AS total_memory_spilled, disk AS total_disk_spilled,
           sread AS total_shuffle_read, swrite AS total_shuffle_write, gc AS total_gc_time,
           coalesce(stages, 0)::DOUBLE AS total_stages,
           coalesce(failed_stages, 0)::DOUBLE AS failed_stages,
           coalesce(parallelism, 0)::DOUBLE AS max_stage_parallelism,
           coalesce(completed, 0)::DOUBLE AS stage_depth_of_failure,
           CASE WHEN stages > 0 THEN completed::DOUBLE / stages ELSE 0 END
               AS completed_stage_ratio,
           CASE WHEN stages > 0 THEN failed_stages::DOUBLE / stages ELSE 0 END
               AS failed_stage_ratio,
           CASE WHEN stages > 0 THEN (mem + disk) / stages ELSE 0 END AS spill_per_stage,
           CASE WHEN stages > 0 THEN gc / stages ELSE 0 END AS gc_per_stage,
           CASE WHEN mean_d > 0 THEN max_d / mean_d ELSE 1 END AS skew_index,
           coalesce(var_d, 0) AS duration_variance,
           CASE WHEN min_d > 0 THEN max_d::DOUBLE / min_d ELSE 1 END AS max_min_duration_ratio,
           CASE WHEN input > 0 THEN mem / input ELSE 0 END AS spill_ratio,
           CASE WHEN input > 0 THEN disk / input ELSE 0 END AS disk_spill_ratio,
           CASE WHEN avg_peak > 0 THEN max_peak / avg_peak ELSE 1 END AS peak_memory_ratio,
           CASE WHEN run > 0 THEN gc / run ELSE 0 END AS gc_time_ratio,
           CASE WHEN total > 0 THEN failed::DOUBLE / total ELSE 0 END AS task_failure_rate,
           retries::DOUBLE AS retry_count
    FROM t LEFT JOIN s USING (app_id)
)"""

_FEATURE_NAMES = FEATURE_COLUMNS


def _round(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0::DOUBLE AS {name}"


ORACLES["app_features"] = f"""WITH {_FEATURES}
SELECT app_id, label, {", ".join(_round(c, c) for c in _FEATURE_NAMES)} FROM features"""

ORACLES["app_features_joined_labels"] = f"""WITH {_FEATURES},
known AS (
    SELECT DISTINCT 'app_' || user_id AS app_id, CAST((user_id + 1) % 7 AS INTEGER) AS label
    FROM events WHERE user_id % 2 = 0
)
SELECT app_id, known.label, {", ".join(_round(c, c) for c in _FEATURE_NAMES)}
FROM features JOIN known USING (app_id)"""

ORACLES["feature_stats"] = f"WITH {_FEATURES} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count({c}) AS count, {_round(f"avg({c})", "mean", 3)},
        {_round(f"stddev_samp({c})", "stddev", 3)}, {_round(f"min({c})", "min", 3)},
        {_round(f"max({c})", "max", 3)} FROM features"""
    for c in _FEATURE_NAMES
)

ORACLES["scaled_features"] = f"""WITH {_FEATURES}
SELECT app_id, label, {", ".join(
    _round(f"CASE WHEN stddev_samp({c}) OVER () > 0 "
           f"THEN ({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () ELSE 0 END", c)
    for c in _FEATURE_NAMES)} FROM features"""

_TRUTH_NAME = """
CASE label WHEN 0 THEN 'Baseline' WHEN 1 THEN 'OOM' WHEN 2 THEN 'Data Skew'
    WHEN 3 THEN 'Serialization Failure' WHEN 4 THEN 'Network Failure'
    WHEN 5 THEN 'Disk Spill Overload' WHEN 6 THEN 'Metadata Failure' ELSE 'Unknown' END
"""

ORACLES["ground_truth"] = f"WITH {APPS} SELECT app_id, label, {_TRUTH_NAME} AS label_name FROM apps"

ORACLES["label_distribution"] = f"""WITH {APPS}
SELECT label, {_TRUTH_NAME} AS label_name, count(*) AS count FROM apps GROUP BY label"""

# ---------------------------------------------------------------- event logs

# What parsing must give back: broken lines gone, odd fields at their defaults.
_PARSED = f"""{TASKS},
parsed AS (
    SELECT * REPLACE (
        CASE WHEN task_id % 29 = 3 THEN 0 ELSE executor_run_time END AS executor_run_time,
        CASE WHEN task_id % 29 IN (3, 4) THEN 0 ELSE jvm_gc_time END AS jvm_gc_time,
        CASE WHEN task_id % 29 = 3 THEN 0 ELSE memory_bytes_spilled END AS memory_bytes_spilled,
        CASE WHEN task_id % 29 = 3 THEN 0 ELSE disk_bytes_spilled END AS disk_bytes_spilled,
        CASE WHEN task_id % 29 = 3 THEN 0 ELSE peak_execution_memory END AS peak_execution_memory,
        CASE WHEN task_id % 29 = 3 THEN 0 ELSE input_bytes_read END AS input_bytes_read,
        CASE WHEN task_id % 29 = 3 THEN 0 ELSE shuffle_bytes_read END AS shuffle_bytes_read,
        CASE WHEN task_id % 29 = 3 THEN 0 ELSE shuffle_bytes_written END AS shuffle_bytes_written,
        CASE WHEN task_id % 29 = 3 THEN 0 ELSE shuffle_fetch_wait_time END
            AS shuffle_fetch_wait_time)
    FROM tasks WHERE task_id % 23 NOT IN (7, 8)
)"""

ORACLES["parse_task_events"] = f"WITH {_PARSED} SELECT * FROM parsed"

ORACLES["parse_stage_events"] = f"""WITH {ATTEMPTS}
SELECT app_id, label, stage_id, stage_attempt_id, stage_name, num_tasks, submission_time,
       completion_time, status, failure_reason FROM attempts"""

ORACLES["parse_both_kinds"] = f"""WITH {_PARSED}, {ATTEMPTS}
SELECT app_id, label, 'task' AS kind, count(*) AS events,
       CAST(sum(executor_run_time) AS BIGINT) AS run_time, CAST(0 AS BIGINT) AS stage_tasks
FROM parsed GROUP BY app_id, label
UNION ALL
SELECT app_id, label, 'stage', count(*), 0, CAST(sum(num_tasks) AS BIGINT)
FROM attempts GROUP BY app_id, label"""

ORACLES["parse_malformed"] = f"""WITH {_PARSED}
SELECT t.app_id, count(*) AS lines, count(p.task_id) AS parsed,
       count(*) FILTER (p.executor_run_time = 0) AS without_metrics,
       CAST(coalesce(sum(p.jvm_gc_time), 0) AS BIGINT) AS gc_time
FROM tasks t LEFT JOIN parsed p USING (task_id) GROUP BY t.app_id"""

ORACLES["label_from_path"] = """
SELECT 'application_' || user_id AS app_id, CAST(user_id % 8 AS INTEGER) AS label,
       count(*) AS files
FROM events WHERE user_id % 8 < 7 AND event_id % 4 < 3 GROUP BY user_id"""

# ---------------------------------------------------------------- workload

_PRICE = "l_extendedprice"
_REVENUE = "l_extendedprice * (1 - l_discount)"
_QTY = "l_quantity"


def _total(expr: str, name: str, digits: int = 2) -> str:
    return _round(f"sum({expr})", name, digits)


ORACLES["q_shipping_priority"] = f"""
SELECT l_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, {_total(_REVENUE, "revenue", 4)}
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15'
  AND l_shipdate > TIMESTAMP '1998-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 100"""

ORACLES["q_order_priority"] = """
SELECT o_orderpriority, count(*) AS order_count
FROM orders JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
     ON o_orderkey = l_orderkey
WHERE o_orderdate >= TIMESTAMP '1996-07-01' AND o_orderdate < TIMESTAMP '1996-10-01'
GROUP BY o_orderpriority"""

_RETURNED = """
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP '1996-10-01' AND o_orderdate < TIMESTAMP '1997-01-01'
  AND l_returnflag = 'R'"""

ORACLES["q_returned_items"] = f"""
SELECT c_custkey, c_name, c_acctbal, n_name, {_total(_REVENUE, "revenue", 4)} {_RETURNED}
GROUP BY c_custkey, c_name, c_acctbal, n_name
ORDER BY revenue DESC, c_custkey, c_name, c_acctbal, n_name LIMIT 50"""

ORACLES["q_returned_items_top20"] = f"""
SELECT c_custkey, c_name, {_total(_REVENUE, "revenue", 4)}, lower(c_name) AS c_name_mod {_RETURNED}
GROUP BY c_custkey, c_name ORDER BY revenue DESC, c_custkey, c_name LIMIT 20"""

ORACLES["q_ship_mode"] = """
SELECT l_returnflag,
       count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS high_line_count,
       count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS low_line_count
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_returnflag IN ('R', 'A') AND l_shipdate >= TIMESTAMP '1996-01-01'
  AND l_shipdate < TIMESTAMP '1997-01-01' AND l_shipdate > o_orderdate
GROUP BY l_returnflag"""

_PRICING = f"""
SELECT l_returnflag, l_linestatus, {_total(_QTY, "sum_qty")}, {_total(_PRICE, "sum_base_price")},
       {_total(_REVENUE, "sum_disc_price", 4)},
       {_total(f"{_REVENUE} * (1 + l_tax)", "sum_charge", 3)},
       %s count(*) AS count_order
FROM %s WHERE l_shipdate <= TIMESTAMP '%s' GROUP BY l_returnflag, l_linestatus"""

ORACLES["q_pricing_summary"] = _PRICING % (
    _total(f"{_QTY} * 2", "sum_slow_qty") + ",",
    "lineitem",
    "1998-09-02",
)

ORACLES["q_broadcast_part_profit"] = f"""
SELECT n_name, {_total(_PRICE, "total")}
FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON l_suppkey = s_suppkey
JOIN orders ON l_orderkey = o_orderkey JOIN nation ON s_nationkey = n_nationkey
WHERE contains(p_name, 'red') GROUP BY n_name"""

ORACLES["q_broadcast_orders"] = f"""
SELECT n_name, {_total(_PRICE, "total_price")}
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name"""

_PARTSUPP = """
partsupp AS (
    SELECT DISTINCT p_partkey AS ps_partkey,
           (p_partkey + i * (s // 4 + p_partkey // s)) % s AS ps_suppkey
    FROM part, range(4) t(i), (SELECT count(*) AS s FROM supplier)
)"""

ORACLES["q_broadcast_partsupp"] = f"""WITH {_PARTSUPP}
SELECT o_orderstatus, count(*) AS cnt
FROM lineitem JOIN partsupp ON l_partkey = ps_partkey AND l_suppkey = ps_suppkey
JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderstatus"""

_SKEWED = """
skewed AS (
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
           l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem
    UNION ALL
    SELECT 1, 1, 1, 1, 50.0, 1000.0, 0.05, 0.08, 'N', 'O', TIMESTAMP '2024-01-01' FROM orders
)"""


def _large_volume(lines: str, threshold: int) -> str:
    return f"""
SELECT c_name, c_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
       o_totalprice, {_total("x.l_quantity", "sum_qty")}
FROM customer JOIN orders ON c_custkey = o_custkey
JOIN (SELECT l_orderkey FROM {lines} GROUP BY l_orderkey
      HAVING sum(l_quantity) > {threshold}) big
     ON o_orderkey = big.l_orderkey
JOIN {lines} x ON o_orderkey = x.l_orderkey
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice
ORDER BY o_totalprice DESC, o_orderdate, o_orderkey, c_custkey LIMIT 100"""


ORACLES["q_large_volume"] = _large_volume("lineitem", 200)
ORACLES["q_large_volume_skewed"] = f"WITH {_SKEWED} {_large_volume('skewed', 300)}"
ORACLES["union_synthetic_rows"] = f"WITH {_SKEWED} " + _PRICING % ("", "skewed", "2024-12-31")

ORACLES["join_key_skew"] = f"""WITH {_SKEWED},
per_key AS (SELECT l_orderkey, count(*) AS n FROM skewed GROUP BY l_orderkey)
SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS distinct_keys, max(n) AS hottest_rows,
       {_round("max(n) / CAST(sum(n) AS DOUBLE)", "hottest_share", 9)}
FROM per_key"""

ORACLES["q_hot_key_join"] = f"""WITH {_SKEWED}
SELECT o_orderpriority, count(*) AS line_count, {_total(_QTY, "total_qty")},
       count(DISTINCT o_orderkey) AS order_count
FROM skewed JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority"""

ORACLES["q_heavy_segment_priority"] = f"""
SELECT c_mktsegment, o_orderpriority, {_total(_PRICE, "total_price")}, {_total(_QTY, "total_qty")},
       {_round("avg(l_discount)", "avg_disc", 9)},
       {_total("l_tax", "total_tax")}
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
GROUP BY c_mktsegment, o_orderpriority
ORDER BY total_price DESC, c_mktsegment, o_orderpriority LIMIT 200"""

ORACLES["q_heavy_nation_status"] = f"""
SELECT n_name, o_orderstatus, {_total(_REVENUE, "revenue", 4)}, count(*) AS cnt
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey
GROUP BY n_name, o_orderstatus ORDER BY revenue DESC, n_name, o_orderstatus LIMIT 100"""

_CUSTOMER_LINES = """
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey"""

ORACLES["q_heavy_customer_spend"] = f"""
SELECT c_custkey, c_name, c_mktsegment, {_total(_PRICE, "total_spent")}, count(*) AS line_count,
       {_total(_QTY, "total_qty")} {_CUSTOMER_LINES}
GROUP BY c_custkey, c_name, c_mktsegment ORDER BY total_spent DESC, c_custkey LIMIT 150"""

ORACLES["q_customer_totals"] = f"""
SELECT c_name, c_custkey, {_total(_PRICE, "total_price")}, count(*) AS order_count
{_CUSTOMER_LINES}
GROUP BY c_name, c_custkey ORDER BY total_price DESC, c_custkey LIMIT 100"""

ORACLES["q_customer_supplier"] = f"""
SELECT c_name, s_name, {_total(_PRICE, "total_price")} {_CUSTOMER_LINES}
JOIN supplier ON l_suppkey = s_suppkey
GROUP BY c_name, s_name ORDER BY total_price DESC, c_name, s_name LIMIT 50"""

ORACLES["q_min_cost_supplier"] = f"""WITH {_PARTSUPP}
SELECT s_acctbal, s_name, n_name, p_partkey, upper(s_name) AS s_name_upper
FROM part JOIN partsupp ON p_partkey = ps_partkey JOIN supplier ON ps_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE p_size = 15 AND p_type LIKE '%O' AND r_name = 'EUROPE'
ORDER BY s_acctbal DESC, s_name, n_name, p_partkey LIMIT 100"""

ORACLES["range_category_agg"] = f"""
SELECT CAST(o_orderkey % 7 AS VARCHAR) AS category, {_total("o_totalprice", "total")}
FROM orders GROUP BY 1"""

ORACLES["cross_join_summary"] = f"""
SELECT count(*) AS total_rows,
       {_round("sum(CAST(a.o_totalprice AS DECIMAL(12,2))) / 1e6", "total_price", 4)}
FROM orders a CROSS JOIN orders b"""

ORACLES["cross_join_pairs"] = f"""
SELECT count(*) AS total_rows,
       {_round("sum(CAST(l_extendedprice AS DECIMAL(12,2))) / 1e6", "total_price", 4)}
FROM lineitem CROSS JOIN customer"""

# ---------------------------------------------------------------- manifest, lookups

ORACLES["pending_runs"] = """
SELECT o_orderpriority AS failure_type, CAST(o_orderkey AS VARCHAR) AS run_id
FROM orders WHERE o_orderstatus NOT IN ('F', 'O')"""

ORACLES["run_summary"] = """
SELECT o_orderpriority AS failure_type, count(*) AS total_runs,
       count(*) FILTER (o_orderstatus = 'F') AS finished,
       count(*) FILTER (o_orderstatus = 'O') AS failed,
       count(*) FILTER (o_orderstatus = 'P' AND o_orderkey % 2 = 0) AS timed_out,
       count(*) FILTER (o_orderstatus = 'P' AND o_orderkey % 2 <> 0) AS errors
FROM orders GROUP BY o_orderpriority"""

_SCENARIOS = "scenarios (label, asked_name, name, tpch_query, injection_method) AS (VALUES "
_SCENARIOS += ", ".join(
    f"({x.label}, '{x.name.capitalize()}', '{x.name}', '{x.tpch_query}', '{x.injection_method}')"
    for x in SCENARIOS
)
_SCENARIOS += ")"

ORACLES["scenario_lookup"] = f"""WITH {APPS}, {_SCENARIOS}
SELECT app_id, CAST(label AS INTEGER) AS label, asked_name, name, tpch_query, injection_method
FROM apps JOIN scenarios USING (label)"""

ORACLES["scenario_names"] = f"""WITH {_SCENARIOS}
SELECT l_linenumber AS label, coalesce(max(name), 'UNKNOWN(' || l_linenumber || ')') AS label_name,
       count(*) AS lines
FROM lineitem LEFT JOIN scenarios ON label = l_linenumber GROUP BY l_linenumber"""


def _size(n: str) -> str:
    """Size text by whole numbers: hundredths of a unit, halves rounded up."""

    def unit(step: int, name: str) -> str:
        cents = f"(({n} * 200 + {step}) // {2 * step})"
        return f"""CAST({cents} // 100 AS VARCHAR) || '.'
                   || lpad(CAST({cents} % 100 AS VARCHAR), 2, '0') || ' {name}'"""

    return f"""CASE WHEN {n} < {1024} THEN CAST({n} AS VARCHAR) || ' B'
    WHEN {n} < {1024**2} THEN {unit(1024, "KB")} WHEN {n} < {1024**3} THEN {unit(1024**2, "MB")}
    ELSE {unit(1024**3, "GB")} END"""


ORACLES["format_bytes"] = f"""WITH {TASKS},
totals AS (
    SELECT app_id, CAST(sum(shuffle_fetch_wait_time) AS BIGINT) AS wait,
           CAST(sum(shuffle_bytes_read) AS BIGINT) AS read,
           CAST(sum(memory_bytes_spilled) AS BIGINT) AS spilled,
           CAST(sum(peak_execution_memory) AS BIGINT) AS peak
    FROM tasks GROUP BY app_id
)
SELECT app_id, {", ".join(f"{_size(c)} AS {c}_text" for c in ("wait", "read", "spilled", "peak"))}
FROM totals"""

ORACLES["table_summary"] = (
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, true AS found, count(*) AS row_count FROM {t}"
        for t in ("customer", "lineitem", "nation", "orders", "part", "region", "supplier")
    )
    + " UNION ALL SELECT 'partsupp', false, NULL"
)

# ---------------------------------------------------------------- evaluation

_PREDICTIONS = f"""{APPS},
predictions AS (
    SELECT app_id, label,
           CASE WHEN CAST(substring(app_id, 5) AS BIGINT) % 5 <> 0 THEN label
                ELSE (label + 1) % 7 END AS prediction
    FROM apps
)"""

_CLASS_NAME = """
CASE {0} WHEN 0 THEN 'Baseline' WHEN 1 THEN 'OOM' WHEN 2 THEN 'Data Skew'
    WHEN 3 THEN 'Serialization Failure' WHEN 4 THEN 'Network Timeout'
    WHEN 5 THEN 'Disk Space Failure' WHEN 6 THEN 'Metadata Failure' ELSE 'Unknown' END
"""

ORACLES["confusion_matrix"] = f"""WITH {_PREDICTIONS}
SELECT label, {", ".join(f"count(*) FILTER (prediction = {c}) AS pred_{c}" for c in range(7))}
FROM predictions GROUP BY label"""

ORACLES["per_class_accuracy"] = f"""WITH {_PREDICTIONS}
SELECT label, {_CLASS_NAME.format("label")} AS label_name,
       count(*) FILTER (prediction = label) AS correct, count(*) AS total,
       {_round("count(*) FILTER (prediction = label) / count(*)::DOUBLE", "accuracy")}
FROM predictions GROUP BY label"""

ORACLES["eval_metrics"] = f"""WITH {_PREDICTIONS},
classes AS (
    SELECT c.label AS class, c.n,
           (SELECT count(*) FROM predictions p WHERE p.prediction = c.label) AS predicted,
           (SELECT count(*) FROM predictions p
            WHERE p.label = c.label AND p.prediction = c.label) AS hits
    FROM (SELECT label, count(*) AS n FROM predictions GROUP BY label) c
),
scored AS (
    SELECT n, hits, hits / n::DOUBLE AS r,
           CASE WHEN predicted > 0 THEN hits / predicted::DOUBLE ELSE 0 END AS p FROM classes
)
SELECT {_round("sum(hits) / sum(n)::DOUBLE", "accuracy")},
       {_round("sum(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END * n) / sum(n)", "f1")},
       {_round("sum(p * n) / sum(n)", "precision")}, {_round("sum(r * n) / sum(n)", "recall")}
FROM scored"""

ORACLES["prediction_table"] = f"""WITH {_PREDICTIONS}
SELECT app_id, label, CAST(prediction AS INTEGER) AS predicted_label,
       {_CLASS_NAME.format("label")} AS label_name,
       {_CLASS_NAME.format("prediction")} AS predicted_name,
       CASE WHEN label = prediction THEN '✓' ELSE '✗' END AS correct
FROM predictions"""

ORACLES["stratified_split"] = f"""WITH {APPS}
SELECT app_id, label,
       row_number() OVER (PARTITION BY label ORDER BY md5(app_id))
           <= ceil(0.8 * count(*) OVER (PARTITION BY label)) AS is_train
FROM apps"""

# What any fitted models must give: each test row scored by each model, with
# probabilities that sum to 1, and importances of all features that sum to 1.
ORACLES["ml_scored_rows"] = f"""WITH split AS ({ORACLES["stratified_split"]}),
models (model) AS (VALUES ('Random Forest'), ('Decision Tree'), ('Logistic Regression'))
SELECT model, label, count(*) AS rows, CAST(count(*) AS DOUBLE) AS probability_sum
FROM split, models WHERE NOT is_train GROUP BY model, label"""

ORACLES["ml_cross_validation_folds"] = f"""WITH {APPS}
SELECT CAST(CAST('0x' || substr(md5(app_id), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold, label,
       count(*) AS rows, true AS f1_agrees
FROM apps GROUP BY fold, label"""

ORACLES["ml_importance_total"] = f"""WITH {_FEATURES}
SELECT count(DISTINCT name) AS features, count(DISTINCT name) / 25.0::DOUBLE AS importance
FROM (SELECT unnest([{", ".join(f"'{c}'" for c in _FEATURE_NAMES)}]) AS name
      FROM (SELECT * FROM features LIMIT 1))"""

# What the audits of the fitted models must give: counts and impurity of the training rows, nothing
# that differs, and the settings as they were given.
_TRAIN = f"""train AS (
    SELECT label FROM ({ORACLES["stratified_split"]}) WHERE is_train
)"""

ORACLES["ml_tree_audit"] = f"""WITH {_TRAIN},
classes AS (SELECT count(*) AS n, sum(count(*)) OVER () AS total FROM train GROUP BY label)
SELECT sum(n)::BIGINT AS root_rows, sum(n)::BIGINT AS leaf_rows,
       {_round("-sum(n / total * log2(n / total))", "root_impurity")},
       0::BIGINT AS wrong_nodes, 1::BIGINT AS leaves_beyond_splits
FROM classes"""

ORACLES["ml_importance_of_nodes"] = f"""SELECT unnest([
    {", ".join(f"'{c}'" for c in _FEATURE_NAMES)}]) AS feature, true AS agrees"""

ORACLES["ml_logistic_slope"] = f"""WITH {_TRAIN}
SELECT label, count(*) AS rows, true AS flat FROM train GROUP BY label"""

ORACLES["ml_saved_parameters"] = """
SELECT * FROM (VALUES
    ('Decision Tree', 'maxDepth', '5'), ('Decision Tree', 'maxBins', '32'),
    ('Decision Tree', 'impurity', 'entropy'), ('Decision Tree', 'seed', '42'),
    ('Logistic Regression', 'maxIter', '100'), ('Logistic Regression', 'family', 'multinomial'),
    ('Logistic Regression', 'elasticNetParam', '0.0'), ('Logistic Regression', 'regParam', '0.01')
) AS settings (model, parameter, value)"""
