"""Root cause of each application on chain graphs.

Walking upstream from the last failed stage, the walk goes on while the parent
failed in its own right. On a chain this has a closed form: a failed stage
*starts* a failure when its parent did not fail or was a logical abort, and the
root cause is the most downstream start. The path is every stage from there to
the last failed stage; all but the first are victims.

Three shuffles find it for all applications, and none needs the stages of a
whole application in one task: stages are first judged inside chunks of stage
ids, each chunk is summed up in one row of fixed size, and only those rows meet
per application. The stages of a path are then picked chunk by chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultweave.functions.scalars import clamp, join_ids
from faultweave.operators.graph import CHUNK, COMPLETED, FAILED, chunk_of, is_logical_abort

NO_FAILURE = "NO_FAILURE"
UNKNOWN_REASON = "Unknown"

# Confidence in hundredths.
BASE = 50
CLEAR_REASON = 20
CLEAR_REASON_LENGTH = 10
SINGLE_PARENT_PATH = 15
CLEAN_PARENTS = 15
EXTRA_ROOT = 10

REASON_PREFIX = 30


def confidence(
    reason: Column, single_parents: Column, clean_parents: Column, candidates: Column
) -> Column:
    """Score in [0, 1]; whole hundredths until the last step, so sums are exact."""
    clear = F.length(F.coalesce(reason, F.lit(""))) > CLEAR_REASON_LENGTH
    points = (
        F.lit(BASE)
        + F.when(clear, CLEAR_REASON).otherwise(0)
        + F.when(single_parents, SINGLE_PARENT_PATH).otherwise(0)
        + F.when(clean_parents, CLEAN_PARENTS).otherwise(0)
        - F.lit(EXTRA_ROOT) * F.greatest(candidates - 1, F.lit(0))
    )
    return clamp(points, 0, 100) / F.lit(100.0)


def _starts(failed: Column, parent: str) -> Column:
    """A failed stage whose parent did not fail in its own right."""
    return failed & ~(_is(parent, "failed") & ~_is(parent, "abort"))


def _is(stage: str, flag: str) -> Column:
    return F.coalesce(f"{stage}.{flag}", F.lit(False))


def _clean(parent: str) -> Column:
    return F.coalesce(f"{parent}.completed", F.lit(True)).alias("clean")


def _flagged_stages(nodes: DataFrame, strict_abort: bool, chunk: int) -> DataFrame:
    reason = F.col("failure_reason")
    return nodes.select(
        "app_id",
        "stage_id",
        "stage_name",
        "failure_reason",
        chunk_of(F.col("stage_id"), chunk).alias("chunk"),
        (F.col("status") == FAILED).alias("failed"),
        (F.col("status") == COMPLETED).alias("completed"),
        is_logical_abort(F.col("status"), reason, strict_abort).alias("abort"),
    )


def _chunk_summaries(nodes: DataFrame, strict_abort: bool, chunk: int) -> DataFrame:
    """One row per (app_id, chunk); the parent of its first stage is still unknown."""
    in_chunk = Window.partitionBy("app_id", "chunk")
    linked = _flagged_stages(nodes, strict_abort, chunk).withColumn(
        "parent",
        F.lag(F.struct("failed", "completed", "abort")).over(in_chunk.orderBy("stage_id")),
    )
    failed, known = F.col("failed"), F.col("parent").isNotNull()
    start = known & _starts(failed, "parent")
    from_start = F.max(F.when(start, F.col("stage_id"))).over(in_chunk)
    root = F.struct("stage_id", "stage_name", "failure_reason", _clean("parent"))
    return (
        linked.withColumn("from_start", failed & (F.col("stage_id") >= from_start))
        .groupBy("app_id", "chunk")
        .agg(
            F.min(F.struct("stage_id", "stage_name", "failure_reason", "failed")).alias("first"),
            F.max(F.struct("stage_id", "stage_name", "failed", "completed", "abort")).alias("last"),
            F.max(F.when(start, root)).alias("root"),
            F.count_if(known & failed & ~_is("parent", "failed")).alias("candidates"),
            F.max(F.when(failed, F.col("stage_id"))).alias("terminal"),
            F.count_if("failed").alias("n_failed"),
            F.count_if("from_start").alias("n_from_start"),
        )
    )


def _resolved_chunks(nodes: DataFrame, strict_abort: bool, chunk: int) -> DataFrame:
    """Chunk rows with the application's root and leaf, and how many of their stages the path
    has."""
    by_app = Window.partitionBy("app_id")
    first = F.col("first")
    head = F.when(
        _starts(first["failed"], "before"),
        F.struct(
            first["stage_id"].alias("stage_id"),
            first["stage_name"].alias("stage_name"),
            first["failure_reason"].alias("failure_reason"),
            _clean("before"),
        ),
    )
    joined = _chunk_summaries(nodes, strict_abort, chunk).withColumn(
        "before", F.lag("last").over(by_app.orderBy("chunk"))
    )
    extra_candidate = first["failed"] & ~_is("before", "failed")
    resolved = joined.select(
        "app_id",
        "chunk",
        F.max(F.coalesce("root", head)).over(by_app).alias("root"),
        F.max(F.struct("last.stage_id", "last.stage_name")).over(by_app).alias("leaf"),
        (F.col("candidates") + extra_candidate.cast("int")).alias("candidates"),
        "terminal",
        F.col("last.stage_id").alias("last_id"),
        F.col("root").isNotNull().alias("starts_inside"),
        "n_failed",
        "n_from_start",
    )
    root_id, root_chunk = F.col("root.stage_id"), chunk_of(F.col("root.stage_id"), chunk)
    in_path = (
        F.when(root_id.isNull(), (F.col("last_id") == F.col("leaf.stage_id")).cast("bigint"))
        .when(F.col("chunk") < root_chunk, 0)
        .when((F.col("chunk") == root_chunk) & F.col("starts_inside"), F.col("n_from_start"))
        .otherwise(F.col("n_failed"))
    )
    return resolved.withColumn("in_path", in_path)


def chain_root_causes(
    nodes: DataFrame, strict_abort: bool = False, chunk: int = CHUNK
) -> DataFrame:
    """One row per application: root cause, last failed stage, path length and confidence.

    Healthy applications get their leaf stage, `NO_FAILURE` and confidence 1. The
    path itself is given by `propagation_path` and `path_text`.
    """
    per_app = (
        _resolved_chunks(nodes, strict_abort, chunk)
        .groupBy("app_id")
        .agg(
            F.max("leaf").alias("leaf"),
            F.max("root").alias("root"),
            F.max("terminal").alias("terminal"),
            F.sum("candidates").alias("candidates"),
            F.sum("in_path").alias("path_length"),
        )
    )
    healthy = F.col("root").isNull()
    score = confidence(
        F.col("root.failure_reason"), F.lit(True), F.col("root.clean"), F.col("candidates")
    )
    return per_app.select(
        "app_id",
        F.coalesce("root.stage_id", "leaf.stage_id").alias("root_cause_stage_id"),
        F.coalesce("root.stage_name", "leaf.stage_name").alias("root_cause_stage_name"),
        F.when(healthy, NO_FAILURE)
        .otherwise(F.coalesce("root.failure_reason", F.lit(UNKNOWN_REASON)))
        .alias("failure_reason"),
        F.coalesce("terminal", "leaf.stage_id").alias("terminal_stage_id"),
        "path_length",
        F.when(healthy, 1.0).otherwise(score).alias("analysis_confidence"),
    )


def propagation_path(
    nodes: DataFrame, strict_abort: bool = False, chunk: int = CHUNK
) -> DataFrame:
    """One row per path stage: (app_id, stage_id, is_victim)."""
    root_id = F.coalesce("root.stage_id", "leaf.stage_id")
    chunks = (
        _resolved_chunks(nodes, strict_abort, chunk)
        .filter("in_path > 0")
        .select("app_id", "chunk", root_id.alias("root_id"), F.col("root").isNull().alias("healthy"))
    )
    stages = _flagged_stages(nodes, strict_abort, chunk).select(
        "app_id", "chunk", "stage_id", "failed"
    )
    of_path = F.when(F.col("healthy"), F.col("stage_id") == F.col("root_id")).otherwise(
        F.col("failed") & (F.col("stage_id") >= F.col("root_id"))
    )
    return (
        stages.join(chunks, ["app_id", "chunk"])
        .filter(of_path)
        .select("app_id", "stage_id", (F.col("stage_id") != F.col("root_id")).alias("is_victim"))
    )


def path_text(path: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Path and victim ids as text, ascending: (app_id, part, propagation_path, victim_stages).

    A part holds the ids of one chunk, so a path of any length comes whole and no
    text is longer than a chunk. `path` is (app_id, stage_id, is_victim).
    """
    victims = F.when(F.col("is_victim"), F.col("stage_id"))
    return path.groupBy("app_id", chunk_of(F.col("stage_id"), chunk).alias("part")).agg(
        join_ids(F.sort_array(F.collect_list("stage_id"))).alias("propagation_path"),
        join_ids(F.sort_array(F.collect_list(victims))).alias("victim_stages"),
    )


def root_cause_summary(causes: DataFrame) -> DataFrame:
    """Applications per failure reason, with the start of the reason for display."""
    start = F.substring("failure_reason", 1, REASON_PREFIX)
    counted = causes.groupBy("failure_reason").agg(F.count("*").alias("occurrences"))
    return counted.withColumn("reason_start", start)
