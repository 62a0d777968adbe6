"""Stage graphs of all applications at once, as node and edge tables.

In a chain graph each stage depends on the next-lower stage id of its
application. One application may own a large share of all stages, so no window
here spans a whole application: stage ids are cut into chunks of `CHUNK` ids,
the first window works inside a chunk, and the second sees only the two border
stages of each chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultweave.functions.scalars import join_ids

CHUNK = 4096

# Stage states and the words that mark a logical abort.
FAILED = "FAILED"
COMPLETED = "COMPLETED"
SKIPPED = "SKIPPED"
UNKNOWN = "UNKNOWN"
ABORT_WORDS = ("cancelled", "aborted")
STRICT_ABORT_WORDS = ("cancelled",)
STATUS_ICONS = {"COMPLETED": "✓", "FAILED": "✗", "SKIPPED": "○"}

NO_PARENT = -1


def chunk_of(stage_id: Column, chunk: int = CHUNK) -> Column:
    return F.floor(stage_id / F.lit(chunk)).cast("int")


def is_logical_abort(status: Column, reason: Column, strict: bool = False) -> Column:
    """Skipped, or failed only because something else cancelled or aborted it.

    Spark's own failure text starts with "Job aborted", so real failures match
    too; `strict` keeps to "cancelled".
    """
    text = F.lower(F.coalesce(reason, F.lit("")))
    hit = status == SKIPPED
    for word in STRICT_ABORT_WORDS if strict else ABORT_WORDS:
        hit = hit | text.contains(word)
    return hit


def stage_nodes(stages: DataFrame) -> DataFrame:
    """One row per (app_id, stage_id): the latest attempt.

    A plain aggregate, so attempts are merged before the shuffle.
    """
    extra = ["parent_ids"] if "parent_ids" in stages.columns else []
    kept = ["stage_attempt_id", "completion_time", "stage_name", "status", "failure_reason"]
    latest = stages.groupBy("app_id", "stage_id").agg(F.max(F.struct(*kept, *extra)).alias("last"))
    return latest.select(
        "app_id",
        "stage_id",
        F.coalesce("last.stage_name", F.lit("")).alias("stage_name"),
        F.coalesce("last.status", F.lit(UNKNOWN)).alias("status"),
        "last.failure_reason",
        *[f"last.{c}" for c in extra],
    )


def chain_links(nodes: DataFrame, carry: list[str] = (), chunk: int = CHUNK) -> DataFrame:
    """Add `prev` and `next`: structs of (stage_id, *carry) of the chain neighbours.

    NULL at the two ends of an application.
    """
    here = F.struct("stage_id", *carry)
    inside = Window.partitionBy("app_id", "_chunk").orderBy("stage_id")
    linked = nodes.withColumn("_chunk", chunk_of(F.col("stage_id"), chunk)).withColumns(
        {"prev": F.lag(here).over(inside), "next": F.lead(here).over(inside)}
    )
    border = F.col("prev").isNull() | F.col("next").isNull()
    across = Window.partitionBy("app_id").orderBy("stage_id")
    joined = linked.filter(border).withColumns(
        {
            "prev": F.coalesce("prev", F.lag(here).over(across)),
            "next": F.coalesce("next", F.lead(here).over(across)),
        }
    )
    return linked.filter(~border).unionByName(joined).drop("_chunk")


def chain_edges(nodes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Edge table with one row per stage; the first stage has parent -1."""
    return chain_links(nodes, chunk=chunk).select(
        "app_id",
        "stage_id",
        F.coalesce("prev.stage_id", F.lit(NO_PARENT)).alias("parent_stage_id"),
        "stage_name",
        "status",
    )


def inner_edges(edges: DataFrame) -> DataFrame:
    """Parent-child pairs only."""
    return edges.filter(F.col("parent_stage_id") != NO_PARENT).select(
        "app_id", "parent_stage_id", F.col("stage_id").alias("child_stage_id")
    )


def chain_shape(nodes: DataFrame) -> DataFrame:
    """Per application: stage count, root and leaf stage, depth, acyclicity.

    A chain is acyclic and as deep as it has stages.
    """
    return nodes.groupBy("app_id").agg(
        F.count("*").alias("total_stages"),
        F.min("stage_id").alias("root_stage_id"),
        F.max("stage_id").alias("leaf_stage_id"),
        F.count("*").alias("depth"),
        F.lit(True).alias("is_acyclic"),
    )


def _ids_or_none(ids: Column) -> Column:
    return F.when(F.size(ids) > 0, join_ids(ids)).otherwise(F.lit("none"))


def status_icon(status: Column) -> Column:
    icon = F
    for name, mark in STATUS_ICONS.items():
        icon = icon.when(status == name, mark)
    return icon.otherwise("?")


def chain_listing(nodes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One line per stage: icon, status, parents, children, reason and its start for display."""
    return chain_links(nodes, chunk=chunk).select(
        "app_id",
        "stage_id",
        status_icon(F.col("status")).alias("icon"),
        "status",
        _ids_or_none(F.array_compact(F.array("prev.stage_id"))).alias("parents"),
        _ids_or_none(F.array_compact(F.array("next.stage_id"))).alias("children"),
        "failure_reason",
        F.substring("failure_reason", 1, 50).alias("reason_start"),
    )


def parents_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each stage with the full row of each of its parents."""
    parent = nodes.select(
        F.col("app_id").alias("p_app"),
        F.col("stage_id").alias("p_id"),
        F.col("stage_name").alias("parent_name"),
        F.col("status").alias("parent_status"),
    )
    match = (F.col("app_id") == F.col("p_app")) & (F.col("parent_stage_id") == F.col("p_id"))
    return (
        inner_edges(edges)
        .join(parent, match)
        .select("app_id", "child_stage_id", "parent_stage_id", "parent_name", "parent_status")
    )


def children_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each stage with the full row of each of its children."""
    child = nodes.select(
        F.col("app_id").alias("c_app"),
        F.col("stage_id").alias("c_id"),
        F.col("stage_name").alias("child_name"),
        F.col("status").alias("child_status"),
    )
    match = (F.col("app_id") == F.col("c_app")) & (F.col("child_stage_id") == F.col("c_id"))
    return (
        inner_edges(edges)
        .join(child, match)
        .select("app_id", "parent_stage_id", "child_stage_id", "child_name", "child_status")
    )


def stages_between(
    nodes: DataFrame, ranges: DataFrame, first: str, last: str, chunk: int = CHUNK
) -> DataFrame:
    """Stages whose id lies in the `[first, last]` of a range row of their application.

    Ranges are spread over the chunks they touch and joined on (app_id, chunk),
    so a large application is split over as many keys as it has chunks.
    """
    low, high = chunk_of(F.col(first), chunk), chunk_of(F.col(last), chunk)
    spread = ranges.filter(F.col(first) <= F.col(last)).withColumn(
        "_chunk", F.explode(F.sequence(low, high))
    )
    keyed = nodes.withColumn("_chunk", chunk_of(F.col("stage_id"), chunk))
    inside = F.col("stage_id").between(F.col(first), F.col(last))
    return keyed.join(spread, ["app_id", "_chunk"]).filter(inside)


def chain_ancestors(
    nodes: DataFrame, seeds: DataFrame, shape: DataFrame, chunk: int = CHUNK
) -> DataFrame:
    """All stages upstream of each seed (app_id, seed_stage_id)."""
    ranges = seeds.join(shape.select("app_id", "root_stage_id"), "app_id").select(
        "app_id",
        "seed_stage_id",
        F.col("root_stage_id").alias("_low"),
        (F.col("seed_stage_id") - 1).alias("_high"),
    )
    found = stages_between(nodes.select("app_id", "stage_id"), ranges, "_low", "_high", chunk)
    return found.select("app_id", "seed_stage_id", F.col("stage_id").alias("ancestor_stage_id"))


def chain_descendants(
    nodes: DataFrame, seeds: DataFrame, shape: DataFrame, chunk: int = CHUNK
) -> DataFrame:
    """All stages downstream of each seed (app_id, seed_stage_id)."""
    ranges = seeds.join(shape.select("app_id", "leaf_stage_id"), "app_id").select(
        "app_id",
        "seed_stage_id",
        (F.col("seed_stage_id") + 1).alias("_low"),
        F.col("leaf_stage_id").alias("_high"),
    )
    found = stages_between(nodes.select("app_id", "stage_id"), ranges, "_low", "_high", chunk)
    return found.select("app_id", "seed_stage_id", F.col("stage_id").alias("descendant_stage_id"))
