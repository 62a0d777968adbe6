"""Stage graphs with true parent ids: reachability, shape and root cause.

A stage may have many parents, so no closed form exists. All applications are walked together.
Each stage has one main arc, to the neighbour nearest in id, which follows the long chains that
such graphs are made of. Jumps of 1, 2, 4, ... steps along main arcs are one row a stage, so a
front runs down a whole chain in rounds by the logarithm of its length; then it takes one step
along all arcs. The rounds grow with the times that a walk must leave main arcs, and no step makes
pairs of stages beyond the answer. Each round is kept once computed; the loops run jobs, as they
must know when nothing new is found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultweave.operators.graph import COMPLETED, FAILED, is_logical_abort
from faultweave.operators.rootcause import NO_FAILURE, UNKNOWN_REASON, confidence
from faultweave.operators.sizing import cut_lineage


def lineage_edges(nodes: DataFrame) -> DataFrame:
    """(app_id, child_stage_id, parent_stage_id) for parents that exist."""
    named = nodes.select(
        "app_id",
        F.col("stage_id").alias("child_stage_id"),
        F.explode(F.array_distinct("parent_ids")).alias("parent_stage_id"),
    )
    known = nodes.select("app_id", F.col("stage_id").alias("parent_stage_id"))
    return named.join(known, ["app_id", "parent_stage_id"], "left_semi").select(
        "app_id", "child_stage_id", "parent_stage_id"
    )


def _main(arcs: DataFrame) -> DataFrame:
    """One arc of each source: to the target nearest in id, of two the smaller."""
    near = F.struct(F.abs(F.col("target") - F.col("source")), "target")
    return arcs.groupBy("app_id", "source").agg(F.min_by("target", near).alias("target"))


def _jumps(main: DataFrame, most: int) -> list[DataFrame]:
    """The targets at 1, 2, 4, ... steps of main arcs: (app_id, source, target), until none is left
    or all of them together make `most` steps. Runs jobs."""
    jumps = [cut_lineage(main.select("app_id", "source", "target"))]
    while 2 ** len(jumps) <= most:
        half = jumps[-1]
        onward = half.selectExpr("app_id", "source AS target", "target AS next")
        double = half.join(onward, ["app_id", "target"])
        double = cut_lineage(double.selectExpr("app_id", "source", "next AS target"))
        if double.isEmpty():
            break
        jumps.append(double)
    return jumps


def _most_stages(arcs: DataFrame) -> int:
    """An upper bound of the stages that the arcs of one application touch."""
    sizes = arcs.groupBy("app_id").agg(F.count_distinct("source").alias("n"))
    return (sizes.agg(F.max("n")).first()[0] or 0) + 1


def reach(arcs: DataFrame, seeds: DataFrame) -> DataFrame:
    """Everything reachable from the seeds, the seeds included. Runs jobs.

    `arcs` is (app_id, source, target); `seeds` is (app_id, seed, stage_id), where
    `seed` keeps walks of one application apart. Applications without seeds take no part.
    What a round finds is closed under main arcs, so the next starts from new stages alone.
    """
    keys = ["app_id", "seed", "stage_id"]
    seeds = cut_lineage(seeds.select(*keys).distinct())
    arcs = cut_lineage(arcs.join(seeds.select("app_id"), "app_id", "left_semi"))
    jumps = _jumps(_main(arcs), _most_stages(arcs))
    found, new = None, seeds
    while found is None or not new.isEmpty():
        for jump in jumps:
            new = _along(jump, new, stay=True).distinct()
        if found is not None:
            new = new.join(found, keys, "left_anti")
        new = cut_lineage(new)
        found = new if found is None else cut_lineage(found.unionByName(new))
        new = cut_lineage(_along(arcs, new).distinct().join(found, keys, "left_anti"))
    return found


def _along(arcs: DataFrame, walks: DataFrame, stay: bool = False) -> DataFrame:
    """The ends of the walks after one arc more; with `stay` also where they were."""
    onward = arcs.selectExpr("app_id", "source AS stage_id", "target")
    moved = walks.join(onward, ["app_id", "stage_id"], "left" if stay else "inner")
    ends = "explode(array(stage_id, coalesce(target, stage_id)))" if stay else "target"
    return moved.selectExpr("app_id", "seed", f"{ends} AS stage_id")


def _walk(edges: DataFrame, seeds: DataFrame, source: str, target: str, found: str) -> DataFrame:
    arcs = edges.select("app_id", F.col(source).alias("source"), F.col(target).alias("target"))
    first = seeds.select(
        "app_id", F.col("seed_stage_id").alias("seed"), F.col("seed_stage_id").alias("stage_id")
    )
    away = reach(arcs, first).filter(F.col("stage_id") != F.col("seed"))
    return away.select(
        "app_id", F.col("seed").alias("seed_stage_id"), F.col("stage_id").alias(found)
    )


def lineage_ancestors(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """All stages upstream of each seed (app_id, seed_stage_id). Runs jobs."""
    return _walk(edges, seeds, "child_stage_id", "parent_stage_id", "ancestor_stage_id")


def lineage_descendants(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """All stages downstream of each seed (app_id, seed_stage_id). Runs jobs."""
    return _walk(edges, seeds, "parent_stage_id", "child_stage_id", "descendant_stage_id")


def lineage_shape(nodes: DataFrame) -> DataFrame:
    """Per application: stages, roots, leaves, depth, acyclicity. Runs jobs.

    `depth` counts the stages of the longest walk. It is NULL for a cyclic graph,
    where walks have more steps than there are stages to leave.
    """
    keys = ["app_id", "stage_id"]
    stages = cut_lineage(nodes.select(*keys, "parent_ids"))
    edges = cut_lineage(lineage_edges(stages))
    children = edges.select("app_id", F.col("child_stage_id").alias("stage_id")).distinct()
    parents = edges.select("app_id", F.col("parent_stage_id").alias("stage_id")).distinct()
    roots = stages.select(*keys).join(children, keys, "left_anti")
    leaves = stages.select(*keys).join(parents, keys, "left_anti")
    walks = _longest_walks(
        edges.selectExpr("app_id", "child_stage_id AS source", "parent_stage_id AS target")
    )
    walked = F.coalesce("steps", F.lit(0))
    acyclic = F.coalesce("is_acyclic", F.lit(True))
    return (
        _per_app(stages, "total_stages")
        .join(_per_app(roots, "root_stages"), "app_id", "left")
        .join(_per_app(leaves, "leaf_stages"), "app_id", "left")
        .join(walks, "app_id", "left")
        .select(
            "app_id",
            "total_stages",
            F.coalesce("root_stages", F.lit(0)).alias("root_stages"),
            F.coalesce("leaf_stages", F.lit(0)).alias("leaf_stages"),
            F.when(acyclic, walked + 1).cast("int").alias("depth"),
            acyclic.alias("is_acyclic"),
        )
    )


def _longest_walks(arcs: DataFrame) -> DataFrame:
    """(app_id, steps, is_acyclic) of the applications with arcs. Runs jobs.

    Each stage keeps the steps of the longest walk found from it: max-plus sums along the jumps
    of its main arc, then one step along all arcs. Where that step finds a longer walk, its arc
    becomes the main arc, and the applications concerned go another round. A cycle comes into
    main arcs as soon as walks grow around it, and the jumps then exceed the number of sources,
    which no acyclic walk does.
    """
    keys = ["app_id", "stage_id"]
    arcs = cut_lineage(arcs)
    sources = arcs.groupBy("app_id").agg(F.count_distinct("source").alias("sources"))
    limits = cut_lineage(sources)
    most = (limits.agg(F.max("sources")).first()[0] or 0) + 1
    ends = arcs.selectExpr("app_id", "source AS stage_id").union(arcs.select("app_id", "target"))
    best = cut_lineage(ends.distinct().withColumn("steps", F.lit(0).cast("long")))
    main, done = _main(arcs), []
    while True:
        for k, jump in enumerate(_jumps(main, most)):
            ahead = best.selectExpr("app_id", "stage_id AS target", "steps AS far")
            longer = jump.join(ahead, ["app_id", "target"]).selectExpr(
                "app_id", "source AS stage_id", f"far + {2**k} AS steps"
            )
            best = cut_lineage(best.unionByName(longer).groupBy(*keys).agg(F.max("steps").alias("steps")))
        ahead = best.selectExpr("app_id", "stage_id AS target", "steps AS far")
        near = F.struct("far", -F.abs(F.col("target") - F.col("source")), "target")
        offer = arcs.join(ahead, ["app_id", "target"]).groupBy("app_id", "source")
        offer = offer.agg(F.max("far").alias("far"), F.max_by("target", near).alias("target"))
        offer = offer.withColumnRenamed("source", "stage_id").join(best, keys)
        offer = cut_lineage(offer.withColumn("grows", F.col("far") >= F.col("steps")))
        apps = best.groupBy("app_id").agg(F.max("steps").alias("steps")).join(limits, "app_id")
        grows = offer.filter("grows").select("app_id").distinct().withColumn("grows", F.lit(True))
        apps = apps.join(grows, "app_id", "left").select(
            "app_id", "steps", (F.col("steps") <= F.col("sources")).alias("is_acyclic"), "grows"
        )
        apps = cut_lineage(apps)
        done.append(apps.filter("grows IS NULL OR NOT is_acyclic").drop("grows"))
        left = apps.filter("grows AND is_acyclic").select("app_id")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done)
        arcs = cut_lineage(arcs.join(left, "app_id", "left_semi"))
        best = best.join(left, "app_id", "left_semi")
        main = offer.join(left, "app_id", "left_semi").selectExpr(
            "app_id", "stage_id AS source", "target"
        )


def _per_app(stages: DataFrame, name: str) -> DataFrame:
    return stages.groupBy("app_id").agg(F.count("*").alias(name))


def _flagged(nodes: DataFrame, edges: DataFrame, strict_abort: bool) -> DataFrame:
    """Stages with their own flags and what their parents and children look like."""
    own = nodes.select(
        "app_id",
        "stage_id",
        "stage_name",
        "failure_reason",
        F.size(F.array_distinct(F.coalesce("parent_ids", F.array().cast("array<int>")))).alias(
            "parents"
        ),
        (F.col("status") == FAILED).alias("failed"),
        (F.col("status") == COMPLETED).alias("completed"),
        is_logical_abort(F.col("status"), F.col("failure_reason"), strict_abort).alias("abort"),
    )
    flags = own.select("app_id", "stage_id", "failed", "completed", "abort")
    up = (
        edges.join(
            flags.withColumnRenamed("stage_id", "parent_stage_id"), ["app_id", "parent_stage_id"]
        )
        .groupBy("app_id", F.col("child_stage_id").alias("stage_id"))
        .agg(
            F.bool_or("failed").alias("any_parent_failed"),
            F.bool_or(F.col("failed") & ~F.col("abort")).alias("any_cause_above"),
            F.bool_and("completed").alias("parents_clean"),
        )
    )
    down = (
        edges.join(
            flags.withColumnRenamed("stage_id", "child_stage_id"), ["app_id", "child_stage_id"]
        )
        .groupBy("app_id", F.col("parent_stage_id").alias("stage_id"))
        .agg(F.bool_or("failed").alias("any_child_failed"), F.lit(True).alias("has_child"))
    )
    no, yes = F.lit(False), F.lit(True)
    return (
        own.join(up, ["app_id", "stage_id"], "left")
        .join(down, ["app_id", "stage_id"], "left")
        .withColumns(
            {
                "any_parent_failed": F.coalesce("any_parent_failed", no),
                "any_cause_above": F.coalesce("any_cause_above", no),
                "parents_clean": F.coalesce("parents_clean", yes),
                "any_child_failed": F.coalesce("any_child_failed", no),
                "has_child": F.coalesce("has_child", no),
            }
        )
    )


def _best(condition: Column) -> Column:
    return F.max(F.when(condition, F.col("stage_id")))


def lineage_root_causes(
    nodes: DataFrame, strict_abort: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Root cause per application, and the walked stages. Runs jobs.

    The walk starts at the failed leaf with the highest id, else at the last
    failed stage without a failed child, and follows every parent that failed in
    its own right. Several stages may end it; the highest id is the root cause.

    Returns (causes, path): causes as in `chain_root_causes`; path is
    (app_id, stage_id, is_victim), each stage once.
    """
    nodes = cut_lineage(nodes)
    edges = cut_lineage(lineage_edges(nodes))
    stages = cut_lineage(_flagged(nodes, edges, strict_abort))
    failed, leaf = F.col("failed"), ~F.col("has_child")
    per_app = cut_lineage(
        stages.groupBy("app_id").agg(
            F.coalesce(
                _best(failed & leaf), _best(failed & ~F.col("any_child_failed")), _best(failed)
            ).alias("terminal"),
            F.coalesce(_best(leaf), F.max("stage_id")).alias("leaf"),
            F.count_if(failed & ~F.col("any_parent_failed")).alias("candidates"),
        )
    )

    causes_above = stages.filter(F.col("failed") & ~F.col("abort"))
    arcs = (
        edges.join(
            causes_above.select("app_id", F.col("stage_id").alias("parent_stage_id")),
            ["app_id", "parent_stage_id"],
            "left_semi",
        )
        .join(
            stages.filter(failed).select("app_id", F.col("stage_id").alias("child_stage_id")),
            ["app_id", "child_stage_id"],
            "left_semi",
        )
        .select(
            "app_id",
            F.col("child_stage_id").alias("source"),
            F.col("parent_stage_id").alias("target"),
        )
    )
    starts = per_app.select(
        "app_id", F.lit(0).alias("seed"), F.coalesce("terminal", "leaf").alias("stage_id")
    )
    walked = reach(arcs, starts).drop("seed").join(stages, ["app_id", "stage_id"])

    ends = F.col("failed") & ~F.col("any_cause_above")
    walk = walked.groupBy("app_id").agg(
        _best(ends).alias("root"), F.bool_and(F.col("parents") <= 1).alias("single_parents")
    )
    chosen = per_app.join(walk, "app_id").withColumn(
        "stage_id", F.coalesce("root", "terminal", "leaf")
    )
    healthy = F.col("terminal").isNull()
    score = confidence(
        F.col("failure_reason"),
        F.col("single_parents"),
        F.col("parents_clean"),
        F.col("candidates"),
    )
    causes = chosen.join(stages, ["app_id", "stage_id"]).select(
        "app_id",
        F.col("stage_id").alias("root_cause_stage_id"),
        F.col("stage_name").alias("root_cause_stage_name"),
        F.when(healthy, NO_FAILURE)
        .otherwise(F.coalesce("failure_reason", F.lit(UNKNOWN_REASON)))
        .alias("failure_reason"),
        F.coalesce("terminal", "leaf").alias("terminal_stage_id"),
        F.when(healthy, 1.0).otherwise(score).alias("analysis_confidence"),
    )
    path = walked.select(
        "app_id", "stage_id", (F.col("failed") & F.col("any_cause_above")).alias("is_victim")
    )
    return causes, path
