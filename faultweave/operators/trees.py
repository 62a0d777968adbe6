"""Fitted trees as node tables: rows routed again, gains recomputed, importances summed.

A saved model holds its nodes as a table. Nodes are few, at most 2 ** (depth + 1) a tree; rows are
routed down by one join a level and never meet each other.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultweave.operators.features import FEATURE_COLUMNS
from faultweave.operators.sizing import broadcast_if_small


def saved_nodes(spark: SparkSession, model: PipelineModel, path: str) -> DataFrame:
    """(tree, id, rows, weight, impurity, gain, left, right, feature, threshold) of the tree model
    that `model`, saved at `path`, ends with. Leaves have no children, feature and threshold.

    `rows` are the training rows seen, `weight` counts them as often as they were drawn.
    """
    place = len(model.stages) - 1
    nodes = spark.read.parquet(f"{path}/stages/{place}_{model.stages[-1].uid}/data")
    if "nodeData" in nodes.columns:
        nodes = nodes.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        nodes = nodes.withColumn("tree", F.lit(0))
    inner = F.col("leftChild") >= 0
    total = F.aggregate("impurityStats", F.lit(0.0), lambda a, x: a + x)
    return nodes.select(
        "tree",
        "id",
        F.col("rawCount").alias("rows"),
        total.alias("weight"),
        "impurity",
        F.when(inner, F.col("gain")).alias("gain"),
        F.when(inner, F.col("leftChild")).alias("left"),
        F.when(inner, F.col("rightChild")).alias("right"),
        F.when(inner, F.col("split.featureIndex")).alias("feature"),
        F.when(inner, F.col("split.leftCategoriesOrThreshold")[0]).alias("threshold"),
    )


def route(rows: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """(…, id): each row of (…, scaled) once for every node of one tree that it passes."""
    split = nodes.select(F.col("id").alias("at"), "feature", "threshold", "left", "right")
    split = broadcast_if_small(split)
    walked = rows.withColumns({"at": F.lit(0), "passed": F.array(F.lit(0))})
    value = F.get("scaled", "feature")
    below = F.when(value <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
    for _ in range(depth):
        walked = walked.join(split, "at").withColumn("below", below)
        walked = walked.select(
            *rows.columns,
            F.coalesce("below", "at").alias("at"),
            F.when(F.col("below").isNull(), F.col("passed"))
            .otherwise(F.array_append("passed", F.col("below")))
            .alias("passed"),
        )
    return walked.select(*rows.columns, F.explode("passed").alias("id"))


def audit(rows: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """Each node of one entropy tree beside what routing its training rows again gives:
    (id, is_leaf, rows, impurity, gain, fitted_rows, fitted_impurity, fitted_gain)."""
    by_class = route(rows, nodes, depth).groupBy("id", "label").agg(F.count("*").alias("c"))
    own = by_class.groupBy("id").agg(
        F.sum("c").alias("rows"), F.sum(F.col("c") * F.log2("c")).alias("spread")
    )
    own = own.select("id", "rows", (F.log2("rows") - F.col("spread") / F.col("rows")).alias("impurity"))
    fitted = nodes.select(
        "id", "left", "right",
        F.col("rows").alias("fitted_rows"),
        F.col("impurity").alias("fitted_impurity"),
        F.col("gain").alias("fitted_gain"),
    )
    share = own.select(F.col("id").alias("child"), (F.col("rows") * F.col("impurity")).alias("part"))
    children = fitted.select("id", F.explode(F.array("left", "right")).alias("child"))
    parts = children.join(share, "child").groupBy("id").agg(F.sum("part").alias("part"))
    gain = F.col("impurity") - F.col("part") / F.col("rows")
    return (
        fitted.join(own, "id", "left")
        .join(parts, "id", "left")
        .select(
            "id",
            F.col("left").isNull().alias("is_leaf"),
            F.coalesce("rows", F.lit(0)).alias("rows"),
            "impurity",
            F.when(F.col("left").isNotNull(), gain).alias("gain"),
            "fitted_rows",
            "fitted_impurity",
            "fitted_gain",
        )
    )


def importances(nodes: DataFrame) -> DataFrame:
    """(feature, importance) of all features: gains by weight, shared out within each tree, then
    averaged over the trees that split at all."""
    names = F.array(*map(F.lit, FEATURE_COLUMNS))
    gains = nodes.where("feature IS NOT NULL").groupBy("tree", "feature")
    gains = gains.agg(F.sum(F.col("gain") * F.col("weight")).alias("gain"))
    totals = gains.groupBy("tree").agg(F.sum("gain").alias("total"))
    trees = totals.agg(F.count("*").alias("trees"))
    shares = gains.join(totals, "tree").groupBy("feature")
    shares = shares.agg(F.sum(F.col("gain") / F.col("total")).alias("share"))
    every = nodes.sparkSession.range(len(FEATURE_COLUMNS)).select(F.col("id").cast("int").alias("feature"))
    return (
        every.join(shares, "feature", "left")
        .join(F.broadcast(trees))
        .select(
            F.get(names, "feature").alias("feature"),
            F.coalesce(F.col("share") / F.col("trees"), F.lit(0.0)).alias("importance"),
        )
    )
