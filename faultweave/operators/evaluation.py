"""How good predictions are: all measures from one count per (label, prediction)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultweave.functions.labels import CLASS_NAMES, label_name
from faultweave.functions.scalars import correctness_mark, guarded_ratio

# The class ids.
CLASSES = (0, 1, 2, 3, 4, 5, 6)


def confusion_matrix(predictions: DataFrame, classes=CLASSES) -> DataFrame:
    """One row per actual class, one column per predicted class, zeros included."""
    return (
        predictions.groupBy("label")
        .agg(*[F.count_if(F.col("prediction") == c).alias(f"pred_{c}") for c in classes])
        .orderBy("label")
    )


def per_class_accuracy(predictions: DataFrame) -> DataFrame:
    hits = predictions.groupBy("label").agg(
        F.count_if(F.col("prediction") == F.col("label")).alias("correct"),
        F.count("*").alias("total"),
    )
    return hits.select(
        "label",
        label_name(F.col("label"), CLASS_NAMES).alias("label_name"),
        "correct",
        "total",
        guarded_ratio(F.col("correct"), F.col("total")).alias("accuracy"),
    ).orderBy("label")


def eval_metrics(predictions: DataFrame) -> DataFrame:
    """Accuracy, F1, precision and recall, weighted by class size; one row.

    A class never predicted has precision 0.
    """
    cells = predictions.groupBy(
        F.col("label").cast("double").alias("label"), "prediction"
    ).agg(F.count("*").alias("n"))
    none = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(
            F.col("label").alias("class"),
            F.col("n").alias("actual"),
            none.alias("predicted"),
            F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(none).alias("hits"),
        ),
        F.struct(
            F.col("prediction").alias("class"),
            none.alias("actual"),
            F.col("n").alias("predicted"),
            none.alias("hits"),
        ),
    )
    per_class = (
        cells.select(F.inline(sides))
        .groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ("actual", "predicted", "hits")])
    )
    precision = guarded_ratio(F.col("hits"), F.col("predicted"))
    recall = guarded_ratio(F.col("hits"), F.col("actual"))
    f1 = guarded_ratio(2 * F.col("hits"), F.col("predicted") + F.col("actual"))
    total = F.sum("actual")
    return per_class.agg(
        F.try_divide(F.sum("hits"), total).alias("accuracy"),
        F.try_divide(F.sum(f1 * F.col("actual")), total).alias("f1"),
        F.try_divide(F.sum(precision * F.col("actual")), total).alias("precision"),
        F.try_divide(F.sum(recall * F.col("actual")), total).alias("recall"),
    )


def prediction_table(predictions: DataFrame) -> DataFrame:
    """Actual against predicted class per application, with names and a mark."""
    label, predicted = F.col("label"), F.col("prediction").cast("int")
    return predictions.select(
        "app_id",
        "label",
        predicted.alias("predicted_label"),
        label_name(label, CLASS_NAMES).alias("label_name"),
        label_name(predicted, CLASS_NAMES).alias("predicted_name"),
        correctness_mark(label, predicted).alias("correct"),
    )
