"""Features to a judged model: split, train three models, compare, save, re-score."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from faultweave.operators.models import (
    RANDOM_FOREST,
    classifiers,
    compare,
    fill_features,
    fit,
    holdout_report,
    load_model,
    measure,
    save_model,
    score,
)
from faultweave.operators.sizing import cut_lineage
from faultweave.operators.split import random_split


class Comparison(NamedTuple):
    models: dict[str, PipelineModel]
    metrics: dict[str, DataFrame]
    table: DataFrame
    test: DataFrame


def train_and_compare(features: DataFrame) -> Comparison:
    """Train the three classifiers on 80% and measure them on the rest. Runs jobs.

    The split is drawn once: both sides are cut from their lineage before a model sees them, and
    the measures, one row a model, are taken before the training rows are released.
    """
    train, test = map(cut_lineage, random_split(fill_features(features)))
    models = {name: fit(train, classifier) for name, classifier in classifiers().items()}
    metrics = {name: _taken(measure(model, test)) for name, model in models.items()}
    train.unpersist()
    return Comparison(models, metrics, compare(metrics), test)


def _taken(row: DataFrame) -> DataFrame:
    """A table of one row, computed now."""
    return row.sparkSession.createDataFrame(row.collect(), row.schema)


def save_results(
    comparison: Comparison, model_path: str, predictions_path: str, name: str = RANDOM_FOREST
) -> None:
    """Write one model and its test predictions. Writes."""
    model = comparison.models[name]
    save_model(model, model_path)
    score(model, comparison.test).write.mode("overwrite").parquet(predictions_path)


def judge_holdout(comparison: Comparison, model_path: str, holdout: DataFrame) -> DataFrame:
    """Score unseen features with the saved forest and set it against the test result."""
    model = load_model(model_path)
    unseen = measure(model, fill_features(holdout))
    return holdout_report(comparison.metrics[RANDOM_FOREST], unseen)
