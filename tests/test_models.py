"""Splits, measures and models."""

from __future__ import annotations

import hashlib
import math
import random
import threading

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import functions as F

from faultweave.operators import evaluation, models, split, trees
from faultweave.operators.features import FEATURE_COLUMNS
from faultweave.plans import classify


@pytest.fixture(scope="module")
def features(spark):
    rng = random.Random(5)
    rows = []
    for i in range(140):
        label = i % 7
        values = [rng.gauss(label * (j % 3), 1.0) for j in range(24)] + [3.0]
        rows.append((f"app{i}", label, *values))
    schema = "app_id string, label int, " + ", ".join(f"{c} double" for c in FEATURE_COLUMNS)
    return spark.createDataFrame(rows, schema).repartition(3).cache()


@pytest.fixture(scope="module")
def predictions(spark):
    rng = random.Random(9)
    rows = [(f"a{i}", rng.randrange(7), float(rng.randrange(6))) for i in range(500)]
    return spark.createDataFrame(rows, "app_id string, label int, prediction double").cache()


@pytest.mark.parametrize(
    "ours, theirs",
    [
        ("accuracy", "accuracy"),
        ("f1", "f1"),
        ("precision", "weightedPrecision"),
        ("recall", "weightedRecall"),
    ],
)
def test_measures_equal_mllib(predictions, ours, theirs):
    want = MulticlassClassificationEvaluator(metricName=theirs).evaluate(predictions)
    assert evaluation.eval_metrics(predictions).first()[ours] == pytest.approx(want, abs=1e-12)


def test_confusion_matrix_has_all_classes(predictions):
    matrix = evaluation.confusion_matrix(predictions)
    assert matrix.columns == ["label"] + [f"pred_{c}" for c in range(7)]
    rows = [r.asDict() for r in matrix.collect()]
    assert all(r["pred_6"] == 0 for r in rows)  # never predicted
    assert sum(sum(r.values()) - r["label"] for r in rows) == 500


def test_stratified_split_is_exact(spark):
    rng = random.Random(1)
    rows = [(f"app_{i}", min(rng.randrange(12), 6)) for i in range(3000)]
    df = spark.createDataFrame(rows, "app_id string, label int")
    got = {r.app_id: r.is_train for r in split.stratified_split(df).collect()}
    for label in range(7):
        apps = sorted(
            (a for a, l in rows if l == label), key=lambda a: hashlib.md5(a.encode()).hexdigest()
        )
        quota = math.ceil(0.8 * len(apps))
        assert [got[a] for a in apps] == [True] * quota + [False] * (len(apps) - quota)


def test_random_split_is_a_partition(features):
    train, test = split.random_split(features)
    again, _ = split.random_split(features)
    assert train.count() + test.count() == features.count()
    assert sorted(r.app_id for r in train.collect()) == sorted(r.app_id for r in again.collect())


def test_scaling(features):
    rows = models.scaled_features(features).collect()
    for j in range(25):
        column = [r.scaled[j] for r in rows]
        mean = sum(column) / len(column)
        assert abs(mean) < 1e-9
        spread = sum((x - mean) ** 2 for x in column) / (len(column) - 1)
        assert spread == pytest.approx(0.0 if j == 24 else 1.0)


def test_assemble(features):
    vector = models.assemble(features).first().features
    assert vector.size == 25


def test_train_compare_save_and_judge(spark, features, tmp_path):
    result = classify.train_and_compare(features)
    table = result.table.collect()
    assert [r.model for r in table] == [
        models.RANDOM_FOREST,
        models.DECISION_TREE,
        models.LOGISTIC_REGRESSION,
    ]
    (best,) = [r for r in table if r.is_best]
    assert best.f1 == max(r.f1 for r in table)

    model_path, out_path = str(tmp_path / "model"), str(tmp_path / "predictions")
    classify.save_results(result, model_path, out_path)
    saved = spark.read.parquet(out_path)
    assert saved.columns == ["app_id", "label", "prediction", "features", "probability"]
    assert saved.count() == result.test.count()

    report = {r.measure: r for r in classify.judge_holdout(result, model_path, features).collect()}
    assert set(report) == set(models.MEASURES)
    f1 = report["f1"]
    assert f1.difference == pytest.approx(f1.holdout - f1.test)
    assert f1.generalises == (f1.holdout >= 0.85 * f1.test)

    importance = models.feature_importance(result.models[models.RANDOM_FOREST], features).collect()
    weights = [r.importance for r in importance]
    assert len(weights) == 25 and weights == sorted(weights, reverse=True)
    assert sum(weights) == pytest.approx(1.0)


def test_first_model_wins_ties(spark):
    schema = ", ".join(f"{m} double" for m in models.MEASURES)
    row = spark.createDataFrame([(0.5, 0.5, 0.5, 0.5)], schema)
    table = models.compare({"one": row, "two": row}).collect()
    assert [(r.model, r.is_best) for r in table] == [("one", True), ("two", False)]


def test_settings():
    forest, tree, logistic = models.classifiers().values()
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getMaxBins()) == (100, 10, 32)
    assert (tree.getMaxDepth(), tree.getImpurity(), tree.getSeed()) == (5, "entropy", 42)
    assert (logistic.getMaxIter(), logistic.getRegParam(), logistic.getFamily()) == (
        100,
        0.01,
        "multinomial",
    )


def test_prediction_table(spark):
    df = spark.createDataFrame(
        [("b", 1, 1.0), ("a", 1, 5.0)], "app_id string, label int, prediction double"
    )
    got = sorted(tuple(r) for r in evaluation.prediction_table(df).collect())
    assert got == [
        ("a", 1, 5, "OOM", "Disk Space Failure", "✗"),
        ("b", 1, 1, "OOM", "OOM", "✓"),
    ]


def test_the_logistic_fit_has_a_flat_slope(features):
    model = models.fit(features, models.classifiers()[models.LOGISTIC_REGRESSION])
    rows = model.transform(features).select("features", "label", "probability").collect()
    x = np.array([r.features.toArray() for r in rows])
    p = np.array([r.probability.toArray() for r in rows])
    p[np.arange(len(rows)), [r.label for r in rows]] -= 1
    fitted = model.stages[-1]
    weights = fitted.coefficientMatrix.toArray()
    slope = p.T @ x / len(rows) + models.REGULARISATION * weights
    assert np.abs(slope).max() < 1e-3
    assert np.abs(p.mean(axis=0)).max() < 1e-3


def test_audit_agrees_and_sees_an_altered_split(spark, features, tmp_path):
    path = str(tmp_path / "tree")
    model = models.saved_and_loaded(
        models.fit(features, models.classifiers()[models.DECISION_TREE]), path
    )
    rows = model.transform(features).select("label", vector_to_array("features").alias("scaled"))
    nodes = trees.saved_nodes(spark, model, path).cache()

    def wrong(table):
        return [
            r.id
            for r in trees.audit(rows, table, models.TREE_DEPTH).collect()
            if r.rows != r.fitted_rows
            or abs((r.impurity or 0) - r.fitted_impurity) > 1e-9
            or abs((r.gain or 0) - (r.fitted_gain or 0)) > 1e-9
        ]

    assert nodes.count() > 5 and wrong(nodes) == []
    altered = F.when(F.col("id") == 0, F.col("threshold") + 1).otherwise(F.col("threshold"))
    assert wrong(nodes.withColumn("threshold", altered))
    other = F.when(F.col("id") == 1, F.lit(24)).otherwise(F.col("feature"))
    assert wrong(nodes.withColumn("feature", other))


@pytest.mark.parametrize("name", [models.RANDOM_FOREST, models.DECISION_TREE])
def test_importances_of_nodes(spark, features, tmp_path, name):
    path = str(tmp_path / "model")
    model = models.saved_and_loaded(models.fit(features, models.classifiers()[name]), path)
    told = {r.feature: r.importance for r in models.feature_importance(model, features).collect()}
    summed = trees.importances(trees.saved_nodes(spark, model, path)).collect()
    assert len(summed) == 25
    assert {r.feature: pytest.approx(r.importance, abs=1e-9) for r in summed} == told


def test_slope_sees_an_altered_coefficient(features):
    model = models.fit(features, models.classifiers()[models.LOGISTIC_REGRESSION])
    assert max(r.steepest for r in models.slope(model, features).collect()) < 1e-3
    short = models.classifiers()[models.LOGISTIC_REGRESSION].setMaxIter(2)
    unfinished = models.fit(features, short)
    assert max(r.steepest for r in models.slope(unfinished, features).collect()) > 1e-2


def test_measures_are_taken_on_one_split(features):
    result = classify.train_and_compare(features)
    again = {n: models.measure(m, result.test).first() for n, m in result.models.items()}
    assert again == {n: row.first() for n, row in result.metrics.items()}


def test_folds_are_judged_by_models_that_have_not_seen_them(features):
    """Each fold is judged whole, about as well as by a forest fitted by hand on the other folds."""
    rows = features.withColumn("fold", F.pmod(F.xxhash64("app_id"), F.lit(3)).cast("int")).cache()
    counts, mean = models.cross_validated_folds(rows, "fold", folds=3)
    got = {(r.fold, r.label, r.prediction): r.rows for r in counts.collect()}
    want = {}
    f1 = []
    for fold in range(3):
        model = models.fit(rows.filter(F.col("fold") != fold), models.classifiers()[models.RANDOM_FOREST])
        judged = model.transform(rows.filter(F.col("fold") == fold))
        for r in judged.groupBy("label", "prediction").count().collect():
            want[fold, r.label, r.prediction] = r["count"]
        f1.append(MulticlassClassificationEvaluator(metricName="f1").evaluate(judged))
    # Trees are sampled by partition, so single predictions may differ; rows of a class may not.
    for fold in range(3):
        for label in range(7):
            assert sum(n for (a, b, _), n in got.items() if (a, b) == (fold, label)) == sum(
                n for (a, b, _), n in want.items() if (a, b) == (fold, label)
            )
    ours = [r.f1 for r in models.weighted_f1(counts, "fold").orderBy("fold").collect()]
    assert sum(ours) / 3 == pytest.approx(mean, abs=1e-9)
    assert ours == pytest.approx(f1, abs=0.15)


def test_folds_are_fitted_side_by_side(features, monkeypatch):
    together = threading.Barrier(3, timeout=60)
    fit = models.Pipeline.fit

    def waiting(self, train, *more):
        together.wait()
        return fit(self, train, *more)

    monkeypatch.setattr(models.Pipeline, "fit", waiting)
    assert 0 <= models.cross_validate(features, folds=3) <= 1


def test_cross_validation_equals_mllib(features):
    forest = models.classifiers()[models.RANDOM_FOREST]
    validator = CrossValidator(
        estimator=Pipeline(stages=[models.assembler(), models.scaler(), forest]),
        estimatorParamMaps=[{}],
        evaluator=MulticlassClassificationEvaluator(metricName="f1"),
        numFolds=3,
        seed=models.SEED,
    )
    want = validator.fit(features).avgMetrics[0]
    assert models.cross_validate(features, folds=3) == pytest.approx(want, abs=1e-12)


def test_weighted_f1_equals_mllib(predictions):
    counts = predictions.groupBy("label", "prediction").agg(F.count("*").alias("rows"))
    want = MulticlassClassificationEvaluator(metricName="f1").evaluate(predictions)
    assert models.weighted_f1(counts).first().f1 == pytest.approx(want, abs=1e-12)
