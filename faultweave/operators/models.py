"""MLlib classifiers of the failure class.

Training, tree statistics and gradients are MLlib's distributed jobs; only model
parameters and single measures reach the driver.
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultweave.operators.evaluation import eval_metrics
from faultweave.operators.features import FEATURE_COLUMNS
from faultweave.operators.sizing import cut_lineage

# Model settings.
SEED = 42
TREES = 100
FOREST_DEPTH = 10
TREE_DEPTH = 5
BINS = 32
ITERATIONS = 100
REGULARISATION = 0.01
FOLDS = 5

# A model generalises if unseen F1 keeps this share of test F1.
GENERALISES = 0.85

RANDOM_FOREST = "Random Forest"
DECISION_TREE = "Decision Tree"
LOGISTIC_REGRESSION = "Logistic Regression"

MEASURES = ("accuracy", "f1", "precision", "recall")


def assembler(output: str = "raw_features") -> VectorAssembler:
    return VectorAssembler(inputCols=FEATURE_COLUMNS, outputCol=output, handleInvalid="keep")


def scaler() -> StandardScaler:
    return StandardScaler(
        inputCol="raw_features", outputCol="features", withMean=True, withStd=True
    )


def classifiers() -> dict[str, Estimator]:
    """The three classifiers in comparison order."""
    return {
        RANDOM_FOREST: RandomForestClassifier(
            numTrees=TREES, maxDepth=FOREST_DEPTH, maxBins=BINS, seed=SEED
        ),
        DECISION_TREE: DecisionTreeClassifier(
            maxDepth=TREE_DEPTH, maxBins=BINS, impurity="entropy", seed=SEED
        ),
        LOGISTIC_REGRESSION: LogisticRegression(
            maxIter=ITERATIONS,
            family="multinomial",
            elasticNetParam=0.0,
            regParam=REGULARISATION,
        ),
    }


def fill_features(df: DataFrame) -> DataFrame:
    return df.fillna(0, subset=FEATURE_COLUMNS)


def assemble(features: DataFrame) -> DataFrame:
    """Add the 25 features as one vector, invalid values kept."""
    return assembler("features").transform(features)


def fit(train: DataFrame, classifier: Estimator) -> PipelineModel:
    """Assemble, scale and train. Runs jobs."""
    return Pipeline(stages=[assembler(), scaler(), classifier]).fit(train)


def scaled_features(features: DataFrame) -> DataFrame:
    """(app_id, label, scaled) with every feature at mean 0 and deviation 1. Runs a job.

    A feature that never varies becomes 0.
    """
    model = Pipeline(stages=[assembler(), scaler()]).fit(features)
    return model.transform(features).select(
        "app_id", "label", vector_to_array("features").alias("scaled")
    )


def cross_validate(features: DataFrame, folds: int = FOLDS) -> float:
    """Mean F1 of the random forest over k folds of all rows. Runs jobs, all folds side by side.

    CrossValidator takes fold after fold, as its parallelism is that of the settings compared. Rows
    fall into its folds: by the same random number of each row.
    """
    rows = cut_lineage(features.withColumn("draw", F.rand(SEED))).cache()
    stages = [assembler(), scaler(), classifiers()[RANDOM_FOREST]]
    evaluator = MulticlassClassificationEvaluator(metricName="f1")

    def judged(number: int) -> float:
        own = (F.col("draw") >= number / folds) & (F.col("draw") < (number + 1) / folds)
        model = Pipeline(stages=stages).fit(rows.filter(~own))
        return evaluator.evaluate(model.transform(rows.filter(own)))

    with ThreadPool(folds) as pool:
        f1 = pool.map(inheritable_thread_target(features.sparkSession)(judged), range(folds))
    rows.unpersist()
    return sum(f1) / folds


def cross_validated_folds(features: DataFrame, fold: str, folds: int = FOLDS):
    """Cross-validation of the random forest by the folds that column `fold` names (from 0): the
    confusion counts (fold, label, prediction, rows) of what each fold's model, fitted on the other
    folds, says of the fold itself; and the mean F1 as told by the validator. Runs jobs, all folds
    side by side. Every fold must have rows.
    """
    validator = CrossValidator(
        estimator=Pipeline(stages=[assembler(), scaler(), classifiers()[RANDOM_FOREST]]),
        estimatorParamMaps=ParamGridBuilder().build(),
        evaluator=MulticlassClassificationEvaluator(metricName="f1"),
        numFolds=folds,
        foldCol=fold,
        parallelism=folds,
        collectSubModels=True,
    )
    fitted = validator.fit(features)
    counts = None
    for number, (model,) in enumerate(fitted.subModels):
        of_fold = model.transform(features.filter(F.col(fold) == number))
        part = of_fold.groupBy(F.lit(number).alias("fold"), "label", "prediction").agg(
            F.count("*").alias("rows")
        )
        counts = part if counts is None else counts.unionByName(part)
    return counts, fitted.avgMetrics[0]


def weighted_f1(counts: DataFrame, *keys: str) -> DataFrame:
    """(*keys, f1) from confusion counts (*keys, label, prediction, rows): F1 of each class,
    weighted by its rows; 0 where nothing of a class was found."""
    told = counts.groupBy(*keys, F.col("prediction").alias("class")).agg(F.sum("rows").alias("told"))
    hit = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("rows")).otherwise(0))
    true = counts.groupBy(*keys, F.col("label").cast("double").alias("class")).agg(
        F.sum("rows").alias("true"), hit.alias("hit")
    )
    # 2PR / (P + R) is 2 hit / (told + true).
    f1 = 2 * F.col("hit") / (F.coalesce("told", F.lit(0)) + F.col("true"))
    joined = true.join(told, [*keys, "class"], "left")
    return joined.groupBy(*keys).agg((F.sum(f1 * F.col("true")) / F.sum("true")).alias("f1"))


def feature_importance(model: PipelineModel, df: DataFrame) -> DataFrame:
    """The 25 importances of a tree model, highest first."""
    weights = model.stages[-1].featureImportances.toArray().tolist()
    rows = list(zip(FEATURE_COLUMNS, weights))
    table = df.sparkSession.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.col("importance").desc(), "feature")


def slope(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """(class, steepest) of a fitted logistic regression: the largest slope of its penalised loss
    over the rows, by the weights and the intercept of each class. One aggregate; 0 at the optimum.
    """
    fitted = model.stages[-1]
    weights = fitted.coefficientMatrix.toArray()
    classes, width = weights.shape
    scored = model.transform(rows).select(
        "label", vector_to_array("features").alias("x"), vector_to_array("probability").alias("p")
    )
    cells = []
    for k in range(classes):
        off = F.col("p")[k] - (F.col("label") == k).cast("double")
        penalty = REGULARISATION * weights[k]
        slopes = [F.avg(off * F.col("x")[j]) + float(penalty[j]) for j in range(width)]
        steepest = F.greatest(*map(F.abs, slopes), F.abs(F.avg(off)))
        cells.append(F.struct(F.lit(k).alias("class"), steepest.alias("steepest")))
    return scored.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def saved_and_loaded(model: PipelineModel, path: str) -> PipelineModel:
    """The model as it comes back from `path`. Writes."""
    save_model(model, path)
    return load_model(path)


def parameters(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """(parameter, value) of the settings that the last stage was given."""
    last = model.stages[-1]
    given = [(p.name, str(last.getOrDefault(p))) for p in last.params if last.isSet(p)]
    return spark.createDataFrame(given, "parameter string, value string")


def compare(metrics: dict[str, DataFrame]) -> DataFrame:
    """One row per model and measure set; `is_best` marks the highest F1, first on ties."""
    rows = None
    for place, (name, row) in enumerate(metrics.items()):
        named = row.select(F.lit(place).alias("place"), F.lit(name).alias("model"), *MEASURES)
        rows = named if rows is None else rows.unionByName(named)
    models = Window.partitionBy(F.lit("all models")).orderBy(F.col("f1").desc(), "place")
    return (
        rows.withColumn("is_best", F.row_number().over(models) == 1)
        .orderBy("place")
        .drop("place")
    )


def holdout_report(test: DataFrame, holdout: DataFrame) -> DataFrame:
    """Test against unseen measures, their difference, and whether F1 held up.

    Both inputs are one-row `eval_metrics` tables.
    """
    both = test.select(F.lit("test").alias("side"), *MEASURES).unionByName(
        holdout.select(F.lit("holdout").alias("side"), *MEASURES)
    )

    def of(side: str, measure: str):
        return F.max(F.when(F.col("side") == side, F.col(measure)))

    sides = both.agg(
        *[of(s, m).alias(f"{s}_{m}") for s in ("test", "holdout") for m in MEASURES]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("measure"),
                F.col(f"test_{m}").alias("test"),
                F.col(f"holdout_{m}").alias("holdout"),
                (F.col(f"holdout_{m}") - F.col(f"test_{m}")).alias("difference"),
                (F.col("holdout_f1") >= F.col("test_f1") * GENERALISES).alias("generalises"),
            )
            for m in MEASURES
        ]
    )
    return sides.select(F.inline(rows))


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Predictions in the persisted five-column form."""
    return model.transform(df).select("app_id", "label", "prediction", "features", "probability")


def measure(model: PipelineModel, df: DataFrame) -> DataFrame:
    return eval_metrics(model.transform(df))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
