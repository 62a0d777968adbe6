"""All named queries: (spark, sf_dir) -> DataFrame over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultweave.functions import scalars
from faultweave.functions.labels import scenario_name, scenarios_by_label, scenarios_by_name
from faultweave.operators import (
    evaluation,
    features,
    graph,
    lineage,
    models,
    rootcause,
    sizing,
    skew,
    split,
    trees,
)
from faultweave.plans import workload
from faultweave.registry import adapters
from faultweave.sources import eventlog, lake, manifest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(value: Column, digits: int = 6) -> Column:
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    return F.round(value, digits) + F.lit(0.0)


def _round_all(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: rounded(F.col(c), digits) for c in doubles})


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [adapters.table(spark, sf_dir, name) for name in names]


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.stage_nodes(adapters.graph_stages(spark, sf_dir))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.app_features(adapters.tasks(spark, sf_dir), adapters.stages(spark, sf_dir))


# ---------------------------------------------------------------- root cause


@query
def root_cause_chain(spark, sf_dir):
    return rootcause.chain_root_causes(_nodes(spark, sf_dir))


@query
def root_cause_path_text(spark, sf_dir):
    return rootcause.path_text(rootcause.propagation_path(_nodes(spark, sf_dir)))


@query
def root_cause_strict(spark, sf_dir):
    return rootcause.chain_root_causes(_nodes(spark, sf_dir), strict_abort=True)


@query
def propagation_path(spark, sf_dir):
    return rootcause.propagation_path(_nodes(spark, sf_dir))


@query
def root_cause_summary(spark, sf_dir):
    causes = rootcause.chain_root_causes(_nodes(spark, sf_dir))
    return rootcause.root_cause_summary(causes)


@query
def root_cause_lineage(spark, sf_dir):
    nodes = graph.stage_nodes(adapters.lineage_stages(spark, sf_dir))
    causes, path = lineage.lineage_root_causes(nodes)
    return causes.join(rootcause.path_text(path), "app_id", "left")


# ---------------------------------------------------------------- graph


@query
def dag_nodes(spark, sf_dir):
    return graph.stage_nodes(adapters.stage_attempts(spark, sf_dir))


@query
def dag_edges(spark, sf_dir):
    return graph.chain_edges(_nodes(spark, sf_dir))


@query
def dag_edges_inner(spark, sf_dir):
    return graph.inner_edges(graph.chain_edges(_nodes(spark, sf_dir)))


@query
def dag_shape(spark, sf_dir):
    return graph.chain_shape(_nodes(spark, sf_dir))


@query
def dag_shape_lineage(spark, sf_dir):
    return lineage.lineage_shape(graph.stage_nodes(adapters.lineage_stages(spark, sf_dir)))


@query
def dag_neighbours(spark, sf_dir):
    return graph.chain_listing(_nodes(spark, sf_dir))


@query
def dag_parents(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return graph.parents_of(nodes, graph.chain_edges(nodes))


@query
def dag_children(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return graph.children_of(nodes, graph.chain_edges(nodes))


def _seeds(nodes: DataFrame) -> DataFrame:
    causes = rootcause.chain_root_causes(nodes)
    return causes.select("app_id", F.col("root_cause_stage_id").alias("seed_stage_id"))


@query
def dag_ancestors(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return graph.chain_ancestors(nodes, _seeds(nodes), graph.chain_shape(nodes))


@query
def dag_descendants(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return graph.chain_descendants(nodes, _seeds(nodes), graph.chain_shape(nodes))


def _lineage_seeds(nodes: DataFrame, pick: Column) -> DataFrame:
    return nodes.groupBy("app_id").agg(pick.alias("seed_stage_id"))


@query
def lineage_ancestors(spark, sf_dir):
    nodes = graph.stage_nodes(adapters.lineage_stages(spark, sf_dir))
    seeds = _lineage_seeds(nodes, F.max("stage_id"))
    return lineage.lineage_ancestors(lineage.lineage_edges(nodes), seeds)


@query
def lineage_descendants(spark, sf_dir):
    nodes = graph.stage_nodes(adapters.lineage_stages(spark, sf_dir))
    seeds = _lineage_seeds(nodes, F.min("stage_id"))
    return lineage.lineage_descendants(lineage.lineage_edges(nodes), seeds)


# ---------------------------------------------------------------- features


@query
def app_features(spark, sf_dir):
    return _round_all(_features(spark, sf_dir))


@query
def app_features_joined_labels(spark, sf_dir):
    """Labels from a table of their own, which knows half of the applications."""
    tasks, stages = adapters.tasks(spark, sf_dir), adapters.stages(spark, sf_dir)
    truth = adapters.known_labels(spark, sf_dir)
    return _round_all(features.app_features(tasks, stages, ground_truth=truth))


@query
def feature_stats(spark, sf_dir):
    return _round_all(features.feature_stats(_features(spark, sf_dir)), 3)


@query
def ground_truth(spark, sf_dir):
    return features.named_ground_truth(features.ground_truth(adapters.tasks(spark, sf_dir)))


@query
def label_distribution(spark, sf_dir):
    return features.label_distribution(features.ground_truth(adapters.tasks(spark, sf_dir)))


# ---------------------------------------------------------------- event logs


@query
def parse_task_events(spark, sf_dir):
    return eventlog.parse_task_events(adapters.log_lines(spark, sf_dir))


@query
def parse_stage_events(spark, sf_dir):
    return eventlog.parse_stage_events(adapters.log_lines(spark, sf_dir))


@query
def parse_both_kinds(spark, sf_dir):
    events = eventlog.parse_events(adapters.log_lines(spark, sf_dir))
    return events.groupBy("app_id", "label", "kind").agg(
        F.count("*").alias("events"),
        F.sum(F.coalesce("task.executor_run_time", F.lit(0))).alias("run_time"),
        F.sum(F.coalesce("stage.num_tasks", F.lit(0))).alias("stage_tasks"),
    )


@query
def parse_malformed(spark, sf_dir):
    """Lines in, rows out and defaulted fields per application."""
    lines = adapters.task_lines(spark, sf_dir)
    seen = lines.groupBy("app_id").agg(F.count("*").alias("lines"))
    parsed = eventlog.parse_task_events(lines).groupBy("app_id").agg(
        F.count("*").alias("parsed"),
        F.count_if(F.col("executor_run_time") == 0).alias("without_metrics"),
        F.sum("jvm_gc_time").alias("gc_time"),
    )
    return seen.join(parsed, "app_id", "left").na.fill(0)


@query
def label_from_path(spark, sf_dir):
    paths = eventlog.with_path_labels(adapters.log_paths(spark, sf_dir), "log_path")
    return paths.groupBy("app_id", "label").agg(F.count("*").alias("files"))


# ---------------------------------------------------------------- workload


def _workload(spark, sf_dir, fn, names: str, **params) -> DataFrame:
    return _compared(fn(*_tables(spark, sf_dir, *names.split()), **params))


#: Decimal places in which sums are compared, by column; sums of doubles differ in their last
#: digits with the order of the rows.
PLACES = {
    "revenue": 4,
    "sum_disc_price": 4,
    "sum_charge": 3,
    "avg_disc": 9,
} | dict.fromkeys(
    "sum_qty sum_base_price sum_slow_qty total total_price total_spent total_qty total_tax".split(),
    2,
)


def _compared(df: DataFrame) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c), n) for c, n in PLACES.items() if c in df.columns})


def _dates_as_text(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.date_format(column, "yyyy-MM-dd"))


@query
def q_shipping_priority(spark, sf_dir):
    top = _workload(
        spark,
        sf_dir,
        workload.shipping_priority,
        "customer orders lineitem",
        cutoff="1998-03-15",
        extra_keys=(),
    )
    return _dates_as_text(top, "o_orderdate")


@query
def q_order_priority(spark, sf_dir):
    return _workload(
        spark,
        sf_dir,
        workload.order_priority,
        "orders lineitem",
        start="1996-07-01",
        end="1996-10-01",
        late=F.col("l_returnflag") == "R",
    )


@query
def q_returned_items(spark, sf_dir):
    return _workload(
        spark,
        sf_dir,
        workload.returned_items,
        "customer orders lineitem nation",
        start="1996-10-01",
        end="1997-01-01",
    )


@query
def q_returned_items_top20(spark, sf_dir):
    return _workload(
        spark,
        sf_dir,
        workload.returned_items,
        "customer orders lineitem nation",
        start="1996-10-01",
        end="1997-01-01",
        by_customer_only=True,
        k=20,
    )


@query
def q_ship_mode(spark, sf_dir):
    shipped = (F.col("l_shipdate") >= "1996-01-01") & (F.col("l_shipdate") < "1997-01-01")
    return _workload(
        spark,
        sf_dir,
        workload.ship_mode,
        "lineitem orders",
        mode_col="l_returnflag",
        modes=("R", "A"),
        line_filter=shipped,
        joined_filter=F.col("l_shipdate") > F.col("o_orderdate"),
        joined_cols=("l_shipdate",),
    )


@query
def q_pricing_summary(spark, sf_dir):
    return _workload(
        spark, sf_dir, workload.pricing_summary, "lineitem", with_double_qty=True
    )


@query
def q_broadcast_part_profit(spark, sf_dir):
    return _workload(
        spark,
        sf_dir,
        workload.part_profit,
        "part lineitem supplier orders nation",
        name_part="red",
    )


@query
def q_broadcast_orders(spark, sf_dir):
    return _workload(
        spark, sf_dir, workload.orders_by_nation, "lineitem orders supplier nation"
    )


@query
def q_broadcast_partsupp(spark, sf_dir):
    lineitem, orders = _tables(spark, sf_dir, "lineitem", "orders")
    return workload.partsupp_status(lineitem, adapters.partsupp(spark, sf_dir), orders)


@query
def q_large_volume(spark, sf_dir):
    top = _workload(spark, sf_dir, workload.large_volume, "customer orders lineitem")
    return _dates_as_text(top, "o_orderdate")


@query
def q_heavy_segment_priority(spark, sf_dir):
    return _workload(spark, sf_dir, workload.segment_priority, "lineitem orders customer")


@query
def q_heavy_nation_status(spark, sf_dir):
    return _workload(
        spark, sf_dir, workload.nation_status, "lineitem orders supplier nation"
    )


@query
def q_heavy_customer_spend(spark, sf_dir):
    return _workload(spark, sf_dir, workload.customer_spend, "customer orders lineitem")


@query
def q_customer_totals(spark, sf_dir):
    return _workload(spark, sf_dir, workload.customer_totals, "orders lineitem customer")


@query
def q_customer_supplier(spark, sf_dir):
    return _workload(
        spark, sf_dir, workload.customer_supplier, "orders lineitem customer supplier"
    )


@query
def q_min_cost_supplier(spark, sf_dir):
    part, supplier, nation, region = _tables(
        spark, sf_dir, "part", "supplier", "nation", "region"
    )
    return workload.supplier_listing(
        part,
        adapters.partsupp(spark, sf_dir),
        supplier,
        nation,
        region,
        type_end="O",
        part_cols=(),
    )


def _skewed_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem plus one line per order that all share order key 1."""
    lineitem, orders = _tables(spark, sf_dir, "lineitem", "orders")
    values = {
        "l_orderkey": F.lit(1),
        "l_partkey": F.lit(1),
        "l_suppkey": F.lit(1),
        "l_linenumber": F.lit(1),
        "l_quantity": F.lit(50.0),
        "l_extendedprice": F.lit(1000.0),
        "l_discount": F.lit(0.05),
        "l_tax": F.lit(0.08),
        "l_returnflag": F.lit("N"),
        "l_linestatus": F.lit("O"),
        "l_shipdate": F.lit("2024-01-01"),
    }
    return workload.with_skewed_rows(lineitem, workload.skewed_rows(lineitem, orders, values))


@query
def union_synthetic_rows(spark, sf_dir):
    rows = _skewed_lineitem(spark, sf_dir)
    return _compared(workload.pricing_summary(rows, cutoff="2024-12-31"))


@query
def q_large_volume_skewed(spark, sf_dir):
    customer, orders = _tables(spark, sf_dir, "customer", "orders")
    top = workload.large_volume(
        customer, orders, _skewed_lineitem(spark, sf_dir), threshold=300
    )
    return _dates_as_text(_compared(top), "o_orderdate")


@query
def join_key_skew(spark, sf_dir):
    share = workload.join_key_skew(_skewed_lineitem(spark, sf_dir), "l_orderkey")
    return share.withColumn("hottest_share", rounded(F.col("hottest_share"), 9))


@query
def q_hot_key_join(spark, sf_dir):
    """Lines, quantity and orders by priority, over lines of which a fifth share one order."""
    orders = adapters.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    lines = _skewed_lineitem(spark, sf_dir).select("l_orderkey", "l_quantity")
    joined = skew.hot_key_join(lines, orders, {"l_orderkey": "o_orderkey"})
    totals = joined.groupBy("o_orderpriority").agg(
        F.count("*").alias("line_count"),
        F.sum("l_quantity").alias("total_qty"),
        F.count_distinct("o_orderkey").alias("order_count"),
    )
    return _round_all(totals)


@query
def range_category_agg(spark, sf_dir):
    (orders,) = _tables(spark, sf_dir, "orders")
    price = F.col("o_totalprice")
    return _compared(workload.category_totals(orders, "o_orderkey", price, 7))


def _pairs_compared(df: DataFrame) -> DataFrame:
    """The count as bigint; the sum, of some 1e13, in millions, so that digits doubles can hold
    are compared."""
    millions = rounded(F.col("total_price") / 1e6, 4)
    return df.withColumns(
        {"total_rows": F.col("total_rows").cast("bigint"), "total_price": millions}
    )


@query
def cross_join_summary(spark, sf_dir):
    (orders,) = _tables(spark, sf_dir, "orders")
    return _pairs_compared(workload.cross_totals(orders, orders, "o_totalprice"))


@query
def cross_join_pairs(spark, sf_dir):
    lineitem, customer = _tables(spark, sf_dir, "lineitem", "customer")
    return _pairs_compared(workload.cross_totals(lineitem, customer, "l_extendedprice"))


# ---------------------------------------------------------------- manifest, lookups


@query
def pending_runs(spark, sf_dir):
    return manifest.pending_runs(
        adapters.planned_runs(spark, sf_dir), adapters.manifest(spark, sf_dir)
    )


@query
def run_summary(spark, sf_dir):
    return manifest.run_summary(adapters.manifest(spark, sf_dir))


@query
def scenario_lookup(spark, sf_dir):
    """Scenario of each application by label, and again by its name in mixed case."""
    apps = features.ground_truth(adapters.tasks(spark, sf_dir))
    named = scenarios_by_label(apps).select(
        "app_id", "label", F.initcap("name").alias("asked_name")
    )
    return scenarios_by_name(named, "asked_name").select(
        named["app_id"], named["label"], "asked_name", "name", "tpch_query", "injection_method"
    )


@query
def scenario_names(spark, sf_dir):
    """Scenario names of order sizes as class ids, unknown ids included."""
    (lineitem,) = _tables(spark, sf_dir, "lineitem")
    counted = lineitem.groupBy(F.col("l_linenumber").alias("label")).agg(
        F.count("*").alias("lines")
    )
    return counted.select("label", scenario_name(F.col("label")).alias("label_name"), "lines")


@query
def format_bytes(spark, sf_dir):
    """Byte totals per application as text, from a few bytes to gigabytes."""
    totals = adapters.tasks(spark, sf_dir).groupBy("app_id").agg(
        F.sum("shuffle_fetch_wait_time").alias("wait"),
        F.sum("shuffle_bytes_read").alias("read"),
        F.sum("memory_bytes_spilled").alias("spilled"),
        F.sum("peak_execution_memory").alias("peak"),
    )
    return totals.select(
        "app_id",
        *[
            scalars.format_bytes(F.col(c)).alias(f"{c}_text")
            for c in ("wait", "read", "spilled", "peak")
        ],
    )


@query
def table_summary(spark, sf_dir):
    return lake.table_summary(spark, sf_dir, ".parquet").select(
        "table_name", "found", "row_count"
    )


# ---------------------------------------------------------------- evaluation


@query
def confusion_matrix(spark, sf_dir):
    return evaluation.confusion_matrix(adapters.predictions(spark, sf_dir))


@query
def per_class_accuracy(spark, sf_dir):
    return _round_all(evaluation.per_class_accuracy(adapters.predictions(spark, sf_dir)))


@query
def eval_metrics(spark, sf_dir):
    return _round_all(evaluation.eval_metrics(adapters.predictions(spark, sf_dir)))


@query
def prediction_table(spark, sf_dir):
    return evaluation.prediction_table(adapters.predictions(spark, sf_dir))


@query
def stratified_split(spark, sf_dir):
    apps = features.ground_truth(adapters.tasks(spark, sf_dir))
    return split.stratified_split(apps)


@query
def scaled_features(spark, sf_dir):
    scaled = models.scaled_features(_features(spark, sf_dir))
    shown = [
        rounded(F.col("scaled")[i]).alias(c) for i, c in enumerate(features.FEATURE_COLUMNS)
    ]
    return scaled.select("app_id", "label", *shown)


# ---------------------------------------------------------------- models


def _split_features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = sizing.cut_lineage(models.fill_features(split.stratified_split(_features(spark, sf_dir))))
    kept = F.col("is_train")
    return rows.filter(kept).drop("is_train"), rows.filter(~kept).drop("is_train")


def _predicted(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    train, test = _split_features(spark, sf_dir)
    model = models.fit(train, models.classifiers()[name])
    return evaluation.prediction_table(models.score(model, test))


@query
def ml_random_forest(spark, sf_dir):
    return _predicted(spark, sf_dir, models.RANDOM_FOREST)


@query
def ml_decision_tree(spark, sf_dir):
    return _predicted(spark, sf_dir, models.DECISION_TREE)


@query
def ml_logistic(spark, sf_dir):
    return _predicted(spark, sf_dir, models.LOGISTIC_REGRESSION)


@query
def ml_feature_importance(spark, sf_dir):
    train, _ = _split_features(spark, sf_dir)
    model = models.fit(train, models.classifiers()[models.RANDOM_FOREST])
    return models.feature_importance(model, train)


@query
def ml_model_comparison(spark, sf_dir):
    train, test = _split_features(spark, sf_dir)
    fitted = {name: models.fit(train, c) for name, c in models.classifiers().items()}
    return models.compare({name: models.measure(m, test) for name, m in fitted.items()})


@query
def ml_scored_rows(spark, sf_dir):
    """Test rows that each fitted model scores, by class, and the sum of their probabilities."""
    train, test = _split_features(spark, sf_dir)
    scored = None
    for name, classifier in models.classifiers().items():
        rows = models.score(models.fit(train, classifier), test).select(
            F.lit(name).alias("model"), "label", vector_to_array("probability").alias("p")
        )
        scored = rows if scored is None else scored.unionByName(rows)
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    return scored.groupBy("model", "label").agg(
        F.count("*").alias("rows"), rounded(F.sum(total)).alias("probability_sum")
    )


@query
def ml_importance_total(spark, sf_dir):
    """Features that the fitted forest names, and the sum of their importances."""
    importance = ml_feature_importance(spark, sf_dir)
    return importance.agg(
        F.count_distinct("feature").alias("features"),
        rounded(F.sum("importance")).alias("importance"),
    )


@query
def ml_cross_validation(spark, sf_dir):
    rows = models.fill_features(_features(spark, sf_dir)).cache()
    mean_f1 = models.cross_validate(rows)
    return rows.agg(F.count("*").alias("rows")).withColumn("mean_f1", F.lit(mean_f1))


@query
def ml_cross_validation_folds(spark, sf_dir):
    """Applications of each fold and class that its model judged, and whether the mean over the
    folds of F1 from the confusion counts is the one that the validator tells."""
    number = F.conv(F.substring(F.md5(F.col("app_id").cast("binary")), 1, 8), 16, 10).cast("long")
    fold = (number % models.FOLDS).cast("int")
    rows = models.fill_features(_features(spark, sf_dir)).withColumn("fold", fold)
    counts, mean_f1 = models.cross_validated_folds(sizing.cut_lineage(rows), "fold")
    counts = sizing.cut_lineage(counts)
    mean = models.weighted_f1(counts, "fold").agg(F.avg("f1")).scalar()
    judged = counts.groupBy("fold", "label").agg(F.sum("rows").alias("rows"))
    return judged.withColumn("f1_agrees", F.abs(mean - F.lit(mean_f1)) < 1e-9)


@query
def ml_holdout_report(spark, sf_dir):
    """A tenth of the applications is held out before the split; the forest, fitted on the training
    rows and measured on the test rows, is saved, loaded and measured on what neither has seen."""
    rows = models.fill_features(_features(spark, sf_dir))
    unseen = F.pmod(F.crc32(F.col("app_id").cast("binary")), F.lit(10)) == 0
    known = sizing.cut_lineage(split.stratified_split(rows.filter(~unseen)))
    train, test = known.filter("is_train"), known.filter("NOT is_train")
    model = models.fit(train, models.classifiers()[models.RANDOM_FOREST])
    loaded = models.saved_and_loaded(model, sizing.shared_folder(spark))
    return models.holdout_report(
        models.measure(model, test), models.measure(loaded, rows.filter(unseen))
    )


def _saved(spark: SparkSession, train: DataFrame, name: str):
    """A model of the name that was fitted, saved and loaded, and where it lies."""
    path = sizing.shared_folder(spark)
    model = models.fit(train, models.classifiers()[name])
    return models.saved_and_loaded(model, path), path


@query
def ml_tree_audit(spark, sf_dir):
    """The saved decision tree, its training rows routed through its nodes again: rows at the root
    and at all leaves, impurity of the root, and nodes whose count, impurity or gain differs."""
    train, _ = _split_features(spark, sf_dir)
    model, path = _saved(spark, train, models.DECISION_TREE)
    rows = model.transform(train).select("label", vector_to_array("features").alias("scaled"))
    nodes = trees.saved_nodes(spark, model, path)
    told = trees.audit(rows, nodes, models.TREE_DEPTH)
    far = F.abs(F.col("impurity") - F.col("fitted_impurity")) > 1e-9
    off = F.abs(F.col("gain") - F.col("fitted_gain")) > 1e-9
    wrong = (F.col("rows") != F.col("fitted_rows")) | far | F.coalesce(off, F.lit(False))
    return told.agg(
        F.max(F.when(F.col("id") == 0, F.col("rows"))).alias("root_rows"),
        F.sum(F.when(F.col("is_leaf"), F.col("rows"))).alias("leaf_rows"),
        rounded(F.max(F.when(F.col("id") == 0, F.col("impurity")))).alias("root_impurity"),
        F.count_if(wrong).alias("wrong_nodes"),
        (F.count_if("is_leaf") - F.count_if(~F.col("is_leaf"))).alias("leaves_beyond_splits"),
    )


@query
def ml_importance_of_nodes(spark, sf_dir):
    """Each feature, and whether the sum over the saved forest's nodes is its importance."""
    train, _ = _split_features(spark, sf_dir)
    model, path = _saved(spark, train, models.RANDOM_FOREST)
    summed = trees.importances(trees.saved_nodes(spark, model, path))
    told = models.feature_importance(model, train).withColumnRenamed("importance", "told")
    same = F.abs(F.col("importance") - F.col("told")) < 1e-9
    return summed.join(told, "feature").select("feature", same.alias("agrees"))


@query
def ml_logistic_slope(spark, sf_dir):
    """Training rows of each class, and whether the fitted loss is flat by its coefficients."""
    train, _ = _split_features(spark, sf_dir)
    model = models.fit(train, models.classifiers()[models.LOGISTIC_REGRESSION])
    steep = models.slope(model, train).withColumnRenamed("class", "label")
    counts = train.groupBy("label").agg(F.count("*").alias("rows"))
    return counts.join(steep, "label").select("label", "rows", (F.col("steepest") < 1e-3).alias("flat"))


@query
def ml_saved_parameters(spark, sf_dir):
    """Settings of the decision tree and the regression as they come back from a saved model."""
    train, _ = _split_features(spark, sf_dir)
    kept = None
    for name in (models.DECISION_TREE, models.LOGISTIC_REGRESSION):
        loaded, _ = _saved(spark, train, name)
        rows = models.parameters(loaded, spark).select(F.lit(name).alias("model"), "*")
        kept = rows if kept is None else kept.unionByName(rows)
    return kept
