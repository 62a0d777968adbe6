"""Salted joins: same rows as a plain join, even tasks, hot keys from a bounded sketch."""

from __future__ import annotations

from collections import Counter
from statistics import median

import pytest
from pyspark.sql import functions as F

from faultweave.operators.skew import hot_key_join, hot_keys

TASKS = 16


@pytest.fixture(scope="module")
def lines(spark):
    """A third of 60,000 rows have key 7, a tenth key 8; all rows of key 7 are alike."""
    kind = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 10 == 1, 8)
    return spark.range(0, 60_000, 1, 64).select(
        F.coalesce(kind, F.pmod(F.xxhash64("id"), F.lit(5000)) + 10).cast("long").alias("k"),
        F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.col("id").cast("string")).alias("v"),
    )


@pytest.fixture(scope="module")
def orders(spark):
    return spark.range(0, 5010).selectExpr("id AS o", "'order ' || id AS name")


@pytest.fixture
def plain_shuffles(spark):
    """Neither adaptive execution nor broadcasts of the sides."""
    settings = {
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": str(TASKS),
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_hot_keys(lines):
    counts = Counter(r.k for r in lines.select("k").collect())
    hashes = lines.select("k", F.xxhash64("k").alias("h")).distinct().collect()
    key = {r.h: r.k for r in hashes}
    found = {key[r.hot]: r for r in hot_keys(lines, ["k"], TASKS).collect()}
    assert set(found) == {k for k, n in counts.items() if n > 60_000 / TASKS} == {7, 8}
    for k, row in found.items():
        assert row.rows == pytest.approx(counts[k], rel=0.05)
        assert row.salts == -(-4 * row.rows * TASKS // 60_000)


def test_hot_keys_are_found_among_many(spark):
    """A key of 3 % among half a million others that a bounded sketch cannot hold."""
    many = spark.range(0, 500_000, 1, 20).selectExpr("if(id % 33 = 0, -1L, id) AS k")
    (found,) = hot_keys(many, ["k"], 64).collect()
    assert found.hot == spark.range(1).select(F.xxhash64(F.lit(-1).cast("long"))).first()[0]


def test_no_hot_keys(spark, lines):
    assert hot_keys(lines.where("k is null"), ["k"], TASKS).collect() == []
    assert hot_keys(spark.range(1000).toDF("k"), ["k"], TASKS).collect() == []
    nulls = spark.range(1000).selectExpr("if(id < 900, null, id) AS k")
    assert hot_keys(nulls, ["k"], TASKS).collect() == []


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_same_rows_as_a_plain_join(spark, lines, orders, how):
    odd = spark.createDataFrame([(None, "no key"), (99_999, "no order")], "k long, v string")
    left = lines.unionByName(odd.unionByName(odd))
    right = orders.unionByName(spark.createDataFrame([(None, "null")], "o long, name string"))
    right = right.unionByName(orders.where("o in (7, 20)"))  # keys with two partners
    got = hot_key_join(left, right, {"k": "o"}, how, TASKS)
    want = left.join(right, F.col("k") == F.col("o"), how)
    assert got.columns == want.columns
    assert rows(got) == rows(want)


def test_composite_keys_and_empty_sides(spark, lines, orders):
    left = lines.withColumn("k2", F.col("k") % 3)
    right = orders.withColumn("o2", F.col("o") % 2)
    keys = {"k": "o", "k2": "o2"}
    want = left.join(right, (F.col("k") == F.col("o")) & (F.col("k2") == F.col("o2")))
    assert rows(hot_key_join(left, right, keys)) == rows(want)
    assert hot_key_join(left.limit(0), right, keys).collect() == []
    assert hot_key_join(left, right.limit(0), keys).collect() == []
    with pytest.raises(ValueError):
        hot_key_join(left, right, keys, "right")
    with pytest.raises(ValueError):
        hot_key_join(left.withColumn("k", F.col("k").cast("int")), right, keys)


def test_tasks_are_even(plain_shuffles, lines, orders):
    """Rows that each task behind the join gets, without adaptive execution."""

    def fullest(df):
        by_task = df.groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert len(by_task) == TASKS
        sizes = [r["count"] for r in by_task]
        return max(sizes) / median(sizes)

    assert fullest(lines.join(orders, F.col("k") == F.col("o"))) > 6
    joined = hot_key_join(lines, orders, {"k": "o"})
    assert fullest(joined) <= 3
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan  # the hot keys are found once
