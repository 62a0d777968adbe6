"""Train and test sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRAIN_SHARE = 0.8
SEED = 42

# Hex digits of the hash that form a bucket: 16**4 buckets per class.
BUCKET_DIGITS = 4


def random_split(df: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Plain 80/20 split by row-wise random numbers."""
    train, test = df.randomSplit([TRAIN_SHARE, 1 - TRAIN_SHARE], seed=seed)
    return train, test


def stratified_split(
    df: DataFrame, key: str = "app_id", label: str = "label", train_share: float = TRAIN_SHARE
) -> DataFrame:
    """Add `is_train`: the first `ceil(share * n)` rows of each class by hash of `key`.

    The rank within a class is exact, yet no task ranks a whole class: rows fall
    into 65,536 hash buckets per class, bucket sizes are summed up in order, and
    only the rows of one bucket are ranked against each other.
    """
    hashed = df.withColumns(
        {
            "_class": F.coalesce(F.col(label).cast("string"), F.lit("")),
            "_hash": F.md5(F.col(key).cast("string")),
        }
    ).withColumn("_bucket", F.substring("_hash", 1, BUCKET_DIGITS))
    by_class = Window.partitionBy("_class")
    earlier = by_class.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        hashed.groupBy("_class", "_bucket")
        .agg(F.count("*").alias("_n"))
        .select(
            "_class",
            "_bucket",
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
            F.sum("_n").over(by_class).alias("_total"),
        )
    )
    in_bucket = Window.partitionBy("_class", "_bucket").orderBy("_hash", key)
    rank = F.col("_before") + F.row_number().over(in_bucket)
    quota = F.floor((F.col("_total") * round(train_share * 100) + 99) / 100)
    return (
        hashed.join(buckets, ["_class", "_bucket"])
        .withColumn("is_train", rank <= quota)
        .select(*df.columns, "is_train")
    )
