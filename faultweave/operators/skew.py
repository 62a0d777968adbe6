"""Joins whose keys are skewed on one side.

Keys that fill more than an average task are found by a sketch of bounded size, whose parts merge
across tasks, and only these are salted. It needs no run-time statistics, so it also serves where
adaptive skew joins cannot split: below an aggregate on other keys, or beside a bucketed table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts that a key which fills an average task is cut into.
PARTS = 4
#: Counters of the sketch for each task behind the shuffle. The sketch is wrong by at most 3.5
#: rows in so many, so each key that fills a task is found.
COUNTERS = 16


def _key(columns: list[str]) -> Column:
    return F.xxhash64(*columns)


def _given(columns: list[str]) -> Column:
    """Whether the row can match at all."""
    given = F.lit(True)
    for name in columns:
        given &= F.col(name).isNotNull()
    return given


def hot_keys(df: DataFrame, columns: list[str], tasks: int) -> DataFrame:
    """(hot, rows, salts) of the keys that hold more than 1 in `tasks` rows: the hash of the key,
    about how many rows it has, and the number of parts to cut it into.

    At most `tasks` rows, however many keys there are. Keys with a null are left out; rows of no
    keys give no rows. Keys of equal hash count as one, which cuts them finer than needed.
    """
    given = df.where(_given(columns)).select(_key(columns).alias("hot"))
    counters = max(1024, COUNTERS * tasks)
    found = given.agg(
        F.count("*").alias("all_rows"),
        F.expr(f"approx_top_k(hot, {tasks}, {counters})").alias("top"),
    )
    share = F.col("count") * tasks / F.col("all_rows")
    return (
        found.select("all_rows", F.inline("top"))
        .where(share > 1)
        .select(
            F.col("item").alias("hot"),
            F.col("count").alias("rows"),
            F.ceil(share * PARTS).cast("int").alias("salts"),
        )
    )


def hot_key_join(
    rows: DataFrame,
    other: DataFrame,
    keys: dict[str, str],
    how: str = "inner",
    tasks: int | None = None,
) -> DataFrame:
    """`rows` joined to `other` where rows.key = other.value for all `keys`, skew of `rows` evened.

    Rows of a hot key are dealt to its salts and the matching rows of `other` are repeated once a
    salt; other keys are joined as they are. Over all keys that adds at most PARTS * tasks copies
    of a row of `other` with a unique key. `how` is inner, left, left_semi or left_anti: each row
    of `rows` meets all its partners in one place. Columns are those of both sides (of `rows` for
    semi and anti joins); names must differ, and types of joined keys must be equal. Null keys match
    nothing, repeated rows are kept.

    A row's salt follows from its values and its partition, not from its place there, so a task
    that runs again deals it alike. `tasks` is the number of tasks behind the shuffle, by default
    spark.sql.shuffle.partitions. The list of hot keys is broadcast: at most `tasks` rows.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"cannot salt the left side of a join of type {how}")
    if tasks is None:
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = list(keys), list(keys.values())
    if [rows.schema[a].dataType for a in left] != [other.schema[b].dataType for b in right]:
        raise ValueError("keys of different types have different hashes; cast them first")
    hot = F.broadcast(hot_keys(rows, left, tasks).select("hot", "salts"))

    values = [c for c, kind in rows.dtypes if not kind.startswith(("map", "variant"))]
    dealt = F.pmod(F.xxhash64(*values, F.spark_partition_id()), F.col("salts"))
    salted = (
        rows.withColumn("_key", F.when(_given(left), _key(left)))
        .join(hot, F.col("_key") == F.col("hot"), "left")
        .withColumn("_salt", F.coalesce(dealt, F.lit(0)).cast("int"))
        .drop("_key", "hot", "salts")
    )
    upto = F.coalesce(F.col("salts"), F.lit(1)) - 1
    copies = (
        other.where(_given(right))
        .withColumn("_other_key", _key(right))
        .join(hot, F.col("_other_key") == F.col("hot"), "left")
        .withColumn("_other_salt", F.explode(F.sequence(F.lit(0), upto)))
        .drop("_other_key", "hot", "salts")
    )
    matched = F.col("_salt") == F.col("_other_salt")
    for a, b in keys.items():
        matched &= F.col(a) == F.col(b)
    return salted.join(copies, matched, how).drop("_salt", "_other_salt")
