"""Pipe-delimited tables to Parquet, and the tables of a lake."""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultweave.functions.scalars import format_bytes
from faultweave.sources.schemas import TABLES

# Tables that are spread over many files, and the file counts.
LARGE_TABLES = ("lineitem", "orders")
LARGE_PARTITIONS = 200
SMALL_PARTITIONS = 10

# Raw bytes per file, once the fixed file counts would make larger ones.
TARGET_FILE_BYTES = 512 * 1024 * 1024

SUMMARY = "table_name string, found boolean, row_count bigint, bytes bigint, size string"


def read_raw_table(spark: SparkSession, name: str, raw_path: str) -> DataFrame:
    """One `<name>.tbl` file or folder with its declared schema."""
    if name not in TABLES:
        raise ValueError(f"Unknown table: {name}")
    return spark.read.schema(TABLES[name]).csv(f"{raw_path}/{name}.tbl", sep="|", header=False)


def stored_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Total file size below a path, from the file listing; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def lay_out(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """File layout: large tables rebalanced to `partitions`, others merged down to them."""
    if name in LARGE_TABLES:
        return df.repartition(partitions or LARGE_PARTITIONS)
    return df.coalesce(partitions or SMALL_PARTITIONS)


def lay_out_by_size(df: DataFrame, name: str, raw_bytes: int) -> DataFrame:
    """`lay_out`, but with more files where a file would outgrow the target size."""
    wanted = math.ceil(raw_bytes / TARGET_FILE_BYTES)
    if name in LARGE_TABLES:
        return df.repartition(max(wanted, LARGE_PARTITIONS))
    return df.coalesce(max(wanted, SMALL_PARTITIONS))


def write_table(df: DataFrame, path: str, compression: str = "snappy") -> None:
    df.write.mode("overwrite").option("compression", compression).parquet(path)


def convert_table(
    spark: SparkSession,
    name: str,
    raw_path: str,
    lake_path: str,
    partitions: int | None = None,
) -> None:
    """Text to Parquet, laid out by size unless `partitions` is given. Writes."""
    df = read_raw_table(spark, name, raw_path)
    if partitions is None:
        size = stored_bytes(spark, f"{raw_path}/{name}.tbl").first()["bytes"]
        df = lay_out_by_size(df, name, size)
    else:
        df = lay_out(df, name, partitions)
    write_table(df, f"{lake_path}/{name}")


def convert_all(
    spark: SparkSession, raw_path: str, lake_path: str, partitions: int | None = None
) -> dict[str, Exception | None]:
    """Convert every table; a table that fails is reported and the rest go on. Writes."""
    outcome: dict[str, Exception | None] = {}
    for name in TABLES:
        try:
            convert_table(spark, name, raw_path, lake_path, partitions)
            outcome[name] = None
        except Exception as error:  # reported to the caller per table
            outcome[name] = error
    return outcome


def open_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at `path`, None if there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def table_summary(
    spark: SparkSession, lake_path: str, suffix: str = "", names: tuple[str, ...] = tuple(TABLES)
) -> DataFrame:
    """Rows, bytes and size text per table; `found` is false for missing tables.

    Rows are counted from file footers and bytes come from the listing, so no
    data is read.
    """
    rows = None
    for name in sorted(names):
        path = f"{lake_path}/{name}{suffix}"
        df = open_table(spark, path)
        if df is None:
            missing = [(name, False, None, None, "NOT FOUND")]
            one = spark.createDataFrame(missing, SUMMARY)
        else:
            counted = df.agg(F.count("*").alias("row_count"))
            both = counted.unionByName(stored_bytes(spark, path), allowMissingColumns=True)
            sums = both.agg(F.max("row_count").alias("row_count"), F.max("bytes").alias("bytes"))
            one = sums.select(
                F.lit(name).alias("table_name"),
                F.lit(True).alias("found"),
                "row_count",
                "bytes",
                format_bytes(F.col("bytes")).alias("size"),
            )
        rows = one if rows is None else rows.unionByName(one)
    return rows


def register_tables(
    spark: SparkSession, lake_path: str, suffix: str = "", names: tuple[str, ...] = tuple(TABLES)
) -> list[str]:
    """Make a temporary view of every table found; return their names."""
    found = []
    for name in names:
        df = open_table(spark, f"{lake_path}/{name}{suffix}")
        if df is not None:
            df.createOrReplaceTempView(name)
            found.append(name)
    return found
