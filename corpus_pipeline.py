"""A training-data pipeline: filter, join near copies, decontaminate, clean and pack documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs. All but the last return the columns of `documents`.

Rows without doc_id pass the stages that decide by doc_id; rows that repeat a doc_id share its
fate there, but of rows with the same doc_id and text, or without doc_id and with the same text, the
near-duplicate stage leaves one. Null texts fail the quality rules. Further columns of docs are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultweave.llm.op01_quality_rules import quality_filter
from faultweave.llm.op03_pii import redacted
from faultweave.llm.op04_packing import pack
from faultweave.llm.op06_decontamination import contaminated
from faultweave.llm.op10_ngram_join import ngram_jaccard_join
from faultweave.llm.queries import TOKENIZER
from faultweave.llm.shared import documents, saved


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects, neither by themselves nor by their host."""
    return quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 0.85 on 4-word shingles connect: the smallest
    doc_id. One row of each doc_id and text."""
    joined = ngram_jaccard_join(docs, k=4, percent=85)
    return _one_of_each(_without(docs, joined.where("component_id <> doc_id")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, contaminated(docs, items))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and n_chars brought up to date."""
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 1024 tokens."""
    return pack(docs, TOKENIZER, length=1024)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    # Written first, so that the join knows the size of this side and moves no text if it is small.
    gone = saved(gone.select("doc_id").where("doc_id is not null").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def _one_of_each(docs: DataFrame) -> DataFrame:
    # Only rows whose hash occurs again are moved and compared as they are.
    row_hash = F.xxhash64("doc_id", "text")
    again = docs.groupBy(row_hash.alias("hash_of_row")).count().where("count > 1")
    again = saved(again.select("hash_of_row"))
    repeated = docs.join(again, row_hash == F.col("hash_of_row"), "left_semi")
    single = docs.join(again, row_hash == F.col("hash_of_row"), "left_anti")
    return single.unionByName(repeated.dropDuplicates(["doc_id", "text"]))


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii", private_data),
    ("packing", packing),
]

#: Tokenization and expectation-maximisation have no SQL; tests hold the stages against plain
#: Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
