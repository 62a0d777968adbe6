"""The named queries of the operators, over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from faultweave.llm import (
    op01_quality_rules,
    op10_ngram_join,
    op12_collocations,
    op13_prefix_trie,
)
from faultweave.llm.op01_quality_rules import quality_rules
from faultweave.llm.op02_token_counts import token_counts
from faultweave.llm.op03_pii import pii_spans
from faultweave.llm.op04_packing import pack
from faultweave.llm.op05_toxicity import toxicity
from faultweave.llm.op06_decontamination import contaminated
from faultweave.llm.op07_suffix_dedup import remove_repeats
from faultweave.llm.op08_language_id import language_id
from faultweave.llm.op09_license_scan import license_scan
from faultweave.llm.op10_ngram_join import ngram_jaccard_join
from faultweave.llm.op11_best_fit import best_fit
from faultweave.llm.op12_collocations import collocations
from faultweave.llm.op13_prefix_trie import prefix_trie
from faultweave.llm.shared import documents

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), TOKENIZER)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), TOKENIZER, length=1024)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(documents(spark, sf_dir), labels)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contaminated(documents(spark, sf_dir), items)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), length=50)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(documents(spark, sf_dir), k=4, percent=85)


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(documents(spark, sf_dir), WORD_TOKENIZER, length=4096)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir), least=100, top=2000)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_token_counts": op2_token_counts,
    "op3_pii": op3_pii,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_decontamination": op6_decontamination,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_language_id": op8_language_id,
    "op9_license_scan": op9_license_scan,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLES = {
    "op1_quality_rules": op01_quality_rules.ORACLE,
    "op10_ngram_jaccard_join": op10_ngram_join.ORACLE,
    "op12_phrase_collocations": op12_collocations.ORACLE,
    "op13_conversation_trie": op13_prefix_trie.ORACLE,
}
