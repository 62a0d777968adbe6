"""Empty tables, odd rows and clashing columns for every operator; the queries and the pipeline."""

from __future__ import annotations

import sys
from collections import Counter

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from faultweave.llm.components import components
from faultweave.llm.op01_quality_rules import quality_filter, quality_rules
from faultweave.llm.op02_token_counts import token_counts
from faultweave.llm.op03_pii import pii_spans, redacted
from faultweave.llm.op04_packing import pack
from faultweave.llm.op05_toxicity import toxicity
from faultweave.llm.op06_decontamination import contaminated
from faultweave.llm.op07_suffix_dedup import remove_repeats
from faultweave.llm.op08_language_id import language_id
from faultweave.llm.op09_license_scan import license_scan
from faultweave.llm.op10_ngram_join import ngram_jaccard_join
from faultweave.llm.queries import ORACLES, QUERIES

from .conftest import TOKENIZER, texts


def _labels(docs):
    return docs.selectExpr("doc_id", "int(doc_id % 2) AS toxic")


def _items(docs):
    return docs.selectExpr("doc_id AS item_id", "text")


#: Operators that return one row for each row of docs.
BY_ROW = {
    "quality_rules": quality_rules,
    "pii_spans": pii_spans,
    "redacted": redacted,
    "toxicity": lambda d: toxicity(d, _labels(d)),
    "remove_repeats": remove_repeats,
    "language_id": language_id,
    "license_scan": license_scan,
    "ngram_jaccard_join": ngram_jaccard_join,
}
OTHERS = {
    "quality_filter": quality_filter,
    "token_counts": lambda d: token_counts(d, TOKENIZER),
    "pack": lambda d: pack(d, TOKENIZER),
    "contaminated": lambda d: contaminated(d, _items(d)),
}


@pytest.mark.parametrize("name", BY_ROW | OTHERS)
def test_no_rows_give_no_rows(none, name):
    assert (BY_ROW | OTHERS)[name](none).collect() == []


@pytest.mark.parametrize("name", BY_ROW)
def test_every_row_comes_out(odd, name):
    ids = Counter(r["doc_id"] for r in BY_ROW[name](odd).collect())
    assert ids == Counter(k for k, _ in texts())


@pytest.mark.parametrize("name", OTHERS)
def test_odd_rows_pass(odd, name):
    assert OTHERS[name](odd).collect()


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_stages_keep_columns(spark, odd, none, sf_dir, stage):
    for docs in (odd, none):
        out = stage[1](spark, docs, sf_dir)
        assert out.schema.simpleString() == docs.schema.simpleString()
        out.collect()


def test_near_duplicates_leave_one_of_each_group(spark, odd, sf_dir):
    kept = corpus_pipeline.near_duplicates(spark, odd, sf_dir)
    joined = {r["doc_id"]: r["component_id"] for r in ngram_jaccard_join(odd).collect()}
    want = {k for k, c in joined.items() if k == c or k is None}
    assert {r["doc_id"] for r in kept.collect()} == want


def test_near_duplicates_leave_one_of_repeated_rows(spark, sf_dir):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (1, long), (2, long), (3, "own text of three"), (3, "own text of three")]
    rows += [(3, "second text of three"), (None, long), (None, long), (None, "no id"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()
    want = Counter(dict.fromkeys(rows, 1))
    del want[2, long]
    assert Counter(map(tuple, kept)) == want


def test_components_of_a_path(spark):
    links = spark.range(200).selectExpr("id AS a", "id + 1 AS b").where("a <> 99")
    links = links.union(spark.createDataFrame([(5, 5), (None, 3)], "a long, b long"))
    out = {r["node"]: r["component"] for r in components(links).collect()}
    assert out == {i: 0 if i < 100 else 100 for i in range(201)}


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(r[i] for i in order) for r in rows)


@pytest.mark.parametrize("name", ORACLES)
def test_queries_match_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS FROM read_parquet('{sf_dir}/{table}.parquet')")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got.columns, got.collect()) == _rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", QUERIES)
def test_queries_run(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_pipeline_packs_what_its_stages_keep(spark, sf_dir):
    packed = corpus_pipeline.run(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    assert {r[0] for r in packed.select("doc_id").collect()} == {
        r[0] for r in docs.select("doc_id").collect()
    }


def test_entry_lists_the_queries():
    known = __spark_entry__.queries()
    assert set(QUERIES) | {"pipeline"} <= set(known)
    assert {f"op{n}_" for n in range(1, 11)} <= {k.split("_")[0] + "_" for k in known}
    assert set(__spark_entry__.oracle_sql()) <= set(known)
    assert "faultweave.llm" in sys.modules
