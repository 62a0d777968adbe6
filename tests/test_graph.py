from __future__ import annotations

import random

import pytest

from faultweave.operators import graph

SCHEMA = """app_id string, stage_id int, stage_attempt_id int, completion_time bigint,
    stage_name string, status string, failure_reason string"""


@pytest.fixture(scope="module")
def ids():
    rng = random.Random(3)
    return {f"a{i}": sorted(rng.sample(range(40), rng.randint(1, 20))) for i in range(40)}


@pytest.fixture(scope="module")
def nodes(spark, ids):
    rows = [(app, i, 0, 0, f"s{i}", "COMPLETED", None) for app in ids for i in ids[app]]
    return graph.stage_nodes(spark.createDataFrame(rows, SCHEMA)).cache()


@pytest.mark.parametrize("chunk", [1, 4, 4096])
def test_edges(nodes, ids, chunk):
    edges = graph.chain_edges(nodes, chunk).collect()
    got = {(r.app_id, r.stage_id): r.parent_stage_id for r in edges}
    want = {(app, i): p for app in ids for i, p in zip(ids[app], [-1, *ids[app]])}
    assert got == want


@pytest.mark.parametrize("chunk", [1, 4, 4096])
def test_neighbours(nodes, ids, chunk):
    got = {(r.app_id, r.stage_id): r for r in graph.chain_listing(nodes, chunk).collect()}
    for app, chain in ids.items():
        for at, i in enumerate(chain):
            row = got[app, i]
            assert row.parents == (str(chain[at - 1]) if at else "none")
            assert row.children == (str(chain[at + 1]) if at + 1 < len(chain) else "none")


@pytest.mark.parametrize("chunk", [2, 4096])
def test_ancestors_and_descendants(spark, nodes, ids, chunk):
    pairs = [(app, i) for app in ids for i in ids[app][:: 3]]
    seeds = spark.createDataFrame(pairs, "app_id string, seed_stage_id int")
    shape = graph.chain_shape(nodes)
    up = {tuple(r) for r in graph.chain_ancestors(nodes, seeds, shape, chunk).collect()}
    down = {tuple(r) for r in graph.chain_descendants(nodes, seeds, shape, chunk).collect()}
    assert up == {(app, s, i) for app, s in pairs for i in ids[app] if i < s}
    assert down == {(app, s, i) for app, s in pairs for i in ids[app] if i > s}


def test_latest_attempt_wins(spark):
    rows = [
        ("a", 1, 0, 5, "first", "FAILED", "lost"),
        ("a", 1, 1, 9, "second", "COMPLETED", None),
        ("a", 2, 0, 7, None, None, None),
    ]
    nodes = graph.stage_nodes(spark.createDataFrame(rows, SCHEMA)).orderBy("stage_id")
    got = [tuple(r) for r in nodes.collect()]
    assert got == [("a", 1, "second", "COMPLETED", None), ("a", 2, "", "UNKNOWN", None)]


def test_shape(nodes, ids):
    for r in graph.chain_shape(nodes).collect():
        chain = ids[r.app_id]
        assert (r.root_stage_id, r.leaf_stage_id, r.depth) == (chain[0], chain[-1], len(chain))


def test_icons(spark):
    rows = [(s,) for s in ("COMPLETED", "FAILED", "SKIPPED", "UNKNOWN")]
    df = spark.createDataFrame(rows, "status string")
    got = [r[0] for r in df.select(graph.status_icon(df["status"])).collect()]
    assert got == ["✓", "✗", "○", "?"]


def test_abort_words(spark):
    reasons = [None, "Stage was Cancelled", "Job aborted", "x"]
    rows = list(zip(["SKIPPED", "FAILED", "FAILED", "FAILED"], reasons))
    df = spark.createDataFrame(rows, "s string, r string")
    loose = [r[0] for r in df.select(graph.is_logical_abort(df["s"], df["r"])).collect()]
    strict = [r[0] for r in df.select(graph.is_logical_abort(df["s"], df["r"], True)).collect()]
    assert (loose, strict) == ([True, True, True, False], [True, True, False, False])
