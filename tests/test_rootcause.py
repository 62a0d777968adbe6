"""Random chains against a literal walk, with chunks small enough to matter."""

from __future__ import annotations

import random

import pytest

from faultweave.operators import graph, rootcause

REASONS = [None, "OOM", "ExecutorLostFailure: lost", "Job was CANCELLED", "Job aborted due to x"]
SCHEMA = """app_id string, stage_id int, stage_attempt_id int, completion_time bigint,
    stage_name string, status string, failure_reason string"""


def random_chain(rng, app):
    ids = sorted(rng.sample(range(60), rng.randint(1, 14)))
    rows = []
    for i in ids:
        status = rng.choices(["FAILED", "COMPLETED", "SKIPPED"], [6, 3, 1])[0]
        reason = rng.choice(REASONS) if status == "FAILED" else None
        rows.append((app, i, 0, 0, f"s{i}", status, reason))
    return rows


def aborted(status, reason, words):
    return status == "SKIPPED" or any(w in (reason or "").lower() for w in words)


def literal_walk(rows, words=("cancelled", "aborted")):
    """Root, reason, path, victims and confidence by walking parents one by one."""
    ids = [r[1] for r in rows]
    by_id = {r[1]: r for r in rows}
    parent = dict(zip(ids[1:], ids))
    failed = [i for i in ids if by_id[i][5] == "FAILED"]
    if not failed:
        return ids[-1], "NO_FAILURE", [ids[-1]], [], 1.0
    current, path = failed[-1], [failed[-1]]
    while current in parent:
        up = by_id[parent[current]]
        if up[5] != "FAILED" or aborted(up[5], up[6], words):
            break
        current = up[1]
        path.insert(0, current)
    reason = by_id[current][6]
    points = 50 + 15
    points += 20 if reason is not None and len(reason) > 10 else 0
    points += 15 if current not in parent or by_id[parent[current]][5] == "COMPLETED" else 0
    roots = sum(1 for i in failed if i not in parent or by_id[parent[i]][5] != "FAILED")
    points -= 10 * max(roots - 1, 0)
    return current, reason or "Unknown", path, path[1:], max(0, min(100, points)) / 100


@pytest.fixture(scope="module")
def chains():
    rng = random.Random(7)
    return {f"app{i}": random_chain(rng, f"app{i}") for i in range(300)}


@pytest.fixture(scope="module")
def nodes(spark, chains):
    rows = [r for chain in chains.values() for r in chain]
    return graph.stage_nodes(spark.createDataFrame(rows, SCHEMA)).cache()


@pytest.mark.parametrize("chunk", [1, 3, 4096])
@pytest.mark.parametrize("strict", [False, True])
def test_against_literal_walk(nodes, chains, chunk, strict):
    words = ("cancelled",) if strict else ("cancelled", "aborted")
    causes = rootcause.chain_root_causes(nodes, strict, chunk=chunk)
    got = {r.app_id: r for r in causes.collect()}
    for app, rows in chains.items():
        root, reason, path, _, score = literal_walk(rows, words)
        r = got[app]
        assert (r.root_cause_stage_id, r.failure_reason) == (root, reason), app
        assert r.root_cause_stage_name == f"s{root}"
        assert (r.path_length, r.terminal_stage_id) == (len(path), path[-1])
        assert r.analysis_confidence == score


@pytest.mark.parametrize("chunk", [2, 4096])
def test_path_rows(nodes, chains, chunk):
    rows = rootcause.propagation_path(nodes, chunk=chunk).collect()
    for app, chain in chains.items():
        _, _, path, victims, _ = literal_walk(chain)
        mine = [r for r in rows if r.app_id == app]
        assert sorted(r.stage_id for r in mine) == path
        assert sorted(r.stage_id for r in mine if r.is_victim) == victims


@pytest.mark.parametrize("chunk", [2, 4096])
def test_path_text_in_parts(nodes, chains, chunk):
    parts = rootcause.path_text(rootcause.propagation_path(nodes), chunk)
    rows = parts.orderBy("app_id", "part").collect()
    for app, chain in chains.items():
        _, _, path, victims, _ = literal_walk(chain)
        mine = [r for r in rows if r.app_id == app]
        for column, ids in (("propagation_path", path), ("victim_stages", victims)):
            texts = [r[column] for r in mine if r[column]]
            assert ",".join(texts) == ",".join(map(str, ids))


def test_long_paths_come_whole(spark):
    n = 200_000
    rows = spark.range(n).selectExpr(
        "'big' AS app_id", "int(id) AS stage_id", "0 AS stage_attempt_id",
        "0L AS completion_time", "'s' AS stage_name", "'FAILED' AS status",
        "'OOM' AS failure_reason",
    )
    nodes = graph.stage_nodes(rows)
    causes = rootcause.chain_root_causes(nodes).first()
    assert (causes.root_cause_stage_id, causes.path_length) == (0, n)
    path = rootcause.propagation_path(nodes)
    assert path.filter("is_victim").count() == n - 1
    texts = rootcause.path_text(path).orderBy("part").collect()
    assert ",".join(r.propagation_path for r in texts) == ",".join(map(str, range(n)))


def test_summary(spark):
    rows = [("a", "x" * 40), ("b", "x" * 35), ("c", "NO_FAILURE")]
    causes = spark.createDataFrame(rows, "app_id string, failure_reason string")
    got = {tuple(r) for r in rootcause.root_cause_summary(causes).collect()}
    assert got == {
        ("x" * 40, 1, "x" * 30), ("x" * 35, 1, "x" * 30), ("NO_FAILURE", 1, "NO_FAILURE")
    }
