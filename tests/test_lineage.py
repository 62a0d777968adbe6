"""Random graphs with many parents against literal walks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from faultweave.operators import graph, lineage, rootcause

SCHEMA = """app_id string, stage_id int, stage_attempt_id int, completion_time bigint,
    stage_name string, status string, failure_reason string, parent_ids array<int>"""
REASONS = ["OOM", "ExecutorLostFailure: lost", "Job aborted", None]


def random_graph(rng, app):
    ids = sorted(rng.sample(range(50), rng.randint(1, 12)))
    rows = []
    for at, i in enumerate(ids):
        parents = rng.sample(ids[:at], min(at, rng.randint(0, 3)))
        if rng.random() < 0.1:
            parents.append(99)  # a parent that left no event
        status = rng.choices(["FAILED", "COMPLETED"], [6, 4])[0]
        reason = rng.choice(REASONS) if status == "FAILED" else None
        rows.append((app, i, 0, 0, f"s{i}", status, reason, parents))
    return rows


@pytest.fixture(scope="module")
def graphs():
    rng = random.Random(11)
    return {f"g{i}": random_graph(rng, f"g{i}") for i in range(80)}


@pytest.fixture(scope="module")
def nodes(spark, graphs):
    rows = [r for g in graphs.values() for r in g]
    return graph.stage_nodes(spark.createDataFrame(rows, SCHEMA)).cache()


def links(rows):
    ids = {r[1] for r in rows}
    return {r[1]: [p for p in r[7] if p in ids] for r in rows}


def closure(start, step):
    seen, todo = set(), list(step[start])
    while todo:
        at = todo.pop()
        if at not in seen:
            seen.add(at)
            todo += step[at]
    return seen


def test_root_causes(nodes, graphs):
    causes, path = lineage.lineage_root_causes(nodes)
    got = {r.app_id: r for r in causes.collect()}
    text = {r.app_id: r for r in rootcause.path_text(path).collect()}
    assert set(got) == set(graphs)
    for app, rows in graphs.items():
        info, up = {r[1]: r for r in rows}, links(rows)
        down = {i: [c for c in up if i in up[c]] for i in up}

        def failed(i):
            return info[i][5] == "FAILED"

        def cause(i):
            return failed(i) and "aborted" not in (info[i][6] or "").lower()

        broken = [i for i in up if failed(i)]
        r = got[app]
        if not broken:
            assert (r.failure_reason, r.analysis_confidence) == ("NO_FAILURE", 1.0)
            assert r.root_cause_stage_id == max(i for i in up if not down[i])
            continue
        leaves = [i for i in broken if not down[i]]
        ends = leaves or [i for i in broken if not any(map(failed, down[i]))]
        terminal = max(ends)
        above = {i: [p for p in up[i] if cause(p)] if failed(i) else [] for i in up}
        walked = {terminal} | closure(terminal, above)
        root = max(i for i in walked if not above[i])
        reason = info[root][6]
        points = 50 + (20 if reason and len(reason) > 10 else 0)
        points += 15 if all(len(info[i][7]) <= 1 for i in walked) else 0
        points += 15 if not any(failed(p) for p in up[root]) else 0
        roots = sum(1 for i in broken if not any(map(failed, up[i])))
        points -= 10 * max(roots - 1, 0)
        assert (r.root_cause_stage_id, r.terminal_stage_id) == (root, terminal), app
        assert r.failure_reason == (reason or "Unknown")
        assert r.analysis_confidence == max(0, points) / 100
        assert text[app].propagation_path == ",".join(map(str, sorted(walked)))
        victims = [i for i in sorted(walked) if above[i]]
        assert text[app].victim_stages == ",".join(map(str, victims))


def test_reachability(spark, nodes, graphs):
    pairs = [(app, rows[-1][1]) for app, rows in graphs.items()]
    firsts = [(app, rows[0][1]) for app, rows in graphs.items()]
    edges = lineage.lineage_edges(nodes)
    schema = "app_id string, seed_stage_id int"
    up = lineage.lineage_ancestors(edges, spark.createDataFrame(pairs, schema)).collect()
    down = lineage.lineage_descendants(edges, spark.createDataFrame(firsts, schema)).collect()
    want_up, want_down = set(), set()
    for app, rows in graphs.items():
        above = links(rows)
        below = {i: [c for c in above if i in above[c]] for i in above}
        last, first = rows[-1][1], rows[0][1]
        want_up |= {(app, last, i) for i in closure(last, above)}
        want_down |= {(app, first, i) for i in closure(first, below)}
    assert {tuple(r) for r in up} == want_up and len(up) == len(want_up)
    assert {tuple(r) for r in down} == want_down and len(down) == len(want_down)


def test_shape(nodes, graphs):
    got = {r.app_id: r for r in lineage.lineage_shape(nodes).collect()}
    for app, rows in graphs.items():
        up = links(rows)
        depth = {}
        for i in sorted(up):
            depth[i] = 1 + max((depth[p] for p in up[i]), default=0)
        used = {p for ps in up.values() for p in ps}
        r = got[app]
        assert (r.is_acyclic, r.depth, r.total_stages) == (True, max(depth.values()), len(up))
        assert r.root_stages == sum(1 for i in up if not up[i])
        assert r.leaf_stages == sum(1 for i in up if i not in used)


def test_cycles(spark):
    rows = [
        ("loop", i, 0, 0, "s", "FAILED", "OOM", [p]) for i, p in ((1, 3), (2, 1), (3, 2))
    ]
    rows += [("tail", 1, 0, 0, "s", "COMPLETED", None, [])]
    rows += [("tail", 2, 0, 0, "s", "COMPLETED", None, [1, 3])]
    rows += [("tail", 3, 0, 0, "s", "COMPLETED", None, [2])]
    nodes = graph.stage_nodes(spark.createDataFrame(rows, SCHEMA))
    got = {r.app_id: (r.is_acyclic, r.depth) for r in lineage.lineage_shape(nodes).collect()}
    assert got == {"loop": (False, None), "tail": (False, None)}
    causes, _ = lineage.lineage_root_causes(nodes)
    roots = {r.app_id: r.root_cause_stage_id for r in causes.collect()}
    assert roots["loop"] == 3  # no stage ends the walk, so it stays where it began


def test_cycles_beside_stages_that_no_walk_leaves(spark):
    def stages(app, parents):
        return [(app, i, 0, 0, "s", "FAILED", "OOM", p) for i, p in parents.items()]

    two = {1: [2], 2: [1]}
    rows = stages("isolated", two | {i: [] for i in range(3, 13)})
    rows += stages("leaves", two | {i: [1] for i in range(3, 13)})
    rows += stages("self", {1: [1]} | {i: [] for i in range(2, 9)})
    rows += stages("fan", {1: []} | {i: [1] for i in range(2, 13)})
    rows += stages("chain", {1: []} | {i: [i - 1] for i in range(2, 13)})
    rows += stages("apart", {i: [] for i in range(1, 13)})
    nodes = graph.stage_nodes(spark.createDataFrame(rows, SCHEMA))
    shape = lineage.lineage_shape(nodes).collect()
    # Alone, the two-cycle sets the bound on steps itself; beside the chain the bound is larger.
    alone = nodes.where("app_id in ('isolated', 'leaves', 'self', 'fan')")
    got = {r.app_id: (r.is_acyclic, r.depth) for r in shape}
    cyclic = dict.fromkeys(("isolated", "leaves", "self"), (False, None))
    assert got == cyclic | {"fan": (True, 2), "chain": (True, 12), "apart": (True, 1)}
    got = {r.app_id: (r.is_acyclic, r.depth) for r in lineage.lineage_shape(alone).collect()}
    assert got == cyclic | {"fan": (True, 2)}


def chain_nodes(spark, depth):
    rows = spark.range(depth).selectExpr(
        "'deep' AS app_id", "int(id) AS stage_id", "0 AS stage_attempt_id",
        "0L AS completion_time", "'s' AS stage_name", "'FAILED' AS status",
        "'OOM' AS failure_reason", "if(id = 0, array(), array(int(id - 1))) AS parent_ids",
    )
    return graph.stage_nodes(rows)


def test_rounds_grow_with_the_logarithm_of_the_depth(spark, monkeypatch):
    kept = []
    cut = lineage.cut_lineage
    monkeypatch.setattr(lineage, "cut_lineage", lambda df: kept.append(1) or cut(df))
    rounds = {}
    for depth in (64, 256, 1024):
        kept.clear()
        shape = lineage.lineage_shape(chain_nodes(spark, depth)).first()
        assert (shape.depth, shape.is_acyclic) == (depth, True)
        rounds[depth] = len(kept)
    assert rounds[1024] - rounds[256] == rounds[256] - rounds[64] <= 8
    seeds = spark.createDataFrame([("deep", 1023)], "app_id string, seed_stage_id int")
    edges = lineage.lineage_edges(chain_nodes(spark, 1024))
    assert lineage.lineage_ancestors(edges, seeds).count() == 1023


def wide_nodes(spark, stages):
    """One application whose stages have the parents o - 1 and o / 2."""
    parents = "array_distinct(array(int(id - 1), int(id div 2)))"
    rows = chain_nodes(spark, stages).drop("parent_ids")
    return rows.withColumn("id", F.col("stage_id")).selectExpr(
        "* EXCEPT (id)", f"if(id = 0, array(), {parents}) AS parent_ids"
    )


def test_many_parents_make_no_pairs_beyond_the_answer(spark, monkeypatch):
    sizes, n = [], 3000
    cut = lineage.cut_lineage

    def counted(df):
        out = cut(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(lineage, "cut_lineage", counted)
    nodes = wide_nodes(spark, n)
    edges = lineage.lineage_edges(nodes)
    seeds = spark.createDataFrame([("deep", n - 1)], "app_id string, seed_stage_id int")
    assert lineage.lineage_ancestors(edges, seeds).count() == n - 1
    assert max(sizes) <= 2 * n and len(sizes) <= 20
    sizes.clear()
    seeds = spark.createDataFrame([("deep", 0)], "app_id string, seed_stage_id int")
    assert lineage.lineage_descendants(edges, seeds).count() == n - 1
    assert max(sizes) <= 2 * n and len(sizes) <= 20
    sizes.clear()
    shape = lineage.lineage_shape(nodes).first()
    assert (shape.depth, shape.is_acyclic) == (n, True)
    assert max(sizes) <= 2 * n and len(sizes) <= 40
    sizes.clear()
    causes, path = lineage.lineage_root_causes(nodes)
    assert causes.first()["root_cause_stage_id"] == 0 and path.count() == n
    assert max(sizes) <= 2 * n


def test_shape_and_reach_of_random_digraphs(spark):
    """Arcs in any direction, cycles among them."""
    rng = random.Random(4)
    rows, graphs = [], {}
    for g in range(60):
        n = rng.randint(1, 14)
        few = rng.random() < 0.5
        up = {
            i: sorted({rng.randrange(n) for _ in range(rng.choice([0, 0, 1] if few else [0, 1, 3]))})
            for i in range(n)
        }
        graphs[f"d{g}"] = up
        rows += [(f"d{g}", i, 0, 0, "s", "FAILED", "OOM", p) for i, p in up.items()]
    nodes = graph.stage_nodes(spark.createDataFrame(rows, SCHEMA))
    shape = {r.app_id: (r.is_acyclic, r.depth) for r in lineage.lineage_shape(nodes).collect()}
    cyclic = 0
    for app, up in graphs.items():
        if any(i in closure(i, up) for i in up):
            want, cyclic = (False, None), cyclic + 1
        else:
            depth = {}

            def walk(i, up=up, depth=depth):
                if i not in depth:
                    depth[i] = 1 + max(map(walk, up[i]), default=0)
                return depth[i]

            want = True, max(map(walk, up))
        assert shape[app] == want, app
    assert 5 < cyclic < 55
    seeds = spark.createDataFrame(
        [(app, i) for app, up in graphs.items() for i in list(up)[:3]],
        "app_id string, seed_stage_id int",
    )
    got = lineage.lineage_ancestors(lineage.lineage_edges(nodes), seeds).collect()
    want = {
        (app, i, j) for app, up in graphs.items() for i in list(up)[:3] for j in closure(i, up) if j != i
    }
    assert {tuple(r) for r in got} == want and len(got) == len(want)
