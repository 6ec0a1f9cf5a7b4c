import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph, large_graph

EDGES = "project_id long, analysis_number int, s long, t long"


def groups(df):
    return sorted((r.project_id, r.component, r.id) for r in df.collect())


def expected(by_run):
    return sorted((run, g[0], v) for run, e in by_run.items() for g in graph.components(sorted({(s, t) for s, t in e if s != t})) for v in g)


def frame(spark, by_run):
    return spark.createDataFrame([(run, 1, s, t) for run, e in by_run.items() for s, t in e], EDGES).distinct()


def ring(nodes):
    return list(zip(nodes, nodes[1:] + nodes[:1]))


def shapes(rng):
    """Runs of one graph each: chains of cycles, rings and paths, random graphs, self loops."""
    mixed = list(range(14))
    rng.shuffle(mixed)
    pairs = [e for k in range(0, 6, 2) for e in [(k, k + 1), (k + 1, k), (k + 1, k + 2)]]
    return {
        1: ring(mixed), 2: [(k, k + 1) for k in range(8)], 3: pairs, 4: [(5, 5), (5, 6), (6, 5)], 5: [(9, 9)],
        6: [(rng.randrange(20), rng.randrange(20)) for _ in range(26)], 7: [(rng.randrange(12), rng.randrange(12)) for _ in range(40)],
        8: ring(mixed[:5]) + ring(mixed[5:9]) + [(mixed[0], mixed[5])] + ring([mixed[5], mixed[12]]),
    }


@pytest.mark.parametrize("finish", [0, 25])
def test_components_by_rounds_equal_those_of_one_task(spark, finish):
    by_run = shapes(random.Random(finish))
    got = large_graph.components(frame(spark, by_run), graph._scc_by_run, finish)
    assert groups(got) == expected(by_run)
    assert got.columns == ["project_id", "analysis_number", "component", "id"]


def test_runs_of_either_size_in_one_call(spark):
    by_run = {1: ring([1, 2]), 2: ring(list(range(5))) + [(3, 4), (3, 40), (40, 41)]}
    deps = frame(spark, by_run).withColumnsRenamed({"s": "source_service_id", "t": "target_service_id"})
    assert groups(graph.scc(deps, 3)) == groups(graph.scc(deps)) == expected(by_run)
    services = deps.select("project_id", "analysis_number", F.explode(F.array("source_service_id", "target_service_id")).alias("id")).distinct()
    each = [sorted((r.project_id, r.id, round(r.bc, 9), round(r.bc_norm, 9)) for r in graph.betweenness(services, deps, n).collect()) for n in (3, 1000)]
    assert each[0] == each[1] and any(x[2] > 0 for x in each[0])


@pytest.mark.parametrize("reached", [10**9, 300])
def test_betweenness_by_rounds_equals_brandes(spark, reached):
    by_run = {k: e for k, e in shapes(random.Random(3)).items() if k in (3, 5, 6, 7)}
    got = {(r.project_id, r.id): r.bc for r in large_graph.betweenness(frame(spark, by_run), reached).collect()}
    want = {(run, v): b for run, e in by_run.items() for v, b in graph.brandes(sorted({(s, t) for s, t in e if s != t})).items() if b > 1e-12}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_sources_that_reach_little_share_a_block(spark, monkeypatch):
    by_run = {1: [(4 * r + a, 4 * r + b) for r in range(64) for a, b in [(0, 1), (1, 2), (2, 3), (3, 0)]]}
    passed, calls = large_graph._passed, []
    monkeypatch.setattr(large_graph, "PILOT", 2, raising=False)
    monkeypatch.setattr(large_graph, "_passed", lambda *a: calls.append(1) or passed(*a))
    got = [(r.id, r.bc) for r in large_graph.betweenness(frame(spark, by_run), 16384).collect()]
    assert sorted(got) == [(v, 3.0) for v in range(256)]  # three pairs of each ring pass through a node
    assert len(calls) == 2


def test_no_edges(spark):
    none = frame(spark, {1: [(1, 1)]})
    assert large_graph.components(none).collect() == [] and large_graph.betweenness(none).collect() == []
    deps = none.withColumnsRenamed({"s": "source_service_id", "t": "target_service_id"})
    assert graph.scc(deps).collect() == [] and graph.scc(deps, 0).collect() == []
