import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph, large_graph, paths
from test_large_graph import frame, ring, shapes


def rounded(df):
    return {(r.project_id, r.id): round(r.bc, 9) for r in df.collect() if r.bc > 1e-12}


def brandes(by_run):
    return {(run, v): round(b, 9) for run, e in by_run.items() for v, b in graph.brandes(sorted({(s, t) for s, t in e if s != t})).items() if b > 1e-12}


def simple(spark, by_run):
    return frame(spark, by_run).filter("s <> t")


def chains(n, length):
    return [(100 * k + i, 100 * k + i + 1) for k in range(n) for i in range(length)]


def test_stages_do_not_grow_with_the_length_of_paths(spark, monkeypatch):
    """No round of joins for each level of a search: 200 of them here and back."""
    monkeypatch.setattr(large_graph, "_passed", None)
    by_run = {1: ring(list(range(200))) + [(0, 300), (300, 2), (500, 501), (501, 502)]}
    deps = frame(spark, by_run).withColumnsRenamed({"s": "source_service_id", "t": "target_service_id"})
    services = deps.select("project_id", "analysis_number", F.explode(F.array("source_service_id", "target_service_id")).alias("id")).distinct()
    assert rounded(graph.betweenness(services, deps, small=0)) == brandes(by_run)


@pytest.mark.parametrize("finish", [0, 8, 10**6])
def test_parts(spark, finish):
    rng = random.Random(finish)
    by_run = {1: chains(3, 30), 2: [(0, k) for k in range(1, 40)] + [(50, 51)], 3: [(k + 1, k) for k in range(40)], 4: [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]}
    e = simple(spark, by_run)
    rows = paths.parts(e, finish).collect()
    got, want = {}, set()
    for r in rows:
        got.setdefault((r.project_id, r.part), set()).add(r.v)
    for run, edges in by_run.items():
        of = {v: {v} for x in edges if x[0] != x[1] for v in x}
        for s, t in edges:
            if s != t and of[s] is not of[t]:
                both = of[s] | of[t]
                of.update(dict.fromkeys(both, both))
        want |= {(run, frozenset(x)) for x in of.values()}
    assert {(run, frozenset(x)) for (run, _), x in got.items()} == want
    assert len(rows) == len({(r.project_id, r.v) for r in rows}) and all(part in x for (_, part), x in got.items())


@pytest.mark.parametrize("name, limit", [("BLOCK_STEPS", 50), ("SHARED_EDGES", 5), ("PART_EDGES", 20), ("COPIED_ROWS", 25)])
def test_blocks_shared_tasks_and_parts_left_to_rounds(spark, monkeypatch, name, limit):
    by_run = {k: e for k, e in shapes(random.Random(5)).items() if k in (3, 6, 7)} | {9: chains(6, 3)}
    monkeypatch.setattr(paths, name, limit)
    calls = []
    monkeypatch.setattr(paths.large_graph, "betweenness", lambda e, f=large_graph.betweenness: calls.append(1) or f(e))
    assert rounded(paths.betweenness(simple(spark, by_run))) == brandes(by_run)
    assert bool(calls) == (name in ("PART_EDGES", "COPIED_ROWS"))


@pytest.mark.parametrize("cells", [1, 200, 10**6])
def test_blocks_of_sources_add_up(cells):
    rng = random.Random(cells)
    e = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(120)} | {(7 * k, 7 * k + 7) for k in range(9)})
    e = [x for x in e if x[0] != x[1]]
    s, t = np.array(e).T
    found = [paths.passed(s, t, k, 3, cells) for k in range(3)]
    want = graph.brandes(e)
    assert sum(x[1] for x in found) == pytest.approx([want[v] for v in found[0][0]])


def test_no_edges(spark):
    assert paths.betweenness(simple(spark, {1: [(1, 1)]})).collect() == []
