"""Graph operators over dependency rows, for all runs at once.

Metrics are aggregates. Strongly connected components and betweenness of a run
with few edges are found in one task each, and runs spread over the cluster;
components of runs with more edges go through rounds of joins (`large_graph`),
their betweenness through their parts and blocks of sources (`paths`).
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import RUN
from ..sources.stages import keep
from . import large_graph, paths

#: Distinct edges of a run up to which one task takes it whole: for components, which need a pass, and for shortest paths, which need one for each node.
SMALL, SMALL_PATHS = 20_000, 2_000


def edges(deps: DataFrame) -> DataFrame:
    """Distinct (s, t) of each run; rows count elsewhere, not here."""
    return deps.filter("source_service_id <> target_service_id").select(*RUN, F.col("source_service_id").alias("s"), F.col("target_service_id").alias("t")).distinct()


def components(pairs: list[tuple[int, int]]) -> list[list[int]]:
    """Strongly connected components with more than one node, by an iterative depth-first search."""
    ahead: dict = {}
    for s, t in pairs:
        ahead.setdefault(s, []).append(t)
        ahead.setdefault(t, [])
    index: dict = {}
    low: dict = {}
    stack: list = []
    on: set = set()
    out = []
    for first in sorted(ahead):
        if first in index:
            continue
        work = [(first, iter(ahead[first]))]
        index[first] = low[first] = len(index)
        stack.append(first)
        on.add(first)
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(ahead[w])))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    group = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        group.append(w)
                        if w == v:
                            break
                    if len(group) > 1:
                        out.append(sorted(group))
    return sorted(out)


def _by_size(deps: DataFrame, small: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Distinct edges of runs with up to `small` of them, and of the others; None where there are none."""
    e = keep(edges(deps))
    n = keep(e.groupBy(*RUN).agg(F.count("*").alias("_n")))
    most, least = n.agg(F.max("_n"), F.min("_n")).first()
    if most is None or most <= small:
        return e, None
    if least > small:
        return None, e
    sized = e.join(n, RUN)
    return sized.filter(F.col("_n") <= small).drop("_n"), keep(sized.filter(F.col("_n") > small).drop("_n"))


def _scc_by_run(e: DataFrame) -> DataFrame:
    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        rows = [(*key, g[0], v) for g in components(list(zip(frame.s, frame.t))) for v in g]
        return pd.DataFrame(rows, columns=[*RUN, "component", "id"])

    return e.groupBy(*RUN).applyInPandas(run, "project_id long, analysis_number int, component long, id long")


def _brandes_by_run(e: DataFrame) -> DataFrame:
    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        rows = [(*key, v, b) for v, b in brandes(list(zip(frame.s, frame.t))).items()]
        return pd.DataFrame(rows, columns=[*RUN, "id", "bc"])

    return e.groupBy(*RUN).applyInPandas(run, "project_id long, analysis_number int, id long, bc double")


def _either(deps: DataFrame, small: int, by_run, by_rounds) -> DataFrame:
    few, many = _by_size(deps, small)
    if many is None:
        return by_run(few)
    return by_rounds(many) if few is None else by_run(few).unionByName(by_rounds(many))


def scc(deps: DataFrame, small: int = SMALL) -> DataFrame:
    """(run, component, id): members of each cycle group; a component is named by its least member. Runs of more than `small`
    distinct edges go through rounds of joins, until `small` edges are left in all."""
    return _either(deps, small, _scc_by_run, lambda e: large_graph.components(e, _scc_by_run, small))


def brandes(pairs: list[tuple[int, int]]) -> dict:
    """Raw betweenness of each node on a directed, unweighted graph."""
    ahead: dict = {}
    for s, t in pairs:
        ahead.setdefault(s, []).append(t)
        ahead.setdefault(t, [])
    out = dict.fromkeys(ahead, 0.0)
    for s in ahead:
        paths, far, before, order, queue = {s: 1.0}, {s: 0}, {}, [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in ahead[v]:
                if w not in far:
                    far[w] = far[v] + 1
                    queue.append(w)
                if far[w] == far[v] + 1:
                    paths[w] = paths.get(w, 0.0) + paths[v]
                    before.setdefault(w, []).append(v)
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before.get(w, []):
                share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                out[w] += share[w]
    return out


def betweenness(services: DataFrame, deps: DataFrame, small: int = SMALL_PATHS) -> DataFrame:
    """(run, id, bc, bc_norm) of every service; normalised by (n-1)(n-2). Runs of more than `small` distinct edges are
    taken by their parts and by blocks of sources."""
    found = _either(deps, small, _brandes_by_run, paths.betweenness)
    n = services.groupBy(*RUN).agg(F.count("*").alias("_n"))
    pairs = (F.col("_n") - 1) * (F.col("_n") - 2)
    bc = F.coalesce("bc", F.lit(0.0))
    rows = services.select(*RUN, "id").join(n, RUN).join(found, [*RUN, "id"], "left")
    return rows.select(*RUN, "id", bc.alias("bc"), F.when(pairs > 0, bc / pairs).otherwise(0.0).alias("bc_norm"))


def run_metrics(services: DataFrame, deps: DataFrame) -> DataFrame:
    """Per run: services, total_dependencies (rows), distinct edges, coupling, connected services and their ratio."""
    n = services.groupBy(*RUN).agg(F.count("*").alias("n_services"))
    rows = deps.groupBy(*RUN).agg(F.count("*").alias("total_dependencies"), F.count_distinct("source_service_id", "target_service_id").alias("n_edges"))
    ends = deps.select(*RUN, F.explode(F.array("source_service_id", "target_service_id")).alias("id")).groupBy(*RUN).agg(F.count_distinct("id").alias("connected"))
    out = n.join(rows, RUN, "left").join(ends, RUN, "left").na.fill(0, ["total_dependencies", "n_edges", "connected"])
    return out.withColumns({"coupling": F.col("n_edges") / F.greatest(F.col("n_services") * (F.col("n_services") - 1), F.lit(1)), "connected_ratio": F.col("connected") / F.col("n_services")})


def degrees(services: DataFrame, deps: DataFrame) -> DataFrame:
    """Per service: in and out degree by rows, mediator ratio, distinct callers and callees and their ratios."""
    out = deps.groupBy(*RUN, F.col("source_service_id").alias("id")).agg(F.count("*").alias("out_degree"), F.count_distinct("target_service_id").alias("callees"))
    into = deps.groupBy(*RUN, F.col("target_service_id").alias("id")).agg(F.count("*").alias("in_degree"), F.count_distinct("source_service_id").alias("callers"))
    n = services.groupBy(*RUN).agg(F.count("*").alias("n_services"))
    rows = deps.groupBy(*RUN).agg(F.count("*").alias("n_rows"))
    all_ = services.select(*RUN, "id", "name").join(out, [*RUN, "id"], "left").join(into, [*RUN, "id"], "left").join(n, RUN).join(rows, RUN, "left")
    all_ = all_.na.fill(0, ["out_degree", "callees", "in_degree", "callers", "n_rows"])
    others = F.greatest(F.col("n_services") - 1, F.lit(1))
    return all_.withColumns({
        "mediator_ratio": F.when(F.col("n_rows") > 0, (F.col("in_degree") + F.col("out_degree")) / F.col("n_rows")).otherwise(0.0),
        "caller_ratio": F.col("callers") / others, "callee_ratio": F.col("callees") / others,
    })


def evidence(deps: DataFrame) -> DataFrame:
    """The last dependency row of each edge."""
    cols = [c for c in deps.columns if c not in RUN]
    last = F.max_by(F.struct(*cols), "id").alias("r")
    return deps.groupBy(*RUN, F.col("source_service_id").alias("s"), F.col("target_service_id").alias("t")).agg(last).select(*RUN, "s", "t", F.col("r.evidence_file"), F.col("r.evidence_code"), F.col("r.call_count"))


def reciprocal(deps: DataFrame) -> DataFrame:
    """(run, a, b) with a < b for each pair of services that call each other."""
    e = edges(deps)
    # One shuffle: both directions of a pair meet under their sorted key.
    pair = e.groupBy(*RUN, F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).agg(F.count("*").alias("n"))
    return pair.filter("n = 2").drop("n")


def most_called(deps: DataFrame) -> DataFrame:
    w = Window.partitionBy(*RUN).orderBy(F.desc("calls"), "id")
    return deps.groupBy(*RUN, F.col("target_service_id").alias("id")).agg(F.count("*").alias("calls")).withColumn("rank", F.row_number().over(w))


def graph_json(services: DataFrame, deps: DataFrame) -> DataFrame:
    """(run, graph): nodes and one edge for each dependency row, ids as text."""
    nodes = services.groupBy(*RUN).agg(F.array_sort(F.collect_list(F.struct(F.col("id").cast("string").alias("id"), "name", F.col("lines_of_code").alias("linesOfCode")))).alias("nodes"))
    links = F.struct(F.col("source_service_id").cast("string").alias("source"), F.col("target_service_id").cast("string").alias("target"), F.col("dependency_type").alias("type"), F.col("call_count").alias("weight"))
    joined = nodes.join(deps.groupBy(*RUN).agg(F.array_sort(F.collect_list(links)).alias("edges")), RUN, "left")
    kind = "array<struct<source:string,target:string,type:string,weight:int>>"
    return joined.select(*RUN, F.to_json(F.struct("nodes", F.coalesce(F.col("edges"), F.from_json(F.lit("[]"), kind)).alias("edges"))).alias("graph"))
