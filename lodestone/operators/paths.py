"""Betweenness by parts of a graph: weakly connected parts are found by rounds of joins, and paths from blocks of sources
in tasks that each hold the edges of one part.

The number of stages does not grow with the length of paths. A part too large for a task, or for copies of its edges to
be dealt to the blocks of its sources, goes through rounds of joins (`large_graph`).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import RUN
from . import large_graph
from .large_graph import Rows

#: Edges of a part that one task may hold, some 200 bytes each at most.
PART_EDGES = 1_000_000
#: Steps along an edge that a block of sources may take at most outwards, and as many back; a task with fewer is worth its start.
BLOCK_STEPS = 100_000_000
#: Rows of copied edges that the blocks of one part may need.
COPIED_ROWS = 200_000_000
#: Edges left in all that are put into parts by a task for each run.
FINISH_EDGES = 20_000
#: Parts of up to so many edges share tasks, about so many edges in each.
SHARED_EDGES = 2_000
#: Pairs of source and node, and of source and edge, that a task looks at in one go.
CELLS = 2_000_000
#: Tasks at most, and at least for each core.
MOST_TASKS, TASKS_PER_CORE = 4_000, 4


def _parts_by_run(e: DataFrame) -> DataFrame:
    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        nodes, ends = np.unique(np.concatenate([frame.s, frame.t]), return_inverse=True)
        s, t = ends[: len(frame)], ends[len(frame) :]
        least, was = np.arange(len(nodes)), None
        while was is None or (was != least).any():
            was = least.copy()
            # The root of each end takes the lesser of both, and roots are followed to theirs.
            low = np.minimum(least[s], least[t])
            np.minimum.at(least, was[s], low)
            np.minimum.at(least, was[t], low)
            least = least[least]
        return pd.DataFrame({"project_id": key[0], "analysis_number": key[1], "v": nodes, "part": nodes[least]})

    return e.groupBy(*RUN).applyInPandas(run, "project_id long, analysis_number int, v long, part long")


def _renamed(found: DataFrame | None, up: DataFrame) -> DataFrame:
    """Parts by their names in (run, v, up), where these have one."""
    if found is None:
        return up.select(*RUN, "v", F.col("up").alias("part"))
    over = up.select(*RUN, F.col("v").alias("part"), "up")
    return found.join(over, [*RUN, "part"], "left").select(*RUN, "v", F.coalesce("up", "part").alias("part"))


def parts(edges: DataFrame, finish_edges: int = FINISH_EDGES) -> DataFrame:
    """(run, v, part): the weakly connected part of each node of (run, s, t), named by one of its nodes. Every node is hooked to
    the one of least hash among its neighbours and itself, hooks are followed to their ends by doubling, and the edges between
    ends go on, until there are none; where `finish_edges` or fewer are left in all, a task for each run takes them."""
    e, seed, n = edges, 0, edges.count()
    found = None if n > finish_edges else _parts_by_run(e)
    while n > finish_edges or found is None:
        seed += 1
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(seed)).alias("h"), F.col(c).alias("id"))  # noqa: E731, B023
        both = e.select(*RUN, "s", "t").unionByName(e.select(*RUN, F.col("t").alias("s"), F.col("s").alias("t")))
        least = both.groupBy(*RUN, F.col("s").alias("v")).agg(F.min(rank("t")).alias("least"))
        up = Rows(least.select(*RUN, "v", F.least("least", rank("v"))["id"].alias("up"), F.lit(True).alias("moved")), moved=F.lit(True))
        while up.counts["moved"]:
            over, next_ = up.light.select(*RUN, F.col("v").alias("up"), F.col("up").alias("over")), up.df.withColumn("was", F.lit(None).cast("long"))
            for _ in range(2):
                next_ = next_.join(over, [*RUN, "up"]).select(*RUN, "v", F.col("up").alias("was"), F.col("over").alias("up"))
            up = Rows(next_.select(*RUN, "v", "up", (F.col("was") != F.col("up")).alias("moved")), moved=F.col("moved"))
        ends = [up.light.select(*RUN, F.col("v").alias(x), F.col("up").alias(f"{x}_up")) for x in ("s", "t")]
        between = e.join(ends[0], [*RUN, "s"]).join(ends[1], [*RUN, "t"]).filter("s_up <> t_up")
        found = _renamed(found, up.df)
        left = Rows(between.select(*RUN, F.col("s_up").alias("s"), F.col("t_up").alias("t")).distinct())
        e, n = left.df, left.n
        if 0 < n <= finish_edges:
            found = _renamed(found, _parts_by_run(e).withColumnRenamed("part", "up"))
    return found


def passed(s: np.ndarray, t: np.ndarray, block: int = 0, blocks: int = 1, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges s -> t, and what the shortest paths from one of `blocks` equal blocks of sources add to each. Searches
    from several sources go on at once: a cell is a source's row and a node."""
    nodes, ends = np.unique(np.concatenate([s, t]), return_inverse=True)
    n, source = len(nodes), ends[: len(s)]
    to = ends[len(s) :][np.argsort(source, kind="stable")]
    degree = np.bincount(source, minlength=n)
    start = np.cumsum(degree) - degree
    sources, out = np.flatnonzero(degree)[block::blocks], np.zeros(n)

    def ahead(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each edge that leaves a cell: the cell's place in `at`, and the cell that the edge enters."""
        v = at % n
        d = degree[v]
        i = np.repeat(np.arange(len(at)), d)
        return i, (at - v)[i] + to[np.arange(len(i)) + np.repeat(start[v] - np.cumsum(d) + d, d)]

    rows = max(1, cells // (n + len(s)))
    for first in range(0, len(sources), rows):
        mine = sources[first : first + rows]
        far, paths, share, place = np.full(len(mine) * n, -1), np.zeros(len(mine) * n), np.zeros(len(mine) * n), np.empty(len(mine) * n, int)
        levels = [np.arange(len(mine)) * n + mine]
        far[levels[0]], paths[levels[0]] = 0, 1
        while len(levels[-1]):
            i, w = ahead(levels[-1])
            new = far[w] < 0
            i, w = i[new], w[new]
            np.add.at(paths, w, paths[levels[-1]][i])
            far[w] = len(levels)
            place[w] = np.arange(len(w))
            levels.append(w[place[w] == np.arange(len(w))])
        for k in range(len(levels) - 2, 0, -1):
            i, w = ahead(levels[k])
            next_ = far[w] == k + 1
            i, w = i[next_], w[next_]
            share[levels[k]] = paths[levels[k]] * np.bincount(i, (1 + share[w]) / paths[w], len(levels[k]))
        met = np.concatenate(levels[1:])
        out += np.bincount(met % n, share[met], n)
    return nodes, out


def _in_tasks(rows: DataFrame, tasks: int) -> DataFrame:
    """(run, id, bc) from edges of parts (run, shared, part, blocks, s, t)."""

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        nodes, bc = passed(frame.s.to_numpy(), frame.t.to_numpy(), key[-1], frame.blocks.iloc[0])
        some = bc > 0
        return pd.DataFrame({"project_id": key[0], "analysis_number": key[1], "id": nodes[some], "bc": bc[some]})

    group = [*RUN, "shared", "part", "block"]
    dealt = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).repartition(tasks, *group)
    return dealt.groupBy(*group).applyInPandas(run, "project_id long, analysis_number int, id long, bc double").groupBy(*RUN, "id").agg(F.sum("bc").alias("bc"))


def betweenness(edges: DataFrame) -> DataFrame:
    """(run, id, bc) of the nodes that lie on a shortest path between two others, from distinct edges (run, s, t) without loops."""
    of = Rows(parts(edges))
    named = Rows(edges.join(of.light.withColumnRenamed("v", "s"), [*RUN, "s"]).select(*RUN, "part", "s", "t"))
    n_nodes = of.df.groupBy(*RUN, "part").agg(F.count("*").cast("double").alias("n"))
    sized = named.df.groupBy(*RUN, "part").agg(F.count("*").cast("double").alias("m")).join(n_nodes, [*RUN, "part"])
    steps = F.col("n") * (F.col("n") + F.col("m"))
    blocks = F.ceil(steps / BLOCK_STEPS).cast("int")
    fits = (F.col("m") <= PART_EDGES) & (F.col("m") * blocks <= COPIED_ROWS)
    plan = Rows(sized.select(*RUN, "part", "m", steps.alias("steps"), blocks.alias("blocks"), fits.alias("fits"), (fits & (F.col("m") <= SHARED_EDGES)).alias("shared")), large=~F.col("fits"))
    # Small parts are put together, by a hash of their names.
    shares = plan.df.groupBy(*RUN).agg(F.ceil(F.coalesce(F.sum(F.when(F.col("shared"), F.col("m"))), F.lit(1)) / SHARED_EDGES).alias("places"))
    at = plan.df.join(F.broadcast(shares), RUN).withColumn("at", F.when(F.col("shared"), F.pmod(F.xxhash64("part"), F.col("places"))).otherwise(F.col("part")))
    at = F.broadcast(at) if plan.n <= large_graph.LIGHT_ROWS else at
    held = named.df.join(at, [*RUN, "part"])
    total = plan.df.filter("fits").agg(F.sum("steps")).first()[0] or 0
    cores = edges.sparkSession.sparkContext.defaultParallelism
    few = _in_tasks(held.filter("fits").select(*RUN, "shared", F.col("at").alias("part"), "blocks", "s", "t"), int(min(MOST_TASKS, max(TASKS_PER_CORE * cores, total // BLOCK_STEPS))))
    if not plan.counts["large"]:
        return few
    return few.unionByName(large_graph.betweenness(held.filter("not fits").select(*RUN, "s", "t")))
