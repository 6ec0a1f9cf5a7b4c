"""Cycle groups and betweenness of graphs too large for one task, in rounds of joins.

Every step is a join or an aggregate over (run, node) or (run, source, node),
stored before the next one reads it, so no task and no driver holds a graph.
Tables known to be small are broadcast, by their counted rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import RUN
from ..sources.stages import Bucketed, Stored

#: Rows that are broadcast at most; each has a few numbers.
LIGHT_ROWS = 100_000
#: A round of trimming and contracting is worth another if it takes this share of the edges.
WORTH = 0.1
#: Rows of (source, node) that one block of sources may reach.
REACHED_ROWS = 200_000_000
#: Edges up to which the lists of neighbours are broadcast: 8 bytes for each, and some 60 for each node.
LISTED_EDGES = 8_000_000
#: Rows of (source, node) for which one bucket more is worth its files, and buckets at most.
PART_ROWS, MOST_PARTS = 1_000_000, 400
#: Where all pairs of source and node may be too many for one block, the first block has this part of them at most.
PILOT = 16
#: Sources from which the reach of others is judged, at least.
TOLD_BY = 20
#: Sources are dealt to so many places by a hash, and a block takes some of these.
PLACES = 1 << 20


class Rows(Stored):
    """A stored table with one form for the smaller side of a join."""

    @property
    def light(self) -> DataFrame:
        return F.broadcast(self.df) if self.n <= LIGHT_ROWS else self.df


def _named(df: DataFrame, **names: str) -> DataFrame:
    return df.select(*RUN, *[F.col(old).alias(new) for new, old in names.items()])


# -- strongly connected components --------------------------------------------------------


def _trimmed(e: Rows) -> Rows:
    """Edges whose source is entered and whose target is left by another edge: no other lies on a cycle."""
    entered, left = _named(e.light, s="t").distinct(), _named(e.light, t="s").distinct()
    return Rows(e.df.join(entered, [*RUN, "s"], "left_semi").join(left, [*RUN, "t"], "left_semi").select(*RUN, "s", "t"))


def _contracted(e: Rows, seed: int) -> tuple[Rows, Rows]:
    """Edges without some nodes that one edge enters and one leaves, their neighbours linked in their stead; and these nodes,
    with their neighbours before and after. No two neighbours go at once: of a chain, the nodes with a larger hash than theirs."""
    into = e.df.groupBy(*RUN, F.col("t").alias("v")).agg(F.count("*").alias("n_in"), F.max("s").alias("before"))
    out = e.df.groupBy(*RUN, F.col("s").alias("v")).agg(F.count("*").alias("n_out"), F.max("t").alias("after"))
    chain = Rows(into.filter("n_in = 1").join(out.filter("n_out = 1"), [*RUN, "v"]).select(*RUN, "v", "before", "after", F.xxhash64("v", F.lit(seed)).alias("h")))
    if not chain.n:
        return e, chain
    held = chain.df
    for side in ("before", "after"):
        beside = _named(chain.light, **{side: "v", f"h_{side}": "h"})
        held = held.join(beside, [*RUN, side], "left").filter(f"h_{side} is null or h_{side} < h or (h_{side} = h and {side} < v)")
    gone = Rows(held.select(*RUN, "v", "before", "after"))
    nodes = _named(gone.light, v="v")
    rest = e.df.join(nodes.withColumnRenamed("v", "s"), [*RUN, "s"], "left_anti").join(nodes.withColumnRenamed("v", "t"), [*RUN, "t"], "left_anti")
    linked = _named(gone.df, s="before", t="after").filter("s <> t")
    return Rows(rest.select(*RUN, "s", "t").unionByName(linked).distinct()), gone


def _coloured(e: Rows, seed: int) -> Rows:
    """(run, v, colour): the node of least hash that reaches v."""
    nodes = e.df.select(*RUN, F.explode(F.array("s", "t")).alias("v")).distinct()
    own = F.struct(F.xxhash64("v", F.lit(seed)).alias("h"), F.col("v").alias("id"))
    best = Rows(nodes.select(*RUN, "v", own.alias("c"), F.lit(True).alias("moved")), moved=F.lit(True))
    while best.counts["moved"]:
        # Only nodes whose colour has changed tell it on.
        told = e.df.join(_named(best.light.filter("moved"), s="v", new="c"), [*RUN, "s"]).groupBy(*RUN, F.col("t").alias("v")).agg(F.min("new").alias("new"))
        better = F.coalesce(F.col("new") < F.col("c"), F.lit(False))
        next_ = best.df.join(told, [*RUN, "v"], "left").select(*RUN, "v", F.when(better, F.col("new")).otherwise(F.col("c")).alias("c"), better.alias("moved"))
        best = Rows(next_, moved=F.col("moved"))
    return Rows(best.df.select(*RUN, "v", F.col("c.id").alias("colour")))


def _returning(inside: Rows, colours: Rows) -> Rows:
    """(run, v, colour) of the nodes that reach the node of their colour: with it, a component."""
    found = Rows(colours.df.filter("v = colour").withColumn("moved", F.lit(True)), moved=F.lit(True))
    while found.counts["moved"]:
        back = inside.df.join(_named(found.light.filter("moved"), t="v", colour="colour"), [*RUN, "t", "colour"]).select(*RUN, F.col("s").alias("v"), "colour").distinct()
        new = back.join(_named(found.light, v="v"), [*RUN, "v"], "left_anti").withColumn("moved", F.lit(True))
        found = Rows(found.df.withColumn("moved", F.lit(False)).unionByName(new), moved=F.col("moved"))
    return found


def components(edges: DataFrame, finish=None, finish_edges: int = 0) -> DataFrame:
    """(run, component, id): members of every strongly connected component of more than one node, named by its least member,
    from distinct edges (run, s, t). Nodes off any cycle are trimmed, chains contracted; where that stops helping, every node
    learns the node of least hash that reaches it, and those that reach it back are its component (forward and backward
    reachability, with a pivot for each part of the graph). The rest falls apart by colour and goes on. Where `finish_edges`
    or fewer edges are left in all, `finish` (edges -> run, component, id) takes them."""
    e, seed, contracted, found = Rows(edges.filter("s <> t").select(*RUN, "s", "t")), 0, [], []
    while e.n:
        if finish is not None and e.n <= finish_edges:
            found.append(Rows(finish(e.df).select(*RUN, F.col("id").alias("v"), F.col("component").alias("comp"))).df)
            break
        seed, was = seed + 1, e.n
        e = _trimmed(e)
        if e.n:
            e, gone = _contracted(e, seed)
            if gone.n:
                contracted.append(gone)
        if not e.n or e.n < was * (1 - WORTH):
            continue
        colours = _coloured(e, seed)
        both = e.df.join(_named(colours.light, s="v", a="colour"), [*RUN, "s"]).join(_named(colours.light, t="v", b="colour"), [*RUN, "t"])
        inside = Rows(both.filter("a = b").select(*RUN, "s", "t", F.col("a").alias("colour")))
        done = _returning(inside, colours)
        found.append(done.df.select(*RUN, "v", F.col("colour").alias("comp")))
        gone = _named(done.light, v="v")
        rest = inside.df.join(gone.withColumnRenamed("v", "s"), [*RUN, "s"], "left_anti").join(gone.withColumnRenamed("v", "t"), [*RUN, "t"], "left_anti")
        e = Rows(rest.select(*RUN, "s", "t"))
    none = edges.limit(0).select(*RUN, F.col("s").alias("v"), F.col("s").alias("comp"))
    labels = none
    for f in found:
        labels = labels.unionByName(f)
    # A contracted node lies on a cycle if and only if the nodes before and after it are in one component, or are one node.
    for gone in reversed(contracted):
        at = Rows(labels)
        named = gone.df
        for side in ("before", "after"):
            named = named.join(_named(at.light, **{side: "v", f"c_{side}": "comp"}), [*RUN, side], "left").withColumn(f"c_{side}", F.coalesce(f"c_{side}", side))
        labels = at.df.unionByName(named.filter("c_before = c_after").select(*RUN, "v", F.col("c_before").alias("comp")))
    # A component may hold its own name without a row; one of a single row of that name is no cycle.
    members = labels.unionByName(labels.select(*RUN, F.col("comp").alias("v"), "comp")).distinct()
    named = members.groupBy(*RUN, "comp").agg(F.min("v").alias("component"), F.count("*").alias("n")).filter("n > 1")
    return members.join(named, [*RUN, "comp"]).select(*RUN, "component", F.col("v").alias("id"))


# -- betweenness ------------------------------------------------------------------------------


def _passed(ahead: DataFrame, behind: DataFrame, sources: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """(v, bc): what the shortest paths from `sources` (src) add to the nodes between their ends; and the pairs of source and
    node that were reached."""
    bucketed = lambda df: Bucketed(df, "src", parts)
    t, far, grown = bucketed(sources.select("src", F.col("src").alias("v"), F.lit(0).alias("far"), F.lit(1.0).alias("paths"))), 0, True
    while grown:
        # Every row stays as it is, and those of the last level are told to the nodes ahead besides.
        new = F.sum(F.when(F.col("w") != F.col("v"), F.col("paths")))
        own = [F.min(F.when(F.col("w") == F.col("v"), F.col(x))).alias(x) for x in ("far", "paths")]
        links = ahead.withColumnRenamed("v", "at")
        told = t.df.join(links, (F.col("at") == F.col("v")) & (F.col("far") == far), "left").withColumn("w", F.explode(F.coalesce(F.concat(F.array("v"), "to"), F.array("v"))))
        found = told.groupBy("src", F.col("w").alias("v")).agg(*own, new.alias("new"))
        last, t = t, bucketed(found.select("src", "v", F.coalesce("far", F.lit(far + 1)).alias("far"), F.coalesce("paths", "new").alias("paths")))
        grown, far = t.n > last.n, far + 1
        last.drop()
    # Back from the farthest level: each node hands its share to the nodes before it, in proportion to their paths.
    level = lambda k: t.df.filter(F.col("far") == k).select("src", "v", "paths")
    far -= 1
    below, out = bucketed(level(far).withColumn("share", F.lit(0.0))), []
    while far > 1:
        far -= 1
        given = below.df.join(behind, "v").select("src", F.explode("to").alias("v"), ((1 + F.col("share")) / F.col("paths")).alias("given"))
        shares = level(far).join(given.groupBy("src", "v").agg(F.sum("given").alias("given")), ["src", "v"], "left")
        last, below = below, bucketed(shares.select("src", "v", "paths", F.coalesce(F.col("paths") * F.col("given"), F.lit(0.0)).alias("share")))
        last.drop()
        out.append(Rows(below.df.filter("src <> v and share > 0").groupBy("v").agg(F.sum("share").alias("bc"))).df)
    reached = t.n
    t.drop()
    below.drop()
    total = sources.limit(0).select(F.col("src").alias("v"), F.lit(0.0).alias("bc"))
    for part in out:
        total = total.unionByName(part)
    return total.groupBy("v").agg(F.sum("bc").alias("bc")), reached


def betweenness(edges: DataFrame, reached_rows: int = REACHED_ROWS) -> DataFrame:
    """(run, id, bc) of the nodes that lie on a shortest path between two others, from distinct edges (run, s, t). Levels of a
    breadth-first search from all sources at once carry numbers of paths; shares are summed backwards over the levels. Rows
    (source, node) are stored in buckets by source, so that no round moves them, and meet the lists of neighbours, which are
    broadcast up to LISTED_EDGES. Sources are taken in blocks, so that no more than about `reached_rows` pairs of source and
    node are held at a time; how many a source reaches is learnt from the blocks before."""
    e = Rows(edges.filter("s <> t").select(*RUN, "s", "t"))
    # One number for run and node.
    nodes = Rows(e.df.select(*RUN, F.explode(F.array("s", "t")).alias("id")).distinct().withColumn("k", F.monotonically_increasing_id()))
    named = e.df.join(_named(nodes.light, s="id", v="k"), [*RUN, "s"]).join(_named(nodes.light, t="id", to="k"), [*RUN, "t"])
    pairs = Rows(named.select("v", "to"))
    lists = [Rows(pairs.df.groupBy(F.col(x).alias("v")).agg(F.collect_list(y).alias("to"))).df for x, y in (("v", "to"), ("to", "v"))]
    ahead, behind = [F.broadcast(x) if pairs.n <= LISTED_EDGES else x for x in lists]
    sources = Rows(lists[0].select(F.col("v").alias("src"), F.pmod(F.xxhash64("v"), F.lit(PLACES)).alias("place")))
    n = nodes.df.groupBy(*RUN).agg(F.count("*").alias("n"))
    per_run = e.df.select(*RUN, "s").distinct().groupBy(*RUN).agg(F.count("*").alias("m")).join(n, RUN)
    most = per_run.agg(F.sum(F.col("m").cast("double") * F.col("n"))).first()[0]
    first, done, per_place, room = 0, [], (most or 0) / PLACES, reached_rows
    if most and most > reached_rows:
        room = reached_rows / PILOT
    while first < PLACES and most:
        width = max(1, min(PLACES - first, int(room / per_place)))
        mine = sources.df.filter(F.col("place").between(first, first + width - 1))
        found, reached = _passed(ahead, behind, mine, max(1, min(MOST_PARTS, int(width * per_place) // PART_ROWS)))
        done.append(Rows(found).df)
        first, room = first + width, reached_rows
        if mine.count() >= TOLD_BY:  # others are expected to reach twice as many nodes as these have
            per_place = min(per_place, 2 * reached / width)
    total = sources.df.limit(0).select(F.col("src").alias("v"), F.lit(0.0).alias("bc"))
    for part in done:
        total = total.unionByName(part)
    return total.groupBy("v").agg(F.sum("bc").alias("bc")).join(nodes.df.withColumnRenamed("k", "v"), "v").select(*RUN, "id", "bc")
