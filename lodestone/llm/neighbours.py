"""Operator 12: approximate nearest neighbours by largest inner product.

A vector of norm r gets one more component, the root of R*R - r*r with the
largest norm R, and a query a zero, which turns the largest inner product into
the least distance. A hierarchical k-means tree is fitted on a bounded sample;
every row goes to one of its leaves, and the rows of a leaf lie together in
blocks of bounded size. A query walks the tree best bin first: a priority
queue holds the nodes met and not yet opened, the one nearest to the query,
less a share of its spread, comes next, and leaves are visited in the order in
which they come up. How many is found by calibration: for a bounded sample of
queries the exact neighbours are sought among all rows, and visits are widened
until the tree finds the wanted share of them. A query then meets the blocks
of its leaves by a join on leaf and block, and keeps its best of each.

Nulls and ties: vectors that are null, zero, or hold null or non-finite
components take no part, nor do those of another length than most have (the
longer of equally many); null ids are candidates but no queries, and rank
behind others of equal score; a repeated row is a candidate for its copies and
a query of its own; equal scores rank by vec_id; scores are sums in the order
of the components, so equal vectors have equal scores. Visits go on until
there are as many candidates as were asked for, or no leaf is left. An empty
table, or one without queries, gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches, table
from .vector_codes import matrix, usual_length, whole_vectors

#: Neighbours, and the queries: ids that this divides.
NEIGHBOURS, EVERY = 20, 20
#: Rows that the tree is fitted on, about; queries that visits are calibrated by, about; the share of true neighbours to find.
SAMPLE, CALIBRATION, RECALL = 20_000, 200, 0.95
#: Children of a node; rows of a leaf, at least (else twice the root of all rows); leaves at most, about; rounds of k-means.
BRANCH, LEAF_ROWS, MOST_LEAVES, ROUNDS = 8, 200, 4096, 12
#: Share of a node's spread by which it comes up earlier.
SPREAD = 0.3
#: Vectors, and queries, of a block.
BLOCK_ROWS = 1024
#: Pairs that a task holds before it merges them.
HELD_ROWS = 500_000


# -- the tree ------------------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes in the order in which they were made. Children are `first` to `last`; a leaf has its number in `leaf`, other nodes -1."""

    centres: np.ndarray
    spread: np.ndarray
    first: np.ndarray
    last: np.ndarray
    leaf: np.ndarray
    reach: float

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(self.reach**2 - (x * x).sum(1), 0))[:, None]], 1)

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, by the nearest child at every node."""
        x, out, todo = self.lifted(x), np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            v, rows = todo.pop()
            if self.leaf[v] >= 0:
                out[rows] = self.leaf[v]
            elif len(rows):
                best = _squares(x[rows], self.centres[self.first[v] : self.last[v]]).argmin(1)
                todo += [(int(self.first[v]) + k, rows[best == k]) for k in range(int(self.last[v] - self.first[v]))]
        return out

    def visits(self, queries: np.ndarray, least: int, sizes: np.ndarray, rows: int) -> Iterator[list[int]]:
        """The first `least` leaves of each query, best bin first, and more until they hold `rows` rows."""
        zero = np.concatenate([queries, np.zeros((len(queries), 1))], 1)
        for at in range(0, len(zero), 256):
            far = _squares(zero[at : at + 256], self.centres) - SPREAD * self.spread
            for d in far.tolist():
                queue, found, held = [(0.0, 0)], [], 0
                while queue and (len(found) < least or held < rows):
                    _, v = heapq.heappop(queue)
                    if self.leaf[v] >= 0:
                        found.append(int(self.leaf[v]))
                        held += int(sizes[self.leaf[v]])
                    else:
                        for w in range(self.first[v], self.last[v]):
                            heapq.heappush(queue, (d[w], w))
                yield found


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances less the square of each x, which no comparison needs."""
    return (centres * centres).sum(1) - 2 * (x @ centres.T)


def _clusters(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """The cluster of each row by k-means, begun from rows drawn in proportion to their squared distance from those drawn."""
    centres, far = [x[rng.integers(len(x))]], np.full(len(x), np.inf)
    while len(centres) < k:
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(1))
        if not far.sum() > 0:
            break
        centres.append(x[rng.choice(len(x), p=far / far.sum())])
    c = np.array(centres)
    for _ in range(ROUNDS):
        best = _squares(x, c).argmin(1)
        counts = np.bincount(best, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, best, x)
        c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
    return _squares(x, c).argmin(1)


def fit(sample: np.ndarray, reach: float, leaf_rows: int, seed: int = 7) -> Tree:
    """A tree over `sample` with about `leaf_rows` of its rows in a leaf, vectors being no longer than `reach`."""
    rng, tree = np.random.default_rng(seed), Tree(*[np.zeros(0)] * 5, reach)
    x = tree.lifted(sample)
    nodes, kids, at = [np.arange(len(x))], [], 0
    while at < len(nodes):
        rows, kid = nodes[at], (0, 0)
        if len(rows) > leaf_rows:
            best = _clusters(x[rows], min(BRANCH, -(-len(rows) // leaf_rows) + 1), rng)
            parts = [rows[best == k] for k in np.unique(best)]
            if len(parts) > 1:
                kid = (len(nodes), len(nodes) + len(parts))
                nodes += parts
        kids.append(kid)
        at += 1
    centres = np.array([x[r].mean(0) for r in nodes])
    spread = np.array([((x[r] - c) ** 2).sum(1).mean() for r, c in zip(nodes, centres)])
    first, last = np.array(kids).T
    bare = first == last
    return Tree(centres, spread, first, last, np.where(bare, np.cumsum(bare) - 1, -1), reach)


# -- scores ------------------------------------------------------------------------------------


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, component by component, so that they depend on the two vectors alone."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * x[:, d]
    return out


@dataclass
class Found:
    """Pairs of a query and a candidate: the query's number, the candidate's row, id (nulls last) and leaf (or the query's id), and
    the score."""

    query: np.ndarray
    row: np.ndarray
    vec_id: np.ndarray
    null: np.ndarray
    leaf: np.ndarray
    score: np.ndarray

    def best(self, k: int) -> Found:
        """The first `k` of each query."""
        order = np.lexsort((self.row, self.vec_id, self.null, -self.score, self.query))
        q = self.query[order]
        start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
        return self._at(order[rank < k])

    def _at(self, at: np.ndarray) -> Found:
        return Found(self.query[at], self.row[at], self.vec_id[at], self.null[at], self.leaf[at], self.score[at])


def joined(parts: list[Found]) -> Found:
    return Found(*[np.concatenate([getattr(p, f) for p in parts]) for f in Found.__dataclass_fields__])


def nearest(q: np.ndarray, q_rows: np.ndarray, x: np.ndarray, rows: np.ndarray, ids: pa.Array, leaf: np.ndarray, k: int) -> Found:
    """The `k` best of `x` for each of `q`, itself left out: a quick product first, then exact ones of all that come near the k-th."""
    rough = q @ x.T
    own = q_rows[:, None] == rows[None, :]
    rough[own] = -np.inf
    if len(x) > k:
        limit = np.partition(rough, len(x) - k, 1)[:, len(x) - k]
        slack = 1e-9 * np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1).max())
        at, to = np.nonzero((rough >= (limit - slack)[:, None]) & ~own)
    else:
        at, to = np.nonzero(~own)
    null = ids.is_null().to_numpy(zero_copy_only=False)
    number = ids.fill_null(0).to_numpy(zero_copy_only=False)
    return Found(at, rows[to], number[to], null[to], leaf[to], exact(q[at], x[to])).best(k)


# -- jobs ------------------------------------------------------------------------------------------


def _vectors(nested: pa.ListScalar, dims: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The row numbers, vectors and ids of one block."""
    v = nested.values
    return matrix(v.field("embedding"), dims), v.field("row").to_numpy(zero_copy_only=False), v.field("vec_id")


def _assigned(tree: Tree, dims: int) -> Callable:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = tree.leaf_of(matrix(b.column("embedding"), dims))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int32())], [*b.schema.names, "leaf"])

    return assign


def _truth(q: np.ndarray, q_rows: np.ndarray, dims: int, k: int) -> Callable:
    """The k nearest of all rows of a partition for each of the bounded sample of queries."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                c = b.slice(at, BLOCK_ROWS)
                rows, leaf = (c.column(n).to_numpy(zero_copy_only=False) for n in ("row", "leaf"))
                found = nearest(q, q_rows, matrix(c.column("embedding"), dims), rows, c.column("vec_id"), leaf, k)
                best = found if best is None else joined([best, found]).best(k)
        if best is not None:
            out = [pa.array(best.query, pa.int32()), pa.array(best.row, pa.int64()), pa.array(best.leaf, pa.int32()), pa.array(best.score)]
            yield pa.RecordBatch.from_arrays(out, ["query", "row", "leaf", "score"])

    return search


def _walks(tree: Tree, dims: int, least: int, sizes: np.ndarray, rows: int) -> Callable:
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaves = list(tree.visits(matrix(b.column("embedding"), dims), least, sizes, rows))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaves, pa.list_(pa.int32()))], [*b.schema.names, "leaves"])

    return walk


def _scores(dims: int, k: int) -> Callable:
    """The k best of each query over the pairs of blocks that a task meets. Pairs are merged as they come, and what is held is
    passed on when it is too much."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Found] = []
        n = 0
        for b in batches:
            for asked, members in zip(b.column("queries"), b.column("members")):
                q, q_rows, q_ids = _vectors(asked, dims)
                x, rows, ids = _vectors(members, dims)
                f = nearest(q, q_rows, x, rows, ids, rows, k)
                f.leaf, f.query = q_ids.to_numpy(zero_copy_only=False)[f.query], q_rows[f.query]
                held.append(f)
                n += len(f.row)
                if n > HELD_ROWS:
                    held = [joined(held).best(k)]
                    n = len(held[0].row)
                    if n > HELD_ROWS // 2:
                        yield _rows(held.pop())
                        n = 0
        if held:
            yield _rows(joined(held).best(k))

    return score


def _rows(f: Found) -> pa.RecordBatch:
    near = pa.array(f.vec_id, pa.int64(), mask=f.null)
    out = [pa.array(f.query, pa.int64()), pa.array(f.leaf, pa.int64()), near, pa.array(f.row, pa.int64()), pa.array(f.score)]
    return pa.RecordBatch.from_arrays(out, ["asker", "query_id", "vec_id", "row", "score"])


def _dealt(df: DataFrame, sizes: DataFrame, name: str) -> DataFrame:
    """Rows of each leaf in blocks of about BLOCK_ROWS, dealt out by a hash of the row; `sizes` has a bounded number of leaves."""
    parts = F.ceil(F.col("n") / BLOCK_ROWS)
    held = F.collect_list(F.struct("row", "vec_id", "embedding")).alias(name)
    block = F.pmod(F.xxhash64("row"), parts).alias("block")
    return df.join(F.broadcast(sizes), "leaf").select("leaf", block, "row", "vec_id", "embedding").groupBy("leaf", "block").agg(held)


def calibrated(tree: Tree, q: np.ndarray, truth: list, sizes: np.ndarray, recall: float) -> tuple[int, float]:
    """Leaves to visit so that the share `recall` of the true neighbours (query, leaf) is found, and the share that is."""
    order = [{leaf: k for k, leaf in enumerate(x)} for x in tree.visits(q, tree.leaves, sizes, 0)]
    ranks = np.array([order[r["query"]][r["leaf"]] for r in truth])
    visits, found = 1, 0.0
    while len(ranks) and (found := float((ranks < visits).mean())) < recall and visits < tree.leaves:
        visits = min(tree.leaves, visits + max(1, visits // 8))
    return visits, found


def search(df: DataFrame, queries, k: int = NEIGHBOURS, recall: float = RECALL, sample: int = SAMPLE, leaf_rows: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the `k` nearest rows found for each row of `df` (vec_id, embedding) where `queries` is true."""
    spark = df.sparkSession
    small_batches(spark, 4 * BLOCK_ROWS)
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    kind = "array<float>" if dict(df.dtypes)["embedding"] == "array<float>" else "array<double>"
    typed = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    whole = whole_vectors(typed, "embedding").withColumn("norm", norm).filter("norm > 0")
    scratch = Scratch(spark)
    rows = scratch.keep(whole.withColumn("row", F.monotonically_increasing_id()), "vectors")
    dims = usual_length(rows, "embedding")
    rows = rows.filter(F.size("embedding") == dims).select("row", "vec_id", "embedding", "norm")
    known = rows.agg(F.count("*").alias("n"), F.max("norm").alias("reach"), F.count_if(queries).alias("queries")).first()
    if not known["queries"]:
        return nothing

    def drawn(part: DataFrame, n: int, most: int, seed: int):
        """About `most` of n rows, by a hash of their number."""
        few = part.filter(F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, most / n) * (1 << 30)))
        return few.select("row", "embedding").toArrow()

    fitted = matrix(drawn(rows, known["n"], sample, 1).column("embedding").combine_chunks(), dims)
    size = max(leaf_rows or max(LEAF_ROWS, 2 * known["n"] ** 0.5), known["n"] / MOST_LEAVES)
    of_leaf = max(1, round(size * min(1.0, sample / known["n"])))
    tree = fit(fitted if len(fitted) else np.zeros((1, dims)), known["reach"], of_leaf)
    index = scratch.keep(rows.drop("norm").mapInArrow(_assigned(tree, dims), f"row long, vec_id long, embedding {kind}, leaf int"), "index")
    counts = index.groupBy("leaf").agg(F.count("*").alias("n"))  # at most one row for each leaf of the tree
    sizes = np.zeros(tree.leaves, np.int64)
    for r in counts.collect():
        sizes[r["leaf"]] = r["n"]
    leaf_sizes = spark.createDataFrame([(i, int(n)) for i, n in enumerate(sizes) if n], "leaf int, n long")

    asking = index.filter(queries).drop("leaf")
    few = drawn(asking, known["queries"], CALIBRATION, 2)
    q, q_rows = matrix(few.column("embedding").combine_chunks(), dims), few.column("row").to_numpy()
    if len(q):
        first = Window.partitionBy("query").orderBy(F.desc("score"), "row")
        near = index.mapInArrow(_truth(q, q_rows, dims, k), "query int, row long, leaf int, score double")
        truth = near.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k).select("query", "leaf").collect()
        visits, _ = calibrated(tree, q, truth, sizes, recall)
    else:
        visits = tree.leaves
    walks = scratch.keep(asking.mapInArrow(_walks(tree, dims, visits, sizes, k + 1), f"row long, vec_id long, embedding {kind}, leaves array<int>"), "walks")
    asked = walks.select("row", "vec_id", "embedding", F.explode("leaves").alias("leaf"))
    asked_sizes = scratch.keep(asked.groupBy("leaf").agg(F.count("*").alias("n")), "asked")
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / BLOCK_ROWS) - 1)).alias("block")
    askers = _dealt(asked, asked_sizes, "queries").drop("block").join(F.broadcast(leaf_sizes), "leaf").select("leaf", "queries", blocks)
    pairs = _dealt(index, leaf_sizes, "members").join(askers, ["leaf", "block"]).select("queries", "members")
    found = pairs.mapInArrow(_scores(dims, k), "asker long, query_id long, vec_id long, row long, score double")
    order = Window.partitionBy("asker").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
