"""Near copies by the Jaccard similarity of their word shingles, for the pipeline: one document of each group is kept.

Texts with equal sets of shingles are one node. Candidates come from two
sources. Operator 8's method, SimHash over the same shingles and a self-join of
tries, puts nodes into one bucket that hang together by fingerprints of at most
2 differing bits; these are the closest pairs. At similarity 0.8 fingerprints
differ in some 10 bits, for which tries divide nothing, so all others meet by
an equal band of minimum hashes: with `BANDS` bands of `ROWS` hashes, a pair at
0.8 shares none of them once in 1.7 million. A candidate of either source
counts only by the exact similarity of the two sets. The pairs of a bucket are
checked in three rounds (with the densest node of all that hang together by
buckets, with the densest node of each bucket, all others), and pairs of nodes
that a round has linked already are left out of the next. The last round works
where a bucket's members lie: those that have a like sketch of another root
(pairs whose sketches agree in under `AGREE` of the places are not compared; a
pair at 0.8 is among them some five times in a million) bring their sets, and
only the edges of a forest leave. What moves thus grows with a group's length
and not with its square. A large bucket is dealt out by pairs of blocks of its
members, bounded by their number and by their shingles.

Nulls and ties: a text of fewer words than a shingle is one shingle; texts
without words are one node; null ids rank behind all others; repeated rows
count once.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NULL_ID, durable, light, packed, release, runs, small_batches, spread_join, texts, word_hashes
from .simhash import classes, components, fingerprint, first_of_each
from .simhash import links as trie_links

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS, AGREE = 20, 3, 0.55
#: Members of a bucket, and shingles of them, compared in one task, twice over at most; one set of more is a block's only large one.
BLOCK, SHINGLES = 2000, 2_000_000
#: Sets that one set is compared with at once.
TOGETHER = 256
_rng = random.Random(11)
_FACTORS = np.array([_rng.getrandbits(64) | 1 for _ in range(BANDS * ROWS)], np.uint64)


def shingles(batch: list[bytes], words: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text."""
    hashes, firsts = word_hashes([t.translate(LOWER) for t in batch])
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
        yield np.unique(runs(hashes[a:b], min(words, b - a))) if b > a else hashes[:0]


def sketch(found: np.ndarray) -> np.ndarray:
    """Minimum hashes of a set."""
    out = np.full(len(_FACTORS), 2**64 - 1, np.uint64)
    for i in range(0, len(found), 2048):
        np.minimum(out, (found[i : i + 2048, None] * _FACTORS).min(axis=0), out=out)
    return out


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, key (a hash of the text), node (a hash of its shingles), their number n, bands, sig: a byte of each minimum hash, and fp: the SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, bands, sigs, said = [], [], [], [], texts(batch.column(1))
            for s in shingles(said, words):
                least = sketch(s)
                nodes.append(xxhash.xxh64_intdigest(s.tobytes()))
                sizes.append(len(s))
                rows = least.reshape(BANDS, ROWS)
                bands.append(np.array([xxhash.xxh64_intdigest(r.tobytes(), j) for j, r in enumerate(rows)], np.uint64).view(np.int64) if len(s) else [])
                sigs.append((least >> np.uint64(8)).astype(np.uint8).tobytes())
            fps = np.array([fingerprint(t, words) for t in said], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary()), pa.array(fps)],
                ["doc_id", "key", "node", "n", "bands", "sig", "fp"],
            )

    small_batches(docs.sparkSession)
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.select(F.col("doc_id").cast("long"), "text", key.alias("key")).mapInArrow(run, "doc_id long, key long, node long, n int, bands array<long>, sig binary, fp long")


def with_tries(nodes: DataFrame) -> DataFrame:
    """`nodes` (stored) without fp and with one more band, which is equal for nodes that hang together by SimHash."""
    fps = durable(nodes.groupBy("fp").agg(F.count("*").alias("n")))
    number, total = fps.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    fps = packed(fps, number)
    found = components(trie_links(fps), 3 * number)
    roots = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "fp")
    keyed = durable(fps.join(roots, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root")), number)
    band = F.when(F.col("n") > 0, F.array(F.xxhash64(F.lit("SimHash"), "root"))).otherwise(F.array().cast("array<long>"))
    return durable(spread_join(nodes, keyed, "fp", total).withColumn("bands", F.concat("bands", band)).drop("fp", "root"), total)


def _sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, found): the shingles of `nodes` (node, id, key; stored), read again from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.view(np.int64) for s in shingles(texts(batch.column(1)), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "found"])

    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "text")
    picked = keyed.join(light(nodes), ["id", "key"]).select("node", "text")
    return picked.mapInArrow(run, "node long, found array<long>").dropDuplicates(["node"])


def _near(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of `pairs` (a, b) with at least `similarity`. One side of many pairs is grouped with them, so that its set
    travels once to each task and not once for each pair."""
    left, right = (sets.select(F.col("node").alias(x), F.col("found").alias("f" + x)) for x in ("a", "b"))
    both = pairs.join(right, "b").join(left, "a").withColumn("both", F.size(F.array_intersect("fa", "fb")))
    return both.filter(F.col("both") >= F.lit(similarity - 1e-9) * (F.size("fa") + F.size("fb") - F.col("both"))).select("a", "b")


def _fields(members, *names: str) -> list[np.ndarray]:
    return [members.field(k).to_numpy() for k in names]


def _alike(similarity: float):
    """(bucket, part, node, root) of members of a bucket, or of two blocks of one, that have a like size and a like sketch to
    one of another root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, part, members in zip(*(batch.column(k) for k in range(3))):
                m = members.values
                node, root, n = _fields(m, "node", "root", "n")
                sig = np.frombuffer(b"".join(m.field("sig").to_pylist()), np.uint8).reshape(len(node), -1)
                some = np.zeros(len(node), bool)
                for i in range(len(node) - 1):
                    j = i + 1 + np.flatnonzero(_fit(root, n, i, similarity))
                    j = j[(sig[j] == sig[i]).mean(axis=1) >= AGREE]
                    some[j] = True
                    some[i] |= len(j) > 0
                if some.any():
                    k = int(some.sum())
                    keys = [pa.array([bucket.as_py()] * k, pa.int64()), pa.array([part.as_py()] * k, batch.schema.field(1).type)]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(node[some]), pa.array(root[some])], ["bucket", "part", "node", "root"])

    return run


def _fit(root: np.ndarray, n: np.ndarray, i: int, similarity: float) -> np.ndarray:
    """Which members behind `i` have another root and a size that `similarity` allows."""
    fit = root[i + 1 :] != root[i]
    fit &= np.minimum(n[i + 1 :], n[i]) >= (similarity - 1e-9) * np.maximum(n[i + 1 :], n[i])
    return fit


def _joined(similarity: float):
    """Edges (a, b) of a forest that connects the members of each list as pairs of at least `similarity` do, where members
    of one root are connected already. Sets are compared where they lie, and no pair leaves but those that join two trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members in batch.column(0):
                m = members.values
                node, root = _fields(m, "node", "root")
                found = m.field("found")
                n = np.diff(found.offsets.to_numpy())
                edges = _forest(root, n, np.unique(found.flatten().to_numpy(), return_inverse=True)[1], similarity)
                if edges:
                    ends = node[np.array(edges)]
                    yield pa.RecordBatch.from_arrays([pa.array(ends.min(axis=1)), pa.array(ends.max(axis=1))], ["a", "b"])

    return run


def _forest(root: np.ndarray, n: np.ndarray, items: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Places (i, j) of the pairs that join two trees. The sets lie behind each other in `items` (numbers from 0 on)."""
    root, starts, edges = root.copy(), np.cumsum(n) - n, []
    mine = np.zeros(int(items.max()) + 1 if len(items) else 1, bool)
    for i in range(len(n) - 1):
        fit = i + 1 + np.flatnonzero(_fit(root, n, i, similarity))
        if not len(fit):
            continue
        own = items[starts[i] : starts[i] + n[i]]
        mine[own] = True
        for k in range(0, len(fit), TOGETHER):
            j = fit[k : k + TOGETHER]
            ends = np.cumsum(n[j])
            hits = np.concatenate([[0], np.cumsum(mine[items[np.repeat(starts[j] - (ends - n[j]), n[j]) + np.arange(ends[-1])]])])
            both = hits[ends] - hits[ends - n[j]]
            for x in j[both >= (similarity - 1e-9) * (n[i] + n[j] - both)].tolist():
                if root[x] != root[i]:
                    edges.append((i, x))
                    root[root == root[x]] = root[i]
        mine[own] = False
    return edges


def _dealt(rows: DataFrame, block: int, shingles_: int = SHINGLES) -> DataFrame:
    """`rows` of members with their bucket's number of members `m` and of shingles `w`, for each pair of blocks of about
    `block` members and `shingles_` shingles: any two members meet in one task, and no task holds more than two blocks."""
    blocks = F.ceil(F.greatest(F.col("m") / block, F.col("w") / shingles_)).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(own, k).alias("x"), F.greatest(own, k).alias("y")))
    return rows.withColumn("part", F.explode(pairs)).withColumn("part", F.col("part.x").cast("long") * blocks + F.col("part.y"))


def links(docs: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect all of `nodes` (node, id, key, n, bands, sig) of at least `similarity`."""
    keyed = nodes.select("node", F.col("n").alias("size"), F.explode("bands").alias("band"))
    # Buckets with the same members are one; members are summed up, not listed.
    sums = keyed.groupBy("band").agg(F.min("node").alias("first"), F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(38,0)")).alias("t")).filter("n > 1")
    buckets = durable(sums.dropDuplicates(["first", "n", "s", "t"]).drop("s", "t"))
    total = buckets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    held = durable(spread_join(keyed, buckets.drop("first").withColumn("m", F.col("n")), "band", total).withColumnRenamed("band", "bucket"), total)
    # The node that meets most others stands in the middle of a group: one comparison with it links what comparisons with a
    # node at the edge would leave open.
    dense = durable(held.groupBy("node").agg(F.sum("m").alias("dense")), total)
    ranked = packed(held.join(dense, "node"), total)
    tops = ranked.groupBy("bucket").agg(F.max(F.struct("dense", "node"))["node"].alias("first"), F.count("*").alias("n"))
    members = durable(spread_join(held, durable(tops, total), "bucket", total), total)
    star = lambda rows: packed(rows.filter("first <> node").select(F.col("first").alias("a"), F.col("node").alias("b")), total).distinct()
    found = components(star(members), total)
    whole = durable(found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()).join(dense, "node"), total)
    pivots = durable(whole.groupBy("root").agg(F.max(F.struct("dense", "node"))["node"].alias("a"), F.count("*").alias("n")), total)
    hung = durable(spread_join(whole.select("node", "root"), pivots, "root", total).filter("a <> node").select("a", F.col("node").alias("b")), total)
    wanted = hung.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = durable(_sets(docs, durable(nodes.select("node", "id", "key").join(wanted, "node"), total), words), total)
    edges = durable(_near(hung, sets, similarity), total)
    for last in (False, True):
        rooted = members.drop("m").join(components(edges, 2 * total), "node", "left").withColumn("root", F.coalesce("root", "node"))
        rooted = durable(rooted, total)
        sums = [F.min("root").alias("r"), F.max("root").alias("s"), F.count("*").alias("n"), F.count("*").alias("m"), F.sum("size").alias("w")]
        open_ = durable(rooted.groupBy("bucket").agg(*sums).filter("r <> s").select("bucket", "n", "m", "w"), total)
        rows = spread_join(rooted, open_, "bucket", total)
        if last:
            more = _compared(rows, nodes, sets, similarity, block)
        else:
            more = _near(star(rows), sets, similarity)
        edges = durable(edges.unionByName(packed(more, total)), 3 * total)
        release(docs.sparkSession)
    return edges


def _compared(rows: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """Edges among the members (bucket, node, root, m, w) of each bucket. Sketches meet first; only members with a like
    sketch of another root bring their sets along."""
    key, part = ["bucket", "part"], F.collect_list(F.struct("node", "root", "n", "sig")).alias("ms")
    dealt = _dealt(rows.select("bucket", "node", "root", "m", "w"), block).join(nodes.select("node", "n", "sig"), "node")
    alike = dealt.groupBy(*key).agg(part).select(*key, "ms").mapInArrow(_alike(similarity), "bucket long, part long, node long, root long")
    lists = durable(alike).join(sets, "node").groupBy(*key).agg(F.collect_list(F.struct("node", "root", "found")).alias("ms"))
    return lists.select("ms").mapInArrow(_joined(similarity), "a long, b long").distinct()


def keep_first(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """One row of `docs` for each group of near copies: of least doc_id, and of least hash of the text among equal or null ids."""
    rows = durable(sketches(docs, words))
    ids = F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.col("key"), "n", "bands", "sig", "fp")
    nodes = with_tries(durable(rows.groupBy("node").agg(F.min(ids).alias("r")).select("node", "r.*")))
    found = classes(rows.select("doc_id", "key", "node"), "node", lambda _: links(docs, nodes, similarity, words))
    return first_of_each(docs, spread_join(rows.select("doc_id", "key", "node"), found[0], "node", found[1]))
