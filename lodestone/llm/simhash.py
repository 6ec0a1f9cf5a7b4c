"""Operator 8: SimHash near-duplicates by a self-join of binary tries.

Fingerprints are made where the documents are read. Equal fingerprints meet in
a map-side aggregate, so a group of copies is one key from then on. Two
fingerprints with at most 2 differing bits agree on one of three blocks of
bits, so the tries are dealt out by (block, value); a key with too many
fingerprints is dealt out again by blocks of its other bits, level by level,
which loses no link and bounds each trie: after five levels 8 bits are open.
In a trie, pairs of nodes are walked down together, level by level for all
tries of a batch at once; differing bits add up, and a pair over the budget is
dropped. Each trie passes on the edges of a spanning forest only. Components
come from star contraction on the edges, with a checkpoint in each round; ids
come back to documents by a join in which hot fingerprints are broadcast, of
which there are fewer than a fixed number at any size of input.

Nulls and ties: a null or empty text has no shingles and fingerprint zero,
linked like any other; null ids rank behind all others and a group of them
alone has a null component_id; repeated rows link to each other; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, durable, light, packed, release, small_batches, spread_join, table, texts

WORDS, SEED, BITS = 3, 42, 2
#: Fingerprints in one trie at most; a key with more is dealt out anew.
TRIE = 2048
#: Edges of a graph whose hot nodes need no care: 16 bytes each, they fit in one task.
FEW_EDGES = 1_000_000
#: Shingles hashed at once.
CHUNK = 255 * 128


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """SimHash of the word shingles of `text`."""
    parts = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not parts:
        return 0
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return digest(joined, seed)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = len(parts) - words + 1
    sums = np.zeros(64, np.int64)
    del parts
    for i in range(0, n, CHUNK):  # a byte for each bit of each hash: a chunk at a time
        j = min(i + CHUNK, n)
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[i:j].tolist(), ends[i + words - 1 : j + words - 1].tolist())], ">u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        full = len(bits) - len(bits) % 255  # sums of 255 bits fit in a byte
        sums += bits[full:].sum(axis=0, dtype=np.int64) + bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * sums > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed number) and key (a hash of the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in texts(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), batch.column(2)], ["doc_id", "fp", "key"])

    small_batches(docs.sparkSession)
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.select(F.col("doc_id").cast("long"), "text", key.alias("key")).mapInArrow(run, "doc_id long, fp long, key long")


# -- tries --------------------------------------------------------------------


def trie_pairs(fps: np.ndarray, tries: np.ndarray, budget: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places (i < j) of all pairs of one trie with at most `budget` differing bits.
    `fps` (unsigned) must be sorted within each trie, `tries` be ascending."""
    n = len(fps)
    firsts = np.flatnonzero(np.concatenate([[True], tries[1:] != tries[:-1]])) if n else np.zeros(0, np.int64)
    lo = firsts
    hi = np.concatenate([firsts[1:], [n]])
    a_lo, a_hi, b_lo, b_hi = lo, hi, lo, hi
    errors = np.zeros(len(lo), np.int8)
    left, right = [], []
    for bit in range(63, -1, -1):
        # A pair of single leaves is settled at once; a leaf with itself is no pair.
        leaf = (a_hi - a_lo == 1) & (b_hi - b_lo == 1)
        i, j = a_lo[leaf], b_lo[leaf]
        near = (i != j) & (np.bitwise_count(fps[i] ^ fps[j]) <= budget)
        left.append(i[near])
        right.append(j[near])
        a_lo, a_hi, b_lo, b_hi, errors = (x[~leaf] for x in (a_lo, a_hi, b_lo, b_hi, errors))
        if not len(a_lo):
            break
        ones = np.concatenate([[0], np.cumsum((fps >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        a_mid, b_mid = a_hi - (ones[a_hi] - ones[a_lo]), b_hi - (ones[b_hi] - ones[b_lo])
        same = a_lo == b_lo  # a node with itself: its two children meet once
        parts = []
        for (al, ah), (bl, bh), cost, keep in (
            ((a_lo, a_mid), (b_lo, b_mid), 0, None),
            ((a_mid, a_hi), (b_mid, b_hi), 0, None),
            ((a_lo, a_mid), (b_mid, b_hi), 1, None),
            ((a_mid, a_hi), (b_lo, b_mid), 1, ~same),
        ):
            ok = (ah > al) & (bh > bl) & (errors + cost <= budget)
            if keep is not None:
                ok &= keep
            parts.append((al[ok], ah[ok], bl[ok], bh[ok], errors[ok] + np.int8(cost)))
        a_lo, a_hi, b_lo, b_hi, errors = (np.concatenate(x) for x in zip(*parts))
    else:
        i, j = a_lo, b_lo
        far = i != j
        left.append(i[far])
        right.append(j[far])
    i, j = np.concatenate(left), np.concatenate(right)
    return np.minimum(i, j), np.maximum(i, j)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges (root, node) of a spanning forest of the graph on 0..n-1."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    touched = set()
    for a, b in zip(left.tolist(), right.tolist()):
        touched.update((a, b))
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(r, x) for x in touched if (r := root(x)) != x]


def _edges(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b) edges from rows that hold the fingerprints of one trie each."""
        for batch in batches:
            lists = batch.column(0)
            sizes = np.diff(lists.offsets.to_numpy())
            values = lists.flatten().to_numpy().view(np.uint64)
            at, group = 0, []
            for k in [*range(len(sizes)), None]:
                # Small tries are walked together; the pairs of one batch stay bounded.
                if group and (k is None or sizes[group].sum() + sizes[k] > 2 * TRIE):
                    total = int(sizes[group].sum())
                    fps, tries = values[at : at + total], np.repeat(np.arange(len(group)), sizes[group])
                    fps = fps[np.lexsort((fps, tries))]
                    found = np.array([(fps[a], fps[b]) for a, b in forest(total, *trie_pairs(fps, tries, budget))], np.uint64).reshape(-1, 2).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["a", "b"])
                    at += total
                    group = []
                if k is not None:
                    group.append(k)

    return run


def _blocks(left: int, budget: int) -> list[int]:
    """Masks of budget + 1 blocks of the bits set in `left`, of like sizes: two fingerprints within `budget` agree on one of them."""
    places = [i for i in range(63, -1, -1) if left >> i & 1]
    cuts = [len(places) * i // (budget + 1) for i in range(budget + 2)]
    return [sum(1 << p for p in places[a:b]) for a, b in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


def _deal(rows: DataFrame, used: list[int] | None, budget: int) -> tuple[DataFrame, list[int]]:
    """`rows` (fp, and mask if dealt before) for each block of the bits that its mask leaves open, with the block added to
    the mask; and all masks so made. Members of one trie share mask and fp & mask."""
    if used is None:
        masks = _blocks(2**64 - 1, budget)
        return rows.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask")), masks
    found, out = {}, F.lit(None)
    for u in used:
        found[u] = [u | b for b in _blocks(~u & 2**64 - 1, budget) if b]
        out = F.when(F.col("mask") == F.lit(_signed(u)), F.array(*[F.lit(_signed(m)) for m in found[u]])).otherwise(out)
    return rows.select("fp", F.explode(out).alias("mask")), sorted({m for ms in found.values() for m in ms})


#: Times that a key may be dealt anew: five levels leave 8 bits open with a budget of 2, so a trie has 256 members at most.
LEVELS = 5


def links(fps: DataFrame, budget: int = BITS, trie: int = TRIE) -> DataFrame:
    """Edges (a, b) that connect all fingerprints within `budget` bits of each other; `fps` has distinct fp.

    A key of more than `trie` fingerprints is dealt again by blocks of its other bits. At the last level a key may hold
    any number, but no more than the open bits allow, and it is walked as a trie like all others."""
    dealt, masks = _deal(fps.select("fp"), None, budget)
    parts = []
    for level in range(LEVELS):
        keyed = dealt.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        hot = None
        if level < LEVELS - 1:
            hot = durable(keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).filter(F.col("n") > trie).select("mask", "key"))
            hot = None if hot.isEmpty() else hot
        cool = keyed if hot is None else keyed.join(hot, ["mask", "key"], "left_anti")
        parts.append(cool.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("fps").mapInArrow(_edges(budget), "a long, b long"))
        if hot is None:
            break
        # The same mask may be reached in two ways; a trie is walked once.
        again, masks = _deal(keyed.join(hot, ["mask", "key"]).select("fp", "mask"), masks, budget)
        dealt = durable(again.distinct())
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# -- components ---------------------------------------------------------------


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, root): root is the least node of each component of at least two nodes. Star contraction:
    each round links the larger neighbours of a node, then the smaller ones, to its least neighbour. A node of very many
    neighbours is a hot key of both joins, and is broadcast. `most` bounds the number of edges, if it is known."""
    spark = edges.sparkSession
    edges = durable(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), most)
    before = None
    while True:
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        ends = 2 * state[0]
        # Only in a large graph can a node have so many neighbours that its join would keep a task long.
        large_graph = state[0] > FEW_EDGES
        stored = (lambda df: durable(df, ends)) if large_graph else (lambda df: df)
        join = (lambda x, y: spread_join(x, y, "u", ends)) if large_graph else (lambda x, y: x.join(y.drop("n"), "u"))
        edges = packed(edges, ends)
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m")))
        large = packed(join(both, least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v"), ends)
        large = durable(large.distinct(), ends)
        # Small star: every node with its smaller neighbours joins the least of them.
        least = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = join(large, least).select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        edges = durable(packed(small.filter("u <> v"), ends).distinct(), ends)
        release(spark)


def classes(rows: DataFrame, node: str, link) -> tuple[DataFrame, int]:
    """For each `node` of `rows` (doc_id, key, and the node): its number of rows n, the root of its component, and the first
    row of the component by id and text (least); `link` gives the edges of the distinct nodes. And the number of rows."""
    rank = F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.col("key"))
    firsts = durable(rows.groupBy(node).agg(F.min(rank).alias("first"), F.count("*").alias("n")))
    found = components(link(firsts))
    linked = durable(found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()).distinct().withColumnRenamed("node", node))
    named = linked.join(firsts, node)
    least = durable(named.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("n")))
    total = least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    better = spread_join(named.select(node, "root"), least, "root", total)
    out = firsts.join(better, node, "left").select(node, "n", F.coalesce("root", node).alias("root"), F.coalesce("least", "first").alias("least"))
    out = durable(out)
    return out, out.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def near_duplicates(docs: DataFrame, budget: int = BITS, trie: int = TRIE, words: int = WORDS) -> DataFrame:
    """doc_id, fp and component_id of each row of `docs`."""
    rows = durable(fingerprints(docs, words))
    out = spread_join(rows, *_with(classes(rows, "fp", lambda fps: links(fps, budget, trie)), "fp"))
    return out.select("doc_id", "fp", F.when(F.col("least.id") != NULL_ID, F.col("least.id")).alias("component_id"))


def _with(found: tuple[DataFrame, int], key: str) -> tuple[DataFrame, str, int]:
    return found[0], key, found[1]


def keep_first(docs: DataFrame, budget: int = BITS, trie: int = TRIE, words: int = WORDS) -> DataFrame:
    """One row of `docs` for each group: of least doc_id, and of least hash of the text among equal or null ids."""
    rows = durable(fingerprints(docs, words))
    return first_of_each(docs, spread_join(rows, *_with(classes(rows, "fp", lambda fps: links(fps, budget, trie)), "fp")))


def first_of_each(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of `docs` that are the first of their group, where `named` has doc_id, key and least of every row. The rows
    that go are named to the scan if they are few; else texts are shuffled."""
    named = named.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("_i"), F.col("key").alias("_k"), "least")
    keyed = docs.withColumns({"_i": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), "_k": F.xxhash64(F.coalesce("text", F.lit("")))})
    gone = durable(named.filter((F.col("_i") != F.col("least.id")) | (F.col("_k") != F.col("least.key"))).select("_i", "_k").distinct())
    kept = keyed.join(light(gone), ["_i", "_k"], "left_anti")
    repeated = named.groupBy("_i", "_k").agg(F.count("*").alias("n")).filter("n > 1")
    if not repeated.isEmpty():  # equal rows with equal ids
        kept = kept.dropDuplicates(["_i", "_k"])
    return kept.drop("_i", "_k")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
