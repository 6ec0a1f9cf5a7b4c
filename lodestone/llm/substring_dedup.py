"""Operator 1: exact substring deduplication by seed and extend.

Seeds are winnowed anchors: of the 5-word sequences in each window of 13
words, the one of least hash. Equal windows have equal anchors at the same
place, so texts that share a window meet in the join on anchors. Each
occurrence of an anchor that two documents share then brings the words around
it, as many on either side as a window can reach. Matches are extended both
ways on these words: the occurrences of an anchor are met in the order of
their doc_id, and split into classes by the words on the left and the right,
for each way to share the length of a window between the two sides; each
class remembers its least doc_id, so no pair of occurrences is formed. What
an occurrence shares with a smaller document is a match, matches of
neighbouring anchors merge into maximal repeats, and the words of repeats of
13 words or more are removed.

Hashes only bring occurrences together; matches are compared as words.
Surroundings that many documents share are one row after map-side aggregates,
whatever the number of documents; hot anchors and surroundings are joined by a
broadcast of bounded size; an anchor with very many different surroundings is
dealt out by the words of its windows.

Nulls and ties: a null text has no words; null ids rank behind all others;
rows with equal doc_id, repeated rows included, do not remove from each other;
windows are judged on the input; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, Scratch, chunk_words, release, runs, small_batches, spread_join, table, texts

WINDOW, SEED = 13, 5
#: Rows of surroundings of one anchor that move as they are, and different ones that are met in one task; an anchor with more
#: is summed up first, and one that still has more is dealt out.
OFTEN, WIDE = 256, 20_000


def _slices(batches: Iterator[pa.RecordBatch], limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about `limit` bytes at most, or of one row."""
    for batch in batches:
        step = max(1, int(batch.num_rows * limit / max(1, batch.nbytes)))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """`pick` (minimum or maximum) of each `width` consecutive items, by doubling."""
    n, level, span = len(x) - width + 1, x, 1
    while 2 * span <= width:
        level, span = pick(level[:-span], level[span:]), 2 * span
    return pick(level[:n], level[width - span : width - span + n])


def anchors(hashes: np.ndarray, counts: np.ndarray, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first word, and hash, of each anchor: a `seed`-word sequence of least hash in some window of its
    document. `hashes` are those of all words, `counts` the words of each document."""
    n, width = len(hashes) - window + 1, window - seed + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = runs(hashes, seed, seed=3) | np.uint64(1)
    least = _slide(grams, width, np.minimum)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(hashes))  # words from here to the end of the document
    least[left[:n] < window] = 0
    # A sequence is the least of a window that holds it if the greatest of those windows' least is its own.
    pad = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), width, np.maximum) == grams)
    return at, grams[at]


def _signed(x: np.ndarray):
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _plain(column) -> list[bytes]:
    """The words of each text, with one space between."""
    return [b" ".join(t.split()) for t in texts(column)]


def anchors_of(rows: DataFrame, window: int, seed: int) -> DataFrame:
    """(a, d, k): the distinct anchors of each row (d, k, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            hashes, counts, *_ = chunk_words(_plain(batch.column(2)))
            at, a = anchors(hashes, counts, window, seed)
            doc = np.searchsorted(np.cumsum(counts), at, "right")
            order = np.lexsort((a, doc))
            a, doc = a[order], doc[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])
            d, k = (batch.column(i).to_numpy(zero_copy_only=False)[doc[new]] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([_signed(a[new]), pa.array(d), pa.array(k)], ["a", "d", "k"])

    return rows.mapInArrow(run, "a long, d long, k long")


def _occurrences(window: int, seed: int):
    """(a, d, k, p, left, h, around, most, n) from rows (d, k, text, seeds): each place p of a shared anchor, with a digest h of
    the words around it, up to `window - seed` on either side (left of them before it). The words themselves come once in
    a batch, with its least document that has them, its greatest one (most) and the number of places (n)."""
    reach = window - seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            shared = batch.column(3)
            hashes, counts, buf, starts, ends = chunk_words(_plain(batch.column(2)))
            at, a = anchors(hashes, counts, window, seed)
            last = np.cumsum(counts)
            first = last - counts
            doc = np.searchsorted(last, at, "right")
            keep = np.zeros(len(a), bool)
            bounds = np.searchsorted(doc, np.arange(len(counts) + 1))
            offsets, values = shared.offsets.to_numpy(), shared.values.to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(len(counts)):
                s = slice(bounds[i], bounds[i + 1])
                keep[s] = np.isin(a[s], values[offsets[i] : offsets[i + 1]])
            at, a, doc = at[keep], a[keep], doc[keep]
            low = np.maximum(at - reach, first[doc])
            high = np.minimum(at + seed + reach, last[doc])
            d, k = (batch.column(i).to_numpy(zero_copy_only=False)[doc] for i in (0, 1))
            raw, digest = buf.tobytes(), xxhash.xxh3_128_digest
            left = (at - low).astype(np.int8)
            said = [raw[x:y] for x, y in zip(starts[low].tolist(), ends[high - 1].tolist())] if len(at) else []
            h = [digest(w, x) for w, x in zip(said, left.tolist())]
            # The first place of each digest in the order of documents, the last one, and how many there are.
            order = np.argsort(d, kind="stable")
            firsts: dict[bytes, int] = {}
            lasts: dict[bytes, int] = {}
            for i in order.tolist():
                firsts.setdefault(h[i], i)
                lasts[h[i]] = i
            times = Counter(h)
            around, most, n = ([None] * len(h) for _ in range(3))
            for x, i in firsts.items():
                around[i], most[i], n[i] = said[i], int(d[lasts[x]]), times[x]
            yield pa.RecordBatch.from_arrays(
                [
                    *(_signed(a), pa.array(d), pa.array(k), pa.array((at - first[doc]).astype(np.int32)), pa.array(left), pa.array(h, pa.binary())),
                    *(pa.array(around, pa.binary()), pa.array(most, pa.int64()), pa.array(n, pa.int64())),
                ],
                ["a", "d", "k", "p", "left", "h", "around", "most", "n"],
            )

    return run


def _extend(window: int, seed: int):
    """(h, n, firsts) from surroundings (a, d, left, h, around, most, n) in the order of a and d: for each number of words that
    a window has before the anchor, the least d of the surroundings with the same words in it, or null where there is no
    such window. Only surroundings that some document shares with a smaller one are passed on."""
    reach = window - seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor: int | None = None
        classes: dict[bytes, int] = {}
        met: dict[bytes, list] = {}
        done: list[tuple] = []

        def close() -> None:
            done.extend((h, n, firsts) for h, (most, n, firsts) in met.items() if min((f for f in firsts if f is not None), default=most) < most)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["h", "n", "firsts"])

        for batch in batches:
            for a, d, left, h, around, most, n in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if a != anchor:
                    close()
                    anchor, classes, met = a, {}, {}
                known = met.get(h)
                if known:
                    known[0], known[1] = max(known[0], most), known[1] + n
                    continue
                ends = list(accumulate(map(len, around.split(b" ")), lambda x, y: x + y + 1, initial=-1))
                # The words after the i-th end: each end is one before the next word's start.
                firsts: list = [None] * (reach + 1)
                for o in range(max(0, left + window - len(ends) + 1), min(left, reach) + 1):
                    firsts[o] = classes.setdefault(around[ends[left - o] + 1 : ends[left - o + window]], d)
                met[h] = [most, n, firsts]
            if len(done) > 10_000:
                yield batch_of(done)
                done = []
        close()
        yield batch_of(done)

    return run


def _extend_wide(rows: DataFrame, window: int, seed: int) -> DataFrame:
    """The same for anchors of very many surroundings: their windows meet by their words, wherever they are."""
    reach = window - seed
    said = F.split(F.col("around").cast("string"), " ")
    each = rows.select("h", "d", "left", "most", said.alias("ws")).select("h", "d", "left", "most", "ws", F.explode(F.sequence(F.lit(0), F.lit(reach))).alias("o"))
    each = each.filter((F.col("o") <= F.col("left")) & (F.size("ws") >= F.col("left") - F.col("o") + window))
    each = each.select("h", "d", "most", "o", F.array_join(F.slice("ws", F.col("left") - F.col("o") + 1, window), " ").alias("w"))
    least = each.groupBy("w").agg(F.min("d").alias("f"), F.count("*").alias("n"))
    total = least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = spread_join(each, least, "w", total).groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("o", "f"))).alias("m"))
    found = found.select("h", F.transform(F.sequence(F.lit(0), F.lit(reach)), lambda o: F.try_element_at("m", o)).alias("firsts"))
    return found.join(rows.select("h", "most", "n"), "h").filter(F.array_min("firsts") < F.col("most")).select("h", "n", "firsts")


def _strip(window: int):
    """The result from rows (doc_id, text, spans): places p of anchors, with a bit o for each window to remove that has o words
    before the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(strip, _slices(batches))

    def strip(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_removed, kept = [], [], []
        for text, spans in zip(texts(batch.column(1)), batch.column(2)):
            words = text.split()
            removed = 0
            n_words.append(len(words))
            if spans.is_valid:
                # Matches merge into maximal repeats.
                edge = np.zeros(len(words) + 1, np.int64)
                place, bits = (spans.values.field(c).to_numpy().astype(np.int64) for c in ("p", "bits"))
                for o in range(int(bits.max()).bit_length()):
                    begin = place[bits >> o & 1 == 1] - o
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, begin + window, -1)
                covered = np.cumsum(edge[:-1]) > 0
                removed = int(covered.sum())
                words = compress(words, (~covered).tolist())
            n_removed.append(removed)
            kept.append(b" ".join(words))
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(n_words, pa.int64()),
                pa.array(n_removed, pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                pa.array(kept, pa.binary()).cast(pa.string()),
            ],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
        )

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED, wide: int = WIDE, often: int = OFTEN) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words left) of each row of `docs`."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    # A row is known by its id and its text; equal rows have equal words to remove.
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k"), "text", F.col("doc_id").cast("long").alias("doc_id"))

    found = scratch.keep(anchors_of(rows.select("d", "k", "text"), window, seed), "anchors")
    shared = scratch.keep(found.groupBy("a").agg(F.min("d").alias("x"), F.max("d").alias("y"), F.count("*").alias("n")).filter("x < y").select("a", "n"), "shared")
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    seeds = scratch.keep(spread_join(found, shared, "a", total).groupBy("d", "k").agg(F.collect_list("a").alias("seeds")), "seeds")
    scratch.drop("anchors")
    scratch.drop("shared")
    release(spark)

    seeded = rows.select("d", "k", "text").join(seeds, ["d", "k"]).select("d", "k", "text", "seeds")
    kinds = "a long, d long, k long, p int, left byte, h binary, around binary, most long, n long"
    held = scratch.keep(seeded.mapInArrow(_occurrences(window, seed), kinds), "occurrences")
    scratch.drop("seeds")
    release(spark)
    said = held.filter("n is not null").select("a", "d", "left", "h", "around", "most", "n")
    many = scratch.keep(said.groupBy("a").agg(F.count("*").alias("c")).filter(F.col("c") > often).select("a"), "many")
    met = said
    if not many.isEmpty():
        # What is said in many batches is summed up before it moves; anchors that still have too much are dealt out.
        summed = said.join(many, "a").groupBy("a", "left", "h").agg(F.min("d").alias("d"), F.max("around").alias("around"), F.max("most").alias("most"), F.sum("n").alias("n"))
        summed = scratch.keep(summed, "summed")
        most = scratch.keep(summed.groupBy("a").agg(F.count("*").alias("c")).filter(F.col("c") > wide).select("a"), "wide")
        met = said.join(many, "a", "left_anti").unionByName(summed.join(most, "a", "left_anti"))
    ways = met.repartition("a").sortWithinPartitions("a", "d").mapInArrow(_extend(window, seed), "h binary, n long, firsts array<long>")
    if met is not said:
        ways = ways.unionByName(_extend_wide(summed.join(most, "a"), window, seed))
    ways = scratch.keep(ways, "ways")
    release(spark)
    total = ways.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = spread_join(held.select("d", "k", "p", "h"), ways, "h", total)
    # A bit for each window around the anchor that stands in a smaller document.
    bits = sum((F.when(F.get("firsts", F.lit(o)) < F.col("d"), 1 << o).otherwise(0) for o in range(window - seed + 1)), F.lit(0))
    hits = found.select("d", "k", "p", bits.alias("bits")).filter("bits <> 0")
    spans = hits.groupBy("d", "k").agg(F.collect_list(F.struct("p", "bits")).alias("spans"))
    spans = scratch.keep(spans, "spans")
    for name in ("occurrences", "many", "summed", "wide", "ways"):
        scratch.drop(name)
    release(spark)

    kinds = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    return rows.join(spans, ["d", "k"], "left").select("doc_id", "text", "spans").mapInArrow(_strip(window), kinds)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i+12], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
m AS (SELECT g, min(doc_id) AS d FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT g.doc_id, i + k AS i FROM g JOIN m USING (g), range(0, 13) AS o(k) WHERE m.d < g.doc_id),
t AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
k AS (SELECT t.doc_id, string_agg(x, ' ' ORDER BY t.i) AS kept FROM t ANTI JOIN c ON t.doc_id = c.doc_id AND t.i = c.i GROUP BY t.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN k ON k.doc_id = w.doc_id
"""
