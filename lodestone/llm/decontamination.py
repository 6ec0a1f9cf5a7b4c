"""Operator 5: benchmark decontamination with an FM-index per shard of the training texts.

Each worker indexes the texts it reads, shard by shard: words become numbers of
the benchmark's vocabulary, stretches that cannot hold a phrase become one
break, and the shard gets its suffix order, a wavelet matrix over the last
column, and suffix positions sampled every few words. All phrases of the
benchmark are searched backwards at once through the wavelet ranks; rows that
match walk to the next sampled position; occurrences merge into spans of words.
Memory is bounded by the shard, and no text is shuffled.

The benchmark travels in blocks of bounded size, so it may be of any length;
a shard is searched for each block.

Nulls and ties: null and empty texts and items have no words; an item of fewer
words than a window is one window; repeated or null ids stand for themselves
(a null item_id cannot be named and is left out of the items, but its words
are hit); an empty benchmark hits nothing; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import small_batches, table, texts

WINDOW = 10
NEW = ["n_words", "spans", "items", "clean"]
#: Symbols of a shard, words between sampled suffixes, bytes of a block of the benchmark.
SHARD, SAMPLE, BLOCK = 1 << 19, 8, 8 << 20
#: a-z, 0-9 and all bytes of other scripts stay, A-Z become small, the rest splits.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Phrases:
    """A block of the benchmark: vocabulary, distinct windows, and the items that each window is of."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW) -> None:
        self.number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], list] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            for i in range(max(len(ids) - window + 1, min(1, len(ids)))):
                found.setdefault(tuple(ids[i : i + window]), []).append(item)
        self.windows = sorted(found, key=len)
        self.items = [sorted({str(x) for x in found[w] if x is not None}) for w in self.windows]
        self.lengths = np.array([len(w) for w in self.windows], np.int64)
        self.least = int(self.lengths.min()) if len(self.windows) else 0


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array of `symbols` by prefix doubling; only suffixes that are still tied are sorted again."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    tied = order
    width = 1
    # rank: place of the first suffix with the same prefix
    starts = np.searchsorted(rank[order], np.arange(rank.max() + 1 if n else 0))
    rank = starts[rank] if n else rank
    while True:
        same = np.zeros(len(tied), bool)
        r = rank[tied]
        same[1:] = r[1:] == r[:-1]
        same[:-1] |= same[1:]
        tied = tied[same]
        if not len(tied):
            return order
        ahead = tied + width
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.argsort(rank[tied] * (n + 1) + second, kind="stable")
        tied, second = tied[by], second[by]
        group = rank[tied]
        new = np.ones(len(tied), bool)
        new[1:] = group[1:] != group[:-1]
        first = np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))
        place = group + np.arange(len(tied)) - first
        order[place] = tied
        new[1:] |= second[1:] != second[:-1]
        rank[tied] = place[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        width *= 2


class Index:
    """FM-index over `symbols`, numbers from 0 (break) to `top`."""

    def __init__(self, symbols: np.ndarray, top: int, sample: int = SAMPLE) -> None:
        symbols, top = np.concatenate([symbols + 1, [0]]), top + 1  # 0 is the end of the text and stands there only
        self.n = len(symbols)
        order = suffix_order(symbols)
        last = symbols[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 2))])
        self.levels = []
        level = last
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            ones = (level >> bit) & 1
            count = np.concatenate([[0], np.cumsum(ones)])
            self.levels.append((bit, count, self.n - int(count[-1])))
            level = level[np.argsort(ones, kind="stable")]
        self.last = last
        marked = order % sample == 0
        self.marks = np.concatenate([[0], np.cumsum(marked)])
        self.marked, self.sampled = marked, order[marked]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each `symbol` stands before place `at` of the last column."""
        low, high = np.zeros(len(at), np.int64), at
        for bit, ones, zeros in self.levels:
            one = (symbol >> bit) & 1 == 1
            a, b = ones[low], ones[high]
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of rows of each pattern (a row of `patterns`), by backward search."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        for k in range(patterns.shape[1] - 1, -1, -1):
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            c = patterns[live, k] + 1
            low[live], high[live] = self.first[c] + self.rank(c, low[live]), self.first[c] + self.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in `rows`: step back to a sampled one."""
        out, steps, todo = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(todo):
            r = rows[todo]
            there = self.marked[r]
            out[todo[there]] = self.sampled[self.marks[r[there]]] + steps
            todo, r = todo[~there], r[~there]
            c = self.last[r]
            rows[todo] = self.first[c] + self.rank(c, r)
            steps += 1
        return out


def search_shard(docs: list[list[bytes]], phrases: Phrases, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, window) of every occurrence of a window in the word lists `docs`."""
    none = np.zeros(0, np.int64)
    if not phrases.windows:
        return none, none, none
    get = phrases.number.get
    ids = np.array([x for d in docs for x in (*[get(w, 0) for w in d], 0)], np.int64)
    firsts = np.concatenate([[0], np.cumsum([len(d) + 1 for d in docs])])
    # A stretch of vocabulary words too short for any window cannot match: drop it, and all breaks but one.
    known = np.concatenate([[False], ids > 0, [False]])
    edge = np.flatnonzero(known[1:] != known[:-1])
    begin, end = edge[::2], edge[1::2]
    keep = end - begin >= phrases.least
    begin, end = begin[keep], end[keep]
    if not len(begin):
        return none, none, none
    sizes = end - begin + 1  # with the break that follows
    place = np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    index = Index(ids[place], len(phrases.number), sample)
    at, which = [], []
    for length in np.unique(phrases.lengths):
        some = np.flatnonzero(phrases.lengths == length)
        low, high = index.search(np.array([phrases.windows[i] for i in some], np.int64))
        n = high - low
        hit = n > 0
        rows = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(n[hit])[:-1]]), n[hit]) + np.arange(n[hit].sum())
        at.append(place[index.locate(rows)])
        which.append(np.repeat(some[hit], n[hit]))
    at, which = np.concatenate(at), np.concatenate(which)
    doc = np.searchsorted(firsts, at, "right") - 1
    return doc, at - firsts[doc], which


def spans(docs: list[bytes], blocks, window: int = WINDOW, shard: int = SHARD, sample: int = SAMPLE) -> Iterator[tuple[int, int, list[tuple[int, int]], list[str]]]:
    """(document, number of words, merged spans of hit words, items) of each of `docs`; `blocks` gives the Phrases."""
    group: list[int] = []
    split: list[list[bytes]] = []
    size = 0
    for k, text in enumerate([*docs, None]):
        if group and (text is None or size > shard):
            hits: list[list] = [[] for _ in group]
            items: list[set] = [set() for _ in group]
            for phrases in blocks():
                for d, at, w in zip(*(x.tolist() for x in search_shard(split, phrases, sample))):
                    hits[d].append((at, at + int(phrases.lengths[w])))
                    items[d].update(phrases.items[w])
            for i, ws, found, named in zip(group, split, hits, items):
                merged: list[tuple[int, int]] = []
                for a, b in sorted(found):
                    if merged and a <= merged[-1][1]:
                        merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
                    else:
                        merged.append((a, b))
                yield i, len(ws), merged, sorted(named)
            group, split, size = [], [], 0
        if text is not None:
            ws = words(text)
            group.append(k)
            split.append(ws)
            size += len(ws)


def cut(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    """`text` without the words of the spans, and without what stands between words of one span."""
    folded = text.translate(_FOLD)
    place, bounds = 0, []
    for w in folded.split():
        a = folded.index(w, place)
        place = a + len(w)
        bounds.append((a, place))
    out, at = [], 0
    for a, b in gone:
        out.append(text[at : bounds[a][0]])
        at = bounds[b - 1][1]
    return b"".join([*out, text[at:]])


def _blocks(benchmark: DataFrame, limit: int) -> list:
    """Broadcasts of the benchmark in blocks of `limit` bytes or one item; the driver holds one block at a time."""
    sc, group, size, out = benchmark.sparkSession.sparkContext, [], 0, []
    for row in benchmark.select("item_id", "text").toLocalIterator():
        text = (row.text or "").encode()
        if group and size + len(text) > limit:
            out.append(sc.broadcast(group))
            group, size = [], 0
        group.append((row.item_id, text))
        size += len(text)
    return [*out, sc.broadcast(group)] if group else out


_READY: dict = {}


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard: int = SHARD, block: int = BLOCK, keep: bool = False) -> DataFrame:
    """doc_id, n_words, spans (of words, start and end), items and clean (the text without the spans, null if there are none)
    of each row of `docs`; with `keep`, before them all other columns of `docs`."""
    small_batches(docs.sparkSession)
    sent, run_id = _blocks(benchmark, block), uuid.uuid4().hex

    def phrases() -> Iterator[Phrases]:
        for i, b in enumerate(sent):
            if (run_id, i) not in _READY:
                if len(_READY) >= 2:
                    _READY.clear()
                _READY[run_id, i] = Phrases(b.value, window)
            yield _READY[run_id, i]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = texts(batch.column(1))
            found = list(spans(rows, phrases, window, shard))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.columns if keep else batch.columns[:1]),
                    pa.array([n for _, n, _, _ in found], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in s] for _, _, s, _ in found], pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))),
                    pa.array([x for *_, x in found], pa.list_(pa.string())),
                    pa.array([cut(rows[i], s) if s else None for i, _, s, _ in found], pa.binary()).cast(pa.string()),
                ],
                [*(batch.schema.names if keep else ["doc_id"]), *NEW],
            )

    docs = docs.drop(*NEW)
    docs = docs.select("doc_id", "text", *[c for c in docs.columns if keep and c not in ("doc_id", "text")])
    kinds = StructType(docs.schema.fields if keep else docs.schema.fields[:1])
    return docs.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kinds)}, n_words long, spans array<struct<start:long,end:long>>, items array<string>, clean string")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH t AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (SELECT kind, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM t),
b AS (SELECT DISTINCT id AS item_id, least(10, len(ws)) AS n, array_to_string(ws[i:i+9], ' ') AS g FROM (SELECT id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM w WHERE kind = 'b' AND len(ws) > 0)),
l AS (SELECT DISTINCT n FROM b),
d AS (SELECT id AS doc_id, i, n, array_to_string(ws[i:i+n-1], ' ') AS g FROM (SELECT id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, l WHERE kind = 'd' AND len(ws) >= n)),
h AS (SELECT doc_id, i, d.n, item_id FROM d JOIN b ON d.n = b.n AND d.g = b.g),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM h, range(0, 10) AS o(k) WHERE k < n GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT w.id AS doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c ON c.doc_id = w.id LEFT JOIN s ON s.doc_id = w.id WHERE kind = 'd'
"""
