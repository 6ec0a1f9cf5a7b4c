"""Operator 7: minimax contiguous sharding.

Documents with equal texts form an atomic group. Groups are ordered by the
64-bit hash of their text, which needs no sort. The smallest feasible capacity
of a shard is found by binary search with a greedy check, and the order is cut
there. The driver sees only sums over ranges of the hash (a fixed number), and
refines the few ranges that may hold a cut until lower and upper bound of the
capacity meet, so the capacity is the exact minimum at any size of input.

Nulls and ties: a null text counts as the empty text; repeated rows and rows
with equal texts share a shard; an empty table gives no rows; with fewer
groups than shards some shards stay empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table

FIRST_BITS, MORE_BITS = 16, 8
#: Rows numbered in one task.
SLOT_ROWS = 50_000


def digests(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"))


class Ranges:
    """Sums over consecutive ranges of keys: `low` key, `bytes`, and whether the range is one `atom`."""

    def __init__(self, rows: list[tuple[int, int, int, bool]]) -> None:
        rows = sorted(rows)
        self.low, self.bits, self.atom = [r[0] for r in rows], [r[1] for r in rows], np.array([r[3] for r in rows], bool)
        self.bytes = np.array([r[2] for r in rows], np.int64)
        self.ends = np.concatenate([[0], np.cumsum(self.bytes)]) if rows else np.zeros(1, np.int64)

    def fits(self, capacity: int, shards: int) -> bool:
        """Greedy check with every range kept whole."""
        at, n = 0, len(self.bytes)
        for _ in range(shards):
            at = int(np.searchsorted(self.ends, self.ends[at] + capacity, "right")) - 1
            if at == n:
                return True
        return at == n

    def may_fit(self, capacity: int, shards: int) -> bool:
        """Greedy check with ranges of more than one group freely divisible: false only if nothing fits."""
        at, total = 0, int(self.ends[-1])
        for _ in range(shards):
            to = at + capacity
            if to >= total:
                return True
            i = int(np.searchsorted(self.ends, to, "right")) - 1
            at = int(self.ends[i]) if self.atom[i] else to
        return False

    def least(self, check, shards: int) -> int:
        low, high = -(-int(self.ends[-1]) // shards), int(self.ends[-1])
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if check(mid, shards) else (mid + 1, high)
        return low

    def open(self, low: int, high: int, shards: int) -> set[int]:
        """Ranges that hold several groups and in which a cut may fall for a capacity between the bounds."""
        found = {i for i in range(len(self.bytes)) if not self.atom[i] and self.bytes[i] * 16 * shards > self.ends[-1]}
        a = b = 0
        total = int(self.ends[-1])
        for _ in range(shards):
            a = int(self.ends[int(np.searchsorted(self.ends, a + low, "right")) - 1])
            b = min(total, b + high)
            i, j = int(np.searchsorted(self.ends, a, "right")) - 1, int(np.searchsorted(self.ends, b, "left"))
            found.update(k for k in range(max(0, i), min(j, len(self.bytes))) if not self.atom[k])
        return found

    def cuts(self, capacity: int, shards: int) -> list[int]:
        """First keys of shards 1, 2, …: as even as whole ranges allow, never over the capacity."""
        n = len(self.bytes)
        latest = [n]  # where the last shards must begin at the latest
        for _ in range(shards - 1):
            latest.append(int(np.searchsorted(self.ends, self.ends[latest[-1]] - capacity, "left")))
        at, keys = 0, []
        for j in range(1, shards):
            least, most = max(at, latest[shards - j]), int(np.searchsorted(self.ends, self.ends[at] + capacity, "right")) - 1
            want = self.ends[at] + (self.ends[n] - self.ends[at]) / (shards - j + 1)
            i = int(np.searchsorted(self.ends, want))
            i -= i > 0 and abs(self.ends[i - 1] - want) <= abs(self.ends[min(i, n)] - want)
            at = min(max(i, least), most)
            keys.append(self.low[at] if at < n else 2**63 - 1)
        return keys


def _sums(rows: DataFrame, bits: int) -> list[tuple[int, int, int, bool]]:
    shift = 64 - bits
    part = F.shiftright("key", shift)
    return [
        (r.part << shift, bits, r.bytes, r.a == r.b)
        for r in rows.groupBy(part.alias("part")).agg(F.sum("size").alias("bytes"), F.min("key").alias("a"), F.max("key").alias("b")).toLocalIterator()
    ]


def plan(rows: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The least capacity, and the first keys of all shards but the first."""
    ranges = Ranges(_sums(rows, FIRST_BITS))
    while True:
        high, low = ranges.least(ranges.fits, shards), ranges.least(ranges.may_fit, shards)
        todo = ranges.open(low, high, shards) if low < high else set()
        if not todo:
            return high, ranges.cuts(high, shards)
        kept = [(ranges.low[i], ranges.bits[i], int(ranges.bytes[i]), bool(ranges.atom[i])) for i in range(len(ranges.low)) if i not in todo]
        for bits in {ranges.bits[i] for i in todo}:
            parts = [ranges.low[i] >> (64 - bits) for i in todo if ranges.bits[i] == bits]
            wanted = rows.sparkSession.createDataFrame([(p,) for p in parts], "part long")
            inside = rows.join(F.broadcast(wanted), F.shiftright("key", 64 - bits) == F.col("part"), "left_semi")
            kept += _sums(inside, min(64, bits + MORE_BITS))
        ranges = Ranges(kept)


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of `docs`."""
    rows = durable(digests(docs))
    _, keys = plan(rows, shards)
    number = F.lit(0)
    for k in keys:
        number = number + (F.col("key") >= F.lit(k)).cast("int")
    n = rows.count()
    parts = max(1, -(-n // (shards * SLOT_ROWS)))
    rows = rows.withColumns({"shard": number, "part": F.pmod(F.xxhash64("doc_id", "key"), F.lit(parts)).cast("int")})
    # At most one row for each SLOT_ROWS documents and shard.
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    order = Window.partitionBy("shard", "part").orderBy("doc_id", "key", "size", "text_crc32")
    numbered = rows.withColumn("row", F.row_number().over(order)).join(before, ["shard", "part"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("row") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
