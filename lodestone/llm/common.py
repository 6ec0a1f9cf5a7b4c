"""Helpers shared by the training-data operators: tables, scratch space in the
cluster's shared folder, and vectorised word hashing."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rank of a null doc_id: behind every other document.
NULL_ID = 2**63 - 1
#: The six ASCII white-space characters, space and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or,
    where that is unset (tests on one machine), a temporary folder."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestone-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


#: Rows of an Arrow batch at most, and bytes, about: both sides of the exchange hold whole batches.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Arrow batches of at most `rows` rows and about `size` bytes (or one row) from now on. Spark reads these settings
    when a query runs, which is after the operator has returned, so they stay set; smaller ones of the caller's are left."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key).lower().removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


#: Rows for which one partition more is worth its files.
PART_ROWS = 20_000


def packed(df: DataFrame, most: int) -> DataFrame:
    """`df`, which has at most about `most` rows, in no more partitions than these are worth: each partition costs files in
    every shuffle and table that follows. Partitions are joined where they lie; many rows keep all of theirs."""
    return df.coalesce(max(1, -(-most // PART_ROWS)))


def durable(df: DataFrame, most: int | None = None) -> DataFrame:
    """`df` computed once and kept in the shared folder, so that a lost executor loses nothing; packed if `most` is known."""
    shared_dir(df.sparkSession)
    return (df if most is None else packed(df, most)).checkpoint(eager=True)


#: Hot keys are those of more than 1 / HOT of all rows, so there are fewer than HOT of them; rows that may be broadcast.
HOT, LEAST_HOT, BROADCAST_ROWS = 10_000, 64, 200_000


def spread_join(rows: DataFrame, keyed: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """`rows` joined with `keyed`, which has one row for each key and their number `n` in `rows`, of `total` rows.
    Hot keys, fewer than HOT whatever the input, are broadcast, so that their rows stay where they are; no other key
    has more than 1 / HOT of the rows (or LEAST_HOT of them), and these are joined by a shuffle. `keyed` is best stored."""
    bound = max(LEAST_HOT, total // HOT)
    hot = keyed.filter(F.col("n") > bound).drop("n")
    if hot.isEmpty():
        return rows.join(keyed.drop("n"), key, how)
    hot, cold = F.broadcast(hot), keyed.filter(F.col("n") <= bound).drop("n")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key, how))


def light(df: DataFrame, rows: int | None = None) -> DataFrame:
    """`df`, which is stored, with a broadcast hint if it has at most BROADCAST_ROWS rows; else it is joined by a shuffle."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def sealed(df: DataFrame, columns: dict) -> DataFrame:
    """`df` with computed `columns` that later filters read as they are. Without this a filter on them would be
    pushed below them with each expression written out again in place of its name."""
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


class Scratch:
    """Parquet tables of one operator run in the shared folder."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/lodestone-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps."""
    gc.collect()
    spark._jvm.System.gc()


def fold_of(doc_id) -> int:
    """crc32 of the id as text, modulo 3; fold 1 is held out."""
    return zlib.crc32(str(doc_id).encode()) % 3


def fold(col) -> "F.Column":
    """fold_of as a column; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("null"))) % 3


def texts(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


# -- word hashes ------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_IN_WORD = np.ones(256, bool)
_IN_WORD[[9, 10, 11, 12, 13, 32]] = False
_CHUNK = 1 << 18
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, `n` or more."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * _CHUNK)
        _POWERS[:] = [_geometric(_BASE, size), _geometric(pow(_BASE, -1, 2**64), size)]
    return _POWERS[0], _POWERS[1]


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 2**64))
        done += step
    return out


def word_hashes(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (`[^\\x20\\x09-\\x0D]+`) of `docs`, in order,
    and the index of each document's first word, with the total at the end.
    Memory is that of one document, or of 2**18 bytes if that is more."""
    hashes, counts, group, size = [], [], [], 0
    for doc in [*docs, None]:
        if group and (doc is None or size + len(doc) > _CHUNK):
            h, n = _hash_chunk(group)
            hashes.append(h)
            counts.append(n)
            group, size = [], 0
        if doc is not None:
            group.append(doc)
            size += len(doc)
    n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


def _hash_chunk(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return chunk_words(docs)[:2]


def chunk_words(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of `docs`, words of each document, and the bytes with each word's start and end."""
    buf = np.frombuffer(b" ".join(docs) + b" ", np.uint8)
    lengths = np.fromiter(map(len, docs), np.int64, len(docs))
    inside = _IN_WORD[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(buf) and inside[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _powers(len(buf) + 1)
    total = np.empty(len(buf) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[buf] * power[: len(buf)], out=total[1:])
    h = _mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    firsts = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths + 1)]))
    return h, np.diff(firsts), buf, starts, ends


def runs(hashes: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hash of each `k` consecutive items, by doubling: one item fewer than `k` from the end on, none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = (_BASE * (2 * seed + 1)) % 2**64 | 1
    parts, level, width, done, out = k, hashes, 1, 0, np.zeros(n, np.uint64)
    while parts:
        if parts & 1:
            out = out * np.uint64(pow(base, width, 2**64)) + level[done : done + n]
            done += width
        parts >>= 1
        if parts:
            level = level[:-width] * np.uint64(pow(base, width, 2**64)) + level[width:]
            width *= 2
    return _mix(out)
