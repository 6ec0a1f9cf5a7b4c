"""Operator 13: codes for vectors, one byte for each of their equal parts.

Vectors become integers and are stored once as blocks: one row of a few
thousand vectors, a contiguous array for each dimension. A round is one
`RDD.treeAggregate` over the blocks: distances from a part to all entries of
its codebook add up dimension by dimension, np.add.at adds the parts of each
entry to int64 tensors of sums and counts, and these, of one small size
whatever the input, merge through a tree. All arithmetic is of integers, so
results do not depend on how rows are dealt out.

Nulls and ties: rows whose vector is null or holds null or non-finite
components go; so do vectors of another length than most have (the longer of
equally many); an empty vector table gives no rows. Null ids rank last and
rows of one id by their vectors when the first entries are chosen; fewer rows
than entries give fewer entries; of equally near entries the first is taken;
null labels count as one. Lengths must be a multiple of the number of parts,
and components no larger than 2**18 in size, so that sums stay in 64 bits;
else a ValueError says so.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, Scratch, small_batches, spread_join, table

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Units into which a component of 1 is cut; the largest component.
SCALE, LARGEST = 256, 2.0**18
#: Vectors of a block; rows of one step of the distances.
BLOCK_ROWS, STEP_ROWS = 4096, 1024
#: Depth of the tree by which sums reach the driver.
DEPTH = 3


def whole_vectors(df: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is there and holds finite components alone."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(F.col(column).isNotNull() & finite & (F.size(column) > 0))


def usual_length(df: DataFrame, column: str) -> int:
    """The length that most vectors have; 0 if there are none."""
    # One row for each length.
    most = df.groupBy(F.size(column).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return most["d"] if most else 0


def matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """The vectors of a batch as rows, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


# -- blocks and sums ------------------------------------------------------------------


@dataclass
class Parts:
    """Codebooks of all parts, as an array of (part, entry, component)."""

    entries: np.ndarray

    def nearest(self, columns: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each vector's part, the first of equally near ones, and its squared distance."""
        book = self.entries[part]
        width = book.shape[1]
        found, far = [], []
        for at in range(0, columns.shape[1], STEP_ROWS):
            rows = columns[part * width : (part + 1) * width, at : at + STEP_ROWS]
            distance = np.zeros((rows.shape[1], len(book)), np.int64)
            for d in range(width):
                distance += (rows[d][:, None] - book[:, d][None, :]) ** 2
            best = distance.argmin(1)
            found.append(best)
            far.append(distance[np.arange(len(best)), best])
        return np.concatenate(found), np.concatenate(far)


def add_block(total: tuple[np.ndarray, np.ndarray], block: bytes, books: Broadcast, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of every entry, with those of one block."""
    sums, counts = total
    parts, columns = Parts(books.value), np.frombuffer(block, np.int64).reshape(dims, -1)
    width = dims // len(sums)
    for p in range(len(sums)):
        best, _ = parts.nearest(columns, p)
        np.add.at(sums[p], best, columns[p * width : (p + 1) * width].T)
        np.add.at(counts[p], best, 1)
    return sums, counts


def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return a[0] + b[0], a[1] + b[1]


def _columnar(dims: int):
    """Blocks of the vectors of a partition, a contiguous run of integers for each dimension."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                x = np.floor(SCALE * matrix(batch.column(0).slice(at, BLOCK_ROWS), dims)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x.T).tobytes()], pa.binary())], ["block"])

    return blocks


def _coded(dims: int, entries: np.ndarray):
    """Code and error of every vector."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = Parts(entries)
        for batch in batches:
            columns = np.ascontiguousarray(np.floor(SCALE * matrix(batch.column("embedding"), dims)).astype(np.int64).T)
            each = [parts.nearest(columns, p) for p in range(len(entries))]
            codes, error = np.stack([b for b, _ in each], 1).astype(np.uint8), sum(e for _, e in each)
            out = [batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, ["vec_id", "label", "code", "error"])

    return code


# -- the operator ------------------------------------------------------------------------


def train(vectors: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, component) for `vectors` (vec_id, embedding), all whole and of `dims` components."""
    sc = vectors.sparkSession.sparkContext
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    seeds = np.floor(SCALE * np.array([r["embedding"] for r in first], np.float64)).astype(np.int64)
    books = np.ascontiguousarray(seeds.reshape(len(first), parts, dims // parts).transpose(1, 0, 2))
    blocks = Scratch(vectors.sparkSession).keep(vectors.select("embedding").mapInArrow(_columnar(dims), "block binary"), "blocks")
    rows = blocks.rdd.map(lambda r: bytes(r[0]))
    for _ in range(rounds):
        zero = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        shared = sc.broadcast(books)
        sums, counts = rows.treeAggregate(zero, lambda total, block, shared=shared: add_block(total, block, shared, dims), merge, DEPTH)
        books = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], books)
        shared.unpersist()
    return books


def encode(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error and label_error of the rows of `df` (vec_id, label, embedding) with whole vectors, and the codebooks."""
    spark = df.sparkSession
    small_batches(spark, BLOCK_ROWS)
    typed = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), "embedding")
    kept = whole_vectors(typed, "embedding")
    dims = usual_length(kept, "embedding")
    kind = "vec_id long, label int, code string, error long"
    if not dims:
        return spark.createDataFrame([], f"{kind}, label_error long"), np.zeros((parts, 0, 0), np.int64)
    if dims % parts or not 0 < entries <= 256:
        raise ValueError(f"{dims} components can't be cut into {parts} equal parts, or {entries} entries not be told by a byte")
    kept = kept.filter(F.size("embedding") == dims)
    largest = kept.agg(F.max(F.array_max(F.transform("embedding", F.abs)))).first()[0]
    if largest > LARGEST:
        raise ValueError(f"a component of {largest} is larger than {LARGEST}")
    books = train(kept, dims, parts, entries, rounds)
    coded = Scratch(spark).keep(kept.mapInArrow(_coded(dims, books), kind), "codes")
    label = F.struct(F.col("label").isNull().alias("no"), F.coalesce("label", F.lit(0)).alias("l")).alias("k")
    sums = coded.groupBy(label).agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    held = coded.withColumn("k", label)
    labels = sums.count()
    out = held.join(F.broadcast(sums.drop("n")), "k") if labels <= HOT else spread_join(held, sums, "k", coded.count())
    return out.drop("k"), books


def digest(books: np.ndarray) -> str:
    return sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = encode(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """Rounds written out: parts as lists of four integers, an entry for each of them, and floors of means."""
    far = "list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"

    def assign(book: str) -> str:
        each = f"SELECT x.vec_id, x.label, x.p, x.v, b.e, {far} AS far FROM x JOIN {book} b ON x.p = b.p"
        return f"""SELECT vec_id, label, p, v, min(e) FILTER (WHERE far = least) AS e, min(far) AS far
  FROM (SELECT *, min(far) OVER (PARTITION BY vec_id, p) AS least FROM ({each})) GROUP BY vec_id, label, p, v"""

    def moved(assigned: str, book: str) -> str:
        sums = ", ".join(f"(sum(v[{k}]) - (sum(v[{k}]) % count(*) + count(*)) % count(*)) // count(*)" for k in range(1, 5))
        return f"SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM {book} b LEFT JOIN (SELECT p, e, [{sums}] AS v FROM {assigned} GROUP BY p, e) m ON m.p = b.p AND m.e = b.e"

    return f"""
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda y: CAST(floor(256 * y::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
x AS (SELECT vec_id, label, p, v[4 * p + 1 : 4 * p + 4] AS v FROM k, range(16) t(p)),
s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k QUALIFY e < 64),
b0 AS (SELECT x.p, s.e, x.v FROM x JOIN s USING (vec_id)),
a0 AS ({assign("b0")}),
b1 AS ({moved("a0", "b0")}),
a1 AS ({assign("b1")}),
b2 AS ({moved("a1", "b1")}),
a2 AS ({assign("b2")}),
r AS (SELECT vec_id, label, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM a2 GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256 FROM r
"""


ORACLE_SQL = _sql()
