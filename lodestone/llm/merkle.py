"""Operator 11: a Merkle manifest of a dataset, with a proof for every row.

Leaves are hashed where the rows are read. A range sort numbers them within
their source, and every 729 consecutive leaves of a source, an aligned
subtree, meet in one row. Block roots are the leaves of the next level, and so
on, so a hot source is many blocks and a level is 1 / 729 of the one below.
Back down, each block's leaves are visited in turn (`Traversal`): a stack of
nodes for each height builds the next run of that height while the present one
is in use, the stack with the lowest waiting node first, so a block is passed
with memory in the logarithm of its leaves. What lies above a block is the
same for all its leaves, and is appended to their paths.

Nulls and ties: a null field is hashed as `-`; null sources come first, and
null ids first in their source; a null id is never tampered with; rows of one
source and id follow their leaves, repeated rows are leaves of their own; an
empty table gives no rows; columns beyond those hashed do not count.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, LEAST_HOT, Scratch, small_batches, spread_join, table

#: Children of a node; levels of a block and its leaves.
FAN, BLOCK_LEVELS = 3, 6
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Rows of paths (up to about 2 KB each) that are broadcast at most.
LIGHT_ROWS = 5_000


# -- one block ----------------------------------------------------------------


def node(children: list[bytes]) -> bytes:
    return sha256(b"".join(children)).hexdigest().encode()


def height(n: int) -> int:
    """Levels above `n` nodes until one is left."""
    h = 0
    while n > 1:
        n, h = -(-n // FAN), h + 1
    return h


class Treehash:
    """The nodes of height `top` over leaves from `start` on, one run of them, made leaf by leaf on a stack."""

    def __init__(self, leaves: list[bytes], top: int, start: int = 0, stop: int | None = None) -> None:
        self.leaves, self.top, self.at = leaves, top, start
        self.stop = min(len(leaves), start + FAN ** (top + 1) if stop is None else stop)
        self.stack: list[tuple[int, int, bytes]] = []

    @property
    def done(self) -> bool:
        return self.at >= self.stop

    @property
    def low(self) -> int:
        return self.stack[-1][0] if self.stack else self.top

    def step(self) -> None:
        h, j, stack = 0, self.at, self.stack
        stack.append((0, j, self.leaves[j]))
        self.at += 1
        while h < self.top and (j % FAN == FAN - 1 or (j + 1) * FAN**h >= len(self.leaves)):
            k = j % FAN + 1
            run = [x[2] for x in stack[-k:]]
            del stack[-k:]
            h, j = h + 1, j // FAN
            stack.append((h, j, node(run)))

    def nodes(self) -> list[bytes]:
        while not self.done:
            self.step()
        return [x[2] for x in self.stack]


class Traversal:
    """Paths of all leaves of a block of `levels` levels, one after the other: for each height, the place of the node
    above the leaf in its run, and the run. Each leaf pays for `levels` steps of the stacks."""

    def __init__(self, leaves: list[bytes], levels: int) -> None:
        self.leaves, self.levels = leaves, levels
        self.runs = [Treehash(leaves, h).nodes() for h in range(levels)]
        self.stacks = [Treehash(leaves, h, FAN ** (h + 1)) for h in range(levels)]

    def held(self) -> int:
        """Nodes in memory, leaves apart."""
        return sum(map(len, self.runs)) + sum(len(s.stack) for s in self.stacks)

    def __iter__(self) -> Iterator[list[tuple[int, list[bytes]]]]:
        self._pay()
        for i in range(len(self.leaves)):
            yield [(i // FAN**h % FAN, run) for h, run in enumerate(self.runs)]
            for h in range(self.levels):
                if (i + 1) % FAN ** (h + 1) or i + 1 >= len(self.leaves):
                    break
                self.runs[h] = self.stacks[h].nodes()
                self.stacks[h] = Treehash(self.leaves, h, i + 1 + FAN ** (h + 1))
            self._pay()

    def _pay(self) -> None:
        for _ in range(self.levels):
            lowest = min((s for s in self.stacks if not s.done), key=lambda s: (s.low, s.top), default=None)
            if lowest is None:
                return
            lowest.step()


def root_of(leaves: list[bytes], levels: int) -> bytes:
    return Treehash(leaves, levels, 0, len(leaves)).nodes()[0]


def fold(leaf: bytes, path: list[tuple[int, list[bytes]]]) -> bytes:
    """The root that `leaf` and its path make."""
    for place, run in path:
        leaf = node([*run[:place], leaf, *run[place + 1 :]])
    return leaf


def written(path: list[tuple[int, list[bytes]]]) -> bytes:
    """A path as text: for each height the place, the number of siblings, and these."""
    return b"".join(b"%d%d" % (place, len(run) - 1) + b"".join(run[:place] + run[place + 1 :]) for place, run in path)


def read(text: bytes) -> list[tuple[int, list[bytes]]]:
    """The path that `written` wrote; the node's own place in its run is empty."""
    out, at = [], 0
    while at < len(text):
        place, n = text[at] - 48, text[at + 1] - 48
        run = [text[at + 2 + 64 * k : at + 66 + 64 * k] for k in range(n)]
        out.append((place, [*run[:place], b"", *run[place:]]))
        at += 2 + 64 * n
    return out


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[dict, pa.StructArray]]:
    """Each row without its nodes, and its nodes."""
    rest = batch.drop_columns(["nodes"]).to_pylist()
    nodes = batch.column("nodes")
    for k, row in enumerate(rest):
        yield row, nodes[k].values


def _hashes(nodes: pa.StructArray, name: str = "hash") -> list[bytes]:
    return nodes.field(name).cast(pa.binary()).to_pylist()


def _roots(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(r["g"], r["block"], -(-r["n"] // FAN**most), root_of(_hashes(nodes), min(most, height(r["n"]))).decode()) for r, nodes in _blocks(batch)]
        yield _table(rows, {"g": pa.int64(), "pos": pa.int64(), "n": pa.int64(), "hash": pa.string()})


def _paths(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    kinds = {"g": pa.int64(), "block": pa.int64(), "path": pa.string(), "subroot": pa.string()}
    for batch in batches:
        for r, nodes in _blocks(batch):
            places, above = nodes.field("pos").to_pylist(), r["path"].encode()
            yield _table([(r["g"], p, (written(x) + above).decode(), r["subroot"]) for p, x in zip(places, Traversal(_hashes(nodes), min(most, height(r["n"]))))], kinds)


def _proofs(batches: Iterator[pa.RecordBatch], most: int, with_paths: bool) -> Iterator[pa.RecordBatch]:
    kinds = dict.fromkeys(["doc_id"], pa.int64()) | dict.fromkeys(["leaf", "subroot", "path", "proof_sha256", "folded_root"], pa.string())
    for batch in batches:
        for r, nodes in _blocks(batch):
            above = read(r["path"].encode())
            shared = b"".join(x for _, run in above for x in run)
            ids, leaves, altered = nodes.field("doc_id").to_pylist(), _hashes(nodes), _hashes(nodes, "altered")
            known: dict[bytes, bytes] = {}  # what block roots fold to: nearly all leaves fold to the same
            rows = []
            for doc, leaf, other, path in zip(ids, leaves, altered, Traversal(leaves, min(most, height(r["n"])))):
                top = fold(leaf if other is None else other, path)
                if top not in known:
                    known = {top: fold(top, above)} if len(known) > 8 else known | {top: fold(top, above)}
                siblings = b"".join(b"".join(run[:p] + run[p + 1 :]) for p, run in path) + shared
                rows.append((doc, leaf.decode(), r["subroot"], (written(path) + r["path"].encode()).decode() if with_paths else None, node([siblings]).decode(), known[top].decode()))
            yield _table(rows, kinds)


def _table(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], list(kinds))


# -- leaves, numbers and levels ------------------------------------------------------


def leaf_hash(fields: list[Column]) -> Column:
    """sha256 of the fields, each `-` if null, else its bytes, `:` and itself."""
    texts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, source, hash, and `altered`, the hash without line ends of the text where `tampered` is true and there are any."""
    rest, text = [F.col(c) for c in FIELDS[:-1]], F.col("text")
    cut = F.lit(False) if tampered is None else tampered
    altered = F.when(cut & F.contains(text, F.lit("\n")), leaf_hash([*rest, F.replace(text, F.lit("\n"), F.lit(""))]))
    return docs.select("doc_id", "source", leaf_hash([*rest, text]).alias("hash"), altered.alias("altered"))


def numbered(scratch: Scratch, df: DataFrame, order: list[str], name: str) -> DataFrame:
    """`df` with `at`, the place of each row in the order of all, from 0. The driver sees one number for each partition."""
    rows = scratch.keep(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), name)
    part = F.shiftright("_m", 33).cast("int")
    before, total = [], 0
    for r in sorted(rows.groupBy(part.alias("_p")).count().collect()):
        before.append((r["_p"], total))
        total += r["count"]
    starts = F.broadcast(df.sparkSession.createDataFrame(before, "_p int, _before long"))
    return rows.withColumn("_p", part).join(starts, "_p").withColumn("at", F.col("_before") + F.col("_m") - F.shiftleft(F.col("_p").cast("long"), 33)).drop("_p", "_m", "_before")


@dataclass
class Climb:
    """Trees over groups of nodes, in rounds of `levels` levels."""

    scratch: Scratch
    levels: int

    def up(self, nodes: DataFrame, most: int, name: str, more: tuple[str, ...] = ()) -> tuple[list[DataFrame], DataFrame]:
        """Blocks of every round over `nodes` (g, pos, n, hash; n nodes in the group, `most` at most), and the top node of each group."""
        fan, rounds = FAN**self.levels, []
        each = functools.partial(_roots, most=self.levels)
        while True:
            k, held = len(rounds), F.sort_array(F.collect_list(F.struct("pos", "hash", *more)))
            rounds.append(self.scratch.keep(nodes.groupBy("g", "n", F.expr(f"pos div {fan}").alias("block")).agg(held.alias("nodes")), f"{name}{k}"))
            nodes = self.scratch.keep(rounds[-1].mapInArrow(each, "g long, pos long, n long, hash string"), f"{name}{k}-roots")
            most, more = -(-most // fan), ()
            if most <= 1:
                return rounds, nodes

    def down(self, rounds: list[DataFrame], paths: DataFrame, name: str) -> DataFrame:
        """Paths (g, block, path, subroot) of the nodes of the first of `rounds`, from those of the top nodes."""
        each = functools.partial(_paths, most=self.levels)
        for k, blocks in reversed(list(enumerate(rounds))):
            paths = self.scratch.keep(below(blocks, paths).mapInArrow(each, "g long, block long, path string, subroot string"), f"{name}{k}-paths")
        return paths


def below(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """`blocks` with the path above each."""
    return blocks.join(F.broadcast(paths) if paths.count() <= LIGHT_ROWS else paths, ["g", "block"])


def manifest(docs: DataFrame, tampered: Column | None = None, with_paths: bool = True, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, path, proof_sha256, folded_root and verified of each row. A path (null if not asked for) is, from
    the leaf up, the node's place in its run, the number of siblings and these, as `read` reads it; rows that `tampered` marks are
    folded from a text without line ends."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    made = scratch.keep(leaves(docs, tampered).withColumn("seq", F.monotonically_increasing_id()), "leaves")
    rows = numbered(scratch, made, ["source", "doc_id", "hash", "seq"], "sorted")
    sources = numbered(scratch, rows.groupBy("source").agg(F.min("at").alias("first"), F.count("*").alias("n")), ["source"], "sources")
    sources = scratch.keep(sources.select(F.col("first").alias("start"), F.col("at").alias("g"), "n", "source"), "groups")
    known = sources.agg(F.count("*").alias("sources"), F.max("n").alias("most"), F.sum("n").alias("rows")).first()
    if not known["sources"]:
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, path string, proof_sha256 string, folded_root string, verified boolean")
    key = F.struct(F.col("source").isNull().alias("no"), F.coalesce("source", F.lit("")).alias("s")).alias("k")
    keyed = sources.select(key, "start", "g", "n", F.col("n").alias("members"))
    placed = rows.select("doc_id", "hash", "altered", "at", key)
    if known["sources"] <= max(LEAST_HOT, HOT):
        grouped = placed.join(F.broadcast(keyed.drop("n")), "k")
    else:
        grouped = spread_join(placed, keyed, "k", known["rows"])
    nodes = grouped.select("g", (F.col("at") - F.col("start")).alias("pos"), F.col("members").alias("n"), "hash", "doc_id", "altered")
    trees = Climb(scratch, block_levels)
    levels, tops = trees.up(nodes, known["most"], "level", ("doc_id", "altered"))
    upper, top = trees.up(tops.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("pos"), F.lit(known["sources"]).cast("long").alias("n"), "hash"), known["sources"], "source")
    root = top.first()["hash"]
    # From the root down: the paths of subroots in the tree of sources, then those of blocks in their source's tree.
    none = F.lit("").alias("path")
    paths = trees.down(upper, top.select("g", F.col("pos").alias("block"), none, F.lit("").alias("subroot")), "source")
    subroots = tops.select("g", F.col("hash").alias("subroot"))
    paths = scratch.keep(paths.select(F.col("block").alias("g"), "path").join(subroots, "g").select("g", F.lit(0).cast("long").alias("block"), "path", "subroot"), "subroots")
    paths = trees.down(levels[1:], paths, "level")
    kind = "doc_id long, leaf string, subroot string, path string, proof_sha256 string, folded_root string"
    out = below(levels[0], paths).mapInArrow(functools.partial(_proofs, most=block_levels, with_paths=with_paths), kind)
    return out.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), "path", "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return manifest(table(spark, sf_dir, "documents"), even, with_paths=False).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


#: crc32 of the id's digits, bit by bit; the constant is the polynomial.
_CRC = """(SELECT xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(l.doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
 lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295))"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _sql() -> str:
    rest = " || ".join(_field(f"CAST({c} AS VARCHAR)") for c in FIELDS[:-1])
    return f"""
WITH RECURSIVE l AS (
  SELECT doc_id, source, text, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n,
    sha256({rest} || {_field("text")}) AS leaf, sha256({rest} || {_field("replace(text, chr(10), '')")}) AS cut FROM documents),
low AS (
  SELECT s, 0 AS h, i, n, leaf AS x FROM l
  UNION ALL
  SELECT s, h + 1, i // 3, (n + 2) // 3, sha256(string_agg(x, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY s, h, i // 3, n),
sub AS (SELECT s, x FROM low WHERE n = 1),
high AS (
  SELECT 0 AS h, s AS i, (SELECT count(*) FROM sub) AS n, x FROM sub
  UNION ALL
  SELECT h + 1, i // 3, (n + 2) // 3, sha256(string_agg(x, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY h, i // 3, n),
steps AS (
  SELECT l.doc_id, 0 AS tree, low.h AS h, low.i, low.x, low.i = l.i // CAST(pow(3, low.h) AS BIGINT) AS own FROM l JOIN low ON l.s = low.s AND low.n > 1 AND low.i // 3 = l.i // CAST(pow(3, low.h + 1) AS BIGINT)
  UNION ALL
  SELECT l.doc_id, 1, high.h, high.i, high.x, high.i = l.s // CAST(pow(3, high.h) AS BIGINT) FROM l JOIN high ON high.n > 1 AND high.i // 3 = l.s // CAST(pow(3, high.h + 1) AS BIGINT)),
sides AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY tree, h) AS k, coalesce(string_agg(x, '' ORDER BY i) FILTER (WHERE i < me), '') AS a, coalesce(string_agg(x, '' ORDER BY i) FILTER (WHERE i > me), '') AS b
  FROM (SELECT *, max(i) FILTER (WHERE own) OVER (PARTITION BY doc_id, tree, h) AS me FROM steps) GROUP BY doc_id, tree, h),
proof AS (SELECT doc_id, sha256(string_agg(a || b, '' ORDER BY k)) AS proof_sha256, max(k) AS top FROM sides GROUP BY doc_id),
folded AS (
  SELECT doc_id, 0 AS k, CASE WHEN {_CRC} % 2 = 0 THEN cut ELSE leaf END AS x FROM l
  UNION ALL
  SELECT folded.doc_id, folded.k + 1, sha256(a || x || b) FROM folded JOIN sides ON sides.doc_id = folded.doc_id AND sides.k = folded.k + 1)
SELECT l.doc_id, leaf, sub.x AS subroot, r.x AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded.x AS folded_root, folded.x = r.x AS verified
FROM l JOIN sub USING (s) CROSS JOIN (SELECT x FROM high WHERE n = 1) r LEFT JOIN proof USING (doc_id) JOIN folded ON folded.doc_id = l.doc_id AND folded.k = coalesce(proof.top, 0)
"""


ORACLE_SQL = _sql()
