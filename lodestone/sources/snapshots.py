"""What files say, kept from one snapshot of a tree to the next.

A snapshot reads the files whose size or time has changed, and takes apart
those whose content is new; what all others say was written by an earlier one.
Tables lie in `store`: files/snapshot=N names each file's content and the
snapshot that took it apart; lines, types and props hold what that one found.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files, java, trees
from .stages import Stored

#: Files that are read at all, and those of them that are taken apart as code.
WANTED = r"\.java$|^application\.(yml|yaml|properties)$|^pom\.xml$|^settings\.gradle"
CODE = r"(^|/)src/main/java/.*\.java$"
_TABLES = {"lines": "line_no int, text string", "types": java.TYPE.removeprefix("path string, "), "props": "key string, value string"}


@dataclass
class Facts:
    """Files (project, path, dir, basename, size, modified), lines (path, line_no, text), types (path, ...) and props (path, key, value)."""

    listed: DataFrame
    lines: DataFrame
    types: DataFrame
    props: DataFrame
    #: Files that were read, and those of them that were taken apart.
    n_read: int = 0
    n_parsed: int = 0


def take_apart(contents: DataFrame) -> dict[str, DataFrame]:
    """Lines, types and props of (path, text) files."""
    code = contents.filter(F.col("path").rlike(CODE))
    return {"lines": files.source_lines(contents), "types": java.java_types(code.select("path", "text")), "props": files.config_properties(contents)}


def read_tree(spark: SparkSession, root: str, project: str) -> Facts:
    """All that a tree says, with nothing kept."""
    listed = Stored(trees.listing(spark, root, project)).df
    wanted = listed.filter(F.col("basename").rlike(WANTED))
    contents = Stored(trees.read(wanted.repartition("path"), root))
    return Facts(listed, n_read=contents.n, n_parsed=contents.n, **take_apart(contents.df))


def _table(spark: SparkSession, store: str, name: str, columns: str) -> DataFrame:
    kind = f"{columns}, snapshot int"
    return spark.read.schema(kind).parquet(f"{store}/{name}") if files.exists(spark, f"{store}/{name}") else spark.createDataFrame([], kind)


_FILES = "path string, size long, modified timestamp, hash string, origin int"


def scan(spark: SparkSession, root: str, project: str, store: str, snapshot: int, trust_times: bool = True) -> Facts:
    """Facts of the tree at `root` as snapshot number `snapshot` (from 1, ascending; a number that was used is written anew). With
    `trust_times`, a file of the same size and time as in the last snapshot is not read; without, all files are read, and those
    with the content that they had are not taken apart."""
    listed = Stored(trees.listing(spark, root, project)).df
    wanted = listed.filter(F.col("basename").rlike(WANTED)).select("path", "size", "modified")
    earlier = _table(spark, store, "files", _FILES).filter(F.col("snapshot") < snapshot)
    last = earlier.agg(F.max("snapshot")).first()[0]
    before = earlier.filter(F.col("snapshot") == F.lit(last)).drop("snapshot")
    same = wanted.join(before, ["path", "size", "modified"]) if trust_times else before.limit(0)
    fresh = wanted.join(same.select("path"), "path", "left_anti")
    contents = Stored(trees.read(fresh.repartition("path"), root))
    # Content that some earlier snapshot took apart under this name.
    known = earlier.groupBy("path", "hash").agg(F.min("origin").alias("origin"))
    read = contents.df.select("path", "hash").join(known, ["path", "hash"], "left")
    new = Stored(contents.df.join(known, ["path", "hash"], "left_anti"))
    now = wanted.join(read, "path").select("path", "size", "modified", "hash", F.coalesce("origin", F.lit(snapshot)).alias("origin"))
    files_now = Stored(same.select("path", "size", "modified", "hash", "origin").unionByName(now))
    hashes = new.df.select("path", "hash")
    for name, part in take_apart(new.df).items():
        part.join(hashes, "path").write.mode("overwrite").parquet(f"{store}/{name}/snapshot={snapshot}")
    files_now.df.write.mode("overwrite").parquet(f"{store}/files/snapshot={snapshot}")
    # Each file's facts lie in the snapshot that took it apart: other folders are not read.
    at = files_now.df.select("path", "hash", F.col("origin").alias("snapshot"))
    tables = {name: _table(spark, store, name, f"path string, hash string, {columns}").join(at, ["path", "hash", "snapshot"], "left_semi").drop("hash", "snapshot") for name, columns in _TABLES.items()}
    return Facts(listed, n_read=contents.n, n_parsed=new.n, **tables)
