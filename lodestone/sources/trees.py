"""Folders and archives, listed and read by executors.

Paths are those that every executor reaches: a shared folder, or the address of
a store that pyarrow knows.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import MAX_BYTES, MAX_DEPTH, MAX_ENTRIES, MAX_UPLOAD
from .stages import Stored

FILE = "project string, path string, dir string, basename string, size long, modified timestamp"
#: Folders that one task lists, and bytes that one task unpacks, about.
LIST_FOLDERS, CHUNK_BYTES = 64, 64 << 20


def opened(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pafs.LocalFileSystem(), root)


def listing(spark: SparkSession, root: str, project: str = "project", max_depth: int = 100) -> DataFrame:
    """FILE of all files below `root`, empty ones too. Each round lists the folders that the one before found; the driver
    sees their number alone."""

    def children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = opened(root)
        base = base.rstrip("/")
        for b in batches:
            rows = []
            for at in b["dir"]:
                for x in fs.get_file_info(pafs.FileSelector(f"{base}/{at}" if at else base, recursive=False)):
                    path = f"{at}/{x.base_name}" if at else x.base_name
                    folder = x.type == pafs.FileType.Directory
                    rows.append((project, path, at, x.base_name, None if folder else x.size, pd.Timestamp(x.mtime).tz_localize(None).floor("us") if x.mtime else None, folder))
            yield pd.DataFrame(rows, columns=["project", "path", "dir", "basename", "size", "modified", "folder"]).astype({"size": "Int64"})

    found: list[DataFrame] = []
    todo, n = spark.createDataFrame([("",)], "dir string"), 1
    while n and len(found) < max_depth:
        spread = todo.repartition(max(1, -(-n // LIST_FOLDERS)))
        level = Stored(spread.mapInPandas(children, FILE + ", folder boolean"), folders=F.col("folder"))
        found.append(level.df.filter("not folder").drop("folder"))
        todo, n = level.df.filter("folder").select(F.col("path").alias("dir")), level.counts["folders"]
    out = found[0]
    for level in found[1:]:
        out = out.unionByName(level)
    return out


def read(files: DataFrame, root: str) -> DataFrame:
    """(path, text, hash) of `files` (path), read as Latin-1 where they are."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = opened(root)
        for b in batches:
            for path in b["path"]:
                with fs.open_input_stream(f"{base.rstrip('/')}/{path}") as f:
                    yield pd.DataFrame({"path": [path], "content": [f.read()]})

    held = files.select("path").mapInPandas(load, "path string, content binary")
    return held.select("path", F.decode("content", "ISO-8859-1").alias("text"), F.sha2("content", 256).alias("hash"))


# -- archives -------------------------------------------------------------------------------

_ENTRY = "project string, archive string, entry string, folder boolean, size long, fault string"


def entries(archives: DataFrame) -> DataFrame:
    """_ENTRY for each entry of `archives` (project, archive: their paths), from their directories alone. An archive that can't be
    opened has one row, with its fault."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for project, archive in zip(b["project"], b["archive"]):
                rows = []
                try:
                    fs, at = opened(archive)
                    size = fs.get_file_info(at).size
                    if not archive.lower().endswith(".zip"):
                        raise ValueError("not a .zip file")
                    if not size or size > MAX_UPLOAD:
                        raise ValueError("empty or too large")
                    with fs.open_input_file(at) as f, zipfile.ZipFile(f) as z:
                        rows = [(project, archive, e.filename, e.is_dir(), e.file_size, None) for e in z.infolist()]
                except Exception as e:  # noqa: BLE001  a bad archive is told and does not stop the others
                    rows = [(project, archive, None, None, None, str(e)[:200] or type(e).__name__)]
                yield pd.DataFrame(rows, columns=["project", "archive", "entry", "folder", "size", "fault"]).astype({"size": "Int64"})

    return archives.repartition("archive").mapInPandas(look, _ENTRY)


def verdicts(listed: DataFrame, max_bytes: int = MAX_BYTES, max_entries: int = MAX_ENTRIES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(project, archive, fault) of each archive of `entries`; fault is null if it may be unpacked. Sizes and numbers of entries
    are summed over all tasks that unpack an archive before any of them begins."""
    parts = F.filter(F.split(F.regexp_replace("entry", r"\\\\", "/"), "/"), lambda x: (x != "") & (x != "."))
    # The depth to which a name climbs, part by part; below zero it is outside.
    steps = F.transform(parts, lambda x: F.when(x == "..", -1).otherwise(1))
    lowest = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda a, x: F.struct((a["at"] + x).alias("at"), F.least(a["low"], a["at"] + x).alias("low")))["low"]
    outside = (lowest < 0) | F.col("entry").startswith("/") | (F.trim("entry") == "")
    rows = listed.withColumns({"_outside": F.coalesce(outside, F.lit(False)), "_depth": F.size(parts)})
    twice = rows.groupBy("project", "archive", "entry").agg(F.count("*").alias("n")).filter("n > 1 and entry is not null").select("project", "archive").distinct().withColumn("_twice", F.lit(True))
    told = rows.groupBy("project", "archive").agg(
        F.max("fault").alias("fault"), F.count("entry").alias("n"), F.sum("size").alias("bytes"), F.max("_depth").alias("depth"), F.bool_or("_outside").alias("outside")
    ).join(twice, ["project", "archive"], "left")
    fault = (
        F.when(F.col("fault").isNotNull(), F.col("fault")).when(F.col("n") > max_entries, "too many entries").when(F.col("outside"), "entry outside the folder")
        .when((F.col("depth") > max_depth) | F.coalesce("_twice", F.lit(False)), "too deep, or twice").when(F.col("bytes") > max_bytes, "too much when unpacked")
    )
    return told.select("project", "archive", fault.alias("fault"))


def unpacked(archives: DataFrame, **caps: int) -> tuple[DataFrame, DataFrame]:
    """(project, path, content) of all files of the `archives` (project, archive) that pass, and their verdicts. Entries are dealt
    out by their bytes, so that one large archive keeps many tasks busy. No entry gives more bytes than its directory says, which the
    caps count; an archive with an entry that can't be read, or is not what its checksum says, gives nothing. A single top folder
    becomes the root."""
    listed = Stored(entries(archives)).df
    judged = Stored(verdicts(listed, **caps)).df
    good = judged.filter("fault is null").select("project", "archive")
    held = listed.filter("not folder").join(good, ["project", "archive"])
    # A large entry has a chunk of its own, small ones share some.
    chunks = F.greatest(F.lit(1), F.ceil(F.col("total") / CHUNK_BYTES))
    sums = held.groupBy("project", "archive").agg(F.sum("size").alias("total"))
    dealt = held.join(sums, ["project", "archive"]).withColumn("chunk", F.pmod(F.xxhash64("entry"), chunks))

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (project, archive), group in b.groupby(["project", "archive"], sort=False):
                fs, at = opened(archive)
                with fs.open_input_file(at) as f, zipfile.ZipFile(io.BufferedReader(f)) as z:
                    for name in group["entry"]:
                        try:
                            data, fault = z.read(name), None
                        except Exception as e:  # noqa: BLE001  told below, with its archive
                            data, fault = None, str(e)[:200] or type(e).__name__
                        yield pd.DataFrame({"project": [project], "archive": [archive], "path": [name], "content": [data], "fault": [fault]})

    files = Stored(dealt.repartition("archive", "chunk").mapInPandas(take, "project string, archive string, path string, content binary, fault string")).df
    broken = files.filter("fault is not null").groupBy("project", "archive").agg(F.min("fault").alias("_broken"))
    judged = judged.join(broken, ["project", "archive"], "left").select("project", "archive", F.coalesce("fault", "_broken").alias("fault"))
    # Folders count when the root is sought: a top folder beside a file, or an empty one, is not alone.
    top = F.substring_index(F.col("entry"), "/", 1)
    tops = listed.join(good, ["project", "archive"]).groupBy("project", "archive").agg(F.count_distinct(top).alias("n"), F.min(top).alias("top"), F.min(F.contains("entry", F.lit("/")).cast("int")).alias("all_in"))
    lone = tops.filter("n = 1 and all_in = 1").select("project", "archive", "top")
    whole = files.join(broken, ["project", "archive"], "left_anti").join(lone, ["project", "archive"], "left")
    path = F.when(F.col("top").isNull(), F.col("path")).otherwise(F.expr("substring(path, length(top) + 2)"))
    return whole.select("project", path.alias("path"), "content"), judged
