"""Readers of source trees, configuration, smell reports and archives."""

from __future__ import annotations

import io
import os
import shutil
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RUN

MAX_UPLOAD, MAX_BYTES, MAX_ENTRIES, MAX_DEPTH = 500 << 20, 1 << 30, 100_000, 50


def unpack(archive: bytes | str, name: str, to: str, max_bytes: int = MAX_BYTES, max_entries: int = MAX_ENTRIES, max_depth: int = MAX_DEPTH) -> str:
    """Unpacks a ZIP archive into the new folder `to` and returns its root: a single top folder becomes the root.
    ValueError if it is no .zip, too large, too deep, or holds blank, doubled or outside names; then nothing is left behind."""
    if not name.lower().endswith(".zip"):
        raise ValueError("not a .zip file")
    size = len(archive) if isinstance(archive, bytes) else os.path.getsize(archive)
    if not 0 < size <= MAX_UPLOAD:
        raise ValueError("empty or too large")
    root = Path(to).resolve()
    root.mkdir(parents=True)
    try:
        seen: set[str] = set()
        left = max_bytes
        with zipfile.ZipFile(io.BytesIO(archive) if isinstance(archive, bytes) else archive) as z:
            if len(z.infolist()) > max_entries:
                raise ValueError("too many entries")
            for entry in z.infolist():
                at = (root / entry.filename).resolve()
                if not entry.filename.strip() or not at.is_relative_to(root):
                    raise ValueError("entry outside the folder")
                if len(at.relative_to(root).parts) > max_depth or entry.filename in seen:
                    raise ValueError("too deep, or twice")
                seen.add(entry.filename)
                if entry.is_dir():
                    at.mkdir(parents=True, exist_ok=True)
                    continue
                at.parent.mkdir(parents=True, exist_ok=True)
                with z.open(entry) as source, at.open("xb") as out:
                    while part := source.read(1 << 16):
                        left -= len(part)
                        if left < 0:
                            raise ValueError("too much when unpacked")
                        out.write(part)
    except Exception as e:
        shutil.rmtree(root, ignore_errors=True)
        raise e if isinstance(e, ValueError) else ValueError(str(e)) from e
    top = list(root.iterdir())
    return str(top[0] if len(top) == 1 and top[0].is_dir() else root)


def inventory(spark: SparkSession, root: str, project: str = "project") -> DataFrame:
    """(project, path, dir, basename, size) of all files, empty ones too, listed by executors."""
    from .trees import listing

    return listing(spark, root, project).drop("modified")


def contents(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(path, text) of the files that match, read as Latin-1."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = Path(root).resolve().as_posix()
    return files.select(F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^{base}/", "").alias("path"), F.decode("content", "ISO-8859-1").alias("text"))


def source_lines(files: DataFrame) -> DataFrame:
    """(path, line_no, text) of (path, text) files; \\n, \\r and \\r\\n end a line, and no empty line follows the last end."""
    whole = F.regexp_replace("text", r"(\r\n|\r|\n)\z", "")
    return files.filter("text <> ''").select("path", F.posexplode(F.split(whole, "\r\n|\r|\n", -1)).alias("i", "text")).select("path", (F.col("i") + 1).alias("line_no"), "text")


def of_services(paths: DataFrame, services: DataFrame) -> DataFrame:
    """Rows with a path as rows of the service (dir, service) in whose folder the path is, deepest folder first; file is the path within."""
    folders = F.filter(F.transform(F.sequence(F.lit(0), F.size(F.split("path", "/")) - 1), lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/")), lambda x: F.lit(True))
    hit = paths.select("path").distinct().select("path", F.explode(folders).alias("dir")).join(services, "dir")
    best = hit.groupBy("path").agg(F.max_by(F.struct("dir", "service"), F.length("dir")).alias("s")).select("path", "s.dir", "s.service")
    joined = paths.join(best, "path")
    return joined.withColumn("file", F.when(F.col("dir") == "", F.col("path")).otherwise(F.expr("substring(path, length(dir) + 2)"))).drop("path", "dir")


def plain_text(value) -> str:
    """A value as text: [a, b] for lists, {k=v} for maps in them, true and false, null."""
    if isinstance(value, list):
        return f"[{', '.join(map(plain_text, value))}]"
    if isinstance(value, dict):
        return "{" + ", ".join(f"{k}={plain_text(v)}" for k, v in value.items()) + "}"
    return "null" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def flatten(value, prefix: str = "") -> dict[str, str]:
    """Nested maps as dotted keys; lists as text, nulls left out."""
    out: dict[str, str] = {}
    for k, v in (value or {}).items():
        key = f"{prefix}{k}"
        if isinstance(v, dict):
            out |= flatten(v, key + ".")
        elif v is not None:
            out[key] = plain_text(v)
    return out


def parse_yaml(text: str) -> dict[str, str]:
    """One document; nothing if it can't be read."""
    import yaml

    try:
        found = yaml.safe_load(text)
    except yaml.YAMLError:
        return {}
    return flatten(found) if isinstance(found, dict) else {}


def parse_properties(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    held = ""
    for line in text.splitlines():
        line = held + line.lstrip()
        held = ""
        if not line or line[0] in "#!":
            continue
        if (len(line) - len(line.rstrip("\\"))) % 2:
            held = line[:-1]
            continue
        at = next((i for i, c in enumerate(line) if c in "=: \t" and (i == 0 or line[i - 1] != "\\")), len(line))
        value = line[at:].lstrip(" \t")
        out[line[:at].replace("\\", "")] = value[1:].lstrip(" \t") if value[:1] in ("=", ":") else value
    return out


def config_properties(files: DataFrame) -> DataFrame:
    """(path, key, value) of application.yml, .yaml and .properties files in (path, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, k, v) for p, t in zip(b.path, b.text) for k, v in (parse_properties(t) if p.endswith(".properties") else parse_yaml(t)).items()]
            yield pd.DataFrame(rows, columns=["path", "key", "value"])

    return files.filter(F.col("path").rlike(r"(^|/)application\.(yml|yaml|properties)$")).mapInPandas(run, "path string, key string, value string")


def datasources(props: DataFrame) -> DataFrame:
    """(service, datasource_url, datasource_name) from (service, path, key, value): of each service's files by rank
    yml, yaml, properties, the first that gives the URL; the name is that of the URL as written."""
    from ..functions.text import database_name, resolve_defaults

    rank = F.when(F.col("path").endswith(".yml"), 0).when(F.col("path").endswith(".yaml"), 1).otherwise(2)
    urls = props.filter("key = 'spring.datasource.url' and trim(value) <> ''").groupBy("service").agg(F.min_by("value", F.struct(rank, "path")).alias("raw"))
    names = props.filter("key = 'spring.datasource.name'").groupBy("service").agg(F.min_by("value", F.struct(rank, "path")).alias("given"))
    return urls.join(names, "service", "left").select("service", resolve_defaults(F.col("raw")).alias("datasource_url"), F.coalesce("given", database_name(F.col("raw"))).alias("datasource_name"))


def split_csv(line):
    """Cells of a line: quotes toggle and vanish, commas outside them divide."""
    return F.transform(F.split(line, ',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1), lambda x: F.replace(x, F.lit('"'), F.lit("")))


# Severity of known smells; all others are MEDIUM.
HIGH_SMELLS = ["cyclic dependency", "cyclic-dependent modularization"]
LOW_SMELLS = ["unutilized abstraction", "unnecessary abstraction", "magic number", "long statement", "empty catch clause"]


def smell_severity(kind):
    return F.when(F.lower(kind).isin(HIGH_SMELLS), "HIGH").when(F.lower(kind).isin(LOW_SMELLS), "LOW").otherwise("MEDIUM")


def smell_reports(files: DataFrame) -> DataFrame:
    """(category, smell_type, class_name, severity) from the first report of each category in (path, text) CSV files."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    kinds = F.array(*[F.when(F.contains(name, F.lit(k)) & F.contains(name, F.lit("smell")), F.lit(k)) for k in ("design", "implementation", "architecture")])
    tagged = files.filter(name.endswith(".csv")).select("path", "text", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("category"))
    first = tagged.groupBy("category").agg(F.min_by("text", "path").alias("text"))
    rows = F.transform(F.filter(F.split("text", "\r\n|\r|\n"), lambda x: F.trim(x) != ""), split_csv)
    table = first.select("category", rows.alias("r")).withColumn("head", F.transform(F.get("r", F.lit(0)), lambda x: F.lower(F.trim(x))))
    smell = F.array_position(F.transform("head", lambda x: F.contains(x, F.lit("smell")) & ~F.contains(x, F.lit("cause"))), True).cast("int")
    by_type, by_package = F.array_position("head", "type name").cast("int"), F.array_position("head", "package name").cast("int")
    table = table.withColumns({"smell": smell, "cls": F.when(by_type > 0, by_type).otherwise(by_package)}).filter("smell > 0")
    cells = table.select("category", "smell", "cls", F.explode(F.slice("r", 2, F.greatest(F.size("r") - 1, F.lit(0)))).alias("c"))
    found = cells.select("category", F.trim(F.get("c", F.col("smell") - 1)).alias("smell_type"), F.trim(F.get("c", F.col("cls") - 1)).alias("class_name")).filter("smell_type <> ''")
    return found.withColumn("severity", smell_severity(F.col("smell_type")))


def sink(df: DataFrame, path: str) -> None:
    """Writes model rows, one folder for each project and run. The runs that `df` holds are replaced, all others stay, so a job
    that is started again leaves what one that ended would have left."""
    df.write.partitionBy(*RUN).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def stored_runs(spark: SparkSession, path: str, project_id: int | None = None, analysis_number: int | None = None) -> DataFrame:
    """Rows that `sink` wrote: of one run, of all runs of a project, or of all; folders of other runs are not read."""
    rows = spark.read.parquet(path)
    for column, value in zip(RUN, (project_id, analysis_number)):
        rows = rows if value is None else rows.filter(F.col(column) == value)
    return rows.withColumns({"project_id": F.col("project_id").cast("long"), "analysis_number": F.col("analysis_number").cast("int")})


def drop_run(spark: SparkSession, path: str, project_id: int, analysis_number: int) -> None:
    """Takes a run's folder away, if there is one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/project_id={project_id}/analysis_number={analysis_number}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
