"""Line scans over source_lines (service, file, line_no, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import literal_urls, strip

FRAMEWORK = r"@SpringBootApplication|@QuarkusMain|@ApplicationPath|Micronaut\.run\(|extends\s+MicroserviceApplication"
MAIN = r"public\s+static\s+void\s+main\s*\("


def code_lines(lines: DataFrame) -> DataFrame:
    """Lines outside comments, imports and package clauses; the comment state runs down each file."""
    t = strip(F.col("text"))
    event = F.when(F.contains(t, F.lit("*/")), False).when(t.startswith("/*"), True)
    before = Window.partitionBy("service", "file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    marked = lines.withColumns({"_t": t, "_e": event}).withColumn("_in", F.coalesce(F.last("_e", ignorenulls=True).over(before), F.lit(False)))
    skip = F.col("_in") | F.col("_t").rlike(r"^(//|\*|/\*|import |package )")
    return marked.filter(~skip).drop("_t", "_e", "_in")


def entry_points(lines: DataFrame) -> DataFrame:
    """Services with a framework entry point or a main method."""
    found = code_lines(lines).groupBy("service").agg(F.bool_or(F.col("text").rlike(FRAMEWORK)).alias("framework"), F.bool_or(F.col("text").rlike(MAIN)).alias("main"))
    return found.filter("framework or main")


def hardcoded_urls(lines: DataFrame) -> DataFrame:
    """(service, file, line_no, pos, url) of URLs in literals of main code."""
    t = strip(F.col("text"))
    main = lines.filter(~F.col("file").rlike("test|Test") & ~t.rlike(r"^(//|\*|/\*|import |package )"))
    return main.select("service", "file", "line_no", F.posexplode(literal_urls(F.col("text"))).alias("pos", "url"))


def line_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("service").agg(F.count("*").alias("lines_of_code"))


def snippets(hits: DataFrame, lines: DataFrame, k: int = 3) -> DataFrame:
    """`hits` (service, file, line_no) with the lines around each, k before and after: start_line, end_line, snippet."""
    hit = hits.select("service", "file", F.col("line_no").alias("hit_line")).distinct()
    wanted = hit.withColumn("line_no", F.explode(F.sequence(F.col("hit_line") - k, F.col("hit_line") + k)))
    joined = wanted.join(lines.select("service", "file", "line_no", "text"), ["service", "file", "line_no"])
    rows = joined.groupBy("service", "file", "hit_line").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("r"))
    return rows.select("service", "file", "hit_line", F.col("r")[0]["line_no"].alias("start_line"), F.element_at("r", -1)["line_no"].alias("end_line"), F.array_join("r.text", "\n").alias("snippet"))


def main_class(lines: DataFrame) -> DataFrame:
    """(service, file): the first file with an entry point, else the first file."""
    rank = F.min(F.when(F.col("text").rlike(r"@SpringBootApplication|public static void main"), 0).otherwise(1)).alias("rank")
    files = lines.groupBy("service", "file").agg(rank)
    return files.groupBy("service").agg(F.min_by("file", F.struct("rank", "file")).alias("file"))
