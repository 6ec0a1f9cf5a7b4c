"""From scanned sources to services and dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_service, port_of, strip_suffix

# Directory names that are not services.
NOT_SERVICES = [
    "example", "examples", "sample", "samples", "demo", "demos", "test", "tests", "integration-test", "integration-tests", "e2e", "e2e-tests", "it-tests", "tck", "testkit",
    "doc", "docs", "documentation", "tutorial", "tutorials", "benchmark", "benchmarks", "buildsrc", "buildscript", "starter", "starters", "template", "templates",
    "archetype", "archetypes", "mock", "mocks", "fixture", "fixtures", "bom", "dependencies", "platform",
]
BUILD_FILES = ["pom.xml", "build.gradle", "build.gradle.kts"]
SKIPPED = ["target", "build", "node_modules", ".gradle", ".git"]


def excluded_name(name, keywords: list[str] | None = None):
    """The name, or the last of several parts split at - and ., is a keyword, or it begins with module-info."""
    keywords = NOT_SERVICES if keywords is None else keywords
    low = F.lower(name)
    parts = F.split(F.regexp_replace(low, r"[-.]+$", ""), "[-.]")
    return low.isin(keywords) | ((F.size(parts) > 1) & F.element_at(parts, -1).isin(keywords)) | low.startswith("module-info")


def candidates(files: DataFrame, modules: DataFrame, keywords: list[str] | None = None) -> DataFrame:
    """(project, dir, name) of build directories that may be services. `files`: project, path, dir, basename, where the
    root's dir is ''; `modules`: (project, dir) of build files that declare submodules."""
    keywords = NOT_SERVICES if keywords is None else keywords
    segments = F.filter(F.split("dir", "/"), lambda x: x != "")
    build = files.filter(F.col("basename").isin(BUILD_FILES) & ~F.arrays_overlap(segments, F.array(*map(F.lit, SKIPPED)))).select("project", "dir").distinct()
    has_src = files.select("project", F.explode(F.filter(F.array(F.regexp_extract("path", "^(|.*?/)src/", 1)), lambda x: F.lit(True))).alias("dir"), "path").filter(F.col("path").rlike("(^|/)src/")).select("project", F.regexp_replace("dir", "/$", "").alias("dir")).distinct().withColumn("has_src", F.lit(True))
    ancestors = F.transform(F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0))), lambda x: F.lower(x))
    name = F.element_at(F.split("dir", "/"), -1)
    out = build.join(modules.distinct().withColumn("has_sub", F.lit(True)), ["project", "dir"], "left").join(has_src, ["project", "dir"], "left").na.fill(False, ["has_sub", "has_src"])
    aggregator = F.when(F.col("dir") == "", F.col("has_sub")).otherwise(F.col("has_sub") & ~F.col("has_src"))
    out = out.filter(~aggregator & ((F.col("dir") == "") | ~excluded_name(name, keywords)) & ~F.arrays_overlap(ancestors, F.array(*map(F.lit, keywords))))
    return out.select("project", "dir", name.alias("name"))


def deployable(found: DataFrame, files: DataFrame, entries: DataFrame, projects: DataFrame) -> DataFrame:
    """(project, dir, confidence, signal): candidates with a framework entry point, a Dockerfile or a main method, else the fallbacks.
    `entries`: project, dir, framework, main."""
    docker = files.filter((F.lower("basename") == "dockerfile") & F.col("basename").isin("Dockerfile", "dockerfile") | F.lower("basename").endswith(".dockerfile")).select("project", "dir").distinct().withColumn("docker", F.lit(True))
    flags = found.join(entries, ["project", "dir"], "left").join(docker, ["project", "dir"], "left").na.fill(False, ["framework", "main", "docker"])
    signal = F.when(F.col("framework"), "framework-entry-point").when(F.col("docker"), "dockerfile").when(F.col("main"), "main-method")
    passed = flags.withColumn("signal", signal).filter("signal is not null")
    passed = passed.withColumn("confidence", F.when(F.col("framework"), "HIGH").when(F.col("docker"), "MEDIUM").otherwise("LOW")).select("project", "dir", "confidence", "signal")
    # Projects of which no candidate passes keep one service.
    rest = projects.select("project").distinct().join(passed.select("project").distinct(), "project", "left_anti")
    n = found.groupBy("project").agg(F.count("*").alias("n"), F.min("dir").alias("only"))
    fallback = rest.join(n, "project", "left").na.fill(0, ["n"]).select(
        "project", F.when(F.col("n") == 1, F.col("only")).otherwise("").alias("dir"), F.lit("LOW").alias("confidence"),
        F.when(F.col("n") == 1, "single-module-fallback").when(F.col("n") == 0, "no-candidates-fallback").otherwise("all-gated-fallback").alias("signal"),
    )
    return passed.unionByName(fallback)


def aliases(services: DataFrame) -> DataFrame:
    """(project_id, alias, id): a directory name beats an application name; among equal directory names the last, among equal applications the first."""
    own = services.select("project_id", F.lower("name").alias("alias"), "id", F.lit(0).alias("prio"), (-F.col("id")).alias("ord"))
    app = services.filter("app_name is not null").select("project_id", F.lower("app_name").alias("alias"), "id", F.lit(1).alias("prio"), F.col("id").alias("ord"))
    first = Window.partitionBy("project_id", "alias").orderBy("prio", "ord")
    return own.unionByName(app).withColumn("rn", F.row_number().over(first)).filter("rn = 1").select("project_id", "alias", "id")


#: Length of the pieces by which a name is sought within others; shorter names are sought whole.
GRAM = 3


def _grams(df: DataFrame, text: str, sizes: list[int]) -> DataFrame:
    """Rows of `df` for each distinct piece of `text`, of each of `sizes` letters."""
    length = F.length(text)

    def of(n: int) -> Column:
        return F.when(length >= n, F.transform(F.sequence(F.lit(1), length - n + 1), lambda i: F.substring(F.col(text), i, n)))

    pieces = [of(n) for n in sizes]
    whole = F.array_distinct(F.flatten(F.filter(F.array(*pieces), lambda x: x.isNotNull())))
    return df.withColumn("gram", F.explode(whole))


def within(needles: DataFrame, haystacks: DataFrame) -> DataFrame:
    """(project_id, needle, haystack) for each `needle` (project_id, needle; none is empty) that is a part of a `haystack`
    (project_id, haystack) of its project. A needle is looked up by one piece of it, the one that the fewest haystacks of the
    project hold, and then compared; no needle meets a haystack with which it does not share that piece."""
    needles, haystacks = needles.distinct(), haystacks.distinct()
    held = _grams(haystacks, "haystack", list(range(1, GRAM + 1)))
    often = held.groupBy("project_id", "gram").agg(F.count("*").alias("n"))
    # Pieces of a needle are as long as it allows, up to GRAM letters.
    own = _grams(needles.withColumn("size", F.least(F.length("needle"), F.lit(GRAM))), "needle", list(range(1, GRAM + 1))).filter(F.length("gram") == F.col("size"))
    # A piece that no haystack holds rules its needle out.
    counted = own.join(often, ["project_id", "gram"], "left").na.fill(0, ["n"])
    rarest = counted.groupBy("project_id", "needle").agg(F.min(F.struct("n", "gram")).alias("r")).filter("r.n > 0").select("project_id", "needle", F.col("r.gram").alias("gram"))
    return held.join(rarest, ["project_id", "gram"]).filter(F.contains("haystack", "needle")).select("project_id", "needle", "haystack")


def alike(targets: DataFrame, names: DataFrame) -> DataFrame:
    """(project_id, norm, alias) of targets and aliases of which one is a part of the other, or the alias without its suffix a part of
    the target. An alias of nothing but a suffix is a part of any target; of those, the first of each project counts."""
    stripped = names.select("project_id", "alias", strip_suffix(F.col("alias")).alias("needle"))
    needles = names.select("project_id", "alias", F.col("alias").alias("needle")).unionByName(stripped).distinct()
    norms = targets.select("project_id", "norm").distinct()
    ahead = within(needles.filter("needle <> ''").select("project_id", "needle"), norms.select("project_id", F.col("norm").alias("haystack")))
    ahead = ahead.join(needles, ["project_id", "needle"]).select("project_id", F.col("haystack").alias("norm"), "alias")
    back = within(norms.select("project_id", F.col("norm").alias("needle")), names.select("project_id", F.col("alias").alias("haystack")))
    bare = needles.filter("needle = ''").groupBy("project_id").agg(F.min("alias").alias("alias"))
    everywhere = norms.join(bare, "project_id").select("project_id", "norm", "alias")
    return ahead.unionByName(back.select("project_id", F.col("needle").alias("norm"), F.col("haystack").alias("alias"))).unionByName(everywhere)


def resolve(calls: DataFrame, services: DataFrame) -> DataFrame:
    """`calls` (project_id, target, ...) with target_id and tier: by name, by port, then by likeness of names; first hit by tier and name."""
    targets = calls.select("project_id", "target").distinct().withColumn("norm", normalize_service(F.col("target")))
    names = aliases(services)
    by_name = targets.join(names.withColumn("norm", F.col("alias")), ["project_id", "norm"]).select("project_id", "target", "id", F.lit(1).alias("tier"), "alias")
    last = services.filter("port is not null").groupBy("project_id", "port").agg(F.max("id").alias("id"))
    ported = targets.withColumn("port", port_of(F.col("target")))
    by_port = ported.join(last, ["project_id", "port"]).select("project_id", "target", "id", F.lit(2).alias("tier"), F.lit("").alias("alias"))
    # Likeness is sought among the targets that the first tiers leave.
    left = targets.join(by_name.unionByName(by_port).select("project_id", "target").distinct(), ["project_id", "target"], "left_anti").filter("norm <> ''")
    first_like = alike(left, names).groupBy("project_id", "norm").agg(F.min("alias").alias("alias"))
    by_like = left.join(first_like, ["project_id", "norm"]).join(names, ["project_id", "alias"]).select("project_id", "target", "id", F.lit(3).alias("tier"), "alias")
    hit = by_name.unionByName(by_port).unionByName(by_like)
    best = hit.groupBy("project_id", "target").agg(F.min(F.struct("tier", "alias", "id")).alias("h")).select("project_id", "target", F.col("h.id").alias("target_id"), F.col("h.tier").alias("tier"))
    return calls.join(best, ["project_id", "target"])


def dependencies(calls: DataFrame, services: DataFrame) -> DataFrame:
    """Dependency rows: calls (project_id, source_id, target, ord, dependency_type, file, line, code) grouped by raw target,
    with the evidence of the first; then resolved, without calls of a service to itself."""
    first = F.min_by(F.struct("dependency_type", "file", "line", "code"), "ord").alias("e")
    each = calls.groupBy("project_id", "source_id", "target").agg(F.count("*").cast("int").alias("call_count"), first)
    return resolve(each, services).filter("source_id <> target_id").select("project_id", "source_id", "target_id", "target", "call_count", "e.dependency_type", "e.file", "e.line", "e.code")


def latest(jobs: DataFrame) -> DataFrame:
    """The latest job of each project."""
    return jobs.groupBy("project_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))


def number_runs(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("analysis_number", F.row_number().over(Window.partitionBy("project_id").orderBy("created_at", "id")))


def progress(completed: Column, total: Column) -> Column:
    """Whole per cent of the services done; 0 where there are none."""
    done, all_ = completed.cast("long"), total.cast("long")
    return F.when(F.coalesce(all_, F.lit(0)) == 0, 0).otherwise(F.floor(done * 100 / all_)).cast("int")


def job_state(events: DataFrame) -> DataFrame:
    """(job_id, status, progress) of events (job_id, seq, status, completed, total), streaming or not: one aggregate
    for each job, in which the first CANCELLED wins over all else, and the last event over the rest."""
    event = F.struct("status", "completed", "total")
    stopped = F.min_by(event, F.when(F.col("status") == "CANCELLED", F.col("seq")))
    last = events.groupBy("job_id").agg(F.count_if(F.col("status") == "CANCELLED").alias("n"), stopped.alias("stopped"), F.max_by(event, "seq").alias("last"))
    e = last.select("job_id", F.when(F.col("n") > 0, F.col("stopped")).otherwise(F.col("last")).alias("e"))
    return e.select("job_id", "e.status", progress(F.col("e.completed"), F.col("e.total")).alias("progress"))
