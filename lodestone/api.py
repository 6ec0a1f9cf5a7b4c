"""Analysis of one source tree, from files to findings and score, and questions to its results."""

from __future__ import annotations

import functools
from collections.abc import Callable
from contextlib import nullcontext
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import lines as scan
from .functions import text as t
from .operators import detectors, diff, graph, model, score
from .operators.runs import Run
from .schema import RUN
from .sources import files, java
from .sources.snapshots import Facts, read_tree
from .sources.snapshots import scan as scan_tree
from .sources.stages import keep
from .streaming.jobs import watch

#: Stages of an analysis.
STAGES = 4


@dataclass
class Analysis:
    services: DataFrame
    endpoints: DataFrame
    dependencies: DataFrame
    findings: DataFrame
    result: DataFrame


def submodules(lines: DataFrame) -> DataFrame:
    """(dir) of build files that declare submodules, from lines (path, text)."""
    name = F.element_at(F.split("path", "/"), -1)
    held = (name == "pom.xml") & F.col("text").rlike("<modules?>")
    gradle = name.startswith("settings.gradle") & F.contains("text", F.lit("include"))
    return lines.filter(held | gradle).select(F.regexp_replace("path", "/?[^/]+$", "").alias("dir")).distinct()


def java_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("path").endswith(".java"))


def find_services(spark: SparkSession, facts: Facts, project: str) -> DataFrame:
    """(dir, service, detection_confidence, detection_signal, id)."""
    listed = facts.listed
    found = keep(model.candidates(listed, submodules(facts.lines).withColumn("project", F.lit(project))))
    lines = files.of_services(java_lines(facts.lines), found.select("dir", F.col("dir").alias("service")))
    main = lines.filter(F.col("file").startswith("src/main/java/"))
    entries = scan.entry_points(main).select(F.lit(project).alias("project"), F.col("service").alias("dir"), "framework", "main")
    passed = model.deployable(found, listed, entries, spark.createDataFrame([(project,)], "project string"))
    short = F.when(F.col("dir") == "", F.lit(project)).otherwise(F.element_at(F.split("dir", "/"), -1))
    named = passed.withColumn("short", short).withColumn("n", F.count("*").over(Window.partitionBy("short")))
    named = named.withColumn("service", F.when(F.col("n") > 1, F.nullif("dir", F.lit(""))).otherwise(F.col("short")))
    ids = F.row_number().over(Window.partitionBy("project").orderBy("dir")).cast("long")  # one project's services
    return named.select("dir", F.coalesce("service", F.lit(project)).alias("service"), F.col("confidence").alias("detection_confidence"), F.col("signal").alias("detection_signal"), ids.alias("id"))


def analyze(
    spark: SparkSession, root: str, project: str = "project", project_id: int = 1, analysis_number: int = 1, config: dict | None = None, enabled: set[str] | None = None,
    smells: DataFrame | None = None, facts: Facts | None = None, run: Run | None = None, follow: bool = False,
) -> Analysis:
    """Services, endpoints, dependencies, findings and score of the tree at `root`, or of `facts` that were read from it; `smells`
    (service, smell_type) is optional. With `run`, each stage is told and the run can be cancelled; with `follow`, addresses of calls
    are sought behind variables too."""
    stage = (lambda name, k: nullcontext()) if run is None else lambda name, k: run.stage(name, k, STAGES)
    with stage("DETECTING_SERVICES", 0):
        facts = facts or read_tree(spark, root, project)
        found = keep(find_services(spark, facts, project))
    with stage("ANALYZING_SERVICES", 1):
        parts = _services(found, facts, project_id, analysis_number)
    with stage("BUILDING_GRAPH", 2):
        deps = _dependencies(found, parts, project_id, analysis_number, follow)
    with stage("DETECTING_PATTERNS", 3):
        return _judged(found, parts, deps, project_id, analysis_number, config, enabled, smells)


@dataclass
class _Parts:
    services: DataFrame
    endpoints: DataFrame
    types: DataFrame
    lines: DataFrame
    props: DataFrame
    configured: DataFrame


def _of_run(df: DataFrame, project_id: int, analysis_number: int) -> DataFrame:
    return df.select(F.lit(project_id).cast("long").alias("project_id"), F.lit(analysis_number).alias("analysis_number"), *df.columns)


def _value(props: DataFrame, key: str) -> DataFrame:
    return props.filter(F.col("key") == key).groupBy("service").agg(F.min_by("value", "path").alias("v"))


def _services(found: DataFrame, facts: Facts, project_id: int, analysis_number: int) -> _Parts:
    where = found.select("dir", "service")
    types = keep(files.of_services(facts.types, where).withColumnRenamed("file", "path").filter(F.col("path").startswith("src/main/java/")))
    lines = keep(files.of_services(java_lines(facts.lines), where))
    configured = files.of_services(facts.lines.filter(F.col("path").rlike(r"(^|/)src/main/resources/application\.[^/]*$")), where).filter(F.col("file").startswith("src/main/resources/"))
    props = keep(files.of_services(facts.props, where).withColumnRenamed("file", "path"))
    ends = keep(java.endpoints(types))
    counted = ends.groupBy("service").agg(F.count("*").cast("int").alias("number_of_endpoints"))
    classes = types.groupBy("service").agg(F.count("*").cast("int").alias("number_of_classes"))
    services = found.join(scan.line_counts(lines), "service", "left").join(counted, "service", "left").join(classes, "service", "left").join(files.datasources(props), "service", "left")
    services = services.na.fill(0, ["lines_of_code", "number_of_endpoints", "number_of_classes"])
    columns = [
        "id", F.col("service").alias("name"), F.col("dir").alias("relative_path"), F.col("lines_of_code").cast("int").alias("lines_of_code"), "number_of_classes",
        "number_of_endpoints", "datasource_url", "datasource_name", "detection_confidence", "detection_signal",
    ]
    services = keep(_of_run(services.select(*columns), project_id, analysis_number))
    named = ends.join(found.select("service", F.col("id").alias("microservice_id")), "service")
    return _Parts(services, keep(_of_run(named, project_id, analysis_number)), types, lines, props, configured)


def _dependencies(found: DataFrame, parts: _Parts, project_id: int, analysis_number: int, follow: bool) -> DataFrame:
    project = F.lit(project_id).cast("long").alias("project_id")
    ports = _value(parts.props, "server.port").select("service", t.resolve_defaults(F.col("v")).alias("v")).select("service", F.expr("try_cast(v AS int)").alias("port"))
    apps = _value(parts.props, "spring.application.name").select("service", t.resolve_defaults(F.col("v")).alias("app_name"))
    known = found.join(ports, "service", "left").join(apps, "service", "left").select(project, "id", F.col("service").alias("name"), "app_name", "port")
    made = java.raw_calls(parts.types, parts.props, follow).join(found.select("service", F.col("id").alias("source_id")), "service")
    resolved = model.dependencies(made.withColumn("project_id", project), known).withColumn("analysis_number", F.lit(analysis_number))
    order = F.row_number().over(Window.partitionBy("project_id").orderBy("source_id", "target")).cast("long")  # one project's pairs of services
    columns = [
        order.alias("id"), F.col("source_id").alias("source_service_id"), F.col("target_id").alias("target_service_id"), "dependency_type", "call_count",
        F.col("file").alias("evidence_file"), F.col("line").alias("evidence_line"), t.truncate(F.col("code"), 1000).alias("evidence_code"), F.col("target").alias("target_url"),
    ]
    return keep(resolved.select(*RUN, *columns))


def _judged(found: DataFrame, parts: _Parts, deps: DataFrame, project_id: int, analysis_number: int, config: dict | None, enabled: set[str] | None, smells: DataFrame | None) -> Analysis:
    of_run = lambda df: _of_run(df, project_id, analysis_number)
    services, main = parts.services, parts.lines.filter(F.col("file").startswith("src/main/java/"))
    m = detectors.Model(services, deps, parts.endpoints, of_run(main), of_run(java.class_metrics(parts.types)), of_run(java.client_types(parts.types)), of_run(parts.configured))
    findings = keep(detectors.detect(m, config, enabled))

    metrics = graph.run_metrics(services, deps)
    sums = services.groupBy(*RUN).agg(F.sum("lines_of_code").alias("loc"), F.coalesce(F.avg("lines_of_code"), F.lit(0.0)).alias("average_service_size"))
    n_smells = F.lit(0) if smells is None else F.lit(smells.join(found.select("dir", "service"), "service", "left_semi").count())
    cycles = findings.groupBy(*RUN).agg(F.count_if(F.col("pattern_type") == "CYCLIC_DEPENDENCY").cast("int").alias("cycles"))
    runs = metrics.join(sums, RUN).join(cycles, RUN, "left").na.fill(0, ["cycles"]).withColumn("smells", n_smells)
    result = score.score(runs, findings, config).join(score.severity_counts(findings), RUN, "left")
    counts = ["total_anti_patterns", *[f"{s}_issues" for s in ("critical", "high", "medium", "low")]]
    result = result.na.fill(0, counts).join(graph.graph_json(services, deps), RUN, "left")
    names = {
        "n_services": "services_analyzed", "loc": "total_lines_of_code", "smells": "total_code_smells", "cycles": "cycle_count",
        "coupling": "coupling_coefficient", "graph": "dependency_graph_json",
    }
    return Analysis(services, parts.endpoints, deps, findings, result.withColumnsRenamed(names))


# -- runs that follow each other -----------------------------------------------------


#: Tables of a run in a store, by their names in Analysis.
STORED = ["services", "endpoints", "dependencies", "findings", "result"]


def reanalyze(spark: SparkSession, root: str, store: str, project: str, project_id: int = 1, run: Run | None = None, trust_times: bool = True, **options) -> tuple[Analysis, Facts, int]:
    """The next run of the tree at `root`: only files that have changed since the last one are read (`snapshots.scan`), and the run's
    tables are written to `store`, one folder for each. A run that does not end leaves nothing there. Returns what was found, what was
    read, and the run's number."""
    results = f"{store}/result"
    last = files.stored_runs(spark, results, project_id).agg(F.max("analysis_number")).first()[0] if files.exists(spark, results) else None
    number, facts_at = (last or 0) + 1, f"{store}/facts/{project_id}"
    with nullcontext() if run is None else run.stage("CLONING", 0, STAGES):
        facts = scan_tree(spark, root, project, facts_at, number, trust_times)
    found = analyze(spark, root, project, project_id, number, facts=facts, run=run, **options)
    for name in STORED:
        if run is not None:
            run.undo(functools.partial(files.drop_run, spark, f"{store}/{name}", project_id, number))
        files.sink(getattr(found, name), f"{store}/{name}")
    if run is not None:
        run.done(STAGES)
    return found, facts, number


def history(spark: SparkSession, store: str, project_id: int) -> DataFrame:
    """The runs of a project in a store, compared each with the one before it."""
    of = lambda name: files.stored_runs(spark, f"{store}/{name}", project_id)
    found = of("findings") if files.exists(spark, f"{store}/findings") else spark.createDataFrame([], detectors.FINDINGS)
    return compare(found, of("result"))


def follow_snapshots(spark: SparkSession, folder: str, store: str, checkpoint: str, told: Callable[[tuple], None] | None = None, **options):
    """Analyses the trees that rows (project_id, project, root) in new Parquet files of `folder` name, one after the other in their
    order, and hands each result to `told`; the started query. A row that was read before a failure is analysed again, as a run more."""

    def each(batch: DataFrame, _: int) -> None:
        for r in batch.orderBy("project_id", "root").toLocalIterator():  # a snapshot a row, each a run of many jobs
            found = reanalyze(spark, r["root"], store, r["project"], r["project_id"], **options)
            if told is not None:
                told(found)

    return watch(spark, folder, "project_id long, project string, root string", each, checkpoint)


def changed_findings(findings: DataFrame, results: DataFrame) -> DataFrame:
    """The findings of each run that has one before it, as new, unchanged or resolved."""
    return diff.changes(findings.withColumn("key", diff.issue_key()), diff.previous(results.select(*RUN)))


def compare(findings: DataFrame, results: DataFrame) -> DataFrame:
    """History of `results`, newest first, with counts of unchanged, new and resolved findings and a sentence."""
    keyed = findings.withColumn("key", diff.issue_key())
    links = diff.previous(results.select(*RUN))
    counts = diff.multiset(keyed, links).groupBy(*RUN).agg(*[F.sum(c).alias(c) for c in ("n_unchanged", "n_new", "n_resolved")])
    out = diff.history(results).join(counts, RUN, "left").na.fill(0, ["n_unchanged", "n_new", "n_resolved"])
    return out.withColumn("summary", F.when(F.col("previous_run").isNotNull(), diff.summary(F.col("health_score_delta"), F.col("n_resolved"), F.col("n_new"))))
