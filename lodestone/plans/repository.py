"""The catalogue of repository queries (Q1-Q38) over model tables, as DataFrame functions,
and their form over the lens views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import model
from ..schema import ACTIVE
from .lens import DEPS, ENDPOINTS, FINDINGS, SERVICES, SMELLS, Tables, query


def by(df: DataFrame, **values) -> DataFrame:
    """Rows with the given values; a list means any of them."""
    for k, v in values.items():
        df = df.filter(F.col(k).isin(v) if isinstance(v, (list, tuple)) else F.col(k) == v)
    return df


def newest(df: DataFrame, n: int | None = None, offset: int = 0) -> DataFrame:
    out = df.orderBy(F.desc("created_at"), F.desc("id")).offset(offset)
    return out if n is None else out.limit(n)


def histogram(df: DataFrame, *cols: str) -> DataFrame:
    """Counts of the values, most frequent first."""
    return df.groupBy(*cols).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *cols)


def active_projects(jobs: DataFrame) -> DataFrame:
    """Projects with a job that is not at its end."""
    return by(jobs, status=ACTIVE).select("project_id").distinct()


def with_children(parents: DataFrame, children: DataFrame, on: list[str], name: str, *cols: str) -> DataFrame:
    """Parents with an array of their children, empty if there are none; children meet in an aggregate before the join."""
    each = children.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))
    return parents.join(each, on, "left").withColumn(name, F.coalesce(name, F.expr(f"slice({name}, 1, 0)"), F.array()))


def dependencies_named(deps: DataFrame, services: DataFrame) -> DataFrame:
    """Dependency rows with both services' names."""
    s = services.select("project_id", "analysis_number", F.col("id").alias("source_service_id"), F.col("name").alias("source"))
    o = services.select("project_id", "analysis_number", F.col("id").alias("target_service_id"), F.col("name").alias("target"))
    run = ["project_id", "analysis_number"]
    return deps.join(s, [*run, "source_service_id"]).join(o, [*run, "target_service_id"])


J = "SELECT o_orderkey id, o_custkey project_id, o_orderstatus status, o_orderdate created_at FROM orders"
#: Results of jobs that are done; owner of a project.
R = "SELECT o_orderkey job_id, o_custkey project_id, o_totalprice health_score, o_orderdate created_at FROM orders WHERE o_orderstatus = 'F'"
P = "SELECT c_custkey project_id, c_name name, c_nationkey owner FROM customer"
OWNER = 3


def results(v: Tables) -> DataFrame:
    return by(v.jobs, status="F").select(F.col("id").alias("job_id"), "project_id", "health_score", "created_at")


def projects(v: Tables) -> DataFrame:
    return v.read("customer").select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("owner"))


@query("q1_jobs_of_project", f"SELECT id, status FROM ({J}) WHERE project_id = 7")
def q1(spark, d):
    return by(Tables(spark, d).jobs, project_id=7).orderBy(F.desc("created_at")).select("id", "status")


@query("q2_latest_job_of_project", f"SELECT id FROM ({J}) WHERE project_id = 7 ORDER BY created_at DESC, id DESC LIMIT 1")
def q2(spark, d):
    return newest(by(Tables(spark, d).jobs, project_id=7), 1).select("id")


@query("q3_projects_with_open_jobs", f"SELECT DISTINCT project_id FROM ({J}) WHERE status IN ('O', 'P')")
def q3(spark, d):
    return by(Tables(spark, d).jobs, status=["O", "P"]).select("project_id").distinct()


@query("q4_jobs_by_status", f"SELECT id, project_id FROM ({J}) WHERE status = 'F'")
def q4(spark, d):
    return by(Tables(spark, d).jobs, status="F").orderBy("created_at").select("id", "project_id")


@query("q5_l1_recent_jobs", f"SELECT id, project_id FROM ({J}) ORDER BY created_at DESC, id DESC LIMIT 20")
def q5(spark, d):
    return newest(Tables(spark, d).jobs, 20).select("id", "project_id")


@query("l7_page_of_jobs", f"SELECT id FROM ({J}) ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 40")
def l7(spark, d):
    return newest(Tables(spark, d).jobs, 20, 40).select("id")


@query("q6_jobs_with_result", f"SELECT j.id, j.status, round(r.health_score, 1) score FROM ({J}) j LEFT JOIN ({R}) r ON r.job_id = j.id")
def q6(spark, d):
    v = Tables(spark, d)
    found = results(v).select(F.col("job_id").alias("id"), F.round("health_score", 1).alias("score"))
    return v.jobs.join(found, "id", "left").select("id", "status", "score")


@query("q7_job_with_project", "SELECT o_orderkey id, c_name project FROM orders JOIN customer ON o_custkey = c_custkey")
def q7(spark, d):
    v = Tables(spark, d)
    return v.jobs.join(v.read("customer"), F.col("project_id") == F.col("c_custkey")).select("id", F.col("c_name").alias("project"))


@query("q8_jobs_of_owner", f"SELECT j.id, round(r.health_score, 1) score FROM ({J}) j JOIN ({P}) p USING (project_id) LEFT JOIN ({R}) r ON r.job_id = j.id WHERE owner = {OWNER}")
def q8(spark, d):
    v = Tables(spark, d)
    own = v.jobs.join(by(projects(v), owner=OWNER).select("project_id"), "project_id")
    found = results(v).select(F.col("job_id").alias("id"), F.round("health_score", 1).alias("score"))
    return own.join(found, "id", "left").select("id", "score")


@query("q9_status_histogram", f"SELECT project_id, status, count(*) n FROM ({J}) GROUP BY 1, 2")
def q9(spark, d):
    return histogram(Tables(spark, d).jobs, "project_id", "status")


@query("q10_jobs_per_project", f"SELECT project_id, count(*) n, count(*) + 1 next_number FROM ({J}) GROUP BY 1")
def q10(spark, d):
    return Tables(spark, d).jobs.groupBy("project_id").agg(F.count("*").alias("n"), (F.count("*") + 1).alias("next_number"))


@query("q11_latest_results", f"SELECT project_id, job_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, job_id DESC) k FROM ({R})) WHERE k = 1")
def q11(spark, d):
    newest_of = F.max(F.struct("created_at", "job_id"))
    return results(Tables(spark, d)).groupBy("project_id").agg(newest_of.alias("r")).select("project_id", "r.job_id")


@query("q12_jobs_with_findings", "SELECT c_custkey project_id, count(o_orderkey) n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def q12(spark, d):
    v = Tables(spark, d)
    joined = with_children(v.read("customer").select(F.col("c_custkey").alias("project_id")), v.jobs, ["project_id"], "jobs", "id", "status")
    return joined.select("project_id", F.size("jobs").cast("long").alias("n"))


@query("q13_average_score", "SELECT o_custkey project_id, round(avg(o_totalprice), 1) score FROM orders GROUP BY 1")
def q13(spark, d):
    return Tables(spark, d).jobs.groupBy("project_id").agg(F.round(F.avg("health_score"), 1).alias("score"))


@query("q15_history_with_findings", f"WITH {FINDINGS}, r AS (SELECT DISTINCT run FROM f) SELECT CAST(r.run AS INTEGER) analysis_number, event_id finding_ord, kind pattern_type FROM r LEFT JOIN f ON f.run = r.run AND f.severity = 'CRITICAL'")
def q15(spark, d):
    found = Tables(spark, d).findings
    runs = found.select("project_id", "analysis_number").distinct()
    joined = runs.join(by(found, severity="CRITICAL"), ["project_id", "analysis_number"], "left")
    return joined.orderBy(F.desc("analysis_number"), "finding_ord").select("analysis_number", "finding_ord", "pattern_type")


@query("q16_smells_by_severity_text", f"WITH {SMELLS} SELECT doc_id, severity FROM smells WHERE service = 'src3'")
def q16(spark, d):
    return by(Tables(spark, d).smells, service="src3").orderBy(F.desc("severity")).select("doc_id", "severity")


@query("q17_smells_of_project", f"WITH {SMELLS} SELECT doc_id, d.lang project, severity FROM smells JOIN documents d USING (doc_id) WHERE severity = 'HIGH'")
def q17(spark, d):
    v = Tables(spark, d)
    project = v.read("documents").select("doc_id", F.col("lang").alias("project"))
    return by(v.smells, severity="HIGH").join(project, "doc_id").select("doc_id", "project", "severity")


@query("q18_smells_by_type", f"WITH {SMELLS} SELECT smell_type, severity, count(*) n FROM smells GROUP BY 1, 2")
def q18(spark, d):
    return histogram(Tables(spark, d).smells, "smell_type", "severity")


@query("q19_smells_per_service", f"WITH {SMELLS} SELECT service, count(*) n FROM smells GROUP BY 1")
def q19(spark, d):
    return histogram(Tables(spark, d).smells, "service")


@query("q20_smells_of_run", f"WITH {SMELLS} SELECT count(*) n FROM smells")
def q20(spark, d):
    return Tables(spark, d).smells.agg(F.count("*").alias("n"))


@query("q21_named_smells", f"WITH {SMELLS} SELECT doc_id, smell_type FROM smells WHERE smell_type IN ('God Class', 'Feature Envy')")
def q21(spark, d):
    return by(Tables(spark, d).smells, smell_type=["God Class", "Feature Envy"]).select("doc_id", "smell_type")


@query("q22_findings_of_type", f"WITH {FINDINGS} SELECT CAST(run AS INTEGER) analysis_number, event_id finding_ord FROM f WHERE kind = 'NANO_SERVICE' AND severity = 'HIGH'")
def q22(spark, d):
    return by(Tables(spark, d).findings, pattern_type="NANO_SERVICE", severity="HIGH").select("analysis_number", "finding_ord")


@query("q23_findings_by_type", f"WITH {FINDINGS} SELECT kind pattern_type, severity, count(*) n FROM f GROUP BY 1, 2")
def q23(spark, d):
    return histogram(Tables(spark, d).findings, "pattern_type", "severity")


@query("q24_endpoints_of_service", f"WITH {ENDPOINTS} SELECT name, path FROM ep WHERE name = 'Brand#12'")
def q24(spark, d):
    return by(Tables(spark, d).endpoints, name="Brand#12").orderBy("path").select("name", "path")


@query("q25_endpoints", f"WITH {ENDPOINTS} SELECT name, count(*) n, count(*) FILTER (WHERE NOT regexp_matches(path, '/v(\\d+)([/.]|$)')) unversioned FROM ep GROUP BY 1")
def q25(spark, d):
    return Tables(spark, d).endpoints.groupBy("name").agg(F.count("*").alias("n"), F.count_if(~F.col("has_versioning")).alias("unversioned"))


@query("q26_services_by_name", f"WITH {SERVICES} SELECT CAST(id AS BIGINT) id, name FROM services")
def q26(spark, d):
    return Tables(spark, d).services.orderBy("name").select("id", "name")


@query("q27_services_with_dependencies", f"WITH {SERVICES}, {DEPS} SELECT name, count(t) n_targets, string_agg(CAST(t AS VARCHAR), ',' ORDER BY t) targets FROM services LEFT JOIN deps ON s = id GROUP BY 1")
def q27(spark, d):
    v = Tables(spark, d)
    deps = v.deps.withColumnRenamed("source_service_id", "_source")
    services = v.services.withColumn("_source", F.col("id"))
    joined = with_children(services, deps, ["project_id", "analysis_number", "_source"], "deps", "target_service_id")
    targets = F.array_join(F.transform("deps", lambda x: x["target_service_id"].cast("string")), ",")
    return joined.orderBy("name").select("name", F.size("deps").cast("long").alias("n_targets"), F.nullif(targets, F.lit("")).alias("targets"))


@query("q28_service_sums", f"WITH {SERVICES} SELECT count(*) n, CAST(sum(loc) AS BIGINT) loc, round(avg(loc), 4) average FROM services")
def q28(spark, d):
    return Tables(spark, d).services.agg(F.count("*").alias("n"), F.sum("lines_of_code").alias("loc"), F.round(F.avg("lines_of_code"), 4).alias("average"))


@query("q29_services_by_database", f"WITH {SERVICES} SELECT name FROM services WHERE url = 'jdbc:postgresql://db/ASIA'")
def q29(spark, d):
    return by(Tables(spark, d).services, datasource_url="jdbc:postgresql://db/ASIA").select("name")


@query("q30_potential_nano_services", f"WITH {SERVICES} SELECT name FROM services WHERE loc < 2500 AND ep <= 5")
def q30(spark, d):
    return Tables(spark, d).services.filter("lines_of_code < 2500 AND number_of_endpoints <= 5").select("name")


@query("q31_projects_of_owner", f"SELECT project_id, name FROM ({P}) WHERE owner = {OWNER}")
def q31(spark, d):
    return by(projects(Tables(spark, d)), owner=OWNER).orderBy(F.desc("project_id")).select("project_id", "name")


@query("q32_projects_with_jobs", f"SELECT p.project_id, count(j.id) n_jobs, count(j.id) > 0 AS has_jobs FROM ({P}) p LEFT JOIN ({J}) j USING (project_id) GROUP BY 1")
def q32(spark, d):
    v = Tables(spark, d)
    per = v.jobs.groupBy("project_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return projects(v).join(per, "project_id", "left").select("project_id", n.alias("n_jobs"), (n > 0).alias("has_jobs"))


@query("q33_dependencies_of_type", f"WITH {DEPS} SELECT CAST(s AS BIGINT) source_service_id, CAST(t AS BIGINT) target_service_id FROM deps WHERE rn = 1")
def q33(spark, d):
    return by(Tables(spark, d).deps, dependency_type="FEIGN_CLIENT").select("source_service_id", "target_service_id")


@query("q34_dependencies_named", f"WITH {DEPS} SELECT a.n_name source, b.n_name target, CAST(cc AS INTEGER) call_count FROM deps JOIN nation a ON a.n_nationkey = s JOIN nation b ON b.n_nationkey = t")
def q34(spark, d):
    v = Tables(spark, d)
    return dependencies_named(v.deps, v.services).select("source", "target", "call_count")


@query("q35_dependency_counts", f"WITH {SERVICES}, {DEPS} SELECT name, (SELECT count(*) FROM deps WHERE s = id) outgoing, (SELECT count(*) FROM deps WHERE t = id) incoming FROM services")
def q35(spark, d):
    v = Tables(spark, d)
    end = lambda side, out: F.struct(F.col(f"{side}_service_id").alias("id"), F.lit(out).alias("o"), F.lit(1 - out).alias("i"))
    ends = v.deps.select("project_id", "analysis_number", F.inline(F.array(end("source", 1), end("target", 0))))
    per = ends.groupBy("project_id", "analysis_number", "id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return v.services.join(per, ["project_id", "analysis_number", "id"], "left").select("name", zero("o").alias("outgoing"), zero("i").alias("incoming"))


@query("q36_chatty_dependencies", f"WITH {DEPS} SELECT a.n_name source, b.n_name target, CAST(cc AS INTEGER) call_count FROM deps JOIN nation a ON a.n_nationkey = s JOIN nation b ON b.n_nationkey = t WHERE cc >= 60")
def q36(spark, d):
    v = Tables(spark, d)
    return dependencies_named(v.deps.filter("call_count >= 60"), v.services).select("source", "target", "call_count")


@query("q37_most_called", f"WITH {DEPS} SELECT CAST(t AS BIGINT) target_service_id, count(*) n FROM deps GROUP BY 1")
def q37(spark, d):
    return histogram(Tables(spark, d).deps, "target_service_id")


@query("q38_user_exists", "SELECT count(*) > 0 AS found FROM customer WHERE c_name = 'Customer#000000001'")
def q38(spark, d):
    return by(Tables(spark, d).read("customer"), c_name="Customer#000000001").agg((F.count("*") > 0).alias("found"))


@query("t1_job_states", """WITH e AS (SELECT user_id % 500 job_id, event_id seq, CASE WHEN event_id % 40 = 7 THEN 'CANCELLED' ELSE upper(event_type) END status, event_id % 11 completed, event_id % 3 * 5 total FROM events),
s AS (SELECT job_id, min(seq) stop FROM e WHERE status = 'CANCELLED' GROUP BY 1), l AS (SELECT e.*, row_number() OVER (PARTITION BY e.job_id ORDER BY seq DESC) rn FROM e LEFT JOIN s USING (job_id) WHERE stop IS NULL OR seq <= stop)
SELECT job_id, status, CAST(CASE WHEN total = 0 THEN 0 ELSE completed * 100 // total END AS INTEGER) progress FROM l WHERE rn = 1""")
def t1(spark, d):
    i = F.col("event_id")
    e = Tables(spark, d).read("events").select((F.col("user_id") % 500).alias("job_id"), i.alias("seq"), F.when(i % 40 == 7, "CANCELLED").otherwise(F.upper("event_type")).alias("status"), (i % 11).alias("completed"), (i % 3 * 5).alias("total"))
    return model.job_state(e)
