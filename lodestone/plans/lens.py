"""Every operator over lens views: the driver's tables in the shape of services,
dependencies, endpoints, source lines, smells, jobs, runs and findings.

QUERIES has the DataFrame form, ORACLE_SQL the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lines as scan
from ..functions import text as t
from ..operators import detectors, diff, graph, model, score
from ..schema import RUN

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


class Tables:
    """Lens views over one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
        self.spark = spark

    def run(self, df: DataFrame) -> DataFrame:
        return df.select(F.lit(1).cast("long").alias("project_id"), F.lit(1).alias("analysis_number"), *df.columns)

    @property
    def services(self) -> DataFrame:
        supplier, nation, region = self.read("supplier"), self.read("nation"), self.read("region")
        ep = supplier.groupBy("s_nationkey").agg(F.count("*").alias("ep"))
        per = self.read("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
        loc = per.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("k")).agg(F.sum("n").alias("loc"))
        joined = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).join(ep, F.col("n_nationkey") == F.col("s_nationkey"), "left").join(loc, F.col("n_nationkey") == F.col("k"), "left")
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("int")
        return self.run(joined.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("jdbc:postgresql://db/"), "r_name").alias("datasource_url"), zero("loc").alias("lines_of_code"), zero("ep").alias("number_of_endpoints")))

    @property
    def deps(self) -> DataFrame:
        l, o, s, c = self.read("lineitem"), self.read("orders"), self.read("supplier"), self.read("customer")
        nations = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
        cc = l.select("l_orderkey", "l_suppkey").join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(nations, F.col("l_orderkey") == F.col("o_orderkey"))
        cc = cc.filter("s_nationkey <> c_nationkey").groupBy(F.col("s_nationkey").alias("s"), F.col("c_nationkey").alias("t")).agg(F.count("*").alias("cc"))
        top = cc.withColumn("rn", F.row_number().over(Window.partitionBy("s").orderBy(F.desc("cc"), "t"))).filter("rn <= 3")
        kind = F.element_at(F.array(F.lit("FEIGN_CLIENT"), F.lit("REST_TEMPLATE"), F.lit("WEB_CLIENT")), F.col("rn"))
        return self.run(top.select((F.col("s") * 100 + F.col("t")).cast("long").alias("id"), F.col("s").cast("long").alias("source_service_id"), F.col("t").cast("long").alias("target_service_id"), kind.alias("dependency_type"), F.col("cc").cast("int").alias("call_count"), F.concat(F.lit("f"), F.col("s"), F.lit(".java")).alias("evidence_file"), F.lit("call()").alias("evidence_code")))

    @property
    def lines(self) -> DataFrame:
        k, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
        made = (
            F.when(k % 6 == 0, F.concat(F.lit('String u = "http://svc-'), n, F.lit(":"), (8000 + F.col("c_nationkey")).cast("string"), F.lit('/api/v1/x";')))
            .when(k % 6 == 1, F.concat(F.lit('// "http://svc-'), n, F.lit('/a"')))
            .when(k % 6 == 2, F.concat(F.lit("call(10.0.0."), n, F.lit(":9090);")))
            .when(k % 6 == 3, F.concat(F.lit('String h = "10.0.0.'), n, F.lit(':9090/api" + "localhost:8080";')))
            .when(k % 6 == 4, "import java.util.List;")
            .otherwise("int x = 1;")
        )
        return self.read("customer").select(F.concat(F.lit("svc"), n).alias("service"), F.lit("Main.java").alias("file"), k.cast("int").alias("line_no"), made.alias("text"))

    @property
    def endpoints(self) -> DataFrame:
        versioned = (F.col("p_size") % 10 == 0) & (F.col("p_brand") != "Brand#11")
        path = F.concat(F.lit("/api"), F.when(versioned, F.concat(F.lit("/v"), (1 + F.col("p_size") % 3).cast("string"))).otherwise(""), F.lit("/"), F.lower(F.replace("p_type", F.lit(" "), F.lit("/"))))
        part = self.read("part").select(F.col("p_brand").alias("name"), path.alias("path"), F.col("p_partkey").alias("part"), F.concat(F.lit("C"), (F.col("p_partkey") % 7).cast("string")).alias("controller_class"))
        return self.run(part.select(F.regexp_extract("name", r"(\d+)", 1).cast("long").alias("microservice_id"), "name", "path", F.element_at(F.array(F.lit("GET"), F.lit("POST"), F.lit("PUT"), F.lit("DELETE")), (F.col("part") % 4 + 1).cast("int")).alias("http_method"), "controller_class", t.path_version(F.col("path")).alias("api_version"), t.path_version(F.col("path")).isNotNull().alias("has_versioning")))

    @property
    def brands(self) -> DataFrame:
        return self.endpoints.select(*RUN, F.col("microservice_id").alias("id"), "name").distinct()

    @property
    def smells(self) -> DataFrame:
        kind = F.when(F.col("toxic") == 1, "HIGH").when(F.col("quality") == 0, "MEDIUM").otherwise("LOW")
        name = F.element_at(F.array(F.lit("God Class"), F.lit("Feature Envy"), F.lit("Long Method")), (F.col("doc_id") % 3 + 1).cast("int"))
        return self.read("labels").join(self.read("documents").select("doc_id", "source"), "doc_id").select("doc_id", F.col("source").alias("service"), kind.alias("severity"), name.alias("smell_type"))

    @property
    def jobs(self) -> DataFrame:
        return self.read("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("health_score"))

    @property
    def findings(self) -> DataFrame:
        e = self.read("events")
        run = F.dense_rank().over(Window.orderBy("day"))
        days = e.select(F.to_date("ts").alias("day")).distinct().withColumn("analysis_number", run)  # a row for each day
        kind = F.col("event_type")
        sev = F.when(F.col("user_id") % 4 == 0, "CRITICAL").when(F.col("user_id") % 4 == 1, "HIGH").when(F.col("user_id") % 4 == 2, "MEDIUM").otherwise("LOW")
        return e.withColumn("day", F.to_date("ts")).join(days, "day").select(F.lit(1).cast("long").alias("project_id"), "analysis_number", F.col("event_id").alias("finding_ord"), F.when(kind == "click", "NANO_SERVICE").otherwise(F.upper(kind)).alias("pattern_type"), sev.alias("severity"), (F.col("user_id") % 20).cast("string").alias("primary_service"))


# -- SQL of the views ---------------------------------------------------------

SERVICES = """services AS (SELECT n_nationkey id, n_name name, concat('jdbc:postgresql://db/', r_name) url, coalesce(loc, 0) loc, coalesce(ep, 0) ep FROM nation JOIN region ON n_regionkey = r_regionkey
 LEFT JOIN (SELECT s_nationkey k, count(*) ep FROM supplier GROUP BY 1) a ON a.k = n_nationkey
 LEFT JOIN (SELECT s_nationkey k, count(*) loc FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1) b ON b.k = n_nationkey)"""
DEPS = """deps AS (SELECT s, t, cc, rn FROM (SELECT s, t, cc, row_number() OVER (PARTITION BY s ORDER BY cc DESC, t) rn FROM (
 SELECT s_nationkey s, c_nationkey t, count(*) cc FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey
 WHERE s_nationkey <> c_nationkey GROUP BY 1, 2)) WHERE rn <= 3)"""
LINES = """src AS (SELECT concat('svc', c_nationkey) service, c_custkey line_no, CASE c_custkey % 6
 WHEN 0 THEN concat('String u = "http://svc-', c_nationkey, ':', 8000 + c_nationkey, '/api/v1/x";') WHEN 1 THEN concat('// "http://svc-', c_nationkey, '/a"')
 WHEN 2 THEN concat('call(10.0.0.', c_nationkey, ':9090);') WHEN 3 THEN concat('String h = "10.0.0.', c_nationkey, ':9090/api" + "localhost:8080";')
 WHEN 4 THEN 'import java.util.List;' ELSE 'int x = 1;' END AS text FROM customer)"""
ENDPOINTS = """ep AS (SELECT p_brand name, p_partkey part, concat('/api', CASE WHEN p_size % 10 = 0 AND p_brand <> 'Brand#11' THEN concat('/v', 1 + p_size % 3) ELSE '' END, '/', lower(replace(p_type, ' ', '/'))) path FROM part)"""
SMELLS = """smells AS (SELECT doc_id, source service, CASE WHEN toxic = 1 THEN 'HIGH' WHEN quality = 0 THEN 'MEDIUM' ELSE 'LOW' END severity,
 CASE doc_id % 3 WHEN 0 THEN 'God Class' WHEN 1 THEN 'Feature Envy' ELSE 'Long Method' END smell_type FROM labels JOIN documents USING (doc_id))"""
FINDINGS = """f AS (SELECT dense_rank() OVER (ORDER BY CAST(ts AS DATE)) run, event_id, CASE WHEN event_type = 'click' THEN 'NANO_SERVICE' ELSE upper(event_type) END kind,
 CASE user_id % 4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END severity, CAST(user_id % 20 AS VARCHAR) primary_service FROM events)"""


# -- detectors ------------------------------------------------------------------


def _short(df: DataFrame, *more: str) -> DataFrame:
    return df.select("pattern_type", "severity", F.col("primary_service").alias("service"), F.array_join("affected", ",").alias("affected"), *more)


@query("k1_cycles", f"""WITH RECURSIVE {DEPS}, r(s, t) AS (SELECT s, t FROM deps UNION SELECT r.s, deps.t FROM r JOIN deps ON r.t = deps.s),
c AS (SELECT a.s id, min(a.t) comp FROM r a JOIN r b ON a.s = b.t AND a.t = b.s GROUP BY 1)
SELECT 'CYCLIC_DEPENDENCY' pattern_type, 'CRITICAL' severity, min(n_name) service, string_agg(n_name, ',' ORDER BY n_name) affected, CAST(count(*) AS INTEGER) cycle_length
FROM c JOIN nation ON n_nationkey = id GROUP BY comp HAVING count(*) > 1""")
def k1(spark, d):
    v = Tables(spark, d)
    return _short(detectors.cyclic(detectors.Model(v.services, v.deps)), "cycle_length")


@query("k2_shared_database", f"WITH {SERVICES} SELECT 'SHARED_DATABASE' pattern_type, 'HIGH' severity, min(name) service, string_agg(name, ',' ORDER BY name) affected, url shared_database_url FROM services GROUP BY url HAVING count(*) > 1")
def k2(spark, d):
    v = Tables(spark, d)
    return _short(detectors.shared_database(detectors.Model(v.services, v.deps)), "shared_database_url")


@query("k3_nano", f"WITH {SERVICES} SELECT 'NANO_SERVICE' pattern_type, 'MEDIUM' severity, name service, name affected FROM services WHERE loc < 2000 AND ep <= 3")
def k3(spark, d):
    v = Tables(spark, d)
    return _short(detectors.nano(detectors.Model(v.services, v.deps), {"nano_max_loc": 2000, "nano_max_endpoints": 3}))


@query("k5_chatty", f"WITH {DEPS} SELECT 'CHATTY_SERVICE' pattern_type, 'HIGH' severity, a.n_name service, concat(a.n_name, ',', b.n_name) affected, CAST(cc AS INTEGER) call_count FROM deps JOIN nation a ON a.n_nationkey = s JOIN nation b ON b.n_nationkey = t WHERE cc >= 100")
def k5(spark, d):
    v = Tables(spark, d)
    return _short(detectors.chatty(detectors.Model(v.services, v.deps), {"chatty_min_calls": 100}), "call_count")


_LITERALS = """lit AS (SELECT service, line_no, unnest(q) AS body, generate_subscripts(q, 1) AS pos FROM (
 SELECT service, line_no, regexp_extract_all(text, '"([^"]*)"', 1) AS q FROM src WHERE NOT regexp_matches(text, '^(//|\\*|/\\*|import |package )'))),
u AS (SELECT service, line_no, pos, regexp_extract(body, '(?i)(https?://[\\w.\\-:]+[/\\w.\\-?=&#%]*|(localhost|127\\.0\\.0\\.1|\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}):\\d{2,5}([/\\w.\\-?=&#%]*)?)', 1) AS url FROM lit)"""


@query("p13_hardcoded_urls", f"WITH {LINES}, {_LITERALS} SELECT service, CAST(line_no AS INTEGER) line_no, url FROM u WHERE url <> ''")
def p13(spark, d):
    return scan.hardcoded_urls(Tables(spark, d).lines).select("service", "line_no", "url")


_METRICS = f"""WITH {DEPS}, m AS (SELECT (SELECT count(*) FROM nation) n_services, (SELECT count(*) FROM deps) total_dependencies, (SELECT count(*) FROM (SELECT DISTINCT s, t FROM deps)) n_edges,
 (SELECT count(*) FROM (SELECT s FROM deps UNION SELECT t FROM deps)) connected)"""


@query("k7_monolith", f"""{_METRICS} SELECT 'DISTRIBUTED_MONOLITH' pattern_type, 'CRITICAL' severity, CAST(NULL AS VARCHAR) service, (SELECT string_agg(n_name, ',' ORDER BY n_name) FROM nation) affected FROM m
WHERE n_services >= 3 AND (n_edges / (n_services * (n_services - 1.0)) > 0.03 OR connected / CAST(n_services AS DOUBLE) > 0.8)""")
def k7(spark, d):
    v = Tables(spark, d)
    return _short(detectors.monolith(detectors.Model(v.services, v.deps), {"monolith_coupling": 0.03}))


@query("a5_run_metrics", f"{_METRICS} SELECT n_services, total_dependencies, n_edges, connected, round(n_edges / (n_services * (n_services - 1.0)), 6) coupling, round(connected / CAST(n_services AS DOUBLE), 6) connected_ratio FROM m")
def a5(spark, d):
    v = Tables(spark, d)
    return graph.run_metrics(v.services, v.deps).select("n_services", "total_dependencies", "n_edges", "connected", F.round("coupling", 6).alias("coupling"), F.round("connected_ratio", 6).alias("connected_ratio"))


@query("k8_api_versioning", f"WITH {ENDPOINTS} SELECT 'API_VERSIONING_ABSENCE' pattern_type, 'MEDIUM' severity, name service, name affected FROM ep GROUP BY name HAVING count(*) FILTER (WHERE regexp_matches(path, '/v(\\d+)([/.]|$)')) = 0")
def k8(spark, d):
    v = Tables(spark, d)
    return _short(detectors.api_versioning(detectors.Model(v.brands, v.deps, endpoints=v.endpoints)))


@query("k9_wrong_cuts", f"WITH {DEPS} SELECT 'WRONG_CUTS' pattern_type, 'HIGH' severity, a.n_name service, concat(a.n_name, ',', b.n_name) affected FROM deps x JOIN deps y ON x.s = y.t AND x.t = y.s AND x.s < x.t JOIN nation a ON a.n_nationkey = x.s JOIN nation b ON b.n_nationkey = x.t")
def k9(spark, d):
    v = Tables(spark, d)
    return _short(detectors.wrong_cuts(detectors.Model(v.services, v.deps)))


_WALKS = ", ".join(f"w{k} AS (SELECT w.s, e.t, sum(w.sg) sg FROM w{k - 1} w JOIN e ON w.t = e.s GROUP BY 1, 2)" for k in range(2, 7))
_BC = f"""WITH {DEPS}, e AS (SELECT DISTINCT s, t FROM deps), w1 AS (SELECT s, t, CAST(count(*) AS DOUBLE) sg FROM e GROUP BY 1, 2), {_WALKS},
aw AS ({" UNION ALL ".join(f"SELECT {k} d, s, t, sg FROM w{k}" for k in range(1, 7))}),
sp AS (SELECT s, t, d, sg FROM (SELECT *, row_number() OVER (PARTITION BY s, t ORDER BY d) rn FROM aw WHERE s <> t) WHERE rn = 1),
b AS (SELECT a.t v, sum(a.sg * b.sg / p.sg) bc FROM sp a JOIN sp b ON a.t = b.s JOIN sp p ON p.s = a.s AND p.t = b.t AND p.d = a.d + b.d WHERE a.s <> b.t GROUP BY 1),
bc AS (SELECT n_nationkey id, n_name name, coalesce(bc, 0) bc, coalesce(bc, 0) / 552.0 bc_norm FROM nation LEFT JOIN b ON v = n_nationkey),
deg AS (SELECT n_nationkey id, (SELECT count(*) FROM deps WHERE t = n_nationkey) in_degree, (SELECT count(*) FROM deps WHERE s = n_nationkey) out_degree, (SELECT count(*) FROM deps) n_rows FROM nation)"""


@query("g3_betweenness", f"{_BC} SELECT CAST(id AS BIGINT) id, round(bc, 6) bc, round(bc_norm, 8) bc_norm FROM bc")
def g3(spark, d):
    v = Tables(spark, d)
    return graph.betweenness(v.services, v.deps).select("id", F.round("bc", 6).alias("bc"), F.round("bc_norm", 8).alias("bc_norm"))


@query("g2_components", f"""WITH RECURSIVE {DEPS}, r(s, t) AS (SELECT s, t FROM deps UNION SELECT r.s, deps.t FROM r JOIN deps ON r.t = deps.s),
c AS (SELECT a.s id, min(a.t) component FROM r a JOIN r b ON a.s = b.t AND a.t = b.s GROUP BY 1)
SELECT CAST(component AS BIGINT) component, CAST(id AS BIGINT) id FROM c WHERE component IN (SELECT component FROM c GROUP BY 1 HAVING count(*) > 1)""")
def g2(spark, d):
    return graph.scc(Tables(spark, d).deps).select("component", "id")


@query("g6_reciprocal", f"WITH {DEPS} SELECT CAST(x.s AS BIGINT) a, CAST(x.t AS BIGINT) b FROM deps x JOIN deps y ON x.s = y.t AND x.t = y.s WHERE x.s < x.t")
def g6(spark, d):
    return graph.reciprocal(Tables(spark, d).deps).select("a", "b")


@query("a10_degrees", f"""WITH {DEPS}, o AS (SELECT s id, count(*) n, count(DISTINCT t) k FROM deps GROUP BY 1), i AS (SELECT t id, count(*) n, count(DISTINCT s) k FROM deps GROUP BY 1)
SELECT CAST(n_nationkey AS BIGINT) id, coalesce(o.n, 0) out_degree, coalesce(i.n, 0) in_degree, coalesce(i.k, 0) callers, coalesce(o.k, 0) callees,
 round((coalesce(o.n, 0) + coalesce(i.n, 0)) / CAST((SELECT count(*) FROM deps) AS DOUBLE), 6) mediator_ratio FROM nation LEFT JOIN o ON o.id = n_nationkey LEFT JOIN i ON i.id = n_nationkey""")
def a10(spark, d):
    v = Tables(spark, d)
    return graph.degrees(v.services, v.deps).select("id", "out_degree", "in_degree", "callers", "callees", F.round("mediator_ratio", 6).alias("mediator_ratio"))


# -- aggregates, score, diff ------------------------------------------------------


@query("a2_service_totals", f"WITH {SERVICES} SELECT count(*) services, CAST(sum(loc) AS BIGINT) total_loc, round(avg(loc), 6) average_loc, CAST(sum(ep) AS BIGINT) endpoints FROM services")
def a2(spark, d):
    return Tables(spark, d).services.agg(F.count("*").alias("services"), F.sum("lines_of_code").alias("total_loc"), F.round(F.coalesce(F.avg("lines_of_code"), F.lit(0.0)), 6).alias("average_loc"), F.sum("number_of_endpoints").alias("endpoints"))


@query("a1_severity_counts", f"""WITH {FINDINGS} SELECT CAST(run AS INTEGER) analysis_number, count(*) total_anti_patterns, count(*) FILTER (WHERE severity = 'CRITICAL') critical_issues, count(*) FILTER (WHERE severity = 'HIGH') high_issues,
 count(*) FILTER (WHERE severity = 'MEDIUM') medium_issues, count(*) FILTER (WHERE severity = 'LOW') low_issues FROM f GROUP BY run""")
def a1(spark, d):
    return score.severity_counts(Tables(spark, d).findings).drop("project_id")


_POINTS = "CASE severity WHEN 'CRITICAL' THEN 8 WHEN 'HIGH' THEN 5 WHEN 'MEDIUM' THEN 3 ELSE 1 END"


@query("a19_penalty_by_type", f"WITH {FINDINGS} SELECT CAST(run AS INTEGER) analysis_number, kind pattern_type, count(*) AS count, CAST(sum({_POINTS}) AS BIGINT) points FROM f WHERE kind <> 'NANO_SERVICE' GROUP BY 1, 2")
def a19(spark, d):
    return score.by_type(Tables(spark, d).findings).drop("project_id")


_SCORE = f"""WITH f AS (SELECT user_id project, CASE WHEN event_type = 'click' THEN 'NANO_SERVICE' ELSE upper(event_type) END kind, CASE event_id % 4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END severity FROM events),
r AS (SELECT project, sum(CASE WHEN kind = 'NANO_SERVICE' THEN 0 ELSE {_POINTS} END) p, count(*) FILTER (WHERE kind = 'NANO_SERVICE') nano,
 project % 50 * 7 smells, 1000 + project * 100 loc, (project % 9) / 10.0 coupling, project % 4 cycles FROM f GROUP BY project),
s AS (SELECT project, greatest(0, 40 - p) a, 20 - CASE WHEN smells > 0 THEN least(20, floor(20 * (smells / (loc / 1000.0)) / 80 + 0.5)) ELSE 0 END q,
 25 - CASE WHEN coupling > 0.1 THEN least(15, floor(15 * coupling + 0.5)) ELSE 0 END - CASE WHEN cycles > 0 THEN least(10, 5 * cycles) ELSE 0 END y, greatest(0, 15 - least(8, 3 * nano)) z FROM r)"""


@query("h5_health_score", f"""{_SCORE} SELECT project project_id, CAST(a AS INTEGER) anti_patterns, CAST(q AS INTEGER) code_quality, CAST(y AS INTEGER) architecture, CAST(z AS INTEGER) service_sizing, CAST(a + q + y + z AS INTEGER) health_score,
 CASE WHEN a + q + y + z >= 90 THEN 'A' WHEN a + q + y + z >= 80 THEN 'B' WHEN a + q + y + z >= 65 THEN 'C' WHEN a + q + y + z >= 50 THEN 'D' ELSE 'F' END grade FROM s""")
def h5(spark, d):
    """Each user's events are the findings of one project."""
    i = F.col("event_id") % 4
    severity = F.when(i == 0, "CRITICAL").when(i == 1, "HIGH").when(i == 2, "MEDIUM").otherwise("LOW")
    kind = F.when(F.col("event_type") == "click", "NANO_SERVICE").otherwise(F.upper("event_type"))
    found = Tables(spark, d).read("events").select(F.col("user_id").alias("project_id"), F.lit(1).alias("analysis_number"), kind.alias("pattern_type"), severity.alias("severity"))
    n = F.col("project_id")
    runs = found.select(*RUN).distinct().withColumns({"smells": n % 50 * 7, "loc": 1000 + n * 100, "coupling": (n % 9) / 10, "cycles": n % 4})
    return score.score(runs, found).select("project_id", "anti_patterns", "code_quality", "architecture", "service_sizing", "health_score", "grade")


@query("h11_history", f"""WITH {FINDINGS}, r AS (SELECT run, count(*) total FROM f GROUP BY 1) SELECT CAST(run AS INTEGER) analysis_number, total total_anti_patterns, total - lag(total) OVER (ORDER BY run) total_anti_patterns_delta,
 CAST(lag(run) OVER (ORDER BY run) AS INTEGER) previous_run, CAST(row_number() OVER (ORDER BY run DESC) AS INTEGER) AS position FROM r""")
def h11(spark, d):
    return diff.history(score.severity_counts(Tables(spark, d).findings).select(*RUN, "total_anti_patterns")).drop("project_id")


@query("w1_analysis_numbers", "SELECT o_orderkey id, o_custkey project_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) analysis_number FROM orders")
def w1(spark, d):
    return model.number_runs(Tables(spark, d).jobs).select("id", "project_id", "analysis_number")


@query("w2_latest_job", "SELECT o_custkey project_id, o_orderkey id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) rn FROM orders) WHERE rn = 1")
def w2(spark, d):
    return model.latest(Tables(spark, d).jobs)


# -- line scans and scalar functions ------------------------------------------------


@query("p8_code_lines", f"WITH {LINES} SELECT service, count(*) n FROM src WHERE NOT regexp_matches(text, '^(//|\\*|/\\*|import |package )') GROUP BY 1")
def p8(spark, d):
    return scan.code_lines(Tables(spark, d).lines).groupBy("service").agg(F.count("*").alias("n"))


@query("w5_snippets", f"""WITH {LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY line_no) n FROM src), h AS (SELECT service, n FROM r WHERE text = 'int x = 1;')
SELECT h.service, CAST(h.n AS INTEGER) hit_line, CAST(min(r.n) AS INTEGER) start_line, CAST(max(r.n) AS INTEGER) end_line, string_agg(r.text, chr(10) ORDER BY r.n) snippet FROM h JOIN r ON r.service = h.service AND r.n BETWEEN h.n - 3 AND h.n + 3 GROUP BY 1, 2""")
def w5(spark, d):
    lines = Tables(spark, d).lines.withColumn("line_no", F.row_number().over(Window.partitionBy("service").orderBy("line_no")))
    return scan.snippets(lines.filter("text = 'int x = 1;'"), lines).drop("file")


@query("f_paths", f"""WITH {ENDPOINTS} SELECT part, path, CASE WHEN regexp_matches(path, '/v(\\d+)([/.]|$)') THEN concat('v', regexp_extract(path, '/v(\\d+)([/.]|$)', 1)) END AS version, CASE WHEN length(path) > 12 THEN concat(left(path, 12), '...') ELSE path END short FROM ep""")
def f_paths(spark, d):
    ep = Tables(spark, d).read("part").select(F.col("p_partkey").alias("part"), F.concat(F.lit("/api"), F.when((F.col("p_size") % 10 == 0) & (F.col("p_brand") != "Brand#11"), F.concat(F.lit("/v"), (1 + F.col("p_size") % 3).cast("string"))).otherwise(""), F.lit("/"), F.lower(F.replace("p_type", F.lit(" "), F.lit("/")))).alias("path"))
    return ep.select("part", t.normalize_path(F.col("path")).alias("path"), t.path_version(F.col("path")).alias("version"), t.truncate(F.col("path"), 12).alias("short"))


@query("f_service_names", """SELECT c_custkey k, lower(concat('svc-', c_nationkey)) host, CASE WHEN c_custkey % 3 = 0 THEN concat('localhost:', 8000 + c_nationkey) ELSE lower(concat('svc-', c_nationkey, '-service')) END service, CASE WHEN c_custkey % 3 = 0 THEN CAST(8000 + c_nationkey AS INTEGER) END port FROM customer""")
def f_names(spark, d):
    n, k = F.col("c_nationkey").cast("string"), F.col("c_custkey")
    url = F.when(k % 3 == 0, F.concat(F.lit("http://localhost:"), (8000 + F.col("c_nationkey")).cast("string"), F.lit("/a/b"))).otherwise(F.concat(F.lit("https://SVC-"), n, F.lit("-service/x")))
    return Tables(spark, d).read("customer").select(k.alias("k"), t.strip_suffix(t.normalize_service(F.concat(F.lit("http://SVC-"), n, F.lit("-service:80/q")))).alias("host"), t.service_of_url(url).alias("service"), t.port_of(url).alias("port"))


@query("f19_canonical_lists", "SELECT o_custkey k, string_agg(lower(o_orderpriority), ',' ORDER BY lower(o_orderpriority)) AS list FROM orders GROUP BY 1")
def f19(spark, d):
    each = Tables(spark, d).read("orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_list(F.concat(F.lit(" "), "o_orderpriority", F.lit("\t"))).alias("x"))
    return each.select("k", t.canonical_list(F.col("x")).alias("list"))


@query("j8_resolution", """WITH c AS (SELECT DISTINCT c_nationkey n, c_custkey % 4 m FROM customer) SELECT CAST(n AS INTEGER) n, CAST(m AS INTEGER) m, CAST(n AS BIGINT) target_id, CASE m WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END tier FROM c WHERE m < 3""")
def j8(spark, d):
    v = Tables(spark, d)
    services = v.services.select("project_id", "id", F.concat(F.lit("s"), F.lpad(F.col("id").cast("string"), 3, "0"), F.lit("-service")).alias("name"), F.lit(None).cast("string").alias("app_name"), (9000 + F.col("id")).cast("int").alias("port"))
    key = F.lpad(F.col("n").cast("string"), 3, "0")
    target = F.when(F.col("m") == 0, F.concat(F.lit("http://s"), key, F.lit("-service/x"))).when(F.col("m") == 1, F.concat(F.lit("localhost:"), (9000 + F.col("n")).cast("string"))).when(F.col("m") == 2, F.concat(F.lit("s"), key)).otherwise("nobody.example")
    calls = v.read("customer").select(F.col("c_nationkey").alias("n"), (F.col("c_custkey") % 4).cast("int").alias("m")).distinct().select(F.lit(1).cast("long").alias("project_id"), "n", "m", target.alias("target"))
    return model.resolve(calls, services).select("n", "m", "target_id", "tier")
