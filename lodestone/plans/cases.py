"""Harder lens views: class metrics, client types, block comments, findings with every kind of signature.

Each query returns the full row of the library's function, so that its SQL
says all of it anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import api
from ..functions import lines as scan
from ..functions import text as t
from ..operators import detectors, diff, graph, model, score
from ..operators.cohesion import tight_cohesion
from ..schema import RUN
from ..sources import files
from .lens import _BC, _LITERALS, _SCORE, DEPS, LINES, ORACLE_SQL, QUERIES, Tables, query  # noqa: F401  the registry is shared
from .shown import CLIENT, FIXED, GODS, PAIR


def _full(df: DataFrame, *more: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """A finding with its description, the details named in `more`, and its `columns`."""
    details = [F.col("details")[k].alias(k) for k in more]
    return df.select("pattern_type", "severity", F.col("primary_service").alias("service"), F.array_join("affected", ",").alias("affected"), "description", *details, *columns)


# -- god services -----------------------------------------------------------------

def classes(v: Tables) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    return v.run(v.read("part").select(
        F.col("p_brand").alias("service"), F.concat(F.lit("C"), k.cast("string")).alias("class"), size.alias("fields"), (k % 60).alias("public_methods"), (k * 37 % 2000).alias("lines_of_code"),
        (size % 30).alias("domains"), (k % 20).alias("ctor_params"), F.when(k % 11 == 0, -1.0).otherwise(k % 11 / 10).alias("tcc"), (k % 7 == 0).alias("is_data_class"),
    ))


@query("k4_god_service", GODS)
def k4(spark, d):
    v = Tables(spark, d)
    return _full(detectors.god(detectors.Model(v.services, v.deps, classes=classes(v))), "classes")


_METHODS = """m AS (SELECT c_nationkey service, c_custkey % 5 class, c_custkey method, CASE WHEN c_custkey % 11 = 0 THEN [] ELSE [c_custkey % 13, c_custkey % 17] END fields FROM customer)"""


@query("a16_tight_cohesion", f"""WITH {_METHODS}, p AS (SELECT a.service, a.class, len(list_intersect(a.fields, b.fields)) > 0 near FROM m a JOIN m b ON a.service = b.service AND a.class = b.class AND a.method < b.method),
n AS (SELECT service, class, count(*) n FROM m GROUP BY 1, 2)
SELECT CAST(n.service AS VARCHAR) service, CAST(n.class AS VARCHAR) AS class, round(CASE WHEN n < 2 THEN -1.0 ELSE (SELECT count(*) FILTER (WHERE near) * 1.0 / count(*) FROM p WHERE p.service = n.service AND p.class = n.class) END, 6) tcc FROM n""")
def a16(spark, d):
    v = Tables(spark, d)
    k = F.col("c_custkey")
    held = v.read("customer").select(F.col("c_nationkey").cast("string").alias("service"), (k % 5).cast("string").alias("class"), k.cast("string").alias("method"), F.when(k % 11 == 0, F.array().cast("array<int>")).otherwise(F.array(k % 13, k % 17)).alias("fields"))
    return tight_cohesion(v.run(held), [*RUN, "service", "class"]).select("service", "class", F.round("tcc", 6).alias("tcc"))


# -- chatty clients of services that no dependency has flagged ------------------------

_CLIENTS = "cl AS (SELECT n_name service, concat('T', c_custkey % 3) AS type, count(*) * 7 calls FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2)"


@query("k5_chatty_clients", f"""WITH {DEPS}, {_CLIENTS}, r AS (SELECT a.n_name source, b.n_name target, cc FROM deps JOIN nation a ON a.n_nationkey = s JOIN nation b ON b.n_nationkey = t WHERE cc >= 125)
SELECT 'CHATTY_SERVICE' pattern_type, 'HIGH' severity, source service, concat(source, ',', target) affected, {PAIR} description, 'dependency' AS type, CAST(cc AS INTEGER) call_count FROM r
UNION ALL SELECT 'CHATTY_SERVICE', 'HIGH', service, service, {CLIENT}, type, CAST(calls AS INTEGER) FROM cl WHERE calls >= 125 AND service NOT IN (SELECT source FROM r)""")
def k5b(spark, d):
    v = Tables(spark, d)
    held = v.read("customer").join(v.read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    clients = held.groupBy(F.col("n_name").alias("service"), F.concat(F.lit("T"), (F.col("c_custkey") % 3).cast("string")).alias("type")).agg((F.count("*") * 7).alias("calls"))
    found = detectors.chatty(detectors.Model(v.services, v.deps, clients=v.run(clients)), {"chatty_min_calls": 125})
    return _full(found, "type", columns=("call_count",))


# -- lines: block comments, every kind of line, lines of code ---------------------------

_BLOCKS = """src AS (SELECT concat('svc', c_nationkey) service, c_custkey line_no, CASE c_custkey % 11 WHEN 0 THEN '/* one' WHEN 3 THEN '  two */ x();' WHEN 5 THEN '/** all on one line */ y();' WHEN 6 THEN '// */ z();'
 WHEN 7 THEN 'import a.b;' WHEN 8 THEN ' package a;' WHEN 9 THEN '* star' ELSE concat('call(', c_custkey, ');') END AS text FROM customer)"""


def block_lines(v: Tables) -> DataFrame:
    k = F.col("c_custkey")
    text = F.when(k % 11 == 0, "/* one").when(k % 11 == 3, "  two */ x();").when(k % 11 == 5, "/** all on one line */ y();").when(k % 11 == 6, "// */ z();").when(k % 11 == 7, "import a.b;").when(k % 11 == 8, " package a;").when(k % 11 == 9, "* star")
    made = text.otherwise(F.concat(F.lit("call("), k.cast("string"), F.lit(");")))
    return v.read("customer").select(F.concat(F.lit("svc"), F.col("c_nationkey").cast("string")).alias("service"), F.lit("Main.java").alias("file"), k.cast("int").alias("line_no"), made.alias("text"))


@query("p8_block_comments", f"""WITH {_BLOCKS}, e AS (SELECT *, trim(text) s, CASE WHEN text LIKE '%*/%' THEN 0 WHEN trim(text) LIKE '/*%' THEN 1 END ev FROM src),
w AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY service ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) inside FROM e)
SELECT service, CAST(line_no AS INTEGER) line_no, text FROM w WHERE inside = 0 AND NOT regexp_matches(s, '^(//|\\*|/\\*|import |package )')""")
def p8b(spark, d):
    return scan.code_lines(block_lines(Tables(spark, d))).select("service", "line_no", "text")


@query("p7_entry_points", f"""WITH {_BLOCKS}, m AS (SELECT c_nationkey % 4 k, concat('svc', c_nationkey) service FROM customer GROUP BY 1, 2)
SELECT service, k = 0 framework, k <= 1 main FROM m WHERE k <= 1""")
def p7(spark, d):
    """Services 0, 4, … start a framework, 1, 5, … have a plain main method, 2, 6, … only say so in comments."""
    k = F.col("c_nationkey") % 4
    held = Tables(spark, d).read("customer").select("c_nationkey").distinct()
    said = F.when(k == 0, F.array(F.lit("@SpringBootApplication"), F.lit("class A { public static void main(String[] a) {} }"))).when(k == 1, F.array(F.lit("/* @QuarkusMain"), F.lit("*/"), F.lit("public  static void main ("))).when(k == 2, F.array(F.lit("// @SpringBootApplication"), F.lit("/* public static void main("), F.lit("public static void main( */")))
    each = held.select(F.concat(F.lit("svc"), F.col("c_nationkey").cast("string")).alias("service"), F.lit("A.java").alias("file"), F.posexplode(said.otherwise(F.array(F.lit("x")))).alias("line_no", "text"))
    return scan.entry_points(each)


@query("x12_main_class", "SELECT concat('svc', c_nationkey) service, coalesce(min(concat('f', c_custkey)) FILTER (WHERE c_custkey % 40 = 3), min(concat('f', c_custkey))) file FROM customer GROUP BY 1")
def x12(spark, d):
    k = F.col("c_custkey")
    held = Tables(spark, d).read("customer").select(F.concat(F.lit("svc"), F.col("c_nationkey").cast("string")).alias("service"), F.concat(F.lit("f"), k.cast("string")).alias("file"), F.when(k % 40 == 3, "public static void main(").otherwise("x").alias("text"))
    return scan.main_class(held)


@query("s18_lines_of_code", r"""WITH t AS (SELECT source service, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) x FROM documents WHERE text <> '')
SELECT service, CAST(sum(len(string_split(CASE WHEN x LIKE '%' || chr(10) THEN left(x, len(x) - 1) ELSE x END, chr(10)))) AS BIGINT) lines_of_code FROM t GROUP BY 1""")
def s18(spark, d):
    """Documents as files of the services that their sources are."""
    v = Tables(spark, d)
    texts = v.read("documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "text")
    services = v.read("documents").select(F.col("source").alias("dir"), F.col("source").alias("service")).distinct()
    return scan.line_counts(files.of_services(files.source_lines(texts), services))


@query("k6_hardcoded_urls", f"WITH {LINES}, {_LITERALS} SELECT 'HARDCODED_ENDPOINTS' pattern_type, 'MEDIUM' severity, service, service affected, {FIXED} description, string_agg(url, ',' ORDER BY line_no, pos) urls FROM u WHERE url <> '' GROUP BY 3")
def k6(spark, d):
    v = Tables(spark, d)
    return _full(detectors.hardcoded(detectors.Model(v.services, v.deps, lines=v.run(v.lines))), "urls")


# -- graph and score, in full -------------------------------------------------------------


@query("k10_esb_affected", f"""{_BC}, x AS (SELECT id, name, (in_degree + out_degree) / CAST(n_rows AS DOUBLE) mediator FROM bc JOIN deg USING (id)
WHERE n_rows > 0 AND ((in_degree / 24.0 >= 0.05 AND out_degree / 24.0 >= 0.05) OR (in_degree + out_degree) / CAST(n_rows AS DOUBLE) >= 0.05 OR bc_norm >= 0.05)),
o AS (SELECT id, n_name other, 1 side FROM x JOIN e ON e.t = id JOIN nation ON n_nationkey = s UNION ALL SELECT id, n_name, 2 FROM x JOIN e ON e.s = id JOIN nation ON n_nationkey = t),
a AS (SELECT id, other, min(side) side FROM o GROUP BY 1, 2)
SELECT 'ESB_MISUSE' pattern_type, 'HIGH' severity, name service, concat(name, ',', (SELECT string_agg(other, ',' ORDER BY side, other) FROM a WHERE a.id = x.id)) affected,
 (SELECT CAST(count(DISTINCT s) AS VARCHAR) FROM e WHERE e.t = x.id) callers, (SELECT CAST(count(DISTINCT t) AS VARCHAR) FROM e WHERE e.s = x.id) callees FROM x""")
def k10(spark, d):
    v = Tables(spark, d)
    return _full(detectors.esb(detectors.Model(v.services, v.deps), {"esb_mediator": 0.05}), "callers", "callees").drop("description")


@query("j10_edge_evidence", f"WITH {DEPS} SELECT CAST(s AS BIGINT) s, CAST(t AS BIGINT) t, concat('f', s, '.java') evidence_file, 'call()' evidence_code, CAST(cc AS INTEGER) call_count FROM deps")
def j10(spark, d):
    return graph.evidence(Tables(spark, d).deps).select("s", "t", "evidence_file", "evidence_code", "call_count")


@query("g7_most_called", f"WITH {DEPS} SELECT CAST(t AS BIGINT) id, count(*) calls, CAST(row_number() OVER (ORDER BY count(*) DESC, t) AS INTEGER) AS rank FROM deps GROUP BY t")
def g7(spark, d):
    return graph.most_called(Tables(spark, d).deps).select("id", "calls", "rank")


def _supplier_edges(modulus: int) -> str:
    return f"""e AS (SELECT DISTINCT a.l_suppkey s, b.l_suppkey t FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
 WHERE (a.l_suppkey * 7 + b.l_suppkey * 3) % {modulus} = 0 AND a.l_suppkey <> b.l_suppkey)"""


def supplier_edges(v: Tables, modulus: int) -> DataFrame:
    """Suppliers of consecutive lines of an order as callers and called, for some of the pairs."""
    line = v.read("lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").cast("long").alias("source_service_id"))
    next_ = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("source_service_id").alias("target_service_id"))
    pairs = line.join(next_, ["l_orderkey", "l_linenumber"]).select("source_service_id", "target_service_id").distinct()
    return v.run(pairs.filter((F.col("source_service_id") * 7 + F.col("target_service_id") * 3) % modulus == 0))


@query("g2_supplier_groups", f"""WITH RECURSIVE {_supplier_edges(73)}, r(s, t) AS (SELECT s, t FROM e UNION SELECT r.s, e.t FROM r JOIN e ON r.t = e.s),
c AS (SELECT a.s id, min(a.t) component FROM r a JOIN r b ON a.s = b.t AND a.t = b.s GROUP BY 1)
SELECT CAST(component AS BIGINT) component, CAST(id AS BIGINT) id FROM c WHERE component IN (SELECT component FROM c GROUP BY 1 HAVING count(*) > 1)""")
def g2b(spark, d):
    """Cycle groups by rounds of joins, whatever the size of the graph."""
    return graph.scc(supplier_edges(Tables(spark, d), 73), small=0).select("component", "id")


@query("g3_supplier_paths", f"""WITH RECURSIVE {_supplier_edges(41)},
w AS (SELECT 1 d, s, t, CAST(1 AS DOUBLE) sg FROM e UNION ALL SELECT d + 1, w.s, e.t, sum(sg) FROM w JOIN e ON w.t = e.s WHERE d < 24 GROUP BY d, w.s, e.t),
sp AS (SELECT s, t, d, sg FROM (SELECT *, row_number() OVER (PARTITION BY s, t ORDER BY d) rn FROM w WHERE s <> t) WHERE rn = 1),
b AS (SELECT a.t v, sum(a.sg * b.sg / p.sg) bc FROM sp a JOIN sp b ON a.t = b.s JOIN sp p ON p.s = a.s AND p.t = b.t AND p.d = a.d + b.d WHERE a.s <> b.t GROUP BY 1)
SELECT s_suppkey id, round(coalesce(bc, 0), 4) bc, round(coalesce(bc, 0) / ((SELECT count(*) FROM supplier) - 1) / ((SELECT count(*) FROM supplier) - 2), 8) bc_norm FROM supplier LEFT JOIN b ON v = s_suppkey""")
def g3b(spark, d):
    """Betweenness by parts and blocks of sources, whatever the size of the graph."""
    v = Tables(spark, d)
    services = v.run(v.read("supplier").select(F.col("s_suppkey").cast("long").alias("id")))
    found = graph.betweenness(services, supplier_edges(v, 41), small=0)
    return found.select("id", F.round("bc", 4).alias("bc"), F.round("bc_norm", 8).alias("bc_norm"))


@query("h6_deductions", f"""{_SCORE}, k AS (SELECT project, kind reason, count(*) n, sum(CASE severity WHEN 'CRITICAL' THEN 8 WHEN 'HIGH' THEN 5 WHEN 'MEDIUM' THEN 3 ELSE 1 END) points FROM f WHERE kind NOT IN ('NANO_SERVICE', 'GOD_SERVICE') GROUP BY 1, 2),
m AS (SELECT project, reason, n, points FROM k
 UNION ALL SELECT project, 'SMELL_DENSITY', smells, least(20, floor(20 * (smells / (loc / 1000.0)) / 80 + 0.5)) FROM r WHERE smells > 0
 UNION ALL SELECT project, 'COUPLING', 1, least(15, floor(15 * coupling + 0.5)) FROM r WHERE coupling > 0.1
 UNION ALL SELECT project, 'CYCLES', cycles, least(10, 5 * cycles) FROM r WHERE cycles > 0
 UNION ALL SELECT project, 'NANO_SERVICE', nano, least(8, 3 * nano) FROM r WHERE nano > 0)
SELECT project project_id, reason, CAST(n AS BIGINT) AS count, CAST(points AS BIGINT) points FROM m WHERE points > 0""")
def h6(spark, d):
    """The itemised deductions of each project's score."""
    i = F.col("event_id") % 4
    severity = F.when(i == 0, "CRITICAL").when(i == 1, "HIGH").when(i == 2, "MEDIUM").otherwise("LOW")
    kind = F.when(F.col("event_type") == "click", "NANO_SERVICE").otherwise(F.upper("event_type"))
    found = Tables(spark, d).read("events").select(F.col("user_id").alias("project_id"), F.lit(1).alias("analysis_number"), kind.alias("pattern_type"), severity.alias("severity"))
    n = F.col("project_id")
    runs = found.select(*RUN).distinct().withColumns({"smells": n % 50 * 7, "loc": 1000 + n * 100, "coupling": (n % 9) / 10, "cycles": n % 4})
    return score.score(runs, found).select("project_id", F.inline("deductions").alias("reason", "count", "points"))


# -- comparison of runs through the library's own keys and sentences -------------------------

_ISSUES = """e AS (SELECT dense_rank() OVER (ORDER BY CAST(ts AS DATE)) run, event_id, user_id, event_type FROM events),
i AS (SELECT run, event_id, user_id % 3 sev, concat(kind, '|primary=svc ', user_id % 6, '|affected=a', user_id % 3, ',b', '|signature=', CASE kind WHEN 'HARDCODED_ENDPOINTS' THEN concat('http://h', user_id % 2, ',http://z') WHEN 'GOD_SERVICE' THEN concat('a', user_id % 2, ',zed')
 WHEN 'SHARED_DATABASE' THEN concat('jdbc:x', user_id % 2) WHEN 'CHATTY_SERVICE' THEN 'rest_template' WHEN 'CYCLIC_DEPENDENCY' THEN CAST(2 + user_id % 2 AS VARCHAR) ELSE '' END) k
 FROM (SELECT *, CASE event_type WHEN 'click' THEN 'HARDCODED_ENDPOINTS' WHEN 'view' THEN 'GOD_SERVICE' WHEN 'error' THEN 'SHARED_DATABASE' WHEN 'signup' THEN CASE WHEN user_id % 2 = 0 THEN 'CHATTY_SERVICE' ELSE 'NANO_SERVICE' END ELSE 'CYCLIC_DEPENDENCY' END kind FROM e))"""
_TALLY = f"""WITH {_ISSUES}, c AS (SELECT run, k, count(*) n FROM i GROUP BY 1, 2), l AS (SELECT run, lag(run) OVER (ORDER BY run) prev FROM (SELECT DISTINCT run FROM i)),
d AS (SELECT run, k, sum(n) n, sum(m) m FROM (SELECT c.run, k, n, 0 m FROM c JOIN l USING (run) WHERE prev IS NOT NULL UNION ALL SELECT l.run, k, 0, n FROM l JOIN c ON c.run = l.prev) GROUP BY 1, 2)"""


def issues(v: Tables) -> DataFrame:
    """Findings with affected services and all kinds of details, spelt in ways that keys must not depend on."""
    u = F.col("user_id")
    n = lambda k: (u % k).cast("string")
    e = F.col("event_type")
    kind = F.when(e == "click", "HARDCODED_ENDPOINTS").when(e == "view", "GOD_SERVICE").when(e == "error", "SHARED_DATABASE").when(e == "signup", F.when(u % 2 == 0, "CHATTY_SERVICE").otherwise("NANO_SERVICE")).otherwise("CYCLIC_DEPENDENCY")
    details = F.create_map(F.lit("urls"), F.concat(F.lit(" HTTP://Z ,,http://h"), n(2), F.lit(" ")), F.lit("classes"), F.concat(F.lit("Zed, a"), n(2)), F.lit("type"), F.lit("REST_TEMPLATE"))
    runs = v.findings.select("analysis_number", F.col("finding_ord").alias("event_id"))
    return v.read("events").join(runs, "event_id").select(
        F.lit(1).cast("long").alias("project_id"), "analysis_number", F.col("event_id").alias("finding_ord"), kind.alias("pattern_type"), F.element_at(F.array(F.lit("HIGH"), F.lit("MEDIUM"), F.lit("LOW")), (u % 3 + 1).cast("int")).alias("severity"),
        F.concat(F.lit(" SVC "), n(6), F.lit("\t")).alias("primary_service"), F.array(F.lit("B "), F.concat(F.lit("a"), n(3)), F.lit(" ")).alias("affected"), details.alias("details"), (2 + u % 2).cast("int").alias("cycle_length"), F.concat(F.lit("JDBC:x"), n(2)).alias("shared_database_url"),
    )


@query("f20_issue_keys", f"WITH {_ISSUES} SELECT event_id finding_ord, k AS key FROM i")
def f20(spark, d):
    return issues(Tables(spark, d)).select("finding_ord", diff.issue_key().alias("key"))


@query("j15_issue_diff", f"{_TALLY} SELECT CAST(run AS INTEGER) analysis_number, k AS key, CAST(least(n, m) AS BIGINT) n_unchanged, CAST(greatest(n - m, 0) AS BIGINT) n_new, CAST(greatest(m - n, 0) AS BIGINT) n_resolved FROM d")
def j15(spark, d):
    found = issues(Tables(spark, d)).withColumn("key", diff.issue_key())
    return diff.multiset(found, diff.previous(found.select(*RUN).distinct())).drop("project_id")


@query("h10_compared_runs", f"""{_TALLY}, s AS (SELECT run, sum(least(n, m)) u, sum(greatest(n - m, 0)) new, sum(greatest(m - n, 0)) resolved FROM d GROUP BY 1),
r AS (SELECT run, count(*) total, 100 - count(*) % 97 score, count(*) FILTER (WHERE sev = 0) high FROM i GROUP BY 1), h AS (SELECT *, lag(run) OVER (ORDER BY run) prev, score - lag(score) OVER (ORDER BY run) ds, high - lag(high) OVER (ORDER BY run) dh FROM r)
SELECT CAST(h.run AS INTEGER) analysis_number, CAST(score AS BIGINT) health_score, CAST(ds AS BIGINT) health_score_delta, CAST(dh AS BIGINT) high_issues_delta, CAST(prev AS INTEGER) previous_run, CAST(coalesce(u, 0) AS BIGINT) n_unchanged, CAST(coalesce(new, 0) AS BIGINT) n_new, CAST(coalesce(resolved, 0) AS BIGINT) n_resolved,
 CASE WHEN prev IS NOT NULL THEN concat(CASE WHEN ds > 0 THEN concat('Score improved by ', ds) WHEN ds < 0 THEN concat('Score declined by ', -ds) ELSE 'Score unchanged' END, CASE WHEN resolved > 0 THEN concat('; ', resolved, ' resolved') ELSE '' END, CASE WHEN new > 0 THEN concat('; ', new, ' new') ELSE '' END) END summary
FROM h LEFT JOIN s ON s.run = h.run""")
def h10(spark, d):
    """Runs compared by the API: counts of findings by their keys, changes, and a sentence."""
    found = issues(Tables(spark, d))
    results = score.severity_counts(found).withColumn("health_score", 100 - F.col("total_anti_patterns") % 97).select(*RUN, "health_score", "high_issues")
    return api.compare(found, results).select("analysis_number", "health_score", "health_score_delta", "high_issues_delta", "previous_run", "n_unchanged", "n_new", "n_resolved", "summary")


@query("u4_matched_issues", f"""{_TALLY}, x AS (SELECT run, k, event_id, row_number() OVER (PARTITION BY run, k ORDER BY event_id) rn FROM i), now AS (SELECT x.* FROM x JOIN l USING (run) WHERE prev IS NOT NULL), old AS (SELECT l.run, k, event_id, rn FROM l JOIN x ON x.run = l.prev)
SELECT CAST(coalesce(a.run, b.run) AS INTEGER) analysis_number, CASE WHEN a.event_id IS NULL THEN 'resolved' WHEN b.event_id IS NULL THEN 'new' ELSE 'unchanged' END state, a.event_id AS current, b.event_id AS former
FROM now a FULL JOIN old b ON a.run = b.run AND a.k = b.k AND a.rn = b.rn""")
def u4(spark, d):
    found = issues(Tables(spark, d)).withColumn("key", diff.issue_key())
    return diff.matched(found, diff.previous(found.select(*RUN).distinct())).select("analysis_number", "state", "current", "former")


@query("j14_previous_run", """WITH n AS (SELECT o_custkey project_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) run FROM orders)
SELECT project_id, CAST(run AS INTEGER) analysis_number, CAST(lag(run) OVER (PARTITION BY project_id ORDER BY run) AS INTEGER) previous_run FROM n""")
def j14(spark, d):
    return diff.previous(model.number_runs(Tables(spark, d).jobs)).select("project_id", "analysis_number", "previous_run")


# -- scalar functions that no other query reaches ------------------------------------------------

_URLS = "[concat('https://gitlab.example/a/r', c_custkey, '.git//'), concat('http://github.com/x/y', c_custkey, '/'), concat('https://host/z', c_custkey, '.git')]"


@query("s6_repositories", f"SELECT c_custkey k, concat(['r', 'y', 'z'][c_custkey % 3 + 1], c_custkey) AS name, CASE c_custkey % 3 WHEN 0 THEN 'GITLAB' ELSE 'GITHUB' END AS host FROM customer")
def s6(spark, d):
    k = F.col("c_custkey")
    n = k.cast("string")
    url = F.when(k % 3 == 0, F.concat(F.lit("https://gitlab.example/a/r"), n, F.lit(".git//"))).when(k % 3 == 1, F.concat(F.lit("http://github.com/x/y"), n, F.lit("/"))).otherwise(F.concat(F.lit("https://host/z"), n, F.lit(".git")))
    return Tables(spark, d).read("customer").select(k.alias("k"), t.repository_name(url).alias("name"), t.source_type(url).alias("host"))


@query("f3_placeholders", """SELECT c_custkey k, CASE c_custkey % 5 WHEN 0 THEN concat('v', c_custkey) WHEN 1 THEN 'dflt' WHEN 2 THEN 'http://own/${x}' WHEN 3 THEN NULL ELSE 'a-b-' END resolved, CASE c_custkey % 5 WHEN 2 THEN 'x' WHEN 4 THEN 'p' ELSE 'key.a' END AS key,
 CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'dflt' WHEN 2 THEN 'http://own/' WHEN 3 THEN '' ELSE 'one-' END AS defaults FROM customer""")
def f3(spark, d):
    k = F.col("c_custkey")
    said = F.when(k % 5 == 0, "${key.a}").when(k % 5 == 1, "${key.a:dflt}").when(k % 5 == 2, "http://own/${x}").when(k % 5 == 3, "${key.a}").otherwise("${p:one}-${q}")
    value = F.when(k % 5 == 0, F.concat(F.lit("v"), k.cast("string"))).when(k % 5 == 4, "a-${z:b}-${none}")
    return Tables(spark, d).read("customer").select(k.alias("k"), t.resolve_placeholder(said, value).alias("resolved"), t.placeholder_key(said).alias("key"), t.resolve_defaults(said).alias("defaults"))


@query("f5_database_names", "SELECT c_custkey k, CASE c_custkey % 3 WHEN 0 THEN concat('db', c_custkey) WHEN 1 THEN concat('shop', c_nationkey) END AS name FROM customer")
def f5(spark, d):
    k = F.col("c_custkey")
    url = F.when(k % 3 == 0, F.concat(F.lit("jdbc:postgresql://h:5432/db"), k.cast("string"), F.lit("?ssl=true"))).when(k % 3 == 1, F.concat(F.lit("mongodb://h/shop"), F.col("c_nationkey").cast("string"))).otherwise("jdbc:h2:mem:x")
    return Tables(spark, d).read("customer").select(k.alias("k"), t.database_name(url).alias("name"))


@query("f11_annotations", """SELECT c_custkey k, CASE c_custkey % 6 WHEN 0 THEN 'header' WHEN 1 THEN 'header' WHEN 2 THEN 'query' END AS version, CASE c_custkey % 6 WHEN 3 THEN 'POST' WHEN 4 THEN 'DELETE' ELSE 'GET' END AS method FROM customer""")
def f11(spark, d):
    k = F.col("c_custkey") % 6
    said = F.when(k == 0, '@GetMapping(value = "/a", headers = "X-API-VERSION=1")').when(k == 1, '@GetMapping(produces = "application/vnd.shop.v2+json")').when(k == 2, '@GetMapping(params = "version=3")').when(k == 3, "@RequestMapping(method = {RequestMethod.PUT, RequestMethod.POST})").when(k == 4, "@RequestMapping(method = RequestMethod.DELETE)").otherwise('@GetMapping("/v1/version=2")')
    return Tables(spark, d).read("customer").select(F.col("c_custkey").alias("k"), t.annotation_version(said).alias("version"), t.http_method(said).alias("method"))


@query("f17_class_files", "SELECT c_custkey k, concat('com/shop/C', c_custkey, '.java') file, 'com.shop' AS domain, concat('a/b', c_custkey) AS path FROM customer")
def f17(spark, d):
    n = F.col("c_custkey").cast("string")
    name = F.concat(F.lit("com.shop.C"), n)
    return Tables(spark, d).read("customer").select(F.col("c_custkey").alias("k"), t.class_file(name).alias("file"), t.import_domain(name).alias("domain"), t.forward_slashes(F.concat(F.lit("a\\b"), n)).alias("path"))


@query("p15_gateways", "SELECT c_custkey k, c_custkey % 5 IN (0, 2) AS gateway FROM customer")
def p15(spark, d):
    k = F.col("c_custkey")
    name = F.element_at(F.array(*[F.lit(x) for x in ["Api-Gateway", "orders", "my-ZUUL-x", "users", "payment"]]), (k % 5 + 1).cast("int"))
    return Tables(spark, d).read("customer").select(k.alias("k"), t.is_gateway(name).alias("gateway"))


@query("p1_excluded_names", "SELECT c_custkey k, c_custkey % 6 IN (0, 1, 2, 4) AS excluded FROM customer")
def p1(spark, d):
    k = F.col("c_custkey")
    name = F.element_at(F.array(*[F.lit(x) for x in ["Examples", "order-test", "shop.docs", "orders", "module-info-x", "contest"]]), (k % 6 + 1).cast("int"))
    return Tables(spark, d).read("customer").select(k.alias("k"), model.excluded_name(name).alias("excluded"))


@query("j9_aliases", """WITH s AS (SELECT c_custkey id, concat('Svc', c_custkey % 50) AS name, CASE WHEN c_custkey % 3 = 0 THEN concat('app', c_custkey % 40) WHEN c_custkey % 3 = 1 THEN concat('svc', c_custkey % 7) END app FROM customer),
a AS (SELECT lower(name) AS alias, id, 0 p, -id o FROM s UNION ALL SELECT lower(app), id, 1, id FROM s WHERE app IS NOT NULL)
SELECT alias, id FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY p, o) rn FROM a) WHERE rn = 1""")
def j9(spark, d):
    k = F.col("c_custkey")
    app = F.when(k % 3 == 0, F.concat(F.lit("app"), (k % 40).cast("string"))).when(k % 3 == 1, F.concat(F.lit("svc"), (k % 7).cast("string")))
    held = Tables(spark, d).read("customer").select(F.lit(1).cast("long").alias("project_id"), k.alias("id"), F.concat(F.lit("Svc"), (k % 50).cast("string")).alias("name"), app.alias("app_name"))
    return model.aliases(held).select("alias", "id")


@query("j8_similar_names", """WITH s AS (SELECT s_suppkey id, s_suppkey % 3 project, concat(['ring', 'widget', 'all-r', 'green-service', '-api', 'x-svc'][s_suppkey % 6 + 1], CASE WHEN s_suppkey % 4 < 2 THEN concat('-', s_suppkey % 31) ELSE '' END,
 CASE WHEN s_suppkey % 5 = 0 THEN '-service' ELSE '' END) AS name FROM supplier),
a AS (SELECT project, name AS alias, regexp_replace(name, '-(service|svc|ms|api|server|app)$', '') bare, max(id) id FROM s GROUP BY 1, 2),
t AS (SELECT DISTINCT p_size % 3 project, CASE WHEN p_partkey % 9 = 0 THEN left(p_name, 1 + p_partkey % 4) ELSE concat(replace(p_name, ' ', '-'), '-', p_partkey % 50) END target FROM part),
h AS (SELECT t.project, target, id, alias, CASE WHEN alias = target THEN 1 ELSE 3 END tier FROM t JOIN a ON a.project = t.project AND (alias = target OR contains(target, alias) OR contains(alias, target) OR contains(target, bare)))
SELECT CAST(project AS BIGINT) project_id, target, CAST(id AS BIGINT) target_id, CAST(tier AS INTEGER) tier FROM (SELECT *, row_number() OVER (PARTITION BY project, target ORDER BY tier, alias, id) rn FROM h) WHERE rn = 1""")
def j8b(spark, d):
    """Targets and services of three projects with names that are parts of each other."""
    v = Tables(spark, d)
    k = F.col("s_suppkey")
    word = F.element_at(F.array(*[F.lit(x) for x in ["ring", "widget", "all-r", "green-service", "-api", "x-svc"]]), (k % 6 + 1).cast("int"))
    number = F.when(k % 4 < 2, F.concat(F.lit("-"), (k % 31).cast("string"))).otherwise("")
    name = F.concat(word, number, F.when(k % 5 == 0, "-service").otherwise(""))
    none = F.lit(None)
    services = v.read("supplier").select((k % 3).cast("long").alias("project_id"), k.cast("long").alias("id"), name.alias("name"), none.cast("string").alias("app_name"), none.cast("int").alias("port"))
    p = F.col("p_partkey")
    target = F.when(p % 9 == 0, F.left("p_name", (1 + p % 4).cast("int"))).otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), (p % 50).cast("string")))
    calls = v.read("part").select((F.col("p_size") % 3).cast("long").alias("project_id"), target.alias("target")).distinct()
    return model.resolve(calls, services).select("project_id", "target", "target_id", "tier")


@query("a12_call_evidence", """WITH c AS (SELECT c_nationkey source_id, c_custkey % 4 target_id, c_custkey ord FROM customer)
SELECT CAST(source_id AS BIGINT) source_id, CAST(target_id AS BIGINT) target_id, CAST(count(*) AS INTEGER) call_count, concat('F', min(ord)) AS file FROM c WHERE source_id <> target_id GROUP BY 1, 2""")
def a12(spark, d):
    """Calls to services 0 to 3, grouped by raw target, with the evidence of the first; calls of a service to itself go."""
    k = F.col("c_custkey")
    v = Tables(spark, d)
    services = v.services.select("project_id", "id", F.concat(F.lit("s"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("name"), F.lit(None).cast("string").alias("app_name"), F.lit(None).cast("int").alias("port"))
    target = F.concat(F.lit("http://s"), F.lpad((k % 4).cast("string"), 3, "0"), F.lit("/x"))
    calls = v.read("customer").select(F.lit(1).cast("long").alias("project_id"), F.col("c_nationkey").cast("long").alias("source_id"), target.alias("target"), k.alias("ord"), F.lit("FEIGN_CLIENT").alias("dependency_type"), F.concat(F.lit("F"), k.cast("string")).alias("file"), k.alias("line"), F.lit("x").alias("code"))
    return model.dependencies(calls, services).select("source_id", "target_id", "call_count", "file")


@query("h12_gate", f"{_SCORE} SELECT project project_id, CAST(a + q + y + z AS INTEGER) health_score FROM s WHERE a + q + y + z < 40")
def h12(spark, d):
    return score.gate(QUERIES["h5_health_score"](spark, d), 40).select("project_id", "health_score")
