"""Sentences and code of findings, over lens views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import detectors, evidence
from .lens import _BC, _LITERALS, ENDPOINTS, LINES, SERVICES, Tables, query


def _percent(x: str) -> str:
    """Whole per cent, halves upwards."""
    return f"CAST(floor(100 * ({x}) + 0.5) AS INTEGER)"


_HUBS = """n_rows > 0 AND ((in_degree / 24.0 >= 0.05 AND out_degree / 24.0 >= 0.05) OR (in_degree + out_degree) / CAST(n_rows AS DOUBLE) >= 0.05 OR bc_norm >= 0.05)"""
_SAID = f"""{_BC}, {SERVICES}, r(s, t) AS (SELECT s, t FROM deps UNION SELECT r.s, deps.t FROM r JOIN deps ON r.t = deps.s),
c AS (SELECT a.s id, min(a.t) comp FROM r a JOIN r b ON a.s = b.t AND a.t = b.s GROUP BY 1),
ring AS (SELECT string_agg(n_name, ' -> ' ORDER BY n_name) x, min(n_name) AS first FROM c JOIN nation ON n_nationkey = id GROUP BY comp HAVING count(*) > 1),
t AS (SELECT (SELECT count(*) FROM e) n_edges, (SELECT count(*) FROM (SELECT s FROM e UNION SELECT t FROM e)) linked, (SELECT count(*) FROM (SELECT url FROM services GROUP BY 1 HAVING count(*) > 1)) shared)
SELECT 'CYCLIC_DEPENDENCY' pattern_type, ring.first service, concat('Cyclic dependency detected: ', x, ' -> ', ring.first) description FROM ring
UNION ALL SELECT 'SHARED_DATABASE', min(name), concat('Multiple services share the same database: ', url) FROM services GROUP BY url HAVING count(*) > 1
UNION ALL SELECT 'NANO_SERVICE', name, concat('Service ''', name, ''' is too small (', loc, ' LOC, ', ep, ' endpoints) to justify operational overhead') FROM services WHERE loc < 2000 AND ep <= 3
UNION ALL SELECT 'WRONG_CUTS', a.n_name, concat('Bidirectional dependency between ''', a.n_name, ''' and ''', b.n_name, '''. Mutual dependencies suggest these services are too tightly coupled and may have been incorrectly split.')
 FROM deps x JOIN deps y ON x.s = y.t AND x.t = y.s AND x.s < x.t JOIN nation a ON a.n_nationkey = x.s JOIN nation b ON b.n_nationkey = x.t
UNION ALL SELECT 'ESB_MISUSE', name, concat('Service ''', name, ''' acts as a central mediator (ESB-like hub). It is called by ', in_degree, ' service(s) (', {_percent("in_degree / 24.0")}, '%) and calls ', out_degree, ' service(s) (',
 {_percent("out_degree / 24.0")}, '%), handling ', in_degree + out_degree, ' of ', n_rows, ' total dependencies. Betweenness centrality: ', printf('%.2f', floor(100 * CAST(bc_norm AS DOUBLE) + 0.5) / 100),
 '. This creates a single point of failure and bottleneck.') FROM bc JOIN deg USING (id) WHERE {_HUBS}
UNION ALL SELECT 'DISTRIBUTED_MONOLITH', NULL, concat('The system exhibits distributed monolith characteristics. Coupling coefficient: ', printf('%.2f', CAST(floor(n_edges / 6.0 + 0.5) / 100 AS DOUBLE)), ' (', n_edges, '/600 possible edges), ',
 {_percent("linked / 25.0")}, '% of services are interconnected, ', shared, ' shared database(s) detected. Services are tightly coupled and likely need coordinated deployments.') FROM t WHERE n_edges / 600.0 > 0.03""".replace("WITH ", "WITH RECURSIVE ", 1)


@query("f21_sentences", _SAID)
def f21(spark, d):
    """The sentences of six detectors' findings."""
    v = Tables(spark, d)
    m = detectors.Model(v.services, v.deps)
    config = {"nano_max_loc": 2000, "nano_max_endpoints": 3, "esb_mediator": 0.05, "monolith_coupling": 0.03}
    made = [f(m, config) for f in (detectors.cyclic, detectors.shared_database, detectors.nano, detectors.wrong_cuts, detectors.esb, detectors.monolith)]
    out = made[0]
    for f in made[1:]:
        out = out.unionByName(f)
    return out.select("pattern_type", F.col("primary_service").alias("service"), "description")


def _shown(found: DataFrame) -> DataFrame:
    """A row for each piece of code of each finding."""
    each = found.select("pattern_type", F.col("primary_service").alias("service"), F.posexplode("snippets").alias("n", "x"))
    return each.select("pattern_type", "service", "n", "x.file", "x.start_line", "x.end_line", "x.highlight_line", "x.code")


def main_lines(v: Tables) -> DataFrame:
    """The lens's lines, numbered within their file without gaps."""
    order = Window.partitionBy("service").orderBy("line_no")
    return v.lines.withColumns({"file": F.lit("src/main/java/Main.java"), "line_no": F.row_number().over(order)})


def _around(hits: str) -> str:
    """Code around `hits` (service, n, file, at, k) in the lines m (service, file, line_no, text)."""
    return f"""SELECT h.service, CAST(n AS INTEGER) n, h.file, CAST(min(m.line_no) AS INTEGER) start_line, CAST(max(m.line_no) AS INTEGER) end_line, CAST(h.hit AS INTEGER) highlight_line, string_agg(text, chr(10) ORDER BY m.line_no) code
 FROM {hits} h JOIN m ON m.service = h.service AND m.file = h.file AND m.line_no BETWEEN h.hit - k AND h.hit + k GROUP BY h.service, n, h.file, h.hit"""


@query("l5_url_snippets", f"""WITH {LINES.replace("src AS", "src0 AS")}, src AS (SELECT service, row_number() OVER (PARTITION BY service ORDER BY line_no) line_no, text FROM src0), {_LITERALS},
m AS (SELECT *, 'src/main/java/Main.java' file FROM src), h AS (SELECT service, line_no hit, 3 k, 'src/main/java/Main.java' file, row_number() OVER (PARTITION BY service ORDER BY line_no, pos) - 1 n FROM u WHERE url <> '')
SELECT 'HARDCODED_ENDPOINTS' pattern_type, x.* FROM ({_around("(SELECT * FROM h WHERE n < 5)")}) x""")
def l5_urls(spark, d):
    v = Tables(spark, d)
    m = detectors.Model(v.services, v.deps, lines=v.run(main_lines(v)))
    return _shown(evidence.attach(detectors.hardcoded(m), m, "HARDCODED_ENDPOINTS"))


@query("l5_call_snippets", f"""{_BC}, x AS (SELECT id, name FROM bc JOIN deg USING (id) WHERE {_HUBS}),
o AS (SELECT name, s, 0 side, s * 100 + t dep FROM x JOIN e ON e.t = x.id UNION ALL SELECT name, s, 1, s * 100 + t FROM x JOIN e ON e.s = x.id),
esb AS (SELECT 'ESB_MISUSE' pattern_type, name service, s, row_number() OVER (PARTITION BY name ORDER BY side, dep) - 1 n FROM o),
mono AS (SELECT 'DISTRIBUTED_MONOLITH' pattern_type, CAST(NULL AS VARCHAR) service, s, row_number() OVER (ORDER BY s * 100 + t) - 1 n FROM e)
SELECT pattern_type, service, CAST(n AS INTEGER) n, concat('f', s, '.java') file, 0 start_line, 0 end_line, 0 highlight_line, 'call()' code FROM (SELECT * FROM esb UNION ALL SELECT * FROM mono) WHERE n < 5""")
def l5_calls(spark, d):
    v = Tables(spark, d)
    m, config = detectors.Model(v.services, v.deps), {"esb_mediator": 0.05, "monolith_coupling": 0.03}
    esb, monolith = (evidence.attach(f(m, config), m, kind) for f, kind in ((detectors.esb, "ESB_MISUSE"), (detectors.monolith, "DISTRIBUTED_MONOLITH")))
    return _shown(esb.unionByName(monolith))


@query("x13_controller_snippets", f"""WITH {ENDPOINTS}, c AS (SELECT DISTINCT name service, part % 7 c FROM ep WHERE name IN (SELECT name FROM ep GROUP BY name HAVING count(*) FILTER (WHERE regexp_matches(path, '/v(\\d+)([/.]|$)')) = 0)),
f AS (SELECT service, c, row_number() OVER (PARTITION BY service ORDER BY c) - 1 n, concat('src/main/java/C', c, '.java') file FROM c QUALIFY n < 3),
m AS (SELECT p_brand service, concat('src/main/java/C', p_partkey % 7, '.java') file, row_number() OVER (PARTITION BY p_brand, p_partkey % 7 ORDER BY p_partkey) line_no,
 CASE WHEN p_partkey % 7 % 2 = 0 AND p_partkey % 3 = 0 THEN concat('  @RestController // ', p_partkey) ELSE concat('line ', p_partkey) END AS text FROM part),
mark AS (SELECT service, file, min(line_no) FILTER (WHERE text LIKE '%@RestController%') l FROM m GROUP BY 1, 2),
h AS (SELECT f.service, n, f.file, coalesce(l, 1) hit, CASE WHEN l IS NULL THEN 10 ELSE 5 END k FROM f JOIN mark ON mark.service = f.service AND mark.file = f.file)
SELECT 'API_VERSIONING_ABSENCE' pattern_type, x.* FROM ({_around("h")}) x""")
def x13(spark, d):
    """Every part is a line of the controller that its number gives."""
    v = Tables(spark, d)
    k = F.col("p_partkey")
    marked = F.concat(F.lit("  @RestController // "), k.cast("string"))
    text = F.when((k % 7 % 2 == 0) & (k % 3 == 0), marked).otherwise(F.concat(F.lit("line "), k.cast("string")))
    order = Window.partitionBy("p_brand", k % 7).orderBy(k)
    file = F.concat(F.lit("src/main/java/C"), (k % 7).cast("string"), F.lit(".java"))
    lines = v.read("part").select(F.col("p_brand").alias("service"), file.alias("file"), F.row_number().over(order).alias("line_no"), text.alias("text"))
    m = detectors.Model(v.brands, v.deps, endpoints=v.endpoints, lines=v.run(lines))
    return _shown(evidence.attach(detectors.api_versioning(m), m, "API_VERSIONING_ABSENCE"))


@query("x14_database_snippets", f"""WITH {SERVICES}, src AS (SELECT n_name service, c_custkey, CASE WHEN c_custkey % 37 = 5 AND c_nationkey % 3 > 0 THEN concat('spring.DataSource.url=', c_custkey) ELSE concat('key', c_custkey, '=v') END AS text,
 concat('src/main/resources/', ['application.yml', 'application.properties', 'bootstrap.yml'][CASE WHEN c_nationkey % 2 = 0 THEN c_custkey % 3 + 1 ELSE 2 END]) file FROM customer JOIN nation ON n_nationkey = c_nationkey),
m AS (SELECT *, row_number() OVER (PARTITION BY service, file ORDER BY c_custkey) line_no FROM src),
mark AS (SELECT service, file, min(line_no) FILTER (WHERE lower(text) LIKE '%datasource%') l FROM m WHERE file NOT LIKE '%bootstrap%' GROUP BY 1, 2),
best AS (SELECT * FROM mark QUALIFY row_number() OVER (PARTITION BY service ORDER BY file DESC) = 1),
g AS (SELECT min(name) lead, url FROM services GROUP BY url HAVING count(*) > 1),
h AS (SELECT g.lead, b.service, b.file, coalesce(l, 1) hit, CASE WHEN l IS NULL THEN 10 ELSE 3 END k, row_number() OVER (PARTITION BY g.url ORDER BY b.service) - 1 n FROM g JOIN services s ON s.url = g.url JOIN best b ON b.service = s.name)
SELECT 'SHARED_DATABASE' pattern_type, h.lead AS service, x.n, x.file, start_line, end_line, highlight_line, code FROM ({_around("h")}) x JOIN h ON h.service = x.service AND h.n = x.n""")
def x14(spark, d):
    """Every customer is a line of a configuration file of its nation's service."""
    v = Tables(spark, d)
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    named = F.concat(F.lit("spring.DataSource.url="), k.cast("string"))
    text = F.when((k % 37 == 5) & (n % 3 > 0), named).otherwise(F.concat(F.lit("key"), k.cast("string"), F.lit("=v")))
    names = F.array(*[F.lit(x) for x in ["application.yml", "application.properties", "bootstrap.yml"]])
    file = F.concat(F.lit("src/main/resources/"), F.element_at(names, F.when(n % 2 == 0, k % 3 + 1).otherwise(2).cast("int")))
    held = v.read("customer").join(v.read("nation"), n == F.col("n_nationkey")).select(F.col("n_name").alias("service"), file.alias("file"), k.alias("k"), text.alias("text"))
    lines = held.withColumn("line_no", F.row_number().over(Window.partitionBy("service", "file").orderBy("k"))).drop("k")
    m = detectors.Model(v.services, v.deps, config=v.run(lines))
    return _shown(evidence.attach(detectors.shared_database(m), m, "SHARED_DATABASE"))


_CLASSES = """c AS (SELECT p_brand service, concat('C', p_partkey) class, p_size fields, p_partkey % 60 methods, p_partkey * 37 % 2000 loc, p_size % 30 domains, p_partkey % 20 params,
 CASE WHEN p_partkey % 11 = 0 THEN -1 ELSE p_partkey % 11 / 10.0 END tcc, p_partkey % 7 = 0 data FROM part)"""
#: God services with their sentences, cut to a thousand characters.
GODS = f"""WITH {_CLASSES}, o AS (SELECT service, class, list_filter([CASE WHEN fields >= 25 THEN concat('fields=', fields, ' (>=25)') END, CASE WHEN methods >= 30 THEN concat('publicMethods=', methods, ' (>=30)') END,
 CASE WHEN loc >= 1000 THEN concat('LOC=', loc, ' (>=1000)') END, CASE WHEN domains >= 20 THEN concat('importDomains=', domains, ' (>=20)') END, CASE WHEN params >= 12 THEN concat('constructorParams=', params, ' (>=12)') END,
 CASE WHEN tcc >= 0 AND tcc < 0.5 THEN printf('TCC=%.2f (<0.50)', CAST(tcc AS DOUBLE)) END], lambda x: x IS NOT NULL) n FROM c WHERE NOT data),
g AS (SELECT service, string_agg(class, ',' ORDER BY class) classes, concat('Service ''', service, ''' exhibits God Service characteristics: ',
 string_agg(concat('class ''', class, ''' exceeds ', len(n), ' God Class metrics (', array_to_string(n, ', '), ')'), '; ' ORDER BY class)) said FROM o WHERE len(n) >= 3 GROUP BY 1)
SELECT 'GOD_SERVICE' pattern_type, 'HIGH' severity, service, service affected, CASE WHEN len(said) > 1000 THEN concat(left(said, 997), '...') ELSE said END description, classes FROM g"""
#: Sentences of chatty pairs, chatty clients and fixed addresses, as SQL expressions.
PAIR = "concat('Excessive communication between ''', source, ''' and ''', target, ''' (', cc, ' calls detected). Fine-grained calls increase latency and coupling.')"
CLIENT = "concat('Service ''', service, ''' contains chatty client ''', type, ''' with ', calls, ' fine-grained HTTP methods. Each method makes a separate HTTP call instead of using a coarse-grained aggregate API.')"
FIXED = "concat('Service ''', service, ''' has ', count(*), ' hardcoded endpoint URL(s). Hardcoded URLs prevent dynamic service discovery and complicate deployment.')"
