import io
import random
import zipfile

import pytest
from lodestone.functions import lines as scan
from lodestone.functions import text as t
from lodestone.operators import detectors, diff, graph, model, score
from lodestone.operators.cohesion import tight_cohesion
from lodestone.schema import RUN
from lodestone.sources import files
from pyspark.sql import functions as F

SERVICES = "project_id long, analysis_number int, id long, name string, datasource_url string, lines_of_code int, number_of_endpoints int"
DEPS = "project_id long, analysis_number int, id long, source_service_id long, target_service_id long, dependency_type string, call_count int, evidence_file string, evidence_code string"


def run(spark, names, pairs, urls=None, calls=1, loc=1000, endpoints=5):
    s = [(1, 1, i, n, (urls or {}).get(n), loc, endpoints) for i, n in enumerate(names)]
    at = {n: i for i, n in enumerate(names)}
    d = [(1, 1, k, at[a], at[b], "FEIGN_CLIENT", calls, "f", "c") for k, (a, b) in enumerate(pairs)]
    return detectors.Model(spark.createDataFrame(s, SERVICES), spark.createDataFrame(d, DEPS))


def names(df):
    return sorted(r.primary_service for r in df.collect())


def test_cycles(spark):
    cases = [("ab", ["ab"], []), ("ab", ["ab", "ba"], [2]), ("abc", ["ab", "bc", "ca"], [3]), ("abcd", ["ab", "ba", "cd", "dc"], [2, 2]), ("ab", [], [])]
    for nodes, pairs, want in cases:
        found = detectors.cyclic(run(spark, list(nodes), [tuple(p) for p in pairs])).collect()
        assert sorted(r.cycle_length for r in found) == want
        assert all(r.severity == "CRITICAL" for r in found)
    ring = detectors.cyclic(run(spark, list("cab"), [("a", "b"), ("b", "c"), ("c", "a")])).first()
    assert ring.details["cycle"] == "a -> b -> c -> a"


def test_components_and_betweenness_against_definitions():
    rng = random.Random(1)
    for _ in range(30):
        n = rng.randrange(2, 9)
        pairs = sorted({(a, b) for _ in range(rng.randrange(2 * n)) if (a := rng.randrange(n)) != (b := rng.randrange(n))})
        far = {(a, b): 1 for a, b in pairs} | {(a, a): 0 for a in range(n)}
        for k in range(n):
            for i in range(n):
                for j in range(n):
                    if (i, k) in far and (k, j) in far:
                        far[i, j] = min(far.get((i, j), 99), far[i, k] + far[k, j])
        groups = {tuple(sorted(j for j in range(n) if (i, j) in far and (j, i) in far)) for i in range(n)}
        assert graph.components(pairs) == sorted(list(g) for g in groups if len(g) > 1)
        count = {}
        for s in range(n):
            count[s, s] = 1.0
            for d in range(1, n):
                for v in range(n):
                    if far.get((s, v)) == d:
                        count[s, v] = sum(count[s, u] for u, w in pairs if w == v and far.get((s, u)) == d - 1)
        got = graph.brandes(pairs)
        for v in got:
            want = sum(count[s, v] * count[v, x] / count[s, x] for s in range(n) for x in range(n) if len({s, v, x}) == 3 and (s, v) in far and (v, x) in far and far.get((s, x)) == far[s, v] + far[v, x])
            assert got[v] == pytest.approx(want)


def test_wrong_cuts_and_monolith(spark):
    assert names(detectors.wrong_cuts(run(spark, list("abcd"), [("a", "b"), ("b", "a"), ("c", "d"), ("d", "c"), ("a", "c")]))) == ["a", "c"]
    ring = [(a, b) for a in "abc" for b in "abc" if a != b]
    assert detectors.monolith(run(spark, list("ab"), [("a", "b"), ("b", "a")])).count() == 0
    assert detectors.monolith(run(spark, list("abc"), ring)).count() == 1
    assert detectors.monolith(run(spark, list("abcd"), [("a", "b")])).count() == 0
    assert detectors.monolith(run(spark, list("abc"), [("a", "b"), ("b", "c"), ("c", "a")], {"a": "u", "b": "u"})).count() == 1
    assert detectors.monolith(run(spark, list("abc"), [("a", "b")]), {"monolith_coupling": 0.1}).count() == 1


def test_esb(spark):
    spokes = [(a, b) for x in "abcd" for a, b in (("hub", x), (x, "hub"))]
    m = run(spark, ["hub", *"abcd"], spokes)
    assert names(detectors.esb(m)) == ["hub"]
    bc = {r.id: (r.bc, r.bc_norm) for r in graph.betweenness(m.services, m.deps).collect()}
    assert bc[0] == (12.0, 1.0) and bc[1] == (0.0, 0.0)
    for name in ("api-gateway", "zuul", "edge-service", "my-bff", "proxy"):
        assert detectors.esb(run(spark, [name, *"abcd"], [(name if a == "hub" else a, name if b == "hub" else b) for a, b in spokes])).count() == 0
    assert detectors.esb(run(spark, list("abcdef"), [("a", "b"), ("b", "a"), ("c", "d"), ("d", "c"), ("e", "f"), ("f", "e")])).count() == 0


def test_attribute_detectors(spark):
    for loc, ep, hit in [(100, 1, 1), (600, 1, 0), (100, 5, 0), (500, 2, 0), (499, 2, 1), (0, 0, 1)]:
        assert detectors.nano(run(spark, ["a"], [], loc=loc, endpoints=ep)).count() == hit
    assert detectors.nano(run(spark, ["a"], [], loc=800, endpoints=3), {"nano_max_loc": 1000, "nano_max_endpoints": 5}).count() == 1
    urls = {"a": "u", "b": "u", "c": "", "d": "   ", "e": "v", "f": "v", "g": "w"}
    found = detectors.shared_database(run(spark, list("abcdefgh"), [], urls)).collect()
    assert sorted((r.shared_database_url, tuple(r.affected)) for r in found) == [("u", ("a", "b")), ("v", ("e", "f"))]
    assert detectors.chatty(run(spark, list("ab"), [("a", "b")], calls=5)).first().call_count == 5
    assert detectors.chatty(run(spark, list("ab"), [("a", "b")], calls=4)).count() == 0
    ends = [(1, 1, 0, "/a", None, "C", False), (1, 1, 0, "/b", None, "C", False), (1, 1, 1, "/v1/a", "v1", "C", True), (1, 1, 1, "/b", None, "C", False), (1, 1, 2, "/x", "header", "C", False)]
    m = run(spark, list("abcd"), [])
    m.endpoints = spark.createDataFrame(ends, "project_id long, analysis_number int, microservice_id long, path string, api_version string, controller_class string, has_versioning boolean")
    assert names(detectors.api_versioning(m)) == ["a"]
    assert detectors.detect(m, enabled={"API_VERSIONING_ABSENCE", "NANO_SERVICE"}).count() == 1


def test_god_service_and_cohesion(spark):
    own = [(1, 1, "s", "Big", f"m{i}", [f"f{i}"]) for i in range(30)] + [(1, 1, "s", "One", "m", ["x"]), (1, 1, "s", "Two", "a", ["x", "y"]), (1, 1, "s", "Two", "b", ["y"]), (1, 1, "s", "Two", "c", ["z"])]
    methods = spark.createDataFrame(own, "project_id long, analysis_number int, service string, class string, method string, fields array<string>")
    tcc = {r["class"]: r.tcc for r in tight_cohesion(methods, [*RUN, "service", "class"]).collect()}
    assert tcc["Big"] == 0 and tcc["One"] == -1 and tcc["Two"] == pytest.approx(1 / 3)
    kind = "project_id long, analysis_number int, service string, class string, fields int, public_methods int, lines_of_code int, domains int, ctor_params int, tcc double, is_data_class boolean"
    rows = [(1, 1, "s", "Big", 30, 30, 100, 1, 0, 0.0, False), (1, 1, "t", "CustomerDto", 30, 30, 100, 1, 0, 0.0, True), (1, 1, "u", "Calculator", 1, 2, 50, 1, 0, 1.0, False)]
    m = run(spark, ["s"], [])
    m.classes = spark.createDataFrame(rows, kind)
    assert names(detectors.god(m)) == ["s"]


def test_hardcoded_lines(spark):
    cases = [('String u = "http://payment-service:8080/api/pay";', 1), ('"localhost:8080"', 1), ('x("127.0.0.1:9090")', 1), ('"10.0.0.5:9090/api"', 1), ('"http://a/x" + "http://b" + "http://c"', 3), ('// "http://a"', 0), ('/* "http://a" */', 0), ('* "http://a"', 0), ('import "http://a"', 0), ("call(10.0.0.5:9090)", 0), ("int x;", 0), ('"a\\"http://b"', 1), ("'http://q'", 1)]
    rows = [("s", "src/A.java", i, x) for i, (x, _) in enumerate(cases)] + [("s", "src/latest/A.java", 1, cases[0][0])]
    found = scan.hardcoded_urls(spark.createDataFrame(rows, "service string, file string, line_no int, text string")).groupBy("line_no").count().collect()
    assert {r.line_no: r["count"] for r in found} == {i: n for i, (_, n) in enumerate(cases) if n}


def test_comment_state(spark):
    text = ["/* a", "@SpringBootApplication", "*/ x", "int y;", "/* one */", "  * z", "import q;", "\t// c", "class A {"]
    rows = [("s", "A", i, x) for i, x in enumerate(text)]
    got = scan.code_lines(spark.createDataFrame(rows, "service string, file string, line_no int, text string")).orderBy("line_no")
    assert [r.text for r in got.collect()] == ["int y;", "class A {"]


def test_scalars(spark):
    def one(f, *values):
        frame = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
        return frame.select(f(*[F.col(c) for c in frame.columns])).first()[0]

    assert [one(t.resolve_defaults, x) for x in ("${A:b}", "${A:}", "${A}", "x${A:b}y")] == ["b", "", "", "xby"]
    assert one(t.database_name, "jdbc:pg://h/${DB:x}") == "${DB:x}" and one(t.database_name, "jdbc:pg://h/db?x=1") == "db" and one(t.database_name, "jdbc") is None
    assert one(t.service_of_url, "http://svc-b:8080/x") == "svc-b" and one(t.service_of_url, "http://localhost:8081/a") == "localhost:8081" and one(t.service_of_url, "http://localhost/a") is None
    assert one(t.service_of_url, "/orders/1") == "/orders/1" and one(t.service_of_url, "http://0.0.0.0:80") is None
    assert one(t.port_of, "localhost:8081/a") == 8081 and one(t.port_of, "a:80") is None
    assert [one(t.normalize_path, x) for x in ("", "a//b", "/x")] == ["/", "/a/b", "/x"] and one(t.path_version, "/api/v2/x") == "v2" and one(t.path_version, "/v2x") is None
    assert one(t.http_method, "RequestMethod.DELETE") == "DELETE" and one(t.http_method, "") == "GET"
    assert one(lambda c: t.truncate(c, 3), "abcd") == "abc..." and one(t.strip, "\t a \x01") == "a"
    assert one(t.repository_name, "https://h/x/repo.git") == "repo" and one(t.source_type, "https://gitlab.com/x") == "GITLAB"
    assert one(t.resolve_placeholder, "${A:http://d}", None) == "http://d" and one(t.resolve_placeholder, "${A}", "http://${P:1}") == "http://1" and one(t.resolve_placeholder, "http://x", None) == "http://x" and one(t.resolve_placeholder, "x", None) is None
    assert one(t.annotation_version, '@X(headers="X-API-Version=1")') == "header" and one(t.annotation_version, '@X(produces="application/vnd.a.v1+json")') == "header" and one(t.annotation_version, '@X(params="version=1")') == "query" and one(t.annotation_version, "@X") is None


def test_score_grades_and_the_published_example(spark):
    kind = "project_id long, analysis_number int, pattern_type string, severity string"
    plain = [("CYCLIC_DEPENDENCY", "CRITICAL")] + [("WRONG_CUTS", "HIGH")] * 4 + [("API_VERSIONING_ABSENCE", "MEDIUM")] * 7 + [("NANO_SERVICE", "MEDIUM")]
    found = spark.createDataFrame([(1, 1, a, b) for a, b in plain] + [(2, 1, "CYCLIC_DEPENDENCY", "CRITICAL"), (2, 1, "X", "HIGH"), (2, 1, "Y", "MEDIUM"), (3, 1, "NANO_SERVICE", "MEDIUM"), (3, 1, "GOD_SERVICE", "HIGH")], kind)
    runs = spark.createDataFrame([(1, 1, 260, 8280, 0.25, 1), (2, 1, 100, 10000, 0.8, 0), (3, 1, 0, 0, 0.0, 3), (4, 1, 0, 100, 0.0, 0)], "project_id long, analysis_number int, smells int, loc int, coupling double, cycles int")
    got = {r.project_id: r for r in score.score(runs, found).collect()}
    assert (got[1].anti_patterns, got[1].code_quality, got[1].architecture, got[1].service_sizing, got[1].health_score, got[1].grade) == (0, 12, 16, 12, 40, "F")
    assert (got[2].anti_patterns, got[2].code_quality, got[2].architecture) == (24, 17, 13)
    assert (got[3].anti_patterns, got[3].architecture, got[3].service_sizing) == (40, 15, 7)
    assert (got[4].health_score, got[4].grade, got[4].deductions) == (100, "A", [])
    edge = spark.createDataFrame([(x,) for x in (90, 89, 80, 79, 65, 64, 50, 49)], "s int").select(score.grade(F.col("s")).alias("g"))
    assert [r.g for r in edge.collect()] == list("ABBCCDDF")
    assert score.gate(score.score(runs, found), 50).count() == 1


def test_diff_is_a_multiset_diff(spark):
    rows = [(1, 1, "k", i) for i in range(3)] + [(1, 2, "k", 10 + i) for i in range(2)] + [(1, 2, "n", 20), (2, 1, "z", 1)]
    keyed = spark.createDataFrame(rows, "project_id long, analysis_number int, key string, finding_ord long")
    links = diff.previous(keyed.select("project_id", "analysis_number").distinct())
    got = {r.key: (r.n_unchanged, r.n_new, r.n_resolved) for r in diff.multiset(keyed, links).collect()}
    assert got == {"k": (2, 0, 1), "n": (0, 1, 0)}
    states = sorted((r.key, r.state, r.former) for r in diff.matched(keyed, links).collect() if r.state != "unchanged")
    assert [s for s in states if s[0] == "k"] == [("k", "resolved", 2)]


def test_boundaries(spark):
    paths = ["a/pom.xml", "a/src/main/java/A.java", "b/pom.xml", "b/Dockerfile", "b/src/x", "common-lib-tests/pom.xml", "agg/pom.xml", "agg/c/pom.xml", "agg/c/src/x", "pom.xml", "docs/d/pom.xml", "test-gateway/pom.xml", "e/target/pom.xml"]
    rows = [("p", x, x.rpartition("/")[0], x.rpartition("/")[2]) for x in paths]
    listed = spark.createDataFrame(rows, "project string, path string, dir string, basename string")
    modules = spark.createDataFrame([("p", ""), ("p", "agg")], "project string, dir string")
    found = model.candidates(listed, modules)
    assert sorted(r.dir for r in found.collect()) == ["a", "agg/c", "b", "test-gateway"]
    entries = spark.createDataFrame([("p", "a", True, True), ("p", "agg/c", False, True)], "project string, dir string, framework boolean, main boolean")
    got = sorted((r.dir, r.confidence, r.signal) for r in model.deployable(found, listed, entries, listed).collect())
    assert got == [("a", "HIGH", "framework-entry-point"), ("agg/c", "LOW", "main-method"), ("b", "MEDIUM", "dockerfile")]
    none = model.deployable(found.filter("dir = 'a'"), listed.limit(0), entries.limit(0), listed).collect()
    assert [(r.dir, r.signal) for r in none] == [("a", "single-module-fallback")]
    assert [r.signal for r in model.deployable(found, listed.limit(0), entries.limit(0), listed).collect()] == ["all-gated-fallback"]
    assert [r.signal for r in model.deployable(found.limit(0), listed.limit(0), entries.limit(0), listed).collect()] == ["no-candidates-fallback"]


def test_dependencies_resolve_by_name_port_and_likeness(spark):
    services = spark.createDataFrame([(1, 0, "order-service", None, 8080), (1, 1, "payment-service", None, 8081), (1, 2, "x", "billing", None)], "project_id long, id long, name string, app_name string, port int")
    rows = [(0, "payment-service"), (0, "http://localhost:8081"), (2, "payment"), (0, "billing"), (2, "/orders/1"), (1, "payment-service"), (0, "nobody")]
    calls = spark.createDataFrame([(1, s, x, i, "FEIGN_CLIENT", f"f{i}", i, "c") for i, (s, x) in enumerate(rows + rows[:1])], "project_id long, source_id long, target string, ord int, dependency_type string, file string, line int, code string")
    got = sorted((r.source_id, r.target, r.target_id, r.call_count, r.file) for r in model.dependencies(calls, services).collect())
    assert got == [(0, "billing", 2, 1, "f3"), (0, "http://localhost:8081", 1, 1, "f1"), (0, "payment-service", 1, 2, "f0"), (2, "/orders/1", 0, 1, "f4"), (2, "payment", 1, 1, "f2")]


def test_sources(spark, tmp_path):
    def pack(entries):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for k, v in entries.items():
                z.writestr(k, v)
        return out.getvalue()

    tree = {"top/a/Dockerfile": "", "top/a/src/main/java/A.java": b"l\xe91\r\nl2\rl3\n\nl5\n", "top/a/application.yml": "server:\n  port: 8081\nspring:\n  datasource:\n    url: jdbc:pg://h/${DB:x}\nlist: [1, 2]\nnone:\n"}
    root = files.unpack(pack(tree), "P.ZIP", str(tmp_path / "p"))
    assert root.endswith("top")
    listed = {r.path: r.size for r in files.inventory(spark, root).collect()}
    assert listed["a/Dockerfile"] == 0 and len(listed) == 3
    found = files.of_services(files.source_lines(files.contents(spark, root, "*.java")), spark.createDataFrame([("a", "a"), ("", "root")], "dir string, service string"))
    assert sorted((r.line_no, r.text, r.service, r.file) for r in found.collect())[0] == (1, "lé1", "a", "src/main/java/A.java") and found.count() == 5
    props = files.config_properties(files.contents(spark, root, "application.*"))
    assert {r.key: r.value for r in props.collect()} == {"server.port": "8081", "spring.datasource.url": "jdbc:pg://h/${DB:x}", "list": "[1, 2]"}
    source = files.datasources(props.withColumn("service", F.lit("a"))).first()
    assert (source.datasource_url, source.datasource_name) == ("jdbc:pg://h/x", "${DB:x}")
    assert files.parse_properties("# c\na=1\nb : 2\nc\\\n d=3\nk v") == {"a": "1", "b": "2", "cd": "3", "k": "v"}
    for bad, options in [({"../x": "1"}, {}), ({"a/b/c": "1"}, {"max_depth": 2}), ({"a": "1", "b": "2"}, {"max_entries": 1}), ({"a": "12345"}, {"max_bytes": 3})]:
        with pytest.raises(ValueError):
            files.unpack(pack(bad), "x.zip", str(tmp_path / "bad"), **options)
        assert not (tmp_path / "bad").exists()
    reports = spark.createDataFrame([("o/DesignSmells.csv", 'Project Name,Package Name,Type Name,Design Smell,Cause of the Smell\np,k,"A,B",Broken Hierarchy,c\np,k,T,,c\nshort\n'), ("o/ImplementationSmells.csv", "Package Name,Implementation Smell\nk,Magic Number\n")], "path string, text string")
    assert sorted((r.category, r.smell_type, r.class_name, r.severity) for r in files.smell_reports(reports).collect()) == [("design", "Broken Hierarchy", "A,B", "MEDIUM"), ("implementation", "Magic Number", "k", "LOW")]


def test_yaml_values_as_text():
    text = "a:\n  - x\n  - true\n  - k: v\n    n:\nb: off\nc: {d: [1, [2]]}\ne:\n"
    assert files.parse_yaml(text) == {"a": "[x, true, {k=v, n=null}]", "b": "false", "c.d": "[1, [2]]"}


def test_job_states(spark):
    rows = [(1, 1, "PENDING", 0, 0), (1, 2, "RUNNING", 3, 5), (2, 1, "RUNNING", 0, 0), (2, 2, "CANCELLED", 1, 2), (2, 3, "COMPLETED", 2, 2)]
    got = {r.job_id: (r.status, r.progress) for r in model.job_state(spark.createDataFrame(rows, "job_id int, seq int, status string, completed int, total int")).collect()}
    assert got == {1: ("RUNNING", 60), 2: ("CANCELLED", 50)}
