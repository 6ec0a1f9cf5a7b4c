"""Code of findings, detectors that fail, and the full comparison of runs."""

import dataclasses
import json

import pytest

from lodestone import api
from lodestone.operators import detectors, diff, evidence, score
from lodestone.schema import RUN

SERVICES = "project_id long, analysis_number int, id long, name string, datasource_url string, lines_of_code int, number_of_endpoints int"
DEPS = "project_id long, analysis_number int, id long, source_service_id long, target_service_id long, call_count int, evidence_file string, evidence_line int, evidence_code string"
LINES = "project_id long, analysis_number int, service string, file string, line_no int, text string"


def model(spark, more=0):
    services = spark.createDataFrame([(1, 1, 1, "a", "jdbc:x", 900, 5), (1, 1, 2, "b", "jdbc:x", 100, 1), (1, 1, 3, "c", None, 900, 5)], SERVICES)
    deps = spark.createDataFrame([(1, 1, 10, 1, 2, 1, "A.java", 7, "old()"), (1, 1, 11, 1, 2, 1, "A.java", 9, "b.call()"), (1, 1, 12, 2, 1, 1, "B.java", 3, "x" * 900)] + [(1, 1, 20 + i, 1, 3, 1, f"C{i}.java", i, f"c{i}()") for i in range(more)], DEPS)
    code = ["package p;", "@SpringBootApplication", "class M {", 'String u = "http://b:80/x";', "}"]
    lines = spark.createDataFrame([(1, 1, s, f"src/main/java/{s}.java", i + 1, t) for s in "ab" for i, t in enumerate(code)], LINES)
    yml = {"a": ["server:", "  port: 1", "spring:", "  DataSource:", "    url: jdbc:x", "x: 1", "y: 2", "z: 3"], "b": [f"k{i}: 1" for i in range(30)]}
    config = [(1, 1, s, f"src/main/resources/application.{e}", i + 1, t) for s, ls in yml.items() for e in ("properties", "yml") for i, t in enumerate(ls if e == "yml" else ["spring.datasource.url=no"])]
    config = spark.createDataFrame(config, LINES)
    return detectors.Model(services, deps, lines=lines, config=config)


def test_findings_carry_code_of_their_services(spark):
    found = {r.pattern_type: r for r in detectors.detect(model(spark), enabled={"WRONG_CUTS", "SHARED_DATABASE", "NANO_SERVICE", "HARDCODED_ENDPOINTS", "CYCLIC_DEPENDENCY"}).collect() if r.primary_service != "b" or r.pattern_type == "NANO_SERVICE"}
    calls = [(s.file, s.start_line, s.code) for s in found["WRONG_CUTS"].snippets]
    assert calls == [("A.java", 9, "b.call()"), ("B.java", 3, "x" * 900)]  # lines are not to be had, the last call's own code is
    shared = [(s.file, s.start_line, s.end_line, s.highlight_line) for s in found["SHARED_DATABASE"].snippets]
    assert shared == [("src/main/resources/application.yml", 1, 7, 4), ("src/main/resources/application.yml", 1, 11, 1)]  # one of each service; line 1 where none speaks of it
    head = found["NANO_SERVICE"].snippets
    assert [(s.file, s.start_line, s.end_line) for s in head] == [("src/main/java/b.java", 1, 5)] and "@SpringBootApplication" in head[0].code
    url = found["HARDCODED_ENDPOINTS"].snippets
    assert [(s.start_line, s.end_line, s.highlight_line) for s in url] == [(1, 5, 4)] and "http://b:80/x" in url[0].code
    assert [s.file for s in found["CYCLIC_DEPENDENCY"].snippets] == ["A.java", "B.java"]


def test_findings_show_the_first_places_only(spark):
    m = model(spark, more=40)
    many = spark.createDataFrame([(1, 1, "a", f"src/main/java/F{i % 3}.java", i // 3 + 1, f'String u{i} = "http://h{i}:80/x" + "http://g{i}:80/y";') for i in range(600)], LINES)
    m = dataclasses.replace(m, lines=many)
    found = {r.pattern_type: r for r in detectors.detect(m, {"monolith_coupling": 0.1}, {"HARDCODED_ENDPOINTS", "ESB_MISUSE", "DISTRIBUTED_MONOLITH"}).collect()}
    assert [(s.file, s.highlight_line) for s in found["HARDCODED_ENDPOINTS"].snippets] == [("src/main/java/F0.java", n) for n in (1, 1, 2, 2, 3)]
    assert found["HARDCODED_ENDPOINTS"].description.startswith("Service 'a' has 1200 hardcoded endpoint URL(s).")
    assert [s.code for s in found["DISTRIBUTED_MONOLITH"].snippets] == ["b.call()", "x" * 900, "c39()"]  # the last call of each pair
    assert len(found["ESB_MISUSE"].snippets) <= 5
    plan = evidence.first(evidence._urls(m), ["project_id", "analysis_number", "service"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # cut before it moves


def test_controllers_and_god_classes_are_shown(spark):
    body = ["package p;", "import x;", "", "// c", "", "", "@RestController", "class C1 {", "}"]
    plain = [f"line {i}" for i in range(20)]
    rows = [(1, 1, "a", f"src/main/java/p/{c}.java", i + 1, t) for c, ls in (("C1", body), ("C2", plain), ("C9", body)) for i, t in enumerate(ls)]
    ends = spark.createDataFrame([(1, 1, 1, "/x", "p." + c, None, False) for c in ("C2", "C1", "C1", "C3", "C9")], "project_id long, analysis_number int, microservice_id long, path string, controller_class string, api_version string, has_versioning boolean")
    wide = spark.createDataFrame([(1, 1, "a", f"p.K{i}", 30, 40, 2000, 1, 0, -1.0, False, "src/main/java/p/C1.java", 8) for i in range(20)] + [(1, 1, "b", "p.S", 26, 31, 1001, 21, 13, 0.25, False, "gone.java", 3)], "project_id long, analysis_number int, service string, class string, fields int, public_methods int, lines_of_code int, domains int, ctor_params int, tcc double, is_data_class boolean, file string, line int")
    m = dataclasses.replace(model(spark), lines=spark.createDataFrame(rows, LINES), endpoints=ends, classes=wide)
    found = {(r.pattern_type, r.primary_service): r for r in detectors.detect(m, enabled={"API_VERSIONING_ABSENCE", "GOD_SERVICE"}).collect()}
    api = found["API_VERSIONING_ABSENCE", "a"]
    assert [(s.file, s.start_line, s.end_line, s.highlight_line) for s in api.snippets] == [("src/main/java/p/C1.java", 2, 9, 7), ("src/main/java/p/C2.java", 1, 11, 1)]  # C3 has no file, C9 is the fourth
    assert api.details["controllers"] == "p.C1,p.C2,p.C3"
    big, small = found["GOD_SERVICE", "a"], found["GOD_SERVICE", "b"]
    assert len(big.description) == 1000 and big.description.endswith("...") and big.description.startswith("Service 'a' exhibits God Service characteristics: class 'p.K0' exceeds 3 God Class metrics (fields=30 (>=25), publicMethods=40 (>=30), LOC=2000 (>=1000)); class")
    assert small.description.endswith("class 'p.S' exceeds 6 God Class metrics (fields=26 (>=25), publicMethods=31 (>=30), LOC=1001 (>=1000), importDomains=21 (>=20), constructorParams=13 (>=12), TCC=0.25 (<0.50))")
    assert len(big.snippets) == 20 and small.snippets is None
    stored = {r.primary_service: r for r in evidence.json_columns(detectors.detect(m, enabled={"GOD_SERVICE"})).collect()}
    assert stored["b"].code_snippets_json is None and stored["a"].affected_services_json == '["a"]'
    assert json.loads(stored["a"].code_snippets_json)[0] == {"file": "src/main/java/p/C1.java", "startLine": 1, "endLine": 9, "highlightLine": 8, "snippet": "\n".join(body)}


def test_a_failing_detector_does_not_stop_the_others(spark, monkeypatch):
    def broken(m, config):
        raise ValueError("no such thing")

    monkeypatch.setitem(detectors.DETECTORS, "NANO_SERVICE", broken)
    found = detectors.detect(model(spark), enabled={"NANO_SERVICE", "WRONG_CUTS"})
    rows = {r.pattern_type: r for r in found.collect()}
    assert set(rows) == {detectors.FAILED, "WRONG_CUTS"} and "no such thing" in rows[detectors.FAILED].description
    assert score.severity_counts(found).first().total_anti_patterns == 1
    assert detectors.detect(model(spark), enabled=set()).count() == 0

    def lost(m, config):
        raise ConnectionError("a machine is gone")

    monkeypatch.setitem(detectors.DETECTORS, "NANO_SERVICE", lost)
    with pytest.raises(ConnectionError):
        detectors.detect(model(spark), enabled={"NANO_SERVICE"})


def test_comparison_lists_findings_and_changes(spark):
    kind = "project_id long, analysis_number int, pattern_type string, severity string, primary_service string, affected array<string>, details map<string,string>, cycle_length int, shared_database_url string"
    row = lambda run, kind, who: (1, run, kind, "HIGH", who, [who], {}, None, None)
    found = spark.createDataFrame([row(1, "NANO_SERVICE", "a"), row(1, "NANO_SERVICE", "b"), row(2, "NANO_SERVICE", "A "), row(2, "WRONG_CUTS", "c"), row(2, "WRONG_CUTS", "c")], kind)
    results = spark.createDataFrame([(1, 1, 50, "D", 0.5), (1, 2, 70, "C", 0.25)], "project_id long, analysis_number int, health_score int, grade string, coupling_coefficient double")
    states = sorted((r.state, r.pattern_type, r.primary_service) for r in api.changed_findings(found, results).collect())
    assert states == [("new", "WRONG_CUTS", "c"), ("new", "WRONG_CUTS", "c"), ("resolved", "NANO_SERVICE", "b"), ("unchanged", "NANO_SERVICE", "A ")]
    last = {r.analysis_number: r for r in api.compare(found, results).collect()}
    assert last[2].previous_grade == "D" and last[2].coupling_coefficient_delta == -0.25 and last[1].previous_grade is None
    assert (last[2].n_new, last[2].n_resolved, last[2].n_unchanged) == (2, 1, 1) and last[2].summary == "Score improved by 20; 1 resolved; 2 new"
    assert diff.previous(results.select(*RUN)).count() == 2
