from lodestone import api

APP = "package a;\n@SpringBootApplication\npublic class App { public static void main(String[] a) { } }\n"


def tree(root):
    def put(path, text):
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)

    put("pom.xml", "<modules><module>a</module></modules>")
    for name, port, other in (("order-service", 8080, "payment-service"), ("payment-service", 8081, "order-service"), ("user-service", 8082, None)):
        put(f"{name}/pom.xml", "<project/>")
        put(f"{name}/src/main/java/a/App.java", APP)
        put(f"{name}/src/main/resources/application.yml", f"server:\n  port: {port}\nspring:\n  datasource:\n    url: jdbc:pg://h/shared\n")
        put(f"{name}/src/main/java/a/Api.java", 'package a;\n@RestController\n@RequestMapping("/api")\nclass Api {\n  @GetMapping("/x") String x() { return "http://localhost:9/x"; }\n}\n')
        if other:
            put(f"{name}/src/main/java/a/Client.java", f'package a;\n@FeignClient(name = "{other}")\ninterface Client {{ @GetMapping("/p") String p(); }}\n')
    put("common-test/pom.xml", "<project/>")


def test_source_tree_to_score_and_comparison(spark, tmp_path):
    tree(tmp_path / "tree")
    root, store = tmp_path / "tree", str(tmp_path / "store")
    one, read, number = api.reanalyze(spark, str(root), store, "shop")
    assert number == 1 and read.n_read > 10
    got = {r.name: r for r in one.services.collect()}
    assert set(got) == {"order-service", "payment-service", "user-service"}
    assert all(r.detection_signal == "framework-entry-point" and r.datasource_url == "jdbc:pg://h/shared" and r.number_of_endpoints == 1 for r in got.values())
    ids = {r.id: n for n, r in got.items()}
    assert {(ids[r.source_service_id], ids[r.target_service_id], r.dependency_type) for r in one.dependencies.collect()} == {("order-service", "payment-service", "FEIGN_CLIENT"), ("payment-service", "order-service", "FEIGN_CLIENT")}
    kinds = sorted(r.pattern_type for r in one.findings.collect())
    assert kinds.count("CYCLIC_DEPENDENCY") == kinds.count("WRONG_CUTS") == kinds.count("SHARED_DATABASE") == 1
    assert kinds.count("NANO_SERVICE") == kinds.count("HARDCODED_ENDPOINTS") == kinds.count("API_VERSIONING_ABSENCE") == 3
    r = one.result.first()
    assert kinds.count("ESB_MISUSE") == 2
    points = 8 + 5 + 5 + 3 * 3 + 3 * 3 + 2 * 5  # cycle, wrong cut, database, addresses, versions, mediators
    assert (r.services_analyzed, r.cycle_count, r.total_dependencies, r.anti_patterns) == (3, 1, 2, max(0, 40 - points))
    assert 0 <= r.health_score <= 100 and r.dependency_graph_json.startswith('{"nodes"')
    two, read, number = api.reanalyze(spark, str(root), store, "shop", enabled={"CYCLIC_DEPENDENCY", "NANO_SERVICE"})
    assert number == 2 and (read.n_read, read.n_parsed) == (0, 0) and two.services.count() == 3
    last = api.history(spark, store, 1).filter("analysis_number = 2").first()
    assert (last.n_unchanged, last.n_new, last.n_resolved) == (4, 0, len(kinds) - 4) and last.summary.startswith("Score improved by")
