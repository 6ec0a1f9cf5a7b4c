from lodestone.operators import detectors
from lodestone.sources import java
from lodestone.streaming import jobs

CONTROLLER = """package a.b;
import org.x.y.Z; import java.util.List;
/* class Fake { } */
@RestController
@RequestMapping("/api")
public class OrderController {
  private static final String S = "class { not }";
  private final Repo repo; // trailing {
  public OrderController(Repo repo, int n) { this.repo = repo; }
  @GetMapping("users") public List<String> all() { return repo.all(); }
  @PostMapping(path = {"/v2/x", "/y"}) public void add(@RequestBody String s) { }
  @RequestMapping(value = "/z", method = RequestMethod.DELETE, headers = "X-API-Version=1") void z() { }
  private int helper() { return 1; }
}
"""
CLIENTS = """package a;
@FeignClient(name = "payment-service", url = "http://localhost:8081")
interface PaymentClient { @GetMapping("/p") String p(); @PostMapping("/q") String q(String x); default int d() { return 1; } }
"""
CALLS = """package a;
class Caller {
  @Value("${u.url:http://localhost:8081}") private String u;
  RestTemplate restTemplate; WebClient web; Map<String,String> map;
  void a() { restTemplate.getForObject("http://svc-b:8080/x", String.class); restTemplate.getForObject(u + "/a", String.class); }
  void b() { web.get().uri("/orders/1").retrieve(); map.put("http://no/x", "y"); }
}
"""


def facts(spark):
    rows = [("orders", "OrderController.java", CONTROLLER), ("orders", "PaymentClient.java", CLIENTS), ("orders", "Caller.java", CALLS), ("x", "Broken.java", "class { {{ \"")]
    return java.java_types(spark.createDataFrame(rows, "service string, path string, text string"))


def test_types_and_endpoints(spark):
    types = {r.name: r for r in facts(spark).collect()}
    assert set(types) == {"OrderController", "PaymentClient", "Caller"}
    c = types["OrderController"]
    assert (c.package, c.kind, c.line, c.end_line, c.ctor_params) == ("a.b", "class", 6, 14, 2)
    assert [(f.name, f.is_static) for f in c.fields] == [("S", True), ("repo", False)]
    assert [(m.name, m.is_public, m.n_params, m.used) for m in c.methods] == [("all", True, 0, ["repo"]), ("add", True, 1, []), ("z", False, 0, []), ("helper", False, 0, [])]
    found = sorted((r.path, r.http_method, r.method_name, r.api_version) for r in java.endpoints(facts(spark)).collect())
    assert found == [("/api/v2/x", "POST", "add", "v2"), ("/api/z", "DELETE", "z", "header"), ("/apiusers", "GET", "all", None)]


def test_calls(spark):
    found = sorted((r.dependency_type, r.target) for r in java.raw_calls(facts(spark)).collect())
    assert found == [("FEIGN_CLIENT", "payment-service")] * 2 + [("REST_TEMPLATE", "localhost:8081"), ("REST_TEMPLATE", "svc-b"), ("WEB_CLIENT", "/orders/1")]
    props = spark.createDataFrame([("orders", "u.url", "http://other:9000")], "service string, key string, value string")
    assert "other" in {r.target for r in java.raw_calls(facts(spark), props).collect()}
    assert {(r.type, r.calls) for r in java.client_types(facts(spark)).collect()} == {("PaymentClient", 2), ("Caller", 2)}


def test_god_class_from_source(spark):
    body = "".join(f"  private int f{i};\n  public int process{i}() {{ return f{i}; }}\n" for i in range(30))
    rows = [("s", "Big.java", f"class Big {{\n{body}}}"), ("t", "CustomerDto.java", f"class CustomerDto {{\n{body}}}"), ("u", "Calculator.java", "class Calculator { int a; public int x() { return a; } public int y() { return a; } }")]
    metrics = {r["class"]: r for r in java.class_metrics(java.java_types(spark.createDataFrame(rows, "service string, path string, text string"))).collect()}
    assert (metrics["Big"].fields, metrics["Big"].public_methods, metrics["Big"].tcc, metrics["Big"].is_data_class) == (30, 30, 0.0, False)
    assert metrics["CustomerDto"].is_data_class and metrics["Calculator"].tcc == 1.0
    classes = java.class_metrics(java.java_types(spark.createDataFrame(rows, "service string, path string, text string")))
    from pyspark.sql import functions as F

    m = detectors.Model(classes, classes, classes=classes.withColumns({"project_id": F.lit(1).cast("long"), "analysis_number": F.lit(1)}))
    assert [r.primary_service for r in detectors.god(m).collect()] == ["s"]


def test_job_states_stream_and_watch(spark, tmp_path):
    kind = "job_id int, seq int, status string, completed int, total int"
    rows = [(1, 1, "PENDING", 0, 0), (1, 2, "RUNNING", 3, 5), (2, 2, "CANCELLED", 1, 2), (2, 3, "COMPLETED", 2, 2)]
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/in")
    want = {(1, "RUNNING", 60), (2, "CANCELLED", 50)}
    assert {tuple(r) for r in jobs.job_states(spark.read.parquet(f"{tmp_path}/in")).collect()} == want
    stream = jobs.job_states(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"))
    query = stream.writeStream.format("memory").queryName("states").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {tuple(r) for r in spark.table("states").collect()} == want
    seen = []
    jobs.watch(spark, f"{tmp_path}/in", kind, lambda df, k: seen.append(df.count()), f"{tmp_path}/c2").awaitTermination(60)
    assert sum(seen) == 4


CHAINS = """package a;
class Caller {
  @Value("${u.url:http://conf:1}") private String u;
  private final String base = root + "/v1";
  private String root = "http://root-svc:8080";
  private String lost = somewhere();
  RestTemplate rest;
  void a() {
    String one = "http://svc-" + "a:80";
    String two = one + "/x" + id + "/y";
    rest.getForObject(two, String.class);
    two = "http://svc-b/z";
    rest.getForObject(two + "/q", String.class);
    rest.getForObject(this.base + "/orders", String.class);
    rest.getForObject(u + "/a", String.class);
    rest.getForObject(host + "/a", String.class);
    rest.getForObject(lost + "/a", String.class);
    String x0 = "http://deep/";
    String x1 = x0; String x2 = x1; String x3 = x2 + "p"; String x4 = x3; String x5 = x4; String x6 = x5 + "q";
    rest.getForObject(x6, String.class);
    String loop = loop2; String loop2 = loop;
    rest.getForObject(loop, String.class);
    rest.getForObject("http://lit/" + id + "/end", String.class);
  }
}
"""


def test_addresses_behind_names(spark):
    types = java.java_types(spark.createDataFrame([("s", "Caller.java", CHAINS), ("t", "Caller.java", CHAINS.replace("root-svc", "other-svc"))], "service string, path string, text string"))
    called = lambda follow: {s: sorted((r.line, r.target) for r in java.raw_calls(types, follow=follow).filter(f"service = '{s}'").collect()) for s in "st"}
    # Without following, literals and configured fields alone say where a call goes.
    assert called(False)["s"] == [(15, "conf"), (23, "lit")]
    want = [(11, "svc-a"), (13, "svc-b"), (14, "root-svc"), (15, "conf"), (20, "deep"), (23, "lit")]
    got = called(True)
    assert got["s"] == want and got["t"] == [(n, x.replace("root-svc", "other-svc")) for n, x in want]


def test_texts_go_on_with_literals_only(spark):
    kind = "service string, path string, type string, at int, parts array<struct<kind:string,val:string>>"
    rows = [("s", "p", "T", 1, [("lit", "a"), ("ref", "x"), ("lit", "b")]), ("s", "p", "T", 2, [("ref", "v"), ("lit", "/c")]), ("s", "p", "T", 3, [("other", "f()"), ("lit", "/c")]), ("s", "p", "T", 4, []), ("s", "p", "T", 5, [("ref", "y")])]
    uses = spark.createDataFrame(rows, kind)
    values = spark.createDataFrame([("s", "v", "V")], "service string, name string, value string")
    got = {r.at: r.text for r in java.texts(uses, values).collect()}
    assert got == {1: "ab", 2: "V/c", 3: None, 4: None, 5: None}
    defs = spark.createDataFrame([("s", "p", "T", "y", 9, [("ref", "v"), ("lit", "1")]), ("s", "p", "U", "y", 1, [("lit", "no")])], "service string, path string, type string, name string, at int, value array<struct<kind:string,val:string>>")
    assert {r.at: r.text for r in java.texts(uses, values, defs).collect()} == got | {5: "V1"}
