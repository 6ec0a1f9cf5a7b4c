"""Ten detectors of architectural anti-patterns. Each takes a Model and options
and returns rows of FINDINGS; thresholds come with the call, else by default."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.errors import AnalysisException, ArithmeticException, ArrayIndexOutOfBoundsException, IllegalArgumentException, NumberFormatException, PythonException, SparkRuntimeException

from ..functions.lines import hardcoded_urls
from ..functions.text import is_gateway, truncate
from ..schema import RUN, option
from ..sources.stages import keep
from . import evidence, graph

FINDINGS = "project_id long, analysis_number int, pattern_type string, severity string, primary_service string, affected array<string>, details map<string,string>, cycle_length int, call_count int, shared_database_url string, description string, snippets array<" + evidence.SNIPPET + ">"
#: Characters of a description.
MAX_TEXT = 1000
#: What is wrong with a detector's tables or rows; anything else, such as a lost machine or a full disk, ends the run.
FAULTS = (
    AnalysisException, ArithmeticException, ArrayIndexOutOfBoundsException, IllegalArgumentException, NumberFormatException, PythonException,
    SparkRuntimeException, ArithmeticError, AttributeError, KeyError, TypeError, ValueError,
)
# The sentences of findings.
SAYS = {
    "CYCLIC_DEPENDENCY": "Cyclic dependency detected: %s",
    "SHARED_DATABASE": "Multiple services share the same database: %s",
    "NANO_SERVICE": "Service '%s' is too small (%d LOC, %d endpoints) to justify operational overhead",
    "GOD_SERVICE": "Service '%s' exhibits God Service characteristics: %s",
    "GOD_CLASS": "class '%s' exceeds %d God Class metrics (%s)",
    "CHATTY_SERVICE": "Excessive communication between '%s' and '%s' (%d calls detected). Fine-grained calls increase latency and coupling.",
    "CHATTY_CLIENT": "Service '%s' contains chatty client '%s' with %d fine-grained HTTP methods. Each method makes a separate HTTP call instead of using a coarse-grained aggregate API.",
    "HARDCODED_ENDPOINTS": "Service '%s' has %d hardcoded endpoint URL(s). Hardcoded URLs prevent dynamic service discovery and complicate deployment.",
    "DISTRIBUTED_MONOLITH": "The system exhibits distributed monolith characteristics. Coupling coefficient: %.2f (%d/%d possible edges), %.0f%% of services are interconnected, %d shared database(s) detected. Services are tightly coupled and likely need coordinated deployments.",
    "API_VERSIONING_ABSENCE": "Service '%s' has %d endpoint(s) with no API versioning strategy. Without versioning, breaking changes cannot be managed gracefully.",
    "WRONG_CUTS": "Bidirectional dependency between '%s' and '%s'. Mutual dependencies suggest these services are too tightly coupled and may have been incorrectly split.",
    "ESB_MISUSE": "Service '%s' acts as a central mediator (ESB-like hub). It is called by %d service(s) (%.0f%%) and calls %d service(s) (%.0f%%), handling %d of %d total dependencies. Betweenness centrality: %.2f. This creates a single point of failure and bottleneck.",
}
#: A detector that failed leaves a finding of this type, so that the others' findings are not lost.
FAILED = "DETECTOR_FAILED"


@dataclass
class Model:
    """Tables of any number of runs."""

    services: DataFrame
    deps: DataFrame
    endpoints: DataFrame | None = None
    lines: DataFrame | None = None
    classes: DataFrame | None = None
    clients: DataFrame | None = None
    #: (run, service, file, line_no, text): lines of configuration files.
    config: DataFrame | None = None
    #: Classes that do too much, with file and line, where classes have them.
    too_much: DataFrame | None = None


def finding(df: DataFrame, kind: str, severity: str, primary: Column, affected: Column, details: dict[str, Column], text: Column, **more: Column) -> DataFrame:
    pairs = [x for k, v in details.items() for x in (F.lit(k), v.cast("string"))]
    null = lambda t: F.lit(None).cast(t)
    return df.select(
        *RUN, F.lit(kind).alias("pattern_type"), F.lit(severity).alias("severity"), primary.alias("primary_service"), affected.alias("affected"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("details"),
        more.get("cycle_length", null("int")).cast("int").alias("cycle_length"), more.get("call_count", null("int")).cast("int").alias("call_count"),
        more.get("shared_database_url", null("string")).alias("shared_database_url"), text.alias("description"),
        F.lit(None).cast(f"array<{evidence.SNIPPET}>").alias("snippets"),
    )


def says(kind: str, *values) -> Column:
    return F.format_string(SAYS[kind], *values)


def _named(df: DataFrame, services: DataFrame, **ids: str) -> DataFrame:
    """`df` with the names of the services whose ids are in the given columns."""
    for new, col in ids.items():
        names = services.select(*RUN, F.col("id").alias(col), F.col("name").alias(new))
        df = df.join(names, [*RUN, col])
    return df


def cyclic(m: Model, config: dict | None = None) -> DataFrame:
    named = _named(graph.scc(m.deps), m.services, name="id")
    groups = named.groupBy(*RUN, "component").agg(F.sort_array(F.collect_list("name")).alias("names"))
    ring = F.concat_ws(" -> ", "names", F.get("names", F.lit(0)))
    return finding(groups, "CYCLIC_DEPENDENCY", "CRITICAL", F.get("names", F.lit(0)), F.col("names"), {"cycle": ring}, says("CYCLIC_DEPENDENCY", ring), cycle_length=F.size("names"))


def shared_database(m: Model, config: dict | None = None) -> DataFrame:
    held = m.services.filter(F.col("datasource_url").isNotNull() & ~F.col("datasource_url").rlike(r"^\s*$"))
    groups = held.groupBy(*RUN, "datasource_url").agg(F.sort_array(F.collect_list("name")).alias("names")).filter(F.size("names") > 1)
    text = says("SHARED_DATABASE", "datasource_url")
    return finding(groups, "SHARED_DATABASE", "HIGH", F.get("names", F.lit(0)), F.col("names"), {"url": F.col("datasource_url")}, text, shared_database_url=F.col("datasource_url"))


def nano(m: Model, config: dict | None = None) -> DataFrame:
    small = m.services.filter((F.col("lines_of_code") < option(config, "nano_max_loc")) & (F.col("number_of_endpoints") <= option(config, "nano_max_endpoints")))
    text = says("NANO_SERVICE", "name", "lines_of_code", "number_of_endpoints")
    return finding(small, "NANO_SERVICE", "MEDIUM", F.col("name"), F.array("name"), {"lines": F.col("lines_of_code"), "endpoints": F.col("number_of_endpoints")}, text)


def god_classes(m: Model, config: dict | None = None) -> DataFrame:
    """Classes that do too much, with `over`, the measures in which they do."""
    o = lambda k: option(config, "god_" + k)
    more = lambda name, column, k: F.when(F.col(column) >= o(k), F.format_string(f"{name}=%d (>={o(k)})", column))
    loose = F.when((F.col("tcc") >= 0) & (F.col("tcc") < o("tcc")), F.format_string(f"TCC=%.2f (<{o('tcc'):.2f})", F.col("tcc").cast("double")))
    tests = F.array(
        more("fields", "fields", "fields"), more("publicMethods", "public_methods", "methods"), more("LOC", "lines_of_code", "loc"),
        more("importDomains", "domains", "domains"), more("constructorParams", "ctor_params", "ctor_params"), loose,
    )
    return m.classes.filter(~F.col("is_data_class")).withColumn("over", F.filter(tests, lambda x: x.isNotNull())).filter(F.size("over") >= o("min_metrics"))


def god(m: Model, config: dict | None = None) -> DataFrame:
    """From class metrics (run, service, class, fields, public_methods, lines_of_code, domains, ctor_params, tcc, is_data_class)."""
    found = god_classes(m, config).withColumn("says", says("GOD_CLASS", "class", F.size("over"), F.array_join("over", ", ")))
    each = found.groupBy(*RUN, "service").agg(F.array_sort(F.collect_list(F.struct("class", "says"))).alias("c"))
    text = says("GOD_SERVICE", "service", F.array_join("c.says", "; "))
    capped = F.when(F.length(text) > MAX_TEXT, F.concat(F.left(text, F.lit(MAX_TEXT - 3)), F.lit("..."))).otherwise(text)
    return finding(each, "GOD_SERVICE", "HIGH", F.col("service"), F.array("service"), {"classes": F.array_join("c.class", ",")}, capped)


def chatty(m: Model, config: dict | None = None) -> DataFrame:
    least = option(config, "chatty_min_calls")
    rows = _named(m.deps.filter(F.col("call_count") >= least), m.services, source="source_service_id", target="target_service_id")
    by_row = finding(rows, "CHATTY_SERVICE", "HIGH", F.col("source"), F.array("source", "target"), {"type": F.lit("dependency")}, says("CHATTY_SERVICE", "source", "target", "call_count"), call_count=F.col("call_count"))
    if m.clients is None:
        return by_row
    # Client types (run, service, type, calls) of services that no row has flagged.
    rest = m.clients.filter(F.col("calls") >= least).join(rows.select(*RUN, F.col("source").alias("service")), [*RUN, "service"], "left_anti")
    by_type = finding(rest, "CHATTY_SERVICE", "HIGH", F.col("service"), F.array("service"), {"type": F.col("type")}, says("CHATTY_CLIENT", "service", "type", "calls"), call_count=F.col("calls"))
    return by_row.unionByName(by_type)


def hardcoded(m: Model, config: dict | None = None) -> DataFrame:
    """From lines (run columns optional: lines of one run carry them)."""
    runs = [c for c in RUN if c in m.lines.columns]
    urls = hardcoded_urls(m.lines) if not runs else hardcoded_urls(m.lines.withColumn("service", F.struct(*runs, F.col("service").alias("name")))).select(F.col("service.project_id"), F.col("service.analysis_number"), F.col("service.name").alias("service"), "file", "line_no", "pos", "url")
    each = urls.groupBy(*runs, "service").agg(F.array_sort(F.collect_list(F.struct("file", "line_no", "pos", "url"))).alias("u"))
    text = says("HARDCODED_ENDPOINTS", "service", F.size("u"))
    return finding(each, "HARDCODED_ENDPOINTS", "MEDIUM", F.col("service"), F.array("service"), {"urls": F.array_join("u.url", ",")}, text)


def monolith(m: Model, config: dict | None = None) -> DataFrame:
    shared = shared_database(m).groupBy(*RUN).agg(F.count("*").alias("shared"))
    runs = graph.run_metrics(m.services, m.deps).join(shared, RUN, "left").na.fill(0, ["shared"]).filter("n_services >= 3")
    c, r = F.col("coupling"), F.col("connected_ratio")
    high, many, some = (option(config, "monolith_" + k) for k in ("coupling", "connected", "moderate"))
    found = runs.filter((c > high) | ((r > many) & (F.col("shared") > 0)) | ((r > many) & (c > some)))
    names = m.services.groupBy(*RUN).agg(F.sort_array(F.collect_list("name")).alias("names"))
    text = says("DISTRIBUTED_MONOLITH", c, "n_edges", F.col("n_services") * (F.col("n_services") - 1), r * 100, "shared")
    return finding(found.join(names, RUN), "DISTRIBUTED_MONOLITH", "CRITICAL", F.lit(None).cast("string"), F.col("names"), {"coupling": F.round(c, 6), "connected": F.round(r, 6), "shared": F.col("shared")}, text)


def api_versioning(m: Model, config: dict | None = None) -> DataFrame:
    versioned = F.coalesce(F.col("has_versioning"), F.lit(False)) | (F.trim(F.coalesce("api_version", F.lit(""))) != "")
    each = m.endpoints.groupBy(*RUN, F.col("microservice_id").alias("id")).agg(F.count("*").alias("total"), F.count_if(versioned).alias("versioned"), F.slice(F.array_distinct(F.sort_array(F.collect_set("controller_class"))), 1, 3).alias("controllers"))
    flagged = _named(each.filter("versioned = 0"), m.services, name="id")
    return finding(flagged, "API_VERSIONING_ABSENCE", "MEDIUM", F.col("name"), F.array("name"), {"endpoints": F.col("total"), "controllers": F.array_join("controllers", ",")}, says("API_VERSIONING_ABSENCE", "name", "total"))


def wrong_cuts(m: Model, config: dict | None = None) -> DataFrame:
    pairs = _named(graph.reciprocal(m.deps), m.services, first="a", second="b")
    return finding(pairs, "WRONG_CUTS", "HIGH", F.col("first"), F.array("first", "second"), {}, says("WRONG_CUTS", "first", "second"))


def esb(m: Model, config: dict | None = None) -> DataFrame:
    theta = option(config, "esb_mediator")
    d = graph.degrees(m.services, m.deps).join(graph.betweenness(m.services, m.deps), [*RUN, "id"])
    hub = ((F.col("caller_ratio") >= theta) & (F.col("callee_ratio") >= theta)) | (F.col("mediator_ratio") >= theta) | (F.col("bc_norm") >= theta)
    found = d.filter((F.col("n_services") >= 3) & (F.col("n_rows") > 0) & ~is_gateway(F.col("name")) & hub)
    e = graph.edges(m.deps)
    names = m.services.select(*RUN, "id", F.col("name").alias("other"))
    callers = e.withColumnsRenamed({"t": "id"}).join(names.withColumnRenamed("id", "s"), [*RUN, "s"]).groupBy(*RUN, "id").agg(F.sort_array(F.collect_set("other")).alias("caller_names"))
    callees = e.withColumnsRenamed({"s": "id"}).join(names.withColumnRenamed("id", "t"), [*RUN, "t"]).groupBy(*RUN, "id").agg(F.sort_array(F.collect_set("other")).alias("callee_names"))
    found = found.join(callers, [*RUN, "id"], "left").join(callees, [*RUN, "id"], "left")
    none = F.array().cast("array<string>")
    affected = F.array_distinct(F.concat(F.array("name"), F.coalesce("caller_names", none), F.coalesce("callee_names", none)))
    details = {"callers": F.col("callers"), "callees": F.col("callees"), "betweenness": F.round("bc_norm", 6), "mediator": F.round("mediator_ratio", 6)}
    through = F.col("in_degree") + F.col("out_degree")
    text = says("ESB_MISUSE", "name", "callers", F.col("caller_ratio") * 100, "callees", F.col("callee_ratio") * 100, through, "n_rows", F.col("bc_norm"))
    return finding(found, "ESB_MISUSE", "HIGH", F.col("name"), affected, details, text)


DETECTORS: dict[str, Callable[[Model, dict | None], DataFrame]] = {
    "CYCLIC_DEPENDENCY": cyclic, "SHARED_DATABASE": shared_database, "NANO_SERVICE": nano, "GOD_SERVICE": god, "CHATTY_SERVICE": chatty,
    "HARDCODED_ENDPOINTS": hardcoded, "DISTRIBUTED_MONOLITH": monolith, "API_VERSIONING_ABSENCE": api_versioning, "WRONG_CUTS": wrong_cuts, "ESB_MISUSE": esb,
}
_NEEDS = {"GOD_SERVICE": "classes", "HARDCODED_ENDPOINTS": "lines", "API_VERSIONING_ABSENCE": "endpoints"}


def detect(m: Model, config: dict | None = None, enabled: set[str] | None = None) -> DataFrame:
    """All findings of the enabled detectors whose tables the model has, with code. A detector that cannot be planned or
    fails on its rows leaves one DETECTOR_FAILED finding, and no more; the others' findings stay."""
    chosen = []
    if m.classes is not None and {"file", "line"} <= set(m.classes.columns):
        m = replace(m, too_much=god_classes(m, config))
    for kind, detector in DETECTORS.items():
        if (enabled is None or kind in enabled) and getattr(m, _NEEDS.get(kind, "services")) is not None:
            try:
                chosen.append(keep(evidence.attach(detector(m, config), m, kind)))
            except FAULTS as e:
                runs = m.services.select(*RUN).distinct()
                chosen.append(finding(runs, FAILED, "LOW", F.lit(None).cast("string"), F.array().cast("array<string>"), {"detector": F.lit(kind)}, truncate(F.lit(f"{kind}: {type(e).__name__}: {str(e)[:200]}"), 300)))
    if not chosen:
        return finding(m.services.limit(0), "", "", F.lit(None).cast("string"), F.array().cast("array<string>"), {}, F.lit(""))
    out = chosen[0]
    for f in chosen[1:]:
        out = out.unionByName(f)
    return out
