"""Code that findings carry: places first, no more of them than a finding shows, and then the lines around each.

Places of a finding are ranked where they lie and cut before they move, so a
service with any number of places brings a few rows to its finding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lines import hardcoded_urls, main_class
from ..functions.text import class_file
from ..schema import RUN

SNIPPET = "struct<file:string,start_line:int,end_line:int,highlight_line:int,code:string>"
#: Places that a finding shows, and lines around each.
SHOWN, AROUND = 5, 3
_PLACE = ["service", "rank", "file", "line", "k", "code"]
_FILES = "src/main/java/"
# Marks of controllers, names of configuration files in the order in which they are asked, and the word that marks a database.
CONTROLLER = "@RestController|@Controller|@RequestMapping"
CONFIG_FILES = ["application.yml", "application.yaml", "application.properties"]
DATABASE = "datasource"


def _with_service(lines: DataFrame) -> DataFrame:
    """Lines whose service is a struct of run and name, so that scans of one run do for all."""
    return lines.withColumn("service", F.struct(*RUN, F.col("service").alias("name")))


def _of_run(df: DataFrame, *columns) -> DataFrame:
    return df.select("service.project_id", "service.analysis_number", F.col("service.name").alias("service"), *columns)


def _place(rank: Column, file, line, k: Column, code: Column | None = None) -> list[Column]:
    return [rank.alias("rank"), F.col(file).alias("file") if isinstance(file, str) else file.alias("file"), line.cast("int").alias("line"), k.cast("int").alias("k"), (F.lit(None).cast("string") if code is None else code).alias("code")]


def first(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first `n` rows of each key by rank and file; more never leave the task in which they lie."""
    order = Window.partitionBy(*keys).orderBy("rank", "file", "line")
    return df.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n).drop("_n")


# -- places -----------------------------------------------------------------------------


def calls(deps: DataFrame, services: DataFrame) -> DataFrame:
    """(run, service, other, id, file, line, code): the last call of each service to each other that names a file."""
    line = F.col("evidence_line") if "evidence_line" in deps.columns else F.lit(None)
    told = F.struct(F.col("evidence_file").alias("file"), line.cast("int").alias("line"), F.col("evidence_code").alias("code"), "id")
    last = deps.filter("evidence_file is not null").groupBy(*RUN, "source_service_id", "target_service_id").agg(F.max_by(told, "id").alias("e"))
    names = services.select(*RUN, "id", "name")
    caller = names.select(*RUN, F.col("id").alias("source_service_id"), F.col("name").alias("service"))
    called = names.select(*RUN, F.col("id").alias("target_service_id"), F.col("name").alias("other"))
    return last.join(caller, [*RUN, "source_service_id"]).join(called, [*RUN, "target_service_id"]).select(*RUN, "service", "other", "e.id", "e.file", "e.line", "e.code")


def _of_calls(found: DataFrame, m, kind: str) -> DataFrame:
    """Calls that a finding speaks of: within its group, from its service, from and to its service, or all of the run."""
    e = calls(m.deps, m.services)
    both = F.array_contains("affected", F.col("service")) & F.array_contains("affected", F.col("other"))
    if kind == "DISTRIBUTED_MONOLITH":
        joined, rank = found.join(e, RUN), F.struct(F.lit("").alias("a"), F.lit("").alias("b"), F.col("id").alias("c"))
    elif kind == "ESB_MISUSE":
        # Incoming calls before outgoing ones.
        into, out = found.join(e.withColumn("primary_service", F.col("other")), [*RUN, "primary_service"]), found.join(e.withColumn("primary_service", F.col("service")), [*RUN, "primary_service"])
        joined = into.withColumn("_in", F.lit("0")).unionByName(out.withColumn("_in", F.lit("1")))
        rank = F.struct(F.col("_in").alias("a"), F.lit("").alias("b"), F.col("id").alias("c"))
    elif kind == "CHATTY_SERVICE":
        joined = found.filter("size(affected) > 1").join(e.withColumn("primary_service", F.col("service")), [*RUN, "primary_service"]).filter(both)
        rank = F.struct(F.lit("").alias("a"), F.lit("").alias("b"), F.col("id").alias("c"))
    else:
        joined = found.withColumn("service", F.explode("affected")).join(e, [*RUN, "service"]).filter(both)
        rank = F.struct(F.col("service").alias("a"), F.col("other").alias("b"), F.col("id").alias("c"))
    return joined.select(*RUN, "_f", "service", *_place(rank, "file", F.coalesce("line", F.lit(0)), F.lit(AROUND), F.col("code")))


def _no_rank(*parts: Column) -> Column:
    a, b, c = [*parts, *[F.lit("")] * 3][:3]
    return F.struct(a.cast("string").alias("a"), b.cast("string").alias("b"), F.lit(0).cast("long").alias("c"))


def _mains(m) -> DataFrame:
    """Line 1 of the main class, or of the first file, of each service."""
    return _of_run(main_class(_with_service(m.lines)), *_place(_no_rank(), "file", F.lit(1), F.lit(15)))


def _urls(m) -> DataFrame:
    """Every fixed address."""
    found = hardcoded_urls(_with_service(m.lines))
    return _of_run(found, *_place(F.struct(F.col("file").alias("a"), F.lit("").alias("b"), (F.col("line_no").cast("long") * 100_000 + F.col("pos")).alias("c")), "file", F.col("line_no"), F.lit(AROUND)))


def _controllers(m) -> DataFrame:
    """For each of the first three controllers of a service, the first line with its mark, else its first line with more around it."""
    named = m.services.select(*RUN, F.col("id").alias("microservice_id"), F.col("name").alias("service"))
    held = m.endpoints.select(*RUN, "microservice_id", "controller_class").join(named, [*RUN, "microservice_id"]).select(*RUN, "service", F.col("controller_class").alias("c")).filter("c is not null").distinct()
    order = Window.partitionBy(*RUN, "service").orderBy("c")
    few = held.withColumn("_n", F.row_number().over(order)).filter("_n <= 3").withColumn("file", F.concat(F.lit(_FILES), class_file(F.col("c"))))
    marked = F.min(F.when(F.col("text").rlike(CONTROLLER), F.col("line_no"))).alias("hit")
    found = m.lines.join(few.select(*RUN, "service", "file", "c"), [*RUN, "service", "file"]).groupBy(*RUN, "service", "file", "c").agg(marked)
    return found.select(*RUN, "service", *_place(_no_rank(F.col("c")), "file", F.coalesce("hit", F.lit(1)), F.when(F.col("hit").isNull(), 10).otherwise(5)))


def _databases(m) -> DataFrame:
    """The first line of a service's first configuration file that speaks of a database, else its first line with more around it."""
    name = F.element_at(F.split("file", "/"), -1)
    asked = F.array_position(F.array(*[F.lit(x) for x in CONFIG_FILES]), name)
    held = m.config.filter(asked > 0).withColumn("_r", asked)
    hit = F.min(F.when(F.contains(F.lower("text"), F.lit(DATABASE)), F.col("line_no"))).alias("hit")
    found = held.groupBy(*RUN, "service", "_r", "file").agg(hit).groupBy(*RUN, "service").agg(F.min(F.struct("_r", "file", "hit")).alias("x"))
    return found.select(*RUN, "service", *_place(_no_rank(F.col("service")), F.col("x.file"), F.coalesce("x.hit", F.lit(1)), F.when(F.col("x.hit").isNull(), 10).otherwise(3)))


def _gods(m) -> DataFrame:
    """The declarations of classes that do too much."""
    return m.too_much.select(*RUN, "service", *_place(_no_rank(F.col("class")), "file", F.col("line"), F.lit(10)))


#: Places of the services of a finding, the table that they need, how many a finding shows (None: of each service as many as there are).
OF_SERVICES = {
    "NANO_SERVICE": (_mains, "lines", 1), "GOD_SERVICE": (_gods, "too_much", None), "HARDCODED_ENDPOINTS": (_urls, "lines", SHOWN),
    "API_VERSIONING_ABSENCE": (_controllers, "lines", 3), "SHARED_DATABASE": (_databases, "config", None),
}
OF_CALLS = {"CYCLIC_DEPENDENCY": SHOWN, "CHATTY_SERVICE": 1, "WRONG_CUTS": 2, "ESB_MISUSE": SHOWN, "DISTRIBUTED_MONOLITH": SHOWN}


# -- from places to code -------------------------------------------------------------------


def _code(places: DataFrame, lines: DataFrame | None) -> DataFrame:
    """`places` with `snippet`: the lines from k before to k after, or the place's own code where it has no line; else they go."""
    own = (F.col("line") < 1) & (F.trim(F.coalesce("code", F.lit(""))) != "")
    ends = F.col("line") + F.size(F.split("code", "\n")) - 1
    bare = places.filter(own).withColumn("snippet", F.struct("file", F.col("line").alias("start_line"), ends.alias("end_line"), F.col("line").alias("highlight_line"), F.col("code").alias("code")).cast(SNIPPET))
    if lines is None:
        return bare
    at = [*RUN, "service", "file"]
    wanted = places.filter("line >= 1").select("_f", *at, "rank", "line", "k", F.explode(F.sequence(F.col("line") - F.col("k"), F.col("line") + F.col("k"))).alias("line_no"))
    held = wanted.join(lines.select(*at, "line_no", "text"), [*at, "line_no"]).groupBy("_f", *at, "rank", "line", "k").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("r"))
    shape = F.struct("file", F.col("r")[0]["line_no"].alias("start_line"), F.element_at("r", -1)["line_no"].alias("end_line"), F.col("line").alias("highlight_line"), F.array_join("r.text", "\n").alias("code")).cast(SNIPPET)
    # Where lines are not to be had, as in ready-made tables, the code that came with the place stands for them.
    read = held.select("_f", *at, "rank", "line", "k", shape.alias("snippet"))
    kept = places.filter("line >= 1").join(read, ["_f", *at, "rank", "line", "k"], "left")
    told = F.when(F.trim(F.coalesce("code", F.lit(""))) != "", F.struct("file", F.col("line").alias("start_line"), ends.alias("end_line"), F.col("line").alias("highlight_line"), F.col("code").alias("code")).cast(SNIPPET))
    return bare.unionByName(kept.withColumn("snippet", F.coalesce("snippet", told)).filter("snippet is not null").select(*bare.columns))


def attach(found: DataFrame, m, kind: str) -> DataFrame:
    """`found`, findings of one `kind`, with the code that the model's tables hold for them; null where there is none."""
    needs = OF_SERVICES.get(kind, (None, "deps", None))[1]
    if getattr(m, needs, None) is None or kind in OF_CALLS and "evidence_file" not in m.deps.columns:
        return found
    each = found.drop("snippets").withColumn("_f", F.xxhash64("pattern_type", "primary_service", "affected", "description"))
    slim = each.select(*RUN, "_f", "primary_service", "affected")
    if kind in OF_CALLS:
        places, n = _of_calls(slim, m, kind), OF_CALLS[kind]
    else:
        make, _, n = OF_SERVICES[kind]
        of_service = make(m)
        if n is not None:
            of_service = first(of_service, [*RUN, "service"], n)
        places = slim.withColumn("service", F.explode("affected")).select(*RUN, "_f", "service").join(of_service, [*RUN, "service"])
    if n is not None:
        places = first(places, [*RUN, "_f"], n)
    lines = m.config if kind == "SHARED_DATABASE" else m.lines
    pieces = _code(places.select(*RUN, "_f", *_PLACE), lines)
    held = pieces.groupBy(*RUN, "_f").agg(F.array_sort(F.collect_list(F.struct("rank", "file", "line", "snippet"))).alias("_s"))
    return each.join(held, [*RUN, "_f"], "left").withColumn("snippets", F.transform("_s", lambda x: x["snippet"])).drop("_f", "_s").select(*found.columns)


def json_columns(found: DataFrame) -> DataFrame:
    """`found` with lists and details as JSON text, as they are stored; code is null where there is none."""
    shown = F.transform(F.filter("snippets", lambda x: x.isNotNull()), lambda x: F.struct(x["file"].alias("file"), x["start_line"].alias("startLine"), x["end_line"].alias("endLine"), x["highlight_line"].alias("highlightLine"), x["code"].alias("snippet")))
    return found.withColumns({
        "affected_services_json": F.coalesce(F.to_json("affected"), F.lit("[]")), "details_json": F.to_json("details"),
        "code_snippets_json": F.when(F.size(shown) > 0, F.to_json(shown)),
    }).drop("affected", "details", "snippets")
