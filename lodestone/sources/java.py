"""Facts of Java sources: a tolerant reader of declarations, annotations and calls.

One row for each top-level type. Comments and literals are masked in place, so
positions stay true; members are found by matching braces, not by a grammar.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators.cohesion import tight_cohesion
from .stages import keep

ANNOTATION = "struct<name:string,text:string,value:string>"
#: A part of a joined text: a literal (lit), the name of a field or variable (ref), or anything else (other).
PART = "struct<kind:string,val:string>"
TYPE = (
    "path string, package string, name string, kind string, is_abstract boolean, line int, end_line int, imports array<string>, ctor_params int, "
    f"annotations array<{ANNOTATION}>, fields array<struct<name:string,type:string,is_static:boolean,annotations:array<{ANNOTATION}>>>, "
    f"methods array<struct<name:string,is_public:boolean,is_static:boolean,is_default:boolean,n_params:int,line:int,annotations:array<{ANNOTATION}>,used:array<string>>>, "
    f"calls array<struct<method:string,receiver:string,receiver_type:string,line:int,at:int,code:string,url:array<{PART}>>>, "
    f"defs array<struct<name:string,at:int,value:array<{PART}>>>"
)
# Methods and types that make a call a remote call, and marks of data classes.
REST_METHODS = ["getForObject", "getForEntity", "postForObject", "postForEntity", "exchange", "put", "delete", "patchForObject"]
CALL_METHODS = ["openConnection", "getForObject", "getForEntity", "postForObject", "postForEntity", "exchange", "patchForObject", "bodyToMono", "bodyToFlux"]
CLIENT_TYPES = ["RestTemplate", "WebClient", "HttpURLConnection", "RestClient", "FeignClient", "OkHttpClient", "CloseableHttpClient", "HttpClient", "AsyncHttpClient"]
CLIENT_WORDS = "client|api|feign|rest|http|proxy|remote|gateway"
MAPPINGS = ["GetMapping", "PostMapping", "PutMapping", "DeleteMapping", "PatchMapping", "RequestMapping"]
DATA_ANNOTATIONS = ["Entity", "Table", "Document", "MappedSuperclass", "Embeddable", "Data", "Value", "Builder", "JsonIgnoreProperties", "XmlRootElement", "XmlType", "Generated", "AutoValue"]
DATA_SUFFIXES = "dto|entity|model|request|response|event|message|command|query|vo|pojo|bean|record|config|properties|settings|options|params|result|payload|wrapper"

_NOISE = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'', re.S)
_DECLARED = re.compile(r"\b(class|interface|enum|record)\s+(\w+)")
_MARK = re.compile(r"@(\w+(?:\.\w+)*)")
_CALL = re.compile(r"\b(\w+)\s*\(")
_DEFINED = re.compile(r"\b(?:String|var|URI|URL)\s+(\w+)\s*=(?!=)|(?<=[;{}])\s*(?:this\s*\.\s*)?(\w+)\s*=(?!=)")


def mask(text: str) -> tuple[str, str]:
    """`text` without comments, and also without what literals hold; both of the same length."""
    blank = lambda s: re.sub(r"[^\n]", " ", s)
    bare = _NOISE.sub(lambda m: m[0] if m[0][0] in "\"'" else blank(m[0]), text)
    return bare, _NOISE.sub(lambda m: m[0][0] + blank(m[0][1:-1]) + m[0][-1] if m[0][0] in "\"'" else blank(m[0]), text)


def closing(masked: str, at: int, pair: str = "{}") -> int:
    """Place of the bracket that closes the one at `at`, or the end."""
    depth = 0
    for i in range(at, len(masked)):
        if masked[i] == pair[0]:
            depth += 1
        elif masked[i] == pair[1]:
            depth -= 1
            if not depth:
                return i
    return len(masked) - 1


def literal(expr: str) -> str | None:
    """Text of one or more joined string literals."""
    parts = re.findall(r'"((?:\\.|[^"\\])*)"', expr)
    return "".join(parts) if parts and not re.sub(r'"(?:\\.|[^"\\])*"|[\s+]', "", expr) else None


def annotations(bare: str, masked: str) -> tuple[list[dict], str]:
    """Annotations in a declaration's head, and the head without them. value: first of value, path, or the bare argument."""
    found, rest, at = [], [], 0
    for m in _MARK.finditer(masked):
        if m.start() < at or m[1] == "interface":
            continue
        end = m.end()
        body = ""
        if (p := re.compile(r"\s*\(").match(masked, end)) is not None:
            close = closing(masked, p.end() - 1, "()")
            body, end = bare[p.end() : close], close + 1
        rest.append(bare[at : m.start()])
        at = end
        value = None
        for key in ("value", "path", ""):
            pattern = rf"(?:^|[,\s]){key}\s*=\s*\{{?\s*" if key else r"^\s*\{?\s*"
            if (k := re.search(pattern + r'((?:"(?:\\.|[^"\\])*"\s*\+?\s*)+)', body)) is not None:
                value = literal(k[1].rstrip().rstrip("+"))
                break
        found.append({"name": m[1].rpartition(".")[2], "text": bare[m.start() : end], "value": value})
    rest.append(bare[at:])
    return found, " ".join(rest)


def _split_args(bare: str, masked: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(masked):
        depth += (c in "([{<") - (c in ")]}>")
        if c == "," and depth <= 0:
            out.append(bare[at:i])
            at = i + 1
    return [x.strip() for x in [*out, bare[at:]] if x.strip()]


def _parts(expr: str, masked: str) -> list[dict]:
    """What a text is joined from, in order."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(masked + "+"):
        depth += (c in "([{") - (c in ")]}")
        if c != "+" or depth > 0:
            continue
        part, at = expr[at:i].strip(), i + 1
        if (text := literal(part)) is not None:
            out.append({"kind": "lit", "val": text})
        elif (name := re.fullmatch(r"(?:this\s*\.\s*)?([A-Za-z_$][\w$]*)", part)) is not None:
            out.append({"kind": "ref", "val": name[1]})
        elif part:
            out.append({"kind": "other", "val": part[:200]})
    return out


def _defs(bare: str, masked: str) -> list[dict]:
    """Texts that fields and variables are set to."""
    out = []
    for m in _DEFINED.finditer(masked):
        end = masked.find(";", m.end())
        if end < 0:
            break
        value = _parts(bare[m.end() : end], masked[m.end() : end])
        if value and value[0]["kind"] != "other":
            out.append({"name": m[1] or m[2], "at": m.start(1) if m[1] else m.start(2), "value": value})
    return out


def read_types(path: str, text: str) -> list[dict]:
    bare, masked = mask(text)
    line = lambda i: text.count("\n", 0, i) + 1
    package = (re.search(r"^\s*package\s+([\w.]+)", masked, re.M) or [None, ""])[1]
    imports = re.findall(r"^\s*import\s+(?:static\s+)?([\w.]+)", masked, re.M)
    out, at = [], 0
    while (m := _DECLARED.search(masked, at)) is not None:
        open_ = masked.find("{", m.end())
        if open_ < 0:
            break
        end = closing(masked, open_)
        begin = max(masked.rfind(c, at, m.start()) for c in ";}") + 1 or at
        marks, head = annotations(bare[begin : m.start()], masked[begin : m.start()])
        kind = {"path": path, "package": package, "name": m[2], "kind": "annotation" if masked[m.start() - 1 : m.start()] == "@" else m[1], "is_abstract": bool(re.search(r"\babstract\b", head)), "line": line(m.start()), "end_line": line(end), "imports": imports, "ctor_params": 0, "annotations": marks, "fields": [], "methods": [], "calls": []}
        bodies = []
        i = start = open_ + 1
        while i < end:
            if masked[i] == "(":
                i = closing(masked, i, "()")
            elif masked[i] in ";{":
                stop = closing(masked, i) if masked[i] == "{" else i
                own, head = annotations(bare[start:i], masked[start:i])
                _member(kind, own, head, bare[i + 1 : stop] if masked[i] == "{" else None, line(start + len(bare[start:i]) - len(bare[start:i].lstrip())), bodies)
                i, start = stop, stop + 1
            i += 1
        names = {f["name"] for f in kind["fields"] if not f["is_static"]}
        for method, body in bodies:
            method["used"] = sorted(names & set(re.findall(r"\w+", mask(body or "")[1])))
        types = {f["name"]: f["type"] for f in kind["fields"]}
        own_line = lambda k, o=open_: line(o + k)
        kind["calls"] = _calls(bare[open_:end], masked[open_:end], types, own_line)
        kind["defs"] = _defs(bare[open_:end], masked[open_:end])
        out.append(kind)
        at = end + 1
    return out


def _member(kind: dict, marks: list[dict], head: str, body: str | None, at: int, bodies: list) -> None:
    words = head.split("=")[0]
    modifiers = set(re.findall(r"\b(public|private|protected|static|default|abstract|final)\b", words))
    if (m := re.search(r"(\w+)\s*\((.*)\)", head, re.S)) is not None and "=" not in head[: m.start()]:
        params = _split_args(m[2], mask(m[2])[1])
        if m[1] == kind["name"]:
            kind["ctor_params"] = max(kind["ctor_params"], len(params))
            return
        public = "public" in modifiers or kind["kind"] == "interface" and "private" not in modifiers
        method = {"name": m[1], "is_public": public, "is_static": "static" in modifiers, "is_default": "default" in modifiers, "n_params": len(params), "line": at, "annotations": marks, "used": []}
        kind["methods"].append(method)
        bodies.append((method, body))
    elif body is None or "=" in head:
        clean = re.sub(r"\b(public|private|protected|static|final|volatile|transient)\b", " ", words)
        if (f := re.match(r"\s*([\w.]+(?:\s*<.*>)?(?:\[\])*)\s+(\w+(?:\s*,\s*\w+)*)\s*$", clean, re.S)) is not None and f[1] not in ("return", "package", "import"):
            for name in re.split(r"\s*,\s*", f[2]):
                kind["fields"].append({"name": name, "type": f[1].rpartition(".")[2], "is_static": "static" in modifiers, "annotations": marks})


def _calls(bare: str, masked: str, types: dict, line) -> list[dict]:
    out = []
    for m in _CALL.finditer(masked):
        method = m[1]
        if method not in REST_METHODS and method not in CALL_METHODS and method not in ("uri", "create", "baseUrl"):
            continue
        close = closing(masked, m.end() - 1, "()")
        args = _split_args(bare[m.end() : close], masked[m.end() : close])
        chain = re.search(r"(?:\w+\s*(?:\([^()]*\))?\s*\.\s*)*$", masked[max(0, m.start() - 400) : m.start()])[0]
        begin = m.start() - len(chain)
        links = [x for x in re.findall(r"\w+", re.sub(r"\([^()]*\)", "", chain)) if x != "this"]
        # A builder chain is known by its root, any other call by what stands before the dot.
        receiver = (links[0] if method in ("uri", "bodyToMono", "bodyToFlux", "baseUrl") else links[-1]) if links else None
        declared = types.get(receiver) or ((re.search(rf"\b([A-Z]\w*)(?:<[^>]*>)?\s+{re.escape(receiver)}\s*[=;,)]", masked) or [None, None])[1] if receiver else None)
        if declared is None and receiver and receiver[0].isupper():
            declared = receiver
        out.append({"method": method, "receiver": receiver, "receiver_type": declared, "line": line(begin), "at": begin, "code": bare[begin : close + 1][:200], "url": _parts(args[0], mask(args[0])[1]) if args else []})
    return out


def java_types(files: DataFrame) -> DataFrame:
    """Facts of (service, path, text) or (path, text) files; a file that can't be read has none."""
    more = "service string, " if "service" in files.columns else ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in (more + "path string, package, name, kind, is_abstract, line, end_line, imports, ctor_params, annotations, fields, methods, calls, defs").split(", ") if c]
        for b in batches:
            rows = []
            for k in range(len(b)):
                found = read_types(b.path.iloc[k], b.text.iloc[k] or "")
                rows += [({"service": b.service.iloc[k]} if more else {}) | f for f in found]
            yield pd.DataFrame(rows, columns=names)

    return files.select(*(["service"] if more else []), "path", "text").mapInPandas(run, more + TYPE)


# -- from facts to the model ----------------------------------------------------


def _has(marks: Column, names: list[str]) -> Column:
    return F.exists(marks, lambda a: a["name"].isin(names))


def endpoints(types: DataFrame) -> DataFrame:
    """(service, path, http_method, controller_class, method_name, api_version, has_versioning): the first mapping annotation of each controller method."""
    held = types.filter(_has(F.col("annotations"), ["RestController", "Controller"]))
    base = F.get(F.filter("annotations", lambda a: a["name"] == "RequestMapping"), F.lit(0))["value"]
    each = held.select("service", "annotations", F.concat_ws(".", F.nullif("package", F.lit("")), "name").alias("controller_class"), F.coalesce(base, F.lit("")).alias("base"), F.explode("methods").alias("m"))
    each = each.withColumn("a", F.get(F.filter("m.annotations", lambda a: a["name"].isin(MAPPINGS)), F.lit(0))).filter("a is not null")
    verb = F.when(F.col("a.name") == "RequestMapping", t.http_method(F.col("a.text"))).otherwise(F.upper(F.regexp_replace("a.name", "Mapping$", "")))
    path = t.normalize_path(F.concat("base", F.coalesce("a.value", F.lit(""))))
    marks = F.filter(F.transform(F.concat("annotations", "m.annotations"), lambda a: t.annotation_version(a["text"])), lambda v: v.isNotNull())
    out = each.select("service", path.alias("path"), verb.alias("http_method"), "controller_class", F.col("m.name").alias("method_name"), F.coalesce(t.path_version(path), F.get(marks, F.lit(0))).alias("api_version"))
    return out.withColumn("has_versioning", F.col("api_version").isNotNull())


#: Rounds of following names; each doubles the length of the chains that are followed.
FOLLOW_ROUNDS = 12


def texts(uses: DataFrame, values: DataFrame, defs: DataFrame | None = None) -> DataFrame:
    """`uses` (service, path, type, at, parts, ...) with `text`, null if it can't be told. A text begins with a literal or a name that
    `values` (service, name, value) knows, and goes on with the literals among its other parts. With `defs` (service, path, type, name,
    at, value), other names stand for what they were last set to before the use, or, as fields, anywhere in their type; names that lead
    to names are followed by joining the table with itself, which doubles the reach of each chain in every round."""
    head, scope = F.get("parts", F.lit(0)), ["service", "path", "type"]
    tail = F.array_join(F.transform(F.filter(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), lambda x: x["kind"] == "lit"), lambda x: x["val"]), "")
    known = values.select("service", F.col("name").alias("_name"), F.col("value").alias("_value"))

    def begun(df: DataFrame) -> DataFrame:
        named = df.withColumns({"_name": F.when(head["kind"] == "ref", head["val"]), "_tail": tail}).join(known, ["service", "_name"], "left")
        first = F.when(head["kind"] == "lit", head["val"]).otherwise(F.col("_value"))
        return named.withColumn("text", F.concat(first, "_tail")).drop("_value")

    found = begun(uses)
    if defs is None:
        return found.drop("_name", "_tail")
    found = keep(found.withColumn("_id", F.monotonically_increasing_id()))
    made = defs.select(*scope, "at", F.col("value").alias("parts"), F.col("name").alias("own"))
    nodes = keep(begun(made).withColumn("_id", F.monotonically_increasing_id()))
    ends = nodes.select(*scope, F.col("own").alias("_name"), F.col("at").alias("_at"), F.col("_id").alias("_to"))

    def linked(df: DataFrame) -> DataFrame:
        """The definition that each name without a text stands for: the last before it, else the first of its type; not its own."""
        before = F.when(F.col("_at") < F.col("at"), F.struct(F.lit(0).alias("a"), (-F.col("_at")).alias("b")))
        near = before.otherwise(F.struct(F.lit(1).alias("a"), F.col("_at").alias("b")))
        open_ = df.filter("text is null and _name is not null").join(ends, [*scope, "_name"]).filter(F.col("_to") != F.col("_id") if "own" in df.columns else F.lit(True))
        return df.join(open_.groupBy("_id").agg(F.min_by("_to", near).alias("_to")), "_id", "left")

    chain = keep(linked(nodes).select("_id", "text", "_tail", "_to"))
    for _ in range(FOLLOW_ROUNDS):
        if chain.filter("text is null and _to is not null").isEmpty():
            break
        ahead = chain.select(F.col("_id").alias("_to"), F.col("text").alias("_text"), F.col("_tail").alias("_more"), F.col("_to").alias("_next"))
        text = F.coalesce("text", F.concat("_text", "_tail"))
        chain = keep(chain.join(ahead, "_to", "left").select("_id", text.alias("text"), F.when(text.isNull(), F.concat("_more", "_tail")).otherwise(F.col("_tail")).alias("_tail"), F.when(text.isNull(), F.col("_next")).alias("_to")))
    given = chain.select(F.col("_id").alias("_to"), F.col("text").alias("_text"))
    out = linked(found).join(given, "_to", "left").withColumn("text", F.coalesce("text", F.concat("_text", "_tail")))
    return out.drop("_name", "_tail", "_id", "_to", "_text")


def raw_calls(types: DataFrame, props: DataFrame | None = None, follow: bool = False) -> DataFrame:
    """(service, target, ord, dependency_type, file, line, code) of Feign clients, RestTemplate and WebClient calls.
    `props`: (service, key, value) for placeholders. With `follow`, addresses are also sought behind variables and fields that
    other texts are set to; without it, only behind names of configured fields."""
    spark = types.sparkSession
    props = spark.createDataFrame([], "service string, key string, value string") if props is None else props.select("service", "key", "value")
    keyed = props.groupBy("service", "key").agg(F.max("value").alias("_v"))

    def placed(df: DataFrame, col: str) -> DataFrame:
        """`col` with its placeholder looked up in the service's configuration."""
        df = df.withColumn("_k", t.placeholder_key(F.col(col)))
        df = df.join(keyed.withColumnRenamed("key", "_k"), ["service", "_k"], "left")
        return df.withColumn(col, F.when(F.col("_k") == "", F.col(col)).otherwise(t.resolve_placeholder(F.col(col), F.col("_v")))).drop("_k", "_v")

    mark = F.get(F.filter("annotations", lambda a: a["name"] == "FeignClient"), F.lit(0))
    named = lambda k: F.nullif(F.regexp_extract("a.text", rf'\b{k}\s*=\s*"([^"]*)"', 1), F.lit(""))
    own = F.nullif(F.regexp_extract("a.text", r'\(\s*"([^"]*)"\s*\)', 1), F.lit(""))
    real = F.filter("methods", lambda m: ~m["is_default"] & ~m["is_static"])
    times = F.when(F.size("methods") == 0, 1).otherwise(F.size(real))
    feign = types.filter("kind = 'interface'").withColumn("a", mark).filter("a is not null").withColumn("n", times).filter("n > 0")
    feign = feign.select("service", F.coalesce(named("name"), named("value"), own, named("url")).alias("target"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"), F.lit("FEIGN_CLIENT").alias("dependency_type"), F.col("path").alias("file"), F.col("line"), F.col("a.text").alias("code"))
    feign = placed(feign, "target").withColumn("target", t.normalize_service(F.col("target")))

    values = types.select("service", "path", F.explode("fields").alias("f")).withColumn("a", F.get(F.filter("f.annotations", lambda a: a["name"] == "Value"), F.lit(0))).filter("a is not null")
    values = placed(values.select("service", "path", F.col("f.name").alias("name"), F.col("a.value").alias("value")), "value").groupBy("service", "name").agg(F.max_by("value", "path").alias("value"))
    calls = types.select("service", "path", F.col("name").alias("type"), F.posexplode("calls").alias("pos", "c"))
    rest = F.col("c.method").isin(REST_METHODS) & (F.col("c.receiver_type").isNull() | (F.col("c.receiver_type") == "RestTemplate"))
    web = (F.col("c.method").isin("uri", "create", "baseUrl")) & F.col("c.receiver_type").startswith("WebClient")
    calls = calls.withColumn("dependency_type", F.when(rest, "REST_TEMPLATE").when(web, "WEB_CLIENT")).filter("dependency_type is not null")
    uses = calls.select("service", "path", "type", "pos", "dependency_type", F.col("c.line").alias("line"), F.col("c.at").alias("at"), F.col("c.code").alias("code"), F.col("c.url").alias("parts"))
    set_to = types.select("service", "path", F.col("name").alias("type"), F.inline("defs").alias("name", "at", "value")) if follow else None
    whole = texts(uses, values, set_to)
    http = whole.select("service", t.service_of_url(F.col("text")).alias("target"), F.col("pos").alias("i"), "dependency_type", F.col("path").alias("file"), "line", "code")
    found = feign.select(*http.columns).unionByName(http).filter("target is not null and target <> ''")
    kind = F.when(F.col("dependency_type") == "FEIGN_CLIENT", 0).when(F.col("dependency_type") == "REST_TEMPLATE", 1).otherwise(2)
    return found.withColumn("ord", F.struct(kind.alias("kind"), "file", "line", "i")).drop("i")


def class_metrics(types: DataFrame) -> DataFrame:
    """(service, class, fields, public_methods, lines_of_code, domains, ctor_params, tcc, is_data_class) of concrete classes."""
    public = F.filter("methods", lambda m: m["is_public"])
    getters = F.size(F.filter(public, lambda m: m["name"].rlike("^(get|set|is)") & (m["n_params"] <= 1)))
    domains = F.array_distinct(F.filter(F.transform("imports", t.import_domain), lambda d: d != "java.lang"))
    df = types.filter("kind = 'class' and not is_abstract and name <> ''").withColumn("p", public)
    # A path may declare several types of one name, and a type several methods of one name.
    keys = ["service", "path", "line"]
    each = df.select(*keys, F.posexplode("p").alias("method", "m")).select(*keys, "method", F.col("m.used").alias("fields"))
    df = df.join(tight_cohesion(each, keys), keys, "left").na.fill(-1.0, ["tcc"])
    n = F.size("p")
    data = _has(F.col("annotations"), DATA_ANNOTATIONS) | F.lower("name").rlike(f"({DATA_SUFFIXES})$") | ((n >= 4) & (getters / F.greatest(n, F.lit(1)) > 0.6))
    return df.select("service", F.concat_ws(".", F.nullif("package", F.lit("")), "name").alias("class"), F.size("fields").alias("fields"), n.alias("public_methods"), (F.col("end_line") - F.col("line") + 1).alias("lines_of_code"), F.size(domains).alias("domains"), "ctor_params", "tcc", data.alias("is_data_class"), F.col("path").alias("file"), "line")


def client_types(types: DataFrame) -> DataFrame:
    """(service, type, calls): what each type looks like as a client of other services."""
    http = MAPPINGS + ["RequestLine"]
    controller = _has(F.col("annotations"), ["Controller", "RestController", "RequestMapping"])
    feign = F.size(F.filter("methods", lambda m: ~m["is_default"]))
    mapped = F.size(F.filter("methods", lambda m: _has(m["annotations"], http)))
    sites = F.size(F.filter("calls", lambda c: c["method"].isin(CALL_METHODS) & F.coalesce(c["receiver_type"].isin(CLIENT_TYPES), F.lit(False))))
    n = (
        F.when((F.col("kind") == "interface") & _has(F.col("annotations"), ["FeignClient"]), feign)
        .when((F.col("kind") == "interface") & ~controller & F.lower("name").rlike(CLIENT_WORDS), mapped)
        .when((F.col("kind") == "class") & ~controller, sites)
    )
    return types.select("service", F.col("name").alias("type"), n.alias("calls")).filter("calls > 0")
