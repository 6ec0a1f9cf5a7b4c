"""Scalar functions on strings, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide what counts as a URL, a version or a literal.
URL = r"(?i)(https?://[\w.\-:]+[/\w.\-?=&#%]*|(?:localhost|127\.0\.0\.1|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}):\d{2,5}(?:[/\w.\-?=&#%]*)?)"
LITERAL = r"""\\.|("(?:\\.|[^"\\])*|'(?:\\.|[^'\\])*)(?:["']|\\?$)|\\$"""
VERSION = r"/v(\d+)([/.]|$)"
SUFFIX = r"-(service|svc|ms|api|server|app)$"
GATEWAY = "gateway|apigateway|edge|zuul|proxy|bff|ingress|router"


def truncate(s: Column, n: int) -> Column:
    return F.when(F.length(s) > n, F.concat(F.left(s, F.lit(n)), F.lit("..."))).otherwise(s)


def strip(s: Column) -> Column:
    """Without characters up to U+0020 at both ends, tabs included."""
    return F.regexp_replace(s, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def resolve_defaults(s: Column) -> Column:
    """${name:default} gives the default, ${name} nothing."""
    return F.regexp_replace(F.regexp_replace(s, r"\$\{[^:}]+:([^}]+)\}", "$1"), r"\$\{[^}]+\}", "")


def resolve_placeholder(s: Column, value: Column) -> Column:
    """The first placeholder of `s`: its configured `value`, its default, `s` itself if that is a URL, or null."""
    default = F.regexp_extract(s, r"\$\{([^:}]+)(?::([^}]*))?\}", 2)
    held = F.regexp_extract(s, r"\$\{([^:}]+)(?::([^}]*))?\}", 1) != ""
    own = F.when(s.rlike("^https?://"), s)
    return F.when(held & (F.trim(value) != ""), resolve_defaults(value)).when(held & (F.trim(default) != ""), default).otherwise(own)


def placeholder_key(s: Column) -> Column:
    return F.regexp_extract(s, r"\$\{([^:}]+)(?::([^}]*))?\}", 1)


def database_name(url: Column) -> Column:
    """What stands between the last slash and a question mark; null if nothing does."""
    return F.nullif(F.regexp_extract(url, r"^.+/([^/?]+)(\?.*)?$", 1), F.lit(""))


def normalize_service(s: Column) -> Column:
    bare = strip(F.lower(F.regexp_replace(s, "^https?://", "")))
    return F.regexp_replace(F.regexp_replace(bare, "^([^:]+):.*$", "$1"), "^([^/]+)/.*$", "$1")


def service_of_url(url: Column) -> Column:
    """Host of `url` as a service name; localhost:port for local hosts; null if there is none."""
    rest = F.regexp_replace(F.regexp_replace(url, "^https?://", ""), "^([^/]+)/.*$", "$1")
    host, port = F.substring_index(rest, ":", 1), F.regexp_extract(rest, r"^[^:]*:(\d+)(:|$)", 1)
    local = (host == "localhost") | host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    return F.when((host == "") | (host == "0.0.0.0"), None).when(local, F.when(port != "", F.concat(F.lit("localhost:"), port))).otherwise(normalize_service(host))


def port_of(target: Column) -> Column:
    return F.nullif(F.regexp_extract(target, r":(\d{4,5})(/[^:]*)?$", 1), F.lit("")).cast("int")


def normalize_path(path: Column) -> Column:
    whole = F.when(F.coalesce(path, F.lit("")) == "", "/").when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.regexp_replace(whole, "//+", "/")


def path_version(path: Column) -> Column:
    n = F.regexp_extract(path, VERSION, 1)
    return F.when(n != "", F.concat(F.lit("v"), n))


def http_method(text: Column) -> Column:
    out = F.lit("GET")
    for name in ["OPTIONS", "HEAD", "PATCH", "DELETE", "PUT", "POST"]:  # the last test made here is the first to hold
        out = F.when(F.contains(text, F.lit(name)), name).otherwise(out)
    return out


def annotation_version(text: Column) -> Column:
    """How an annotation names a version beside the path: header or query."""
    low = F.lower(text)
    header = F.contains(low, F.lit("headers")) & text.rlike(r"(?i)(x-api-version|api-version|accept-version|api\.version)")
    media = low.rlike("produces|consumes") & text.rlike(r"(?i)vnd\.[\w.-]+\.v\d+")
    query = F.contains(low, F.lit("params")) & text.rlike(r"(?i)(^|[^a-z0-9_-])(version|api-version|api\.version|v)\s*=")
    return F.when(header | media, "header").when(query, "query")


def strip_suffix(name: Column) -> Column:
    return F.regexp_replace(name, SUFFIX, "")


def import_domain(qualified: Column) -> Column:
    return F.substring_index(qualified, ".", 2)


def class_file(qualified: Column) -> Column:
    return F.concat(F.replace(qualified, F.lit("."), F.lit("/")), F.lit(".java"))


def forward_slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def canonical_list(items: Column) -> Column:
    clean = F.filter(F.transform(items, lambda x: F.lower(strip(x))), lambda x: x.isNotNull() & (x != ""))
    return F.array_join(F.array_sort(clean), ",")


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("int")


def is_gateway(name: Column) -> Column:
    return F.lower(name).rlike(GATEWAY)


def literal_urls(line: Column) -> Column:
    """All URLs inside string literals of `line`."""
    bodies = F.regexp_extract_all(line, F.lit(LITERAL), F.lit(1))
    return F.flatten(F.transform(bodies, lambda b: F.regexp_extract_all(b, F.lit(URL), F.lit(1))))


def repository_name(url: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1), r"\.git$", "")


def source_type(url: Column) -> Column:
    host = F.substring_index(F.regexp_replace(url, "^https?://", ""), "/", 1)
    return F.when(F.contains(host, F.lit("gitlab")), "GITLAB").otherwise("GITHUB")
