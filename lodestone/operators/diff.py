"""Comparison of successive runs: previous run, multiset diff of findings, deltas, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ..functions.text import canonical_list, strip
from ..schema import RUN


def previous(runs: DataFrame, order: str = "analysis_number") -> DataFrame:
    """`runs` with previous_run, the run before it in its project."""
    w = Window.partitionBy("project_id").orderBy(order)
    return runs.withColumn("previous_run", F.lag("analysis_number").over(w))


def signature() -> Column:
    kind = F.col("pattern_type")
    held = lambda k: F.coalesce(F.try_element_at("details", F.lit(k)), F.lit(""))
    return (
        F.when(kind == "HARDCODED_ENDPOINTS", canonical_list(F.split(held("urls"), ",")))
        .when(kind == "GOD_SERVICE", canonical_list(F.split(held("classes"), ",")))
        .when(kind == "SHARED_DATABASE", F.lower(strip(F.coalesce("shared_database_url", F.lit("")))))
        .when(kind == "CHATTY_SERVICE", F.lower(held("type")))
        .when(kind == "CYCLIC_DEPENDENCY", F.coalesce(F.col("cycle_length").cast("string"), F.lit("")))
        .otherwise("")
    )


def issue_key() -> Column:
    primary = F.lower(strip(F.coalesce("primary_service", F.lit(""))))
    return F.concat(F.col("pattern_type"), F.lit("|primary="), primary, F.lit("|affected="), canonical_list(F.col("affected")), F.lit("|signature="), signature())


def multiset(keyed: DataFrame, links: DataFrame) -> DataFrame:
    """(run, key, n_unchanged, n_new, n_resolved) of `keyed` (run, key) rows; `links` has (run, previous_run).
    Counts stand for the numbered occurrences, so a key with many findings is one row on each side."""
    n = keyed.groupBy(*RUN, "key").agg(F.count("*").alias("n"))
    linked = links.filter("previous_run is not null").select(*RUN, "previous_run")
    now = n.join(linked, RUN).select(*RUN, "key", "n", F.lit(0).cast("long").alias("m"))
    then = n.withColumnRenamed("analysis_number", "previous_run").join(linked, ["project_id", "previous_run"]).select(*RUN, "key", F.lit(0).cast("long").alias("n"), F.col("n").alias("m"))
    both = now.unionByName(then).groupBy(*RUN, "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    return both.select(*RUN, "key", F.least("n", "m").alias("n_unchanged"), F.greatest(F.col("n") - F.col("m"), F.lit(0)).alias("n_new"), F.greatest(F.col("m") - F.col("n"), F.lit(0)).alias("n_resolved"))


def matched(findings: DataFrame, links: DataFrame, order: str = "finding_ord") -> DataFrame:
    """Each current or previous finding with its state; equal findings pair in their order, so surplus old ones are resolved."""
    w = Window.partitionBy(*RUN, "key").orderBy(order)
    numbered = findings.withColumn("rn", F.row_number().over(w)).select(*RUN, "key", "rn", order)
    linked = links.filter("previous_run is not null").select(*RUN, "previous_run")
    now = numbered.join(linked, RUN).select(*RUN, "key", "rn", F.col(order).alias("current"))
    then = numbered.withColumnRenamed("analysis_number", "previous_run").join(linked, ["project_id", "previous_run"]).select(*RUN, "key", "rn", F.col(order).alias("former"))
    joined = now.join(then, [*RUN, "key", "rn"], "full_outer")
    return joined.withColumn("state", F.when(F.col("current").isNull(), "resolved").when(F.col("former").isNull(), "new").otherwise("unchanged"))


def summary(delta: Column, resolved: Column, new: Column) -> Column:
    """One sentence on the change."""
    first = F.when(delta > 0, F.format_string("Score improved by %d", delta)).when(delta < 0, F.format_string("Score declined by %d", F.abs(delta))).otherwise("Score unchanged")
    return F.concat_ws("; ", first, F.when(resolved > 0, F.format_string("%d resolved", resolved)), F.when(new > 0, F.format_string("%d new", new)))


METRICS = ["health_score", "coupling_coefficient", "anti_patterns", "code_quality", "architecture", "service_sizing", "total_anti_patterns", "total_code_smells", "critical_issues", "high_issues", "medium_issues", "low_issues", "total_lines_of_code", "total_dependencies", "cycle_count", "services_analyzed"]


def history(results: DataFrame) -> DataFrame:
    """Runs, newest first in each project, with the change of each metric since the run before; first runs have null changes."""
    w = Window.partitionBy("project_id").orderBy("analysis_number")
    named = [c for c in METRICS if c in results.columns]
    former = {"previous_run": F.lag("analysis_number").over(w)} | ({"previous_grade": F.lag("grade").over(w)} if "grade" in results.columns else {})
    out = results.withColumns({f"{c}_delta": F.col(c) - F.lag(c).over(w) for c in named} | former)
    return out.withColumn("position", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("analysis_number"))))


def changes(findings: DataFrame, links: DataFrame) -> DataFrame:
    """(run, state, and the finding): every finding of a run as new or unchanged, and those of the run before that it lacks as
    resolved. Equal findings pair off in order; `findings` has the columns of one finding and a key."""
    columns = [c for c in findings.columns if c not in (*RUN, "key")]
    ordered = findings.withColumn("_order", F.xxhash64(*[F.to_json(c) if isinstance(findings.schema[c].dataType, MapType) else F.col(c) for c in columns]))
    w = Window.partitionBy(*RUN, "key").orderBy("_order")
    numbered = ordered.withColumn("rn", F.row_number().over(w)).select(*RUN, "key", "rn", F.struct(*columns).alias("f"))
    linked = links.filter("previous_run is not null").select(*RUN, "previous_run")
    now = numbered.join(linked.select(*RUN), RUN).withColumnRenamed("f", "current")
    then = numbered.withColumnRenamed("analysis_number", "previous_run").join(linked, ["project_id", "previous_run"]).select(*RUN, "key", "rn", F.col("f").alias("former"))
    both = now.join(then, [*RUN, "key", "rn"], "full_outer")
    state = F.when(F.col("current").isNull(), "resolved").when(F.col("former").isNull(), "new").otherwise("unchanged")
    return both.select(*RUN, state.alias("state"), "key", F.coalesce("current", "former").alias("f")).select(*RUN, "state", "key", "f.*")
