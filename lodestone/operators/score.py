"""Health score, grade and deductions of each run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import round_half_up
from ..schema import PENALTY, RUN, option

SIZING = ["NANO_SERVICE", "GOD_SERVICE"]
#: Of no weight: what is told of a detector that failed.
UNCOUNTED = "DETECTOR_FAILED"


def penalty(severity) -> "F.Column":
    out = F.lit(0)
    for k, v in PENALTY.items():
        out = F.when(severity == k, v).otherwise(out)
    return out


def by_type(findings: DataFrame) -> DataFrame:
    """(run, pattern_type, count, points) of the types that count as anti-patterns."""
    return findings.filter(~F.col("pattern_type").isin(SIZING)).groupBy(*RUN, "pattern_type").agg(F.count("*").alias("count"), F.sum(penalty(F.col("severity"))).alias("points"))


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("pattern_type") != UNCOUNTED).groupBy(*RUN).agg(F.count("*").alias("total_anti_patterns"), *[F.count_if(F.col("severity") == s).alias(f"{s.lower()}_issues") for s in PENALTY])


def grade(score) -> "F.Column":
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 65, "C").when(score >= 50, "D").otherwise("F")


def score(runs: DataFrame, findings: DataFrame, config: dict | None = None) -> DataFrame:
    """`runs` (run, smells, loc, coupling, cycles) with the four parts, health_score, grade and deductions."""
    findings = findings.filter(F.col("pattern_type") != UNCOUNTED)
    sums = findings.groupBy(*RUN).agg(
        F.sum(F.when(F.col("pattern_type").isin(SIZING), 0).otherwise(penalty(F.col("severity")))).alias("_points"),
        F.count_if(F.col("pattern_type") == "NANO_SERVICE").alias("_nano"),
        F.count_if(F.col("pattern_type") == "GOD_SERVICE").alias("_god"),
    )
    kinds = by_type(findings).groupBy(*RUN).agg(F.array_sort(F.collect_list(F.struct(F.col("pattern_type").alias("reason"), F.col("count").cast("long").alias("count"), F.col("points").cast("long").alias("points")))).alias("_kinds"))
    df = runs.join(sums, RUN, "left").join(kinds, RUN, "left").na.fill(0, ["_points", "_nano", "_god"])
    density = F.col("smells") / (F.col("loc") / 1000)
    most = option(config, "smell_density")
    quality = F.when((F.col("smells") > 0) & (F.col("loc") > 0), F.least(F.lit(20), round_half_up(20 * density / most))).otherwise(0)
    coupled = F.when(F.col("coupling") > 0.1, F.least(F.lit(15), round_half_up(15 * F.col("coupling")))).otherwise(0)
    cycles = F.when(F.col("cycles") > 0, F.least(F.lit(10), 5 * F.col("cycles"))).otherwise(0)
    tiny, large = F.least(F.lit(8), 3 * F.col("_nano")), F.least(F.lit(10), 5 * F.col("_god"))
    df = df.withColumns({"_q": quality, "_c": coupled, "_y": cycles, "_t": tiny, "_g": large})
    df = df.withColumns({
        "anti_patterns": F.greatest(F.lit(0), 40 - F.col("_points")).cast("int"), "code_quality": (20 - F.col("_q")).cast("int"),
        "architecture": (25 - F.col("_c") - F.col("_y")).cast("int"), "service_sizing": F.greatest(F.lit(0), 15 - F.col("_t") - F.col("_g")).cast("int"),
    })
    total = F.greatest(F.lit(0), F.least(F.lit(100), F.col("anti_patterns") + F.col("code_quality") + F.col("architecture") + F.col("service_sizing")))
    item = lambda name, count, points: F.when(points > 0, F.struct(F.lit(name).alias("reason"), count.cast("long").alias("count"), points.cast("long").alias("points")))
    more = F.array(item("SMELL_DENSITY", F.col("smells"), F.col("_q")), item("COUPLING", F.lit(1), F.col("_c")), item("CYCLES", F.col("cycles"), F.col("_y")), item("NANO_SERVICE", F.col("_nano"), F.col("_t")), item("GOD_SERVICE", F.col("_god"), F.col("_g")))
    more = F.filter(more, lambda x: x.isNotNull())
    df = df.withColumns({"health_score": total, "deductions": F.when(F.col("_kinds").isNull(), more).otherwise(F.concat("_kinds", more))})
    return df.withColumn("grade", grade(F.col("health_score"))).drop("_points", "_nano", "_god", "_kinds", "_q", "_c", "_y", "_t", "_g")


def gate(scored: DataFrame, threshold: int) -> DataFrame:
    """Runs that a quality gate turns away."""
    return scored.filter(F.col("health_score") < threshold)
