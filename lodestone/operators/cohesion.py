"""How much the public methods of a class share its fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tight_cohesion(methods: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tcc) from (keys, method, fields) with one row for each method of a class: pairs of methods that share a field, of all
    pairs; -1 for fewer than two methods. Methods of a class with the same fields are one set and their number; sets meet by the
    fields that they hold, so rows grow with a class's different sets and not with the pairs of its methods."""
    sets = methods.groupBy(*keys, F.array_sort(F.array_compact(F.array_distinct("fields"))).alias("_set")).agg(F.count("*").alias("_k"))
    n = sets.groupBy(*keys).agg(F.sum("_k").alias("_n"), F.sum(F.when(F.size("_set") > 0, F.expr("_k * (_k - 1) div 2"))).alias("_same"))
    used = sets.select(*keys, "_set", "_k", F.explode("_set").alias("_field"))
    other = used.withColumnsRenamed({"_set": "_other", "_k": "_m"})
    pairs = used.join(other, [*keys, "_field"]).filter("_set < _other").select(*keys, "_set", "_other", "_k", "_m").distinct()
    near = pairs.groupBy(*keys).agg(F.sum(F.col("_k") * F.col("_m")).alias("_near"))
    all_ = F.col("_n") * (F.col("_n") - 1) / 2
    tcc = F.when(F.col("_n") < 2, -1.0).otherwise((F.coalesce("_same", F.lit(0)) + F.coalesce("_near", F.lit(0))) / all_)
    return n.join(near, keys, "left").select(*keys, tcc.alias("tcc"))
