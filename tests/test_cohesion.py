import random

import pytest
from lodestone.operators.cohesion import tight_cohesion
from pyspark.sql import functions as F


def test_pairs_of_methods_that_share_fields_equal_brute_force(spark):
    rng = random.Random(6)
    rows = [(f"C{c}", f"m{k}", [rng.choice([1, 2, 3, 4, 5, None]) for _ in range(rng.randrange(4))]) for c in range(12) for k in range(c * 3)] + [("lone", "m", [1]), ("none", "m", None), ("none", "n", None)]
    want = {}
    for c in {r[0] for r in rows}:
        held = [{f for f in r[2] or [] if f is not None} for r in rows if r[0] == c]
        near = [bool(a & b) for i, a in enumerate(held) for b in held[:i]]
        want[c] = sum(near) / len(near) if near else -1.0
    got = tight_cohesion(spark.createDataFrame(rows, "class string, method string, fields array<int>"), ["class"])
    assert {r["class"]: r.tcc for r in got.collect()} == pytest.approx(want)


def test_methods_of_the_same_fields_are_not_paired(spark):
    """300 000 methods of one class and six sets of fields; their pairs are 4.5 * 10^10."""
    n = 300_000
    methods = spark.range(n).select(F.lit("C").alias("class"), F.col("id").alias("method"), F.array(F.col("id") % 3, 3 + F.col("id") % 2).alias("fields"))
    # Without a common field: the other two of one modulus, and the other one of two.
    k = n // 6
    apart = 6 * 2 * k * k // 2
    assert tight_cohesion(methods, ["class"]).first().tcc == pytest.approx(1 - apart / (n * (n - 1) / 2), abs=1e-12)
