import random
from fractions import Fraction
from hashlib import sha256
from math import floor, inf, isfinite, nan

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import neighbours, vector_codes

CODED = "vec_id long, label int, embedding array<float>"


def vectors(rng, n, dims, spots=5):
    """Clustered vectors in single precision, with repeats, ties and rows that take no part."""
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(spots)]
    rows = [(i, rng.choice([None, 1, 2, 3]), np.float32([c + rng.gauss(0, 0.3) for c in rng.choice(centres)]).tolist()) for i in range(n)]
    rows += [rows[3], rows[3], (3, 1, rows[4][2]), (None, 2, rows[5][2]), (None, None, rows[6][2]), (n, 1, [0.0] * dims), (n + 1, 1, rows[0][2])]
    bad = [None, [None] * dims, [nan] * dims, [inf] + [0.0] * (dims - 1), [], [1.0] * (dims + 1), [None, *rows[0][2][1:]]]
    return rows + [(1000 + i, 1, x) for i, x in enumerate(bad)]


def usable(rows, dims):
    return [r for r in rows if r[2] is not None and len(r[2]) == dims and all(x is not None and isfinite(x) for x in r[2])]


# -- codes -------------------------------------------------------------------


def coded(rows, parts, entries, rounds):
    """Codes by plain integers."""
    width = len(rows[0][2]) // parts
    cut = [[tuple(floor(256 * Fraction(x)) for x in r[2][p * width : (p + 1) * width]) for p in range(parts)] for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][2]))
    books = [[cut[i][p] for i in order[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min(range(len(books[p])), key=lambda e: (far(v, books[p][e]), e))
    for _ in range(rounds):
        got = [[near(c[p], p) for p in range(parts)] for c in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut[i][p] for i in range(len(rows)) if got[i][p] == e]
                if own:
                    books[p][e] = tuple(sum(x) // len(own) for x in zip(*own))
    out, by = [], {}
    for r, c in zip(rows, cut):
        best = [near(c[p], p) for p in range(parts)]
        error = sum(far(c[p], books[p][e]) for p, e in enumerate(best))
        by[r[1]] = by.get(r[1], 0) + error
        out.append((r[0], r[1], "".join(f"{e:02x}" for e in best), error))
    return [(i, code, error, by[label]) for i, label, code, error in out], sha256(",".join(str(x) for b in books for v in b for x in v).encode()).hexdigest()


@pytest.mark.parametrize("n, parts, entries, rounds", [(150, 4, 16, 2), (40, 2, 64, 2), (90, 8, 5, 3), (60, 1, 8, 0)])
def test_codes_equal_plain_integers(spark, n, parts, entries, rounds):
    rows = vectors(random.Random(n), n, 8)
    df = spark.createDataFrame(rows, CODED).withColumns({"code": F.lit("clash"), "error": F.lit(1), "k": F.lit(2), "n": F.lit(3)}).repartition(5)
    out, books = vector_codes.encode(df, parts, entries, rounds)
    want, digest = coded(usable(rows, 8), parts, entries, rounds)
    assert sorted([(r.vec_id, r.code, r.error, r.label_error) for r in out.collect()], key=repr) == sorted(want, key=repr)
    assert vector_codes.digest(books) == digest


def test_codes_of_no_rows_and_of_lengths_that_do_not_fit(spark):
    for rows in ([], [(1, 1, None), (2, 1, [nan])]):
        out, _ = vector_codes.encode(spark.createDataFrame(rows, CODED))
        assert out.collect() == [] and out.columns == ["vec_id", "label", "code", "error", "label_error"]
    with pytest.raises(ValueError, match="3 components"):
        vector_codes.encode(spark.createDataFrame([(1, 1, [1.0, 2.0, 3.0])], CODED), 2)
    with pytest.raises(ValueError, match="larger"):
        vector_codes.encode(spark.createDataFrame([(1, 1, [1e30, 2.0])], CODED), 2)


def test_sums_do_not_depend_on_blocks():
    rng = np.random.default_rng(1)
    x = rng.integers(-900, 900, (8, 5000))
    books = x[:, :64].reshape(4, 2, 64).transpose(0, 2, 1).copy()

    class Shared:
        value = books

    def zero():
        return np.zeros_like(books), np.zeros(books.shape[:2], np.int64)

    whole = vector_codes.add_block(zero(), x.tobytes(), Shared, 8)
    halves = [vector_codes.add_block(zero(), np.ascontiguousarray(x[:, a:b]).tobytes(), Shared, 8) for a, b in ((0, 1), (1, 4999), (4999, 5000))]
    merged = vector_codes.merge(vector_codes.merge(halves[0], halves[1]), halves[2])
    assert all((a == b).all() for a, b in zip(whole, merged)) and whole[1].sum() == 4 * 5000


# -- neighbours ----------------------------------------------------------------


def inner(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += x * y
    return total


def brute(rows, every, k):
    out = []
    for i, q in enumerate(rows):
        if q[0] is not None and q[0] % every == 0:
            best = sorted(((-inner(q[2], x[2]), x[0] is None, x[0] or 0) for j, x in enumerate(rows) if j != i))[:k]
            out += [(q[0], rank + 1, None if null else x, -s) for rank, (s, null, x) in enumerate(best)]
    return out


@pytest.mark.parametrize("n, leaf_rows, k", [(120, 10, 5), (30, 200, 50), (60, 2, 3)])
def test_all_leaves_give_the_exact_neighbours(spark, n, leaf_rows, k):
    rows = vectors(random.Random(n), n, 6)
    df = spark.createDataFrame(rows, CODED).withColumns({"row": F.lit(1), "leaf": F.lit(2), "norm": F.lit(0.5), "score": F.lit("x")}).repartition(3)
    out = neighbours.search(df, F.col("vec_id") % 7 == 0, k, recall=1.1, leaf_rows=leaf_rows)
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in out.collect()]
    want = brute([r for r in usable(rows, 6) if any(r[2])], 7, k)
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_many_copies_fill_many_blocks(spark):
    rows = [(i, 1, [1.0, 2.0]) for i in range(2500)] + [(9000, 1, [2.0, 1.0]), (9001, 1, [5.0, 5.0])]
    out = neighbours.search(spark.createDataFrame(rows, CODED), F.col("vec_id").isin(9000, 4), 3, leaf_rows=50).collect()
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in out}
    assert got == {(9000, 1): (9001, 15.0), (9000, 2): (0, 4.0), (9000, 3): (1, 4.0), (4, 1): (9001, 15.0), (4, 2): (0, 5.0), (4, 3): (1, 5.0)}


def test_calibrated_visits_reach_the_recall(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 16)).astype(np.float32) + 2 * rng.normal(size=(12, 16))[rng.integers(12, size=6000)].astype(np.float32)
    df = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], CODED)
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 10 == 0, 10, recall=0.95, leaf_rows=60).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    y, found = x.astype(np.float64), 0
    for q in range(0, 6000, 10):
        score = y @ y[q]
        score[q] = -np.inf
        found += len(set(np.argsort(-score)[:10].tolist()) & got[q])
    assert all(len(v) == 10 for v in got.values()) and found / 6000 >= 0.9


def test_visits_come_best_bin_first_and_widen_until_there_are_rows():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 4))
    tree = neighbours.fit(x, float(np.sqrt((x * x).sum(1)).max()), 20)
    leaf = tree.leaf_of(x)
    sizes = np.bincount(leaf, minlength=tree.leaves)
    assert sizes.sum() == 400 and tree.leaves >= 10
    for order in tree.visits(x[:20], tree.leaves, sizes, 0):
        assert sorted(order) == list(range(tree.leaves))
    for few in tree.visits(x[:20], 1, sizes, 100):
        assert sum(sizes[v] for v in few) >= 100 > sum(sizes[v] for v in few[:-1])
    assert neighbours.fit(np.ones((50, 3)), 2.0, 5).leaves == 1


def test_no_rows_no_queries_one_row(spark):
    df = spark.createDataFrame([(1, 1, [1.0]), (2, 1, [2.0])], CODED)
    assert neighbours.search(df.limit(0), F.col("vec_id") % 2 == 0).collect() == []
    assert neighbours.search(df, F.col("vec_id") == 9).collect() == []
    assert neighbours.search(df.filter("vec_id = 2"), F.col("vec_id") == 2).collect() == []
    assert [tuple(r) for r in neighbours.search(df, F.col("vec_id") == 2).collect()] == [(2, 1, 1, 2.0)]
