import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from lodestone.llm import merkle

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, cut=False):
    doc, text, lang, source, n = row
    values = [doc, source, lang, n, text.replace("\n", "") if cut and text is not None else text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(leaves):
    """All levels, from the leaves to one node."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def steps(levels, i):
    out = []
    for level in levels[:-1]:
        at = i - i % 3
        run = level[at : at + 3]
        out.append((run[: i % 3], run[i % 3 + 1 :]))
        i //= 3
    return out


def expected(rows, tampered):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees.append(tree([leaf_of(r) for r in by[s]]))
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(by[s]):
            path = steps(trees[k], i) + steps(top, k)
            x = leaf_of(r, tampered(r[0]))
            for a, b in path:
                x = h(*a, x, *b)
            out.append((r[0], leaf_of(r), trees[k][-1][0], top[-1][0], h(*[y for a, b in path for y in a + b]), x, x == top[-1][0]))
    return out


def even(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0


def rows_of(rng, n, sources):
    texts = [None, "", "a\nb", "é\n", "x" * 20_000 + "\n", "same"]
    return [(rng.choice([None, rng.randrange(n), i]), rng.choice([*texts, f"t{i}\n"]), rng.choice([None, "en"]), rng.choice(sources), rng.choice([None, i])) for i in range(n)]


@pytest.mark.parametrize("n, sources, levels", [(1, ["a"], 6), (40, [None, "", "é", "z", "aa", "Z", "a"], 1), (160, ["hot"] * 9 + [None, "b"], 2), (60, [f"s{i}" for i in range(50)], 1), (120, ["a", "b"], 6)])
def test_manifest_equals_brute_force(spark, n, sources, levels):
    rows = rows_of(random.Random(n), n, sources)
    rows += rows[: n // 4] * 3  # repeated rows
    docs = spark.createDataFrame(rows, COLUMNS).withColumns({"hash": F.lit("clash"), "pos": F.lit(1), "g": F.lit(2), "block": F.lit(3), "path": F.lit("x")})
    out = merkle.manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 2 == 0, block_levels=levels).collect()
    got = [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in out]
    assert sorted(got, key=repr) == sorted(expected(rows, even), key=repr)
    for r in out:  # the paths themselves fold to the root
        path = merkle.read(r.path.encode())
        assert merkle.fold(r.leaf.encode(), path).decode() == r.root
        assert h("".join(x.decode() for _, run in path for x in run)) == r.proof_sha256


def test_no_rows(spark):
    assert merkle.manifest(spark.createDataFrame([], COLUMNS)).collect() == []


def test_nothing_tampered_all_verified(spark):
    out = merkle.manifest(spark.createDataFrame(rows_of(random.Random(5), 50, ["a", None]), COLUMNS), with_paths=False)
    assert out.filter("verified and path is null").count() == 50


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 242, 243, 500, 729])
def test_traversal_holds_a_logarithm_of_the_leaves(n):
    leaves = [h(str(i)).encode() for i in range(n)]
    whole, levels = tree([x.decode() for x in leaves]), merkle.height(n)
    walk = merkle.Traversal(leaves, levels)
    late, most = 0, 0
    for i, path in enumerate(walk):
        most = max(most, walk.held())
        assert [(b"".join(run[:p]), b"".join(run[p + 1 :])) for p, run in path] == [("".join(a).encode(), "".join(b).encode()) for a, b in steps(whole, i)]
        # Every stack that the next leaf needs is ready: the schedule is never behind.
        late += sum(not s.done for k, s in enumerate(walk.stacks) if (i + 1) % 3 ** (k + 1) == 0 and i + 1 < n)
    assert late == 0 and most <= 8 * max(1, levels)
    assert merkle.root_of(leaves, levels).decode() == whole[-1][0]


def test_partial_blocks_are_raised_to_the_height_of_whole_ones():
    leaves = [h(str(i)).encode() for i in range(4)]
    assert merkle.root_of(leaves, 3).decode() == h(tree([x.decode() for x in leaves])[-1][0])
    path = list(merkle.Traversal(leaves, 3))[3]
    assert merkle.fold(leaves[3], path) == merkle.root_of(leaves, 3)
