import random

import numpy as np

import corpus_pipeline
from lodestone.llm import common, near_copies, simhash

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_copies_equal_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for g in range(30):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([12, 60, 200, 400]))]
        for k in range(6):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):  # each change touches five shingles
                words[rng.randrange(len(words))] = f"x{rng.randrange(5000)}"
            rows.append((len(rows), (" " if k % 2 else "\n").join(words).upper() if k == 3 else " ".join(words)))
    rows += [(900, None), (901, " "), (902, "a b"), (903, "A  b"), (904, "a c"), (None, "lone text"), (None, "other text")]
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    far = 0
    for i in range(len(rows)):
        for j in range(i):
            whole = len(sets[i] | sets[j])
            if whole == 0 or len(sets[i] & sets[j]) / whole >= 0.8:
                far += sets[i] != sets[j]
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert far > 30
    want = [rows[i] for i in range(len(rows)) if root(i) == i]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], KIND)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    # Buckets dealt out by blocks, texts and ids joined by shuffles.
    monkeypatch.setattr(near_copies.links, "__defaults__", (0.8, 5, 2))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_forest_connects_what_pairs_do(monkeypatch):
    rng = random.Random(4)
    for together in (256, 1):
        monkeypatch.setattr(near_copies, "TOGETHER", together)
        for _ in range(60):
            pool = rng.sample(range(1000), 14)
            sets = [set(rng.sample(pool, rng.randrange(9, 15))) for _ in range(12)] + [set()]
            given = np.array([rng.choice([k, k, 0]) for k in range(len(sets))])
            want = given.copy()
            for i, s in enumerate(sets):
                for j, t in enumerate(sets[:i]):
                    if s | t and len(s & t) / len(s | t) >= 0.8:
                        want[want == want[i]] = want[j]
            found = given.copy()
            sizes = np.array([len(s) for s in sets])
            edges = near_copies._forest(given, sizes, np.array([x for s in sets for x in sorted(s)]), 0.8)
            for i, j in edges:
                assert len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8
                assert found[i] != found[j]
                found[found == found[i]] = found[j]
            same = lambda roots: roots[:, None] == roots
            assert (same(found) == same(want)).all()


def test_tries_find_near_copies_that_share_no_band(spark, monkeypatch):
    """With minimum hashes that no two sets share, SimHash alone brings near copies together; others stay apart."""
    monkeypatch.setattr(near_copies, "sketch", lambda found: (found.sum() | np.uint64(1)) * np.arange(1, 61, dtype=np.uint64))
    rng = random.Random(3)
    rows = []
    for g in range(4):
        base = [f"w{rng.randrange(5000)}" for _ in range(1500)]
        rows += [(len(rows), " ".join(base), "en", "s", 1), (len(rows) + 1, " ".join(base[:-1] + ["x"]), "en", "s", 1), (len(rows) + 2, " ".join(base[::-1]), "en", "s", 1)]
    rows += [(90, None, "en", "s", 1), (91, "", "en", "s", 1)]
    fps = [simhash.fingerprint((t or "").encode(), 5) for _, t, *_ in rows]
    near = [i for i in range(1, 12, 3) if (fps[i] ^ fps[i - 1]).bit_count() <= 2]
    assert len(near) > 2
    got = {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(rows, KIND), "").collect()}
    assert got == {r[0] for r in rows} - set(near) - {91}
