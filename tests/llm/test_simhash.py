import random

import numpy as np
from lodestone.llm import simhash

KIND = "doc_id long, text string, fp string, key string, rest string"


def classes(fps, budget=2):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= budget:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_fingerprint_is_a_majority_of_bits():
    assert simhash.fingerprint(b" \t") == 0
    assert simhash.fingerprint(b"A b") == simhash.fingerprint(b"a  b\n")
    text = " ".join(f"w{i}" for i in range(700))
    import xxhash

    words = text.split()
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert simhash.fingerprint(text.encode()) == want


def test_trie_pairs_equal_brute_force():
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = sorted({b ^ (1 << rng.randrange(64)) * (k > 0) ^ (1 << rng.randrange(64)) * (k > 1) for b in base for k in (0, 1, 1, 2, 2, 2)} | {0, 1, 2**64 - 1})
    i, j = simhash.trie_pairs(np.array(fps, np.uint64), np.zeros(len(fps), int))
    want = {(a, b) for b in range(len(fps)) for a in range(b) if bin(fps[a] ^ fps[b]).count("1") <= 2}
    assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)


def test_links_and_components_equal_brute_force_when_keys_are_dealt_anew(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(12)] + [0]
    fps = []
    for b in base:
        x = b
        for _ in range(25):
            x ^= 1 << rng.randrange(64)
            fps.append(x)
    fps = sorted({f - 2**64 if f >= 2**63 else f for f in fps})
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = classes(fps)
    for trie in (2048, 6, 1):
        roots = {r.node: r.root for r in simhash.components(simhash.links(frame, trie=trie)).collect()}
        got = [roots.get(f, f) for f in fps]
        assert len(set(got)) == len(set(want))
        assert len(set(zip(got, want))) == len(set(want))


def test_whole_operator_with_nulls_empty_texts_ties_and_clashing_columns(spark):
    words = [f"w{i}" for i in range(300)]
    long = " ".join(words)
    rows = [(7, long), (3, long + " x"), (9, long.upper()), (5, None), (4, ""), (None, " "), (8, "a b"), (8, "a b"), (None, "zz")]
    docs = spark.createDataFrame([(d, t, "x", "y", "z") for d, t in rows], KIND)
    out = {(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert {(d, c) for d, f, c in out if f == 0} == {(5, 4), (4, 4), (None, 4)}
    assert {c for d, f, c in out if d in (7, 3, 9)} == {3}
    assert {c for d, f, c in out if d == 8} == {8}
    assert (None, simhash.fingerprint(b"zz") - (2**64 if simhash.fingerprint(b"zz") >= 2**63 else 0), None) in out
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_a_key_that_is_dealt_at_every_level_keeps_its_links(spark):
    """Fingerprints that share all but their last 12 bits: each deal leaves a large key but the last."""
    rng = random.Random(8)
    fps = sorted(rng.sample(range(4096), 300))
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = classes(fps, 1)
    for trie in (40, 3):
        roots = {r.node: r.root for r in simhash.components(simhash.links(frame, 1, trie)).collect()}
        got = [roots.get(f, f) for f in fps]
        assert len(set(zip(got, want))) == len(set(want)) == len(set(got))


def test_components_with_hot_nodes(spark, monkeypatch):
    from lodestone.llm import common

    monkeypatch.setattr(simhash, "FEW_EDGES", 0)
    monkeypatch.setattr(common, "LEAST_HOT", 3)
    edges = spark.createDataFrame([(5, i) for i in range(6, 60)] + [(60, 61), (61, 62), (70, 70)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 5 for i in range(6, 60)} | {61: 60, 62: 60}


def test_hot_keys_join_as_others(spark, monkeypatch):
    from lodestone.llm import common

    rows = spark.createDataFrame([(i % 7 if i < 50 else 9, i) for i in range(300)], "k long, v long")
    keyed = rows.groupBy("k").count().withColumnRenamed("count", "n").withColumn("x", rows["k"] * 2)
    want = sorted((k, v, 2 * k) for k, v in rows.collect())
    for least in (64, 5, 10_000):
        monkeypatch.setattr(common, "LEAST_HOT", least)
        assert sorted(map(tuple, common.spread_join(rows, keyed, "k", 300).select("k", "v", "x").collect())) == want


def test_a_long_text_takes_bounded_memory_and_keeps_its_fingerprint(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000)).encode()
    want = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 300)
    assert simhash.fingerprint(text) == want
