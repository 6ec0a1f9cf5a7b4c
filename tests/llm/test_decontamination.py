import random

import numpy as np
from lodestone.llm import decontamination as op


def test_suffix_order_equals_sorting():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 200):
        for top in (1, 2, 30):
            s = rng.integers(0, top + 1, n)
            assert op.suffix_order(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(2)
    s = rng.integers(0, 4, 300)
    for sample in (1, 5):
        index = op.Index(s, 3, sample)
        for length in (1, 2, 4):
            p = rng.integers(1, 4, (30, length))
            for row, low, high in zip(p, *index.search(p)):
                want = [i for i in range(300 - length + 1) if (s[i : i + length] == row).all()]
                assert sorted(index.locate(np.arange(low, high)).tolist()) == want


def brute(docs, items, window):
    out = []
    for d, t in docs:
        ws = op.words((t or "").encode())
        hit, named = set(), set()
        for item, text in items:
            iw = op.words((text or "").encode())
            for i in range(max(len(iw) - window + 1, min(1, len(iw)))):
                p = iw[i : i + window]
                for k in range(len(ws) - len(p) + 1):
                    if ws[k : k + len(p)] == p:
                        hit.update(range(k, k + len(p)))
                        if item is not None:
                            named.add(str(item))
        out.append((d, len(ws), len(hit), sorted(named)))
    return sorted(out, key=repr)


def test_equals_brute_force_in_any_shards_and_blocks(spark):
    rng = random.Random(4)
    v = ["a", "B", "c1", "É", "d"]
    text = lambda n: "".join(rng.choice(v) + rng.choice([" ", "\n", "--", "."]) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 5, 8]))) for i in range(8)] + [(9, None), (10, ""), (None, "zz yy xx ww"), (3, "q r s t u"), (11, "q r s t u")]
    docs = [(i % 30, text(rng.choice([0, 1, 4, 30]))) for i in range(40)] + [(50, None), (None, "A " + items[3][1]), (51, "x q r, S T u zz yy xx ww " * 3), (51, "x q r, S T u zz yy xx ww " * 3)]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, items int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for window, shard, block in ((4, 1 << 19, 1 << 20), (4, 20, 15), (10, 5, 1 << 20)):
        got = op.decontaminate(frame, bench, window, shard, block).collect()
        assert sorted(((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), r["items"]) for r in got), key=repr) == brute(docs, items, window)


def test_cut_leaves_the_rest_as_it_was():
    assert op.cut("Ünd Foo, bar.  Baz! qux".encode(), [(1, 3)]).decode() == "Ünd .  Baz! qux"


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert op.decontaminate(none, bench).count() == 0
    rows = op.decontaminate(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), bench.limit(0)).collect()
    assert [(r.n_words, r.spans, r["items"]) for r in rows] == [(3, [], [])]
