import hashlib
import random

import numpy as np
from lodestone.llm import substring_dedup as op


def brute(rows, window):
    rank = lambda d: 2**63 - 1 if d is None else d
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, rank(d)), rank(d))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < rank(d):
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=repr)


def test_equals_brute_force(spark):
    rng = random.Random(1)
    vocabulary = ["a", "b", "c", "dé", "e\xa0f", "ＧH"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 5, 12, 13, 14, 40, 90]))) for _ in range(40)]
    passage = " ".join(f"p{i}" for i in range(30))
    texts += [f"x{i} {passage} y{i}" for i in range(20)] + [texts[5]] * 3 + [" ".join(texts)] * 2
    rows = [(rng.randrange(1000), t) for t in texts] + [(None, passage), (None, passage), (4, None), (6, ""), (4, passage), (4, passage)]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, a int, kept int")
    for window, seed, wide, often in ((13, 5, 20_000, 256), (13, 5, 20_000, 1), (6, 2, 3, 2)):
        got = sorted((tuple(r) for r in op.substring_dedup(docs, window, seed, wide, often).collect()), key=repr)
        assert got == brute(rows, window)


def test_empty_table(spark):
    assert op.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def sample_rows(seed=3):
    rng = random.Random(seed)
    passages = [" ".join(f"p{j}_{rng.randrange(9)}" for j in range(rng.randrange(10, 40))) for _ in range(12)]
    text = lambda i: " ".join([f"a{i}x{rng.randrange(99)}", rng.choice(passages), *(f"b{rng.randrange(30)}" for _ in range(rng.randrange(30))), rng.choice(passages)])
    return [(rng.randrange(60), text(i)) for i in range(50)]


def test_words_decide_where_hashes_collide(spark, monkeypatch):
    """With two bits of each hash, nearly all sequences have the hash of some other."""
    rows = sample_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    real = op.anchors
    coarse = lambda hashes, *more: real(hashes & np.uint64(3), *more)
    at, a = coarse(np.arange(400, dtype=np.uint64), np.array([400]))
    assert len(set(a.tolist())) < len(at)
    weak = lambda hashes, *more: (lambda at, a: (at, a & np.uint64(1)))(*real(hashes, *more))
    for worse in (coarse, weak):
        monkeypatch.setattr(op, "anchors", worse)
        got = sorted((tuple(r) for r in local(op, docs, rows)), key=repr)
        assert got == brute(rows, 13)


def local(op, docs, rows):
    """The operator's steps in this process, so that patches hold: workers have modules of their own."""
    import pyarrow as pa

    d = [r[0] for r in rows]
    k = list(range(len(rows)))
    batch = pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(k, pa.int64()), pa.array([t for _, t in rows])], ["d", "k", "text"])
    hashes, counts, *_ = op.chunk_words(op._plain(batch.column(2)))
    _, a = op.anchors(hashes, counts, 13, 5)
    all_seeds = pa.array([a.view(np.int64).tolist()] * len(rows), pa.list_(pa.int64()))
    held = next(op._occurrences(13, 5)(iter([pa.RecordBatch.from_arrays([*batch.columns, all_seeds], ["d", "k", "text", "seeds"])]))).to_pylist()
    order = sorted((r for r in held if r["n"] is not None), key=lambda r: (r["a"], r["d"]))
    names = [("a", pa.int64()), ("d", pa.int64()), ("left", pa.int8()), ("h", pa.binary()), ("around", pa.binary()), ("most", pa.int64()), ("n", pa.int64())]
    columns = [pa.array([r[c] for r in order], t) for c, t in names]
    ways = {r["h"]: r["firsts"] for b in op._extend(13, 5)(iter([pa.RecordBatch.from_arrays(columns, [c for c, _ in names])])) for r in b.to_pylist()}
    spans = [[] for _ in rows]
    for r in held:
        spans[r["k"]].append({"p": r["p"], "bits": sum(1 << o for o, f in enumerate(ways.get(r["h"], [])) if f is not None and f < r["d"])})
    kind = pa.list_(pa.struct({"p": pa.int32(), "bits": pa.int32()}))
    columns = [batch.column(0), batch.column(2), pa.array([[x for x in s if x["bits"]] or None for s in spans], kind)]
    for b in op._strip(13)(iter([pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "spans"])])):
        yield from (tuple(r.values()) for r in b.to_pylist())


def test_without_anchors_nothing_is_found(spark, monkeypatch):
    rows = sample_rows()
    monkeypatch.setattr(op, "anchors", lambda *_: (np.zeros(0, np.int64), np.zeros(0, np.uint64)))
    assert all(r[2] == 0 for r in local(op, None, rows)) and any(r[2] for r in brute(rows, 13))


def test_a_very_long_text(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    long = " ".join(f"w{i * i % 10007}" for i in range(200_000)) + " " + passage
    rows = [(1, passage), (2, long)]
    got = {r.doc_id: r for r in op.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_removed == 0 and got[2].n_words == 200_060 and got[2].n_removed == 60
