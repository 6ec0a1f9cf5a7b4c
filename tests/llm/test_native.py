import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from lodestone.llm import line_dedup, quality, sharding

WS = " \t\n\x0b\x0c\r"


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(1)
    line = lambda: rng.choice(["Foo ", "foo", "\tFOO\r", "ÉA", "éa", "", "  ", "x y", "Z" * 30] + [f"u{rng.randrange(99)}" for _ in range(9)])
    rows = [(i, "\n".join(line() for _ in range(rng.randrange(12)))) for i in range(60)] + [(70, None), (None, "foo\nbar"), (None, "foo"), (5, "foo\nq"), (5, "foo\nq"), (71, "\n".join(f"a{i}" for i in range(3000)) + "\nfoo")]
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(WS).translate(upper)
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    want = []
    for d, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if not (key(x) and seen[key(x)] >= 4)]
        want.append((d, len(ls), len(ls) - len(kept), "\n".join(kept)))
    docs = spark.createDataFrame([(d, t, "a", "b") for d, t in rows], "doc_id long, text string, h string, kept string")
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in line_dedup.line_dedup(docs.drop("kept"), 4).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


def test_line_dedup_of_many_repeated_rows(spark):
    text = "\n".join(f"line {i}" for i in range(200))
    docs = spark.range(1500).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text + "\nown").alias("text")).unionByName(spark.createDataFrame([(1, "line 7\nelse")], "doc_id long, text string"))
    out = line_dedup.line_dedup(docs, 1501)  # one line alone is in so many rows
    assert out.groupBy("n_lines", "n_dropped", F.length("kept").alias("k")).count().count() == 2
    assert out.filter("doc_id = 1").first().kept == "else" and out.filter("doc_id is null and n_dropped = 1").count() == 1500


def test_quality_measures_equal_brute_force(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "b", "é"]) + rng.choice(" \n\t") * rng.randrange(3) + rng.choice(["", "#", "|"]) for _ in range(rng.randrange(60))) for _ in range(60)] + [None, "", " \n ", "x\nx\nx"]
    texts += ["one two three four five " * 4 + " ".join(f"w{i}" for i in range(5000))]
    rows = []
    for i, t in enumerate(texts):
        s = t or ""
        ws = re.findall(r"[^ \t-\r]+", s)
        g = Counter(tuple(ws[k : k + 5]) for k in range(len(ws) - 4))
        rep = {k + j for k in range(len(ws) - 4) if g[tuple(ws[k : k + 5])] > 1 for j in range(5)}
        ls = [x for x in s.split("\n") if x.strip(WS)]
        rows.append((i, len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in s), len(ls) - len(set(ls)), len(rep), len(ws) < 10 or 100 * len(rep) > 20 * len(ws)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = quality.quality(docs)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted(tuple(r) for r in out.select(*names).collect()) == rows
    assert out.filter("base_failed and kept").count() == 0
    # The order of the rules changes nothing but the name of the first that rejects.
    rules = quality.text_rules()
    a, b = (sorted((r.doc_id, r.kept) for r in quality.quality(docs, x).collect()) for x in (rules, rules[::-1]))
    assert a == b
    assert quality.quality(docs.limit(0)).count() == 0


def test_rules_are_ordered_by_rejections_per_cost(spark):
    docs = spark.createDataFrame([(i, "w " * i) for i in range(50)], "doc_id long, text string")
    measured = quality.measures(docs)
    from pyspark.sql import functions as F

    never, often = quality.Rule("never", F.lit(False)), quality.Rule("often", F.col("n_words") > 3)
    assert [r.name for r in quality.order(measured, [never, often])] == ["often", "never"]


def least_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, at = (low + high) // 2, 1, 0
        for s in sizes:
            if at + s > mid:
                used, at = used + 1, 0
            at += s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


def test_shards_are_minimax_gapless_and_keep_equal_texts_together(spark):
    rng = random.Random(3)
    for n, hot in ((200, 1), (60, 40), (3, 1)):
        rows = [(i, "x" * rng.randrange(400) + str(i)) for i in range(n)] + [(1000 + i, "same text") for i in range(hot)] + [(None, None), (5, None), (5, "a"), (5, "a")]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        out = sharding.shard(docs, 7).collect()
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
        where: dict = {}
        for r in out:
            assert where.setdefault(r.text_crc32, r.shard) == r.shard and 0 <= r.shard < 7 and r.law == "bytes"
        for s in range(7):
            assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
        groups: dict = {}
        for r in sharding.digests(docs).collect():
            groups[r.key] = groups.get(r.key, 0) + r.size
        best = least_capacity([groups[k] for k in sorted(groups)], 7)
        assert max(sum(r.size for r in out if r.shard == s) for s in range(7)) == best
        assert sharding.plan(sharding.digests(docs), 7)[0] == best
    assert sharding.shard(docs.limit(0)).count() == 0
