import itertools
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from lodestone.llm import bpe, language_id, toxicity


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    library, own = Tokenizer.from_file(path), bpe.load(path)
    rng = random.Random(1)
    marks = "abcXYZ éßñ\t\n\x0b\x1c\x1f\x85\xa0 'sre!?<|endoftext|> 12３٣漢字🎉 "
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(60))) for _ in range(600)] + [None, "", "  ", "<|endoftext|>", "a <|endoftext|>  b", "ab" * 3000, "Ä" * 700]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode(docs).collect():
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r.n_tokens == len(want)
        assert own.decode(np.array(want, "<u4").tobytes()) == library.decode(want, skip_special_tokens=False) == (texts[r.doc_id] or "")


PIECES = ["▁", "a", "b", "ab", "▁a", "ba", "aba", "▁ab"]


def exact(word, p):
    """The sum over all segmentations, in exact fractions, by its definition: how a word ends, and all ways to say the rest."""
    p = [Fraction(float(x)) for x in p]
    ways = [Fraction(1)]
    for j in range(1, len(word) + 1):
        some = [(n, p[k]) for k, x in enumerate(PIECES) if (n := len(x)) <= j and word[j - n : j] == x]
        if word[j - 1] not in PIECES:
            some.append((1, p[-1]))
        ways.append(sum(ways[j - n] * q for n, q in some))
    top = ways[-1]
    return math.log(top.numerator) - math.log(top.denominator)


def test_forward_sum_equals_all_segmentations():
    p = np.linspace(0.05, 0.2, len(PIECES) + 1)
    model = language_id.Model(PIECES, ["x"], np.array([p]), np.zeros(1))
    for word in ("a", "abab", "abcab", "bbbbb"):
        marked = "▁" + word
        total = 0.0
        for cuts in itertools.product([0, 1], repeat=len(marked) - 1):
            parts, at = [], 0
            for i, c in enumerate([*cuts, 1], 1):
                if c:
                    parts.append(marked[at:i])
                    at = i
            if all(x in PIECES or x == "c" for x in parts):
                total += math.prod(p[PIECES.index(x)] if x in PIECES else p[-1] for x in parts)
        assert model.log_probabilities([word])[0, 0] == pytest.approx(math.log(total))
        assert exact(marked, p) == pytest.approx(math.log(total))


def test_forward_sum_is_exact_at_any_length_and_outside_the_vocabulary():
    rng = random.Random(3)
    rows = np.array([[1e-6 * k for k in range(1, 10)], [2e-12, 1e-3, 1e-9, 1e-7, 1e-5, 1e-8, 1e-4, 1e-2, 1e-30]])
    model = language_id.Model(PIECES, ["x", "y"], rows, np.zeros(2))
    for n in (1, 39, 40, 41, 200, 201, 450):
        for letters in ("ab", "abcdé", "xyz"):
            word = "".join(rng.choice(letters) for _ in range(n))
            got = model.log_probabilities([word])[0]
            assert got == pytest.approx([exact("▁" + word, p) for p in rows], rel=1e-12)
    assert np.isfinite(model.log_probabilities(["ab" * 30000])).all()


def test_scores_do_not_depend_on_what_was_scored_before(monkeypatch):
    rng = random.Random(5)
    rows = np.array([np.linspace(0.01, 0.2, len(PIECES) + 1), np.linspace(0.2, 0.01, len(PIECES) + 1)])
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.choice([1, 3, 8, 50, 90])))
    texts = [" ".join(word() for _ in range(rng.randrange(40))) for _ in range(60)] + ["x" * 300, ""]
    new = lambda: language_id.Model(PIECES, ["x", "y"], rows, np.log([0.4, 0.6]))
    want = np.array([new().log_probabilities([t])[0] for t in texts])
    for memory, together in ((400_000, 1 << 16), (30, 7), (1, 1)):
        monkeypatch.setattr(language_id, "MEMORY", memory)
        monkeypatch.setattr(language_id, "TOGETHER", together)
        one = new()
        for _ in range(2):
            assert (one.log_probabilities(texts) == want).all()


def test_query_equals_brute_force_fit_and_prediction(spark):
    """Counts, expectation maximisation and choice of language written out anew, on all rows."""
    rng = random.Random(7)
    say = {"x": ["ab", "aba", "ba", "c" * 45], "y": ["b", "bb", "bab", "ab" * 30]}
    rows = [(i, " ".join(rng.choice(say[k]) for _ in range(rng.randrange(1, 9))), k) for i in range(90) for k in [rng.choice("xy")]]
    rows += [rows[3], rows[3], (200, None, "x"), (201, "--", "y"), (None, "bab", None), (202, "ab", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learn = [r for r in rows if r[2] and zlib.crc32(str(r[0]).encode()) % 3 != 1]
    table = {}
    for lang in "xy":
        said = Counter(w for _, t, k in learn if k == lang and t for w in t.split())
        p = {x: 1 / 9 for x in [*PIECES, None]}
        for _ in range(language_id.ROUNDS):
            total = dict.fromkeys(p, language_id.PRIOR)
            for w, c in said.items():
                w = "▁" + w
                arcs = [(i, j, x) for j in range(1, len(w) + 1) for i in range(j) for x in [w[i:j] if w[i:j] in PIECES else None if j == i + 1 else ""] if x != ""]
                f, g = [1] + [0] * len(w), [0] * len(w) + [1]
                for i, j, x in arcs:
                    f[j] += f[i] * p[x]
                for i, j, x in reversed(arcs):
                    g[i] += p[x] * g[j]
                for i, j, x in arcs:
                    total[x] += c * f[i] * p[x] * g[j] / f[-1]
            p = {x: v / sum(total.values()) for x, v in total.items()}
        table[lang] = [p[x] for x in [*PIECES, None]]
    model = language_id.train(docs, pieces=PIECES)
    assert model.probabilities == pytest.approx(np.array([table["x"], table["y"]]), rel=1e-9)
    share = {k: math.log(sum(r[2] == k for r in learn) / len(learn)) for k in "xy"}
    got = sorted(((r.doc_id, r.text, r.lang_pred, round(r.score, 9)) for r in language_id.identify(docs, model).collect()), key=repr)
    want = []
    for d, t, _ in rows:
        if not t or not any(c.isalpha() for c in t):
            want.append((d, t, "und", 0.0))
            continue
        x = {k: share[k] + sum(exact("▁" + w, table[k]) for w in t.split()) for k in "xy"}
        best = min("xy", key=lambda k: -x[k])
        want.append((d, t, best, round(1 / sum(math.exp(v - x[best]) for v in x.values()), 9)))
    assert got == sorted(want, key=repr)
    again = language_id.identify(docs.repartition(7), model).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, language_id.identify(docs, model).collect()))


def test_language_of_nulls_marks_and_held_out_texts(spark):
    rng = random.Random(4)
    say = {"en": ["the", "water", "house", "and"], "de": ["der", "wasser", "haus", "und"]}
    rows = [(i, " ".join(rng.choice(say[k]) for _ in range(20)), k, 1.0) for i in range(60) for k in [("en", "de")[i % 2]]]
    rows += [(100, None, "en", None), (101, "12 !?", "de", None), (None, "das wasser und der", None, None), (103, "x" * 5000, "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in language_id.identify(docs, language_id.train(docs)).collect()}
    assert all(got[i].lang_pred == got[i].lang for i in range(60)) and got[None].lang_pred == "de"
    assert got[100].lang_pred == got[101].lang_pred == "und" and got[100].score == 0 and 0 <= got[103].score <= 1
    empty = docs.limit(0)
    assert language_id.identify(docs, language_id.train(empty)).filter("lang_pred <> 'und'").count() == 0
    assert language_id.identify(empty, language_id.train(docs)).count() == 0


def test_language_without_spaces(spark):
    rng = random.Random(6)
    say = {"x": ["山水", "山", "火"], "y": ["水山", "水", "木"]}
    rows = [(i, "".join(rng.choice(say[k]) for _ in range(90)), k) for i in range(60) for k in [("x", "y", "y")[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, pieces=["▁", "山", "水", "火", "木", "山水", "水山"])
    assert all(r.lang_pred == r.lang for r in language_id.identify(docs, model).collect())


def toxic_rows(n, seed=5):
    rng = random.Random(seed)
    part = ["an", "er", "in", "st", "on", "th", "re", "ou"]
    prose = lambda n: " ".join("".join(rng.choice(part) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rude = ["grumble", "vexatious", "peevish", "surly old"]
    rows = []
    for i in range(n):
        bad = i % 3 == 0
        said = "".join(f" {rng.choice(rude)} {prose(9)}" for _ in range(4)) if bad else " "
        rows.append((i, prose(30) + said + prose(20), int(bad)))
    return rows


def test_toxicity_on_held_out_texts(spark):
    rows = toxic_rows(900)
    rows += [(5000, None, 0), (5001, "", None), (None, "grumble", 1), (5002, "grumble" * 9000, 0), rows[6], rows[6]]
    docs = spark.createDataFrame([(d, t, 0.5) for d, t, _ in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows] + [(9999, 1)], "doc_id long, toxic int")
    model = toxicity.train(toxicity.training_rows(docs, labels))
    out = toxicity.toxicity(docs, model).collect()
    got = {r.doc_id: r for r in out}
    held = [(r.predicted, rows[d][2]) for d, r in got.items() if d is not None and d < 900 and r.held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.9
    assert got[5000].score == got[5001].score and got[5000].predicted == 0
    assert len({r.score for r in out if r.doc_id == rows[6][0]}) == 1 and len(out) == len(rows)
    assert toxicity.Model([], []).score(b"grumble") == 0
    assert toxicity.train([(b"a", 1)]).weights == []
    assert toxicity.toxicity(docs.limit(0), model).count() == 0


def test_window_distances_and_evidence_equal_brute_force():
    """The evidence of every text, from the compressed lengths of all its windows."""
    rows = [(t.encode(), y) for _, t, y in toxic_rows(300, 9)]
    model = toxicity.train(rows, rounds=3)
    compress = [[toxicity.compressor(c) for c in (a, a + b)] for a, b in model.pairs]
    span = toxicity.SPAN
    for text, _ in [*rows[:20], (b"", 0), (b"one", 0), (b"one two three four five", 0)]:
        ws = text.lower().split()
        all_windows = [b" " + b" ".join(ws[i : i + span]) + b" " for i in range(max(1, len(ws) - span + 1))] if ws else []
        far = [[len(a(w)) - len(b(w)) for a, b in compress] for w in all_windows]
        starts = sorted({*range(0, len(all_windows), span), len(all_windows) - 1} if ws else set())
        want = []
        for i in starts:
            grams = {all_windows[i][j : j + toxicity.GRAM] for j in range(len(all_windows[i]) - toxicity.GRAM + 1)}
            if far[i][0] >= toxicity.FIRST and any(g in model.pairs[0][1] and g not in model.pairs[0][0] for g in grams):
                words = range(i, min(i + span, len(ws)))
                want.append(max(min(sum(d) / len(d) for j, d in enumerate(far) if j <= p < j + span) for p in words))
        found, n = model.evidence(text)
        assert [x for x, _ in found] == [x for x in want if x >= toxicity.DISTANCES[0]] and n == len(starts)


def test_long_texts_are_read_in_stretches_with_the_same_evidence(monkeypatch):
    rows = [(t.encode(), y) for _, t, y in toxic_rows(300, 9)]
    model = toxicity.train(rows, rounds=3)
    text = b" ".join(t for t, _ in rows[:20])
    want = model.evidence(text)
    for stretch in (1, 50, 1000):
        monkeypatch.setattr(toxicity, "STRETCH", stretch)
        assert model.evidence(text) == want


def test_toxic_context_is_found_without_the_top_words():
    """Texts whose toxic words are all but the commonest are still told apart."""
    rows = [(t.encode(), y) for _, t, y in toxic_rows(900)]
    model = toxicity.train(rows)
    rest = [(t.replace(b"grumble", b"stonre").replace(b"vexatious", b"anerin"), y) for t, y in ((t.encode(), y) for _, t, y in toxic_rows(240, 77))]
    bad, good = ([model.score(t) for t, y in rest if y == label] for label in (1, 0))
    assert sum(b > g for b in bad for g in good) / len(bad) / len(good) > 0.8
