"""Operator 6: language identification by unigrams summed over all segmentations.

The vocabulary is a fixed public one. For each language, the probabilities of
its pieces are fitted by expectation maximisation on the words of a bounded
sample of labelled texts: in each round every task sums the expected uses of
pieces over its share of the words, and the sums of all tasks are added up by
language and piece. The probability of a word is the sum over all ways to cut
it into pieces, by the forward algorithm with rescaling, over the whole word
whatever its length and with memory of the longest piece only; pieces do not
cross white space, so a text's log probability is the sum over its words, and
each worker keeps the scores of recent words, by the words themselves.

Sums are added in an order that depends on the text alone, always in double
precision, so a text has one score wherever it is read and whatever was scored
before it.

Training: about `SAMPLE` rows of each language, outside the held-out fold and
with texts of up to `SAMPLE_BYTES`.

Nulls and ties: `und` with score 0 for a null text and one without letters,
and for any text if nothing could be learned; null labels are not learned;
equal scores go to the first language by name; repeated rows and null ids
stand for themselves; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import durable, fold, small_batches, table

NAME = "piece_bpe_32k.model"
SAMPLE, SAMPLE_BYTES, ROUNDS, PRIOR = 1000, 100_000, 4, 0.02
#: Words of up to so many characters are scored many at a time, longer ones alone; no result depends on it.
SHORT = 40
#: Words that a worker remembers, and their greatest length in bytes; bytes of a text counted at once, words looked up together.
MEMORY, MEMORY_BYTES, PART, TOGETHER = 800_000, 64, 1 << 20, 1 << 16
#: Below the first, running sums are scaled up; below the second, a sum made without scaling is made again with it.
_LOW, _SMALL = 1e-60, 1e-200
_LETTER = regex.compile(r"\p{L}")
_START = "▁"


def vocabulary(name: str = NAME) -> list[str]:
    """Pieces of letters and marks, without control and byte pieces."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def words(text: str) -> list[str]:
    return [w.decode() for w in text.encode().split()]


class Lattice:
    """All segmentations of a word into pieces; a character outside the vocabulary is a piece of its own, number -1."""

    def __init__(self, pieces: list[str]) -> None:
        self.number = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)

    def ends(self, word: str) -> Iterator[list[tuple[int, int]]]:
        """For each end, (start, piece)."""
        get, longest = self.number.get, self.longest
        for j in range(1, len(word) + 1):
            some = [(i, k) for i in range(max(0, j - longest), j) if (k := get(word[i:j])) is not None]
            if not some or some[-1][0] != j - 1:
                some.append((j - 1, -1))
            yield some

    def forward(self, word: str, columns: list[list[float]]) -> list[float]:
        """Log of the sum over all segmentations, for each of `columns` of piece probabilities; any length."""
        longest, n = self.longest, len(columns)
        rows = range(n)
        # ahead[l][j % size]: sum of all segmentations of the first j characters, times e ** -log[l].
        size = longest + 1
        ahead = [[0.0] * size for _ in rows]
        log = [0.0] * n
        for l in rows:
            ahead[l][0] = 1.0
        at = 0
        for j, some in enumerate(self.ends(word), 1):
            at = j % size
            for l in rows:
                a, p = ahead[l], columns[l]
                s = 0.0
                for i, k in some:
                    s += a[i % size] * p[k]
                a[at] = s
                if s < _LOW:
                    top = max(a)
                    if 0.0 < top < _LOW:
                        ahead[l] = [x / top for x in a]
                        log[l] += math.log(top)
        return [math.log(ahead[l][at]) + log[l] if ahead[l][at] > 0.0 else -math.inf for l in rows]


def expected(word: str, count: int, lattice: Lattice, p: list[float], total: list[float]) -> None:
    """Adds to `total` how often each piece is expected in `word`, said `count` times: forward and backward sums, each
    position with a scale of its own, so that any length is exact."""
    edges = list(lattice.ends(word))
    n = len(edges)
    ahead, scale = [1.0] + [0.0] * n, [0.0] * (n + 1)  # true sum: ahead * e ** scale
    now = 0.0
    for j, some in enumerate(edges, 1):
        s = 0.0
        for i, k in some:
            s += ahead[i] * p[k] * (math.exp(scale[i] - now) if scale[i] != now else 1.0)
        if 0.0 < s < 1e-100:
            now += math.log(s)
            s = 1.0
        ahead[j], scale[j] = s, now
    if ahead[n] <= 0.0:
        return
    # back[j]: sum over the rest of the word, divided by the whole and by e ** -scale[j], so that products stay in range.
    back = [0.0] * n + [count / ahead[n]]
    for j in range(n, 0, -1):
        b = back[j]
        if b:
            for i, k in edges[j - 1]:
                x = p[k] * b * (math.exp(scale[i] - scale[j]) if scale[i] != scale[j] else 1.0)
                back[i] += x
                total[k] += ahead[i] * x


def short_spans(words: list[str], lattice: Lattice, unknown: int, none: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """For `words` of one length: (start, end) of all their parts that may be pieces, and the piece of each part and word;
    a single character outside the vocabulary is `unknown`, any other such part `none`."""
    n = len(words[0])
    spans = [(i, j) for j in range(1, n + 1) for i in range(max(0, j - lattice.longest), j)]
    parts = itemgetter(*(slice(i, j) for i, j in spans), slice(0, 0))  # two at least: always a tuple
    found = map(lattice.number.get, chain.from_iterable(map(parts, words)), repeat(none))
    ids = np.fromiter(found, np.int64, len(words) * (len(spans) + 1)).reshape(len(words), -1).T[:-1].copy()
    single = np.array([j - i == 1 for i, j in spans])
    ids[single] = np.where(ids[single] == none, unknown, ids[single])
    return spans, ids


def expect_all(counts: list[tuple[str, int]], lattice: Lattice, p: list[float]) -> np.ndarray:
    """How often each piece is expected in all words, said so many times each: short words of one length together."""
    size = len(p)
    total, row = [0.0] * size, np.array([*p, 0.0])
    sums = np.zeros(size + 1)
    of_length: dict[int, list[tuple[str, int]]] = {}
    for w, c in counts:
        of_length.setdefault(len(w) if len(w) <= SHORT else 0, []).append((_START + w, c))
    for length, group in of_length.items():
        for some in (group[i : i + 4096] for i in range(0, len(group), 4096)):
            if not length:
                for w, c in some:
                    expected(w, c, lattice, p, total)
                continue
            spans, ids = short_spans([w for w, _ in some], lattice, size - 1, size)
            ahead, back = np.zeros((length + 2, len(some))), np.zeros((length + 2, len(some)))
            ahead[0] = 1
            for e, (i, j) in enumerate(spans):
                ahead[j] += ahead[i] * row[ids[e]]
            fine = ahead[-1] > _SMALL
            back[-1, fine] = np.array([c for _, c in some], float)[fine] / ahead[-1, fine]
            for e in range(len(spans) - 1, -1, -1):
                i, j = spans[e]
                x = row[ids[e]] * back[j]
                back[i] += x
                sums += np.bincount(ids[e], ahead[i] * x, size + 1)
            for k in np.flatnonzero(~fine).tolist():
                expected(*some[k], lattice, p, total)
    return sums[:size] + np.array(total)


def _parts(text: bytes) -> Iterator[bytes]:
    """`text` cut at spaces into parts of about PART bytes, or more where a word is longer."""
    at = 0
    while len(text) - at > PART and (end := text.find(b" ", at + PART)) >= 0:
        yield text[at:end]
        at = end
    yield text[at:]


def _groups(said: list[tuple[int, Counter]], limit: int) -> Iterator[list[tuple[int, Counter]]]:
    group, size = [], 0
    for item in said:
        if group and size + len(item[1]) > limit:
            yield group
            group, size = [], 0
        group.append(item)
        size += len(item[1])
    if group:
        yield group


class Model:
    """Log probabilities of words in each language."""

    def __init__(self, pieces: list[str], languages: list[str], probabilities: np.ndarray, prior: np.ndarray) -> None:
        self.pieces, self.languages, self.probabilities, self.prior = pieces, languages, probabilities, prior
        self._ready = None

    def __getstate__(self):
        return self.pieces, self.languages, self.probabilities, self.prior

    def __setstate__(self, state) -> None:
        self.__init__(*state)

    def _learn(self, new: list[str]) -> np.ndarray:
        """Scores of `new` words, short ones of one length together."""
        lattice, columns = self._ready[0], self._ready[1]
        out = np.zeros((len(new), len(self.languages)))
        of_length: dict[int, list[int]] = {}
        for k, w in enumerate(new):
            of_length.setdefault(len(w) if len(w) <= SHORT else 0, []).append(k)
        unknown, none = len(self.pieces), len(self.pieces) + 1
        table = np.vstack([self.probabilities.T, np.zeros(len(self.languages))])
        for length, group in of_length.items():
            for some in (group[i : i + 4096] for i in range(0, len(group), 4096)):
                if not length:
                    out[some] = [lattice.forward(_START + new[k], columns) for k in some]
                    continue
                spans, ids = short_spans([_START + new[k] for k in some], lattice, unknown, none)
                ahead = np.zeros((length + 2, len(some), len(self.languages)))
                ahead[0] = 1
                for e, (i, j) in enumerate(spans):
                    ahead[j] += ahead[i] * table[ids[e]]
                # A sum that came near the end of the range of numbers is made again with scaling.
                low = np.flatnonzero((ahead[-1] < _SMALL).any(axis=1))
                with np.errstate(divide="ignore"):
                    scores = np.log(ahead[-1])
                for k in low.tolist():
                    scores[k] = lattice.forward(_START + new[some[k]], columns)
                out[some] = scores
        return out

    def _scores(self, ws: list[bytes]) -> np.ndarray:
        """Scores of distinct words, in their order."""
        memory = self._ready[2]
        ids = list(map(memory.get, ws))
        if None not in ids:
            return self._ready[3][ids]
        new = [w for w, k in zip(ws, ids) if k is None]
        learnt = self._learn([w.decode() for w in new])
        out = np.empty((len(ws), len(self.languages)))
        missing = np.array([k is None for k in ids])
        out[~missing] = self._ready[3][[k for k in ids if k is not None]]
        out[missing] = learnt
        kept = [i for i, w in enumerate(new) if len(w) <= MEMORY_BYTES]
        if len(memory) + len(kept) > MEMORY:
            memory.clear()
            kept = kept[:MEMORY]
        first = len(memory)
        self._ready[3][first : first + len(kept)] = learnt[kept]
        memory.update(zip((new[i] for i in kept), range(first, first + len(kept))))
        return out

    def log_probabilities(self, texts: list[str]) -> np.ndarray:
        """Log of prior and probability of each of `texts`, a column for each language. A text is read in parts, in each of
        which its distinct words count as often as they are said; neither depends on other texts."""
        if not self._ready:
            self._ready = Lattice(self.pieces), [c.tolist() for c in self.probabilities], {}, np.zeros((MEMORY, len(self.languages)))
        total = np.tile(self.prior, (len(texts), 1))
        said = [(d, Counter(part.split())) for d, t in enumerate(texts) for part in _parts(t.encode())]
        # Words of several texts are looked up together.
        for some in _groups(said, TOGETHER):
            distinct = dict.fromkeys(chain.from_iterable(c for _, c in some))
            scores = self._scores(list(distinct))
            place = dict(zip(distinct, range(len(distinct))))
            for d, c in some:
                if c:
                    times = np.fromiter(c.values(), float, len(c))
                    total[d] += (scores[list(map(place.__getitem__, c))] * times[:, None]).sum(axis=0)
        return total

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language of each text, and its share in the probability of all."""
        out = [("und", 0.0)] * len(texts)
        some = [i for i, t in enumerate(texts) if t and self.languages and _LETTER.search(t)]
        if some:
            x = self.log_probabilities([texts[i] for i in some])
            best = x.argmax(axis=1)
            share = 1 / np.exp(np.clip(x - x.max(axis=1, keepdims=True), -700, 0)).sum(axis=1)
            for i, b, s in zip(some, best, share):
                out[i] = self.languages[b], float(s)
        return out


def train(docs: DataFrame, sample: int = SAMPLE, pieces: list[str] | None = None, rounds: int = ROUNDS, prior: float = PRIOR) -> Model:
    """A model from text and lang of rows outside the held-out fold. The driver holds one row for each language and piece
    of the vocabulary that it uses; words stay in the tasks."""
    spark = docs.sparkSession
    pieces = vocabulary() if pieces is None else pieces
    size = len(pieces)
    known = docs.filter(F.col("lang").isNotNull() & (fold("doc_id") != 1))
    n = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for name, count in n.items():
        share = F.when(F.col("lang") == name, F.lit(sample / count)).otherwise(share)
    picked = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)).filter(F.octet_length("text") <= SAMPLE_BYTES)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter((l, w) for l, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in words(t))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])

    small_batches(spark)
    counted = picked.select("lang", "text").mapInArrow(count_words, "lang string, word string, n long")
    counts = durable(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    languages = sorted(r.lang for r in counts.select("lang").distinct().collect())
    table = {x: np.full(size + 1, 1.0 / (size + 1)) for x in languages}
    for _ in range(rounds if languages else 0):
        sent = spark.sparkContext.broadcast((pieces, table))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces, table = sent.value
            lattice = Lattice(pieces)
            p = {x: v.tolist() for x, v in table.items()}
            said: dict[str, list[tuple[str, int]]] = {}
            for batch in batches:
                for lang, word, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    said.setdefault(lang, []).append((word, c))
            for lang, ws in said.items():
                t = expect_all(ws, lattice, p[lang])
                used = np.flatnonzero(t)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(t[used])], ["lang", "piece", "x"])

        found = counts.mapInArrow(expect, "lang string, piece int, x double").groupBy("lang", "piece").agg(F.sum("x").alias("x"))
        table = {x: np.full(size + 1, prior) for x in languages}
        for r in found.collect():
            table[r.lang][r.piece] += r.x
        table = {x: v / v.sum() for x, v in table.items()}
        sent.unpersist()
    whole = sum(n[x] for x in languages)
    return Model(pieces, languages, np.array([table[x] for x in languages]), np.log(np.array([n[x] / whole for x in languages])))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of each row of `docs`, with its other columns."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sent.value.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*batch.schema.names, "lang_pred", "score"]
            )

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", (fold("doc_id") == 1).alias("held_out"), "lang_pred", "score")
