"""Operator 4: toxicity by compression distance between trained zstandard dictionaries.

One dictionary is trained on windows of ordinary texts, another on windows of
toxic texts. A window is `SPAN` words of a text. Its distance is what the
toxic dictionary saves: the window's compressed length with the ordinary
dictionary, less that with both. A word counts by the least distance of all
windows that hold it, so that it does not matter where a window is cut.

Labels are those of whole texts, most of whose words are ordinary, so windows
are chosen in rounds: the first toxic dictionary comes from all windows of
toxic texts, each later one from the stretches that passed `BARS` in the round
before. Every text is judged by dictionaries of the other half of the texts,
and the stretches that pass in ordinary texts go to the ordinary dictionary,
which competes for them in the next round. Both halves' pairs are kept, and
distances are their means.

How many stretches of a text reach each of `DISTANCES`, and how many windows
there are, give the score through a logistic curve fitted on labelled texts
that no dictionary has seen: that calibrates the thresholds.

Training reads a bounded sample of labelled rows outside the held-out fold:
about `SAMPLE` rows of each class, texts of up to `SAMPLE_BYTES`; dictionaries
and curve are made by the driver. Nothing but text is an input of a score.

Nulls and ties: a null text scores as an empty one, by the curve's constant;
unlabelled rows and labels without a document are not trained on; repeated
rows score alike; without labels of both classes every score is 0; an empty
table gives no rows.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, small_batches, table, texts

#: Labelled rows of each class in training, about; longest text among them, in bytes.
SAMPLE, SAMPLE_BYTES = 3000, 30_000
#: Words of a window; rounds; distance that a first window, and the least one of a word, must reach in round 1 and later.
SPAN, ROUNDS, FIRST, BARS = 4, 7, 3, (1.0, 1.5)
#: Bytes of the ordinary dictionary, of the toxic one in round 1 and later, and of windows that one is trained on.
ORDINARY, TOXIC, TRAINED = 120_000, (112_000, 12_000), 2 << 20
#: Length of segments (all windows, stretches) and of byte sequences in the choice of a dictionary's content.
SEGMENTS, GRAM, LEVEL = (32, 16), 6, 12
DISTANCES = (1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 5.0)
_BITS = 22
#: Bytes of a text split into words at once.
STRETCH = 1 << 20


def words(text: bytes) -> list[bytes]:
    return text.lower().split()


def window(ws: list[bytes], at: int, span: int = SPAN) -> bytes:
    return b" " + b" ".join(ws[at : at + span]) + b" "


def distinct(docs: list[bytes]) -> list[bytes]:
    """`docs` without near copies of earlier ones: those that share a minimum hash of 5-word shingles."""
    seen: set = set()
    out = []
    for text in docs:
        w = words(text)
        shingles = np.array([zlib.crc32(b" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))], np.uint32)
        least = [(j, int((shingles * np.uint32(2 * 7919 * j + 1) + np.uint32(104729 * j)).min())) for j in range(4)]
        if not seen.intersection(least):
            out.append(text)
        seen.update(least)
    return out


def dictionary(found: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary trained on windows; empty if there are too few."""
    n = sum(map(len, found))
    try:
        return zstandard.train_dictionary(min(size, max(n // 2, 256)), found, k=segment, d=GRAM, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def compressor(content: bytes):
    """A compressor of single windows with `content`."""
    params = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, source_size=64, dict_size=len(content), window_log=20, min_match=3, write_content_size=0, write_checksum=0, write_dict_id=0
    )
    # As plain content: windows are so short that literals cost the same in both, and only matches tell them apart.
    trained = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    trained.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=trained, compression_params=params).compress


def _places(text: np.ndarray) -> np.ndarray:
    """A place in the table of bits for each sequence of GRAM bytes."""
    n = max(0, len(text) - GRAM + 1)
    x = np.zeros(n, np.uint64)
    for k in range(GRAM):
        x = x << np.uint64(8) | text[k : k + n]
    return (x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _BITS)).astype(np.int64)


class Model:
    """Pairs of dictionaries (ordinary, toxic) and the curve's weights; half a megabyte that travels with the tasks."""

    def __init__(self, pairs: list[tuple[bytes, bytes]], weights: list[float]) -> None:
        self.pairs, self.weights = pairs, weights
        self._ready: list = []

    def __getstate__(self):
        return self.pairs, self.weights

    def __setstate__(self, state) -> None:
        self.__init__(*state)

    def _prepare(self) -> None:
        self._ready = [(compressor(a), compressor(a + b)) for a, b in self.pairs]
        # Sequences that only the first pair's toxic dictionary has, and a table of bits to look for them.
        plain, toxic = ({x[i : i + GRAM] for i in range(len(x) - GRAM + 1)} for x in self.pairs[0])
        self._only = toxic - plain
        self._bits = np.zeros(1 << _BITS, bool)
        for g in self._only:
            self._bits[_places(np.frombuffer(g, np.uint8))] = True

    def distance(self, text: bytes, pair: int = 0) -> int:
        """Bytes that the toxic dictionary of a pair saves on one window."""
        if not self._ready:
            self._prepare()
        plain, both = self._ready[pair]
        return len(plain(text)) - len(both(text))

    def _screen(self, text: bytes) -> np.ndarray:
        """Places of sequences that only the first toxic dictionary has."""
        maybe = np.flatnonzero(self._bits[_places(np.frombuffer(text, np.uint8))])
        return np.array([i for i in maybe.tolist() if text[i : i + GRAM] in self._only], np.int64)

    def evidence(self, text: bytes) -> tuple[list[tuple[float, bytes]], int]:
        """For each window side by side that passes with the first pair: the greatest least distance of one of its words, if
        it counts, and that word with its neighbours; and the number of windows. A window without a sequence that only the
        toxic dictionary has is not compressed. Texts are read in stretches that overlap."""
        if not self._ready:
            self._prepare()
        text = text.lower()
        out: list[tuple[float, bytes]] = []
        ws: list[bytes] = []
        n = at = end = 0
        whole = False
        while not whole:
            begin = end
            end = text.find(b" ", begin + STRETCH) if len(text) - begin > STRETCH else -1
            whole = end < 0
            ws += text[begin:].split() if whole else text[begin:end].split()
            last = max(0, len(ws) - SPAN)
            # In a stretch that goes on, only windows with all their neighbours are judged yet; the last one reaches to the end.
            starts = list(range(at, (last if whole else last - SPAN) + 1, SPAN)) if ws else []
            if whole and starts and starts[-1] < last:
                starts.append(last)
            n += len(starts)
            plain = b" " + b" ".join(ws) + b" "
            bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)])
            begins, stops = bounds[starts], bounds[np.minimum(np.array(starts, np.int64) + SPAN, len(ws))] + 1
            hits = self._screen(plain)
            near = np.searchsorted(hits, begins) < np.searchsorted(hits, stops - GRAM + 1)
            memo: dict[int, float] = {}

            def mean(j: int) -> float:
                if j not in memo:
                    w = window(ws, j)
                    memo[j] = sum(self.distance(w, k) for k in range(len(self.pairs))) / len(self.pairs)
                return memo[j]

            def least(p: int, found: float) -> float:
                """The least distance of the windows that hold word p, or 0 if one is too small to count."""
                for j in range(max(0, p - SPAN + 1), min(p, last) + 1):
                    if (d := mean(j)) < DISTANCES[0]:
                        return 0.0
                    found = min(found, d)
                return found

            for i in np.flatnonzero(near).tolist():
                if self.distance(plain[begins[i] : stops[i]]) >= FIRST and mean(starts[i]) >= DISTANCES[0]:
                    words_of = range(starts[i], min(starts[i] + SPAN, len(ws)))
                    best, place = max(((least(p, mean(starts[i])), p) for p in words_of), key=lambda x: x[0])
                    if best:
                        out.append((best, window(ws, max(0, place - 1), 3)))
            at = starts[-1] + SPAN if starts else at
            drop = max(0, at - SPAN + 1)
            ws, at = ws[drop:], at - drop
        return out, n

    def features(self, text: bytes) -> list[float]:
        found, n = self.evidence(text)
        return [float(np.log1p(sum(x >= t for x, _ in found))) for t in DISTANCES] + [float(np.log1p(n))]

    def score(self, text: bytes) -> float:
        if not self.weights:
            return 0.0
        x = self.weights[0] + sum(w * f for w, f in zip(self.weights[1:], self.features(text)))
        return float(1 / (1 + np.exp(-x)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> list[float]:
    """Constant and weights of a logistic curve, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = np.full(len(w), ridge)
        penalty[0] = 1e-3
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def _windows(docs: list[bytes]) -> list[bytes]:
    """Windows side by side of `docs`, in any order, TRAINED bytes of them."""
    found = [window(ws, i) for text in docs for ws in [words(text)] for i in range(0, len(ws), SPAN)]
    random.Random(1).shuffle(found)
    sizes = np.cumsum([len(w) for w in found]) if found else np.zeros(0)
    return found[: int(np.searchsorted(sizes, TRAINED, "right"))]


def train(rows: list[tuple[bytes, int]], rounds: int = ROUNDS) -> Model:
    """A model from (text, label) rows: two of three train the dictionaries, the third the curve."""
    rows = sorted(rows, key=lambda r: (zlib.crc32(r[0]), r))
    held, used = rows[::3], [r for i, r in enumerate(rows) if i % 3]
    classes = [distinct([t for t, y in used if y == label]) for label in (0, 1)]
    if min(map(len, classes)) < 2 or len({y for _, y in held}) < 2:
        return Model([], [])
    halves = [[c[half::2] for c in classes] for half in (0, 1)]
    base = [[_windows(docs) for docs in half] for half in halves]
    pairs = [(dictionary(b[0], ORDINARY, SEGMENTS[0]), dictionary(b[1], TOXIC[0], SEGMENTS[0])) for b in base]
    for k in range(1, rounds):
        judges = [Model([p], []) for p in pairs]
        passed = [[[w for t in docs for x, w in judges[1 - i].evidence(t)[0] if x >= BARS[min(k, 2) - 1]] for docs in halves[i]] for i in (0, 1)]
        made = [(dictionary(base[i][0] + passed[i][0], ORDINARY, SEGMENTS[0]), dictionary(passed[i][1], TOXIC[1], SEGMENTS[1])) for i in (0, 1)]
        if not all(b for _, b in made):
            break  # too little passed: the pairs of the round before stay
        pairs = made
    model = Model(pairs, [])
    model.weights = logistic(np.array([model.features(t) for t, _ in held]), np.array([y for _, y in held], float))
    return model


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[tuple[bytes, int]]:
    """About `sample` labelled rows of each class outside the held-out fold, picked by a hash of their id."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id") != 1)).select("doc_id", "toxic")
    n = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for label, count in n.items():
        share = F.when(F.col("toxic") == label, F.lit(sample / count)).otherwise(share)
    picked = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    rows = docs.filter(F.octet_length("text") <= SAMPLE_BYTES).select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "toxic")
    return [(r.text.encode(), r.toxic) for r in rows.toLocalIterator()]


def toxicity(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of `docs`."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [sent.value.score(t) for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", (fold("doc_id") == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, train(training_rows(docs, table(spark, sf_dir, "labels"))))
