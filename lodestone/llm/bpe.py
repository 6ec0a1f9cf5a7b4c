"""Operator 3: byte-level BPE encoding and decoding with a fixed public vocabulary.

A text is cut at its special tokens, then before each white space that follows
a word; no token of this vocabulary crosses such a place, so a piece has the
same tokens wherever it stands, and each worker keeps the ids of recent pieces.
A piece is cut into words by the vocabulary's pattern, and each word is merged
in a contiguous array of the ranks of adjacent parts: take the least rank,
delete the boundary, refresh the two neighbouring ranks, until none is left.

Nulls and ties: a null text is an empty text (no ids); rows stand for
themselves, so repeated rows, null ids and empty tables need no care.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import table

NAME = "byte_bpe_50k.json"
#: White space as the vocabulary's pattern means it.
_WS = r"\t-\r \x85\xa0  -     　"
_PIECE, _ASCII_PIECE = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+"), re.compile(r"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_NONE = 1 << 30
#: Pieces that a worker remembers, and their greatest length.
CACHE, CACHED_CHARS = 300_000, 48


def _byte_chars() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself if printable, else the next from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b if b in plain else next(extra)) for b in range(256)]


class Tokenizer:
    """Encoder and decoder of the vocabulary in `path`, a tokenizers file of byte-level BPE."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: b for b, c in enumerate(_byte_chars())}
        vocab = {s: i for s, i in spec["model"]["vocab"].items()}
        raw = {s: bytes(byte[c] for c in s) for s in vocab}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for s, i in vocab.items():
            self.bytes_of[i] = raw[s]
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.single = [vocab[c] for c in _byte_chars()]
        # (left id, right id) as one number -> rank and merged id.
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(vocab[a] << 20 | vocab[b], (rank, vocab[a + b]))
        self.rank_of = {k: r for k, (r, _) in self.merges.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}

    def word(self, word: bytes) -> list[int]:
        """Ids of one word."""
        ids = [self.single[b] for b in word]
        get = self.rank_of.get
        ranks = [get(a << 20 | b, _NONE) for a, b in zip(ids, ids[1:])]
        if len(ids) > 200:
            return self._long_word(ids)
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            ids[i] = self.merges[ids[i] << 20 | ids[i + 1]][1]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], _NONE)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 20 | ids[i + 1], _NONE)
        return ids

    def _long_word(self, ids: list[int]) -> list[int]:
        """The same merges with a heap of ranks and linked parts: a word of n bytes takes n log n steps."""
        import heapq

        n = len(ids)
        left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.rank_of.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], right[i] = self.merges[a << 20 | b][1], False, right[j]
            if right[i] < n:
                left[right[i]] = i
            for x in (left[i], i):
                if x >= 0 and right[x] < n and (r := self.rank_of.get(ids[x] << 20 | ids[right[x]])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[right[x]]))
        return [t for t, ok in zip(ids, alive) if ok]

    def piece(self, piece: str) -> bytes:
        """Ids of one piece as little-endian numbers of 32 bits."""
        out: list[int] = []
        for w in _WORD.findall(piece):
            out += self.word(w.encode())
        packed = np.array(out, "<u4").tobytes()
        if len(piece) <= CACHED_CHARS:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[piece] = packed
        return packed

    def plain(self, text: str) -> bytes:
        pieces = (_ASCII_PIECE if text.isascii() else _PIECE).findall(text)
        get, new = self.cache.get, self.piece
        return b"".join([get(p) or new(p) for p in pieces])

    def encode(self, text: str) -> bytes:
        """Ids of `text`, little-endian numbers of 32 bits."""
        if not self.split or not any(s in text for s in self.special):
            return self.plain(text)
        return b"".join(np.array([self.special[x]], "<u4").tobytes() if x in self.special else self.plain(x) for x in self.split.split(text))

    def decode(self, ids: bytes) -> str:
        """The text of `ids`; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_LOADED: dict[str, Tokenizer] = {}


def load(path: str) -> Tokenizer:
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def vocabulary_path(name: str = NAME) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, ids (array of int), n_tokens, ids_sha256 and decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path or vocabulary_path())
        for batch in batches:
            rows = [tokenizer.encode(t or "") for t in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype("int32")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), "<i4"))),
                    pa.array([len(r) // 4 for r in rows], pa.int64()),
                    pa.array([hashlib.sha256(r).hexdigest() for r in rows], pa.string()),
                    pa.array([hashlib.sha256(tokenizer.decode(r).encode()).hexdigest() for r in rows], pa.string()),
                ],
                ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
