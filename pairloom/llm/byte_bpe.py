"""Byte-level BPE encoding and decoding by ranks.

Method: the distinct pre-tokens of a step are put into buckets by length and each bucket into one padded
matrix of ids, a row per pre-token. In every round each row merges its leftmost pair of least rank; ranks come
from an open-addressing hash table over pairs of ids, held in numpy. A merge takes one column out of a row, so
the matrix is compacted to one column less, and rows without a mergeable pair leave it. Only the two pairs next to
a merge are looked up again.

Pre-tokens beyond ``LONGEST`` bytes would make a row whose rounds cost its length each; they follow the same rule
(least rank first, leftmost on ties) with a heap instead, so that nothing is cut. A pre-token that is itself in the
vocabulary is its one id. Texts are cut as in ``tokens``; pieces are remembered in a bounded memo.

Defined cases: a null text counts as empty: no ids, and the digests of no bytes; equal ranks inside a row go to the
leftmost pair, and rows are independent, so repeated rows are encoded alike; a text of any length is a step of its own; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.common import Recent, steps
from pairloom.llm.tokens import encode_by_pieces

#: Bytes of a pre-token that still goes into a matrix.
LONGEST = 512
_NONE = np.int32(np.iinfo(np.int32).max)
_MIX = np.uint64(0x9E3779B97F4A7C15)

_coders: dict[tuple[str, str], "Coder"] = {}


def load_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by id."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * (max(int(rank) for _, rank in pairs) + 1)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PairTable:
    """Ranks of pairs of ids: open addressing with linear probing, looked up for whole arrays."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray):
        bits = max(8, int(2 * max(1, len(pairs)) - 1).bit_length() + 1)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.ranks = np.full(1 << bits, _NONE, np.int32)
        left = np.arange(len(pairs))
        slots = self._slots(pairs)
        while len(left):
            free = self.keys[slots] == np.iinfo(np.uint64).max
            taken, first = np.unique(slots[free], return_index=True)
            chosen = left[free][first]
            self.keys[taken], self.ranks[taken] = pairs[chosen], ranks[chosen]
            rest = self.keys[slots] != pairs[left]
            left, slots = left[rest], (slots[rest] + 1) & self.mask

    def _slots(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs * _MIX) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of every pair; ``_NONE`` where there is none or an id is negative (padding)."""
        pairs = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        slots = self._slots(pairs)
        keys = self.keys[slots]
        found = np.where(keys == pairs, self.ranks[slots], _NONE)
        open_ = np.flatnonzero((keys != pairs) & (keys != np.iinfo(np.uint64).max))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & self.mask
            keys = self.keys[slots[open_]]
            hit = keys == pairs[open_]
            found[open_[hit]] = self.ranks[slots[open_[hit]]]
            open_ = open_[~hit & (keys != np.iinfo(np.uint64).max)]
        found[(left < 0) | (right < 0)] = _NONE
        return found


class Coder:
    """Encoder and decoder for one rank file and one pattern."""

    def __init__(self, path: str, pattern: str):
        self.tokens = load_ranks(path)
        self.id_of = {token: i for i, token in enumerate(self.tokens) if token}
        # The pattern's white space is Unicode's, without the separators that Python adds.
        spaced = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}")
        self.split = regex.compile(spaced.replace(r"\S", r"\P{White_Space}")).findall
        pairs, ranks = [], []
        for token, i in self.id_of.items():
            for k in range(1, len(token)):
                a, b = self.id_of.get(token[:k]), self.id_of.get(token[k:])
                if a is not None and b is not None:
                    pairs.append(a << 32 | b)
                    ranks.append(i)
        self.pairs = PairTable(np.array(pairs, np.uint64), np.array(ranks, np.int32))
        self.rank_of = dict(zip(pairs, ranks))
        self.single = np.array([self.id_of[bytes([b])] for b in range(256)], np.int32)
        self.pieces = Recent(lambda pieces: self._encode_whole([p.decode() for p in pieces]))

    # ------------------------------------------------------------------ pre-tokens

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of every pre-token, as bytes of unsigned 32-bit integers."""
        made: list[bytes] = [b""] * len(words)
        buckets: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            known = self.id_of.get(word)
            if known is not None:
                made[k] = known.to_bytes(4, "little")
            elif len(word) > LONGEST:
                made[k] = self._merge_long(word)
            elif word:
                buckets.setdefault((len(word) - 1).bit_length(), []).append(k)
        for members in buckets.values():
            for k, ids in zip(members, self._merge_matrix([words[k] for k in members])):
                made[k] = ids
        return made

    def _merge_matrix(self, words: list[bytes]) -> list[bytes]:
        made: list[bytes] = [b""] * len(words)
        width = max(map(len, words))
        lengths = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < lengths[:, None], self.single[raw], np.int32(-1))
        row = np.arange(len(words))
        rank = self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(words), -1)
        while len(row):
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(row), np.int64)
            best = rank[np.arange(len(row)), at] if rank.shape[1] else np.full(len(row), _NONE)
            done = best == _NONE
            if done.any():
                for r, found in zip(row[done].tolist(), ids[done]):
                    made[r] = found[found >= 0].astype("<u4").tobytes()
                row, ids, rank, at, best = row[~done], ids[~done], rank[~done], at[~done], best[~done]
                if not len(row):
                    break
            n, every = len(row), np.arange(len(row))
            ids[every, at] = best
            stay = np.ones(ids.shape, bool)
            stay[every, at + 1] = False
            ids = ids[stay].reshape(n, -1)
            # The merged pair goes; the pairs on both sides of it are looked up again.
            stay = np.ones(rank.shape, bool)
            stay[every, at] = False
            rank = rank[stay].reshape(n, -1)
            for k in (at - 1, at):
                inside = np.flatnonzero((k >= 0) & (k < rank.shape[1]))
                if len(inside):
                    j = k[inside]
                    rank[inside, j] = self.pairs.get(ids[inside, j], ids[inside, j + 1])
        return made

    def _merge_long(self, word: bytes) -> bytes:
        """The same rule for one long pre-token: a heap of (rank, place) over a linked list."""
        ids = self.single[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(k: int) -> None:
            if 0 <= k and after[k] < n:
                rank = self.rank_of.get(ids[k] << 32 | ids[after[k]])
                if rank is not None:
                    heapq.heappush(heap, (rank, k, ids[k], ids[after[k]]))

        for k in range(n - 1):
            offer(k)
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            if ids[k] != a or after[k] >= n or ids[after[k]] != b:
                continue  # one of both has been merged meanwhile
            gone = after[k]
            ids[k], ids[gone] = rank, -1
            after[k] = after[gone]
            if after[k] < n:
                before[after[k]] = k
            offer(before[k])
            offer(k)
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    # ------------------------------------------------------------------ texts

    def _encode_whole(self, texts: list[str]) -> list[bytes]:
        parts = [self.split(text) for text in texts]
        words = list({word for part in parts for word in part})
        ids = dict(zip(words, self.merge([word.encode() for word in words])))
        return [b"".join(map(ids.__getitem__, part)) for part in parts]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as bytes of little-endian unsigned 32-bit integers."""
        return encode_by_pieces(texts, self._encode_whole, self.pieces)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def coder(path: str, pattern: str) -> Coder:
    """The coder of a rank file, loaded once per Python worker."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(path, pattern)
    return _coders[path, pattern]


def encode_documents(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the ids of every whole text, as little-endian unsigned 32-bit integers."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts, ids in _encoded(batches, ranks, pattern):
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, decoded): the bytes behind the ids of ``encode_documents``."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = coder(ranks, pattern).decode
        for batch in batches:
            raw = pa.array([one(x or b"") for x in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), raw], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, decoded binary")


def _encoded(batches, ranks, pattern):
    encode = coder(ranks, pattern).encode
    for batch in batches:
        doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        for low, high in steps(texts):
            yield doc_ids[low:high], texts[low:high], encode(texts[low:high])


def digest_documents(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text, encoded and decoded again."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = coder(ranks, pattern).decode
        for doc_ids, _, ids in _encoded(batches, ranks, pattern):
            columns = [
                pa.array(doc_ids, pa.int64()),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(decode(x)).hexdigest() for x in ids]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
