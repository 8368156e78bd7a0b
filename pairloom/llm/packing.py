"""Packing documents into training sequences of a fixed number of tokens.

Method: sum of squares (Csirik et al. 2006). With N(g) open sequences of residual gap g, a piece goes where
the sum of N(g)^2 becomes smallest: into an open sequence or a new one. Gaps then stay evenly spread, and
almost every later piece finds one that it fills. Pieces are taken longest first. At the end the emptiest
sequences are dissolved and their pieces placed again by the same rule, as long as that saves sequences.

Scale: tokens never leave the task that made them; only a row of a few numbers per piece is shuffled. Pieces
are dealt evenly, by their place in the written table, to groups of about ``GROUP_PIECES``; a group
is packed by itself, so tasks and memory stay bounded whatever the input or its hot keys. The price is under
one sequence a group beside what the rule itself leaves open.

Defined cases: a null text counts as empty and an empty one as the end id alone; rows with the same doc_id, or
with none, are packed one by one; pieces of equal size go by their place in the written table, and equally good gaps to the tightest; a
text of any length is encoded whole by one task and then cut; an empty table gives no rows; only the columns asked for
are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.common import crc32, steps
from pairloom.llm.tokens import encoder
from pairloom.session import write_through

#: Tokens of a sequence.
CAPACITY = 2048
#: Pieces packed together, on average.
GROUP_PIECES = 16_384

_PIECES = "at long, doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut_lengths(total: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document: only the first may be shorter than ``capacity``."""
    first = total % capacity or min(total, capacity)
    return [first, *[capacity] * ((total - first) // capacity)]


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every text: its ids are those of ``vocabulary``, followed by ``end_id``."""
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts = encoder(vocabulary).encode
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for low, high in steps(texts):
                rows = []
                for doc_id, raw in zip(ids[low:high], encode_texts(texts[low:high])):
                    raw += end
                    start = 0
                    for k, length in enumerate(cut_lengths(len(raw) // 4, capacity)):
                        part = raw[4 * start : 4 * (start + length)]
                        rows.append((at, doc_id, k, start, length, crc32(part)))
                        start += length
                        at += 1
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)]
                yield pa.RecordBatch.from_arrays(columns, _NAMES)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, _PIECES)


_NAMES = [c.split()[0] for c in _PIECES.split(", ")]
_TYPES = [pa.int32() if c.endswith(" int") else pa.int64() for c in _PIECES.split(", ")]


class _Open:
    """Open sequences by residual gap."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.held: list[list[int]] = []
        self.gap: list[int] = []

    def place(self, item: int, size: int) -> None:
        """Put a piece where the sum of squared counts becomes smallest; ties go to the tightest gap."""
        n, capacity = self.count, self.capacity
        # Gap g becomes g - size: N(g) falls and N(g - size) rises by one. Closed sequences do not count.
        change = 2 * (n[: capacity - size] - n[size:capacity]) + 2
        if size < capacity:
            change[0] = 1 - 2 * n[size]
        change[n[size:capacity] == 0] = np.iinfo(np.int64).max
        best = int(change.argmin()) if len(change) else -1
        new = 2 * n[capacity - size] + 1 if size < capacity else 0
        if best >= 0 and n[size + best] and change[best] <= new:
            k = self.by_gap[size + best].pop()
            n[size + best] -= 1
        else:
            k, best = len(self.held), capacity - size
            self.held.append([])
            self.gap.append(capacity)
        self.held[k].append(item)
        self.gap[k] = best
        if best:
            n[best] += 1
            self.by_gap[best].append(k)

    def dissolve(self, share: float) -> list[int]:
        """Take the emptiest open sequences apart; their pieces."""
        still_open = sorted((k for k in range(len(self.held)) if self.gap[k] and self.held[k]), key=lambda k: -self.gap[k])
        freed: list[int] = []
        for k in still_open[: max(1, int(share * len(still_open)))]:
            self.by_gap[self.gap[k]].remove(k)
            self.count[self.gap[k]] -= 1
            freed += self.held[k]
            self.held[k], self.gap[k] = [], 0
        return freed


def pack_sizes(sizes: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Places of ``sizes`` by sequence."""

    def filled(packing: _Open, items: list[int]) -> list[list[int]]:
        for item in sorted(items, key=lambda i: (-sizes[i], i)):
            packing.place(item, int(sizes[item]))
        return [held for held in packing.held if held]

    packing = _Open(capacity)
    best = filled(packing, list(range(len(sizes))))
    while packing.count.any():
        again = filled(packing, packing.dissolve(0.1))
        if len(again) >= len(best):
            break
        best = [list(held) for held in again]
    return best


def pack(found: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Give every row of ``pieces`` its sequence and its offset in there."""
    written = write_through(found)
    groups = max(1, -(-written.count() // group_pieces))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_batches = [b for b in batches if b.num_rows]
        if not held_batches:
            return
        rows = pa.Table.from_batches(held_batches).sort_by("at")
        sizes = rows["length"].to_numpy()
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        base = rows["part"][0].as_py() << 32
        for k, held in enumerate(pack_sizes(sizes, capacity)):
            sequence[held] = base + k
            offset[held] = np.cumsum(sizes[held]) - sizes[held]
        rows = rows.drop_columns(["at", "part"])
        rows = rows.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        yield from rows.combine_chunks().to_batches()

    part = F.pmod(F.xxhash64("at"), F.lit(groups)).cast("int")
    return written.withColumn("part", part).repartitionById(groups, F.col("part")).mapInArrow(place, _PLACES)


def pack_documents(
    docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES
) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens.

    A document is its ids followed by ``end_id``; one longer than ``capacity`` is cut, its first piece being
    the short one. Gives (doc_id, piece, start, length, ids_crc32, sequence_id, offset), where the pieces of a
    sequence lie one behind the other from offset 0.
    """
    return pack(pieces(docs, vocabulary, end_id, capacity), capacity, group_pieces)
