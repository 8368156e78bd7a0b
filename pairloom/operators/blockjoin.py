"""Similar records from chunks that meet in memory: prefix filter, bitmaps and overlaps in numpy.

Both sides are dealt to chunks of bounded size, and every chunk meets all chunks of the other side that may hold a partner
of one of its sets. What two chunks need travels once for each such meeting, not for each key or candidate, and nothing but pairs
within reach is written. A meeting has its own token order, rarest of both chunks first; two sets with Jaccard >= t share a token among the
first |s| - ceil(t |s|) + 1 of each (see ``setjoin``).

Tokens are 32-bit hashes here. Two tokens of one hash count as common, so an overlap is never too small: all true pairs are
found, and whoever verifies them looks at the sets themselves.
"""

from __future__ import annotations

import json
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from pairloom.functions.similarity import Measure
from pairloom.operators import setjoin

# Executors get these functions as they are and need not find this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Tokens of a chunk, at most, but for a single set.
CHUNK = 1 << 22
#: Cells of the table that says which sets have met, and pairs or tokens that are looked at together.
CELLS, TOGETHER = 1 << 24, 1 << 21
#: Share of all pairs up to which the wide bitmaps of those left are compared.
DENSE = 0.02
#: Tokens are counted at 2^PLACES places and marked at 2^MARKS.
PLACES, MARKS = 22, 20
#: 64-bit words of the bitmap of a set, and of that of a set of more than ``LONG`` tokens, which fills the first one.
WORDS, WIDE, LONG = 16, 256, 256
#: What a set costs besides its tokens, in tokens.
OWN = 16
#: Sizes to an octave that are told apart where sets are dealt out, and groups of block keys.
STEPS, GROUPS = 4, 64
#: Slack for rounding, as in ``setjoin``.
SLACK = 1e-9


# ------------------------------------------------------------------------------ two chunks


class Sets:
    """The sets of one column of a chunk: tokens one after the other, sets beginning at ``start``."""

    def __init__(self, lists: pa.ListArray, sizes: np.ndarray):
        self.tokens = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint32)
        self.size = sizes.astype(np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.row = np.repeat(np.arange(len(sizes)), self.size)
        self._postings = None

    def __len__(self) -> int:
        return len(self.size)

    def marks(self, row: int) -> np.ndarray:
        return self.tokens[self.start[row] : self.start[row] + self.size[row]] & ((1 << MARKS) - 1)

    def postings(self) -> tuple[np.ndarray, np.ndarray]:
        """The rows that hold a token of each mark, and where those of a mark begin."""
        if self._postings is None:
            marks = (self.tokens & ((1 << MARKS) - 1)).astype(np.uint64)
            keys = marks << np.uint64(32) | self.row.astype(np.uint64)
            keys.sort()
            begin = np.concatenate(([0], np.cumsum(np.bincount(marks.astype(np.int64), minlength=1 << MARKS))))
            self._postings = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), begin
        return self._postings


def parities(sizes: np.ndarray, tokens: np.ndarray, words: int) -> np.ndarray:
    """The parities of the tokens at each of 64 x ``words`` places, a row for each set.

    Two bitmaps differ in no more places than the tokens behind them.
    """
    width, ends, parts = 64 * words, np.concatenate(([0], np.cumsum(sizes))), [np.zeros((0, words), np.uint64)]
    for first in range(0, len(sizes), 16_000 // words):
        last = min(first + 16_000 // words, len(sizes))
        row = np.repeat(np.arange(last - first), sizes[first:last])
        places = row * width + (tokens[ends[first] : ends[last]].astype(np.int64) & (width - 1))
        odd = (np.bincount(places, minlength=(last - first) * width) & 1).astype(np.uint8)
        parts.append(np.packbits(odd, bitorder="little").view(np.uint64).reshape(-1, words))
    return np.concatenate(parts)


def apart(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many places the bitmaps i of ``x`` and j of ``y`` differ."""
    found, step = np.zeros(len(i), np.int64), max(1, (1 << 20) // x.shape[1])
    for k in range(0, len(i), step):
        some = x[i[k : k + step]]
        some ^= y[j[k : k + step]]
        found[k : k + step] = np.bitwise_count(some).sum(1, dtype=np.int64)
    return found


class Prefixes:
    """The known tokens of sets in the common order, of which the first ones have to meet."""

    def __init__(self, sets: Sets, tokens: np.ndarray, levels: np.ndarray, floor: float):
        level = levels[tokens & ((1 << PLACES) - 1)]
        known = np.flatnonzero(level)
        keys = sets.row[known].astype(np.uint64) << np.uint64(40) | level[known].astype(np.uint64) << np.uint64(32) | tokens[known]
        keys.sort()
        row, token = (keys >> np.uint64(40)).astype(np.int64), keys & np.uint64(0xFFFFFFFF)
        held = np.bincount(row, minlength=len(sets))
        # What the other chunk lacks comes first in the order and brings no pair together.
        self.lacking = sets.size - held
        last = held - np.ceil(floor * sets.size - SLACK).astype(np.int64)
        first = np.arange(len(row)) - (np.cumsum(held) - held)[row] <= last[row]
        self.row, self.token = row[first], token[first]
        self.bits = parities(held, token, WORDS)
        # Long sets have a number among themselves, others -1.
        long = held > LONG
        self.long = np.where(long, np.cumsum(long) - 1, -1)
        self.wide = parities(held[long], token[long[row]], WIDE)


def met(a: Sets, b: Sets, floor: float, mix: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) with a shared token in both prefixes, sizes and bitmaps that allow Jaccard >= ``floor``, by rising i.

    ``mix`` are hashes of what pairs have to agree on; they become part of the tokens.
    """
    ours, theirs = (s.tokens if mix is None else s.tokens ^ m[s.row] for s, m in ((a, mix and mix[0]), (b, mix and mix[1])))
    n1, n2 = (np.bincount((t & ((1 << PLACES) - 1)).astype(np.int64), minlength=1 << PLACES) for t in (ours, theirs))
    levels = np.zeros(1 << PLACES, np.uint8)
    both = np.flatnonzero((n1 > 0) & (n2 > 0))
    levels[both] = np.minimum(np.rint(8 * np.log2(n1[both] + n2[both])), 255)
    left, right = Prefixes(a, ours, levels, floor), Prefixes(b, theirs, levels, floor)

    # Right sets are numbered by size, so those a left set may be similar to are neighbours.
    order = np.argsort(b.size, kind="stable")
    number = np.empty(len(b), np.int64)
    number[order] = np.arange(len(b))
    low = np.searchsorted(b.size[order], floor * a.size - SLACK)
    high = np.searchsorted(b.size[order], a.size / floor + SLACK, "right")
    wide = np.uint64(32)
    index = right.token << wide | number[right.row].astype(np.uint64)
    index.sort()
    asked = left.token << wide | left.row.astype(np.uint64)
    asked.sort()
    token, row = asked >> wide << wide, (asked & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begin = np.searchsorted(index, token | low[row].astype(np.uint64))
    end = np.searchsorted(index, token | high[row].astype(np.uint64))
    some = np.flatnonzero(end > begin)
    some = some[np.argsort(row[some], kind="stable")]
    row, begin, count = row[some], begin[some], (end - begin)[some]
    posting = (index & np.uint64(0xFFFFFFFF)).astype(np.int64)

    most = (1 - floor) / (1 + floor)
    rows = np.unique(row)
    entries = np.searchsorted(row, rows), np.searchsorted(row, rows, "right")
    widths = (high - low)[rows]
    seen = np.zeros(max(CELLS, widths.max(initial=0)), np.bool_)
    at = 0
    while at < len(rows):
        until = at + max(1, int(np.searchsorted(np.cumsum(widths[at:]), CELLS, "right")))
        some = slice(at, until)
        base = np.cumsum(widths[some]) - widths[some]
        shift = np.zeros(len(a), np.int64)
        shift[rows[some]] = base - low[rows[some]]
        first, last = entries[0][at], entries[1][until - 1]
        # A few meetings at a time fill the table, which then lists each pair once.
        sums = np.cumsum(count[first:last])
        cut = first
        while cut < last:
            done = sums[cut - first - 1] if cut > first else 0
            stop = first + max(cut - first + 1, int(np.searchsorted(sums, done + TOGETHER, "right")))
            n, own = count[cut:stop], slice(cut, stop)
            place = np.arange(n.sum()) + np.repeat(begin[own] - (np.cumsum(n) - n), n)
            seen[posting[place] + np.repeat(shift[row[own]], n)] = True
            cut = stop
        cells = np.flatnonzero(seen[: widths[some].sum()])
        seen[cells] = False
        i = np.repeat(rows[some], np.diff(np.append(np.searchsorted(cells, base), len(cells))))
        j = order[cells - shift[i]]
        # What one side lacks differs for certain.
        allowed = most * (a.size[i] + b.size[j]) + SLACK - left.lacking[i] - right.lacking[j]
        near = apart(left.bits, right.bits, i, j) <= allowed
        i, j, allowed = i[near], j[near], allowed[near]
        near = np.ones(len(i), np.bool_)
        # Where many are left, as at low thresholds, postings count what they share for less.
        few = len(i) <= DENSE * widths[some].sum()
        long = np.flatnonzero((left.long[i] >= 0) & (right.long[j] >= 0) & few)
        near[long] = apart(left.wide, right.wide, left.long[i[long]], right.long[j[long]]) <= allowed[long]
        yield i[near], j[near]
        at = until


def overlaps(a: Sets, b: Sets, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Tokens that the sets i of ``a`` and j of ``b`` have in common, or a few more; i must not fall."""
    found, mark = np.zeros(len(i), np.int64), np.zeros(1 << MARKS, np.bool_)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(i)) + 1, [len(i)])) if len(i) else np.zeros(1, np.int64)
    sizes = np.concatenate(([0], np.cumsum(b.size[j])))
    for first, last in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        mine = a.marks(i[first])
        if sizes[last] - sizes[first] > 2 * len(b):
            rows, begin = b.postings()
            held = begin[mine + 1] - begin[mine]
            if held.sum() + len(b) < sizes[last] - sizes[first]:
                # Many partners: what all sets share with this one comes from the postings.
                lists = [rows[x:y] for x, y in zip(begin[mine].tolist(), begin[mine + 1].tolist()) if x < y]
                all_of = np.bincount(np.concatenate(lists), minlength=len(b)) if lists else np.zeros(len(b), np.int64)
                found[first:last] = all_of[j[first:last]]
                continue
        mark[mine] = True
        for k in range(first, last, 4096):
            some = j[k : min(k + 4096, last)]
            n = b.size[some]
            ends = np.cumsum(n)
            place = np.arange(ends[-1]) + np.repeat(b.start[some] - (ends - n), n)
            hits = np.concatenate(([0], np.cumsum(mark[b.tokens[place] & ((1 << MARKS) - 1)], dtype=np.int64)))
            found[k : k + len(some)] = hits[ends] - hits[ends - n]
        mark[mine] = False
    return np.minimum(found, np.minimum(a.size[i], b.size[j]))


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(part)), where=whole > 0)


#: The highest score of sets of m and n items with o in common at most, as ``Measure.most``.
BOUNDS = {
    "jaccard": lambda o, m, n: _share(o, m + n - o),
    "dice": lambda o, m, n: _share(2 * o, m + n),
    "edit": lambda o, m, n: _share(np.minimum(m, n) + o, m + n),
}


def within_reach(
    left: pa.Table, right: pa.Table, texts: Sequence[str], single: Sequence[str], asked: Sequence[tuple[str, float]], threshold: float,
    miss: float, measure: str,
) -> pa.Table:
    """(id1, id2) of two chunks that agree on ``on``, have Jaccard >= floor in a column of ``asked`` and may reach the mean."""
    sides = []
    for table in (left, right):
        table = table.combine_chunks()
        lists = {c: table.column(f"items_{c}").combine_chunks() for c in texts}
        sides.append({c: Sets(lists[c], lists[c].value_lengths().to_numpy(zero_copy_only=False)) for c in texts})
        sides[-1] |= {"id": table.column("id").combine_chunks(), "on": table.column("on").to_numpy()}
        for c in single:
            codes = table.column(f"code_{c}")
            sides[-1][f"code_{c}"] = codes.fill_null(0).to_numpy(), codes.is_valid().to_numpy(zero_copy_only=False)
    one, two = sides
    mix = None
    if len({*np.unique(one["on"]), *np.unique(two["on"])}) > 1:
        mix = tuple((s["on"] & 0xFFFFFFFF).astype(np.uint32) for s in sides)
    bound, found = BOUNDS[measure], [np.zeros(0, np.int64)]

    for column, floor in asked:
        a, b = one[column], two[column]
        for i, j in met(a, b, floor, mix):
            agree = np.flatnonzero(one["on"][i] == two["on"][j])
            i, j = i[agree], j[agree]
            common = overlaps(a, b, i, j)
            near = np.flatnonzero(common >= floor * (a.size[i] + b.size[j] - common) - SLACK)
            i, j, common = i[near], j[near], common[near]
            total = np.zeros(len(i))
            for c in texts:
                x, y = one[c], two[c]
                total += bound(common if c == column else overlaps(x, y, i, j), x.size[i], y.size[j])
            for c in single:
                (x, known), (y, also) = one[f"code_{c}"], two[f"code_{c}"]
                total += np.where((x[i] == y[j]) & known[i] & also[j], 1.0, miss)
            near = np.flatnonzero(total / (len(texts) + len(single)) >= threshold - SLACK)
            found.append(i[near] * len(two["id"]) + j[near])
    pairs = np.concatenate(found)
    if len(asked) > 1:
        pairs = np.unique(pairs)
    i, j = np.divmod(pairs, max(1, len(two["id"])))
    return pa.table({"id1": one["id"].take(pa.array(i)), "id2": two["id"].take(pa.array(j))})


# ------------------------------------------------------------------------------- all chunks


def _chunks(weights: dict[tuple[int, int], int], most: float) -> tuple[dict[tuple[int, int], tuple[int, int]], list[tuple[int, int, int, float]]]:
    """(first chunk, chunks) of every (group, bucket), and (group, least bucket, largest one, weight) of every chunk."""
    places, chunks = {}, []
    for (group, bucket), weight in sorted(weights.items()):
        parts = max(1, ceil(weight / most))
        last = chunks[-1] if chunks else None
        if parts == 1 and last and last[0] == group and last[3] + weight <= most:
            chunks[-1] = (group, last[1], bucket, last[3] + weight)
            places[group, bucket] = len(chunks) - 1, 1
        else:
            places[group, bucket] = len(chunks), parts
            chunks += [(group, bucket, bucket, weight / parts)] * parts
    return places, chunks


def _partition(number: int, partitions: int) -> int:
    """Where Spark's hash partitioning places a row of this int: Murmur3, seed 42."""
    word = 0xFFFFFFFF
    turned = lambda x, by: (x << by | x >> 32 - by) & word
    h = turned(42 ^ turned(number * 0xCC9E2D51 & word, 15) * 0x1B873593 & word, 13) * 5 + 0xE6546B64 & word ^ 4
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & word
    h ^= h >> 16
    return (h - (1 << 32) if h >> 31 else h) % partitions


def spread(count: int) -> list[int]:
    """So many numbers that hash partitioning places in as many different partitions."""
    numbers, k = {}, 0
    while len(numbers) < count:
        numbers.setdefault(_partition(k, count), k)
        k += 1
    return list(numbers.values())


def near_records(
    sets: DataFrame, texts: Sequence[str], single: Sequence[str], asked: Sequence[tuple[str, float]], on: Sequence[str], threshold: float,
    kind: Measure, measure: str,
) -> list[DataFrame]:
    """(id1, id2), some at a time, of all pairs that agree on ``on``, have Jaccard >= floor in a column of ``asked``, and whose mean may
    reach the threshold: no true pair is lost.

    ``sets`` are written rows (id, n1, n2, columns of one item, items of each text as 32-bit hashes). Sets are dealt out by what they have to
    agree on and by size, in chunks of so many tokens that there are some meetings for each core and at most ``CHUNK`` tokens in one.
    """
    spark, texts, single, asked, on = sets.sparkSession, list(texts), list(single), list(asked), list(on)
    column, floor = asked[0][0], min(f for _, f in asked)
    by_size = all(c == column for c, _ in asked)
    bucket = F.floor(STEPS * F.log2(F.size(f"items_{column}"))).cast("int") if by_size else F.lit(0)
    able = sets.dropna(subset=on) if on else sets
    able = able.filter(" OR ".join(f"size(items_{c}) > 0" for c, _ in asked))
    code = F.xxhash64(*on) if on else F.lit(0).cast("bigint")
    group = F.pmod(code, F.lit(GROUPS)).cast("int")
    rows = able.select(
        "id", "n1", "n2", code.alias("on"), group.alias("group"), bucket.alias("bucket"),
        *[F.xxhash64(c).alias(f"code_{c}") if c in on else F.when(F.col(c).isNotNull(), F.xxhash64(c)).alias(f"code_{c}") for c in single],
        *[f"items_{c}" for c in texts],
    )
    weight = sum((F.size(f"items_{c}") for c in texts), F.lit(OWN)).cast("bigint")
    held = rows.select("group", "bucket", "n1", "n2", weight.alias("w")).groupBy("group", "bucket").agg(
        *[F.sum(F.when(F.col(f"n{k}") > 0, F.col("w"))).alias(f"w{k}") for k in (1, 2)]
    ).collect()
    tokens = [sum(r[f"w{k}"] or 0 for r in held) for k in (1, 2)]
    if not all(tokens):
        return []
    # Few tokens need fewer groups; a power of two of them, so that each takes whole ones.
    groups = min(GROUPS, 1 << (sum(tokens) // (CHUNK >> 7)).bit_length())
    weights = [Counter(), Counter()]
    for r in held:
        for k in (1, 2):
            if r[f"w{k}"]:
                weights[k - 1][r["group"] % groups, r["bucket"]] += r[f"w{k}"]
    buckets = 1 + max(r["bucket"] for r in held)
    a_side = ceil((4 * spark.sparkContext.defaultParallelism) ** 0.5)
    dealt = [_chunks(w, min(CHUNK, max(t / a_side, CHUNK >> 6))) for w, t in zip(weights, tokens)]

    def may_meet(x: tuple, y: tuple) -> bool:
        sizes = [(2 ** (c[1] / STEPS), 2 ** ((c[2] + 1) / STEPS)) for c in (x, y)]
        return x[0] == y[0] and (not by_size or (sizes[0][1] >= floor * sizes[1][0] * (1 - SLACK) and sizes[1][1] >= floor * sizes[0][0] * (1 - SLACK)))

    of_group = defaultdict(list)
    for k, y in enumerate(dealt[1][1]):
        of_group[y[0]].append(k)
    meetings = [(i, k) for i, x in enumerate(dealt[0][1]) for k in of_group[x[0]] if may_meet(x, dealt[1][1][k])]
    if not meetings:
        return []
    cost = [dealt[0][1][i][3] + dealt[1][1][k][3] for i, k in meetings]
    # A meeting moves both its chunks, so the meetings take turns: one moves about twice the tokens there are.
    turns = setjoin._slices(sum(cost) / 8, sum(tokens))
    done = np.cumsum(cost) - cost
    turn = np.minimum((done * turns / sum(cost)).astype(int), turns - 1)

    def side(k: int, own: Sequence[int]) -> DataFrame:
        # Small tables that every row looks up; as literals they need no job of their own.
        place = F.col("group") % groups * buckets + F.col("bucket")
        firsts, parts, tasks = [-1] * (groups * buckets), [1] * (groups * buckets), [[] for _ in dealt[k][1]]
        for (g, b), found in dealt[k][0].items():
            firsts[g * buckets + b], parts[g * buckets + b] = found
        for m, n in zip(own, spread(len(own))):
            tasks[meetings[m][k]].append(n)
        look = lambda table, kind, at: F.get(F.from_json(F.lit(json.dumps(table)), kind), at)
        chunk = (look(firsts, "array<int>", place) + F.pmod(F.xxhash64("id"), look(parts, "array<int>", place))).cast("int")
        mine = rows.filter(f"n{k + 1} > 0").withColumn("task", F.explode(look(tasks, "array<array<int>>", chunk)))
        return mine.select("task", *[F.col(c).alias(f"{c}_{k}") for c in moved])

    moved = ["id", "on", *[f"code_{c}" for c in single], *[f"items_{c}" for c in texts]]
    miss, kind_of_id = kind.miss, dict(sets.dtypes)["id"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        sides = (side.rename_columns(["task", *moved]) for side in (left, right))
        return within_reach(*sides, texts, single, asked, threshold, miss, measure)

    parts = []
    for t in np.unique(turn):
        own = np.flatnonzero(turn == t)
        # Each meeting is a task; by itself Spark would join small ones to a few tasks.
        ones, twos = (side(k, own).repartition(len(own), "task").groupBy("task") for k in (0, 1))
        parts.append(ones.cogroup(twos).applyInArrow(meet, f"id1 {kind_of_id}, id2 {kind_of_id}"))
    return parts
