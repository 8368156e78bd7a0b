"""Hard negatives: different-label rows that score just below an anchor's positives, by an exact search in a GNAT.

Scores are inner products of whole-numbered vectors. With one more coordinate, sqrt(M^2 - |x|^2) for entries (M the
largest norm) and 0 for anchors, |q - x|^2 = |q|^2 + M^2 - 2 <q, x>: high scores are near, and a window of scores is an
annulus around the anchor.

Method: a multiway hyperplane tree (GNAT, Brin 1995). Each node has split points and sends an entry to the
nearest one. For each pair (i, j) of them it keeps the range of distances from split point i to all entries below j. An anchor at
distance d from i that wants entries at distance r1 to r2 can leave out j if that range does not meet
[max(d - r2, r1 - d), d + r2]: by one comparison of ranges it eliminates siblings, not just the child itself. What is left at the
end are leaves, whose entries are scored exactly in whole numbers, so the result is exact.

Positives are searched in the anchor's own leaf first; their least score bounds the second search. The scores
found are the windows of the third one, for negatives: from 80 % of a positive's score up to it.

Scale: the split points come from a sample of ``SAMPLE`` distinct vectors and the tree has a fixed size; every row is
sent down it, and the ranges, which all rows make, are aggregated to a row for each pair of split points. Leaves of more than
``BLOCK`` entries are dealt to several blocks. Tasks read one block's entries and then stream its anchors.
Of equal vectors with equal labels only the ``positives`` + 1 of least id are entries, as no others can be among the first; a
window limit removes the rest before the shuffle. Anchors with equal vectors and labels are searched for once.
Hits are limited before they are shuffled. How many leaves an anchor meets depends on the data: where distances hardly
differ, as between random directions in 64 dimensions, most of them.

Defined cases: rows without vec_id, label or vector, with null or non-finite components, of another length than most vectors,
or with components so large that a hundred scores exceed a long, take no part; zero vectors do; ties go to the smaller
vec_id; a repeated row can be a positive of its copy, and repeated anchors give repeated results; anchors without
positives or negatives give no rows; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom.llm.common import batch_of, schema_of
from pairloom.session import write_through

SAMPLE, BLOCK = 20_000, 2048
#: Split points of a node, and sampled vectors that are not split further.
SPLITS, LEAST = 12, 24


# ----------------------------------------------------------------------------------------- tree


@dataclass
class Node:
    """``points`` with their lengthened coordinates; ``children`` are nodes, or leaves as -1 - leaf."""

    points: np.ndarray
    children: list[int]
    low: np.ndarray = field(default_factory=lambda: np.zeros(0))
    high: np.ndarray = field(default_factory=lambda: np.zeros(0))


@dataclass
class Tree:
    largest: float
    nodes: list[Node]
    leaves: int

    @property
    def slack(self) -> float:
        """More than rounding can move a distance."""
        return 1e-6 * (1 + self.largest**0.5)

    def lengthen(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.largest - (vectors * vectors).sum(axis=1), 0)
        return np.column_stack([vectors, np.sqrt(rest)])

    def descend(self, vectors: np.ndarray, seen=None) -> np.ndarray:
        """The leaf of every vector; ``seen(node, child, distances)`` for the vectors below each child."""
        longer, leaves = self.lengthen(vectors), np.zeros(len(vectors), np.int64)
        waiting = [(0, np.arange(len(vectors)))] if self.nodes and len(vectors) else []
        while waiting:
            number, at = waiting.pop()
            node = self.nodes[number]
            distances = _distances(longer[at], node.points)
            nearest = distances.argmin(axis=1)
            for child, below in enumerate(node.children):
                chosen = nearest == child
                if not chosen.any():
                    continue
                if seen:
                    seen(number, child, distances[chosen])
                if below < 0:
                    leaves[at[chosen]] = -1 - below
                else:
                    waiting.append((below, at[chosen]))
        return leaves

    def meeting(self, vector: np.ndarray, lowest: np.ndarray, highest: np.ndarray) -> list[int]:
        """The leaves that may hold entries with a score between ``lowest`` and ``highest``, of any of several windows."""
        if not self.nodes:
            return [0]
        own = float(vector @ vector) + self.largest
        near = np.sqrt(np.maximum(own - 2 * highest, 0)) - self.slack
        far = np.sqrt(np.maximum(own - 2 * lowest, 0)) + self.slack
        found, waiting = [], [0]
        while waiting:
            node = self.nodes[waiting.pop()]
            apart = np.sqrt(np.maximum(own - 2 * (node.points[:, :-1] @ vector), 0))
            least = np.maximum(apart[:, None] - far, near - apart[:, None])  # of every split point and window
            most = apart[:, None] + far
            meets = (node.low[:, :, None] <= most[:, None, :]) & (node.high[:, :, None] >= least[:, None, :])
            for child in np.flatnonzero(meets.all(axis=0).any(axis=1)).tolist():
                below = node.children[child]
                if below < 0:
                    found.append(-1 - below)
                else:
                    waiting.append(below)
        return found


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0))


def plant(sample: np.ndarray, largest: float, least: int = LEAST, splits: int = SPLITS) -> Tree:
    """The tree of a sample: split points far from each other, down to nodes of ``least`` sampled vectors."""
    rng = np.random.default_rng(9)
    tree = Tree(largest, [], 1)
    longer = tree.lengthen(sample)

    def far_apart(at: np.ndarray) -> np.ndarray:
        some = longer[rng.choice(at, min(len(at), 3 * splits), replace=False)]
        chosen, nearest = [0], _distances(some, some[:1])[:, 0]
        while len(chosen) < splits and nearest.max() > 2 * tree.slack:
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, _distances(some, some[chosen[-1:]])[:, 0])
        return some[chosen]

    leaves = 0
    waiting = [(np.arange(len(sample)), None)]
    while waiting:
        at, parent = waiting.pop()
        points = far_apart(at) if len(at) > least else longer[:0]
        if len(points) < 2:
            number, leaves = -1 - leaves, leaves + 1
        else:
            number = len(tree.nodes)
            tree.nodes.append(Node(points, [0] * len(points)))
            nearest = _distances(longer[at], points).argmin(axis=1)
            waiting += [(at[nearest == child], (number, child)) for child in range(len(points))]
        if parent:
            tree.nodes[parent[0]].children[parent[1]] = number
    tree.leaves = max(1, leaves)
    return tree


# ----------------------------------------------------------------------------------------- rows


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions).astype(np.float64)


def scores_of(queries: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Inner products of whole-numbered vectors, exact."""
    most = np.abs(queries).max(initial=0) * np.abs(entries).max(initial=0) * entries.shape[1]
    if most < 2.0**53:
        return (queries @ entries.T).astype(np.int64)
    return queries.astype(np.int64) @ entries.astype(np.int64).T


def _valid(dimensions: int) -> Column:
    v, most = F.col("vector"), float(int((2**56 / dimensions) ** 0.5))
    return (F.size(v) == dimensions) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= most))


def _grown(entries: DataFrame, dimensions: int, sample: int, block: int) -> tuple[Tree, np.ndarray]:
    """The tree with its ranges over all entries, and the number of entries of each leaf."""
    spark = entries.sparkSession
    total, largest = entries.agg(F.count(F.lit(1)), F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))).first()
    drawn = entries.filter("first").orderBy(F.xxhash64("vec_id"), "vec_id").select("vector").limit(sample).toArrow()
    drawn = _matrix(drawn["vector"].combine_chunks(), dimensions)
    tree = plant(drawn, largest, max(LEAST, block * len(drawn) // total))
    shared = spark.sparkContext.broadcast(tree)  # of fixed size
    columns = "node int, point int, child int, low double, high double, entries long"
    schema = schema_of(columns)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}
        leaves = np.zeros(shared.value.leaves, np.int64)

        def seen(node: int, child: int, distances: np.ndarray) -> None:
            low, high = distances.min(axis=0), distances.max(axis=0)
            if (node, child) in found:
                before = found[node, child]
                low, high = np.minimum(low, before[0]), np.maximum(high, before[1])
            found[node, child] = [low, high]

        for batch in batches:
            if batch.num_rows:
                leaves += np.bincount(shared.value.descend(_matrix(batch.column(0), dimensions), seen), minlength=len(leaves))
        rows = [
            (node, point, child, float(low[point]), float(high[point]), 0)
            for (node, child), (low, high) in found.items()
            for point in range(len(low))
        ]
        rows += [(-1, 0, leaf, 0.0, 0.0, int(n)) for leaf, n in enumerate(leaves.tolist()) if n]
        if rows:
            yield batch_of(rows, schema)

    found = entries.select("vector").mapInArrow(measure, columns).groupBy("node", "point", "child")
    sizes = np.zeros(tree.leaves, np.int64)
    for node in tree.nodes:
        n = len(node.points)
        # A child without entries meets nothing.
        node.low, node.high = np.full((n, n), np.inf), np.full((n, n), -np.inf)
    # A row for each pair of split points and each leaf of the tree.
    for number, point, child, low, high, n in found.agg(F.min("low"), F.max("high"), F.sum("entries")).collect():
        if number < 0:
            sizes[child] = n
        else:
            tree.nodes[number].low[point, child], tree.nodes[number].high[point, child] = low, high
    return tree, sizes


class _Search:
    """Entries dealt to blocks of leaves, and anchors sent to the blocks they have to meet."""

    columns = "block long, asked boolean, id long, mark long, label long, vector array<double>, marks array<long>"
    hits = "id long, mark long, positive_score long, hit long, score long"

    def __init__(self, entries: DataFrame, dimensions: int, sample: int, block: int):
        self.entries, self.dimensions = entries, dimensions
        self.tree, sizes = _grown(entries, dimensions, sample, block)
        self.parts = np.maximum(1, -(-sizes // block))
        self.first = np.cumsum(self.parts) - self.parts
        self.shared = entries.sparkSession.sparkContext.broadcast((self.tree, self.first, self.parts))

    def placed(self) -> DataFrame:
        shared, dimensions, schema = self.shared, self.dimensions, schema_of(self.columns)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, first, parts = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, leaves = batch.column(0).to_numpy(), tree.descend(_matrix(batch.column(2), dimensions))
                spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64)
                asked, zero = pa.array(np.zeros(len(ids), bool)), pa.array(np.zeros(len(ids), np.int64))
                arrays = [pa.array(first[leaves] + spread % parts[leaves]), asked, batch.column(0), zero, batch.column(1), batch.column(2)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.nulls(len(ids), pa.list_(pa.int64()))], schema=schema)

        return self.entries.select("vec_id", "label", "vector").mapInArrow(place, self.columns)

    def requests(self, anchors: DataFrame, how: str) -> DataFrame:
        """``anchors`` (id, mark, label, vector, marks) to blocks. ``own``: to their leaf; ``rest``: to other leaves with
        scores from marks[0] on; ``windows``: to leaves with scores below each of ``marks``, down to 80 %."""
        shared, dimensions, schema = self.shared, self.dimensions, schema_of(self.columns)

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, first, parts = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, marks, labels, _, wanted = (c.to_pylist() for c in batch.columns)
                vectors = _matrix(batch.column(3), dimensions)
                out = []
                for id_, mark, label, vector, leaf, own in zip(ids, marks, labels, vectors, tree.descend(vectors).tolist(), wanted):
                    if how == "own":
                        leaves = [leaf]
                    elif how == "rest":
                        least = np.array([own[0] if own else -np.inf], float)
                        leaves = [x for x in tree.meeting(vector, least, np.array([np.inf])) if x != leaf]
                    else:
                        highest = np.array(own, float)
                        usable = highest >= 0  # below zero, 80 % lie above the whole
                        leaves = tree.meeting(vector, 0.8 * highest[usable], highest[usable]) if usable.any() else []
                    values = vector.tolist()
                    for x in leaves:
                        out += [(int(first[x]) + part, True, id_, mark, label, values, own) for part in range(int(parts[x]))]
                    if len(out) > 2000:
                        yield batch_of(out, schema)
                        out = []
                if out:
                    yield batch_of(out, schema)

        return anchors.select("id", "mark", "label", "vector", "marks").mapInArrow(send, self.columns)

    def run(self, anchors: DataFrame, how: str, top: int) -> DataFrame:
        """At most ``top`` hits of every block, anchor and window: (id, mark, positive_score, hit, score)."""
        dimensions, schema = self.dimensions, schema_of(self.hits)
        both = self.placed().unionAll(self.requests(anchors, how)).repartition("block").sortWithinPartitions("block", "asked")

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, []
            for batch in batches:
                blocks, asked = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
                edges = np.flatnonzero(np.diff(blocks) | np.diff(asked.astype(np.int8))) + 1
                out = []
                for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                    if a == b:
                        continue
                    part = batch.slice(a, b - a)
                    matrix = _matrix(part.column(5), dimensions)
                    if blocks[a] != now:
                        now, held = blocks[a], []
                    if not asked[a]:
                        held.append((part.column(2).to_numpy(), part.column(4).to_numpy(), matrix))
                        continue
                    if len(held) > 1:
                        held = [tuple(np.concatenate(c) for c in zip(*held))]
                    if held:
                        out += _hits(held[0], part, matrix, how, top)
                if out:
                    yield batch_of(out, schema)

        return both.mapInArrow(search, self.hits)


def _hits(entries: tuple, asking: pa.RecordBatch, vectors: np.ndarray, how: str, top: int) -> list[tuple]:
    ids, labels, matrix = entries
    found = []
    columns = (asking.column(k).to_pylist() for k in (2, 3, 4, 6))
    for scores, (id_, mark, label, marks) in zip(scores_of(vectors, matrix), zip(*columns)):
        if how == "windows":
            other = labels != label
            for p in marks:
                inside = other & (scores <= p) & (100 * scores >= 80 * p)
                found += [(id_, mark, p, i, s) for i, s in first_of(ids, scores, inside, top)]
        else:
            inside = labels == label
            if how == "rest" and marks:
                inside &= scores >= marks[0]
            found += [(id_, mark, None, i, s) for i, s in first_of(ids, scores, inside, top)]
    return found


def first_of(ids: np.ndarray, scores: np.ndarray, inside: np.ndarray, top: int) -> list[tuple[int, int]]:
    """The ``top`` (id, score) of highest score, ties to the smaller id."""
    at = np.flatnonzero(inside)
    if len(at) > top:
        limit = np.partition(scores[at], -top)[-top]
        at = at[scores[at] >= limit]
    at = at[np.lexsort((ids[at], -scores[at]))][:top]
    return list(zip(ids[at].tolist(), scores[at].tolist()))


def _first(hits: DataFrame, top: int) -> DataFrame:
    """The ``top`` hits of every anchor and window, with their ``place`` from 1."""
    order = Window.partitionBy("id", "mark", "positive_score").orderBy(F.desc("score"), "hit")
    return hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)


def mine(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, sample: int = SAMPLE, block: int = BLOCK
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows for which ``anchors`` holds.

    ``vectors`` has vec_id, label and vector (whole numbers as doubles). Positives are the ``positives`` highest
    scores of other rows of the anchor's label, negatives the ``negatives`` highest ones of other labels between 80 % of the positive's score and it.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("vector").cast("array<double>"), anchors.alias("asks")
    ).filter("vec_id IS NOT NULL AND label IS NOT NULL")
    usual = rows.groupBy(F.size("vector").alias("n")).count().filter("n > 0").orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if usual is None:
        return empty
    dimensions = usual["n"]
    rows = rows.filter(_valid(dimensions))
    alike = Window.partitionBy("vector", "label").orderBy("vec_id")
    entries = rows.withColumn("copy", F.row_number().over(alike)).filter(F.col("copy") <= max(positives, negatives) + 1)
    entries = write_through(entries.select("vec_id", "label", "vector", (F.col("copy") == 1).alias("first")))
    if entries.isEmpty():
        return empty
    asked = rows.filter("asks").withColumn("mark", F.xxhash64("vector", "label"))
    kinds = asked.groupBy("vector", "label", "mark").agg(F.min("vec_id").alias("id"))
    kinds = write_through(kinds.select("id", "mark", "label", "vector", F.lit(None).cast("array<long>").alias("marks")))
    search, key = _Search(entries, dimensions, sample, block), ["id", "mark"]

    near = write_through(_first(search.run(kinds, "own", positives + 1), positives + 1).drop("place"))
    least = near.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") > positives)
    bounded = kinds.drop("marks").join(least, key, "left").withColumn("marks", F.when(F.col("least").isNotNull(), F.array("least")))
    best = _first(near.unionByName(search.run(bounded, "rest", positives + 1)), positives + 1)
    best = write_through(best.select(*key, F.col("hit").alias("positive_id"), F.col("score").alias("positive_score"), "place"))

    windows = best.groupBy(*key).agg(F.collect_set("positive_score").alias("marks"))
    found = _first(search.run(kinds.drop("marks").join(windows, key), "windows", negatives), negatives)
    lists = found.groupBy(*key, "positive_score").agg(
        F.array_sort(F.collect_list(F.struct("place", F.col("hit").alias("negative_id"), F.col("score").alias("negative_score")))).alias("near")
    )
    pairs = best.join(lists, [*key, "positive_score"], "left").groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score", "near"))).alias("pairs")
    )
    # The anchor's own row is one of its label's, unless smaller ids have crowded it out.
    own = F.struct(F.col("anchor_id").alias("i"), F.col("own").alias("s"))
    at = F.array_position(F.transform("pairs", lambda p: F.struct(p["positive_id"].alias("i"), p["positive_score"].alias("s"))), own)
    square = F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x.cast("long"))
    class_of = kinds.select("id", F.col("mark"), "label", "vector")
    named = asked.select(F.col("vec_id").alias("anchor_id"), "label", "vector", "mark", square.alias("own")).join(
        class_of, ["mark", "label", "vector"]
    )
    others = F.filter("pairs", lambda p, k: k + 1 != F.col("at"))
    return (
        named.select("anchor_id", "own", "id", "mark").join(pairs, key).withColumn("at", at)
        .select("anchor_id", F.explode(F.slice(others, 1, positives)).alias("pair"))
        .select("anchor_id", "pair.positive_id", "pair.positive_score", F.posexplode("pair.near").alias("k", "near"))
        .select(
            "anchor_id", "positive_id", (F.col("k") + 1).alias("rank"), F.col("near.negative_id").alias("negative_id"),
            "positive_score", F.col("near.negative_score").alias("negative_score"),
        )
    )
