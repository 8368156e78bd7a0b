"""Approximate nearest neighbours by inner product with an inverted multi-index.

Vectors are cut in two halves and each half is quantised by a codebook of its own, so a pair of centroids names one of
``CENTROIDS``^2 cells. A query sorts both codebooks by inner product with its halves and visits pairs in falling order
of the sum, with a heap, until the cells visited hold the wanted share of all distinct vectors. Entries of visited cells are
reranked by their exact inner product in double precision.

The codebooks are fitted by k-means on a sample of ``SAMPLE`` distinct vectors (least hash of the id). The same sample
measures how deep queries must go: ``depth`` is the share of distinct vectors within which ``RECALL`` of true
neighbours inside the sample are met; copies count neither there nor in a search. Nearer neighbours of a larger table are met earlier, so the share is on the safe side. Vectors
without structure need a large share (about 0.4 for random directions in 64 dimensions), clustered ones a small one.

Scale: every vector is indexed. Entries are dealt to blocks of about ``BLOCK`` of neighbouring cells, larger cells to
several; the cell sizes the driver needs are a table of fixed size. A query is sent to the blocks that hold visited cells.
Tasks read one block's entries and then stream its queries, so memory is bounded by a block. Of equal vectors only
the ``top`` + 1 of least id are entries, as no others can be among the nearest ones; a window limit removes the rest
before the shuffle. Partial results are one row per query and block.

Defined cases: vectors that are null, empty, zero, of another length than most, or hold null or non-finite numbers,
and rows without vec_id, take no part; ties go to the smaller vec_id; a query's own row is left out once, so a repeated
row can be a neighbour of its copy, and repeated query rows give repeated results; fewer rows than ``top`` give all of
them; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom.session import write_through

CENTROIDS, SAMPLE, BLOCK = 64, 20_000, 1024
#: Share of true neighbours that the depth of the search is measured for, and queries that measure it.
RECALL, PROBES = 0.96, 300

_LIST = pa.list_(pa.float64())


@dataclass
class Index:
    books: tuple[np.ndarray, np.ndarray]
    half: int
    depth: float

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        return self._nearest(0, vectors[:, : self.half]) * len(self.books[1]) + self._nearest(1, vectors[:, self.half :])

    def _nearest(self, k: int, part: np.ndarray) -> np.ndarray:
        book = self.books[k]
        return (part @ book.T - 0.5 * (book * book).sum(axis=1)).argmax(axis=1)

    def visit(self, vector: np.ndarray) -> Iterator[int]:
        """Cells in falling order of the summed inner product of their two centroids."""
        first, second = self.books[0] @ vector[: self.half], self.books[1] @ vector[self.half :]
        rows, columns = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
        one, two = (-first[rows]).tolist(), (-second[columns]).tolist()
        rows, columns, width = rows.tolist(), columns.tolist(), len(two)
        heap = [(one[0] + two[0], 0, 0)]
        while heap:
            _, i, j = heapq.heappop(heap)
            yield rows[i] * width + columns[j]
            # Every pair has one parent: (i, j - 1), or (i - 1, 0) at the left edge.
            if j + 1 < width:
                heapq.heappush(heap, (one[i] + two[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(one):
                heapq.heappush(heap, (one[i + 1] + two[0], i + 1, 0))


def _kmeans(points: np.ndarray, k: int, rng, rounds: int = 10) -> np.ndarray:
    k = min(k, len(points))
    book = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        at = (points @ book.T - 0.5 * (book * book).sum(axis=1)).argmax(axis=1)
        sizes = np.bincount(at, minlength=k)
        sums = np.zeros_like(book)
        np.add.at(sums, at, points)
        book[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return book


def fit(sample: np.ndarray, top: int, centroids: int = CENTROIDS, recall: float = RECALL) -> Index:
    """Codebooks and search depth from a sample of vectors."""
    rng = np.random.default_rng(5)
    half = sample.shape[1] // 2
    index = Index((_kmeans(sample[:, :half], centroids, rng), _kmeans(sample[:, half:], centroids, rng)), half, 1.0)
    cells = index.cells(sample)
    sizes = np.bincount(cells, minlength=len(index.books[0]) * len(index.books[1]))
    reached = []
    for k in rng.choice(len(sample), min(PROBES, len(sample)), replace=False).tolist():
        scores = sample @ sample[k]
        scores[k] = -np.inf
        order = np.fromiter(index.visit(sample[k]), np.int64, len(sizes))
        share = np.empty(len(sizes))
        share[order] = np.cumsum(sizes[order]) / len(sample)
        near = np.argsort(-scores)[: min(top, len(sample) - 1)]
        reached += share[cells[near]].tolist()
    index.depth = float(np.quantile(reached, recall)) if reached and recall < 1 else 1.0
    return index


def _valid(vectors: DataFrame, dimensions: int) -> Column:
    v = F.col("vector")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size(v) == dimensions) & good & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions).astype(np.float64)


def nearest(
    vectors: DataFrame, queries: Column, top: int = 20, key: str = "vec_id", value: str = "embedding",
    centroids: int = CENTROIDS, sample: int = SAMPLE, recall: float = RECALL, block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` entries found for every row for which ``queries`` holds."""
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(
        F.col(key).cast("long").alias("vec_id"), F.col(value).cast("array<double>").alias("vector"), queries.alias("asks")
    ).filter("vec_id IS NOT NULL")
    usual = rows.groupBy(F.size("vector").alias("n")).count().filter("n > 0").orderBy(F.desc("count"), "n").first()
    if usual is None:
        return spark.createDataFrame([], result)
    dimensions = usual["n"]
    rows = rows.filter(_valid(rows, dimensions))
    alike = Window.partitionBy("vector").orderBy("vec_id")
    entries = rows.withColumn("copy", F.row_number().over(alike)).filter(F.col("copy") <= top + 1)
    entries = write_through(entries.select("vec_id", "vector", (F.col("copy") == 1).alias("first")))
    drawn = entries.filter("first").orderBy(F.xxhash64("vec_id"), "vec_id").select("vector").limit(sample)
    drawn = drawn.toArrow()["vector"].combine_chunks()
    if not len(drawn):
        return spark.createDataFrame([], result)
    index = fit(_matrix(drawn, dimensions), top, centroids, recall)
    shared = spark.sparkContext.broadcast(index)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.zeros((len(shared.value.books[0]) * len(shared.value.books[1]), 2), np.int64)
        for batch in batches:
            if batch.num_rows:
                cells = shared.value.cells(_matrix(batch.column(0), dimensions))
                sizes[:, 0] += np.bincount(cells, minlength=len(sizes))
                sizes[:, 1] += np.bincount(cells[batch.column(1).to_numpy(zero_copy_only=False)], minlength=len(sizes))
        held = np.flatnonzero(sizes[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(held), *(pa.array(c) for c in sizes[held].T)], ["cell", "n", "kinds"])

    cells = len(index.books[0]) * len(index.books[1])
    sizes, kinds_of = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
    found = entries.select("vector", "first").mapInArrow(counted, "cell long, n long, kinds long")
    for cell, n, distinct in found.groupBy("cell").agg(F.sum("n"), F.sum("kinds")).collect():  # a row a cell at most
        sizes[cell], kinds_of[cell] = n, distinct
    # Blocks of neighbouring cells; a cell beyond the size of a block has blocks of its own.
    parts = np.maximum(1, -(-sizes // block))
    first, filled = np.zeros(cells, np.int64), 0
    number = 0
    for cell in range(cells):
        if parts[cell] > 1 or filled + sizes[cell] > block:
            number, filled = number + 1, 0
        first[cell] = number
        filled += int(sizes[cell])
        if parts[cell] > 1:
            number, filled = number + int(parts[cell]), 0
    layout = spark.sparkContext.broadcast((first, parts, kinds_of))
    columns = "block long, asked boolean, id long, vector array<double>, cells array<int>, mark long, times long"
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), _LIST, pa.list_(pa.int32()), pa.int64(), pa.int64()]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, parts, _ = layout.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, cells = batch.column(0).to_numpy(), shared.value.cells(_matrix(batch.column(1), dimensions))
            at = first[cells] + (ids * 0x9E3779B1 >> 7) % parts[cells]
            own = pa.array([[c] for c in cells.tolist()], pa.list_(pa.int32()))
            asked, zero = pa.array(np.zeros(len(ids), bool)), pa.array(np.zeros(len(ids), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(at), asked, batch.column(0), batch.column(1), own, zero, zero], names)

    def requested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, (first, parts, distinct) = shared.value, layout.value
        wanted = index.depth * distinct.sum()
        for batch in batches:
            ids, marks, times = (batch.column(k).to_pylist() for k in (0, 2, 3))
            out: list[list] = [[], [], [], [], [], [], []]
            for query, vector, mark, n in zip(ids, _matrix(batch.column(1), dimensions), marks, times):
                by_block: dict[int, list[int]] = {}
                met = 0
                for cell in index.visit(vector):
                    if distinct[cell]:
                        for part in range(int(parts[cell])):
                            by_block.setdefault(int(first[cell]) + part, []).append(cell)
                        met += int(distinct[cell])
                        if met >= wanted and met > top:
                            break
                for block_, cells in by_block.items():
                    for column, x in zip(out, (block_, True, query, vector, cells, mark, n)):
                        column.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    asked = rows.filter("asks").groupBy("vec_id", "vector").agg(F.count(F.lit(1)).alias("times"))
    asked = asked.select("vec_id", "vector", F.xxhash64("vector").alias("mark"), "times").mapInArrow(requested, columns)
    meetings = entries.select("vec_id", "vector").mapInArrow(placed, columns).unionAll(asked)
    meetings = meetings.repartition("block").sortWithinPartitions("block", "asked")
    partial = "query_id long, mark long, times long, own double, ids array<long>, scores array<double>"
    partial_kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), _LIST]

    def reranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        visited = np.zeros(cells, bool)
        for batch in batches:
            blocks, asked = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            edges = (np.flatnonzero(np.diff(blocks) | np.diff(asked.astype(np.int8))) + 1).tolist()
            out: list[list] = [[], [], [], [], [], []]
            for a, b in zip([0, *edges], [*edges, batch.num_rows]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                matrix, own = _matrix(part.column(3), dimensions), part.column(4)
                if blocks[a] != now:
                    now, held = blocks[a], []
                if not asked[a]:
                    held.append((part.column(2).to_numpy(), matrix, own.flatten().to_numpy()))
                    continue
                if len(held) > 1:  # all entries of the block have been read
                    held = [tuple(np.concatenate(c) for c in zip(*held))]
                if not held:
                    continue
                ids, vectors, at = held[0]
                rows = zip(matrix, matrix @ vectors.T, *(part.column(k).to_pylist() for k in (2, 5, 6)))
                for k, (query, rough, id_, mark, times) in enumerate(rows):
                    wanted = own[k].values.to_numpy()
                    visited[wanted] = True
                    chosen = np.flatnonzero(visited[at])
                    visited[wanted] = False
                    found = best(ids, vectors, query, top + 1, rough, chosen)
                    for column, x in zip(out, (id_, mark, times, float((query * query).sum()), *found)):
                        column.append(x)
            if out[0]:
                arrays = [pa.array(c, k) for c, k in zip(out, partial_kinds)]
                yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in partial.split(", ")])

    found = meetings.mapInArrow(reranked, partial).repartition("query_id").sortWithinPartitions("query_id", "mark")
    return found.mapInArrow(lambda batches: _merged(batches, top), result)


def best(
    ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, top: int, rough: np.ndarray | None = None, chosen: np.ndarray | None = None
) -> tuple[list[int], list[float]]:
    """The ``top`` ids of largest inner product among the ``chosen`` places, ties to the smaller id; ``rough`` are the products up
    to rounding."""
    rough = vectors @ query if rough is None else rough
    chosen = np.arange(len(ids)) if chosen is None else chosen
    if len(chosen) > top:
        # Sums of equal vectors may differ in their last bits here, so what is close to the limit stays in.
        limit = np.partition(rough[chosen], -top)[-top]
        chosen = chosen[rough[chosen] >= limit - 1e-9 * max(1.0, abs(limit))]
    ids, scores = ids[chosen], (vectors[chosen] * query).sum(axis=1)
    order = np.lexsort((ids, -scores))[:top]
    return ids[order].tolist(), scores[order].tolist()


def _merged(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """The nearest of all blocks, from rows sorted by query."""
    now, own, times, pairs, out = None, 0.0, 0, [], []

    def finish() -> None:
        near = sorted(pairs)
        # The query's own row, unless smaller ids have crowded it out.
        if now is not None and (-own, now[0]) in near:
            near.remove((-own, now[0]))
        for _ in range(times):
            out.extend((now[0], rank, i, -s) for rank, (s, i) in enumerate(near[:top], 1))

    def rows() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["query_id", "rank", "vec_id", "score"])

    for batch in batches:
        for query, mark, n, self_score, ids, scores in zip(*(c.to_pylist() for c in batch.columns)):
            if (query, mark) != now:
                finish()
                now, own, times, pairs = (query, mark), self_score, n, []
            pairs += [(-s, i) for s, i in zip(scores, ids)]
        if out:
            yield rows()
            out = []
    finish()
    if out:
        yield rows()
