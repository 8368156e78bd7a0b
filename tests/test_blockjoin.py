import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_matching import RECORD, brute, listed

from pairloom.operators import blockjoin, matching, setjoin


def texts(rng, prefix, count):
    """Texts of all sizes whose words are partly common, with near copies."""
    bases = [[f"w{int(rng.paretovariate(0.6))}" for _ in range(n)] for n in (1, 2, 4, 8, 20, 40, 90)]
    rows = []
    for i in range(count):
        words = [w for w in rng.choice(bases) if rng.random() > 0.15] + [f"z{rng.randrange(9)}" for _ in range(rng.randrange(3))]
        rows.append((f"{prefix}{i}", " ".join(words), f"n{rng.randrange(4)} m{rng.randrange(3)}", rng.choice([1, 2, None]), rng.choice(["x", "y", None])))
    return rows


def as_lists(sets):
    return blockjoin.Sets(pa.array([sorted(s) for s in sets], pa.list_(pa.int32())), np.array([len(s) for s in sets]))


@pytest.mark.parametrize("threshold", [0.25, 0.5, 0.7, 1.0])
@pytest.mark.parametrize("small", [False, True])
def test_two_chunks_lose_no_pair(monkeypatch, threshold, small):
    """Overlaps by marks and by postings are exact; a place, a step or a bitmap for nearly everything changes nothing."""
    if small:
        for name, value in {"PLACES": 2, "CELLS": 7, "TOGETHER": 3, "LONG": 3, "DENSE": 1}.items():
            monkeypatch.setattr(blockjoin, name, value)
    rng = random.Random(int(threshold * 100))
    base = [rng.sample(range(-300, 300), 60) for _ in range(4)]
    make = lambda: [{t for t in rng.choice(base)[: rng.randrange(1, 60)] if rng.random() > 0.1} | {rng.randrange(-9, 9)} for _ in range(120)] + [set()]
    left, right = make(), make()
    right[:5] = left[:5]
    found = set()
    for i, j in blockjoin.met(as_lists(left), as_lists(right), threshold):
        common = blockjoin.overlaps(as_lists(left), as_lists(right), i, j)
        assert common.tolist() == [len(left[x] & right[y]) for x, y in zip(i, j)]
        found |= set(zip(i.tolist(), j.tolist()))
    expected = {(i, j) for i, x in enumerate(left) for j, y in enumerate(right) if x & y and len(x & y) >= threshold * len(x | y)}
    assert expected and found >= expected


@pytest.mark.parametrize("measure,threshold,columns,single", [
    ("jaccard", 0.5, ["paper_title"], []),
    ("edit", 0.7, ["paper_title"], []),
    ("dice", 0.7, ["author_names", "paper_title"], ["year", "publication_venue"]),
    ("jaccard", 0.7, ["author_names", "paper_title"], ["year", "publication_venue"]),
])
def test_many_chunks_equal_all_pairs(spark, monkeypatch, measure, threshold, columns, single):
    """Chunks of a few sets in several turns give each pair once, and no table of keys is built."""
    monkeypatch.setattr(blockjoin, "CHUNK", 400)
    monkeypatch.setattr(setjoin, "FEW", 100)
    if not single:
        monkeypatch.setattr(setjoin, "key_rows", None)
    rng = random.Random(7)
    rows = texts(rng, "l", 50), texts(rng, "r", 60)
    # Missing values of one item agree with nothing.
    plain = [[(*r[:3], r[3] or f"{r[0]}none", r[4] or f"{r[0]}none") for r in side] for side in rows]
    left, right = (spark.createDataFrame(side, RECORD) for side in rows)
    pairs = matching.similar_records(left, right, columns, threshold, single=single, measure=measure)
    expected = brute(*plain, [*columns, *single], measure, threshold)
    assert expected and listed(pairs, left, right, [*columns, *single]) == expected


def test_null_and_empty_texts_meet_nothing(spark):
    rows = [("1", None, "a", 1, "v"), ("2", "", "a", 1, "v"), ("3", "x y", "a", 1, "v")]
    left = spark.createDataFrame(rows, RECORD)
    found = matching.similar_records(left, left, ["paper_title"], 0.5).select("rep1", "rep2").collect()
    assert [tuple(r) for r in found] == [("3", "3")]
    assert matching.similar_records(left.filter("index < '3'"), left, ["paper_title"], 0.5).count() == 0


def test_meetings_are_spread(spark):
    numbers = blockjoin.spread(23)
    where = spark.createDataFrame([(n,) for n in numbers], "n int").select(F.expr("pmod(hash(n), 23)")).collect()
    assert sorted(r[0] for r in where) == list(range(23))


def test_large_cells_are_split():
    weights = {(0, 1): 10, (0, 2): 30, (0, 3): 250, (1, 3): 20}
    places, chunks = blockjoin._chunks(weights, 100)
    assert places == {(0, 1): (0, 1), (0, 2): (0, 1), (0, 3): (1, 3), (1, 3): (4, 1)}
    assert [c[:3] for c in chunks] == [(0, 1, 2), (0, 3, 3), (0, 3, 3), (0, 3, 3), (1, 3, 3)]
    assert all(w <= 100 for *_, w in chunks) and sum(w for *_, w in chunks) == sum(weights.values())
