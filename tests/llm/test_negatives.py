"""Hard negatives against brute force."""

import duckdb
import numpy as np
from pyspark.sql import functions as F, types as T

import llm.tables as tables
from pairloom.llm import hard_negatives as mining, queries

SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()), T.StructField("label", T.LongType()), T.StructField("vector", T.ArrayType(T.DoubleType())),
        # Names that the operator uses itself.
        T.StructField("copy", T.StringType()), T.StructField("mark", T.StringType()), T.StructField("block", T.StringType()),
    ]
)


def by_hand(rows, every=100, positives=5, negatives=5):
    usable = [(i, l, [int(x) for x in v]) for i, l, v in rows if i is not None and l is not None and v and len(v) == 4 and None not in v and np.isfinite(v).all()]
    found = []
    for k, (anchor, label, vector) in enumerate(usable):
        if anchor % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(vector, v)), i, l) for m, (i, l, v) in enumerate(usable) if m != k)
        same = [(i, -s) for s, i, l in scored if l == label][:positives]
        for positive, p in same:
            near = [(i, -s) for s, i, l in scored if l != label and 80 * p <= 100 * -s <= 100 * p][:negatives]
            found += [(anchor, positive, rank, i, p, s) for rank, (i, s) in enumerate(near, 1)]
    return found


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", "m", "b") for r in rows], SCHEMA)


def awkward(n=900, most=300):
    rng = np.random.default_rng(8)
    centres = rng.integers(-most, most, (12, 4))
    rows = [(i, int(rng.integers(0, 4)), (centres[i % 12] + rng.integers(-8, 9, 4)).astype(float).tolist()) for i in range(n)]
    # A hot vector, ties, equal rows and everything that takes no part.
    rows += [(1000 + i, i % 2, [50.0, 60.0, 70.0, 80.0]) for i in range(300)]
    rows += [(700, 1, [1.0, 2.0, 3.0, 4.0]), (1200, 0, [50.0, 60.0, 70.0, 80.0]), (1200, 0, [50.0, 60.0, 70.0, 80.0]), (2000, 1, [0.0] * 4)]
    rows += [(2100, None, [1.0] * 4), (2200, 1, None), (2300, 1, [1.0, None, 2.0, 3.0]), (2400, 1, [float("nan"), 1.0, 1.0, 1.0]),
             (2500, 1, [float("inf"), 1.0, 1.0, 1.0]), (2600, 1, []), (2700, 1, [1.0]), (None, 1, [1.0] * 4), (2800, 99, [5.0, 5.0, 5.0, 5.0])]
    return rows


def test_against_brute_force(spark):
    rows = awkward()
    expected = tables.bag(by_hand(rows))
    assert len(expected) > 300
    for sample, block in ((20_000, 2048), (300, 16), (2, 64)):
        found = mining.mine(frame(spark, rows), F.col("vec_id") % 100 == 0, sample=sample, block=block)
        assert tables.bag(found.collect()) == expected
    assert mining.mine(frame(spark, []), F.lit(True)).count() == 0
    assert mining.mine(frame(spark, rows[-13:]), F.col("vec_id") % 100 == 0).count() == len(by_hand(rows[-13:]))


def test_large_components_stay_exact(spark):
    rows = [(i, l, [x * 200_001 for x in v]) for i, l, v in awkward(300, 300)[:300]]
    found = mining.mine(frame(spark, rows), F.col("vec_id") % 20 == 0, block=32)
    assert tables.bag(found.collect()) == tables.bag(by_hand(rows, 20))


def test_ranges_eliminate_siblings_and_lose_nothing():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 200, (60, 16))
    entries = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(0, 5, (6000, 16)))
    tree = mining.plant(entries[rng.permutation(6000)[:2000]], float((entries**2).sum(axis=1).max()))
    for node in tree.nodes:
        n = len(node.points)
        node.low, node.high = np.full((n, n), np.inf), np.full((n, n), -np.inf)

    def seen(number, child, distances):
        node = tree.nodes[number]
        node.low[:, child] = np.minimum(node.low[:, child], distances.min(axis=0))
        node.high[:, child] = np.maximum(node.high[:, child], distances.max(axis=0))

    leaves = tree.descend(entries, seen)
    assert len(tree.nodes) > 5 and tree.leaves > 50
    met = []
    for k in rng.choice(6000, 60, replace=False).tolist():
        scores = entries @ entries[k]
        for p in np.sort(scores)[[-2, -50, -500]]:
            held = tree.meeting(entries[k], np.array([0.97 * p]), np.array([p]))
            inside = (scores <= p) & (scores >= 0.97 * p) & (p >= 0)
            assert set(leaves[inside].tolist()) <= set(held)
            met.append(len(held) / tree.leaves)
    assert np.mean(met) < 0.3


def test_whole_embeddings(spark):
    folder = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    expected = con.execute(queries.ORACLE["op12_hard_negatives"]).fetchall()
    found = queries.op12_hard_negatives(spark, folder)
    assert found.columns == [d[0] for d in con.description] and tables.bag(found.collect()) == tables.bag(expected)
