import random

import pytest

from pairloom.operators import clusters, evaluate


def union_find(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {x: find(x) for x in list(root)}


def first_fit(pairs):
    groups = []
    for pair in pairs:
        for group in groups:
            if pair[0] in group[1] or pair[1] in group[1]:
                group[1].update(pair)
                break
        else:
            groups.append(("|".join(pair), set(pair)))
    return {(name, x) for name, group in groups for x in group}


def graphs():
    rng = random.Random(3)
    yield [(f"{i:03d}", f"{i + 1:03d}") for i in range(60)]  # a long chain
    yield [("hub", f"{i:03d}") for i in range(40)] + [("x", "y"), ("y", "z")]  # a star
    for _ in range(2):
        pairs = {(f"{rng.randrange(40):02d}", f"{rng.randrange(40):02d}") for _ in range(35)}
        yield sorted(p for p in pairs if p[0] != p[1])


@pytest.mark.parametrize("pairs", list(graphs()), ids=["chain", "star", "random1", "random2"])
def test_components(spark, pairs):
    edges = spark.createDataFrame(pairs, "u string, v string")
    found = {r.id: r.cluster_id for r in clusters.connected_components(edges).collect()}
    assert found == union_find(pairs)


@pytest.mark.parametrize("pairs", list(graphs()), ids=["chain", "star", "random1", "random2"])
@pytest.mark.parametrize("bits", [20, 1])
def test_first_fit(spark, pairs, bits, monkeypatch):
    monkeypatch.setattr(clusters, "CHUNK_BITS", bits)
    shuffled = list(pairs)
    random.Random(5).shuffle(shuffled)
    rows = [(a, b, i) for i, (a, b) in enumerate(shuffled)]
    df = spark.createDataFrame(rows, "id1 string, id2 string, place int")
    found = {(r.cluster_id, r.id) for r in clusters.first_fit(df, ["place"]).collect()}
    assert found == first_fit(shuffled)


def test_resolved_records(spark):
    records = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    held = spark.createDataFrame([("a", "a"), ("a", "c"), ("b", "b"), ("b", "d")], "cluster_id string, id string")
    assert {r.id for r in clusters.resolved_records(records, held).collect()} == {"a", "b", "e"}


def pairs_of(spark, *pairs):
    return spark.createDataFrame([tuple(p) for p in pairs], "id1 string, id2 string")


def test_evaluation(spark):
    base = pairs_of(spark, "ab", "cd", "cd", "ef")
    found = evaluate.evaluate_pairs(base, pairs_of(spark, "ab", "xy")).first()
    assert (found.tp, found.fp, found.fn) == (1, 1, 2)
    assert (found.precision, found.recall, found.f_measure) == pytest.approx((0.5, 1 / 3, 0.4))
    nothing = evaluate.evaluate_pairs(base.limit(0), base.limit(0)).first()
    assert (nothing.precision, nothing.recall, nothing.f_measure) == (0, 0, 0)


def test_pair_sets(spark):
    first, second = pairs_of(spark, "ab", "cd"), pairs_of(spark, "ba", "cd", "ef")
    assert evaluate.pairs_contained(first, second).first().contained
    assert not evaluate.pairs_contained(second, first).first().contained
    assert [tuple(r) for r in evaluate.common_pairs(first, second).collect()] == [("c", "d")]
    assert [tuple(r) for r in evaluate.missing_pairs(first, second).collect()] == [("a", "b")]


def test_blocks_equal(spark):
    make = lambda rows: spark.createDataFrame(rows, "blocking_key string, index string")
    first = make([("k", "1"), ("k", "2")])
    assert evaluate.blocks_equal(first, make([("k", "2"), ("k", "1")])).first().equal
    assert not evaluate.blocks_equal(first, make([("k", "1"), ("m", "2")])).first().equal
