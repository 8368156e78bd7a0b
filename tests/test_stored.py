"""Stored blocks and bins from a table."""

import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import blocking, matching, stored
from pairloom.plans.tables import part_sources

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_blocks_join_without_a_shuffle(spark):
    blocked = [blocking.initials_hash(df, ["paper_title"]).select("value", "index") for df in part_sources(spark, FOLDER)]
    tables = [stored.store(df, ["value"]) for df in blocked]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        groups, counts = stored.match_stored(*tables, ["value"]), stored.matched_stored(*tables, ["value"])
        for found in (groups, counts):
            assert "Exchange" not in plan(found) and "Join" in plan(found)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(groups) == rows(matching.match_equal(*blocked, ["value"]))
    assert rows(counts) == rows(matching.matched_keys(*blocked, ["value"]))


def test_bins_from_a_table(spark):
    rng = random.Random(2)
    bins = [(k, k + 1, f"y{k}") for k in range(-50, 50)] + [(-1000, 1000, "wide"), (7, 7, "empty"), (9, 3, "turned"), (0, 64, "power")]
    bins += [(a, a + rng.randrange(1, 90), f"r{a}") for a in rng.sample(range(-200, 200), 80)]
    records = [(i, rng.randrange(-1200, 1200)) for i in range(400)] + [(900, None), (901, 64), (902, 0), (903, -50)]
    found = stored.in_bins(
        spark.createDataFrame(records, "id int, year int"), "year", spark.createDataFrame(bins, "low int, high int, label string")
    )
    expected = sorted((i, y, name) for i, y in records for low, high, name in bins if y is not None and low <= y < high)
    assert sorted(map(tuple, found.collect())) == expected
    parts = [(k / 10, (k + 1) / 10, k) for k in range(10_000)]
    values = [(i, rng.random() * 1100) for i in range(500)]
    found = stored.in_bins(spark.createDataFrame(values, "id int, v double"), "v", spark.createDataFrame(parts, "low double, high double, label int"))
    assert sorted(map(tuple, found.collect())) == sorted((i, v, k) for i, v in values for low, high, k in parts if low <= v < high)
    none = spark.createDataFrame([], "low int, high int, label string")
    assert stored.in_bins(spark.createDataFrame(records, "id int, year int"), "year", none).count() == 0


def test_labels_agree_with_the_fixed_bins(spark):
    records = spark.createDataFrame([(str(y), y) for y in range(1990, 2010)], "index string, year int")
    table = spark.createDataFrame(list(zip(blocking.YEAR_BOUNDS[:-1], blocking.YEAR_BOUNDS[1:], blocking.YEAR_LABELS)), "low int, high int, label string")
    expected = blocking.year_ranges(records).select("index", "year", "blocking_key")
    assert sorted(stored.in_bins(records, "year", table).collect()) == sorted(expected.collect())


def test_totals_of_bins(spark):
    """Totals equal those of the listed rows: bins that overlap, are empty, repeated, or share a label, and missing values and numbers."""
    rng = random.Random(6)
    bins = [(a, a + rng.randrange(-3, 90), rng.choice(["x", "y", None, f"r{a}"])) for a in rng.choices(range(-200, 200), k=150)]
    bins += [(-1000, 1000, "wide"), (-1000, 1000, "wide"), (None, 5, "open"), (500, 600, "nobody"), (300, 301, "one")]
    records = [(rng.choice([None, i]), rng.randrange(-250, 250)) for i in range(300)] + [(7, None), (None, 300)]
    records, bins = spark.createDataFrame(records, "id bigint, year int"), spark.createDataFrame(bins, "low bigint, high bigint, label string")
    found = stored.in_bins(records, "year", bins, totals={"ids": "id"})
    listed = stored.in_bins(records, "year", bins).groupBy("label")
    expected = listed.agg(F.count(F.lit(1)).alias("records"), F.min("year").alias("least"), F.max("year").alias("greatest"), F.sum("id").alias("ids"))
    assert found.dtypes == expected.dtypes
    key = lambda row: (row[0] is None, row)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(map(tuple, expected.collect()), key=key)
    assert stored.in_bins(records, "year", bins.limit(0), totals={}).count() == 0


def test_totals_of_wide_bins_list_no_rows(spark):
    """Four thousand million records in bins: each counts once for each bin."""
    records = spark.range(65_536).selectExpr("id", "id % 1000 / 1000D AS v")
    bins = spark.range(65_536).selectExpr("-1D AS low", "1D + id / 100000 AS high", "id AS label")
    found = stored.in_bins(records, "v", bins, totals={"ids": "id"}).selectExpr("count(*)", "sum(records)", "max(ids)", "min(ids)").first()
    assert tuple(found) == (65_536, 65_536**2, 65_536 * 65_535 // 2, 65_536 * 65_535 // 2)


def test_only_whole_numbers_are_added_up(spark):
    bins = spark.createDataFrame([(0, 1, "a")], "low int, high int, label string")
    with pytest.raises(ValueError):
        stored.in_bins(spark.range(3).selectExpr("id", "1.5D AS v"), "id", bins, totals={"v": "v"})
