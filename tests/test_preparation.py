import math

import pytest
from pyspark.sql import functions as F

from pairloom.operators import clean, profile
from pairloom.plans import sweeps
from pairloom.schema import RECORD
from pairloom.sources import readers, writers

CITATIONS = (
    "#*First  title\n#@A. One, B. Two\n#t1999\n#cSIGMOD Conference\n#index007\n#%ignored\n"
    "\n#*Old\n#*Later title \n#tunknown\n#cVLDB\n#index8\n \t\n\n\n#@No Title\n#t2001\n#cvldb j.\n\n"
    "#*Outside\n#t1980\n#cSIGMOD\n#index9"
)


def test_citations(spark, tmp_path):
    (tmp_path / "c.txt").write_text(CITATIONS)
    rows = {r.paper_title: r for r in readers.read_citations(spark, str(tmp_path / "c.txt")).collect()}
    assert set(rows) == {"First  title", "Later title", None, "Outside"}
    assert rows["First  title"]["index"] == "007" and rows["First  title"].author_names == "A. One, B. Two"
    assert rows["Later title"].year == "unknown" and rows[None].year == "2001"
    (tmp_path / "w.txt").write_bytes(CITATIONS.replace("\n", "\r\n").encode())
    windows = readers.read_citations(spark, str(tmp_path / "w.txt")).collect()
    assert sorted(map(str, windows)) == sorted(map(str, rows.values()))


def test_prepare(spark, tmp_path):
    (tmp_path / "c.txt").write_text(CITATIONS)
    raw = readers.read_citations(spark, str(tmp_path / "c.txt"))
    rows = {r.paper_title: r for r in clean.prepare(raw).collect()}
    assert set(rows) == {"first titl", "untitl"}  # the mean fill of 1993 falls outside the range
    assert rows["first titl"].publication_venue == "sigmod confer"
    assert rows["untitl"].author_names == "no title" and len(rows["untitl"]["index"]) == 32
    assert clean.prepare(raw, fill="median").count() == 3
    assert clean.prepare(raw).schema["year"].dataType.simpleString() == "int"


def years(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "year string")


@pytest.mark.parametrize("method,value", [("mean", 2.25), ("median", 2.0), ("mode", 1.0)])
def test_fill_years(spark, method, value):
    df = clean.fill_years(clean.parse_year(years(spark, "1", "1", "3", "4", "x", None)), method.upper())
    assert sorted(r.year for r in df.collect()) == sorted([1, 1, 3, 4, value, value])


def test_unknown_fill_is_refused(spark):
    with pytest.raises(ValueError):
        clean.fill_years(clean.parse_year(years(spark, "1")), "max")


def test_year_cast_cuts_towards_zero(spark):
    df = spark.createDataFrame([(1999.9,), (-1.5,)], "year double")
    assert [r.year for r in clean.integer_year(df).collect()] == [1999, -1]


def test_profile(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 1, 2, 2, 9)], "year double")
    row = profile.shape(df).first()
    assert (row.skewness, row.kurtosis) == pytest.approx((1.419, 0.143), abs=1e-3)
    assert (row.lean, row.tails) == ("right", "flat")
    assert {(r.bin, r.n) for r in profile.histogram(df).collect()} == {(1, 2), (2, 2), (10, 1)}
    flat = spark.createDataFrame([(5.0,), (5.0,), (None,)], "year double")
    assert [tuple(r) for r in profile.histogram(flat).collect()] == [(1, 2)]
    assert profile.null_counts(flat).first().year == 1
    assert math.isnan(profile.moments(flat).first().skewness or math.nan)


def test_round_trips(spark, tmp_path):
    records = spark.createDataFrame([("A \"t\"", "n, m", 1999, "vldb", "007")], RECORD)
    writers.write_records(records, str(tmp_path / "r"))
    assert readers.read_records(spark, str(tmp_path / "r")).collect() == records.collect()
    pairs = spark.createDataFrame([("01", "2")], "id1 string, id2 string")
    writers.write_pairs(pairs, str(tmp_path / "p"))
    assert readers.read_pairs(spark, str(tmp_path / "p")).collect() == pairs.collect()
    part = next((tmp_path / "p").glob("part-*.csv")).read_text()
    assert part.splitlines()[0] == "dblp_index,acm_index"
    scored = pairs.withColumn("sim", F.lit(0.9))
    for _ in range(2):
        writers.write_scored_pairs(scored, str(tmp_path / "s"))
    assert spark.read.csv(str(tmp_path / "s"), header=True).count() == 1


def test_cluster_lines(spark, tmp_path):
    rows = [("c", "2"), ("c", "1")] + [("big", str(i)) for i in range(50)]
    held = spark.createDataFrame(rows, "cluster_id string, id string")
    lines = [r.value for r in writers.cluster_lines(held, 10).collect()]
    assert "Cluster c.0: {1, 2}" in lines
    big = [line for line in lines if line.startswith("Cluster big.")]
    ids = [i for line in big for i in line[line.index("{") + 1 : -1].split(", ")]
    assert len(big) > 1 and sorted(ids) == sorted(str(i) for i in range(50))
    writers.write_clusters(held, str(tmp_path / "c"))
    assert spark.read.text(str(tmp_path / "c")).count() == 2


def test_replicate(spark):
    df = spark.createDataFrame([("t", "a", 1999, "v", "1")], RECORD)
    rows = {(r.replica, r["index"], r.paper_title) for r in sweeps.replicate(df, 3).collect()}
    assert rows == {(0, "1", "t"), (1, "1-1", "t 1"), (2, "1-2", "t 2")}
    with pytest.raises(ValueError):
        sweeps.replicate(df, 0)


def test_replication_sweep_counts_every_copy(spark):
    from pairloom.plans import sweeps

    left = spark.createDataFrame([("1", "big red"), ("2", None), ("3", ""), ("4", "other")], "index string, paper_title string")
    right = spark.createDataFrame([("5", "blue rose"), ("6", None), ("7", "big red 1")], "index string, paper_title string")
    # Keys of copy r: own initials and the first character of r; missing and empty texts have that alone.
    keys = lambda own, r: [(o or "") + str(r)[:1] if r else o for o in own if r or o is not None]
    got = {r.factor: (r.records, int(r.matches)) for r in sweeps.replication_sweep(left, right, 12).collect()}
    for most in range(1, 13):
        ones = [k for r in range(most) for k in keys(["br", None, "", "o"], r)]
        twos = [k for r in range(most) for k in keys(["br", None, "br1"], r)]
        assert got[most] == (len(ones) + len(twos), sum(a == b for a in ones for b in twos))
