import os
import random
from itertools import product

import pytest
from pyspark.sql import functions as F
from test_functions import python_scores

from pairloom import session
from pairloom.functions.text import token_set
from pairloom.operators import blocking, matching, setjoin
from pairloom.operators.setjoin import candidate_pairs, possible_pairs, ranked_sets

RECORD = "index string, paper_title string, author_names string, year int, publication_venue string"


def make_records(spark, seed, count, prefix):
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(14)]
    rows = []
    for i in range(count):
        title = " ".join(rng.choices(vocabulary, k=rng.randint(0, 6)))
        if rng.random() < 0.3:  # a third of the records share one title
            title = "t0 t1 T2 t3"
        authors = " ".join(rng.choices(vocabulary[:6], k=rng.randint(1, 3)))
        rows.append((f"{prefix}{i}", title, authors, rng.choice([1999, 2000]), rng.choice(["sigmod", "vldb"])))
    return rows, spark.createDataFrame(rows, RECORD)


@pytest.fixture(scope="module")
def sources(spark):
    left_rows, left = make_records(spark, 1, 45, "l")
    right_rows, right = make_records(spark, 2, 45, "r")
    return left_rows, left.cache(), right_rows, right.cache()


def listed(pairs, left, right, columns):
    members = matching.class_members(left, right, columns)
    return sorted(tuple(r) for r in matching.expand_classes(pairs, members).collect())


def brute(left_rows, right_rows, columns, measure, threshold, strict=False, same=()):
    names = ("index", "paper_title", "author_names", "year", "publication_venue")
    found = []
    for a, b in product(left_rows, right_rows):
        a, b = dict(zip(names, a)), dict(zip(names, b))
        if any(a[c] != b[c] for c in same):
            continue
        total = 0.0
        for c in columns:
            total += python_scores(str(a[c]).lower().split(), str(b[c]).lower().split())[measure]
        mean = total / len(columns)
        if mean > threshold or (mean == threshold and not strict):
            found.append((a["index"], b["index"]))
    return sorted(found)


@pytest.mark.parametrize("measure", ["jaccard", "dice", "edit"])
@pytest.mark.parametrize("threshold", [0.6, 0.75, 0.85])
def test_title_join_equals_all_pairs(sources, measure, threshold):
    left_rows, left, right_rows, right = sources
    pairs = matching.similar_records(left, right, ["paper_title"], threshold, measure=measure)
    expected = brute(left_rows, right_rows, ["paper_title"], measure, threshold)
    assert listed(pairs, left, right, ["paper_title"]) == expected
    assert expected


@pytest.mark.parametrize("measure,threshold", [("jaccard", 0.7), ("jaccard", 0.85), ("edit", 0.85)])
def test_four_column_join_equals_all_pairs(sources, measure, threshold):
    left_rows, left, right_rows, right = sources
    texts, single = ["author_names", "paper_title"], ["year", "publication_venue"]
    pairs = matching.similar_records(left, right, texts, threshold, single=single, measure=measure)
    expected = brute(left_rows, right_rows, texts + single, measure, threshold)
    assert listed(pairs, left, right, texts + single) == expected
    assert expected


def test_block_and_strict(sources):
    left_rows, left, right_rows, right = sources
    pairs = matching.similar_records(
        left, right, ["paper_title"], 0.75, block=["year"], strict=True
    )
    expected = brute(left_rows, right_rows, ["paper_title"], "jaccard", 0.75, True, ["year"])
    assert listed(pairs, left, right, ["year", "paper_title"]) == expected


def test_threshold_without_a_bound_is_refused(sources):
    _, left, _, right = sources
    with pytest.raises(ValueError):
        matching.similar_records(left, right, ["paper_title"], 0.5, measure="edit")


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.61, 0.7, 0.85, 1.0])
@pytest.mark.parametrize("frequent", [0, 3, None, 10_000])
def test_frequent_tokens_lose_no_pair(sources, threshold, frequent):
    left_rows, left, right_rows, right = sources
    sets = [
        df.select(F.col("index").alias("id"), token_set(F.col("paper_title")).alias("s"))
        for df in (left, right)
    ]
    ranked = ranked_sets(*sets, "s")
    found = candidate_pairs(ranked, threshold, frequent=frequent)
    found = {tuple(r) for r in possible_pairs(found, ranked, threshold).collect()}
    assert found >= set(brute(left_rows, right_rows, ["paper_title"], "jaccard", threshold))


@pytest.mark.parametrize("threshold", [0.25, 0.4, 0.5, 0.6])
@pytest.mark.parametrize("frequent", [0.5, 40.0])
def test_combinations_lose_no_pair(spark, monkeypatch, threshold, frequent):
    """Few tokens that nearly all sets hold: whatever two sets share is frequent."""
    monkeypatch.setattr(setjoin, "COMBINED", 1e9)
    rng = random.Random(11)
    sides = [[(f"{s}{k}", sorted(rng.sample("abcdefghijkl", rng.randrange(1, 10)))) for k in range(60)] for s in "xy"]
    ranked = ranked_sets(*[spark.createDataFrame(side, "id string, s array<string>") for side in sides], "s")
    found = {tuple(r) for r in candidate_pairs(ranked, threshold, frequent=frequent).collect()}
    expected = {(a, b) for a, x in sides[0] for b, y in sides[1] if len({*x} & {*y}) >= threshold * len({*x} | {*y})}
    assert expected and found >= expected


@pytest.mark.parametrize("threshold,need", [(0.7, 3), (0.85, 4)])
def test_equal_records(sources, threshold, need):
    left_rows, left, right_rows, right = sources
    columns = ["author_names", "paper_title", "year", "publication_venue"]
    groups = matching.equal_records(left, right, columns, threshold)
    found = matching.expand_groups(groups, ["agreeing", "group"]).collect()
    expected = brute(left_rows, right_rows, columns, "exact", threshold)
    assert sorted(tuple(r) for r in found) == expected


def test_match_equal_lists_both_sides(sources):
    left_rows, left, right_rows, right = sources
    l, r = (blocking.initials_hash(df, ["paper_title"]) for df in (left, right))
    groups = matching.match_equal(l, r, ["value"])
    found = {tuple(p) for p in matching.expand_groups(groups, ["value"]).collect()}
    key = lambda row: "".join(w[0] for w in row[1].split())
    expected = {(a[0], b[0]) for a, b in product(left_rows, right_rows) if key(a) == key(b)}
    assert found == expected
    sizes = matching.matched_keys(l, r, ["value"]).selectExpr("sum(n1 * n2)").first()[0]
    assert sizes == len(expected)


# ------------------------------------------------------------------------------- blocking


def edge_records(spark):
    return spark.createDataFrame(
        [
            ("1", "a quick test", "ann lee, bo", 1995, "sigmod vldb record"),
            ("2", "all quiet today", "al b", 2004, "vldb"),
            ("3", "x", "", 2005, "pods"),
            ("4", "", "z", 1994, "sigmod"),
            ("1", "a quick test", "ann lee, bo", 1995, "sigmod vldb record"),
        ],
        RECORD,
    )


def test_initials_blocks_hold_each_id_once(spark):
    blocked = blocking.initials_hash(edge_records(spark), ["paper_title", "year", "publication_venue"])
    rows = {(r.blocking_key, r["index"]) for r in blocking.members(blocked).collect()}
    assert rows == {
        ("aqt1995sigmod", "1"), ("aqt2004vldb", "2"), ("x2005vldb", "3"), ("1994sigmod", "4"),
    }
    assert blocking.members(blocked).count() == 4


def test_two_publishers_and_bins(spark):
    blocked = blocking.year_and_publisher(edge_records(spark))
    rows = {(r.blocking_key, r["index"]) for r in blocked.collect()}
    assert rows == {("1995-sigmod", "1"), ("1995-vldb", "1"), ("2004-vldb", "2")}
    assert blocking.year_ranges(edge_records(spark)).count() == 3
    assert blocking.year_and_publisher(edge_records(spark), years=2004).count() == 1
    assert blocking.year_and_publisher(edge_records(spark), years=(1995, 2004)).count() == 4


def test_short_texts_share_the_empty_ngram_key(spark):
    blocked = blocking.full_ngrams(edge_records(spark), 2, ["paper_title"])
    keys = {r["index"]: r.blocking_key for r in blocked.collect()}
    assert keys["3"] == keys["4"] != keys["1"]
    values = {r["index"]: r.value.paper_title for r in blocked.collect()}
    assert values["3"] == [] and values["1"][:2] == ["a ", " q"]


def test_lengths_count_none(spark):
    df = spark.createDataFrame([("1", None, "ab", None, "v")], RECORD)
    row = blocking.named_lengths(df, ["paper_title", "author_names", "year"]).first()
    assert row.blocking_key == "Lengths_4_2_4" and row.value.author_names == 2


def test_nested_and_stats(spark):
    outer = blocking.year_and_publisher(edge_records(spark))
    inner = blocking.nested(outer, blocking.initials_hash, ["paper_title"])
    assert {(r.outer_key, r.blocking_key) for r in inner.collect()} == {
        ("1995-sigmod", "aqt"), ("1995-vldb", "aqt"), ("2004-vldb", "aqt"),
    }
    stats = blocking.block_stats(blocking.initials_hash(edge_records(spark), ["paper_title"])).first()
    assert (stats.blocks, stats.records, stats.pairs) == (3, 5, 3)


@pytest.mark.parametrize("threshold", [0.62, 0.7, 0.8, 0.9])
def test_neighbouring_tokens_lose_no_pair(spark, threshold):
    """Sets of all sizes whose tokens are nearly all frequent."""
    rng = random.Random(int(threshold * 100))
    sides = []
    for _ in range(2):
        rows = []
        for i in range(150):
            base = rng.choice([[f"a{k}" for k in range(n)] for n in (1, 2, 3, 4, 6, 9, 14, 30)])
            kept = [t for t in base if rng.random() > 0.12] + [f"z{rng.randint(0, 40)}" for _ in range(rng.randint(0, 2))]
            rows.append((i, sorted(set(kept))))
        sides.append(rows)
    frames = [spark.createDataFrame(rows, "id int, s array<string>") for rows in sides]
    ranked = ranked_sets(*frames, "s")
    expected = set()
    for (i, a), (j, b) in product(*sides):
        common = len(set(a) & set(b))
        if a and b and common >= threshold * (len(a) + len(b) - common):
            expected.add((i, j))
    for frequent in (0, 5, None, 1000):
        pairs = possible_pairs(candidate_pairs(ranked, threshold, frequent=frequent), ranked, threshold)
        assert {tuple(r) for r in pairs.collect()} >= expected
    assert len(expected) > 100


def test_records_of_few_values_are_joined_by_value(spark, monkeypatch):
    """Where every column has to be similar, records with equal values in one column alone are no candidates."""
    rng = random.Random(5)
    make = lambda prefix, venue: [
        (f"{prefix}{i}", f"big bolt no{rng.randrange(3)}", f"t{rng.randrange(30)} x", 1990 + rng.randrange(2), venue) for i in range(60)
    ]
    rows = make("l", "one"), make("r", "two")
    left, right = (spark.createDataFrame(r, RECORD) for r in rows)
    seen = []
    reach = matching._within_reach
    monkeypatch.setattr(matching, "_within_reach", lambda pairs, *rest: seen.append(pairs.count()) or reach(pairs, *rest))
    options = {"single": ["year", "publication_venue"], "measure": "edit", "order": ["author_names", "paper_title", "year", "publication_venue"]}
    pairs = matching.similar_records(left, right, ["author_names", "paper_title"], 0.85, **options)
    expected = brute(*rows, options["order"], "edit", 0.85)
    assert expected and listed(pairs, left, right, ["author_names", "paper_title", "year", "publication_venue"]) == expected
    assert sum(seen) < 4 * len(expected)


@pytest.mark.parametrize("measure,threshold", [("jaccard", 0.7), ("dice", 0.7), ("edit", 0.85)])
def test_fingerprints_lose_no_pair(spark, monkeypatch, measure, threshold):
    """Sets larger than the number of fingerprints, so that many items share one."""
    monkeypatch.setattr(matching, "fingerprints", lambda items: F.array_distinct(F.transform(items, lambda i: (F.pmod(F.xxhash64(i), F.lit(7))).cast("short"))))
    rng = random.Random(8)
    rows = [[(f"{s}{i}", " ".join(rng.sample("abcdefghijklmnop", 14)), "", 1, "") for i in range(30)] for s in "lr"]
    left, right = (spark.createDataFrame(r, RECORD) for r in rows)
    pairs = matching.similar_records(left, right, ["paper_title"], threshold, measure=measure)
    assert listed(pairs, left, right, ["paper_title"]) == brute(*rows, ["paper_title"], measure, threshold)


def test_pairs_are_verified_from_few_candidates(spark, monkeypatch):
    """Long texts fill the bitmaps, which then rule out nothing: whole sets move for pairs within reach only."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(9000)]
    base = rng.sample(words, 3000)
    text = lambda share: " ".join(base[: int(3000 * share)] + rng.sample(words, 3000 - int(3000 * share)))
    rows = [[(f"{s}{i}", text(0.45), "", 1, "") for i in range(12)] + [(f"{s}x", " ".join(base), "", 1, "")] for s in "lr"]
    left, right = (spark.createDataFrame(r, RECORD) for r in rows)
    kept = []
    reach = matching._within_reach
    monkeypatch.setattr(matching, "_within_reach", lambda *args: kept.append(reach(*args)) or kept[-1])
    pairs = matching.similar_records(left, right, ["paper_title"], 0.7, measure="dice")
    sets = [[(r[0], set(r[1].split())) for r in side] for side in rows]
    expected = sorted((a, b) for (a, x), (b, y) in product(*sets) if 2 * len(x & y) >= 0.7 * (len(x) + len(y)))
    assert expected and listed(pairs, left, right, ["paper_title"]) == expected
    assert kept[0].count() <= len(expected) + 10


@pytest.mark.parametrize("threshold", [0.5, 0.7])
def test_tokens_that_share_a_place_lose_no_pair(spark, monkeypatch, threshold):
    """Eight places for all tokens; sets stay where they are while they are ranked."""
    monkeypatch.setattr(setjoin, "PLACES", 3)
    plans = []
    write = setjoin.write_through
    monkeypatch.setattr(setjoin, "write_through", lambda df: plans.append(df._jdf.queryExecution().toString()) or write(df))
    rng = random.Random(3)
    near = lambda: [f"t{i}" for i in range(12) if rng.random() > 0.15] + [f"u{rng.randrange(9)}"]
    sides = [[(f"{s}{k}", near() if k % 2 else rng.sample([f"t{i}" for i in range(25)], rng.randrange(0, 12))) for k in range(80)] for s in "xy"]
    ranked = ranked_sets(*[spark.createDataFrame(side, "id string, s array<string>") for side in sides], "s")
    assert len(plans) == 1 and "Exchange" not in plans[0]
    expected = {(a, b) for a, x in sides[0] for b, y in sides[1] if {*x} & {*y} and len({*x} & {*y}) >= threshold * len({*x} | {*y})}
    for frequent in (3, 1000):
        pairs = possible_pairs(candidate_pairs(ranked, threshold, frequent=frequent), ranked, threshold)
        assert {tuple(r) for r in pairs.collect()} >= expected
    assert expected


@pytest.mark.parametrize("measure,threshold", [("jaccard", 0.5), ("dice", 0.85)])
def test_slices_lose_no_pair_and_leave_nothing(sources, spark, monkeypatch, tmp_path, measure, threshold):
    """Many slices give all pairs, and of all tables only the sets, two lists of pairs and no shuffle files stay."""
    monkeypatch.setattr(setjoin, "FEW", 20)
    monkeypatch.setattr(setjoin, "MEETINGS", 0)
    monkeypatch.setattr(matching, "FEW", 20)
    monkeypatch.setattr(matching, "AT_A_TIME", 0)
    monkeypatch.setattr(setjoin, "COUNTED", 1)
    monkeypatch.setattr(session, "_written", {})
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    counts = []
    slices = setjoin._slices
    monkeypatch.setattr(setjoin, "_slices", lambda *args: counts.append(slices(*args)) or counts[-1])
    before = spark.conf.get("spark.sql.parquet.compression.codec")
    left_rows, left, right_rows, right = sources
    pairs = matching.similar_records(left, right, ["paper_title"], threshold, measure=measure)
    assert len(os.listdir(tmp_path)) == 3 and spark.conf.get("spark.sql.parquet.compression.codec") == before
    assert listed(pairs, left, right, ["paper_title"]) == brute(left_rows, right_rows, ["paper_title"], measure, threshold)
    assert counts[0] > 3
    session.release(spark)
    assert len(os.listdir(tmp_path)) == 0


def test_a_step_leaves_no_shuffle_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "_written", {})
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    shuffles = lambda: spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    before = shuffles()
    with session.step(spark) as keep:
        session.write_through(spark.range(50).repartition(5, "id"))
        kept = keep(spark.range(30).repartition(3, "id"), spark.range(5))
    assert shuffles() <= before and len(os.listdir(tmp_path)) == 1 and kept.count() == 35
    session.release(spark)


def test_pairs_are_verified_in_turns(spark, monkeypatch, tmp_path):
    """Whole sets move for the pairs of one turn; what is given is written, and shuffles none of them again."""
    monkeypatch.setattr(matching, "FEW", 20)
    monkeypatch.setattr(matching, "AT_A_TIME", 0)
    monkeypatch.setattr(session, "_written", {})
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    rows = [[(f"{s}{i}", " ".join(rng.sample(words, rng.randrange(6, 12))), "", 1, "") for i in range(40)] for s in "lr"]
    left, right = (spark.createDataFrame(r, RECORD) for r in rows)
    turns, write = [], session.write_through
    monkeypatch.setattr(session, "write_through", lambda *parts: turns.append(len(parts)) or write(*parts))
    pairs = matching.similar_records(left, right, ["paper_title"], 0.7)
    expected = brute(*rows, ["paper_title"], "jaccard", 0.7)
    assert turns[-1] > 3 and "Join" not in pairs._jdf.queryExecution().toString()
    assert expected and listed(pairs, left, right, ["paper_title"]) == expected
    session.release(spark)
    assert os.listdir(tmp_path) == []


def test_a_discarded_table_is_gone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "_written", {})
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    one, two = session.write_through(spark.range(5)), session.write_through(spark.range(7))
    session.discard(one)
    assert len(os.listdir(tmp_path)) == 1 and two.count() == 7
    session.release(spark)
    assert os.listdir(tmp_path) == []
