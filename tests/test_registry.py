"""Blockings and similarities by name."""

import pytest

from pairloom.operators import blocking, matching, registry
from pairloom.plans.tables import part_records, part_sources

FOLDER = "/root/testdata/sf0.001"


def test_names_find_what_they_name(spark):
    left, right = part_sources(spark, FOLDER)
    rows = lambda df: sorted(map(tuple, df.collect()))
    dice = matching.similar_records(left, right, ["paper_title"], 0.85, measure="dice")
    assert rows(registry.match_by(left, right, "paper_title", "dice", 0.85)) == rows(dice)
    assert all(r[-1] >= 0.85 for r in registry.match_by(left, right, "paper_title", "ratio", 0.85).collect())
    blocked = registry.block_by(part_records(spark, FOLDER), "full_hash", ["paper_title"])
    assert rows(blocked) == rows(blocking.full_hash(part_records(spark, FOLDER), ["paper_title"]))


def test_unknown_names_are_refused(spark):
    left, right = part_sources(spark, FOLDER)
    with pytest.raises(ValueError, match="ratio"):
        registry.match_by(left, right, "paper_title", "cosine", 0.85)
    with pytest.raises(ValueError, match="year_ranges"):
        registry.block_by(left, "soundex")


def test_own_similarities_can_be_added(spark, monkeypatch):
    left, right = part_sources(spark, FOLDER)
    monkeypatch.setitem(registry.SIMILARITIES, "none", lambda left, right, column, threshold: left.limit(0))
    assert registry.match_by(left, right, "paper_title", "none", 0.5).count() == 0
