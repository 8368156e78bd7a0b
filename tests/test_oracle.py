"""A sample of the named queries against DuckDB; ``oracle_check.py`` runs them all."""

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SAMPLE = (
    "clean_text augment_title augment_compose filter_range_venue surrogate_ids prepare_records "
    "year_shape year_histogram block_initials_hash block_full_ngram3 block_two_level match_full_ngram "
    "match_counts baseline_jac_title_70 baseline_jac_85 baseline_exact_70 baseline_dice_chars_70 "
    "baseline_edit_70 clusters_components clusters_first_fit evaluate_blocking sweep_columns "
    "roundtrip_raw_records match_url_ratio_85 block_year_bins block_by_name baseline_edit_title_85"
).split()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, con, name):
    result = compare(spark, con, FOLDER, name, entry.queries()[name], entry.oracle_sql()[name])
    assert result.startswith("ok"), result


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
