"""From raw documents to training sequences: quality, language, near duplicates, packing.

Every stage works on all that the one before it kept, and its decisions take effect: what it rejects is gone. All
but the last return the columns of ``documents``. Each result is written as Parquet in the shared folder and read again,
so a lost executor costs only its tasks and no stage is computed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairloom.llm import language_id, ngram_join, packing, quality
from pairloom.llm.common import importable, read
from pairloom.llm.queries import BYTE_BPE, language_model
from pairloom.session import write_through


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what fails the base rules or the cutoffs certified on the labelled documents.

    Null and empty texts fail; repeated rows are judged alike, texts of any length whole; without labels, or in an empty
    table, the base rules decide alone.
    """
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those below the calibrated least probability.

    Null and empty texts have no letters; repeated rows are judged alike, texts of any length whole; ties between languages
    do not matter here. Without a labelled row there is no model, and only documents without letters go.
    """
    importable(spark)
    return language_id.keep_identified(docs, language_model(docs))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least doc_id of every group of near duplicates: 5-word windows, 80 %.

    Of texts that share that id the one of least digest stays, and one row of it. Rows without a doc_id and texts
    without words all stay; texts of any length are one set; an empty table stays empty.
    """
    importable(spark)
    return ngram_join.keep_one(docs, n=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place all tokens in sequences of 2048.

    Null and empty texts are an end id alone; repeated rows are packed one by one, long texts cut; an empty table gives no
    rows.
    """
    importable(spark)
    return packing.pack_documents(docs, BYTE_BPE, end_id=0)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", identify_language),
    ("ngram_jaccard", ngram_jaccard),
    ("best_fit_packing", pack),
]

#: Sampled training, components and packing have no SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole documents table."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = write_through(stage(spark, docs, sf_dir))
    return docs
