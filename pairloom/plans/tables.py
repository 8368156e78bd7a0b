"""Records for entity resolution drawn from the given tables. Every table is used whole."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

# The two sources to link: documents by collection, parts by brand.
FIRST_COLLECTIONS = tuple(f"src{i}" for i in range(10))
FIRST_BRANDS = tuple(f"Brand#{i}" for i in range(1, 14))

# Venue settings for documents, whose venue is their language.
LANGUAGE_VENUE = {"venue_rules": (("en", "en"),), "venue_default": "other"}
LANGUAGES = ("en", "de")
BRANDS = ("Brand#1", "Brand#2")


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{table}.parquet"))


def read_text(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table with long texts.

    One row group is read by one task. Whoever has files of few, large row groups can set
    ``pairloom.text.partitions`` to have their rows dealt out first.
    """
    df = read(spark, folder, table)
    partitions = spark.conf.get("pairloom.text.partitions", None)
    return df.repartition(int(partitions)) if partitions else df


def document_records(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as records, with the collection they come from.

    Title: the whole text. Authors: its distinct capitalised words. Year: 1990 plus the number of bits
    of the length, so that copies agree. Venue: the language.
    """
    names = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\p{Lu}\p{L}*"), F.lit(0)))
    return read_text(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("index"),
        F.col("text").alias("paper_title"),
        F.array_join(names, " ").alias("author_names"),
        (F.length(F.bin("n_chars")) + 1990).alias("year"),
        F.col("lang").alias("publication_venue"),
        "source",
    )


def document_sources(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    records = document_records(spark, folder)
    first = F.coalesce(F.col("source").isin(*FIRST_COLLECTIONS), F.lit(False))
    return records.filter(first).drop("source"), records.filter(~first).drop("source")


def part_records(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as records: few distinct names, so blocks and classes are large.

    Title: the name. Authors: the type. Year: 1990 plus the size. Venue: the brand.
    """
    return read(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("index"),
        F.col("p_name").alias("paper_title"),
        F.col("p_type").alias("author_names"),
        (F.col("p_size") + 1990).alias("year"),
        F.col("p_brand").alias("publication_venue"),
    )


def part_sources(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    records = part_records(spark, folder)
    first = F.coalesce(F.col("publication_venue").isin(*FIRST_BRANDS), F.lit(False))
    return records.filter(first), records.filter(~first)


def page_records(spark: SparkSession, folder: str) -> DataFrame:
    """Web pages as raw records with gaps.

    Id: the page, missing for mobile hosts. Title: the page title. Authors: the words of the host
    name, missing for ``www`` hosts. Year: the number that ends the path, empty where the path ends
    in anything else. Venue: the language part of the path.
    """

    def found(pattern: str, column: str):
        return F.regexp_extract(column, pattern, 1)

    host = F.translate(found("^https?://([^/:]+)", "url"), ".", " ")
    return read_text(spark, folder, "pages").select(
        F.nullif(found("<title>([^<]*)</title>", "html"), F.lit("")).alias("paper_title"),
        F.when(~host.startswith("www "), host).alias("author_names"),
        found("/([0-9]+)(?:$|[?#])", "url").alias("year"),
        F.nullif(found("/([a-z]{2})/", "url"), F.lit("")).alias("publication_venue"),
        F.when(~host.startswith("m "), F.col("page_id").cast("string")).alias("index"),
    )
