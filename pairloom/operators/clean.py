"""Preparing raw records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom.functions.stem import stem_words
from pairloom.functions.text import normalise, strip_punctuation
from pairloom.schema import RECORD_COLUMNS
from pairloom.session import write_through

# Stand-ins for missing text (the second is spelled this way on purpose).
DEFAULTS = {"paper_title": "Untitled", "author_names": "unamed"}
VENUE_PATTERN = "SIGMOD|VLDB"
FIRST_YEAR, LAST_YEAR = 1995, 2004

#: Ways to fill missing years.
FILLS = ("mean", "median", "mode")
#: Text that spells a number.
NUMBER = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"


def _middle(counts: DataFrame, total: int) -> float:
    """Median from (year, n): distinct years are sorted over partitions, and only partition totals are gathered."""
    held = write_through(
        counts.repartitionByRange("year").select("year", "n", F.spark_partition_id().alias("part"))
    )
    before, wanted, found = 0, [(total - 1) // 2, total // 2], []
    for part, n in sorted(held.groupBy("part").agg(F.sum("n")).collect()):
        if any(before <= rank < before + n for rank in wanted):
            so_far = F.sum("n").over(Window.partitionBy("part").orderBy("year"))
            rows = held.filter(F.col("part") == part).select("year", (so_far + before).alias("upto"))
            for rank in wanted:
                if before <= rank < before + n:
                    found.append(rows.filter(F.col("upto") > rank).agg(F.min("year")).first()[0])
        before += n
    return sum(found) / len(found)


def fill_value(df: DataFrame, method: str) -> float | None:
    """The mean, median or smallest mode of the years; null when there is none."""
    if method == "mean":
        return df.agg(F.avg("year")).first()[0]
    counts = df.filter("year IS NOT NULL").groupBy(F.col("year").cast("double").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    total, often = counts.agg(F.sum("n"), F.max(F.struct("n", -F.col("year")))).first()
    if total is None:
        return None
    return -often[1] if method == "mode" else _middle(counts, total)


def parse_year(df: DataFrame) -> DataFrame:
    """Year as a number; anything that does not spell one becomes null."""
    year = F.col("year").cast("string")
    return df.withColumn("year", F.when(year.rlike(NUMBER), F.trim(year).try_cast("double")))


def drop_missing_years(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["year"])


def fill_years(df: DataFrame, method: str) -> DataFrame:
    """Fill missing years with the mean, median or (smallest) mode of the whole column."""
    method = method.lower()
    if method not in FILLS:
        raise ValueError(f"unknown filling method {method!r}; use one of {sorted(FILLS)}")
    fill = F.lit(fill_value(df, method)).cast("double")
    return df.withColumn("year", F.coalesce("year", fill))


def select_range(
    df: DataFrame, first: int = FIRST_YEAR, last: int = LAST_YEAR, venues: str = VENUE_PATTERN
) -> DataFrame:
    """Records of the years ``first`` to ``last`` whose venue matches the pattern in any case."""
    in_years = F.col("year").between(first, last)
    return df.filter(in_years & F.col("publication_venue").rlike(f"(?i){venues}"))


def fill_defaults(df: DataFrame, defaults: Mapping[str, str] = DEFAULTS) -> DataFrame:
    return df.fillna(dict(defaults))


def record_text(columns: Sequence[str]) -> Column:
    """The values as one string that differs whenever they do, missing ones included."""
    text = [F.col(c).cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.lit("v"), F.length(t).cast("string"), F.lit(":"), t), F.lit("n")) for t in text]
    return F.concat(*parts)


def surrogate_ids(df: DataFrame, reproducible: bool = False) -> DataFrame:
    """Give records without an id one of 32 hex digits: random, or the md5 of the record and its occurrence number.

    Equal records are numbered in two levels, so that a record which is repeated very often is not
    gathered in one task.
    """
    if not reproducible:
        return df.withColumn("index", F.coalesce("index", F.replace(F.uuid(), F.lit("-"))))
    others = [c for c in df.columns if c != "index"]
    lacking = write_through(
        df.filter("index IS NULL").select(
            *others, F.md5(record_text(others)).alias("_key"), (F.monotonically_increasing_id() % 64).alias("_salt")
        )
    )
    before = Window.partitionBy("_key").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = lacking.groupBy("_key", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select("_key", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_key", "_salt").orderBy(F.lit(0)))
    number = (F.col("_start") + F.col("_row")).cast("string")
    named = lacking.withColumn("_row", inside).join(starts, ["_key", "_salt"]).withColumn(
        "index", F.md5(F.concat("_key", F.lit("#"), number))
    )
    return df.filter("index IS NOT NULL").unionAll(named.select(*df.columns))


def remove_punctuation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: strip_punctuation(F.col(c)) for c in columns})


def text_columns(df: DataFrame) -> list[str]:
    return [name for name, kind in df.dtypes if kind == "string"]


def clean_text(df: DataFrame) -> DataFrame:
    """Lower-case, trim and collapse whitespace in every string column, ids included."""
    return df.withColumns({c: normalise(F.col(c)) for c in text_columns(df)})


def stem(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: stem_words(F.col(c)) for c in columns})


def integer_year(df: DataFrame) -> DataFrame:
    """Cut the year to an integer, towards zero."""
    return df.withColumn("year", F.col("year").cast("int"))


def drop_duplicates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One record per combination of values; keeps the smallest id when there is one."""
    columns = list(columns or [c for c in df.columns if c != "index"])
    rest = [c for c in df.columns if c not in columns]
    if rest == ["index"]:
        # Only digests and ids are grouped; the texts are fetched once for the ids that stay.
        keyed = df.withColumn("_key", F.md5(record_text(columns)))
        kept = keyed.groupBy("_key").agg(F.min("index").alias("index")).select("_key", F.col("index").alias("_kept"))
        one = keyed.join(kept, "_key").filter(F.col("index").eqNullSafe(F.col("_kept")))
        repeated = Window.partitionBy("_key").orderBy(F.lit(0))
        return one.withColumn("_row", F.row_number().over(repeated)).filter("_row = 1").select(*df.columns)
    return df.dropDuplicates(columns)


def prepare(
    raw: DataFrame,
    fill: str = "mean",
    first: int = FIRST_YEAR,
    last: int = LAST_YEAR,
    venues: str = VENUE_PATTERN,
    stemmed: bool = True,
    reproducible_ids: bool = False,
) -> DataFrame:
    """Raw text records to clean ones, in one plan; only the year fill is a separate aggregate."""
    cleaned = ("paper_title", "publication_venue")
    df = fill_years(parse_year(raw), fill)
    df = surrogate_ids(fill_defaults(select_range(df, first, last, venues)), reproducible_ids)
    df = clean_text(remove_punctuation(df, cleaned))
    if stemmed:
        df = stem(df, cleaned)
    return integer_year(df).select(*RECORD_COLUMNS)
