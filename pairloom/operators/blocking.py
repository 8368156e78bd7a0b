"""Blocking: every function tags records with ``blocking_key`` (and ``value``), one row per record.

Blocks are never gathered into one row or one list. A block is the set of rows that carry its key, so
a block with a third of all records is as harmless as any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.functions.text import canonical_venue, initials, ngrams

# The two venues and the yearly bins of the bibliographic data.
VENUE_RULES = (("sigmod", "sigmod"),)
VENUE_DEFAULT = "vldb"
PUBLISHERS = ("sigmod", "vldb")
YEAR_BOUNDS = (1995, 1996, 1997, 1998, 1999, 2000, 2001, 2002, 2003, 2004, 2005)
YEAR_LABELS = tuple(str(year) for year in YEAR_BOUNDS[:-1])

INITIAL_COLUMNS = ("author_names", "paper_title")
VENUE_COLUMN = "publication_venue"


def initials_key(
    columns: Sequence[str],
    venue_rules: Sequence[tuple[str, str]] | None = VENUE_RULES,
    venue_default: str = VENUE_DEFAULT,
) -> Column:
    """Initials of authors and title, the canonical venue and the year, in the caller's order.

    ``venue_rules=None`` keeps the venue as it is.
    """

    def part(name: str) -> Column:
        if name in INITIAL_COLUMNS:
            return initials(F.col(name))
        if name == VENUE_COLUMN and venue_rules is not None:
            return canonical_venue(F.col(name), venue_rules, venue_default)
        return F.col(name).cast("string")

    return F.concat(*[part(name) for name in columns])


def initials_hash(df: DataFrame, columns: Sequence[str], **venue) -> DataFrame:
    """Key: the initials; value: their md5."""
    return df.withColumn("blocking_key", initials_key(columns, **venue)).withColumn(
        "value", F.md5("blocking_key")
    )


def full_hash(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Key and value: md5 of the column values joined without a separator."""
    digest = F.md5(F.concat(*[F.col(c).cast("string") for c in columns]))
    return df.withColumn("blocking_key", digest).withColumn("value", F.col("blocking_key"))


def initials_ngrams(df: DataFrame, n: int, columns: Sequence[str], **venue) -> DataFrame:
    """Key: the initials; value: the n-grams of the key."""
    return df.withColumn("blocking_key", initials_key(columns, **venue)).withColumn(
        "value", ngrams(F.col("blocking_key"), n)
    )


def same_ngrams_key(text: Column, n: int) -> Column:
    """A string that is equal exactly when the n-gram lists are equal.

    A list of overlapping windows spells out its text, so only texts shorter than ``n``, whose lists
    are all empty, need to be mapped together. No window has to be built for the comparison.
    """
    return F.when(F.length(text) < n, F.lit("")).otherwise(text)


def full_ngrams_key(n: int, columns: Sequence[str], **venue) -> Column:
    """sha256 that is equal when every column has the same n-grams."""
    parts = [same_ngrams_key(_full_text(c, **venue), n).alias(c) for c in columns]
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def _full_text(name: str, venue_rules=VENUE_RULES, venue_default=VENUE_DEFAULT) -> Column:
    if name == VENUE_COLUMN and venue_rules is not None:
        return canonical_venue(F.col(name), venue_rules, venue_default)
    return F.col(name).cast("string")


def full_ngrams(df: DataFrame, n: int, columns: Sequence[str], **venue) -> DataFrame:
    """Key: digest of the n-grams of every column; value: those n-grams, one array per column."""
    value = F.struct(*[ngrams(_full_text(c, **venue), n).alias(c) for c in columns])
    return df.withColumn("blocking_key", full_ngrams_key(n, columns, **venue)).withColumn(
        "value", value
    )


def text_length(name: str) -> Column:
    """Length of the value as text; a missing value counts as the text ``None``."""
    return F.length(F.coalesce(F.col(name).cast("string"), F.lit("None")))


def lengths(df: DataFrame, columns: Sequence[str], prefix: str = "") -> DataFrame:
    """Key: ``prefix`` and the lengths joined by ``_``; value: the lengths."""
    sizes = [text_length(c) for c in columns]
    key = F.concat(F.lit(prefix), F.concat_ws("_", *[s.cast("string") for s in sizes]))
    value = F.struct(*[s.alias(c) for s, c in zip(sizes, columns, strict=True)])
    return df.withColumn("blocking_key", key).withColumn("value", value)


def named_lengths(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return lengths(df, columns, prefix="Lengths_")


def year_label(
    year: Column, bounds: Sequence[int] = YEAR_BOUNDS, labels: Sequence[str] = YEAR_LABELS
) -> Column:
    """Label of the half-open bin [low, high) that holds the year; null outside all bins."""
    if len(bounds) != len(labels) + 1:
        raise ValueError("one more bound than labels is needed")
    label = F.lit(None).cast("string")
    for low, high, name in zip(bounds[:-1], bounds[1:], labels, strict=True):
        label = F.when((year >= low) & (year < high), F.lit(name)).otherwise(label)
    return label


def year_ranges(df: DataFrame, bounds=YEAR_BOUNDS, labels=YEAR_LABELS) -> DataFrame:
    """Key: the year bin. Records outside every bin belong to no block."""
    tagged = df.withColumn("blocking_key", year_label(F.col("year"), bounds, labels))
    return tagged.filter(F.col("blocking_key").isNotNull())


def year_and_publisher(
    df: DataFrame,
    bounds=YEAR_BOUNDS,
    labels=YEAR_LABELS,
    publishers: Sequence[str] = PUBLISHERS,
    years: int | tuple[int, int] | None = None,
) -> DataFrame:
    """Key: year bin and publisher. A venue naming two publishers puts its record in both blocks.

    ``years`` keeps one year, or the half-open range of two years, before blocking.
    """
    if isinstance(years, int):
        df = df.filter(F.col("year") == years)
    elif years is not None:
        df = df.filter((F.col("year") >= years[0]) & (F.col("year") < years[1]))
    named = F.array(
        *[F.when(F.col(VENUE_COLUMN).contains(p), F.lit(p)) for p in publishers]
    )
    return (
        df.withColumn("year_label", year_label(F.col("year"), bounds, labels))
        .filter(F.col("year_label").isNotNull())
        .withColumn("publisher", F.explode(F.array_compact(named)))
        .withColumn("blocking_key", F.concat_ws("-", "year_label", "publisher"))
    )


def year_and_venue(df: DataFrame, bounds=YEAR_BOUNDS, labels=YEAR_LABELS) -> DataFrame:
    """Key: year bin and the venue as written; null when the year is outside every bin."""
    key = F.concat(year_label(F.col("year"), bounds, labels), F.lit("-"), F.col(VENUE_COLUMN))
    return df.withColumn("blocking_key", key)


def nested(outer: DataFrame, inner, *args, **kwargs) -> DataFrame:
    """Run a second blocking inside every block: the key becomes (outer_key, blocking_key)."""
    return inner(outer.withColumnRenamed("blocking_key", "outer_key"), *args, **kwargs)


BLOCKERS = {
    "initials_hash": initials_hash,
    "full_hash": full_hash,
    "initials_ngrams": initials_ngrams,
    "full_ngrams": full_ngrams,
    "lengths": lengths,
    "named_lengths": named_lengths,
    "year_ranges": year_ranges,
    "year_and_publisher": year_and_publisher,
    "year_and_venue": year_and_venue,
}


def members(blocked: DataFrame, *columns: str) -> DataFrame:
    """Distinct (key, …, index) rows: the blocks in long form."""
    return blocked.select(*(columns or ("blocking_key",)), "index").distinct()


def block_sizes(blocked: DataFrame, *columns: str) -> DataFrame:
    """Records per block."""
    return blocked.groupBy(*(columns or ("blocking_key",))).agg(F.count(F.lit(1)).alias("records"))


def block_stats(blocked: DataFrame, *columns: str) -> DataFrame:
    """Number of blocks and of candidate pairs inside them, in one row."""
    # Decimal: the square of a large block's size does not fit a bigint.
    n = F.col("records").cast("decimal(20,0)")
    pairs = (n * (n - 1) / 2).cast("decimal(38,0)")
    return block_sizes(blocked, *columns).agg(
        F.count(F.lit(1)).alias("blocks"),
        F.coalesce(F.sum("records"), F.lit(0)).alias("records"),
        F.coalesce(F.sum(pairs), F.lit(0)).alias("pairs"),
    )
