"""Similarities between two sets, lists or strings, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairloom.functions.text import character_set, let

# Symbols of common tokens come after this code point; controls and ASCII are left out.
_FIRST_SYMBOL = 256


def jaccard(a: Column, b: Column) -> Column:
    """|a ∩ b| / |a ∪ b| of two duplicate-free arrays; 0 when both are empty."""
    return let(
        F.size(F.array_intersect(a, b)),
        lambda common: F.coalesce(
            F.try_divide(common, F.size(a) + F.size(b) - common).cast("double"), F.lit(0.0)
        ),
    )


def dice(a: Column, b: Column) -> Column:
    """2 |a ∩ b| / (|a| + |b|) of two duplicate-free arrays; 0 when both are empty."""
    common = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(2 * common, F.size(a) + F.size(b)).cast("double"), F.lit(0.0))


def exact(a: Column, b: Column) -> Column:
    """1 when both values are equal, else 0. Sort arrays first when they stand for sets."""
    return F.when(a.eqNullSafe(b), 1.0).otherwise(0.0)


def exact_sets(a: Column, b: Column) -> Column:
    return exact(F.array_sort(a), F.array_sort(b))


def _spell(own: Column, common: Column, other: int) -> Column:
    """Write a sorted token set as a string with one symbol per token.

    A token of both sets has the symbol of its place among the ``common`` ones; one that only this set
    holds (``own``) can equal nothing, so all of them share the symbol ``other``.
    """
    numbered = F.transform(common, lambda t, i: F.struct(t.alias("t"), (i + _FIRST_SYMBOL + 1).alias("symbol")))
    alone = F.transform(own, lambda t: F.struct(t.alias("t"), F.lit(other).alias("symbol")))

    def code(token: Column) -> Column:
        # The surrogates are no characters.
        symbol = F.when(token["symbol"] >= 0xD800, token["symbol"] + 0x800).otherwise(token["symbol"])
        return F.lpad(F.hex(symbol), 8, "0")

    symbols = F.transform(F.sort_array(F.concat(numbered, alone)), code)
    return F.decode(F.unhex(F.array_join(symbols, "")), "UTF-32")


def edit_tokens(a: Column, b: Column, least: float = 0.0) -> Column:
    """1 - d / (|a| + |b|), d the edit distance between both token sets in sorted order.

    Each token becomes one symbol, which lets the built-in string distance work on tokens; sets may have
    a million tokens in common. Two empty sets score 0. Scores below ``least`` may come out as 0, which
    spares most of the work.
    """
    size = F.size(a) + F.size(b)
    limit = F.floor((1 - least) * size + 1e-9).cast("int")
    distance = let(
        F.sort_array(F.array_intersect(a, b)),
        lambda common: F.call_function(
            "levenshtein",
            _spell(F.array_except(a, b), common, _FIRST_SYMBOL - 1),
            _spell(F.array_except(b, a), common, _FIRST_SYMBOL),
            limit,
        ),
    )
    score = let(distance, lambda d: F.when(d >= 0, 1 - F.try_divide(d, size)))
    return F.coalesce(score, F.lit(0.0)).cast("double")


def edit_characters(a: Column, b: Column) -> Column:
    """1 - d / (longer length), d the edit distance between two strings; equal strings score 1."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.coalesce(1 - F.try_divide(F.levenshtein(a, b), longest), F.lit(1.0)).cast("double")


def edit_ceiling(a: Column, b: Column) -> Column:
    """What ``edit_tokens`` can reach at most, from sizes and overlap alone."""
    spared = F.greatest(F.size(a), F.size(b)) - F.size(F.array_intersect(a, b))
    return F.coalesce(1 - F.try_divide(spared, F.size(a) + F.size(b)), F.lit(0.0)).cast("double")


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole).cast("double"), F.lit(0.0))


@dataclass(frozen=True)
class Measure:
    """A set similarity with what a join needs to know about it.

    ``jaccard_floor(t)`` is a Jaccard value that every pair scoring at least ``t`` reaches.
    ``miss`` is the score of two different one-item sets. ``ceiling`` is a cheap upper bound of a
    costly score. ``most(o, m, n)`` is the highest score of sets of m and n items with o in common at most.
    """

    score: Callable[[Column, Column], Column]
    jaccard_floor: Callable[[float], float]
    most: Callable[[Column, Column, Column], Column]
    miss: float = 0.0
    ceiling: Callable[[Column, Column], Column] | None = None


#: Set similarities by name. Equality is not among them: it holds for two empty sets, which share no
#: token, and needs no similarity join (see ``matching.equal_records``).
#:
#: Dice d and Jaccard j of the same sets are tied by j = d / (2 - d). For the edit similarity, d is
#: at least the longer length n minus the overlap o, so a score of t leaves o >= n - (1-t)(m+n); the
#: Jaccard value this implies is smallest at m = n, where it is (2t - 1) / (3 - 2t).
MEASURES = {
    "jaccard": Measure(jaccard, lambda t: t, lambda o, m, n: _ratio(o, m + n - o)),
    "dice": Measure(dice, lambda t: t / (2 - t), lambda o, m, n: _ratio(2 * o, m + n)),
    "edit": Measure(
        edit_tokens, lambda t: (2 * t - 1) / (3 - 2 * t), lambda o, m, n: _ratio(m + n - F.greatest(m, n) + o, m + n), 0.5, edit_ceiling
    ),
}


def as_set(df: DataFrame, column: str) -> Column:
    """The set a column stands for: the items of an array, the characters of anything else."""
    if dict(df.dtypes)[column].startswith("array"):
        return F.array_distinct(column)
    return character_set(F.col(column).cast("string"))


#: The same set similarities for SQL text, as temporary functions that Spark inlines.
SQL_FUNCTIONS = {
    "jaccard_similarity": (
        "coalesce(try_divide(size(array_intersect(a, b)), size(array_union(a, b))), 0)"
    ),
    "dice_similarity": (
        "coalesce(try_divide(2 * size(array_intersect(a, b)), "
        "size(array_distinct(a)) + size(array_distinct(b))), 0)"
    ),
    "exact_similarity": "CASE WHEN array_sort(a) <=> array_sort(b) THEN 1 ELSE 0 END",
}


def register_sql_functions(spark: SparkSession) -> None:
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<STRING>, b ARRAY<STRING>) "
            f"RETURNS DOUBLE RETURN {body}"
        )
