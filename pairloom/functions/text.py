"""Text expressions: tokens, n-grams, initials, cleaning and augmentations.

Everything here is a Column built from JVM functions. No Python runs on the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values.
# Whitespace as Python's str.split() sees it: ASCII, the file/group/record/unit separators, NEL and
# every Unicode separator.
WHITESPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"
# ASCII punctuation without the backslash.
PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\]^_`{|}~]"""


def words(text: Column) -> Column:
    """Whitespace-separated tokens, without empty ones."""
    return F.filter(F.split(text, WHITESPACE), lambda w: w != "")


def token_set(text: Column) -> Column:
    """Distinct lower-cased tokens."""
    return F.array_distinct(words(F.lower(text)))


def characters(text: Column) -> Column:
    """One entry per code point, newlines included."""
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def character_set(text: Column) -> Column:
    return F.array_distinct(characters(text))


def lower_character_set(text: Column) -> Column:
    """Distinct characters of the lower-cased tokens (whitespace left out)."""
    return character_set(F.regexp_replace(F.lower(text), WHITESPACE, ""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def ngrams(text: Column, n: int) -> Column:
    """All windows of ``n`` characters in order; empty when the text is shorter than ``n``."""
    if n < 1:
        raise ValueError("n must be at least 1")

    def windows(chars: Column) -> Column:
        starts = F.slice(chars, 1, F.greatest(F.size(chars) - (n - 1), F.lit(0)))
        return F.transform(
            starts, lambda c, i: F.concat(c, *[F.get(chars, i + k) for k in range(1, n)])
        )

    return let(characters(text), windows)


def initials(text: Column) -> Column:
    """The first character of every token, joined."""
    return F.array_join(F.transform(words(text), lambda w: F.substring(w, 1, 1)), "")


def canonical_venue(venue: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Map a venue to the label of the first rule whose needle it contains, else to ``default``."""
    mapped = reduce(
        lambda rest, rule: F.when(venue.contains(rule[0]), F.lit(rule[1])).otherwise(rest),
        reversed(list(rules)),
        F.lit(default),
    )
    return mapped


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, WHITESPACE, " "))


def normalise(text: Column) -> Column:
    """Lower-case, trim and collapse runs of whitespace."""
    return collapse_spaces(F.lower(text))


def strip_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, PUNCTUATION, "")


def title_case(text: Column) -> Column:
    """Capitalise after every non-letter, so ``o'neil`` becomes ``O'Neil``.

    Runs of letters and of others are taken apart, but others that begin with an ASCII character, which has no
    capital, stay with the letters before them: that halves the runs.
    """
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+(?:[\x00-\x40\x5B-\x60\x7B-\x7F]\P{L}*)?|\P{L}+"), F.lit(0))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.substr(r, F.lit(2)))),
        "",
    )


def alphanumeric(text: Column) -> Column:
    """Letters and numbers only; spaces go too."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "")


#: Augmentations by name; callers may pass their own mapping to the sweeps.
AUGMENTATIONS: dict[str, Callable[[Column], Column]] = {
    "identity": lambda text: text,
    "lower": F.lower,
    "upper": F.upper,
    "title": title_case,
    "alphanumerical": alphanumeric,
    "reverse": F.reverse,
}


def augment(text: Column, names: Sequence[str]) -> Column:
    """Apply the named augmentations one after another.

    The empty text in between keeps the optimizer from reading lower(upper(x)) as lower(x), which
    differs for letters such as ß.
    """
    return reduce(lambda value, name: AUGMENTATIONS[name](F.concat(value, F.lit(""))), names, text)


def with_augmented(df: DataFrame, column: str, chosen: Sequence[Sequence[str]]) -> tuple[DataFrame, dict[Sequence[str], Column]]:
    """``df`` with the column under each combination of augmentations, and where to find each of them.

    Combinations that begin alike share these steps, so each step is applied once to a text; identity is no step.
    """
    steps_of = {c: tuple(name for name in c if name != "identity") for c in chosen}
    every = sorted({steps[:k] for steps in steps_of.values() for k in range(len(steps) + 1)})
    names = {steps: "_".join(("augmented", column, *steps)) for steps in every}
    df = df.withColumn(names[()], F.col(column))
    for size in range(1, max(map(len, every)) + 1):
        df = df.withColumns({names[s]: augment(F.col(names[s[:-1]]), s[-1:]) for s in every if len(s) == size})
    return df, {c: F.col(names[steps]) for c, steps in steps_of.items()}
