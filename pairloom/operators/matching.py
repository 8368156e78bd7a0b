"""Matching records of two sources.

Results are kept factored so that they stay as small as their information:

* an equality match is the long table of the records whose key occurs on both sides; every left record
  of a key matches every right record of it;
* a similarity match lists pairs of *classes*, a class being the records with identical values, as
  ``rep1, rep2, n1, n2, sim``; ``class_members`` names the records of each class.

``expand_groups`` and ``expand_classes`` turn either into a list of id pairs for callers who want it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.functions.similarity import MEASURES, Measure
from pairloom.functions.text import character_set, lower_character_set, ngrams, token_set
from pairloom.operators.blockjoin import near_records
from pairloom.operators.setjoin import EPSILON
from pairloom.session import discard, step, write_through

#: What a value is taken as a set of; ``characters`` are those of its lower-cased tokens, ``raw_characters`` all, and
#: ``items`` those of an array.
ELEMENTS = {
    "items": F.array_distinct,
    "tokens": token_set,
    "characters": lower_character_set,
    "raw_characters": character_set,
    "bigrams": lambda text: F.array_distinct(ngrams(text, 2)),
    "trigrams": lambda text: F.array_distinct(ngrams(text, 3)),
}

#: Pairs for each set that are compared at a time, by fingerprints or whole, and the pairs that always may.
AT_A_TIME, FEW = 0.5, 50_000

#: A set of tokens as one text, and back.
PACKED = (lambda items: F.array_join(items, " "), lambda text: F.array_remove(F.split(text, " "), ""))

#: Jaccard value that all text columns must reach for a join on one of them to be taken.
ENOUGH = 0.5
#: Records for each distinct set of a column from which distinct sets are joined before records.
COPIES = 4


def both_sides(left: DataFrame, right: DataFrame, columns: Sequence[str | Column]) -> DataFrame:
    """Both sources in one frame, tagged ``side`` a and b."""
    return left.select(F.lit("a").alias("side"), *columns).unionAll(
        right.select(F.lit("b").alias("side"), *columns)
    )


def side_counts(tagged: DataFrame, on: Sequence[str]) -> DataFrame:
    """Records per key on either side."""
    return tagged.groupBy(*on).agg(
        F.count_if(F.col("side") == "a").alias("n1"), F.count_if(F.col("side") == "b").alias("n2")
    )


def pair_count(n1: str = "n1", n2: str = "n2") -> Column:
    """Pairs of n1 and n2 records, as a decimal: the product of two large blocks exceeds a bigint."""
    return (F.col(n1).cast("decimal(19,0)") * F.col(n2).cast("decimal(19,0)")).cast("decimal(38,0)")


# ---------------------------------------------------------------------------- equality matches


def matched_keys(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys that occur on both sides, with the records (``n1``, ``n2``) they hold there. A missing key is none."""
    tagged = both_sides(left, right, on).dropna(subset=list(on))
    return side_counts(tagged, on).filter("n1 > 0 AND n2 > 0")


def match_equal(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Records whose key occurs on both sides: (key…, side, index), without duplicates.

    The texts behind the keys are read once: counting and selecting work on the written keys.
    """
    tagged = write_through(both_sides(left, right, [*on, "index"]))
    keys = side_counts(tagged, on).filter("n1 > 0 AND n2 > 0").select(*on)
    return tagged.join(keys, list(on), "left_semi").distinct()


def expand_groups(groups: DataFrame, on: Sequence[str]) -> DataFrame:
    """List the id pairs of an equality match. The list is as long as the sum of n1 · n2."""
    ones = groups.filter("side = 'a'").select(*on, F.col("index").alias("id1"))
    twos = groups.filter("side = 'b'").select(*on, F.col("index").alias("id2"))
    return ones.join(twos, list(on)).select("id1", "id2").distinct()


# -------------------------------------------------------------------------------- value classes


def class_key(columns: Sequence[str]) -> Column:
    """Digest of the values; null and empty differ, and no two columns run together."""
    return F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def value_classes(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per distinct combination of values over both sources.

    ``rep1``/``rep2`` are the smallest ids that hold it on either side (null where none does) and
    ``n1``/``n2`` count the records. Copies are merged before anything is compared, so a text that a
    third of all records share costs as much as any other text.
    """
    tagged = both_sides(left, right, ["index", *columns]).withColumn("class", class_key(columns))
    on_a, on_b = F.col("side") == "a", F.col("side") == "b"
    return tagged.groupBy("class").agg(
        F.min(F.when(on_a, F.col("index"))).alias("rep1"),
        F.min(F.when(on_b, F.col("index"))).alias("rep2"),
        F.count_if(on_a).alias("n1"),
        F.count_if(on_b).alias("n2"),
        *[F.first(c).alias(c) for c in columns],
    )


def class_members(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(side, rep, index): the class of every record, named by its smallest id on that side."""
    tagged = write_through(
        both_sides(left, right, ["index", *columns]).select(
            "side", "index", class_key(columns).alias("class")
        )
    )
    reps = tagged.groupBy("side", "class").agg(F.min("index").alias("rep"))
    return tagged.join(reps, ["side", "class"]).select("side", "rep", "index")


def expand_classes(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """List the id pairs behind class pairs. The list is as long as the sum of n1 · n2."""
    ones = members.filter("side = 'a'").select(F.col("rep").alias("rep1"), F.col("index").alias("id1"))
    twos = members.filter("side = 'b'").select(F.col("rep").alias("rep2"), F.col("index").alias("id2"))
    return pairs.join(ones, "rep1").join(twos, "rep2").select("id1", "id2")


# --------------------------------------------------------------------------- similarity matches


def mean_score(scores: Sequence[Column]) -> Column:
    """Mean of the scores, added up in the given order."""
    total = reduce(lambda a, b: a + b, scores)
    return total / len(scores) if len(scores) > 1 else total


def passes(score: Column, threshold: float, strict: bool = False) -> Column:
    return score > threshold if strict else score >= threshold


def _levels(texts: int, single: Sequence[str], threshold: float, miss: float):
    """(single-item columns that agree, score some text column must reach, score each must) for every possible case.

    A mean of k scores reaching t needs a sum of k·t. Single-item columns add 1 when equal and
    ``miss`` when not; the text columns must bring the rest: one of them at least its share, and each
    of them what is left when the others score 1.
    """
    from itertools import combinations

    for equal in range(len(single), -1, -1):
        rest = (texts + len(single)) * threshold - equal - (len(single) - equal) * miss
        share = rest / texts
        if share <= 1 + EPSILON:
            yield list(combinations(single, equal)), min(share, 1.0), min(rest - (texts - 1), 1.0)


def fingerprints(items: Column) -> Column:
    """The distinct 16-bit hashes of the items of a set: two bytes an item, which is what a pair can carry along."""
    return F.array_distinct(F.transform(items, lambda item: (F.pmod(F.xxhash64(item), F.lit(1 << 16)) - (1 << 15)).cast("short")))


def hashed_items(items: str) -> Column:
    """The items as 32-bit hashes; a missing set is an empty one."""
    return F.coalesce(F.transform(items, lambda item: F.hash(item)), F.array().cast("array<int>"))


def most_common(prints1: Column, n1: Column, prints2: Column, n2: Column) -> Column:
    """Items that two sets of n1 and n2 items have in common at most, from their fingerprints.

    Common items have common fingerprints, and several share one only as often as each side has fewer fingerprints than items.
    """
    shared = F.least(n1 - F.size(prints1), n2 - F.size(prints2))
    return F.least(F.size(F.array_intersect(prints1, prints2)) + shared, n1, n2)


def similar_records(
    left: DataFrame,
    right: DataFrame,
    texts: Sequence[str],
    threshold: float,
    single: Sequence[str] = (),
    measure: str = "jaccard",
    elements: str = "tokens",
    block: Sequence[str] = (),
    strict: bool = False,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """All pairs of records whose mean similarity over the columns reaches the threshold.

    ``texts`` are compared as sets of tokens or characters. ``single`` columns always hold one item
    (a year, a venue label), so two of them are equal or share nothing. ``block`` columns must agree.
    ``order`` is the order in which the scores are added up, by default ``texts`` then ``single``.

    Gives (block…, rep1, rep2, n1, n2, sim) over the classes of identical values. The result is that
    of comparing every pair; candidates come from set-similarity joins on the text columns, at
    the lowest score that still allows the mean. A threshold so low that a pair may qualify without
    sharing anything has no such bound and is refused.
    """
    texts, single, block = list(texts), list(single), list(block)
    kind, as_set = MEASURES[measure], ELEMENTS[elements]
    columns = [*block, *(c for c in (*texts, *single) if c not in block)]
    with step(left.sparkSession) as keep:
        classes = value_classes(left, right, columns)
        # Read many times below, so it is computed and written once. Pairs are of written numbers, which are short.
        sets = keep(
            classes.select(
                "rep1", "rep2", "n1", "n2",
                *block,
                *[c for c in single if c not in block],
                *[as_set(F.col(c)).alias(f"set_{c}") for c in texts],
            ).withColumn("id", F.monotonically_increasing_id())
        )
        ones, twos = sets.filter("n1 > 0"), sets.filter("n2 > 0")

        levels = list(_levels(len(texts), single, threshold, kind.miss))
        if not levels:
            raise ValueError(f"no pair can reach the threshold {threshold}")
        asked, found = [], []
        fewest = None
        for agree, score, each in levels:
            floor = kind.jaccard_floor(score)
            if floor <= 0:
                raise ValueError(
                    f"threshold {threshold} lets {measure} pairs qualify that share nothing"
                )
            # If all single-item columns agree, they are part of the key; else the values alone have to find the pairs.
            on = [*block, *(c for c in single if len(agree[0]) == len(single) and c not in block)]
            least = kind.jaccard_floor(each - EPSILON) if each > 0 else 0.0
            if len(texts) > 1 and least >= ENOUGH:
                # Every column has to be similar, so one of them finds all pairs: the one with the fewest copies.
                fewest = fewest or _distinct_sets(sets, texts)
                finest = max(texts, key=lambda c: fewest[c])
                if fewest[finest] * COPIES <= fewest["rows"]:
                    found.append(_by_values(sets, texts, least, block, agree))
                else:
                    asked.append((finest, least, on))
            else:
                asked += [(c, floor, on) for c in texts]
        if found:
            candidates = keep(found[0] if len(found) == 1 else reduce(DataFrame.unionAll, found).distinct())
        else:
            candidates = sets.select(F.col("id").alias("id1"), F.col("id").alias("id2")).limit(0)
    near = _within_reach(candidates, sets, texts, single, threshold, measure, asked)
    if found:
        discard(candidates)

    # Tokens hold no blanks, so a set of them moves as one text.
    packed, unpacked = (PACKED if elements == "tokens" else (lambda c: c, lambda c: c))
    ones = ones.select(
        F.col("id").alias("id1"), "rep1", "n1", *block,
        *[packed(F.col(f"set_{c}")).alias(f"a_{c}") for c in texts],
        *[F.col(c).alias(f"a_{c}") for c in single],
    )
    twos = twos.select(
        F.col("id").alias("id2"), "rep2", "n2", *[F.col(c).alias(f"same_{c}") for c in block],
        *[packed(F.col(f"set_{c}")).alias(f"b_{c}") for c in texts],
        *[F.col(c).alias(f"b_{c}") for c in single],
    )
    summed = list(order or [*texts, *single])
    # With all other columns at 1, a column must bring at least this.
    least = max(0.0, len(summed) * threshold - (len(summed) - 1) - EPSILON)
    exact = (lambda a, b: kind.score(a, b, least)) if measure == "edit" else kind.score

    def mean(score) -> Column:
        parts = {c: score(F.col(f"a_{c}"), F.col(f"b_{c}")) for c in texts}
        for c in single:
            equal = F.col(f"a_{c}") == F.col(f"b_{c}")
            parts[c] = F.when(equal, 1.0).otherwise(kind.miss)
        return mean_score([parts[c] for c in summed])

    def verified(some: DataFrame, ones: DataFrame) -> DataFrame:
        pairs = some.join(ones, "id1").join(twos, "id2")
        for c in block:
            pairs = pairs.filter(F.col(c) == F.col(f"same_{c}"))
        pairs = pairs.withColumns({f"{k}_{c}": unpacked(F.col(f"{k}_{c}")) for k in "ab" for c in texts})
        if kind.ceiling is not None:
            pairs = pairs.filter(mean(kind.ceiling) >= threshold - EPSILON)
        # As the output of a generator the score is computed once; a filter on a plain column would compute it again.
        scored = pairs.select(*block, "rep1", "rep2", "n1", "n2", F.explode(F.array(mean(exact))).alias("sim"))
        return scored.filter(passes(F.col("sim"), threshold, strict))

    # Whole sets move with each pair, so these take their turns, too, and leave only results.
    with step(left.sparkSession) as keep:
        return keep(*[verified(some, own) for some, own in _turns(near, ones, sets)])


def _turns(pairs: DataFrame, ones: DataFrame, sets: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """(pairs, left sets) cut alike by ``id1``, so that about ``AT_A_TIME`` pairs a set are in one turn."""
    there = pairs.count()
    count = ceil(there / max(FEW, AT_A_TIME * sets.count())) if there > FEW else 1
    if count == 1:
        return [(pairs, ones)]
    turn = lambda rows, k: rows.filter(F.pmod(F.xxhash64("id1"), F.lit(count)) == k)
    return [(turn(pairs, k), turn(ones, k)) for k in range(count)]


def _distinct_sets(sets: DataFrame, texts: Sequence[str]) -> dict[str, int]:
    """About how many distinct sets each text column has, and the ``rows``."""
    counts = [F.approx_count_distinct(F.xxhash64(f"set_{c}")).alias(c) for c in texts]
    return sets.agg(F.count(F.lit(1)).alias("rows"), *counts).first().asDict()


def _by_values(
    sets: DataFrame, texts: Sequence[str], floor: float, block: Sequence[str], agree: Sequence[Sequence[str]]
) -> DataFrame:
    """(id1, id2) that contain all pairs whose sets have Jaccard >= ``floor`` in every text column and which agree on one
    of the groups of columns in ``agree``.

    For columns of few distinct sets: these are joined first, and records then meet on all columns at once.
    """
    digest = lambda c: F.md5(F.to_json(F.sort_array(f"set_{c}")))
    other = [c for c in sets.columns if c not in block and any(c in group for group in agree)]
    keyed = write_through(sets.select("id", "n1", "n2", *block, *other, *[digest(c).alias(f"key_{c}") for c in texts]))
    ones, twos = (keyed.filter(f"n{k} > 0").withColumnRenamed("id", f"id{k}").drop("n1", "n2") for k in (1, 2))
    twos = twos.withColumnsRenamed({f"key_{c}": f"other_{c}" for c in texts})
    for c in texts:
        values = sets.groupBy(digest(c).alias("id")).agg(F.max("n1").alias("n1"), F.max("n2").alias("n2"), F.first(f"set_{c}").alias("items"))
        values = write_through(values.select("id", "n1", "n2", hashed_items("items").alias("items_value")))
        near = near_records(values, ["value"], [], [("value", floor)], [], floor, MEASURES["jaccard"], "jaccard")
        near = write_through(*near) if near else values.select(F.col("id").alias("id1"), F.col("id").alias("id2")).limit(0)
        ones = ones.join(near.toDF(f"key_{c}", f"other_{c}"), f"key_{c}").drop(f"key_{c}")
    on = [*block, *[f"other_{c}" for c in texts]]
    pairs = [ones.join(twos, list(dict.fromkeys([*on, *group]))).select("id1", "id2") for group in agree]
    return pairs[0] if len(pairs) == 1 else reduce(DataFrame.unionAll, pairs).distinct()


def _within_reach(
    pairs: DataFrame,
    sets: DataFrame,
    texts: Sequence[str],
    single: Sequence[str],
    threshold: float,
    measure: str,
    asked: Sequence[tuple[str, float, Sequence[str]]] = (),
) -> DataFrame:
    """(id1, id2) whose mean over all columns may reach the threshold: no true pair is lost.

    These are the ``pairs`` whose fingerprints allow it, and the pairs that agree on the columns and have the Jaccard value in the text column
    that ``asked`` names, as far as their hashed tokens allow it.
    """
    with step(sets.sparkSession) as keep:
        given = not pairs.isEmpty()
        parts = _by_fingerprints(pairs, sets, texts, single, threshold, MEASURES[measure]) if given else []
        if asked:
            columns = list(dict.fromkeys([*single, *(c for *_, on in asked for c in on)]))
            hashed = write_through(sets.select("id", "n1", "n2", *columns, *[hashed_items(f"set_{c}").alias(f"items_{c}") for c in texts]))
        for on in dict.fromkeys(tuple(on) for *_, on in asked):
            # The lowest Jaccard value that is asked of a column finds what the others ask for.
            floors = {c: min(f for d, f, o in asked if d == c and tuple(o) == on) for c in dict.fromkeys(c for c, _, o in asked if tuple(o) == on)}
            parts += near_records(hashed, texts, single, list(floors.items()), on, threshold, MEASURES[measure], measure)
        if not parts:
            return keep(pairs.limit(0))
        several = given + len({tuple(on) for *_, on in asked}) > 1
        return keep(write_through(*parts).distinct()) if several else keep(*parts)


def _by_fingerprints(
    pairs: DataFrame, sets: DataFrame, texts: Sequence[str], single: Sequence[str], threshold: float, kind: Measure
) -> list[DataFrame]:
    """The pairs (id1, id2), some at a time, whose fingerprints allow the mean over all columns to reach the threshold."""
    prints = write_through(
        sets.select(
            "id", "n1", "n2", *single,
            *[F.size(f"set_{c}").alias(f"size_{c}") for c in texts],
            *[fingerprints(F.col(f"set_{c}")).alias(f"prints_{c}") for c in texts],
        )
    )

    def side(k: int) -> DataFrame:
        own = [*single, *[f"{what}_{c}" for c in texts for what in ("size", "prints")]]
        return prints.filter(f"n{k} > 0").select(F.col("id").alias(f"id{k}"), *[F.col(c).alias(f"{c}_{k}") for c in own])

    def most(c: str) -> Column:
        n1, n2 = F.col(f"size_{c}_1"), F.col(f"size_{c}_2")
        return kind.most(most_common(F.col(f"prints_{c}_1"), n1, F.col(f"prints_{c}_2"), n2), n1, n2)

    scores = [most(c) for c in texts]
    scores += [F.when(F.col(f"{c}_1") == F.col(f"{c}_2"), 1.0).otherwise(kind.miss) for c in single]

    def within(some: DataFrame, ones: DataFrame) -> DataFrame:
        near = some.join(ones, "id1").join(side(2), "id2")
        return near.filter(mean_score(scores) >= threshold - EPSILON).select("id1", "id2")

    # Fingerprints are moved once for each pair, so many pairs take their turns.
    return [within(some, own) for some, own in _turns(pairs, side(1), sets)]


def equal_records(
    left: DataFrame, right: DataFrame, columns: Sequence[str], threshold: float
) -> DataFrame:
    """Baseline with the all-or-nothing similarity: enough columns with equal token sets.

    A mean of k zeros and ones reaches t when at least ceil(k·t) columns agree, so every set of that
    many columns is one equality match. Gives its records as (agreeing, group, side, index); two
    records match when they share a group, and may share several.
    """
    from itertools import combinations

    columns = list(columns)
    need = max(1, ceil(len(columns) * threshold - EPSILON))
    # Token sets are compared by digest, so that only digests are shuffled.
    same = [
        F.md5(F.array_join(F.array_sort(token_set(F.col(c).cast("string"))), " ")).alias(c)
        for c in columns
    ]
    groups = F.array(
        *[
            F.struct(
                F.lit("+".join(chosen)).alias("agreeing"),
                F.md5(F.concat(*chosen)).alias("group"),
            )
            for chosen in combinations(columns, need)
        ]
    )

    def keyed(df: DataFrame) -> DataFrame:
        return df.select("index", *same).select("index", F.inline(groups))

    return match_equal(keyed(left), keyed(right), ["agreeing", "group"])
