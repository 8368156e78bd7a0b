"""Exact set-similarity join by prefix filtering.

Published ideas: prefix and length filtering (Bayardo et al. 2007, "Scaling up all pairs similarity
search"), positional filtering (Xiao et al. 2008, PPJoin), longer prefixes that must share several
tokens (Wang et al. 2012, AdaptJoin) and bitmaps that bound an overlap (Sandes et al. 2020).

For sets sorted by one global token order, two sets with Jaccard >= t share a token among the first
|s| - ceil(t |s|) + 1 of each. Any order is right; rarest first makes the shared token selective.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from pairloom.functions.text import let
from pairloom.session import step, write_through

#: Slack for rounding: a filter may keep too much but never drop a true pair.
EPSILON = 1e-9
#: Above this threshold frequent tokens are taken in pairs of neighbours, at or below it in combinations.
PAIRED = 0.6
#: Combinations of frequent tokens that are keys, for each token of all sets, at most.
COMBINED = 0.25
#: 64-bit words of the bitmap of a set.
WORDS = 16
#: Tokens are counted at 2^PLACES places.
PLACES = 22
#: Pairs of equal keys that meet at a time, for each key, and the pairs that always may.
MEETINGS, FEW = 0.25, 1_000_000
#: One key of so many is counted to know how many will meet.
COUNTED = 64
#: Width of a bucket of sizes, in steps of the largest ratio of two similar sets.
STEPS = 4


def token_levels(words: DataFrame) -> np.ndarray:
    """How common the tokens (side, item) are: a level, 8 to an octave of the count, for each of 2^PLACES places of tokens.

    Tokens of one place count together. Level 0 says that a side has no token there. The table has a bounded size,
    whatever the number of tokens; it reaches the driver as one row a batch.
    """
    place = F.col("item").bitwiseAND(F.lit((1 << PLACES) - 1)).cast("int")
    counts = words.groupBy(place.alias("place")).agg(
        F.count_if(F.col("side") == 1).alias("n1"), F.count_if(F.col("side") == 2).alias("n2")
    )
    level = F.least(F.round(8 * F.log2(F.col("n1") + F.col("n2"))), F.lit(255)).cast("int")

    def packed(batches):
        for batch in batches:
            places, levels = (batch.column(k).to_numpy().astype(kind).tobytes() for k, kind in ((0, np.int32), (1, np.uint8)))
            yield pa.RecordBatch.from_pydict({"places": [places], "levels": [levels]}, pa.schema([("places", pa.binary()), ("levels", pa.binary())]))

    found = counts.filter("n1 > 0 AND n2 > 0").select("place", level.alias("level"))
    levels = np.zeros(1 << PLACES, np.uint8)
    for row in found.mapInArrow(packed, "places binary, levels binary").collect():
        levels[np.frombuffer(row["places"], np.int32)] = np.frombuffer(row["levels"], np.uint8)
    return levels


def ranked_sets(left: DataFrame, right: DataFrame, items: str, carry: Sequence[str] = ()) -> DataFrame:
    """Both sides' sets with their tokens in a global order: what every threshold starts from.

    Gives (side, id, ``carry``…, size, tokens, skipped, bits): ``tokens`` are the tokens (n, item) that both sides
    may know, by how common their place of ``token_levels`` is, and ``skipped`` counts the others, which one side lacks for
    certain; they come before them in the order and cannot bring a pair together. ``bits`` are the parities of the tokens at each
    of 64 x WORDS places. Only counts of places are shuffled: every set looks its own tokens up and stays where it is.
    Written out, so the texts behind the sets are ranked once. Tokens are 64-bit hashes from here on: they
    find candidates, and whoever verifies these looks at the sets themselves.
    """
    carry, width = list(carry), 64 * WORDS
    columns = ["id", *carry, F.size(items).alias("size"), F.transform(items, lambda item: F.xxhash64(item)).alias("items")]
    sets = left.select(F.lit(1).alias("side"), *columns).unionAll(right.select(F.lit(2).alias("side"), *columns)).filter("size > 0")
    levels = left.sparkSession.sparkContext.broadcast(token_levels(sets.select("side", F.explode("items").alias("item"))))

    def ranked(batches):
        for batch in batches:
            rows = batch.num_rows
            sizes = batch.column("size").to_numpy()
            item, row = batch.column("items").flatten().to_numpy(), np.repeat(np.arange(rows), sizes)
            level = levels.value[item & (len(levels.value) - 1)]
            known = np.flatnonzero(level)
            order = known[np.lexsort((item[known], level[known], row[known]))]
            item, row, level = item[order], row[order], level[order]
            held = np.bincount(row, minlength=rows)
            ends = np.concatenate(([0], np.cumsum(held)))
            n = pa.array(np.rint(2 ** (level / 8)).astype(np.int64))
            tokens = pa.StructArray.from_arrays([n, pa.array(item)], ["n", "item"])
            bits = []
            for first in range(0, rows, 1000):
                some = slice(ends[first], ends[min(first + 1000, rows)])
                places = (row[some] - first) * width + (item[some] & (width - 1))
                count = min(1000, rows - first)
                odd = (np.bincount(places, minlength=count * width) & 1).astype(np.uint8)
                bits.append(np.packbits(odd, bitorder="little").view(np.int64))
            words = np.arange(rows + 1, dtype=np.int32) * (width // 64)
            made = {
                "tokens": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), tokens),
                "bits": pa.ListArray.from_arrays(pa.array(words), pa.array(np.concatenate(bits) if bits else np.zeros(0, np.int64))),
                "skipped": pa.array((sizes - held).astype(np.int32)),
            }
            kept = ["side", "id", *carry, "size"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *made.values()], [*kept, *made])

    schema = sets.drop("items").schema
    token = StructType([StructField("n", LongType()), StructField("item", LongType())])
    for name, kind in (("tokens", ArrayType(token)), ("bits", ArrayType(LongType())), ("skipped", IntegerType())):
        schema = schema.add(name, kind)
    return write_through(sets.mapInArrow(ranked, schema).filter(F.size("tokens") > 0))


def candidate_pairs(
    ranked: DataFrame, threshold: float, block: Sequence[str] = (), frequent: float | None = None
) -> DataFrame:
    """Distinct (id1, id2) that contain every pair with Jaccard >= ``threshold``.

    ``ranked`` comes from ``ranked_sets`` with the ``block`` columns carried. Only pairs that agree on all
    ``block`` columns are looked at, but for a few whose keys have the same hash.

    Sizes of similar sets differ by a factor of 1 / threshold at most, so the logarithm of the size is
    part of the key. Rare tokens, which at most ``frequent`` sets hold (by default the root of the number of
    sets, so that a token brings no more pairs than there are sets), are keys of their own. Frequent tokens never
    are, so that no key holds a fixed share of all sets. Above a threshold of ``PAIRED`` they are keys only together with the
    next token of the set:

    similar sets have 2 |x - y| + |y - x| <= 2 (1 - t) |x|. If no rare token is shared, all ``absent`` unshared and rare
    tokens of x are among x - y. Each further token of x alone breaks at most two neighbourhoods of frequent
    tokens and each one of y alone at most one, so among the first floor(2 (1 - t) |x|) - 2 absent + 2 frequent
    tokens one neighbourhood is whole in both. Sets too small to have so many keep all tokens as single keys.

    Below that the first tokens that two sets share are keys in combinations, as many as their counts ask for: if no
    rare token is shared, x misses at most ``left`` of its frequent ones, so the first two shared ones are among the
    first left + 2 and the first three among the first left + 3. Two tokens are a key where, by their counts, about ``frequent`` sets or
    fewer hold both, and else go on to a third one. Sets that may share no more than one or two tokens at all have
    keys for just those, which meet one another alone. Where that makes more than ``COMBINED`` keys a token of the input,
    ``frequent`` is doubled.
    """
    return _met(*key_rows(ranked, threshold, block, frequent), threshold).distinct()


def key_rows(
    ranked: DataFrame, threshold: float, block: Sequence[str] = (), frequent: float | None = None
) -> tuple[DataFrame, DataFrame]:
    """The keys of both sides that ``candidate_pairs`` describes: (key, id1, s1, p1) and (key, id2, s2, p2), with the
    size of the set and the place of the key."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie in (0, 1]")
    block = list(block)
    total, tokens = ranked.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    frequent = total**0.5 if frequent is None else frequent
    size, none = F.col("size"), F.lit(0).cast("bigint")
    need = F.ceil(threshold * size - EPSILON).cast("int")
    # Sets that share too little with the whole other side to reach any partner go at once.
    able = ranked.withColumn("need", need).filter(F.size("tokens") >= F.col("need"))
    if threshold <= PAIRED:
        frequent = _affordable(able, frequent, total, COMBINED * tokens)
    ordered = able.withColumn("rare", F.size(F.filter("tokens", lambda t: t["n"] <= frequent)))
    prefix = F.greatest(size - F.col("need") + 1 - F.col("skipped"), F.lit(0))
    kind = "array<struct<item:bigint,next:bigint,place:int>>"
    every = F.transform(
        F.slice("tokens", F.lit(1), prefix),
        lambda t, i: F.struct(t["item"].alias("item"), none.alias("next"), (F.col("skipped") + i).alias("place")),
    ).cast(kind)
    if threshold <= PAIRED:
        singles = F.slice(every, F.lit(1), F.least(F.col("rare"), F.size(every)))
        keys = F.concat(singles, _combined(frequent, total).cast(kind))
    else:
        small = size * threshold < 2 / (2 * threshold - 1) + 1
        singles = F.when(small, every).otherwise(F.slice(every, F.lit(1), F.col("rare")))
        absent = F.col("skipped") + F.col("rare")
        spare = F.floor(2 * (1 - threshold) * size + EPSILON).cast("int") - 2 * absent
        run = F.slice("tokens", F.col("rare") + 1, F.greatest(spare + 2, F.lit(0)))
        pairs = let(
            run,
            lambda r: F.transform(
                F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))),
                lambda t, i: F.struct(t["item"].alias("item"), F.get(r, i + 1)["item"].alias("next"), F.col("skipped").alias("place")),
            ),
        ).cast(kind)
        paired = (absent <= size - F.col("need")) & (spare >= 0)
        keys = F.concat(singles, F.when(paired, pairs).otherwise(F.array().cast(kind)))
    # A bucket is wider than the ratio of similar sets, so a set has to look into few of them.
    ratio = log(1 / threshold) + EPSILON
    bucket = lambda shift: F.floor((F.log(size) + shift) / (STEPS * ratio)) if threshold < 1 else size.cast("bigint")
    agreeing = ordered.dropna(subset=block) if block else ordered
    signatures = agreeing.select(
        "side", "id", *block, "size", "skipped", F.inline(keys)
    )

    def keyed(side: int, bucket: Column) -> DataFrame:
        # One hash stands for the whole key. Pairs that meet by chance are ruled out like any other candidate.
        rows = signatures.filter(f"side = {side}").withColumn("bucket", bucket)
        key = F.xxhash64(*block, "item", "next", "bucket").alias("key")
        return rows.select(key, F.col("id").alias(f"id{side}"), F.col("size").alias(f"s{side}"), F.col("place").cast("int").alias(f"p{side}"))

    ones = keyed(1, bucket(0))
    twos = keyed(2, F.explode(F.sequence(bucket(-ratio), bucket(ratio))))
    return ones, twos


def _met(ones: DataFrame, twos: DataFrame, threshold: float) -> DataFrame:
    """(id1, id2) once for each key they share, as far as sizes and places allow the threshold."""
    s1, s2 = F.col("s1"), F.col("s2")
    # The first token two sets share and everything else they share stand at or after its places.
    reachable = F.least(s1 - F.col("p1"), s2 - F.col("p2"))
    return (
        ones.join(twos, "key")
        .filter((s1 >= threshold * s2 - EPSILON) & (s2 >= threshold * s1 - EPSILON))
        .filter(reachable >= threshold / (1 + threshold) * (s1 + s2) - EPSILON)
        .select("id1", "id2")
    )


def _left(frequent: float) -> Column:
    """Frequent tokens that a set may miss in a similar one if that has none of its rare ones; negative: it has one."""
    rare = F.size(F.filter("tokens", lambda t: t["n"] <= frequent))
    return F.col("size") - F.col("need") - F.col("skipped") - rare


def _affordable(able: DataFrame, frequent: float, total: int, most: float) -> float:
    """``frequent``, doubled until no more than ``most`` pairs of tokens are keys."""
    steps = [frequent * 2**k for k in range(40) if not k or frequent * 2 ** (k - 1) < total]
    pairs = [F.sum(let(F.greatest(_left(f) + 2, F.lit(0)), lambda n: (n * (n - 1) / 2))) for f in steps]
    counts = able.agg(*pairs).first()
    return next((f for f, n in zip(steps, counts) if (n or 0) <= most), steps[-1])


def _combined(frequent: float, total: int) -> Column:
    """Keys (item, next, place) of the combinations of frequent tokens of a set, for thresholds up to ``PAIRED``."""
    tokens = F.slice("tokens", F.col("rare") + 1, F.size("tokens"))
    left = F.col("size") - F.col("need") - F.col("skipped") - F.col("rare")
    before = F.col("skipped") + F.col("rare")

    def key(first: Column, *more: Column, place: Column) -> Column:
        # What follows the first token as one hash; the number of tokens tells keys of one length from another.
        return F.struct(first["item"].alias("item"), F.xxhash64(F.lit(len(more)), *[m["item"] for m in more]).alias("next"), place.alias("place"))

    def only(first: Column, *more: Column, place: Column) -> Column:
        # For sets that may share these tokens and no other.
        return F.struct(first["item"].alias("item"), F.xxhash64(F.lit(-len(more)), *[m["item"] for m in more], F.lit("only")).alias("next"), place.alias("place"))

    def after(f: Column, at: Column, depth: int) -> Column:
        """The tokens that may be the next shared one after place ``at``, with their places."""
        end = F.least(left + depth, F.size(f))
        rest = F.slice(f, at + 2, F.greatest(end - at - 1, F.lit(0)))
        return F.transform(rest, lambda t, k: F.struct(t.alias("t"), (at + 1 + k).alias("at")))

    def from_two(f: Column, a: Column, b: Column, b_at: Column) -> Column:
        place = before + b_at - 1
        few = a["n"].cast("double") * b["n"] / total <= frequent
        deeper = F.transform(after(f, b_at, 3), lambda c: key(a, b, c["t"], place=before + c["at"] - 2))
        end = F.when(F.col("need") <= 2, F.array(only(a, b, place=place)))
        return F.when(few, F.array(key(a, b, place=place))).otherwise(F.concat(deeper, F.coalesce(end, F.slice(deeper, 1, 0))))

    def from_one(f: Column, a: Column, at: Column) -> Column:
        pairs = F.flatten(F.transform(after(f, at, 2), lambda b: from_two(f, a, b["t"], b["at"])))
        end = F.when(F.col("need") <= 1, F.array(only(a, place=before + at)))
        return F.concat(pairs, F.coalesce(end, F.slice(pairs, 1, 0)))

    def every(f: Column) -> Column:
        firsts = F.slice(f, 1, F.greatest(left + 1, F.lit(0)))
        return F.flatten(F.transform(firsts, lambda a, at: from_one(f, a, at)))

    return let(tokens, every)


def possible_pairs(pairs: DataFrame, ranked: DataFrame, threshold: float) -> DataFrame:
    """The candidates whose bitmaps allow Jaccard >= ``threshold``: no true pair is lost.

    Similar sets differ in at most (1 - t) / (1 + t) of their items. Two bitmaps differ in no more places
    than the tokens behind them, and the tokens that only one side knows differ for certain.
    """
    side = lambda k: ranked.filter(f"side = {k}").select(
        F.col("id").alias(f"id{k}"), F.col("size").alias(f"s{k}"), F.col("skipped").alias(f"u{k}"), F.col("bits").alias(f"b{k}")
    )
    places = F.aggregate(
        F.zip_with("b1", "b2", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x
    )
    most = (1 - threshold) / (1 + threshold) * (F.col("s1") + F.col("s2")) + EPSILON
    near = pairs.join(side(1), "id1").join(side(2), "id2").filter(F.col("u1") + F.col("u2") <= most)
    return near.filter(F.col("u1") + F.col("u2") + places <= most).select("id1", "id2")


def _slices(pairs: float, rows: int) -> int:
    """In how many slices so many pairs have to meet, so that about ``MEETINGS`` of them a row do so at a time."""
    return max(1, ceil(pairs / max(FEW, MEETINGS * rows)))


def near_pairs(ranked: DataFrame, threshold: float, block: Sequence[str] = ()) -> DataFrame:
    """``possible_pairs`` of the ``candidate_pairs``, written out.

    Candidates may be many more than the sets. Keys are made once; then the sets of one side meet all of the other, some
    at a time, and what the bitmaps leave is written before the next ones do. All pairs are found, while the disk holds
    the candidates of one slice, which are bounded by the number of keys.
    """
    with step(ranked.sparkSession) as keep:
        ones, twos = (write_through(rows) for rows in key_rows(ranked, threshold, block))
        some = [rows.filter(F.pmod("key", F.lit(COUNTED)) == 0) for rows in (ones, twos)]
        count = _slices(COUNTED * _met(*some, threshold).count(), ones.count() + twos.count())
        slices = [ones.filter(F.pmod(F.xxhash64("id1"), F.lit(count)) == k) if count > 1 else ones for k in range(count)]
        return keep(*[possible_pairs(_met(some, twos, threshold).distinct(), ranked, threshold) for some in slices])
