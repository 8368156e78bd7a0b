"""Blockings and similarities by name, for callers that take them from a list of their own.

``BLOCKERS`` is that of ``blocking``; ``SIMILARITIES`` adds string similarity to the set similarities. Both are plain
dicts: what is put in under a new name can be asked for by it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import partial, reduce

from pyspark.sql import DataFrame, functions as F

from pairloom.functions.similarity import MEASURES
from pairloom.operators.blocking import BLOCKERS
from pairloom.operators.editjoin import similar_texts
from pairloom.operators.matching import similar_records


def _by_measure(left: DataFrame, right: DataFrame, column: str, threshold: float, measure: str) -> DataFrame:
    return similar_records(left, right, [column], threshold, measure=measure)


#: (left, right, column, threshold) to class pairs (rep1, rep2, n1, n2, sim).
SIMILARITIES: dict[str, Callable[[DataFrame, DataFrame, str, float], DataFrame]] = {
    **{name: partial(_by_measure, measure=name) for name in MEASURES},
    "ratio": similar_texts,
}


def _named(registry: Mapping[str, Callable], name: str) -> Callable:
    if name not in registry:
        raise ValueError(f"{name!r} is unknown; there are {', '.join(sorted(registry))}")
    return registry[name]


def match_by(left: DataFrame, right: DataFrame, column: str, similarity: str, threshold: float) -> DataFrame:
    """Class pairs whose values of one column reach the threshold under a similarity asked for by name."""
    return _named(SIMILARITIES, similarity)(left, right, column, threshold)


def block_by(records: DataFrame, blocker: str, *args, **options) -> DataFrame:
    """Records tagged by a blocking asked for by name."""
    return _named(BLOCKERS, blocker)(records, *args, **options)


def compare_blockers(records: DataFrame, asked: Mapping[str, tuple]) -> DataFrame:
    """(blocker, blocks, records) of several blockings of the same records, each named with its arguments, in one job."""
    keys = [
        block_by(records, name, *args).select(F.lit(name).alias("blocker"), F.md5("blocking_key").alias("key"))
        for name, args in asked.items()
    ]
    sizes = reduce(DataFrame.unionAll, keys).dropna().groupBy("blocker", "key").agg(F.count(F.lit(1)).alias("records"))
    return sizes.groupBy("blocker").agg(F.count(F.lit(1)).alias("blocks"), F.sum("records").alias("records"))
