"""Blocks stored once and joined many times, and bins that come from a table.

Stored blocks are bucketed tables in the shared folder: rows of a key are in one bucket, and both sides have the same
number of buckets, so every matcher joins them without a shuffle.
"""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType

from pairloom.session import scratch_path, write_through


def store(blocked: DataFrame, on: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Write rows bucketed by ``on`` and give the stored table. Rows without a key are left out.

    Tables that are to be joined need the same ``buckets`` (by default the session's shuffle partitions). The table is
    known to this session under the name of its folder, and ``session.release`` deletes its files.
    """
    spark, on = blocked.sparkSession, list(on)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark)
    name = os.path.basename(path).replace("-", "_")
    # One file a bucket, in the order of the key.
    rows = blocked.dropna(subset=on).repartition(buckets, *on)
    rows.write.option("path", path).bucketBy(buckets, *on).sortBy(*on).saveAsTable(name)
    return spark.table(name)


def match_stored(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Records of two stored tables whose key occurs on both sides: (key…, side, index), as ``matching.match_equal``."""
    on = list(on)
    halves = [
        own.join(other.select(*on), on, "left_semi").select(*on, F.lit(side).alias("side"), "index").distinct()
        for own, other, side in ((left, right, "a"), (right, left, "b"))
    ]
    return halves[0].unionAll(halves[1])


def matched_stored(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys that occur in both stored tables with their records on either side, as ``matching.matched_keys``."""
    on = list(on)
    one, two = (t.groupBy(*on).agg(F.count(F.lit(1)).alias(n)) for t, n in ((left, "n1"), (right, "n2")))
    return one.join(two, on)


def in_bins(records: DataFrame, column: str, bins: DataFrame, totals: Mapping[str, str] | None = None) -> DataFrame:
    """Every record with the label of each bin [low, high) of the table ``bins`` that holds its value.

    With ``totals`` (name: column of whole numbers) instead, for each label that holds any record: (label, records, least, greatest,
    name…), the records in its bins, the least and greatest value there and the sums. Records times bins may then be any number, as none is
    listed.

    Bins may overlap, be of any widths and leave gaps; a record in no bin, or without a value, gives no row. A bin lies in
    one or two cells of the grid that is as wide as the power of two above its width, so records meet bins by
    (level, cell), once for each level that occurs, and only then are compared. The join is a plain equi-join: where the
    bins are few, Spark broadcasts them by their measured size, and else it splits cells with many records.
    """
    spark: SparkSession = records.sparkSession
    width = F.col("high").cast("double") - F.col("low").cast("double")
    if totals is not None:
        return _bin_totals(records, column, bins.filter(width > 0).select("low", "high", "label"), totals)
    level = F.ceil(F.log2(width)).cast("int")
    usable = bins.filter(width > 0).select("low", "high", "label", level.alias("level"))
    # Widths of doubles have some two thousand powers of two; tables have a few.
    levels = [row[0] for row in usable.select("level").distinct().collect()]
    if not levels:
        return records.withColumn("label", F.lit(None).cast(bins.schema["label"].dataType)).filter(F.lit(False))
    cell = lambda x, k: F.floor(x.cast("double") / F.pow(F.lit(2.0), k)).cast("bigint")
    # The end of a bin is not in it, but may be where its last cell begins; that cell then only brings no match.
    cells = F.sequence(cell(F.col("low"), F.col("level")), cell(F.col("high"), F.col("level")))
    spread = usable.withColumn("cell", F.explode(cells))
    asked = records.filter(F.col(column).isNotNull()).withColumn("level", F.explode(F.array(*[F.lit(k) for k in sorted(levels)])))
    asked = asked.withColumn("cell", cell(F.col(column), F.col("level")))
    found = asked.join(spread, ["level", "cell"]).filter((F.col(column) >= F.col("low")) & (F.col(column) < F.col("high")))
    return found.select(*records.columns, "label")


def _bin_totals(records: DataFrame, column: str, bins: DataFrame, totals: Mapping[str, str]) -> DataFrame:
    """Totals of all bins from running sums over the values: what lies below the end less what lies below the beginning.

    Equal values are added up first, and so are equal bins. Values and ends of bins are dealt out by range and summed within each; the ranges
    before one add a row each.
    """
    kinds = {name: records.select(F.sum(c)).schema[0].dataType for name, c in totals.items()}
    for name, kind in kinds.items():
        if not isinstance(kind, LongType):
            raise ValueError(f"{name} is no sum of whole numbers")
    # A sum over nothing but missing numbers is missing, so those present are counted.
    sums = [f"{what}_{name}" for name in totals for what in ("sum", "known")]
    counted = ["records", *sums]
    made = [F.sum(F.col(c).cast("decimal(38,0)")).alias(f"sum_{name}") for name, c in totals.items()]
    made += [F.count(c).cast("decimal(38,0)").alias(f"known_{name}") for name, c in totals.items()]
    value = records.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value"))
    values = value.agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("records"), *made).withColumn("at", F.col("value"))
    alike = write_through(bins.groupBy("low", "high", "label").agg(F.count(F.lit(1)).alias("times")))
    none = values.drop("at").schema
    ends = alike.select(F.col("low").alias("at")).unionAll(alike.select("high")).distinct()
    ends = ends.select(*[F.lit(None).cast(field.dataType).alias(field.name) for field in none], "at")
    points = values.select(*none.names, "at").unionAll(ends).groupBy("at").agg(
        F.max("value").alias("value"), *[F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,0)").alias(c) for c in counted]
    )
    # Where a range begins depends on a sample, so rows keep the range they got.
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = write_through(points.repartitionByRange(parts, "at").withColumn("range", F.spark_partition_id()))
    ranges = points.groupBy("range").agg(
        *[F.sum(c).alias(f"all_{c}") for c in counted], F.min("value").alias("range_least"), F.max("value").alias("range_greatest")
    )
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        "range", *[F.coalesce(F.sum(f"all_{c}").over(earlier), F.lit(0)).alias(f"before_{c}") for c in counted],
        F.max("range_greatest").over(earlier).alias("before"), F.min("range_least").over(later).alias("after"),
    )
    inside = Window.partitionBy("range").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    onwards = Window.partitionBy("range").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = points.select(
        "at", "range", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(c) for c in counted],
        F.max("value").over(inside).alias("own_before"), F.min("value").over(onwards).alias("own_after"),
    ).join(F.broadcast(ranges), "range")
    below = write_through(
        below.select(
            "at", *[(F.col(c) + F.col(f"before_{c}")).cast("decimal(38,0)").alias(c) for c in counted],
            F.coalesce("own_before", "before").alias("last"), F.coalesce("own_after", "after").alias("next"),
        )
    )
    low = below.select(F.col("at").alias("from"), *[F.col(c).alias(f"low_{c}") for c in counted], F.col("next").alias("least"))
    high = below.select(F.col("at").alias("to"), *[F.col(c).alias(f"high_{c}") for c in counted], F.col("last").alias("greatest"))
    found = alike.join(low, F.col("low") == F.col("from")).join(high, F.col("high") == F.col("to"))
    found = found.withColumns({c: (F.col(f"high_{c}") - F.col(f"low_{c}")) * F.col("times") for c in counted}).filter("records > 0")
    whole = lambda name: F.when(F.sum(f"known_{name}") > 0, F.sum(f"sum_{name}")).cast("bigint")
    return found.groupBy("label").agg(
        F.sum("records").cast("bigint").alias("records"), F.min("least").alias("least"), F.max("greatest").alias("greatest"),
        *[whole(name).alias(name) for name in totals],
    )
