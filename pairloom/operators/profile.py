"""Profiling a numeric column."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def moments(df: DataFrame, column: str = "year") -> DataFrame:
    """Population skewness and excess kurtosis."""
    return df.agg(F.skewness(column).alias("skewness"), F.kurtosis(column).alias("kurtosis"))


def shape(
    df: DataFrame, column: str = "year", skew: float = 0.1, flat: float = 2.8, peaked: float = 3.2
) -> DataFrame:
    """Moments with labels for the lean and the tails of the distribution."""
    s, k = F.col("skewness"), F.col("kurtosis")
    lean = (
        F.when((s < skew) & k.between(flat, peaked), "normal")
        .when(s > skew, "right")
        .when(s < -skew, "left")
    )
    tails = F.when(k > peaked, "peaked").when(k < flat, "flat")
    return moments(df, column).withColumn("lean", lean).withColumn("tails", tails)


def histogram(df: DataFrame, column: str = "year", bins: int = 10) -> DataFrame:
    """Counts in equal bins from the least to the greatest value; the last bin is closed."""
    value = F.col(column).cast("double")
    known = df.filter(value.isNotNull())
    low, high = known.agg(F.min(value)).scalar(), known.agg(F.max(value)).scalar()
    number = F.when(low == high, F.lit(1)).otherwise(
        F.least(F.width_bucket(value, low, high, F.lit(bins)), F.lit(bins))
    )
    return known.groupBy(number.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def null_counts(df: DataFrame) -> DataFrame:
    """Missing values per column, in one row."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
