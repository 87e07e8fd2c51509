"""Statistics of multisets and the indicators made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def multiset(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row for each key: size, number of distinct values, most copies, unique mode (null on ties), entropy and that over ln(size)."""
    counts = df.groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    # The largest and the smallest of the most frequent values are one if and only if there is no tie.
    total = counts.groupBy(*keys).agg(
        F.sum("c").alias("size"), F.count("*").alias("distinct"), F.sum(F.col("c") * F.ln("c")).alias("clnc"),
        F.max(F.struct("c", "v")).alias("high"), F.min(F.struct(-F.col("c"), "v")).alias("low"),
    )
    total = total.withColumn("max_dup", F.col("high.c")).withColumn("majority", F.when(F.col("high.v") == F.col("low.v"), F.col("high.v")))
    total = total.withColumn("entropy", F.when(F.col("distinct") == 1, 0.0).otherwise(F.ln("size") - F.col("clnc") / F.col("size")))
    return total.withColumn("normalized_entropy", F.when(F.col("size") <= 1, 0.0).otherwise(F.col("entropy") / F.ln("size"))).drop("clnc", "high", "low")


def quantized(v: Column) -> Column:
    """The powers of two up to ``v``."""
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.pow(F.lit(2.0), i).cast("long")), lambda p: p <= v)


def percents(v: Column) -> Column:
    """0, 20, .. up to 100 * v; none for NaN."""
    return F.when(F.isnan(v), F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(0), F.lit(100), F.lit(20)), lambda i: i <= F.least(v * 100, F.lit(100.0))))


def quadratic(v: Column) -> Column:
    """A share within 0 and 1 and its square."""
    v = F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    return F.array(v, v * v)


def bin_of(v: Column, n: int = 10) -> Column:
    return F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(0.9999)) * n).cast("int")


def mean_dev(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and deviation whose sums go over distinct values but are divided by the multiset's size."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    per = counts.groupBy(*keys).agg((F.sum("v") / F.sum("c")).alias("mean"), (F.sum(F.col("v") * F.col("v")) / F.sum("c")).alias("square"))
    return per.withColumn("deviation", F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0)))).drop("square")
