"""Scoring, ranking and evaluation of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(features: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    """Score of each key: sum of value * weight, missing weights 0."""
    return features.join(params.select("feature", "weight"), "feature", "left").groupBy(*keys).agg(F.sum(F.col("value") * F.coalesce("weight", F.lit(0.0))).alias("score"))


def ranked(cands: DataFrame, example: list[str], score: str, ties: list[str], entities: str) -> DataFrame:
    """rank by descending score and ``ties``, and unique_rank, the number of distinct lists so far."""
    order = [F.desc(score), *ties]
    w = Window.partitionBy(*example).orderBy(*order)
    out = cands.withColumn("rank", F.row_number().over(w))
    first = F.row_number().over(Window.partitionBy(*example, entities).orderBy(*order)) == 1
    return out.withColumn("_first", first.cast("int")).withColumn("unique_rank", F.sum("_first").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_first")


def ir(correct: Column, predicted: Column, gold: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1."""
    p = F.coalesce(F.try_divide(correct, predicted), F.lit(0.0))
    r = F.coalesce(F.try_divide(correct, gold), F.lit(0.0))
    return p, r, F.when(correct == 0, 0.0).otherwise(2 * p * r / (p + r))
