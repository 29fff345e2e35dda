"""Scores: scaling, aggregation of positions and sequences, thresholds."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit_scaler(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean_<c> and std_<c> (population; below 1e-8 it is 1)."""
    std = lambda c: F.when(F.coalesce(F.stddev_pop(c), F.lit(0.0)) < 1e-8, F.lit(1.0)).otherwise(F.stddev_pop(c))
    return df.agg(*[F.avg(c).alias(f"mean_{c}") for c in columns], *[std(c).alias(f"std_{c}") for c in columns])


def scale(df: DataFrame, scaler: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` as z-scores of the one row of ``scaler``."""
    out = df.join(F.broadcast(scaler))
    return out.withColumns({c: (F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}") for c in columns}).drop(*scaler.columns)


def _linear(sorted_values: Column, q: float) -> Column:
    """Linear-interpolated quantile of a sorted array."""
    at = (F.size(sorted_values) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    a, b = F.get(sorted_values, low), F.get(sorted_values, F.least(low + 1, F.size(sorted_values) - 1))
    return a + (b - a) * (at - low)


def aggregate_scores(values: Column, how: str) -> Column:
    """The score of a sequence from an array of position scores: last, max, mean, pNN or topkK."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    if how == "last":
        return F.element_at(values, -1)
    if how == "max":
        return F.array_max(values)
    if how == "mean":
        return mean(values)
    if m := re.fullmatch(r"p(\d+(?:\.\d+)?)", how):
        return _linear(F.sort_array(values), float(m[1]) / 100)
    if (m := re.fullmatch(r"topk(\d+)", how)) and int(m[1]) > 0:
        return mean(F.slice(F.sort_array(values, asc=False), 1, int(m[1])))
    raise ValueError(f"unknown aggregation: {how}")


def run_scores(scores: DataFrame) -> DataFrame:
    """The highest sequence score of each run."""
    return scores.groupBy("run_id").agg(F.max("score").alias("score"))


def threshold(run_scores_: DataFrame, fpr: float = 0.01) -> DataFrame:
    """One row: the linear percentile 100 (1 - fpr) of run scores."""
    if not 0 < fpr < 1:
        raise ValueError("the false-positive rate must lie between 0 and 1")
    return run_scores_.agg(F.percentile("score", F.lit(1 - fpr)).alias("threshold"))


def flag(scores: DataFrame, limit: DataFrame) -> DataFrame:
    """``scores`` with flagged: strictly above the one row of ``limit``."""
    return scores.join(F.broadcast(limit)).withColumn("flagged", F.col("score") > F.col("threshold"))


def calibration(scores: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and standard deviation of each column from sums; variances below 1e-12 are 1e-12."""
    n = F.count("*")
    out = []
    for c in columns:
        mean = F.sum(c) / n
        out += [mean.alias(f"mean_{c}"), F.sqrt(F.greatest(F.sum(F.col(c) * F.col(c)) / n - mean * mean, F.lit(1e-12))).alias(f"std_{c}")]
    return scores.agg(*out)
