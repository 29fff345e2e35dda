"""Ranking and classification metrics as grouped sums and running windows; ties are exact.

Curves are computed over distinct scores: counts by score first, then one running sum over them. The running
sum is taken in two levels, within ranges of scores and over the ranges, so no task sees all scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLITS = 64


def _curve(scored: DataFrame, keys: list[str]) -> DataFrame:
    """By descending score: p, q positives and negatives at the score, tp, fp at or above it, big_p and big_n of the group."""
    counts = scored.groupBy(*keys, "score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("q"))
    edges = counts.groupBy(*keys).agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"), F.sum("p").alias("big_p"), F.sum("q").alias("big_n"))
    joined = counts.join(edges, keys) if keys else counts.join(F.broadcast(edges))
    width = F.when(F.col("_hi") > F.col("_lo"), (F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.lit(0.0))
    ranged = joined.withColumn("_r", F.floor(width * (SPLITS - 1)).cast("int"))
    above = Window.partitionBy(*keys).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)
    heads = ranged.groupBy(*keys, "_r").agg(F.sum("p").alias("_p"), F.sum("q").alias("_q"))
    heads = heads.select(*keys, "_r", F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_tp"), F.coalesce(F.sum("_q").over(above), F.lit(0)).alias("_fp"))
    within = Window.partitionBy(*keys, "_r").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(heads, [*keys, "_r"])
    return out.select(*keys, "score", "p", "q", "big_p", "big_n", (F.col("_tp") + F.sum("p").over(within)).alias("tp"), (F.col("_fp") + F.sum("q").over(within)).alias("fp"))


def ranking_metrics(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """roc_auc (ties one half), average_precision (step sums) and best_f1 with its threshold; null where a class is missing.

    ``scored``: score, label (1 is positive) and ``keys``.
    """
    keys = keys or []
    c = _curve(scored, keys)
    f1 = 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("big_p"))
    both = (F.max("big_p") > 0) & (F.max("big_n") > 0)
    pairs = F.max("big_p") * F.lit(1.0) * F.max("big_n")
    return c.withColumn("f1", f1).groupBy(*keys).agg(
        F.when(both, F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2)) / pairs).alias("roc_auc"),
        F.when(both, F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.max("big_p")).alias("average_precision"),
        F.when(both, F.max("f1")).alias("best_f1"), F.when(both, F.max_by("score", F.struct(F.col("f1"), -F.col("score")))).alias("best_threshold"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def classification(flagged: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """precision, recall, f1, fpr, n_flagged, n of rows (flagged, label); zero where a denominator is zero."""
    hit, pos = F.col("flagged"), F.col("label") == 1
    tp, fp, fn, tn = F.count_if(hit & pos), F.count_if(hit & ~pos), F.count_if(~hit & pos), F.count_if(~hit & ~pos)
    return flagged.groupBy(*(keys or [])).agg(
        _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), _ratio(fp, fp + tn).alias("fpr"),
        F.count_if(hit).alias("n_flagged"), F.count("*").alias("n"),
    )


def grouped_flags(flagged: DataFrame, keys: list[str]) -> DataFrame:
    """count, n_flagged and detection_rate of each group, and of all where ``rollup`` keys are null."""
    return flagged.rollup(*keys).agg(F.count("*").alias("runs_total"), F.count_if("flagged").alias("n_flagged"), (F.count_if("flagged") / F.count("*")).alias("detection_rate"))


def ghost_runs(sequences: DataFrame) -> DataFrame:
    """Attack runs without a sequence of label 1."""
    return sequences.groupBy("run_id").agg(F.max("seq_label").alias("top_label")).filter("top_label < 1")


def bootstrap_ci(scored: DataFrame, limit: float, rounds: int = 2000, seed: int = 0) -> DataFrame:
    """2.5th and 97.5th percentiles of recall, fpr and roc_auc over resamples of runs; resamples of one class are skipped.

    The runs of an experiment (hundreds) are one broadcast row; resamples are spread over tasks.
    """
    import numpy as np
    import pyarrow as pa

    runs = scored.agg(F.collect_list(F.struct(F.col("score").cast("double").alias("s"), F.col("label").cast("int").alias("l"))).alias("runs"))

    def resample(batches):
        for batch in batches:
            rows = {"auc": [], "recall": [], "fpr": []}
            for i, own in zip(batch.column("id").to_pylist(), batch.column("runs").to_pylist()):
                own = sorted((x["s"], x["l"]) for x in own)
                pick = np.random.default_rng([seed, i]).integers(0, len(own), len(own))
                s, y = np.array([own[k][0] for k in pick]), np.array([own[k][1] for k in pick]) == 1
                if y.all() or not y.any():
                    continue
                neg = np.sort(s[~y])
                wins = np.searchsorted(neg, s[y], "left") + np.searchsorted(neg, s[y], "right")
                rows["auc"].append(float(wins.sum() / (2 * y.sum() * (~y).sum())))
                rows["recall"].append(float((s[y] > limit).mean()))
                rows["fpr"].append(float((s[~y] > limit).mean()))
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.float64()) for k, v in rows.items()})

    each = scored.sparkSession.range(rounds).join(F.broadcast(runs)).mapInArrow(resample, "auc double, recall double, fpr double")
    q = F.array(F.lit(0.025), F.lit(0.975))
    cut = lambda c: [F.get(F.percentile(c, q), F.lit(i)).alias(f"{c}_{n}") for i, n in enumerate(("low", "high"))]
    return each.agg(F.count("*").alias("n_resamples"), *cut("auc"), *cut("recall"), *cut("fpr"))
