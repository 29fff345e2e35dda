"""Sequences of windows and of events, cut inside runs, with their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake import schema as S
from tracelake.functions.scalars import sequence_label, token_sequence_label, window_label


def label_windows(windows: DataFrame, runs: DataFrame, g: S.Geometry = S.Geometry()) -> DataFrame:
    """``windows`` with label by the spray interval of their run; ``runs``: run_id, is_attack, spray_start_ns, spray_end_ns."""
    start = F.col("start_ns")
    joined = windows.join(runs.select("run_id", "is_attack", "spray_start_ns", "spray_end_ns"), "run_id", "left")
    label = window_label(start, start + g.window_ns, F.coalesce("is_attack", F.lit(False)), F.col("spray_start_ns"), F.col("spray_end_ns"))
    return joined.withColumn("label", label).drop("is_attack", "spray_start_ns", "spray_end_ns")


def window_sequences(windows: DataFrame, values: Column | None = None, length: int = S.SEQ_WINDOWS, policy: str = "endpoint", boundary: str = "drop") -> DataFrame:
    """run_id, start_ns, seq_label (and ``items``) of every ``length`` consecutive windows of a run, step one; short runs have none."""
    frame = Window.partitionBy("run_id").orderBy("start_ns").rowsBetween(Window.currentRow, length - 1)
    labels = F.collect_list("label").over(frame)
    out = windows.withColumn("_labels", labels)
    if values is not None:
        out = out.withColumn("items", F.collect_list(values).over(frame))
    out = out.filter(F.size("_labels") == length)
    return out.select("run_id", "start_ns", sequence_label(F.col("_labels"), policy, boundary).alias("seq_label"), *(["items"] if values is not None else []))


def short_runs(windows: DataFrame, length: int = S.SEQ_WINDOWS, policy: str = "drop") -> DataFrame:
    """Runs with fewer windows than a sequence; with policy ``error`` such a run raises when it is read."""
    found = windows.groupBy("run_id").agg(F.count("*").alias("n_windows")).filter(F.col("n_windows") < length)
    if policy == "error":
        return found.withColumn("n_windows", F.when(F.raise_error(F.concat(F.lit("run is too short: "), F.col("run_id"))).isNull(), F.col("n_windows")))
    return found


def event_sequences(tokens: DataFrame, item: Column, length: int = S.SEQ_EVENTS, stride: int = S.SEQ_EVENT_STRIDE, label: str = "label") -> DataFrame:
    """run_id, chunk, items, seq_label of every ``length`` consecutive events, ``stride`` apart; ``tokens`` has pos and ``label``.

    An event lies in at most ceil(length / stride) chunks, so the shuffle grows with the events.
    """
    last = F.expr(f"pos div {stride}")
    first = F.greatest(F.lit(0).cast("long"), F.expr(f"(pos - {length} + {stride}) div {stride}"))
    rows = tokens.withColumn("chunk", F.explode(F.sequence(first, last))).filter(F.col("pos") < F.col("chunk") * stride + length)
    grouped = rows.groupBy("run_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("pos", item.alias("item"), F.col(label).alias("l")))).alias("x")).filter(F.size("x") == length)
    return grouped.select("run_id", "chunk", F.col("x.item").alias("items"), token_sequence_label(F.col("x.l")).alias("seq_label"))


def reset_first(items: Column) -> Column:
    """Field arrays whose first event has no predecessor: longest delta class, continuous delta 0."""
    return F.transform(items, lambda x, i: F.when(i == 0, x.withField("dt", F.lit(len(S.DT_FIELD_US))).withField("dt_cont", F.lit(0.0))).otherwise(x))


def contiguous(windows: DataFrame, g: S.Geometry = S.Geometry()) -> DataFrame:
    """Runs with a gap between neighbouring windows: (run_id, n_gaps)."""
    before = Window.partitionBy("run_id").orderBy("start_ns")
    gap = F.col("start_ns") - F.lag("start_ns").over(before)
    return windows.withColumn("_gap", gap).groupBy("run_id").agg(F.count_if(F.col("_gap") != g.stride_ns).alias("n_gaps")).filter("n_gaps > 0")


def dedup_window_scores(scores: DataFrame, length_ns: int) -> DataFrame:
    """(run_id, slot, score): the highest score of each window over overlapping sequences; ``scores``: run_id, start_ns, values."""
    each = scores.select("run_id", "start_ns", F.posexplode("values").alias("k", "score"))
    slot = F.bround((F.col("start_ns") + F.col("k") * length_ns) / length_ns).cast("long")
    return each.groupBy("run_id", slot.alias("slot")).agg(F.max("score").alias("score"))


def median_step(scores: DataFrame) -> DataFrame:
    """Median distance of neighbouring sequence starts inside runs."""
    gap = F.col("start_ns") - F.lag("start_ns").over(Window.partitionBy("run_id").orderBy("start_ns"))
    return scores.withColumn("_gap", gap).agg(F.percentile("_gap", F.lit(0.5)).alias("step_ns"))
