"""Hopping windows over integer nanoseconds: the spine of all windows of a run, and the windows of each event."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.schema import Geometry


def spine(events: DataFrame, g: Geometry) -> DataFrame:
    """(run_id, start_ns) of every window from a run's first event to its last, empty ones included."""
    floor = lambda c: F.expr(f"{c} - pmod({c}, {g.stride_ns}L)")
    bounds = events.groupBy("run_id").agg(F.min("timestamp_ns").alias("first"), F.max("timestamp_ns").alias("last"))
    return bounds.select("run_id", F.explode(F.sequence(floor("first"), floor("last"), F.lit(g.stride_ns))).alias("start_ns"))


def assign(events: DataFrame, g: Geometry) -> DataFrame:
    """Each event once for every window that holds it (start included, end not); no window begins before the run's first."""
    starts = events.groupBy("run_id").agg(F.min("timestamp_ns").alias("_first"))
    last = F.expr(f"timestamp_ns - pmod(timestamp_ns, {g.stride_ns}L)")
    hops = -(-g.window_ns // g.stride_ns)
    options = F.sequence(last - F.lit((hops - 1) * g.stride_ns), last, F.lit(g.stride_ns))
    rows = events.join(starts, "run_id").withColumn("start_ns", F.explode(options))
    first = F.expr(f"_first - pmod(_first, {g.stride_ns}L)")
    return rows.filter((F.col("start_ns") >= first) & (F.col("timestamp_ns") < F.col("start_ns") + g.window_ns)).drop("_first")


def since_previous(events: DataFrame, windows: DataFrame, g: Geometry) -> DataFrame:
    """(run_id, start_ns, time_since_previous_event_ms): the gap to the last event before each window, at most the cap.

    An as-of join as a running maximum over stride cells, to which windows are aligned.
    """
    cells = events.groupBy("run_id", F.expr(f"timestamp_ns - pmod(timestamp_ns, {g.stride_ns}L)").alias("start_ns")).agg(F.max("timestamp_ns").alias("_cell"))
    before = Window.partitionBy("run_id").orderBy("start_ns").rowsBetween(Window.unboundedPreceding, -1)
    gap = (F.col("start_ns") - F.max("_cell").over(before)) / 1e6
    capped = F.when(gap.isNotNull(), F.least(F.greatest(gap, F.lit(0.0)), F.lit(g.gap_cap_ns / 1e6)))
    return windows.join(cells, ["run_id", "start_ns"], "left").select("run_id", "start_ns", F.coalesce(capped, F.lit(g.window_ns / 1e6)).alias("time_since_previous_event_ms"))
