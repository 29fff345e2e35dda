"""Frees matched to allocations and reclaimed pointers, by one window over (run, pointer).

A pointer is live when the last event on it was an allocation and recently freed when it was a free, so the
preceding event on the pointer decides both. Events without a pointer, or of other kinds, touch no state; each
has a partition of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake import schema as S
from tracelake.functions.scalars import alloc_size, bucket_index


def resolve(events: DataFrame, reclaim_ns: int = S.RECLAIM_NS) -> DataFrame:
    """``events`` with task_id, size, bucket, size_resolved, resolved_bytes_alloc, allocation_timestamp_ns, object_lifetime_ns,
    reclaim_from_free and reclaim_cross_site."""
    tracked = F.col("op").isin("ALLOC", "FREE") & (F.coalesce("ptr", F.lit("")) != "")
    key = F.when(tracked, F.col("ptr")).otherwise(F.concat(F.lit("\x00"), F.col("seq").cast("string")))
    before = Window.partitionBy("run_id", "_key").orderBy("timestamp_ns", "seq")
    last = F.lag(F.struct("op", "timestamp_ns", "_size", "call_site")).over(before)
    alloc, free = F.col("op") == "ALLOC", F.col("op") == "FREE"
    live = free & (F.col("_last.op") == "ALLOC")
    reclaim = alloc & (F.col("_last.op") == "FREE") & (F.col("timestamp_ns") - F.col("_last.timestamp_ns") <= reclaim_ns)
    no = F.lit(False)
    out = events.withColumns({"_key": key, "_size": F.when(alloc, alloc_size(F.col("bytes_alloc"), F.col("bytes_req")))}).withColumn("_last", last)
    return out.withColumns({
        "task_id": F.coalesce("tid", "pid"),
        "size_resolved": alloc | F.coalesce(live, no),
        "resolved_bytes_alloc": F.when(alloc, F.col("_size")).when(live, F.col("_last._size")),
        "allocation_timestamp_ns": F.when(live, F.col("_last.timestamp_ns")),
        "object_lifetime_ns": F.when(live, F.greatest(F.lit(0), F.col("timestamp_ns") - F.col("_last.timestamp_ns"))),
        "reclaim_from_free": F.coalesce(reclaim, no),
        "reclaim_cross_site": F.coalesce(reclaim & (F.col("call_site") != F.col("_last.call_site")), no),
    }).withColumn("bucket", F.when(F.col("size_resolved"), bucket_index(F.coalesce("resolved_bytes_alloc", F.lit(0))))).drop("_key", "_size", "_last")


def resolution_stats(resolved: DataFrame) -> DataFrame:
    """Counts a run: allocations, frees, resolved and unresolved frees, reclaims; quality of the run."""
    alloc, free = F.col("op") == "ALLOC", F.col("op") == "FREE"
    found = resolved.groupBy("run_id").agg(
        F.count_if(alloc).alias("n_alloc"), F.count_if(free).alias("n_free"), F.count_if(free & F.col("size_resolved")).alias("n_resolved"),
        F.count_if(free & ~F.col("size_resolved")).alias("n_unresolved"), F.count_if("reclaim_from_free").alias("n_reclaim"), F.count_if("reclaim_cross_site").alias("n_cross_site"),
    )
    share = F.col("n_unresolved") / F.greatest(F.col("n_free"), F.lit(1))
    return found.withColumn("quality", F.when(share > S.HIGH_FREE_UNKNOWN, F.lit("high_free_unknown")).otherwise(F.lit("ok")))
