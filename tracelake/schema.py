"""Schemas, constants and the window geometry of the trace model.

Times are nanoseconds in longs; an event's order in its run is (timestamp_ns, seq), since stamps tie.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Bucket bounds (inclusive), thresholds, vocabulary radices and lengths of the data format.
SIZE_BUCKETS = (32, 64, 96, 128, 192, 256, 512, 1024, 2048, 4096, 8192)
BUCKET_LABELS = (*(str(s) for s in SIZE_BUCKETS), "gt_8192")
N_BUCKETS = len(BUCKET_LABELS)
DT_US = (2.0, 50.0, 1000.0)
DT_FIELD_US = (2.0, 10.0, 100.0, 1000.0, 10_000.0)
LIFETIME_US = (100.0, 10_000.0)
TOKEN_RADICES = (2, 12, 4, 4, 4, 3, 3)
CALL_SITE_SLOTS = 4096
SEQ_WINDOWS = 32
SEQ_EVENTS, SEQ_EVENT_STRIDE = 128, 64
CPU_HISTORY = 32
RECLAIM_NS = 50_000_000
BOUNDARY_FRACTION = 0.5
HIGH_FREE_UNKNOWN = 0.05
SCHEMA_VERSION = 3

EVENT = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("timestamp_ns", T.LongType()),
    T.StructField("pid", T.LongType()), T.StructField("tid", T.LongType()), T.StructField("cpu", T.IntegerType()),
    T.StructField("comm", T.StringType()), T.StructField("op", T.StringType()), T.StructField("ptr", T.StringType()),
    T.StructField("bytes_req", T.LongType()), T.StructField("bytes_alloc", T.LongType()), T.StructField("call_site", T.StringType()),
])
CSV_COLUMNS = ("timestamp_ns", "pid", "tid", "cpu", "comm", "op", "ptr", "bytes_req", "bytes_alloc", "call_site")


@dataclass(frozen=True)
class Geometry:
    """Lengths in nanoseconds: hopping window, stride, sub-window for bursts, cap of the idle gap, bound of short lives."""

    window_ns: int = 100_000_000
    stride_ns: int = 50_000_000
    bin_ns: int = 1_000_000
    gap_cap_ns: int = 60_000_000_000
    short_ns: int = 1_000_000
    reclaim_ns: int = RECLAIM_NS

    @property
    def bins(self) -> int:
        return max(1, -(-self.window_ns // self.bin_ns))


def _per_bucket(prefix: str) -> list[str]:
    return [f"{prefix}_{label}" for label in BUCKET_LABELS]


# Names, groups and order of a window's features.
GROUPS = {
    **{p: _per_bucket(p) for p in ("alloc_count", "free_count", "alloc_rate", "free_rate")},
    "global": [
        "alloc_free_bucket_corr", "alloc_callsite_entropy", "free_callsite_entropy", "total_alloc", "total_free", "net_alloc_resolved", "free_unknown",
        "alloc_burst_1ms", "free_burst_1ms", "alloc_free_ratio", "n_active_tasks", "top_task_alloc_fraction", "task_alloc_entropy",
    ],
    "top_task_alloc": _per_bucket("top_task_alloc_count"),
    "top_task_free": _per_bucket("top_task_free_count"),
    "timing": ["top_task_alloc_burst_1ms", "top_task_alloc_free_ratio", "event_count", "is_empty", "time_since_previous_event_ms"],
    "reclaim": ["reclaim_count", "cross_site_reclaim_count", "reclaim_rate"],
    "cpu": ["cpu_alloc_entropy", "top_cpu_alloc_fraction"],
    "lifetime": ["lifetime_median", "lifetime_p90", "short_lived_count", "long_lived_count"],
    "burst": ["burst_dominant_bucket_ratio", "burst_dominant_callsite_ratio"],
}
FEATURES = [name for group in GROUPS.values() for name in group]
