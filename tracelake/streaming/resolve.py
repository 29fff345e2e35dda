"""Free resolution on a stream: one state per (run, pointer), the last event on it.

Events of a key are ordered inside a micro-batch by (timestamp_ns, seq); a batch does not reorder earlier ones, so a
source must deliver a run's events in order, as trace readers do. With ``idle_ms`` a state is dropped when its pointer has
been still for so long. Also event-time window counts with a watermark, for live dashboards.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracelake import schema as S
from tracelake.functions.scalars import alloc_size

OUT = "run_id string, seq long, timestamp_ns long, op string, ptr string, call_site string, size_resolved boolean, resolved_bytes_alloc long, object_lifetime_ns long, reclaim_from_free boolean, reclaim_cross_site boolean"
STATE = "op string, timestamp_ns long, size long, call_site string"


def resolve_stream(events: DataFrame, reclaim_ns: int = S.RECLAIM_NS, idle_ms: int | None = None) -> DataFrame:
    """The annotations of ``operators.resolve`` for a stream (or a table) of events with pointers."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else (None, None, None, None)
        rows = pd.concat(list(frames)).sort_values(["timestamp_ns", "seq"], kind="stable")
        out = []
        for r in rows.itertuples(index=False):
            op, ts, size, site = last
            alloc = r.op == "ALLOC"
            live = not alloc and op == "ALLOC"
            reclaim = alloc and op == "FREE" and r.timestamp_ns - ts <= reclaim_ns
            own = int(r.size) if alloc else (size if live else None)
            out.append((r.run_id, r.seq, r.timestamp_ns, r.op, r.ptr, r.call_site, alloc or live, own, max(0, r.timestamp_ns - ts) if live else None, reclaim, bool(reclaim and r.call_site != site)))
            last = (r.op, int(r.timestamp_ns), int(r.size) if alloc else None, r.call_site)
        state.update(last)
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        frame = pd.DataFrame(out, columns=[f.split()[0] for f in OUT.split(", ")])
        yield frame.astype({"resolved_bytes_alloc": "Int64", "object_lifetime_ns": "Int64"})

    rows = events.filter(F.col("op").isin("ALLOC", "FREE") & (F.coalesce("ptr", F.lit("")) != ""))
    rows = rows.select("run_id", "seq", "timestamp_ns", "op", "ptr", F.coalesce("call_site", F.lit("")).alias("call_site"), alloc_size(F.col("bytes_alloc"), F.col("bytes_req")).alias("size"))
    return rows.groupBy("run_id", "ptr").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def window_counts_stream(events: DataFrame, time_col: str, window: str = "10 minutes", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by run and event-time window, final once the watermark passes."""
    return events.withWatermark(time_col, late).groupBy("run_id", F.window(time_col, window, slide)).agg(F.count("*").alias("event_count"), F.count_if(F.col("op") == "ALLOC").alias("total_alloc")).select("run_id", "window.start", "event_count", "total_alloc")
