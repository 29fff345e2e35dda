"""Event tokens and fields: call-site profiles, processor concentration, deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake import schema as S
from tracelake.functions import scalars as X
from tracelake.operators.resolve import resolve

#: Profiles (about 60 bytes each) that may be broadcast; beyond, the join shuffles.
BROADCAST_PROFILES = 200_000


def call_site_profiles(events: DataFrame) -> DataFrame:
    """call_site, total_count, behavior_type, frequency_rank from the allocations of ``events`` (normal runs).

    Behaviour: 0 one size, 1 few, 2 broad, 3 unseen; rank: 0 at the 95th percentile of counts, 1 at the 80th, 2 at the median, 3 below.
    """
    size = X.alloc_size(F.col("bytes_alloc"), F.col("bytes_req"))
    sizes = events.filter("op = 'ALLOC'").groupBy("call_site", X.bucket_index(size).alias("bucket")).agg(F.count("*").alias("n"))
    sites = sizes.groupBy("call_site").agg(F.sum("n").alias("total_count"), F.max("n").alias("_top"), F.count("*").alias("_kinds"))
    cuts = sites.agg(F.percentile("total_count", F.array(F.lit(0.5), F.lit(0.8), F.lit(0.95))).alias("_p"))
    kind = F.when(F.col("total_count") == 0, 3).when((F.col("_top") / F.col("total_count") >= 0.9) & (F.col("_kinds") <= 2), 0).when(F.col("_kinds") <= 3, 1).otherwise(2)
    rank = F.when(F.col("total_count") >= F.get("_p", F.lit(2)), 0).when(F.col("total_count") >= F.get("_p", F.lit(1)), 1).when(F.col("total_count") >= F.get("_p", F.lit(0)), 2).otherwise(3)
    # one row of percentiles
    return sites.join(F.broadcast(cuts)).select("call_site", "total_count", kind.alias("behavior_type"), rank.alias("frequency_rank"))


def cpu_concentration(history: int = S.CPU_HISTORY):
    """Share of a run's last ``history`` events (this one included) on the same processor: 0 over 0.7, 1 over 0.3, else 2; needs pos."""
    same = F.count("*").over(Window.partitionBy("run_id", "cpu").orderBy("pos").rangeBetween(1 - history, 0))
    share = same / F.least(F.col("pos") + 1, F.lit(history))
    return F.when(F.col("pos") == 0, 0).when(share > 0.7, 0).when(share > 0.3, 1).otherwise(2)


def tokenise(events: DataFrame, profiles: DataFrame, runs: DataFrame | None = None, reclaim_ns: int = S.RECLAIM_NS) -> DataFrame:
    """run_id, pos, timestamp_ns, token, the event's fields and label (1 inside the closed interval of its run in ``runs``)."""
    order = Window.partitionBy("run_id").orderBy("timestamp_ns", "seq")
    rows = resolve(events, reclaim_ns).withColumns({"pos": (F.row_number().over(order) - 1).cast("long"), "_dt": F.col("timestamp_ns") - F.lag("timestamp_ns").over(order)})
    small = profiles.select(F.col("call_site"), "behavior_type", "frequency_rank")
    rows = rows.join(F.broadcast(small) if small.count() <= BROADCAST_PROFILES else small, "call_site", "left")
    if runs is None:
        label = F.lit(0)
    else:
        rows = rows.join(runs.select("run_id", "spray_start_ns", "spray_end_ns"), "run_id", "left")
        label = F.when(F.col("timestamp_ns").between(F.col("spray_start_ns"), F.col("spray_end_ns")), 1).otherwise(0)
    rows = rows.withColumns({
        "op_code": F.when(F.col("op") == "ALLOC", 0).otherwise(1), "size_bucket": X.token_size_bucket(F.coalesce("resolved_bytes_alloc", F.lit(0))), "cs": X.call_site_slot(F.col("call_site")),
        "cpu_bucket": cpu_concentration(), "reclaim": X.reclaim_flag(F.col("reclaim_from_free"), F.col("reclaim_cross_site")),
        "life": X.lifecycle_state(F.col("op"), F.col("reclaim_from_free"), F.col("object_lifetime_ns")), "dt": X.dt_field_bucket(F.col("_dt")), "dt_cont": X.dt_continuous(F.col("_dt")), "label": label,
    })
    token = X.encode_token(F.col("op_code"), F.col("size_bucket"), F.coalesce("behavior_type", F.lit(3)), F.coalesce("frequency_rank", F.lit(3)), X.dt_bucket(F.col("_dt")), F.col("cpu_bucket"), F.col("reclaim"))
    return rows.select("run_id", "pos", "timestamp_ns", token.alias("token"), F.col("op_code").alias("op"), "size_bucket", "cs", "cpu_bucket", "reclaim", "life", "dt", "dt_cont", "label")


FIELD_NAMES = ("op", "size_bucket", "cs", "cpu_bucket", "reclaim", "life", "dt", "dt_cont")


def fields():
    return F.struct(*FIELD_NAMES)
