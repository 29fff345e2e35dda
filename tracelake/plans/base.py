"""The driver's ``events`` read as allocation events, and the same in SQL.

A user's clicks, views and purchases allocate, errors and signups free; the pointer is the user, eight runs share
the users. Stamps are minutes apart, so windows are ten minutes long and the other lengths grow alike.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake import schema as S

MINUTE = 60_000_000_000
G = S.Geometry(window_ns=10 * MINUTE, stride_ns=5 * MINUTE, bin_ns=6_000_000_000, gap_cap_ns=60 * MINUTE, short_ns=60 * MINUTE, reclaim_ns=360 * MINUTE)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder of ``spark.checkpoint.dir``; unset, a temporary one, but only where all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tracelake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    size = F.floor(F.col("value") * 20).cast("long")
    op = F.when(F.col("event_type").isin("click", "view", "purchase"), "ALLOC").otherwise("FREE")
    return e.select(
        F.concat(F.lit("run_"), (F.col("user_id") % 8).cast("string")).alias("run_id"), F.col("event_id").alias("seq"), (F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")) * 1000).alias("timestamp_ns"),
        (F.col("user_id") % 32).alias("pid"), (F.col("user_id") % 32).alias("tid"), (F.col("event_id") % 4).cast("int").alias("cpu"), F.col("event_type").alias("comm"), op.alias("op"),
        F.col("user_id").cast("string").alias("ptr"), F.lit(0).cast("long").alias("bytes_req"), F.when(op == "ALLOC", size).otherwise(F.lit(0)).alias("bytes_alloc"), F.col("props").alias("call_site"),
    )


def spray_runs(events: DataFrame) -> DataFrame:
    """Runs 0 to 3 as attacks, with an interval two days and three minutes long from the fifth day on."""
    day = 1440 * MINUTE
    first = events.groupBy("run_id").agg(F.min("timestamp_ns").alias("first"))
    attack = F.col("run_id").isin("run_0", "run_1", "run_2", "run_3")
    return first.select("run_id", attack.alias("is_attack"), F.when(attack, F.col("first") + 5 * day).alias("spray_start_ns"), F.when(attack, F.col("first") + 7 * day + 3 * MINUTE).alias("spray_end_ns"))


_W, _S, _B, _R, _D = G.window_ns, G.stride_ns, G.bin_ns, G.reclaim_ns, 1440 * MINUTE


def bucket_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} <= {b} THEN {i}" for i, b in enumerate(S.SIZE_BUCKETS)) + f" ELSE {len(S.SIZE_BUCKETS)} END"


EV = """ev AS (SELECT 'run_' || (user_id % 8) AS run_id, event_id AS seq, epoch_us(ts) * 1000 AS timestamp_ns, user_id % 32 AS task_id, CAST(event_id % 4 AS INTEGER) AS cpu, event_type AS comm,
  CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'ALLOC' ELSE 'FREE' END AS op, user_id AS ptr, CAST(floor(value * 20) AS BIGINT) AS size, props AS call_site FROM events)"""
RE = EV + f""", lg AS (SELECT *, lag(op) OVER w AS lop, lag(timestamp_ns) OVER w AS lts, lag(size) OVER w AS lsize, lag(call_site) OVER w AS lsite FROM ev WINDOW w AS (PARTITION BY run_id, ptr ORDER BY timestamp_ns, seq)),
re AS (SELECT *, op = 'ALLOC' OR coalesce(lop = 'ALLOC', false) AS size_resolved, CASE WHEN op = 'ALLOC' THEN size WHEN lop = 'ALLOC' THEN lsize END AS rb,
  CASE WHEN op = 'FREE' AND lop = 'ALLOC' THEN greatest(0, timestamp_ns - lts) END AS life, coalesce(op = 'ALLOC' AND lop = 'FREE' AND timestamp_ns - lts <= {_R}, false) AS rec,
  coalesce(op = 'ALLOC' AND lop = 'FREE' AND timestamp_ns - lts <= {_R} AND call_site <> lsite, false) AS crs FROM lg),
rx AS (SELECT *, CASE WHEN size_resolved THEN {bucket_sql('rb')} END AS bucket FROM re)"""
WN = RE + f""", bd AS (SELECT run_id, min(timestamp_ns) - min(timestamp_ns) % {_S} AS lo, max(timestamp_ns) - max(timestamp_ns) % {_S} AS hi FROM ev GROUP BY 1),
sp AS (SELECT run_id, unnest(range(lo, hi + {_S}, {_S})) AS start_ns FROM bd),
wx AS (SELECT *, unnest([timestamp_ns - timestamp_ns % {_S} - {_S}, timestamp_ns - timestamp_ns % {_S}]) AS start_ns FROM rx),
wn AS (SELECT wx.*, least((timestamp_ns - start_ns) // {_B}, {G.bins - 1}) AS bin FROM wx JOIN bd USING (run_id) WHERE start_ns >= lo AND timestamp_ns < start_ns + {_W})"""
RUNS = f"""runs AS (SELECT run_id, run_id IN ('run_0','run_1','run_2','run_3') AS is_attack, min(timestamp_ns) + {5 * _D} AS s0, min(timestamp_ns) + {7 * _D + 3 * MINUTE} AS s1 FROM ev GROUP BY 1)"""
LABEL = f"""lb AS (SELECT sp.run_id, sp.start_ns, greatest(0, least(start_ns + {_W}, s1) - greatest(start_ns, s0)) AS ov, is_attack, s1 - s0 AS len FROM sp JOIN runs USING (run_id)),
lw AS (SELECT run_id, start_ns, CASE WHEN NOT is_attack THEN 0 WHEN ov = 0 THEN 0 WHEN ov >= {_W} * 0.5 OR ov >= len * 0.5 THEN 1 ELSE -1 END AS label FROM lb)"""
# the running entropy of grouped counts c
ENT = "CASE WHEN count(*) FILTER (c > 0) > 1 THEN (log2(sum(c)) - sum(c * log2(greatest(c, 1))) / sum(c)) / log2(count(*) FILTER (c > 0)) ELSE 0.0 END"


def f32(c: str) -> str:
    return f"round(CAST(CAST({c} AS FLOAT) AS DOUBLE), 4)"
