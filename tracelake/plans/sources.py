"""Queries over the sources: the driver's ``events`` are written as trace lines and files, read back and held against the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.plans.base import table, trace_events, work_path
from tracelake.sources import runs as U
from tracelake.sources import traces as TR

# seconds since this stamp, so that a stamp in doubles keeps its microseconds
EPOCH_US = 1_704_067_200_000_000


def _written(spark, sf_dir):
    """events with the words of their trace lines: run, micros, task, pid, cpu, op, ptr, size, site, and the stamp as seconds."""
    e = table(spark, sf_dir, "events")
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")) - EPOCH_US
    sign = lambda c: F.lpad(F.lower(F.hex(c)), 8, "0")
    e = e.select(
        "event_id", "event_type", (F.col("user_id") % 8).alias("run"), us.alias("us"), F.concat("event_type", F.lit("-x")).alias("task"), F.col("user_id").alias("pid"), (F.col("event_id") % 4).alias("cpu"),
        F.when(F.col("event_type").isin("click", "view", "purchase"), "ALLOC").otherwise("FREE").alias("op"), sign("user_id").alias("ptr"), sign("event_id").alias("site"), F.floor(F.col("value") * 20).cast("long").alias("size"),
    )
    return e.withColumn("stamp", F.format_string("%d.%06d", F.expr("us div 1000000"), F.col("us") % 1_000_000))


def _lines(e, line, half=0):
    """Lines of a trace, their path and their place in it."""
    path = F.concat(F.lit("/raw/CVE-2024-1/attack/spray/run_"), F.col("run").cast("string"), F.lit("/trace.log"))
    return e.select(path.alias("path"), F.lit(0).cast("long").alias("block"), (F.col("event_id") * 4 + half).alias("line_id"), line.alias("line")).filter("line is not null")


def _stored(*lines):
    """``lines`` written and read back in the layout of ``read_lines``, with the run that their path names: what is parsed is stored text."""
    spark, path = lines[0].sparkSession, work_path(lines[0].sparkSession, "lines")
    for part in lines:
        part.write.mode("append").parquet(path)
    return TR.with_run_id(spark.read.schema(lines[0].schema).parquet(path), "/raw")


def _kernel(e):
    head = F.format_string("  %s-%d   [%03d] ...1 %s: ", "task", "pid", "cpu", "stamp")
    alloc = F.format_string("kmalloc: call_site=%s ptr=%s bytes_req=%d bytes_alloc=%d gfp_flags=GFP_KERNEL", "site", "ptr", "size", F.col("size") + 8)
    return F.concat(head, F.when(F.col("op") == "ALLOC", alloc).otherwise(F.format_string("kfree: call_site=%s ptr=%s", "site", "ptr")))


def _probe(e):
    return F.concat_ws(",", F.col("us") * 1000, "pid", F.col("pid") + 1, "task", "op", "ptr", "size", F.col("size") + 8, "site")


def trace_lines(spark, sf_dir):
    """Runs of even number as kernel lines, others as probe lines; comments, blanks, cut lines and, later in each run, lines of the other grammar are no events."""
    e = _written(spark, sf_dir)
    even = F.col("run") % 2 == 0
    own = _lines(e, F.when(even, _kernel(e)).otherwise(_probe(e)))
    other = _lines(e, F.when(even, _probe(e)).otherwise(_kernel(e)), 1)
    junk = _lines(e, F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("# "), _kernel(e))).when(F.col("event_id") % 3 == 1, F.lit("   ")).otherwise(F.substring_index(_kernel(e), " call_site", 1)), 2)
    return TR.parse_lines(_stored(own, other, junk)).drop("tid")


TRACE_LINES = f"""
WITH e AS (SELECT *, user_id % 8 AS run, epoch_us(ts) - {EPOCH_US} AS us, event_type IN ('click', 'view', 'purchase') AS a, CAST(floor(value * 20) AS BIGINT) AS size FROM events)
SELECT 'CVE-2024-1/spray/run_' || run AS run_id, row_number() OVER (PARTITION BY run ORDER BY event_id) - 1 AS seq,
  CASE WHEN run % 2 = 1 THEN us * 1000 ELSE CAST(trunc(CAST((us // 1000000) || '.' || lpad(CAST(us % 1000000 AS VARCHAR), 6, '0') AS DOUBLE) * 1e9) AS BIGINT) END AS timestamp_ns,
  user_id AS pid, CAST(CASE WHEN run % 2 = 1 THEN 0 ELSE event_id % 4 END AS INTEGER) AS cpu, event_type || '-x' AS comm, CASE WHEN a THEN 'ALLOC' ELSE 'FREE' END AS op,
  lpad(lower(to_hex(user_id)), 8, '0') AS ptr, CASE WHEN a OR run % 2 = 1 THEN size ELSE 0 END AS bytes_req, CASE WHEN a OR run % 2 = 1 THEN size + 8 ELSE 0 END AS bytes_alloc,
  lpad(lower(to_hex(event_id)), 8, '0') AS call_site FROM e
"""


def trace_markers(spark, sf_dir):
    """Intervals of runs: signups write start markers, errors end markers; manifests, written and read as files, come before the trace."""
    e = _written(spark, sf_dir)
    name = F.when(F.col("event_type") == "signup", "SPRAY_START").when(F.col("event_type") == "error", "SPRAY_END")
    text = F.concat(F.format_string("  %s-%d  [%03d] ....  %s: tracing_mark_write+0xb2/0x200 <ffffffff81167302>: ", "task", "pid", "cpu", "stamp"), name)
    marked = TR.markers(_stored(_lines(e, text), _lines(e, _kernel(e), 1)))
    first = e.groupBy("run").agg(F.min("event_id").alias("n"))
    run = F.concat(F.lit("CVE-2024-1/spray/run_"), F.col("run").cast("string"))
    manifest = F.to_json(F.struct(run.alias("run_id"), F.when(F.col("run") < 4, "valid").otherwise("invalid").alias("status"), F.col("n").alias("spray_start_ns"), F.when(F.col("run") != 3, F.col("n") + F.col("run")).alias("spray_end_ns")))
    path = work_path(spark, "manifests")
    first.filter("run < 6").select("run", manifest.alias("value")).repartition("run").write.partitionBy("run").text(path)
    return TR.interval(marked, U.read_manifests(spark, path, "part-*"))


TRACE_MARKERS = f"""
WITH e AS (SELECT *, user_id % 8 AS run, epoch_us(ts) - {EPOCH_US} AS us FROM events),
f AS (SELECT run, min(event_id) AS n FROM e GROUP BY 1),
m AS (SELECT run, arg_max(us, event_id) FILTER (event_type = 'signup') AS s, arg_max(us, event_id) FILTER (event_type = 'error') AS t FROM e WHERE event_type IN ('signup', 'error') GROUP BY 1),
x AS (SELECT run, n, s, t, run IN (1, 2) AS own FROM f LEFT JOIN m USING (run) WHERE run < 6 OR m.run IS NOT NULL)
SELECT 'CVE-2024-1/spray/run_' || run AS run_id,
  CASE WHEN own THEN n ELSE CAST(trunc(CAST((s // 1000000) || '.' || lpad(CAST(s % 1000000 AS VARCHAR), 6, '0') AS DOUBLE) * 1e9) AS BIGINT) END AS spray_start_ns,
  CASE WHEN own THEN n + run ELSE CAST(trunc(CAST((t // 1000000) || '.' || lpad(CAST(t % 1000000 AS VARCHAR), 6, '0') AS DOUBLE) * 1e9) AS BIGINT) END AS spray_end_ns FROM x
"""


def marker_files(spark, sf_dir):
    """Marker files by run, and attack runs joined with them; run 7 is no attack and has no end."""
    e = _written(spark, sf_dir).groupBy("run").agg(F.min("us").alias("s"), F.max("us").alias("t"))
    run = F.concat(F.lit("spray/run_"), F.col("run").cast("string"))
    text = F.to_json(F.create_map(F.concat(run, F.lit(".log")), F.struct(F.col("s").alias("SPRAY_START"), F.when(F.col("run") < 7, F.col("t") + 1).alias("SPRAY_END"))))
    path = work_path(spark, "markers")
    e.select("run", text.alias("value")).repartition("run").write.partitionBy("run").text(path)
    return TR.attack_intervals(e.select(run.alias("run_id"), (F.col("run") < 7).alias("is_attack")), TR.read_markers(spark, path))


MARKER_FILES = f"""SELECT 'spray/run_' || user_id % 8 AS run_id, user_id % 8 < 7 AS is_attack, min(epoch_us(ts)) - {EPOCH_US} AS spray_start_ns,
  CASE WHEN user_id % 8 < 7 THEN max(epoch_us(ts)) - {EPOCH_US} + 1 END AS spray_end_ns FROM events GROUP BY 1, 2, user_id % 8"""

_FIELDS = ("timestamp_ns", "pid", "tid", "cpu", "comm", "op", "ptr", "bytes_req", "bytes_alloc", "call_site")


def event_files(spark, sf_dir):
    """Events written as CSV, read, written as Parquet and read again."""
    csv, parquet = work_path(spark, "events-csv"), work_path(spark, "events")
    TR.write_events(trace_events(spark, sf_dir), csv, csv=True)
    TR.write_events(TR.read_events_csv(spark, csv), parquet)
    return spark.read.parquet(parquet).select(F.regexp_extract("run_id", "run_id=([^/]+)", 1).alias("run_id"), *_FIELDS)


EVENT_FILES = """SELECT 'run_' || (user_id % 8) AS run_id, epoch_us(ts) * 1000 AS timestamp_ns, user_id % 32 AS pid, user_id % 32 AS tid, CAST(event_id % 4 AS INTEGER) AS cpu, event_type AS comm,
  CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'ALLOC' ELSE 'FREE' END AS op, CAST(user_id AS VARCHAR) AS ptr, CAST(0 AS BIGINT) AS bytes_req,
  CASE WHEN event_type IN ('click', 'view', 'purchase') THEN CAST(floor(value * 20) AS BIGINT) ELSE 0 END AS bytes_alloc, props AS call_site FROM events"""


def trace_validity(spark, sf_dir):
    """Whether runs have events enough and both markers, and no lost events: purchases of runs 0 to 2 report a processor's overrun."""
    e = _written(spark, sf_dir)
    first = e.groupBy("run").agg(F.min("event_id").alias("event_id"), F.count("*").alias("n"))
    marks = lambda name, half: _lines(first, F.when(F.col("run") != 5, F.lit(f"  a-1 [000] .... 1.5: tracing_mark_write+0xb2/0x200 <ffffffff81167302>: {name}")), half)
    found = TR.marker_list(_stored(marks("SPRAY_START", 0), marks("SPRAY_END", 1)))
    lost = TR.overruns(_stored(_lines(e, F.when((F.col("event_type") == "purchase") & (F.col("run") < 3), F.format_string(" overrun: %d", "run")))))
    events = TR.parse_lines(_stored(_lines(e, F.when(F.col("run") != 6, _kernel(e)))))
    runs = TR.with_run_id(_lines(first, F.lit("")), "/raw").select("run_id")
    checked = TR.validate_traces(events, found, runs, minimum=100, require_markers=True)
    return checked.join(lost, "run_id", "left").join(TR.run_validity(checked, lost), "run_id")


TRACE_VALIDITY = """
WITH r AS (SELECT user_id % 8 AS run, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS p FROM events GROUP BY 1),
x AS (SELECT run, CASE WHEN run = 6 THEN 0 ELSE n END AS n, CASE WHEN run < 3 AND p > 0 THEN p * run END AS lost FROM r),
v AS (SELECT *, CASE WHEN n = 0 THEN 'missing_or_empty_trace' WHEN n < 100 THEN 'too_few_events' WHEN run = 5 THEN 'invalid_markers' END AS reason FROM x)
SELECT 'CVE-2024-1/spray/run_' || run AS run_id, n AS event_count, reason, CAST(lost AS BIGINT) AS overrun, reason IS NULL AND coalesce(lost, 0) = 0 AS valid FROM v
"""


def slab_lines(spark, sf_dir):
    e = _written(spark, sf_dir)
    return TR.slab_usage(_stored(_lines(e, F.format_string("kmalloc-%d: %d objects", F.expr("shiftleft(8L, int(pid % 7))"), F.col("event_id")))))


SLAB_LINES = "SELECT 'CVE-2024-1/spray/run_' || user_id % 8 AS run_id, CAST(8 << (user_id % 7) AS BIGINT) AS size, max(event_id) AS usage FROM events GROUP BY user_id % 8, user_id % 7"


def file_digests(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    path = work_path(spark, "digests")
    n.select("event_type", F.concat_ws(":", "event_type", "n").alias("value")).repartition("event_type").write.partitionBy("event_type").text(path)
    found = U.digests(spark, path).filter(F.contains("path", F.lit("/part-")))
    return found.select(F.regexp_extract("path", "event_type=([^/]+)", 1).alias("event_type"), "length", "sha256")


FILE_DIGESTS = "SELECT event_type, CAST(strlen(event_type || ':' || count(*)) + 1 AS BIGINT) AS length, sha256(event_type || ':' || count(*) || chr(10)) AS sha256 FROM events GROUP BY event_type"


def cpu_files(spark, sf_dir):
    """Samples written as arrays whose last item holds the processors' shares, one file for each label, and their mean."""
    v = table(spark, sf_dir, "embeddings").select("label", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("u"))
    record = F.concat(F.lit("[1,"), F.to_json("u"), F.lit("]"))
    text = v.groupBy("label").agg(F.concat(F.lit("["), F.array_join(F.collect_list(record), ","), F.lit("]")).alias("value"))
    path = work_path(spark, "cpu")
    text.write.partitionBy("label").text(path)
    return U.mean_cpu(U.read_cpu(spark, path)).select(F.round("mean_usage", 6).alias("mean_usage"))


CPU_FILES = "SELECT round(sum(list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))))) / (count(*) * 4), 6) AS mean_usage FROM embeddings"


def run_discovery(spark, sf_dir):
    """Trace paths of events; names that do not fit are no runs."""
    e = _written(spark, sf_dir).select("run", "event_type", "event_id")
    kind = F.when(F.col("event_type") == "click", "attack").when(F.col("event_type") == "view", "baseline").when(F.col("event_type") == "error", "other").otherwise("normal")
    path = F.concat_ws("/", F.lit("/raw"), F.when(F.col("run") == 7, "CVE-x").otherwise(F.concat(F.lit("CVE-2024-"), F.col("run").cast("string"))), kind, "event_type", F.concat(F.lit("run_"), F.col("event_id").cast("string")), F.when(F.col("event_id") % 5 == 0, "notes.txt").otherwise("trace.log"))
    return U.discover_runs(e.select(path.alias("path"))).drop("path")


RUN_DISCOVERY = """SELECT 'CVE-2024-' || user_id % 8 || '/' || event_type || '/run_' || event_id AS run_id, 'CVE-2024-' || user_id % 8 AS cve, CASE WHEN event_type = 'click' THEN 'attack' ELSE 'normal' END AS class,
  event_type AS sub, 'run_' || event_id AS run FROM events WHERE user_id % 8 <> 7 AND event_type <> 'error' AND event_id % 5 <> 0"""


def cut_intervals(spark, sf_dir):
    """Each user is a run: its signups and errors are markers; an expected crash that leaves an interval open is cut at the last event."""
    e = table(spark, sf_dir, "events").withColumn("run_id", F.col("user_id").cast("string"))
    marks = e.filter("event_type in ('signup', 'error')").select("run_id", F.when(F.col("event_type") == "signup", "SPRAY_START").otherwise("SPRAY_END").alias("name"), F.col("event_id").alias("ns"), F.lit(0).cast("long").alias("block"), F.col("event_id").alias("line_id"))
    ends = e.groupBy("run_id").agg((F.max("user_id") % 2 == 0).alias("expect_crash"), (F.max("user_id") % 3 != 0).alias("vm_crashed"), F.max("event_id").alias("last_event_ns"))
    return TR.resolve_interval(TR.validated_markers(marks), ends)


CUT_INTERVALS = """
WITH m AS (SELECT user_id, event_id, event_type = 'signup' AS s FROM events WHERE event_type IN ('signup', 'error')),
d AS (SELECT *, sum(CASE WHEN s THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS depth FROM m),
c AS (SELECT user_id, min(depth) >= 0 AND arg_max(depth, event_id) = 0 AS ok, min(event_id) AS a, max(event_id) AS b, arg_max(s, event_id) AS open FROM d GROUP BY 1),
l AS (SELECT user_id, max(event_id) AS last FROM events GROUP BY 1)
SELECT CAST(user_id AS VARCHAR) AS run_id, a AS start_ns, CASE WHEN ok THEN b ELSE last END AS end_ns, NOT ok AS partial FROM c JOIN l USING (user_id) WHERE ok OR (user_id % 2 = 0 AND user_id % 3 <> 0 AND open)
"""

QUERIES = {
    "trace_lines": (trace_lines, TRACE_LINES), "trace_markers": (trace_markers, TRACE_MARKERS), "marker_files": (marker_files, MARKER_FILES), "event_files": (event_files, EVENT_FILES),
    "trace_validity": (trace_validity, TRACE_VALIDITY), "slab_lines": (slab_lines, SLAB_LINES), "file_digests": (file_digests, FILE_DIGESTS), "cpu_files": (cpu_files, CPU_FILES),
    "run_discovery": (run_discovery, RUN_DISCOVERY), "cut_intervals": (cut_intervals, CUT_INTERVALS),
}
