"""Queries over windows: resolution, features by family, labels, sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake import schema as S
from tracelake.operators import features as O
from tracelake.operators import resolve as R
from tracelake.operators import sequences as Q
from tracelake.operators import windows as W
from tracelake.operators.metrics import ghost_runs
from tracelake.plans.base import ENT, G, LABEL, RE, RUNS, WN, f32, spray_runs, trace_events

KEYS = ["run_id", "start_ns"]


def _features(spark: SparkSession, sf_dir: str, features: list[str] | None = None, top_task: bool = True) -> DataFrame:
    return O.window_features(trace_events(spark, sf_dir), G, features, top_task)


def _pick(*counts: str, numbers: tuple[str, ...] = (), plain: tuple[str, ...] = ()):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = _features(spark, sf_dir, [*counts, *numbers], bool(plain))
        return f.select(*KEYS, *plain, *[F.col(c).cast("long").alias(c) for c in counts], *[F.round(F.col(c).cast("double"), 4).alias(c) for c in numbers])

    return run


def resolve_events(spark, sf_dir):
    r = R.resolve(trace_events(spark, sf_dir), G.reclaim_ns)
    return r.select("run_id", "seq", "op", "size_resolved", "resolved_bytes_alloc", "object_lifetime_ns", "reclaim_from_free", "reclaim_cross_site", F.col("bucket").cast("long").alias("bucket"))


def resolution_stats(spark, sf_dir):
    return R.resolution_stats(R.resolve(trace_events(spark, sf_dir), G.reclaim_ns))


def _labelled(spark, sf_dir):
    e = trace_events(spark, sf_dir)
    return Q.label_windows(W.spine(e, G), spray_runs(e), G)


def window_labels(spark, sf_dir):
    return _labelled(spark, sf_dir).select(*KEYS, F.col("label").cast("long").alias("label"))


def window_sequences(spark, sf_dir):
    w = _labelled(spark, sf_dir)
    a = Q.window_sequences(w, policy="any").withColumnRenamed("seq_label", "any_label")
    b = Q.window_sequences(w, policy="endpoint", boundary="keep").withColumnRenamed("seq_label", "endpoint_kept")
    return a.join(b, KEYS).select(*KEYS, F.col("any_label").cast("long").alias("any_label"), F.col("endpoint_kept").cast("long").alias("endpoint_kept"))


def label_histogram(spark, sf_dir):
    return _labelled(spark, sf_dir).groupBy("run_id").agg(*[F.count_if(F.col("label") == v).alias(n) for v, n in ((-1, "boundary"), (0, "normal"), (1, "spray"))])


def run_empty_ratio(spark, sf_dir):
    return O.empty_ratio(_features(spark, sf_dir, ["is_empty"], False)).select("run_id", "n_windows", F.round("empty_ratio", 6).alias("empty_ratio"))


def run_ghosts(spark, sf_dir):
    w = _labelled(spark, sf_dir)
    return ghost_runs(Q.window_sequences(w, policy="any")).select("run_id", F.col("top_label").cast("long").alias("top_label"))


def window_score_slots(spark, sf_dir):
    """Sequences of four windows scored by their starts' day; overlapping windows keep the highest."""
    w = W.spine(trace_events(spark, sf_dir), G).withColumn("label", F.lit(0))
    value = F.pmod(F.expr(f"start_ns div {G.stride_ns}L"), F.lit(97)).cast("double")
    s = Q.window_sequences(w, value, length=4).withColumn("values", F.transform("items", lambda x, i: x + i * 10))
    return Q.dedup_window_scores(s, G.stride_ns)


def sequence_step(spark, sf_dir):
    w = W.spine(trace_events(spark, sf_dir), G).withColumn("label", F.lit(0))
    return Q.median_step(Q.window_sequences(w))


def finite_check(spark, sf_dir):
    return O.non_finite(_features(spark, sf_dir))


_FREE = "op = 'FREE' AND size_resolved"
_COUNTS = ", ".join(
    f"count(*) FILTER (op = 'ALLOC' AND bucket = {i}) AS alloc_count_{b}, count(*) FILTER ({_FREE} AND bucket = {i}) AS free_count_{b}" for i, b in enumerate(S.BUCKET_LABELS)
)
_AGG = WN + f""", ag AS (SELECT run_id, start_ns, {_COUNTS}, count(*) FILTER (op = 'ALLOC') AS total_alloc, count(*) FILTER (op = 'FREE') AS total_free,
  count(*) FILTER (op = 'FREE' AND NOT size_resolved) AS free_unknown, count(*) AS event_count, count(*) FILTER (rec) AS reclaim_count, count(*) FILTER (crs) AS cross_site_reclaim_count,
  quantile_cont(life / 1e6, 0.5) AS m, quantile_cont(life / 1e6, 0.9) AS p, count(*) FILTER (life < {G.short_ns}) AS short_lived_count FROM wn GROUP BY 1, 2)"""
_COUNT_COLS = [f"{k}_count_{b}" for k in ("alloc", "free") for b in S.BUCKET_LABELS]
_KNOWN = " + ".join(f"free_count_{b}" for b in S.BUCKET_LABELS)
_z = lambda c: f"coalesce({c}, 0)"

COUNTS_SQL = f"WITH {_AGG} SELECT run_id, start_ns, {', '.join(f'CAST({_z(c)} AS BIGINT) AS {c}' for c in [*_COUNT_COLS, 'total_alloc', 'total_free', 'free_unknown', 'event_count'])}, CAST({_z('total_alloc - (' + _KNOWN + ')')} AS BIGINT) AS net_alloc_resolved, CAST(CASE WHEN event_count IS NULL THEN 1 ELSE 0 END AS BIGINT) AS is_empty FROM sp LEFT JOIN ag USING (run_id, start_ns)"
_X, _Y = [f"CAST({_z('alloc_count_' + b)} AS DOUBLE)" for b in S.BUCKET_LABELS], [f"CAST({_z('free_count_' + b)} AS DOUBLE)" for b in S.BUCKET_LABELS]
_sum = " + ".join
CORR_SQL = f"""WITH {_AGG}, s AS (SELECT run_id, start_ns, {_sum(_X)} AS sx, {_sum(_Y)} AS sy, {_sum(f'{a}*{b}' for a, b in zip(_X, _Y))} AS sxy, {_sum(f'{a}*{a}' for a in _X)} AS sxx, {_sum(f'{b}*{b}' for b in _Y)} AS syy,
  {', '.join(f"{_z('alloc_count_' + b)} / 600000.0 AS alloc_rate_{b}, {_z('free_count_' + b)} / 600000.0 AS free_rate_{b}" for b in S.BUCKET_LABELS)} FROM sp LEFT JOIN ag USING (run_id, start_ns))
SELECT run_id, start_ns, {f32('CASE WHEN 12*sxx > sx*sx AND 12*syy > sy*sy THEN (12*sxy - sx*sy) / sqrt((12*sxx - sx*sx) * (12*syy - sy*sy)) ELSE 0 END')} AS alloc_free_bucket_corr,
  {', '.join(f"{f32(f'{k}_rate_{b}')} AS {k}_rate_{b}" for k in ('alloc', 'free') for b in S.BUCKET_LABELS)} FROM s"""
ENTROPY_SQL = f"""WITH {WN}, a AS (SELECT run_id, start_ns, {ENT} AS e FROM (SELECT run_id, start_ns, call_site, count(*) AS c FROM wn WHERE op = 'ALLOC' GROUP BY ALL) GROUP BY 1, 2),
f AS (SELECT run_id, start_ns, {ENT} AS e FROM (SELECT run_id, start_ns, call_site, count(*) AS c FROM wn WHERE op = 'FREE' GROUP BY ALL) GROUP BY 1, 2),
t AS (SELECT run_id, start_ns, {ENT} AS e, count(*) AS k FROM (SELECT run_id, start_ns, task_id, count(*) AS c FROM wn WHERE op = 'ALLOC' GROUP BY ALL) GROUP BY 1, 2),
c AS (SELECT run_id, start_ns, {ENT} AS e, max(c) / sum(c) AS top FROM (SELECT run_id, start_ns, cpu, count(*) AS c FROM wn WHERE op = 'ALLOC' GROUP BY ALL) GROUP BY 1, 2)
SELECT sp.run_id, sp.start_ns, {f32('coalesce(a.e, 0)')} AS alloc_callsite_entropy, {f32('coalesce(f.e, 0)')} AS free_callsite_entropy, {f32('coalesce(t.e, 0)')} AS task_alloc_entropy, CAST(coalesce(t.k, 0) AS BIGINT) AS n_active_tasks,
  {f32('coalesce(c.e, 0)')} AS cpu_alloc_entropy, {f32('coalesce(c.top, 0)')} AS top_cpu_alloc_fraction
FROM sp LEFT JOIN a USING (run_id, start_ns) LEFT JOIN f USING (run_id, start_ns) LEFT JOIN t USING (run_id, start_ns) LEFT JOIN c USING (run_id, start_ns)"""
_TOPC = ", ".join(f"count(*) FILTER (op = 'ALLOC' AND bucket = {i}) AS a{i}, count(*) FILTER ({_FREE} AND bucket = {i}) AS f{i}" for i in range(S.N_BUCKETS))
TOP_SQL = f"""WITH {WN}, tk AS (SELECT run_id, start_ns, task_id, count(*) FILTER (op = 'ALLOC') AS n, min(seq) FILTER (op = 'ALLOC') AS fs, {_TOPC} FROM wn GROUP BY 1, 2, 3),
tp AS (SELECT * FROM tk WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY run_id, start_ns ORDER BY n DESC, fs) = 1),
cm AS (SELECT run_id, start_ns, task_id, comm FROM (SELECT run_id, start_ns, task_id, comm, count(*) AS n, min(seq) AS fs FROM wn GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY run_id, start_ns, task_id ORDER BY n DESC, fs) = 1),
bn AS (SELECT run_id, start_ns, task_id, max(c) AS b FROM (SELECT run_id, start_ns, task_id, bin, count(*) AS c FROM wn WHERE op = 'ALLOC' GROUP BY ALL) GROUP BY 1, 2, 3),
tot AS (SELECT run_id, start_ns, count(*) FILTER (op = 'ALLOC') AS ta FROM wn GROUP BY 1, 2)
SELECT sp.run_id, sp.start_ns, coalesce(tp.task_id, -1) AS top_task_id, coalesce(cm.comm, '') AS top_task_comm, {f32('coalesce(tp.n / greatest(ta, 1), 0)')} AS top_task_alloc_fraction,
  {f32("least(coalesce(tp.n, 0) / greatest(coalesce(" + " + ".join(f"f{i}" for i in range(S.N_BUCKETS)) + ", 0), 1), 100)")} AS top_task_alloc_free_ratio, CAST(coalesce(bn.b, 0) AS BIGINT) AS top_task_alloc_burst_1ms,
  {', '.join(f"CAST(coalesce({k[0]}{i}, 0) AS BIGINT) AS top_task_{k}_count_{b}" for k in ('alloc', 'free') for i, b in enumerate(S.BUCKET_LABELS))}
FROM sp LEFT JOIN tp USING (run_id, start_ns) LEFT JOIN cm ON cm.run_id = sp.run_id AND cm.start_ns = sp.start_ns AND cm.task_id = tp.task_id LEFT JOIN bn ON bn.run_id = sp.run_id AND bn.start_ns = sp.start_ns AND bn.task_id = tp.task_id
LEFT JOIN tot ON tot.run_id = sp.run_id AND tot.start_ns = sp.start_ns"""
BURST_SQL = f"""WITH {WN}, b AS (SELECT run_id, start_ns, bin, count(*) AS n, count(*) FILTER (op = 'ALLOC') AS a, count(*) FILTER (op = 'FREE') AS f FROM wn GROUP BY 1, 2, 3),
m AS (SELECT run_id, start_ns, max(a) AS a, max(f) AS f FROM b GROUP BY 1, 2), d AS (SELECT run_id, start_ns, bin FROM b QUALIFY row_number() OVER (PARTITION BY run_id, start_ns ORDER BY n DESC, bin) = 1),
x AS (SELECT wn.* FROM wn JOIN d USING (run_id, start_ns, bin) WHERE op = 'ALLOC'),
k AS (SELECT run_id, start_ns, max(c) / sum(c) AS r FROM (SELECT run_id, start_ns, bucket, count(*) AS c FROM x GROUP BY ALL) GROUP BY 1, 2), s AS (SELECT run_id, start_ns, max(c) / sum(c) AS r FROM (SELECT run_id, start_ns, call_site, count(*) AS c FROM x GROUP BY ALL) GROUP BY 1, 2)
SELECT sp.run_id, sp.start_ns, CAST(coalesce(m.a, 0) AS BIGINT) AS alloc_burst_1ms, CAST(coalesce(m.f, 0) AS BIGINT) AS free_burst_1ms, {f32('coalesce(k.r, 0)')} AS burst_dominant_bucket_ratio, {f32('coalesce(s.r, 0)')} AS burst_dominant_callsite_ratio
FROM sp LEFT JOIN m USING (run_id, start_ns) LEFT JOIN k USING (run_id, start_ns) LEFT JOIN s USING (run_id, start_ns)"""
TIMING_SQL = f"""WITH {_AGG}, p AS (SELECT sp.run_id, sp.start_ns, max(ev.timestamp_ns) AS prev FROM sp ASOF LEFT JOIN ev ON ev.run_id = sp.run_id AND ev.timestamp_ns < sp.start_ns GROUP BY 1, 2)
SELECT run_id, start_ns, {f32(f'CASE WHEN prev IS NULL THEN 600000.0 ELSE least(greatest((start_ns - prev) / 1e6, 0), {G.gap_cap_ns / 1e6}) END')} AS time_since_previous_event_ms, {f32("least(coalesce(total_alloc, 0) / greatest(coalesce(total_free, 0), 1), 100)")} AS alloc_free_ratio
FROM p LEFT JOIN ag USING (run_id, start_ns)"""
LIFE_SQL = f"""WITH {_AGG} SELECT run_id, start_ns, {', '.join(f'CAST({_z(c)} AS BIGINT) AS {c}' for c in ('reclaim_count', 'cross_site_reclaim_count', 'short_lived_count'))}, {f32('coalesce(reclaim_count / greatest(total_alloc, 1), 0)')} AS reclaim_rate,
  CAST(greatest(0, coalesce(total_alloc, 0) - coalesce(total_free, 0)) AS BIGINT) AS long_lived_count, {f32('coalesce(m, 0)')} AS lifetime_median, {f32('coalesce(p, 0)')} AS lifetime_p90 FROM sp LEFT JOIN ag USING (run_id, start_ns)"""
_SEQ = "WINDOW w AS (PARTITION BY run_id ORDER BY start_ns ROWS BETWEEN CURRENT ROW AND 31 FOLLOWING)"
_SEQS = f"sq AS (SELECT run_id, start_ns, count(*) OVER w AS n, min(label) OVER w AS lo, max(label) OVER w AS hi, last_value(label) OVER w AS last FROM lw {_SEQ})"

QUERIES = {
    "resolve_events": (resolve_events, f"WITH {RE} SELECT run_id, seq, op, size_resolved, rb AS resolved_bytes_alloc, life AS object_lifetime_ns, rec AS reclaim_from_free, crs AS reclaim_cross_site, CAST(bucket AS BIGINT) AS bucket FROM rx"),
    "resolution_stats": (resolution_stats, f"WITH {RE} SELECT run_id, count(*) FILTER (op='ALLOC') AS n_alloc, count(*) FILTER (op='FREE') AS n_free, count(*) FILTER (op='FREE' AND size_resolved) AS n_resolved, count(*) FILTER (op='FREE' AND NOT size_resolved) AS n_unresolved, count(*) FILTER (rec) AS n_reclaim, count(*) FILTER (crs) AS n_cross_site, CASE WHEN count(*) FILTER (op='FREE' AND NOT size_resolved) / greatest(count(*) FILTER (op='FREE'), 1) > 0.05 THEN 'high_free_unknown' ELSE 'ok' END AS quality FROM rx GROUP BY 1"),
    "window_counts": (_pick(*_COUNT_COLS, "total_alloc", "total_free", "free_unknown", "event_count", "net_alloc_resolved", "is_empty"), COUNTS_SQL),
    "window_rates": (_pick(numbers=("alloc_free_bucket_corr", *S.GROUPS["alloc_rate"], *S.GROUPS["free_rate"])), CORR_SQL),
    "window_entropies": (_pick("n_active_tasks", numbers=("alloc_callsite_entropy", "free_callsite_entropy", "task_alloc_entropy", "cpu_alloc_entropy", "top_cpu_alloc_fraction")), ENTROPY_SQL),
    "window_top_task": (_pick("top_task_alloc_burst_1ms", *S.GROUPS["top_task_alloc"], *S.GROUPS["top_task_free"], numbers=("top_task_alloc_fraction", "top_task_alloc_free_ratio"), plain=("top_task_id", "top_task_comm")), TOP_SQL),
    "window_bursts": (_pick("alloc_burst_1ms", "free_burst_1ms", numbers=("burst_dominant_bucket_ratio", "burst_dominant_callsite_ratio")), BURST_SQL),
    "window_timing": (_pick(numbers=("time_since_previous_event_ms", "alloc_free_ratio")), TIMING_SQL),
    "window_lifetimes": (_pick("reclaim_count", "cross_site_reclaim_count", "short_lived_count", "long_lived_count", numbers=("reclaim_rate", "lifetime_median", "lifetime_p90")), LIFE_SQL),
    "window_features": (_features, None),
    "window_labels": (window_labels, f"WITH {WN}, {RUNS}, {LABEL} SELECT run_id, start_ns, CAST(label AS BIGINT) AS label FROM lw"),
    "window_sequences": (window_sequences, f"WITH {WN}, {RUNS}, {LABEL}, {_SEQS} SELECT run_id, start_ns, CAST(CASE WHEN lo = -1 THEN -1 WHEN hi = 1 THEN 1 ELSE 0 END AS BIGINT) AS any_label, CAST(last AS BIGINT) AS endpoint_kept FROM sq WHERE n = 32"),
    "label_histogram": (label_histogram, f"WITH {WN}, {RUNS}, {LABEL} SELECT run_id, count(*) FILTER (label = -1) AS boundary, count(*) FILTER (label = 0) AS normal, count(*) FILTER (label = 1) AS spray FROM lw GROUP BY 1"),
    "run_empty_ratio": (run_empty_ratio, f"WITH {WN}, h AS (SELECT DISTINCT run_id, start_ns, 0.0 AS z FROM wn) SELECT run_id, count(*) AS n_windows, round(avg(coalesce(z, 1.0)), 6) AS empty_ratio FROM sp LEFT JOIN h USING (run_id, start_ns) GROUP BY 1"),
    "run_ghosts": (run_ghosts, f"WITH {WN}, {RUNS}, {LABEL}, {_SEQS} SELECT run_id, CAST(max(CASE WHEN lo = -1 THEN -1 WHEN hi = 1 THEN 1 ELSE 0 END) AS BIGINT) AS top_label FROM sq WHERE n = 32 GROUP BY 1 HAVING max(CASE WHEN lo = -1 THEN -1 WHEN hi = 1 THEN 1 ELSE 0 END) < 1"),
    "window_score_slots": (window_score_slots, f"WITH {WN}, q AS (SELECT run_id, start_ns, count(*) OVER (PARTITION BY run_id ORDER BY start_ns ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS n FROM sp), x AS (SELECT run_id, start_ns // {G.stride_ns} AS s, unnest([0,1,2,3]) AS k FROM q WHERE n = 4) SELECT run_id, s + k AS slot, max(CAST((s + k) % 97 + k * 10 AS DOUBLE)) AS score FROM x GROUP BY 1, 2"),
    "sequence_step": (sequence_step, f"WITH {WN}, q AS (SELECT run_id, start_ns, count(*) OVER (PARTITION BY run_id ORDER BY start_ns ROWS BETWEEN CURRENT ROW AND 31 FOLLOWING) AS n FROM sp), d AS (SELECT start_ns - lag(start_ns) OVER (PARTITION BY run_id ORDER BY start_ns) AS g FROM q WHERE n = 32) SELECT quantile_cont(CAST(g AS DOUBLE), 0.5) AS step_ns FROM d"),
    "finite_check": (finite_check, "SELECT CAST(0 AS BIGINT) AS n_bad"),
}
