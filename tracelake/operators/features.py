"""The features of a window.

Events are placed in windows and partitioned by (run, window) once; every grouping below is finer than that
partitioning, so groupings and joins share it. All is aggregation with partial sums: no window's events are
collected. Ties for the top task, command and sub-window go to what came first.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake import schema as S
from tracelake.functions.scalars import capped_ratio, normalised_entropy, sanitise
from tracelake.operators.resolve import resolve
from tracelake.operators.windows import assign, since_previous, spine

WINDOW = ["run_id", "start_ns"]


def _n(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def _c_log_c(c: str) -> Column:
    return F.sum(F.col(c) * F.log2(F.col(c) + F.lit(0.0)))


def _first(condition: Column | None = None) -> Column:
    place = F.struct("timestamp_ns", "seq")
    return F.min(place if condition is None else F.when(condition, place))


def _rank(count: str, first: str) -> Column:
    """Orders by count, then by who came first."""
    return F.struct(F.col(count), -F.col(f"{first}.timestamp_ns"), -F.col(f"{first}.seq"))


def _correlation(x: list[Column], y: list[Column]) -> Column:
    n = len(x)
    add = lambda cs: reduce(lambda a, b: a + b, cs)
    sx, sy = add(x), add(y)
    cov = add([a * b for a, b in zip(x, y)]) * n - sx * sy
    vx, vy = add([a * a for a in x]) * n - sx * sx, add([b * b for b in y]) * n - sy * sy
    return F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * F.lit(1.0) * vy)).otherwise(F.lit(0.0))


def placed_events(events: DataFrame, g: S.Geometry = S.Geometry()) -> DataFrame:
    """Resolved events in their windows, partitioned by (run, window) and kept."""
    placed = assign(resolve(events, g.reclaim_ns), g)
    place = F.least(F.expr(f"(timestamp_ns - start_ns) div {g.bin_ns}L"), F.lit(g.bins - 1)).cast("int")
    return placed.withColumn("bin", place).repartition(*WINDOW).persist(StorageLevel.MEMORY_AND_DISK)


def window_features(events: DataFrame, g: S.Geometry = S.Geometry(), features: list[str] | None = None, top_task: bool = True) -> DataFrame:
    """run_id, start_ns and ``features`` (all of ``schema.FEATURES`` if not given) as floats, for every window; with ``top_task``
    also top_task_id and top_task_comm. Groupings that no wanted column needs are not made."""
    want = list(features) if features is not None else S.FEATURES
    needs = lambda *names: any(n in want for n in names)
    e = placed_events(events, g)
    alloc, free = F.col("op") == "ALLOC", F.col("op") == "FREE"
    known = free & F.col("size_resolved")
    per = lambda name, test: [_n(test & (F.col("bucket") == i)).alias(f"{name}_{label}") for i, label in enumerate(S.BUCKET_LABELS)]
    life = F.col("object_lifetime_ns") / 1e6

    base = e.groupBy(*WINDOW).agg(
        *per("alloc_count", alloc), *per("free_count", known), _n(alloc).alias("total_alloc"), _n(free).alias("total_free"), _n(free & ~F.col("size_resolved")).alias("free_unknown"),
        F.count("*").alias("event_count"), _n(alloc & F.col("reclaim_from_free")).alias("reclaim_count"), _n(alloc & F.col("reclaim_cross_site")).alias("cross_site_reclaim_count"),
        F.percentile(life, F.array(F.lit(0.5), F.lit(0.9))).alias("_life"), _n(F.col("object_lifetime_ns") < g.short_ns).alias("short_lived_count"),
    )
    tasks = e.groupBy(*WINDOW, "task_id").agg(_n(alloc).alias("_n"), _first(alloc).alias("_first"), *per("top_task_alloc_count", alloc), *per("top_task_free_count", known)).filter("_n > 0")
    vector = [F.col(c) for c in (*S.GROUPS["top_task_alloc"], *S.GROUPS["top_task_free"])]
    top = tasks.groupBy(*WINDOW).agg(
        F.count("*").alias("n_active_tasks"), normalised_entropy(F.sum("_n"), F.count("*"), _c_log_c("_n")).alias("task_alloc_entropy"),
        F.max_by(F.struct("task_id", "_n", *vector), _rank("_n", "_first")).alias("_top"),
    ).select(*WINDOW, "n_active_tasks", "task_alloc_entropy", F.col("_top.task_id").alias("top_task_id"), F.col("_top._n").alias("_top_n"), *[F.col(f"_top.{c}") for c in (*S.GROUPS["top_task_alloc"], *S.GROUPS["top_task_free"])])
    comms = e.groupBy(*WINDOW, "task_id", "comm").agg(F.count("*").alias("_n"), _first().alias("_first")).groupBy(*WINDOW, F.col("task_id").alias("top_task_id")).agg(F.max_by("comm", _rank("_n", "_first")).alias("top_task_comm"))
    sites = e.filter(alloc | free).groupBy(*WINDOW, "call_site").agg(_n(alloc).alias("_a"), _n(free).alias("_f"))
    kinds = lambda c: F.count_if(F.col(c) > 0)
    logs = lambda c: F.sum(F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) + F.lit(0.0))).otherwise(F.lit(0.0)))
    sites = sites.groupBy(*WINDOW).agg(normalised_entropy(F.sum("_a"), kinds("_a"), logs("_a")).alias("alloc_callsite_entropy"), normalised_entropy(F.sum("_f"), kinds("_f"), logs("_f")).alias("free_callsite_entropy"))
    cpus = e.filter(alloc).groupBy(*WINDOW, "cpu").agg(F.count("*").alias("_n")).groupBy(*WINDOW).agg(
        normalised_entropy(F.sum("_n"), F.count("*"), _c_log_c("_n")).alias("cpu_alloc_entropy"), (F.max("_n") / F.sum("_n")).alias("top_cpu_alloc_fraction")
    )
    bins = e.groupBy(*WINDOW, "bin").agg(F.count("*").alias("_n"), _n(alloc).alias("_a"), _n(free).alias("_f")).groupBy(*WINDOW).agg(
        F.max("_a").alias("alloc_burst_1ms"), F.max("_f").alias("free_burst_1ms"), F.max_by("bin", F.struct(F.col("_n"), -F.col("bin"))).alias("_dense")
    )
    task_bins = e.filter(alloc).groupBy(*WINDOW, "task_id", "bin").agg(F.count("*").alias("_n")).groupBy(*WINDOW, F.col("task_id").alias("top_task_id")).agg(F.max("_n").alias("top_task_alloc_burst_1ms"))
    dense = e.filter(alloc).join(bins.select(*WINDOW, F.col("_dense").alias("bin")), [*WINDOW, "bin"])
    share = lambda key, name: dense.groupBy(*WINDOW, key).agg(F.count("*").alias("_n")).groupBy(*WINDOW).agg((F.max("_n") / F.sum("_n")).alias(name))

    out = spine(events, g)
    ranked = top_task or needs("n_active_tasks", "task_alloc_entropy", *(f for f in S.FEATURES if f.startswith("top_task_")))
    parts = [
        (True, lambda: base), (ranked, lambda: top), (needs("alloc_callsite_entropy", "free_callsite_entropy"), lambda: sites), (needs(*S.GROUPS["cpu"]), lambda: cpus),
        (needs("alloc_burst_1ms", "free_burst_1ms"), lambda: bins), (needs("burst_dominant_bucket_ratio"), lambda: share("bucket", "burst_dominant_bucket_ratio")),
        (needs("burst_dominant_callsite_ratio"), lambda: share("call_site", "burst_dominant_callsite_ratio")), (needs("time_since_previous_event_ms"), lambda: since_previous(events, out, g)),
    ]
    windows = out
    for wanted, part in parts:
        if wanted:
            windows = windows.join(part(), WINDOW, "left")
    out = windows
    if top_task:
        out = out.join(comms, [*WINDOW, "top_task_id"], "left")
    if needs("top_task_alloc_burst_1ms"):
        out = out.join(task_bins, [*WINDOW, "top_task_id"], "left")
    out = out.fillna(0, [c for c in out.columns if c not in (*WINDOW, "top_task_id", "top_task_comm", "_life")])

    ms = g.window_ns / 1e6
    col = {c: F.col(c) for c in out.columns}
    for kind in ("alloc", "free"):
        col |= {f"{kind}_rate_{label}": F.col(f"{kind}_count_{label}") / ms for label in S.BUCKET_LABELS}
    counts = lambda p: [F.col(f"{p}_count_{label}") for label in S.BUCKET_LABELS]
    resolved = reduce(lambda a, b: a + b, counts("free"))
    col |= {
        "alloc_free_bucket_corr": _correlation(counts("alloc"), counts("free")),
        "net_alloc_resolved": F.col("total_alloc") - resolved,
        "alloc_free_ratio": capped_ratio(F.col("total_alloc"), F.col("total_free")),
        "is_empty": (F.col("event_count") == 0).cast("int"),
        "reclaim_rate": F.col("reclaim_count") / F.greatest(F.col("total_alloc"), F.lit(1)),
        "lifetime_median": F.coalesce(F.get("_life", F.lit(0)), F.lit(0.0)),
        "lifetime_p90": F.coalesce(F.get("_life", F.lit(1)), F.lit(0.0)),
        "long_lived_count": F.greatest(F.lit(0), F.col("total_alloc") - F.col("total_free")),
    }
    if ranked:
        top_free = reduce(lambda a, b: a + b, counts("top_task_free"))
        col |= {"top_task_alloc_fraction": F.col("_top_n") / F.greatest(F.col("total_alloc"), F.lit(1)), "top_task_alloc_free_ratio": capped_ratio(F.col("_top_n"), top_free)}
    named = [F.coalesce("top_task_id", F.lit(-1)).alias("top_task_id"), F.coalesce("top_task_comm", F.lit("")).alias("top_task_comm")] if top_task else []
    return out.select(*WINDOW, *named, *[sanitise(col[f]).alias(f) for f in want])


def empty_ratio(features: DataFrame) -> DataFrame:
    return features.groupBy("run_id").agg(F.count("*").alias("n_windows"), F.avg("is_empty").alias("empty_ratio"))


def non_finite(features: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Number of values that are null, not numbers or infinite; 0 for a sound table."""
    bad = [F.coalesce(F.isnan(c) | (F.abs(F.col(c)) == F.lit(float("inf"))), F.lit(True)).cast("int") for c in columns or S.FEATURES]
    return features.agg(F.coalesce(F.sum(reduce(lambda a, b: a + b, bad)), F.lit(0)).alias("n_bad"))
