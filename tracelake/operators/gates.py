"""Data-quality gates: each returns rows (name, ok, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake import schema as S
from tracelake.operators.sequences import contiguous


def _gate(df: DataFrame, name: str, ok: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(name).alias("name"), ok.alias("ok"), detail.cast("string").alias("detail"))


def no_cross_run(windows: DataFrame, g: S.Geometry = S.Geometry()) -> DataFrame:
    """Windows of a run are one stride apart, so a sequence spans one run without gaps."""
    bad = contiguous(windows, g).agg(F.count("*").alias("n"))
    return _gate(bad, "no_cross_run", F.col("n") == 0, F.concat(F.col("n").cast("string"), F.lit(" runs with gaps")))


def marker_success(runs: DataFrame, least: float = 0.95) -> DataFrame:
    """Share of attack runs with complete markers (marker_status); no runs: not applicable, ok."""
    r = runs.agg(F.avg((F.col("marker_status") == "complete").cast("double")).alias("r"))
    return _gate(r, "marker_success", F.coalesce(F.col("r") >= least, F.lit(True)), F.coalesce(F.format_string("%.4f", "r"), F.lit("n/a")))


def empty_windows(windows: DataFrame) -> DataFrame:
    """Both classes have empty windows; ``windows``: class, is_empty."""
    r = windows.groupBy("class").agg(F.avg(F.col("is_empty").cast("double")).alias("r")).agg(F.min("r").alias("r"), F.count("*").alias("n"))
    return _gate(r, "empty_windows", F.coalesce((F.col("r") > 0) & (F.col("n") == 2), F.lit(False)), F.coalesce(F.format_string("%.4f", "r"), F.lit("none")))


def sequence_length(sequences: DataFrame, length: int = S.SEQ_WINDOWS) -> DataFrame:
    r = sequences.agg(F.min(F.size("items")).alias("a"), F.max(F.size("items")).alias("b"))
    return _gate(r, "sequence_length", F.coalesce((F.col("a") == length) & (F.col("b") == length), F.lit(False)), F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))


def top_task(windows: DataFrame, prefixes: tuple[str, ...] = ("poc_", "workload")) -> DataFrame:
    """Some window's top command begins with one of ``prefixes``."""
    test = F.lit(False)
    for p in prefixes:
        test = test | F.startswith("top_task_comm", F.lit(p))
    r = windows.agg(F.coalesce(F.bool_or(test), F.lit(False)).alias("r"), F.count_if(test).alias("n"))
    return _gate(r, "top_task", F.col("r"), F.col("n"))


def target_bucket(windows: DataFrame, targets: DataFrame, least: float = 0.8, exempt: tuple[str, ...] = ()) -> DataFrame:
    """Of each (cve, variant), the share of runs whose windows of label 1 allocate in the family's target bucket; all non-exempt reach
    ``least``. ``windows``: run_id, cve, variant, label and alloc_count_*; ``targets``: cve, bucket (label)."""
    counts = F.map_from_arrays(F.array(*[F.lit(b) for b in S.BUCKET_LABELS]), F.array(*[F.col(f"alloc_count_{b}").cast("double") for b in S.BUCKET_LABELS]))
    hit = F.coalesce(F.element_at(counts, F.col("bucket")), F.lit(0.0)) > 0
    runs = windows.filter("label = 1").join(targets, "cve").groupBy("cve", "variant", "run_id").agg(F.bool_or(hit).alias("hit"))
    shares = runs.groupBy("cve", "variant").agg(F.avg(F.col("hit").cast("double")).alias("share"))
    r = shares.filter(~F.col("variant").isin(*exempt) if exempt else F.lit(True)).agg(F.min("share").alias("r"), F.count("*").alias("n"))
    return _gate(r, "target_bucket", F.coalesce(F.col("r") >= least, F.lit(False)), F.coalesce(F.format_string("%.4f", "r"), F.lit("no runs")))


def no_shortcut(runs: DataFrame) -> DataFrame:
    """Window counts and empty ratios of both classes overlap; ``runs``: class, n_windows, empty_ratio."""
    by = runs.groupBy().agg(*[f(F.when(F.col("class") == c, F.col(v))).alias(f"{n}_{v}_{c}") for c in ("attack", "normal") for v in ("n_windows", "empty_ratio") for f, n in ((F.min, "lo"), (F.max, "hi"))])
    over = lambda v: (F.col(f"lo_{v}_attack") < F.col(f"hi_{v}_normal")) & (F.col(f"lo_{v}_normal") < F.col(f"hi_{v}_attack"))
    return _gate(by, "no_shortcut", F.coalesce(over("n_windows") & over("empty_ratio"), F.lit(False)), F.to_json(F.struct(*by.columns)))


def disjoint(roles: DataFrame) -> DataFrame:
    """No run has two roles; ``roles``: run_id, role."""
    r = roles.groupBy("run_id").agg(F.count_distinct("role").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n"))
    return _gate(r, "disjoint_split", F.col("n") == 0, F.concat(F.col("n").cast("string"), F.lit(" shared runs")))


def finite(counts: DataFrame) -> DataFrame:
    return _gate(counts, "finite", F.col("n_bad") == 0, F.col("n_bad"))


def end_to_end(metrics: DataFrame) -> DataFrame:
    """A ranking metric came out."""
    return _gate(metrics.agg(F.max("roc_auc").alias("a")), "end_to_end", F.col("a").isNotNull(), F.format_string("%.4f", "a"))


def control_report(report: DataFrame, name: str) -> DataFrame:
    """Detection among a control family; informational, always ok."""
    r = report.agg(F.sum("runs_total").alias("n"), F.sum("n_flagged").alias("k"))
    return _gate(r, name, F.lit(True), F.concat_ws("/", F.col("k").cast("string"), F.col("n").cast("string")))


def gate_report(gates: list[DataFrame]) -> DataFrame:
    """name, status (pass, FAIL, not_checked), detail of all gates."""
    out = gates[0]
    for g in gates[1:]:
        out = out.unionByName(g)
    return out.select("name", F.when(F.col("ok").isNull(), "not_checked").when(F.col("ok"), "pass").otherwise("FAIL").alias("status"), "detail")


def status_counts(spark: SparkSession, gates: DataFrame) -> DataFrame:
    return gates.groupBy("status").agg(F.count("*").alias("n"))
