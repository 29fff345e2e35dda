"""Runs, manifests, registries, experiment reports and file digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.scalars import run_metadata, safe_number

MANIFEST = """run_id string, run_uuid string, class string, cve string, variant string, workload string, workload_label string, msg_size long, status string,
expected_crash boolean, vm_crashed boolean, marker_partial boolean, marker_count long, trace_start_ns long, trace_end_ns long, spray_start_ns long, spray_end_ns long,
event_count long, trace_overrun long, error string"""


def read_manifests(spark: SparkSession, path: str, glob: str = "manifest.json") -> DataFrame:
    """Manifest fields and dir, the folder of each; a manifest that does not parse has null fields."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("wholetext", "true").text(path)
    own = F.from_json("value", MANIFEST.replace("\n", " "))
    return rows.select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("dir"), own.alias("m")).select("dir", "m.*")


def discover_runs(paths: DataFrame) -> DataFrame:
    """run_id, cve, class, sub, run of trace paths ``<cve>/{attack,normal,baseline}/<sub>/<run>/trace.log``; baseline counts as normal."""
    p = F.split("path", "/")
    at = lambda i: F.try_element_at(p, F.lit(-i))
    rows = paths.select("path", at(5).alias("cve"), at(4).alias("kind"), at(3).alias("sub"), at(2).alias("run"), at(1).alias("file"))
    rows = rows.filter((F.col("file") == "trace.log") & F.col("kind").isin("attack", "normal", "baseline") & F.col("cve").rlike(r"^CVE-\d{4}-\d+$"))
    return rows.select("path", F.concat_ws("/", "cve", "sub", "run").alias("run_id"), "cve", F.when(F.col("kind") == "attack", "attack").otherwise("normal").alias("class"), "sub", "run")


def drop_invalid(runs: DataFrame, manifests: DataFrame) -> DataFrame:
    """Runs without those whose manifest has a status other than valid; a run without a manifest stays."""
    return runs.join(manifests.filter(F.col("status").isNotNull() & (F.col("status") != "valid")).select("run_id"), "run_id", "left_anti")


def baseline_class(run_id: Column, cls: Column) -> Column:
    """Runs of the baseline variant are normal."""
    return F.when(F.contains(run_id, F.lit("/poc_cfh_baseline/")), F.lit("normal")).otherwise(cls)


def merge_metadata(runs: DataFrame, overrides: DataFrame) -> DataFrame:
    """Run metadata from the path, fields replaced by those of ``overrides`` (run_id, class, cve, variant, workload) that are not null."""
    names = ("class", "cve", "variant", "workload")
    own = runs.select("run_id", run_metadata(F.col("run_id")).alias("m"))
    other = overrides.select("run_id", *[F.col(c).alias(f"o_{c}") for c in names])
    return own.join(other, "run_id", "left").select("run_id", *[F.coalesce(f"o_{c}", f"m.{c}").alias(c) for c in names])


def registry(manifests: DataFrame) -> DataFrame:
    """One row a run: the id of the manifest or else of its uuid, with status, class and family; of repeated ids the smallest row."""
    rid = F.coalesce("run_id", "run_uuid")
    rows = manifests.withColumn("id", rid).filter("id is not null")
    return rows.groupBy(F.col("id").alias("run_id")).agg(F.min(F.struct("status", "class", "cve", "variant", "workload")).alias("x")).select("run_id", "x.*")


def registry_counts(found: DataFrame) -> DataFrame:
    """Runs by family and class: total, valid, invalid, and the variants seen."""
    ok = F.coalesce(F.col("status") == "valid", F.lit(False))
    return found.groupBy("cve", "class").agg(F.count("*").alias("total"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"), F.sort_array(F.collect_set("variant")).alias("variants"))


def quarantine_plan(runs: DataFrame, workloads: list[str], target: str) -> DataFrame:
    """run_id, workload, destination of the runs of retired workloads."""
    own = run_metadata(F.col("run_id"))["workload"]
    return runs.select("run_id", own.alias("workload")).filter(F.col("workload").isin(workloads)).withColumn("destination", F.concat(F.lit(target.rstrip("/") + "/"), F.col("run_id")))


def outcomes(results: DataFrame) -> DataFrame:
    """Runs by outcome; good_crash is success, unknown_crash panic, hang and timeout timeout, others as they are."""
    o = F.col("outcome")
    kind = F.when(o == "good_crash", "success").when(o == "unknown_crash", "panic").when(o.isin("timeout", "hang"), "timeout").otherwise(o)
    return results.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))


def mean_cpu(spark_json: DataFrame, threads: int = 4) -> DataFrame:
    """Mean usage over samples (usage: array of processor shares) and threads."""
    return spark_json.select(F.aggregate("usage", F.lit(0.0), lambda a, x: a + x).alias("u")).agg((F.sum("u") / (F.count("*") * threads)).alias("mean_usage"))


def read_cpu(spark: SparkSession, path: str) -> DataFrame:
    """usage of every sample of the JSON files below ``path``: a file is an array of records, a record's last item the shares of its processors."""
    files = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").text(path)
    records = files.select(F.explode(F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>")).alias("r"))
    last = F.try_element_at(F.try_variant_get("r", "$", "array<variant>"), F.lit(-1))
    return records.select(F.try_variant_get(last, "$", "array<double>").alias("usage")).filter("usage is not null")


def slab_rates(idle: DataFrame, busy: DataFrame, seconds: int = 3600, cpus: int = 4) -> DataFrame:
    """Allocations a second and processor by size, idle beside busy, and their logarithms."""
    rate = lambda c: F.col(c) / seconds / cpus
    both = idle.select("size", F.col("usage").alias("u0")).join(busy.select("size", F.col("usage").alias("u1")), "size")
    return both.select("size", rate("u0").alias("idle"), rate("u1").alias("busy"), F.when(rate("u0") > 0, F.ln(rate("u0"))).alias("idle_log"), F.when(rate("u1") > 0, F.ln(rate("u1"))).alias("busy_log"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


# The names of the report files and, by column of the comparison, the report's groups and fields.
CONFIG_FILE, REPORT_FILE = "experiment_config.json", "evaluation_report.json"
REPORT_METRICS = {"run_auc": "roc_auc", "run_precision": "precision_at_threshold", "run_recall": "recall_at_threshold", "run_f1": "f1_at_threshold", "run_fpr": "fpr_at_threshold"}
REPORT_COUNTS = ("test_normal_runs", "attack_runs_total", "attack_runs_no_spray_sequence")


def reports_of(files: DataFrame, models: list[str] | None = None) -> DataFrame:
    """dir, model, seed, held_out_cve, the metrics and counts of folders whose configuration and report both parse.

    ``files``: dir, file, value. A missing model is ``?``, a missing family ``-``.
    """
    def parsed(file: str, shape: str) -> DataFrame:
        value = F.from_json("value", shape + ", _broken string", {"columnNameOfCorruptRecord": "_broken"})
        return files.filter(F.col("file") == file).select("dir", value.alias("v")).filter("v is not null and v._broken is null")

    config = parsed(CONFIG_FILE, "model string, held_out_cve string, seed string").select(
        "dir", F.coalesce("v.model", F.lit("?")).alias("model"), F.coalesce("v.seed", F.lit("")).alias("seed"),
        F.coalesce(F.when(F.col("v.held_out_cve") != "", F.col("v.held_out_cve")), F.lit("-")).alias("held_out_cve"),
    )
    shape = f"run_level struct<{', '.join(f'{v}: double' for v in REPORT_METRICS.values())}>, counts struct<{', '.join(f'{c}: string' for c in REPORT_COUNTS)}>"
    report = parsed(REPORT_FILE, shape).select("dir", *[F.col(f"v.run_level.{v}").alias(c) for c, v in REPORT_METRICS.items()], *[F.col(f"v.counts.{c}") for c in REPORT_COUNTS])
    out = config.join(report, "dir")
    return out.filter(F.col("model").isin(models)) if models else out


def read_reports(spark: SparkSession, path: str, models: list[str] | None = None) -> DataFrame:
    """``reports_of`` the folders in ``path``."""
    files = spark.read.option("pathGlobFilter", "*.json").option("wholetext", "true").text(f"{path.rstrip('/')}/*")
    return reports_of(files.select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("dir"), F.col("_metadata.file_name").alias("file"), "value"), models)


def comparison(reports: DataFrame) -> DataFrame:
    """The comparison table as text: four decimals, empty where missing, by model and family."""
    return reports.select(
        "model", "seed", "held_out_cve", *[safe_number(F.col(c)).alias(c) for c in REPORT_METRICS], *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in REPORT_COUNTS]
    ).orderBy("model", "held_out_cve")


def experiment_tags(names: DataFrame, tags: list[str], models: list[str]) -> DataFrame:
    """tag, model, seed of folder names ``<date>_<tag>_v2_<model>_s<seed>_<time>`` among ``tags`` and ``models``."""
    pattern = r"^(\d+)_(.+)_v2_(.+)_s(\d+)_(\d{6})$"
    rows = names.select("name", *[F.regexp_extract("name", pattern, i).alias(c) for i, c in ((2, "tag"), (3, "model"), (4, "seed"))])
    return rows.filter(F.col("tag").isin(tags) & F.col("model").isin(models)).withColumn("seed", F.col("seed").cast("long"))


def auc_pivot(rows: DataFrame, models: list[str]) -> DataFrame:
    """Scenario by model; rows: tag, model, roc_auc."""
    return rows.groupBy("tag").pivot("model", models).agg(F.first("roc_auc"))


def markdown(table: DataFrame, limit: int = 1000) -> str:
    """A small report table as Markdown. A report has tens of rows; one of more than ``limit`` is an error, not cut."""
    rows = table.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report of more than {limit} rows is no small table")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(table.columns), line(["---"] * len(table.columns)), *(line(r) for r in rows)])


def write_table(df: DataFrame, path: str, force: bool = False, kind: str = "parquet") -> None:
    """Writes ``df``; an output that exists is an error unless ``force``. The commit protocol makes it whole or absent."""
    out = df.coalesce(1).write.option("header", "true") if kind == "csv" else df.write
    out.mode("overwrite" if force else "errorifexists").format(kind).save(path)
