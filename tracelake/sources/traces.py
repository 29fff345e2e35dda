"""Trace logs as events: two text grammars, markers, intervals, statistics, the CSV form.

Lines are ordered by file, block start and a number that rises inside a block; that order is ``seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake import schema as S

# Names of the kernel's events and of the fields of their lines, and of the markers.
ALLOC_FIELDS = ("call_site", "ptr", "bytes_req", "bytes_alloc", "gfp_flags")
FREE_FIELDS = ("call_site", "ptr")
MARKERS = ("SPRAY_START", "SPRAY_END")


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def read_lines(spark: SparkSession, path: str, glob: str = "*.log") -> DataFrame:
    """path, block, line_id, line of every line of the files below ``path``, except below a ``quarantine`` folder."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    out = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_id"), F.col("value").alias("line"))
    return out.filter(~F.array_contains(F.split("path", "/"), "quarantine"))


def with_run_id(lines: DataFrame, root: str) -> DataFrame:
    """``lines`` with run_id: the path below ``root`` without file name or suffix and class folder."""
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    below = F.substring_index("path", F.lit(base + "/"), -1) if isinstance(base, Column) else F.expr(f"substring_index(path, '{base}/', -1)")
    run = F.regexp_replace(F.regexp_replace(below, r"(/trace)?\.log$|/[^/]+\.log$", ""), r"(^|/)(attack|normal|baseline)/", "$1")
    return lines.withColumn("run_id", run)


def _ns(seconds: Column) -> Column:
    """Nanoseconds of a text of seconds; in doubles and cut, as the format's writers do."""
    return (seconds.cast("double") * F.lit(1e9)).cast("long")


def _only(c: Column, signs: str) -> Column:
    """Whether the text is not empty and made of ``signs`` alone."""
    return (c != "") & (F.translate(c, signs, "") == "")


def _digits(c: Column) -> Column:
    return _only(c, "0123456789")


def _address(c: Column) -> Column:
    return _only(c, "0123456789abcdefx")


def _head(text: Column) -> Column:
    """task, pid, cpu and stamp of a line's head ``task-pid [cpu] flags stamp``; null if it is none."""
    words, rest = F.split(F.rtrim(text), r"\s+"), F.substring_index(text, " [", -1)
    task = F.rtrim(F.left(text, F.length(text) - F.length(rest) - 2))
    pid = F.substring_index(task, "-", -1)
    out = F.struct(
        F.left(task, F.length(task) - F.length(pid) - 1).alias("task"), pid.alias("pid"), F.substring_index(rest, "]", 1).alias("cpu"), F.get(words, F.size(words) - 1).alias("stamp"),
    )
    parts = F.split(out["stamp"], r"\.")
    good = F.contains(text, F.lit(" [")) & (out["task"] != "") & _digits(out["pid"]) & _digits(out["cpu"]) & (F.size(parts) == 2) & _digits(F.get(parts, F.lit(0))) & _digits(F.get(parts, F.lit(1)))
    return F.when(good, out)


def _split_at(line: Column, event: str) -> tuple[Column, Column]:
    """What stands before ``: event`` in a line, and the words after it; null where the line has no such event."""
    there = F.contains(line, F.lit(f": {event}"))
    return F.when(there, F.substring_index(line, f": {event}", 1)), F.split(F.when(there, F.substring(line, F.locate(f": {event}", line) + len(event) + 2, F.length(line))), r"\s+")


def _fields(words: Column, names: tuple[str, ...]) -> Column:
    """The values of ``name=value`` words as a struct."""
    value = lambda n: F.substring(F.get(F.filter(words, lambda w: w.startswith(f"{n}=")), F.lit(0)), F.lit(len(n) + 2), F.length(F.array_join(words, " ")))
    return F.struct(*[value(n).alias(n) for n in names])


def _kernel_event(line: Column, event: str, names: tuple[str, ...]) -> Column:
    """Head and fields of a kernel line of ``event``, or null."""
    before, words = _split_at(line, f"{event}: ")
    head, own = _head(before), _fields(words, names)
    good = head.isNotNull() & _address(own["call_site"]) & _address(own["ptr"])
    if "bytes_req" in names:
        good = good & _digits(own["bytes_req"]) & _digits(own["bytes_alloc"]) & (own["gfp_flags"] != "")
    return F.when(good, F.struct(head.alias("head"), own.alias("own")))


def _probe_event(line: Column) -> Column:
    """The fields of a comma-separated probe line, or null; commas inside the task's name stay."""
    parts = F.split(line, ",")
    at = lambda k: F.get(parts, k)
    fits = lambda k: at(k).isin("ALLOC", "FREE") & _address(at(k + 1)) & _digits(at(k + 2)) & _digits(at(k + 3)) & _address(at(k + 4))
    op = F.when(F.size(parts) >= 9, F.get(F.filter(F.sequence(F.lit(4), F.greatest(F.size(parts) - 5, F.lit(4))), fits), F.lit(0)))
    good = _digits(at(F.lit(0))) & _digits(at(F.lit(1))) & _digits(at(F.lit(2))) & op.isNotNull()
    return F.when(good, F.struct(
        at(F.lit(0)).alias("stamp"), at(F.lit(1)).alias("pid"), at(F.lit(2)).alias("tid"), F.array_join(F.slice(parts, F.lit(4), op - 3), ",").alias("task"), at(op).alias("op"),
        at(op + 1).alias("ptr"), at(op + 2).alias("bytes_req"), at(op + 3).alias("bytes_alloc"), at(op + 4).alias("call_site"),
    ))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Events of ``lines`` (run_id, block, line_id, line). A run's first line that fits a grammar fixes the grammar of the run."""
    line = F.col("line")
    raw = lines.withColumn("line", stripped(line)).filter((line != "") & ~F.startswith("line", F.lit("#")))
    read = raw.select("run_id", "block", "line_id", _probe_event(line).alias("p"), _kernel_event(line, "kmalloc", ALLOC_FIELDS).alias("a"), _kernel_event(line, "kfree", FREE_FIELDS).alias("f"))
    read = read.filter(F.coalesce(F.col("p").isNotNull() | F.col("a").isNotNull() | F.col("f").isNotNull(), F.lit(False)))
    probe = F.col("p").isNotNull()
    formats = read.groupBy("run_id").agg(F.min_by(probe, F.struct("block", "line_id")).alias("probes"))
    rows = read.join(formats, "run_id").filter(probe == F.col("probes"))
    either = lambda of_probe, of_kernel: F.when(F.col("probes"), of_probe).otherwise(of_kernel)
    kernel = lambda c: F.coalesce(f"a.head.{c}", f"f.head.{c}")
    zero = F.lit("0")
    events = rows.select(
        "run_id", "block", "line_id", either(F.col("p.stamp").try_cast("long"), _ns(kernel("stamp"))).alias("timestamp_ns"),
        either(F.col("p.pid"), kernel("pid")).cast("long").alias("pid"), either(F.col("p.tid"), kernel("pid")).cast("long").alias("tid"),
        either(F.lit(0), kernel("cpu").try_cast("int")).alias("cpu"), stripped(either(F.col("p.task"), kernel("task"))).alias("comm"),
        either(F.col("p.op"), F.when(F.col("a").isNotNull(), "ALLOC").otherwise("FREE")).alias("op"), either(F.col("p.ptr"), F.coalesce("a.own.ptr", "f.own.ptr")).alias("ptr"),
        either(F.col("p.bytes_req"), F.coalesce(F.col("a.own.bytes_req"), zero)).cast("long").alias("bytes_req"), either(F.col("p.bytes_alloc"), F.coalesce(F.col("a.own.bytes_alloc"), zero)).cast("long").alias("bytes_alloc"),
        either(F.col("p.call_site"), F.coalesce("a.own.call_site", "f.own.call_site")).alias("call_site"),
    )
    return with_seq(events)


def with_seq(events: DataFrame) -> DataFrame:
    """Events with seq, the place of the line in its run."""
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("block", "line_id")) - 1
    return events.withColumn("seq", place.cast("long")).select(*S.EVENT.fieldNames())


def markers(lines: DataFrame) -> DataFrame:
    """run_id, spray_start_ns, spray_end_ns: the last marker of each name in a run."""
    order = F.struct("block", "line_id")
    last = lambda m: F.max_by(F.when(F.col("name") == m, F.col("ns")), F.when(F.col("name") == m, order))
    return marker_list(lines).groupBy("run_id").agg(last("SPRAY_START").alias("spray_start_ns"), last("SPRAY_END").alias("spray_end_ns"))


def marker_list(lines: DataFrame) -> DataFrame:
    """run_id, name, ns, block, line_id of every marker: a word that begins with its name, after the writer's function, in a line of the trace."""
    before, words = _split_at(F.col("line"), "tracing_mark_write")
    said = F.get(words, F.lit(2))
    name = F.when(F.get(words, F.lit(1)).endswith(":"), F.when(F.startswith(said, F.lit(MARKERS[0])), MARKERS[0]).when(F.startswith(said, F.lit(MARKERS[1])), MARKERS[1]))
    found = lines.select("run_id", name.alias("name"), _head(before).alias("head"), "block", "line_id").filter("name is not null and head is not null")
    return found.select("run_id", "name", _ns(F.col("head.stamp")).alias("ns"), "block", "line_id")


def validated_markers(found: DataFrame) -> DataFrame:
    """run_id, ok, start_ns, end_ns, last_name: markers begin with a start, end with an end, never nest below zero and each end is later
    than its start; the interval runs from the first marker to the last."""
    by = Window.partitionBy("run_id").orderBy("block", "line_id")
    depth = F.sum(F.when(F.col("name") == "SPRAY_START", 1).otherwise(-1)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    opened = F.last(F.when(F.col("name") == "SPRAY_START", F.col("ns")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    rows = found.withColumns({"depth": depth, "opened": opened})
    order = F.struct("block", "line_id")
    ok = (F.min("depth") >= 0) & (F.max_by("depth", order) == 0) & (F.min_by("name", order) == "SPRAY_START") & (F.max_by("name", order) == "SPRAY_END")
    ok = ok & (F.count_if((F.col("name") == "SPRAY_END") & ~F.coalesce(F.col("ns") > F.col("opened"), F.lit(False))) == 0)
    return rows.groupBy("run_id").agg(ok.alias("ok"), F.min_by("ns", order).alias("start_ns"), F.max_by("ns", order).alias("end_ns"), F.max_by("name", order).alias("last_name"))


def resolve_interval(checked: DataFrame, outcomes: DataFrame) -> DataFrame:
    """run_id, start_ns, end_ns, partial: a valid interval as it is; in an expected crash that left an open interval, to the last event.

    ``outcomes``: run_id, expect_crash, vm_crashed, last_event_ns.
    """
    rows = checked.join(outcomes, "run_id")
    cut = ~F.col("ok") & F.col("expect_crash") & F.col("vm_crashed") & (F.col("last_name") == "SPRAY_START")
    return rows.filter(F.col("ok") | cut).select("run_id", "start_ns", F.when(F.col("ok"), F.col("end_ns")).otherwise(F.col("last_event_ns")).alias("end_ns"), cut.alias("partial"))


def interval(marked: DataFrame, manifests: DataFrame) -> DataFrame:
    """run_id, spray_start_ns, spray_end_ns: the manifest's whole interval where it is valid and not empty, else the trace's markers."""
    good = (F.col("status") == "valid") & (F.col("spray_end_ns") > F.col("spray_start_ns"))
    own = manifests.select("run_id", F.when(good, F.struct("spray_start_ns", "spray_end_ns")).alias("m"))
    both = marked.select("run_id", F.struct("spray_start_ns", "spray_end_ns").alias("t")).join(own, "run_id", "full")
    return both.select("run_id", F.coalesce("m", "t").alias("x")).select("run_id", "x.*")


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    """run_id, spray_start_ns, spray_end_ns of marker files {"<run>.log": {"SPRAY_START": ns, "SPRAY_END": ns}}; a missing marker is null."""
    files = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").text(path)
    own = F.from_json("value", f"map<string, struct<{', '.join(f'{m}: bigint' for m in MARKERS)}>>")
    rows = files.select(F.explode(own).alias("name", "m")).filter(F.endswith("name", F.lit(".log")))
    return rows.select(F.regexp_replace("name", r"\.log$", "").alias("run_id"), F.col("m.SPRAY_START").alias("spray_start_ns"), F.col("m.SPRAY_END").alias("spray_end_ns"))


def attack_intervals(runs: DataFrame, found: DataFrame) -> DataFrame:
    """``runs`` (run_id, is_attack) with spray_start_ns and spray_end_ns. An attack run whose interval is missing or does not end after its start
    is an error when its row is read; other runs have what was found."""
    rows = runs.select("run_id", "is_attack").join(found.select("run_id", "spray_start_ns", "spray_end_ns"), "run_id", "left")
    sound = ~F.col("is_attack") | F.coalesce(F.col("spray_end_ns") > F.col("spray_start_ns"), F.lit(False))
    fault = F.raise_error(F.concat(F.lit("no sound interval of the attack run "), "run_id")).cast("long")
    return rows.withColumn("spray_start_ns", F.when(sound, F.col("spray_start_ns")).otherwise(fault))


def trace_bounds(events: DataFrame) -> DataFrame:
    """First and last stamp of each run by line order."""
    return events.groupBy("run_id").agg(F.min_by("timestamp_ns", "seq").alias("first_ns"), F.max_by("timestamp_ns", "seq").alias("last_ns"))


def validate_traces(events: DataFrame, found: DataFrame, runs: DataFrame, minimum: int = 100, require_markers: bool = False) -> DataFrame:
    """run_id, event_count, reason (null: valid) for every run of ``runs``."""
    n = events.groupBy("run_id").agg(F.count("*").alias("event_count"))
    names = found.groupBy("run_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("block", "line_id", "name"))), lambda x: x["name"]).alias("names"))
    rows = runs.select("run_id").join(n, "run_id", "left").join(names, "run_id", "left").withColumn("event_count", F.coalesce("event_count", F.lit(0)))
    wrong = F.lit(require_markers) & ~F.coalesce(F.col("names") == F.array(*[F.lit(m) for m in MARKERS]), F.lit(False))
    reason = F.when(F.col("event_count") == 0, "missing_or_empty_trace").when(F.col("event_count") < minimum, "too_few_events").when(wrong, "invalid_markers")
    return rows.select("run_id", "event_count", reason.alias("reason"))


def _leading(c: Column) -> Column:
    """The digits that a text begins with, as a number, or null."""
    return F.substring(c, F.lit(1), F.length(c) - F.length(F.ltrim(c, F.lit("0123456789")))).try_cast("long")


def overruns(lines: DataFrame) -> DataFrame:
    """Lost events of each run, summed over processors."""
    words = F.split(stripped(F.col("line")), r"\s+")
    n = F.when(F.get(words, F.lit(0)) == "overrun:", _leading(F.get(words, F.lit(1))))
    return lines.withColumn("n", n).filter("n is not null").groupBy("run_id").agg(F.sum("n").alias("overrun"))


def run_validity(checked: DataFrame, lost: DataFrame) -> DataFrame:
    """run_id, valid: a sound trace without lost events."""
    return checked.join(lost, "run_id", "left").select("run_id", (F.col("reason").isNull() & (F.coalesce("overrun", F.lit(0)) == 0)).alias("valid"))


def slab_usage(lines: DataFrame) -> DataFrame:
    """run_id, size, usage: the last usage of each object size, from ``kmalloc-size: usage``."""
    pair = F.split(F.get(F.split("line", "kmalloc-"), F.lit(1)), ": ", 2)
    size = F.when(_digits(F.get(pair, F.lit(0))), F.get(pair, F.lit(0)).try_cast("long"))
    rows = lines.select("run_id", "block", "line_id", size.alias("size"), _leading(F.get(pair, F.lit(1))).alias("n")).filter("size is not null and n is not null")
    return rows.groupBy("run_id", "size").agg(F.max_by("n", F.struct("block", "line_id")).alias("usage"))


def write_events(events: DataFrame, path: str, csv: bool = False) -> None:
    """Events as Parquet by run, or as CSV with a header."""
    if csv:
        events.select("run_id", *S.CSV_COLUMNS).write.partitionBy("run_id").option("header", "true").csv(path)
    else:
        events.write.partitionBy("run_id").parquet(path)


def read_events_csv(spark: SparkSession, path: str) -> DataFrame:
    """Events of CSV files with a header in the column order of the format; rows whose numbers do not parse are left out, missing
    fields take their defaults. The run is the file's path without its suffix."""
    text = spark.read.option("header", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").option("enforceSchema", "true").schema(", ".join(f"{c} string" for c in S.CSV_COLUMNS)).csv(path)
    rows = text.select("*", F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_id"))
    base = path.rstrip("/").split("/")[-1]
    num = lambda c, default=None: F.when(F.col(c).isNull(), F.lit(default)).otherwise(F.col(c).try_cast("long"))
    keep = lambda c: F.col(c).try_cast("long").isNotNull() | F.col(c).isNull()
    rows = rows.filter(F.col("timestamp_ns").try_cast("long").isNotNull() & F.col("pid").try_cast("long").isNotNull() & F.col("op").isNotNull())
    for c in ("tid", "cpu", "bytes_req", "bytes_alloc"):
        rows = rows.filter(keep(c))
    run = F.regexp_replace(F.expr(f"substring_index(p, '/{base}/', -1)"), r"\.csv$", "")
    return with_seq(rows.select(
        run.alias("run_id"), "block", "line_id", num("timestamp_ns").alias("timestamp_ns"), num("pid").alias("pid"), F.coalesce(num("tid"), num("pid")).alias("tid"), num("cpu", 0).cast("int").alias("cpu"),
        F.coalesce("comm", F.lit("")).alias("comm"), "op", F.coalesce("ptr", F.lit("")).alias("ptr"), num("bytes_req", 0).alias("bytes_req"), num("bytes_alloc", 0).alias("bytes_alloc"), F.coalesce("call_site", F.lit("")).alias("call_site"),
    ))
