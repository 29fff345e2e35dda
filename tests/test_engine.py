"""Golden values of the trace model on small frames, ties included."""

import math
import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tracelake import schema as S
from tracelake.functions import scalars as X
from tracelake.operators import features, gates, metrics, resolve, scoring, sequences, splits, tokens, windows
from tracelake.sources import runs as U
from tracelake.sources import traces as TR

MS = 1_000_000
DDL = "run_id string, seq long, timestamp_ns long, pid long, tid long, cpu int, comm string, op string, ptr string, bytes_req long, bytes_alloc long, call_site string"


def events(spark, rows):
    """rows: (ts, op, ptr, size, site?, cpu?, tid?, comm?)"""
    out = []
    for i, r in enumerate(rows):
        ts, op, ptr, size, site, cpu, tid, comm = (*r, *("s", 0, 1, "t")[len(r) - 4 :])
        out.append(("r", i, ts, tid, tid, cpu, comm, op, ptr, size, size, site))
    return spark.createDataFrame(out, DDL)


def values(spark, column, rows, kind="long"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i long, v {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_buckets(spark):
    assert values(spark, X.bucket_index, [32, 33, 64, 96, 128, 192, 256, 512, 1024, 2048, 4096, 8192, 8193]) == [0, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]


def test_delta_and_lifecycle_classes(spark):
    assert values(spark, X.dt_field_bucket, [0, 1999, 2000, 9999, 10_000, 100_000, MS, 10 * MS, -5, None]) == [0, 0, 1, 1, 2, 3, 4, 5, 0, 5]
    life = values(spark, lambda v: X.lifecycle_state(F.lit("FREE"), F.lit(False), v), [0, 99_000, 100_000, 9 * MS, 10 * MS, None])
    assert life == [2, 2, 3, 3, 4, 5]


def test_tokens_are_a_bijection(spark):
    cols = ["a", "b", "c", "d", "e", "f", "g"]
    df = spark.range(1)
    for c, n in zip(cols, S.TOKEN_RADICES):
        df = df.crossJoin(spark.range(n).select(F.col("id").cast("int").alias(c)))
    row = df.select(X.encode_token(*map(F.col, cols)).alias("t")).agg(F.count_distinct("t"), F.min("t"), F.max("t")).first()
    assert tuple(row) == (13824, 0, 13823)


def test_resolution(spark):
    r = resolve.resolve(events(spark, [(1000, "ALLOC", "a", 256), (2000, "ALLOC", "b", 64), (3000, "FREE", "a", 0), (4000, "FREE", "c", 0)]))
    got = {x.seq: x for x in r.collect()}
    assert (got[2].size_resolved, got[2].resolved_bytes_alloc, got[2].object_lifetime_ns) == (True, 256, 2000)
    assert not got[3].size_resolved
    s = resolve.resolution_stats(r).first()
    assert (s.n_resolved, s.n_unresolved, s.quality) == (1, 1, "high_free_unknown")


def test_reclaim_and_pointer_reuse(spark):
    rows = [(MS, "ALLOC", "p", 256, "x"), (2 * MS, "FREE", "p", 0, "x"), (3 * MS, "ALLOC", "p", 512, "x"), (4 * MS, "FREE", "p", 0, "y"), (5 * MS, "ALLOC", "p", 8, "z")]
    got = sorted(resolve.resolve(events(spark, rows)).collect(), key=lambda x: x.seq)
    assert [x.resolved_bytes_alloc for x in got if x.op == "FREE"] == [256, 512]
    assert sum(x.reclaim_from_free for x in got) == 2 and sum(x.reclaim_cross_site for x in got) == 1
    late = events(spark, [(0, "ALLOC", "p", 8), (1, "FREE", "p", 0), (100 * MS, "ALLOC", "p", 8), (0, "FREE", "", 0)])
    assert not any(x.reclaim_from_free for x in resolve.resolve(late).collect())


def brute_resolve(rows):
    live, freed, out = {}, {}, []
    for ts, op, ptr, size, site in rows:
        if op == "ALLOC":
            was = freed.pop(ptr, None)
            rec = was is not None and ts - was[0] <= S.RECLAIM_NS
            out.append((True, size, None, rec, rec and was[1] != site))
            live[ptr] = (size, ts)
        else:
            was = live.pop(ptr, None)
            freed[ptr] = (ts, site)
            out.append((was is not None, was and was[0], None if was is None else max(0, ts - was[1]), False, False))
    return out


def test_resolution_against_a_state_machine_with_ties(spark):
    rng = random.Random(1)
    ts, rows = 0, []
    for _ in range(3000):
        ts += rng.choice([0, 0, 1, 30]) * MS
        rows.append((ts, rng.choice(["ALLOC", "FREE"]), f"p{rng.randint(0, 40)}", rng.randint(1, 9000), rng.choice("abc")))
    got = sorted(resolve.resolve(events(spark, rows)).collect(), key=lambda x: x.seq)
    assert [(x.size_resolved, x.resolved_bytes_alloc, x.object_lifetime_ns, x.reclaim_from_free, x.reclaim_cross_site) for x in got] == brute_resolve(rows)


def test_empty_windows_are_rows(spark):
    f = features.window_features(events(spark, [(0, "ALLOC", "a", 8), (0, "ALLOC", "b", 8), (1000 * MS, "ALLOC", "c", 8)])).collect()
    assert len(f) == 21 and sum(x.is_empty for x in f) == 18 and sum(x.event_count for x in f) == 4
    first = min(f, key=lambda x: x.start_ns)
    assert first["alloc_rate_32"] == pytest.approx(0.02) and first.time_since_previous_event_ms == 100


def entropy(c):
    n = sum(c.values())
    return 0.0 if len(c) < 2 else -sum(v / n * math.log2(v / n) for v in c.values()) / math.log2(len(c))


def test_features_against_plain_counting(spark):
    rng = random.Random(4)
    ts, rows = 7 * MS, []
    for _ in range(600):
        ts += rng.choice([0, 0, 300_000, 2 * MS, 40 * MS])
        rows.append((ts, rng.choice(["ALLOC", "ALLOC", "FREE"]), f"p{rng.randint(0, 30)}", rng.choice([8, 60, 500, 9000]), rng.choice("abcd"), rng.randint(0, 3), rng.randint(1, 4), rng.choice(["x", "y"])))
    e = events(spark, rows)
    got = {r.start_ns: r for r in features.window_features(e).collect()}
    notes = [(t, op, site, cpu, tid, comm) + r for (t, op, _, _, site, cpu, tid, comm), r in zip(rows, brute_resolve([r[:5] for r in rows]))]
    for start, r in got.items():
        own = [x for x in notes if start <= x[0] < start + 100 * MS]
        al = [x for x in own if x[1] == "ALLOC"]
        assert r.event_count == len(own) and r.total_alloc == len(al)
        tasks = Counter(x[4] for x in al)
        if tasks:
            top = tasks.most_common(1)[0][0]
            assert r.top_task_id == top
            assert r.top_task_comm == Counter(x[5] for x in own if x[4] == top).most_common(1)[0][0]
            assert r.task_alloc_entropy == pytest.approx(entropy(tasks), abs=1e-6)
        assert r.alloc_callsite_entropy == pytest.approx(entropy(Counter(x[2] for x in al)), abs=1e-6)
        assert r.free_callsite_entropy == pytest.approx(entropy(Counter(x[2] for x in own if x[1] == "FREE")), abs=1e-6)
        bins = defaultdict(list)
        for x in own:
            bins[(x[0] - start) // MS].append(x)
        if bins:
            dense = max(sorted(bins), key=lambda k: len(bins[k]))
            sites = Counter(x[2] for x in bins[dense] if x[1] == "ALLOC")
            want = max(sites.values()) / sum(sites.values()) if sites else 0
            assert r.burst_dominant_callsite_ratio == pytest.approx(want, abs=1e-6)
    spark.catalog.clearCache()


def test_labels(spark):
    def label(starts, s0, s1):
        df = spark.createDataFrame([(int(s * MS),) for s in starts], "s long")
        end = F.col("s") + 100 * MS
        return [r[0] for r in df.orderBy("s").select(X.window_label(F.col("s"), end, F.lit(True), F.lit(int(s0 * MS)), F.lit(int(s1 * MS)))).collect()]

    assert label([0, 100, 150, 250, 260, 300], 100, 300) == [0, 1, 1, 1, -1, 0]
    assert label([0, 50, 100], 50, 50.2) == [1, 1, 0]
    assert label([0], 5, 5) == [-1]
    arr = spark.createDataFrame([([1, -1, 0],)], "v array<int>")
    assert [arr.select(X.sequence_label(F.col("v"), p, b)).first()[0] for p, b in (("any", "drop"), ("endpoint", "drop"), ("any", "keep"))] == [-1, -1, 1]
    with pytest.raises(ValueError):
        X.sequence_label(F.col("v"), "other")


def test_window_sequences_and_short_runs(spark):
    df = spark.range(40).select(F.lit("r").alias("run_id"), (F.col("id") * 50 * MS).alias("start_ns"), F.lit(0).alias("label"))
    assert sequences.window_sequences(df).count() == 9
    assert sequences.window_sequences(df.filter(f"start_ns < {5 * 50 * MS}")).count() == 0
    assert sequences.short_runs(df.limit(5)).count() == 1
    assert sequences.contiguous(df).count() == 0 and sequences.contiguous(df.filter(f"start_ns <> {50 * MS * 3}")).count() == 1


def test_event_sequences_reset_their_first_delta(spark):
    e = events(spark, [(i * MS, "ALLOC", f"p{i}", 8) for i in range(300)])
    t = tokens.tokenise(e, tokens.call_site_profiles(e))
    s = sequences.event_sequences(t, tokens.fields()).withColumn("items", sequences.reset_first(F.col("items"))).orderBy("chunk").collect()
    assert [r.chunk for r in s] == [0, 1, 2] and all(len(r["items"]) == 128 and r["items"][0].dt == 5 and r["items"][0].dt_cont == 0 for r in s)


def test_score_aggregation(spark):
    df = spark.createDataFrame([([1.0] * 123 + [50.0] * 5,)], "v array<double>")
    assert df.select(scoring.aggregate_scores(F.col("v"), "topk8")).first()[0] == 31.625
    assert df.select(scoring.aggregate_scores(F.col("v"), "p90")).first()[0] == 1.0
    small = spark.createDataFrame([([3.0, 1.0, 2.0],)], "v array<double>")
    assert small.select(scoring.aggregate_scores(F.col("v"), "topk10")).first()[0] == 2.0
    for bad in ("topk0", "median"):
        with pytest.raises(ValueError):
            scoring.aggregate_scores(F.col("v"), bad)


def test_ranking_metrics_with_ties(spark):
    rng = random.Random(3)
    rows = [(float(rng.randint(0, 9)), rng.randint(0, 1)) for _ in range(200)]
    m = metrics.ranking_metrics(spark.createDataFrame(rows, "score double, label int")).first()
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    assert m.roc_auc == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg))
    best = max((2 * sum(y for s, y in rows if s >= t) / (sum(s >= t for s, _ in rows) + len(pos)), -t) for t in {s for s, _ in rows})
    assert (m.best_f1, m.best_threshold) == (pytest.approx(best[0]), -best[1])
    assert metrics.ranking_metrics(spark.createDataFrame([(1.0, 1)], "score double, label int")).first().roc_auc is None
    ci = metrics.bootstrap_ci(spark.createDataFrame(rows[:40], "score double, label int"), 5.0, rounds=50).first()
    assert 0 <= ci.auc_low <= ci.auc_high <= 1


def test_splits(spark):
    runs = spark.createDataFrame([(f"c/w{k % 3}/run_{k}",) for k in range(90)], "run_id string")
    s = splits.stratified_split(runs)
    assert {(r.split, r.n) for r in s.groupBy("stratum", "split").agg(F.count("*").alias("n")).collect()} == {("val", 4), ("test", 4), ("train", 22)}
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, splits.stratified_split(runs).collect()))
    with pytest.raises(Exception, match="too few runs"):
        splits.stratified_split(runs.limit(2)).collect()
    fam = spark.createDataFrame([("c/idle/run_1",), ("c/msg_msg_256/run_1",), ("c/keyctl/run_2",), ("c/poc_cfh_baseline/run_1",)], "run_id string")
    assert Counter(r.family for r in splits.families(fam).collect()) == {"normal": 1, "churn": 2, "baseline": 1}


def test_gates_can_fail(spark):
    roles = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "val")], "run_id string, role string")
    r = gates.gate_report([gates.disjoint(roles), gates.finite(spark.createDataFrame([(0,)], "n_bad long"))]).collect()
    assert {x.name: x.status for x in r} == {"disjoint_split": "FAIL", "finite": "pass"}


def kmalloc(ts, pid=1858, comm="bash", cpu=3, ptr="00000000688bb814", size=32):
    return f"  {comm}-{pid}  [{cpu:03d}] ...1 {ts:.6f}: kmalloc: call_site=ffffffff8139c7f1 ptr={ptr} bytes_req={size} bytes_alloc={size} gfp_flags=GFP_KERNEL"


def test_trace_sources(spark, tmp_path):
    a, b, q = tmp_path / "CVE-2017-7308/attack/v/run_1", tmp_path / "CVE-2017-7308/normal/idle/run_2", tmp_path / "quarantine/x/run_3"
    for d in (a, b, q):
        os.makedirs(d)
    mark = "  bash-100   [000] ....    {:.6f}: tracing_mark_write+0xb2/0x200 <ffffffff81167302>: {}"
    (a / "trace.log").write_text("\n".join(["# head", "", kmalloc(11.852213, comm="my-bash"), "  bash-1858  [003] ...1 12.500000: kfree: call_site=ffffffff8136ccd1 ptr=00000000688bb814", mark.format(1.0, "SPRAY_START"), mark.format(1.5, "SPRAY_START"), mark.format(2.0, "SPRAY_END"), "noise"]))
    (b / "trace.log").write_text("5000,7,8,a,b,ALLOC,0000abc0,10,16,ffff1\n" + kmalloc(1.0) + "\n6000,7,8,c,FREE,0000abc0,0,0,ffff1\n")
    (q / "trace.log").write_text(kmalloc(1.0) + "\n")
    lines = TR.with_run_id(TR.read_lines(spark, str(tmp_path)), str(tmp_path))
    e = sorted(TR.parse_lines(lines).collect(), key=lambda r: (r.run_id, r.seq))
    assert [r.run_id for r in e] == ["CVE-2017-7308/idle/run_2"] * 2 + ["CVE-2017-7308/v/run_1"] * 2
    probe, alloc, free = e[0], e[2], e[3]
    assert (probe.tid, probe.cpu, probe.comm, probe.bytes_alloc) == (8, 0, "a,b", 16)
    assert (alloc.timestamp_ns, alloc.pid, alloc.cpu, alloc.comm, alloc.op, alloc.bytes_alloc) == (11852213000, 1858, 3, "my-bash", "ALLOC", 32)
    assert (free.op, free.bytes_req, free.seq) == ("FREE", 0, 1)
    assert tuple(TR.markers(lines).first()) == ("CVE-2017-7308/v/run_1", 1_500_000_000, 2_000_000_000)
    m = TR.validated_markers(TR.marker_list(lines)).first()
    assert not m.ok and m.last_name == "SPRAY_END"
    checked = {r.run_id: r.reason for r in TR.validate_traces(TR.parse_lines(lines), TR.marker_list(lines), lines.select("run_id").distinct(), 2, True).collect()}
    assert set(checked.values()) == {"invalid_markers"}
    out = str(tmp_path / "csv")
    TR.parse_lines(lines).filter("run_id like '%run_1'").select(*S.CSV_COLUMNS).coalesce(1).write.option("header", "true").csv(out)
    assert TR.read_events_csv(spark, out).count() == 2


def test_overrun_bounds_and_interval(spark):
    lines = spark.createDataFrame([("r", 0, i, t) for i, t in enumerate(["cpu 0", "overrun: 0", "cpu 1", " overrun: 7"])], "run_id string, block long, line_id long, line string")
    assert TR.overruns(lines).first().overrun == 7
    marked = spark.createDataFrame([("a", 1, 5), ("b", 1, 5)], "run_id string, spray_start_ns long, spray_end_ns long")
    man = spark.createDataFrame([("a", "valid", 10, 20), ("b", "valid", 20, 20)], "run_id string, status string, spray_start_ns long, spray_end_ns long")
    assert {tuple(r) for r in TR.interval(marked, man).collect()} == {("a", 10, 20), ("b", 1, 5)}


def test_odd_lines_of_both_grammars(spark):
    kernel = [
        "  a b-c-12    [003] d..1.  12.000000345: kmalloc: call_site=ffff81 ptr=00ab bytes_req=8 bytes_alloc=16 gfp_flags=GFP_KERNEL node=-1",
        "x [y]-7 [000] .... 1.5: kfree: call_site=0xfe ptr=0xab", "x-7 [000] .... 1.5: kfree: call_site=0xfe ptr=zz", "x-7 [000] .... 15: kfree: call_site=0xfe ptr=ab",
        "x-7 .... 1.5: kfree: call_site=0xfe ptr=ab", "x-7 [000] .... 1.5: kmalloc: call_site=0xfe ptr=ab bytes_req=8 gfp_flags=A", "# x-7 [000] .... 1.5: kfree: call_site=0xfe ptr=ab",
        "1,2,3,n,FREE,ab,0,0,cd",
    ]
    probe = ["5,2,3,n,ALLOC,p,FREE,0xab,1,2,cd", "6,2,3,,ALLOC,ab,1,2,cd,more", "7,2,3,n,ALLOC,ab,1,2", "8,2,x,n,ALLOC,ab,1,2,cd", kernel[1]]
    lines = spark.createDataFrame([(r, 0, i, t) for r, own in (("k", kernel), ("p", probe)) for i, t in enumerate(own)], "run_id string, block long, line_id long, line string")
    events = TR.parse_lines(lines).collect()
    got = {r: sorted((x.timestamp_ns, x.pid, x.tid, x.cpu, x.comm, x.op, x.ptr, x.bytes_req, x.bytes_alloc, x.call_site) for x in events if x.run_id == r) for r in ("k", "p")}
    assert got["k"] == [(1500000000, 7, 7, 0, "x [y]", "FREE", "0xab", 0, 0, "0xfe"), (12000000345, 12, 12, 3, "a b-c", "ALLOC", "00ab", 8, 16, "ffff81")]
    assert got["p"] == [(5, 2, 3, 0, "n,ALLOC,p", "FREE", "0xab", 1, 2, "cd"), (6, 2, 3, 0, "", "ALLOC", "ab", 1, 2, "cd")]
    marks = ["a-1 [000] .... 2.5: tracing_mark_write: f: SPRAY_START now", "a-1 [000] .... 3.5: tracing_mark_write: f SPRAY_END", "a-1 [000] .... 4.5: tracing_mark_write: f: SPRAY_END", "SPRAY_END"]
    found = TR.marker_list(spark.createDataFrame([("r", 0, i, t) for i, t in enumerate(marks)], "run_id string, block long, line_id long, line string"))
    assert sorted((r.name, r.ns) for r in found.collect()) == [("SPRAY_END", 4500000000), ("SPRAY_START", 2500000000)]
    slab = spark.createDataFrame([("r", 0, 0, "x kmalloc-64: 12 a"), ("r", 0, 1, "kmalloc-64: 15"), ("r", 0, 2, "kmalloc-x: 3")], "run_id string, block long, line_id long, line string")
    assert [tuple(r) for r in TR.slab_usage(slab).collect()] == [("r", 64, 15)]


def test_run_tables(spark, tmp_path):
    ids = ["CVE-2017-7308/poc_cfh_combo/run_001_x", "CVE-2017-7308/idle/run_002_y", "CVE-2017-7308/net_busy_run_003"]
    got = [tuple(r[0]) for r in spark.createDataFrame([(i,) for i in ids], "r string").select(X.run_metadata(F.col("r"))).collect()]
    assert got == [("attack", "CVE-2017-7308", "poc_cfh_combo", None), ("normal", "CVE-2017-7308", None, "idle"), ("normal", "CVE-2017-7308", None, "net_busy")]
    level = '{"run_level": {"roc_auc": 0.5, "f1_at_threshold": NaN, "fpr_at_threshold": 1}, "counts": {"test_normal_runs": 7}}'
    for d, c, r in (("a", '{"model": "m", "seed": 1}', level), ("b", "{", level), ("c", '{"model": "m"}', ""), ("d", '{"held_out_cve": "CVE-1"}', '{"run_level": null}')):
        os.makedirs(tmp_path / d)
        (tmp_path / d / "experiment_config.json").write_text(c)
        (tmp_path / d / "evaluation_report.json").write_text(r)
        (tmp_path / d / "other.json").write_text('{"run_level": {"roc_auc": 0.9}}')
    reports = U.read_reports(spark, str(tmp_path))
    assert [tuple(r) for r in U.comparison(reports).collect()] == [("?", "", "CVE-1", *[""] * 8), ("m", "1", "-", "0.5000", "", "", "", "1.0000", "7", "", "")]
    assert U.read_reports(spark, str(tmp_path), ["m"]).count() == 1
    with pytest.raises(ValueError):
        U.markdown(spark.range(3), limit=2)
    assert U.markdown(spark.createDataFrame([(1, None)], "a int, b string")) == "| a | b |\n| --- | --- |\n| 1 |  |"
    target = str(tmp_path / "out")
    U.write_table(spark.range(1), target)
    with pytest.raises(Exception):
        U.write_table(spark.range(1), target)
    U.write_table(spark.range(2), target, force=True)
    assert spark.read.parquet(target).count() == 2


def test_ocsvm_separates_and_survives_saving(spark, tmp_path):
    from tracelake.models.detectors import OneClassSVM

    rng = random.Random(5)
    near = [tuple(rng.gauss(0, 1) for _ in range(4)) for _ in range(200)]
    far = [tuple(rng.gauss(6, 1) for _ in range(4)) for _ in range(20)]
    cols = ["a", "b", "c", "d"]
    df = spark.createDataFrame(near, "a double, b double, c double, d double")
    model = OneClassSVM().fit(df, cols)
    lo = [r.score for r in model.anomaly_score(df).collect()]
    hi = [r.score for r in model.anomaly_score(spark.createDataFrame(far, df.schema)).collect()]
    assert sum(hi) / len(hi) > sorted(lo)[int(0.9 * len(lo))]
    model.save(str(tmp_path / "m.npz"))
    again = OneClassSVM.load(str(tmp_path / "m.npz"))
    assert [r.score for r in again.anomaly_score(df.limit(5)).collect()] == [r.score for r in model.anomaly_score(df.limit(5)).collect()]


def test_sequence_models_score_attacks_higher(spark):
    from tracelake.models.detectors import MODELS

    normal = spark.createDataFrame([("n", k, [(i + k) % 6 for i in range(64)]) for k in range(40)], "run_id string, chunk long, items array<int>")
    odd = spark.createDataFrame([("a", k, [5] * 64) for k in range(5)], normal.schema)
    for name in ("markov", "markov_centroid"):
        m = MODELS[name]().fit_sequences(normal)
        mean = lambda d: m.sequence_anomaly_score(d).agg(F.avg(scoring.aggregate_scores(F.col("scores"), "mean"))).first()[0]  # noqa: B023, E731
        assert mean(odd) > mean(normal)


def test_streaming_resolution_equals_the_batch(spark, tmp_path):
    from tracelake.streaming.resolve import resolve_stream

    rng = random.Random(2)
    rows = [(i * MS, rng.choice(["ALLOC", "FREE"]), f"p{rng.randint(0, 5)}", 64, rng.choice("ab")) for i in range(200)]
    e = events(spark, rows).coalesce(1)
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = resolve_stream(stream).writeStream.format("memory").queryName("resolved").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    cols = ["seq", "size_resolved", "resolved_bytes_alloc", "object_lifetime_ns", "reclaim_from_free", "reclaim_cross_site"]
    want = resolve.resolve(e).select(*cols)
    assert sorted(map(str, spark.table("resolved").select(*cols).collect())) == sorted(map(str, want.collect()))


def test_an_attack_run_without_a_sound_interval_is_an_error(spark):
    runs = spark.createDataFrame([("a", True), ("b", False), ("c", False)], "run_id string, is_attack boolean")
    found = lambda *rows: spark.createDataFrame(rows, "run_id string, spray_start_ns long, spray_end_ns long")
    got = {r.run_id: (r.spray_start_ns, r.spray_end_ns) for r in TR.attack_intervals(runs, found(("a", 1, 2), ("b", 5, 5))).collect()}
    assert got == {"a": (1, 2), "b": (5, 5), "c": (None, None)}
    for wrong in (found(("b", 1, 2)), found(("a", 2, 2)), found(("a", None, 2))):
        with pytest.raises(Exception, match="no sound interval"):
            TR.attack_intervals(runs, wrong).collect()
