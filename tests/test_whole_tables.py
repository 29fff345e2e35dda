"""Queries that run over their whole tables, against plain Python."""

import math
import os
from collections import Counter, defaultdict

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")

from tracelake import queries as engine  # noqa: E402
from tracelake.plans.base import G, trace_events  # noqa: E402


def test_marker_intervals_judge_every_marker(spark):
    markers = defaultdict(list)
    for e in spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id", "event_type").collect():
        if e.event_type in ("signup", "error"):
            markers[str(e.user_id)].append((e.event_id, e.event_type == "signup"))
    want = {}
    for run, own in markers.items():
        own.sort()
        depth, sound = 0, own[0][1] and not own[-1][1]
        for _, starts in own:
            depth += 1 if starts else -1
            sound = sound and depth >= 0
        want[run] = (sound and depth == 0, own[0][0], own[-1][0], "SPRAY_START" if own[-1][1] else "SPRAY_END")
    got = {r.run_id: (r.ok, r.start_ns, r.end_ns, r.last_name) for r in engine.QUERIES["marker_intervals"](spark, SF).collect()}
    assert got == want


def test_detectors_see_whole_vectors(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 24)).astype(np.float32)
    x[0, 20] = 40  # strange beyond the first numbers alone
    rows = [(i, [float(v) for v in r], 9 if i == 0 else i % 5) for i, r in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    z = {r.vec_id: r.score for r in engine.QUERIES["zscore_detector"](spark, str(tmp_path)).collect()}
    own = x.astype(float)
    want = (((own - own[1:].mean(0)) / own[1:].std(0)) ** 2).mean(1)
    assert [z[i] for i in range(600)] == pytest.approx(want.tolist(), abs=2e-5)
    svm = {r.vec_id: r.score for r in engine.QUERIES["ocsvm_detector"](spark, str(tmp_path)).collect()}
    assert max(z, key=z.get) == max(svm, key=svm.get) == 0


def test_heatmap_has_every_run(spark):
    runs = defaultdict(list)
    for e in trace_events(spark, SF).select("run_id", "timestamp_ns").collect():
        runs[e.run_id].append(e.timestamp_ns)
    counts = Counter()
    for run, stamps in runs.items():
        first = min(stamps) - min(stamps) % G.stride_ns
        for ns in stamps:
            at = ns - ns % G.stride_ns
            counts.update((run, start) for start in (at - G.stride_ns, at) if start >= first)
    got = {(r.run_id, r.start_ns): r.value for r in engine.QUERIES["heatmap"](spark, SF).collect()}
    assert len(runs) == 8 and got.keys() == counts.keys()
    assert all(got[k] == pytest.approx(math.log10(1 + n), abs=1e-6) for k, n in counts.items())


def test_cross_family_split_has_every_role(spark):
    strata, want = Counter(), Counter()
    for o in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_custkey").collect():
        cve, work = 1000 + o.o_custkey % 5, ("idle", "net_busy", "msg_msg_256", "keyctl", "fs_io")[o.o_orderkey % 5]
        if o.o_orderkey % 4 == 0:
            want["eval_attack"] += cve in (1001, 1002)
        elif work in ("msg_msg_256", "keyctl"):
            want["churn"] += 1
        elif cve == 1002:
            want["eval_normal"] += 1
        elif cve in (1000, 1001):
            strata[cve, work] += 1
    for (cve, _), n in strata.items():
        share = max(1, round(n * 0.15))
        val, test = (1, 1) if 2 * share >= n else (share, share)
        want["val"] += val
        want["train"] += n - val - test
        want["eval_normal"] += test * (cve == 1001)
    got = {r.role: r.n for r in engine.QUERIES["cross_family_split"](spark, SF).collect()}
    assert got == dict(want)


def test_bootstrap_draws_every_resample(spark):
    from tracelake.operators import metrics

    got = engine.QUERIES["bootstrap_ci"](spark, SF).first()
    scored = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    runs = scored.selectExpr("source", "1 - quality AS label", "double(n_chars) AS score").groupBy("source", "label").agg({"score": "max"}).withColumnRenamed("max(score)", "score")
    assert 1800 < got.n_resamples <= 2000 and got == metrics.bootstrap_ci(runs, 20_000.0, rounds=2000).first()
