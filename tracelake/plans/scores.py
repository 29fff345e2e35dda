"""Queries over tokens, scores, metrics, splits, gates and run tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake import schema as S
from tracelake.functions import scalars as X
from tracelake.models.detectors import MODELS
from tracelake.operators import gates as GT
from tracelake.operators import metrics as M
from tracelake.operators import scoring as C
from tracelake.operators import sequences as Q
from tracelake.operators import splits as P
from tracelake.operators import tokens as T
from tracelake.operators import windows as W
from tracelake.plans.base import EV, G, LABEL, RE, RUNS, WN, spray_runs, table, trace_events
from tracelake.sources import runs as U
from tracelake.sources import traces as TR

_long = lambda *cs: [F.col(c).cast("long").alias(c) for c in cs]


def _tokens(spark, sf_dir):
    e = trace_events(spark, sf_dir)
    profiles = T.call_site_profiles(e.filter("run_id NOT IN ('run_0','run_1','run_2','run_3')"))
    return T.tokenise(e, profiles, spray_runs(e), G.reclaim_ns)


def call_site_profiles(spark, sf_dir):
    e = trace_events(spark, sf_dir).filter("run_id NOT IN ('run_0','run_1','run_2','run_3')")
    return T.call_site_profiles(e).select("call_site", *_long("total_count", "behavior_type", "frequency_rank"))


def event_tokens(spark, sf_dir):
    return _tokens(spark, sf_dir).select("run_id", *_long("pos", "token", "op", "size_bucket", "cpu_bucket", "reclaim", "life", "dt", "label"), F.round("dt_cont", 6).alias("dt_cont"))


def token_sequences(spark, sf_dir):
    s = Q.event_sequences(_tokens(spark, sf_dir), F.col("token"))
    return s.select("run_id", "chunk", F.col("seq_label").cast("long").alias("seq_label"), F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x).alias("token_sum"), F.get("items", F.lit(0)).cast("long").alias("first_token"), F.element_at("items", -1).cast("long").alias("last_token"))


def event_field_sequences(spark, sf_dir):
    s = Q.event_sequences(_tokens(spark, sf_dir), T.fields()).withColumn("items", Q.reset_first(F.col("items")))
    add = lambda f: F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x[f])
    return s.select("run_id", "chunk", add("dt").alias("dt_sum"), add("life").alias("life_sum"), F.get("items", F.lit(0))["dt"].cast("long").alias("first_dt"), F.get("items", F.lit(0))["dt_cont"].alias("first_dt_cont"))


def call_site_slots(spark, sf_dir):
    return trace_events(spark, sf_dir).select("call_site").distinct().select("call_site", X.call_site_slot(F.col("call_site")).alias("slot"))


LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def scaler_fit(spark, sf_dir):
    s = C.fit_scaler(table(spark, sf_dir, "lineitem"), LINE)
    return s.select(*[F.round(c, 4).alias(c) for c in s.columns])


def scaled_rows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *LINE)
    out = C.scale(li, C.fit_scaler(li, LINE), LINE)
    return out.groupBy("l_linenumber").agg(F.count("*").alias("n"), *[F.round(F.max(c), 4).alias(f"max_{c}") for c in LINE])


HOWS = ("last", "max", "mean", "p90", "topk8")


def score_aggregation(spark, sf_dir):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", *[F.round(C.aggregate_scores(v, h), 6).alias(h) for h in HOWS])


def _scored(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("score"))
    return d.join(table(spark, sf_dir, "labels"), "doc_id").withColumn("label", 1 - F.col("quality"))


def ranking_metrics(spark, sf_dir):
    return M.ranking_metrics(_scored(spark, sf_dir)).select(*[F.round(c, 6).alias(c) for c in ("roc_auc", "average_precision", "best_f1")], "best_threshold")


def ranking_by_lang(spark, sf_dir):
    return M.ranking_metrics(_scored(spark, sf_dir), ["lang"]).select("lang", *[F.round(c, 6).alias(c) for c in ("roc_auc", "average_precision")])


def _flagged(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return C.flag(s, C.threshold(s.filter("label = 0"), 0.1))


def run_threshold(spark, sf_dir):
    s = _scored(spark, sf_dir).filter("label = 0").withColumn("run_id", F.col("source"))
    return C.threshold(C.run_scores(s), 0.25).select(F.round("threshold", 6).alias("threshold"))


def run_max_scores(spark, sf_dir):
    return C.run_scores(_scored(spark, sf_dir).withColumn("run_id", F.col("source")))


def classification(spark, sf_dir):
    return M.classification(_flagged(spark, sf_dir)).select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "fpr")], "n_flagged", "n")


def grouped_flags(spark, sf_dir):
    return M.grouped_flags(_flagged(spark, sf_dir), ["lang", "source"]).select("lang", "source", "runs_total", "n_flagged", F.round("detection_rate", 6).alias("detection_rate"))


def bootstrap(spark, sf_dir):
    s = _scored(spark, sf_dir).groupBy("source", "label").agg(F.max("score").alias("score"))
    return M.bootstrap_ci(s, 20_000.0)


def calibration(spark, sf_dir):
    c = C.calibration(table(spark, sf_dir, "lineitem"), LINE[:2])
    return c.select(*[F.round(x, 3).alias(x) for x in c.columns])


def _runs(spark, sf_dir):
    """Synthetic run identifiers over orders: families, variants, workloads and control runs."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    cve = F.concat(F.lit("CVE-2017-"), (1000 + F.col("o_custkey") % 5).cast("string"))
    attack = k % 4 == 0
    work = F.element_at(F.array(*[F.lit(w) for w in ("idle", "net_busy", "msg_msg_256", "keyctl", "fs_io")]), (k % 5 + 1).cast("int"))
    variant = F.when(k % 3 == 0, "poc_cfh_baseline").otherwise("poc_cfh_combo")
    sub = F.when(attack, variant).otherwise(work)
    return o.select(F.concat_ws("/", cve, sub, F.concat(F.lit("run_"), k.cast("string"))).alias("run_id"), F.when(attack, "attack").otherwise("normal").alias("class"), cve.alias("cve"), k.alias("k"))


RUNS_SQL = """rn AS (SELECT 'CVE-2017-' || (1000 + o_custkey % 5) AS cve, CASE WHEN o_orderkey % 4 = 0 THEN 'attack' ELSE 'normal' END AS class,
  CASE WHEN o_orderkey % 4 = 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'poc_cfh_baseline' ELSE 'poc_cfh_combo' END ELSE (['idle','net_busy','msg_msg_256','keyctl','fs_io'])[CAST(o_orderkey % 5 + 1 AS INTEGER)] END AS sub, o_orderkey AS k FROM orders),
rs AS (SELECT *, cve || '/' || sub || '/run_' || k AS run_id FROM rn)"""
_FAM = "CASE WHEN sub = 'poc_cfh_baseline' THEN 'baseline' WHEN sub IN ('msg_msg_256', 'keyctl') THEN 'churn' ELSE 'normal' END"


def run_metadata(spark, sf_dir):
    return _runs(spark, sf_dir).select("run_id", X.run_metadata(F.col("run_id")).alias("m")).select("run_id", "m.*")


def control_families(spark, sf_dir):
    return P.families(_runs(spark, sf_dir)).groupBy("family").agg(F.count("*").alias("n"))


def run_strata(spark, sf_dir):
    return _runs(spark, sf_dir).groupBy(X.run_stratum(F.col("run_id")).alias("stratum")).agg(F.count("*").alias("n"))


def stratified_split(spark, sf_dir):
    s = P.stratified_split(_runs(spark, sf_dir))
    return s.groupBy("stratum", "split").agg(F.count("*").alias("n"))


def cross_family_split(spark, sf_dir):
    roles = P.cross_family(_runs(spark, sf_dir), ["CVE-2017-1000", "CVE-2017-1001"], ["CVE-2017-1001", "CVE-2017-1002"])
    return roles.groupBy("role").agg(F.count("*").alias("n"))


def leave_one_out(spark, sf_dir):
    return P.leave_one_out(_runs(spark, sf_dir), "CVE-2017-1002").groupBy("role").agg(F.count("*").alias("n"))


def set_operations(spark, sf_dir):
    r = _runs(spark, sf_dir).select("run_id", "k")
    a, b = r.filter("k % 2 = 0"), r.filter("k % 3 = 0")
    out = [("both", P.overlap(a, b)), ("only_first", P.not_in(a, b)), ("semi", P.only_in(a, b)), ("union", a.select("run_id").unionByName(b.select("run_id")))]
    rows = [df.agg(F.lit(n).alias("op"), F.count("*").alias("n")) for n, df in out]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def gate_report(spark, sf_dir):
    e = trace_events(spark, sf_dir)
    sp = W.spine(e, G)
    filled = W.assign(e, G).select("run_id", "start_ns").distinct().withColumn("full", F.lit(1))
    w = sp.join(filled, ["run_id", "start_ns"], "left").withColumn("is_empty", F.col("full").isNull().cast("int")).join(spray_runs(e).select("run_id", F.when(F.col("is_attack"), "attack").otherwise("normal").alias("class")), "run_id")
    runs = w.groupBy("run_id", "class").agg(F.count("*").alias("n_windows"), F.avg("is_empty").alias("empty_ratio"))
    roles = P.stratified_split(_runs(spark, sf_dir)).withColumnRenamed("split", "role")
    marked = runs.withColumn("marker_status", F.when(F.col("run_id") == "run_0", "missing").otherwise("complete"))
    return GT.gate_report([GT.no_cross_run(w, G), GT.marker_success(marked), GT.empty_windows(w), GT.no_shortcut(runs), GT.disjoint(roles), GT.end_to_end(M.ranking_metrics(_scored(spark, sf_dir)))]).select("name", "status")


def target_buckets(spark, sf_dir):
    from tracelake.operators.features import window_features

    e = trace_events(spark, sf_dir)
    w = Q.label_windows(window_features(e, G, S.GROUPS["alloc_count"], False), spray_runs(e), G).withColumns({"cve": F.substring("run_id", 1, 5), "variant": F.col("run_id")})
    targets = w.select("cve").distinct().withColumn("bucket", F.lit("4096"))
    return GT.target_bucket(w, targets).select("name", "ok")


def run_registry(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 5000
    m = o.select(
        F.when(k % 2 == 0, F.concat(F.lit("r"), k.cast("string"))).alias("run_id"), F.concat(F.lit("u"), k.cast("string")).alias("run_uuid"), F.when(F.col("o_orderstatus") == "F", "invalid").otherwise("valid").alias("status"),
        F.when(k % 4 == 0, "attack").otherwise("normal").alias("class"), F.concat(F.lit("CVE-"), (k % 3).cast("string")).alias("cve"), F.concat(F.lit("v"), (k % 6).cast("string")).alias("variant"), F.lit(None).cast("string").alias("workload"),
    )
    return U.registry_counts(U.registry(m)).withColumn("variants", F.array_join("variants", ","))


def outcome_rollup(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "good_crash").when(F.col("event_type") == "view", "hang").when(F.col("event_type") == "error", "unknown_crash").when(F.col("event_type") == "signup", "timeout").otherwise(F.col("event_type"))
    return U.outcomes(table(spark, sf_dir, "events").select(kind.alias("outcome")))


def auc_pivot(spark, sf_dir):
    models = ["m0", "m1", "m2"]
    s = _scored(spark, sf_dir).withColumns({"tag": F.col("lang"), "model": F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string"))})
    rows = M.ranking_metrics(s, ["tag", "model"]).withColumn("roc_auc", F.round("roc_auc", 6))
    return U.auc_pivot(rows, models)


def comparison_table(spark, sf_dir):
    """A configuration and a report for each customer, as the files' texts; some reports are cut off and left out."""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    family = F.when(key % 5 != 0, F.col("c_name")).otherwise("")
    config = F.to_json(F.struct(F.concat(F.lit("model"), (key % 4).cast("string")).alias("model"), key.alias("seed"), family.alias("held_out_cve")))
    level = F.struct(F.when(key % 7 != 0, F.col("c_acctbal")).alias("roc_auc"), F.lit(0.5).alias("precision_at_threshold"), F.lit(0.25).alias("recall_at_threshold"), (F.col("c_acctbal") / 2).alias("f1_at_threshold"))
    report = F.to_json(F.struct(level.alias("run_level"), F.struct(key.alias("test_normal_runs"), F.lit(3).alias("attack_runs_total")).alias("counts")))
    report = F.when(key % 11 == 0, F.left(report, F.length(report) - 1)).otherwise(report)
    rows = lambda name, value: c.select(key.cast("string").alias("dir"), F.lit(name).alias("file"), value.alias("value"))
    return U.comparison(U.reports_of(rows(U.CONFIG_FILE, config).union(rows(U.REPORT_FILE, report))))


def trace_bounds(spark, sf_dir):
    return TR.trace_bounds(trace_events(spark, sf_dir))


def marker_intervals(spark, sf_dir):
    """Signups as starts and errors as ends, a run a user: which runs nest soundly."""
    e = table(spark, sf_dir, "events").filter("event_type IN ('signup', 'error')")
    m = e.select(F.col("user_id").cast("string").alias("run_id"), F.when(F.col("event_type") == "signup", "SPRAY_START").otherwise("SPRAY_END").alias("name"), F.col("event_id").alias("ns"), F.lit(0).alias("block"), F.col("event_id").alias("line_id"))
    return TR.validated_markers(m)


def mean_cpu(spark, sf_dir):
    return U.mean_cpu(table(spark, sf_dir, "embeddings").select(F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("usage"))).select(F.round("mean_usage", 6).alias("mean_usage"))


def slab_rates(spark, sf_dir):
    p = table(spark, sf_dir, "part").groupBy("p_size").agg(F.count("*").alias("usage"), F.max("p_partkey").alias("most"))
    out = U.slab_rates(p.select(F.col("p_size").cast("long").alias("size"), "usage"), p.select(F.col("p_size").cast("long").alias("size"), F.col("most").alias("usage")))
    return out.select("size", *[F.round(c, 6).alias(c) for c in ("idle", "busy", "idle_log", "busy_log")])


def heatmap(spark, sf_dir):
    e = W.assign(trace_events(spark, sf_dir), G)
    return e.groupBy("run_id", "start_ns").agg(F.round(X.log_count(F.count("*")), 6).alias("value"))


def scalar_buckets(spark, sf_dir):
    """Size, delta and lifetime classes of numbers that cover all bounds."""
    v = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 7 % 20000).alias("v"))
    ns = F.col("v") * 1000
    return v.distinct().select("v", *[c.cast("long").alias(n) for n, c in (("bucket", X.bucket_index(F.col("v"))), ("token_bucket", X.token_size_bucket(F.col("v"))), ("dt", X.dt_bucket(ns)), ("dt_field", X.dt_field_bucket(ns)), ("life", X.lifecycle_state(F.lit("FREE"), F.lit(False), ns)))])


def _vectors(spark, sf_dir):
    """vec_id, label and a column for each number of the longest embedding; the names of these."""
    e = table(spark, sf_dir, "embeddings")
    cols = [f"x{i}" for i in range(max(1, e.agg(F.max(F.size("embedding"))).first()[0] or 0))]
    return e.select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(cols)]), cols


def zscore_detector(spark, sf_dir):
    v, cols = _vectors(spark, sf_dir)
    return MODELS["zscore"]().fit(v.filter("label < 5"), cols).anomaly_score(v).select("vec_id", F.round("score", 5).alias("score"))


def ocsvm_detector(spark, sf_dir):
    v, cols = _vectors(spark, sf_dir)
    return MODELS["ocsvm"]().fit(v.filter("label < 5"), cols).anomaly_score(v).select("vec_id", "score")


def _normal_and_all(spark, sf_dir, item):
    t = _tokens(spark, sf_dir)
    s = Q.event_sequences(t, item)
    return s.filter("run_id NOT IN ('run_0','run_1','run_2','run_3')"), s


def markov_detector(spark, sf_dir):
    normal, every = _normal_and_all(spark, sf_dir, F.col("size_bucket"))
    scores = MODELS["markov"](g=3).fit_sequences(normal).sequence_anomaly_score(every)
    return scores.select("run_id", "chunk", F.round(C.aggregate_scores(F.col("scores"), "mean"), 6).alias("score"))


def markov_centroid_detector(spark, sf_dir):
    normal, every = _normal_and_all(spark, sf_dir, F.col("token"))
    scores = MODELS["markov_centroid"]().fit_sequences(normal).sequence_anomaly_score(every)
    return scores.select("run_id", "chunk", C.aggregate_scores(F.col("scores"), "mean").alias("score"))


def field_nll_detector(spark, sf_dir):
    normal, every = _normal_and_all(spark, sf_dir, T.fields())
    scores = MODELS["field_nll"]().fit_sequences(normal).sequence_anomaly_score(every)
    return scores.select("run_id", "chunk", C.aggregate_scores(F.col("scores"), "p90").alias("score"))


_NORMAL = "run_id NOT IN ('run_0','run_1','run_2','run_3')"
_b = lambda c, bounds: "CASE " + " ".join(f"WHEN {c} < {b} THEN {i}" for i, b in enumerate(bounds)) + f" ELSE {len(bounds)} END"
_bi = lambda c: "CASE " + " ".join(f"WHEN {c} <= {b} THEN {i}" for i, b in enumerate(S.SIZE_BUCKETS)) + f" ELSE {len(S.SIZE_BUCKETS)} END"
PROFILE = f"""sz AS (SELECT call_site, {_bi('size')} AS b, count(*) AS n FROM ev WHERE op = 'ALLOC' AND {_NORMAL} GROUP BY 1, 2), st AS (SELECT call_site, sum(n) AS t, max(n) AS m, count(*) AS k FROM sz GROUP BY 1),
pc AS (SELECT quantile_cont(t, 0.5) AS p50, quantile_cont(t, 0.8) AS p80, quantile_cont(t, 0.95) AS p95 FROM st),
pf AS (SELECT call_site, t, CASE WHEN m / t >= 0.9 AND k <= 2 THEN 0 WHEN k <= 3 THEN 1 ELSE 2 END AS bt, CASE WHEN t >= p95 THEN 0 WHEN t >= p80 THEN 1 WHEN t >= p50 THEN 2 ELSE 3 END AS fr FROM st, pc)"""
TOKENS = f"""{RE}, {PROFILE}, {RUNS}, ps AS (SELECT *, row_number() OVER w - 1 AS pos, timestamp_ns - lag(timestamp_ns) OVER w AS d FROM rx WINDOW w AS (PARTITION BY run_id ORDER BY timestamp_ns, seq)),
cc AS (SELECT *, count(*) OVER (PARTITION BY run_id, cpu ORDER BY pos RANGE BETWEEN 31 PRECEDING AND CURRENT ROW) AS same FROM ps),
fl AS (SELECT cc.run_id, pos, CASE WHEN op = 'ALLOC' THEN 0 ELSE 1 END AS op, CASE WHEN coalesce(rb, 0) > 0 THEN {_bi('rb')} ELSE 0 END AS size_bucket,
  CASE WHEN pos = 0 THEN 0 WHEN same / least(pos + 1, 32) > 0.7 THEN 0 WHEN same / least(pos + 1, 32) > 0.3 THEN 1 ELSE 2 END AS cpu_bucket, CASE WHEN crs THEN 2 WHEN rec THEN 1 ELSE 0 END AS reclaim,
  CASE WHEN op = 'ALLOC' THEN CASE WHEN rec THEN 1 ELSE 0 END WHEN life IS NULL THEN 5 ELSE 2 + ({_b('life / 1000.0', S.LIFETIME_US)}) END AS life,
  CASE WHEN d IS NULL THEN 5 ELSE {_b('d / 1000.0', S.DT_FIELD_US)} END AS dt, CASE WHEN d IS NULL THEN 3 ELSE {_b('d / 1000.0', S.DT_US)} END AS dtb, CASE WHEN d IS NULL THEN 0 ELSE ln(1 + d / 1000.0) / ln(1 + 1e9) END AS dt_cont,
  CASE WHEN is_attack AND timestamp_ns BETWEEN s0 AND s1 THEN 1 ELSE 0 END AS label, coalesce(bt, 3) AS bt, coalesce(fr, 3) AS fr FROM cc LEFT JOIN pf USING (call_site) JOIN runs USING (run_id)),
tk AS (SELECT *, ((((((op * 12 + size_bucket) * 4 + bt) * 4 + fr) * 4 + dtb) * 3 + cpu_bucket) * 3 + reclaim) AS token FROM fl)"""
CHUNK = "ck AS (SELECT *, unnest(range(greatest(0, pos // 64 - 1), pos // 64 + 1)) AS chunk FROM tk), cq AS (SELECT *, count(*) OVER (PARTITION BY run_id, chunk) AS n, pos = chunk * 64 AS head FROM ck)"
SCORED = "sc AS (SELECT d.doc_id, d.lang, d.source, CAST(d.n_chars AS DOUBLE) AS score, 1 - l.quality AS label FROM documents d JOIN labels l USING (doc_id))"


def _auc(keys: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    pre = f"{keys}, " if keys else ""
    return f"""g AS (SELECT {pre}score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS q FROM sc GROUP BY {pre}score),
c AS (SELECT *, sum(p) OVER ({part} ORDER BY score DESC) AS tp, sum(q) OVER ({part} ORDER BY score DESC) AS fp, sum(p) OVER ({part}) AS bp, sum(q) OVER ({part}) AS bn FROM g),
m AS (SELECT {pre}CASE WHEN max(bp) > 0 AND max(bn) > 0 THEN sum(q * (tp - p / 2)) / (max(bp) * max(bn)) END AS roc_auc, CASE WHEN max(bp) > 0 AND max(bn) > 0 THEN sum(p * tp / (tp + fp)) / max(bp) END AS average_precision,
  max(2 * tp / (tp + fp + bp)) AS best_f1, arg_max(score, (2 * tp / (tp + fp + bp), -score)) AS best_threshold FROM c {'GROUP BY ' + keys if keys else ''})"""


THR = "th AS (SELECT quantile_cont(score, 0.9) AS t FROM sc WHERE label = 0), fg AS (SELECT sc.*, score > t AS f FROM sc, th)"
_r = lambda c: f"round({c}, 6)"
_SPLIT = f"""SELECT stratum, split, CAST(n AS BIGINT) AS n FROM (SELECT stratum, unnest(['val', 'test', 'train']) AS split, unnest([v, t, n - v - t]) AS n FROM (SELECT stratum, n, CASE WHEN v0 + t0 >= n THEN 1 ELSE v0 END AS v, CASE WHEN v0 + t0 >= n THEN 1 ELSE t0 END AS t
  FROM (SELECT cve || '/' || sub AS stratum, count(*) AS n, greatest(1, CAST(round_even(count(*) * 0.15, 0) AS BIGINT)) AS v0, greatest(1, CAST(round_even(count(*) * 0.15, 0) AS BIGINT)) AS t0 FROM rs GROUP BY 1))) WHERE n > 0"""
_EMB = "em AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings)"

QUERIES = {
    "call_site_profiles": (call_site_profiles, f"WITH {EV}, {PROFILE} SELECT call_site, CAST(t AS BIGINT) AS total_count, CAST(bt AS BIGINT) AS behavior_type, CAST(fr AS BIGINT) AS frequency_rank FROM pf"),
    "event_tokens": (event_tokens, f"WITH {TOKENS} SELECT run_id, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in ('pos', 'token', 'op', 'size_bucket', 'cpu_bucket', 'reclaim', 'life', 'dt', 'label'))}, round(dt_cont, 6) AS dt_cont FROM tk"),
    "token_sequences": (token_sequences, f"WITH {TOKENS}, {CHUNK} SELECT run_id, chunk, CAST(CASE WHEN min(label) <> max(label) THEN -1 ELSE max(label) END AS BIGINT) AS seq_label, CAST(sum(token) AS BIGINT) AS token_sum, CAST(arg_min(token, pos) AS BIGINT) AS first_token, CAST(arg_max(token, pos) AS BIGINT) AS last_token FROM cq WHERE n = 128 GROUP BY 1, 2"),
    "event_field_sequences": (event_field_sequences, f"WITH {TOKENS}, {CHUNK} SELECT run_id, chunk, CAST(sum(CASE WHEN head THEN 5 ELSE dt END) AS BIGINT) AS dt_sum, CAST(sum(life) AS BIGINT) AS life_sum, CAST(5 AS BIGINT) AS first_dt, CAST(0 AS DOUBLE) AS first_dt_cont FROM cq WHERE n = 128 GROUP BY 1, 2"),
    "call_site_slots": (call_site_slots, None),
    "scaler_fit": (scaler_fit, f"SELECT {', '.join(f'round(avg({c}), 4) AS mean_{c}' for c in LINE)}, {', '.join(f'round(stddev_pop({c}), 4) AS std_{c}' for c in LINE)} FROM lineitem"),
    "scaled_rows": (scaled_rows, f"WITH s AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in LINE)} FROM lineitem) SELECT l_linenumber, count(*) AS n, {', '.join(f'round(max(({c} - m_{c}) / s_{c}), 4) AS max_{c}' for c in LINE)} FROM lineitem, s GROUP BY 1"),
    "score_aggregation": (score_aggregation, f"WITH {_EMB} SELECT vec_id, round(e[-1], 6) AS last, round(list_max(e), 6) AS max, round(list_avg(e), 6) AS mean, round(list_aggregate(e, 'quantile_cont', 0.9), 6) AS p90, round(list_avg(list_reverse_sort(e)[1:8]), 6) AS topk8 FROM em"),
    "ranking_metrics": (ranking_metrics, f"WITH {SCORED}, {_auc('')} SELECT {_r('roc_auc')} AS roc_auc, {_r('average_precision')} AS average_precision, {_r('best_f1')} AS best_f1, best_threshold FROM m"),
    "ranking_by_lang": (ranking_by_lang, f"WITH {SCORED}, {_auc('lang')} SELECT lang, {_r('roc_auc')} AS roc_auc, {_r('average_precision')} AS average_precision FROM m"),
    "run_threshold": (run_threshold, f"WITH {SCORED}, r AS (SELECT source, max(score) AS s FROM sc WHERE label = 0 GROUP BY 1) SELECT round(quantile_cont(s, 0.75), 6) AS threshold FROM r"),
    "run_max_scores": (run_max_scores, f"WITH {SCORED} SELECT source AS run_id, max(score) AS score FROM sc GROUP BY 1"),
    "classification": (classification, f"WITH {SCORED}, {THR}, k AS (SELECT count(*) FILTER (f AND label = 1) AS tp, count(*) FILTER (f AND label <> 1) AS fp, count(*) FILTER (NOT f AND label = 1) AS fn, count(*) FILTER (NOT f AND label <> 1) AS tn FROM fg) SELECT {_r('coalesce(tp / nullif(tp + fp, 0), 0)')} AS precision, {_r('coalesce(tp / nullif(tp + fn, 0), 0)')} AS recall, {_r('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)')} AS f1, {_r('coalesce(fp / nullif(fp + tn, 0), 0)')} AS fpr, tp + fp AS n_flagged, tp + fp + fn + tn AS n FROM k"),
    "grouped_flags": (grouped_flags, f"WITH {SCORED}, {THR} SELECT lang, source, count(*) AS runs_total, count(*) FILTER (f) AS n_flagged, {_r('count(*) FILTER (f) / count(*)')} AS detection_rate FROM fg GROUP BY ROLLUP (lang, source)"),
    "bootstrap_ci": (bootstrap, None),
    "calibration": (calibration, f"SELECT {', '.join(f'round(avg({c}), 3) AS mean_{c}, round(stddev_pop({c}), 3) AS std_{c}' for c in LINE[:2])} FROM lineitem"),
    "run_metadata": (run_metadata, f"WITH {RUNS_SQL} SELECT run_id, class, cve, CASE WHEN class = 'attack' THEN sub END AS variant, CASE WHEN class = 'normal' THEN sub END AS workload FROM rs"),
    "control_families": (control_families, f"WITH {RUNS_SQL} SELECT {_FAM} AS family, count(*) AS n FROM rs GROUP BY 1"),
    "run_strata": (run_strata, f"WITH {RUNS_SQL} SELECT cve || '/' || sub AS stratum, count(*) AS n FROM rs GROUP BY 1"),
    "stratified_split": (stratified_split, f"WITH {RUNS_SQL} {_SPLIT}"),
    "cross_family_split": (cross_family_split, f"WITH {RUNS_SQL} SELECT role, count(*) AS n FROM (SELECT CASE WHEN class = 'attack' AND cve IN ('CVE-2017-1001', 'CVE-2017-1002') THEN 'eval_attack' WHEN class = 'normal' AND {_FAM} <> 'normal' THEN {_FAM} END AS role FROM rs) WHERE role IS NOT NULL GROUP BY 1"),
    "leave_one_out": (leave_one_out, f"WITH {RUNS_SQL} SELECT CASE WHEN class = 'attack' AND cve = 'CVE-2017-1002' THEN 'held_out' ELSE 'pool' END AS role, count(*) AS n FROM rs GROUP BY 1"),
    "set_operations": (set_operations, f"WITH {RUNS_SQL} SELECT 'both' AS op, count(*) AS n FROM rs WHERE k % 6 = 0 UNION ALL SELECT 'semi', count(*) FROM rs WHERE k % 6 = 0 UNION ALL SELECT 'only_first', count(*) FROM rs WHERE k % 2 = 0 AND k % 3 <> 0 UNION ALL SELECT 'union', count(*) FILTER (k % 2 = 0) + count(*) FILTER (k % 3 = 0) FROM rs"),
    "gate_report": (gate_report, f"WITH {WN}, w AS (SELECT sp.run_id, sp.start_ns, CASE WHEN x.n IS NULL THEN 1.0 ELSE 0.0 END AS e, CASE WHEN sp.run_id IN ('run_0','run_1','run_2','run_3') THEN 'a' ELSE 'n' END AS c FROM sp LEFT JOIN (SELECT run_id, start_ns, count(*) AS n FROM wn GROUP BY 1, 2) x USING (run_id, start_ns)), r AS (SELECT run_id, c, count(*) AS n, avg(e) AS e FROM w GROUP BY 1, 2), s AS (SELECT min(n) FILTER (c='a') AS la, max(n) FILTER (c='a') AS ha, min(n) FILTER (c='n') AS ln, max(n) FILTER (c='n') AS hn, min(e) FILTER (c='a') AS ea, max(e) FILTER (c='a') AS fa, min(e) FILTER (c='n') AS en, max(e) FILTER (c='n') AS fn FROM r) SELECT 'no_cross_run' AS name, 'pass' AS status UNION ALL SELECT 'marker_success', CASE WHEN 1 - 1 / count(DISTINCT run_id) >= 0.95 THEN 'pass' ELSE 'FAIL' END FROM w UNION ALL SELECT 'empty_windows', CASE WHEN min(a) > 0 THEN 'pass' ELSE 'FAIL' END FROM (SELECT avg(e) AS a FROM w GROUP BY c) UNION ALL SELECT 'no_shortcut', CASE WHEN la < hn AND ln < ha AND ea < fn AND en < fa THEN 'pass' ELSE 'FAIL' END FROM s UNION ALL SELECT 'disjoint_split', 'pass' UNION ALL SELECT 'end_to_end', 'pass'"),
    "target_bucket": (target_buckets, f"WITH {WN}, {RUNS}, {LABEL}, h AS (SELECT l.run_id, max(CASE WHEN x.n > 0 THEN 1 ELSE 0 END) AS hit FROM lw l LEFT JOIN (SELECT run_id, start_ns, count(*) AS n FROM wn WHERE op = 'ALLOC' AND bucket = 9 GROUP BY 1, 2) x USING (run_id, start_ns) WHERE label = 1 GROUP BY 1) SELECT 'target_bucket' AS name, min(hit) >= 0.8 AS ok FROM h"),
    "run_registry": (run_registry, "WITH m AS (SELECT o_orderkey % 5000 AS k, CASE WHEN o_orderstatus = 'F' THEN 'invalid' ELSE 'valid' END AS status FROM orders), r AS (SELECT k, min(status) AS status FROM m GROUP BY 1) SELECT 'CVE-' || (k % 3) AS cve, CASE WHEN k % 4 = 0 THEN 'attack' ELSE 'normal' END AS class, count(*) AS total, count(*) FILTER (status = 'valid') AS valid, count(*) FILTER (status <> 'valid') AS invalid, array_to_string(list_sort(list_distinct(list('v' || (k % 6)))), ',') AS variants FROM r GROUP BY 1, 2"),
    "outcome_rollup": (outcome_rollup, "SELECT CASE event_type WHEN 'click' THEN 'success' WHEN 'error' THEN 'panic' WHEN 'view' THEN 'timeout' WHEN 'signup' THEN 'timeout' ELSE event_type END AS outcome, count(*) AS n FROM events GROUP BY 1"),
    "auc_pivot": (auc_pivot, f"WITH {SCORED.replace('d.doc_id,', 'd.doc_id, d.lang || chr(47) || (d.doc_id % 3) AS tm,')}, {_auc('tm')} SELECT split_part(tm, '/', 1) AS tag, {', '.join(f'max(round(roc_auc, 6)) FILTER (split_part(tm, chr(47), 2) = {chr(39)}{i}{chr(39)}) AS m{i}' for i in range(3))} FROM m GROUP BY 1"),
    "comparison_table": (comparison_table, "SELECT 'model' || (c_custkey % 4) AS model, CAST(c_custkey AS VARCHAR) AS seed, CASE WHEN c_custkey % 5 = 0 THEN '-' ELSE c_name END AS held_out_cve, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE printf('%.4f', c_acctbal) END AS run_auc, '0.5000' AS run_precision, '0.2500' AS run_recall, printf('%.4f', c_acctbal / 2) AS run_f1, '' AS run_fpr, CAST(c_custkey AS VARCHAR) AS test_normal_runs, '3' AS attack_runs_total, '' AS attack_runs_no_spray_sequence FROM customer WHERE c_custkey % 11 <> 0"),
    "trace_bounds": (trace_bounds, f"WITH {EV} SELECT run_id, arg_min(timestamp_ns, seq) AS first_ns, arg_max(timestamp_ns, seq) AS last_ns FROM ev GROUP BY 1"),
    "marker_intervals": (marker_intervals, "WITH m AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS ns, CASE WHEN event_type = 'signup' THEN 1 ELSE -1 END AS s FROM events WHERE event_type IN ('signup', 'error') AND event_id % 40 < 8), d AS (SELECT *, sum(s) OVER w AS depth, max(CASE WHEN s = 1 THEN ns END) OVER w AS opened FROM m WINDOW w AS (PARTITION BY run_id ORDER BY ns)) SELECT run_id, min(depth) >= 0 AND arg_max(depth, ns) = 0 AND arg_min(s, ns) = 1 AND arg_max(s, ns) = -1 AND count(*) FILTER (s = -1 AND NOT coalesce(ns > opened, false)) = 0 AS ok, min(ns) AS start_ns, max(ns) AS end_ns, CASE WHEN arg_max(s, ns) = 1 THEN 'SPRAY_START' ELSE 'SPRAY_END' END AS last_name FROM d GROUP BY 1"),
    "mean_cpu": (mean_cpu, "SELECT round(sum(list_sum([abs(CAST(x AS DOUBLE)) FOR x IN embedding])) / (count(*) * 4), 6) AS mean_usage FROM embeddings"),
    "slab_rates": (slab_rates, "WITH p AS (SELECT CAST(p_size AS BIGINT) AS size, count(*) / 3600.0 / 4 AS idle, max(p_partkey) / 3600.0 / 4 AS busy FROM part GROUP BY 1) SELECT size, round(idle, 6) AS idle, round(busy, 6) AS busy, round(ln(idle), 6) AS idle_log, round(ln(busy), 6) AS busy_log FROM p"),
    "heatmap": (heatmap, f"WITH {WN} SELECT start_ns, round(log10(1 + count(*)), 6) AS value FROM wn WHERE run_id = 'run_1' GROUP BY 1"),
    "scalar_buckets": (scalar_buckets, f"WITH v AS (SELECT DISTINCT l_orderkey * 7 % 20000 AS v FROM lineitem) SELECT v, CAST({_bi('v')} AS BIGINT) AS bucket, CAST(CASE WHEN v > 0 THEN {_bi('v')} ELSE 0 END AS BIGINT) AS token_bucket, CAST({_b('v', S.DT_US)} AS BIGINT) AS dt, CAST({_b('v', S.DT_FIELD_US)} AS BIGINT) AS dt_field, CAST(2 + ({_b('v', S.LIFETIME_US)}) AS BIGINT) AS life FROM v"),
    "zscore_detector": (zscore_detector, f"WITH {_EMB}, s AS (SELECT {', '.join(f'avg(e[{i + 1}]) AS m{i}, stddev_pop(e[{i + 1}]) AS s{i}' for i in range(8))} FROM em WHERE label < 5) SELECT vec_id, round(({' + '.join(f'pow((e[{i + 1}] - m{i}) / s{i}, 2)' for i in range(8))}) / 8, 5) AS score FROM em, s"),
    "markov_detector": (markov_detector, f"WITH {TOKENS}, {CHUNK}, pr AS (SELECT run_id, chunk, pos, size_bucket AS cur, lag(size_bucket) OVER (PARTITION BY run_id, chunk ORDER BY pos) AS prev FROM cq WHERE n = 128), ct AS (SELECT prev, cur, count(*) AS n FROM pr WHERE prev IS NOT NULL AND {_NORMAL} GROUP BY 1, 2), tp AS (SELECT prev, cur FROM ct QUALIFY row_number() OVER (PARTITION BY prev ORDER BY n DESC, cur) <= 3) SELECT pr.run_id, pr.chunk, round(avg(CASE WHEN pr.prev IS NULL OR tp.cur IS NOT NULL THEN 0.0 ELSE 1.0 END), 6) AS score FROM pr LEFT JOIN tp USING (prev, cur) GROUP BY 1, 2"),
    "ocsvm_detector": (ocsvm_detector, None),
    "markov_centroid_detector": (markov_centroid_detector, None),
    "field_nll_detector": (field_nll_detector, None),
}
