"""Quality by hierarchical empirical Bayes: a document classifier and site posteriors.

A classifier over words and shape features is fitted on a bounded sample of labelled rows; it keeps the features
whose association with the label is beyond chance. Features are not independent, so a ridge logistic regression
weighs them together; all weights of a document's features are summed. Sites have two levels, host and path. The
labelled counts of a host are a beta-binomial sample around the global rate, those of a path around its host's
posterior; the prior's strength is a moment estimate from the sites' spread, so sparse sites shrink to
what is above them and large ones keep their own rate. A document's log-odds are the classifier's evidence
plus what its path's posterior adds to the global rate. Counts and posteriors come from all labelled rows by
grouped aggregation.

Defined results: a null text has no words; null hosts or paths form sites of their own; of several labels of one
id the most frequent value counts (ties: 1); without labels all evidence is 0 and all rates one half; repeated rows
each get a row; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import byte_chunks, materialise, table, text_of

#: Labelled rows that the classifier is fitted on, at most; those with the smallest hashes of their ids.
FIT_ROWS = 20_000
#: Features that the classifier keeps, at most; the strongest.
FEATURES = 5_000
Z = 6.0
SUPPORT = 8
#: Ridge of the logistic fit, and its steps at most.
RIDGE = 0.02
FIT_STEPS = 500
#: Site rows that may be broadcast (about 100 bytes each); beyond, the join shuffles.
BROADCAST_SITES = 200_000
CHUNK_BYTES = 2 << 20
_WORD = re.compile(r"[^\W\d_]+")
_SYMBOLS = str.maketrans("", "", "#*$%&|<>")


def features(text: str) -> set[str]:
    """Lower-cased words, and shapes: shares of symbols, capitals, exclamation marks and distinct words in eighths."""
    found = _WORD.findall(text)
    n, chars = len(found), max(1, len(text))
    out = set(map(str.lower, found))
    tokens = text.split()
    m = max(1, len(tokens))
    share = lambda a, b: min(8, int(8 * a / b))
    letters = max(1, sum(map(len, found)))
    out |= {
        f"/symbols/{share(len(text) - len(text.translate(_SYMBOLS)), m)}", f"/capitals/{share(sum(w.isupper() and len(w) or 0 for w in found), letters)}",
        f"/shouts/{share(text.count('!'), m)}", f"/distinct/{share(len(set(tokens)), m)}", f"/letters/{share(letters, chars)}", f"/words/{min(4, n.bit_length() // 2)}",
    }
    return out


def logistic(bits: np.ndarray, y: np.ndarray, count: int, start: float) -> tuple[float, np.ndarray]:
    """Offset and weights of a ridge logistic fit on rows of ``count`` packed feature bits, by accelerated gradients from ``start``."""
    def blocks() -> Iterator[tuple[slice, np.ndarray]]:
        for at in range(0, len(bits), 2048):
            own = np.unpackbits(bits[at : at + 2048], axis=1, count=count).astype(np.float32)
            yield slice(at, at + 2048), np.hstack([np.ones((len(own), 1), np.float32), own])

    ridge = np.append(0.0, np.full(count, RIDGE))
    v = np.ones(count + 1, np.float32)
    for _ in range(20):  # the steepest curvature
        v = sum(x.T @ (x @ v) for _, x in blocks())
        v, top = v / np.linalg.norm(v), np.linalg.norm(v)
    step = 1 / (0.26 * top + RIDGE)
    w = ahead = np.append(start, np.zeros(count))
    t = 1.0
    for _ in range(FIT_STEPS):
        slope = ridge * ahead
        for rows, x in blocks():
            slope = slope + x.T @ (1 / (1 + np.exp(-np.clip(x @ ahead.astype(np.float32), -50, 50))) - y[rows]).astype(np.float32)
        new = ahead - step * slope
        if (ahead - new) @ (new - w) > 0:  # overshot: begin the acceleration anew
            t = 1.0
        grown = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / grown * (new - w), new, grown
        if np.abs(slope).max() < 1e-5 * len(y):
            break
    return float(w[0]), w[1:]


def _fit(docs: DataFrame, labels: DataFrame, target: str, keep: int) -> tuple[float, dict[str, float]]:
    """Offset of the log-odds and the weights of the features that are tied to ``target`` (docs: id, text; labels: id, target)."""
    chosen = labels.select("id", target).orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS)
    rows = docs.join(F.broadcast(chosen), "id")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in byte_chunks(batches, "text", CHUNK_BYTES):
            counts: dict[str, list[int]] = {}
            for text, y in zip(chunk.column("text").to_pylist(), chunk.column(target).to_pylist()):
                for f in (*features(text), ""):
                    counts.setdefault(f, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], names=["f", "no", "yes"])

    counted = rows.select("text", F.col(target).cast("int").alias(target)).mapInArrow(explode, "f string, no long, yes long").groupBy("f").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
    counted = materialise(counted, "classifier-counts")
    whole = counted.filter("f = ''").first()
    if whole is None or not whole["no"] or not whole["yes"]:
        return 0.0, {}
    n0, n1 = whole["no"], whole["yes"]
    share = (F.col("no") + F.col("yes")) / (n0 + n1)
    z = (F.col("yes") / n1 - F.col("no") / n0) / F.sqrt(share * (1 - share) * (1 / n0 + 1 / n1))
    best = counted.filter("f <> ''").filter((F.col("no") + F.col("yes") >= SUPPORT) & (share < 1)).withColumn("z", F.abs(z)).filter(F.col("z") >= Z).orderBy(F.desc("z"), "f").limit(keep)
    place = {r["f"]: i for i, r in enumerate(best.collect())}
    if not place:
        return math.log(n1 / n0), {}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in byte_chunks(batches, "text", CHUNK_BYTES):
            bits = np.zeros((chunk.num_rows, len(place)), bool)
            for row, text in zip(bits, chunk.column("text").to_pylist()):
                row[[place[x] for x in features(text) & place.keys()]] = True
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in np.packbits(bits, axis=1)], pa.binary()), chunk.column(target)], names=["b", "y"])

    packed = rows.select("text", F.col(target).cast("int").alias(target)).mapInArrow(pack, "b binary, y int").orderBy("b", "y").toArrow()  # FIT_ROWS rows of FEATURES bits
    bits = np.frombuffer(b"".join(packed["b"].to_pylist()), np.uint8).reshape(packed.num_rows, -1)
    offset, w = logistic(bits, packed["y"].to_numpy().astype(float), len(place), math.log(n1 / n0))
    return offset, dict(zip(place, w.tolist()))


def _shrunk(rows: DataFrame, keys: list[str], yes: str, above: str, strength: float, name: str) -> DataFrame:
    return rows.withColumn(name, (F.col(yes) + F.col(above) * strength) / (F.col("n") + strength))


def _strength(rows: DataFrame, yes: str, rate) -> float:
    """Prior strength of a beta-binomial around ``rate`` by moments, between 1 and 1e6, from all sites."""
    p = F.col(yes) / F.col("n")
    r = rows.filter("n >= 2").agg(
        F.sum(F.col("n") * (p - rate) * (p - rate)).alias("spread"), F.sum(rate * (1 - rate)).alias("inside"), F.sum(F.col("n") * rate * (1 - rate)).alias("total")
    ).first()
    if r["spread"] is None or not r["total"]:
        return 1.0
    excess = (r["spread"] - r["inside"]) / max(1e-12, r["total"] - r["inside"])
    return min(1e6, max(1.0, 1 / excess - 1)) if excess > 0 else 1e6


def site_rates(sites: DataFrame, target: str) -> tuple[DataFrame, DataFrame, float]:
    """(host, path, rate) of every labelled path, (h, host_rate) of every labelled host and the global rate; ``sites``: host, path, target of labelled rows."""
    by_path = materialise(sites.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(target).alias("yes")), "site-paths")
    whole = by_path.agg(F.sum("n").alias("n"), F.sum("yes").alias("yes")).first()
    top = (whole["yes"] + 0.5) / (whole["n"] + 1) if whole["n"] else 0.5
    by_host = by_path.groupBy("host").agg(F.sum("n").alias("n"), F.sum("yes").alias("yes"))
    hosts = _shrunk(by_host.withColumn("top", F.lit(top)), ["host"], "yes", "top", _strength(by_host, "yes", F.lit(top)), "host_rate").select(F.col("host").alias("h"), "host_rate")
    hosts = materialise(hosts, "site-host-rates")
    paths = materialise(by_path.join(hosts, F.col("host").eqNullSafe(F.col("h"))), "site-hosts")
    return _shrunk(paths, ["host", "path"], "yes", "host_rate", _strength(paths, "yes", F.col("host_rate")), "rate").select("host", "path", "rate"), hosts, top


def score(docs: DataFrame, labels: DataFrame, targets: tuple[str, ...] = ("quality", "toxic"), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", features_kept: int = FEATURES) -> DataFrame:
    """id, and for each target the classifier's log-odds ``<t>_evidence``, the path's rate ``<t>_site`` and the posterior ``<t>_posterior``."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"))
    voted = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*[(F.avg(t) >= 0.5).cast("int").alias(t) for t in targets])
    voted = materialise(voted, "labels")
    models = [_fit(rows.select("id", "text"), voted.filter(F.col(t).isNotNull()), t, features_kept) for t in targets]
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [(prior, w, w.keys()) for prior, w in shared.value]
        for chunk in byte_chunks(batches, "text", CHUNK_BYTES):
            out: list[list[float]] = [[] for _ in own]
            for text in chunk.column("text").to_pylist():
                f = features(text)
                for col, (prior, w, keys) in zip(out, own):
                    col.append(prior + math.fsum(w[x] for x in f & keys))
            yield pa.RecordBatch.from_arrays([*(chunk.column(c) for c in ("id", "host", "path")), *map(pa.array, out)], names=["id", "host", "path", *(f"e{k}" for k in range(len(own)))])

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(judge, f"id {kind}, host string, path string, " + ", ".join(f"e{k} double" for k in range(len(targets))))
    labelled = rows.select("id", "host", "path").join(voted, "id")
    columns = [F.col("id").alias(id_col)]
    for k, t in enumerate(targets):
        rates, hosts, top = site_rates(labelled.filter(F.col(t).isNotNull()).select("host", "path", t), t)
        rates = rates.select(F.col("host").alias(f"h{k}"), F.col("path").alias(f"p{k}"), F.col("rate").alias(f"rate{k}"))
        rates = F.broadcast(rates) if rates.count() <= BROADCAST_SITES else rates
        found = found.join(rates, F.col("host").eqNullSafe(F.col(f"h{k}")) & F.col("path").eqNullSafe(F.col(f"p{k}")), "left")
        hosts = hosts.select(F.col("h").alias(f"hh{k}"), F.col("host_rate").alias(f"host_rate{k}"))
        hosts = F.broadcast(hosts) if hosts.count() <= BROADCAST_SITES else hosts
        found = found.join(hosts, F.col("host").eqNullSafe(F.col(f"hh{k}")), "left")
        # a path without labels has its host's posterior
        rate = F.coalesce(F.col(f"rate{k}"), F.col(f"host_rate{k}"), F.lit(top))
        logit = lambda p: F.ln(p / (1 - p))
        shift = logit(F.least(F.greatest(rate, F.lit(1e-6)), F.lit(1 - 1e-6))) - math.log(top / (1 - top))
        columns += [F.col(f"e{k}").alias(f"{t}_evidence"), rate.alias(f"{t}_site"), (1 / (1 + F.exp(-(F.col(f"e{k}") + shift)))).alias(f"{t}_posterior")]
    return found.select(*columns)


def op3_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    good, toxic = F.col("quality_posterior") >= 0.5, F.col("toxic_posterior") >= 0.5
    return found.withColumns({"is_quality": good, "is_toxic": toxic, "kept": good & ~toxic})
