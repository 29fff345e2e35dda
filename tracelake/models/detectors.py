"""Detectors of anomalous windows and sequences, and a registry of them.

``ocsvm``: a one-class support vector machine; ``zscore``: distance from the training mean; ``markov``: rank of the next
token after its predecessor; ``markov_centroid``: the same and the distance of a sequence's token histogram from the
training centroid; ``field_nll``: calibrated surprise of each event field. The sequence models are count-based: they keep the
interfaces, score algebra, weights and thresholds of next-event models, not a neural network's numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.scoring import calibration, fit_scaler

#: Rows that the support vector machine is fitted on, at most; chosen by hash.
FIT_ROWS = 2000
# Weights of the fields' surprise, and how each model's scores are aggregated by default.
WEIGHTS = {"op": 0.05, "size_bucket": 0.25, "csrep": 0.15, "cpu_bucket": 0.05, "reclaim": 0.05, "life": 0.20, "dt": 0.25}


class ZScore:
    """Mean squared z-score of a window."""

    def fit(self, df: DataFrame, columns: list[str]) -> "ZScore":
        self.columns, self.scaler = columns, fit_scaler(df, columns)
        return self

    def anomaly_score(self, df: DataFrame) -> DataFrame:
        out = df.join(F.broadcast(self.scaler))
        z = [F.pow((F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}"), F.lit(2)) for c in self.columns]
        total = z[0]
        for x in z[1:]:
            total = total + x
        return out.withColumn("score", total / len(z)).drop(*self.scaler.columns)


@dataclass
class OneClassSVM:
    """RBF one-class machine on z-scored columns, gamma 1 / (columns * variance), fitted by pairwise ascent on a bounded sample."""

    nu: float = 0.05
    rounds: int = 20_000
    fit_rows: int = FIT_ROWS
    columns: list[str] = field(default_factory=list)

    def fit(self, df: DataFrame, columns: list[str]) -> "OneClassSVM":
        self.columns = columns
        s = fit_scaler(df, columns).first()
        self.mean = np.array([s[f"mean_{c}"] for c in columns], float)
        self.std = np.array([s[f"std_{c}"] for c in columns], float)
        rows = df.select(*columns).orderBy(F.xxhash64(*columns)).limit(self.fit_rows).toPandas().to_numpy(float)
        x = (rows - self.mean) / self.std
        self.gamma = 1.0 / (x.shape[1] * max(x.var(), 1e-12))
        n = len(x)
        kernel = np.exp(-self.gamma * ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)) if n * n * x.shape[1] < 5e7 else np.stack([np.exp(-self.gamma * ((x - r) ** 2).sum(1)) for r in x])
        cap = 1.0 / (self.nu * n)
        alpha = np.zeros(n)
        whole = int(self.nu * n)
        alpha[:whole] = cap
        if whole < n:
            alpha[whole] = 1.0 - alpha.sum()
        grad = kernel @ alpha
        for _ in range(self.rounds):
            up, down = np.where(alpha < cap - 1e-12, grad, np.inf), np.where(alpha > 1e-12, grad, -np.inf)
            i, j = int(up.argmin()), int(down.argmax())
            if grad[j] - grad[i] < 1e-6:
                break
            step = (grad[j] - grad[i]) / max(kernel[i, i] + kernel[j, j] - 2 * kernel[i, j], 1e-12)
            step = min(step, cap - alpha[i], alpha[j])
            alpha[i] += step
            alpha[j] -= step
            grad += step * (kernel[:, i] - kernel[:, j])
        keep = alpha > 1e-12
        self.vectors, self.alpha = x[keep], alpha[keep]
        return self

    def score_array(self, rows: np.ndarray) -> np.ndarray:
        """Minus the decision values; higher is stranger."""
        x = (rows - self.mean) / self.std
        out = np.empty(len(x))
        for at in range(0, len(x), 4096):
            own = x[at : at + 4096]
            d = (own * own).sum(1)[:, None] + (self.vectors * self.vectors).sum(1)[None, :] - 2 * own @ self.vectors.T
            out[at : at + 4096] = -(np.exp(-self.gamma * np.maximum(d, 0)) @ self.alpha)
        return out

    def anomaly_score(self, df: DataFrame) -> DataFrame:
        @F.pandas_udf("double")
        def score(rows: pd.Series) -> pd.Series:
            return pd.Series(self.score_array(np.stack(rows.to_list())) if len(rows) else np.zeros(0))

        return df.withColumn("score", score(F.array(*[F.col(c).cast("double") for c in self.columns])))

    def save(self, path: str) -> None:
        np.savez(path, mean=self.mean, std=self.std, gamma=self.gamma, vectors=self.vectors, alpha=self.alpha, columns=np.array(self.columns), nu=self.nu)

    @classmethod
    def load(cls, path: str) -> "OneClassSVM":
        z = np.load(path, allow_pickle=False)
        out = cls(nu=float(z["nu"]), columns=z["columns"].tolist())
        out.mean, out.std, out.gamma, out.vectors, out.alpha = z["mean"], z["std"], float(z["gamma"]), z["vectors"], z["alpha"]
        return out


def _pairs(sequences: DataFrame, value) -> DataFrame:
    """Positions of sequences: run_id, chunk, pos, prev, cur."""
    rows = sequences.select("run_id", "chunk", F.posexplode("items").alias("pos", "x"))
    cur = value(F.col("x"))
    prev = F.lag("cur").over(Window.partitionBy("run_id", "chunk").orderBy("pos"))
    return rows.withColumn("cur", cur).withColumn("prev", prev)


class Markov:
    """Violation where the next token is not among the ``g`` most frequent successors of its predecessor; first positions are 0."""

    def __init__(self, g: int = 10):
        self.g = g

    def fit_sequences(self, sequences: DataFrame) -> "Markov":
        counts = _pairs(sequences, lambda x: x).filter("prev is not null").groupBy("prev", "cur").agg(F.count("*").alias("n"))
        place = F.row_number().over(Window.partitionBy("prev").orderBy(F.desc("n"), "cur"))
        self.top = counts.withColumn("k", place).filter(F.col("k") <= self.g).select("prev", "cur", F.lit(True).alias("known"))
        return self

    def positions(self, sequences: DataFrame) -> DataFrame:
        rows = _pairs(sequences, lambda x: x).join(self.top, ["prev", "cur"], "left")
        return rows.withColumn("score", F.when(F.col("prev").isNull() | F.col("known"), 0.0).otherwise(1.0)).select("run_id", "chunk", "pos", "cur", "score")

    def sequence_anomaly_score(self, sequences: DataFrame) -> DataFrame:
        """run_id, chunk, scores: an array by position."""
        return _arrays(self.positions(sequences))


def _arrays(positions: DataFrame) -> DataFrame:
    return positions.groupBy("run_id", "chunk").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "score"))), lambda x: x["score"]).alias("scores"))


class MarkovCentroid(Markov):
    """Violation plus ``weight`` times the distance of the sequence's token shares from the training mean, over its 99th percentile, at most 1."""

    def __init__(self, g: int = 10, weight: float = 0.3):
        super().__init__(g)
        self.weight = weight

    def _shares(self, sequences: DataFrame) -> DataFrame:
        rows = sequences.select("run_id", "chunk", F.size("items").alias("m"), F.explode("items").alias("cur"))
        return rows.groupBy("run_id", "chunk", "cur").agg((F.count("*") / F.max("m")).alias("s"))

    def _distance(self, sequences: DataFrame) -> DataFrame:
        # |s - c|^2 = |c|^2 + sum over the sequence's own tokens of (s - c)^2 - c^2
        own = self._shares(sequences).join(self.centroid, "cur", "left").withColumn("c", F.coalesce("c", F.lit(0.0)))
        part = own.groupBy("run_id", "chunk").agg(F.sum((F.col("s") - F.col("c")) * (F.col("s") - F.col("c")) - F.col("c") * F.col("c")).alias("d"))
        return part.join(F.broadcast(self.norm)).select("run_id", "chunk", F.sqrt(F.greatest(F.col("d") + F.col("norm"), F.lit(0.0))).alias("d"))

    def fit_sequences(self, sequences: DataFrame) -> "MarkovCentroid":
        super().fit_sequences(sequences)
        n = sequences.count()
        self.centroid = self._shares(sequences).groupBy("cur").agg((F.sum("s") / n).alias("c"))
        self.norm = self.centroid.agg(F.coalesce(F.sum(F.col("c") * F.col("c")), F.lit(0.0)).alias("norm"))
        self.scale = self._distance(sequences).agg(F.greatest(F.percentile("d", F.lit(0.99)), F.lit(1e-12)).alias("p99"))
        return self

    def positions(self, sequences: DataFrame) -> DataFrame:
        far = self._distance(sequences).join(F.broadcast(self.scale)).select("run_id", "chunk", F.least(F.col("d") / F.col("p99"), F.lit(1.0)).alias("far"))
        return super().positions(sequences).join(far, ["run_id", "chunk"]).withColumn("score", F.col("score") + self.weight * F.col("far")).drop("far")


class FieldNLL:
    """Weighted sum of the surprise of each field of the next event given the field's last value, as z-scores of normal data cut at 0.

    Surprise is minus the logarithm of a smoothed conditional frequency; csrep is whether the call site repeats.
    """

    smoothing = 0.5

    def _rows(self, sequences: DataFrame) -> DataFrame:
        rows = sequences.select("run_id", "chunk", F.posexplode("items").alias("pos", "x"))
        by = Window.partitionBy("run_id", "chunk").orderBy("pos")
        out = {}
        for name in WEIGHTS:
            own = (F.col("x.cs") == F.lag("x.cs").over(by)).cast("int") if name == "csrep" else F.col(f"x.{name}")
            out[name] = own
        rows = rows.withColumns(out)
        return rows.withColumns({f"prev_{n}": F.lag(n).over(by) for n in WEIGHTS})

    def fit_sequences(self, sequences: DataFrame) -> "FieldNLL":
        rows = self._rows(sequences).filter("pos > 0").persist()
        self.tables = {}
        for n in WEIGHTS:
            pair = rows.groupBy(F.coalesce(f"prev_{n}", F.lit(-1)).alias(f"prev_{n}"), n).agg(F.count("*").alias("k"))
            total, kinds = F.sum("k").over(Window.partitionBy(f"prev_{n}")), 16
            # fields have at most a dozen values, so a table has at most a few hundred rows
            self.tables[n] = pair.select(f"prev_{n}", n, (-F.ln((F.col("k") + self.smoothing) / (total + self.smoothing * kinds))).alias(f"nll_{n}"))
        self.floor = math.log(2 * 16.0 * 1000)
        self.stats = calibration(self._surprise(rows), [f"nll_{n}" for n in WEIGHTS]).first()
        rows.unpersist()
        return self

    def _surprise(self, rows: DataFrame) -> DataFrame:
        for n, t in self.tables.items():
            rows = rows.withColumn(f"prev_{n}", F.coalesce(f"prev_{n}", F.lit(-1))).join(F.broadcast(t), [f"prev_{n}", n], "left").withColumn(f"nll_{n}", F.coalesce(f"nll_{n}", F.lit(self.floor)))
        return rows

    def sequence_anomaly_score(self, sequences: DataFrame) -> DataFrame:
        rows = self._surprise(self._rows(sequences))
        total: Column = F.lit(0.0)
        for n, w in WEIGHTS.items():
            total = total + w * F.greatest((F.col(f"nll_{n}") - self.stats[f"mean_nll_{n}"]) / self.stats[f"std_nll_{n}"], F.lit(0.0))
        return _arrays(rows.withColumn("score", F.when(F.col("pos") == 0, 0.0).otherwise(total)))


AGGREGATION = {"ocsvm": "max", "zscore": "max", "markov": "mean", "markov_centroid": "mean", "field_nll": "p90"}
MODELS = {"ocsvm": OneClassSVM, "zscore": ZScore, "markov": Markov, "markov_centroid": MarkovCentroid, "field_nll": FieldNLL}
