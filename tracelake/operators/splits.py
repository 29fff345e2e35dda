"""Whole-run splits: stratified, across families, one family left out; set operations between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.scalars import control_family, run_stratum


def stratified_split(runs: DataFrame, seed: int = 42, val: float = 0.15, test: float = 0.15) -> DataFrame:
    """``runs`` (run_id) with stratum and split (train, val, test): in each stratum, in an order hashed from the seed, the first go
    to val and test. Shares are rounded half to even, at least one; where both would take all, one each. A stratum of fewer
    than three runs raises."""
    own = runs.select("run_id", run_stratum(F.col("run_id")).alias("stratum")).distinct()
    part = Window.partitionBy("stratum")
    n = F.count("*").over(part)
    place = F.row_number().over(part.orderBy(F.xxhash64(F.lit(seed), "run_id"), "run_id"))
    share = lambda f: F.greatest(F.lit(1), F.bround(F.col("n") * f, 0).cast("int"))
    out = own.withColumns({"n": n, "place": place}).withColumns({"v": share(val), "t": share(test)})
    out = out.withColumn("all", F.col("v") + F.col("t") >= F.col("n")).withColumns({"v": F.when(F.col("all"), 1).otherwise(F.col("v")), "t": F.when(F.col("all"), 1).otherwise(F.col("t"))})
    split = F.when(F.col("place") <= F.col("v"), "val").when(F.col("place") <= F.col("v") + F.col("t"), "test").otherwise("train")
    split = F.when(F.col("n") < 3, F.raise_error(F.concat(F.lit("too few runs in stratum "), F.col("stratum")))).otherwise(split)
    return out.select("run_id", "stratum", split.alias("split"))


def families(runs: DataFrame) -> DataFrame:
    """``runs`` with family: baseline, churn or normal; control families never train or calibrate."""
    return runs.withColumn("family", control_family(F.col("run_id")))


def cross_family(runs: DataFrame, train: list[str], test: list[str], seed: int = 42) -> DataFrame:
    """(run_id, role) for runs (run_id, class, cve): train and val from the normal runs of the training families; eval_normal their
    held-out part in shared families and all normal runs of new ones; eval_attack the attacks of the test families."""
    own = families(runs)
    normal = own.filter("class = 'normal' AND family = 'normal'")
    pool = stratified_split(normal.filter(F.col("cve").isin(train)), seed).join(normal.select("run_id", "cve"), "run_id")
    roles = [
        pool.filter("split <> 'test'").select("run_id", F.col("split").alias("role")),
        pool.filter((F.col("split") == "test") & F.col("cve").isin(test)).select("run_id", F.lit("eval_normal").alias("role")),
        normal.filter(F.col("cve").isin([c for c in test if c not in train])).select("run_id", F.lit("eval_normal").alias("role")),
        own.filter((F.col("class") == "attack") & F.col("cve").isin(test)).select("run_id", F.lit("eval_attack").alias("role")),
        own.filter("class = 'normal' AND family <> 'normal'").select("run_id", F.col("family").alias("role")),
    ]
    out = roles[0]
    for r in roles[1:]:
        out = out.unionByName(r)
    return out


def leave_one_out(runs: DataFrame, family: str) -> DataFrame:
    """``runs`` with role: held_out for the attacks of ``family``, else pool."""
    return runs.withColumn("role", F.when((F.col("class") == "attack") & (F.col("cve") == family), "held_out").otherwise("pool"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Runs of both."""
    return a.select("run_id").intersect(b.select("run_id"))


def only_in(rows: DataFrame, groups: DataFrame) -> DataFrame:
    return rows.join(groups.select("run_id"), "run_id", "left_semi")


def not_in(rows: DataFrame, groups: DataFrame) -> DataFrame:
    return rows.join(groups.select("run_id"), "run_id", "left_anti")
