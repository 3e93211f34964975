"""A battery of experiments: a declared list of arms over one sample, a ledger row for each arm, and the arms ranked by what they gain.

An arm's key is a digest of everything that its result depends on: its columns, learner, settings and persistence, the folds, and the sample's own digest. A key that the ledger has is not run
again, so a battery whose driver was lost goes on where it ended, and a changed arm or sample is a new row. The sample is written once and all arms read it."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import panel as p
from ..operators import scan
from ..sources.files import append_ledger
from ..sources.scratch import materialize
from . import learn, pairwise

LEDGER = "key string, arm string, columns string, learner string, settings string, persistence string, folds string, sample string, pooled double, mean double, sd double, per_fold array<double>"
LEARNERS = ("logistic", "weighted", "boosted", "pairwise")


@dataclass(frozen=True)
class Arm:
    """learner: one of LEARNERS; persistence: none, runmax, decaymax:<keep> or ewma:<rate>, over a series' scores."""

    name: str
    columns: tuple[str, ...]
    learner: str = "logistic"
    persistence: str = "none"
    settings: dict = field(default_factory=dict)


def sample_digest(rows: DataFrame) -> str:
    """The same for the same rows in any order and partitioning: counts, and sums of hashes of whole rows (as exact decimals)."""
    h = F.xxhash64(*[F.col(c) for c in sorted(rows.columns)]).cast("decimal(20,0)")
    r = rows.agg(F.count("*").alias("n"), F.sum(h).alias("s")).first()
    return hashlib.sha256(json.dumps([sorted(rows.dtypes), r["n"], str(r["s"])]).encode()).hexdigest()[:16]


def key_of(arm: Arm, folds: Sequence[int], sample: str) -> str:
    known = asdict(arm) | {"folds": list(folds), "sample": sample}
    del known["name"]  # a name is no part of a result
    return hashlib.sha256(json.dumps(known, sort_keys=True, default=list).encode()).hexdigest()[:16]


def persisted(rows: DataFrame, score: str, kind: str) -> DataFrame:
    """The score made persistent along each series; t counts a series' rows from 0."""
    name, _, value = kind.partition(":")
    if name == "none":
        return rows
    if name == "runmax":
        return rows.withColumn(score, F.max(score).over(Window.partitionBy("series_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    if name == "decaymax":
        return scan.decayed_max(rows.withColumnRenamed(score, "_raw"), "_raw", float(value or 0.99), score).drop("_raw")
    if name == "ewma":
        return scan.smoothed(rows.withColumnRenamed(score, "_raw"), "_raw", float(value or 0.3), score).drop("_raw")
    raise ValueError(f"unknown persistence {kind!r}")


def raw_scores(rows: DataFrame, arm: Arm, folds: Sequence[int]) -> DataFrame:
    """(series_id, t, y, fold, score), out of fold, before any persistence."""
    cols, n = list(arm.columns), len(folds)
    if arm.learner == "pairwise":
        out = pairwise.out_of_fold(rows, cols, "score", n, **arm.settings)
    elif arm.learner == "boosted":
        out = learn.out_of_fold(rows, cols, lambda: learn.gbt(**arm.settings), "score", n)
    elif arm.learner == "weighted":
        out = learn.out_of_fold(learn.pair_weights(rows), cols, learn.logistic, "score", n, weight="weight")
    elif arm.learner == "logistic":
        out = learn.out_of_fold(rows, cols, learn.logistic, "score", n)
    else:
        raise ValueError(f"unknown learner {arm.learner!r}: it is one of {', '.join(LEARNERS)}")
    return out.select("series_id", "t", "y", "fold", "score")


@dataclass
class Sample:
    """The rows of a battery, their digest, and what has been fitted on them: arms that differ in persistence alone share their fits."""

    rows: DataFrame
    digest: str
    fitted: dict[str, DataFrame] = field(default_factory=dict)

    def raw_scores(self, arm: Arm, folds: Sequence[int]) -> DataFrame:
        key = key_of(replace(arm, persistence="none"), folds, self.digest)
        if key not in self.fitted:
            self.fitted[key] = materialize(raw_scores(self.rows, arm, folds), "raw-scores")
        return self.fitted[key]


def scores(rows: DataFrame | Sample, arm: Arm, folds: Sequence[int]) -> DataFrame:
    """(series_id, t, y, fold, score), out of fold."""
    raw = rows.raw_scores(arm, folds) if isinstance(rows, Sample) else raw_scores(rows, arm, folds)
    return persisted(raw, "score", arm.persistence)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def run(rows: DataFrame, arms: Sequence[Arm], path: str, folds: Sequence[int] = range(5)) -> list[str]:
    """Runs the arms whose keys the ledger at ``path`` does not have, in order; each arm's row is written when it ends. Arms that differ in persistence alone share
    their fits. rows: series_id, t, y, fold and the arms' columns. Returns the keys of all arms."""
    spark, folds = rows.sparkSession, list(folds)
    held = materialize(rows, "sample")
    sample = Sample(held, sample_digest(held))
    done = {r["key"] for r in ledger(spark, path).select("key").collect()}  # a row for each arm ever run
    keys = []
    for arm in arms:
        key = key_of(arm, folds, sample.digest)
        keys.append(key)
        if key in done:
            continue
        scored = materialize(scores(sample, arm, folds).withColumn("score", F.round("score", 9)), "scores")
        per = {r["fold"]: r["auc"] for r in p.pooled(p.per_step(scored, "fold", "t"), "fold").collect()}
        each = [per.get(f, 0.5) for f in folds]
        pooled = p.pooled(p.per_step(scored, "t")).first()["auc"]
        mean = sum(each) / len(each)
        sd = (sum((v - mean) ** 2 for v in each) / len(each)) ** 0.5
        row = (key, arm.name, ",".join(arm.columns), arm.learner, json.dumps(arm.settings, sort_keys=True), arm.persistence, ",".join(map(str, folds)), sample.digest, pooled, mean, sd, each)
        append_ledger(spark.createDataFrame([row], LEDGER).coalesce(1), path)
        done.add(key)
    return keys


def ranking(book: DataFrame, keys: Sequence[str], base: str) -> DataFrame:
    """The ledger rows of ``keys`` by gain over the row ``base``: mean gain over folds, its least fold, the folds that gain, and the rank."""
    b = F.broadcast(book.filter(F.col("key") == base).limit(1).select(F.col("per_fold").alias("_base")))  # one row
    j = book.filter(F.col("key").isin(list(keys))).dropDuplicates(["key"]).crossJoin(b)
    gains = F.zip_with("per_fold", "_base", lambda x, y: x - y)
    j = j.withColumn("_g", gains).select("key", "arm", "pooled", (F.aggregate("_g", F.lit(0.0), lambda a, v: a + v) / F.size("_g")).alias("gain"), F.array_min("_g").alias("least_gain"), F.size(F.filter("_g", lambda v: v > 0)).alias("folds_up"))
    return j.withColumn("rank", F.row_number().over(Window.orderBy(F.col("gain").desc(), "arm")))  # a row for each arm
