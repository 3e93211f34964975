"""A pairwise objective within time steps: does a broken series outrank one that is not broken yet, at the same step?

Every positive draws ``DRAWS`` negatives of its own step by counter: the k-th draw is the negative at a hashed position among the step's negatives, which are put
in the order of another hash. No pair of a step is made but those, a step of any size is many tasks (positions come from buckets), and the draws are
the same however the rows are partitioned. A logistic model without intercept is then fitted to the differences of the two rows' columns, so
whatever is common to a step drops out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.draws import PRIME, mixed
from ..operators.ranks import positions
from ..sources.scratch import materialize
from .learn import imputed

DRAWS = 8


def sampled(rows: DataFrame, draws: int = DRAWS) -> DataFrame:
    """rows (series_id, t, y) -> (series_id, t, draw, other): for each positive and draw a negative of the same step; steps without negatives give none."""
    neg = rows.filter("y = 0").select("t", "series_id", mixed(F.col("series_id"), F.col("t"), draws).alias("h"))
    placed = positions(neg, ["t"], "h", "series_id").select(F.col("t").alias("_t"), F.col("series_id").alias("other"), F.col("pos").alias("_pos"))
    sizes = neg.groupBy("t").agg(F.count("*").alias("n"))
    pos = rows.filter("y = 1").select("series_id", "t").join(sizes, "t").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    want = pos.withColumn("_at", F.floor(mixed(F.col("series_id"), F.col("t"), F.col("draw")) * F.col("n") / PRIME).cast("long"))
    return want.join(placed, (F.col("t") == F.col("_t")) & (F.col("_at") == F.col("_pos"))).select("series_id", "t", "draw", "other")


def differences(rows: DataFrame, cols: Sequence[str], draws: int = DRAWS) -> DataFrame:
    """(label, d_<col>): the positive's columns less the negative's; every second draw is turned round, with label 0."""
    held = imputed(rows, list(cols))
    names = [*cols, "missing"]
    at = lambda side: held.select(F.col("series_id").alias(f"_s{side}"), F.col("t").alias(f"_t{side}"), *[F.col(c).alias(f"_{side}_{c}") for c in names])
    pairs = sampled(rows.select("series_id", "t", "y"), draws)
    j = pairs.join(at("a"), (F.col("series_id") == F.col("_sa")) & (F.col("t") == F.col("_ta"))).join(at("b"), (F.col("other") == F.col("_sb")) & (F.col("t") == F.col("_tb")))
    sign = F.when(F.col("draw") % 2 == 0, 1.0).otherwise(-1.0)
    return j.select((F.col("draw") % 2 == 0).cast("int").alias("label"), *[(sign * (F.col(f"_a_{c}") - F.col(f"_b_{c}"))).alias(f"d_{c}") for c in names])


def fit(rows: DataFrame, cols: Sequence[str], draws: int = DRAWS, ridge: float = 1e-3) -> list[float]:
    """The weight of each column (and of ``missing``), fitted on the pairs of ``rows`` (series_id, t, y, cols)."""
    d = materialize(differences(rows, cols, draws), "pairs")
    names = [f"d_{c}" for c in (*cols, "missing")]
    data = VectorAssembler(inputCols=names, outputCol="features").transform(d)
    return [float(v) for v in LogisticRegression(labelCol="label", fitIntercept=False, regParam=ridge, maxIter=50).fit(data).coefficients]


def apply(rows: DataFrame, cols: Sequence[str], weights: Sequence[float], name: str) -> DataFrame:
    held = imputed(rows, list(cols))
    return held.withColumn(name, sum((F.lit(w) * F.col(c) for w, c in zip(weights, (*cols, "missing"), strict=True)), F.lit(0.0))).drop("missing")


def out_of_fold(rows: DataFrame, cols: Sequence[str], name: str = "ranked", folds: int = 5, draws: int = DRAWS) -> DataFrame:
    """Every row's score by the weights of the other folds. Scores of different folds compare within a step only as far as the folds' weights agree."""
    held = materialize(rows, "panel")
    out = None
    for k in range(folds):
        part = apply(held.filter(F.col("fold") == k), cols, fit(held.filter((F.col("fold") != k) & (F.col("fold") >= 0)), cols, draws), name)
        out = part if out is None else out.unionByName(part)
    return out
