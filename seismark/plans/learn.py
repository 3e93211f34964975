"""Out-of-fold training, stacking, routing and baselines with spark.ml. Folds are of whole series: no series is in training and test."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize


def imputed(rows: DataFrame, cols: list[str]) -> DataFrame:
    """Missing values become 0 with one flag for each row, as the learners take no NaN."""
    none = sum((F.when(F.col(c).isNull() | F.isnan(c), 1.0).otherwise(0.0) for c in cols), F.lit(0.0))
    return rows.withColumns({"missing": none / float(len(cols)), **{c: F.when(F.col(c).isNull() | F.isnan(c), 0.0).otherwise(F.col(c).cast("double")) for c in cols}})


def _probability(fitted, rows: DataFrame, name: str) -> DataFrame:
    return fitted.transform(rows).withColumn(name, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def out_of_fold(rows: DataFrame, cols: list[str], make, name: str = "oof", folds: int = 5, weight: str | None = None) -> DataFrame:
    """Every row's probability from a model fitted on the other folds. rows: fold, y, cols."""
    data = VectorAssembler(inputCols=[*cols, "missing"], outputCol="features").transform(imputed(rows, cols))
    parts = []
    for k in range(folds):
        est = make()
        est = est.setWeightCol(weight) if weight else est
        parts.append(_probability(est.fit(data.filter((F.col("fold") != k) & (F.col("fold") >= 0))), data.filter(F.col("fold") == k), name))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("features", "missing")


def gbt(seed: int = 42, rounds: int = 10, depth: int = 4) -> GBTClassifier:
    return GBTClassifier(labelCol="y", maxIter=rounds, maxDepth=depth, stepSize=0.1, subsamplingRate=0.7, featureSubsetStrategy="0.7", maxBins=64, seed=seed)


def logistic() -> LogisticRegression:
    return LogisticRegression(labelCol="y", maxIter=30, regParam=0.01)


def forest_baseline(train: DataFrame, cols: list[str], seed: int = 42):
    return Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="raw", handleInvalid="skip"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), RandomForestClassifier(labelCol="y", numTrees=20, maxDepth=6, seed=seed)]).fit(train)


def pair_weights(rows: DataFrame) -> DataFrame:
    """Weight of a row in the time-stratified score: the rows of the other class in its step."""
    g = rows.groupBy("t").agg(F.sum("y").alias("_p"), F.count("*").alias("_n"))
    return rows.join(g, "t").withColumn("weight", F.when(F.col("y") == 1, F.col("_n") - F.col("_p")).otherwise(F.col("_p")).cast("double")).drop("_p", "_n")


def router(rows: DataFrame, cols: list[str], k: int = 6, seed: int = 42, folds: int = 5) -> DataFrame:
    """Cluster of each series (rows: fold, cols): the centres for a fold's series are fitted on the other folds' alone, so cluster numbers
    compare within a fold only."""
    data = VectorAssembler(inputCols=cols, outputCol="raw").transform(materialize(rows, "routed"))  # every fold's fit passes over them several times
    parts = [Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="features", withMean=True), KMeans(k=k, seed=seed)]).fit(data.filter((F.col("fold") != f) & (F.col("fold") >= 0))).transform(data.filter(F.col("fold") == f)) for f in range(folds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumnRenamed("prediction", "cluster").drop("raw", "features")
