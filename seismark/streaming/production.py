"""The production step: a fitted model applied to a stream, as one query.

A model is a folder: ``members/<name>`` fitted pipelines, each over its own columns of the engine; ``manifest.json`` with the digest of the engine's column names (in order),
the history length, the members' columns, what they were fitted on, the blend, and each member's calibration against elapsed time. It is loaded only if its manifest is that
of this engine and of the provenance asked for. ``score`` takes the engine's columns, streamed or not, to one score in [0, 1] for each row: members,
calibration and blend use the row alone, so no row waits for another series.

``fit`` trains the members on whole series and calibrates them on out-of-fold scores, so that no series is in its own calibration."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibrate as c
from ..plans import learn
from ..sources.files import check_manifest, manifest_digest
from ..sources.scratch import materialize
from . import engine

BLENDS = ("mean", "logit_mean", "scdf")


class Model:
    def __init__(self, manifest: dict, members: dict[str, PipelineModel]):
        self.manifest, self.members = manifest, members


def filled(rows: DataFrame, cols: list[str]) -> DataFrame:
    """Columns as learners take them: what is missing or not finite is 0."""
    return rows.withColumns({f"_{x}": F.when(F.col(x).isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.col(x).cast("double")) for x in cols})


def _estimator(cols: list[str], make) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=[f"_{x}" for x in cols], outputCol="_features"), make().setFeaturesCol("_features")])


def _probability(model: PipelineModel, rows: DataFrame, cols: list[str], name: str) -> DataFrame:
    kept = rows.columns
    return model.transform(filled(rows, cols)).withColumn(name, vector_to_array("probability")[1]).select(*kept, name)


def fit(rows: DataFrame, members: dict[str, list[str]], n_hist: int, provenance: dict, blend: str = "scdf", make=learn.logistic, folds: int = 5, quantiles: int = 256, least: int = 400, coordinate: str = c.COORDINATES[0]) -> Model:
    """rows: the engine's columns of whole series with y and fold (-1: left out of everything)."""
    if blend not in BLENDS:
        raise ValueError(f"unknown blend {blend!r}: it is one of {', '.join(BLENDS)}")
    data = materialize(rows.filter("fold >= 0"), "training")
    fitted, grids = {}, {}
    at = c.anchors(int(data.agg(F.max("t")).first()[0]))
    for name, cols in members.items():
        fitted[name] = _estimator(cols, make).fit(filled(data, cols))
        if blend == "scdf":
            parts = [_probability(_estimator(cols, make).fit(filled(data.filter(F.col("fold") != k), cols)), data.filter(F.col("fold") == k), cols, "score").select("t", "score") for k in range(folds)]
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            grids[name] = c.grid_payload(c.fit_time_cdf(materialize(out, "out-of-fold"), at, quantiles, least), coordinate)
    manifest = {"n_hist": n_hist, "columns": engine.COLUMNS, "digest": manifest_digest(engine.COLUMNS), "members": members, "blend": blend, "coordinate": coordinate, "provenance": provenance, "grids": grids}
    return Model(manifest, fitted)


def save(model: Model, spark: SparkSession, folder: str) -> None:
    for name, fitted in model.members.items():
        fitted.write().overwrite().save(f"{folder}/members/{name}")
    spark.createDataFrame([(json.dumps(model.manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest.json")


def load(spark: SparkSession, folder: str, expected: dict | None = None) -> Model:
    """Refuses (ValueError) a model whose columns are not the engine's, or whose provenance differs in anything that ``expected`` names."""
    manifest = json.loads(spark.read.text(f"{folder}/manifest.json").first()[0])
    if manifest["columns"] != engine.COLUMNS:
        raise ValueError("the model was made for other columns")
    check_manifest(engine.COLUMNS, manifest["digest"])
    unknown = sorted({x for cols in manifest["members"].values() for x in cols} - set(engine.COLUMNS))
    if unknown:
        raise ValueError(f"the engine has no columns {', '.join(unknown)}")
    known = manifest["provenance"] | {"blend": manifest["blend"], "coordinate": manifest["coordinate"], "n_members": len(manifest["members"]), "n_hist": manifest["n_hist"]}
    wrong = [f"{k} is {known.get(k)!r}, not {v!r}" for k, v in sorted((expected or {}).items()) if known.get(k) != v]
    if wrong:
        raise ValueError("this is not the model that was asked for: " + "; ".join(wrong))
    return Model(manifest, {name: PipelineModel.load(f"{folder}/members/{name}") for name in manifest["members"]})


def _blend(kind: str, cols: list[str]) -> Column:
    return c.blend_logit(cols) if kind == "logit_mean" else c.blend_mean(cols)


def score(features: DataFrame, model: Model) -> DataFrame:
    """(series_id, t, a column for each member, score) of the engine's rows."""
    m, out = model.manifest, features
    for name, cols in m["members"].items():
        out = _probability(model.members[name], out, cols, name)
    used = list(m["members"])
    if m["blend"] == "scdf":
        for name in used:
            grid, coordinate = c.grid_of_payload(features.sparkSession, m["grids"][name])
            out = c.apply_time_cdf(out, grid, name, f"{name}_cal", coordinate)
        used = [f"{name}_cal" for name in used]
    return out.select("series_id", "t", *m["members"], _blend(m["blend"], used).alias("score"))


def stream(rows: DataFrame, model: Model, idle_ms: int | None = None) -> DataFrame:
    """The score of every online row of a stream of (series_id, ts_us, row_id, cents)."""
    return score(engine.stream(rows, model.manifest["n_hist"], idle_ms), model)


def batch(rows: DataFrame, model: Model) -> DataFrame:
    return score(engine.batch(rows, model.manifest["n_hist"]), model)
