"""Double cross-fitting and distillation: a teacher's label for a row comes from a teacher that saw neither the row's series nor the fold that the
student will be judged on.

For an outer fold o, every other fold g is predicted by a teacher fitted on the folds but o and g, and o itself by one fitted on all folds but o. Columns are encoded
once, into one written table that all fits read. Every prediction carries the folds that its teacher was fitted on, and ``assert_pure`` refuses a table in which one
of them is the row's own, or the outer fold.

A student learns from soft labels (1 - mix) y + mix q by plain cross-entropy: each row counts twice, as a positive with weight q and as a negative with weight 1 - q."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .learn import imputed, logistic

EPS = 1e-6


def encoded(rows: DataFrame, teacher_cols: Sequence[str], student_cols: Sequence[str]) -> DataFrame:
    """(series_id, t, fold, y, teacher, student): both views as vectors, written once. Rows of fold -1 are left out of everything."""
    held = imputed(rows.filter("fold >= 0"), sorted({*teacher_cols, *student_cols})).drop("missing")
    for name, cols in (("teacher", teacher_cols), ("student", student_cols)):
        held = VectorAssembler(inputCols=list(cols), outputCol=name).transform(held)
    out = materialize(held.select("series_id", "t", "fold", F.col("y").cast("int").alias("y"), "teacher", "student"), "encoded")
    if out.groupBy("series_id").agg(F.count_distinct("fold").alias("n")).filter("n > 1").head(1):
        raise ValueError("a series is in two folds")
    return out


def _predicted(data: DataFrame, fit_folds: Sequence[int], on: int, view: str, make) -> DataFrame:
    model = make().setFeaturesCol(view).fit(data.filter(F.col("fold").isin(list(fit_folds))))
    out = model.transform(data.filter(F.col("fold") == on))
    q = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
    return out.select("series_id", "t", "fold", "y", "student", q.alias("q"), F.array(*[F.lit(f) for f in fit_folds]).alias("fit_folds"))


def nested(data: DataFrame, outer: int, folds: Sequence[int], make=logistic, view: str = "teacher") -> DataFrame:
    """Every row with the teacher's ``q`` as the outer fold may see it, and the folds that this teacher was fitted on."""
    train = [g for g in folds if g != outer]
    parts = [_predicted(data, [x for x in train if x != g], g, view, make) for g in train] + [_predicted(data, train, outer, view, make)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return materialize(out, "nested")


def assert_pure(predicted: DataFrame, outer: int) -> None:
    """Refuses predictions by a teacher that saw the row's own fold, or the outer one."""
    bad = predicted.filter(F.array_contains("fit_folds", F.col("fold")) | F.array_contains("fit_folds", outer)).head(1)
    if bad:
        raise ValueError(f"a teacher fitted on folds {list(bad[0]['fit_folds'])} labels fold {bad[0]['fold']} for outer fold {outer}")


def soft_rows(rows: DataFrame, mix: float) -> DataFrame:
    """(label, weight, student): each row as a positive and a negative, weighted by its soft label."""
    q = (1 - mix) * F.col("y") + mix * F.least(F.greatest(F.col("q"), F.lit(EPS)), F.lit(1 - EPS))
    both = F.explode(F.array(F.struct(F.lit(1).alias("y"), q.alias("weight")), F.struct(F.lit(0).alias("y"), (1 - q).alias("weight")))).alias("s")
    return rows.select("student", both).select("student", "s.y", "s.weight").filter("weight > 0")


def distilled(rows: DataFrame, teacher_cols: Sequence[str], student_cols: Sequence[str], mix: float = 0.5, folds: Sequence[int] = range(5), make=logistic, name: str = "student_score") -> DataFrame:
    """(series_id, t, fold, y, score): each fold's rows by a student of the other folds, taught by teachers of the remaining ones. mix 0: hard labels alone."""
    data, folds = encoded(rows, teacher_cols, student_cols), list(folds)
    out = None
    for o in folds:
        taught = nested(data, o, folds, make)
        assert_pure(taught, o)
        student = make().setFeaturesCol("student").setWeightCol("weight").fit(soft_rows(taught.filter(F.col("fold") != o), mix))
        part = student.transform(data.filter(F.col("fold") == o)).select("series_id", "t", "fold", "y", vector_to_array("probability")[1].alias(name))
        out = part if out is None else out.unionByName(part)
    return out
