"""Reading and writing of plain files: CSV with required columns, store tables, ledgers, reports."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load_csv(spark: SparkSession, path: str, required: list[str] = (), schema: str | None = None) -> DataFrame:
    """A CSV file with a header; FileNotFoundError if there is none, ValueError naming missing columns."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(f"no CSV file at {path}")
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    require_columns(df, required)
    return df


def require_columns(df: DataFrame, required: list[str]) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def load_observations(spark: SparkSession, path: str, id_col: str = "id", time_col: str = "time", value_col: str = "value", period_col: str = "period", history: int = 1) -> DataFrame:
    """A long table as (series_id, i, segment, x): i counts a series' rows in time order; ``history`` is the period code of its history
    (1 in current files, 0 in older ones)."""
    df = spark.read.parquet(path)
    require_columns(df, [id_col, time_col, value_col, period_col])
    order = Window.partitionBy(id_col).orderBy(F.col(period_col), F.col(time_col))
    return df.select(F.col(id_col).alias("series_id"), (F.row_number().over(order) - 1).cast("long").alias("i"), F.when(F.col(period_col) == history, "history").otherwise("online").alias("segment"), F.col(value_col).cast("double").alias("x"))


def write_store(obs: DataFrame, labels: DataFrame, path: str, buckets: int = 64) -> None:
    """Observations (partitioned by a hash bucket of the series, sorted by series and position) and one row of facts for each series."""
    bucket = F.pmod(F.xxhash64("series_id"), F.lit(buckets)).cast("int")
    obs.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("series_id", "i").write.partitionBy("bucket").parquet(f"{path}/obs")
    n = lambda s: F.sum(F.when(F.col("segment") == s, 1).otherwise(0))
    meta = obs.groupBy("series_id").agg(n("history").alias("n_hist"), n("online").alias("n_online"))
    meta.join(labels, "series_id", "left").withColumn("has_break", F.coalesce(F.col("tau") >= 0, F.lit(False))).write.parquet(f"{path}/meta")


def load_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/obs").drop("bucket"), spark.read.parquet(f"{path}/meta")


def append_ledger(row: DataFrame, path: str) -> None:
    """Appends to an experiment ledger; the commit protocol keeps concurrent writers apart."""
    row.write.mode("append").parquet(path)


def write_submission(df: DataFrame, path: str) -> None:
    df.select("timestamp", "has_structural_break").write.mode("overwrite").option("header", True).csv(path)


def write_report(values: dict, path: str) -> None:
    with open(path, "w") as f:
        json.dump(values, f, indent=2, sort_keys=True, default=str)


def manifest_digest(columns: list[str]) -> str:
    """Order-sensitive digest of column names."""
    return hashlib.sha256("\n".join(columns).encode()).hexdigest()


def check_manifest(columns: list[str], digest: str) -> None:
    if manifest_digest(columns) != digest:
        raise ValueError("the columns are not those that the model was made for")
