"""Deterministic series for trials: noise comes from hashes of (seed, position), so any executor makes the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column) -> Column:
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def normal(seed: int, *keys: Column) -> Column:
    """Box-Muller over two hashed uniforms."""
    return F.sqrt(-2 * F.log(uniform(seed, *keys, F.lit(0)))) * F.cos(2 * 3.141592653589793 * uniform(seed, *keys, F.lit(1)))


def _daily(spark: SparkSession, lengths: list[int], level: list[float], scale: list[float], seed: int) -> DataFrame:
    n = sum(lengths)
    starts = [sum(lengths[:k]) for k in range(len(lengths))]
    pick = lambda v: F.coalesce(*[F.when(F.col("id") >= s, F.lit(float(x))) for s, x in reversed(list(zip(starts, v, strict=True)))])
    edge = F.col("id").isin(starts[1:]).cast("int")
    return spark.range(n).select(
        F.expr("date_add(date'2020-01-01', cast(id as int))").cast("timestamp").alias("timestamp"),
        F.round(pick(level) + pick(scale) * normal(seed, F.col("id")), 4).alias("value"),
        edge.alias("has_structural_break"),
    )


def mean_shift(spark: SparkSession, n: int = 60, shift: float = 2.0, sd: float = 0.5, seed: int = 42) -> DataFrame:
    return _daily(spark, [n, n], [0, shift], [sd, sd], seed)


def variance_shift(spark: SparkSession, n: int = 60, before: float = 0.5, after: float = 2.0, seed: int = 42) -> DataFrame:
    return _daily(spark, [n, n], [0, 0], [before, after], seed)


def multi_regime(spark: SparkSession, n: int = 40, levels: tuple[float, ...] = (0, 3, -2), sd: float = 0.5, seed: int = 42) -> DataFrame:
    return _daily(spark, [n] * len(levels), list(levels), [sd] * len(levels), seed)
