"""Series tables: (series_id, i, cents, x), i counting observations of a series from 0; the first ``n_hist`` are its history.

Values have two decimals, so sums are taken in integer cents and are exact in any order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Family:
    """A way to read a table as series: its key, total order, value, and history length."""

    table: str
    key: str
    order: tuple[str, ...]
    value: str
    n_hist: int

    def sql(self) -> str:
        return (
            f"select {self.key} as series_id, cast(row_number() over (partition by {self.key} order by {', '.join(self.order)}) - 1 as bigint) as i, "
            f"cast(round({self.value} * 100) as bigint) as cents from {self.table}"
        )


USER = Family("events", "user_id", ("ts", "event_id"), "value", 40)
SUPPLIER = Family("lineitem", "l_suppkey", ("l_shipdate", "l_orderkey", "l_linenumber"), "l_extendedprice", 300)
TYPE = Family("events", "event_type", ("ts", "event_id"), "value", 1200)


def series(spark: SparkSession, sf_dir: str, family: Family, spread: bool = False) -> DataFrame:
    """``spread``: in as many tasks as ``spread_evenly`` gives, for costly functions of whole series."""
    by = Window.partitionBy("series_id").orderBy(*[F.col(f"o{k}") for k in range(len(family.order))])
    src = table(spark, sf_dir, family.table).select(F.col(family.key).alias("series_id"), *[F.col(c).alias(f"o{k}") for k, c in enumerate(family.order)], F.round(F.col(family.value) * 100).cast("long").alias("cents"))
    if spread:  # before the numbering: after it Spark finds the rows grouped already, leaves the repartition out and joins its own partitions
        src = spread_evenly(src, table(spark, sf_dir, family.table).count())
    return src.select("series_id", (F.row_number().over(by) - 1).cast("long").alias("i"), "cents", (F.col("cents") / 100.0).alias("x"))


def split(obs: DataFrame, n_hist: int) -> tuple[DataFrame, DataFrame]:
    """(history, online); online rows count t from 0."""
    return obs.filter(F.col("i") < n_hist), obs.filter(F.col("i") >= n_hist).withColumn("t", F.col("i") - n_hist)


def planted_tau(key, horizon: int = 40):
    """A planted first online index after a break: (37 key) mod horizon for even keys, -1 (none) for odd ones."""
    return F.when(key % 2 == 0, (key * 37) % horizon).otherwise(F.lit(-1)).cast("long")


def absorbing_label(t, tau):
    """1 from the break on, for good."""
    return F.when((tau >= 0) & (t >= tau), 1).otherwise(0).cast("long")


#: Rows of a task of costly functions, where there are more tasks than the session's shuffles have: some 27 series of 600 rows.
SPREAD_ROWS = 1 << 14


def spread_evenly(rows: DataFrame, many: int = 0) -> DataFrame:
    """Rows by series in as many tasks as the session's shuffles have, or as ``many`` rows need at SPREAD_ROWS a task if those are more. Spark would join small partitions into about one task for
    each core, and with costly functions the fullest of them is waited for; and a task that writes hundreds of columns slows down as its writers' dictionaries grow."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(n, -(-many // SPREAD_ROWS)), "series_id")
