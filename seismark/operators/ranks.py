"""Running sums, positions and tiles within groups of any size. The counted values are written once. A group of up to ``ROWS`` values is summed in one window; a larger one is cut by
quantiles of its own values into buckets of about that size, each summed in its own window, and a bucket's base is a prefix sum over the
buckets before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize

#: Values that one window sums.
ROWS = 1_000_000


def prefixes(df: DataFrame, by: Sequence[str], order: str, sizes: Sequence[str], rows: int | None = None) -> DataFrame:
    """For each size s: ``s_below``, its sum over the group's rows of smaller ``order``, and ``s_all``, over the whole group. df has one row for each
    (by, order); it is written once, as its count says whether any group can be large."""
    rows = rows or ROWS
    held = materialize(df, "cells")
    n = held.count()  # of the files' footers
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    if n <= rows:  # no group is larger
        upto = group.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return held.withColumns({f"{s}_below": F.sum(s).over(upto) - F.col(s) for s in sizes} | {f"{s}_all": F.sum(s).over(group) for s in sizes})
    shares = [k / -(-n // rows) for k in range(1, -(-n // rows))]
    # at most n / rows groups are large; a group's cuts beyond its own need fall together or split finer, and neither changes a sum
    large = held.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile_approx(order, F.array(*[F.lit(x) for x in shares]), 10_000).alias("_cuts")).filter(F.col("_n") > rows).select(*[F.col(b).alias(f"_of_{b}") for b in by], F.array_sort(F.array_distinct("_cuts")).alias("_cuts"))
    cut = held.join(large, [F.col(b).eqNullSafe(F.col(f"_of_{b}")) for b in by], "left") if by else held.crossJoin(F.broadcast(large))  # without groups: one row
    part = F.coalesce(F.size(F.filter("_cuts", lambda q: q < F.col(order))), F.lit(0))
    held = cut.withColumn("_part", part).drop("_cuts", *[f"_of_{b}" for b in by])
    sums = held.groupBy(*by, "_part").agg(*[F.sum(s).alias(f"_sum_{s}") for s in sizes])
    base = sums.select(*[F.col(b).alias(f"_by_{b}") for b in by], F.col("_part").alias("_bucket"), *[(F.sum(f"_sum_{s}").over(group.orderBy("_part")) - F.col(f"_sum_{s}")).alias(f"_base_{s}") for s in sizes], *[F.sum(f"_sum_{s}").over(group).alias(f"{s}_all") for s in sizes])
    on = [F.col(b) == F.col(f"_by_{b}") for b in by] + [F.col("_part") == F.col("_bucket")]
    joined = held.join(base if by else F.broadcast(base), on)  # without groups: a row for each bucket
    inner = Window.partitionBy(*by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = joined.withColumns({f"{s}_below": F.col(f"_base_{s}") + F.sum(s).over(inner) - F.col(s) for s in sizes})
    return out.drop("_part", "_bucket", *[f"_by_{b}" for b in by], *[f"_base_{s}" for s in sizes])


def positions(df: DataFrame, by: Sequence[str], value: str, key: str) -> DataFrame:
    """``pos``: each row's place (from 0) in its group in the order of (value, key), and ``n``, the group's rows. (by, key) is unique."""
    counted = df.groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_k"))
    ahead = prefixes(counted, by, "_v", ["_k"]).select(*[F.col(b).alias(f"_g_{b}") for b in by], F.col("_v").alias("_w"), F.col("_k_below").alias("_ahead"), F.col("_k_all").alias("n"))
    own = prefixes(df.withColumn("_one", F.lit(1).cast("long")).withColumn("_v", F.col(value)), [*by, "_v"], key, ["_one"])
    return own.join(ahead, [F.col(b) == F.col(f"_g_{b}") for b in by] + [F.col("_v") == F.col("_w")]).withColumn("pos", F.col("_ahead") + F.col("_one_below")).drop("_one", "_v", "_one_below", "_one_all", "_w", "_ahead", *[f"_g_{b}" for b in by])


def tile(pos: Column, n: Column, k: int) -> Column:
    """The tile (1 to k) of a place among n: tiles of equal size, the first ones one larger where n leaves a rest."""
    size, rest = F.floor(n / k), n % k
    big = rest * (size + 1)
    return F.when(pos < big, F.floor(pos / (size + 1))).otherwise(rest + F.floor((pos - big) / F.greatest(size, F.lit(1)))).cast("int") + 1


def order_statistics(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, k, q): linearly interpolated quantiles at the given shares, exact whatever the number of rows; nulls are left out."""
    c = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    p = prefixes(c, by, "_v", ["_n"])
    at = lambda s: F.lit(float(s)) * (F.col("_n_all") - 1)
    wanted = F.array(*[F.struct(F.lit(k).alias("k"), F.floor(at(s)).alias("lo"), F.ceil(at(s)).alias("hi"), (at(s) - F.floor(at(s))).alias("f")) for k, s in enumerate(shares)])
    here = lambda i: (i >= F.col("_n_below")) & (i < F.col("_n_below") + F.col("_n"))
    hit = p.select(*by, "_v", F.explode(F.filter(F.transform(wanted, lambda x: F.struct(x["k"].alias("k"), here(x["lo"]).alias("low"), here(x["hi"]).alias("high"), x["f"].alias("f"))), lambda x: x["low"] | x["high"])).alias("x"))
    return hit.groupBy(*by, F.col("x.k").alias("k")).agg(F.max(F.when(F.col("x.low"), F.col("_v"))).alias("_a"), F.max(F.when(F.col("x.high"), F.col("_v"))).alias("_b"), F.max("x.f").alias("_f")).select(*by, "k", (F.col("_a") + F.col("_f") * (F.col("_b") - F.col("_a"))).alias("q"))
