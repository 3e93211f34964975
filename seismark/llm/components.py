"""Connected components over an edge table, without gathering links or labels anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", most_rounds: int = 100) -> DataFrame:
    """(node, component): component is the smallest node reachable. Alternates large-star and small-star steps;
    each is one minimum per node (combined before the shuffle, so that a hot centre is a row for each task) joined
    back to the edges (a skewed join that Spark can split). The edge count never grows, and every
    round ends in a written table, so a lost executor costs its tasks only.

    Nodes without an edge to another node are not returned; null ends are ignored; an empty table gives an empty result."""
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter("u <> v and u is not null and v is not null").distinct()
    e = materialize(e, "edges")
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        # large star: the larger neighbours of a node go to its smallest
        large = both.filter("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours go to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        joined = large.join(least, F.col("u") == F.col("k"))
        small = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u <> v").distinct()
        new = materialize(small, "edges")
        done = new.join(e, ["u", "v"], "left_anti").isEmpty() and e.join(new, ["u", "v"], "left_anti").isEmpty()
        e = new
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
