"""Time-stratified ranking metrics over (t, score, y) rows, and what they are made of.

Ranks are taken over distinct (t, score) cells, counted before the shuffle, so rows of equal scores, however many, are one row; a step's
cells are ranked in buckets (``ranks.prefixes``), so a step of any size is many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import prefixes


def _count(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0)).cast("long")


def cells(rows: DataFrame, *by: str, score: str = "score", y: str = "y") -> DataFrame:
    """Counts by (by, score), with the negatives of lower scores: pos, neg, below."""
    c = rows.groupBy(*by, F.col(score).alias("score")).agg(_count(F.col(y) == 1).alias("pos"), _count(F.col(y) == 0).alias("neg"))
    return prefixes(c, by, "score", ["neg"]).withColumnRenamed("neg_below", "below").drop("neg_all")


def per_step(rows: DataFrame, *by: str, score: str = "score", y: str = "y") -> DataFrame:
    """n_pos, n_neg, twice the concordant pairs (ties one), auc and pair weight for each step with both classes."""
    keys = by or ("t",)
    g = cells(rows, *keys, score=score, y=y).groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * (2 * F.col("below") + F.col("neg"))).alias("num2"))
    g = g.filter("n_pos > 0 and n_neg > 0").withColumn("w", F.col("n_pos") * F.col("n_neg"))
    return g.withColumn("auc", F.col("num2") / (2.0 * F.col("w")))


def pooled(steps: DataFrame, *by: str) -> DataFrame:
    """Pair-weighted score: sum of concordant pairs over sum of pairs; 0.5 if there are none."""
    g = steps.groupBy(*by) if by else steps
    return g.agg(F.coalesce(F.sum("num2") / (2.0 * F.sum("w")), F.lit(0.5)).alias("auc"), F.coalesce(F.sum("w"), F.lit(0)).cast("long").alias("pairs"), F.count("*").alias("steps"))


def weightings(steps: DataFrame) -> DataFrame:
    """Pair-weighted, equal and alive-weighted means of the steps' scores."""
    alive = F.col("n_pos") + F.col("n_neg")
    return steps.agg(F.coalesce(F.sum("num2") / (2.0 * F.sum("w")), F.lit(0.5)).alias("pairs"), F.coalesce(F.avg("auc"), F.lit(0.5)).alias("equal"), F.coalesce(F.sum(F.col("auc") * alive) / F.sum(alive), F.lit(0.5)).alias("alive"))


def midranks(rows: DataFrame, score: str = "score", name: str = "midrank", by: str = "t") -> DataFrame:
    """Average rank of the score within each step, through distinct-score cells."""
    c = rows.groupBy(by, F.col(score).alias("_s")).agg(F.count("*").alias("_k"))
    c = prefixes(c, [by], "_s", ["_k"]).select(by, "_s", (F.col("_k_below") + (F.col("_k") + 1) / 2.0).alias("_r"), F.col("_k_all").alias("_n"))
    j = rows.join(c.withColumnRenamed(by, "_b"), (F.col(by) == F.col("_b")) & (F.col(score) == F.col("_s")))
    return j.withColumn(name, F.col("_r")).withColumn("n_step", F.col("_n")).drop("_s", "_r", "_n", "_b")


def loss_cube(rows: DataFrame, t_band: Column, age_band: Column) -> DataFrame:
    """Twice the lost pairs and twice all pairs by (t band, age band of the positive, kind of the negative). rows: t, score, y, tau."""
    c = rows.groupBy("t", "score").agg(_count((F.col("y") == 0) & (F.col("tau") < 0)).alias("never"), _count((F.col("y") == 0) & (F.col("tau") >= 0)).alias("prebreak"))
    kinds_of = ("never", "prebreak")
    c = prefixes(c, ["t"], "score", kinds_of).withColumns({f"{k}_over": F.col(f"{k}_all") - F.col(f"{k}_below") - F.col(k) for k in kinds_of})
    pos = rows.filter("y = 1").groupBy("t", "score", (F.col("t") - F.col("tau")).alias("age")).agg(F.count("*").alias("n"))
    j = pos.join(c, ["t", "score"])
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), (F.col("n") * (2 * F.col(f"{k}_over") + F.col(k))).alias("lost2"), (2 * F.col("n") * F.col(f"{k}_all")).alias("pairs2")) for k in ("never", "prebreak")]))
    return j.select(t_band.alias("t_band"), age_band.alias("age_band"), kinds.alias("k")).groupBy("t_band", "age_band", "k.kind").agg(F.sum("k.lost2").alias("lost2"), F.sum("k.pairs2").alias("pairs2"))


def row_losses(rows: DataFrame) -> DataFrame:
    """Twice the pairs of opposite class in the same step that each row stands wrong against (ties one)."""
    c = rows.groupBy("t", "score").agg(_count(F.col("y") == 1).alias("_p"), _count(F.col("y") == 0).alias("_q"))
    c = prefixes(c, ["t"], "score", ["_p", "_q"]).select("t", "score", "_p", "_q", F.col("_p_below").alias("_pos_below"), (F.col("_q_all") - F.col("_q_below") - F.col("_q")).alias("_neg_above"))
    j = rows.join(c, ["t", "score"])
    return j.withColumn("loss2", F.when(F.col("y") == 1, 2 * F.col("_neg_above") + F.col("_q")).otherwise(2 * F.col("_pos_below") + F.col("_p"))).drop("_p", "_q", "_pos_below", "_neg_above")


def pair_flow(rows: DataFrame, old: str, new: str) -> DataFrame:
    """All same-step pairs of a positive and a negative: concordant under ``old`` only (damage), under ``new`` only (repair). No pairs are made: those
    concordant under both are counted by dominance. Where p stands above q under old, there is one highest bit at which their old ranks
    differ; so each row goes to one group for each bit of its rank (rows with equal higher bits), and in a group the positives with the bit
    set are counted against the negatives without it in the order of new."""
    at = [F.col("t"), F.col(old).alias("o"), F.col(new).alias("w"), "y"]
    cell = rows.select(*at).groupBy("t", "o").agg(_count(F.col("y") == 1).alias("pos"), _count(F.col("y") == 0).alias("neg"), F.count("*").alias("n"))
    ranked = prefixes(cell, ["t"], "o", ["n", "neg"])
    both = lambda c, name: c.groupBy("t").agg(F.sum(F.col("pos") * F.col("neg_below")).alias(name))
    first = both(ranked, "a")
    second = both(cells(rows.select("t", F.col(new).alias("score"), "y"), "t").withColumnRenamed("below", "neg_below"), "b")
    sizes = cell.groupBy("t").agg((F.sum("pos") * F.sum("neg")).alias("pairs"))
    top = ranked.agg(F.max("n_below")).first()[0] or 0
    joined = rows.select(*at).join(ranked.select("t", F.col("o").alias("_o"), F.col("n_below").alias("r")).withColumnRenamed("t", "_t"), (F.col("t") == F.col("_t")) & (F.col("o") == F.col("_o")))
    level = F.explode(F.array(*[F.struct(F.lit(k).alias("bit"), F.shiftright("r", k + 1).alias("pre"), F.shiftright("r", k).bitwiseAND(F.lit(1)).alias("one")) for k in range(max(int(top).bit_length(), 1))])).alias("x")
    split = joined.select("t", "w", "y", level).filter((F.col("x.one") == F.col("y")) & F.col("y").isin(0, 1)).select("t", "x.bit", "x.pre", F.col("w").alias("score"), "y")
    over = cells(split, "t", "bit", "pre").groupBy("t").agg(F.sum(F.col("pos") * F.col("below")).alias("ab"))
    j = sizes.filter("pairs > 0").join(first, "t", "left").join(second, "t", "left").join(over, "t", "left").na.fill(0, ["a", "b", "ab"])
    return j.select("t", "pairs", (F.col("b") - F.col("ab")).alias("repaired"), (F.col("a") - F.col("ab")).alias("damaged"))


def weighted_bootstrap(rows: DataFrame, draws: DataFrame) -> DataFrame:
    """Score for each draw with series counted ``k`` times: draws (draw, series_id, k) meet rows once, then cells are sums of weights."""
    j = rows.join(draws, "series_id")
    c = j.groupBy("draw", "t", "score").agg(F.sum(F.when(F.col("y") == 1, F.col("k")).otherwise(0)).cast("long").alias("pos"), F.sum(F.when(F.col("y") == 0, F.col("k")).otherwise(0)).cast("long").alias("neg"))
    s = prefixes(c, ["draw", "t"], "score", ["neg"]).withColumnRenamed("neg_below", "below").groupBy("draw", "t").agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * (2 * F.col("below") + F.col("neg"))).alias("num2")).filter("n_pos > 0 and n_neg > 0").withColumn("w", F.col("n_pos") * F.col("n_neg"))
    return pooled(s, "draw")
