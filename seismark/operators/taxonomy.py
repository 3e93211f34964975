"""What kind of break a series had: effect sizes by family across its break, against the same sizes across placebo cuts of unbroken series.

A broken series is cut at its break. An unbroken one is cut once, at the relative place of a broken series drawn by counter. Rows after the cut are compared with the rows
before it, or with the history where there are few of those. Each family's size is then ranked among the placebo sizes of its bucket (of rows after
the cut), which gives a surprise that compares across families; the largest leads, unless it is small, and is mixed where another comes near."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .draws import PRIME, mixed
from .ranks import positions, prefixes

FAMILIES = ("location", "scale", "tails", "dependence", "trend", "spectral")
#: Shortest online part and sides of a cut, least rows before a cut that stand for themselves, tail quantile, floor, least surprise of a leader, and share of it that makes a mixture, cap.
SHORTEST, SIDE, PLACEBO_SIDE, OWN, TAIL, FLOOR, LEADS, MIXED, CAP = 24, 4, 6, 60, 0.99, 1e-9, 1.0, 0.6, 3.2
BUCKETS = (50, 150, 250)


def cuts(meta: DataFrame) -> DataFrame:
    """meta (series_id, tau (-1: none), n_online) -> (series_id, has_break, cut, n_online): series long enough, cut at their break or at a drawn place."""
    rel = meta.filter("tau > 0 and tau < n_online").select("series_id", "tau", "n_online", (F.col("tau") / F.col("n_online")).alias("rel"))
    placed = positions(rel.withColumn("_g", F.lit(0)), ["_g"], "rel", "series_id").select(F.col("pos").alias("_pos"), F.col("rel").alias("_rel"), F.col("n").alias("_n"))
    size = rel.agg(F.count("*").alias("_m"))  # one row
    calm = meta.filter("tau < 0").crossJoin(F.broadcast(size)).withColumn("_at", F.floor(mixed(F.col("series_id"), F.lit(17).cast("long")) * F.col("_m") / PRIME).cast("long"))
    drawn = calm.join(placed, F.col("_at") == F.col("_pos")).select("series_id", F.lit(False).alias("has_break"), F.greatest(F.lit(PLACEBO_SIDE), F.least(F.col("n_online") - PLACEBO_SIDE, F.floor(F.col("_rel") * F.col("n_online")))).cast("long").alias("cut"), "n_online")
    broken = meta.filter("tau >= 0").select("series_id", F.lit(True).alias("has_break"), F.col("tau").cast("long").alias("cut"), "n_online")
    return broken.unionByName(drawn).filter((F.col("n_online") >= SHORTEST) & (F.col("cut") >= SIDE) & (F.col("n_online") - F.col("cut") >= SIDE))


def effects(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """rows (series_id, part 'h' or 'o', t, z, e) -> (series_id, has_break, n_post, a column for each family): standardised sizes of the change at the cut. e, the residual, may be null
    where its lags are missing."""
    j = rows.join(cut, "series_id")
    own = F.col("cut") >= OWN
    side = F.when((F.col("part") == "o") & (F.col("t") >= F.col("cut")), "post").when(F.when(own, F.col("part") == "o").otherwise(F.col("part") == "h"), "ref")
    j = j.withColumn("side", side).filter("side is not null")
    of = Window.partitionBy("series_id", "side")
    order = of.orderBy("t")
    j = j.withColumns({"_m": F.avg("z").over(of), "_n": F.count("*").over(of), "_k": F.row_number().over(order) - 1})
    c = F.col("z") - F.col("_m")
    j = j.withColumn("_c", c).withColumns({"_l": F.lag("_c").over(order), "_d": F.col("z") - F.lag("z").over(order), "_x": F.col("_k") - (F.col("_n") - 1) / 2.0})
    tail = j.filter("side = 'ref'").groupBy("series_id").agg(F.percentile(F.abs("z"), F.lit(TAIL)).alias("_q"))
    s = j.join(tail, "series_id").groupBy("series_id", "has_break", "side").agg(
        F.count("*").alias("n"), F.first("_m").alias("mean"), F.stddev_pop("z").alias("sd"), F.stddev_pop("e").alias("e_sd"), F.avg(F.when(F.abs("z") > F.col("_q"), 1.0).otherwise(0.0)).alias("far"),
        F.sum(F.col("_c") * F.col("_l")).alias("_cl"), F.sum(F.col("_c") * F.col("_c")).alias("_cc"), F.sum(F.col("_x") * F.col("z")).alias("_xz"), F.sum(F.col("_x") * F.col("_x")).alias("_xx"), F.var_pop("_d").alias("_dv"), F.var_pop("z").alias("_zv"),
    )
    s = s.withColumns({"acf": F.when(F.col("_cc") > 0, F.coalesce(F.col("_cl"), F.lit(0.0)) / F.col("_cc")).otherwise(0.0), "slope": F.col("_xz") / F.greatest(F.col("_xx"), F.lit(FLOOR)) * F.col("n"), "rough": F.when(F.col("n") > 2, F.col("_dv") / F.greatest(F.col("_zv"), F.lit(1e-12))).otherwise(0.0)})
    names = ("n", "mean", "sd", "e_sd", "far", "acf", "slope", "rough")
    pick = lambda which, n: F.max(F.when(F.col("side") == which, F.col(n)))
    w = s.groupBy("series_id", "has_break").agg(*[pick("ref", n).alias(f"r_{n}") for n in names], *[pick("post", n).alias(f"p_{n}") for n in names]).filter("r_n is not null and p_n is not null")
    se, floor = F.sqrt(1.0 / F.col("r_n") + 1.0 / F.col("p_n")), F.lit(FLOOR)
    gap = lambda n: F.abs(F.col(f"p_{n}") - F.col(f"r_{n}"))
    size = {
        "location": gap("mean") / F.greatest(se * F.col("r_sd"), floor),
        "scale": F.abs(F.ln(F.greatest("p_e_sd", floor) / F.greatest("r_e_sd", floor))) / F.greatest(se, floor),
        "tails": F.abs(F.col("p_far") - (1 - TAIL)) / F.greatest(se, floor),
        "dependence": gap("acf") / F.greatest(se, floor),
        "trend": gap("slope") / F.greatest(se * F.greatest(F.col("r_sd"), floor) * F.col("p_n"), floor),
        "spectral": gap("rough") / F.greatest(se, floor),
    }
    return w.select("series_id", "has_break", F.col("p_n").cast("long").alias("n_post"), *[size[f].alias(f) for f in FAMILIES])


def surprises(sizes: DataFrame, least: int = 50, buckets: Sequence[int] = BUCKETS) -> DataFrame:
    """(series_id, has_break, family, bucket, size, surprise): -log10 of the placebo share above, within the bucket; null where it has under ``least`` placebo cuts."""
    bucket = sum((F.when(F.col("n_post") >= b, 1).otherwise(0) for b in buckets), F.lit(0))
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.round(F.col(f), 9).alias("size")) for f in FAMILIES])).alias("c")
    long = sizes.select("series_id", "has_break", bucket.alias("bucket"), cells).select("series_id", "has_break", "bucket", "c.*")
    counted = long.groupBy("family", "bucket", "size").agg(F.sum(F.when(F.col("has_break"), 0).otherwise(1)).alias("_k"))
    c = prefixes(counted, ["family", "bucket"], "size", ["_k"]).select(F.col("family").alias("_f"), F.col("bucket").alias("_b"), F.col("size").alias("_s"), (F.col("_k_below") + F.col("_k")).alias("_le"), F.col("_k_all").alias("_all"))
    j = long.join(c, (F.col("family") == F.col("_f")) & (F.col("bucket") == F.col("_b")) & (F.col("size") == F.col("_s")))
    p = F.greatest(1 - F.col("_le") / (F.col("_all") + 1.0), 1 / (F.col("_all") + 1.0))
    return j.select("series_id", "has_break", "family", "bucket", "size", F.when(F.col("_all") >= least, F.least(-F.log10(p), F.lit(CAP))).alias("surprise"))


def leaders(found: DataFrame) -> DataFrame:
    """(series_id, has_break, family, lead, mixed): the family of the largest surprise (the first of equals), 'none' under LEADS; mixed where the second reaches MIXED of it."""
    place = F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), F.col("family"))
    g = found.filter("surprise is not null").groupBy("series_id", "has_break").agg(F.array_sort(F.collect_list(F.struct((-F.col("surprise")).alias("s"), place.alias("k"), "family"))).alias("f"))  # six entries
    first, second = -F.col("f")[0]["s"], -F.col("f")[1]["s"]
    return g.select("series_id", "has_break", F.when(first >= LEADS, F.col("f")[0]["family"]).otherwise("none").alias("family"), first.alias("lead"), ((first >= LEADS) & (second >= MIXED * first)).alias("mixed"))
