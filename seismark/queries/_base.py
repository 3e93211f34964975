"""Series, panels and their SQL forms, shared by the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import windows as w
from ..sources.scratch import materialize
from ..sources.series import SUPPLIER, USER, Family, absorbing_label, planted_tau, series, split

R = 6


def rounded(df: DataFrame, digits: int = R) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def obs(spark: SparkSession, sf_dir: str, family: Family = SUPPLIER, spread: bool = False) -> DataFrame:
    return series(spark, sf_dir, family, spread)


def z_online(spark: SparkSession, sf_dir: str, family: Family = SUPPLIER) -> DataFrame:
    """Online rows with z against the history's moments."""
    from ..operators import history as h

    hist, online = split(obs(spark, sf_dir, family), family.n_hist)
    return h.standardise(online, h.moments(hist))


def panel(spark: SparkSession, sf_dir: str, family: Family = USER) -> DataFrame:
    """(series_id, t, tau, y, d, score, score_b, score_c): integer scores of three causal detectors. d = n x - sum of the history, in cents; score is the
    larger of two reflected sums of d with an allowance, score_b is |d|, score_c the absolute sum of the last eight d."""
    hist, online = split(obs(spark, sf_dir, family), family.n_hist)
    s = hist.groupBy("series_id").agg(F.sum("cents").alias("s1"), F.count("*").alias("n"))
    d = online.join(s, "series_id").withColumn("d", F.col("n") * F.col("cents") - F.col("s1"))
    k = F.lit(1000).cast("long") * F.col("n")
    d = w.cusum_pair(d.withColumn("k", k), F.col("d"), F.col("k"))
    tau = planted_tau(F.col("series_id"))
    return materialize(_scored(d, tau), "panel")  # written once: ranks read it several times


def _scored(d: DataFrame, tau) -> DataFrame:
    return d.withColumn("tau", tau).select(
        "series_id", "t", "tau", absorbing_label(F.col("t"), tau).alias("y"), "d", F.greatest("up", "down").alias("score"), F.abs("d").alias("score_b"),
        F.abs(F.sum("d").over(w.trailing(8))).alias("score_c"),
    )


def obs_sql(family: Family = SUPPLIER) -> str:
    n = family.n_hist
    return (
        f"obs as (select *, cents / 100.0 as x from ({family.sql()})), hist as (select * from obs where i < {n}), onl as (select *, i - {n} as t from obs where i >= {n}), "
        "mom as (select series_id, count(*) as n, sum(cents)::double as s1, sum(cents*cents)::double as s2 from hist group by series_id), "
        "par as (select series_id, n, s1 / n / 100.0 as mu, greatest(sqrt(greatest((s2 - s1 * s1 / n) / (n - 1), 0.0)) / 100.0, 1e-9) as sd from mom), "
        "zon as (select o.*, p.mu, p.sd, (o.x - p.mu) / p.sd as z from onl o join par p using (series_id))"
    )


def panel_sql(family: Family = USER) -> str:
    return (
        obs_sql(family)
        + """, dd as (select o.series_id, o.t, (m.n * o.cents - m.s1)::bigint as d, 1000 * m.n as k from onl o join (select series_id, count(*) as n, sum(cents)::bigint as s1 from hist group by series_id) m using (series_id)),
cc as (select *, sum(d - k) over o as cu, sum(-d - k) over o as cd, sum(d) over (partition by series_id order by t rows 7 preceding) as c8 from dd window o as (partition by series_id order by t)),
panel as (select series_id, t::bigint as t, tau, case when tau >= 0 and t >= tau then 1 else 0 end as y, d, greatest(cu - least(0, mu_), cd - least(0, md_))::bigint as score, abs(d)::bigint as score_b, abs(c8)::bigint as score_c
  from (select *, min(cu) over o as mu_, min(cd) over o as md_, (case when series_id % 2 = 0 then (series_id * 37) % 40 else -1 end)::bigint as tau from cc window o as (partition by series_id order by t)))"""
    )


def unsigned(sql: str, *cols: str) -> str:
    """The query with negative zeros of these columns made plain zeros, as rounding gives them in Spark."""
    return f"select * replace ({', '.join(f'{c} + 0.0 as {c}' for c in cols)}) from ({sql})"
