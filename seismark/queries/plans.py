"""Pairwise learning within steps and portfolio selection, with SQL twins of what SQL can say."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibrate as c
from ..operators import panel as p
from ..operators.draws import PRIME, mixed_sql
from ..plans import pairwise, portfolio
from ..sources.scratch import scratch_path
from ._base import panel, panel_sql, rounded

QUERIES, ORACLE = {}, {}
FOLD = "(((series_id * 2654435 + 97) % 10007) % 5)::bigint"


SAMPLE_SQL = (
    "with " + panel_sql() + f""", ng as (select t, series_id, row_number() over (partition by t order by {mixed_sql('series_id', 't', str(pairwise.DRAWS))}, series_id) - 1 as pos, count(*) over (partition by t) as n from panel where y = 0),
ps as (select series_id, t, unnest(range({pairwise.DRAWS})) as draw from panel where y = 1)
select p.series_id, p.t, p.draw::integer as draw, n.series_id as other from ps p join ng n on n.t = p.t and n.pos = floor({mixed_sql('p.series_id', 'p.t', 'p.draw')} * n.n / {PRIME}::double)"""
)


def pair_sample(spark, sf):
    """Eight negatives of its own step for each positive."""
    return pairwise.sampled(panel(spark, sf).select("series_id", "t", "y"))


def _rows(spark, sf):
    return panel(spark, sf).withColumn("fold", c.fold_of(F.col("series_id"))).select("series_id", "t", "fold", "y", (F.col("score") / 1e6).alias("a"), (F.col("score_b") / 1e6).alias("b"), (F.col("score_c") / 1e6).alias("cc"))


def pairwise_oof(spark, sf):
    """The time-stratified score of each fold under weights fitted on the other folds' pairs."""
    got = pairwise.out_of_fold(_rows(spark, sf), ["a", "b", "cc"]).withColumn("score", F.round("ranked", 9))
    return rounded(p.pooled(p.per_step(got, "fold", "t"), "fold"), 4)


MEMBERS = ["score", "score_b", "score_c"]


def _portfolio_sql() -> str:
    ranks = ", ".join(f"2 * (rank() over (partition by t order by {m}) - 1) + count(*) over (partition by t, {m}) as r{i}" for i, m in enumerate(MEMBERS))
    total = " + ".join(f"(mask >> {i} & 1) * r{i}" for i in range(3))
    auc = lambda cond, name: f"""{name}r as (select h.f, mask, t, y, rank() over (partition by h.f, mask, t order by s) + (count(*) over (partition by h.f, mask, t, s) - 1) / 2.0 as r from tr join (select unnest(range(5)) as f) h on fold {cond} h.f),
{name}s as (select f, mask, t, count(*) filter (where y = 1) as n1, count(*) filter (where y = 0) as n0, sum(r) filter (where y = 1) as rs from {name}r group by all),
{name} as (select f, mask, coalesce(sum(2 * rs - n1 * (n1 + 1)) / (2.0 * sum(n1 * n0)), 0.5) as auc from {name}s where n1 > 0 and n0 > 0 group by all)"""  # noqa: E731
    return (
        "with " + panel_sql() + f""", rk as materialized (select series_id, t, y, {FOLD} as fold, {ranks} from panel),
tr as materialized (select t, y, fold, mask, {total} as s from rk, (select unnest([1, 2, 3, 4, 5, 6, 7]) as mask) m), {auc('<>', 'ta')}, {auc('=', 'te')},
g1 as (select f, arg_max(mask, [auc, mask]) as mask, max(auc) as auc from ta where mask in (1, 2, 4) group by f),
c2 as (select g1.f, g1.mask as was, g1.auc as old, arg_max(ta.mask, [ta.auc, ta.mask]) as mask, max(ta.auc) as auc from g1 join ta on ta.f = g1.f and bit_count(ta.mask::integer) = 2 and ta.mask & g1.mask = g1.mask group by all),
g2 as (select f, was as m1, case when auc > old + 1e-6 then mask end as m2, case when auc > old + 1e-6 then auc else old end as auc from c2),
g3 as (select g2.f, m1, m2, g2.auc as old, ta.auc as nw from g2 join ta on ta.f = g2.f and ta.mask = 7),
fin as (select f, m1, m2, case when m2 is not null and nw > old + 1e-6 then 7 else coalesce(m2, m1) end as mask, case when m2 is not null and nw > old + 1e-6 then nw else old end as auc from g3),
nm as (select unnest([1, 2, 4]) as bit, unnest({MEMBERS}) as name)
select fin.f::bigint as fold, (select name from nm where bit = m1) || coalesce('+' || (select name from nm where bit = m2 - m1), '') || case when fin.mask = 7 then '+' || (select name from nm where bit = 7 - m2) else '' end as chosen, round(fin.auc, 9) as train_auc, round(coalesce(te.auc, 0.5), 9) as test_auc
from fin left join te on te.f = fin.f and te.mask = fin.mask"""
    )


def portfolio_choice(spark, sf):
    rows = panel(spark, sf).withColumn("fold", c.fold_of(F.col("series_id")))
    return rounded(portfolio.portfolio(rows, MEMBERS)[0], 9)


QUERIES |= {"q_pair_sample": pair_sample, "q_pairwise_oof": pairwise_oof, "q_portfolio": portfolio_choice}
ORACLE |= {"q_pair_sample": SAMPLE_SQL, "q_portfolio": _portfolio_sql()}


def distilled(spark, sf):
    """Students of three causal columns, taught by teachers that also see the next eight rows: the time-stratified score of each fold."""
    from pyspark.sql import Window

    from ..plans import nested

    ahead = Window.partitionBy("series_id").orderBy("t").rowsBetween(1, 8)
    rows = _rows(spark, sf).withColumn("fold", c.fold_of(F.col("series_id"), 3)).withColumns({f"{x}_next": F.avg(x).over(ahead) for x in ("a", "cc")})
    got = nested.distilled(rows, ["a", "b", "cc", "a_next", "cc_next"], ["a", "b", "cc"], folds=range(3))
    return rounded(p.pooled(p.per_step(got.withColumn("score", F.round("student_score", 9)), "fold", "t"), "fold"), 4)


QUERIES |= {"q_distilled": distilled}


def battery_ranking(spark, sf):
    """Arms over one sample of three columns, by their gain over the level alone."""
    from ..plans import battery

    rows = _rows(spark, sf).withColumn("fold", c.fold_of(F.col("series_id"), 3))
    arms = [battery.Arm("level", ("b",)), battery.Arm("sums", ("a", "b", "cc"), "weighted"), battery.Arm("paired", ("a", "b", "cc"), "pairwise"), battery.Arm("held", ("b",), persistence="decaymax:0.98")]
    book = scratch_path(spark, "ledger")
    keys = battery.run(rows, arms, book, range(3))
    return rounded(battery.ranking(battery.ledger(spark, book), keys, keys[0]).drop("key"), 4)


QUERIES |= {"q_battery": battery_ranking}
