"""Pairwise learning within steps and portfolio selection against brute force."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from seismark.operators import panel as p
from seismark.plans import learn, pairwise, portfolio


def ts_auc(score, y, t):
    won = pairs = 0.0
    for step in np.unique(t):
        a, b = score[(t == step) & (y == 1)], score[(t == step) & (y == 0)]
        won += (a[:, None] > b[None]).sum() + 0.5 * (a[:, None] == b[None]).sum()
        pairs += len(a) * len(b)
    return won / pairs


@pytest.fixture(scope="module")
def planted(spark):
    """Steps differ in level and in how common breaks are: the better column follows the step far more than the break."""
    rng = np.random.default_rng(2)
    s, t = np.repeat(np.arange(200), 30), np.tile(np.arange(30), 200)
    y = (rng.random(len(s)) < 0.05 + 0.6 * (t / 30)).astype(int)
    a = 0.8 * y - 6.0 * np.sin(t) + rng.standard_normal(len(s))
    b = 0.3 * y + rng.standard_normal(len(s))
    rows = spark.createDataFrame([(int(i), int(j), int(k), int(i % 5), float(u), float(v)) for i, j, k, u, v in zip(s, t, y, a, b, strict=True)], "series_id long, t long, y int, fold int, a double, b double")
    return rows.cache()


def test_draws_are_of_the_step_and_do_not_depend_on_partitions(planted):
    got = pairwise.sampled(planted.select("series_id", "t", "y")).collect()
    again = pairwise.sampled(planted.repartition(7, "y").select("series_id", "t", "y")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    y = {(r.series_id, r.t): r.y for r in planted.collect()}
    n = sum(y.values())
    assert len(got) == 8 * n and all(y[r.series_id, r.t] == 1 and y[r.other, r.t] == 0 for r in got)
    # draws spread over a step's negatives about evenly
    step = [r.other for r in got if r.t == 10]
    negatives = sum(1 for (s, t), v in y.items() if t == 10 and v == 0)
    assert len(set(step)) > 0.8 * negatives * (1 - np.exp(-len(step) / negatives))


def test_steps_of_one_class_give_no_pairs(spark):
    rows = spark.createDataFrame([(1, 0, 1), (2, 0, 1), (3, 1, 0), (4, 2, 1), (5, 2, 0)], "series_id long, t long, y int")
    got = pairwise.sampled(rows, 3).collect()
    assert sorted(map(tuple, got)) == [(4, 2, k, 5) for k in range(3)] and pairwise.sampled(rows.limit(0)).count() == 0


def test_pairs_beat_weights_where_steps_differ(planted):
    score = lambda df, name: p.pooled(p.per_step(df.withColumn("score", F.round(name, 9)), "t")).first().auc
    paired = score(pairwise.out_of_fold(planted, ["a", "b"]), "ranked")
    weighted = score(learn.out_of_fold(learn.pair_weights(planted), ["a", "b"], learn.logistic, weight="weight"), "oof")
    assert paired > weighted + 0.01 and paired > 0.7, (paired, weighted)


def test_greedy_choice_is_the_best_of_all_subsets(spark):
    """Four members: two good ones of different kinds, a copy of one of them with noise, and noise."""
    rng = np.random.default_rng(9)
    s, t = np.repeat(np.arange(100), 12), np.tile(np.arange(12), 100)
    y = (rng.random(len(s)) < 0.4).astype(int)
    m = np.stack([y + 1.2 * rng.standard_normal(len(s)), y + 1.4 * rng.standard_normal(len(s)), np.zeros(len(s)), rng.standard_normal(len(s))])
    m[2] = np.round(m[0] + 2 * rng.standard_normal(len(s)))
    names = ["m0", "m1", "m2", "m3"]
    rows = spark.createDataFrame([(int(a), int(b), int(c), int(a % 3), *map(float, v)) for a, b, c, v in zip(s, t, y, m.T, strict=True)], "series_id long, t long, y int, fold int, m0 double, m1 double, m2 double, m3 double")
    rank = np.zeros_like(m)
    for step in range(12):
        at = t == step
        for i in range(4):
            v = m[i, at]
            rank[i, at] = ((v[:, None] > v).sum(axis=1) * 2 + (v[:, None] == v).sum(axis=1))  # whole numbers: equal sums are equal
    report, blended = portfolio.portfolio(rows, names, range(3))
    got = {r.fold: r for r in report.collect()}
    for f in range(3):
        other, own = s % 3 != f, s % 3 == f
        all_of = {c: ts_auc(rank[list(c)].sum(axis=0)[other], y[other], t[other]) for n in range(1, 5) for c in combinations(range(4), n)}
        best = max(all_of, key=all_of.get)
        assert set(got[f].chosen.split("+")) == {names[i] for i in best} and got[f].train_auc == pytest.approx(all_of[best])
        assert got[f].test_auc == pytest.approx(ts_auc(rank[list(best)].sum(axis=0)[own], y[own], t[own]))
        for r in blended.filter(F.col("fold") == f).limit(50).collect():
            assert r.blend == pytest.approx(rank[list(best)][:, (s == r.series_id) & (t == r.t)].mean() / 200)


def test_teachers_never_saw_what_they_label(planted):
    from seismark.plans import nested

    rows = planted.withColumn("fold", F.col("series_id") % 3).withColumn("ahead", F.col("y") * 1.0)
    data = nested.encoded(rows, ["a", "b", "ahead"], ["a", "b"])
    taught = nested.nested(data, 1, [0, 1, 2])
    nested.assert_pure(taught, 1)
    assert taught.count() == planted.count()
    got = {tuple(r.fit_folds): set() for r in taught.select("fit_folds").distinct().collect()}
    for r in taught.select("fold", "fit_folds").distinct().collect():
        got[tuple(r.fit_folds)].add(r.fold)
    assert got == {(2,): {0}, (0,): {2}, (0, 2): {1}}
    # the labels of a fold are those of a plain fit on the folds named
    model = learn.logistic().setFeaturesCol("teacher").fit(data.filter("fold = 2"))
    from pyspark.ml.functions import vector_to_array

    want = {(r.series_id, r.t): r.q for r in model.transform(data.filter("fold = 0")).select("series_id", "t", vector_to_array("probability")[1].alias("q")).collect()}
    assert all(r.q == pytest.approx(want[r.series_id, r.t], abs=1e-9) for r in taught.filter("fold = 0").collect())
    for bad in ("array(0, 1)", "array(1)"):
        with pytest.raises(ValueError, match="outer fold 1"):
            nested.assert_pure(taught.withColumn("fit_folds", F.expr(bad)), 1)
    with pytest.raises(ValueError, match="two folds"):
        nested.encoded(planted.withColumn("fold", F.col("t") % 3), ["a"], ["b"])


def test_soft_labels_are_cross_entropy(planted):
    """mix 0 is the plain fit on hard labels; every row keeps a total weight of one."""
    from seismark.plans import nested

    rows = planted.withColumn("fold", F.col("series_id") % 3)
    got = {(r.series_id, r.t): r.student_score for r in nested.distilled(rows, ["a"], ["a", "b"], mix=0.0, folds=range(3)).filter("fold = 2").collect()}
    data = nested.encoded(rows, ["a"], ["a", "b"])
    from pyspark.ml.functions import vector_to_array

    plain = learn.logistic().setFeaturesCol("student").fit(data.filter("fold <> 2")).transform(data.filter("fold = 2")).select("series_id", "t", vector_to_array("probability")[1].alias("q"))
    assert all(got[r.series_id, r.t] == pytest.approx(r.q, abs=1e-6) for r in plain.collect())
    soft = nested.soft_rows(data.withColumn("q", F.lit(0.3)), 0.5)
    assert soft.agg(F.sum("weight")).first()[0] == pytest.approx(data.count())


def test_battery_goes_on_where_it_ended(spark, planted, tmp_path, monkeypatch):
    from seismark.plans import battery

    rows, book = planted.withColumn("fold", F.col("series_id") % 2), f"file://{tmp_path}/ledger"
    arms = [battery.Arm("base", ("b",)), battery.Arm("both", ("a", "b"), "pairwise"), battery.Arm("held", ("b",), persistence="runmax")]
    ran, plain = [], battery.scores

    def counted(held, arm, folds):
        ran.append(arm.name)
        if arm.name == "both" and len(ran) == 2:
            raise RuntimeError("the driver is lost")
        return plain(held, arm, folds)

    monkeypatch.setattr(battery, "scores", counted)
    with pytest.raises(RuntimeError):
        battery.run(rows, arms, book, range(2))
    keys = battery.run(rows.repartition(5), arms, book, range(2))  # the same sample in another order
    assert ran == ["base", "both", "both", "held"] and battery.ledger(spark, book).count() == 3
    again = battery.run(rows, [battery.Arm("renamed", ("b",)), battery.Arm("soft", ("b",), persistence="ewma:0.5")], book, range(2))
    assert ran[4:] == ["soft"] and again[0] == keys[0]
    assert battery.run(rows.filter("t < 20"), arms[:1], book, range(2)) != keys[:1] and ran[5:] == ["base"]  # another sample
    got = {r.key: r for r in battery.ranking(battery.ledger(spark, book), keys, keys[0]).collect()}
    assert len(got) == 3 and got[keys[0]].gain == 0 and got[keys[1]].gain > 0.05 and got[keys[1]].folds_up == 2 and got[keys[1]]["rank"] == 1
    for bad in (battery.Arm("x", ("b",), "forest"), battery.Arm("x", ("b",), persistence="forever")):
        with pytest.raises(ValueError, match="unknown"):
            plain(rows, bad, range(2))
