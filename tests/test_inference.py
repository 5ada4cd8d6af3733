import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchloom.models.ordered import fit, ordered_logit
from pitchloom.operators import stats
from pitchloom.operators.asof import window_contrast
from pitchloom.operators.causal import att_scores, bootstrap_ratio, cross_fitted, md5_uniform, partially_linear, poisson_weight
from pitchloom.operators.ranking import cumulate
from pitchloom.operators.shocks import near_misses, shock_table


def test_ordered_logit_finds_what_made_the_data(spark):
    rng = np.random.default_rng(0)
    n = 60_000
    minute, x = rng.integers(0, 30, n), rng.integers(-3, 4, (n, 2)).astype(float)
    alpha = 0.4 * np.sin(np.arange(30) / 5)
    eta = alpha[minute] + x @ np.array([0.8, -0.5])
    u = rng.logistic(size=n) + eta
    y = (u > -0.6).astype(int) + (u > 0.7)
    got = fit(minute, x, y, np.ones(n))
    assert got["beta"] == pytest.approx([0.8, -0.5], abs=0.04)
    assert np.diff(got["cut"])[0] == pytest.approx(1.3, abs=0.05)
    shifted = got["alpha"] - got["alpha"].mean() - (alpha - alpha.mean())
    assert np.abs(shifted).max() < 0.2
    df = spark.createDataFrame([(int(m), float(a), float(b), int(k)) for m, (a, b), k in zip(minute[:4000], x[:4000], y[:4000])] + [(None, 1.0, 1.0, 1), (1, None, 1.0, 1)], "m int, a double, b double, y int")
    rows = ordered_logit(df, "m", ["a", "b"], "y").collect()
    assert {r.part for r in rows} == {"cut", "beta", "alpha"} and len(rows) == 2 + 2 + 30
    assert ordered_logit(df.limit(0), "m", ["a", "b"], "y").count() == 0


def test_weights_are_those_of_a_poisson_count(spark):
    w = [r.w for r in spark.range(20_000).select(poisson_weight(md5_uniform(F.col("id"))).alias("w")).collect()]
    assert np.mean(w) == pytest.approx(1, abs=0.03) and np.var(w) == pytest.approx(1, abs=0.05)


def test_bootstrap_spread_of_a_mean(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(3, 2, 400)
    df = spark.createDataFrame([("x", k, float(a), 1.0) for k, a in enumerate(v)], "b string, g long, a double, n double")
    got = bootstrap_ratio(df, ["b"], "g", "a", "n", 300).first()
    assert got.estimate == pytest.approx(v.mean()) and got.se == pytest.approx(v.std() / 20, rel=0.2)


def panel(spark, effect=0.7):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(600):
        cell = g % 3
        for _ in range(4):
            t = float(rng.random() < (0.2, 0.5, 0.7)[cell])
            rows.append(("a", cell, g, t, float(2 * cell + effect * t + rng.normal(0, 0.5))))
    return spark.createDataFrame(rows, "b string, c int, g long, t double, y double"), rows


def test_cross_fitting_never_uses_the_own_fold(spark):
    df, _ = panel(spark)
    got = cross_fitted(df.withColumn("fold", F.floor(md5_uniform(F.col("g")) * 5)), ["c"], "g", 5, {"m": ("y", None)}).collect()
    for r in got[:40]:
        assert r.m == pytest.approx(np.mean([o.y for o in got if o.c == r.c and o.fold != r.fold]))


def test_effects_are_found(spark):
    df, _ = panel(spark)
    plr = partially_linear(df, "y", "t", ["b", "c"], "g", ["b"]).first()
    assert plr.theta == pytest.approx(0.7, abs=0.06) and 0.01 < plr.se < 0.05 and plr.n == 2400
    s = att_scores(df, "y", "t", ["b", "c"], "g").agg(F.sum("psi").alias("a"), F.sum("t").alias("b")).first()
    assert s.a / s.b == pytest.approx(0.7, abs=0.06)


@pytest.mark.parametrize("parts", [1, 7])
def test_running_sums_over_parts(spark, parts):
    rng = np.random.default_rng(3)
    rows = [(k % 2 if k % 5 else None, k, int(rng.integers(0, 9))) for k in range(300)]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {(r.g, r.o): r.cum_v for r in cumulate(spark.createDataFrame(rows, "g int, o int, v int"), ["g"], "o", ["v"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {(g, o): sum(v for h, p, v in rows if h == g and p <= o) for g, o, _ in rows}


def test_split_rhat_of_mixed_and_stuck_chains(spark):
    rng = np.random.default_rng(4)
    rows = [(c, k, float(rng.normal(c * off))) for off in (0.0,) for c in range(3) for k in range(200)]
    good = stats.split_rhat(spark.createDataFrame(rows, "c int, k int, v double").withColumn("b", F.lit(1)), ["b"], "c", "k", "v").first()
    bad = stats.split_rhat(spark.createDataFrame([(c, k, v + 5 * c) for c, k, v in rows], "c int, k int, v double").withColumn("b", F.lit(1)), ["b"], "c", "k", "v").first()
    assert good.rhat == pytest.approx(1, abs=0.02) and bad.rhat > 2 and bad.ess < 20 < good.ess <= 600


@pytest.mark.parametrize("how", ["sum", "avg", "max"])
def test_windows_equal_brute_force(spark, how):
    rng = np.random.default_rng(5)
    anchors = [(k, int(rng.integers(0, 2)), int(rng.integers(0, 500))) for k in range(12)]
    values = [(int(rng.integers(0, 2)), int(rng.integers(0, 4)), int(rng.integers(0, 500)), float(rng.integers(0, 9))) for _ in range(200)]
    a, v = spark.createDataFrame(anchors, "a int, m int, at int"), spark.createDataFrame(values, "m int, u int, t int, v double")
    got = {(r.a, r.u): (r.member_pre, r.member_post) for r in window_contrast(a, v, "a", "at", ["m"], "u", "t", "v", 60, None, how).collect()}
    fold = {"sum": sum, "avg": lambda x: sum(x) / len(x), "max": max}[how]
    want = {}
    for k, m, at in anchors:
        for u in {w[1] for w in values if w[0] == m}:
            pre = [w[3] for w in values if w[:2] == (m, u) and at - 60 <= w[2] < at]
            post = [w[3] for w in values if w[:2] == (m, u) and at <= w[2] <= at + 60]
            want[k, u] = (fold(pre) if pre else None, fold(post) if post else None)
    assert got == want


def test_shocks_clip_windows_and_count_mates(spark):
    goals = spark.createDataFrame([(1, 7, 1, 300, 5, 50), (2, 7, 1, 700, 11, 60), (3, 7, None, 1, 1, 50)], "goal_id long, match_id long, period int, t long, minute long, scoring_team_id long")
    seen = [(7, 1, p, team, m, m * 60) for p, team, lo, hi in ((1, 50, 0, 20), (2, 50, 0, 6), (3, 60, 8, 20)) for m in (lo, hi)]
    events = spark.createDataFrame(seen, "match_id long, period int, player_id long, team_id long, minute long, start_game_clock long")
    got = {(r.shock_id, r.player_id): r for r in shock_table(goals, events).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 3)}
    one = got[1, 1]
    assert (one.pre_start, one.post_end, one.pre_cut, one.post_cut, one.has_overlap, one.n_mates) == (0, 900, True, False, True, 1)
    assert got[1, 2].left_field and got[2, 3].entered and got[2, 3].perspective == "GOAL_FOR" and got[2, 1].perspective == "GOAL_AGAINST"
    x = spark.createDataFrame([(1, "S", 0.7), (2, "S", 0.45), (3, "W", 0.9), (4, "W", 0.5), (5, None, 0.5), (6, "S", None)], "event_id long, outcome string, xg double")
    assert sorted(map(tuple, near_misses(x).collect())) == [(1, "lax_save"), (1, "save"), (2, "lax_save"), (4, "woodwork")]
