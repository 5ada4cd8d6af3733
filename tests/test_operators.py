import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchloom.functions.text import name_norm, null_if_sentinel
from pitchloom.operators import kernels, stats
from pitchloom.operators.asof import asof_backward, clip, window_contrast
from pitchloom.operators.blocks import leave_one_out
from pitchloom.operators.islands import debounce, run_events
from pitchloom.operators.ranking import bh_adjust, percentile_average
from pitchloom.operators.reshape import contract_violations, union_relaxed


def test_asof_keeps_equality_ties_and_nulls(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 4), (3, "b", 5), (4, None, 5), (5, "a", None)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 5, 1), ("a", 5, 2), ("a", None, 9), (None, 1, 8)], "k string, t int, v int")
    got = {r.id: r.v for r in asof_backward(left, right, ["k"], "t", ["v"], 0).collect()}
    assert got == {1: 2, 2: 0, 3: 0, 4: 0, 5: 0}


def test_window_edges_and_leave_one_out(spark):
    shocks = spark.createDataFrame([(1, 1, 1, 100)], "s int, m int, p int, at int")
    vals = spark.createDataFrame([(1, 1, "a", 90, 2.0), (1, 1, "a", 100, 3.0), (1, 1, "a", 110, 5.0), (1, 1, "b", 89, 7.0), (1, 2, "a", 100, 9.0)], "m int, p int, u string, t int, v double")
    both = window_contrast(shocks, vals, "s", "at", ["m", "p"], "u", "t", "v", 10.0)
    got = {r.u: (r.member_pre, r.member_post) for r in both.collect()}
    assert got == {"a": (2.0, 8.0), "b": (0.0, 0.0)}
    rel = leave_one_out(both, ["s"]).agg(F.sum("delta_relative")).first()[0]
    assert rel == pytest.approx(0.0)
    assert leave_one_out(both.where("u = 'a'"), ["s"]).first().delta_team_loo is None


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (5.0,), (-5.0,)], "x double")
    assert [r[0] for r in df.select(clip(F.col("x"), -1.0, 1.0)).collect()] == [None, 1.0, -1.0]


def test_debounce_ignores_a_single_flip(spark):
    flags = [True, False, True, True, False, False, True]
    df = spark.createDataFrame([(1, k, f) for k, f in enumerate(flags)], "g int, o int, f boolean")
    got = [r.s for r in debounce(df, ["g"], ["o"], "f", 2, "s").orderBy("o").collect()]
    assert got == [True, True, True, True, True, False, False]


def test_sprints_merge_over_short_gaps(spark):
    df = spark.createDataFrame([(1, k, 30.0 if k in {1, 2, 4, 5, 9} else 1.0) for k in range(12)], "g int, o int, v double")
    got = run_events(df, ["g"], "o", F.col("v") > 20, 2, 3).collect()
    assert [(r.event_start, r.event_end) for r in got] == [(1, 5)]


def test_average_rank_and_bh(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 1.0), ("g", 2.0), ("g", None)], "g string, v double")
    assert sorted(r[0] for r in df.select(percentile_average("v", ["g"])).collect() if r[0] is not None) == pytest.approx([0.5, 0.5, 1.0])
    p = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.8)], "id int, p double")
    got = {r.id: r.a for r in bh_adjust(p.withColumn("f", F.lit(1)), "p", ["f"], ["id"], "a").collect()}
    assert got == pytest.approx({1: 0.04, 3: 0.16 / 3, 2: 0.16 / 3, 4: 0.8})


def test_union_and_contract(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2.5, "y")], "x double, s string")
    both = union_relaxed([a, b])
    assert sorted((r.x, r.s) for r in both.collect()) == [(1.0, None), (2.5, "y")]
    assert contract_violations(both, {"x": "float", "s": "int", "z": "text"}) == ["missing z", "s: string is no int"]


def test_names_and_sentinels(spark):
    df = spark.createDataFrame([("Jürgen  O'Nørß-Łuk",), ("é",), ("null",), (" ",), (None,)], "t string")
    assert [r[0] for r in df.select(name_norm(F.col("t"))).collect()] == ["jurgen o norss luk", "e", "null", "", None]
    assert [r[0] for r in df.select(null_if_sentinel(F.col("t"))).collect()][2:] == [None, None, None]


def test_auc_of_ties(spark):
    df = spark.createDataFrame([(0, 0.1, 0), (0, 0.4, 0), (0, 0.4, 1), (0, 0.8, 1)], "g int, s double, y int")
    assert stats.auc(df, "s", "y", ["g"]).first().auc == pytest.approx(0.875)


def test_within_effect_equals_imputation_on_a_balanced_panel(spark):
    rng = np.random.default_rng(0)
    rows = [(u, int(post), float(u + 0.7 * post + rng.normal())) for u in range(40) for post in (0, 1)]
    df = spark.createDataFrame(rows, "u int, x int, y double").withColumn("g", F.lit(1))
    got = stats.within_effect(df, "y", "x", ["u"], "u", ["g"]).first()
    direct = np.mean([rows[2 * u + 1][2] - rows[2 * u][2] for u in range(40)])
    assert got.beta == pytest.approx(direct) and got.se > 0


def test_filter_keeps_a_line_and_a_constant():
    line = np.linspace(0, 10, 100)
    sections = kernels.lowpass(4, 1.0, 25.0)
    # unit gain at rest, no shift in the middle; the reflected ends are too short for the filter to settle
    assert np.allclose(kernels.both_ways(np.full(50, 3.0), sections), 3.0)
    assert np.allclose(kernels.both_ways(line, sections)[45:55], line[45:55], atol=0.02)
    noisy = np.sin(2 * np.pi * 8 * np.arange(400) / 25)
    assert np.abs(kernels.both_ways(noisy, sections)[150:250]).max() < 1e-3
    spiky = 1 + 0.1 * np.sin(np.arange(30))
    spiky[10] = 50
    got = kernels.hampel(spiky)
    assert abs(got[10] - 1) < 0.2 and list(np.flatnonzero(got != spiky)[1:-1]) == [10]  # the padded ends aside
    # without any spread around it there is no telling what an outlier is
    still = np.ones(30)
    still[10] = 50
    assert np.all(kernels.hampel(still) == still) and np.all(kernels.hampel(still[:5]) == still[:5])


def test_control_is_a_share_and_symmetric():
    a, b, t = np.array([[0.0, 5.0]]), np.array([[0.0, -5.0]]), np.array([0.0, 0.0])
    assert kernels.control(a, b, t, 0.0) == pytest.approx(0.5, abs=1e-6)
    assert kernels.control(np.array([[0.0, 1.0]]), np.array([[0.0, 60.0]]), t, 0.0) == 1.0


def test_elo_conserves_points_and_greedy_takes_the_free_one(spark):
    games = spark.createDataFrame([(1, 10, 20, 2, 0), (2, 20, 10, 1, 1)], "o int, h int, a int, x int, y int")
    got = kernels.elo(games, "o", "h", "a", "x", "y").orderBy("game").collect()
    assert got[0].before_home == 1500 and got[1].before_home + got[1].before_away == pytest.approx(3000)
    left = spark.createDataFrame([(1, 1, 10), (2, 1, 11)], "k long, m int, t int")
    right = spark.createDataFrame([(7, 1, 10), (8, 1, 30)], "r long, m int, t int")
    assert sorted(map(tuple, kernels.greedy_match(left, right, "k", "r", ["m"], "t").collect())) == [(1, 7), (2, 8)]
