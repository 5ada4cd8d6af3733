import random
from dataclasses import replace

import numpy as np
import pytest

from pitchloom.operators.spikes import Limits, details, flag_implausible, predict, stuck

LIMITS = Limits(lower=0.0, upper=100.0, stuck_len=5, stuck_tol=0.02)
DDL = "src long, seg long, t long, id long, v double, part boolean, is_spike string"


def flags(df):
    got = {"spike": set(), "stuck": set(), "impossible": set()}
    for r in df.collect():
        for kind in got:
            if r[f"is_{kind}"]:
                got[kind].add(r["id"])
    return got


def series(src=1, n=60, mean=20.0, seed=0):
    rng = random.Random(seed)
    return [[src, 1, k, src * 1000 + k, round(rng.gauss(mean, 1.0), 3), False, "x"] for k in range(n)]


def run(spark, rows, limits=LIMITS, **kw):
    df = spark.createDataFrame([tuple(r) for r in rows], DDL)
    return flag_implausible(df, ["src"], ["seg"], "t", ["id"], ["v"], limits, low_exempt="part", **kw)


def test_spikes_stuck_and_impossible(spark):
    rows = series()
    rows[10][4] = 40.0
    rows[30][4], rows[31][4] = 2.0, 2.5
    for k in range(40, 46):
        rows[k][4] = 20.5 + 0.01 * (k % 2)
    rows[42][4] = None  # the stretch goes on across a null
    rows[50][4], rows[51][4], rows[52][4] = -3.0, float("inf"), float("nan")
    rows += series(src=2, mean=60.0, seed=1)
    rows.append([None, 1, 1, 9, 200.0, False, "x"])
    rows.append([3, 1, 1, 3001, 55.0, False, "x"])  # one reading: nothing to compare with
    got = flags(run(spark, rows + rows))
    assert got["spike"] == {1010, 1030, 1031, 1050}
    assert got["stuck"] == {1040, 1041, 1043, 1044, 1045}
    assert got["impossible"] == {1050, 1051, 9}
    assert run(spark, rows + rows).count() == len(rows) - 2


def test_low_readings_of_part_minutes_and_null_order(spark):
    rows = series()
    rows[10][4], rows[10][5] = 3.0, True
    rows[20][4], rows[20][5] = 45.0, True
    rows[25][2] = None
    got = flags(run(spark, rows))
    assert got["spike"] == {1020} and not got["stuck"]


@pytest.mark.parametrize("span", [7.0, 20.0, 1000.0])
def test_blocks_change_nothing(spark, span):
    rows = series(n=200)
    rows[70][4] = 35.0
    for k in range(100, 110):
        rows[k][4] = 20.0
    plain = run(spark, rows).collect()
    cut = run(spark, rows, block_span=span, halo=12.0).collect()
    assert sorted(map(str, plain)) == sorted(map(str, cut))


def test_positions_against_neighbours(spark):
    rows = [(1, k, k, 0.1 * k, 5.0 + 0.05 * k + 0.013 * (k % 3)) for k in range(80)]
    rows[20] = (1, 20, 20, 12.0, 5.0)
    rows[40], rows[41] = (1, 40, 40, -9.0, 6.0), (1, 41, 41, -9.1, 6.1)
    for k in range(60, 72):
        rows[k] = (1, k, k, 6.0, 8.0)
    df = spark.createDataFrame(rows, "src long, t long, id long, x double, y double")
    limits = Limits(-60, 60, 10, 0.021, detail_k=8.0, min_jump=4.0, reach=5, moving=True)
    got = flags(flag_implausible(df, ["src"], [], "t", ["id"], ["x", "y"], limits))
    assert got["spike"] == {20, 40, 41} and got["stuck"] == set(range(60, 72))


def test_empty(spark):
    assert run(spark, series()[:1]).limit(0).count() == 0
    df = spark.createDataFrame([], DDL)
    assert flag_implausible(df, ["src"], ["seg"], "t", ["id"], ["v"], replace(LIMITS)).count() == 0


def test_the_coefficients_decide(spark):
    rows = series()
    rows[10][4], rows[20][4] = 29.0, 40.0
    found = {k: flags(run(spark, rows, replace(LIMITS, detail_k=k)))["spike"] for k in (3.5, 5.0, 12.0, 40.0)}
    assert found[3.5] >= found[5.0] >= {1010, 1020} and found[12.0] == {1020} and found[40.0] == set()


def test_predictions_equal_brute_force():
    rng = np.random.default_rng(1)
    n = 120
    series = np.sort(rng.integers(0, 7, n))
    t = np.concatenate([np.cumsum(rng.uniform(0.5, 2, (series == s).sum())) for s in range(7)])
    v, good = rng.normal(size=(n, 2)), rng.random(n) > 0.2
    mean, _ = predict(series, t, v, good, 3, False)
    line, _ = predict(series, t, v, good, 3, True)
    for k in range(n):
        near = [j for j in range(n) if j != k and series[j] == series[k] and abs(j - k) <= 3 and good[j]]
        if not near:
            assert np.isnan(mean[k]).all()
            continue
        assert np.allclose(mean[k], v[near].mean(axis=0))
        if len(near) > 1:
            w = np.array([1 - abs(j - k) / 4 for j in near])
            for d in range(2):
                fit = np.polyfit(t[near] - t[k], v[near, d], 1, w=np.sqrt(w))
                assert line[k, d] == pytest.approx(fit[1], abs=1e-6)


def test_runs_of_zero_details_equal_brute_force():
    rng = np.random.default_rng(2)
    series = np.sort(rng.integers(0, 5, 300))
    v = np.cumsum(rng.integers(-1, 2, 300) * (rng.random(300) > 0.6))[:, None] * 0.01
    tol = np.full(300, 0.011)
    want = set()
    for a in range(297):
        if series[a] == series[a + 3] and np.ptp(v[a : a + 4]) <= 0.011:
            want |= set(range(a, a + 4))
    assert set(np.flatnonzero(stuck(series, v, 4, tol))) == want


def test_neighbours_of_a_spike_are_not_blamed():
    v = np.zeros((40, 1)) + np.random.default_rng(3).normal(0, 0.1, (40, 1))
    v[[20, 21, 22]] += 50.0
    w, _, _, good = details(np.zeros(40, int), np.arange(40.0), v, np.ones(40, bool), LIMITS)
    assert set(np.flatnonzero(~good)) == {20, 21, 22} and np.abs(np.delete(w[:, 0], [20, 21, 22])).max() < 1


def test_kinds_in_one_pass_equal_kinds_alone(spark):
    rows = series()
    rows[10][4] = 40.0
    for k in range(40, 46):
        rows[k][4] = 20.5
    other = replace(LIMITS, upper=30.0, stuck_tol=0.0, detail_k=30.0)
    df = spark.createDataFrame([tuple(r) for r in rows], DDL)
    both = df.selectExpr("*", "'a' AS what").unionByName(df.selectExpr("*", "'b' AS what"))
    got = flag_implausible(both, ["what", "src"], ["seg"], "t", ["id"], ["v"], {"a": LIMITS, "b": other}, kind="what")
    for what, limits in (("a", LIMITS), ("b", other)):
        assert flags(got.where(f"what = '{what}'")) == flags(run(spark, rows, limits))
    with pytest.raises(ValueError):
        flag_implausible(both, ["what", "src"], ["seg"], "t", ["id"], ["v"], {"a": LIMITS, "b": replace(LIMITS, reach=3)}, kind="what")


def test_batches_and_hot_sources_change_nothing(spark):
    rows = [[1, s, k, 100000 + s * 1000 + k, v[4], False, "x"] for s in range(30) for k, v in enumerate(series(n=45, seed=s))] + series(src=2, seed=99)
    rows[100][4], rows[700][4] = 60.0, 55.0
    whole = sorted(map(str, run(spark, rows).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        assert sorted(map(str, run(spark, rows).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
