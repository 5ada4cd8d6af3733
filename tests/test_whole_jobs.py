"""Queries that must cover their whole tables, against brute force over all rows."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchloom.operators.blocks import on_grid
from pitchloom.operators.kernels import placebo, qualification
from pitchloom.operators.ranking import bh_adjust
from pitchloom.plans import catalog


def brute_bh(p):
    p = np.asarray(p, float)
    order = np.argsort(p, kind="stable")
    raw = p[order] * len(p) / np.arange(1, len(p) + 1)
    out = np.empty(len(p))
    out[order] = np.minimum(np.minimum.accumulate(raw[::-1])[::-1], 1)
    return out


def test_bh_of_a_hot_family_in_many_parts(spark):
    rng = np.random.default_rng(5)
    p = np.round(np.concatenate([rng.random(3000) ** 3, rng.random(40), [0.5]]), 4)
    family = ["hot"] * 3000 + [None] * 40 + ["one"]
    df = spark.createDataFrame([(k, f, float(v)) for k, (f, v) in enumerate(zip(family, p))] + [(9999, "hot", None)], "id long, f string, p double")
    got = {r.id: r.a for r in bh_adjust(df, "p", ["f"], ["id"], "a").collect()}
    want = np.concatenate([brute_bh(p[:3000]), brute_bh(p[3000:3040]), brute_bh(p[3040:])])
    assert len(got) == 3042 and got.pop(9999) is None
    assert [got[k] for k in range(3041)] == pytest.approx(list(want))


def test_w21_adjusts_every_row(spark, sf):
    rows = duckdb.sql(f"SELECT l_orderkey, l_linenumber, l_returnflag, l_tax + l_discount / 10 + 0.0001 FROM read_parquet('{sf}/lineitem.parquet')").fetchall()
    want = []  # order and line don't identify a row
    for flag in {r[2] for r in rows}:
        part = [r for r in rows if r[2] == flag]
        want += [(*r[:2], a) for r, a in zip(part, brute_bh([r[3] for r in part]))]
    got = sorted(map(tuple, catalog.queries()["w21_bh_adjusted"](spark, sf).select("l_orderkey", "l_linenumber", "adjusted").collect()))
    assert len(got) == len(rows)
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, sorted(want)))


def test_c23_takes_the_next_event_of_any_kind(spark, sf):
    events = f"(SELECT DISTINCT * EXCLUDE (received_at) FROM read_parquet('{sf}/events_enriched.parquet'))"
    rows = duckdb.sql(f"SELECT event_id, match_id, team_id, possession_event_type FROM {events} ORDER BY match_id, period NULLS FIRST, startTime NULLS FIRST, event_id").fetchall()
    want, cut_first = {}, {}
    for pool, out in ((rows, want), ([r for r in rows if r[3] == "PA"], cut_first)):
        for r, after in zip(pool, [*pool[1:], (None, None, None, None)]):
            if r[3] == "PA":
                out[r[0]] = int(after[1] == r[1] and r[2] is not None and after[2] == r[2] and after[0] is not None)
    got = {r.event_id: r.success for r in catalog.queries()["c23_pass_success"](spark, sf).collect()}
    assert got == want and want != cut_first


def test_grid_has_the_positions_of_the_block(spark):
    df = spark.createDataFrame([(1, "a", 3, 2.0), (1, "b", 50, 4.0), (2, "a", 7, 1.0)], "g int, u string, m long, v double")
    got = sorted(map(tuple, on_grid(df, ["g"], "u", "m", ["v"]).select("g", "u", "m", "v").collect()))
    assert got == [(1, "a", 3, 2.0), (1, "a", 50, 0.0), (1, "b", 3, 0.0), (1, "b", 50, 4.0), (2, "a", 7, 1.0)]


def test_c06_keeps_stoppage_time(spark, tmp_path):
    rows = [(k, *r, None) for k, r in enumerate([(1, 1, 10, 44, 5.0), (1, 1, 11, 44, 1.0), (1, 1, 10, 47, 3.0), (1, 2, 10, 50, 2.0)])]
    spark.createDataFrame(rows, "pm_id long, pff_match_id long, period long, pff_player_id long, minute_in_period long, distance_m double, loaded_at timestamp").write.parquet(str(tmp_path / "raw_per_minute.parquet"))
    got = {tuple(r)[:4]: r.relative for r in catalog.queries()["c06_minute_contrast"](spark, str(tmp_path)).collect()}
    assert got == {(1, 1, 10, 44): 4.0, (1, 1, 11, 44): -4.0, (1, 1, 10, 47): 3.0, (1, 1, 11, 47): -3.0, (1, 2, 10, 50): None}


def test_c06_against_brute_force(spark, sf):
    readings = duckdb.sql(f"SELECT pff_match_id, period, minute_in_period, pff_player_id, max(distance_m) FROM read_parquet('{sf}/raw_per_minute.parquet') WHERE minute_in_period IS NOT NULL AND period IS NOT NULL GROUP BY ALL").fetchall()
    members, values = {}, {}
    for game, period, m, player, v in readings:
        members.setdefault((game, period), set()).add(player)
        values.setdefault((game, period, m), {})[player] = v or 0.0
    want = {}
    for (game, period, m), own in values.items():
        block = members[game, period]
        for player in block:
            x = own.get(player, 0.0)
            want[game, period, player, m] = x - (sum(own.values()) - x) / (len(block) - 1) if len(block) > 1 else None
    got = {tuple(r)[:4]: r.relative for r in catalog.queries()["c06_minute_contrast"](spark, sf).collect()}
    assert got.keys() == want.keys() and len(got) > 0
    assert all((got[k] is None and want[k] is None) or got[k] == pytest.approx(want[k], abs=1e-4) for k in want)


def test_placebo_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(b, u, m, float(rng.normal() + (0.45 if b == "x" and m > 0 else 0.0))) for b in "xy" for u in range(12) for m in range(-4, 5)]
    got = {r.b: r for r in placebo(spark.createDataFrame(rows, "b string, u long, m long, v double"), "b", "u", "m", "v", 1000).collect()}
    for b in "xy":
        v = np.array([r[3] for r in rows if r[0] == b]).reshape(12, 9)
        effect = v[:, 5:].mean() - v[:, :5].mean()
        drawn = np.array([(w[:, 5:].mean() - w[:, :5].mean()) for w in (rng.permuted(v, axis=1) for _ in range(4000))])
        assert got[b].effect == pytest.approx(effect)
        assert got[b].p == pytest.approx(np.mean(np.abs(drawn) >= abs(effect)), abs=0.06)


def test_k19_draws_a_thousand_times(spark, sf):
    got = catalog.queries()["k19_placebo"](spark, sf).collect()
    assert got and all(abs(r.p * 1001 - round(r.p * 1001)) < 1e-6 for r in got)


def test_qualification_against_a_plain_simulation(spark, sf):
    rates = [0.8, 1.3, 1.8, 0.5]
    got = {r.t: r.p for r in qualification(spark.createDataFrame([(1, t, r) for t, r in enumerate(rates)], "g long, t long, r double"), "g", "t", "r").collect()}
    rng, hits = np.random.default_rng(8), np.zeros(4)
    for _ in range(6000):
        table = [[0, 0, 0, t] for t in range(4)]
        for i in range(4):
            for j in range(i):
                a, b = rng.poisson(rates[i]), rng.poisson(rates[j])
                for t, x, y in ((i, a, b), (j, b, a)):
                    table[t][0] += 3 if x > y else int(x == y)
                    table[t][1] += x - y
                    table[t][2] += x
        for row in sorted(table, key=lambda r: (-r[0], -r[1], -r[2], r[3]))[:2]:
            hits[row[3]] += 1
    assert [got[t] for t in range(4)] == pytest.approx(list(hits / 6000), abs=0.05)
    # shares of 1,500 simulations, which 500 can't all give
    shares = [r.p * 1500 for r in catalog.queries()["c19_qualification"](spark, sf).collect()]
    assert all(abs(x - round(x)) < 1e-6 for x in shares) and any(round(x) % 3 for x in shares)
