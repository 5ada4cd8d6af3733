"""Learned models on generated truth, and the name cascade on a small register."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchloom.models.folds import boosted_out_of_fold, doubly_robust
from pitchloom.operators.stats import auc
from pitchloom.plans.published import name_cascade


def test_doubly_robust_finds_the_effect_on_the_treated(spark):
    rng = np.random.default_rng(6)
    rows = []
    for g in range(250):
        for _ in range(8):
            x, z = rng.normal(size=2)
            t = float(rng.random() < 1 / (1 + np.exp(-0.8 * x)))
            rows.append((g, t, float(1 + 2 * x - z + 0.6 * t + rng.normal(0, 0.5)), float(x), float(z)))
    df = spark.createDataFrame(rows, "g int, t double, y double, x double, z double")
    got = doubly_robust(df, "g", "t", "y", ["x", "z"]).first()
    naive = np.mean([r[2] for r in rows if r[1]]) - np.mean([r[2] for r in rows if not r[1]])
    assert got.att == pytest.approx(0.6, abs=0.1) and abs(naive - 0.6) > 0.5 and got.n == 2000 and 0.01 < got.se < 0.06


def test_boosted_rows_are_predicted_once_by_models_that_never_saw_their_group(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(900, 2))
    rows = [(k, k // 9, float(a), float(b), float(rng.random() < 1 / (1 + np.exp(-2.5 * a)))) for k, (a, b) in enumerate(x)]
    # a group's number tells its label: a model that had seen the group would be perfect
    df = spark.createDataFrame(rows, "id int, g int, a double, b double, y double").withColumn("leak", F.col("g").cast("double"))
    out = boosted_out_of_fold(df, ["id"], "g", "y", ["a", "b", "leak"]).cache()
    assert out.select("id").distinct().count() == out.count() == 900
    score = auc(out.withColumn("one", F.lit(1)).withColumn("yi", F.col("y").cast("int")), "raw", "yi", ["one"]).first().auc
    assert 0.8 < score < 0.97
    assert out.agg(F.avg("calibrated")).first()[0] == pytest.approx(np.mean([r[4] for r in rows]), abs=0.01)


def test_the_cascade_takes_the_first_pass_that_is_clear(spark, tmp_path):
    players = [(1, "Ana María", "Belinor", "FC A"), (2, "Robert", "Tororstra", "FC A"), (3, "Karl", "Bo", "FC A"), (4, "Karl", "Bo", "FC A"), (5, "Ana María", "Belinor", "FC B"), (None, "X", "Y", "FC A"), (6, None, None, "FC A")]
    typed = [(10, "belinor ana maria", "fc a "), (11, "Ana Belinor", "FC A"), (12, "Rubert Tororsta", "FC A"), (13, "Karl Bo", "FC A"), (14, "Ana Belinor", None), (15, None, "FC A"), (16, "Nobody Here", "FC A"), (17, "Robertinho Torstra", "FC A"), (18, "Any", "FC A"), (10, "belinor ana maria", "fc a ")]
    spark.createDataFrame(players, "id long, firstName string, lastName string, team_name string").write.parquet(f"{tmp_path}/players.parquet")
    spark.createDataFrame(typed, "sb_player_id long, sb_player_name string, team_name string").write.parquet(f"{tmp_path}/sb_to_pff_player_map.parquet")
    shown = lambda df: {tuple(r) for r in df.select("sb_player_id", "pff_player_id", "pass_no").collect()}
    assert shown(name_cascade(spark, str(tmp_path))) == {(10, 1, 1), (11, 1, 2), (12, 2, 3), (17, 2, 4)}
    assert shown(name_cascade(spark, str(tmp_path), {16: 3, 12: 4})) == {(10, 1, 1), (11, 1, 2), (12, 4, 0), (16, 3, 0), (17, 2, 4)}
