"""Statistical queries: calibration, panels, balance, discontinuities, shrinkage, learned models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitchloom.models import folds
from pitchloom.operators import kernels, stats
from pitchloom.plans import relational as R
from pitchloom.plans.relational import GOALS, PANEL, PM
from pitchloom.session import table

QUERIES: dict = {}
ORACLE: dict = {}


def q(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


_TM = "(SELECT DISTINCT match_id, minute_bin, 1 / (1 + exp(-(0.5 * score_diff + 0.003 * elo_diff))) AS p, (y > 1)::INT AS y FROM training_matrix WHERE score_diff IS NOT NULL AND elo_diff IS NOT NULL AND y IS NOT NULL)"


def _scores(s, d):
    t = table(s, d, "training_matrix").dropna(subset=["score_diff", "elo_diff", "y"])
    return t.select("match_id", "minute_bin", (1 / (1 + F.exp(-(0.5 * F.col("score_diff") + 0.003 * F.col("elo_diff"))))).alias("p"), (F.col("y") > 1).cast("int").alias("y")).distinct()


@q("k06_auc", f"WITH t AS (SELECT round(p, 9) AS p, y FROM {_TM}), c AS (SELECT p, sum(y) AS pos, count(*) AS n FROM t GROUP BY 1), r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c) SELECT round((sum(pos * (below + (n + 1) / 2.0)) - sum(pos) * (sum(pos) + 1) / 2.0) / (sum(pos) * (sum(n) - sum(pos))), 6) AS auc FROM r")
def _(s, d):
    t = _scores(s, d).withColumns({"p": F.round("p", 9), "g": F.lit(0)})
    return stats.auc(t, "p", "y", ["g"]).select(F.round("auc", 6).alias("auc"))


@q("k07_calibration_curve", f"SELECT least(floor(p * 10), 9)::BIGINT AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS mean_y FROM {_TM} GROUP BY 1")
def _(s, d):
    return stats.calibration(_scores(s, d), "p", "y", 10).select("bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("mean_y", 6).alias("mean_y"))


@q("k08_murphy", f"WITH c AS (SELECT least(floor(p * 10), 9) AS b, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM {_TM} GROUP BY 1), a AS (SELECT sum(n) AS t, sum(n * my) / sum(n) AS base FROM c) SELECT round(sum(n / t * pow(mp - my, 2)), 6) AS reliability, round(sum(n / t * pow(my - base, 2)), 6) AS resolution, round(any_value(base * (1 - base)), 6) AS uncertainty FROM c, a")
def _(s, d):
    return stats.murphy(_scores(s, d), "p", "y", 10).select(*[F.round(c, 6).alias(c) for c in ("reliability", "resolution", "uncertainty")])


@q("k09_ece", f"WITH c AS (SELECT least(floor(p * 10), 9) AS b, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM {_TM} GROUP BY 1) SELECT round(sum(n * abs(mp - my)) / sum(n), 6) AS ece, round(max(abs(mp - my)), 6) AS mce FROM c")
def _(s, d):
    return stats.murphy(_scores(s, d), "p", "y", 10).select(F.round("ece", 6).alias("ece"), F.round("mce", 6).alias("mce"))


@q("a30_brier_per_minute", f"SELECT minute_bin, round(avg(pow(p - y, 2)), 6) AS brier FROM {_TM} GROUP BY 1")
def _(s, d):
    return _scores(s, d).groupBy("minute_bin").agg(F.round(F.avg(F.pow(F.col("p") - F.col("y"), 2)), 6).alias("brier"))


_FE = f"""WITH r AS (SELECT channel, pff_player_id, shock_id, outcome AS y, post AS x FROM {PANEL} WHERE outcome IS NOT NULL AND post IS NOT NULL AND relative_min <> 0),
w AS (SELECT channel, pff_player_id, y - avg(y) OVER u AS y, x - avg(x) OVER u AS x FROM r WINDOW u AS (PARTITION BY channel, pff_player_id, shock_id)),
c AS (SELECT channel, pff_player_id, sum(x * y) AS xy, sum(x * x) AS xx, count(*) AS m FROM w GROUP BY 1, 2)"""


@q("k12_fixed_effects", f"{_FE}, b AS (SELECT channel, sum(xy) / sum(xx) AS beta FROM c GROUP BY 1) SELECT channel, round(any_value(beta), 6) AS beta, round(sqrt(sum(pow(xy - beta * xx, 2))) / sum(xx), 6) AS se, sum(m)::BIGINT AS n FROM c JOIN b USING (channel) GROUP BY 1")
def _(s, d):
    rows = R.panel(s, d).where("relative_min <> 0")
    return stats.within_effect(rows, "outcome", "post", ["pff_player_id", "shock_id"], "pff_player_id", ["channel"]).select("channel", F.round("beta", 6).alias("beta"), F.round("se", 6).alias("se"), "n")


@q("k14_event_study", f"WITH m AS (SELECT channel, relative_min, avg(outcome) AS m FROM {PANEL} WHERE outcome IS NOT NULL GROUP BY 1, 2) SELECT m.channel, m.relative_min::BIGINT AS rel, round(m.m - b.m, 6) AS effect FROM m JOIN m b ON b.channel = m.channel AND b.relative_min = -1")
def _(s, d):
    m = R.panel(s, d).dropna(subset=["outcome"]).groupBy("channel", "relative_min").agg(F.avg("outcome").alias("m"))
    ref = F.max(F.when(F.col("relative_min") == -1, F.col("m"))).over(Window.partitionBy("channel"))
    return m.withColumn("ref", ref).where("ref IS NOT NULL").select("channel", F.col("relative_min").cast("long").alias("rel"), F.round(F.col("m") - F.col("ref"), 6).alias("effect"))


@q("k15_imputation", f"WITH b AS (SELECT channel, pff_player_id, shock_id, avg(outcome) AS base FROM {PANEL} WHERE relative_min < 0 AND outcome IS NOT NULL GROUP BY ALL) SELECT p.channel, round(avg(p.outcome - b.base), 6) AS att, count(*) AS n FROM {PANEL} p JOIN b USING (channel, pff_player_id, shock_id) WHERE p.relative_min > 0 AND p.outcome IS NOT NULL GROUP BY 1")
def _(s, d):
    w = Window.partitionBy("channel", "pff_player_id", "shock_id")
    p = R.panel(s, d).dropna(subset=["outcome", "pff_player_id", "shock_id"]).withColumn("base", F.avg(F.when(F.col("relative_min") < 0, F.col("outcome"))).over(w))
    return p.where("relative_min > 0 AND base IS NOT NULL").groupBy("channel").agg(F.round(F.avg(F.col("outcome") - F.col("base")), 6).alias("att"), F.count(F.lit(1)).alias("n"))


@q("k16_bounds", f"WITH b AS (SELECT channel, relative_min, avg(outcome) AS m FROM {PANEL} GROUP BY 1, 2), j AS (SELECT channel, max(abs(m - pm)) AS jump FROM (SELECT channel, relative_min, m, lag(m) OVER (PARTITION BY channel ORDER BY relative_min) AS pm FROM b WHERE relative_min < 0) GROUP BY 1), e AS (SELECT channel, avg(m) AS eff, avg(relative_min) AS tau FROM b WHERE relative_min > 0 GROUP BY 1) SELECT channel, mult, round(eff - mult * jump * tau, 6) AS lo, round(eff + mult * jump * tau, 6) AS hi FROM e JOIN j USING (channel), (SELECT unnest([0.5, 1.0, 2.0])::DOUBLE AS mult)")
def _(s, d):
    b = R.panel(s, d).groupBy("channel", "relative_min").agg(F.avg("outcome").alias("m"))
    step = F.abs(F.col("m") - F.lag("m").over(Window.partitionBy("channel").orderBy("relative_min")))
    marked = b.withColumn("step", F.when(F.col("relative_min") < 0, step))
    after = F.col("relative_min") > 0
    e = marked.groupBy("channel").agg(F.avg(F.when(after, F.col("m"))).alias("eff"), F.avg(F.when(after, F.col("relative_min"))).alias("tau"), F.max("step").alias("jump"))
    e = e.select("*", F.explode(F.array(F.lit(0.5), F.lit(1.0), F.lit(2.0))).alias("mult"))
    reach = F.col("mult") * F.col("jump") * F.col("tau")
    return e.select("channel", "mult", F.round(F.col("eff") - reach, 6).alias("lo"), F.round(F.col("eff") + reach, 6).alias("hi"))


@q("k18_pooled_difference", f"SELECT channel, round(avg(outcome_player_abs) FILTER (post = 1) - avg(outcome_player_abs) FILTER (post = 0), 6) AS pooled FROM {PANEL} GROUP BY 1")
def _(s, d):
    y = F.col("outcome_player_abs")
    return R.panel(s, d).groupBy("channel").agg(F.round(F.avg(F.when(F.col("post") == 1, y)) - F.avg(F.when(F.col("post") == 0, y)), 6).alias("pooled"))


@q("k20_icc", f"WITH g AS (SELECT pff_player_id, count(*) AS n, avg(outcome) AS m, coalesce(var_samp(outcome), 0) AS v FROM {PANEL} WHERE outcome IS NOT NULL GROUP BY 1), o AS (SELECT sum(n) AS N_, count(*) AS k, sum(n * n) AS n2, sum(n * m) AS s, sum((n - 1) * v) AS ssw, sum(n * m * m) AS q FROM g), x AS (SELECT N_, k, ssw / (N_ - k) AS msw, (q - s * s / N_) / (k - 1) AS msb, (N_ - n2 / N_) / (k - 1) AS n0 FROM o) SELECT round((msb - msw) / (msb + (n0 - 1) * msw), 6) AS icc, round(1 + (N_ / k - 1) * (msb - msw) / (msb + (n0 - 1) * msw), 6) AS design_effect FROM x")
def _(s, d):
    return stats.icc(R.panel(s, d), "pff_player_id", "outcome").select(F.round("icc", 6).alias("icc"), F.round("design_effect", 6).alias("design_effect"))


@q("k23_stage_strata", f"SELECT coalesce(stage, 'none') AS stage, channel, round(avg(outcome) FILTER (post = 1) - avg(outcome) FILTER (post = 0), 6) AS ate FROM {PANEL} GROUP BY 1, 2 UNION ALL SELECT 'all', channel, round(avg(outcome) FILTER (post = 1) - avg(outcome) FILTER (post = 0), 6) FROM {PANEL} GROUP BY 2")
def _(s, d):
    y = F.col("outcome")
    ate = F.round(F.avg(F.when(F.col("post") == 1, y)) - F.avg(F.when(F.col("post") == 0, y)), 6).alias("ate")
    rows = R.panel(s, d).withColumn("st", F.coalesce("stage", F.lit("none")))
    return rows.groupingSets([["st", "channel"], ["channel"]], "st", "channel").agg(ate, F.grouping("st").alias("g")).select(F.when(F.col("g") == 1, "all").otherwise(F.col("st")).alias("stage"), "channel", "ate")


@q("k27_discontinuity", "WITH r AS (SELECT o_totalprice - 150000 AS d, (o_orderstatus = 'F')::INT AS y, 1 - abs(o_totalprice - 150000) / 40000 AS w FROM orders WHERE abs(o_totalprice - 150000) < 40000), m AS (SELECT d >= 0 AS r, sum(w) AS s0, sum(w * d) AS s1, sum(w * d * d) AS s2, sum(w * y) AS t0, sum(w * d * y) AS t1, count(*) AS n FROM r GROUP BY 1), a AS (SELECT r, n, (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) AS v FROM m) SELECT round(max(v) FILTER (r) - max(v) FILTER (NOT r), 6) AS jump, sum(n)::BIGINT AS n FROM a")
def _(s, d):
    o = table(s, d, "orders").select("o_totalprice", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return stats.local_linear_jump(o, "o_totalprice", "y", 150000.0, 40000.0).select(F.round("jump", 6).alias("jump"), "n")


@q("k29_balance", "WITH r AS (SELECT (o_orderpriority = '1-URGENT')::INT AS t, o_totalprice AS a, o_custkey::DOUBLE AS b FROM orders), l AS (SELECT t, 'o_totalprice' AS covariate, a AS v FROM r UNION ALL SELECT t, 'o_custkey', b FROM r) SELECT covariate, round((avg(v) FILTER (t = 1) - avg(v) FILTER (t = 0)) / sqrt((var_pop(v) FILTER (t = 1) + var_pop(v) FILTER (t = 0)) / 2), 6) AS smd FROM l GROUP BY 1")
def _(s, d):
    o = table(s, d, "orders").select((F.col("o_orderpriority") == "1-URGENT").cast("int").alias("t"), "o_totalprice", "o_custkey")
    return stats.smd(o, "t", ["o_totalprice", "o_custkey"]).select("covariate", F.round("smd", 6).alias("smd"))


@q("k30_robustness", f"{_FE}, b AS (SELECT channel, sum(xy) / sum(xx) AS beta FROM c GROUP BY 1), e AS (SELECT channel, any_value(beta) / (sqrt(sum(pow(xy - beta * xx, 2))) / sum(xx)) AS t, sum(m) - 2 AS dof FROM c JOIN b USING (channel) GROUP BY 1) SELECT channel, round(0.5 * (sqrt(pow(t * t / dof, 2) + 4 * t * t / dof) - t * t / dof), 5) AS rv FROM e")
def _(s, d):
    e = stats.within_effect(R.panel(s, d).where("relative_min <> 0"), "outcome", "post", ["pff_player_id", "shock_id"], "pff_player_id", ["channel"])
    return e.select("channel", F.round(stats.robustness_value(F.col("beta") / F.col("se"), F.col("n") - 2), 5).alias("rv"))


@q("k11_shrunk_means", f"WITH g AS (SELECT pff_player_id, count(*) AS n, avg(psv95) AS m, coalesce(var_samp(psv95), 0) AS v FROM {PM} WHERE psv95 BETWEEN 0 AND 12.5 GROUP BY 1), o AS (SELECT sum(n) AS N_, count(*) AS k, sum(n * n) AS n2, sum(n * m) / sum(n) AS g, sum((n - 1) * v) AS ssw, sum(n * m * m) AS q FROM g), t AS (SELECT g, ssw / (N_ - k) AS w, greatest(((q - N_ * g * g) / (k - 1) - ssw / (N_ - k)) / ((N_ - n2 / N_) / (k - 1)), 0) AS b FROM o) SELECT pff_player_id, round(t.g + b / (b + w / n) * (m - t.g), 5) AS shrunk FROM g, t")
def _(s, d):
    rows = R.minutes(s, d).where("psv95 BETWEEN 0 AND 12.5")
    return stats.shrink(rows, "pff_player_id", "psv95").select("pff_player_id", F.round("shrunk", 5).alias("shrunk"))


@q("k33_rhat", f"WITH c AS (SELECT channel, perspective AS chain, avg(outcome) AS m, var_samp(outcome) AS v, count(*) AS n FROM {PANEL} WHERE outcome IS NOT NULL AND perspective IS NOT NULL GROUP BY 1, 2) SELECT channel, round(sqrt(((avg(n) - 1) / avg(n) * avg(v) + var_samp(m)) / avg(v)), 6) AS rhat FROM c GROUP BY 1")
def _(s, d):
    c = R.panel(s, d).dropna(subset=["outcome", "perspective"]).groupBy("channel", "perspective").agg(F.avg("outcome").alias("m"), F.var_samp("outcome").alias("v"), F.count(F.lit(1)).alias("n"))
    return c.groupBy("channel").agg(F.round(F.sqrt(((F.avg("n") - 1) / F.avg("n") * F.avg("v") + F.var_samp("m")) / F.avg("v")), 6).alias("rhat"))


@q("k34_ks", f"WITH c AS (SELECT outcome AS v, count(*) FILTER (post = 0) AS a, count(*) FILTER (post = 1) AS b FROM {PANEL} WHERE outcome IS NOT NULL GROUP BY 1), r AS (SELECT sum(a) OVER w / (SELECT sum(a) FROM c) AS fa, sum(b) OVER w / (SELECT sum(b) FROM c) AS fb FROM c WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING)) SELECT round(max(abs(fa - fb)), 6) AS ks FROM r")
def _(s, d):
    return stats.ks_distance(R.panel(s, d), "post", "outcome", 0, 1).select(F.round("ks", 6).alias("ks"))


@q("k19_placebo")
def _(s, d):
    return kernels.placebo(R.panel(s, d), "channel", "pff_player_id", "relative_min", "outcome", 1000)


@q("k24_doubly_robust")
def _(s, d):
    p = R.panel(s, d).where("relative_min > 0").dropna(subset=["outcome", "leverage", "pff_player_id", "relative_min", "perspective"])
    rows = p.select("panel_id", F.col("pff_player_id").alias("g"), (F.col("perspective") == "GOAL_AGAINST").cast("double").alias("t"), F.col("outcome").alias("y"), "leverage", F.col("relative_min").cast("double").alias("rel"))
    return folds.doubly_robust(rows, "g", "t", "y", ["leverage", "rel"])


@q("k03_boosted_oof")
def _(s, d):
    t = table(s, d, "training_matrix").dropna().distinct()
    rows = t.select("match_id", "minute_bin", (F.col("y") > 1).cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in ("score_diff", "red_diff", "elo_diff", "shots_diff_recent")])
    return folds.boosted_out_of_fold(rows, ["match_id", "minute_bin"], "match_id", "label", ["score_diff", "red_diff", "elo_diff", "shots_diff_recent"])


@q("t05_elo", f"""WITH RECURSIVE per AS (SELECT match_id, scoring_team_id AS team, count(*) AS n FROM {GOALS} WHERE match_id IS NOT NULL AND scoring_team_id IS NOT NULL GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY n DESC, team) AS k FROM per),
gm AS (SELECT a.match_id, a.team AS x, b.team AS y, a.n AS nx, b.n AS ny, row_number() OVER (ORDER BY a.match_id, a.team) AS i FROM rk a JOIN rk b ON b.match_id = a.match_id AND a.k = 1 AND b.k = 2),
r AS (SELECT 0::BIGINT AS i, MAP {{-1::BIGINT: 0.0::DOUBLE}} AS m, NULL::BIGINT AS game, NULL::BIGINT AS home, NULL::BIGINT AS away, NULL::DOUBLE AS rx, NULL::DOUBLE AS ry
UNION ALL SELECT i, map_concat(m, MAP {{x: rx + 20 * ((CASE WHEN nx > ny THEN 1.0 WHEN nx = ny THEN 0.5 ELSE 0.0 END) - 1 / (1 + pow(10, (ry - rx - 100) / 400))), y: ry - 20 * ((CASE WHEN nx > ny THEN 1.0 WHEN nx = ny THEN 0.5 ELSE 0.0 END) - 1 / (1 + pow(10, (ry - rx - 100) / 400)))}}), match_id, x, y, rx, ry
FROM (SELECT gm.*, r.m, coalesce(r.m[gm.x], 1500.0) AS rx, coalesce(r.m[gm.y], 1500.0) AS ry FROM r JOIN gm ON gm.i = r.i + 1))
SELECT game, home, away, round(rx, 6) AS before_home, round(ry, 6) AS before_away FROM r WHERE game IS NOT NULL""")
def _(s, d):
    g = R.goals(s, d).dropna(subset=["match_id", "scoring_team_id"])
    per = g.groupBy("match_id", F.col("scoring_team_id").alias("team")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("match_id").orderBy(F.desc("n"), "team")
    two = per.withColumns({"k": F.row_number().over(w)}).where("k <= 2").groupBy("match_id").pivot("k", [1, 2]).agg(F.struct(F.first("team").alias("team"), F.first("n").alias("n")))
    games = two.select("match_id", F.col("1.team").alias("a"), F.col("2.team").alias("b"), F.col("1.n").alias("ga"), F.coalesce("2.n", F.lit(0)).alias("gb")).where("b IS NOT NULL")
    return kernels.elo(games, "match_id", "a", "b", "ga", "gb").select("game", "home", "away", F.round("before_home", 6).alias("before_home"), F.round("before_away", 6).alias("before_away"))


@q("c16_smoothed_speed")
def _(s, d):
    from pitchloom.plans.analytic import positions

    return kernels.smooth_speed(positions(s, d), ["game", "num"], "t", "frame_id", "x", "y", 5.0)


@q("c13_pitch_control")
def _(s, d):
    t = table(s, d, "tracking").dropDuplicates(["frame_id"]).select("frame_id", "homePlayers", "awayPlayers", F.get("balls", F.lit(0)).alias("ball"))
    return kernels.pitch_control(t, "frame_id", "homePlayers", "awayPlayers", "ball")


@q("c19_qualification")
def _(s, d):
    # groups are drawn by team number, as no table holds fixtures; a team's rate is its goals per match
    e = table(s, d, "events_enriched").select("match_id", F.col("team_id").alias("team")).dropna().distinct().groupBy("team").agg(F.count(F.lit(1)).alias("matches"))
    g = R.goals(s, d).where("scoring_team_id IS NOT NULL").groupBy(F.col("scoring_team_id").alias("team")).agg(F.count(F.lit(1)).alias("goals"))
    r = e.join(g, "team", "left").select(F.floor(F.col("team") / 4).cast("long").alias("grp"), "team", (F.coalesce("goals", F.lit(0)) / F.col("matches")).alias("rate"))
    return kernels.qualification(r, "grp", "team", "rate", sims=1500)


@q("k36_group_split", f"SELECT match_id, count(*) AS n FROM {GOALS} WHERE match_id IS NOT NULL GROUP BY 1")
def _(s, d):
    g = R.goals(s, d).where("match_id IS NOT NULL")
    parts = folds.split_groups(g, "match_id", 0.8)
    return parts.groupBy("match_id").agg(F.count(F.lit(1)).alias("n"))
