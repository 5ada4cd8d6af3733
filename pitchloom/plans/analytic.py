"""Windows, rankings, islands and the composite event-anchored operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchloom.functions import scalar as S
from pitchloom.functions.text import name_norm, null_if_sentinel
from pitchloom.operators.asof import window_contrast
from pitchloom.operators.blocks import leave_one_out, on_grid, others_mean
from pitchloom.operators.islands import debounce, segment_id
from pitchloom.operators.ranking import bh_adjust, ordinal_rank, percentile_average, percentile_ordinal, top_per_group, z_score
from pitchloom.plans import relational as R
from pitchloom.plans.relational import EV, GOALS, PANEL, PCJ, PLAYERS, PM
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


# --- windows ---
@q("w01_running_count", f"SELECT goal_id, sum(CASE WHEN is_own_goal THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY start_game_clock NULLS FIRST, goal_id ROWS UNBOUNDED PRECEDING)::BIGINT AS own, count(*) OVER (PARTITION BY match_id ORDER BY start_game_clock NULLS FIRST, goal_id ROWS UNBOUNDED PRECEDING) AS n FROM {GOALS}")
def _(s, d):
    w = Window.partitionBy("match_id").orderBy("start_game_clock", "goal_id").rowsBetween(Window.unboundedPreceding, 0)
    return R.goals(s, d).select("goal_id", F.sum(F.when(F.col("is_own_goal"), 1).otherwise(0)).over(w).alias("own"), F.count(F.lit(1)).over(w).alias("n"))


@q("w02_lead", f"SELECT event_id, lead(team_id) OVER (PARTITION BY match_id ORDER BY startTime NULLS FIRST, event_id) AS next_team FROM {EV}")
def _(s, d):
    w = Window.partitionBy("match_id").orderBy("startTime", "event_id")
    return R.events(s, d, "match_id", "startTime", "team_id").select("event_id", F.lead("team_id").over(w).alias("next_team"))


@q("w03_own_next_three", f"SELECT event_id, (coalesce(lead(team_id, 1) OVER w = team_id, false)::BIGINT + coalesce(lead(team_id, 2) OVER w = team_id, false)::BIGINT + coalesce(lead(team_id, 3) OVER w = team_id, false)::BIGINT >= 2) AS kept FROM {EV} WINDOW w AS (PARTITION BY match_id ORDER BY period NULLS FIRST, startTime NULLS FIRST, event_id)")
def _(s, d):
    w = Window.partitionBy("match_id").orderBy("period", "startTime", "event_id")
    own = [F.coalesce(F.lead("team_id", k).over(w) == F.col("team_id"), F.lit(False)).cast("int") for k in (1, 2, 3)]
    return R.events(s, d, "match_id", "period", "startTime", "team_id").select("event_id", (own[0] + own[1] + own[2] >= 2).alias("kept"))


@q("w05_clipped_z", f"SELECT panel_id, round(least(greatest(coalesce((outcome - avg(outcome) OVER w) / nullif(stddev_samp(outcome) OVER w, 0), 0), -5), 5), 5) AS z FROM {PANEL} WHERE outcome IS NOT NULL WINDOW w AS (PARTITION BY channel, perspective)")
def _(s, d):
    return R.panel(s, d).where("outcome IS NOT NULL").select("panel_id", F.round(z_score("outcome", ["channel", "perspective"], 5.0), 5).alias("z"))


@q("w07_global_z", f"SELECT panel_id, round(coalesce((leverage - (SELECT avg(leverage) FROM {PANEL})) / (SELECT stddev_samp(leverage) FROM {PANEL}), 0), 5) AS z FROM {PANEL}")
def _(s, d):
    p = R.panel(s, d)
    m, sd = (p.agg(f("leverage")).scalar() for f in (F.avg, F.stddev_samp))
    return p.select("panel_id", F.round(F.coalesce(F.try_divide(F.col("leverage") - m, sd), F.lit(0.0)), 5).alias("z"))


@q("w08_ordinal_rank", f"SELECT edition_id, pff_player_id, CASE WHEN v IS NOT NULL THEN row_number() OVER (PARTITION BY edition_id ORDER BY v DESC NULLS LAST, pff_player_id) END AS rk FROM (SELECT *, CASE WHEN isnan(chasing_clutch_idx) THEN NULL ELSE chasing_clutch_idx END AS v FROM {PCJ})")
def _(s, d):
    p = R.pcj(s, d).withColumn("v", F.when(~F.isnan("chasing_clutch_idx"), F.col("chasing_clutch_idx")))
    return p.select("edition_id", "pff_player_id", ordinal_rank("v", ["pff_player_id"], ["edition_id"]).cast("long").alias("rk"))


@q("w09_percentile", f"SELECT edition_id, pff_player_id, round(CASE WHEN minutes_played IS NOT NULL THEN row_number() OVER (PARTITION BY edition_id ORDER BY minutes_played NULLS LAST, pff_player_id) / count(minutes_played) OVER (PARTITION BY edition_id) END, 6) AS pct FROM {PCJ}")
def _(s, d):
    return R.pcj(s, d).select("edition_id", "pff_player_id", F.round(percentile_ordinal("minutes_played", ["pff_player_id"], ["edition_id"]), 6).alias("pct"))


@q("w10_average_rank_percentile", f"SELECT edition_id, pff_player_id, round(CASE WHEN minutes_played IS NOT NULL THEN (rank() OVER (PARTITION BY edition_id, position_group ORDER BY minutes_played NULLS LAST) + (count(*) OVER (PARTITION BY edition_id, position_group, minutes_played) - 1) / 2.0) / count(minutes_played) OVER (PARTITION BY edition_id, position_group) END, 6) AS pct FROM {PCJ}")
def _(s, d):
    return R.pcj(s, d).select("edition_id", "pff_player_id", F.round(percentile_average("minutes_played", ["edition_id", "position_group"]), 6).alias("pct"))


@q("w11_rolling_shots", "SELECT match_id, minute_bin, sum(abs(coalesce(shots_diff_recent, 0))) OVER (PARTITION BY match_id ORDER BY minute_bin ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)::BIGINT AS recent FROM (SELECT DISTINCT * FROM training_matrix) WHERE match_id IS NOT NULL AND minute_bin IS NOT NULL")
def _(s, d):
    w = Window.partitionBy("match_id").orderBy("minute_bin").rowsBetween(-10, -1)
    t = table(s, d, "training_matrix").distinct().where("match_id IS NOT NULL AND minute_bin IS NOT NULL")
    return t.select("match_id", "minute_bin", F.sum(F.abs(F.coalesce("shots_diff_recent", F.lit(0)))).over(w).alias("recent"))


@q("w12_state_before", f"SELECT goal_id, coalesce(sum(1) OVER (PARTITION BY match_id ORDER BY start_game_clock NULLS FIRST, goal_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM {GOALS}")
def _(s, d):
    w = Window.partitionBy("match_id").orderBy("start_game_clock", "goal_id").rowsBetween(Window.unboundedPreceding, -1)
    return R.goals(s, d).select("goal_id", F.coalesce(F.sum(F.lit(1)).over(w), F.lit(0)).cast("long").alias("before"))


@q("w13_max_jump", f"WITH b AS (SELECT channel, relative_min, avg(outcome) AS m FROM {PANEL} GROUP BY 1, 2) SELECT channel, round(max(abs(j)), 6) AS jump FROM (SELECT channel, m - lag(m) OVER (PARTITION BY channel ORDER BY relative_min) AS j FROM b) GROUP BY 1")
def _(s, d):
    b = R.panel(s, d).groupBy("channel", "relative_min").agg(F.avg("outcome").alias("m"))
    j = F.col("m") - F.lag("m").over(Window.partitionBy("channel").orderBy("relative_min"))
    return b.select("channel", j.alias("j")).groupBy("channel").agg(F.round(F.max(F.abs("j")), 6).alias("jump"))


_HOME = "(SELECT frame_id, game, t, num, x, y FROM (SELECT frame_id, gameRefId::BIGINT AS game, videoTimeMs AS t, TRY_CAST(TRY_CAST(trim(p.jerseyNum) AS DOUBLE) AS BIGINT) AS num, p.x AS x, p.y AS y FROM (SELECT frame_id, gameRefId, videoTimeMs, unnest(homePlayers) AS p FROM (SELECT DISTINCT * FROM tracking))) WHERE num IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL QUALIFY row_number() OVER (PARTITION BY frame_id, num ORDER BY x, y) = 1)"


def positions(s, d) -> DataFrame:
    """One home position per frame and shirt; of a shirt listed twice the entry of smaller (x, y)."""
    from pitchloom.operators.nested import whole_number_column

    t = table(s, d, "tracking").dropDuplicates(["frame_id"]).select("frame_id", F.col("gameRefId").cast("long").alias("game"), F.col("videoTimeMs").alias("t"), F.explode("homePlayers").alias("p"))
    rows = t.select("frame_id", "game", "t", whole_number_column(F.col("p.jerseyNum")).alias("num"), F.col("p.x").alias("x"), F.col("p.y").alias("y")).dropna(subset=["num", "x", "y"])
    return rows.groupBy("frame_id", "game", "t", "num").agg(F.min(F.struct("x", "y")).alias("at")).select("frame_id", "game", "t", "num", "at.x", "at.y")


@q("w14_velocity", f"SELECT frame_id, num, round(CASE WHEN lag(x) OVER w IS NOT NULL AND t > lag(t) OVER w THEN least(greatest((x - lag(x) OVER w) / ((t - lag(t) OVER w) / 1000), -12), 12) END, 5) AS vx FROM {_HOME} WINDOW w AS (PARTITION BY game, num ORDER BY t, frame_id)")
def _(s, d):
    w = Window.partitionBy("game", "num").orderBy("t", "frame_id")
    v = F.try_divide(F.col("x") - F.lag("x").over(w), (F.col("t") - F.lag("t").over(w)) / 1000)
    return positions(s, d).select("frame_id", "num", F.round(F.when(v.isNotNull(), F.greatest(F.least(v, F.lit(12.0)), F.lit(-12.0))), 5).alias("vx"))


@q("w15_position_two_seconds_ago", f"SELECT frame_id, num, lag(x, 10) OVER (PARTITION BY game, num ORDER BY t, frame_id) AS x_then FROM {_HOME}")
def _(s, d):
    return positions(s, d).select("frame_id", "num", F.lag("x", 10).over(Window.partitionBy("game", "num").orderBy("t", "frame_id")).alias("x_then"))


@q("w16_gradient", f"SELECT frame_id, num, round(coalesce((lead(x) OVER w - lag(x) OVER w) / 2, lead(x) OVER w - x, x - lag(x) OVER w), 6) AS g FROM {_HOME} WINDOW w AS (PARTITION BY game, num ORDER BY t, frame_id)")
def _(s, d):
    w = Window.partitionBy("game", "num").orderBy("t", "frame_id")
    ahead, behind, x = F.lead("x").over(w), F.lag("x").over(w), F.col("x")
    return positions(s, d).select("frame_id", "num", F.round(F.coalesce((ahead - behind) / 2, ahead - x, x - behind), 6).alias("g"))


@q("w17_segments", f"""WITH m AS (SELECT game, num, t, frame_id, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(t) OVER w AS pt FROM {_HOME} WINDOW w AS (PARTITION BY game, num ORDER BY t, frame_id))
SELECT frame_id, num, sum(CASE WHEN sqrt((x - px) * (x - px) + (y - py) * (y - py)) > 12 * (t - pt) / 1000 THEN 1 ELSE 0 END) OVER (PARTITION BY game, num ORDER BY t, frame_id ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM m""")
def _(s, d):
    w = Window.partitionBy("game", "num").orderBy("t", "frame_id")
    p = positions(s, d).withColumns({"px": F.lag("x").over(w), "py": F.lag("y").over(w), "pt": F.lag("t").over(w)})
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    jump = F.sqrt(dx * dx + dy * dy) > 12 * (F.col("t") - F.col("pt")) / 1000
    return p.select("frame_id", "num", segment_id(jump, ["game", "num"], ["t", "frame_id"]).alias("segment"))


@q("w18_run_events", f"""WITH r AS (SELECT pff_player_id, pff_match_id, period, minute_in_period AS m FROM {PM} WHERE minute_in_period IS NOT NULL AND coalesce(sprint_s >= 1, false)),
a AS (SELECT *, m - row_number() OVER (PARTITION BY pff_player_id, pff_match_id, period ORDER BY m) AS g FROM (SELECT DISTINCT * FROM r))
SELECT pff_player_id, pff_match_id, period, min(m) AS event_start, max(m) AS event_end FROM a GROUP BY pff_player_id, pff_match_id, period, g HAVING count(*) >= 2""")
def _(s, d):
    keys = ["pff_player_id", "pff_match_id", "period"]
    rows = R.minutes(s, d).select(*keys, F.col("minute_in_period").alias("m"), "sprint_s").dropna(subset=["m"])
    # minutes that are missing break a run, so runs are found on consecutive numbers
    hot = rows.where(F.coalesce(F.col("sprint_s") >= 1, F.lit(False))).select(*keys, "m").distinct()
    numbered = hot.withColumn("g", F.col("m") - F.row_number().over(Window.partitionBy(*keys).orderBy("m")))
    spans = numbered.groupBy(*keys, "g").agg(F.min("m").alias("event_start"), F.max("m").alias("event_end"), F.count(F.lit(1)).alias("n"))
    return spans.where("n >= 2").drop("g", "n")


_STEADY = """f AS (SELECT DISTINCT frame_id, gameRefId::BIGINT AS game, period::BIGINT AS period, coalesce(game_event.home_ball, false) AS home_ball FROM tracking),
r AS (SELECT *, sum(c) OVER (PARTITION BY game, period ORDER BY frame_id) AS run FROM (SELECT *, CASE WHEN lag(home_ball) OVER w IS DISTINCT FROM home_ball THEN 1 ELSE 0 END AS c FROM f WINDOW w AS (PARTITION BY game, period ORDER BY frame_id))),
n AS (SELECT *, row_number() OVER (PARTITION BY game, period, run ORDER BY frame_id) AS pos FROM r),
st AS (SELECT frame_id, game, period, home_ball, coalesce(last_value(CASE WHEN pos >= 2 THEN home_ball END IGNORE NULLS) OVER w, first_value(home_ball) OVER w) AS steady FROM n WINDOW w AS (PARTITION BY game, period ORDER BY frame_id ROWS UNBOUNDED PRECEDING))"""


@q("w19_debounced_possession", f"WITH {_STEADY} SELECT frame_id, home_ball, steady FROM st")
def _(s, d):
    t = table(s, d, "tracking").dropDuplicates(["frame_id"]).select(F.col("gameRefId").cast("long").alias("game"), F.col("period").cast("long").alias("period"), "frame_id", F.coalesce(F.col("game_event.home_ball"), F.lit(False)).alias("home_ball"))
    return debounce(t, ["game", "period"], ["frame_id"], "home_ball", 2, "steady").select("frame_id", "home_ball", "steady")


@q("w21_bh_adjusted", """WITH p AS (SELECT l_orderkey, l_linenumber, l_tax + l_discount / 10 + 0.0001 AS p, l_returnflag AS f FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY p, l_orderkey, l_linenumber) AS rk, count(*) OVER (PARTITION BY f) AS n FROM p)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(least(min(p * n / rk) OVER (PARTITION BY f ORDER BY rk DESC ROWS UNBOUNDED PRECEDING), 1), 6) AS adjusted FROM r""")
def _(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), (F.col("l_tax") + F.col("l_discount") / 10 + 0.0001).alias("p"), F.col("l_returnflag").alias("f"))
    return bh_adjust(li, "p", ["f"], ["l_orderkey", "l_linenumber"], "adj").select("l_orderkey", "l_linenumber", F.round("adj", 6).alias("adjusted"))


@q("w22_signed_pick", f"SELECT edition_id, pff_player_id, CASE WHEN abs(chasing_clutch_idx) >= abs(protecting_clutch_idx) THEN chasing_clutch_idx ELSE protecting_clutch_idx END AS pick FROM {PCJ} WHERE NOT isnan(chasing_clutch_idx) AND NOT isnan(protecting_clutch_idx)")
def _(s, d):
    a, b = F.col("chasing_clutch_idx"), F.col("protecting_clutch_idx")
    return R.pcj(s, d).where(~F.isnan(a) & ~F.isnan(b) & a.isNotNull() & b.isNotNull()).select("edition_id", "pff_player_id", F.when(F.abs(a) >= F.abs(b), a).otherwise(b).alias("pick"))


@q("w23_minute_from_frame", "SELECT frame_id, floor((frameNum - min(frameNum) OVER (PARTITION BY gameRefId, period)) / 1500)::BIGINT AS minute FROM (SELECT DISTINCT frame_id, gameRefId, period, frameNum FROM tracking)")
def _(s, d):
    t = table(s, d, "tracking").select("frame_id", "gameRefId", "period", "frameNum").distinct()
    return t.select("frame_id", F.floor((F.col("frameNum") - F.min("frameNum").over(Window.partitionBy("gameRefId", "period"))) / 1500).alias("minute"))


@q("o03_top_ten_per_group", f"SELECT edition_id, position_bucket, pff_player_id, rk FROM (SELECT *, row_number() OVER (PARTITION BY edition_id, position_bucket ORDER BY minutes_played DESC NULLS LAST, pff_player_id) AS rk FROM {PCJ}) WHERE rk <= 10")
def _(s, d):
    return top_per_group(R.pcj(s, d), ["edition_id", "position_bucket"], [F.desc_nulls_last("minutes_played"), F.asc("pff_player_id")], 10, "rk").select("edition_id", "position_bucket", "pff_player_id", F.col("rk").cast("long").alias("rk"))


@q("o08_table_rank", f"""WITH t AS (SELECT match_id, scoring_team_id AS team, count(*) AS gf FROM {GOALS} WHERE match_id IS NOT NULL AND scoring_team_id IS NOT NULL GROUP BY 1, 2)
SELECT team, row_number() OVER (ORDER BY sum(gf) DESC, count(*) DESC, team) AS place, sum(gf)::BIGINT AS gf FROM t GROUP BY team""")
def _(s, d):
    t = R.goals(s, d).where("match_id IS NOT NULL AND scoring_team_id IS NOT NULL").groupBy("match_id", F.col("scoring_team_id").alias("team")).agg(F.count(F.lit(1)).alias("gf"))
    by_team = t.groupBy("team").agg(F.sum("gf").alias("gf"), F.count(F.lit(1)).alias("n"))
    # places are counted per number of goals first, so no task ranks all teams
    above = by_team.groupBy("gf").agg(F.count(F.lit(1)).alias("k")).select("gf", F.coalesce(F.sum("k").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("gf")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above"))
    inside = F.row_number().over(Window.partitionBy("gf").orderBy(F.desc("n"), "team"))
    return by_team.join(above, "gf").select("team", (F.col("above") + inside).cast("long").alias("place"), "gf")


# --- composites ---
_ABS = "((period - 1) * 45 + minute_in_period)"
_C05 = f"""m AS (SELECT pff_match_id AS match_id, period, pff_player_id AS player_id, {_ABS} * 60 AS sec, distance_m AS v FROM {PM} WHERE period IS NOT NULL AND minute_in_period IS NOT NULL),
g AS (SELECT goal_id, match_id, period, start_game_clock AS t FROM {GOALS} WHERE match_id IS NOT NULL AND period IS NOT NULL AND start_game_clock IS NOT NULL),
c AS (SELECT g.goal_id, m.player_id, coalesce(sum(v) FILTER (sec >= t - 600 AND sec < t), 0) AS pre, coalesce(sum(v) FILTER (sec >= t AND sec <= t + 600), 0) AS post FROM g JOIN m USING (match_id, period) GROUP BY 1, 2),
l AS (SELECT *, count(*) OVER b AS n, CASE WHEN count(*) OVER b > 1 THEN (sum(pre) OVER b - pre) / (count(*) OVER b - 1) END AS lpre, CASE WHEN count(*) OVER b > 1 THEN (sum(post) OVER b - post) / (count(*) OVER b - 1) END AS lpost FROM c WINDOW b AS (PARTITION BY goal_id))"""


def _minute_values(s, d) -> DataFrame:
    sec = ((F.col("period") - 1) * 45 + F.col("minute_in_period")) * 60
    return R.minutes(s, d).select(F.col("pff_match_id").alias("match_id"), "period", F.col("pff_player_id").alias("player_id"), sec.alias("sec"), F.col("distance_m").alias("v")).dropna(subset=["period", "sec"])


@q("c05_window_contrast", f"WITH {_C05} SELECT goal_id, player_id, round(post - pre, 4) AS delta_player, round(lpost - lpre, 4) AS delta_team_loo, round(post - pre - (lpost - lpre), 4) AS delta_relative FROM l")
def _(s, d):
    shocks = R.goals(s, d).select("goal_id", "match_id", "period", F.col("start_game_clock").alias("at")).dropna()
    both = window_contrast(shocks, _minute_values(s, d), "goal_id", "at", ["match_id", "period"], "player_id", "sec", "v", 600.0)
    out = leave_one_out(both, ["goal_id"])
    return out.select("goal_id", "player_id", *[F.round(c, 4).alias(c) for c in ("delta_player", "delta_team_loo", "delta_relative")])


@q("c06_minute_contrast", f"""WITH p AS (SELECT pff_match_id, period, pff_player_id, minute_in_period AS m, max(distance_m) AS v FROM {PM} WHERE minute_in_period IS NOT NULL AND period IS NOT NULL GROUP BY ALL), mem AS (SELECT DISTINCT pff_match_id, period, pff_player_id FROM p),
g AS (SELECT * FROM mem JOIN (SELECT DISTINCT pff_match_id, period, m FROM p) USING (pff_match_id, period)), f AS (SELECT g.pff_match_id, g.period, g.pff_player_id, g.m, coalesce(p.v, 0) AS v FROM g LEFT JOIN p USING (pff_match_id, period, pff_player_id, m))
SELECT pff_match_id, period, pff_player_id, m, round(v - (CASE WHEN count(*) OVER b > 1 THEN (sum(v) OVER b - v) / (count(*) OVER b - 1) END), 4) AS relative FROM f WINDOW b AS (PARTITION BY pff_match_id, period, m)""")
def _(s, d):
    keys = ["pff_match_id", "period", "pff_player_id"]
    p = R.minutes(s, d).dropna(subset=["minute_in_period", "period"]).groupBy(*keys, F.col("minute_in_period").alias("m")).agg(F.max("distance_m").alias("v"))
    grid = on_grid(p, ["pff_match_id", "period"], "pff_player_id", "m", ["v"])
    return grid.select(*keys, "m", F.round(F.col("v") - others_mean("v", ["pff_match_id", "period", "m"]), 4).alias("relative"))


@q("c09_event_study_panel", f"""WITH m AS (SELECT pff_match_id AS match_id, period, pff_player_id AS player_id, {_ABS} AS minute, max(distance_m) AS v FROM {PM} WHERE period IS NOT NULL AND minute_in_period IS NOT NULL GROUP BY ALL),
g AS (SELECT goal_id, match_id, period, minute AS at_ FROM {GOALS} WHERE match_id IS NOT NULL AND period IS NOT NULL AND minute IS NOT NULL), u AS (SELECT DISTINCT goal_id, match_id, period, at_, player_id FROM g JOIN m USING (match_id, period))
SELECT x.goal_id, x.player_id, x.rel, coalesce(m.v, 0) AS outcome, (x.rel > 0)::BIGINT AS post FROM (SELECT * FROM u, (SELECT unnest(range(-10, 11)) AS rel)) x LEFT JOIN m ON m.match_id = x.match_id AND m.period = x.period AND m.player_id = x.player_id AND m.minute = x.at_ + x.rel""")
def _(s, d):
    m = R.minutes(s, d).select(F.col("pff_match_id").alias("match_id"), "period", F.col("pff_player_id").alias("player_id"), ((F.col("period") - 1) * 45 + F.col("minute_in_period")).alias("minute"), "distance_m").dropna(subset=["period", "minute"])
    m = m.groupBy("match_id", "period", "player_id", "minute").agg(F.max("distance_m").alias("v"))
    g = R.goals(s, d).select("goal_id", "match_id", "period", F.col("minute").alias("at")).dropna()
    # the spine is exploded after the join on the match, so each unit carries its own 21 bins
    units = g.join(m.select("match_id", "period", "player_id").distinct(), ["match_id", "period"])
    bins = units.select("*", F.explode(F.sequence(F.lit(-10).cast("long"), F.lit(10).cast("long"))).alias("rel")).withColumn("minute", F.col("at") + F.col("rel"))
    return bins.join(m, ["match_id", "period", "player_id", "minute"], "left").select("goal_id", "player_id", "rel", F.coalesce("v", F.lit(0.0)).alias("outcome"), (F.col("rel") > 0).cast("long").alias("post"))


@q("c02_playing_intervals", f"SELECT pff_match_id, pff_player_id, min({_ABS}) AS minute_in, max({_ABS}) AS minute_out, greatest(max({_ABS}) - min({_ABS}), 0) AS played FROM {PM} GROUP BY 1, 2")
def _(s, d):
    at = (F.col("period") - 1) * 45 + F.col("minute_in_period")
    return R.minutes(s, d).groupBy("pff_match_id", "pff_player_id").agg(F.min(at).alias("minute_in"), F.max(at).alias("minute_out")).withColumn("played", F.when(F.col("minute_in").isNotNull(), F.greatest(F.col("minute_out") - F.col("minute_in"), F.lit(0))))


@q("c22_credit_sign", f"SELECT panel_id, CASE WHEN outcome > 0 THEN -outcome ELSE abs(outcome) END AS credit FROM {PANEL} WHERE outcome IS NOT NULL")
def _(s, d):
    v = F.col("outcome")
    return R.panel(s, d).where("outcome IS NOT NULL").select("panel_id", F.when(v > 0, -v).otherwise(F.abs(v)).alias("credit"))


@q("c23_pass_success", f"SELECT event_id, success FROM (SELECT event_id, possession_event_type, coalesce(lead(team_id) OVER (PARTITION BY match_id ORDER BY period NULLS FIRST, startTime NULLS FIRST, event_id) = team_id, false)::BIGINT AS success FROM {EV}) WHERE possession_event_type = 'PA'")
def _(s, d):
    w = Window.partitionBy("match_id").orderBy("period", "startTime", "event_id")
    e = R.events(s, d, "match_id", "period", "startTime", "team_id", "possession_event_type")
    # the next event of any kind decides, so passes are picked after the window
    e = e.withColumn("success", F.coalesce(F.lead("team_id").over(w) == F.col("team_id"), F.lit(False)).cast("long"))
    return e.where("possession_event_type = 'PA'").select("event_id", "success")


@q("c31_wide_summary", f"SELECT pff_player_id, round(avg(outcome) FILTER (perspective = 'GOAL_FOR'), 6) AS goal_for, round(avg(outcome) FILTER (perspective = 'GOAL_AGAINST'), 6) AS goal_against FROM {PANEL} GROUP BY 1")
def _(s, d):
    wide = R.panel(s, d).groupBy("pff_player_id").pivot("perspective", ["GOAL_FOR", "GOAL_AGAINST"]).agg(F.round(F.avg("outcome"), 6))
    return wide.withColumnsRenamed({"GOAL_FOR": "goal_for", "GOAL_AGAINST": "goal_against"})


# --- scalar functions ---
@q("f01_flip", f"SELECT event_id, CASE WHEN gameEvents.homeTeam THEN -ball[1].x ELSE ball[1].x END AS x FROM {EV} WHERE gameEvents.homeTeam IS NOT NULL AND ball[1].x IS NOT NULL")
def _(s, d):
    x = F.get("ball", F.lit(0))["x"]
    return R.events(s, d, "ball", "gameEvents").select("event_id", S.flip(x, F.col("gameEvents.homeTeam")).alias("x"), F.col("gameEvents.homeTeam").alias("h")).where("h IS NOT NULL AND x IS NOT NULL").drop("h")


@q("f05_geometry", f"SELECT event_id, round(sqrt(pow(52.5 - ball[1].x, 2) + pow(ball[1].y, 2)), 5) AS dist, round(atan2(ball[1].y, 52.5 - ball[1].x), 5) + 0.0 AS angle FROM {EV} WHERE ball[1].x IS NOT NULL AND ball[1].y IS NOT NULL")
def _(s, d):
    b = F.get("ball", F.lit(0))
    e = R.events(s, d, "ball").select("event_id", b["x"].alias("x"), b["y"].alias("y")).dropna()
    return e.select("event_id", F.round(S.goal_distance(F.col("x"), F.col("y")), 5).alias("dist"), (F.round(S.goal_angle(F.col("x"), F.col("y")), 5) + 0.0).alias("angle"))


@q("f07_aperture", f"WITH b AS (SELECT event_id, ball[1].x AS x, ball[1].y AS y FROM {EV} WHERE ball[1].x IS NOT NULL AND ball[1].y IS NOT NULL), m AS (SELECT event_id, sqrt(pow(52.5 - x, 2) + pow(3.66 - y, 2)) AS a, sqrt(pow(52.5 - x, 2) + pow(-3.66 - y, 2)) AS b FROM b) SELECT event_id, round(acos(greatest(-1, least(1, (a * a + b * b - 7.32 * 7.32) / (2 * a * b + 1e-8)))), 4) AS aperture FROM m")
def _(s, d):
    b = F.get("ball", F.lit(0))
    e = R.events(s, d, "ball").select("event_id", b["x"].alias("x"), b["y"].alias("y")).dropna()
    return e.select("event_id", F.round(S.goal_aperture(F.col("x"), F.col("y")), 4).alias("aperture"))


@q("f08_in_triangle", f"WITH b AS (SELECT event_id, ball[1].x AS x, ball[1].y AS y FROM {EV} WHERE ball[1].x IS NOT NULL AND ball[1].y IS NOT NULL) SELECT event_id, x BETWEEN 30 AND 52.5 AND abs(y) <= 3.66 * (x - 30) / 22.5 AS inside FROM b WHERE abs(abs(y) - 3.66 * (x - 30) / 22.5) > 1e-6")
def _(s, d):
    b = F.get("ball", F.lit(0))
    e = R.events(s, d, "ball").select("event_id", b["x"].alias("x"), b["y"].alias("y")).dropna()
    e = e.where(F.abs(F.abs("y") - 3.66 * (F.col("x") - 30) / 22.5) > 1e-6)
    return e.select("event_id", S.in_triangle(F.col("x"), F.col("y"), (30.0, 0.0), (52.5, 3.66), (52.5, -3.66)).alias("inside"))


@q("f12_unit_direction", f"SELECT event_id, round(ball[1].x / greatest(sqrt(ball[1].x * ball[1].x + ball[1].y * ball[1].y), 0.01), 5) AS ux FROM {EV} WHERE ball[1].x IS NOT NULL AND ball[1].y IS NOT NULL")
def _(s, d):
    b = F.get("ball", F.lit(0))
    return R.events(s, d, "ball").where(b["x"].isNotNull() & b["y"].isNotNull()).select("event_id", F.round(b["x"] / F.greatest(F.sqrt(b["x"] * b["x"] + b["y"] * b["y"]), F.lit(0.01)), 5).alias("ux"))


@q("f17_name_norm", f"SELECT id, trim(regexp_replace(lower(strip_accents(concat_ws(' ', replace(replace(replace(replace(replace(firstName, 'ø', 'o'), 'Ø', 'O'), 'ł', 'l'), 'Ł', 'L'), 'ß', 'ss'), replace(replace(replace(replace(replace(lastName, 'ø', 'o'), 'Ø', 'O'), 'ł', 'l'), 'Ł', 'L'), 'ß', 'ss')))), '[^a-z0-9]+', ' ', 'g')) AS name FROM {PLAYERS}")
def _(s, d):
    return R.players(s, d).select("id", name_norm(F.concat_ws(" ", "firstName", "lastName")).alias("name"))


@q("f18_bounded_levenshtein", "SELECT a.n_name AS a, b.n_name AS b, CASE WHEN levenshtein(a.n_name, b.n_name) <= 4 THEN levenshtein(a.n_name, b.n_name) ELSE -1 END AS dist FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def _(s, d):
    n = table(s, d, "nation")
    a, b = n.select(F.col("n_name").alias("a"), F.col("n_nationkey").alias("ka"), "n_regionkey"), n.select(F.col("n_name").alias("b"), F.col("n_nationkey").alias("kb"), "n_regionkey")
    return a.join(F.broadcast(b), "n_regionkey").where("ka < kb").select("a", "b", F.levenshtein("a", "b", 4).cast("long").alias("dist"))


@q("f20_age_years", f"SELECT id, round(datediff('day', TRY_CAST(dob AS DATE), DATE '2022-11-20') / 365.25, 4) AS age FROM {PLAYERS} WHERE regexp_full_match(dob, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')")
def _(s, d):
    p = R.players(s, d).where(F.col("dob").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"))
    return p.select("id", F.round(F.datediff(F.lit("2022-11-20").cast("date"), F.try_to_date("dob", "yyyy-MM-dd")) / 365.25, 4).alias("age"))


@q("f25_tier", "SELECT DISTINCT match_id, CASE WHEN comp_tier = 1 THEN 'top' WHEN comp_tier IN (2, 3) THEN 'mid' ELSE 'other' END AS tier FROM training_matrix")
def _(s, d):
    t = F.col("comp_tier")
    return table(s, d, "training_matrix").select("match_id", F.when(t == 1, "top").when(t.isin(2, 3), "mid").otherwise("other").alias("tier")).distinct()


@q("f26_logistic", "SELECT DISTINCT match_id, minute_bin, round(1 / (1 + exp(-(0.4 * score_diff + 0.002 * elo_diff))), 6) AS p FROM training_matrix WHERE score_diff IS NOT NULL AND elo_diff IS NOT NULL")
def _(s, d):
    t = table(s, d, "training_matrix").dropna(subset=["score_diff", "elo_diff"])
    return t.select("match_id", "minute_bin", F.round(S.logistic(0.4 * F.col("score_diff") + 0.002 * F.col("elo_diff")), 6).alias("p")).distinct()


@q("f28_poisson_outcome", """WITH f AS (SELECT k, CASE k WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 6 WHEN 4 THEN 24 ELSE 120 END AS fact FROM (SELECT unnest(range(0, 6)) AS k)), m AS (SELECT r_regionkey AS id, 0.5 + r_regionkey * 0.3 AS a, 1.1 AS b FROM region),
p AS (SELECT id, i.k AS i, j.k AS j, exp(-a) * pow(a, i.k) / i.fact * exp(-b) * pow(b, j.k) / j.fact AS pr FROM m, f i, f j) SELECT id::BIGINT AS id, round(sum(CASE WHEN i > j THEN pr ELSE 0 END) / sum(pr), 6) AS win, round(sum(CASE WHEN i = j THEN pr ELSE 0 END) / sum(pr), 6) AS draw FROM p GROUP BY 1""")
def _(s, d):
    r = table(s, d, "region").select(F.col("r_regionkey").cast("long").alias("id"), (0.5 + F.col("r_regionkey") * 0.3).alias("a"), F.lit(1.1).alias("b"))
    return S.poisson_outcome(r, "id", "a", "b", 6).select("id", F.round("win", 6).alias("win"), F.round("draw", 6).alias("draw"))


@q("f29_gaussian_kernel", f"SELECT event_id, round(exp(-(ball[1].x * ball[1].x + ball[1].y * ball[1].y) / (2 * 15 * 15)), 6) AS k FROM {EV} WHERE ball[1].x IS NOT NULL AND ball[1].y IS NOT NULL")
def _(s, d):
    b = F.get("ball", F.lit(0))
    return R.events(s, d, "ball").where(b["x"].isNotNull() & b["y"].isNotNull()).select("event_id", F.round(F.exp(-(b["x"] * b["x"] + b["y"] * b["y"]) / (2 * 15.0 * 15.0)), 6).alias("k"))


@q("f32_log_rates", f"SELECT pm_id, round(ln(distance_m / 60 + 0.01), 6) AS log_rate FROM {PM} WHERE distance_m >= 0")
def _(s, d):
    return R.minutes(s, d).where("distance_m >= 0").select("pm_id", F.round(F.ln(F.col("distance_m") / 60 + 0.01), 6).alias("log_rate"))


@q("f33_tiers", f"SELECT edition_id, pff_player_id, CASE WHEN p >= .95 THEN 'S' WHEN p >= .85 THEN 'A' WHEN p >= .60 THEN 'B' WHEN p >= .40 THEN 'C' WHEN p >= .15 THEN 'D' WHEN p IS NULL THEN NULL ELSE 'E' END AS tier FROM (SELECT edition_id, pff_player_id, CASE WHEN minutes_played IS NOT NULL THEN row_number() OVER (PARTITION BY edition_id ORDER BY minutes_played NULLS LAST, pff_player_id) / count(minutes_played) OVER (PARTITION BY edition_id) END AS p FROM {PCJ})")
def _(s, d):
    p = R.pcj(s, d).select("edition_id", "pff_player_id", percentile_ordinal("minutes_played", ["pff_player_id"], ["edition_id"]).alias("p"))
    return p.select("edition_id", "pff_player_id", S.tier(F.col("p")).alias("tier"))


@q("f34_certainty", f"SELECT edition_id, pff_player_id, CASE WHEN chasing_clutch_lo80 > 0 THEN 'certain' ELSE 'uncertain' END AS c FROM {PCJ} WHERE chasing_clutch_lo80 IS NOT NULL AND NOT isnan(chasing_clutch_lo80)")
def _(s, d):
    lo = F.col("chasing_clutch_lo80")
    return R.pcj(s, d).where(lo.isNotNull() & ~F.isnan(lo)).select("edition_id", "pff_player_id", F.when(lo > 0, "certain").otherwise("uncertain").alias("c"))


@q("f36_credibility", f"SELECT edition_id, pff_player_id, CASE WHEN minutes_played >= 900 AND n_shocks_for + n_shocks_against >= 10 THEN 'HIGH' WHEN minutes_played >= 270 THEN 'MED' ELSE 'LOW' END AS c FROM {PCJ}")
def _(s, d):
    c = F.when((F.col("minutes_played") >= 900) & (F.col("n_shocks_for") + F.col("n_shocks_against") >= 10), "HIGH").when(F.col("minutes_played") >= 270, "MED").otherwise("LOW")
    return R.pcj(s, d).select("edition_id", "pff_player_id", c.alias("c"))


@q("f37_bar", f"SELECT edition_id, pff_player_id, repeat('#', least(greatest(floor(minutes_played / 100.0)::BIGINT, 0), 20)::INT) AS bar FROM {PCJ} WHERE minutes_played IS NOT NULL")
def _(s, d):
    n = F.greatest(F.least(F.floor(F.col("minutes_played") / 100), F.lit(20)), F.lit(0)).cast("int")
    return R.pcj(s, d).where("minutes_played IS NOT NULL").select("edition_id", "pff_player_id", F.repeat(F.lit("#"), n).alias("bar"))


@q("f39_offside_margin", """WITH f AS (SELECT frame_id, homePlayers, awayPlayers FROM (SELECT DISTINCT * FROM tracking)), h AS (SELECT frame_id, max(p.x) AS hx FROM (SELECT frame_id, unnest(homePlayers) AS p FROM f) GROUP BY 1), a AS (SELECT frame_id, max(p.x) AS ax FROM (SELECT frame_id, unnest(awayPlayers) AS p FROM f) WHERE p.visibility = 'VISIBLE' GROUP BY 1)
SELECT frame_id, round(hx - ax, 6) AS margin FROM h JOIN a USING (frame_id) WHERE hx IS NOT NULL AND ax IS NOT NULL""")
def _(s, d):
    t = table(s, d, "tracking").dropDuplicates(["frame_id"])
    hx = F.array_max(F.transform("homePlayers", lambda p: p["x"]))
    ax = F.array_max(F.transform(F.filter("awayPlayers", lambda p: p["visibility"] == "VISIBLE"), lambda p: p["x"]))
    return t.select("frame_id", F.round(hx - ax, 6).alias("margin")).where("margin IS NOT NULL")


@q("f41_sentinels", f"SELECT event_id, CASE WHEN lower(trim(gameEvents.setpieceType)) IN ('', 'null') THEN NULL ELSE gameEvents.setpieceType END AS setpiece FROM {EV}")
def _(s, d):
    return R.events(s, d, "gameEvents").select("event_id", null_if_sentinel(F.col("gameEvents.setpieceType")).alias("setpiece"))
