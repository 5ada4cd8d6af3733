"""The event-anchored chain: goals, shocks, windows, channels, win probability, value labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitchloom.functions import scalar as S
from pitchloom.operators import kernels
from pitchloom.operators.asof import interval_join, window_contrast
from pitchloom.operators.blocks import leave_one_out
from pitchloom.operators.islands import debounce
from pitchloom.operators.shocks import chance, near_misses, playing_intervals, shock_table
from pitchloom.plans import relational as R
from pitchloom.plans.analytic import _ABS, _HOME, _STEADY, positions
from pitchloom.plans.fields import _SIDES, FRAMES, exact_mean, mean_sql, sides
from pitchloom.plans.relational import EV, GOALS, PANEL, PM
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


# --- goals ---
_GREEDY = f"""RECURSIVE g AS (SELECT goal_id, match_id, period, start_game_clock AS t, row_number() OVER (PARTITION BY match_id, period ORDER BY start_game_clock, goal_id) AS k FROM {GOALS} WHERE match_id IS NOT NULL AND period IS NOT NULL AND start_game_clock IS NOT NULL),
ev AS (SELECT match_id, period, list({{'t': start_game_clock, 'i': event_id}} ORDER BY start_game_clock, event_id) AS es FROM {EV} WHERE possessionEvents.shotOutcomeType = 'G' AND match_id IS NOT NULL AND period IS NOT NULL AND start_game_clock IS NOT NULL GROUP BY 1, 2),
r AS (SELECT match_id, period, 0::BIGINT AS k, es, NULL::BIGINT AS goal_id, NULL::BIGINT AS event_id, NULL::BIGINT AS clock FROM ev
UNION ALL SELECT match_id, period, k, list_filter(es, lambda x: x.i <> c.i), goal_id, c.i, c.t FROM (SELECT r.match_id, r.period, g.k, r.es, g.goal_id, list_sort(list_transform(r.es, lambda x: {{'d': abs(x.t - g.t), 't': x.t, 'i': x.i}}))[1] AS c FROM r JOIN g ON g.match_id = r.match_id AND g.period = r.period AND g.k = r.k + 1 WHERE len(r.es) > 0))"""


def provider_goals(s, d):
    return table(s, d, "events_enriched").where("possessionEvents.shotOutcomeType = 'G'").select("event_id", "match_id", "period", F.col("start_game_clock").alias("t")).dropna().distinct()


def matched_goals(s, d):
    g = R.goals(s, d).select("goal_id", "match_id", "period", F.col("start_game_clock").alias("t")).dropna()
    return kernels.greedy_match(g, provider_goals(s, d), "goal_id", "event_id", ["match_id", "period"], "t")


@q("j16_greedy_match", f"WITH {_GREEDY} SELECT goal_id, event_id FROM r WHERE goal_id IS NOT NULL")
def _(s, d):
    return matched_goals(s, d)


@q("c01_goals_timeline", f"""WITH {_GREEDY}, m AS (SELECT goal_id, clock FROM r WHERE goal_id IS NOT NULL), s AS {_SIDES},
t AS (SELECT a.goal_id, a.match_id, a.period::BIGINT AS period, CASE WHEN abs(m.clock - a.start_game_clock) <= 15 THEN m.clock ELSE a.start_game_clock END AS clock, abs(m.clock - a.start_game_clock) <= 15 IS TRUE AS reclocked, s.h FROM {GOALS} a LEFT JOIN m USING (goal_id) LEFT JOIN s ON s.match_id = a.match_id AND s.team_id = a.scoring_team_id WHERE a.match_id IS NOT NULL AND a.period < 5 AND a.start_game_clock IS NOT NULL)
SELECT goal_id, clock, reclocked, count(*) FILTER (h) OVER w AS home, count(*) FILTER (NOT h) OVER w AS away FROM t WINDOW w AS (PARTITION BY match_id ORDER BY period, clock, goal_id ROWS UNBOUNDED PRECEDING)""")
def _(s, d):
    # the public feed tells which goals there are, the provider's clock when they fell
    g = R.goals(s, d).where("match_id IS NOT NULL AND period < 5 AND start_game_clock IS NOT NULL")
    clock = matched_goals(s, d).join(provider_goals(s, d).select("event_id", F.col("t").alias("provider")), "event_id").select("goal_id", "provider")
    g = g.join(clock, "goal_id", "left").join(sides(s, d).withColumnRenamed("team_id", "scoring_team_id"), ["match_id", "scoring_team_id"], "left")
    near = F.coalesce(F.abs(F.col("provider") - F.col("start_game_clock")) <= 15, F.lit(False))
    g = g.withColumns({"reclocked": near, "clock": F.when(near, F.col("provider")).otherwise(F.col("start_game_clock"))})
    w = Window.partitionBy("match_id").orderBy("period", "clock", "goal_id").rowsBetween(Window.unboundedPreceding, 0)
    return g.select("goal_id", "clock", "reclocked", F.count_if("is_home").over(w).alias("home"), F.count_if(~F.col("is_home")).over(w).alias("away"))


# --- shocks ---
_SHOCKS = f"""g AS (SELECT goal_id, match_id, period, start_game_clock AS t, minute, scoring_team_id FROM {GOALS} WHERE match_id IS NOT NULL AND period IS NOT NULL AND start_game_clock IS NOT NULL AND minute IS NOT NULL),
b AS (SELECT match_id, period, min(start_game_clock) AS lo, max(start_game_clock) AS hi FROM {EV} WHERE match_id IS NOT NULL AND period IS NOT NULL AND start_game_clock IS NOT NULL GROUP BY 1, 2),
sp AS (SELECT match_id, player_id, min(minute) AS minute_in, max(minute) AS minute_out FROM {EV} WHERE match_id IS NOT NULL AND player_id IS NOT NULL AND minute IS NOT NULL GROUP BY 1, 2),
tm AS (SELECT match_id, player_id, team_id FROM (SELECT match_id, player_id, team_id, count(*) AS n FROM {EV} WHERE match_id IS NOT NULL AND player_id IS NOT NULL AND minute IS NOT NULL AND team_id IS NOT NULL GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY match_id, player_id ORDER BY n DESC, team_id) = 1),
sh AS (SELECT g.goal_id AS shock_id, g.match_id, g.period::BIGINT AS period, sp.player_id, CASE WHEN tm.team_id = g.scoring_team_id THEN 'GOAL_FOR' ELSE 'GOAL_AGAINST' END AS perspective, greatest(g.t - 600, b.lo) AS pre_start, least(g.t + 600, b.hi) AS post_end, g.t - 600 < b.lo AS pre_cut, g.t + 600 > b.hi AS post_cut,
EXISTS (SELECT 1 FROM g o WHERE o.match_id = g.match_id AND o.t <> g.t AND abs(o.t - g.t) <= 600) AS has_overlap, sp.minute_in > 0 AND sp.minute_in BETWEEN floor((g.t - 600) / 60) AND floor(g.t / 60) AS entered, sp.minute_out BETWEEN floor(g.t / 60) AND floor((g.t + 600) / 60) AS left_field
FROM g JOIN b ON b.match_id = g.match_id AND b.period = g.period JOIN sp ON sp.match_id = g.match_id AND g.minute BETWEEN sp.minute_in AND sp.minute_out JOIN tm ON tm.match_id = sp.match_id AND tm.player_id = sp.player_id)"""


def shocks(s, d):
    g = R.goals(s, d).select("goal_id", "match_id", "period", F.col("start_game_clock").alias("t"), "minute", "scoring_team_id")
    return shock_table(g, R.events(s, d, "match_id", "period", "player_id", "team_id", "minute", "start_game_clock"), 600)


@q("c03_shock_table", f"WITH {_SHOCKS} SELECT *, count(*) OVER (PARTITION BY shock_id, perspective) - 1 AS n_mates FROM sh")
def _(s, d):
    return shocks(s, d)


@q("c04_block_members", f"WITH {_SHOCKS} SELECT shock_id, perspective, player_id FROM sh")
def _(s, d):
    return shocks(s, d).select("shock_id", "perspective", "player_id")


@q("a12_shock_flags", f"WITH {_SHOCKS} SELECT perspective, count(DISTINCT shock_id) AS n_shocks, count(*) AS n_rows, count(*) FILTER (has_overlap) AS n_overlap, count(*) FILTER (pre_cut OR post_cut) AS n_cut, count(*) FILTER (entered OR left_field) AS n_moved FROM sh GROUP BY 1")
def _(s, d):
    return shocks(s, d).groupBy("perspective").agg(F.count_distinct("shock_id").alias("n_shocks"), F.count(F.lit(1)).alias("n_rows"), F.count_if("has_overlap").alias("n_overlap"), F.count_if(F.col("pre_cut") | F.col("post_cut")).alias("n_cut"), F.count_if(F.col("entered") | F.col("left_field")).alias("n_moved"))


# --- windows ---
_WINDOW = f"""v AS (SELECT match_id, period, player_id, start_game_clock AS sec FROM {EV} WHERE match_id IS NOT NULL AND period IS NOT NULL AND player_id IS NOT NULL AND start_game_clock IS NOT NULL),
g AS (SELECT goal_id, match_id, period, start_game_clock AS t FROM {GOALS} WHERE match_id IS NOT NULL AND period IS NOT NULL AND start_game_clock IS NOT NULL),
c AS (SELECT g.goal_id, v.player_id, count(*) FILTER (sec >= t - 600 AND sec < t) AS pre, count(*) FILTER (sec >= t AND sec <= t + 600) AS post FROM g JOIN v USING (match_id, period) GROUP BY 1, 2)"""


def _event_windows(s, d):
    v = R.events(s, d, "match_id", "period", "player_id", "start_game_clock").dropna().select("match_id", "period", "player_id", F.col("start_game_clock").alias("sec"), F.lit(1.0).alias("v"))
    g = R.goals(s, d).select("goal_id", "match_id", "period", F.col("start_game_clock").alias("at")).dropna()
    return window_contrast(g, v, "goal_id", "at", ["match_id", "period"], "player_id", "sec", "v", 600)


@q("a09_window_sums", f"WITH {_WINDOW} SELECT goal_id, player_id, pre::DOUBLE AS member_pre, post::DOUBLE AS member_post FROM c")
def _(s, d):
    return _event_windows(s, d)


@q("c08_channel_windows", f"""WITH {_WINDOW} SELECT goal_id, player_id, (post - pre)::DOUBLE AS delta_player, round(CASE WHEN count(*) OVER b > 1 THEN ((sum(post) OVER b - post) / (count(*) OVER b - 1)::DOUBLE) - ((sum(pre) OVER b - pre) / (count(*) OVER b - 1)::DOUBLE) END, 6) AS delta_team_loo FROM c WINDOW b AS (PARTITION BY goal_id)""")
def _(s, d):
    return leave_one_out(_event_windows(s, d), ["goal_id"]).select("goal_id", "player_id", "delta_player", F.round("delta_team_loo", 6).alias("delta_team_loo"))


@q("a11_others_in_window", f"WITH {_WINDOW} SELECT goal_id, player_id, round(CASE WHEN count(*) OVER b > 1 THEN (sum(post) OVER b - post) / (count(*) OVER b - 1)::DOUBLE END, 6) AS others_post FROM c WINDOW b AS (PARTITION BY goal_id)")
def _(s, d):
    return leave_one_out(_event_windows(s, d), ["goal_id"]).select("goal_id", "player_id", F.round("loo_post", 6).alias("others_post"))


@q("a10_window_peaks", f"""WITH v AS (SELECT pff_match_id AS match_id, period, pff_player_id AS player_id, {_ABS} * 60 AS sec, psv95 AS v FROM {PM} WHERE period IS NOT NULL AND minute_in_period IS NOT NULL),
g AS (SELECT goal_id, match_id, period, start_game_clock AS t FROM {GOALS} WHERE match_id IS NOT NULL AND period IS NOT NULL AND start_game_clock IS NOT NULL)
SELECT g.goal_id, v.player_id, max(v) FILTER (sec >= t - 600 AND sec < t) AS member_pre, max(v) FILTER (sec >= t AND sec <= t + 600) AS member_post FROM g JOIN v USING (match_id, period) GROUP BY 1, 2""")
def _(s, d):
    sec = ((F.col("period") - 1) * 45 + F.col("minute_in_period")) * 60
    v = R.minutes(s, d).select(F.col("pff_match_id").alias("match_id"), "period", F.col("pff_player_id").alias("player_id"), sec.alias("sec"), F.col("psv95").alias("v")).dropna(subset=["period", "sec"])
    g = R.goals(s, d).select("goal_id", "match_id", "period", F.col("start_game_clock").alias("at")).dropna()
    return window_contrast(g, v, "goal_id", "at", ["match_id", "period"], "player_id", "sec", "v", 600, None, "max")


@q("c07_channel_minutes", f"""WITH e AS (SELECT match_id, period::BIGINT AS period, player_id, minute - (period - 1) * 45 AS m, count(*) AS n_events, count(*) FILTER (possession_event_type = 'SH') AS n_shots FROM {EV} WHERE match_id IS NOT NULL AND period IS NOT NULL AND player_id IS NOT NULL AND minute IS NOT NULL GROUP BY ALL),
p AS (SELECT pff_match_id AS match_id, period, pff_player_id AS player_id, minute_in_period AS m, max(distance_m) AS metres FROM {PM} GROUP BY ALL)
SELECT e.match_id, e.period, e.player_id, e.m, n_events, n_shots, coalesce(metres, 0) AS metres, round(n_events + 2.0 * n_shots + coalesce(metres, 0) / 100, 6) AS outcome FROM e LEFT JOIN p USING (match_id, period, player_id, m)""")
def _(s, d):
    keys = ["match_id", "period", "player_id", "m"]
    e = R.events(s, d, "match_id", "period", "player_id", "minute", "possession_event_type").dropna(subset=["match_id", "period", "player_id", "minute"])
    e = e.withColumn("m", F.col("minute") - (F.col("period") - 1) * 45).withColumn("period", F.col("period").cast("long")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("possession_event_type") == "SH").alias("n_shots"))
    p = table(s, d, "raw_per_minute").groupBy(F.col("pff_match_id").alias("match_id"), "period", F.col("pff_player_id").alias("player_id"), F.col("minute_in_period").alias("m")).agg(F.max("distance_m").alias("metres"))
    j = e.join(p, keys, "left").fillna(0.0, ["metres"])
    return j.withColumn("outcome", F.round(F.col("n_events") + 2.0 * F.col("n_shots") + F.col("metres") / 100, 6))


_WIDE = f"""m AS (SELECT pff_match_id AS match_id, pff_player_id AS player_id, {_ABS} AS minute, max(distance_m) AS v FROM {PM} WHERE period IS NOT NULL AND minute_in_period IS NOT NULL GROUP BY ALL),
g AS (SELECT goal_id, match_id, minute AS at_ FROM {GOALS} WHERE match_id IS NOT NULL AND minute IS NOT NULL),
pw AS (SELECT g.goal_id, m.player_id, m.minute - g.at_ AS rel, m.v FROM g JOIN m ON m.match_id = g.match_id AND m.minute BETWEEN g.at_ - 15 AND g.at_ + 15 AND m.minute <> g.at_)"""


def window_panel(s, d, width: int = 15):
    """(goal_id, player_id, rel, v) of the minutes around each goal, minute 0 left out, over the whole match."""
    m = R.minutes(s, d).select(F.col("pff_match_id").alias("match_id"), F.col("pff_player_id").alias("player_id"), ((F.col("period") - 1) * 45 + F.col("minute_in_period")).alias("minute"), "distance_m").dropna(subset=["minute"])
    m = m.groupBy("match_id", "player_id", "minute").agg(F.max("distance_m").alias("v"))
    g = R.goals(s, d).select("goal_id", "match_id", F.col("minute").alias("at")).dropna()
    spine = g.select("goal_id", "match_id", F.explode(F.sequence(F.lit(-width).cast("long"), F.lit(width).cast("long"))).alias("rel"), "at").where("rel <> 0").withColumn("minute", F.col("at") + F.col("rel"))
    return spine.join(m, ["match_id", "minute"]).select("goal_id", "player_id", "rel", "v")


@q("c10_window_panel", f"WITH {_WIDE} SELECT goal_id, player_id, rel, v FROM pw")
def _(s, d):
    return window_panel(s, d)


@q("k21_window_sensitivity", f"WITH {_WIDE} SELECT w::BIGINT AS width, round({mean_sql('CASE WHEN rel > 0 THEN v END')} - {mean_sql('CASE WHEN rel < 0 THEN v END')}, 6) AS diff, count(*) AS n FROM pw, (SELECT unnest([3, 5, 7, 10, 15]) AS w) WHERE abs(rel) <= w GROUP BY 1")
def _(s, d):
    p = window_panel(s, d).select("rel", "v", F.explode(F.filter(F.array(*[F.lit(w).cast("long") for w in (3, 5, 7, 10, 15)]), lambda w: F.abs("rel") <= w)).alias("width"))
    p = p.withColumns({"after": F.when(F.col("rel") > 0, F.col("v")), "before": F.when(F.col("rel") < 0, F.col("v"))})
    return p.groupBy("width").agg(F.round(exact_mean("after") - exact_mean("before"), 6).alias("diff"), F.count(F.lit(1)).alias("n"))


# --- near misses and contexts ---
_XG = "1 / (1 + exp(-(1.2 - 0.09 * sqrt(pow(52.5 - abs(ball[1].x), 2) + pow(ball[1].y, 2)))))"
_NEAR = f"""sx AS (SELECT event_id, match_id, minute, possessionEvents.shotOutcomeType AS o, {_XG} AS xg FROM {EV} WHERE possession_event_type = 'SH' AND ball[1].x IS NOT NULL AND ball[1].y IS NOT NULL),
nm AS (SELECT event_id, 'woodwork' AS kind FROM sx WHERE o = 'W' AND xg BETWEEN 0.15 AND 0.85 UNION SELECT event_id, 'save' FROM sx WHERE o = 'S' AND xg >= 0.6 UNION SELECT event_id, 'lax_save' FROM sx WHERE o = 'S' AND xg >= 0.4 UNION SELECT event_id, 'cleared' FROM sx WHERE o = 'B' AND xg >= 0.5)"""


def shots(s, d):
    b = F.get("ball", F.lit(0))
    rows = table(s, d, "events_enriched").where((F.col("possession_event_type") == "SH") & b["x"].isNotNull() & b["y"].isNotNull())
    return rows.select("event_id", "match_id", "period", "start_game_clock", "minute", "team_id", F.col("possessionEvents.shotOutcomeType").alias("outcome"), chance(b["x"], b["y"]).alias("xg")).dropDuplicates(["event_id"])


@q("c11_near_misses", f"WITH {_NEAR} SELECT nm.event_id, kind, round(xg, 6) AS xg FROM nm JOIN sx USING (event_id)")
def _(s, d):
    x = shots(s, d)
    return near_misses(x).join(x.select("event_id", F.round("xg", 6).alias("xg")), "event_id").select("event_id", "kind", "xg")


@q("a19_near_miss_exposure", f"""WITH {_NEAR}, sp AS (SELECT match_id, player_id, min(minute) AS minute_in, max(minute) AS minute_out FROM {EV} WHERE match_id IS NOT NULL AND player_id IS NOT NULL AND minute IS NOT NULL AND team_id IS NOT NULL GROUP BY 1, 2)
SELECT sp.player_id, count(*) AS n FROM (SELECT DISTINCT event_id FROM nm) JOIN sx USING (event_id) JOIN sp ON sp.match_id = sx.match_id AND sx.minute BETWEEN sp.minute_in AND sp.minute_out GROUP BY 1""")
def _(s, d):
    x = shots(s, d)
    missed = x.join(near_misses(x).select("event_id").distinct(), "event_id", "left_semi").select("event_id", "match_id", "minute")
    spans = playing_intervals(R.events(s, d, "match_id", "player_id", "team_id", "minute").dropna())
    return interval_join(missed, spans, ["match_id"], "minute", "minute_in", "minute_out").groupBy("player_id").agg(F.count(F.lit(1)).alias("n"))


@q("c12_defensive_context", f"""WITH {_STEADY}, u AS (SELECT st.game, st.period, t.balls[1].x AS bx, t.balls[1].y AS by_, unnest(t.awayPlayers) AS u FROM {FRAMES} t JOIN st USING (frame_id) WHERE st.steady AND t.balls[1].x IS NOT NULL AND t.balls[1].y IS NOT NULL),
p AS (SELECT game, period, bx, by_, TRY_CAST(TRY_CAST(trim(u.jerseyNum) AS DOUBLE) AS BIGINT) AS num, u.x AS x, u.y AS y FROM u)
SELECT game, period, num, count(*) AS frames, count(*) FILTER (CASE WHEN period % 2 = 0 THEN -x ELSE x END > 105 / 6.0) AS in_third, count(*) FILTER ((x - bx) * (x - bx) + (y - by_) * (y - by_) <= 9) AS pressing FROM p WHERE num IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL GROUP BY ALL""")
def _(s, d):
    from pitchloom.operators.nested import whole_number_column

    t = table(s, d, "tracking").dropDuplicates(["frame_id"])
    ball = F.get("balls", F.lit(0))
    held = debounce(t.select(F.col("gameRefId").cast("long").alias("game"), F.col("period").cast("long").alias("period"), "frame_id", F.coalesce("game_event.home_ball", F.lit(False)).alias("h")), ["game", "period"], ["frame_id"], "h", 2, "steady").where("steady")
    f = t.select("frame_id", ball["x"].alias("bx"), ball["y"].alias("by"), "awayPlayers").dropna(subset=["bx", "by"]).join(held.select("frame_id", "game", "period"), "frame_id")
    p = f.select("game", "period", "bx", "by", F.explode("awayPlayers").alias("u")).select("game", "period", "bx", "by", whole_number_column(F.col("u.jerseyNum")).alias("num"), F.col("u.x").alias("x"), F.col("u.y").alias("y")).dropna(subset=["num", "x", "y"])
    dx, dy = F.col("x") - F.col("bx"), F.col("y") - F.col("by")
    return p.groupBy("game", "period", "num").agg(F.count(F.lit(1)).alias("frames"), F.count_if(S.flip(F.col("x"), F.col("period") % 2 == 0) > 105 / 6.0).alias("in_third"), F.count_if(dx * dx + dy * dy <= 9).alias("pressing"))


_STEPS = f"""m AS (SELECT game, num, t, frame_id, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step, (t - lag(t) OVER w) / 1000 AS dt FROM {_HOME} WHERE t IS NOT NULL WINDOW w AS (PARTITION BY game, num ORDER BY t, frame_id)),
v AS (SELECT game, num, floor(t / 60000)::BIGINT AS minute, step, dt, step / dt AS speed FROM m WHERE dt > 0 AND dt <= 1 AND step / dt <= 11)"""


@q("c15_minute_metrics", f"""WITH {_STEPS} SELECT game, num, minute, round(sum(CAST(step AS DECIMAL(18,9)))::DOUBLE, 4) AS metres, round(coalesce(sum(CAST(dt AS DECIMAL(18,9))) FILTER (speed >= 5.5), 0)::DOUBLE, 4) AS hsr_s, round(coalesce(sum(CAST(dt AS DECIMAL(18,9))) FILTER (speed >= 25 / 3.6), 0)::DOUBLE, 4) AS sprint_s,
round(quantile_cont(speed, 0.95), 6) AS p95, """ + ", ".join(f"round(coalesce(sum(CAST(step AS DECIMAL(18,9))) FILTER (speed >= {a} AND speed < {b}), 0)::DOUBLE, 4) AS z{k}_m" for k, (a, b) in enumerate(zip((0, 2, 4, 5.5, 7), (2, 4, 5.5, 7, 99)), 1)) + " FROM v GROUP BY 1, 2, 3")
def _(s, d):
    w = Window.partitionBy("game", "num").orderBy("t", "frame_id")
    p = positions(s, d).where("t IS NOT NULL")
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))
    v = p.select("game", "num", "t", step.alias("step"), ((F.col("t") - F.lag("t").over(w)) / 1000).alias("dt")).where("dt > 0 AND dt <= 1").withColumn("speed", F.col("step") / F.col("dt")).where("speed <= 11")
    return kernels.minute_metrics(v.withColumn("minute", F.floor(F.col("t") / 60000)), ["game", "num", "minute"])


# --- win probability ---
_MATRIX = f"""s AS {_SIDES}, mt AS (SELECT DISTINCT match_id FROM s), sp AS (SELECT match_id, b FROM mt, (SELECT unnest(range(1, 91)) AS b)),
gl AS (SELECT g.match_id, least(greatest(g.minute + 1, 1), 90) AS b, sum(CASE WHEN s.h THEN 1 ELSE -1 END) AS d FROM {GOALS} g JOIN s ON s.match_id = g.match_id AND s.team_id = g.scoring_team_id WHERE g.minute IS NOT NULL GROUP BY 1, 2),
sc AS (SELECT e.match_id, least(greatest(e.minute + 1, 1), 90) AS b, sum(CASE WHEN s.h THEN 1 ELSE -1 END) AS d FROM {EV} e JOIN s ON s.match_id = e.match_id AND s.team_id = e.team_id WHERE e.possession_event_type = 'SH' AND e.minute IS NOT NULL GROUP BY 1, 2),
x AS (SELECT sp.match_id, sp.b, coalesce(gl.d, 0) AS g, coalesce(sc.d, 0) AS n FROM sp LEFT JOIN gl USING (match_id, b) LEFT JOIN sc USING (match_id, b)),
mx AS (SELECT match_id, b AS minute_bin, coalesce(sum(g) OVER (PARTITION BY match_id ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS score_diff, coalesce(sum(n) OVER (PARTITION BY match_id ORDER BY b ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0)::BIGINT AS shots_recent, sign(sum(g) OVER (PARTITION BY match_id))::BIGINT + 1 AS y FROM x)"""


def training_matrix(s, d):
    """Match x 90 minutes from the event tables: score and recent shots before the minute, final result."""
    side = sides(s, d)
    spine = side.select("match_id").distinct().select("match_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(90).cast("long"))).alias("minute_bin"))
    bin_ = F.greatest(F.least(F.col("minute") + 1, F.lit(90)), F.lit(1)).alias("minute_bin")

    def balance(rows, out):
        return rows.where("minute IS NOT NULL").join(side, ["match_id", "team_id"]).groupBy("match_id", bin_).agg(F.sum(F.when(F.col("is_home"), 1).otherwise(-1)).alias(out))

    g = balance(R.goals(s, d).withColumnRenamed("scoring_team_id", "team_id"), "g")
    n = balance(table(s, d, "events_enriched").where("possession_event_type = 'SH'").select("event_id", "match_id", "team_id", "minute").distinct(), "n")
    x = spine.join(g, ["match_id", "minute_bin"], "left").join(n, ["match_id", "minute_bin"], "left").fillna(0, ["g", "n"])
    w = Window.partitionBy("match_id").orderBy("minute_bin")
    total = F.sum("g").over(Window.partitionBy("match_id"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return x.select("match_id", "minute_bin", zero(F.sum("g").over(w.rowsBetween(Window.unboundedPreceding, -1))).alias("score_diff"), zero(F.sum("n").over(w.rowsBetween(-10, -1))).alias("shots_recent"), (F.signum(total).cast("long") + 1).alias("y"))


@q("c17_training_matrix", f"WITH {_MATRIX} SELECT * FROM mx")
def _(s, d):
    return training_matrix(s, d)


def _home_wins(lead, minute, recent):
    """A fixed curve for the home side's chance: leads count more the later they are."""
    return S.logistic(0.2 + lead * (0.7 + minute / 60.0) + 0.03 * recent)


_P = "1 / (1 + exp(-(0.2 + {lead} * (0.7 + minute_bin / 60.0) + 0.03 * shots_recent)))"


@q("c18_win_probability", f"WITH {_MATRIX} SELECT match_id, minute_bin, round({_P.format(lead='score_diff')}, 6) AS p_home, round(abs({_P.format(lead='(score_diff + 1)')} - {_P.format(lead='score_diff')}), 6) AS leverage FROM mx")
def _(s, d):
    m, r, lead = F.col("minute_bin"), F.col("shots_recent"), F.col("score_diff")
    p, up = _home_wins(lead, m, r), _home_wins(lead + 1, m, r)
    return training_matrix(s, d).select("match_id", "minute_bin", F.round(p, 6).alias("p_home"), F.round(F.abs(up - p), 6).alias("leverage"))


# --- value labels ---
_ORDER = "PARTITION BY match_id ORDER BY period NULLS FIRST, startTime NULLS FIRST, event_id"


@q("c20_press_recovery", f"""SELECT event_id, minute, pressed AS recovered FROM (SELECT event_id, minute, possession_event_type AS k, coalesce(lead(team_id) OVER w <> team_id AND lead(startTime) OVER w - startTime <= 5, false)::BIGINT AS pressed FROM {EV} WINDOW w AS ({_ORDER})) WHERE k = 'CH'""")
def _(s, d):
    w = Window.partitionBy("match_id").orderBy("period", "startTime", "event_id")
    e = R.events(s, d, "match_id", "period", "startTime", "team_id", "minute", "possession_event_type")
    label = F.coalesce((F.lead("team_id").over(w) != F.col("team_id")) & (F.lead("startTime").over(w) - F.col("startTime") <= 5), F.lit(False))
    return e.withColumn("recovered", label.cast("long")).where("possession_event_type = 'CH'").select("event_id", "minute", "recovered")


_VDEP = f"""l AS (SELECT event_id, team_id, (""" + " + ".join(f"coalesce(lead(team_id, {k}) OVER w = team_id AND lead(possession_event_type, {k}) OVER w IN ('PA', 'SH', 'CR', 'BC'), false)::INT" for k in (1, 2, 3)) + """ >= 2)::INT AS rec, (""" + " OR ".join(f"coalesce(lead(team_id, {k}) OVER w <> team_id AND lead(possession_event_type, {k}) OVER w = 'SH', false)" for k in (1, 2, 3, 4, 5)) + f""")::INT AS att FROM {EV} WINDOW w AS ({_ORDER}))"""


def vdep_labels(s, d):
    """(event_id, team_id, rec, att): two own offensive actions among the next three, a shot of the
    opponent among the next five."""
    w = Window.partitionBy("match_id").orderBy("period", "startTime", "event_id")
    e = R.events(s, d, "match_id", "period", "startTime", "team_id", "possession_event_type")
    same = lambda k: F.lead("team_id", k).over(w) == F.col("team_id")
    kind = lambda k: F.lead("possession_event_type", k).over(w)
    own = [F.coalesce(same(k) & kind(k).isin("PA", "SH", "CR", "BC"), F.lit(False)).cast("int") for k in (1, 2, 3)]
    shot = F.lit(False)
    for k in range(1, 6):
        shot = shot | F.coalesce(~same(k) & (kind(k) == "SH"), F.lit(False))
    return e.select("event_id", "team_id", (own[0] + own[1] + own[2] >= 2).cast("int").alias("rec"), shot.cast("int").alias("att"))


@q("c21_vdep_labels", f"WITH {_VDEP} SELECT event_id, rec::BIGINT AS rec, att::BIGINT AS att FROM l")
def _(s, d):
    return vdep_labels(s, d).select("event_id", F.col("rec").cast("long").alias("rec"), F.col("att").cast("long").alias("att"))


@q("k05_vdep_value", f"WITH {_VDEP}, c AS (SELECT sum(att)::DOUBLE / sum(rec) AS c FROM l) SELECT team_id, round(avg(rec) - any_value(c.c) * avg(att), 6) AS value FROM l, c GROUP BY 1")
def _(s, d):
    per = vdep_labels(s, d).groupBy("team_id").agg(F.sum("rec").alias("r"), F.sum("att").alias("a"), F.count(F.lit(1)).alias("n"))
    one = Window.partitionBy(F.lit(0))  # one row per team
    c = F.sum("a").over(one) / F.sum("r").over(one)
    return per.select("team_id", F.round(F.col("r") / F.col("n") - c * (F.col("a") / F.col("n")), 6).alias("value"))


_SCORES = "1 / (1 + exp(-(-4 + 0.05 * {sign} * CASE WHEN gameEvents.homeTeam THEN ball[1].x ELSE -ball[1].x END)))"


@q("c24_action_values", f"""WITH p AS (SELECT event_id, match_id, period, startTime, team_id, {_SCORES.format(sign='1')} AS ps, {_SCORES.format(sign='-1')} AS pc FROM {EV} WHERE ball[1].x IS NOT NULL AND gameEvents.homeTeam IS NOT NULL AND match_id IS NOT NULL AND team_id IS NOT NULL),
b AS (SELECT event_id, ps, pc, lag(team_id) OVER w = team_id AS same, lag(ps) OVER w AS lps, lag(pc) OVER w AS lpc FROM p WINDOW w AS ({_ORDER}))
SELECT event_id, round(ps - CASE WHEN lps IS NULL THEN 0 WHEN same THEN lps ELSE lpc END, 6) + 0.0 AS offensive, round(-(pc - CASE WHEN lps IS NULL THEN 0 WHEN same THEN lpc ELSE lps END), 6) + 0.0 AS defensive FROM b""")
def _(s, d):
    x, home = F.get("ball", F.lit(0))["x"], F.col("gameEvents.homeTeam")
    e = R.events(s, d, "match_id", "period", "startTime", "team_id", "ball", "gameEvents").where(x.isNotNull() & home.isNotNull() & F.col("match_id").isNotNull() & F.col("team_id").isNotNull())
    ahead = F.when(home, x).otherwise(-x)
    e = e.select("event_id", "match_id", "period", "startTime", "team_id", S.logistic(-4 + 0.05 * ahead).alias("ps"), S.logistic(-4 + -0.05 * ahead).alias("pc"))
    return action_values(e)


def action_values(e):
    """Offensive and defensive value of an action: the change of the chances to score and to
    concede, seen from its own side; the chances swap where the ball changed hands."""
    w = Window.partitionBy("match_id").orderBy("period", "startTime", "event_id")
    same, ps, pc = F.lag("team_id").over(w) == F.col("team_id"), F.lag("ps").over(w), F.lag("pc").over(w)
    before = lambda own, other: F.when(own.isNull(), 0.0).when(same, own).otherwise(other)
    return e.select("event_id", (F.round(F.col("ps") - before(ps, pc), 6) + 0.0).alias("offensive"), (F.round(-(F.col("pc") - before(pc, ps)), 6) + 0.0).alias("defensive"))


# --- pools and panels ---
_POOL = f"""sx AS (SELECT event_id, match_id, period, start_game_clock AS t, team_id, possessionEvents.shotOutcomeType AS o, {_XG} AS xg FROM {EV} WHERE possession_event_type = 'SH' AND ball[1].x IS NOT NULL AND ball[1].y IS NOT NULL),
po AS (SELECT * FROM sx WHERE xg BETWEEN 0.15 AND 0.85 AND o IN ('G', 'S', 'B') AND match_id IS NOT NULL AND team_id IS NOT NULL AND t IS NOT NULL)"""


def shot_pool(s, d):
    return shots(s, d).where(F.col("xg").between(0.15, 0.85) & F.col("outcome").isin("G", "S", "B")).dropna(subset=["match_id", "team_id", "start_game_clock"])


@q("c25_shot_pool", f"""WITH {_POOL}, e AS (SELECT match_id, team_id, start_game_clock AS u FROM {EV} WHERE match_id IS NOT NULL AND team_id IS NOT NULL AND start_game_clock IS NOT NULL)
SELECT po.event_id, (o = 'G')::BIGINT AS treated, round(xg, 6) AS xg, count(e.u) AS n_after FROM po LEFT JOIN e ON e.match_id = po.match_id AND e.team_id = po.team_id AND e.u BETWEEN po.t + 60 AND po.t + 600 GROUP BY ALL""")
def _(s, d):
    pool = shot_pool(s, d).select("event_id", "match_id", "team_id", (F.col("outcome") == "G").cast("long").alias("treated"), F.round("xg", 6).alias("xg"), F.col("start_game_clock").alias("t"))
    # events per ten-second slot are counted first: a shot meets sums, and single events at the two borders only through them
    e = R.events(s, d, "match_id", "team_id", "start_game_clock").dropna().groupBy("match_id", "team_id", F.col("start_game_clock").alias("u")).agg(F.count(F.lit(1)).alias("n"))
    hit = interval_join(e, pool.withColumns({"a": F.col("t") + 60, "b": F.col("t") + 600}), ["match_id", "team_id"], "u", "a", "b").groupBy("event_id").agg(F.sum("n").alias("n_after"))
    return pool.join(hit, "event_id", "left").select("event_id", "treated", "xg", F.coalesce("n_after", F.lit(0)).alias("n_after"))


_DELTA = f"""dl AS (SELECT channel, perspective, pff_player_id, shock_id, {mean_sql('CASE WHEN relative_min > 0 THEN outcome END')} - {mean_sql('CASE WHEN relative_min < 0 THEN outcome END')} AS delta, max(leverage) AS leverage FROM {PANEL} WHERE channel IS NOT NULL AND perspective IS NOT NULL AND pff_player_id IS NOT NULL AND shock_id IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING delta IS NOT NULL)"""


def delta_panel(s, d, reach: int = 10):
    p = R.panel(s, d).dropna(subset=["channel", "perspective", "pff_player_id", "shock_id"])
    rel = F.col("relative_min")
    p = p.withColumns({"after": F.when((rel > 0) & (rel <= reach), F.col("outcome")), "before": F.when((rel < 0) & (rel >= -reach), F.col("outcome"))})
    return p.groupBy("channel", "perspective", "pff_player_id", "shock_id").agg((exact_mean("after") - exact_mean("before")).alias("delta"), F.max("leverage").alias("leverage")).where("delta IS NOT NULL")


@q("c26_delta_panel", f"WITH {_DELTA} SELECT channel, perspective, pff_player_id, shock_id, round(least(greatest(coalesce((delta - avg(delta) OVER w) / nullif(stddev_samp(delta) OVER w, 0), 0), -5), 5), 5) AS z, CASE perspective WHEN 'GOAL_FOR' THEN 1 ELSE -1 END AS team_direction FROM dl WINDOW w AS (PARTITION BY channel, perspective)")
def _(s, d):
    p = delta_panel(s, d)
    m = p.groupBy("channel", "perspective").agg(F.avg("delta").alias("m"), F.stddev_samp("delta").alias("sd"))  # four channels, two sides
    z = F.coalesce(F.try_divide(F.col("delta") - F.col("m"), F.nullif("sd", F.lit(0.0))), F.lit(0.0))
    j = p.join(F.broadcast(m), ["channel", "perspective"])
    return j.select("channel", "perspective", "pff_player_id", "shock_id", F.round(F.greatest(F.least(z, F.lit(5.0)), F.lit(-5.0)), 5).alias("z"), F.when(F.col("perspective") == "GOAL_FOR", 1).otherwise(-1).alias("team_direction"))


@q("c27_acute_delta", f"SELECT pff_player_id, " + ", ".join(f"round({mean_sql(f'CASE WHEN channel = {chr(39)}{c}{chr(39)} AND relative_min BETWEEN 1 AND 5 THEN outcome END')} - {mean_sql(f'CASE WHEN channel = {chr(39)}{c}{chr(39)} AND relative_min BETWEEN -5 AND -1 THEN outcome END')}, 6) AS {c}" for c in ("ataque", "fisico")) + f" FROM {PANEL} GROUP BY 1")
def _(s, d):
    p, rel, out = R.panel(s, d), F.col("relative_min"), {}
    for c in ("ataque", "fisico"):
        mine = F.col("channel") == c
        p = p.withColumns({f"{c}_a": F.when(mine & rel.between(1, 5), F.col("outcome")), f"{c}_b": F.when(mine & rel.between(-5, -1), F.col("outcome"))})
        out[c] = F.round(exact_mean(f"{c}_a") - exact_mean(f"{c}_b"), 6).alias(c)
    return p.groupBy("pff_player_id").agg(*out.values())


@q("c29_summaries", f"SELECT channel, perspective, round({mean_sql('outcome')}, 6) AS mean, round(stddev_pop(outcome), 6) AS sd, round(quantile_cont(outcome, 0.1), 6) AS q10, round(quantile_cont(outcome, 0.9), 6) AS q90, round(count(*) FILTER (outcome > 0) / count(outcome), 6) AS p_positive FROM {PANEL} WHERE outcome IS NOT NULL GROUP BY 1, 2")
def _(s, d):
    y = F.col("outcome")
    return R.panel(s, d).where("outcome IS NOT NULL").groupBy("channel", "perspective").agg(
        F.round(exact_mean("outcome"), 6).alias("mean"), F.round(F.stddev_pop(y), 6).alias("sd"), F.round(F.percentile(y, 0.1), 6).alias("q10"), F.round(F.percentile(y, 0.9), 6).alias("q90"), F.round(F.count_if(y > 0) / F.count(y), 6).alias("p_positive")
    )


@q("c30_channel_correlations", f"WITH {_DELTA}, ds AS (SELECT channel, perspective, shock_id, avg(delta) AS delta FROM dl GROUP BY 1, 2, 3) SELECT a.channel AS channel_a, b.channel AS channel_b, round(corr(a.delta, b.delta), 5) AS r, count(*) AS n FROM ds a JOIN ds b USING (perspective, shock_id) WHERE a.channel < b.channel GROUP BY 1, 2 HAVING count(*) > 2")
def _(s, d):
    # a shock's sides have one mean delta per channel, so they stand side by side instead of meeting in a join
    wide = delta_panel(s, d).groupBy("perspective", "shock_id").pivot("channel", ["ataque", "defensa", "fisico", "offball"]).agg(F.avg("delta"))
    names = ["ataque", "defensa", "fisico", "offball"]
    pairs = [F.struct(F.lit(a).alias("channel_a"), F.lit(b).alias("channel_b"), F.col(a).alias("u"), F.col(b).alias("v")) for k, a in enumerate(names) for b in names[k + 1 :]]
    long = wide.select(F.explode(F.array(*pairs)).alias("x")).select("x.*").dropna()
    return long.groupBy("channel_a", "channel_b").agg(F.round(F.corr("u", "v"), 5).alias("r"), F.count(F.lit(1)).alias("n")).where("n > 2")


@q("c32_direction_check", f"""WITH h AS (SELECT frame_id, gameRefId::BIGINT AS game, period::BIGINT AS period, list_avg(list_transform(homePlayers, lambda p: p.x)) AS hx, list_avg(list_transform(awayPlayers, lambda p: p.x)) AS ax FROM {FRAMES} WHERE period IS NOT NULL AND gameRefId IS NOT NULL)
SELECT game, period, min(frame_id) AS frame_id, arg_min(CASE WHEN hx < ax THEN 'L' WHEN hx > ax THEN 'R' END, frame_id) AS seen, CASE WHEN period % 2 = 1 THEN 'L' ELSE 'R' END AS expected FROM h WHERE hx IS NOT NULL AND ax IS NOT NULL AND hx <> ax GROUP BY 1, 2""")
def _(s, d):
    def mean_x(side):
        xs = F.filter(F.transform(side, lambda p: p["x"]), lambda x: x.isNotNull())
        return F.try_divide(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x), F.size(xs))

    h = table(s, d, "tracking").where("period IS NOT NULL AND gameRefId IS NOT NULL").select("frame_id", F.col("gameRefId").cast("long").alias("game"), F.col("period").cast("long").alias("period"), mean_x("homePlayers").alias("hx"), mean_x("awayPlayers").alias("ax")).where("hx <> ax")
    out = h.groupBy("game", "period").agg(F.min("frame_id").alias("frame_id"), F.min_by(F.when(F.col("hx") < F.col("ax"), "L").otherwise("R"), "frame_id").alias("seen"))
    return out.withColumn("expected", S.attack_side(F.col("period"), F.lit(True)))
