"""Further projections, joins, aggregations and scalar expressions of the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchloom.functions import scalar as S
from pitchloom.operators.asof import asof_backward, interval_join
from pitchloom.operators.blocks import on_grid, others_mean
from pitchloom.operators.reshape import contract_violations, union_relaxed
from pitchloom.plans import relational as R
from pitchloom.plans.relational import EV, GOALS, PANEL, PCJ, PLAYERS, PM
from pitchloom.session import table

QUERIES: dict = {}
ORACLE: dict = {}
FRAMES = "(SELECT DISTINCT * FROM tracking)"


def q(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def exact_mean(column: str, scale: int = 9):
    """A mean whose rounding can't depend on the order of the rows."""
    return F.try_divide(F.sum(F.col(column).cast(f"decimal(24,{scale})")).cast("double"), F.count(column))


def mean_sql(column: str, scale: int = 9) -> str:
    return f"sum(CAST({column} AS DECIMAL(24,{scale})))::DOUBLE / nullif(count({column}), 0)"


# --- projections ---
@q("sel07_metadata", f"SELECT match_id, min(received_at)::DATE::VARCHAR AS match_day, count(DISTINCT team_id) AS n_teams, max(period)::BIGINT AS periods FROM events_enriched WHERE match_id IS NOT NULL GROUP BY 1")
def _(s, d):
    e = table(s, d, "events_enriched").where("match_id IS NOT NULL")
    return e.groupBy("match_id").agg(F.min("received_at").cast("date").cast("string").alias("match_day"), F.count_distinct("team_id").alias("n_teams"), F.max("period").cast("long").alias("periods"))


@q("sel08_enriched_events", f"""WITH g AS (SELECT match_id, start_game_clock AS t, max(cum_home * 1000 + cum_away) AS c FROM {GOALS} WHERE match_id IS NOT NULL AND start_game_clock IS NOT NULL AND cum_home IS NOT NULL AND cum_away IS NOT NULL GROUP BY 1, 2)
SELECT e.event_id, e.period::BIGINT AS period, coalesce(floor(g.c / 1000), 0)::BIGINT AS home, coalesce(g.c % 1000, 0)::BIGINT AS away, CASE WHEN e.gameEvents.homeTeam = (e.period % 2 = 1) THEN 'R' ELSE 'L' END AS direction,
CASE WHEN e.gameEvents.homeTeam = (e.period % 2 = 1) THEN e.ball[1].x ELSE -e.ball[1].x END AS x FROM (SELECT * FROM {EV} WHERE match_id IS NOT NULL AND start_game_clock IS NOT NULL AND gameEvents.homeTeam IS NOT NULL AND period IS NOT NULL AND ball[1].x IS NOT NULL) e ASOF LEFT JOIN g ON e.match_id = g.match_id AND e.start_game_clock >= g.t""")
def _(s, d):
    x = F.get("ball", F.lit(0))["x"]
    e = R.events(s, d, "match_id", "period", "start_game_clock", "gameEvents", "ball").select("event_id", "match_id", "period", "start_game_clock", F.col("gameEvents.homeTeam").alias("home_team"), x.alias("x")).dropna()
    g = R.goals(s, d).dropna(subset=["cum_home", "cum_away"]).select("match_id", "start_game_clock", F.col("cum_home").alias("home"), F.col("cum_away").alias("away"))
    right = F.col("home_team") == (F.col("period") % 2 == 1)
    got = asof_backward(e, g, ["match_id"], "start_game_clock", ["home", "away"], 0)
    return got.select("event_id", F.col("period").cast("long").alias("period"), "home", "away", F.when(right, "R").otherwise("L").alias("direction"), S.flip(F.col("x"), ~right).alias("x"))


@q("sel10_between", f"SELECT panel_id FROM {PANEL} WHERE relative_min BETWEEN -5 AND 5 AND leverage BETWEEN 0.05 AND 0.1")
def _(s, d):
    return R.panel(s, d).where(F.col("relative_min").between(-5, 5) & F.col("leverage").between(0.05, 0.1)).select("panel_id")


@q("sel11_conditional", f"SELECT panel_id, CASE WHEN stage = 'GROUP' THEN 'group' WHEN stage IN ('R16', 'QF') THEN 'ko' WHEN stage IS NULL THEN 'unknown' ELSE 'other' END AS phase FROM {PANEL}")
def _(s, d):
    st = F.col("stage")
    return R.panel(s, d).select("panel_id", F.when(st == "GROUP", "group").when(st.isin("R16", "QF"), "ko").when(st.isNull(), "unknown").otherwise("other").alias("phase"))


@q("sel12_coalesce", f"SELECT id, coalesce(nickname, firstName || ' ' || lastName, lastName, 'unknown') AS shown FROM {PLAYERS}")
def _(s, d):
    return R.players(s, d).select("id", F.coalesce("nickname", F.concat("firstName", F.lit(" "), "lastName"), "lastName", F.lit("unknown")).alias("shown"))


@q("sel18_aligned_union", f"SELECT 'goal' AS kind, goal_id AS id, minute, is_own_goal AS flag FROM {GOALS} UNION ALL SELECT 'sub', event_id, minute, NULL FROM {EV} WHERE game_event_type = 'SUB'")
def _(s, d):
    a = R.goals(s, d).select(F.lit("goal").alias("kind"), F.col("goal_id").alias("id"), "minute", F.col("is_own_goal").alias("flag"))
    b = R.events(s, d, "minute", "game_event_type").where("game_event_type = 'SUB'").select(F.lit("sub").alias("kind"), F.col("event_id").alias("id"), "minute")
    return union_relaxed([a, b])


CONTRACTS = {"pcj_table": {"edition_id": "int", "pff_player_id": "int", "chasing_clutch_idx": "float", "position_group": "text"}, "players": {"id": "int", "height": "int", "shirt": "text"}, "goals_timeline": {"is_own_goal": "bool", "minute": "text"}}


@q("sel20_contract", "SELECT * FROM (VALUES ('players', 'height: double is no int'), ('players', 'missing shirt'), ('goals_timeline', 'minute: bigint is no text')) AS t(table_name, violation)")
def _(s, d):
    wrong = [(name, w) for name, rules in CONTRACTS.items() for w in contract_violations(table(s, d, name), rules)]
    return s.createDataFrame(wrong, "table_name string, violation string")


@q("sel21_unnest", f"SELECT event_id, gameEvents.teamName AS teamName, gameEvents.playerName AS playerName, gameEvents.setpieceType AS setpieceType FROM {EV} WHERE gameEvents IS NOT NULL")
def _(s, d):
    return R.events(s, d, "gameEvents").where("gameEvents IS NOT NULL").select("event_id", "gameEvents.*").select("event_id", "teamName", "playerName", "setpieceType")


# --- joins ---
@q("j02_running_score", f"""WITH g AS (SELECT match_id, start_game_clock AS t, max(cum_home - cum_away) AS lead FROM {GOALS} WHERE match_id IS NOT NULL AND start_game_clock IS NOT NULL AND cum_home IS NOT NULL AND cum_away IS NOT NULL GROUP BY 1, 2)
SELECT e.event_id, g.lead FROM (SELECT * FROM {EV} WHERE match_id IS NOT NULL AND start_game_clock IS NOT NULL) e ASOF LEFT JOIN g ON e.match_id = g.match_id AND e.start_game_clock >= g.t""")
def _(s, d):
    e = R.events(s, d, "match_id", "start_game_clock").dropna()
    g = R.goals(s, d).select("match_id", "start_game_clock", (F.col("cum_home") - F.col("cum_away")).alias("lead")).dropna()
    return asof_backward(e, g, ["match_id"], "start_game_clock", ["lead"]).select("event_id", "lead")


@q("j03_press_score", f"""WITH g AS (SELECT match_id, start_game_clock AS t, max(cum_home + cum_away) AS n FROM {GOALS} WHERE match_id IS NOT NULL AND start_game_clock IS NOT NULL AND cum_home IS NOT NULL AND cum_away IS NOT NULL GROUP BY 1, 2)
SELECT e.event_id, coalesce(g.n, 0) AS goals_before FROM (SELECT * FROM {EV} WHERE possession_event_type = 'CH' AND match_id IS NOT NULL AND start_game_clock IS NOT NULL) e ASOF LEFT JOIN g ON e.match_id = g.match_id AND e.start_game_clock >= g.t""")
def _(s, d):
    e = table(s, d, "events_enriched").where("possession_event_type = 'CH'").select("event_id", "match_id", "start_game_clock").dropna().distinct()
    g = R.goals(s, d).select("match_id", "start_game_clock", (F.col("cum_home") + F.col("cum_away")).alias("n")).dropna()
    return asof_backward(e, g, ["match_id"], "start_game_clock", ["n"], 0).select("event_id", F.col("n").alias("goals_before"))


@q("j04_event_frame", f"""WITH f AS (SELECT gameRefId::BIGINT AS match_id, videoTimeMs AS t, max(frame_id) AS frame_id FROM {FRAMES} WHERE gameRefId IS NOT NULL AND videoTimeMs IS NOT NULL GROUP BY 1, 2),
e AS (SELECT event_id, match_id, startTime * 1000 AS t FROM {EV} WHERE match_id IS NOT NULL AND startTime IS NOT NULL), a AS (SELECT e.*, f.frame_id AS frame_id FROM e ASOF LEFT JOIN f ON e.match_id = f.match_id AND e.t >= f.t)
SELECT a.event_id, a.frame_id, f.frame_id AS frame_before FROM (SELECT *, t - 1000 AS u FROM a) a ASOF LEFT JOIN f ON a.match_id = f.match_id AND a.u >= f.t""")
def _(s, d):
    e = R.events(s, d, "match_id", "startTime").select("event_id", "match_id", (F.col("startTime") * 1000).alias("t")).dropna()
    f = table(s, d, "tracking").select(F.col("gameRefId").cast("long").alias("match_id"), F.col("videoTimeMs").alias("t"), "frame_id").distinct()
    got = asof_backward(e, f, ["match_id"], "t", ["frame_id"]).withColumn("t", F.col("t") - 1000)
    then = asof_backward(got, f.withColumnRenamed("frame_id", "frame_before"), ["match_id"], "t", ["frame_before"])
    return then.select("event_id", "frame_id", "frame_before")


@q("j05_action_frame", f"""WITH f AS (SELECT gameRefId::BIGINT AS match_id, period::BIGINT AS period, periodGameClockTime AS t, max(frame_id) AS frame_id FROM {FRAMES} WHERE gameRefId IS NOT NULL AND period IS NOT NULL AND periodGameClockTime IS NOT NULL GROUP BY ALL)
SELECT e.event_id, f.frame_id FROM (SELECT event_id, match_id, period::BIGINT AS period, (start_game_clock - (period - 1) * 2700)::DOUBLE AS t FROM {EV} WHERE match_id IS NOT NULL AND period IS NOT NULL AND start_game_clock IS NOT NULL) e ASOF LEFT JOIN f ON e.match_id = f.match_id AND e.period = f.period AND e.t >= f.t""")
def _(s, d):
    e = R.events(s, d, "match_id", "period", "start_game_clock").dropna().select("event_id", "match_id", F.col("period").cast("long").alias("period"), (F.col("start_game_clock") - (F.col("period") - 1) * 2700).cast("double").alias("t"))
    f = table(s, d, "tracking").select(F.col("gameRefId").cast("long").alias("match_id"), F.col("period").cast("long").alias("period"), F.col("periodGameClockTime").alias("t"), "frame_id").distinct()
    return asof_backward(e, f, ["match_id", "period"], "t", ["frame_id"]).select("event_id", "frame_id")


@q("j08_inner_lookup", f"SELECT DISTINCT e.match_id, e.player_id, p.positionGroupType AS position_type FROM {EV} e JOIN {PLAYERS} p ON p.id = e.player_id")
def _(s, d):
    e = table(s, d, "events_enriched").select("match_id", "player_id").where("player_id IS NOT NULL").distinct()
    return e.join(R.players(s, d).select(F.col("id").alias("player_id"), F.col("positionGroupType").alias("position_type")), "player_id").select("match_id", "player_id", "position_type").distinct()


@q("j09_interval", f"SELECT g.goal_id, e.event_id FROM {GOALS} g JOIN {EV} e ON e.match_id = g.match_id AND e.period = g.period AND e.start_game_clock >= g.start_game_clock - 60 AND e.start_game_clock < g.start_game_clock")
def _(s, d):
    g = R.goals(s, d).select("goal_id", "match_id", "period", (F.col("start_game_clock") - 60).alias("a"), F.col("start_game_clock").alias("b"))
    e = R.events(s, d, "match_id", "period", "start_game_clock")
    return interval_join(e, g, ["match_id", "period"], "start_game_clock", "a", "b", closed_end=False).select("goal_id", "event_id")


@q("j17_dense_grid", f"""WITH c AS (SELECT match_id, player_id, minute, count(*) AS n FROM {EV} WHERE match_id IS NOT NULL AND player_id IS NOT NULL AND minute IS NOT NULL AND possession_event_type = 'PA' GROUP BY ALL)
SELECT m.match_id, m.player_id, g.minute, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT match_id, player_id FROM c) m JOIN (SELECT DISTINCT match_id, minute FROM c) g USING (match_id) LEFT JOIN c USING (match_id, player_id, minute)""")
def _(s, d):
    c = R.events(s, d, "match_id", "player_id", "minute", "possession_event_type").where("possession_event_type = 'PA'").dropna().groupBy("match_id", "player_id", "minute").agg(F.count(F.lit(1)).alias("n"))
    return on_grid(c, ["match_id"], "player_id", "minute", ["n"], 0)


@q("j19_relative_seconds", f"SELECT g.goal_id, count(*) AS n, min(e.start_game_clock - g.start_game_clock) AS first_sec FROM {GOALS} g JOIN {EV} e ON e.match_id = g.match_id AND e.start_game_clock BETWEEN g.start_game_clock + 60 AND g.start_game_clock + 600 GROUP BY 1")
def _(s, d):
    g = R.goals(s, d).select("goal_id", "match_id", F.col("start_game_clock").alias("t")).dropna().withColumns({"a": F.col("t") + 60, "b": F.col("t") + 600})
    e = R.events(s, d, "match_id", "start_game_clock").dropna()
    return interval_join(e, g, ["match_id"], "start_game_clock", "a", "b").groupBy("goal_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("start_game_clock") - F.col("t")).alias("first_sec"))


@q("j20_team_crosswalk", f"SELECT DISTINCT e.team_id, p.pff_player_id FROM (SELECT DISTINCT team_id, lower(trim(gameEvents.teamName)) AS nm FROM events_enriched WHERE team_id IS NOT NULL) e JOIN (SELECT DISTINCT pff_player_id, lower(trim(team_name)) AS nm FROM pcj_table) p ON p.nm = e.nm")
def _(s, d):
    e = table(s, d, "events_enriched").where("team_id IS NOT NULL").select("team_id", F.lower(F.trim("gameEvents.teamName")).alias("nm")).distinct()
    return e.join(table(s, d, "pcj_table").select("pff_player_id", F.lower(F.trim("team_name")).alias("nm")).distinct(), "nm").select("team_id", "pff_player_id").distinct()


@q("j23_side_by_side", "SELECT DISTINCT match_id, minute_bin, score_diff, score_diff * score_diff AS squared FROM training_matrix")
def _(s, d):
    # two frames of the same rows put side by side are one projection
    return table(s, d, "training_matrix").select("match_id", "minute_bin", "score_diff", (F.col("score_diff") * F.col("score_diff")).alias("squared")).distinct()


# --- aggregations ---
@q("a13_event_others", f"""WITH e AS (SELECT event_id, match_id, team_id, minute, CAST(endTime - startTime AS DECIMAL(18,6)) AS v FROM {EV} WHERE match_id IS NOT NULL AND team_id IS NOT NULL AND minute IS NOT NULL)
SELECT event_id, round(CASE WHEN count(*) OVER w > 1 THEN (coalesce(sum(v) OVER w, 0) - coalesce(v, 0))::DOUBLE / (count(*) OVER w - 1) END, 6) AS others FROM e WINDOW w AS (PARTITION BY match_id, team_id, minute)""")
def _(s, d):
    e = R.events(s, d, "match_id", "team_id", "minute", "startTime", "endTime").dropna(subset=["match_id", "team_id", "minute"])
    w = Window.partitionBy("match_id", "team_id", "minute")
    v = (F.col("endTime") - F.col("startTime")).cast("decimal(18,6)")
    e = e.withColumns({"v": v, "n": F.count(F.lit(1)).over(w)}).withColumn("total", F.sum("v").over(w))
    zero = F.lit(0).cast("decimal(18,6)")
    return e.select("event_id", F.round(F.when(F.col("n") > 1, (F.coalesce("total", zero) - F.coalesce("v", zero)).cast("double") / (F.col("n") - 1)), 6).alias("others"))


@q("a16_count_by_type", f"SELECT possessionEvents.shotOutcomeType AS outcome, count(*) AS n FROM {EV} WHERE possession_event_type = 'SH' GROUP BY 1")
def _(s, d):
    return table(s, d, "events_enriched").where("possession_event_type = 'SH'").select("event_id", F.col("possessionEvents.shotOutcomeType").alias("outcome")).distinct().groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@q("a21_channel_means", f"SELECT pff_player_id, " + ", ".join(f"round(sum(CAST(outcome AS DECIMAL(24,9))) FILTER (channel = '{c}')::DOUBLE / nullif(count(outcome) FILTER (channel = '{c}'), 0), 6) AS {c}" for c in ("ataque", "defensa", "fisico", "offball")) + f" FROM {PANEL} WHERE channel IS NOT NULL AND pff_player_id IS NOT NULL GROUP BY 1")
def _(s, d):
    # one pivot instead of a chain of full outer joins
    p = R.panel(s, d).dropna(subset=["channel", "pff_player_id"])
    return p.groupBy("pff_player_id").pivot("channel", ["ataque", "defensa", "fisico", "offball"]).agg(F.round(exact_mean("outcome"), 6))


@q("a22_grades", f"""WITH g AS (SELECT pm_id, pff_player_id, list_avg([CAST(n_high_accel AS DOUBLE), n_high_decel]) AS grade FROM {PM})
SELECT p.id, round({mean_sql('g.grade')}, 6) AS mean_grade, count(g.grade) AS n FROM g JOIN {PLAYERS} p ON p.id = g.pff_player_id GROUP BY 1""")
def _(s, d):
    parts = F.filter(F.array(F.col("n_high_accel").cast("double"), F.col("n_high_decel")), lambda x: x.isNotNull())
    g = R.minutes(s, d).select(F.col("pff_player_id").alias("id"), F.try_divide(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), F.size(parts)).alias("grade"))
    per = g.groupBy("id").agg(F.round(exact_mean("grade"), 6).alias("mean_grade"), F.count("grade").alias("n"))
    return per.join(R.players(s, d).select("id"), "id", "left_semi").select("id", "mean_grade", "n")


_SIDES = f"(SELECT match_id, team_id, h FROM (SELECT match_id, team_id, gameEvents.homeTeam AS h, count(*) AS n FROM {EV} WHERE match_id IS NOT NULL AND team_id IS NOT NULL AND gameEvents.homeTeam IS NOT NULL GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY match_id, team_id ORDER BY n DESC, h) = 1)"


def sides(s, d) -> DataFrame:
    """(match_id, team_id, is_home) by the flag that most of the team's events carry."""
    e = R.events(s, d, "match_id", "team_id", "gameEvents").select("match_id", "team_id", F.col("gameEvents.homeTeam").alias("h")).dropna()
    n = e.groupBy("match_id", "team_id", "h").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("match_id", "team_id").agg(F.min_by("h", F.struct(-F.col("n"), "h")).alias("is_home"))


@q("a32_goals_by_side", f"""WITH t AS (SELECT match_id, scoring_team_id AS team_id, count(*) AS n FROM {GOALS} WHERE minute <= 90 AND match_id IS NOT NULL GROUP BY 1, 2), s AS {_SIDES}
SELECT h.match_id, h.team_id AS home, a.team_id AS away, coalesce(x.n, 0) AS home_goals, coalesce(y.n, 0) AS away_goals FROM (SELECT * FROM s WHERE h) h JOIN (SELECT * FROM s WHERE NOT h) a USING (match_id)
LEFT JOIN t x ON x.match_id = h.match_id AND x.team_id = h.team_id LEFT JOIN t y ON y.match_id = h.match_id AND y.team_id = a.team_id""")
def _(s, d):
    t = R.goals(s, d).where("minute <= 90 AND match_id IS NOT NULL").groupBy("match_id", F.col("scoring_team_id").alias("team_id")).agg(F.count(F.lit(1)).alias("n"))
    side = sides(s, d)
    with_goals = side.join(t, ["match_id", "team_id"], "left").fillna(0, ["n"])
    h = with_goals.where("is_home").select("match_id", F.col("team_id").alias("home"), F.col("n").alias("home_goals"))
    a = with_goals.where("NOT is_home").select("match_id", F.col("team_id").alias("away"), F.col("n").alias("away_goals"))
    return h.join(a, "match_id").select("match_id", "home", "away", "home_goals", "away_goals")


@q("a33_possession_frames", f"""WITH f AS (SELECT gameRefId::BIGINT AS game, period::BIGINT AS period, floor(periodGameClockTime / 60)::BIGINT AS minute, coalesce(game_event.home_ball, false) AS h FROM {FRAMES} WHERE periodGameClockTime IS NOT NULL)
SELECT game, period, minute, side, count(*) FILTER (h = (side = 'home')) AS frames_in, count(*) FILTER (h <> (side = 'home')) AS frames_out FROM f, (SELECT unnest(['home', 'away']) AS side) GROUP BY ALL""")
def _(s, d):
    f = table(s, d, "tracking").dropDuplicates(["frame_id"]).where("periodGameClockTime IS NOT NULL")
    f = f.select(F.col("gameRefId").cast("long").alias("game"), F.col("period").cast("long").alias("period"), F.floor(F.col("periodGameClockTime") / 60).alias("minute"), F.coalesce("game_event.home_ball", F.lit(False)).alias("h"))
    n = f.groupBy("game", "period", "minute").agg(F.count_if("h").alias("home"), F.count_if(~F.col("h")).alias("away"))
    two = n.select("game", "period", "minute", F.explode(F.array(F.struct(F.lit("home").alias("side"), F.col("home").alias("i"), F.col("away").alias("o")), F.struct(F.lit("away").alias("side"), F.col("away").alias("i"), F.col("home").alias("o")))).alias("t"))
    return two.select("game", "period", "minute", "t.side", F.col("t.i").alias("frames_in"), F.col("t.o").alias("frames_out"))


@q("w04_next_same_team", f"SELECT event_id, coalesce((lead(team_id) OVER w = team_id)::BIGINT, 0) AS kept FROM {EV} WINDOW w AS (PARTITION BY match_id ORDER BY period NULLS FIRST, startTime NULLS FIRST, event_id)")
def _(s, d):
    w = Window.partitionBy("match_id").orderBy("period", "startTime", "event_id")
    return R.events(s, d, "match_id", "period", "startTime", "team_id").select("event_id", F.coalesce((F.lead("team_id").over(w) == F.col("team_id")).cast("long"), F.lit(0)).alias("kept"))


@q("w06_z_in_position", f"SELECT edition_id, pff_player_id, round(coalesce((minutes_played - avg(minutes_played) OVER w) / coalesce(nullif(stddev_samp(minutes_played) OVER w, 0), 1), 0), 5) AS z FROM {PCJ} WINDOW w AS (PARTITION BY position_group)")
def _(s, d):
    # groups may hold a twentieth of all rows: their moments are aggregated and joined, not gathered by a window
    p = R.pcj(s, d).select("edition_id", "pff_player_id", "position_group", "minutes_played")
    m = p.groupBy(F.col("position_group").alias("g")).agg(F.avg("minutes_played").alias("m"), F.stddev_samp("minutes_played").alias("sd"))
    j = p.join(F.broadcast(m), F.col("position_group").eqNullSafe(F.col("g")))  # a row per position
    return j.select("edition_id", "pff_player_id", F.round(F.coalesce((F.col("minutes_played") - F.col("m")) / F.coalesce(F.nullif("sd", F.lit(0.0)), F.lit(1.0)), F.lit(0.0)), 5).alias("z"))


@q("o04_largest_or_lower_bar", f"""WITH p AS (SELECT edition_id, pff_player_id, minutes_played AS v FROM {PCJ}), hi AS (SELECT count(*) AS n FROM p WHERE v >= 2500)
SELECT edition_id, pff_player_id, v FROM p, hi WHERE v >= CASE WHEN hi.n >= 5 THEN 2500 ELSE 1500 END ORDER BY v DESC, edition_id, pff_player_id LIMIT 10""")
def _(s, d):
    p = R.pcj(s, d).select("edition_id", "pff_player_id", F.col("minutes_played").alias("v"))
    # of ten rows above the lower bar at most the first five decide whether the higher one is met
    top = p.where("v >= 1500").orderBy(F.desc("v"), "edition_id", "pff_player_id").limit(10)
    high = F.count_if(F.col("v") >= 2500).over(Window.partitionBy(F.lit(0)))
    return top.withColumn("n", high).where((F.col("v") >= 2500) | (F.col("n") < 5)).drop("n")


@q("o05_listing", f"SELECT row_number() OVER (ORDER BY minutes_played DESC NULLS LAST, edition_id, pff_player_id) AS place, format('{{}} ({{}})', coalesce(player_name, '?'), coalesce(team_name, '?')) AS line FROM {PCJ} ORDER BY 1 LIMIT 15")
def _(s, d):
    top = R.pcj(s, d).orderBy(F.desc_nulls_last("minutes_played"), "edition_id", "pff_player_id").limit(15)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("minutes_played"), "edition_id", "pff_player_id"))
    return top.select(place.cast("long").alias("place"), F.format_string("%s (%s)", F.coalesce("player_name", F.lit("?")), F.coalesce("team_name", F.lit("?"))).alias("line"))


@q("u02_diagonal", "SELECT 'n' AS kind, n_nationkey::BIGINT AS k, n_name AS name, n_regionkey::BIGINT AS region FROM nation UNION ALL SELECT 'r', r_regionkey, r_name, NULL FROM region")
def _(s, d):
    a = table(s, d, "nation").select(F.lit("n").alias("kind"), F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"))
    return a.unionByName(table(s, d, "region").select(F.lit("r").alias("kind"), F.col("r_regionkey").cast("long").alias("k"), F.col("r_name").alias("name")), allowMissingColumns=True)


@q("u03_supertype", "SELECT l_linenumber::DOUBLE AS v FROM lineitem WHERE l_quantity > 49 UNION ALL SELECT s_acctbal FROM supplier")
def _(s, d):
    return union_relaxed([table(s, d, "lineitem").where("l_quantity > 49").select(F.col("l_linenumber").alias("v")), table(s, d, "supplier").select(F.col("s_acctbal").alias("v"))])


@q("u05_distinct_subset", f"SELECT match_id, team_id, min(event_id) AS event_id FROM {EV} GROUP BY 1, 2")
def _(s, d):
    return table(s, d, "events_enriched").groupBy("match_id", "team_id").agg(F.min("event_id").alias("event_id"))


@q("u11_display_pivot", f"SELECT coalesce(stage, 'none') AS stage, count(*) FILTER (post = 0) AS pre, count(*) FILTER (post = 1) AS post FROM {PANEL} GROUP BY 1")
def _(s, d):
    return R.panel(s, d).withColumn("stage", F.coalesce("stage", F.lit("none"))).groupBy("stage").pivot("post", [0, 1]).agg(F.count(F.lit(1))).select("stage", F.coalesce("0", F.lit(0)).alias("pre"), F.coalesce("1", F.lit(0)).alias("post"))


@q("u12_renames", f"SELECT goal_id AS id, match_id AS game, minute AS at_minute FROM {GOALS}")
def _(s, d):
    return R.goals(s, d).select("goal_id", "match_id", "minute").withColumnsRenamed({"goal_id": "id", "match_id": "game", "minute": "at_minute"})


# --- scalar expressions ---
@q("f02_attack_direction", "SELECT * FROM (SELECT DISTINCT gameRefId::BIGINT AS game, period::BIGINT AS period, CASE WHEN period % 2 = 1 THEN 'L' ELSE 'R' END AS home_side FROM tracking WHERE period IS NOT NULL)")
def _(s, d):
    return table(s, d, "tracking").where("period IS NOT NULL").select(F.col("gameRefId").cast("long").alias("game"), F.col("period").cast("long").alias("period"), S.attack_side(F.col("period"), F.lit(True)).alias("home_side")).distinct()


@q("f03_week_index", f"SELECT edition_id, pff_player_id, round(coalesce((CASE WHEN n_matches_played IS NOT NULL THEN least(greatest(n_matches_played, 1), 8) END - 1) / 7.0, 0), 6) AS week_index FROM {PCJ}")
def _(s, d):
    return R.pcj(s, d).select("edition_id", "pff_player_id", F.round(S.week_index(F.col("n_matches_played"), 8), 6).alias("week_index"))


@q("f04_stride", f"SELECT frame_id, floor(periodGameClockTime / 60)::BIGINT AS minute FROM {FRAMES} WHERE frameNum % 25 = 0")
def _(s, d):
    return table(s, d, "tracking").dropDuplicates(["frame_id"]).where(F.pmod("frameNum", F.lit(25)) == 0).select("frame_id", F.floor(F.col("periodGameClockTime") / 60).alias("minute"))


@q("f06_goal_angle", f"SELECT event_id, round(atan2(ball[1].y, 52.5 - ball[1].x), 5) + 0.0 AS angle FROM {EV} WHERE ball[1].x IS NOT NULL AND ball[1].y IS NOT NULL")
def _(s, d):
    b = F.get("ball", F.lit(0))
    return R.events(s, d, "ball").where(b["x"].isNotNull() & b["y"].isNotNull()).select("event_id", (F.round(S.goal_angle(b["x"], b["y"]), 5) + 0.0).alias("angle"))


@q("f09_freeze_frame", f"""WITH f AS (SELECT frame_id, balls[1].x AS bx, balls[1].y AS by_, awayPlayers AS opp FROM {FRAMES} WHERE balls[1].x IS NOT NULL AND balls[1].y IS NOT NULL),
o AS (SELECT frame_id, bx, by_, p.x AS x, p.y AS y FROM (SELECT frame_id, bx, by_, unnest(opp) AS p FROM f) WHERE p.x IS NOT NULL AND p.y IS NOT NULL),
m AS (SELECT frame_id, count(*) FILTER (sqrt((x - bx) * (x - bx) + (y - by_) * (y - by_)) <= 3) AS close_by, round(min(sqrt((x - bx) * (x - bx) + (y - by_) * (y - by_))), 6) AS nearest, count(*) FILTER (x > bx) AS ahead FROM o GROUP BY 1)
SELECT f.frame_id, coalesce(m.close_by, 0) AS close_by, coalesce(m.nearest, 99.0) AS nearest, coalesce(m.ahead, 0) AS ahead FROM f LEFT JOIN m USING (frame_id)""")
def _(s, d):
    ball = F.get("balls", F.lit(0))
    f = table(s, d, "tracking").dropDuplicates(["frame_id"]).where(ball["x"].isNotNull() & ball["y"].isNotNull()).select("frame_id", ball["x"].alias("bx"), ball["y"].alias("by"), "awayPlayers")
    geometry = S.freeze_frame(F.col("awayPlayers"), F.col("bx"), F.col("by"), 3.0, 99.0)
    return f.select("frame_id", geometry["close_by"].cast("long").alias("close_by"), F.round(geometry["nearest"], 6).alias("nearest"), geometry["ahead"].cast("long").alias("ahead"))


@q("f10_one_hot", f"SELECT event_id, " + ", ".join(f"coalesce((possession_event_type = '{k}')::BIGINT, 0) AS is_{k.lower()}" for k in ("PA", "SH", "CR")) + f" FROM {EV}")
def _(s, d):
    return R.events(s, d, "possession_event_type").select("event_id", *[S.one_hot(F.col("possession_event_type"), k).alias(f"is_{k.lower()}") for k in ("PA", "SH", "CR")])


@q("f11_shot_features", f"""WITH b AS (SELECT event_id, ball[1].x AS x, ball[1].y AS y, minute, coalesce(gameEvents.homeTeam, false) AS h, coalesce(possessionEvents.shotOutcomeType = 'G', false) AS g, gameEvents.setpieceType AS sp FROM {EV} WHERE possession_event_type = 'SH' AND ball[1].x IS NOT NULL AND ball[1].y IS NOT NULL),
m AS (SELECT *, sqrt(pow(52.5 - x, 2) + pow(3.66 - y, 2)) AS a, sqrt(pow(52.5 - x, 2) + pow(-3.66 - y, 2)) AS c FROM b)
SELECT event_id, round(sqrt(pow(52.5 - x, 2) + pow(y, 2)), 5) AS distance, round(abs(atan2(y, 52.5 - x)), 5) AS angle, round(acos(greatest(-1, least(1, (a * a + c * c - 7.32 * 7.32) / (2 * a * c + 1e-8)))), 4) AS aperture, coalesce((sp = 'F')::BIGINT, 0) AS free_kick, coalesce((sp = 'C')::BIGINT, 0) AS corner, h::BIGINT AS home, minute, g::BIGINT AS label FROM m""")
def _(s, d):
    b = F.get("ball", F.lit(0))
    e = table(s, d, "events_enriched").where((F.col("possession_event_type") == "SH") & b["x"].isNotNull() & b["y"].isNotNull()).drop("received_at").dropDuplicates(["event_id"])
    sp = F.col("gameEvents.setpieceType")
    return e.select(
        "event_id", F.round(S.goal_distance(b["x"], b["y"]), 5).alias("distance"), F.round(F.abs(S.goal_angle(b["x"], b["y"])), 5).alias("angle"), F.round(S.goal_aperture(b["x"], b["y"]), 4).alias("aperture"),
        S.one_hot(sp, "F").alias("free_kick"), S.one_hot(sp, "C").alias("corner"), F.coalesce("gameEvents.homeTeam", F.lit(False)).cast("long").alias("home"), "minute", S.one_hot(F.col("possessionEvents.shotOutcomeType"), "G").alias("label"),
    )


@q("f13_date_key", "SELECT o_orderkey, substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS day FROM orders")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", F.substring(F.col("o_orderdate").cast("string"), 1, 10).alias("day"))


@q("f14_split", f"SELECT id, len(string_split(lastName, ' ')) AS n, string_split(lastName, ' ')[1] AS first_part FROM {PLAYERS} WHERE lastName IS NOT NULL")
def _(s, d):
    parts = F.split("lastName", " ")
    return R.players(s, d).where("lastName IS NOT NULL").select("id", F.size(parts).cast("long").alias("n"), F.get(parts, F.lit(0)).alias("first_part"))


@q("f15_starts_with", f"SELECT id FROM {PLAYERS} WHERE starts_with(positionGroupType, 'L')")
def _(s, d):
    return R.players(s, d).where(F.col("positionGroupType").startswith("L")).select("id")


@q("f16_matches", f"SELECT id FROM {PLAYERS} WHERE regexp_matches(lastName, '[aeiou]{{2}}')")
def _(s, d):
    return R.players(s, d).where(F.col("lastName").rlike("[aeiou]{2}")).select("id")


@q("f21_list_map", f"SELECT frame_id, array_to_string(list_transform(homePlayers, lambda p: coalesce(p.jerseyNum, '-')), '|') AS shirts FROM {FRAMES}")
def _(s, d):
    return table(s, d, "tracking").dropDuplicates(["frame_id"]).select("frame_id", F.array_join(F.transform("homePlayers", lambda p: F.coalesce(p["jerseyNum"], F.lit("-"))), "|").alias("shirts"))


@q("f22_list_contains", f"SELECT frame_id, list_contains(list_transform(homePlayers, lambda p: p.jerseyNum), '7') AS has_seven FROM {FRAMES} WHERE homePlayers IS NOT NULL")
def _(s, d):
    return table(s, d, "tracking").dropDuplicates(["frame_id"]).where("homePlayers IS NOT NULL").select("frame_id", F.exists("homePlayers", lambda p: p["jerseyNum"].eqNullSafe("7")).alias("has_seven"))


@q("f23_opponent", f"WITH t AS (SELECT match_id, list_sort(list(DISTINCT team_id)) AS ts FROM {EV} WHERE team_id IS NOT NULL AND match_id IS NOT NULL GROUP BY 1) SELECT DISTINCT e.match_id, e.team_id, list_filter(ts, lambda x: x <> e.team_id)[1] AS opponent FROM {EV} e JOIN t USING (match_id) WHERE e.team_id IS NOT NULL")
def _(s, d):
    e = table(s, d, "events_enriched").select("match_id", "team_id").dropna().distinct()
    t = e.groupBy("match_id").agg(F.array_sort(F.collect_set("team_id")).alias("ts"))  # the teams of a match
    return e.join(t, "match_id").select("match_id", "team_id", F.get(F.array_except("ts", F.array("team_id")), F.lit(0)).alias("opponent"))


@q("f24_map_fields", "SELECT DISTINCT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def _(s, d):
    entries = F.map_entries(F.from_json("props", "map<string,string>"))
    k = F.get(F.filter(entries, lambda e: e["key"] == "k"), F.lit(0))["value"]
    return table(s, d, "events").select("event_id", k.try_cast("long").alias("k")).where("k IS NOT NULL").distinct()


@q("f27_temperature", "WITH p AS (SELECT DISTINCT match_id, minute_bin, 1 / (1 + exp(-0.4 * score_diff)) AS a FROM training_matrix WHERE score_diff IS NOT NULL) SELECT match_id, minute_bin, round(exp(ln(a) / 1.5) / (exp(ln(a) / 1.5) + exp(ln(1 - a) / 1.5)), 6) AS p FROM p")
def _(s, d):
    a = S.logistic(0.4 * F.col("score_diff"))
    return table(s, d, "training_matrix").where("score_diff IS NOT NULL").select("match_id", "minute_bin", F.round(S.temperature([a, 1 - a], 1.5)[0], 6).alias("p")).distinct()


@q("f30_grid_lookup", f"""WITH e AS (SELECT event_id, CASE WHEN gameEvents.homeTeam THEN ball[1].x ELSE -ball[1].x END AS x, CASE WHEN gameEvents.homeTeam THEN ball[1].y ELSE -ball[1].y END AS y, possession_event_type AS k, coalesce(possessionEvents.shotOutcomeType = 'G', false) AS g FROM {EV} WHERE ball[1].x IS NOT NULL AND ball[1].y IS NOT NULL AND gameEvents.homeTeam IS NOT NULL),
c AS (SELECT *, least(greatest(floor((x + 52.5) / 10.5), 0), 9) AS ix, least(greatest(floor((y + 34) / (68.0 / 7)), 0), 6) AS iy FROM e), m AS (SELECT ix, iy, avg(g::INT) AS v FROM c WHERE k = 'SH' GROUP BY 1, 2)
SELECT event_id, round(coalesce(m.v, 0.03), 6) AS v FROM c LEFT JOIN m USING (ix, iy)""")
def _(s, d):
    b, home = F.get("ball", F.lit(0)), F.col("gameEvents.homeTeam")
    e = R.events(s, d, "ball", "gameEvents", "possession_event_type", "possessionEvents").where(b["x"].isNotNull() & b["y"].isNotNull() & home.isNotNull())
    ix, iy = S.grid_cell(S.flip(b["x"], ~home), 52.5, 10.5, 10), S.grid_cell(S.flip(b["y"], ~home), 34.0, 68.0 / 7, 7)
    e = e.select("event_id", ix.alias("ix"), iy.alias("iy"), "possession_event_type", S.one_hot(F.col("possessionEvents.shotOutcomeType"), "G").alias("g"))
    m = e.where("possession_event_type = 'SH'").groupBy("ix", "iy").agg(F.avg("g").alias("v"))  # 70 cells
    return e.join(F.broadcast(m), ["ix", "iy"], "left").select("event_id", F.round(F.coalesce("v", F.lit(0.03)), 6).alias("v"))


@q("f31_metabolic_power", f"SELECT pm_id, round(greatest((155.4 * pow(a, 5) - 30.4 * pow(a, 4) - 43.3 * pow(a, 3) + 46.3 * a * a + 19.5 * a + 3.6) * sqrt(a * a + 1) * 1.29 * v, 0), 4) AS power FROM (SELECT pm_id, psv95 AS v, (n_high_accel - n_high_decel) / 9.81 AS a FROM {PM} WHERE psv95 IS NOT NULL AND n_high_accel IS NOT NULL AND n_high_decel IS NOT NULL)")
def _(s, d):
    p = R.minutes(s, d).dropna(subset=["psv95", "n_high_accel", "n_high_decel"])
    return p.select("pm_id", F.round(S.metabolic_power(F.col("psv95"), F.col("n_high_accel") - F.col("n_high_decel")), 4).alias("power"))


@q("f35_significance", f"SELECT panel_id, CASE WHEN p >= 0.95 THEN 'positive' WHEN p <= 0.05 THEN 'negative' WHEN p >= 0.85 THEN 'likely positive' WHEN p <= 0.15 THEN 'likely negative' ELSE 'unclear' END AS sign FROM (SELECT panel_id, 1 / (1 + exp(-8 * outcome)) AS p FROM {PANEL} WHERE outcome IS NOT NULL)")
def _(s, d):
    return R.panel(s, d).where("outcome IS NOT NULL").select("panel_id", S.significance(S.logistic(8 * F.col("outcome")), 0.95, 0.85).alias("sign"))


@q("f38_score_after", f"SELECT a.goal_id, count(*) FILTER (b.scoring_team_id = a.scoring_team_id) AS own, count(*) FILTER (b.scoring_team_id <> a.scoring_team_id) AS other FROM {GOALS} a JOIN {GOALS} b ON b.match_id = a.match_id AND b.start_game_clock <= a.start_game_clock GROUP BY 1")
def _(s, d):
    # both sides' running counts in one window; goals at the same clock count for each other
    g = R.goals(s, d).select("goal_id", "match_id", "start_game_clock", "scoring_team_id").dropna(subset=["match_id", "start_game_clock"])
    upto = lambda *by: F.count("scoring_team_id").over(Window.partitionBy(*by).orderBy("start_game_clock").rangeBetween(Window.unboundedPreceding, 0))
    own = F.when(F.col("scoring_team_id").isNull(), F.lit(0)).otherwise(upto("match_id", "scoring_team_id"))
    return g.select("goal_id", own.cast("long").alias("own"), F.when(F.col("scoring_team_id").isNull(), F.lit(0)).otherwise(upto("match_id") - own).cast("long").alias("other"))


@q("f40_json_equality", "SELECT event_id, true AS same FROM (SELECT DISTINCT event_id FROM events WHERE props IS NOT NULL AND json_valid(props))")
def _(s, d):
    # keys in one order and values as text: two spellings of one object are equal
    normal = lambda c: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.from_json(c, "map<string,string>")))))
    other = F.regexp_replace("props", r":\s*", " : ")
    return table(s, d, "events").where("props IS NOT NULL").select("event_id", (normal("props") == normal(other)).alias("same")).distinct()
