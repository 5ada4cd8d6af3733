"""Projections, joins, aggregations, sorts and set operations over the match tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchloom.operators.asof import asof_backward, interval_join
from pitchloom.operators.reshape import pivot_values, union_relaxed
from pitchloom.session import maybe_broadcast, table

QUERIES: dict = {}
ORACLE: dict = {}

#: rows delivered again count once; the load time is all that may differ
EV = "(SELECT DISTINCT * EXCLUDE (received_at) FROM events_enriched)"
GOALS = "(SELECT DISTINCT * EXCLUDE (loaded_at) FROM goals_timeline)"
PM = "(SELECT DISTINCT * EXCLUDE (loaded_at) FROM raw_per_minute)"
PCJ = "(SELECT DISTINCT * EXCLUDE (loaded_at) FROM pcj_table)"
PANEL = "(SELECT DISTINCT * FROM panel_master)"
PLAYERS = "(SELECT DISTINCT * FROM players)"


def q(name: str, sql: str | None = None):
    """Registers a query, with its oracle if SQL can say it."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def events(s: SparkSession, d: str, *cols: str) -> DataFrame:
    rows = table(s, d, "events_enriched")
    return (rows.select("event_id", *cols) if cols else rows.drop("received_at")).dropDuplicates(["event_id"])


def goals(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "goals_timeline").drop("loaded_at").dropDuplicates(["goal_id"])


def minutes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "raw_per_minute").drop("loaded_at").dropDuplicates(["pm_id"])


def pcj(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pcj_table").drop("loaded_at").dropDuplicates(["edition_id", "pff_player_id"])


def panel(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "panel_master").dropDuplicates(["panel_id"])


def players(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "players").dropDuplicates(["id"])


# --- projections and predicates ---
@q("sel01_flatten_events", f"SELECT event_id, gameEvents.period AS period, gameEvents.startGameClock AS clock, floor(gameEvents.startGameClock / 60)::BIGINT AS minute, gameEvents.gameEventType AS kind, possessionEvents.possessionEventType AS pos_kind FROM {EV}")
def _(s, d):
    e = events(s, d, "gameEvents", "possessionEvents")
    return e.select("event_id", F.col("gameEvents.period").cast("long").alias("period"), F.col("gameEvents.startGameClock").alias("clock"), F.floor(F.col("gameEvents.startGameClock") / 60).alias("minute"), F.col("gameEvents.gameEventType").alias("kind"), F.col("possessionEvents.possessionEventType").alias("pos_kind"))


@q("sel02_first_ball", f"SELECT event_id, ball[1].x AS x, ball[1].y AS y FROM {EV}")
def _(s, d):
    ball = F.get("ball", F.lit(0))
    return events(s, d, "ball").select("event_id", ball["x"].alias("x"), ball["y"].alias("y"))


@q("sel03_goals_view", f"SELECT event_id, match_id, start_game_clock, coalesce(possessionEvents.nonEvent, false) OR coalesce(gameEvents.initialNonEvent, false) AS disallowed, coalesce(period = 4 AND start_game_clock > 7200, false) AS shootout FROM {EV} WHERE possessionEvents.shotOutcomeType = 'G'")
def _(s, d):
    # repeats carry the same content, so the filter may come before they are dropped
    rows = table(s, d, "events_enriched").where(F.col("possessionEvents.shotOutcomeType") == "G")
    e = rows.select("event_id", "match_id", "period", "start_game_clock", "gameEvents", "possessionEvents").dropDuplicates(["event_id"])
    no = F.coalesce("possessionEvents.nonEvent", F.lit(False)) | F.coalesce("gameEvents.initialNonEvent", F.lit(False))
    return e.select("event_id", "match_id", "start_game_clock", no.alias("disallowed"), F.coalesce((F.col("period") == 4) & (F.col("start_game_clock") > 7200), F.lit(False)).alias("shootout"))


@q("sel04_shots_view", f"SELECT event_id, match_id, period, start_game_clock, player_id, possessionEvents.shotOutcomeType AS outcome FROM {EV} WHERE possession_event_type = 'SH'")
def _(s, d):
    rows = table(s, d, "events_enriched").where(F.col("possession_event_type") == "SH")
    return rows.select("event_id", "match_id", "period", "start_game_clock", "player_id", F.col("possessionEvents.shotOutcomeType").alias("outcome")).distinct()


@q("sel05_sub_view", f"SELECT event_id, match_id, minute, team_id FROM {EV} WHERE game_event_type = 'SUB'")
def _(s, d):
    return table(s, d, "events_enriched").where(F.col("game_event_type") == "SUB").select("event_id", "match_id", "minute", "team_id").distinct()


@q("sel06_ids_as_numbers", "SELECT DISTINCT id, TRY_CAST(substr(dob, 1, 4) AS BIGINT) AS born FROM players")
def _(s, d):
    return players(s, d).select("id", F.substring("dob", 1, 4).try_cast("long").alias("born"))


@q("sel09_membership", f"SELECT event_id FROM {EV} WHERE possession_event_type IN ('SH', 'CR', 'PA') AND minute BETWEEN 80 AND 90")
def _(s, d):
    return table(s, d, "events_enriched").where(F.col("possession_event_type").isin("SH", "CR", "PA") & F.col("minute").between(80, 90)).select("event_id").distinct()


# --- fixed values: position groups and their buckets ---
BUCKETS = {"GK": "GK", "LCB": "DEF", "RCB": "DEF", "MCB": "DEF", "LB": "DEF", "RB": "DEF", "LWB": "DEF", "RWB": "DEF", "DM": "MED", "CM": "MED", "AM": "MED", "LM": "MED", "RM": "MED", "LW": "ATT", "RW": "ATT", "CF": "ATT"}
# --- end of fixed values ---
_BUCKET_SQL = "CASE " + " ".join(f"WHEN position_group = '{a}' THEN '{b}'" for a, b in BUCKETS.items()) + " ELSE 'OTHER' END"


@q("sel13_dict_replace", f"SELECT edition_id, pff_player_id, {_BUCKET_SQL} AS bucket FROM {PCJ}")
def _(s, d):
    lookup = F.create_map(*[F.lit(x) for kv in BUCKETS.items() for x in kv])
    return pcj(s, d).select("edition_id", "pff_player_id", F.coalesce(lookup[F.col("position_group")], F.lit("OTHER")).alias("bucket"))


@q("sel14_horizontal_mean", f"SELECT pm_id, round(list_avg([z1_m, z2_m, z3_m, z4_m, z5_m]), 6) AS zone_mean FROM {PM}")
def _(s, d):
    zones = F.filter(F.array("z1_m", "z2_m", "z3_m", "z4_m", "z5_m"), lambda z: z.isNotNull())
    mean = F.try_divide(F.aggregate(zones, F.lit(0.0), lambda a, z: a + z), F.size(zones))
    return minutes(s, d).select("pm_id", F.round(mean, 6).alias("zone_mean"))


@q("sel15_row_index", "SELECT match_id, minute_bin, row_number() OVER (PARTITION BY match_id ORDER BY minute_bin) - 1 AS row_no FROM (SELECT DISTINCT match_id, minute_bin FROM training_matrix)")
def _(s, d):
    rows = table(s, d, "training_matrix").select("match_id", "minute_bin").distinct()
    return rows.select("match_id", "minute_bin", (F.row_number().over(Window.partitionBy("match_id").orderBy("minute_bin")) - 1).cast("long").alias("row_no"))


@q("sel16_prefix_columns", f"SELECT pm_id, z1_m, z2_m, z3_m, z4_m, z5_m FROM {PM}")
def _(s, d):
    rows = table(s, d, "raw_per_minute")
    zones = sorted(c for c in rows.columns if c.startswith("z") and c.endswith("_m"))
    return rows.select("pm_id", *zones).distinct()


@q("sel17_drop_nulls", f"SELECT panel_id, outcome FROM {PANEL} WHERE outcome IS NOT NULL AND outcome_player_abs IS NOT NULL AND leverage IS NOT NULL")
def _(s, d):
    return panel(s, d).dropna(subset=["outcome", "outcome_player_abs", "leverage"]).select("panel_id", "outcome")


@q("sel19_player_search", f"SELECT id, lastName FROM {PLAYERS} WHERE regexp_matches(lower(coalesce(nickname, '') || ' ' || lastName), '(van|von) ')")
def _(s, d):
    return players(s, d).where(F.lower(F.concat(F.coalesce("nickname", F.lit("")), F.lit(" "), "lastName")).rlike("(van|von) ")).select("id", "lastName")


@q("sel22_first_rows", f"SELECT id, lastName FROM {PLAYERS} ORDER BY id LIMIT 10")
def _(s, d):
    return players(s, d).select("id", "lastName").orderBy("id").limit(10)


# --- scans ---
@q("s15_relaxed_union", "SELECT s_suppkey AS k, s_name AS name, s_nationkey::BIGINT AS nation, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def _(s, d):
    a = table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    b = table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return union_relaxed([b, a])


@q("s17_partitions", "SELECT match_id, count(DISTINCT event_id) AS n FROM events_enriched WHERE match_id IS NOT NULL GROUP BY 1")
def _(s, d):
    return events(s, d, "match_id").where("match_id IS NOT NULL").groupBy("match_id").agg(F.count(F.lit(1)).alias("n"))


@q("s18_inventory", "SELECT m.match_id, m.match_id IN (SELECT DISTINCT gameRefId::BIGINT FROM tracking WHERE gameRefId IS NOT NULL) AS has_tracking FROM (SELECT DISTINCT match_id FROM goals_timeline WHERE match_id IS NOT NULL) m")
def _(s, d):
    have = table(s, d, "tracking").select(F.col("gameRefId").cast("long").alias("g")).distinct()
    ids = table(s, d, "goals_timeline").select("match_id").where("match_id IS NOT NULL").distinct()
    return ids.join(have, ids.match_id == have.g, "left").select("match_id", F.col("g").isNotNull().alias("has_tracking"))


# --- joins ---
@q("j01_score_state", f"""WITH g AS (SELECT match_id, start_game_clock AS t, max(cum_home * 1000 + cum_away) AS c FROM {GOALS} WHERE match_id IS NOT NULL AND start_game_clock IS NOT NULL AND cum_home IS NOT NULL AND cum_away IS NOT NULL GROUP BY 1, 2)
SELECT e.event_id, coalesce(floor(g.c / 1000), 0)::BIGINT AS home, coalesce(g.c % 1000, 0)::BIGINT AS away FROM (SELECT * FROM {EV} WHERE match_id IS NOT NULL AND start_game_clock IS NOT NULL) e ASOF LEFT JOIN g ON e.match_id = g.match_id AND e.start_game_clock >= g.t""")
def _(s, d):
    e = events(s, d, "match_id", "start_game_clock").dropna()
    g = goals(s, d).dropna(subset=["cum_home", "cum_away"]).select("match_id", "start_game_clock", F.col("cum_home").alias("home"), F.col("cum_away").alias("away"))
    return asof_backward(e, g, ["match_id"], "start_game_clock", ["home", "away"], 0).select("event_id", "home", "away")


@q("j06_name_crosswalk", f"SELECT e.team_id, m.n FROM (SELECT DISTINCT team_id, gameEvents.teamName AS nm FROM events_enriched WHERE team_id IS NOT NULL) e JOIN (SELECT team_name, count(*) AS n FROM {PLAYERS} GROUP BY 1) m ON m.team_name = e.nm")
def _(s, d):
    e = table(s, d, "events_enriched").select("team_id", F.col("gameEvents.teamName").alias("team_name")).where("team_id IS NOT NULL").distinct()
    m = players(s, d).groupBy("team_name").agg(F.count(F.lit(1)).alias("n"))
    return e.join(maybe_broadcast(m), "team_name").select("team_id", "n")


@q("j07_star_join", "SELECT n_name, r_name, count(*) AS n, round(sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE, 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def _(s, d):
    li, o = table(s, d, "lineitem").select("l_orderkey", "l_extendedprice"), table(s, d, "orders").select("o_orderkey", "o_custkey")
    c = table(s, d, "customer").select("c_custkey", "c_nationkey")
    n = table(s, d, "nation").join(F.broadcast(table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(maybe_broadcast(c), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double"), 2).alias("revenue"))


@q("j10_on_field", f"""WITH p AS (SELECT pff_match_id AS match_id, pff_player_id AS player_id, min((period - 1) * 45 + minute_in_period) AS minute_in, max((period - 1) * 45 + minute_in_period) AS minute_out FROM {PM} GROUP BY 1, 2)
SELECT g.goal_id, p.player_id FROM {GOALS} g JOIN p ON p.match_id = g.match_id AND g.minute BETWEEN p.minute_in AND p.minute_out""")
def _(s, d):
    at = (F.col("period") - 1) * 45 + F.col("minute_in_period")
    p = minutes(s, d).groupBy(F.col("pff_match_id").alias("match_id"), F.col("pff_player_id").alias("player_id")).agg(F.min(at).alias("minute_in"), F.max(at).alias("minute_out"))
    return interval_join(goals(s, d).select("goal_id", "match_id", "minute"), p, ["match_id"], "minute", "minute_in", "minute_out").select("goal_id", "player_id")


@q("j11_overlapping_goals", f"SELECT DISTINCT a.goal_id FROM {GOALS} a JOIN {GOALS} b ON a.match_id = b.match_id AND a.start_game_clock <> b.start_game_clock AND abs(a.start_game_clock - b.start_game_clock) <= 600")
def _(s, d):
    g = goals(s, d).select("goal_id", "match_id", "start_game_clock").dropna()
    times = g.select("match_id", "start_game_clock").distinct()
    w = Window.partitionBy("match_id").orderBy("start_game_clock")
    t = F.col("start_game_clock")
    near = times.withColumn("near", F.coalesce(t - F.lag(t).over(w) <= 600, F.lit(False)) | F.coalesce(F.lead(t).over(w) - t <= 600, F.lit(False))).where("near")
    return g.join(near, ["match_id", "start_game_clock"], "left_semi").select("goal_id")


@q("j12_minute_spine", f"SELECT g.goal_id, b.rel FROM {GOALS} g, (SELECT unnest(range(-10, 11)) AS rel) b")
def _(s, d):
    return goals(s, d).select("goal_id", F.explode(F.sequence(F.lit(-10).cast("long"), F.lit(10).cast("long"))).alias("rel"))


@q("j13_full_outer", f"SELECT coalesce(a.match_id, b.match_id) AS match_id, a.n_goals, b.n_shots FROM (SELECT match_id, count(*) AS n_goals FROM {GOALS} WHERE match_id IS NOT NULL GROUP BY 1) a FULL JOIN (SELECT match_id, count(*) AS n_shots FROM {EV} WHERE possession_event_type = 'SH' AND match_id IS NOT NULL GROUP BY 1) b ON a.match_id = b.match_id")
def _(s, d):
    a = goals(s, d).where("match_id IS NOT NULL").groupBy("match_id").agg(F.count(F.lit(1)).alias("n_goals"))
    shots = table(s, d, "events_enriched").where("possession_event_type = 'SH' AND match_id IS NOT NULL").select("event_id", "match_id").distinct()
    b = shots.groupBy("match_id").agg(F.count(F.lit(1)).alias("n_shots"))
    return a.join(b, "match_id", "full")


@q("j14_semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def _(s, d):
    o = table(s, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey")
    return table(s, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@q("j14_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(s, d):
    return table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@q("j15_nearest_in_array", """WITH b AS (SELECT frame_id, balls[1].x AS bx, balls[1].y AS by_, homePlayers FROM (SELECT DISTINCT frame_id, balls, homePlayers FROM tracking)),
e AS (SELECT frame_id, bx, by_, unnest(homePlayers) AS p FROM b WHERE bx IS NOT NULL AND by_ IS NOT NULL)
SELECT frame_id, round(min(sqrt((p.x - bx) * (p.x - bx) + (p.y - by_) * (p.y - by_))), 6) AS nearest_m FROM e WHERE p.x IS NOT NULL AND p.y IS NOT NULL GROUP BY frame_id""")
def _(s, d):
    ball = F.get("balls", F.lit(0))
    rows = table(s, d, "tracking").dropDuplicates(["frame_id"]).select("frame_id", ball["x"].alias("bx"), ball["y"].alias("by"), "homePlayers").dropna(subset=["bx", "by"])
    near = F.array_min(F.transform("homePlayers", lambda p: F.sqrt((p["x"] - F.col("bx")) * (p["x"] - F.col("bx")) + (p["y"] - F.col("by")) * (p["y"] - F.col("by")))))
    return rows.select("frame_id", F.round(near, 6).alias("nearest_m")).where("nearest_m IS NOT NULL")


@q("j21_lookup_default", f"SELECT g.goal_id, coalesce(t.n, 0) AS n FROM {GOALS} g LEFT JOIN (SELECT match_id, minute, count(*) AS n FROM {EV} GROUP BY 1, 2) t ON t.match_id = g.match_id AND t.minute = g.minute")
def _(s, d):
    n = events(s, d, "match_id", "minute").groupBy("match_id", "minute").agg(F.count(F.lit(1)).alias("n"))
    return goals(s, d).select("goal_id", "match_id", "minute").join(n, ["match_id", "minute"], "left").select("goal_id", F.coalesce("n", F.lit(0)).alias("n"))


@q("j22_key_difference", "SELECT DISTINCT pff_player_id FROM raw_per_minute WHERE pff_player_id NOT IN (SELECT id FROM players)")
def _(s, d):
    return table(s, d, "raw_per_minute").select("pff_player_id").distinct().join(table(s, d, "players").select(F.col("id").alias("pff_player_id")), "pff_player_id", "left_anti")


# --- aggregations ---
@q("a01_group_count", f"SELECT possession_event_type AS kind, count(*) AS n FROM {EV} GROUP BY 1")
def _(s, d):
    return events(s, d, "possession_event_type").groupBy(F.col("possession_event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"))


@q("a02_period_bounds", f"SELECT match_id, period, min(start_game_clock) AS lo, max(start_game_clock) AS hi FROM {EV} GROUP BY 1, 2")
def _(s, d):
    return events(s, d, "match_id", "period", "start_game_clock").groupBy("match_id", "period").agg(F.min("start_game_clock").alias("lo"), F.max("start_game_clock").alias("hi"))


@q("a03_match_end", f"SELECT match_id, floor(max(start_game_clock) / 60)::BIGINT + 1 AS end_minute FROM {EV} GROUP BY 1")
def _(s, d):
    return events(s, d, "match_id", "start_game_clock").groupBy("match_id").agg((F.floor(F.max("start_game_clock") / 60) + 1).alias("end_minute"))


@q("a04_player_minute", f"SELECT match_id, period, player_id, minute, count(*) AS n, min(start_game_clock) AS first_clock FROM {EV} GROUP BY 1, 2, 3, 4")
def _(s, d):
    return events(s, d, "match_id", "period", "player_id", "minute", "start_game_clock").groupBy("match_id", "period", "player_id", "minute").agg(F.count(F.lit(1)).alias("n"), F.min("start_game_clock").alias("first_clock"))


@q("a05_conditional_sum", f"SELECT team_id, count(*) FILTER (possession_event_type = 'SH') AS shots, count(*) FILTER (gameEvents.homeTeam) AS home_events FROM {EV} GROUP BY 1")
def _(s, d):
    return events(s, d, "team_id", "possession_event_type", "gameEvents").groupBy("team_id").agg(F.count_if(F.col("possession_event_type") == "SH").alias("shots"), F.count_if(F.col("gameEvents.homeTeam")).alias("home_events"))


@q("a06_visible_share", """SELECT period, count(*) FILTER (p.visibility = 'VISIBLE') AS seen, round(count(*) FILTER (p.visibility = 'VISIBLE') / count(*), 6) AS share FROM (SELECT period, unnest(homePlayers) AS p FROM (SELECT DISTINCT * FROM tracking)) WHERE p IS NOT NULL GROUP BY 1""")
def _(s, d):
    rows = table(s, d, "tracking").dropDuplicates(["frame_id"]).select(F.col("period").cast("long").alias("period"), F.explode("homePlayers").alias("p")).where("p IS NOT NULL")
    seen = F.count_if(F.col("p.visibility") == "VISIBLE")
    return rows.groupBy("period").agg(seen.alias("seen"), F.round(seen / F.count(F.lit(1)), 6).alias("share"))


@q("a07_weighted_sum", f"SELECT player_id, sum(CASE possession_event_type WHEN 'SH' THEN 2.0 WHEN 'CR' THEN 1.0 WHEN 'PA' THEN 0.5 ELSE 0.0 END * CASE WHEN gameEvents.homeTeam THEN 1.5 ELSE 1.0 END)::DOUBLE AS v FROM {EV} GROUP BY 1")
def _(s, d):
    k = F.col("possession_event_type")
    v = F.when(k == "SH", 2.0).when(k == "CR", 1.0).when(k == "PA", 0.5).otherwise(0.0) * F.when(F.col("gameEvents.homeTeam"), 1.5).otherwise(1.0)
    return events(s, d, "player_id", "possession_event_type", "gameEvents").groupBy("player_id").agg(F.sum(v).alias("v"))


@q("a08_rollup", f"SELECT pff_player_id, round(avg(psv95), 6) AS mean_v, max(psv95) AS max_v, count(*) AS n FROM {PM} GROUP BY 1")
def _(s, d):
    return minutes(s, d).groupBy("pff_player_id").agg(F.round(F.avg("psv95"), 6).alias("mean_v"), F.max("psv95").alias("max_v"), F.count(F.lit(1)).alias("n"))


@q("a14_count_distinct", f"SELECT channel, count(DISTINCT shock_id) AS shocks, count(DISTINCT pff_player_id) AS people FROM {PANEL} GROUP BY 1")
def _(s, d):
    return panel(s, d).groupBy("channel").agg(F.count_distinct("shock_id").alias("shocks"), F.count_distinct("pff_player_id").alias("people"))


@q("a15_shock_summary", f"SELECT count(*) AS n_rows, count(DISTINCT shock_id) AS n_shocks, count(*) FILTER (stage = 'GROUP') AS n_group, count(*) FILTER (post = 1) AS n_post FROM {PANEL}")
def _(s, d):
    return panel(s, d).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("shock_id").alias("n_shocks"), F.count_if(F.col("stage") == "GROUP").alias("n_group"), F.count_if(F.col("post") == 1).alias("n_post"))


@q("a17_exposure", f"SELECT pff_player_id, round(sum(CAST(leverage AS DECIMAL(18,9)))::DOUBLE / count(leverage), 6) AS mean_lev, max(leverage) AS max_lev, count(*) FILTER (leverage >= 0.05) AS n_high FROM {PANEL} GROUP BY 1")
def _(s, d):
    # summed exactly, so that the order of the rows can't decide how a mean is rounded
    mean = F.try_divide(F.sum(F.col("leverage").cast("decimal(18,9)")).cast("double"), F.count("leverage"))
    return panel(s, d).groupBy("pff_player_id").agg(F.round(mean, 6).alias("mean_lev"), F.max("leverage").alias("max_lev"), F.count_if(F.col("leverage") >= 0.05).alias("n_high"))


@q("a18_minutes_played", f"SELECT pff_player_id, count(*) AS minutes, count(DISTINCT pff_match_id) AS matches FROM {PM} GROUP BY 1")
def _(s, d):
    return minutes(s, d).groupBy("pff_player_id").agg(F.count(F.lit(1)).alias("minutes"), F.count_distinct("pff_match_id").alias("matches"))


@q("a20_totals_per90", f"SELECT pff_player_id, round(coalesce(sum(distance_m), 0), 4) AS metres, round(coalesce(sum(distance_m), 0) / count(*) * 90, 4) AS per90, max(psv95) AS peak FROM {PM} GROUP BY 1")
def _(s, d):
    total = F.coalesce(F.sum("distance_m"), F.lit(0.0))
    return minutes(s, d).groupBy("pff_player_id").agg(F.round(total, 4).alias("metres"), F.round(total / F.count(F.lit(1)) * 90, 4).alias("per90"), F.max("psv95").alias("peak"))


@q("a23_pre_post_means", f"SELECT pff_player_id, shock_id, channel, round(avg(outcome) FILTER (post = 1) - avg(outcome) FILTER (post = 0), 6) AS diff FROM {PANEL} GROUP BY 1, 2, 3 HAVING diff IS NOT NULL")
def _(s, d):
    diff = F.avg(F.when(F.col("post") == 1, F.col("outcome"))) - F.avg(F.when(F.col("post") == 0, F.col("outcome")))
    return panel(s, d).groupBy("pff_player_id", "shock_id", "channel").agg(F.round(diff, 6).alias("diff")).where("diff IS NOT NULL")


@q("a24_mode", f"SELECT pff_player_id, position_group FROM (SELECT pff_player_id, position_group, row_number() OVER (PARTITION BY pff_player_id ORDER BY count(*) DESC, position_group) AS r FROM {PANEL} WHERE position_group IS NOT NULL GROUP BY 1, 2) WHERE r = 1")
def _(s, d):
    n = panel(s, d).where("position_group IS NOT NULL").groupBy("pff_player_id", "position_group").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("pff_player_id").agg(F.min_by("position_group", F.struct(-F.col("n"), "position_group")).alias("position_group"))


@q("a25_teams_of_match", f"SELECT match_id, array_to_string(list_sort(list(DISTINCT team_id)), ',') AS teams FROM {EV} WHERE team_id IS NOT NULL GROUP BY 1")
def _(s, d):
    return events(s, d, "match_id", "team_id").where("team_id IS NOT NULL").groupBy("match_id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_set("team_id")), lambda t: t.cast("string"))).alias("teams"))


@q("a26_team_rollup", f"SELECT edition_id, team_name, count(*) AS n, round(avg(age_years), 6) AS age, sum(minutes_played)::BIGINT AS minutes FROM {PCJ} GROUP BY 1, 2")
def _(s, d):
    return pcj(s, d).groupBy("edition_id", "team_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("age_years"), 6).alias("age"), F.sum("minutes_played").alias("minutes"))


@q("a27_dense_counts", f"""WITH m AS (SELECT DISTINCT match_id FROM {EV} WHERE match_id IS NOT NULL), g AS (SELECT match_id, b FROM m, (SELECT unnest(range(1, 91)) AS b)),
c AS (SELECT match_id, least(greatest(minute + 1, 1), 90) AS b, count(*) AS n FROM {EV} WHERE possession_event_type = 'SH' AND minute IS NOT NULL GROUP BY 1, 2)
SELECT g.match_id, g.b AS minute_bin, coalesce(c.n, 0) AS n FROM g LEFT JOIN c ON c.match_id = g.match_id AND c.b = g.b""")
def _(s, d):
    e = events(s, d, "match_id", "minute", "possession_event_type")
    grid = e.select("match_id").where("match_id IS NOT NULL").distinct().select("match_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(90).cast("long"))).alias("minute_bin"))
    c = e.where("possession_event_type = 'SH' AND minute IS NOT NULL").groupBy("match_id", F.greatest(F.least(F.col("minute") + 1, F.lit(90)), F.lit(1)).alias("minute_bin")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(c, ["match_id", "minute_bin"], "left").fillna(0, ["n"])


@q("a28_shot_grid", f"""WITH p AS (SELECT least(greatest(floor((ball[1].x + 52.5) / 10.5), 0), 9)::BIGINT AS ix, least(greatest(floor((ball[1].y + 34) / (68.0 / 7)), 0), 6)::BIGINT AS iy, CASE WHEN possessionEvents.shotOutcomeType = 'G' THEN 1.0 ELSE 0.0 END AS y FROM {EV} WHERE possession_event_type = 'SH' AND ball[1].x IS NOT NULL AND ball[1].y IS NOT NULL),
m AS (SELECT ix, iy, avg(y) AS v FROM p GROUP BY 1, 2)
SELECT a.ix, b.iy, round(coalesce(m.v, 0.03), 6) AS v FROM (SELECT unnest(range(0, 10)) AS ix) a, (SELECT unnest(range(0, 7)) AS iy) b LEFT JOIN m ON m.ix = a.ix AND m.iy = b.iy""")
def _(s, d):
    ball = F.get("ball", F.lit(0))
    e = events(s, d, "possession_event_type", "ball", "possessionEvents").where("possession_event_type = 'SH'").select(ball["x"].alias("x"), ball["y"].alias("y"), F.when(F.col("possessionEvents.shotOutcomeType") == "G", 1.0).otherwise(0.0).alias("g")).dropna(subset=["x", "y"])
    ix = F.greatest(F.least(F.floor((F.col("x") + 52.5) / 10.5), F.lit(9)), F.lit(0))
    iy = F.greatest(F.least(F.floor((F.col("y") + 34) / (68.0 / 7)), F.lit(6)), F.lit(0))
    m = e.groupBy(ix.alias("ix"), iy.alias("iy")).agg(F.avg("g").alias("v"))
    grid = s.range(10).select(F.col("id").alias("ix"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("iy"))
    return grid.join(m, ["ix", "iy"], "left").select("ix", "iy", F.round(F.coalesce("v", F.lit(0.03)), 6).alias("v"))


@q("a29_having", f"SELECT pff_player_id, pff_match_id, sum(n_frames)::BIGINT AS frames FROM {PM} GROUP BY 1, 2 HAVING sum(n_frames) >= 60000")
def _(s, d):
    return minutes(s, d).groupBy("pff_player_id", "pff_match_id").agg(F.sum("n_frames").alias("frames")).where("frames >= 60000")


@q("a31_pivot_means", f"SELECT stage, round(avg(outcome) FILTER (channel = 'ataque'), 6) AS ataque, round(avg(outcome) FILTER (channel = 'defensa'), 6) AS defensa, round(avg(outcome) FILTER (channel = 'fisico'), 6) AS fisico, round(avg(outcome) FILTER (channel = 'offball'), 6) AS offball FROM {PANEL} GROUP BY 1")
def _(s, d):
    return panel(s, d).groupBy("stage").pivot("channel", ["ataque", "defensa", "fisico", "offball"]).agg(F.round(F.avg("outcome"), 6))


# --- sorts, sets and shapes ---
@q("o01_multi_sort", f"SELECT id, lastName, team_name FROM {PLAYERS} ORDER BY team_name, lastName, id")
def _(s, d):
    return players(s, d).select("id", "lastName", "team_name").orderBy("team_name", "lastName", "id")


@q("o02_top_report", f"SELECT edition_id, pff_player_id, minutes_played FROM {PCJ} ORDER BY minutes_played DESC NULLS LAST, edition_id, pff_player_id LIMIT 20")
def _(s, d):
    return pcj(s, d).select("edition_id", "pff_player_id", "minutes_played").orderBy(F.desc_nulls_last("minutes_played"), "edition_id", "pff_player_id").limit(20)


@q("o06_argmin_clock", f"SELECT match_id, arg_min(event_id, (abs(start_game_clock - 2700), event_id)) AS event_id FROM {EV} WHERE start_game_clock IS NOT NULL GROUP BY 1")
def _(s, d):
    return events(s, d, "match_id", "start_game_clock").where("start_game_clock IS NOT NULL").groupBy("match_id").agg(F.min_by("event_id", F.struct(F.abs(F.col("start_game_clock") - 2700), "event_id")).alias("event_id"))


@q("o07_keep_first", f"SELECT match_id, minute, min(event_id) AS event_id FROM {EV} GROUP BY 1, 2")
def _(s, d):
    return events(s, d, "match_id", "minute").groupBy("match_id", "minute").agg(F.min("event_id").alias("event_id"))


@q("u01_union", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def _(s, d):
    return table(s, d, "nation").select(F.col("n_name").alias("name")).unionByName(table(s, d, "region").select(F.col("r_name").alias("name")))


@q("u04_distinct", "SELECT DISTINCT possession_event_type, game_event_type FROM events_enriched")
def _(s, d):
    return table(s, d, "events_enriched").select("possession_event_type", "game_event_type").distinct()


@q("u06_explode_structs", "SELECT frame_id, count(*) AS n, round(avg(p.x), 6) AS mean_x FROM (SELECT frame_id, unnest(awayPlayers) AS p FROM (SELECT DISTINCT * FROM tracking)) WHERE p IS NOT NULL GROUP BY 1")
def _(s, d):
    rows = table(s, d, "tracking").dropDuplicates(["frame_id"]).select("frame_id", F.explode("awayPlayers").alias("p")).where("p IS NOT NULL")
    return rows.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p.x"), 6).alias("mean_x"))


@q("u07_pivot_long", f"SELECT pff_player_id, max(v) FILTER (k = 'distance_m') AS distance_m, max(v) FILTER (k = 'psv95') AS psv95 FROM (SELECT pff_player_id, 'distance_m' AS k, max(distance_m) AS v FROM {PM} GROUP BY 1 UNION ALL SELECT pff_player_id, 'psv95', max(psv95) FROM {PM} GROUP BY 1) GROUP BY 1")
def _(s, d):
    top = minutes(s, d).groupBy("pff_player_id").agg(F.max("distance_m").alias("distance_m"), F.max("psv95").alias("psv95"))
    return pivot_values(top.unpivot(["pff_player_id"], ["distance_m", "psv95"], "k", "v"), ["pff_player_id"], "k", "v", ["distance_m", "psv95"])


@q("u08_pivot_two_keys", f"SELECT pff_player_id, count(*) FILTER (channel = 'offball' AND perspective = 'GOAL_FOR') AS offball_for, count(*) FILTER (channel = 'offball' AND perspective = 'GOAL_AGAINST') AS offball_against FROM {PANEL} GROUP BY 1")
def _(s, d):
    both = F.concat_ws("_", "channel", "perspective")
    rows = panel(s, d).withColumn("k", both).groupBy("pff_player_id").pivot("k", ["offball_GOAL_FOR", "offball_GOAL_AGAINST"]).agg(F.count(F.lit(1)))
    return rows.select("pff_player_id", F.coalesce("offball_GOAL_FOR", F.lit(0)).alias("offball_for"), F.coalesce("offball_GOAL_AGAINST", F.lit(0)).alias("offball_against"))


@q("u09_unpivot", f"SELECT pm_id, zone, metres FROM {PM} UNPIVOT INCLUDE NULLS (metres FOR zone IN (z1_m, z2_m, z3_m, z4_m, z5_m))".replace("SELECT pm_id, zone, metres FROM (SELECT DISTINCT * EXCLUDE (loaded_at)", "SELECT pm_id, zone, metres FROM (SELECT DISTINCT pm_id, z1_m, z2_m, z3_m, z4_m, z5_m"))
def _(s, d):
    zones = [f"z{k}_m" for k in range(1, 6)]
    return minutes(s, d).unpivot(["pm_id"], zones, "zone", "metres")


@q("u10_token_sets", f"SELECT id, array_to_string(list_sort(list_distinct(list_filter(string_split(lower(lastName), ' '), lambda x: x NOT IN ('de', 'da', 'dos', 'van', 'von', 'el', '')))), ', ') AS tokens FROM {PLAYERS}")
def _(s, d):
    tokens = F.array_sort(F.array_except(F.split(F.lower("lastName"), " "), F.array(*[F.lit(x) for x in ("de", "da", "dos", "van", "von", "el", "")])))
    return players(s, d).select("id", F.concat_ws(", ", tokens).alias("tokens"))
