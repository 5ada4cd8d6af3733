"""Queries on nested records (p1) and implausible readings (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchloom.operators.nested import RecordSpec, flatten_json, flatten_lists
from pitchloom.operators.spikes import Limits, flag_implausible
from pitchloom.session import table

FEED = [
    RecordSpec("game_event", ("gameEvents", "game_events"), ("gameEventId", "game_event_id")),
    RecordSpec("possession_event", ("possessionEvents", "possession_events"), ("possessionEventId", "possession_event_id"), parent="game_event"),
]
PLAYERS = {"home_player": "homePlayers", "away_player": "awayPlayers"}

#: Stuck readings may differ by two units of the last digit that the provider delivers (m/s, metres a minute, metres).
STEPS = 2.1
MINUTES = {
    "psv95": Limits(lower=0.0, upper=12.5, stuck_len=5, stuck_tol=STEPS * 0.001),
    # metres in a minute: a whole minute at 12 m/s
    "distance_m": Limits(lower=0.0, upper=720.0, stuck_len=5, stuck_tol=STEPS * 0.01),
}
#: metres from the centre spot, five frames a second: two seconds without a centimetre of sway don't happen.
POSITION = Limits(lower=-57.5, upper=57.5, stuck_len=10, stuck_tol=STEPS * 0.01, detail_k=8.0, min_jump=4.0, reach=5, moving=True, max_gap=2_000.0)
FULL_MINUTE = 1500


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = flatten_json(table(spark, sf_dir, "raw_feed"), "feed_id", "payload", FEED)
    frames = flatten_lists(table(spark, sf_dir, "tracking"), "frame_id", PLAYERS, "jerseyNum")
    links = ["record_kind", "parent_id", "child_id"]
    return feed.select(*links).union(frames.select(*links)).distinct()


def p1_game_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parent table with its typed fields, read from each record's own span."""
    rows = flatten_json(table(spark, sf_dir, "raw_feed"), "feed_id", "payload", FEED[:1], with_record=True)
    field = lambda *names: F.coalesce(*[F.get_json_object("record", f"$.{n}") for n in names])
    return rows.select(
        F.col("row_id").alias("feed_id"),
        F.col("child_id").alias("game_event_id"),
        F.col("ordinal").cast("long").alias("ordinal"),
        field("period").try_cast("long").alias("period"),
        field("startGameClock", "start_game_clock").try_cast("long").alias("start_game_clock"),
        field("gameEventType", "game_event_type").alias("game_event_type"),
    ).distinct()


def p1_frame_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per player and frame, the frame's period carried along."""
    rows = flatten_lists(table(spark, sf_dir, "tracking"), "frame_id", PLAYERS, "jerseyNum", carry=("period",), values=("x", "y"))
    return rows.select("record_kind", F.col("parent_id").alias("frame_id"), F.col("child_id").alias("shirt"), F.col("period").cast("long").alias("period"), "x", "y").distinct()


def _minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both fields in one pass, as rows (field_name, value)."""
    rows = table(spark, sf_dir, "raw_per_minute").withColumn("partly", F.col("n_frames") < FULL_MINUTE)
    long = rows.unpivot(["pm_id", "pff_player_id", "pff_match_id", "period", "minute_in_period", "partly"], list(MINUTES), "field_name", "value")
    return flag_implausible(long, ["field_name", "pff_player_id"], ["pff_match_id", "period"], "minute_in_period", ["pm_id"], ["value"], MINUTES, low_exempt="partly", kind="field_name")


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "tracking").select("frame_id", "gameRefId", "videoTimeMs", "homePlayers")
    rows = flatten_lists(frames, "frame_id", {"home_player": "homePlayers"}, "jerseyNum", carry=("gameRefId", "videoTimeMs"), values=("x", "y"))
    rows = rows.withColumnsRenamed({"parent_id": "frame_id", "child_id": "shirt"})
    # ten-minute blocks with four seconds of neighbours: more than a stuck stretch or a local median looks at
    return flag_implausible(rows, ["gameRefId", "shirt"], [], "videoTimeMs", ["frame_id"], ["x", "y"], POSITION, block_span=600_000.0, halo=4_000.0)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = F.col("is_spike") | F.col("is_stuck") | F.col("is_impossible")
    minutes = _minutes(spark, sf_dir).where(case).select("field_name", F.col("pm_id").alias("record_id"), F.lit(0).cast("long").alias("item_no"))
    places = _positions(spark, sf_dir).where(case).select(F.lit("homePlayers").alias("field_name"), F.col("frame_id").alias("record_id"), F.col("shirt").alias("item_no"))
    return minutes.union(places).distinct()


QUERIES = {"p1_found": p1_found, "p1_game_events": p1_game_events, "p1_frame_players": p1_frame_players, "p4_found": p4_found}

_FEED_SQL = """
WITH ok AS (SELECT DISTINCT feed_id, payload::JSON AS j FROM raw_feed WHERE payload IS NOT NULL AND json_valid(payload)),
t1 AS (SELECT feed_id, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j->>'$') THEN (j->>'$')::JSON END ELSE j END AS j FROM ok),
t2 AS (SELECT feed_id, unnest(CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') ELSE [j] END) AS j FROM t1),
t3 AS (SELECT feed_id, coalesce(CASE WHEN json_type(json_extract(j, '$.data')) = 'OBJECT' THEN json_extract(j, '$.data') END, j) AS j FROM t2),
t4 AS (SELECT feed_id, coalesce(json_extract(j, '$.gameEvents'), json_extract(j, '$.game_events')) AS g FROM t3),
ge0 AS (SELECT feed_id, unnest(CASE WHEN json_type(g) = 'ARRAY' THEN json_extract(g, '$[*]') ELSE [g] END) AS e FROM t4 WHERE json_type(g) IN ('ARRAY', 'OBJECT')),
ge AS (SELECT feed_id, e, CAST(TRY_CAST(json_extract_string(e, '$.gameEventId') AS DOUBLE) AS BIGINT) AS geid FROM ge0 WHERE json_type(e) = 'OBJECT'),
pe0 AS (SELECT geid, coalesce(json_extract(e, '$.possessionEvents'), json_extract(e, '$.possession_events')) AS p FROM ge WHERE geid IS NOT NULL),
pe1 AS (SELECT geid, unnest(CASE WHEN json_type(p) = 'ARRAY' THEN json_extract(p, '$[*]') ELSE [p] END) AS e FROM pe0 WHERE json_type(p) IN ('ARRAY', 'OBJECT')),
pe AS (SELECT geid, CAST(TRY_CAST(json_extract_string(e, '$.possessionEventId') AS DOUBLE) AS BIGINT) AS peid FROM pe1 WHERE json_type(e) = 'OBJECT')
"""
_SHIRT = "TRY_CAST(TRY_CAST(trim(p.jerseyNum) AS DOUBLE) AS BIGINT)"
ORACLE = {
    "p1_found": _FEED_SQL
    + f"""SELECT 'game_event' AS record_kind, feed_id AS parent_id, geid AS child_id FROM ge WHERE geid IS NOT NULL
UNION SELECT 'possession_event', geid, peid FROM pe WHERE peid IS NOT NULL
UNION SELECT 'home_player', frame_id, {_SHIRT} FROM (SELECT frame_id, unnest(homePlayers) AS p FROM tracking) WHERE {_SHIRT} IS NOT NULL
UNION SELECT 'away_player', frame_id, {_SHIRT} FROM (SELECT frame_id, unnest(awayPlayers) AS p FROM tracking) WHERE {_SHIRT} IS NOT NULL""",
    "p1_frame_players": f"""SELECT DISTINCT record_kind, frame_id, {_SHIRT} AS shirt, CAST(period AS BIGINT) AS period, p.x AS x, p.y AS y FROM (
SELECT 'home_player' AS record_kind, frame_id, period, unnest(homePlayers) AS p FROM tracking
UNION ALL SELECT 'away_player', frame_id, period, unnest(awayPlayers) FROM tracking) WHERE {_SHIRT} IS NOT NULL""",
    "p1_game_events": _FEED_SQL
    + """SELECT DISTINCT feed_id, geid AS game_event_id, o.ordinal AS ordinal,
TRY_CAST(json_extract_string(o.e, '$.period') AS BIGINT) AS period,
TRY_CAST(coalesce(json_extract_string(o.e, '$.startGameClock'), json_extract_string(o.e, '$.start_game_clock')) AS BIGINT) AS start_game_clock,
coalesce(json_extract_string(o.e, '$.gameEventType'), json_extract_string(o.e, '$.game_event_type')) AS game_event_type
FROM (SELECT feed_id, e, CAST(TRY_CAST(json_extract_string(e, '$.gameEventId') AS DOUBLE) AS BIGINT) AS geid, row_number() OVER (PARTITION BY feed_id, g ORDER BY i) - 1 AS ordinal
 FROM (SELECT feed_id, g, unnest(CASE WHEN json_type(g) = 'ARRAY' THEN json_extract(g, '$[*]') ELSE [g] END) AS e, generate_subscripts(CASE WHEN json_type(g) = 'ARRAY' THEN json_extract(g, '$[*]') ELSE [g] END, 1) AS i FROM t4 WHERE json_type(g) IN ('ARRAY', 'OBJECT'))
 WHERE json_type(e) = 'OBJECT') o WHERE geid IS NOT NULL""",
}
