"""Event-anchored tables: shocks with their players, windows around them, near misses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchloom.operators.asof import interval_join


def mode_of(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value): the most frequent non-null value per key, the smallest of equally frequent ones."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), value)).alias(value))


def period_bounds(events: DataFrame) -> DataFrame:
    return events.dropna(subset=["match_id", "period", "start_game_clock"]).groupBy("match_id", "period").agg(F.min("start_game_clock").alias("lo"), F.max("start_game_clock").alias("hi"))


def playing_intervals(events: DataFrame) -> DataFrame:
    """(match_id, player_id, team_id, minute_in, minute_out) by what a player is seen doing."""
    seen = events.dropna(subset=["match_id", "player_id", "minute"])
    spans = seen.groupBy("match_id", "player_id").agg(F.min("minute").alias("minute_in"), F.max("minute").alias("minute_out"))
    return spans.join(mode_of(seen, ["match_id", "player_id"], "team_id"), ["match_id", "player_id"])


def overlapping(goals: DataFrame, width: int) -> DataFrame:
    """Adds has_overlap: another goal of the match at another time within ``width`` seconds."""
    times = goals.select("match_id", "t").distinct()
    w = Window.partitionBy("match_id").orderBy("t")
    near = times.withColumn("has_overlap", F.coalesce(F.col("t") - F.lag("t").over(w) <= width, F.lit(False)) | F.coalesce(F.lead("t").over(w) - F.col("t") <= width, F.lit(False)))
    return goals.join(near, ["match_id", "t"])


def shock_table(goals: DataFrame, events: DataFrame, width: int = 600) -> DataFrame:
    """One row per goal and player on the field, with the windows clipped to the period.

    ``goals``: goal_id, match_id, period, t (seconds), minute, scoring_team_id. A player
    counts as entered (left) in a window by the whole minutes it touches. Goals with a null
    match, period, clock or minute have no rows; players without a team are against.
    """
    g = overlapping(goals.dropna(subset=["goal_id", "match_id", "period", "t", "minute"]), width).join(period_bounds(events), ["match_id", "period"])
    rows = interval_join(g, playing_intervals(events), ["match_id"], "minute", "minute_in", "minute_out")
    t, minute = F.col("t"), lambda x: F.floor(x / 60)
    side = F.when(F.col("team_id") == F.col("scoring_team_id"), "GOAL_FOR").otherwise("GOAL_AGAINST")
    out = rows.select(
        F.col("goal_id").alias("shock_id"), "match_id", F.col("period").cast("long").alias("period"), "player_id", side.alias("perspective"), F.greatest(t - width, F.col("lo")).alias("pre_start"), F.least(t + width, F.col("hi")).alias("post_end"),
        (t - width < F.col("lo")).alias("pre_cut"), (t + width > F.col("hi")).alias("post_cut"), "has_overlap",
        ((F.col("minute_in") > 0) & F.col("minute_in").between(minute(t - width), minute(t))).alias("entered"), F.col("minute_out").between(minute(t), minute(t + width)).alias("left_field"),
    )
    return out.withColumn("n_mates", F.count(F.lit(1)).over(Window.partitionBy("shock_id", "perspective")) - 1)  # players of one side


def chance(x: Column, y: Column) -> Column:
    """A shot's chance by its distance from the nearer goal; a fixed curve, to be replaced by a fitted one."""
    return 1 / (1 + F.exp(-(1.2 - 0.09 * F.hypot(52.5 - F.abs(x), y))))


def near_misses(shots: DataFrame) -> DataFrame:
    """(event_id, kind): ``shots`` has event_id, outcome, xg; woodwork and wide within a band of chances,
    saves of good chances and lax saves of fair ones. One row per shot and kind."""
    xg, outcome = F.col("xg"), F.col("outcome")
    kinds = F.array_compact(F.array(F.when((outcome == "W") & xg.between(0.15, 0.85), "woodwork"), F.when((outcome == "S") & (xg >= 0.6), "save"), F.when((outcome == "S") & (xg >= 0.4), "lax_save"), F.when((outcome == "B") & (xg >= 0.5), "cleared")))
    return shots.select("event_id", F.explode(kinds).alias("kind")).distinct()
