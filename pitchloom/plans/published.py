"""The wide published table and the name cascade."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from pitchloom.functions.scalar import tier
from pitchloom.functions.text import name_norm
from pitchloom.operators.ranking import ordinal_rank, percentile_ordinal
from pitchloom.operators.reshape import contract_violations
from pitchloom.plans import relational as R
from pitchloom.plans.relational import PANEL, PCJ, PM
from pitchloom.session import cut, table

QUERIES: dict = {}
ORACLE: dict = {}
MIN_MINUTES = 270
CONTRACT = {"edition_id": "int", "pff_player_id": "int", "minutes_played": "int", "rank_minutes": "int", "tier": "text", "metres": "float", "peak": "float", "n_shocks": "int"}


def master_table(s, d):
    """Players of an edition with at least ``MIN_MINUTES`` minutes, their physical totals and
    shock exposure, ranks and tiers; the schema contract is checked before it is returned."""
    base = R.pcj(s, d).where(F.col("minutes_played") >= MIN_MINUTES).select("edition_id", "pff_player_id", "position_bucket", "minutes_played")
    base = base.withColumns({"rank_minutes": ordinal_rank("minutes_played", ["pff_player_id"], ["edition_id"]).cast("long"), "tier": tier(percentile_ordinal("minutes_played", ["pff_player_id"], ["edition_id"]))})
    physical = R.minutes(s, d).groupBy("pff_player_id").agg(F.round(F.sum("distance_m"), 4).alias("metres"), F.max("psv95").alias("peak"))
    shocks = R.panel(s, d).groupBy("pff_player_id").agg(F.count_distinct("shock_id").alias("n_shocks"))
    out = base.join(physical, "pff_player_id", "left").join(shocks, "pff_player_id", "left").fillna(0, ["n_shocks"])
    out = out.select("edition_id", "pff_player_id", "position_bucket", "minutes_played", "rank_minutes", "tier", "metres", "peak", "n_shocks")
    if wrong := contract_violations(out, CONTRACT):
        raise ValueError("; ".join(wrong))
    return out


def _ratio(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(ratio=[SequenceMatcher(None, a, b).ratio() for a, b in zip(pdf["a"], pdf["b"])])[["sb_player_id", "pff_player_id", "ratio"]]


def name_cascade(s, d, overrides: dict[int, int] | None = None):
    """(sb_player_id, pff_player_id, pass_no): within the same team the first pass that leaves one
    candidate: 1 equal names; 2 one name's tokens all in the other, or two common tokens; 3
    every token within two edits; 4 the best sequence ratio of at least 0.55 that leads by
    more than 0.1. ``overrides`` (0) settle rows by hand. The team is the block, so the
    pairs are rows times the size of their team; rows without a name or team have none."""
    norm = lambda c: F.split(name_norm(F.col(c)), " ")
    rows = table(s, d, "sb_to_pff_player_map").select("sb_player_id", F.lower(F.trim("team_name")).alias("team"), norm("sb_player_name").alias("rt")).dropna().distinct()
    people = R.players(s, d).select(F.col("id").alias("pff_player_id"), F.lower(F.trim("team_name")).alias("team"), F.split(name_norm(F.concat_ws(" ", "firstName", "lastName")), " ").alias("pt")).dropna()
    by_hand = s.createDataFrame([(a, b, 0) for a, b in (overrides or {}).items()], "sb_player_id long, pff_player_id long, pass_no long")
    rows = rows.join(by_hand, "sb_player_id", "left_anti")
    pairs = rows.join(people, "team")
    within = lambda a, b: F.size(F.array_except(a, b)) == 0
    near = F.size(F.filter("rt", lambda t: F.exists("pt", lambda u: F.levenshtein(t, u, 2) >= 0)))
    subset = within("rt", "pt") | within("pt", "rt") | (F.size(F.array_intersect("rt", "pt")) >= 2)
    passes = F.when(F.array_sort("rt") == F.array_sort("pt"), 1).when(subset, 2).when(near >= F.greatest(F.lit(2), F.size("rt")), 3)
    hits = pairs.select("sb_player_id", "pff_player_id", passes.cast("long").alias("pass_no")).where("pass_no IS NOT NULL")
    one = hits.groupBy("sb_player_id", "pass_no").agg(F.count(F.lit(1)).alias("n"), F.min("pff_player_id").alias("pff_player_id")).where("n = 1")
    found = cut(one.groupBy("sb_player_id").agg(F.min_by("pff_player_id", "pass_no").alias("pff_player_id"), F.min("pass_no").alias("pass_no")))
    text = lambda c: F.array_join(F.array_sort(c), " ")
    rest = pairs.join(found, "sb_player_id", "left_anti").select("sb_player_id", "pff_player_id", text("rt").alias("a"), text("pt").alias("b"))
    scored = rest.mapInPandas(_ratio, "sb_player_id long, pff_player_id long, ratio double")
    w = Window.partitionBy("sb_player_id").orderBy(F.desc("ratio"), "pff_player_id")  # the people of a team
    best = scored.withColumns({"place": F.row_number().over(w), "next": F.coalesce(F.lead("ratio").over(w), F.lit(0.0))})
    fourth = best.where("place = 1 AND ratio >= 0.55 AND ratio - next > 0.1").select("sb_player_id", "pff_player_id", F.lit(4).cast("long").alias("pass_no"))
    return found.unionByName(fourth).unionByName(by_hand)


QUERIES = {"c28_master_table": master_table, "j18_name_cascade": name_cascade}
ORACLE = {
    "c28_master_table": f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY edition_id ORDER BY minutes_played, pff_player_id) / count(*) OVER (PARTITION BY edition_id) AS p FROM {PCJ} WHERE minutes_played >= 270),
ph AS (SELECT pff_player_id, round(sum(distance_m), 4) AS metres, max(psv95) AS peak FROM {PM} GROUP BY 1), sh AS (SELECT pff_player_id, count(DISTINCT shock_id) AS n FROM {PANEL} GROUP BY 1)
SELECT edition_id, b.pff_player_id, position_bucket, minutes_played, row_number() OVER (PARTITION BY edition_id ORDER BY minutes_played DESC, b.pff_player_id) AS rank_minutes,
CASE WHEN p >= .95 THEN 'S' WHEN p >= .85 THEN 'A' WHEN p >= .60 THEN 'B' WHEN p >= .40 THEN 'C' WHEN p >= .15 THEN 'D' ELSE 'E' END AS tier, metres, peak, coalesce(sh.n, 0) AS n_shocks
FROM b LEFT JOIN ph USING (pff_player_id) LEFT JOIN sh USING (pff_player_id)""",
}
