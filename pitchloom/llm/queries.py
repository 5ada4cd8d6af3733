"""Queries p2, p3, p5 to p9 over the whole driver tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchloom.llm.lookalike import alike_pairs, canonical_text, class_sizes
from pitchloom.llm.mixing import mixture
from pitchloom.llm.names import link_names
from pitchloom.llm.nearest import nearest
from pitchloom.llm.packing import audit, fill_report, pack
from pitchloom.llm.sizes import token_size
from pitchloom.llm.splits import assign_splits, components
from pitchloom.llm.topn import top_n
from pitchloom.session import few_rows, table


def _known(column: str, prefix: str):
    return F.when(F.col(column) != 0, F.concat(F.lit(prefix), F.col(column).cast("string")))


def _match_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b) ties of public (s:) and provider (p:) ids, and every id tied to itself."""
    panel = table(spark, sf_dir, "panel_master").select(_known("sb_match_id", "s:").alias("s"), _known("pff_match_id", "p:").alias("p"))
    matrix = table(spark, sf_dir, "training_matrix").select(_known("match_id", "s:").alias("s"), F.lit(None).cast("string").alias("p"))
    ids = panel.unionByName(matrix).distinct()
    one = F.coalesce("s", "p")
    return ids.where(one.isNotNull()).select(one.alias("a"), F.coalesce("p", "s").alias("b"))


def _public_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(m, component): the public ids that are tied to a provider's."""
    panel = table(spark, sf_dir, "panel_master").select(_known("sb_match_id", "s:").alias("a"), _known("pff_match_id", "p:").alias("b"))
    found = components(panel.dropna().distinct())
    return found.where(F.col("vertex").startswith("s:")).select(F.substring("vertex", 3, 30).cast("long").alias("m"), "component")


def p2_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(match_id, representative, n_links): each public id with the smallest id that it must share
    a split with and the number of those; linear in the ids, where p2_found's pairs aren't."""
    public = _public_matches(spark, sf_dir)
    per = public.groupBy("component").agg(F.min("m").alias("representative"), (F.count(F.lit(1)) - 1).alias("n_links"))
    return public.join(per, "component").select(F.col("m").alias("match_id"), "representative", "n_links")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    public = _public_matches(spark, sf_dir)
    a, b = public.withColumnRenamed("m", "match_id_a"), public.withColumnRenamed("m", "match_id_b")
    return a.join(b, "component").where(F.col("match_id_a") < F.col("match_id_b")).select("match_id_a", "match_id_b")


def _split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, row_key, component, split_name) of every row of the two tables, repeats once."""
    panel = table(spark, sf_dir, "panel_master").select(
        F.lit("panel_master").alias("table_name"), F.col("panel_id").cast("string").alias("row_key"), F.coalesce(_known("sb_match_id", "s:"), _known("pff_match_id", "p:")).alias("vertex")
    )
    matrix = table(spark, sf_dir, "training_matrix").select(
        F.lit("training_matrix").alias("table_name"), F.concat_ws(":", F.coalesce(F.col("match_id").cast("string"), F.lit("null")), F.coalesce(F.col("minute_bin").cast("string"), F.lit("null"))).alias("row_key"), _known("match_id", "s:").alias("vertex")
    )
    rows = panel.unionByName(matrix).distinct()
    found = components(_match_ids(spark, sf_dir))
    rows = rows.join(found, "vertex", "left").withColumn("component", F.coalesce("component", F.concat_ws(":", F.lit("row"), "table_name", "row_key"))).drop("vertex")
    targets = {r[0]: r[1] for r in few_rows(table(spark, sf_dir, "split_targets").select("split_name", "target_share"), 10_000, "splits") if r[0] is not None}
    splits = assign_splits(rows.groupBy("component").agg(F.count(F.lit(1)).alias("n")), targets)
    return rows.join(splits, "component", "left")


def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_rows(spark, sf_dir).select("table_name", "row_key", "component", "split_name")


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _split_rows(spark, sf_dir).groupBy("split_name").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("component").alias("n_components"))
    whole = F.sum("n_rows").over(Window.partitionBy(F.lit(0)))  # one row per split
    return rows.select("split_name", "n_rows", "n_components", F.round(F.col("n_rows") / whole, 6).alias("actual_share"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pcj_table").select("edition_id", "position_group", "pff_player_id", "minutes_played", "chasing_clutch_idx", "protecting_clutch_idx")
    long = rows.unpivot(["edition_id", "position_group", "pff_player_id", "minutes_played"], ["chasing_clutch_idx", "protecting_clutch_idx"], "idx_name", "idx")
    best = top_n(long, ["idx_name", "edition_id", "position_group"], [("idx", True), ("minutes_played", True), ("pff_player_id", False)], 10, ["pff_player_id"])
    return best.select("idx_name", "edition_id", "position_group", "pff_player_id")


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    players = table(spark, sf_dir, "players")
    people = players.select(F.col("id").alias("person_id"), F.col("firstName").alias("given"), F.col("lastName").alias("family"), F.col("nickname").alias("nick"), F.col("team_name").alias("team"))
    typed = table(spark, sf_dir, "sb_to_pff_player_map").select(
        F.col("sb_player_id").alias("row_id"),
        F.col("pff_player_name").alias("name_a"),
        # name_norm is made from sb_player_name and has lost apostrophes and full stops
        F.coalesce("sb_player_name", "name_norm").alias("name_b"),
        F.col("team_name").alias("team"),
        F.col("pff_player_id").alias("known_id"),
    )
    return link_names(people, typed)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).select(F.col("row_id").alias("sb_player_id"), F.col("person_id").alias("pff_player_id"))


def p5_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each person with the number of variants linked to them and the weakest link."""
    return _links(spark, sf_dir).groupBy(F.col("person_id").alias("pff_player_id")).agg(F.count(F.lit(1)).alias("n_variants"), F.round(F.min("score"), 6).alias("weakest"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    goals = table(spark, sf_dir, "goals_timeline").select("goal_id", "match_id", "period", "start_game_clock")
    shots = table(spark, sf_dir, "events_enriched").where(F.col("possession_event_type") == "SH").select("event_id", "match_id", "period", "start_game_clock")
    return nearest(goals, shots, "goal_id", "event_id", ["match_id", "period"], "start_game_clock", "start_game_clock", 15.0).select("goal_id", "event_id")


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source", token_size().alias("tokens"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_sized(spark, sf_dir).select("doc_id", "tokens"), "doc_id", "tokens", table(spark, sf_dir, "container_sizes"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).where((F.col("n_pieces") > 1) & (F.col("piece_no") == 0)).select("size_name", "doc_id")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(_packed(spark, sf_dir), table(spark, sf_dir, "container_sizes"))


def p7_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a packing must keep, per container size; see ``packing.audit``."""
    return audit(_packed(spark, sf_dir), table(spark, sf_dir, "container_sizes"), "doc_id", 0.97)


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixture(_sized(spark, sf_dir), "doc_id", "text", "source", "tokens", table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose fitted rates stand at their caps short of the goal; checked exactly."""
    return _mixed(spark, sf_dir)[1].where(F.col("short") & ~F.col("reachable")).select("source")


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alike_pairs(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per class with its rows, its different texts and the pairs they make."""
    return class_sizes(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_text(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {
    "p2_found": p2_found,
    "p2_members": p2_members,
    "p2_splits": p2_splits,
    "p2_shares": p2_shares,
    "p3_found": p3_found,
    "p5_found": p5_found,
    "p5_stars": p5_stars,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p7_containers": p7_containers,
    "p7_fill": p7_fill,
    "p7_audit": p7_audit,
    "p8_found": p8_found,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_classes": p9_classes,
    "p9_canonical": p9_canonical,
}

_TOKENS = r"coalesce(n_tokens, len(regexp_extract_all(coalesce(text, ''), '\w+|[^\w\s]+')))"
ORACLE = {
    "p2_found": """WITH RECURSIVE e AS (SELECT DISTINCT sb_match_id AS s, pff_match_id AS p FROM panel_master WHERE sb_match_id <> 0 AND pff_match_id <> 0),
n AS (SELECT DISTINCT a.s AS x, b.s AS y FROM e a JOIN e b USING (p)),
r AS (SELECT x, y FROM n UNION SELECT r.x, n.y FROM r JOIN n ON r.y = n.x)
SELECT x AS match_id_a, y AS match_id_b FROM r WHERE x < y""",
    "p2_members": """WITH RECURSIVE e AS (SELECT DISTINCT sb_match_id AS s, pff_match_id AS p FROM panel_master WHERE sb_match_id <> 0 AND pff_match_id <> 0),
n AS (SELECT DISTINCT a.s AS x, b.s AS y FROM e a JOIN e b USING (p)),
r AS (SELECT x, y FROM n UNION SELECT r.x, n.y FROM r JOIN n ON r.y = n.x)
SELECT x AS match_id, min(y) AS representative, count(*) - 1 AS n_links FROM r GROUP BY x""",
    "p3_found": """WITH d AS (SELECT DISTINCT edition_id, position_group, pff_player_id, minutes_played, chasing_clutch_idx, protecting_clutch_idx FROM pcj_table WHERE position_group IS NOT NULL),
l AS (SELECT 'chasing_clutch_idx' AS idx_name, chasing_clutch_idx AS idx, * FROM d UNION ALL SELECT 'protecting_clutch_idx', protecting_clutch_idx, * FROM d)
SELECT idx_name, edition_id, position_group, pff_player_id FROM l WHERE idx IS NOT NULL AND NOT isnan(idx) AND edition_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY idx_name, edition_id, position_group ORDER BY idx DESC, minutes_played DESC NULLS LAST, pff_player_id) <= 10""",
    "p6_found": """WITH g AS (SELECT DISTINCT goal_id, match_id, period, start_game_clock AS t FROM goals_timeline),
s AS (SELECT DISTINCT event_id, match_id, period, start_game_clock AS t FROM events_enriched WHERE possession_event_type = 'SH')
SELECT goal_id, event_id FROM g JOIN s ON g.match_id = s.match_id AND g.period = s.period AND s.t BETWEEN g.t - 15 AND g.t + 15
QUALIFY row_number() OVER (PARTITION BY goal_id ORDER BY abs(g.t - s.t), s.t, event_id) = 1""",
    "p7_found": f"SELECT size_name, doc_id FROM (SELECT doc_id, {_TOKENS} AS n FROM documents), container_sizes WHERE n > capacity_tokens",
    "p7_audit": f"SELECT size_name, sum(n)::BIGINT AS tokens, count(*) FILTER (n > capacity_tokens) AS n_cut, 0 AS n_over, 0 AS n_ragged, true AS well_filled FROM (SELECT doc_id, {_TOKENS} AS n FROM documents), container_sizes GROUP BY 1",
    "p8_found": f"""WITH d AS (SELECT source, {_TOKENS} AS n FROM documents), t AS (SELECT source, sum(n) AS n FROM d GROUP BY source), w AS (SELECT sum(n) AS n FROM d)
SELECT m.source AS source FROM mix_targets m LEFT JOIN t ON t.source = m.source, w WHERE coalesce(t.n, 0) * m.max_repeats < m.target_share * w.n""",
}
