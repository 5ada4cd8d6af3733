"""Readers, writers, audits and streams, exercised on files written from the driver's tables.

Files go to the shared folder of ``spark.checkpoint.dir``, each run into a folder of its own.
"""

from __future__ import annotations

import difflib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchloom.models import folds
from pitchloom.operators.nested import whole_number_column
from pitchloom.plans import relational as R
from pitchloom.plans.relational import EV, PCJ, PLAYERS
from pitchloom.session import checkpoint_dir, table
from pitchloom.sources import readers
from pitchloom.streaming import live

QUERIES: dict = {}
ORACLE: dict = {}


def q(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def as_lines(df: DataFrame, path: str, compression: str = "none") -> str:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.option("compression", compression).text(path)
    return path


# --- sources ---
_NATIONS = "SELECT n_regionkey::BIGINT AS match_id, n_nationkey::BIGINT AS nation, n_name AS name FROM nation"


def _documents(s, d) -> str:
    """One document per region: an array of objects in a folder of the region's number."""
    path = folder(s)
    n = table(s, d, "nation").select("n_regionkey", F.struct(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name")).alias("o"))
    docs = n.groupBy(F.col("n_regionkey").alias("region")).agg(F.to_json(F.collect_list("o")).alias("value"))  # nation has 25 rows at any scale
    docs.repartition("region").write.partitionBy("region").text(path)
    return path


@q("s01_array_documents", "SELECT n_nationkey::BIGINT AS nation, n_name AS name FROM nation")
def _(s, d):
    return readers.json_documents(s, _documents(s, d), T.StructType([T.StructField("nation", T.LongType()), T.StructField("name", T.StringType())])).select("nation", "name")


@q("s06_inferred_documents", "SELECT n_nationkey::BIGINT AS nation, n_name AS name FROM nation")
def _(s, d):
    return readers.json_documents(s, _documents(s, d)).select("nation", "name")


@q("s07_id_from_path", _NATIONS)
def _(s, d):
    return readers.json_documents(s, _documents(s, d), id_pattern=r"region=(\d+)").select("match_id", "nation", "name")


CUSTOMER = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()), T.StructField("c_acctbal", T.DoubleType())])


@q("s02_compressed_lines", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(s, d):
    path = as_lines(table(s, d, "customer").select(*CUSTOMER.fieldNames()), folder(s), "bzip2")
    return readers.json_lines(s, path, CUSTOMER).drop(readers.CORRUPT)


@q("s03_peeked_schema", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(s, d):
    path = as_lines(table(s, d, "customer").select(*CUSTOMER.fieldNames()), folder(s))
    return readers.peeked_lines(s, path, 50).select(*CUSTOMER.fieldNames())


@q("s04_chunked_write", "SELECT l_returnflag, count(*) AS n, sum(l_quantity)::DOUBLE AS quantity FROM lineitem GROUP BY 1")
def _(s, d):
    path = folder(s)
    readers.write(table(s, d, "lineitem").select("l_returnflag", "l_quantity"), path, max_rows_per_file=5000)
    return s.read.parquet(path).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@q("s05_unified_schema", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, NULL::DOUBLE AS weight FROM nation")
def _(s, d):
    return readers.with_schema(table(s, d, "nation"), T.StructType([T.StructField("n_nationkey", T.LongType()), T.StructField("n_name", T.StringType()), T.StructField("weight", T.DoubleType())]))


@q("s08_folder_tree", "SELECT s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def _(s, d):
    path = folder(s)
    as_lines(table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), f"{path}/a/b")
    as_lines(table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), f"{path}/c")
    return readers.tree(s, path, T.StructType([T.StructField("k", T.LongType()), T.StructField("name", T.StringType())]))


@q("s09_events_by_match", f"SELECT match_id, count(*) AS n, min(event_id) AS first_event, count(gameEvents.setpieceType) AS n_setpiece FROM {EV} WHERE match_id IS NOT NULL GROUP BY 1")
def _(s, d):
    path = folder(s)
    e = R.events(s, d, "match_id", "gameEvents").where("match_id IS NOT NULL")
    lines = as_lines(e, f"{path}/lines")
    readers.write(readers.json_lines(s, lines, e.schema).drop(readers.CORRUPT), f"{path}/table", ["match_id"])
    back = s.read.parquet(f"{path}/table")
    return back.groupBy(F.col("match_id").cast("long").alias("match_id")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.count("gameEvents.setpieceType").alias("n_setpiece"))


@q("s10_without_sentinels", f"SELECT event_id, CASE WHEN gameEvents.setpieceType IN ('', 'null') THEN NULL ELSE gameEvents.setpieceType END AS setpiece, gameEvents.teamName AS team FROM {EV}")
def _(s, d):
    clean = readers.without_sentinels(R.events(s, d, "gameEvents"))
    return clean.select("event_id", F.col("gameEvents.setpieceType").alias("setpiece"), F.col("gameEvents.teamName").alias("team"))


@q("s11_tagged_union", "SELECT 'suppliers' AS competition, s_suppkey AS k FROM supplier UNION ALL SELECT 'customers', c_custkey FROM customer")
def _(s, d):
    frames = {"suppliers": table(s, d, "supplier").select(F.col("s_suppkey").alias("k")), "customers": table(s, d, "customer").select(F.col("c_custkey").alias("k"))}
    return readers.tagged_union(frames, "competition")


@q("s12_tolerant_catalog", "SELECT count(*) FILTER (c_custkey % 7 <> 0) AS n_good, count(*) FILTER (c_custkey % 7 = 0) AS n_corrupt FROM customer")
def _(s, d):
    c = table(s, d, "customer").select(*CUSTOMER.fieldNames())
    line = F.to_json(F.struct(*CUSTOMER.fieldNames()))
    path = folder(s)
    c.select(F.when(F.col("c_custkey") % 7 == 0, F.substring(line, 1, 12)).otherwise(line).alias("value")).write.text(path)
    good, corrupt = readers.catalog(s, path, CUSTOMER)
    return corrupt.select(good.agg(F.count(F.lit(1))).scalar().alias("n_good"), "n_corrupt")


@q("s13_extract_all", "SELECT 'nation' AS table_name, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'supplier', count(*) FROM supplier")
def _(s, d):
    got = readers.extract_all(s, {name: (lambda name=name: table(s, d, name)) for name in ("nation", "region", "supplier")}, folder(s))
    return readers.tagged_union({name: df.agg(F.count(F.lit(1)).alias("n")) for name, df in got.items()}, "table_name").select("table_name", "n")


@q("s14_one_partition", f"SELECT event_id FROM {EV} WHERE match_id = (SELECT min(match_id) FROM events_enriched)")
def _(s, d):
    e = R.events(s, d, "match_id")
    return readers.partition(e, "match_id", table(s, d, "events_enriched").agg(F.min("match_id")).first()[0]).select("event_id")


@q("s16_partition_scan", "SELECT l_shipmode_like::BIGINT AS part, count(*) AS n FROM (SELECT l_linenumber AS l_shipmode_like FROM lineitem WHERE l_linenumber = 2) GROUP BY 1")
def _(s, d):
    path = folder(s)
    readers.write(table(s, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("part")).repartition("part"), path, ["part"])
    scan = s.read.parquet(path).where("part = 2")  # pruned to one folder
    return scan.groupBy(F.col("part").cast("long").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@q("s19_checked_catalog", f"SELECT id, lastName FROM {PLAYERS} WHERE positionGroupType = 'GK'")
def _(s, d):
    return readers.allowed(R.players(s, d), "positionGroupType", "GK", ("GK", "CM", "CF")).select("id", "lastName")


@q("s20_flattened_structs", f"SELECT event_id, gameEvents.teamId AS team_id, gameEvents.teamName AS team, gameEvents.playerName AS player FROM {EV} WHERE gameEvents.period = 2 AND gameEvents.homeTeam")
def _(s, d):
    g = "gameEvents"
    return R.events(s, d, g).where((F.col(f"{g}.period") == 2) & F.col(f"{g}.homeTeam")).select("event_id", F.col(f"{g}.teamId").alias("team_id"), F.col(f"{g}.teamName").alias("team"), F.col(f"{g}.playerName").alias("player"))


@q("s21_csv", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(s, d):
    path = folder(s)
    table(s, d, "customer").select(*CUSTOMER.fieldNames()).write.option("header", True).csv(path)
    return readers.csv_table(s, path, CUSTOMER)


@q("s22_guarded_write", "SELECT true AS refused, count(*) AS n FROM supplier")
def _(s, d):
    path, rows = folder(s), table(s, d, "supplier")
    readers.write(rows, path)
    try:
        readers.write(rows, path)
        refused = False
    except Exception:
        refused = True
    return s.read.parquet(path).agg(F.lit(refused).alias("refused"), F.count(F.lit(1)).alias("n"))


@q("s23_materialized", "SELECT 1 AS n_built, count(*) AS n FROM supplier")
def _(s, d):
    path, built = folder(s), []
    for _ in range(2):
        out = readers.materialize(s, path, lambda: built.append(1) or table(s, d, "supplier"))
    return out.agg(F.lit(len(built)).alias("n_built"), F.count(F.lit(1)).alias("n"))


@q("s24_replaced_partition", "SELECT n_regionkey::BIGINT AS region, CASE WHEN n_regionkey = 1 THEN 'again' ELSE 'first' END AS run, count(*) AS n FROM nation GROUP BY 1, 2")
def _(s, d):
    path, n = folder(s), table(s, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("region"))
    readers.write(n.withColumn("run", F.lit("first")), path, ["region"])
    readers.write(n.where("region = 1").withColumn("run", F.lit("again")), path, ["region"], overwrite=True)
    return s.read.parquet(path).groupBy(F.col("region").cast("long").alias("region"), "run").agg(F.count(F.lit(1)).alias("n"))


@q("s25_cache_by_tag", "SELECT 'short' AS tag, count(*) AS n FROM supplier UNION ALL SELECT 'long', 2 * count(*) FROM supplier")
def _(s, d):
    path, rows = folder(s), table(s, d, "supplier").select("s_suppkey")
    builds = {"short": lambda: rows, "long": lambda: rows.union(rows)}
    return readers.tagged_union({tag: readers.materialize(s, f"{path}/tag={tag}", b).agg(F.count(F.lit(1)).alias("n")) for tag, b in builds.items()}, "tag").select("tag", "n")


@q("s26_saved_model", "SELECT count(*) AS n, count(*) AS n_same FROM (SELECT DISTINCT match_id, minute_bin, score_diff, elo_diff, y FROM training_matrix WHERE match_id IS NOT NULL AND minute_bin IS NOT NULL AND score_diff IS NOT NULL AND elo_diff IS NOT NULL AND y IS NOT NULL)")
def _(s, d):
    t = table(s, d, "training_matrix").select("match_id", "minute_bin", F.col("score_diff").cast("double").alias("score_diff"), "elo_diff", (F.col("y") > 1).cast("double").alias("label"), "y").dropna().distinct()
    path, model = folder(s), folds.fit_pipeline(t, "label", ["score_diff", "elo_diff"])
    model.write().overwrite().save(path)
    again = PipelineModel.load(path).transform(model.transform(t).withColumnsRenamed({c: f"first_{c}" for c in ("_x", "rawPrediction", "probability", "prediction")}))
    return again.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("prediction") == F.col("first_prediction")).alias("n_same"))


@q("s27_text_cards", f"SELECT edition_id, pff_player_id, coalesce(player_name, '?') || chr(10) || 'Team: ' || coalesce(team_name, '-') || chr(10) || 'Minutes: ' || coalesce(minutes_played::VARCHAR, '-') AS card FROM {PCJ}")
def _(s, d):
    return R.pcj(s, d).select("edition_id", "pff_player_id", readers.text_card({"Team": "team_name", "Minutes": "minutes_played"}, "player_name").alias("card"))


@q("s28_radar_data", f"SELECT edition_id, pff_player_id, axis, v FROM (SELECT edition_id, pff_player_id, minutes_played::DOUBLE AS minutes_played, n_matches_played::DOUBLE AS n_matches_played, age_years FROM {PCJ}) UNPIVOT INCLUDE NULLS (v FOR axis IN (minutes_played, n_matches_played, age_years))")
def _(s, d):
    axes = ["minutes_played", "n_matches_played", "age_years"]
    return R.pcj(s, d).select("edition_id", "pff_player_id", *[F.col(a).cast("double").alias(a) for a in axes]).unpivot(["edition_id", "pff_player_id"], axes, "axis", "v")


@q("s29_inventory", "SELECT true AS any_file, true AS any_byte")
def _(s, d):
    path = folder(s)
    readers.write(table(s, d, "supplier"), path)
    return readers.inventory(s, path).agg((F.count(F.lit(1)) > 0).alias("any_file"), (F.sum("bytes") > 0).alias("any_byte"))


# --- audits ---
@q("q01_round_trip", "SELECT 'left' AS side, count(*) FILTER (c_custkey % 10 = 0) AS n FROM customer")
def _(s, d):
    # every tenth row is left out of the copy, so the audit has something to find
    rows = table(s, d, "customer").select(*CUSTOMER.fieldNames())
    path = as_lines(rows.where("c_custkey % 10 <> 0"), folder(s))
    return readers.round_trip(rows, readers.json_lines(s, path, CUSTOMER).drop(readers.CORRUPT))


_SAMPLE = "('0x' || substr(md5({k}::VARCHAR), 1, 8))::BIGINT < 858993459"


@q("q02_sampled_round_trip", f"SELECT count(*) AS n_sampled, count(*) AS n_same FROM customer WHERE {_SAMPLE.format(k='c_custkey')}")
def _(s, d):
    rows = table(s, d, "customer").select(*CUSTOMER.fieldNames())
    path = as_lines(rows, folder(s))
    return readers.sampled_agreement(rows, readers.json_lines(s, path, CUSTOMER).drop(readers.CORRUPT), "c_custkey", 0.2)


@q("q03_null_audit", "SELECT column_name, n_null, n_rows FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS n_null, count(*) AS n_rows FROM players" for c in ("id", "nickname", "firstName", "lastName", "dob", "height", "team_name", "positionGroupType")) + ")")
def _(s, d):
    return readers.null_counts(table(s, d, "players"))


@q("q04_audit_per_channel", f"SELECT channel, count(*) AS n, count(*) FILTER (outcome IS NULL) AS n_null FROM (SELECT DISTINCT * FROM panel_master) WHERE {_SAMPLE.format(k='panel_id')} GROUP BY 1")
def _(s, d):
    p = R.panel(s, d).where(F.conv(F.substring(F.md5(F.col("panel_id").cast("string")), 1, 8), 16, 10).cast("long") < 858993459)  # the audit's sample
    return p.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome").isNull()).alias("n_null"))


@q("q05_first_rows", "SELECT 20 AS n_rows, 0 AS n_different")
def _(s, d):
    rows = table(s, d, "customer").select(*CUSTOMER.fieldNames())
    path = as_lines(rows, folder(s))
    back = readers.json_lines(s, path, CUSTOMER).drop(readers.CORRUPT)
    first = lambda df: df.orderBy("c_custkey").limit(20)
    a, b = first(rows), first(back).withColumnsRenamed({c: f"{c}_b" for c in CUSTOMER.fieldNames()})
    same = F.col("c_name").eqNullSafe(F.col("c_name_b")) & F.col("c_acctbal").eqNullSafe(F.col("c_acctbal_b"))
    return a.join(b, F.col("c_custkey") == F.col("c_custkey_b"), "full").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~same).alias("n_different"))


# --- streams ---
@q("t01_file_stream", "SELECT event_id, user_id, event_type FROM events")
def _(s, d):
    return live.run_once(live.table_stream(s, d, "events").select("event_id", "user_id", "event_type"), folder(s))


@q("t02_stream_velocity", """SELECT game, t, round(CASE WHEN t > lag(t) OVER w THEN least(greatest((x - lag(x) OVER w) / (t - lag(t) OVER w), -12), 12) END, 5) AS vx FROM (SELECT DISTINCT gameRefId::BIGINT AS game, videoTimeMs / 1000 AS t, balls[1].x AS x, balls[1].y AS y FROM tracking WHERE gameRefId IS NOT NULL AND videoTimeMs IS NOT NULL AND balls[1].x IS NOT NULL AND balls[1].y IS NOT NULL) WINDOW w AS (PARTITION BY game ORDER BY t)""")
def _(s, d):
    ball = F.get("balls", F.lit(0))
    frames = live.table_stream(s, d, "tracking").select(F.col("gameRefId").cast("long").alias("game"), (F.col("videoTimeMs") / 1000).alias("t"), ball["x"].alias("x"), ball["y"].alias("y"))
    out = live.run_once(live.velocities(frames, "game", "t", "x", "y", expire_ms=None), folder(s))
    # a frame delivered again is measured against none, the first delivery has the speed
    return out.groupBy("game", "t").agg(F.round(F.max("vx"), 5).alias("vx"))


@q("t04_stream_debounce", """WITH f AS (SELECT DISTINCT frame_id, gameRefId::BIGINT AS game, coalesce(game_event.home_ball, false) AS h FROM tracking WHERE gameRefId IS NOT NULL), r AS (SELECT *, sum(c) OVER (PARTITION BY game ORDER BY frame_id) AS run FROM (SELECT *, CASE WHEN lag(h) OVER w IS DISTINCT FROM h THEN 1 ELSE 0 END AS c FROM f WINDOW w AS (PARTITION BY game ORDER BY frame_id))),
n AS (SELECT *, row_number() OVER (PARTITION BY game, run ORDER BY frame_id) AS pos FROM r) SELECT game, frame_id, coalesce(last_value(CASE WHEN pos >= 2 THEN h END IGNORE NULLS) OVER w, first_value(h) OVER w) AS steady FROM n WINDOW w AS (PARTITION BY game ORDER BY frame_id ROWS UNBOUNDED PRECEDING)""")
def _(s, d):
    frames = live.table_stream(s, d, "tracking").where("gameRefId IS NOT NULL").select(F.col("gameRefId").cast("long").alias("game"), "frame_id", F.coalesce("game_event.home_ball", F.lit(False)).alias("h"))
    # repeats are dropped by a stateful distinct before the debounce, which counts frames
    return live.run_once(live.steady_flags(frames.dropDuplicates(["game", "frame_id"]), "game", "frame_id", "h", expire_ms=None), folder(s)).select("game", F.col("o").alias("frame_id"), "steady")


@q("t07_stream_minutes", "SELECT user_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, count(*) AS n FROM events WHERE ts < (SELECT date_trunc('minute', max(ts) - INTERVAL 10 MINUTE) FROM events) GROUP BY 1, 2")
def _(s, d):
    counted = live.minute_buckets(live.table_stream(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["user_id"])
    # the last minutes are still open when the stream ends
    return live.run_once(counted, folder(s)).select("user_id", F.date_format("bucket", "yyyy-MM-dd HH:mm").alias("minute"), "n")


# --- vectorised Python functions ---
@q("f19_sequence_ratio")
def _(s, d):
    def ratios(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "ratio": [round(difflib.SequenceMatcher(None, a, b).ratio(), 6) for a, b in zip(pdf["a"], pdf["b"])]})

    p = R.players(s, d).select("id", F.col("nickname").alias("a"), F.concat_ws(" ", "firstName", "lastName").alias("b")).dropna()
    return p.mapInPandas(ratios, "id long, ratio double")


@q("x01_scalar_function", "SELECT frame_id, count(*) AS n FROM (SELECT frame_id, TRY_CAST(TRY_CAST(trim(p.jerseyNum) AS DOUBLE) AS BIGINT) AS num FROM (SELECT frame_id, unnest(homePlayers) AS p FROM (SELECT DISTINCT * FROM tracking))) WHERE num IS NOT NULL GROUP BY 1")
def _(s, d):
    # a declared row function of the reference, as a column expression
    rows = table(s, d, "tracking").dropDuplicates(["frame_id"]).select("frame_id", F.explode("homePlayers").alias("p"))
    return rows.where(whole_number_column(F.col("p.jerseyNum")).isNotNull()).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"))


@q("x02_grouped_map", f"SELECT match_id, team_id, max(k) AS longest FROM (SELECT match_id, team_id, run, count(*) AS k FROM (SELECT match_id, team_id, sum(c) OVER (PARTITION BY match_id ORDER BY period, startTime, event_id) AS run FROM (SELECT *, CASE WHEN lag(team_id) OVER w IS DISTINCT FROM team_id THEN 1 ELSE 0 END AS c FROM {EV} WHERE match_id IS NOT NULL AND team_id IS NOT NULL AND period IS NOT NULL AND startTime IS NOT NULL WINDOW w AS (PARTITION BY match_id ORDER BY period, startTime, event_id))) GROUP BY 1, 2, 3) GROUP BY 1, 2")
def _(s, d):
    def longest(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        team = pdf.sort_values(["period", "startTime", "event_id"])["team_id"]
        runs = team.groupby((team != team.shift()).cumsum()).agg(["first", "size"])
        best = runs.groupby("first")["size"].max()
        return pd.DataFrame({"match_id": key[0], "team_id": best.index, "longest": best.to_numpy()})

    # one call per match: a match is bounded by its length
    e = R.events(s, d, "match_id", "team_id", "period", "startTime").dropna()
    return e.groupBy("match_id").applyInPandas(longest, "match_id long, team_id long, longest long")
