import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchloom.sources import readers
from pitchloom.streaming import live


def test_json_readers(spark, tmp_path):
    (tmp_path / "m_17.json").write_text(json.dumps([{"a": 1, "s": {"b": "null"}}, {"a": 2.5, "c": [{"d": ""}]}]))
    df = readers.json_documents(spark, str(tmp_path / "m_17.json"), id_pattern=r"m_(\d+)")
    assert df.count() == 2 and {r.match_id for r in df.select("match_id").collect()} == {17}
    clean = readers.without_sentinels(df.select("s", "c")).collect()
    assert all(r.s is None or r.s.b is None for r in clean) and all(r.c is None or r.c[0].d is None for r in clean)
    lines = tmp_path / "t.jsonl"
    lines.write_text('{"frameNum": 1, "homePlayers": [{"jerseyNum": "7", "x": 1.0}]}\n{"frameNum": \n{"frameNum": 2, "late": 1}\n')
    assert readers.tracking_frames(spark, str(lines)).count() == 2
    bad = readers.json_lines(spark, str(lines), T.StructType([T.StructField("frameNum", T.LongType())]))
    assert bad.where(F.col("_corrupt_record").isNotNull()).count() == 1
    good, corrupt = readers.catalog(spark, str(lines), T.StructType([T.StructField("frameNum", T.LongType())]))
    assert good.select("frameNum").collect() and corrupt.first().n_corrupt == 1


def test_tables_and_audit(spark, tmp_path):
    df = spark.range(10).withColumn("p", F.col("id") % 2)
    path = str(tmp_path / "t")
    readers.write(df, path, ["p"])
    with pytest.raises(Exception):
        readers.write(df, path, ["p"])
    readers.write(df.where("p = 1"), path, ["p"], overwrite=True)
    back = spark.read.parquet(path).select("id", F.col("p").cast("long").alias("p"))
    assert readers.round_trip(df, back).count() == 0
    assert [tuple(r) for r in readers.round_trip(df, back.where("id > 0").unionByName(back.where("id = 9"))).orderBy("side").collect()] == [("left", 1), ("right", 1)]
    assert readers.partition(back, "p", 1).count() == 5
    with pytest.raises(LookupError):
        readers.partition(back, "p", 7)
    built = []
    for _ in range(2):
        out = readers.materialize(spark, str(tmp_path / "m"), lambda: built.append(1) or df)
    assert out.count() == 10 and built == [1]
    assert readers.inventory(spark, path).where("bytes > 0").count() >= 2
    wide = readers.scan(spark, [path, str(tmp_path / "m")])
    assert wide.count() == 20
    (tmp_path / "p.csv").write_text("id,height\n1,180.5\n2,\n")
    assert readers.csv_table(spark, str(tmp_path / "p.csv"), T.StructType([T.StructField("id", T.LongType()), T.StructField("height", T.DoubleType())])).count() == 2


def drain(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()
    return df.sparkSession.table(name).collect()


def test_streaming_twins(spark, tmp_path):
    rows = [(1, float(t), float(t) * 2, 0.0, t % 4 < 2) for t in range(8)]
    src = spark.createDataFrame(rows, "k long, t double, x double, y double, f boolean").coalesce(1)
    src.write.parquet(str(tmp_path / "s"))
    stream = lambda: live.file_stream(spark, str(tmp_path / "s"), src.schema)
    v = sorted(drain(live.velocities(stream(), "k", "t", "x", "y", expire_ms=None), "vel"), key=lambda r: r.t)
    assert v[0].vx is None and all(r.vx == 2.0 for r in v[1:])
    s = sorted(drain(live.steady_flags(stream(), "k", "t", "f", expire_ms=None), "flags"), key=lambda r: r.o)
    assert [r.steady for r in s] == [True, True, True, False, False, True, True, False]
    stamped = stream().withColumn("ts", F.timestamp_seconds(F.col("t") * 30))
    got = drain(live.minute_buckets(stamped, "ts", ["k"]), "mins", "complete")
    assert sorted(r.n for r in got) == [2, 2, 2, 2]
    values = stamped.select("k", F.col("ts").alias("vt"), "x")
    anchors = stamped.where("t = 4").select("k", F.col("ts").alias("at"))
    near = drain(live.anchored(anchors, values, "k", "at", "vt", "1 minute"), "near")
    assert len(near) == 5
