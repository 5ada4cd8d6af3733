"""Streaming twins of the stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    """New parquet files of a folder in bounded steps."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's file, or the files of its folder, as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile():
        return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return file_stream(spark, f"{sf_dir}/{name}.parquet", schema)


def run_once(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream gives for all that is there now: written once and exactly by the file sink,
    with its progress in the same shared folder, and read back."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/progress").option("path", f"{folder}/rows").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def minute_buckets(events: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """(keys, bucket, n) per tumbling minute; rows later than ``late`` are dropped by the watermark."""
    counted = events.withWatermark(time, late).groupBy(*keys, F.window(time, "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*keys, F.col("w.start").alias("bucket"), "n")


def anchored(anchors: DataFrame, values: DataFrame, key: str, anchor_time: str, value_time: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Values within ``width`` of an anchor of the same key: a stream-stream join whose state
    both watermarks bound."""
    a = anchors.withWatermark(anchor_time, late).alias("a")
    v = values.withWatermark(value_time, late).withColumnRenamed(key, "_key").alias("v")
    near = F.expr(f"{key} = _key AND {value_time} >= {anchor_time} - INTERVAL {width} AND {value_time} <= {anchor_time} + INTERVAL {width}")
    return a.join(v, near).drop("_key")


def _timer(expire_ms: int | None) -> str:
    return GroupStateTimeout.NoTimeout if expire_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def velocities(frames: DataFrame, key: str, time: str, x: str, y: str, cap: float = 12.0, expire_ms: int | None = 3_600_000) -> DataFrame:
    """(key, time, vx, vy): differences to the same player's frame before, across batches.
    Time is in seconds; frames that come out of order are measured against none. What is
    kept of a player that isn't heard of for ``expire_ms`` is given up; None keeps it, for
    runs over what is there now, which a timer would keep awake."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        for pdf in batches:
            out = []
            for t, px, py in pdf.sort_values("t")[["t", "x", "y"]].itertuples(index=False):
                if last is None or t <= last[0]:
                    out.append((group[0], t, None, None))
                else:
                    d = t - last[0]
                    out.append((group[0], t, *(max(-cap, min(cap, (b - a) / d)) for a, b in ((last[1], px), (last[2], py)))))
                if last is None or t > last[0]:
                    last = (t, px, py)
            yield pd.DataFrame(out, columns=[key, "t", "vx", "vy"]).astype({"vx": "float64", "vy": "float64"})
        if last is not None:
            state.update(tuple(float(v) for v in last))
            if expire_ms is not None:
                state.setTimeoutDuration(expire_ms)

    kind = frames.schema[key].dataType.simpleString()
    rows = frames.select(key, F.col(time).cast("double").alias("t"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, t double, vx double, vy double", "t double, x double, y double", "append", _timer(expire_ms))


def steady_flags(frames: DataFrame, key: str, order: str, flag: str, least: int = 2, expire_ms: int | None = 3_600_000) -> DataFrame:
    """(key, order, steady): a state that flips after ``least`` equal values in a row, kept
    across batches until the key isn't heard of for ``expire_ms`` (None: for ever, for runs
    over what is there now)."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, value, run = state.get if state.exists else (None, None, 0)
        for pdf in batches:
            out = []
            for o, f in pdf.sort_values("o")[["o", "f"]].itertuples(index=False):
                run = run + 1 if f == value else 1
                value = bool(f)
                if held is None or run >= least:
                    held = value
                out.append((group[0], o, held))
            yield pd.DataFrame(out, columns=[key, "o", "steady"])
        if held is not None:
            state.update((held, value, run))
            if expire_ms is not None:
                state.setTimeoutDuration(expire_ms)

    kind = frames.schema[key].dataType.simpleString()
    rows = frames.select(key, F.col(order).cast("long").alias("o"), F.coalesce(F.col(flag), F.lit(False)).alias("f")).dropna()
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, o long, steady boolean", "held boolean, value boolean, run int", "append", _timer(expire_ms))
