"""Session settings, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(app: str = "pitchloom", cpus: str = "8", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PITCHLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the session's ``spark.checkpoint.dir``; a temporary
    folder only when the session runs on one machine (``local[...]``) and names none."""
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if named:
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="pitchloom-checkpoint-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the files, so that
    later steps neither recompute it nor depend on an executor that may be lost."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables; a file or a folder of files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, key: str) -> DataFrame:
    """Rows delivered again under the same key count once. They carry the same content,
    so a distinct over the columns the caller has projected is enough; for tables whose
    load time may differ, project it away first. Null keys are kept apart as rows."""
    return df.dropDuplicates([key]) if key in df.columns else df.distinct()


def few_rows(df: DataFrame, most: int, what: str) -> list:
    """All rows of a parameter table on the driver; more than ``most`` are an error, never cut off."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}")
    return rows


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate, used to decide whether a side may be broadcast."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def maybe_broadcast(df: DataFrame, limit_bytes: int = 8 << 20) -> DataFrame:
    """Hint a broadcast only when the estimated size is within ``limit_bytes``; beyond it
    the planner is left to shuffle."""
    return F.broadcast(df) if estimated_bytes(df) <= limit_bytes else df


def shuffled(df: DataFrame) -> DataFrame:
    """A join side that grows with the input: both sides are shuffled and merged, so its rows
    never pass through the driver. Estimates rest on compressed files and would let the
    planner, or AQE at run time, broadcast several such tables, each many times its estimate."""
    return df.hint("merge")
