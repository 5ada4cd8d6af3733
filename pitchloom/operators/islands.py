"""Gaps and islands: segments, run-length events and debouncing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segment_id(breaks: Column, keys: list[str], order: list[str]) -> Column:
    """Number of the segment a row is in; a true (non-null) ``breaks`` starts the next one."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.sum(F.when(breaks, 1).otherwise(0)).over(w)


def runs(df: DataFrame, keys: list[str], order: list[str], flag: str) -> DataFrame:
    """Adds run_no and pos_in_run of equal neighbouring values of ``flag``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = ~F.col(flag).eqNullSafe(F.lag(flag).over(w)) | (F.row_number().over(w) == 1)
    out = df.withColumn("_c", changed).withColumn("run_no", segment_id(F.col("_c"), keys, order))
    return out.withColumn("pos_in_run", F.row_number().over(Window.partitionBy(*keys, "run_no").orderBy(*order))).drop("_c")


def debounce(df: DataFrame, keys: list[str], order: list[str], flag: str, frames: int, out: str) -> DataFrame:
    """``flag`` as a state that flips only after ``frames`` equal values in a row; it starts as
    the first value."""
    marked = runs(df, keys, order, flag)
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steady = F.last(F.when(F.col("pos_in_run") >= frames, F.col(flag)), ignorenulls=True).over(upto)
    return marked.withColumn(out, F.coalesce(steady, F.first(flag).over(upto))).drop("run_no", "pos_in_run")


def run_events(df: DataFrame, keys: list[str], order: str, hot: Column, least: int, merge_gap: int) -> DataFrame:
    """(keys, event_start, event_end) of stretches where ``hot`` holds for ``least`` units of
    ``order``; stretches less than ``merge_gap`` apart are one."""
    rows = runs(df.withColumn("_hot", F.coalesce(hot, F.lit(False))), keys, [order], "_hot").where("_hot")
    spans = rows.groupBy(*keys, "run_no").agg(F.min(order).alias("s"), F.max(order).alias("e"))
    w = Window.partitionBy(*keys).orderBy("s")
    apart = spans.withColumn("_new", F.coalesce(F.col("s") - F.lag("e").over(w) >= merge_gap, F.lit(True)))
    merged = apart.withColumn("_ev", segment_id(F.col("_new"), keys, ["s"])).groupBy(*keys, "_ev").agg(F.min("s").alias("event_start"), F.max("e").alias("event_end"))
    return merged.where(F.col("event_end") - F.col("event_start") + 1 >= least).drop("_ev")
