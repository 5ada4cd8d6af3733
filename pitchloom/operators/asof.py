"""As-of lookups and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], on: str, carry: list[str], default: object = None) -> DataFrame:
    """``left`` with the ``carry`` values of the last right row of the same ``by`` whose ``on``
    is not later (equality included); ``default`` where there is none.

    One union, one shuffle, one sort: right rows sort before left ones of equal time and
    their values are carried forward. Left rows with null keys or a null time keep the
    default; right rows with nulls there are ignored. Of right rows of equal time the one
    with the largest carried values counts.
    """
    lcols = left.columns
    keyed = right.dropna(subset=[*by, on]).select(*by, on, F.struct(*carry).alias("_carry"))
    both = left.withColumn("_right", F.lit(False)).unionByName(keyed.withColumn("_right", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(F.col(on).asc_nulls_first(), F.desc("_right"), F.col("_carry").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = both.withColumn("_last", F.last("_carry", ignorenulls=True).over(w)).where(~F.col("_right"))
    usable = F.col(on).isNotNull()
    for b in by:
        usable = usable & F.col(b).isNotNull()
    value = lambda c: F.when(usable, F.col(f"_last.{c}"))
    return got.select(*lcols, *[(F.coalesce(value(c), F.lit(default)) if default is not None else value(c)).alias(c) for c in carry])


def interval_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, closed_end: bool = True) -> DataFrame:
    """Points inside spans of the same keys: an equi-join with a residual range condition.
    Beside the keys the two tables have no column in common."""
    other = {k: f"_span_{k}" for k in keys}
    spans = spans.withColumnsRenamed(other)
    inside = (F.col(at) >= F.col(start)) & ((F.col(at) <= F.col(end)) if closed_end else (F.col(at) < F.col(end)))
    for k, renamed in other.items():
        inside = inside & (F.col(k) == F.col(renamed))
    return points.join(spans, inside).drop(*other.values())


def window_contrast(anchors: DataFrame, values: DataFrame, anchor: str, at: str, match: list[str], unit: str, time: str, value: str, width: float, fill: float | None = 0.0, how: str = "sum") -> DataFrame:
    """(anchor, unit, member_pre, member_post): ``how`` (sum, avg, max) of the values in
    [t - width, t) and [t, t + width].

    The members of a block are the units with any value in it (``match`` should hold the
    period, so that stoppage time doesn't leak); without a value in a window they get
    ``fill``. Values meet anchors in an equi-join on the match and a time bucket of the
    width, so an anchor only meets the values of three buckets, however long a match is.
    """
    slot = F.floor(F.col(time) / width)
    near = anchors.select(*match, anchor, at, F.explode(F.sequence(F.floor((F.col(at) - width) / width), F.floor((F.col(at) + width) / width))).alias("_slot"))
    joined = near.join(values.select(*match, unit, time, value, slot.alias("_slot")), [*match, "_slot"])
    gap = F.col(time) - F.col(at)
    fold = {"sum": F.sum, "avg": F.avg, "max": F.max}[how]
    inside = joined.where(gap.between(-width, width)).groupBy(anchor, unit).agg(fold(F.when(gap < 0, F.col(value))).alias("member_pre"), fold(F.when(gap >= 0, F.col(value))).alias("member_post"))
    members = anchors.select(*match, anchor).join(values.select(*match, unit).distinct(), match).select(anchor, unit).distinct()
    both = members.join(inside, [anchor, unit], "left")
    return both if fill is None else both.fillna(fill, ["member_pre", "member_post"])


def clip(x: Column, low: object, high: object) -> Column:
    """Null stays null (``least`` and ``greatest`` alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))
