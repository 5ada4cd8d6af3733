"""Ranks, percentiles, top-k and multiple-testing adjustment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchloom.session import cut, maybe_broadcast


def ordinal_rank(value: str, tie: list[str], group: list[str] | None = None, descending: bool = True) -> Column:
    """1, 2, 3 ... by value, ties by ``tie``; null values get no rank and push nobody."""
    order = F.desc_nulls_last(value) if descending else F.asc_nulls_last(value)
    return F.when(F.col(value).isNotNull(), F.row_number().over(Window.partitionBy(*(group or [F.lit(0)])).orderBy(order, *tie)))


def percentile_ordinal(value: str, tie: list[str], group: list[str]) -> Column:
    """Ascending ordinal rank over the count of non-null values of the group."""
    return ordinal_rank(value, tie, group, False) / F.count(value).over(Window.partitionBy(*group))


def percentile_average(value: str, group: list[str]) -> Column:
    """Average rank of ties over the count of non-null values (not ``percent_rank``)."""
    by = Window.partitionBy(*group).orderBy(F.asc_nulls_last(value))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*group, value))
    return F.when(F.col(value).isNotNull(), (F.rank().over(by) + (ties - 1) / 2) / F.count(value).over(Window.partitionBy(*group)))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank_in_group") -> DataFrame:
    """First ``n`` rows per group; the planner prunes before the shuffle (WindowGroupLimit)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def cumulate(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Adds cum_<column>, the sum up to and with the row, to rows that are unique in (keys, order).

    No key is gathered in one task: the rows are range-partitioned, sums run inside the parts
    and are carried over from part to part by one row a part and key. Null keys are keys."""
    rows = cut(df.repartitionByRange(*keys, order).withColumn("_part", F.spark_partition_id()))
    parts = rows.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_m_{c}") for c in columns])
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    names = {c: f"_k_{c}" for c in [*keys, "_part"]}
    parts = parts.select(*[F.col(c).alias(n) for c, n in names.items()], *[F.coalesce(F.sum(f"_m_{c}").over(earlier), F.lit(0)).alias(f"_b_{c}") for c in columns])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    inside = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(maybe_broadcast(parts), same).select(*df.columns, *[(F.sum(c).over(inside) + F.col(f"_b_{c}")).alias(f"cum_{c}") for c in columns])


def bh_adjust(df: DataFrame, p: str, family: list[str], tie: list[str], out: str) -> DataFrame:
    """Benjamini-Hochberg: running minimum from the largest p down of p * n / rank, at most 1.

    Rows of equal p get the value of the last of them, so the order of ``tie`` among them has
    no effect. A family is never gathered in one task: it is counted by distinct p, the distinct
    values are range-partitioned, and ranks and minima run inside the parts and are carried
    over from part to part by one row a part and family."""
    keys = [f"_f{k}" for k in range(len(family))]
    counts = df.where(F.col(p).isNotNull()).groupBy(*[F.col(f).alias(k) for f, k in zip(family, keys)], F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    counts = cut(counts.repartitionByRange(*keys, "_p").withColumn("_part", F.spark_partition_id()))

    def carried(ranked: DataFrame, more: DataFrame) -> DataFrame:
        """Null families are families, so the join takes nulls as equal."""
        more = more.withColumnsRenamed({c: f"{c}_m" for c in [*keys, "_part"]})
        return ranked.join(more, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"{c}_m")) for c in [*keys, "_part"]]))

    by_part = Window.partitionBy(*keys).orderBy("_part")
    parts = counts.groupBy(*keys, "_part").agg(F.sum("_c").alias("_m"))
    parts = parts.select(*keys, "_part", F.sum("_m").over(Window.partitionBy(*keys)).alias("_n"), F.coalesce(F.sum("_m").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_part").orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    raw = carried(counts, parts).withColumn("_raw", F.col("_p") * F.col("_n") / (F.col("_before") + F.sum("_c").over(inside)))
    raw = cut(raw.select(*keys, "_p", "_part", "_raw"))
    later = raw.groupBy(*keys, "_part").agg(F.min("_raw").alias("_m"))
    later = later.select(*keys, "_part", F.min("_m").over(by_part.rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    down = Window.partitionBy(*keys, "_part").orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    adjusted = carried(raw, later).select(*keys, "_p", F.least(F.min("_raw").over(down), "_later", F.lit(1.0)).alias("_adj"))
    adjusted = maybe_broadcast(cut(adjusted))
    same = reduce(Column.__and__, [F.col(f).eqNullSafe(F.col(k)) for f, k in zip(family, keys)], F.col(p) == F.col("_p"))
    return df.join(adjusted, same, "left").select(*df.columns, F.col("_adj").alias(out))


def z_score(value: str, group: list[str], limit: float | None = None) -> Column:
    """(x - mean) / sample deviation within the group; 0 where that isn't defined."""
    w = Window.partitionBy(*group)
    z = F.coalesce(F.try_divide(F.col(value) - F.avg(value).over(w), F.nullif(F.stddev_samp(value).over(w), F.lit(0.0))), F.lit(0.0))
    return z if limit is None else F.greatest(F.least(z, F.lit(limit)), F.lit(-limit))
