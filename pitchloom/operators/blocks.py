"""Contrasts of a member with the rest of its block, and dense grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def others_mean(value: str, block: list[str]) -> Column:
    """Mean of the block without the row itself: (total - self) / (n - 1); null for n = 1.
    A null value counts as 0 in the total and as a member in n."""
    w = Window.partitionBy(*block)
    own = F.coalesce(F.col(value), F.lit(0.0))
    n = F.count(F.lit(1)).over(w)
    return F.when(n > 1, (F.sum(own).over(w) - own) / (n - 1))


def leave_one_out(df: DataFrame, block: list[str], pre: str = "member_pre", post: str = "member_post") -> DataFrame:
    """Adds delta_player, delta_team_loo and delta_relative to a pre/post table."""
    out = df.withColumns({"loo_pre": others_mean(pre, block), "loo_post": others_mean(post, block)})
    return out.withColumns({"delta_player": F.col(post) - F.col(pre), "delta_team_loo": F.col("loo_post") - F.col("loo_pre")}).withColumn("delta_relative", F.col("delta_player") - F.col("delta_team_loo"))


def on_grid(df: DataFrame, block: list[str], member: str, position: str, values: list[str], fill: float | None = 0.0) -> DataFrame:
    """The members of each block times the positions where any of them has a row, with the
    values of ``df`` (one row per block, member and position) where it has them. Members and
    positions meet in an equi-join on the block, so a block without a row has none here."""
    keys = [*block, member]
    grid = df.select(*keys).distinct().join(df.select(*block, position).distinct(), block)
    got = grid.join(df.select(*keys, position, *values), [*keys, position], "left")
    return got if fill is None else got.fillna(fill, values)
