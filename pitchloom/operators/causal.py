"""Resampling, cross-fitting and effect estimators as aggregations over cells and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: distribution function of a Poisson(1) count ---
POISSON = (0.36787944, 0.73575888, 0.9196986, 0.98101184, 0.99634015)
# --- end of fixed values ---


def md5_uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts only, the same in any engine."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / float(1 << 32)


def poisson_weight(u: Column) -> Column:
    out = F.when(u < POISSON[0], 0)
    for k, bound in enumerate(POISSON[1:], 1):
        out = out.when(u < bound, k)
    return out.otherwise(len(POISSON)).cast("long")


def bootstrap_ratio(clusters: DataFrame, by: list[str], cluster: str, top: str, bottom: str, draws: int) -> DataFrame:
    """(by, estimate, se): sum(top) / sum(bottom) over clusters and its deviation over ``draws``
    Poisson bootstraps. Clusters are sums already, so a draw costs a row per cluster; weights
    come from hashes, so any task draws the same ones."""
    each = clusters.select(*by, cluster, top, bottom, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("_draw"))
    w = poisson_weight(md5_uniform(F.col(cluster), F.col("_draw")))
    drawn = each.groupBy(*by, "_draw").agg(F.try_divide(F.sum(w * F.col(top)), F.sum(w * F.col(bottom))).alias("_e"))
    spread = drawn.groupBy(*by).agg(F.stddev_samp("_e").alias("se"))
    point = clusters.groupBy(*by).agg(F.try_divide(F.sum(top), F.sum(bottom)).alias("estimate"))
    return point.join(spread, by)


def cross_fitted(df: DataFrame, cells: list[str], group: str, folds: int, means: dict[str, tuple[str, Column | None]]) -> DataFrame:
    """Adds out-of-fold cell means: ``means`` maps a new column to (value, condition). The mean
    of a cell without the row's own fold is a difference of sums, so cells are aggregated
    once per fold and nothing is fitted in a loop. Cells seen in one fold only get null."""
    rows = df.withColumn("_fold", F.floor(md5_uniform(F.col(group)) * folds))
    sums = []
    for name, (value, cond) in means.items():
        y = F.col(value) if cond is None else F.when(cond, F.col(value))
        sums += [F.sum(y).alias(f"_s_{name}"), F.count(y).alias(f"_n_{name}")]
    per = rows.groupBy(*cells, "_fold").agg(*sums)
    w = Window.partitionBy(*cells)  # a row per fold
    out = per.select(*cells, "_fold", *[F.try_divide(F.sum(f"_s_{m}").over(w) - F.coalesce(f"_s_{m}", F.lit(0.0)), F.sum(f"_n_{m}").over(w) - F.col(f"_n_{m}")).alias(m) for m in means])
    return rows.join(out, [*cells, "_fold"]).drop("_fold")


def partially_linear(df: DataFrame, y: str, t: str, cells: list[str], group: str, by: list[str], folds: int = 5) -> DataFrame:
    """(by, theta, se, n): residual on residual with cross-fitted cell means, errors clustered by group."""
    r = cross_fitted(df, cells, group, folds, {"_my": (y, None), "_mt": (t, None)}).dropna(subset=["_my", "_mt"])
    r = r.select(*by, group, (F.col(y) - F.col("_my")).alias("_ry"), (F.col(t) - F.col("_mt")).alias("_rt"))
    per = r.groupBy(*by, group).agg(F.sum(F.col("_rt") * F.col("_ry")).alias("_a"), F.sum(F.col("_rt") * F.col("_rt")).alias("_b"), F.count(F.lit(1)).alias("_m"))
    a, b = F.col("_a"), F.col("_b")
    one = per.groupBy(*by).agg(F.sum(a).alias("_A1"), F.sum(b).alias("_B1"), F.sum(a * a).alias("_aa"), F.sum(a * b).alias("_ab"), F.sum(b * b).alias("_bb"), F.sum("_m").alias("n"))
    theta = F.try_divide("_A1", "_B1")
    meat = F.greatest(F.col("_aa") - 2 * theta * F.col("_ab") + theta * theta * F.col("_bb"), F.lit(0.0))
    return one.select(*by, theta.alias("theta"), F.try_divide(F.sqrt(meat), "_B1").alias("se"), "n")


def att_scores(df: DataFrame, y: str, t: str, cells: list[str], group: str, folds: int = 5, trim: float = 0.01) -> DataFrame:
    """Adds psi, whose sum over the sum of t is the effect on the treated: doubly robust scores
    with cross-fitted cell means; rows of cells without untreated rows elsewhere fall out."""
    r = cross_fitted(df, cells, group, folds, {"_m0": (y, F.col(t) == 0), "_e": (t, None)}).dropna(subset=["_m0", "_e"])
    e, gap = F.greatest(F.least("_e", F.lit(1 - trim)), F.lit(trim)), F.col(y) - F.col("_m0")
    return r.withColumn("psi", F.col(t) * gap - (1 - F.col(t)) * e / (1 - e) * gap).drop("_m0", "_e")
