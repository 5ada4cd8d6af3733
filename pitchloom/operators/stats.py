"""Estimators and diagnostics as aggregations; only small results reach the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchloom.operators.ranking import cumulate


def auc(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """(by, auc) by the rank-sum with average ranks of ties. Scores are counted first, so the
    running sums are over distinct scores, not rows."""
    counts = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, score).agg(F.sum(label).alias("_pos"), F.count(F.lit(1)).alias("_n"))
    ranked = cumulate(counts, by, score, ["_n"]).withColumn("_below", F.col("cum__n") - F.col("_n"))
    ranks = F.sum(F.col("_pos") * (F.col("_below") + (F.col("_n") + 1) / 2))
    p, n = F.sum("_pos"), F.sum("_n")
    return ranked.groupBy(*by).agg(F.try_divide(ranks - p * (p + 1) / 2, p * (n - p)).alias("auc"))


def bins(p: Column, count: int) -> Column:
    """0..count-1 for probabilities, the last bin closed."""
    return F.least(F.floor(p * count), F.lit(count - 1))


def calibration(df: DataFrame, p: str, y: str, count: int) -> DataFrame:
    """(bin, n, mean_p, mean_y)."""
    return df.groupBy(bins(F.col(p), count).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"))


def murphy(df: DataFrame, p: str, y: str, count: int) -> DataFrame:
    """One row: reliability, resolution, uncertainty, ece, mce."""
    cells = calibration(df, p, y, count)
    one = Window.partitionBy(F.lit(0))  # a row per bin
    joined = cells.withColumns({"total": F.sum("n").over(one), "base": F.sum(F.col("n") * F.col("mean_y")).over(one) / F.sum("n").over(one)})
    gap = F.col("mean_p") - F.col("mean_y")
    weight = F.col("n") / F.col("total")
    return joined.agg(
        F.sum(weight * gap * gap).alias("reliability"),
        F.sum(weight * F.pow(F.col("mean_y") - F.col("base"), 2)).alias("resolution"),
        F.first(F.col("base") * (1 - F.col("base"))).alias("uncertainty"),
        F.sum(weight * F.abs(gap)).alias("ece"),
        F.max(F.abs(gap)).alias("mce"),
    )


def within_effect(df: DataFrame, y: str, x: str, unit: list[str], cluster: str, by: list[str]) -> DataFrame:
    """(by, beta, se, n): y on x with the unit absorbed, clustered sandwich without small-sample
    factor. Two aggregations and one window; scores are summed per cluster first."""
    rows = df.dropna(subset=[y, x])
    w = Window.partitionBy(*by, *unit)
    rows = rows.withColumns({"_y": F.col(y) - F.avg(y).over(w), "_x": F.col(x) - F.avg(x).over(w)})
    per = rows.groupBy(*by, cluster).agg(F.sum(F.col("_x") * F.col("_y")).alias("xy"), F.sum(F.col("_x") * F.col("_x")).alias("xx"), F.count(F.lit(1)).alias("m"))
    # sum over clusters of (xy - beta xx)^2 without a second pass
    agg = per.groupBy(*by).agg(
        F.sum("xy").alias("sxy"), F.sum("xx").alias("sxx"), F.sum(F.col("xy") * F.col("xy")).alias("a"), F.sum(F.col("xy") * F.col("xx")).alias("b"), F.sum(F.col("xx") * F.col("xx")).alias("c"), F.sum("m").alias("n")
    )
    beta = F.try_divide("sxy", "sxx")
    meat = F.col("a") - 2 * beta * F.col("b") + beta * beta * F.col("c")
    return agg.select(*by, beta.alias("beta"), F.try_divide(F.sqrt(F.greatest(meat, F.lit(0.0))), "sxx").alias("se"), "n")


def smd(df: DataFrame, treated: str, covariates: list[str]) -> DataFrame:
    """(covariate, smd): difference of means over the pooled population deviation."""
    long = df.select(F.col(treated).alias("_t"), *[F.col(c).cast("double").alias(c) for c in covariates]).unpivot(["_t"], covariates, "covariate", "v")
    m = lambda t: F.avg(F.when(F.col("_t") == t, F.col("v")))
    v = lambda t: F.var_pop(F.when(F.col("_t") == t, F.col("v")))
    return long.groupBy("covariate").agg(F.try_divide(m(1) - m(0), F.nullif(F.sqrt((v(1) + v(0)) / 2), F.lit(0.0))).alias("smd"))


def local_linear_jump(df: DataFrame, x: str, y: str, cut: float, width: float) -> DataFrame:
    """One row: the jump of y at ``cut`` between two local lines, triangular kernel."""
    d = F.col(x) - cut
    rows = df.dropna(subset=[x, y]).where(F.abs(d) < width).select(d.alias("d"), F.col(y).alias("y"), (1 - F.abs(d) / width).alias("w"), (d >= 0).alias("right"))
    k, dd, yy = F.col("w"), F.col("d"), F.col("y")
    sides = rows.groupBy("right").agg(F.sum(k).alias("s0"), F.sum(k * dd).alias("s1"), F.sum(k * dd * dd).alias("s2"), F.sum(k * yy).alias("t0"), F.sum(k * dd * yy).alias("t1"), F.count(F.lit(1)).alias("n"))
    at = F.try_divide(F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1"), F.nullif(F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1"), F.lit(0.0)))
    return sides.agg((F.max(F.when(F.col("right"), at)) - F.max(F.when(~F.col("right"), at))).alias("jump"), F.sum("n").alias("n"))


def shrink(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, mean, shrunk): empirical-Bayes means of a normal random effect, with the
    variances by the method of moments (one-way analysis of variance)."""
    g = df.dropna(subset=[value]).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"))
    n, mean = F.col("n"), F.col("mean")
    one = lambda c: g.agg(c).scalar()
    j = g.withColumns({"total": one(F.sum("n")), "k": one(F.count(F.lit(1))), "n2": one(F.sum(n * n)), "grand": one(F.sum(n * mean) / F.sum("n")), "ssw": one(F.sum((n - 1) * F.col("v"))), "q": one(F.sum(n * mean * mean))})
    within = F.try_divide("ssw", F.col("total") - F.col("k"))
    between = F.try_divide(F.try_divide(F.col("q") - F.col("total") * F.col("grand") * F.col("grand"), F.col("k") - 1) - within, F.try_divide(F.col("total") - F.try_divide("n2", "total"), F.col("k") - 1))
    tau = F.greatest(between, F.lit(0.0))
    weight = F.coalesce(F.try_divide(tau, tau + within / n), F.lit(0.0))
    return j.select(group, "n", "mean", (F.col("grand") + weight * (mean - F.col("grand"))).alias("shrunk"))


def icc(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: intraclass correlation of a one-way layout and the design effect."""
    g = df.dropna(subset=[value]).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"))
    n, mean = F.col("n"), F.col("mean")
    one = g.agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("k"), F.sum(n * n).alias("n2"), F.sum(n * mean).alias("s"), F.sum((n - 1) * F.col("v")).alias("ssw"), F.sum(n * mean * mean).alias("q"))
    msw = F.col("ssw") / (F.col("N") - F.col("k"))
    msb = (F.col("q") - F.col("s") * F.col("s") / F.col("N")) / (F.col("k") - 1)
    n0 = (F.col("N") - F.col("n2") / F.col("N")) / (F.col("k") - 1)
    rho = (msb - msw) / (msb + (n0 - 1) * msw)
    return one.select(rho.alias("icc"), (1 + (F.col("N") / F.col("k") - 1) * rho).alias("design_effect"))


def ks_distance(df: DataFrame, sample: str, value: str, a: object, b: object) -> DataFrame:
    """One row: largest gap between the two samples' distribution functions."""
    counts = df.dropna(subset=[value]).groupBy(value).agg(F.count_if(F.col(sample) == a).alias("na"), F.count_if(F.col(sample) == b).alias("nb"))
    cum = cumulate(counts, [], value, ["na", "nb"])
    top = cum.agg(F.max("cum_na").alias("ta"), F.max("cum_nb").alias("tb"))
    share = lambda c, t: F.try_divide(F.col(c), top.select(t).scalar())
    return cum.agg(F.max(F.abs(share("cum_na", "ta") - share("cum_nb", "tb"))).alias("ks"))


def split_rhat(df: DataFrame, by: list[str], chain: str, order: str, value: str) -> DataFrame:
    """(by, rhat, ess): chains cut into halves by ``order``; ess by the ratio of the variances
    within and between the halves, at most the number of draws."""
    half = F.ntile(2).over(Window.partitionBy(*by, chain).orderBy(order)).alias("_half")
    c = df.select(*by, chain, F.col(value).alias("_v"), half).groupBy(*by, chain, "_half").agg(F.avg("_v").alias("m"), F.var_samp("_v").alias("v"), F.count(F.lit(1)).alias("n"))
    n, within, between = F.avg("n"), F.avg("v"), F.var_samp("m")
    return c.groupBy(*by).agg(F.sqrt(((n - 1) / n * within + between) / within).alias("rhat"), F.least(F.sum("n") * within / (within + n * between), F.sum("n").cast("double")).alias("ess"))


def robustness_value(t: Column, dof: Column) -> Column:
    """Closed form: strength a confounder would need to explain the estimate away."""
    f2 = t * t / dof
    return 0.5 * (F.sqrt(f2 * f2 + 4 * f2) - f2)
