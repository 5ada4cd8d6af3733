"""Scalar expressions: geometry, probabilities, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: metres; the pitch's half length and the half width of a goal
HALF_LENGTH, HALF_GOAL = 52.5, 3.66
# --- fixed values: energy cost of running by slope (polynomial, highest power first), grass factor, gravity ---
RUNNING_COST, GRASS, GRAVITY = (155.4, -30.4, -43.3, 46.3, 19.5, 3.6), 1.29, 9.81
# --- end of fixed values ---
#: lower bounds of the percentile tiers
TIERS = ((0.95, "S"), (0.85, "A"), (0.60, "B"), (0.40, "C"), (0.15, "D"))


def flip(x: Column, when: Column) -> Column:
    """Mirrored coordinate for sides that attack the other way."""
    return F.when(when, -x).otherwise(x)


def goal_distance(x: Column, y: Column) -> Column:
    return F.hypot(F.lit(HALF_LENGTH) - x, y)


def goal_angle(x: Column, y: Column) -> Column:
    return F.atan2(y, F.lit(HALF_LENGTH) - x)


def goal_aperture(x: Column, y: Column) -> Column:
    """Angle between the posts by the cosine rule."""
    a, b = F.hypot(HALF_LENGTH - x, HALF_GOAL - y), F.hypot(HALF_LENGTH - x, -HALF_GOAL - y)
    cosine = (a * a + b * b - (2 * HALF_GOAL) ** 2) / (2 * a * b + 1e-8)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def in_triangle(x: Column, y: Column, p: tuple, q: tuple, r: tuple) -> Column:
    """By the signs of three cross products; the border belongs to the triangle."""

    def side(a: tuple, b: tuple) -> Column:
        return (x - b[0]) * (a[1] - b[1]) - (a[0] - b[0]) * (y - b[1])

    signs = [side(p, q), side(q, r), side(r, p)]
    negative, positive = F.lit(False), F.lit(False)
    for s in signs:
        negative, positive = negative | (s < 0), positive | (s > 0)
    return ~(negative & positive)


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def poisson_outcome(df: DataFrame, key: str, mean_a: str, mean_b: str, below: int) -> DataFrame:
    """(key, win, draw, loss) of two independent truncated Poisson scores, renormalised."""
    cells = df.select(key, mean_a, mean_b, F.explode(F.sequence(F.lit(0), F.lit(below - 1))).alias("_i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(below - 1))).alias("_j"))
    pmf = lambda m, k: F.exp(-F.col(m)) * F.pow(F.col(m), F.col(k)) / F.factorial(k)
    cells = cells.withColumn("_p", pmf(mean_a, "_i") * pmf(mean_b, "_j"))
    part = lambda cond: F.sum(F.when(cond, F.col("_p")).otherwise(0.0)) / F.sum("_p")
    i, j = F.col("_i"), F.col("_j")
    return cells.groupBy(key).agg(part(i > j).alias("win"), part(i == j).alias("draw"), part(i < j).alias("loss"))


def tier(percentile: Column) -> Column:
    out = F.when(percentile.isNull(), None)
    for bound, label in TIERS:
        out = out.when(percentile >= bound, label)
    return out.otherwise("E")


def temperature(probabilities: list[Column], t: float) -> list[Column]:
    """softmax(log p / T) of class probabilities."""
    powered = [F.exp(F.ln(p) / t) for p in probabilities]
    total = sum(powered[1:], powered[0])
    return [p / total for p in powered]


def one_hot(value: Column, label: str) -> Column:
    """1 where the value is the label, else 0; null counts as another value."""
    return F.coalesce((value == label).cast("long"), F.lit(0))


def attack_side(period: Column, home_left_first: Column) -> Column:
    """The side from which the home team plays: it changes with every period."""
    return F.when((period % 2 == 1) == home_left_first, "L").otherwise("R")


def week_index(week: Column, weeks: int) -> Column:
    """0 for the first week to 1 for the last; unknown weeks count as the first."""
    return F.coalesce(F.when(week.isNotNull(), F.greatest(F.least(week, F.lit(weeks)), F.lit(1)) - 1) / float(weeks - 1), F.lit(0.0))


def grid_cell(x: Column, half: float, width: float, cells: int) -> Column:
    """0..cells-1, positions outside in the outermost cells."""
    return F.greatest(F.least(F.floor((x + half) / width), F.lit(cells - 1)), F.lit(0))


def freeze_frame(opponents: Column, x: Column, y: Column, near: float, none: float) -> Column:
    """struct(close_by, nearest, ahead): opponents within ``near`` of the spot, the nearest one's
    distance (``none`` if there is nobody) and those further up the pitch."""
    seen = F.filter(opponents, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    far = F.transform(seen, lambda p: F.sqrt((p["x"] - x) * (p["x"] - x) + (p["y"] - y) * (p["y"] - y)))
    size = lambda a: F.coalesce(F.size(a), F.lit(0))
    some = lambda a: F.when(a.isNotNull(), size(a)).otherwise(0)
    return F.struct(some(F.filter(far, lambda v: v <= near)).alias("close_by"), F.coalesce(F.array_min(far), F.lit(none)).alias("nearest"), some(F.filter(seen, lambda p: p["x"] > x)).alias("ahead"))


def metabolic_power(speed: Column, acceleration: Column) -> Column:
    """W/kg of running on grass by the cost of running uphill at the equivalent slope, never negative."""
    a = acceleration / GRAVITY
    cost = F.lit(0.0)
    for k, c in enumerate(RUNNING_COST):
        cost = cost + c * F.pow(a, F.lit(len(RUNNING_COST) - 1 - k))
    return F.greatest(cost * F.sqrt(a * a + 1) * GRASS * speed, F.lit(0.0))


def significance(p: Column, sure: float, likely: float) -> Column:
    """What the probability of a positive effect says about its sign."""
    out = F.when(p >= sure, "positive").when(p <= round(1 - sure, 9), "negative")
    return out.when(p >= likely, "likely positive").when(p <= round(1 - likely, 9), "likely negative").when(p.isNotNull(), "unclear")
