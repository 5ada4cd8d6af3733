"""Implausible readings by an undecimated wavelet decomposition per source.

The decomposition is a lifting scheme on the readings as they lie: each one is predicted from
its neighbours (a weighted mean, or a weighted line for things that move) and its detail
coefficient is what the prediction leaves over. Coefficients that stand out in their own
series don't enter the approximation (wavelet shrinkage, repeated until nothing changes), so
the neighbours of a spike aren't blamed for it. What is left is judged by the spread of the
source's own coefficients: a large coefficient is a spike, a run in which the finest ones (the
differences of neighbours) vanish is a stuck sensor, and bounds tell what is impossible
whatever the source. The coefficients alone decide about spikes.

A series is read in order by one pass over sorted partitions, in Arrow batches; only the
source's scale and level come from an aggregation, which merges sketches map-side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchloom.session import maybe_broadcast

MAD_TO_SIGMA = 1.4826
#: Relative rank error of the medians is 1 / MEDIAN_ACCURACY; partial results merge, so a hot source is aggregated map-side.
MEDIAN_ACCURACY = 5000
#: Passes of the shrinkage at most; each takes out the causes among the large coefficients.
PASSES = 6
#: A smooth that differs from its source's level by less than so many of its own errors is taken as the level.
LEVEL_K = 3.0


@dataclass(frozen=True)
class Limits:
    """What counts as implausible.

    lower, upper: physical bounds of every coordinate. stuck_len readings in a row within
    stuck_tol of each other are stuck. A detail beyond detail_k robust sigmas of its source's
    details (and at least min_jump) is a spike. A reading is predicted from ``reach``
    neighbours on either side: by their mean, moved to the source's level where it doesn't
    clearly differ from it, or (``moving``) by a line through them; readings more than
    ``max_gap`` apart in the order don't belong to one series.
    """

    lower: float
    upper: float
    stuck_len: int
    stuck_tol: float
    detail_k: float = 5.0
    min_jump: float = 0.0
    reach: int = 8
    moving: bool = False
    max_gap: float | None = None


def _neighbours(series: np.ndarray, reach: int) -> Iterator[tuple[int, slice, slice, np.ndarray]]:
    """(offset, own rows, neighbour rows, whether both are of one series)."""
    n = len(series)
    for o in range(1, min(reach, n - 1) + 1):
        same = series[o:] == series[:-o]
        yield o, slice(0, n - o), slice(o, n), same
        yield -o, slice(o, n), slice(0, n - o), same


def predict(series: np.ndarray, t: np.ndarray, v: np.ndarray, good: np.ndarray, reach: int, moving: bool) -> tuple[np.ndarray, np.ndarray]:
    """(prediction, weight of the neighbours used); NaN where a reading has no good neighbour."""
    n, dims = v.shape
    s0, s1, s2 = np.zeros(n), np.zeros(n), np.zeros(n)
    x0, x1 = np.zeros((n, dims)), np.zeros((n, dims))
    for o, own, other, same in _neighbours(series, reach):
        w = np.where(same & good[other], 1 - abs(o) / (reach + 1) if moving else 1.0, 0.0)
        u = t[other] - t[own] if moving else None
        s0[own] += w
        x0[own] += w[:, None] * v[other]
        if moving:
            u = np.where(w > 0, u, 0.0)
            s1[own] += w * u
            s2[own] += w * u * u
            x1[own] += (w * u)[:, None] * v[other]
    with np.errstate(divide="ignore", invalid="ignore"):
        out = x0 / s0[:, None]
        if moving:
            det = s0 * s2 - s1 * s1
            line = (s2[:, None] * x0 - s1[:, None] * x1) / det[:, None]
            out = np.where((det > 1e-9 * s0 * s2)[:, None] & (s2 > 0)[:, None], line, out)
    return out, s0


def _series_median(series: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Lower median of the finite values of each series, for every reading of it."""
    finite = np.isfinite(w)
    out = np.zeros(len(w))
    if not finite.any():
        return out
    starts = np.concatenate(([True], series[1:] != series[:-1]))
    number = np.cumsum(starts) - 1
    rows = np.flatnonzero(finite)
    order = rows[np.lexsort((w[rows], number[rows]))]
    names, first, count = np.unique(number[order], return_index=True, return_counts=True)
    middle = np.zeros(number[-1] + 1)
    middle[names] = w[order[first + (count - 1) // 2]]
    return middle[number]


def details(series: np.ndarray, t: np.ndarray, v: np.ndarray, good: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(detail coefficients, approximation, weight of the neighbours, readings that the
    shrinkage has left in the approximation)."""
    good = good.copy()
    # the finest details tell the spread of what rests best: a short displaced run has only two large ones
    step = np.full(len(v), np.nan)
    if not limits.moving and len(v) > 1:
        both = (series[1:] == series[:-1]) & good[1:] & good[:-1]
        step[1:] = np.where(both, np.sqrt(((v[1:] - v[:-1]) ** 2).sum(axis=1)) / 2**0.5, np.nan)
    for _ in range(PASSES):
        smooth, weight = predict(series, t, v, good, limits.reach, limits.moving)
        size = np.sqrt(((v - smooth) ** 2).sum(axis=1))
        spread = _series_median(series, np.where(good, size, np.nan) if limits.moving else step)
        bar = np.maximum(limits.detail_k * MAD_TO_SIGMA * spread, limits.min_jump)
        large = good & (size > bar)
        if not large.any():
            break
        # a displaced reading moves the predictions of its neighbours by a small share of its own
        # coefficient, so of the large coefficients within reach only those near the largest are causes
        peak = np.where(large, size, -1.0)
        top = peak.copy()
        for _, own, other, same in _neighbours(series, limits.reach):
            np.maximum(top[own], np.where(same, peak[other], -1.0), out=top[own])
        good &= ~(large & (2 * peak >= top))
    smooth, weight = predict(series, t, v, good, limits.reach, limits.moving)
    return v - smooth, smooth, weight, good


def stuck(series: np.ndarray, v: np.ndarray, length: int, tolerance: np.ndarray) -> np.ndarray:
    """Readings of runs of at least ``length`` whose finest details are all (but) zero, unless a
    slow drift adds up beyond the tolerance within so many readings."""
    n = len(series)
    out = np.zeros(n, bool)
    if n < length:
        return out
    zero = np.concatenate(([False], (series[1:] == series[:-1]) & (np.abs(v[1:] - v[:-1]) <= tolerance[1:, None]).all(axis=1)))
    ones = np.cumsum(zero)
    # a stretch of ``length`` readings has length - 1 details
    last = np.flatnonzero(ones[length - 1 :] - ones[: n - length + 1] == length - 1) + length - 1
    if len(last):
        span = last[:, None] - np.arange(length)
        drift = (v[span].max(axis=1) - v[span].min(axis=1) <= tolerance[last][:, None]).all(axis=1)
        out[span[drift].ravel()] = True
    return out


def _decompose(values: list[str], limits: Limits):
    """Sorted Arrow batches to the home readings with _w (coefficient), _c (approximation), _n, _still, _good."""

    def judged(batch: pa.RecordBatch) -> pa.RecordBatch:
        number = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
        series, t = number("_series"), number("_o").astype(float)
        v = np.column_stack([number(c).astype(float) for c in values])
        again = batch.column("_again").to_numpy(zero_copy_only=False)
        fresh = np.concatenate(([True], (again[1:] != again[:-1]) | (series[1:] != series[:-1])))
        batch, series, t, v = batch.filter(pa.array(fresh)), series[fresh], t[fresh], v[fresh]
        usable, home, tol = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_usable", "_at_home", "_tol"))
        if limits.max_gap is not None:
            with np.errstate(invalid="ignore"):
                torn = np.concatenate(([True], (series[1:] != series[:-1]) | (np.diff(t) > limits.max_gap)))
            series = np.cumsum(torn)
        still = stuck(series, v, limits.stuck_len, tol)
        w, smooth, weight, good = details(series, t, v, usable & ~still, limits)
        size = w[:, 0] if len(values) == 1 else np.sqrt((w**2).sum(axis=1))
        pick = np.flatnonzero(home)
        kept = batch.take(pa.array(pick))
        null = lambda a: pa.array(a[pick], mask=~np.isfinite(a[pick]))
        columns = [*kept.columns, null(size), null(smooth[:, 0]), pa.array(weight[pick]), pa.array(still[pick]), pa.array(good[pick])]
        return pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_w", "_c", "_n", "_still", "_good"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            series = batch.column("_series").to_numpy()
            ends = np.flatnonzero(series[1:] != series[:-1])
            if held and held[0].column("_series")[0].as_py() != series[0]:
                yield judged(pa.concat_batches(held))
                held = []
            if not len(ends):
                held.append(batch)
                continue
            at = int(ends[-1]) + 1  # the last series may go on in the next batch
            yield judged(pa.concat_batches([*held, batch.slice(0, at)]))
            held = [batch.slice(at)]
        if held:
            yield judged(pa.concat_batches(held))

    return run


def flag_implausible(
    readings: DataFrame,
    source: list[str],
    segment: list[str],
    order: str,
    key: list[str],
    values: list[str],
    limits: Limits | dict[str, Limits],
    low_exempt: str | None = None,
    block_span: float | None = None,
    halo: float = 0.0,
    kind: str | None = None,
) -> DataFrame:
    """(source, key, values, is_spike, is_stuck, is_impossible) for every reading.

    ``segment`` cuts a source into series that are continuous in ``order``; ``key``
    identifies a reading. With ``block_span`` long series are also cut into blocks of
    that span of ``order``, each with copies of the readings within ``halo`` outside it,
    so that no task has to hold a whole hot source; halo copies only serve as neighbours.
    Several kinds of readings (``kind`` names the column, which should be among the
    source columns) are judged in one pass by a dict of limits; those may differ in
    bounds, stuck_tol, detail_k and min_jump only.

    Nulls and NaN in ``values`` are no readings: they are left out, and a stuck stretch
    goes on across them. Infinite readings are impossible. Readings without a source are
    judged by the bounds only. Readings with the same key and values count once. Without
    ``order`` a reading is placed before the others of its series. A boolean column
    ``low_exempt`` names readings that aren't spikes for being low; they don't serve to
    predict others. A reading without neighbours is judged by its source's level, if it
    doesn't move, else it is no spike; a source of one reading is never a spike. Empty
    input gives an empty result; columns of ``readings`` that aren't named stay out,
    whatever their names.
    """
    rules = limits if isinstance(limits, dict) else {"": limits}
    shape = next(iter(rules.values()))
    if len({(r.stuck_len, r.reach, r.moving, r.max_gap) for r in rules.values()}) > 1:
        raise ValueError("limits judged in one pass must share stuck_len, reach, moving and max_gap")

    def rule(name: str) -> Column:
        if kind is None:
            return F.lit(float(getattr(shape, name)))
        out = F.lit(None).cast("double")
        for k, r in rules.items():
            out = F.when(F.col(kind) == k, float(getattr(r, name))).otherwise(out)
        return out

    cols = [*dict.fromkeys([*source, *segment, *key, *values])]
    low_ok = F.coalesce(F.col(low_exempt), F.lit(False)) if low_exempt else F.lit(False)
    rows = readings.select(*cols, F.col(order).cast("double").alias("_o"), low_ok.alias("_low_ok"))
    infinite, outside, known = F.lit(False), F.lit(False), F.lit(True)
    for v in values:
        rows = rows.where(F.col(v).isNotNull() & ~F.isnan(v))
        infinite = infinite | (F.abs(F.col(v)) == F.lit(float("inf")))
        outside = outside | (F.col(v) < rule("lower")) | (F.col(v) > rule("upper"))
    for s in source:
        known = known & F.col(s).isNotNull()
    series = known & ~infinite
    result = [*dict.fromkeys([*source, *key, *values])]
    simple = rows.where(~series).select(*result, F.lit(False).alias("is_spike"), F.lit(False).alias("is_stuck"), outside.alias("is_impossible")).distinct()

    rows = rows.where(series)
    part = [F.col(c) for c in dict.fromkeys([*source, *segment])]
    at = F.coalesce(F.col("_o"), F.lit(0.0))
    if block_span:
        rows = rows.withColumn("_home", F.floor(at / block_span)).withColumn("_block", F.explode(F.sequence(F.floor((at - halo) / block_span), F.floor((at + halo) / block_span))))
        part.append(F.col("_block"))
        at_home = F.col("_home") == F.col("_block")
    else:
        at_home = F.lit(True)
    rows = rows.select(
        *cols, *(["_block"] if block_span else []), F.coalesce(F.col("_o"), F.lit(-1e18)).alias("_o"), "_low_ok", F.xxhash64(*part).alias("_series"), F.xxhash64(*key, *values).alias("_again"),
        at_home.alias("_at_home"), (~outside & ~F.col("_low_ok")).alias("_usable"), rule("stuck_tol").alias("_tol"), outside.alias("_outside"),
    )
    ordered = rows.repartition(*part).sortWithinPartitions(*part, "_o", *key, *values)
    slim = ordered.select(*result, "_o", "_low_ok", "_series", "_again", "_at_home", "_usable", "_tol", "_outside")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields)
    judged = slim.mapInArrow(_decompose(values, shape), f"{ddl}, _w double, _c double, _n double, _still boolean, _good boolean").drop("_o", "_series", "_again", "_at_home", "_tol", "_usable")

    middle = F.percentile_approx(F.abs("_w"), F.lit(0.5), F.lit(MEDIAN_ACCURACY)).alias("_m")
    stats = judged.where("_good").groupBy(*source).agg(middle, F.avg("_c").alias("_level")).withColumnsRenamed({s: f"_s_{s}" for s in source})
    on = None
    for s in source:
        on = (F.col(s) == F.col(f"_s_{s}")) if on is None else on & (F.col(s) == F.col(f"_s_{s}"))
    rows = judged.join(maybe_broadcast(stats), on, "left")

    sigma = MAD_TO_SIGMA * F.col("_m")
    if shape.moving or len(values) > 1:
        detail = F.abs("_w")
        low = F.lit(False)
    else:
        near = F.col("_c").isNull() | (F.abs(F.col("_c") - F.col("_level")) * F.sqrt("_n") <= LEVEL_K * sigma)
        signed = F.col(values[0]) - F.when(near, F.col("_level")).otherwise(F.col("_c"))
        detail, low = F.abs(signed), F.col("_low_ok") & (signed < 0)
    spike = (detail > F.greatest(rule("detail_k") * sigma, rule("min_jump"))) & ~low
    flagged = rows.select(*result, F.coalesce(spike, F.lit(False)).alias("is_spike"), F.coalesce(F.col("_still"), F.lit(False)).alias("is_stuck"), F.col("_outside").alias("is_impossible"))
    return flagged.unionByName(simple)
