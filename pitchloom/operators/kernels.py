"""Numeric kernels that SQL can't say: Arrow-batched numpy per bounded group."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: parameters of the published models ---
ELO_K, ELO_START, ELO_HOME = 20.0, 1500.0, 100.0
SPEED_MAX, REACTION, SIGMA, RATE, STEP, HORIZON, ENOUGH, BALL_SPEED = 5.0, 0.7, 0.45, 4.3, 0.04, 10.0, 0.99, 15.0
TELEPORT, SPEED_CAP, LEAST_SEGMENT, HAMPEL_WIDTH, HAMPEL_K, CUTOFF_HZ = 12.0, 11.0, 16, 9, 3.0, 1.0
HIGH_SPEED, SPRINT, ZONES = 5.5, 25 / 3.6, (0.0, 2.0, 4.0, 5.5, 7.0)
# --- end of fixed values ---


def elo(games: DataFrame, order: str, home: str, away: str, home_goals: str, away_goals: str) -> DataFrame:
    """(order, home, away, before_home, before_away): ratings before each game, in order.

    A rating depends on all earlier games, so this is a serial fold: one row per game (a few
    dozen bytes) goes through one task, nothing else of the table does.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rating: dict[int, float] = {}
        for pdf in batches:
            before = []
            for a, b, ga, gb in zip(pdf["a"], pdf["b"], pdf["ga"], pdf["gb"]):
                ra, rb = rating.get(a, ELO_START), rating.get(b, ELO_START)
                before.append((ra, rb))
                expected = 1 / (1 + 10 ** ((rb - ra - ELO_HOME) / 400))
                change = ELO_K * ((1.0 if ga > gb else 0.5 if ga == gb else 0.0) - expected)
                rating[a], rating[b] = ra + change, rb - change
            yield pd.DataFrame({"game": pdf["o"], "home": pdf["a"], "away": pdf["b"], "before_home": [x for x, _ in before], "before_away": [y for _, y in before]})

    rows = games.select(F.col(order).cast("long").alias("o"), F.col(home).cast("long").alias("a"), F.col(away).cast("long").alias("b"), F.col(home_goals).cast("long").alias("ga"), F.col(away_goals).cast("long").alias("gb")).dropna()
    return rows.coalesce(1).sortWithinPartitions("o", "a").mapInPandas(fold, "game long, home long, away long, before_home double, before_away double")


def greedy_match(left: DataFrame, right: DataFrame, left_key: str, right_key: str, by: list[str], time: str) -> DataFrame:
    """(left_key, right_key): in order of time each left record takes the nearest right one
    that is still free. The order matters, so each group (a match's goals) is one call."""
    both = left.select(*by, F.col(time).alias("_t"), F.col(left_key).alias("_k"), F.lit(True).alias("_l")).unionByName(right.select(*by, F.col(time).alias("_t"), F.col(right_key).alias("_k"), F.lit(False).alias("_l")))

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["_l"]].sort_values(["_t", "_k"]), pdf[~pdf["_l"]].sort_values(["_t", "_k"])
        free, out = b["_t"].to_numpy(float), []
        keys, taken = b["_k"].to_numpy(), np.zeros(len(b), bool)
        for t, k in zip(a["_t"], a["_k"]):
            if taken.all():
                break
            at = int(np.argmin(np.where(taken, np.inf, np.abs(free - t))))
            taken[at] = True
            out.append((k, keys[at]))
        return pd.DataFrame(out, columns=["l", "r"]).astype("int64")

    return both.groupBy(*by).applyInPandas(match, "l long, r long").select(F.col("l").alias(left_key), F.col("r").alias(right_key))


def lowpass(order: int, cutoff: float, rate: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order sections (b, a) of a Butterworth low-pass by the bilinear transform."""
    warped = 2 * rate * np.tan(np.pi * cutoff / rate)
    out = []
    for k in range(order // 2):
        angle = np.pi * (2 * k + 1) / (2 * order)
        c = 2 * rate
        a0, a1, a2 = warped**2, 2 * warped * np.sin(angle), 1.0
        norm = a2 * c * c + a1 * c + a0
        a = np.array([1.0, (2 * a0 - 2 * a2 * c * c) / norm, (a2 * c * c - a1 * c + a0) / norm])
        out.append((np.array([1.0, 2.0, 1.0]) * a0 / norm, a))
    return out


def _section(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Direct form, started in the steady state of the first value."""
    level = x[0]
    z1, z2 = level * (1 - b[0]), level * (b[2] - a[2])
    out = np.empty_like(x)
    for k, v in enumerate(x):
        y = b[0] * v + z1
        z1, z2 = b[1] * v - a[1] * y + z2, b[2] * v - a[2] * y
        out[k] = y
    return out


def both_ways(x: np.ndarray, sections: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Zero-phase filtering: forwards and backwards over an oddly reflected series."""
    pad = min(3 * (2 * len(sections) + 1), len(x) - 1)
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        for b, a in sections:
            ext = _section(b, a, ext)
        ext = ext[::-1]
    return ext[pad : pad + len(x)]


def _running_median(x: np.ndarray, width: int) -> np.ndarray:
    half = width // 2
    return np.median(np.lib.stride_tricks.sliding_window_view(np.pad(x, half, mode="edge"), width), axis=1)


def hampel(x: np.ndarray, width: int = HAMPEL_WIDTH, k: float = HAMPEL_K) -> np.ndarray:
    """Values further than k robust deviations from the running median replaced by it. The
    deviation is the running median of the distances; where that is 0 nothing is replaced,
    and a series shorter than the window stays as it is."""
    if len(x) < width:
        return x
    mid = _running_median(x, width)
    away = np.abs(x - mid)
    sigma = 1.4826 * _running_median(away, width)
    return np.where((sigma > 0) & (away > k * sigma), mid, x)


def smooth_speed(df: DataFrame, source: list[str], time: str, key: str, x: str, y: str, rate: float) -> DataFrame:
    """(source, key, speed): teleports cut segments, positions are low-passed both ways, speeds
    by central differences, outliers replaced, capped. Segments shorter than
    ``LEAST_SEGMENT`` frames have no speed. One call per source (a player in a match)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_t", "_k"], kind="stable").reset_index(drop=True)
        t, px, py = pdf["_t"].to_numpy(float) / 1000, pdf["_x"].to_numpy(float), pdf["_y"].to_numpy(float)
        speed = np.full(len(pdf), np.nan)
        cut = np.flatnonzero(~(np.hypot(np.diff(px), np.diff(py)) <= TELEPORT * np.diff(t))) + 1
        for part in np.split(np.arange(len(pdf)), cut):
            if len(part) >= LEAST_SEGMENT:
                sx, sy = (both_ways(v[part], lowpass(4, CUTOFF_HZ, rate)) for v in (px, py))
                v = np.hypot(np.gradient(sx, t[part]), np.gradient(sy, t[part]))
                speed[part] = np.minimum(hampel(v), SPEED_CAP)
        return pdf.assign(speed=speed)[[*source, "_k", "speed"]]

    rows = df.select(*source, F.col(time).alias("_t"), F.col(key).cast("long").alias("_k"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna()
    ddl = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in source)
    out = rows.groupBy(*source).applyInPandas(run, f"{ddl}, _k long, speed double").withColumnRenamed("_k", key)
    return out.withColumn("speed", F.when(~F.isnan("speed"), F.col("speed")))


def minute_metrics(steps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metres, hsr_s, sprint_s, p95, z1_m..z5_m) of steps (step in metres, dt in seconds,
    speed in m/s): an aggregation, whatever the speeds were smoothed by. Metres and seconds
    are summed exactly."""
    v, exact = F.col("speed"), lambda c: F.col(c).cast("decimal(18,9)")
    part = lambda c, cond: F.round(F.coalesce(F.sum(F.when(cond, exact(c))).cast("double"), F.lit(0.0)), 4)
    zones = [part("step", (v >= a) & (v < b)).alias(f"z{k}_m") for k, (a, b) in enumerate(zip(ZONES, (*ZONES[1:], 99.0)), 1)]
    return steps.groupBy(*keys).agg(F.round(F.sum(exact("step")).cast("double"), 4).alias("metres"), part("dt", v >= HIGH_SPEED).alias("hsr_s"), part("dt", v >= SPRINT).alias("sprint_s"), F.round(F.percentile(v, 0.95), 6).alias("p95"), *zones)


def arrival_times(players: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Seconds until each standing player reaches the target: reaction, then full speed."""
    return REACTION + np.hypot(players[:, 0] - target[0], players[:, 1] - target[1]) / SPEED_MAX


def control(attack: np.ndarray, defend: np.ndarray, target: np.ndarray, flight: float) -> float:
    """Share of the attack in the control of a target when the ball arrives after ``flight``."""
    ta, td = arrival_times(attack, target), arrival_times(defend, target)
    lead = np.log(10) * (np.sqrt(3) * SIGMA / np.pi + 1 / RATE)
    if td.min() - max(flight, ta.min()) >= lead:
        return 1.0
    if ta.min() - max(flight, td.min()) >= lead:
        return 0.0
    arrive, side = np.concatenate([ta, td]), np.arange(len(ta) + len(td)) < len(ta)
    held, clock = np.zeros(len(arrive)), flight
    while held.sum() < ENOUGH and clock < flight + HORIZON:
        reach = 1 / (1 + np.exp(np.clip(-np.pi / np.sqrt(3) / SIGMA * (clock - arrive), -60, 60)))
        held += (1 - held.sum()) * reach * RATE * STEP
        clock += STEP
    return float(held[side].sum() / max(held.sum(), 1e-12))


def pitch_control(frames: DataFrame, key: str, home: str, away: str, ball: str) -> DataFrame:
    """(key, home_control): control of the ball's own spot for the home side, frame by frame."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for hx, hy, ax, ay, bx, by in zip(pdf["hx"], pdf["hy"], pdf["ax"], pdf["ay"], pdf["bx"], pdf["by"]):
                h, a = np.column_stack([hx, hy]), np.column_stack([ax, ay])
                out.append(control(h, a, np.array([bx, by]), 0.0) if len(h) and len(a) else None)
            yield pd.DataFrame({key: pdf[key], "home_control": pd.Series(out, dtype="float64")})

    pick = lambda side, c: F.transform(F.filter(side, lambda p: p["x"].isNotNull() & p["y"].isNotNull()), lambda p: p[c].cast("double"))
    rows = frames.select(F.col(key).cast("long").alias(key), pick(home, "x").alias("hx"), pick(home, "y").alias("hy"), pick(away, "x").alias("ax"), pick(away, "y").alias("ay"), F.col(f"{ball}.x").alias("bx"), F.col(f"{ball}.y").alias("by")).dropna()
    return rows.mapInPandas(run, f"{key} long, home_control double")


def qualification(teams: DataFrame, group: str, team: str, rate: str, sims: int = 1500, places: int = 2, seed: int = 42) -> DataFrame:
    """(group, team, p): share of simulated round-robins in which the team is among the first
    ``places`` by points, difference, goals. Seeded per group, so it repeats exactly."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_t").reset_index(drop=True)
        n, rates = len(pdf), pdf["_r"].to_numpy(float)
        rng = np.random.default_rng([seed, zlib.crc32(str(pdf["_g"].iloc[0]).encode())])
        points, diff, made = (np.zeros((sims, n)) for _ in range(3))
        for i in range(n):
            for j in range(i + 1, n):
                a, b = rng.poisson(rates[i], sims), rng.poisson(rates[j], sims)
                points[:, i] += 3 * (a > b) + (a == b)
                points[:, j] += 3 * (b > a) + (a == b)
                diff[:, i] += a - b
                diff[:, j] += b - a
                made[:, i] += a
                made[:, j] += b
        rank = np.argsort(np.argsort(-(points * 1e6 + diff * 1e3 + made), axis=1, kind="stable"), axis=1)
        return pd.DataFrame({"_g": pdf["_g"], "_t": pdf["_t"], "p": (rank < places).mean(axis=0)})

    rows = teams.select(F.col(group).cast("long").alias("_g"), F.col(team).cast("long").alias("_t"), F.col(rate).cast("double").alias("_r"))
    return rows.groupBy("_g").applyInPandas(run, "_g long, _t long, p double").withColumnsRenamed({"_g": group, "_t": team})


def placebo(panel: DataFrame, by: str, unit: str, position: str, value: str, draws: int, seed: int = 42) -> DataFrame:
    """(by, effect, p): the post-minus-pre mean against draws in which each unit's post labels
    are permuted. Draws are seeded per unit. Units meet in a task as sorted rows, which adds
    up its units, so it sends one row per group and draw; a unit's readings are gathered,
    a group never. A permutation moves labels only, so counts and totals are those of the unit."""

    def add(sums: dict, b: str, u: str, post: np.ndarray, v: np.ndarray) -> None:
        rng = np.random.default_rng([seed, zlib.crc32(f"{b}:{u}".encode())])
        s1, rest = sums.setdefault(b, (np.zeros(draws + 1), np.zeros(3)))
        s1[0] += v[post].sum()
        at = 1
        while at <= draws:  # a few million labels at once, however long the unit is
            some = min(draws + 1 - at, max(1, 4_000_000 // len(v)))
            s1[at : at + some] += rng.permuted(np.tile(post, (some, 1)), axis=1) @ v
            at += some
        rest += (v.sum(), post.sum(), len(v))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if pdf.empty:
                continue
            b, u, post, v = pdf["_b"].to_numpy(), pdf["_u"].to_numpy(), pdf["_p"].to_numpy() > 0, pdf["_v"].to_numpy(float)
            starts = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (u[1:] != u[:-1])])
            for lo, hi in zip(starts[:-1], starts[1:]):
                add(sums, b[lo], u[lo], post[lo:hi], v[lo:hi])
            held = pdf.iloc[starts[-1] :]  # may go on in the next batch
        if held is not None and len(held):
            add(sums, held["_b"].iloc[0], held["_u"].iloc[0], held["_p"].to_numpy() > 0, held["_v"].to_numpy(float))
        for b, (s1, (total, n1, n)) in sums.items():
            yield pd.DataFrame({"_b": b, "draw": np.arange(draws + 1), "s1": s1, "n1": int(n1), "s0": total - s1, "n0": int(n - n1)})

    rows = panel.select(F.col(by).cast("string").alias("_b"), F.col(unit).cast("string").alias("_u"), F.col(position).cast("long").alias("_p"), F.col(value).cast("double").alias("_v")).dropna()
    sums = rows.repartition("_b", "_u").sortWithinPartitions("_b", "_u", "_p", "_v").mapInPandas(run, "_b string, draw long, s1 double, n1 long, s0 double, n0 long")
    effects = sums.groupBy("_b", "draw").agg((F.try_divide(F.sum("s1"), F.sum("n1")) - F.try_divide(F.sum("s0"), F.sum("n0"))).alias("e"))
    real = F.max(F.when(F.col("draw") == 0, F.col("e")))
    drawn = effects.where("draw > 0").groupBy("_b").agg(F.collect_list("e").alias("es"))  # one number per draw
    return effects.groupBy("_b").agg(real.alias("effect")).join(drawn, "_b").select(F.col("_b").alias(by), "effect", ((1 + F.size(F.filter("es", lambda e: F.abs(e) >= F.abs(F.col("effect"))))) / (1 + F.size("es"))).alias("p"))
