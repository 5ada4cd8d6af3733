"""Matching records by nearest time: a two-pointer merge over sorted partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _merge(tolerance: float):
    """Streams a partition sorted by (entity, block, time, right before left). Of the right
    side only the last record before a left one and the first after it are held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry: pd.DataFrame | None = None
        for pdf in batches:
            pdf = pd.concat([carry, pdf], ignore_index=True) if carry is not None else pdf
            if len(pdf):
                out, carry = _match(pdf, tolerance, False)
                if len(out):
                    yield out
        if carry is not None and len(carry):
            out, _ = _match(carry, tolerance, True)
            if len(out):
                yield out

    return run


def _match(pdf: pd.DataFrame, tolerance: float, final: bool) -> tuple[pd.DataFrame, pd.DataFrame]:
    n = len(pdf)
    part = pdf["_part"].to_numpy()
    left = pdf["_left"].to_numpy()
    t = pdf["_t"].to_numpy(np.float64)
    key = pdf["_key"].to_numpy(np.int64)
    place = np.arange(n)
    change = np.concatenate(([True], part[1:] != part[:-1]))
    first = np.maximum.accumulate(np.where(change, place, 0))
    right = ~left
    before = np.maximum.accumulate(np.where(right, place, -1))
    before = np.where(before >= first, before, -1)
    after = np.minimum.accumulate(np.where(right, place, n)[::-1])[::-1]
    ends = np.append(np.flatnonzero(change)[1:], n)
    last = ends[np.cumsum(change) - 1]
    open_part = (last == n) & (not final)
    after = np.where(after < last, after, -1)
    gap_before = np.where(before >= 0, t - t[np.maximum(before, 0)], np.inf)
    gap_after = np.where(after >= 0, t[np.maximum(after, 0)] - t, np.inf)
    # the next right record can't be nearer than what has been read already, so a left one waits
    # only while that is within the tolerance and nearer than the right one before it
    ahead = t[-1] - t if n else t
    waits = left & open_part & (after < 0) & (gap_before > ahead) & (ahead <= tolerance)
    ready = left & ~waits
    earlier = gap_before <= gap_after
    gap = np.where(earlier, gap_before, gap_after)
    hit = ready & (gap <= tolerance)
    partner = np.where(earlier, before, after)
    out = pd.DataFrame({"left_key": key[hit], "right_key": key[partner[hit]], "gap": gap[hit]})
    # Carried on: waiting left records and the last right record before each of them, and
    # the last right record of all, if the entity may go on in the next batch.
    keep = waits.copy()
    keep[before[waits & (before >= 0)]] = True
    if not final and n and last[-1] == n and before[-1] >= 0:
        keep[before[-1]] = True
    return out, pdf[keep]


def nearest(left: DataFrame, right: DataFrame, left_key: str, right_key: str, entity: list[str], left_time: str, right_time: str, tolerance: float, block: float | None = None) -> DataFrame:
    """(left_key, right_key, gap): for each left record the nearest right one of its entity.

    Both tables are partitioned by entity and time block, sorted inside the partitions, and
    walked once. Blocks (``block`` wide, by default 20 tolerances) split a hot entity;
    right records within the tolerance of a block's border are copied into the next one,
    so no pair is lost. Of equally near right records the earlier wins, then the smaller
    key; a gap equal to ``tolerance`` counts. Entity columns must have the same names in
    both tables and integer keys. Records with a null entity, time or key (or NaN time)
    take no part; right records of the same entity and time are reduced to the smallest
    key before the shuffle, and repeats of left records count once. Left records without
    a partner in reach, and empty tables, give no rows.
    """
    block = block or max(20 * tolerance, 1.0)
    usable = lambda df, key, time: df.where(F.col(key).isNotNull() & F.col(time).isNotNull() & ~F.isnan(F.col(time).cast("double"))).dropna(subset=entity)
    names = [f"_e{k}" for k in range(len(entity))]
    ents = [F.col(e).alias(a) for e, a in zip(entity, names)]
    time_l, time_r = F.col(left_time).cast("double"), F.col(right_time).cast("double")
    lhs = usable(left, left_key, left_time).select(*ents, time_l.alias("_t"), F.col(left_key).cast("long").alias("_key")).distinct()
    lhs = lhs.withColumn("_block", F.floor(F.col("_t") / block)).withColumn("_left", F.lit(True))
    rhs = usable(right, right_key, right_time).select(*ents, time_r.alias("_t"), F.col(right_key).cast("long").alias("_key"))
    rhs = rhs.withColumn("_block", F.explode(F.sequence(F.floor((F.col("_t") - tolerance) / block), F.floor((F.col("_t") + tolerance) / block))))
    rhs = rhs.groupBy(*names, "_block", "_t").agg(F.min("_key").alias("_key")).withColumn("_left", F.lit(False))
    both = lhs.unionByName(rhs)
    where = [*names, "_block"]
    both = both.repartition(*where).sortWithinPartitions(*where, "_t", "_left", "_key")
    # equal entities get equal labels inside a partition; the label only has to differ between neighbours
    part = F.concat_ws("\x1f", *[F.col(c).cast("string") for c in where]).alias("_part")
    rows = both.select(part, "_t", "_key", "_left")
    found = rows.mapInPandas(_merge(tolerance), "left_key long, right_key long, gap double")
    return found.withColumnsRenamed({"left_key": left_key, "right_key": right_key} if left_key != right_key else {"left_key": f"left_{left_key}", "right_key": f"right_{right_key}"})
