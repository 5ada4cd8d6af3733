"""Filling fixed-capacity containers by minimum bin slack."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchloom.session import few_rows

SHARD_BITS = 32
#: container sizes at most; more are an error
MOST_SIZES = 100_000


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum that is at most ``room``.

    Subset sums are the bits of one integer; a length that is there m times is added in
    powers of two of copies. The search ends as soon as the room is filled exactly.
    """
    sums, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if 0 < x <= room), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left > 0:
            take = min(copies, left)
            steps.append((length, take, sums))
            sums = (sums | (sums << (take * length))) & mask
            left -= take
            copies *= 2
            if sums >> room & 1:
                break
        if sums >> room & 1:
            break
    at, used = sums.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= take * length
    return used


def plan(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each length (all in 1..capacity).

    Each container starts with the longest item left and takes the fullest combination of
    the others; a combination is used again while its lengths last, since it stays the
    fullest one.
    """
    order = np.argsort(-lengths, kind="stable")
    values, first, number = np.unique(-lengths[order], return_index=True, return_counts=True)
    counts = {int(-v): int(c) for v, c in zip(values, number)}
    next_at = {int(-v): int(f) for v, f in zip(values, first)}
    container = np.zeros(len(lengths), np.int64)
    bins = 0
    for longest in sorted(counts, reverse=True):
        while counts.get(longest, 0) > 0:
            counts[longest] -= 1
            use = fullest(counts, capacity - longest)
            counts[longest] += 1
            use[longest] = use.get(longest, 0) + 1
            times = min(counts[x] // k for x, k in use.items())
            for x, k in use.items():
                at = next_at[x]
                container[order[at : at + times * k]] = bins + np.arange(times * k) // k
                next_at[x] = at + times * k
                counts[x] -= times * k
                if not counts[x]:
                    del counts[x]
            bins += times
    return container


def pack(docs: DataFrame, key: str, size: str, containers: DataFrame, shard_items: int = 50_000) -> DataFrame:
    """(size_name, key, piece_no, n_pieces, tokens, container_id) for every container size.

    ``containers`` has (size_name, capacity_tokens). An item larger than the capacity is cut
    into pieces of the whole capacity and one rest, everything else stays whole. Items are
    spread by hash over shards of about ``shard_items`` items that are packed side by side;
    a shard leaves at most its last containers unfilled, so the loss is bounded by the
    number of shards. Null or negative sizes count as 0; items of size 0 take no room and
    go to the shard's first container. Rows with a null key are items too, and so are
    repeats; equal rows are counted first and spread by their number, so that a key that
    holds a third of all rows fills many shards. Sizes without a positive capacity are
    left out; more than ``MOST_SIZES`` sizes are an error.
    """
    items = docs.select(F.col(key).alias("_key"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("_n"))
    kinds = containers.where(F.col("capacity_tokens") > 0).select(F.col("size_name").cast("string").alias("_size"), F.col("capacity_tokens").cast("long").alias("_cap")).distinct()
    kinds_list = [{"_size": r["_size"], "_cap": r["_cap"]} for r in few_rows(kinds, MOST_SIZES, "container sizes")]
    shards = max(1, -(-items.count() // shard_items))
    # one folded literal, however many sizes there are
    by_size = F.from_json(F.lit(json.dumps(kinds_list)), "array<struct<_size:string,_cap:bigint>>")
    copies = items.groupBy("_key", "_n").agg(F.count(F.lit(1)).alias("_m")).select("_key", "_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_m"))).alias("_copy"))
    each = copies.withColumn("_shard", F.pmod(F.xxhash64("_key", "_copy"), F.lit(shards))).drop("_copy").select("*", F.inline(by_size))
    kind = dict((f.name, f.dataType.simpleString()) for f in items.schema.fields)["_key"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_n", "_key"], kind="stable").reset_index(drop=True)
        cap, shard = int(pdf["_cap"].iloc[0]), int(pdf["_shard"].iloc[0])
        n = pdf["_n"].to_numpy(np.int64)
        full, rest = n // cap, n % cap
        pieces = np.maximum(full + (rest > 0), 1)
        has = rest > 0
        base = np.zeros(len(n), np.int64)
        base[has] = plan(rest[has], cap)
        used = int(base[has].max()) + 1 if has.any() else 0
        row = np.repeat(np.arange(len(n)), pieces)
        no = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        whole = no < full[row]
        container = np.where(whole, 0, base[row])
        container[whole] = used + np.arange(whole.sum())
        return pd.DataFrame(
            {
                "_size": pdf["_size"].to_numpy()[row],
                "_key": pdf["_key"].to_numpy()[row],
                "piece_no": no,
                "n_pieces": pieces[row],
                "tokens": np.where(whole, cap, rest[row]),
                "container_id": (shard << SHARD_BITS) + container,
            }
        )

    out = each.groupBy("_size", "_shard").applyInPandas(run, f"_size string, _key {kind}, piece_no long, n_pieces long, tokens long, container_id long")
    return out.withColumnsRenamed({"_size": "size_name", "_key": key})


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """(size_name, n_containers, tokens, fill): how much of the opened containers is used."""
    used = packed.groupBy("size_name").agg(F.countDistinct("container_id").alias("n_containers"), F.sum("tokens").alias("tokens"))
    return used.join(containers.select("size_name", "capacity_tokens").distinct(), "size_name").select(
        "size_name", "n_containers", "tokens", (F.col("tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("fill")
    )


def audit(packed: DataFrame, containers: DataFrame, key: str, least_fill: float) -> DataFrame:
    """(size_name, tokens, n_cut, n_over, n_ragged, well_filled): what a packing must keep. Tokens
    of all pieces, items that are cut, containers beyond their capacity, cut items that
    have a piece between their first and last that isn't a whole container, and whether
    all containers but one of each shard are filled to ``least_fill`` on average."""
    caps = containers.select("size_name", "capacity_tokens").distinct()
    per = packed.groupBy("size_name", "container_id").agg(F.sum("tokens").alias("t")).join(caps, "size_name")
    shard = F.shiftright("container_id", SHARD_BITS)
    boxes = per.groupBy("size_name").agg(
        F.sum("t").alias("tokens"), F.count_if(F.col("t") > F.col("capacity_tokens")).alias("n_over"),
        (F.sum("t") >= least_fill * (F.count(F.lit(1)) - F.count_distinct(shard)) * F.first("capacity_tokens")).alias("well_filled"),
    )
    ragged = (F.col("piece_no") < F.col("n_pieces") - 1) & (F.col("tokens") != F.col("capacity_tokens"))
    cut = packed.join(caps, "size_name").groupBy("size_name").agg(F.count_if((F.col("n_pieces") > 1) & (F.col("piece_no") == 0)).alias("n_cut"), F.count_if(ragged).alias("n_ragged"))
    return boxes.join(cut, "size_name").select("size_name", "tokens", "n_cut", "n_over", "n_ragged", "well_filled")
