"""Splits that keep related records together.

Connected components by frontier breadth-first search: adjacency lists are hash-partitioned,
many seeds expand at once, and where the areas of two seeds touch their labels collide.
The colliding labels form a smaller graph that is solved the same way until it fits one
task. Components then fill the splits in the order of their hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchloom.session import cut

HASH_BUCKETS = 4096


def _union_find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch["a"], batch["b"]):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    names = list(parent)
    if names:
        yield pd.DataFrame({"vertex": names, "component": [root(x) for x in names]})


def _expand(edges: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """(vertex, label) after ``hops`` steps of all seeds at once, and the colliding labels.

    Seeds are the vertices of higher (degree, hash) than all their neighbours, at most half
    of all vertices: every edge of a seed leads to a vertex of no higher degree that is no
    seed. Vertices that no frontier reached in time stay on their own and collide later.
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("d"))
    rank = F.struct("d", F.xxhash64("a").alias("h"), F.col("a").alias("v"))
    ranks = cut(degree.select(F.col("a").alias("vertex"), rank.alias("rank")))
    near = both.join(ranks.select(F.col("vertex").alias("b"), F.col("rank").alias("rb")), "b").groupBy("a").agg(F.max("rb").alias("best"))
    seeds = ranks.join(near.withColumnRenamed("a", "vertex"), "vertex").where(F.col("rank") > F.col("best"))
    labels = seeds.select("vertex", F.col("vertex").alias("label"))
    frontier = labels
    for _ in range(hops):
        reached = both.join(frontier.withColumnRenamed("vertex", "a"), "a").groupBy(F.col("b").alias("vertex")).agg(F.min("label").alias("label"))
        frontier = cut(reached.join(labels.select("vertex"), "vertex", "left_anti"))
        labels = labels.unionByName(frontier)
    labels = ranks.select("vertex").join(labels, "vertex", "left").select("vertex", F.coalesce("label", "vertex").alias("label"))
    labels = cut(labels)
    met = edges.join(labels.select(F.col("vertex").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("vertex").alias("b"), F.col("label").alias("lb")), "b")
    met = met.where(F.col("la") != F.col("lb")).select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
    return labels, cut(met)


def components(edges: DataFrame, hops: int = 2, small_graph_edges: int = 500_000) -> DataFrame:
    """(vertex, component) of an undirected graph of string pairs (a, b).

    ``component`` is the smallest vertex. Pairs with a null are no edges, a pair of equal
    vertices makes the vertex known without tying it to anything, repeats count once; an
    empty input gives an empty result. A graph of colliding labels of at most
    ``small_graph_edges`` edges is merged in one task, a larger one is expanded again;
    each expansion leaves at most half of the vertices, so the rounds grow with the
    logarithm of the graph. No graph is collected to the driver.
    """
    known = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    alone = known.where(F.col("a") == F.col("b")).select(F.col("a").alias("vertex")).distinct()
    graph = cut(known.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    levels = []
    while True:
        labels, graph = _expand(graph, hops)
        levels.append(labels)
        if graph.count() <= small_graph_edges:
            break
    merged = graph.coalesce(1).mapInPandas(_union_find, "vertex string, component string")
    found = merged.select("vertex", "component")
    for labels in reversed(levels):
        up = found.withColumnRenamed("vertex", "label")
        found = labels.join(up, "label", "left").select("vertex", F.coalesce("component", "label").alias("component"))
    least = found.groupBy("component").agg(F.min("vertex").alias("least"))
    named = found.join(least, "component").select("vertex", F.col("least").alias("component"))
    return cut(named.unionByName(alone.join(named.select("vertex"), "vertex", "left_anti").select("vertex", F.col("vertex").alias("component"))))


def assign_splits(sizes: DataFrame, targets: dict[str, float], large_parts: int = 2000) -> DataFrame:
    """(component, split_name) so that the splits hold near the target shares of all records.

    ``sizes`` has (component, n). Components of at least 1 / ``large_parts`` of all records
    (so at most ``large_parts`` of them) are placed first, largest first, each where most
    is missing. All others follow in hash order: their cumulated size, from the totals of
    ``HASH_BUCKETS`` hash buckets and a window inside each, is cut at the shares still to
    be filled. Shares are taken relative to their sum; null or negative ones count as 0.
    With no positive share nothing is assigned. The result is the same on every run.
    """
    shares = {k: max(v or 0.0, 0.0) for k, v in targets.items()}
    whole = sum(shares.values())
    names = sorted(k for k, v in shares.items() if v > 0)
    sizes = sizes.select("component", F.col("n").cast("long").alias("n")).where(F.col("component").isNotNull())
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not names or not total:
        return sizes.select("component", F.lit(None).cast("string").alias("split_name")).where(F.lit(False))
    large = F.col("n") * large_parts >= total
    missing = {k: shares[k] / whole * total for k in names}
    placed = []
    for row in sizes.where(large).orderBy(F.desc("n"), F.xxhash64("component"), "component").collect():  # at most large_parts rows
        to = max(names, key=lambda k: missing[k])
        missing[to] -= row["n"]
        placed.append((row["component"], to))
    first = sizes.sparkSession.createDataFrame(placed, "component string, split_name string")

    spread = sizes.where(~large).withColumn("h", F.xxhash64("component")).withColumn("bucket", F.pmod("h", F.lit(HASH_BUCKETS)))
    buckets = spread.groupBy("bucket").agg(F.sum("n").alias("t")).orderBy("bucket").collect()  # at most HASH_BUCKETS rows
    rest = sum(r["t"] for r in buckets)
    before, run = [], 0
    for r in buckets:
        before.append((r["bucket"], run))
        run += r["t"]
    starts = sizes.sparkSession.createDataFrame(before, "bucket long, before long")
    open_ = {k: max(v, 0.0) for k, v in missing.items()}
    scale = rest / (sum(open_.values()) or 1.0)
    w = Window.partitionBy("bucket").orderBy("h", "component").rowsBetween(Window.unboundedPreceding, -1)
    middle = spread.join(F.broadcast(starts), "bucket").withColumn("at", F.col("before") + F.coalesce(F.sum("n").over(w), F.lit(0)) + F.col("n") / 2)
    split, edge = F.lit(names[-1]), 0.0
    rules = []
    for k in names[:-1]:
        edge += open_[k] * scale
        rules.append((edge, k))
    for edge, k in reversed(rules):
        split = F.when(F.col("at") < edge, k).otherwise(split)
    return first.unionByName(middle.select("component", split.alias("split_name")))
