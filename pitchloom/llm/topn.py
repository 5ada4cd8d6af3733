"""Top N items within every group by merging sorted runs.

Every input partition is sorted once into a run ordered by group and score; a pass over the
run keeps N distinct items of a group and seeks to the next one. Only these heads are
shuffled, so a group of any size sends at most N rows per run. Runs meet in two levels, by
group and bucket of runs and then by group; where they meet, a loser tree merges a bounded
number of runs at a time and stops after N outputs. Values stay in Arrow types throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: runs of a group that are held and merged at once
MOST_RUNS = 256
#: runs 0 to 2 ** BUCKET_BITS - 1 form the first bucket, and so on
BUCKET_BITS = 10


class LoserTree:
    """Merges sorted lists of tuples; ``pop`` gives (run, item) of the least head."""

    def __init__(self, runs: list[list[tuple]]) -> None:
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.loser = [-1] * self.k
        for leaf in range(self.k):
            self._settle(leaf)

    def _head(self, run: int) -> tuple | None:
        return self.runs[run][self.at[run]] if self.at[run] < len(self.runs[run]) else None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._head(a), self._head(b)
        if x is None or y is None:
            return x is not None
        return (x, a) < (y, b)

    def _settle(self, leaf: int) -> None:
        """Play the leaf up to the root, leaving the loser at each node; an empty node is
        an opponent that hasn't come yet, so the player waits there."""
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            other = self.loser[node]
            if other < 0:
                self.loser[node] = winner
                return
            if self._beats(other, winner):
                self.loser[node], winner = winner, other
            node //= 2
        self.loser[0] = winner

    def pop(self) -> tuple[int, tuple] | None:
        run = self.loser[0]
        item = self._head(run)
        if item is None:
            return None
        self.at[run] += 1
        winner, node = run, (run + self.k) // 2
        while node > 0:
            if self._beats(self.loser[node], winner):
                self.loser[node], winner = winner, self.loser[node]
            node //= 2
        self.loser[0] = winner
        return run, item


def _ascending(df: DataFrame, order: list[tuple[str, bool]]) -> dict[str, Column]:
    """Columns whose ascending order is the wanted one, nulls last."""
    out: dict[str, Column] = {}
    types = {f.name: f.dataType for f in df.schema.fields}
    for k, (name, descending) in enumerate(order):
        dtype, col = types[name], F.col(name)
        if descending and isinstance(dtype, T.FractionalType):
            col = F.when(col == 0, F.lit(0.0)).otherwise(-col)
        elif isinstance(dtype, T.FractionalType):
            col = F.when(col == 0, F.lit(0.0)).otherwise(col)
        elif descending and isinstance(dtype, T.IntegralType):
            col = F.bitwise_not(col)
        elif descending:
            raise TypeError(f"{name}: only numbers can be ordered downwards")
        out[f"_n{k}"] = F.col(name).isNull()
        out[f"_k{k}"] = F.coalesce(col, F.lit("" if isinstance(dtype, T.StringType) else 0).cast(col_type(dtype)))
    return out


def col_type(dtype: T.DataType) -> T.DataType:
    return T.DoubleType() if isinstance(dtype, T.FractionalType) else dtype


def top_n(df: DataFrame, group: list[str], order: list[tuple[str, bool]], n: int, item: list[str]) -> DataFrame:
    """(group, item, rank) of the first ``n`` distinct items of each group.

    ``order`` lists (column, descending), the score first; nulls of the later columns come
    last. ``item`` identifies an item and must be among the ordered columns or determined
    by them for the result to be the same on every run. Rows with a null group column, or
    a null or NaN score, aren't ranked. Rows of one item that tie in every ordered column
    (repeats) count once. 0.0 and -0.0 are equal. ``n`` < 1 and empty tables give no rows;
    further columns are left out, whatever their names.
    """
    score = order[0][0]
    types = {f.name: f.dataType for f in df.schema.fields}
    usable = F.col(score).isNotNull()
    if isinstance(types[score], T.FractionalType):
        usable = usable & ~F.isnan(score)
    for g in group:
        usable = usable & F.col(g).isNotNull()
    keys = _ascending(df, order)
    groups = [f"_g{k}" for k in range(len(group))]
    items = [f"_i{k}" for k in range(len(item))]
    flat = df.where(usable).select(*[F.col(g).alias(a) for g, a in zip(group, groups)], *[c.alias(a) for a, c in keys.items()], *[F.col(i).alias(a) for i, a in zip(item, items)])
    by = [*groups, *keys, *items]
    kinds = {f.name: f.dataType for f in flat.schema.fields}
    ddl = ", ".join(f"{c} {kinds[c].simpleString()}" for c in by)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = TaskContext.get().partitionId()
        last, seen = None, 0
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            differs = lambda c: pc.fill_null(pc.not_equal(c[1:], c[:-1]), True).to_numpy(zero_copy_only=False)
            new_group, new_item = np.zeros(rows, bool), np.zeros(rows, bool)
            head = tuple(batch.column(c)[0].as_py() for c in range(len(by)))
            new_group[0] = last is None or last[: len(groups)] != head[: len(groups)]
            new_item[0] = last is None or last != head
            for c in range(len(by)):
                if rows > 1:
                    step = differs(batch.column(c))
                    new_item[1:] |= step
                    if c < len(groups):
                        new_group[1:] |= step
            order_no = np.cumsum(new_item)
            start = np.maximum.accumulate(np.where(new_group, np.arange(rows), -1))
            rank = np.where(start >= 0, order_no - order_no[np.maximum(start, 0)] + 1, order_no + seen)
            keep = np.flatnonzero(new_item & (rank <= n))
            seen, last = int(rank[-1]), tuple(batch.column(c)[rows - 1].as_py() for c in range(len(by)))
            if len(keep):
                out = batch.take(pa.array(keep))
                columns = [*out.columns, pa.array(np.full(len(keep), run, np.int32)), pa.array(rank[keep].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=[*by, "_run", "_at"])

    runs = flat.sortWithinPartitions(*by).mapInArrow(heads, f"{ddl}, _run int, _at int")

    ng = len(groups)
    fields = [f.name for f in runs.schema.fields]

    def merged(lists: list[list[tuple]]) -> list[tuple]:
        """The first n different items of sorted runs of (*keys, *items)."""
        tree, out = LoserTree(lists), []
        while len(out) < n and (got := tree.pop()) is not None:
            if not out or got[1] != out[-1]:
                out.append(got[1])
        return out

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (group, run, place) to the heads of each group. A group of one run is
        its own result and passes as it is; of the others at most ``MOST_RUNS`` runs are
        held, and what they give is itself a run for the next ones."""
        schema = pa.schema([(f, t) for f, t in zip(fields, arrow_types)])
        group_now, run_now, held, out = None, None, [], []

        def feed(batch: pa.RecordBatch) -> None:
            """Rows of one group, which may go on in the next batch."""
            nonlocal group_now, run_now, held
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[:ng] != group_now:
                    close()
                    group_now, held, run_now = row[:ng], [[]], row[-2]
                elif row[-2] != run_now:
                    if len(held) >= MOST_RUNS:
                        held = [merged(held)]
                    held.append([])
                    run_now = row[-2]
                held[-1].append(row[ng:-2])

        def close() -> None:
            nonlocal group_now
            if group_now is not None:
                out.extend((*group_now, *item, run_now, place) for place, item in enumerate(merged(held), 1))
            group_now = None

        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            new_group, new_run = np.ones(rows, bool), np.zeros(rows, bool)
            if rows > 1:
                changes = lambda c: pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
                new_group[1:] = np.any([changes(batch.column(c)) for c in range(ng)], axis=0) if ng else False
                new_run[1:] = changes(batch.column(len(fields) - 2)) & ~new_group[1:]
            starts = np.flatnonzero(new_group)
            ends = np.append(starts[1:], rows)
            several = np.add.reduceat(new_run, starts) > 0
            # the first may belong to the group before it, the last may go on
            several[0] = several[-1] = True
            for k in np.flatnonzero(several):
                feed(batch.slice(int(starts[k]), int(ends[k] - starts[k])))
            alone = ~np.repeat(several, ends - starts)
            if alone.any():
                yield batch.filter(pa.array(alone))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    arrow_types = [to_arrow_type(kinds[c]) for c in by] + [pa.int32(), pa.int32()]
    final = f"{ddl}, _run int, _at int"
    # runs meet by group and bucket first, so that a group of any size is spread over the buckets
    near = runs.withColumn("_bucket", F.shiftright("_run", BUCKET_BITS)).repartition(*groups, "_bucket").sortWithinPartitions(*groups, "_run", "_at")
    near = near.select(*fields).mapInArrow(merge, final)
    met = near.repartition(*groups).sortWithinPartitions(*groups, "_run", "_at")
    top = met.mapInArrow(merge, final).withColumnRenamed("_at", "rank")
    return top.select(*[F.col(a).alias(g) for g, a in zip(group, groups)], *[F.col(a).alias(i) for i, a in zip(item, items)], "rank")
