"""Best-fit-decreasing bin packing of indivisible groups into shards, in two levels.

Groups (rows with an equal key) are packed where they lie: the groups of one part of the key space go best-fit-decreasing
into crates, fixed-capacity bins far smaller than a shard. Crates, and the few groups that are larger than a crate, then
go best-fit-decreasing into the shards; there are a bounded number of them (a few for each crate's worth of bytes and one
for each part), so that step runs on the driver. The shard capacity is the smallest for which the shards asked for
suffice, which makes their sizes near equal. Both steps find the tightest bin in a balanced tree of remaining capacities.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, own_names

#: Crates for each shard; the crate's capacity is a shard's mean size divided by this.
CRATES = 64
#: Groups that one part packs, about.
PART_GROUPS = 50_000
#: Slices of a group whose rows are numbered apart, so a huge group does not meet in one task.
SLICES = 64


class RoomTree:
    """Remaining capacities in a weight-balanced tree: insert, and take out the tightest that fits.

    Nodes are kept in arrays; a subtree that leans too far is rebuilt, which keeps the height logarithmic.
    """

    def __init__(self) -> None:
        self.root: list | None = None  # [room, bin, left, right, size]

    @staticmethod
    def _size(node) -> int:
        return node[4] if node else 0

    def _flat(self, node, out: list) -> list:
        stack = []
        while stack or node:
            while node:
                stack.append(node)
                node = node[2]
            node = stack.pop()
            out.append((node[0], node[1]))
            node = node[3]
        return out

    def _build(self, keys: list, lo: int, hi: int):
        if lo >= hi:
            return None
        mid = (lo + hi) // 2
        return [*keys[mid], self._build(keys, lo, mid), self._build(keys, mid + 1, hi), hi - lo]

    def insert(self, room: int, bin_: int) -> None:
        key, path, node = (room, bin_), [], self.root
        while node:
            node[4] += 1
            side = 2 if key < (node[0], node[1]) else 3
            path.append((node, side))
            node = node[side]
        new = [room, bin_, None, None, 1]
        if not path:
            self.root = new
            return
        path[-1][0][path[-1][1]] = new
        for k, (node, _) in enumerate(path):
            if max(self._size(node[2]), self._size(node[3])) > 0.7 * node[4] + 1:
                built = self._build(self._flat(node, []), 0, node[4])
                if k:
                    path[k - 1][0][path[k - 1][1]] = built
                else:
                    self.root = built
                break

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the (room, bin) with the least room of at least size, or None."""
        best, node = None, self.root
        while node:
            if node[0] >= size:
                best, node = node, node[2]
            else:
                node = node[3]
        if best is None:
            return None
        room, bin_ = best[0], best[1]
        self._remove((room, bin_))
        return room, bin_

    def _remove(self, key: tuple[int, int]) -> None:
        parent, side, node = None, 0, self.root
        while (node[0], node[1]) != key:
            node[4] -= 1
            parent, side = node, 2 if key < (node[0], node[1]) else 3
            node = node[side]
        if node[2] and node[3]:
            node[4] -= 1
            up, down, at = node, node[3], 3
            while down[2]:
                down[4] -= 1
                up, down, at = down, down[2], 2
            node[0], node[1] = down[0], down[1]
            up[at] = down[3]
            return
        child = node[2] or node[3]
        if parent:
            parent[side] = child
        else:
            self.root = child


def best_fit_decreasing(sizes: np.ndarray, capacity: int, limit: int | None = None) -> np.ndarray | None:
    """The bin of each size, ties in the order given; None if more than `limit` bins would be needed. A size over the
    capacity gets a bin of its own."""
    tree, n, out = RoomTree(), 0, np.zeros(len(sizes), np.int64)
    order = np.argsort(-sizes, kind="stable")
    for i, s in zip(order.tolist(), sizes[order].tolist(), strict=True):
        found = tree.take(s)
        if found is None:
            if limit is not None and n == limit:
                return None
            found, n = (capacity, n), n + 1
        out[i] = found[1]
        if found[0] > s:
            tree.insert(found[0] - s, found[1])
    return out


def into_shards(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Best-fit-decreasing with the smallest capacity (to one part in 2^14 of the mean) that needs no more shards."""
    low = max(math.ceil(int(sizes.sum()) / shards), int(sizes.max()))
    step = max(1, low >> 14)
    bins = best_fit_decreasing(sizes, low, shards)
    k, bad = 1, 0
    while bins is None:
        bins = best_fit_decreasing(sizes, low + k * step, shards)
        if bins is None:
            bad, k = k, 2 * k
    good = k
    while good - bad > 1:
        mid = (good + bad) // 2
        found = best_fit_decreasing(sizes, low + mid * step, shards)
        if found is None:
            bad = mid
        else:
            bins, good = found, mid
    return bins


def shard_groups(rows: DataFrame, key: list[str], size: str, shards: int) -> DataFrame:
    """Give each row of `rows` a shard from 0 and a gapless slot there; rows with an equal key share a shard.

    `size` is a column of positive integers, equal for equal keys. A null key is a key like any other. Returns all the
    columns of rows and shard int, slot long (replaced if they are there already). A group larger than a mean shard
    cannot be split; it then sets the capacity. An empty table gives no rows. Rows of one group are numbered in
    slices, so a group with a third of all rows is spread over many tasks; rows in a slice are ordered by their
    content, and equal rows get different slots.
    """
    inputs = {f"key_{i}": c for i, c in enumerate(key)} | {"size": size}
    return own_names(rows, inputs, ["shard", "slot"], lambda inner, size, **keys: _shard_groups(inner, list(keys.values()), size, shards))


def _shard_groups(rows: DataFrame, key: list[str], size: str, shards: int) -> DataFrame:
    spark = rows.sparkSession
    given = list(rows.columns)
    order = [F.xxhash64(*given), *[F.col(c) for c in given]]
    rows = rows.select(*given, F.struct(*key).alias("__k"), F.col(size).cast("long").alias("__s"), F.pmod(F.xxhash64(*given, F.lit(7)), F.lit(SLICES)).cast("int").alias("__c"))
    rows = materialize(rows, "rows")
    cells = rows.groupBy("__k", "__c").agg(F.count("*").alias("__n"), F.max("__s").alias("__s"))
    cells = materialize(cells, "cells")
    groups = cells.groupBy("__k").agg(F.sum("__n").alias("__n"), F.sum(F.col("__n") * F.col("__s")).alias("__b"))
    groups = materialize(groups, "groups")
    n_groups, total, = groups.agg(F.count("*"), F.sum("__b")).first()
    if not n_groups:
        return rows.select(*given, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).limit(0)
    capacity = max(1, total // (shards * CRATES))
    parts = max(1, math.ceil(n_groups / PART_GROUPS))

    def crate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = list(batches)
        if not got:
            return
        t = pa.Table.from_batches(got)
        n, b = t["__n"].to_numpy(), t["__b"].to_numpy()
        bins = best_fit_decreasing(b, capacity)
        order = np.argsort(bins, kind="stable")
        bins, n, t = bins[order], n[order], t.take(pa.array(order))
        before = np.cumsum(n) - n
        head = np.concatenate(([True], bins[1:] != bins[:-1]))
        base = before - np.maximum.accumulate(np.where(head, before, 0))
        t = t.append_column("__crate", pa.array(bins + (TaskContext.get().partitionId() << 32), pa.int64()))
        t = t.append_column("__base", pa.array(base, pa.int64()))
        yield from t.to_batches(max_chunksize=10_000)

    kind = groups.schema["__k"].dataType.simpleString()
    # dealt by round robin over sorted rows: even, and the same when a task runs again
    placed = groups.repartition(parts).mapInArrow(crate, f"__k {kind}, __n long, __b long, __crate long, __base long")
    placed = materialize(placed, "placed")
    crates = placed.groupBy("__crate").agg(F.sum("__n").alias("n"), F.sum("__b").alias("b")).orderBy("__crate").toPandas()
    crates["shard"] = into_shards(crates["b"].to_numpy(), shards)
    crates["first"] = crates.groupby("shard")["n"].cumsum() - crates["n"]
    where = spark.createDataFrame(crates[["__crate", "shard", "first"]], "__crate long, shard int, first long")
    by_group = placed.join(where, "__crate").select("__k", "shard", (F.col("first") + F.col("__base")).alias("__at"))
    w = Window.partitionBy("__k").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    by_cell = cells.select("__k", "__c", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    by_cell = by_cell.join(by_group, "__k").select("__k", "__c", "shard", (F.col("__off") + F.col("__at")).alias("__at"))
    w = Window.partitionBy("__k", "__c").orderBy(*order)
    numbered = rows.withColumn("__i", F.row_number().over(w).cast("long") - 1)
    return numbered.join(by_cell, ["__k", "__c"]).select(*given, F.col("shard").cast("int"), (F.col("__at") + F.col("__i")).alias("slot"))
