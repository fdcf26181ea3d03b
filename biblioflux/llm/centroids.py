"""Centroid clustering on integer vectors with Drake's adaptive bounds.

Each vector carries its cluster, an upper bound of the distance to its centroid, lower bounds of the distances to its
several next nearest centroids and one remainder bound for all others. When the centroids move, the bounds move along.
A vector whose upper bound lies below all lower bounds stays where it is; one whose order cannot be certified is
measured again, exactly, against those centroids alone whose bounds do not rule them out. Bounds are floats that are
rounded outwards; distances are exact integers, so the clusters are those of plain assignment, ties included.

A round is one narrow pass over the table of vectors: it writes vectors and bounds to the shared folder, and for each
task the sums of its clusters, which Spark adds up. The driver holds the centroids only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from .common import materialize, release

#: Sums are carried in two parts, the lower one of so many bits, so that any number of rows adds up exactly.
LIMB = 62
#: The largest finite component, that of a 32-bit float; larger ones count as infinite.
LARGEST = 3.4028235e38
_UP, _DOWN = 1 + 1e-12, 1 - 1e-12


class Found(NamedTuple):
    """vectors: (id, vector, cluster, distance), distance null beyond a long; centroids: the final ones, integers;
    measured: for each round but the last, the vectors measured against some centroids and those against all."""

    vectors: DataFrame
    centroids: list[list[int]]
    measured: list[tuple[int, int]]


def usable(embedding: str, dim: int) -> Column:
    """True for vectors with exactly `dim` components, none null or non-finite."""
    c = F.col(embedding)
    fine = F.forall(c, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= LARGEST), F.lit(False)))
    return F.coalesce((F.size(c) == dim) & fine, F.lit(False))


class Metric:
    """Exact squared distances of integer vectors: by float products where these are exact, else by Python's integers."""

    def __init__(self, centroids: list[list[int]]):
        self.exact = np.array(centroids, object)
        self.k, self.dim = self.exact.shape
        self.limit = int((2.0**53 / (4 * self.dim)) ** 0.5)
        self.small = max((abs(x) for c in centroids for x in c), default=0) <= self.limit
        self.plain = np.array(centroids, np.float64) if self.small else None
        self.norm = (self.plain**2).sum(1) if self.small else None

    def all(self, x: np.ndarray) -> np.ndarray:
        if self.small and x.dtype != object:
            return ((x**2).sum(1)[:, None] - 2 * (x @ self.plain.T) + self.norm).astype(np.int64)
        d = whole(x)[:, None, :] - self.exact[None]
        return (d * d).sum(2)

    def to(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        if self.small and x.dtype != object:
            d = x - self.plain[cluster]
            return np.einsum("ij,ij->i", d, d).astype(np.int64)
        d = whole(x) - self.exact[cluster]
        return (d * d).sum(1)


def whole(x: np.ndarray) -> np.ndarray:
    """Integer-valued floats as Python's integers."""
    return x if x.dtype == object else np.vectorize(int, otypes=[object])(x) if x.size else x.astype(object)


def integers(x: np.ndarray, scale: int, limit: int) -> np.ndarray:
    """floor(scale x): floats where all are small enough for exact products, else Python's integers."""
    x = np.floor(x.astype(np.float64) * scale)
    return whole(x) if x.size and np.abs(x).max() > limit else x


def _root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


class Bounds(NamedTuple):
    cluster: np.ndarray  # n
    upper: np.ndarray  # n
    near: np.ndarray  # n x b, centroids other than the own one
    low: np.ndarray  # n x b
    rest: np.ndarray  # n


def full_scan(x: np.ndarray, metric: Metric, b: int) -> Bounds:
    """All distances; ties go to the smaller number."""
    d = metric.all(x)
    order = np.argsort(d, axis=1, kind="stable")
    far = _root(np.take_along_axis(d, order, 1)) if d.size else np.zeros(d.shape)
    rest = far[:, b + 1] * _DOWN if metric.k > b + 1 else np.full(len(x), np.inf)
    return Bounds(order[:, 0].astype(np.int32), far[:, 0] * _UP, order[:, 1 : b + 1].astype(np.int32), far[:, 1 : b + 1] * _DOWN, rest)


def moved_bounds(s: Bounds, moves: np.ndarray) -> Bounds:
    """The bounds after centroid j has moved by moves[j]."""
    return Bounds(s.cluster, (s.upper + moves[s.cluster]) * _UP, s.near, (s.low - moves[s.near]) * _DOWN, (s.rest - moves.max(initial=0.0)) * _DOWN)


def reassign(x: np.ndarray, s: Bounds, metric: Metric) -> tuple[Bounds, int, int]:
    """(bounds, the vectors measured against some centroids, those measured against all), the clusters being exact."""
    b = s.near.shape[1]
    cluster, upper, near, low, rest = (a.copy() for a in s)
    lowest = np.minimum(low.min(1, initial=np.inf), rest)
    open_ = np.flatnonzero(upper >= lowest)
    if len(open_):  # first the true distance to the own centroid
        upper[open_] = _root(metric.to(x[open_], cluster[open_])) * _UP
        open_ = open_[upper[open_] >= lowest[open_]]
    again = open_[upper[open_] >= rest[open_]]
    some = open_[upper[open_] < rest[open_]]
    if len(some):  # only tracked centroids can be nearer: measure those, and put them in order
        at = np.concatenate([cluster[some, None], near[some]], axis=1)
        doubtful = np.concatenate([np.ones((len(some), 1), bool), low[some] <= upper[some, None]], axis=1)
        row, col = np.nonzero(doubtful)
        d = metric.to(x[some[row]], at[row, col])
        # the nearest of each row; of equal ones the smaller number
        key = np.lexsort((at[row, col], d, row)) if d.dtype != object else np.array(sorted(range(len(d)), key=lambda i: (row[i], d[i], at[row[i], col[i]])))
        best = key[np.concatenate(([True], row[key][1:] != row[key][:-1]))]
        bound = np.concatenate([upper[some, None], low[some]], axis=1)
        bound[row, col] = _root(d) * _DOWN
        first = col[best]
        line = np.arange(len(some))
        cluster[some], upper[some] = at[line, first], _root(d[best]) * _UP
        bound[line, first] = -1.0
        order = np.argsort(bound, axis=1, kind="stable")[:, 1:]
        near[some] = np.take_along_axis(at, order, 1)
        low[some] = np.take_along_axis(bound, order, 1)
    if len(again):
        f = full_scan(x[again], metric, b)
        cluster[again], upper[again], near[again], low[again], rest[again] = f
    return Bounds(cluster, upper, near, low, rest), len(some), len(again)


def _tasks_sums(x: np.ndarray, cluster: np.ndarray, k: int, sums: list[list[int]], counts: list[int]) -> None:
    for j in np.unique(cluster).tolist():
        own = x[cluster == j]
        counts[j] += len(own)
        step = own.sum(0) if own.dtype == object else own.astype(np.int64).sum(0)
        sums[j] = [p + int(q) for p, q in zip(sums[j], step, strict=True)]


def cluster_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, bounds: int | None = None) -> Found:
    """Cluster the usable vectors of df into at most k clusters, exactly as plain rounds of assignment and floor means do.

    Components become floor(scale x). Centroids start as the k usable vectors with the smallest sha256 of
    `seed:id`, in that order; vectors of one id, which tie, are ordered by their components. In each round every vector
    goes to the nearest centroid (ties: the smaller number), and every centroid that has vectors becomes their
    componentwise floor(sum / count). `bounds` nearest centroids are tracked for each vector, a quarter of k and two at
    least by default.

    Null, short, long and non-finite vectors are left out. Rows repeated, or with equal ids, are vectors of their own;
    a null id counts as an empty one where ids are hashed and stays null. With fewer than k vectors there are fewer
    centroids; an empty table gives no rows. Other columns are not read. A distance beyond a long is null.
    """
    ids = df.schema[vec_id].dataType.simpleString()
    kind = df.schema[embedding].dataType
    if not isinstance(kind, ArrayType) or not isinstance(kind.elementType, (FloatType, DoubleType)):
        raise TypeError(f"{embedding} must be an array of floats or doubles")
    number = kind.elementType.simpleString()
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    vectors = df.select(q(vec_id).alias("id"), q(embedding).alias("v")).where(usable("v", dim))
    start = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = vectors.select(start.alias("h"), "v").orderBy("h", "v").limit(k).collect()  # k rows
    centroids = [[int(c) for c in np.floor(np.array(r["v"], np.float64) * scale)] for r in first]
    if not centroids:
        return Found(vectors.select(F.col("id").alias(vec_id), F.col("v").alias(embedding), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), [], [])
    b = min(len(centroids) - 1, bounds or max(2, k // 4))
    state = f"id {ids}, v array<{number}>, cluster int, upper double, near array<int>, low array<double>, rest double"
    total = "part int, sums array<struct<hi: decimal(38,0), lo: decimal(38,0)>>, n long, some long, every long"

    def a_round(old: DataFrame | None, centroids: list[list[int]], moves: np.ndarray | None) -> DataFrame:
        k = len(centroids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            metric = Metric(centroids)
            sums, counts, some, every = [[0] * dim for _ in range(k)], [0] * k, 0, 0
            names = [*[c.split(" ")[0] for c in state.split(", ")], "part", "sums", "n", "some", "every"]
            limbs = pa.list_(pa.struct([("hi", pa.decimal128(38, 0)), ("lo", pa.decimal128(38, 0))]))
            types = [pa.list_(pa.float32() if number == "float" else pa.float64()), pa.int32(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.float64(), pa.int32(), limbs, pa.int64(), pa.int64(), pa.int64()]
            id_type = None
            for batch in batches:
                n, id_type = batch.num_rows, batch.schema.field(0).type
                if not n:
                    continue
                x = integers(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, dim), scale, metric.limit)
                if moves is None:
                    s, m = full_scan(x, metric, b), (0, n)
                else:
                    near, low = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(n, b) for i in (4, 5))
                    held = Bounds(batch.column(2).to_numpy(), batch.column(3).to_numpy(), near, low, batch.column(6).to_numpy())
                    s, *m = reassign(x, moved_bounds(held, moves), metric)
                some, every = some + m[0], every + m[1]
                _tasks_sums(x, s.cluster, k, sums, counts)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * b), pa.array(a.ravel(), t)) for a, t in ((s.near, pa.int32()), (s.low, pa.float64()))]
                rows = [batch.column(0), batch.column(1).cast(types[0]), pa.array(s.cluster, pa.int32()), pa.array(s.upper), lists[0], lists[1], pa.array(s.rest)]
                yield pa.RecordBatch.from_arrays([*rows, *[pa.nulls(n, t) for t in types[6:]]], names=names)
            if id_type is not None:  # the task's sums, a row for each cluster
                mask = (1 << LIMB) - 1
                parts = [[{"hi": v >> LIMB, "lo": v & mask} for v in c] for c in sums]
                tail = [pa.array(range(k), pa.int32()), pa.array(parts, limbs), pa.array(counts, pa.int64()), pa.array([some] + [0] * (k - 1), pa.int64()), pa.array([every] + [0] * (k - 1), pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.nulls(k, id_type), *[pa.nulls(k, t) for t in types[:6]], *tail], names=names)

        rows = (vectors if old is None else old.where("part IS NULL").select(*[c.split(" ")[0] for c in state.split(", ")]))
        return materialize(rows.mapInArrow(run, f"{state}, {total}"), "drake")

    def updated(t: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
        long = t.where("part IS NOT NULL").select("part", "n", "some", "every", F.posexplode("sums").alias("j", "x"))
        sums = [F.sum(c).alias(a) for c, a in (("x.hi", "hi"), ("x.lo", "lo"), ("n", "n"), ("some", "some"), ("every", "every"))]
        rows = long.groupBy("part", "j").agg(*sums).collect()  # k x dim rows
        measured.append(max((r["some"], r["every"]) for r in rows if r["part"] == 0))
        out = [list(c) for c in centroids]
        for r in rows:
            if r["n"]:
                out[r["part"]][r["j"]] = ((int(r["hi"]) << LIMB) + int(r["lo"])) // r["n"]
        return out

    table, moves, measured = None, None, []
    for turn in range(rounds + 1):
        old, table = table, a_round(table, centroids, moves)
        if old is not None:
            release(old)
        if turn < rounds:
            new = updated(table, centroids)
            moves = np.array([float(sum((p - q) ** 2 for p, q in zip(x, y, strict=True))) ** 0.5 for x, y in zip(centroids, new, strict=True)]) * _UP
            centroids = new
    final = centroids

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        metric = Metric(final)
        for batch in batches:
            x = integers(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim), scale, metric.limit)
            d = metric.to(x, batch.column(2).to_numpy())
            d = pa.array(d, pa.int64()) if d.dtype != object else pa.array([int(v) if v < 1 << 63 else None for v in d], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, d], names=["id", "v", "cluster", "distance"])

    out = table.where("part IS NULL").select("id", "v", "cluster").mapInArrow(measure, f"id {ids}, v array<{number}>, cluster int, distance long")
    return Found(out.select(F.col("id").alias(vec_id), F.col("v").alias(embedding), "cluster", "distance"), final, measured)


def with_inertia(found: Found) -> DataFrame:
    """The vectors with cluster_inertia, inertia (null where a distance is, or beyond a long) and centroid_sha256, the
    hash of the final centroid's components as decimal integers joined by commas."""
    total = F.when(F.count_if(F.col("distance").isNull()) == 0, F.sum(F.col("distance").cast("decimal(38,0)")))
    rows = found.vectors.groupBy("cluster").agg(total.alias("s")).collect()  # k rows
    sums = {r["cluster"]: None if r["s"] is None else int(r["s"]) for r in rows}
    every = None if None in sums.values() else sum(sums.values())
    fits = lambda v: v if v is not None and v < 1 << 63 else None
    told = [(j, fits(sums.get(j)), fits(every), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(found.centroids)]
    side = found.vectors.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.vectors.join(F.broadcast(side), "cluster")
