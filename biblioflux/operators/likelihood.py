"""Multinomial logits of individual rows by maximum likelihood, gradient and information being sums over the cluster."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import chi2_tail
from ..scratch import forget, written


class NotConverged(RuntimeError):
    """The likelihood has no maximum that Newton's method reaches, as for a category that the design sets apart."""


@dataclass(frozen=True)
class Fit:
    names: list[str]
    categories: list[str]
    beta: np.ndarray  # a row for each column of the design, a column for each category but the last
    loglik: float
    n: int
    rounds: int


def intercept() -> list[tuple[str, Column]]:
    return [("one", F.lit(1.0))]


def linear(column: str, start: float = 0.0) -> list[tuple[str, Column]]:
    """The column less its start."""
    return [(column, F.col(column).cast("double") - start)]


def dummies(column: str, levels: list) -> list[tuple[str, Column]]:
    """A column for each level but the first."""
    return [(f"{column}={v}", (F.col(column) == v).cast("double")) for v in levels[1:]]


def crossed(a: list[tuple[str, Column]], b: list[tuple[str, Column]]) -> list[tuple[str, Column]]:
    """Products of every column of a with every one of b, as group x year dummies."""
    return [(f"{x}:{y}", c * d) for x, c in a for y, d in b]


def _sums(batch: pa.RecordBatch, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    p, k = beta.shape
    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
    y, w = batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(float)
    eta = np.column_stack((x @ beta, np.zeros(len(x))))
    eta -= eta.max(axis=1, keepdims=True)
    logp = eta - np.log(np.exp(eta).sum(axis=1, keepdims=True))
    prob = np.exp(logp)[:, :k]
    hit = (y[:, None] == np.arange(k)).astype(float)
    gradient = x.T @ (w[:, None] * (hit - prob))
    information = np.zeros((p, k, p, k))
    for a in range(k):
        for b in range(a, k):
            m = x.T @ (x * (w * prob[:, a] * ((a == b) - prob[:, b]))[:, None])
            information[:, a, :, b] = m
            information[:, b, :, a] = m
    return float((w * logp[np.arange(len(y)), y]).sum()), gradient, information


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: np.ndarray | None = None
    for batch in batches:
        for raw in batch.column(batch.num_columns - 1).to_pylist():
            part = np.frombuffer(raw)
            total = part.copy() if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def fit_multinomial(df: DataFrame, category: str, design: list[tuple[str, Column]], rounds: int = 60, tolerance: float = 1e-10, largest: float = 25.0) -> Fit:
    """Fit the logit of `category` (its last value, in order, being the reference) on the columns of the design.

    Rows that agree in the design and the category are counted together once, and that table is written. In each round its
    tasks sum likelihood, gradient and information for the present coefficients, which are all that the driver sends out,
    and 32 sums at most come back. Steps are halved until the likelihood does not fall. Raises NotConverged when the
    rounds run out, when the information has no inverse or when a coefficient passes `largest`. Rows with a null
    category or a null in the design are left out.
    """
    names = [n for n, _ in design]
    x = F.array(*[c.cast("double") for _, c in design])
    rows = df.where(F.col(category).isNotNull()).select(x.alias("x"), F.col(category).cast("string").alias("y"))
    rows = rows.where(~F.exists("x", lambda v: v.isNull()))
    cells = written(rows.groupBy("x", "y").agg(F.count("*").alias("w")), "cells")
    seen = {r["y"]: r["n"] for r in cells.groupBy("y").agg(F.sum("w").alias("n")).collect()}  # a row for each category
    categories = sorted(seen)
    n, p, k = sum(seen.values()), len(names), len(categories) - 1
    if k < 1 or not n:
        raise ValueError("a fit needs two categories")
    code = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col("y")).cast("int") - 1
    coded = cells.select("x", code.alias("y"), "w")

    def evaluate(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + p * k + (p * k) ** 2)
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    value, gradient, information = _sums(batch.slice(at, 4096), beta)
                    total += np.concatenate(([value], gradient.ravel(), information.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        parts = coded.mapInArrow(run, "sums binary")
        few = parts.repartition(min(32, max(1, parts.rdd.getNumPartitions()))) if parts.rdd.getNumPartitions() > 32 else parts
        total = sum(np.frombuffer(r["sums"]) for r in few.mapInArrow(_add, "sums binary").collect())
        return float(total[0]), total[1 : 1 + p * k], total[1 + p * k :].reshape(p * k, p * k)

    beta = np.zeros((p, k))
    value, gradient, information = evaluate(beta)
    try:
        for turn in range(1, rounds + 1):
            try:
                if np.linalg.cond(information) > 1e14:
                    raise np.linalg.LinAlgError
                step = np.linalg.solve(information, gradient).reshape(p, k)
            except np.linalg.LinAlgError:
                raise NotConverged("the information has no inverse: a category is set apart or columns depend on each other") from None
            scale = 1.0
            while True:
                new = evaluate(beta + scale * step)
                if new[0] >= value - 1e-9 * max(1.0, abs(value)) or scale < 1e-6:
                    break
                scale /= 2
            beta, gain = beta + scale * step, new[0] - value
            value, gradient, information = new
            if np.abs(beta).max() > largest:
                raise NotConverged(f"a coefficient passed {largest}: the likelihood has no maximum")
            if np.abs(scale * step).max() < tolerance ** 0.5 and abs(gain) <= tolerance * max(1.0, abs(value)):
                return Fit(names, categories, beta, value, n, turn)
        raise NotConverged(f"no maximum in {rounds} rounds")
    finally:
        forget(cells)


def likelihood_ratio(full: Fit, reduced: Fit) -> tuple[float, int, float]:
    """(statistic, degrees of freedom, p) of a model against one whose design is part of its own."""
    if full.categories != reduced.categories or full.n != reduced.n:
        raise ValueError("the fits are of different rows")
    lr, df = 2 * (full.loglik - reduced.loglik), (len(full.names) - len(reduced.names)) * (len(full.categories) - 1)
    return lr, df, chi2_tail(lr, df)
