"""Tails, tests and fits on small arrays; likelihood-ratio column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_tail(x: float, df: int) -> float:
    """Upper tail of chi-square for whole degrees of freedom: a finite series."""
    if df <= 0 or x <= 0:
        return 1.0
    half = x / 2
    if df % 2 == 0:
        term = total = 1.0
        for k in range(1, df // 2):
            term *= half / k
            total += term
        return math.exp(-half) * total
    total = math.erfc(math.sqrt(half))
    term = math.sqrt(half) * math.exp(-half) / math.gamma(1.5)
    for k in range((df - 1) // 2):
        total += term
        term *= half / (1.5 + k)
    return total


def xlogy(x: Column, ratio: Column) -> Column:
    """x ln(ratio), 0 where x is 0."""
    return F.when(x > 0, x * F.ln(ratio)).otherwise(F.lit(0.0))


def two_cell_llr(k: Column, expected: Column, total: Column) -> Column:
    """2 (k ln(k/E) + (N-k) ln((N-k)/(N-E))); 0 where a logarithm does not exist."""
    ok = (k > 0) & (expected > 0) & (total > k) & (total > expected)
    return F.when(ok, 2 * (k * F.ln(k / expected) + (total - k) * F.ln((total - k) / (total - expected)))).otherwise(F.lit(0.0))


def bigram_g2(n12: Column, n1: Column, n2: Column, total: Column) -> Column:
    """Likelihood ratio of the 2 x 2 table of a bigram; cells that are empty or impossible add nothing."""
    cells = [(n12, n1 * n2), (n1 - n12, n1 * (total - n2)), (n2 - n12, (total - n1) * n2), (total - n1 - n2 + n12, (total - n1) * (total - n2))]
    out = F.lit(0.0)
    for observed, product in cells:
        out = out + F.when((observed > 0) & (product > 0), observed * F.ln(observed * total / product)).otherwise(F.lit(0.0))
    return 2 * out


def logit_fit(years: np.ndarray, hits: np.ndarray, totals: np.ndarray, rounds: int = 60) -> tuple[float, float, float]:
    """(intercept, slope, standard error of the slope) of a grouped binomial logit by Newton's method."""
    x = np.column_stack((np.ones(len(years)), years.astype(float)))
    share = hits.sum() / totals.sum() if totals.sum() else 0.0
    if not 0 < share < 1:
        return math.nan, math.nan, math.nan
    beta = np.array([math.log(share / (1 - share)), 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ beta))
        w = totals * p * (1 - p)
        info = x.T @ (x * w[:, None])
        step = np.linalg.solve(info, x.T @ (hits - totals * p))
        beta += step
        if np.abs(step).max() < 1e-13:
            break
    p = 1 / (1 + np.exp(-x @ beta))
    info = x.T @ (x * (totals * p * (1 - p))[:, None])
    return float(beta[0]), float(beta[1]), float(math.sqrt(np.linalg.inv(info)[1, 1]))


def multinomial_fit(design: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, bool]:
    """(log likelihood, coefficients, converged) of a grouped multinomial logit, last category as reference.

    design has a row for each cell, counts a row of category counts for each. Damped Newton steps.
    """
    n, k = counts.sum(axis=1), counts.shape[1] - 1
    p = design.shape[1]
    beta = np.zeros((p, k))
    share = counts.sum(axis=0) / max(1, counts.sum())
    if (share > 0).all():
        beta[0] = np.log(share[:-1] / share[-1])

    def loglik(b: np.ndarray) -> tuple[float, np.ndarray]:
        eta = np.column_stack((design @ b, np.zeros(len(design))))
        top = eta.max(axis=1, keepdims=True)
        lse = top[:, 0] + np.log(np.exp(eta - top).sum(axis=1))
        logp = eta - lse[:, None]
        return float((counts * logp).sum()), np.exp(logp)

    value, prob = loglik(beta)
    for _ in range(rounds):
        grad = design.T @ (counts - n[:, None] * prob)[:, :k]
        info = np.zeros((p * k, p * k))
        for a in range(k):
            for b in range(k):
                w = n * prob[:, a] * ((a == b) - prob[:, b])
                info[a::k, b::k] = design.T @ (design * w[:, None])
        step = np.linalg.lstsq(info, grad.reshape(-1), rcond=None)[0].reshape(p, k)
        scale = 1.0
        while scale > 1e-8:
            new, new_prob = loglik(beta + scale * step)
            if new >= value - 1e-12:
                break
            scale /= 2
        beta, gain, value, prob = beta + scale * step, new - value, new, new_prob
        if np.abs(grad).max() < 1e-9 * max(1, n.sum()) and gain < 1e-11 * max(1.0, abs(value)):
            return value, beta, True
    return value, beta, bool(np.abs(grad).max() < 1e-5 * max(1, n.sum()))
