"""Tests and fits on panels. Documents are summed to counts first; what is fitted has a row for each cell."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import chi2_tail, logit_fit, multinomial_fit, normal_two_sided
from .multiple import benjamini_hochberg


def pearson(p: DataFrame, row: str = "year", by: list[str] = ()) -> DataFrame:
    """(by..., n, chi2, df, cramers_v, min_expected) of the contingency table of row and field; all in SQL."""
    by = list(by)
    key = by or [F.lit(0)]
    t = p.withColumns({
        "r": F.sum("n").over(Window.partitionBy(*by, row)),
        "c": F.sum("n").over(Window.partitionBy(*by, "field")),
        "grand": F.sum("n").over(Window.partitionBy(*key)),
    }).where("r > 0 AND c > 0").withColumn("e", F.col("r") * F.col("c") / F.col("grand"))
    diff = F.col("n") - F.col("e")
    out = t.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum(diff * diff / F.col("e")).alias("chi2"), F.countDistinct(row).alias("rows"), F.countDistinct("field").alias("cols"), F.min("e").alias("min_expected")
    )
    least = F.least("rows", "cols") - 1
    return out.select(*by, "n", "chi2", ((F.col("rows") - 1) * (F.col("cols") - 1)).alias("df"), F.when(least > 0, F.sqrt(F.col("chi2") / (F.col("n") * least))).alias("cramers_v"), "min_expected")


def pearson_with_p(p: DataFrame, row: str = "year", by: list[str] = ()) -> DataFrame:
    @F.pandas_udf("double")
    def tail(x: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([chi2_tail(float(a), int(b)) for a, b in zip(x, df, strict=True)])

    return pearson(p, row, by).withColumn("p", tail("chi2", F.col("df").cast("long")))


def _trend_row(years: np.ndarray, hits: np.ndarray, totals: np.ndarray) -> dict:
    t = years - years.min()
    _, beta, se = logit_fit(t, hits, totals)
    z = beta / se if se and not math.isnan(se) else math.nan
    return {
        "beta": beta, "se": se, "z": z, "p": normal_two_sided(z) if not math.isnan(z) else math.nan, "odds_ratio": math.exp(beta),
        "or_low": math.exp(beta - 1.96 * se), "or_high": math.exp(beta + 1.96 * se), "percent_change": 100 * (math.exp(beta) - 1),
    }


_TREND = "beta double, se double, z double, p double, odds_ratio double, or_low double, or_high double, percent_change double"


def logit_trends(p: DataFrame, by: list[str] = (), exclude: list[str] = (), adjust: bool = True) -> DataFrame:
    """A binomial logit of each field's share on the year: slope, error, Wald test, odds ratio; q over the fields of each
    group. Fields in `exclude` are not tested."""
    by = list(by)
    cells = p.withColumn("total", F.sum("n").over(Window.partitionBy(*by, "year"))).where(~F.col("field").isin(*exclude) if exclude else F.lit(True))
    kinds = {f.name: f.dataType.simpleString() for f in p.schema}

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("year")
        got = _trend_row(rows["year"].to_numpy(float), rows["n"].to_numpy(float), rows["total"].to_numpy(float))
        return pd.DataFrame([dict(zip([*by, "field"], key, strict=True)) | got])

    names = ", ".join(f"{c} {kinds[c]}" for c in [*by, "field"])
    out = cells.groupBy(*by, "field").applyInPandas(fit, f"{names}, {_TREND}")
    return benjamini_hochberg(out, "p", "field", "q", by) if adjust else out


def leave_one_year_out(p: DataFrame) -> DataFrame:
    """The trends without each year in turn: one row for each omitted year and field."""
    years = p.select(F.col("year").alias("omitted")).distinct()
    return logit_trends(p.crossJoin(years).where("year <> omitted"), ["omitted"], adjust=False)


def interactions(p: DataFrame, group: str, first, second, exclude: list[str] = ()) -> DataFrame:
    """Whether a field's trend differs between two groups: slope of `second` minus slope of `first`.

    The logit with group, year and their product is saturated in the group, so the interaction is the difference of the
    groups' own slopes and its variance the sum of theirs.
    """
    t = logit_trends(p.where(F.col(group).isin(first, second)), [group], exclude, adjust=False)
    a = t.where(F.col(group) == first).select("field", F.col("beta").alias("b0"), F.col("se").alias("s0"))
    b = t.where(F.col(group) == second).select("field", F.col("beta").alias("b1"), F.col("se").alias("s1"))
    out = a.join(b, "field").select("field", (F.col("b1") - F.col("b0")).alias("coefficient"), F.sqrt(F.col("s0") ** 2 + F.col("s1") ** 2).alias("se"), F.exp("b0").alias("first_or"), F.exp("b1").alias("second_or"))

    @F.pandas_udf("double")
    def tail(z: pd.Series) -> pd.Series:
        return z.map(lambda v: None if v is None or math.isnan(v) else normal_two_sided(v))

    c, s = F.col("coefficient"), F.col("se")
    out = out.withColumns({"p": tail(c / s), "ratio": F.exp(c), "ratio_low": F.exp(c - 1.96 * s), "ratio_high": F.exp(c + 1.96 * s)})
    return benjamini_hochberg(out, "p", "field", "q")


def _matrix(rows: pd.DataFrame, keys: list[str]) -> tuple[pd.DataFrame, np.ndarray]:
    wide = rows.pivot_table(index=keys, columns="field", values="n", aggfunc="sum", fill_value=0).sort_index()
    wide = wide.loc[:, wide.sum() > 0]
    return wide.index.to_frame(index=False), wide.to_numpy(float)


def multinomial_trend(p: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by..., n, lr, df, p, pseudo_r2, converged): the multinomial logit with a year against the one without."""
    by = list(by)
    kinds = {f.name: f.dataType.simpleString() for f in p.schema}

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cells, counts = _matrix(rows, ["year"])
        t = cells["year"].to_numpy(float)
        full, _, ok = multinomial_fit(np.column_stack((np.ones(len(t)), t - t.min())), counts)
        share = counts.sum(axis=0) / counts.sum()
        null = float((counts.sum(axis=0) * np.log(share)).sum())
        lr, df = 2 * (full - null), counts.shape[1] - 1
        return pd.DataFrame([dict(zip(by, key, strict=False)) | {"n": int(counts.sum()), "lr": lr, "df": df, "p": chi2_tail(lr, df), "pseudo_r2": 1 - full / null if null else math.nan, "converged": ok}])

    names = "".join(f"{c} {kinds[c]}, " for c in by)
    grouped = p.groupBy(*by) if by else p.groupBy(F.lit(0).alias("__all"))
    return grouped.applyInPandas(fit, f"{names}n long, lr double, df int, p double, pseudo_r2 double, converged boolean")


def group_tests(p: DataFrame, group: str) -> DataFrame:
    """Likelihood-ratio tests on (group, year, field) counts of two groups: composition, group x linear year, group x
    categorical year. Models that are saturated in the group are fitted as sums over it."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        cells, counts = _matrix(rows, [group, "year"])
        keep = counts.sum(axis=1) > 0
        cells, counts = cells[keep].reset_index(drop=True), counts[keep]
        years = sorted(cells["year"].unique())
        g = (cells[group] == sorted(cells[group].unique())[-1]).to_numpy(float)
        t = cells["year"].to_numpy(float) - years[0]
        one = np.ones(len(cells))
        dummies = np.column_stack([one, *[(cells["year"] == y).to_numpy(float) for y in years[1:]]])
        k = counts.shape[1] - 1
        log = lambda x: np.log(np.where(x > 0, x, 1))
        by_year = np.array([counts[cells["year"] == y].sum(axis=0) for y in years])
        years_only = float((by_year * log(by_year / by_year.sum(axis=1, keepdims=True))).sum())
        additive, _, ok1 = multinomial_fit(np.column_stack((dummies, g)), counts)
        saturated = float((counts * log(counts / counts.sum(axis=1, keepdims=True))).sum())
        linear, _, ok2 = multinomial_fit(np.column_stack((one, g, t)), counts)
        apart, oks = 0.0, []
        for v in (0.0, 1.0):
            value, _, ok = multinomial_fit(np.column_stack((one, t))[g == v], counts[g == v])
            apart += value
            oks.append(ok)
        rows_out = [
            ("group composition", 2 * (additive - years_only), k, ok1),
            ("group x linear year", 2 * (apart - linear), k, ok2 and all(oks)),
            ("group x categorical year", 2 * (saturated - additive), k * (len(years) - 1), ok1),
        ]
        n = int(counts.sum())
        return pd.DataFrame([{"test": a, "n": n, "lr": lr, "df": df, "p": chi2_tail(lr, df), "converged": c} for a, lr, df, c in rows_out])

    return p.groupBy(F.lit(0).alias("__all")).applyInPandas(run, "test string, n long, lr double, df int, p double, converged boolean")


def saturated_loglik(p: DataFrame, cell: list[str]) -> DataFrame:
    """(loglik): the sum of c ln(c / n) over cells, in SQL."""
    t = p.withColumn("t", F.sum("n").over(Window.partitionBy(*cell)))
    return t.where("n > 0").agg(F.sum(F.col("n") * F.ln(F.col("n") / F.col("t"))).alias("loglik"))
