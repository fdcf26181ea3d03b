"""The study of trends over several scopes of one classification: fits, scans, resampling and the table of key signals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rand import scope_seed
from ..sources.sinks import markdown_report
from . import inference, panel, resample, scans
from .multiple import benjamini_hochberg


@dataclass(frozen=True)
class Study:
    """Tables by scope: overall tests, trends with their bootstrap, best splits and lowest windows with scan-adjusted p."""

    overall: DataFrame
    trends: DataFrame
    changes: DataFrame
    lows: DataFrame


def scope_tests(p: DataFrame) -> DataFrame:
    """(scope, n, chi2, chi2_df, chi2_p, cramers_v, min_expected, lr, lr_df, lr_p, pseudo_r2, converged): Pearson's test and
    the multinomial logit of the year, for each scope of a panel (scope, year, field, n)."""
    pearson = inference.pearson_with_p(p, "year", ["scope"]).withColumnsRenamed({"df": "chi2_df", "p": "chi2_p"})
    ratio = inference.multinomial_trend(p, ["scope"]).withColumnsRenamed({"df": "lr_df", "p": "lr_p"}).drop("n")
    return pearson.join(ratio, "scope")


def scope_study(p: DataFrame, scopes: list[str], permutations: int, bootstraps: int, seed: int) -> Study:
    """All tables for the scopes of a panel (scope, year, field, n), which are a handful. The k-th scope's resampling has the
    seeds of scope_seed()."""
    nulls: dict[str, list[DataFrame]] = {"split_z": [], "low_window": []}
    boots = []
    for k, scope in enumerate(scopes):
        own = p.where(F.col("scope") == scope).drop("scope")
        for kind, tables in nulls.items():
            table = resample.permutation_scan(own, kind, permutations, scope_seed(seed, k), min_side=2)
            tables.append(table.select(F.lit(scope).alias("scope"), "field", F.col("p").alias("scan_p")))
        boots.append(resample.bootstrap_trends(own, bootstraps, scope_seed(seed, k, bootstrap=True)).withColumn("scope", F.lit(scope)))
    joined = {kind: tables[0] if len(tables) == 1 else panel.stacked(tables) for kind, tables in nulls.items()}
    boot = panel.stacked(boots)
    changes = scans.best(scans.split_scan(p, ["scope"]), ["scope"], F.abs("z"), "cut").join(joined["split_z"], ["scope", "field"])
    lows = scans.best(scans.window_scan(p, ["scope"]), ["scope"], F.col("z"), "start").join(joined["low_window"], ["scope", "field"])
    stable = boot.select("scope", "field", "cut_frequency", "window_frequency")
    return Study(
        scope_tests(p),
        panel.attach(inference.logit_trends(p, ["scope"]), boot.drop("cut_frequency", "window_frequency"), ["scope", "field"]),
        panel.attach(benjamini_hochberg(changes, "scan_p", "field", "scan_q", ["scope"]), stable.drop("window_frequency"), ["scope", "field"]),
        panel.attach(benjamini_hochberg(lows, "scan_p", "field", "scan_q", ["scope"]), stable.drop("cut_frequency"), ["scope", "field"]),
    )


def key_signals(study: Study, trend: str, split: str, low: str) -> DataFrame:
    """(scope, signal, field, effect, unit, p, q, stability, structure): the trend of one field, the change point of a
    second and the low window of a third, in each scope; differences in percentage points."""
    pick = lambda t, f: t.where(F.col("field") == f)
    a = pick(study.trends, trend).select("scope", F.lit("linear trend").alias("signal"), "field", F.col("odds_ratio").alias("effect"), F.lit("odds ratio per year").alias("unit"), "p", "q", F.col("share_or_above_1").alias("stability"), F.lit("linear").alias("structure"))
    b = pick(study.changes, split).select("scope", F.lit("change point"), "field", F.col("diff") * 100, F.lit("later minus earlier, points"), "scan_p", "scan_q", "cut_frequency", scans.split_label())
    c = pick(study.lows, low).select("scope", F.lit("low window"), "field", F.col("diff") * 100, F.lit("outside minus inside, points"), "scan_p", "scan_q", "window_frequency", scans.window_label())
    return a.union(b).union(c)


def by_scope(signals: DataFrame, scopes: list[str], value: str = "effect") -> DataFrame:
    """(signal, a column for each scope): the long table of signals made wide."""
    return signals.groupBy("signal").pivot("scope", scopes).agg(F.first(value))


def narrative(study: Study, level: float = 0.05) -> list[str]:
    """Sentences on each scope, all numbers taken from the tables: the overall tests, which fields have a trend, a change
    point or a low window below the level after adjustment, and how stable these are."""
    overall = study.overall.orderBy("scope").collect()  # a row for each scope; the other tables have one for each field too
    out = []
    for o in overall:
        lines = [f"Scope {o.scope}: {o.n} rows; chi-square {o.chi2:.2f} on {o.chi2_df} degrees of freedom (p = {o.chi2_p:.4f}), likelihood ratio of the year {o.lr:.2f} on {o.lr_df} (p = {o.lr_p:.4f})."]
        mine = lambda t: t.where(F.col("scope") == o.scope)  # noqa: B023, E731
        trends = mine(study.trends).where(F.col("q") < level).orderBy("q", "field").collect()
        lines += [f"{r.field} has a trend: odds ratio {r.odds_ratio:.3f} a year ({r.or_low:.3f} to {r.or_high:.3f}, q = {r.q:.4f}); {100 * r.share_or_above_1:.0f} % of the bootstrap draws lie above 1." for r in trends]
        changes = mine(study.changes).where(F.col("scan_q") < level).orderBy("scan_q", "field").collect()
        lines += [f"{r.field} changes after {r.cut}: {100 * r['diff']:+.1f} points (scan-adjusted p = {r.scan_p:.4f}, q = {r.scan_q:.4f}), a split chosen in {100 * r.cut_frequency:.0f} % of the draws." for r in changes]
        lows = mine(study.lows).where(F.col("scan_q") < level).orderBy("scan_q", "field").collect()
        lines += [f"{r.field} is low from {r.start} on: {100 * r['diff']:+.1f} points outside the window (scan-adjusted p = {r.scan_p:.4f}, q = {r.scan_q:.4f}), chosen in {100 * r.window_frequency:.0f} % of the draws." for r in lows]
        if len(lines) == 1:
            lines.append(f"No field has a trend, a change point or a low window at the level {level:g}.")
        out.append(" ".join(lines))
    return out


def study_report(study: Study, title: str = "Trends of fields") -> str:
    """The narrative and the tables as Markdown."""
    text = "\n\n".join(narrative(study))
    return markdown_report(title, {"Findings": text, "Overall tests": study.overall.orderBy("scope"), "Trends": study.trends.orderBy("scope", "field"), "Change points": study.changes.orderBy("scope", "field"), "Low windows": study.lows.orderBy("scope", "field")})
