"""Command line: run a query of the catalogue, or an analysis of tables of articles (CSV or Parquet).

python -m biblioflux query NAME --data DIR --output DIR [--format parquet|csv]
python -m biblioflux trends --input FILE --output DIR [--year year] [--field field] [--first-year Y] [--last-year Y]
python -m biblioflux study --input FILE --output DIR [--permutations N] [--bootstraps N] [--seed N] [--raw-field C] [--score C] [--margin C]
python -m biblioflux compare --cn FILE --en FILE --output DIR [--period-end Y]

study writes a table for each part (overall, trends, changes, lows) over the scopes final, raw and high_confidence, and a
report; compare tests whether two groups' compositions and trends differ, over all years and up to --period-end.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import inference, multiple, panel
from .operators.classify import Thresholds
from .operators.study import scope_study, study_report
from .plans.queries import QUERIES
from .schemas import require_columns
from .scratch import written
from .sources.readers import read_csv
from .sources.sinks import write_markdown


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="biblioflux", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    kinds = p.add_subparsers(dest="command", required=True)
    q = kinds.add_parser("query")
    q.add_argument("name", choices=sorted(QUERIES))
    q.add_argument("--data", required=True, help="folder of the tables")
    tr, st, co = (kinds.add_parser(c) for c in ("trends", "study", "compare"))
    for k in (tr, st):
        k.add_argument("--input", required=True, help="table of articles")
    st.add_argument("--permutations", type=int, default=10_000)
    st.add_argument("--bootstraps", type=int, default=5_000)
    st.add_argument("--seed", type=int, default=20260810)
    st.add_argument("--raw-field", default="raw_field")
    st.add_argument("--score", default="score")
    st.add_argument("--margin", default="margin")
    for group in ("cn", "en"):
        co.add_argument(f"--{group}", required=True, help=f"table of the articles of group {group}")
    co.add_argument("--period-end", type=int, default=2024)
    for k in (tr, st, co):
        k.add_argument("--year", default="year")
        k.add_argument("--field", default="field")
        k.add_argument("--first-year", type=int, default=2020)
        k.add_argument("--last-year", type=int, default=2025)
    for k in (q, tr, st, co):
        k.add_argument("--output", required=True)
        k.add_argument("--format", choices=["parquet", "csv"], default="parquet")
    return p


def _rows(spark: SparkSession, a: argparse.Namespace, path: str, more: list[str] = ()) -> DataFrame:
    df = read_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path)
    year = F.col(a.year).cast("string").try_cast("int")
    rows = require_columns(df, [a.year, a.field, *more]).select(year.alias("year"), F.col(a.field).alias("field"), *more)
    return rows.where(F.col("year").between(a.first_year, a.last_year))


def _save(df: DataFrame, path: str, kind: str) -> None:
    writer = df.write.mode("overwrite")
    (writer.option("header", True).csv if kind == "csv" else writer.parquet)(path)


def _study(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = _rows(spark, a, a.input, [a.raw_field, a.score, a.margin])
    raw, t = rows.withColumn("field", F.col(a.raw_field)), Thresholds()
    number = lambda c: F.col(c).cast("string").try_cast("double")
    sure = raw.where((number(a.score) >= t.medium_score) & (number(a.margin) >= t.medium_margin))
    scopes = {"final": rows, "raw": raw, "high_confidence": sure}
    found = scope_study(written(panel.panel(panel.scopes(scopes), "year", "field", ["scope"]), "panel"), list(scopes), a.permutations, a.bootstraps, a.seed)
    for name in ("overall", "trends", "changes", "lows"):
        _save(getattr(found, name), f"{a.output}/{name}", a.format)
    write_markdown(study_report(found), f"{a.output}/report.md", spark)


def _compare(spark: SparkSession, a: argparse.Namespace) -> None:
    both = panel.stacked([_rows(spark, a, path).withColumn("grp", F.lit(name)) for name, path in (("cn", a.cn), ("en", a.en))])
    scopes = panel.period_scopes(both, "year", a.period_end, f"to_{a.period_end}")
    p = written(panel.panel(scopes, "year", "field", ["scope", "grp"]), "panel")
    names = ["all", f"to_{a.period_end}"]
    tests = panel.stacked([inference.group_tests(p.where(F.col("scope") == s).drop("scope"), "grp").withColumn("scope", F.lit(s)) for s in names])
    slopes = panel.stacked([inference.interactions(p.where(F.col("scope") == s).drop("scope"), "grp", "cn", "en").withColumn("scope", F.lit(s)) for s in names])
    pooled = p.groupBy("scope", "grp", "field").agg(F.sum("n").alias("n"))
    for name, out in (("group_tests", tests), ("interactions", slopes), ("pooled", inference.pearson_with_p(pooled, "grp", ["scope"])), ("annual_shares", panel.shares(p, ["scope", "grp", "year"]))):
        _save(out, f"{a.output}/{name}", a.format)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("biblioflux").getOrCreate()
    if a.command == "query":
        _save(QUERIES[a.name](spark, a.data), a.output, a.format)
    elif a.command == "trends":
        trends = inference.logit_trends(panel.panel(_rows(spark, a, a.input), "year", "field"))
        _save(multiple.by_significance(trends, "p", "field", "q"), a.output, a.format)
    else:
        (_study if a.command == "study" else _compare)(spark, a)


if __name__ == "__main__":
    main()
