"""Panels of counts by year and field, their shares, and scopes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def panel(df: DataFrame, year: str, field: str, by: list[str] = (), years: DataFrame | None = None, fields: DataFrame | None = None) -> DataFrame:
    """(by..., year, field, n) counts, zero where a year and field of the grid have no row.

    The grid is the years and fields given, or those that occur; it has a row for each pair of labels and group.
    """
    df = df.where(F.col(year).isNotNull() & F.col(field).isNotNull())
    counts = df.groupBy(*by, F.col(year).alias("year"), F.col(field).alias("field")).agg(F.count("*").alias("n"))
    years = counts.select("year").distinct() if years is None else years.select("year")
    fields = counts.select("field").distinct() if fields is None else fields.select("field")
    grid = years.crossJoin(fields)
    if by:
        grid = counts.select(*by).distinct().crossJoin(grid)
    return grid.join(counts, [*by, "year", "field"], "left").select(*by, "year", "field", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def shares(p: DataFrame, within: list[str]) -> DataFrame:
    """The panel with total and share of the cells in each group; null where a group is empty."""
    w = Window.partitionBy(*within)
    out = p.withColumn("total", F.sum("n").over(w))
    return out.withColumn("share", F.when(F.col("total") > 0, F.col("n") / F.col("total")))


def overall_shares(p: DataFrame) -> DataFrame:
    by_field = p.groupBy("field").agg(F.sum("n").alias("n"))
    total = by_field.agg(F.sum("n").alias("t"))
    return by_field.crossJoin(F.broadcast(total)).select("field", "n", (F.col("n") * 100.0 / F.col("t")).alias("percent"))  # one row


def bars(p: DataFrame, dim: DataFrame | None = None) -> DataFrame:
    """(place, field, percent, label): a bar for each field, in the order of the domain (idx, field) or of the names, with
    the label that stands above it."""
    out = overall_shares(p)
    if dim is not None:
        out = out.join(dim.select("idx", "field"), "field", "left")
    order = [*([F.col("idx").asc_nulls_last()] if dim is not None else []), F.asc("field")]
    label = F.concat(F.format_string("%.1f", "percent"), F.lit("%"))
    return out.select(F.row_number().over(Window.orderBy(*order)).alias("place"), "field", "percent", label.alias("label"))  # a row for each field


def panels(p: DataFrame, fields: list[str]) -> DataFrame:
    """(panel, field, year, percent, label): the yearly shares of the given fields, a panel for each, in their order."""
    place = F.array_position(F.array(*[F.lit(f) for f in fields]), F.col("field")).cast("int").alias("panel")
    x = shares(p, ["year"]).where(F.col("field").isin(*fields))
    percent = F.col("share") * 100
    return x.select(place, "field", "year", percent.alias("percent"), F.concat(F.format_string("%.1f", percent), F.lit("%")).alias("label"))


def pivot_panel(p: DataFrame, fields: list[str], value: str = "n") -> DataFrame:
    return p.groupBy("year").pivot("field", fields).agg(F.first(value))


def scopes(parts: dict[str, DataFrame]) -> DataFrame:
    """One table of all scopes, with a scope column, so that they are worked on in one job."""
    tagged = [df.withColumn("scope", F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def stacked(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def period_scopes(df: DataFrame, year: str, last_year: int, name: str) -> DataFrame:
    """All rows under scope `all`, and those up to last_year under scope `name`."""
    return scopes({"all": df, name: df.where(F.col(year) <= last_year)})


def clear_scope(df: DataFrame, flag: str, name: str = "non_ambiguous") -> DataFrame:
    """All rows under scope `all`; those without the flag under scope `name`, only if any row has the flag."""
    flagged = F.broadcast(df.agg(F.max(F.col(flag).cast("int")).alias("__any")).where("__any = 1"))  # one row or none
    return scopes({"all": df, name: df.where(~F.col(flag)).crossJoin(flagged).drop("__any")})


def attach(table: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """table with the columns of other, null where other lacks the key."""
    return table.join(other, keys, "left")


def in_domain_order(df: DataFrame, dim: DataFrame, column: str, position: str | None = None) -> DataFrame:
    """Rows in the domain's order, labels that it lacks last, by name; with the label's place in the domain, if asked for."""
    out = df.join(dim.select("idx", F.col("field").alias(column)), column, "left").orderBy(F.col("idx").asc_nulls_last(), column)
    return out.withColumnRenamed("idx", position) if position else out.drop("idx")
