"""Scans of a panel for breaks and low windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def two_proportion_z(a: Column, na: Column, b: Column, nb: Column) -> Column:
    """Pooled z of B minus A; the variance is at least 1e-15, and z is null where a side is empty."""
    pooled = (a + b) / (na + nb)
    var = F.greatest(pooled * (1 - pooled) * (1 / na + 1 / nb), F.lit(1e-15))
    return F.when((na > 0) & (nb > 0), (b / nb - a / na) / F.sqrt(var))


def _ranks(p: DataFrame) -> DataFrame:
    """(year, i, years): the places of the panel's years, which are few."""
    y = p.select("year").distinct()
    return y.withColumns({"i": F.row_number().over(Window.orderBy("year")), "years": F.count("*").over(Window.partitionBy(F.lit(0)))})


def with_totals(p: DataFrame, by: list[str] = ()) -> DataFrame:
    return p.withColumn("total", F.sum("n").over(Window.partitionBy(*by, "year")))


def split_scan(p: DataFrame, by: list[str] = (), min_side: int = 2) -> DataFrame:
    """(by..., field, cut, before, after, diff, z) for each split after year `cut` that leaves min_side years or more on
    each side. diff is the share after minus before."""
    by = list(by)
    r = _ranks(p)
    cuts = r.where((F.col("i") >= min_side) & (F.col("years") - F.col("i") >= min_side)).select(F.col("year").alias("cut"))
    x = with_totals(p, by).crossJoin(cuts)  # a panel and its few years
    late = F.col("year") > F.col("cut")
    agg = x.groupBy(*by, "field", "cut").agg(*[F.sum(F.when(side, F.col(c)).otherwise(0)).alias(name) for name, side, c in (("a", ~late, "n"), ("na", ~late, "total"), ("b", late, "n"), ("nb", late, "total"))])
    a, na, b, nb = (F.col(c) for c in ("a", "na", "b", "nb"))
    before, after = F.when(na > 0, a / na), F.when(nb > 0, b / nb)
    return agg.select(*by, "field", "cut", before.alias("before"), after.alias("after"), (after - before).alias("diff"), two_proportion_z(a, na, b, nb).alias("z"))


def window_scan(p: DataFrame, by: list[str] = (), width: int = 2) -> DataFrame:
    """(by..., field, start, inside, outside, diff, z) for each window of `width` years; diff is the share outside minus
    inside, so a low window stands out."""
    by = list(by)
    r = _ranks(p)
    starts = r.where(F.col("years") - F.col("i") >= width - 1).select(F.col("year").alias("start"), F.col("i").alias("s"))
    x = with_totals(p, by).join(r.select("year", "i"), "year").crossJoin(starts)  # a panel and its few years
    inside = (F.col("i") >= F.col("s")) & (F.col("i") < F.col("s") + width)
    agg = x.groupBy(*by, "field", "start").agg(*[F.sum(F.when(side, F.col(c)).otherwise(0)).alias(name) for name, side, c in (("a", inside, "n"), ("na", inside, "total"), ("b", ~inside, "n"), ("nb", ~inside, "total"))])
    a, na, b, nb = (F.col(c) for c in ("a", "na", "b", "nb"))
    low, high = F.when(na > 0, a / na), F.when(nb > 0, b / nb)
    return agg.select(*by, "field", "start", low.alias("inside"), high.alias("outside"), (high - low).alias("diff"), two_proportion_z(a, na, b, nb).alias("z"))


def best(scan: DataFrame, by: list[str], value: Column, place: str) -> DataFrame:
    """The row with the largest value (to 9 digits) for each field, the first place on ties."""
    w = Window.partitionBy(*by, "field").orderBy(F.desc_nulls_last(F.round(value, 9)), F.asc(place))
    return scan.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def split_label(cut: str = "cut") -> Column:
    return F.concat(F.col(cut).cast("string"), F.lit("/"), (F.col(cut) + 1).cast("string"))


def window_label(start: str = "start", width: int = 2) -> Column:
    return F.concat(F.col(start).cast("string"), F.lit("-"), (F.col(start) + width - 1).cast("string"))
