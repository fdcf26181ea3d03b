"""Schemas, domains and input checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARTICLE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("Title", T.StringType()),
        T.StructField("Abstract", T.StringType()),
        T.StructField("Year", T.IntegerType()),
        T.StructField("Author", T.StringType()),
        T.StructField("Keywords", T.StringType()),
        T.StructField("JEL_Category", T.StringType()),
        T.StructField("Journal", T.StringType()),
        T.StructField("Citations", T.DoubleType()),
    ]
)


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df, or an error that names the columns it lacks."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def backfill(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """df with each absent optional column added as its default (null as a string column)."""
    absent = {c: v for c, v in defaults.items() if c not in df.columns}
    return df.withColumns({c: F.lit(None).cast("string") if v is None else F.lit(v) for c, v in absent.items()}) if absent else df


def domain(spark: SparkSession, labels: list[str], column: str = "field") -> DataFrame:
    """A dimension table (idx, column) that fixes the order of labels."""
    return spark.createDataFrame(list(enumerate(labels)), f"idx int, {column} string")


def outside_domain(df: DataFrame, dim: DataFrame, column: str) -> DataFrame:
    """Distinct non-null labels of df that the dimension lacks."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().join(dim.select(column), column, "left_anti")


def check_domain(df: DataFrame, dim: DataFrame, column: str, size: int | None = None) -> DataFrame:
    """df, or an error for labels outside the domain, or for a domain of another size than asked for."""
    bad = [r[0] for r in outside_domain(df, dim, column).limit(20).collect()]
    if bad:
        raise ValueError(f"labels outside the domain: {', '.join(map(str, bad))}")
    if size is not None and dim.count() != size:
        raise ValueError(f"the domain must have {size} labels")
    return df
