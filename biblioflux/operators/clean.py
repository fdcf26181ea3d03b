"""Cleaning of article tables: selection of columns, completeness, relevance, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import join_lists, squeeze, to_number, to_text
from ..schemas import backfill

#: Two-letter tags of tab-separated exports.
TAGS = ["TI", "AB", "PY", "AU", "AF", "DE", "ID", "WC", "SC", "TC", "Z9", "DT", "SO", "DI"]


def clean_tab_articles(raw: DataFrame, first_year: int = 2020, last_year: int = 2025) -> DataFrame:
    """Articles from a tagged export, with reject_reason (null where the row is complete).

    Rows without abstract, then rows without title, year or any author, are tagged; a blank author still counts as
    given and does not fall back to the long form. Citations come from TC if that column exists, else Z9, else 0.
    """
    cites = "TC" if "TC" in raw.columns else "Z9" if "Z9" in raw.columns else None
    df = backfill(raw, {c: None for c in TAGS})
    blank = lambda c: F.coalesce(squeeze(F.col(c)), F.lit("")) == ""
    year = to_number(F.col("PY")).cast("int")
    reason = (
        F.when(blank("AB"), "missing_abstract")
        .when(blank("TI") | blank("PY") | (blank("AU") & blank("AF")), "incomplete_metadata")
        .when(year.isNull() | ~year.between(first_year, last_year), "year_out_of_range")
    )
    return df.select(
        squeeze(F.col("TI")).alias("Title"),
        squeeze(F.col("AB")).alias("Abstract"),
        year.alias("Year"),
        F.coalesce("AU", "AF").alias("Author"),
        join_lists(F.col("DE"), F.col("ID")).alias("Keywords"),
        join_lists(F.col("WC"), F.col("SC")).alias("JEL_Category"),
        (to_number(F.col(cites), "bigint", 0) if cites else F.lit(0).cast("bigint")).alias("Citations"),
        F.col("SO").alias("Journal"),
        F.col("DI").alias("DOI"),
        reason.alias("reject_reason"),
    )


def rename_present(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def clean_articles(df: DataFrame, text_columns: list[str], year: str = "Year", citations: str | None = "Citations", first_year: int = 2020, last_year: int = 2025) -> DataFrame:
    """Squeezed text columns, a whole year within the range, numeric citations (0 where there are none); rows with a
    blank required text are left out."""
    df = backfill(df, {citations: None} if citations else {})
    out = df.withColumns({c: squeeze(to_text(F.col(c))) for c in text_columns} | {year: to_number(F.col(year)).cast("int")})
    if citations:
        out = out.withColumn(citations, to_number(F.col(citations), "double", 0.0))
    keep = F.col(year).between(first_year, last_year)
    for c in text_columns:
        keep = keep & (F.col(c) != "")
    return out.where(keep)


def relevance(text: Column, strong: list[str], weak: list[str], markers: list[str], weak_needed: int = 3) -> Column:
    """Whether a text belongs to the subject: a strong keyword, or enough distinct weak ones and no exclusion marker."""
    hits = lambda words: F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda k: F.contains(text, k)))
    return (hits(strong) >= 1) | ((hits(markers) == 0) & (hits(weak) >= weak_needed))


def filter_relevant(df: DataFrame, text: Column, applies: Column, strong: list[str], weak: list[str], markers: list[str], weak_needed: int = 3) -> DataFrame:
    """Rows the predicate does not apply to, and relevant ones."""
    return df.where(~F.coalesce(applies, F.lit(False)) | relevance(F.coalesce(text, F.lit("")), strong, weak, markers, weak_needed))


def drop_exact_duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropDuplicates(columns)


def repeated_keys(df: DataFrame, keys: list[str], out: str = "copies") -> DataFrame:
    """All rows whose key occurs more than once, with how often: counts are joined back, so a hot key can be split."""
    counts = df.groupBy(*keys).agg(F.count("*").alias(out)).where(F.col(out) > 1)
    return df.join(counts, keys)


def remap(df: DataFrame, column: str, names: dict[str, str], out: str | None = None) -> DataFrame:
    """Labels by a dictionary; others stay."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return df.withColumn(out or column, F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(column)), F.col(column)) if pairs else F.col(column))
