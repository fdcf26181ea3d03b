"""Sinks: CSV with a byte-order mark, side outputs, run metadata, Markdown."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header; `single` is for small result tables only."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True, escape='"')


def write_csv_bom(df: DataFrame, path: str, max_rows: int = 100_000) -> None:
    """One local CSV file with a byte-order mark, for spreadsheets; an error beyond max_rows."""
    rows = df.limit(max_rows + 1).toPandas()
    if len(rows) > max_rows:
        raise ValueError(f"over {max_rows} rows; use write_csv")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    rows.to_csv(path, index=False, encoding="utf-8-sig")


def write_rejects(tagged: DataFrame, path: str, reason: str = "reject_reason") -> None:
    """The rejected rows of a tagged table, a folder for each reason."""
    tagged.where(F.col(reason).isNotNull()).write.mode("overwrite").partitionBy(reason).parquet(path)


def write_metadata(path: str, **facts: object) -> None:
    """Thresholds, seeds and counts of a run as JSON."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(facts, f, ensure_ascii=False, indent=2, sort_keys=True, default=str)


def markdown_table(df: DataFrame, max_rows: int = 200) -> str:
    """A table as Markdown; a line under it says so if df has more than max_rows rows."""
    rows = df.limit(max_rows + 1).collect()
    more = ["", f"Only the first {max_rows} rows are shown."] if len(rows) > max_rows else []
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows[:max_rows]] + more)


def markdown_report(title: str, sections: Mapping[str, DataFrame | str], notes: str = "") -> str:
    """A report of small result tables and text under headings; the numbers come from the tables alone."""
    parts = [f"# {title}"]
    for name, body in sections.items():
        parts += [f"## {name}", markdown_table(body) if isinstance(body, DataFrame) else body]
    return "\n\n".join([*parts, notes] if notes else parts) + "\n"


def write_markdown(text: str, path: str, spark: SparkSession) -> None:
    """A text as one file, on any file system that Spark writes to."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
