"""Readers of article exports."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def matching_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob, sorted; an error if there are none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    names = sorted(f.getPath().toString() for f in found or [])
    if not names:
        raise FileNotFoundError(f"no file matches {pattern}")
    return names


def first_existing(spark: SparkSession, paths: Iterable[str]) -> str:
    """The first path that exists."""
    tried = list(paths)
    for p in tried:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return p
    raise FileNotFoundError(f"none of these exists: {', '.join(tried)}")


def read_tab_export(spark: SparkSession, pattern: str) -> DataFrame:
    """Tab-separated exports, all columns as text, unioned by name.

    The header is each file's first line (a byte-order mark is dropped). Rows with more fields than it are skipped, short
    ones are padded with null, quotes have no meaning and empty fields are null.
    """
    frames = []
    for name in matching_files(spark, pattern):
        lines = spark.read.text(name).where(F.col("value") != "")
        head = lines.first()
        if head is None:
            continue
        columns = head[0].lstrip("﻿").rstrip("\r").split("\t")
        parts = F.split(F.regexp_replace("value", "\r$", ""), "\t")
        rows = lines.where(F.col("value") != F.lit(head[0])).select(parts.alias("p")).where(F.size("p") <= len(columns))
        frames.append(rows.select(*[F.nullif(F.get("p", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns) if c]))
    if not frames:
        raise ValueError(f"{pattern}: no file has a header")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def parse_blocks(texts: DataFrame, column: str = "value") -> DataFrame:
    """(block, fields) of key:value texts: blocks lie between blank lines, each line is cut once at `:` or `：`, the last
    of equal keys wins, lines without a colon are left out."""
    whole = F.regexp_replace(F.regexp_replace(F.regexp_replace(column, "﻿", ""), "\r\n?", "\n"), r"^\s+|\s+$", "")
    blocks = texts.select(F.posexplode(F.split(whole, r"\n[ \t]*\n")).alias("block", "b"))
    lines = blocks.select("block", F.filter(F.split("b", "\n"), lambda x: F.rlike(x, F.lit("[:：]"))).alias("lines"))
    keyed = lines.select("block", F.transform("lines", lambda x: _strip(F.regexp_extract(x, "^([^:：]*)[:：]", 1))).alias("k"), F.transform("lines", lambda x: _strip(F.regexp_replace(x, "^[^:：]*[:：]", ""))).alias("v"))
    numbered = keyed.select("block", "k", "v", F.reverse("k").alias("r"), F.size("k").alias("n"))
    picks = numbered.select("block", "k", "v", F.transform(F.array_distinct("k"), lambda k: F.col("n") - F.array_position("r", k).cast("int")).alias("at"))
    fields = F.map_from_entries(F.transform("at", lambda i: F.struct(F.get("k", i), F.get("v", i))))
    return picks.where(F.size("at") > 0).select("block", fields.alias("fields"))


def _strip(c):
    return F.regexp_replace(c, r"^[\s　]+|[\s　]+$", "")


def read_blocks(spark: SparkSession, pattern: str, keys: Iterable[str], encodings: Iterable[str] = ("utf-8-sig", "utf-8", "gb18030")) -> DataFrame:
    """Key:value block files, a column for each key that is asked for."""
    frames = [_decoded(spark, name, encodings) for name in matching_files(spark, pattern)]
    blocks = parse_blocks(reduce(lambda a, b: a.unionByName(b), frames))
    return blocks.select(*[F.try_element_at("fields", F.lit(k)).alias(k) for k in keys])


def _decoded(spark: SparkSession, name: str, encodings: Iterable[str]) -> DataFrame:
    tried = list(encodings)

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"value": [_text(bytes(x), tried) for x in frame["content"]]})

    return spark.read.format("binaryFile").load(name).select("content").mapInPandas(decode, "value string")


def _text(raw: bytes, encodings: list[str]) -> str:
    for e in encodings:
        try:
            return raw.decode(e)
        except UnicodeDecodeError:
            continue
    return raw.decode(encodings[-1], "replace")


def read_csv(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """A CSV file with a header, quoted line feeds and doubled quotes; all columns as text, a byte-order mark dropped."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding=encoding)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def read_csv_any(spark: SparkSession, path: str, encodings: Iterable[str] = ("utf-8", "gb18030", "latin1")) -> DataFrame:
    """CSV files, each in the first encoding that decodes the whole of it."""
    tried = list(encodings)

    def first_fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for raw in frame["content"]:
                fits = [e for e in tried if _decodes(raw, e)]
                found.append(fits[0] if fits else None)
            yield pd.DataFrame({"path": frame["path"], "encoding": found})

    files = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(first_fit, "path string, encoding string").collect()
    bad = [r["path"] for r in files if r["encoding"] is None]
    if bad:
        raise UnicodeError(f"none of the encodings fits: {', '.join(bad)}")
    if not files:
        raise FileNotFoundError(path)
    native = {"utf-8": "utf-8", "latin1": "iso-8859-1", "iso-8859-1": "iso-8859-1"}
    parts = [read_csv(spark, r["path"], native[r["encoding"]]) if r["encoding"] in native else _decoded_csv(spark, r["path"], r["encoding"]) for r in files]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def _decodes(raw: bytes, encoding: str) -> bool:
    try:
        bytes(raw).decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def _decoded_csv(spark: SparkSession, path: str, encoding: str, member: str | None = None) -> DataFrame:
    """CSV that Spark cannot decode or open itself, all columns as text: read whole where it lies, then split to rows."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for raw in frame["content"]:
                data = io.BytesIO(raw)
                if member is not None:
                    with zipfile.ZipFile(data) as z:
                        data = io.BytesIO(z.read(member))
                for part in pd.read_csv(data, dtype=str, keep_default_na=False, encoding=encoding, chunksize=5000):
                    yield pd.DataFrame({"m": [dict(zip(part.columns, r, strict=True)) for r in part.itertuples(index=False)]})

    maps = spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "m map<string,string>")
    columns = [r[0] for r in maps.select(F.explode(F.map_keys("m"))).distinct().collect()]
    return maps.select(*[F.col("m").getItem(c).alias(c) for c in sorted(columns)])


def read_zip_member(spark: SparkSession, path: str, member: str, encoding: str = "utf-8-sig") -> DataFrame:
    """A CSV member of a zip archive, all columns as text."""
    return _decoded_csv(spark, path, encoding, member)
