"""How far the sources of a language lie apart in their terms, by an inverted index that corrects a baseline.

Terms have smoothed shares p in parts of a thousand million, all in integers. Two sources differ by the sum of |p - q|
over all V kept terms, most of which one or both of them lack. So each pair starts at V times the difference of the
shares of a count of zero, and only what occurs corrects that: a term of one source alone counts against the other's
zero share, which a histogram of shares holds for all terms of a source together; a term of both counts for itself, and
only these postings meet, by term.

Each task counts terms of its texts before anything moves, so a source with a third of all documents sends as many
rows as another; no list of a group's terms is ever built.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, release

#: Shares are counted in parts of so many; each count is raised by SMOOTH.
PARTS, SMOOTH = 1_000_000_000, 5
#: A task hands on its counts when it holds so many.
HELD = 200_000
#: Longer texts are cut between terms, so that the list of terms stays small.
SLICE = 1 << 21
#: Every byte that no term has becomes a space, A-Z become lower case; bytes from 128 on are letters beyond ASCII.
_PLAIN = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))


def _slices(raw: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(raw):
        end = len(raw) if len(raw) - at <= SLICE else raw.find(b" ", at + SLICE)
        end = len(raw) if end < 0 else end
        yield raw[at:end]
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs): occurrences and documents; the row without a term counts the group's documents."""
    held: dict[tuple[str, str], list] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs, rows) in held.items():
            terms = [None, *n]
            cols = [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([0, *n.values()], pa.int64()), pa.array([rows, *map(docs.__getitem__, n)], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            group = held.setdefault((lang, source), [Counter(), Counter(), 0])
            group[2] += 1
            own: set[bytes] = set()
            for part in _slices(text.translate(_PLAIN)):
                words = part.split()
                group[0].update(words)
                own.update(words)
            group[1].update(own)
        if sum(len(g[0]) for g in held.values()) > HELD:
            yield from out()
    yield from out()


def _share(count: Column | str, total: str, kept: str) -> Column:
    """1 + floor(PARTS (count + SMOOTH) / (total + SMOOTH kept)), exact."""
    c = F.col(count) if isinstance(count, str) else count
    d = "decimal(38,0)"
    top, below = (c.cast(d) + F.lit(SMOOTH)) * F.lit(PARTS).cast("decimal(10,0)"), F.col(total).cast("decimal(20,0)") + F.lit(SMOOTH) * F.col(kept).cast("decimal(16,0)")
    return F.lit(1).cast("long") + F.floor((top - F.pmod(top, below.cast(d))) / below).cast("long")


def source_divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank), for every occurring group of a language and a source.

    Part `pair` has each other source of the language, the value being the sum of |p - q| over the language's kept terms:
    those in at least `min_docs` of its documents. Part `term` has the terms that the group uses and that have a larger
    share p in it than q in its language, the value being p - q, down to rank `top`. Ranks go by falling value, then by
    the item's bytes.

    A null language, source or text counts as an empty one. A text without terms still makes its group occur; where
    nothing is kept, pairs have the value 0. Rows repeated count each; other columns are not read; an empty table gives
    no rows.
    """
    q = lambda c: F.coalesce(F.col("`" + c.replace("`", "``") + "`"), F.lit(""))
    rows = docs.select(q(lang).alias("lang"), q(source).alias("source"), q(text).alias("text"))
    counted = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    cells = materialize(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "cells")
    kept = cells.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("df"), F.sum("n").alias("lang_n")).where(F.col("df") >= min_docs).drop("df")
    postings = materialize(cells.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "postings")
    # counts of groups and languages: as many rows as there are groups
    per_group = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    per_lang = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    sizes = cells.where("term IS NULL").select("lang", "source").join(per_group, ["lang", "source"], "left").join(per_lang, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    groups = materialize(sizes.withColumn("p0", F.when(F.col("kept") > 0, _share(F.lit(0), "total", "kept")).otherwise(F.lit(0).cast("long"))), "groups")
    known = postings.join(groups, ["lang", "source"])
    index = materialize(known.select("lang", "source", "term", _share("n", "total", "kept").alias("p"), "p0", _share("lang_n", "lang_total", "kept").alias("q")), "index")
    release(cells, postings)

    mine = groups.select("lang", "source", "p0", "kept")
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("o0"))
    f0 = F.abs(F.col("p0") - F.col("o0"))
    start = mine.join(other, "lang").where("source <> item").select("lang", "source", "item", (F.col("kept") * f0).alias("x"))
    # what one source has: its shares against the other's zero share, by histogram, in both directions
    have = index.groupBy("lang", "source", "p0", "p").agg(F.count("*").alias("m"))
    alone = have.join(other, "lang").where("source <> item").withColumn("x", F.col("m") * (F.abs(F.col("p") - F.col("o0")) - f0)).where("x <> 0")
    alone = alone.groupBy("lang", "source", "item").agg(F.sum("x").alias("x"))
    # what both have: their postings meet by term
    a = index.select("lang", "term", "source", "p", "p0")
    b = index.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("o"), F.col("p0").alias("o0"))
    x = F.abs(F.col("p") - F.col("o")) - F.abs(F.col("p") - F.col("o0")) - F.abs(F.col("p0") - F.col("o")) + f0
    both = a.join(b, ["lang", "term"]).where("source < item").withColumn("x", x).where("x <> 0").groupBy("lang", "source", "item").agg(F.sum("x").alias("x"))
    fix = alone.unionByName(both)
    turned = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    fix = fix.select("lang", turned.alias("y"), "x").select("lang", "y.source", "y.item", "x")
    pairs = start.unionByName(fix).groupBy("lang", "source", "item").agg(F.sum("x").alias("value")).withColumn("part", F.lit("pair"))
    over = index.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"), F.lit("term").alias("part"))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(w)).unionByName(over.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")
