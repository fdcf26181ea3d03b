"""Word n-grams counted as numbers inside tasks: only the distinct n-grams of a stretch of words become text and move."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places that are counted at once.
PLACES = 1 << 20
#: Cells of a sketch that move as one row.
BLOCK = 1 << 14
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Stretch:
    """Places of a batch side by side: the row of each, the words from it to the end of its row, and the words as numbers
    (with the few words after the last place that its n-grams need)."""

    row: np.ndarray
    room: np.ndarray
    codes: np.ndarray
    words: pa.Array

    def starts(self, n: int) -> np.ndarray:
        return np.flatnonzero(self.room >= n)

    @property
    def bits(self) -> int:
        return max(1, (len(self.words) - 1).bit_length())

    def keys(self, at: np.ndarray, n: int) -> np.ndarray:
        key = self.codes[at]
        for i in range(1, n):
            key = (key << self.bits) | self.codes[at + i]
        return key

    def ends(self, at: np.ndarray, n: int) -> np.ndarray:
        """The first and last word of each n-gram, as a number of two words."""
        return (self.codes[at] << self.bits) | self.codes[at + n - 1]

    def terms(self, keys: np.ndarray, n: int) -> pa.Array:
        mask = (1 << self.bits) - 1
        parts = [self.words.take(pa.array((keys >> self.bits * (n - 1 - i)) & mask)) for i in range(n)]
        return parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")

    def hashes(self) -> np.ndarray:
        """A number for each word that is the same in every task."""
        return pd.util.hash_array(self.words.to_numpy(zero_copy_only=False), categorize=False)[self.codes]

    def cells(self, hashes: np.ndarray, at: np.ndarray, n: int, cells: int) -> np.ndarray:
        h = hashes[at]
        for i in range(1, n):
            h = (h ^ (h >> np.uint64(29))) * _MIX + hashes[at + i]
        h = (h ^ (h >> np.uint64(32))) * _MIX
        return ((h >> np.uint64(20)) % np.uint64(cells)).astype(np.int64)


def stretches(tokens: pa.ListArray, longest: int) -> Iterator[Stretch]:
    """The words of a batch in stretches of at most PLACES places; n-grams of up to `longest` words fit one number."""
    places = min(PLACES, (1 << 62 // longest) - longest)
    size = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, end = tokens.flatten(), np.cumsum(size)
    for lo in range(0, len(flat), places):
        hi = min(lo + places, len(flat))
        first, last = np.searchsorted(end, [lo, hi - 1], side="right")
        row = np.repeat(np.arange(first, last + 1), size[first : last + 1])
        row = row[lo - (end[first] - size[first]) :][: hi - lo]
        part = flat.slice(lo, hi - lo + longest - 1).dictionary_encode()
        yield Stretch(row, end[row] - np.arange(lo, hi), part.indices.to_numpy().astype(np.int64), part.dictionary.cast(pa.string()))


def gram_rows(df: DataFrame, tokens: Column, sizes: Sequence[int], gapped: bool = False) -> DataFrame:
    """(n, term, freq) as gram_counts(), a row for each stretch that has the n-gram: freq is yet to be summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in stretches(batch.column(0), max(sizes)):
                for n in sizes:
                    key, freq = np.unique(s.ends(s.starts(n), n) if gapped else s.keys(s.starts(n), n), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), n, np.int32)), s.terms(key, 2 if gapped else n), pa.array(freq, pa.int64())], names=["n", "term", "freq"])

    return df.select(tokens.alias("k")).mapInArrow(count, "n int, term string, freq long")


def gram_counts(df: DataFrame, tokens: Column, sizes: Sequence[int], gapped: bool = False) -> DataFrame:
    """(n, term, freq) of n-grams of neighbouring tokens, which are not null and hold no space, for each n of sizes; if gapped,
    of their first and last words only."""
    return gram_rows(df, tokens, sizes, gapped).groupBy("n", "term").agg(F.sum("freq").alias("freq"))


def sketch(df: DataFrame, tokens: Column, sizes: Sequence[int], cells: int) -> np.ndarray:
    """How many n-grams fall into each cell of a hash: a bound from above for each n-gram in it. `cells` numbers for each
    task move, however many n-grams there are."""

    def rows(blocks: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for b, n in blocks.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([n.tobytes()], pa.binary())], names=["block", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for s in stretches(batch.column(0), max(sizes)):
                hashes = s.hashes()
                for n in sizes:
                    np.add.at(total, s.cells(hashes, s.starts(n), n, cells), 1)
        parts = {i // BLOCK: total[i : i + BLOCK] for i in range(0, cells, BLOCK)}
        yield from rows({b: n for b, n in parts.items() if n.any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, n in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[b] = total.get(b, 0) + np.frombuffer(n.as_buffer(), np.int64)
        yield from rows(total)

    schema = "block int, n binary"
    parts = df.select(tokens.alias("k")).mapInArrow(count, schema).repartition("block").mapInArrow(add, schema)
    out = np.zeros(cells, np.int64)
    for part in parts.toArrow().to_batches():  # `cells` numbers
        for b, n in zip(part.column(0).to_pylist(), part.column(1), strict=True):
            out[b * BLOCK : (b + 1) * BLOCK] = np.frombuffer(n.as_buffer(), np.int64)
    return out


def counts_in_cells(df: DataFrame, tokens: Column, sizes: Sequence[int], wanted: np.ndarray) -> DataFrame:
    """(term, cell, cf) of the n-grams in wanted cells (a truth value for each cell)."""
    held = df.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in stretches(batch.column(0), max(sizes)):
                hashes = s.hashes()
                for n in sizes:
                    at = s.starts(n)
                    cell = s.cells(hashes, at, n, len(held.value))
                    kept = held.value[cell]
                    key, first, cf = np.unique(s.keys(at[kept], n), return_index=True, return_counts=True)
                    yield pa.RecordBatch.from_arrays([s.terms(key, n), pa.array(cell[kept][first], pa.int64()), pa.array(cf, pa.int64())], names=["term", "cell", "cf"])

    rows = df.select(tokens.alias("k")).mapInArrow(count, "term string, cell long, cf long")
    return rows.groupBy("term").agg(F.min("cell").alias("cell"), F.sum("cf").alias("cf"))


def vocabulary_frequencies(df: DataFrame, doc: str, tokens: Column, sizes: Sequence[int], vocabulary: DataFrame, cells: int) -> DataFrame:
    """(doc, term, tf) of the n-grams of a vocabulary (term, cell) that a task can hold."""
    table = vocabulary.select("term", "cell").toArrow()
    names, wanted = table.column("term").combine_chunks().cast(pa.string()), np.zeros(cells, bool)
    wanted[table.column("cell").to_numpy()] = True
    held = df.sparkSession.sparkContext.broadcast((names, wanted))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, wanted = held.value
        for batch in batches:
            for s in stretches(batch.column(1), max(sizes)):
                hashes, found = s.hashes(), [np.empty(0, np.int64)]
                for n in sizes:
                    at = s.starts(n)
                    at = at[wanted[s.cells(hashes, at, n, cells)]]
                    key, back = np.unique(s.keys(at, n), return_inverse=True)
                    place = pc.fill_null(pc.index_in(s.terms(key, n), value_set=names), -1).to_numpy(zero_copy_only=False).astype(np.int64)[back]
                    found.append((s.row[at] * len(names) + place)[place >= 0])
                pair, tf = np.unique(np.concatenate(found), return_counts=True)
                if len(pair):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pair // len(names))), names.take(pa.array(pair % len(names))), pa.array(tf, pa.int64())], names=[doc, "term", "tf"])

    kind = df.schema[doc].dataType.simpleString()
    rows = df.select(doc, tokens.alias("__k")).mapInArrow(count, f"`{doc}` {kind}, term string, tf long")
    return rows.groupBy(doc, "term").agg(F.sum("tf").alias("tf"))
