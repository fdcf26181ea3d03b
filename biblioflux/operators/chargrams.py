"""Documents as vectors of character n-grams of a vocabulary: n-grams are looked up as numbers, and a document is one row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import written

#: Characters that are looked up at once, and places of the tree that are held as a plain table.
PLACES, TABLE = 1 << 20, 1 << 24


class GramTree:
    """The n-grams of a vocabulary as a tree: a node and a letter give the next node; `term` is a node's n-gram, or -1."""

    def __init__(self, grams: list[str]):
        self.longest = max(map(len, grams), default=0)
        letters = sorted({c for g in grams for c in g})
        self.letters = np.array([ord(c) for c in letters], np.uint32)
        self.width = len(letters) + 1  # the last one is any other letter
        nodes = {p: i for i, p in enumerate(sorted({g[:k] for g in grams for k in range(len(g) + 1)} | {""}))}
        code = {c: i for i, c in enumerate(letters)}
        at = sorted((nodes[p[:-1]] * self.width + code[p[-1]], i) for p, i in nodes.items() if p)
        self.key, self.next = np.array([a for a, _ in at], np.int64), np.array([i for _, i in at], np.int32)
        self.term = np.full(len(nodes), -1, np.int32)
        self.term[[nodes[g] for g in grams]] = np.arange(len(grams))
        self.table: np.ndarray | None = None
        if len(nodes) * self.width <= TABLE:
            self.table = np.full(len(nodes) * self.width, -1, np.int32)
            self.table[self.key] = self.next

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        key = node.astype(np.int64) * self.width + letter
        if self.table is not None:
            return self.table[key]
        found = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[found] == key, self.next[found], -1)

    def terms(self, text: str, places: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, n-gram) of all n-grams that start at a place and lie before its end."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kinds, of = np.unique(codes, return_inverse=True)
        known = np.searchsorted(self.letters, kinds)
        known = np.where(self.letters[np.minimum(known, len(self.letters) - 1)] == kinds, known, self.width - 1)
        letter = known[of]
        node, rows, terms = np.zeros(len(places), np.int32), [], []
        for k in range(self.longest):
            on = places + k < end
            places, end, row, node = places[on], end[on], row[on], node[on]
            node = self.step(node, letter[places + k])
            on = node >= 0
            places, end, row, node = places[on], end[on], row[on], node[on]
            term = self.term[node]
            rows.append(row[term >= 0])
            terms.append(term[term >= 0])
        return np.concatenate(rows), np.concatenate(terms)


def _counted(texts: list[tuple[int, str]], tree: GramTree, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, n-gram, tf) of texts (row, text), sorted by row; a long text is looked up in parts."""
    found: list[np.ndarray] = []
    tf: list[np.ndarray] = []
    held: list[str] = []
    places: list[np.ndarray] = []
    ends: list[np.ndarray] = []
    rows: list[np.ndarray] = []
    size = 0

    def flush() -> None:
        nonlocal held, places, ends, rows, size
        row, term = tree.terms("".join(held), *(np.concatenate(x) for x in (places, ends, rows)))
        pair, count = np.unique(row * n + term, return_counts=True)
        found.append(pair)
        tf.append(count)
        held, places, ends, rows, size = [], [], [], [], 0

    for i, x in texts:
        for lo in range(0, len(x), PLACES):
            part = x[lo : lo + PLACES + tree.longest - 1]
            starts = min(PLACES, len(x) - lo)
            held.append(part)
            places.append(np.arange(size, size + starts))
            rows.append(np.full(starts, i, np.int64))
            size += len(part)
            ends.append(np.full(starts, size))
            if size >= PLACES:
                flush()
    if held:
        flush()
    if not found:
        return (np.zeros(0, np.int64),) * 3
    pair, back = np.unique(np.concatenate(found), return_inverse=True)
    count = np.bincount(back, np.concatenate(tf), len(pair)).astype(np.int64)
    return pair // n, pair % n, count


def vectors(docs: DataFrame, doc: str, text: Column, vocabulary: list[str]) -> DataFrame:
    """(doc, at, tf), written: for each document with an n-gram of the vocabulary, the places of its n-grams there and their
    counts, as bytes of 32 and 64 bits. Rows of one document meet first, so no n-gram has to move."""
    held, n = docs.sparkSession.sparkContext.broadcast(vocabulary), len(vocabulary)
    kind = docs.schema[doc].dataType.simpleString()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = GramTree(held.value)
        for batch in batches:
            texts = [(i, x) for i, some in enumerate(batch.column(1).to_pylist()) for x in some or [] if x]
            row, term, tf = _counted(texts, tree, n)
            start = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
            if not len(start):
                continue
            end = np.append(start[1:], len(row))
            term, tf = term.astype(np.int32), tf.astype(np.int64)
            at, counts = ([x[lo:hi].tobytes() for lo, hi in zip(start.tolist(), end.tolist(), strict=True)] for x in (term, tf))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[start])), pa.array(at, pa.binary()), pa.array(counts, pa.binary())], names=[doc, "at", "tf"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = docs.select(doc, text.alias("__k")).repartition(parts, doc).groupBy(doc).agg(F.collect_list("__k").alias("__k"))
    return written(met.mapInArrow(look, f"`{doc}` {kind}, at binary, tf binary"), "vectors")


def document_frequencies(packed: DataFrame, n: int) -> np.ndarray:
    """How many documents have each of the n n-grams."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total[np.frombuffer(x.as_buffer(), np.int32)] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["at", "df"])

    rows = packed.select("at").mapInArrow(count, "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(n, np.int64)
    out[rows.column("at").to_numpy()] = rows.column("df").to_numpy()
    return out


def _weights(at: bytes, tf: bytes, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, (1 + ln tf) idf at unit length)."""
    place = np.frombuffer(at, np.int32)
    w = (1 + np.log(np.frombuffer(tf, np.int64))) * idf[place]
    return place, w / np.sqrt((w * w).sum())


def prototype_scores(packed: DataFrame, doc: str, idf: np.ndarray, docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(doc, idx, field, score) as classify.prototype_scores(): the seeds (doc, idx, field), a handful, are rows of packed."""
    own = {r[doc]: (r["idx"], r["field"]) for r in seeds.select(doc, "idx", "field").collect()}
    vectors_ = np.zeros((len(own), len(idf)))
    places = {d: i for i, d in enumerate(own)}
    for r in packed.where(F.col(doc).isin(*own)).collect():
        at, w = _weights(r["at"], r["tf"], idf)
        vectors_[places[r[doc]], at] = w
    held = docs.sparkSession.sparkContext.broadcast((np.ascontiguousarray(vectors_.T), idf))
    kind, names = docs.schema[doc].dataType.simpleString(), [f"v{i}" for i in range(len(own))]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, idf = held.value
        for batch in batches:
            out = np.zeros((batch.num_rows, v.shape[1]))
            for i, (a, b) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                at, w = _weights(a.as_buffer(), b.as_buffer(), idf)
                out[i] = w @ v[at]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in out.T]], names=[doc, *names])

    sums = packed.mapInArrow(score, f"`{doc}` {kind}, " + ", ".join(f"{c} double" for c in names))
    each = [F.struct(F.lit(idx).alias("idx"), F.lit(field).alias("field"), F.coalesce(F.col(c), F.lit(0.0)).alias("score")) for (idx, field), c in zip(own.values(), names, strict=True)]
    return docs.select(doc).join(sums, doc, "left").select(doc, F.inline(F.array(*each)))
