"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are reduced to lower-cased letters and digits. A place where a text holds an item of m
characters with at most e edits shares at least m + 1 - q (e + 1) q-grams with it, all on at most e + 1 neighbouring
diagonals. So shared q-grams are counted in overlapping bands of diagonals, each twice as wide as that; bands that reach
the bound are regions, and each is verified by a banded alignment.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_names

Q, EDIT_RATE = 10, 0.06
#: Characters of benchmark text in one broadcast index (about 30 bytes each); a larger benchmark is taken in blocks.
INDEX_CHARS = 4_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_BITS = 22
_tables: list[np.ndarray] = []


def _char_tables() -> list[np.ndarray]:
    """For each code point: whether it is a letter or digit, and its lower case where that is one code point."""
    if not _tables:
        text = [chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x110000)]
        _tables.append(np.fromiter(map(str.isalnum, text), bool, 0x110000))
        low = np.arange(0x110000, dtype=np.uint32)
        for c, x in enumerate(text):
            y = x.lower()
            if y != x and len(y) == 1:
                low[c] = ord(y)
        _tables.append(low)
    return _tables


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points kept, lower-cased, and their places in the text."""
    alnum, low = _char_tables()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero(alnum[codes])
    return low[codes[at]], at


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q characters from each place; doubling, so the work grows with log q."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    power = {1: codes.astype(np.uint64)}
    size = 1
    while 2 * size <= q:
        h = power[size]
        power[2 * size] = h[: len(h) - size] * np.uint64(pow(_BASE, size, 1 << 64)) + h[size:]
        size *= 2
    h, have = power[size], size
    for part in sorted((p for p in power if p < size), reverse=True):
        if have + part <= q:
            n = len(codes) - have - part + 1
            h = h[:n] * np.uint64(pow(_BASE, part, 1 << 64)) + power[part][have : have + n]
            have += part
    return h * np.uint64(0xBF58476D1CE4E5B9)


def edit_budget(m: int, q: int, rate: float) -> int:
    """The edits allowed in an item of m characters: the rate's share, fewer where the bound would fall below 1."""
    return max(0, min(int(rate * m), (m + 1) // q - 1 - ((m + 1) % q == 0)))


class Index:
    """The q-grams of a block of items; ids, lengths, budgets and bounds of the items."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, rate: float = EDIT_RATE):
        self.q = q
        self.ids, self.codes, grams, owner, place = [], [], [], [], []
        for item, text in items:
            codes, _ = normalise(text or "")
            if len(codes) < q:
                continue
            h = gram_hashes(codes, q)
            owner.append(np.full(len(h), len(self.ids), np.int64))
            place.append(np.arange(len(h)))
            grams.append(h)
            self.ids.append(item)
            self.codes.append(codes)
        self.m = np.array([len(c) for c in self.codes], np.int64)
        self.budget = np.array([edit_budget(m, q, rate) for m in self.m.tolist()], np.int64)
        self.bound = self.m + 1 - q * (self.budget + 1)
        if self.ids:
            h, owner, place = np.concatenate(grams), np.concatenate(owner), np.concatenate(place)
            order = np.lexsort((place, owner, h))
            self.owner, self.place = owner[order], place[order]
            self.hash, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.filter: np.ndarray | None = None

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of known grams, and which they are."""
        if self.filter is None:
            self.filter = np.zeros(1 << _BITS, bool)
            self.filter[self.hash >> np.uint64(64 - _BITS)] = True
        at = np.flatnonzero(self.filter[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.hash, h[at]), len(self.hash) - 1)
        ok = self.hash[k] == h[at]
        return at[ok], k[ok]

    def matches(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """For each text (item id, start, end, edits) of every place that holds an item within its budget."""
        out: list[list] = [[] for _ in texts]
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) < 1_000_000):
                chars += len(texts[end])
                end += 1
            if self.ids:
                self._slice(texts[at:end], out, at)
            at = end
        return out

    def _slice(self, texts: list[str], out: list, base: int) -> None:
        codes, places = normalise("\n".join(texts))
        ends = np.cumsum([len(t) + 1 for t in texts])
        h = gram_hashes(codes, self.q)
        if not len(h):
            return
        at, gram = self.hits(h)
        doc = np.searchsorted(ends, places[at], side="right")
        whole = doc == np.searchsorted(ends, places[at + self.q - 1], side="right")
        at, gram, doc = at[whole], gram[whole], doc[whole]
        # band: (text, item, number); each hit counts in two overlapping ones, an item's place once in each
        found, lo = [], 0
        total = np.cumsum(self.count[gram])
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + 2_000_000, side="right")))
            n = self.count[gram[lo:hi]]
            row = np.repeat(np.arange(lo, hi), n)
            entry = np.repeat(self.first[gram[lo:hi]], n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            item, place = self.owner[entry], self.place[entry]
            diagonal = at[row] - place
            width = self.budget[item] + 1
            band = np.floor_divide(diagonal, width)
            rows = np.stack((doc[row], item, band, place), axis=1)
            found.append(np.unique(np.concatenate((rows, rows - np.array([0, 0, 1, 0]))), axis=0))
            lo = hi
        if not found:
            return
        rows = np.unique(np.concatenate(found), axis=0) if len(found) > 1 else found[0]
        head = np.flatnonzero(np.concatenate(([True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1))))
        shared = np.diff(np.append(head, len(rows)))
        first = np.searchsorted(places, np.concatenate(([0], ends[:-1])))
        last = np.append(first[1:], len(codes))
        for d, i, b, _ in rows[head[shared >= self.bound[rows[head, 1]]]].tolist():
            w, m, e = int(self.budget[i]) + 1, int(self.m[i]), int(self.budget[i])
            low, high = b * w, (b + 2) * w - 1  # diagonals, from the first character kept of the slice
            start, stop = max(int(first[d]), low - e), min(int(last[d]), high + m + e)
            if stop <= start:
                continue
            hit = banded_alignment(self.codes[i], codes[start:stop], low - e - start, high + e - start, e)
            if hit is None:
                continue
            edits, x, y = hit
            shift = int(ends[d - 1]) if d else 0
            span = (int(self.ids[i]), int(places[start + x]) - shift, int(places[start + y - 1]) - shift + 1, edits)
            seen = out[base + d]
            if not any(s[0] == span[0] and s[1] < span[2] and span[1] < s[2] for s in seen):
                seen.append(span)


def banded_alignment(item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place in text that holds the whole item on diagonals low to high, or None over the
    budget. The ends of the text are free."""
    n, width = len(text), high - low + 1
    big = len(item) + n + 1
    col = low + np.arange(width)  # text characters used before item character 0
    cost = np.where((col >= 0) & (col <= n), 0, big)
    start = np.clip(col, 0, n)
    for r, c in enumerate(item.tolist(), 1):
        col = low + r + np.arange(width)
        ok = (col >= 1) & (col <= n)
        same = np.ones(width, np.int64)
        same[ok] = text[col[ok] - 1] != c
        a = np.where(ok, cost + same, big)  # item character against a text character
        up = np.append(cost[1:] + 1, big)  # item character left out
        up_start = np.append(start[1:], 0)
        new = np.where(up < a, up, a)
        new_start = np.where(up < a, up_start, start)
        new = np.where((col >= 0) & (col <= n), new, big)
        # text characters left out: a running minimum along the row
        step = np.arange(width)
        key = (new - step) * width + step
        best = np.minimum.accumulate(key)
        src = best % width
        cost, start = np.minimum(new[src] + step - src, big), new_start[src]
        if cost.min() > budget:
            return None
    k = int(np.argmin(cost))
    x, y = int(start[k]), int(low + len(item) + k)
    return (int(cost[k]), x, y) if cost[k] <= budget and y > x else None


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "matches", q: int = Q, rate: float = EDIT_RATE, index_chars: int = INDEX_CHARS) -> DataFrame:
    """docs with a column `out`: the places of each whole text that hold a benchmark item, as an array of item_id, start,
    end (characters of the text) and edits; empty where there is none.

    A place holds an item if the item's letters and digits, lower-cased, align with it within edit_budget() edits. Null
    and empty texts hold nothing. Items that are null or have fewer than q letters and digits never match; an empty
    benchmark marks nothing. Of overlapping places of one item the first found is given. A column named `out` is
    replaced, others stay; repeated rows are marked alike. The index is broadcast in blocks of `index_chars` characters.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / index_chars))
    found: list = []
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()
        index = spark.sparkContext.broadcast(Index([(r["i"], r["t"]) for r in part], q, rate))
        found.append(_marker(index))

    def run(inner: DataFrame, text: str) -> DataFrame:
        marked = [f(F.col(text)) for f in found]
        return inner.withColumn(out, F.concat(*marked) if len(marked) > 1 else marked[0])

    return own_names(docs, {"text": text}, [out], run)


def _marker(index):
    @F.pandas_udf("array<struct<item_id:long,start:long,end:long,edits:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            got = index.value.matches([t if isinstance(t, str) else "" for t in s.tolist()])
            yield pd.Series([[dict(zip(("item_id", "start", "end", "edits"), x, strict=True)) for x in m] for m in got], dtype=object)

    return run
