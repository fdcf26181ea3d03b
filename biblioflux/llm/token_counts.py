"""Token counts by rank-synchronous array merging.

The text is cut into pre-tokens that no vocabulary piece can bridge; distinct pre-tokens of a slice of texts are held
as one ragged numpy array of symbols, and in each round every sequence applies its lowest-rank pair at once. What
survives is counted. The merge table is derived from the pieces of an existing model file, which is never trained or
copied.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the mark that stands for a space in the pieces.
MARK = "▁"
_RUN = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_BIG = np.int64(1) << 40
_K = np.int64(1) << 21


class RankMerger:
    """Counts the pieces of words by a BPE model of sentencepiece's kind with byte fallback."""

    def __init__(self, model_path: str, cache_words: int = 400_000):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        spec, trained = model.normalizer_spec, model.trainer_spec
        plain = not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and spec.escape_whitespaces
        if trained.model_type != 2 or not trained.byte_fallback or not plain or not spec.add_dummy_prefix:
            raise ValueError("only plain BPE models with byte fallback and a dummy prefix are covered")
        pieces = {p.piece: p.score for p in model.pieces if p.type == 1}
        if any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("models with user-defined or unused pieces are not covered")
        if any(x != MARK and y == MARK for p in pieces for x, y in zip(p, p[1:], strict=False)):
            raise ValueError("a piece goes on past a space; words cannot be counted apart")
        ids = {p: i for i, p in enumerate(pieces)}
        for p in pieces:
            for c in p:
                ids.setdefault(c, len(ids))
        self.unknown = len(ids)
        self.of_char = np.full(0x110000, self.unknown, np.int64)
        self.char_cost = np.ones(0x110000, np.int8)
        self.char_cost[0x80:] = 2
        self.char_cost[0x800:] = 3
        self.char_cost[0x10000:] = 4
        for p, i in ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
                if p in pieces:
                    self.char_cost[ord(p)] = 1
        # rank: dense by falling score, equal scores share one
        order = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        rows, bridges = [], set()
        for p, s in pieces.items():
            bridges.update(ids[x] * int(_K) + ids[y] for x, y in zip(p, p[1:], strict=False))
            rows += [(ids[p[:k]] * int(_K) + ids[p[k:]], order[s], ids[p]) for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 3)
        self.keys, self.ranks, self.made = (np.ascontiguousarray(table[:, k]) for k in range(3))
        self.bridges = np.array(sorted(bridges), np.int64)
        self.cache: dict[str, int] = {}
        self.cache_words = cache_words

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * _K + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _BIG), self.made[at]

    def merge(self, words: list[str]) -> np.ndarray:
        """Pieces of each word; the words carry their own space marks."""
        out = np.zeros(len(words), np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        if not len(codes):
            return out
        sym, cost = self.of_char[codes], self.char_cost[codes].astype(np.int64)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        # sequences end where a word ends or where no piece has both neighbours
        pair = sym[:-1] * _K + sym[1:]
        at = np.minimum(np.searchsorted(self.bridges, pair), len(self.bridges) - 1)
        cut = (self.bridges[at] != pair) | (word[1:] != word[:-1])
        seq = np.concatenate(([0], np.cumsum(cut)))
        while len(sym):
            start = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            rank, made = self._look(sym[:-1], sym[1:])
            rank[seq[1:] != seq[:-1]] = _BIG
            rank = np.append(rank, _BIG)
            size = np.diff(np.append(start, len(sym)))
            least = np.repeat(np.minimum.reduceat(rank, start), size)
            done = least == _BIG
            if done.any():
                out += np.bincount(word[done], cost[done], len(out)).astype(np.int64)
                keep = ~done
                sym, cost, word, seq = sym[keep], cost[keep], word[keep], seq[keep]
                made = np.append(made, 0)[keep]
                rank, least = rank[keep], least[keep]
                if not len(sym):
                    break
            pos = np.flatnonzero(rank == least)
            pos = self._together(sym, seq, pos, made, least)
            sym[pos], cost[pos] = made[pos], 1
            keep = np.ones(len(sym), bool)
            keep[pos + 1] = False
            sym, cost, word, seq = sym[keep], cost[keep], word[keep], seq[keep]
        return out

    def _together(self, sym, seq, pos, made, least) -> np.ndarray:
        """Of the places with their sequence's lowest rank, those that one round may merge: no two overlap, and none
        comes after a merge that opens a pair as good or better, which must go first."""
        own = seq[pos]
        if len(pos) < 2 or not (own[1:] == own[:-1]).any():
            return pos
        new_run = np.concatenate(([True], (np.diff(pos) != 1)))
        first = np.maximum.accumulate(np.where(new_run, np.arange(len(pos)), 0))
        pos = pos[(np.arange(len(pos)) - first) % 2 == 0]
        own = seq[pos]
        n, at = len(sym), made[pos]
        joined = np.concatenate(([False], pos[1:] == pos[:-1] + 2))
        before = np.where(joined, np.concatenate(([0], at[:-1])), sym[np.maximum(pos - 1, 0)])
        has_before = (pos > 0) & (seq[np.maximum(pos - 1, 0)] == own)
        after = np.minimum(pos + 2, n - 1)
        has_after = (pos + 2 < n) & (seq[after] == own)
        bad = has_before & (self._look(before, at)[0] <= least[pos])
        bad |= has_after & (self._look(at, sym[after])[0] <= least[pos])
        total = np.cumsum(bad)
        so_far = total - bad
        head = np.concatenate(([True], own[1:] != own[:-1]))
        base = np.maximum.accumulate(np.where(head, so_far, 0))
        return pos[so_far == base]

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; texts are handled in slices of a few million characters, so memory follows the longest
        text and not the batch."""
        out = np.zeros(len(texts), np.int64)
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) < 4_000_000):
                chars += len(texts[end])
                end += 1
            out[at:end] = self._slice(texts[at:end])
            at = end
        return out

    def _slice(self, texts: list[str]) -> list[int]:
        cut = []
        for t in texts:
            if not t:
                cut.append([])
            elif t[0] == " " or "  " in t or MARK in t:
                cut.append([w[1:] for w in _RUN.findall(MARK + t.replace(" ", MARK))])
            else:
                cut.append(t.split(" "))
        known = self.cache
        missing = list({w for words in cut for w in words if w not in known})
        if missing:
            found = dict(zip(missing, self.merge([MARK + w for w in missing]).tolist(), strict=True))
            if len(known) + len(found) <= self.cache_words:
                known.update(found)
            else:
                known = _Both(known, found)
        return [sum(map(known.__getitem__, words)) for words in cut]


class _Both(dict):
    """Looks in its own words and then in the kept ones, which are full."""

    def __init__(self, kept: dict, own: dict):
        super().__init__(own)
        self.kept = kept

    def __missing__(self, key):
        return self.kept[key]


_mergers: dict[str, RankMerger] = {}


def merger(model_path: str) -> RankMerger:
    """One merger for each Python worker."""
    if model_path not in _mergers:
        _mergers[model_path] = RankMerger(model_path)
    return _mergers[model_path]


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs with a column `out`: the tokens of the whole text, without begin or end tokens.

    A null text counts as empty and has 0 tokens. Rows are not changed, moved or joined, so repeated rows and ids are
    counted apart, and an empty table stays empty. A column named `out` that is there already is replaced; all other
    columns stay. The work is one narrow pass; each Python worker keeps at most 400,000 words.
    """

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = merger(model_path)
        for s in batches:
            yield pd.Series(m.counts([t if isinstance(t, str) else "" for t in s.tolist()]))

    return docs.withColumn(out, tokens(F.col(text)))
