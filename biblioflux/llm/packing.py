"""Best-fit packing of tokenised documents into sequences, improved by a swap-based local search.

Documents are tokenised in one narrow pass and cut into pieces; only the small piece rows move. They are dealt evenly
(no key, so no hot key) into groups of bounded size. Each group is packed best-fit-decreasing, and then a local search
moves documents out of the emptiest bins, or exchanges one for one or two for one with fuller bins, each step raising
the sum of squared fills, until bins empty.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Piece rows that one group packs, about; memory and time of a task follow it and not the table.
GROUP_ROWS = 8192

#: White space other than space and line feed, as the split pattern of byte-level BPE has it, and near it.
_ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for the 256 bytes: printable ones stand for themselves, the others
    follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts by a byte-level BPE file of the tokenizers library, without added special tokens.

    Most words recur, so texts with plain spacing are cut at their spaces, where the split pattern always cuts, and the
    ids of each word are kept (at most `cache_words` of them). New words are encoded together. All other texts, and
    words with letters beyond the Latin blocks, go to the library as they are.
    """

    def __init__(self, path: str, cache_words: int = 400_000):
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        letters, added = _byte_letters(), {t["id"] for t in spec["added_tokens"]}
        vocab = {bytes(letters[c] for c in w): i for w, i in spec["model"]["vocab"].items() if i not in added}
        merged = [i for w, i in sorted(vocab.items(), key=lambda x: x[1]) if len(w) > 1]
        pre = spec["pre_tokenizer"]
        plain = pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and spec["normalizer"] is None
        # the fast library takes an id for its rank; so it must be
        rank_is_id = [bytes(letters[c] for c in "".join(m)) for m in self._merges(spec)] == [w for w, _ in sorted(((w, i) for w, i in vocab.items() if len(w) > 1), key=lambda x: x[1])]
        self.fast = None
        if plain and rank_is_id and merged:
            #: Fixed value: the split pattern of byte-level BPE.
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=vocab, special_tokens={})
            self.width = np.zeros(max(vocab.values()) + 1, np.int64)
            for w, i in vocab.items():
                self.width[i] = len(w)
        self.cache: dict[str, bytes] = {}
        self.cache_words = cache_words

    @staticmethod
    def _merges(spec: dict) -> list:
        return [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]

    def _whole(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _first(self, word: str) -> bytes:
        if not word or max(word) >= "ɐ":
            return self._whole(word)
        return np.array(self.fast.encode_ordinary(word), "<u4").tobytes()

    def _simple(self, t: str) -> bool:
        return not ("  " in t or " \n" in t or "\n " in t or _ODD.search(t) or any(s in t for s in self.special))

    def _new(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words with a space before each."""
        near = [w for w in words if w and max(w) < "ɐ"]
        out = {w: self._whole(" " + w) for w in words if not w or max(w) >= "ɐ"}
        if near:
            ids = np.array(self.fast.encode_ordinary(" " + " ".join(near)), "<u4")
            ends = np.cumsum(self.width[ids])
            stops = np.searchsorted(ends, np.cumsum([len(w.encode()) + 1 for w in near])) + 1
            raw, at = ids.tobytes(), 0
            for w, stop in zip(near, stops.tolist(), strict=True):
                out[w] = raw[4 * at : 4 * stop]
                at = stop
        return out

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text, in order."""
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) < 4_000_000):
                chars += len(texts[end])
                end += 1
            yield from self._slice(texts[at:end])
            at = end

    def _slice(self, texts: list[str]) -> Iterator[bytes]:
        if self.fast is None:
            yield from map(self._whole, texts)
            return
        cut = [t.split(" ") if t and self._simple(t) else None for t in texts]
        known = self.cache
        missing = list({w for words in cut if words for w in words[1:] if w not in known})
        if missing:
            found = self._new(missing)
            if len(known) + len(found) <= self.cache_words:
                known.update(found)
            else:
                known = _Both(known, found)
        for t, words in zip(texts, cut, strict=True):
            if words is None:
                yield self._whole(t) if t else b""
            else:
                yield self._first(words[0]) + b"".join(map(known.__getitem__, words[1:]))


class _Both(dict):
    def __init__(self, kept: dict, own: dict):
        super().__init__(own)
        self.kept = kept

    def __missing__(self, key):
        return self.kept[key]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size; bins are found by their remaining room in a bit set, tightest first."""
    order = np.argsort(-sizes, kind="stable")
    room: dict[int, list[int]] = {}
    bits, n, out = 0, 0, np.zeros(len(sizes), np.int64)
    for i, s in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = bits >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                bits ^= 1 << r
        else:
            r, b, n = capacity, n, n + 1
        out[i] = b
        if r - s:
            room.setdefault(r - s, []).append(b)
            bits |= 1 << (r - s)
    return out


def local_search(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Raise the sum of squared fills until bins empty.

    The emptiest bin gives: a document moves to the bin where it fits tightest; or is exchanged for a smaller one of
    another bin; or two are exchanged for one. Each step takes the exchange that moves most, keeps every bin within its
    capacity and moves tokens to a bin at least as full, so the sum of squares rises and the search ends: when the
    number of bins is the least possible, or when a pass over all bins finds no step.
    """
    bins = bins.copy()
    n_bins = int(bins.max()) + 1 if len(bins) else 0
    fill = np.bincount(bins, sizes, n_bins).astype(np.int64)
    least = math.ceil(int(sizes.sum()) / capacity)
    stuck, moved = np.zeros(n_bins, bool), False
    while np.count_nonzero(fill) > least:
        givers = np.flatnonzero((fill > 0) & (fill < capacity) & ~stuck)
        if not len(givers):
            if not moved:
                break
            stuck[:], moved = False, False  # what other bins gave may have freed these
            continue
        giver = int(givers[np.argmin(fill[givers])])
        own = np.flatnonzero(bins == giver)
        others = np.flatnonzero((bins != giver) & (fill[bins] >= fill[giver]) & (fill[bins] < capacity))
        step = _step(sizes, bins, capacity - fill, own[np.argsort(-sizes[own], kind="stable")], others)
        if step is None:
            stuck[giver] = True
            continue
        out, into, to = step
        bins[out], bins[into] = to, giver
        d = int(sizes[out].sum()) - int(sizes[into].sum())
        fill[giver] -= d
        fill[to] += d
        moved = True
    return np.unique(bins, return_inverse=True)[1]


def _step(sizes, bins, gap_of, own, others):
    """(documents that leave, documents that come, the bin), or None; own is in descending order of size."""
    if not len(others):
        return None
    b = np.unique(bins[others])
    gaps = gap_of[b]
    widest = int(gaps.max())
    for i in own:  # move: the tightest bin
        if sizes[i] <= widest:
            fit = gaps >= sizes[i]
            return np.array([i]), np.array([], np.int64), int(b[fit][np.argmin(gaps[fit])])
    x, g = sizes[others], gap_of[bins[others]]
    reach = np.zeros(int(x.max()) + 1, np.int64)  # the widest gap beside a document of each size
    np.maximum.at(reach, x, g)
    comes = np.flatnonzero(reach)
    upto = comes + reach[comes]
    alone = np.arange(len(own))[:, None]
    for leave in (alone, np.stack(np.triu_indices(len(own), 1), axis=1)):  # one for one, two for one
        if not len(leave):
            continue
        leaves, which = np.unique(sizes[own][leave].sum(axis=1), return_inverse=True)
        fits = (comes < leaves[:, None]) & (leaves[:, None] <= upto)
        least = np.where(fits.any(axis=1), comes[fits.argmax(axis=1)], leaves)  # the smallest that can come
        k = int(np.argmax(leaves - least))
        if leaves[k] > least[k]:
            into = np.flatnonzero((x == least[k]) & (leaves[k] - x <= g))[0]
            return own[leave[np.flatnonzero(which == k)[0]]], others[[into]], int(bins[others[into]])
    return None


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin (from 0) of each size from 1 to capacity; full ones get bins of their own."""
    out = np.zeros(len(sizes), np.int64)
    full = sizes == capacity
    part = np.flatnonzero(~full)
    n = 0
    if len(part):
        out[part] = local_search(sizes[part], best_fit_decreasing(sizes[part], capacity), capacity)
        n = int(out[part].max()) + 1
    out[full] = n + np.arange(int(full.sum()))
    return out


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids and a closing id 0, cut where it is longer than
    capacity; the first piece takes what is left over."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows: list[list[int]] = [[], [], [], [], []]
            for i, raw in enumerate(e.encode(texts)):
                raw += b"\0\0\0\0"
                n = len(raw) // 4
                start, length = 0, (n - 1) % capacity + 1
                for piece in range(-(-n // capacity)):
                    for to, v in zip(rows, (i, piece, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])), strict=True):
                        to.append(v)
                    start, length = start + length, capacity
            own, piece, start, length, crc = rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(own, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=[doc_id, "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(doc_id, text).mapInArrow(cut, f"`{doc_id}` {kind}, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text", group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pack all documents into sequences of at most `capacity` tokens.

    Returns a row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is
    the closing id alone. Repeated rows and ids are packed apart; a null id stays null; an empty table gives no rows.
    Other columns are not read. Groups are dealt by Spark's round robin over sorted rows, so a task that is run again
    gets the same rows.
    """
    groups = max(1, math.ceil(docs.count() / group_rows))
    pieces = token_pieces(docs, tokenizer_path, capacity, doc_id, text)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = list(batches)
        if not rows:
            return
        t = pa.Table.from_batches(rows)
        length, crc = t["length"].to_numpy(), t["ids_crc32"].to_numpy()
        t = t.take(pa.array(np.lexsort((t["piece"].to_numpy(), crc, -length))))
        length = t["length"].to_numpy()
        bins = pack(length, capacity)
        order = np.argsort(bins, kind="stable")
        t, bins, length = t.take(pa.array(order)), bins[order], length[order]
        before = np.cumsum(length) - length
        head = np.concatenate(([True], bins[1:] != bins[:-1]))
        offset = before - np.maximum.accumulate(np.where(head, before, 0))
        t = t.append_column("sequence_id", pa.array(bins + (TaskContext.get().partitionId() << 32), pa.int64()))
        t = t.append_column("offset", pa.array(offset, pa.int64()))
        yield from t.to_batches(max_chunksize=10_000)

    kind = docs.schema[doc_id].dataType.simpleString()
    return pieces.repartition(groups).mapInArrow(
        place, f"`{doc_id}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
