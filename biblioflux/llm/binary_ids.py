"""Token ids in binary files: frequency-ranked ids in a byte-aligned variable-length coding with separate control bytes.

Documents are put in ascending order of their ids by a range partitioning, and each partition becomes one file, in one
narrow pass of tokenising and coding. A file is a sequence of blocks that hold all that is needed to read them:

    "FRVB", then 8 unsigned 32-bit numbers: version, file number, block number, pieces, ids, distinct ids, bytes of
    names, bytes of data; then
    the distinct ids, most frequent first (16 bits each if all fit, else 32: version 1 or 2);
    for each piece: number of ids (32 bits), flags (8 bits: 1 the document ends here, 2 its id is null), length of
    its name (32 bits); then the names, which are the document ids as UTF-8 text;
    control bytes, two bits for each id in turn: the number of its data bytes less one;
    data bytes: for each id its place among the distinct ids, little-endian, in as few bytes as hold it;
    a line feed.

All numbers are little-endian. A document that does not end with its block goes on in the next one, so blocks are of
bounded size whatever the documents are. Spark's own writer commits the files, so lost or repeated tasks leave none
behind and any file system that Spark writes to will do.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize
from .packing import _byte_letters

#: A block is closed when it has so many ids.
BLOCK_IDS = 1 << 22
#: Text of about so many bytes goes into one file.
FILE_BYTES = 64 << 20
_MAGIC, _HEAD = b"FRVB", 36
#: Of each control byte, the data bytes of its four ids.
_LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


class Piece(NamedTuple):
    name: bytes | None
    ids: np.ndarray
    ends: bool


def encode_block(pieces: list[Piece], number: int, block: int) -> bytes:
    """One block, as the module's text has it."""
    ids = np.concatenate([p.ids for p in pieces]) if pieces else np.zeros(0, np.uint32)
    count = np.bincount(ids, minlength=1)
    distinct = np.argsort(-count, kind="stable")[: np.count_nonzero(count)]
    place = np.zeros(len(count), np.uint32)
    place[distinct] = np.arange(len(distinct), dtype=np.uint32)
    code = place[ids]
    length = np.ones(len(code), np.uint8)
    for limit in (1 << 8, 1 << 16, 1 << 24):
        length += code >= limit
    control = np.zeros(-(-len(code) // 4) * 4, np.uint8)
    control[: len(code)] = length - 1
    control = control.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    data = code.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) < length[:, None]]
    version = 1 if not len(distinct) or distinct.max() < 1 << 16 else 2
    names = [p.name or b"" for p in pieces]
    head = np.array([version, number, block, len(pieces), len(ids), len(distinct), sum(map(len, names)), len(data)], "<u4")
    sizes = np.array([len(p.ids) for p in pieces], "<u4")
    flags = np.array([int(p.ends) + 2 * (p.name is None) for p in pieces], np.uint8)
    spans = np.array([len(n) for n in names], "<u4")
    table = distinct.astype("<u2" if version == 1 else "<u4")
    return b"".join([_MAGIC, head.tobytes(), table.tobytes(), sizes.tobytes(), flags.tobytes(), spans.tobytes(), *names, control.tobytes(), data.tobytes()])


def decode_blocks(raw: bytes) -> Iterator[tuple[int, list[Piece]]]:
    """(file number, pieces) of each block of a file."""
    at = 0
    while at < len(raw):
        if raw[at : at + 4] != _MAGIC:
            raise ValueError("not a file of ids")
        version, number, _, n, ids, distinct, span, size = np.frombuffer(raw, "<u4", 8, at + 4).tolist()
        at += _HEAD

        def take(kind: str, k: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, k, at)
            at += out.nbytes
            return out

        table = take("<u2" if version == 1 else "<u4", distinct).astype(np.uint32)
        sizes, flags, spans = take("<u4", n), take("u1", n), take("<u4", n)
        names = take("u1", span).tobytes()
        length = _LENGTHS[take("u1", -(-ids // 4))].ravel()[:ids]
        data = take("u1", size)
        start = np.cumsum(length, dtype=np.int64) - length
        code = data[start].astype(np.uint32) if ids else np.zeros(0, np.uint32)
        for k in range(1, int(length.max(initial=1))):
            more = np.flatnonzero(length > k)
            code[more] |= data[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
        found = table[code]
        cut, stops = np.split(found, np.cumsum(sizes))[:-1], np.cumsum(spans).tolist()
        yield number, [Piece(None if f & 2 else names[e - s : e], x, bool(f & 1)) for x, f, s, e in zip(cut, flags.tolist(), spans.tolist(), stops, strict=True)]
        at += 1


#: Fixed value: the pattern of words in lower-casing vocabularies with word ends.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_MARK = "\x01"
#: Words with control characters, odd white space or letters beyond the Latin blocks are left to the library.
_ODD = re.compile("[\x00-\x09\x0b-\x20\x7f-\xa0\u0250-\U0010ffff]")


class WordEncoder:
    """Ids of texts by a file of the tokenizers library, without added special tokens.

    Where the file drops white space and never looks across it, a text's ids are those of its words one after the
    other, and most words recur: the distinct words of many texts are encoded once. Latin ones are encoded together by
    tiktoken, over the same merges, the end of a word being a byte of its own that is merged first; all others, and the
    texts of other files, go to the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = self._drops_space(spec)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.fast = self._fast(spec) if self.by_word else None

    @staticmethod
    def _drops_space(spec: dict) -> bool:
        norm = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        first, *rest = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        cuts = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and first.get("pattern") == {"Regex": _WORDS}
        plain = [r["type"] for r in rest] == ["ByteLevel"] and not rest[0]["add_prefix_space"] and not rest[0]["use_regex"]
        added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])
        return norm == ["NFC", "Replace", "Lowercase"] and cuts and plain and added and spec["post_processor"] is None

    def _fast(self, spec: dict):
        import tiktoken

        model = spec["model"]
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        letters = _byte_letters()
        if not suffix or model["ignore_merges"] or any(c not in vocab or c + suffix not in vocab for c in letters):
            return None

        def raw(token: str) -> bytes:
            end = token.endswith(suffix)
            return bytes(letters[c] for c in (token[: -len(suffix)] if end else token)) + (_MARK.encode() if end else b"")

        order = {raw(c): vocab[c] for c in letters} | {raw(c + suffix): vocab[c + suffix] for c in letters}
        made = [x + y for x, y in merges if not x.endswith(suffix)]
        if len(made) != len(merges) or len(set(made)) != len(made):
            return None
        order |= {raw(w): vocab[w] for w in made}
        if len(order) != 2 * len(letters) + len(made):
            return None
        self.id_of = np.array(list(order.values()), np.uint32)
        self.width = np.array([len(w) for w in order], np.int64)
        return tiktoken.Encoding("own", pat_str=rf"[^{_MARK}]+{_MARK}", mergeable_ranks={w: i for i, w in enumerate(order)}, special_tokens={})

    def _by_library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.full.encode_batch(texts, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        marked = regex.sub(_WORDS, rf"\g<0>{_MARK}", "\n".join(words).lower())
        ranks = np.array(self.fast.encode_ordinary(marked.replace("\n", "")), np.int64)
        ends = np.flatnonzero(np.frombuffer((marked + "\n").encode(), np.uint8) == 10)
        stops = np.searchsorted(np.cumsum(self.width[ranks]), ends - np.arange(len(ends)), "right")
        return self.id_of[ranks], np.diff(stops, prepend=0)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of words that have no white space around them."""
        if self.fast is None:
            return self._by_library(words)
        every = "\n".join(words)
        if not _ODD.search(every) and not any(x in every for x in self.special):
            return self._plain(words)
        odd = np.array([bool(_ODD.search(w)) or any(x in w for x in self.special) for w in words])
        ids, counts = zip(self._plain([w for w, o in zip(words, odd, strict=True) if not o]), self._by_library([w for w, o in zip(words, odd, strict=True) if o]), strict=True)
        place = np.argsort(np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)]))
        return _ragged(np.concatenate(ids), np.concatenate(counts), place)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all UTF-8 texts, one after the other; the number of ids of each)."""
        if not self.by_word:
            return self._by_library([t.decode() for t in texts.to_pylist()])
        words = pc.ascii_split_whitespace(texts.cast(pa.string()))
        coded = words.flatten().dictionary_encode()
        ids, counts = _ragged(*self._words(coded.dictionary.to_pylist()), coded.indices.to_numpy())
        before = np.concatenate(([0], np.cumsum(counts)))
        return ids, np.diff(before[words.offsets.to_numpy() - words.offsets[0].as_py()])


def _ragged(values: np.ndarray, counts: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of values, counts[i] long, that `place` names, one after the other; and their lengths."""
    own, start = counts[place], np.cumsum(counts) - counts
    shift = start[place] - (np.cumsum(own) - own)
    return values[np.repeat(shift, own) + np.arange(own.sum())], own


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _cut(text: bytes, size: int) -> list[bytes]:
    """Parts of about so many bytes, cut before spaces."""
    out, at = [], 0
    while len(text) - at > size and (end := text.find(b" ", at + size)) >= 0:
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def _pieces(batches: Iterator[pa.RecordBatch], encoder: WordEncoder, end_id: int, slice_bytes: int = 1 << 24) -> Iterator[Piece]:
    """The ids of each text and end_id; texts are encoded some together, long ones in parts."""
    end = np.array([end_id], np.uint32)
    for batch in batches:
        names = batch.column(0).cast(pa.binary())
        texts = pc.fill_null(batch.column(1).cast(pa.binary()), b"")
        size = pc.binary_length(texts).to_numpy()
        at = 0
        while at < batch.num_rows:
            stop = at + max(1, int(np.searchsorted(np.cumsum(size[at:]), slice_bytes, "right")))
            if stop == at + 1 and encoder.by_word and size[at] > slice_bytes:
                for part in _cut(texts[at].as_py(), slice_bytes):
                    yield Piece(names[at].as_py(), encoder.encode(pa.array([part], pa.binary()))[0], False)
                yield Piece(names[at].as_py(), end, True)
            else:
                ids, counts = encoder.encode(texts.slice(at, stop - at))
                stops = np.cumsum(counts)
                closed = np.insert(ids, stops, end_id)
                stops += np.arange(1, len(stops) + 1)
                for name, x in zip(names.slice(at, stop - at).to_pylist(), np.split(closed, stops[:-1]), strict=True):
                    yield Piece(name, x, True)
            at = stop


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, doc_id: str = "doc_id", text: str = "text", file_bytes: int = FILE_BYTES, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of all documents, each followed by end_id, to files below `path`, in ascending order of doc_id.

    A null id comes first; rows with one id are ordered by a hash of their text, and equal rows stay as many as they are,
    over several files if need be. A null or empty text is the end id alone. Other columns are not read; of an empty
    table comes a folder without ids.
    """
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    rows = docs.select(q(doc_id).alias("id"), q(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    keyed = rows.select("id", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("m"), "text")
    placed = keyed.repartitionByRange(math.ceil((size + 1) / file_bytes), "id", "h", "m").sortWithinPartitions("id", "h", "m")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, block, held, pieces = TaskContext.get().partitionId(), 0, 0, []

        def out() -> pa.RecordBatch:
            nonlocal block, held
            raw = encode_block(pieces, number, block)
            block, held = block + 1, 0
            pieces.clear()
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], names=["block"])

        for piece in _pieces(batches, _encoder(tokenizer_path), end_id):
            pieces.append(piece)
            held += len(piece.ids)
            if held >= block_ids:
                yield out()
        if pieces:
            yield out()

    blocks = placed.select(F.col("id").cast("string").alias("id"), "text").mapInArrow(code, "block binary")
    # Spark's text writer puts the bytes as they are, each row followed by a line feed
    blocks.select(F.col("block").cast("string")).write.option("compression", "none").option("lineSep", "\n").text(path)


def read_ids(spark: SparkSession, path: str, id_type: str = "long", with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, file, ids) of each document in the files below `path`: the ids of all documents
    before it, their number with the end id, the crc32 of them as little-endian unsigned 32-bit integers, the file's
    number and, if asked for, the ids themselves as such bytes (else null)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                at, crc, n, held = 0, 0, 0, []
                for number, pieces in decode_blocks(content.as_py()):
                    rows: list[list] = [[], [], [], [], []]
                    for p in pieces:
                        raw = p.ids.astype("<u4").tobytes()
                        crc, n = zlib.crc32(raw, crc), n + len(p.ids)
                        if with_ids:
                            held.append(raw)
                        if p.ends:
                            for to, v in zip(rows, (p.name, at, n, crc, b"".join(held) if with_ids else None), strict=True):
                                to.append(v)
                            at, crc, n, held = at + n, 0, 0, []
                    names, *numbers, ids = rows
                    cols = [pa.array(names, pa.binary()).cast(pa.string()), *(pa.array(v, pa.int64()) for v in numbers), pa.array([number] * len(names), pa.int32()), pa.array(ids, pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["id", "at", "n_tokens", "ids_crc32", "file", "ids"])

    files = spark.read.format("binaryFile").load(path).select("content")
    rows = materialize(files.mapInArrow(decode, "id string, at long, n_tokens long, ids_crc32 long, file int, ids binary"), "ids")
    # ids before each file: sums within runs of files, and of the runs before
    run = F.floor(F.col("file") / 1024)
    sums = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumn("run", run)
    before = Window.partitionBy("run").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    runs = sums.groupBy("run").agg(F.sum("n").alias("n"))  # one row for 1024 files
    runs = runs.select("run", F.coalesce(F.sum("n").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    base = sums.withColumn("inside", F.coalesce(F.sum("n").over(before), F.lit(0))).join(runs, "run").select("file", (F.col("base") + F.col("inside")).alias("base"))
    return rows.join(base, "file").select(F.col("id").cast(id_type).alias("doc_id"), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "file", "ids")
