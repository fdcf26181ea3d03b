"""Document likelihood over the subword lattice of a unigram vocabulary.

The pieces of an existing vocabulary file are the events of a unigram model; their scores there are the starting
weights, and expected counts over the distinct training words refine them. A word's probability is the sum over all its
segmentations, taken by a forward recursion in log space; a word of the training corpus is one more edge, from its
begin to its end. The weight of that edge and of the spelled-out paths is Good and Turing's: what is spelled out has the
share of words seen once. Beside it stands a word-unigram baseline with add-one counts.

Corpus counts are a table of words that grows with the corpus and stays distributed. Only the piece weights (as many as
the vocabulary) and the counts of at most HOT_WORDS frequent words are broadcast; all other words of a document meet
their counts in a join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, own_names

HOT_WORDS = 250_000
EM_ROUNDS = 2
MARK = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CELLS = 60_000
_LN10 = math.log(10)


@dataclass
class PieceTable:
    """Pieces by the hash of their characters; log weights of pieces and of the 256 fallback bytes."""

    keys: np.ndarray
    order: np.ndarray
    longest: int
    single: np.ndarray
    logp: np.ndarray
    byte_logp: np.ndarray

    @staticmethod
    def load(path: str) -> PieceTable:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        pieces = [(p.piece, p.score) for p in model.pieces if p.type == 1]
        hashes = np.array([_hash(np.array([ord(c) for c in p], np.uint64))[-1] for p, _ in pieces], np.uint64)
        order = np.argsort(hashes)
        # scores that are ranks stand for weights that fall as 1 / rank
        logp = -np.log(2 - np.array([s for _, s in pieces]))
        logp -= np.log(np.exp(logp).sum())
        single = np.sort(np.array([ord(p) for p, _ in pieces if len(p) == 1], np.int64))
        return PieceTable(hashes[order], order, max(len(p) for p, _ in pieces), single, logp, np.full(256, math.log(1e-6)))


def _hash(codes: np.ndarray) -> np.ndarray:
    """Prefix hashes along the last axis, from the empty prefix on."""
    out = np.zeros((*codes.shape[:-1], codes.shape[-1] + 1), np.uint64)
    for k in range(codes.shape[-1]):
        out[..., k + 1] = out[..., k] * _BASE + codes[..., k] + np.uint64(1)
    return out


def _lattice(t: PieceTable, words: list[bytes], weights: np.ndarray | None = None):
    """Log probabilities of words (each opened by a space mark); with weights also the expected counts of pieces and of
    fallback bytes."""
    out = np.zeros(len(words))
    expected, expected_bytes = (np.zeros(len(t.logp)), np.zeros(256)) if weights is not None else (None, None)
    text = [MARK + w.decode("utf-8", "surrogatepass") for w in words]
    lengths = np.array([len(x) for x in text])
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        n = lengths[order[at]]
        end = min(int(np.searchsorted(lengths[order], n, side="right")), at + max(1, _CELLS // int(n)))
        rows = order[at:end]
        codes = np.frombuffer("".join(text[i] for i in rows).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(rows), n)
        out[rows] = _same_length(t, codes, None if weights is None else weights[rows], expected, expected_bytes)
        at = end
    return out if weights is None else (out, expected, expected_bytes)


def _same_length(t: PieceTable, codes: np.ndarray, weights, expected, expected_bytes) -> np.ndarray:
    rows, n = codes.shape
    h = _hash(codes.astype(np.uint64))
    longest = min(t.longest, n)
    piece = np.full((n + 1, rows, longest + 1), -1, np.int64)  # by end and length
    score = np.full((n + 1, rows, longest + 1), -np.inf)
    power = np.ones(1, np.uint64)
    for size in range(1, longest + 1):
        power = power * _BASE
        key = h[:, size:] - h[:, : n + 1 - size] * power
        k = np.minimum(np.searchsorted(t.keys, key), len(t.keys) - 1)
        hit = t.keys[k] == key
        ids = t.order[k]
        piece[size:, :, size] = np.where(hit, ids, -1).T
        score[size:, :, size] = np.where(hit, t.logp[ids], -np.inf).T
    lone_r, lone_c = np.nonzero(piece[1:, :, 1].T < 0)
    for r, c in zip(lone_r.tolist(), lone_c.tolist(), strict=True):  # letters outside the vocabulary: their bytes
        raw = chr(codes[r, c]).encode("utf-8", "surrogatepass")
        score[c + 1, r, 1] = t.byte_logp[list(raw)].sum()
    alpha = np.full((n + 1, rows), -np.inf)
    alpha[0] = 0
    for j in range(1, n + 1):
        m = min(j, longest)
        x = score[j, :, 1 : m + 1] + alpha[j - m : j][::-1].T
        top = x.max(axis=1)
        alpha[j] = top + np.log(np.exp(x - top[:, None]).sum(axis=1))
    total = alpha[n]
    if weights is not None:
        beta = np.full((n + 1, rows), -np.inf)
        beta[n] = 0
        for j in range(n, 0, -1):
            m = min(j, longest)
            x = score[j, :, 1 : m + 1] + beta[j][:, None]
            part = np.exp(x + alpha[j - m : j][::-1].T - total[:, None]) * weights[:, None]
            ids = piece[j, :, 1 : m + 1]
            ok = ids >= 0
            expected += np.bincount(ids[ok], part[ok], len(expected))
            for r in np.flatnonzero(~ok[:, 0]):
                for b in chr(codes[r, j - 1]).encode("utf-8", "surrogatepass"):
                    expected_bytes[b] += part[r, 0]
            beta[j - m : j] = np.logaddexp(beta[j - m : j], x.T[::-1])
    return total


def word_counts(docs: DataFrame, text: str, flush: int = 400_000) -> DataFrame:
    """(word, n) over all texts; each task sums up to `flush` distinct words before it passes them on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()

        def rows():
            words, n = list(c), list(c.values())
            c.clear()
            for k in range(0, len(words), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[k : k + 100_000], pa.binary()), pa.array(n[k : k + 100_000], pa.int64())], names=["word", "n"])

        for batch in batches:
            for t in batch.column(0):
                c.update((t.as_py() or "").encode("utf-8", "surrogatepass").lower().split())
                if len(c) > flush:
                    yield from rows()
        yield from rows()

    return docs.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class CorpusModel:
    """Training words as a table (word, n, spelled: log probability over the lattice); totals; the piece weights."""

    lexicon: DataFrame
    train_tokens: int
    distinct: int
    train_docs: int
    once: int
    pieces: PieceTable

    @property
    def words(self) -> int:
        return self.train_tokens - self.train_docs

    @property
    def end_share(self) -> float:
        return (self.train_docs + 1) / (self.train_tokens + 2)

    @property
    def spelled_share(self) -> float:
        """The share of words that is spelled out: that of words seen once."""
        return (self.once + 1) / (self.words + 1)

    @property
    def whole_weight(self) -> float:
        """What one occurrence in training adds to a word's probability."""
        return (1 - self.spelled_share) * (1 - self.end_share) / max(1, self.words)

    @property
    def spelled_weight(self) -> float:
        return self.spelled_share * (1 - self.end_share)


def fit(docs: DataFrame, vocabulary_path: str, text: str = "text", rounds: int = EM_ROUNDS) -> CorpusModel:
    """Count the words of all whole texts (A-Z lower-cased, cut at white space) and weigh the vocabulary's pieces by
    expected counts over the distinct ones, as new words resemble rare ones. A null text counts as empty; an empty table gives a model without words, whose weights
    are the vocabulary's own."""
    spark = docs.sparkSession
    train_docs = docs.count()
    counts = materialize(word_counts(docs, text), "words")
    words, total, once = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") == 1)).first()
    table = PieceTable.load(vocabulary_path)
    for _ in range(rounds if words else 0):
        shared = spark.sparkContext.broadcast(table)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            t = shared.value
            e, b = np.zeros(len(t.logp)), np.zeros(256)
            for batch in batches:
                for k in range(0, batch.num_rows, 20_000):
                    part = batch.slice(k, 20_000).column(0).to_pylist()
                    _, x, y = _lattice(t, part, np.ones(len(part)))
                    e, b = e + x, b + y
            e = np.concatenate((e, b))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(e))), pa.array(e)], names=["piece", "e"])

        # summed in whole billionths, so the result does not hang on the order of tasks
        got = counts.mapInArrow(expect, "piece long, e double").where("e > 0")
        got = got.groupBy("piece").agg(F.sum((F.col("e") * 1e6).cast("decimal(38,0)")).cast("double").alias("e")).toPandas()
        e = np.full(len(table.logp) + 256, 0.1)
        e[got["piece"].to_numpy()] += got["e"].to_numpy() / 1e6
        logp = np.log(e) - math.log(e.sum())
        table = PieceTable(table.keys, table.order, table.longest, table.single, logp[:-256], logp[-256:])
        shared.unpersist()
    shared = spark.sparkContext.broadcast(table)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 20_000):
                part = batch.slice(k, 20_000)
                lp = _lattice(shared.value, part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lp)], names=["word", "n", "spelled"])

    lexicon = materialize(counts.mapInArrow(spell, "word binary, n long, spelled double"), "lexicon")
    return CorpusModel(lexicon, total + train_docs, words + (train_docs > 0), train_docs, once, table)


def _hot(model: CorpusModel, limit: int) -> dict[bytes, tuple[float, float]]:
    """For the most frequent words, at most `limit` of them, log10 of their count plus one and of their probability.
    They are those over the lowest step of a logarithmic histogram (a few hundred rows) that keeps within the limit."""
    counts = model.lexicon
    step = F.floor(F.log2("n") * 8)
    seen, low = 0, None
    for r in counts.groupBy(step.alias("k")).count().orderBy(F.desc("k")).collect():
        seen += r["count"]
        if seen > limit:
            break
        low = r["k"]
    if low is None:
        return {}
    top = counts.where(step >= low).toPandas()
    n = top["n"].to_numpy(float)
    p = np.log10(n * model.whole_weight + model.spelled_weight * np.exp(top["spelled"].to_numpy()))
    return dict(zip(map(bytes, top["word"]), zip(np.log10(n + 1).tolist(), p.tolist(), strict=True), strict=True))


def _some_texts(whole: pa.RecordBatch, rows: int = 1000, size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most `rows` rows, and of about `size` bytes of text or one row."""
    held = np.cumsum(pc.fill_null(pc.binary_length(whole.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < whole.num_rows:
        stop = int(np.searchsorted(held, (held[at - 1] if at else 0) + size, "right"))
        stop = max(at + 1, min(stop, at + rows))
        yield whole.slice(at, stop - at)
        at = stop


def score(docs: DataFrame, model: CorpusModel, text: str = "text", hot_words: int = HOT_WORDS) -> DataFrame:
    """docs without the text, with n_tokens, n_known, train_tokens, base_score and score (log10) of each whole text.

    Tokens are the words and one end. n_known counts those that occur in training. A null or empty text is the end
    alone. Letters outside the vocabulary are spelled in fallback bytes, so every text has a finite score.
    Repeated rows are scored apart; columns of these names that are there already are replaced, others stay. An empty
    table gives no rows.
    """
    mine = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return own_names(docs, {"text": text}, mine, lambda inner, text: _score(inner, model, text, hot_words))


def _score(docs: DataFrame, model: CorpusModel, text: str, hot_words: int) -> DataFrame:
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c != text]
    shared = spark.sparkContext.broadcast((_hot(model, hot_words), math.log10(model.end_share)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hot, end = shared.value
        uid = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in _some_texts(whole):
                cut = [(x or "").encode("utf-8", "surrogatepass").lower().split() for x in batch.column(0).to_pylist()]
                n_tokens, n_known, base, logp, words_out, tf_out = [], [], [], [], [], []
                for words in cut:
                    tf = Counter(words)
                    seen, b, p, rest, rest_tf = 0, 0.0, end, [], []
                    for w, c in tf.items():
                        got = hot.get(w)
                        if got is None:
                            rest.append(w)
                            rest_tf.append(c)
                        else:
                            seen += c
                            b += c * got[0]
                            p += c * got[1]
                    for to, v in zip((n_tokens, n_known, base, logp, words_out, tf_out), (len(words) + 1, seen, b, p, rest, rest_tf), strict=True):
                        to.append(v)
                ids = pa.array(range(uid, uid + len(cut)), pa.int64())
                uid += len(cut)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k) for k in range(1, batch.num_columns)), ids, pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(logp, pa.float64()), pa.array(words_out, pa.list_(pa.binary())), pa.array(tf_out, pa.list_(pa.int32()))],
                    names=[*kept, "__uid", "__n", "__known", "__base", "__score", "__words", "__tf"],
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    schema = f"{schema}, " * bool(schema) + "__uid long, __n long, __known long, __base double, __score double, __words array<binary>, __tf array<int>"
    part = materialize(docs.select(text, *kept).mapInArrow(run, schema), "scored")
    rest = part.select("__uid", F.explode(F.arrays_zip("__words", "__tf")).alias("x"))
    rest = rest.select("__uid", F.col("x.__words").alias("word"), F.col("x.__tf").alias("tf"))
    # words that training lacks are spelled out here; a null stands for each of the others
    pieces = spark.sparkContext.broadcast(model.pieces)

    @F.pandas_udf("double")
    def spell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for words in batches:
            new = words.dropna()
            kinds = list({bytes(w) for w in new})
            found = dict(zip(kinds, _lattice(pieces.value, kinds).tolist(), strict=True)) if kinds else {}
            out = pd.Series(np.nan, index=words.index)
            out[new.index] = [found[bytes(w)] for w in new]
            yield out

    rest = rest.join(model.lexicon, "word", "left")
    new = F.col("n").isNull()
    rest = rest.withColumn("__new", spell(F.when(new, F.col("word"))))
    p = F.log10(F.coalesce("n", F.lit(0)) * model.whole_weight + F.exp(F.coalesce("spelled", F.lit(0.0))) * model.spelled_weight)
    spelled = F.col("__new") / _LN10 + math.log10(model.spelled_weight)
    known = F.when(new, 0).otherwise(F.col("tf"))
    rest = rest.groupBy("__uid").agg(F.sum(known).alias("__k"), F.sum(known * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("__b"), F.sum(F.col("tf") * F.when(new, spelled).otherwise(p)).alias("__m"))
    out = part.drop("__words", "__tf").join(rest, "__uid", "left")

    def log10(x: float) -> Column:
        return F.lit(math.log10(x))

    end = model.train_docs
    return out.select(
        *kept,
        F.col("__n").alias("n_tokens"),
        (F.col("__known") + F.coalesce("__k", F.lit(0)) + int(end > 0)).cast("long").alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("__base") + F.coalesce("__b", F.lit(0.0)) + log10(end + 1) - F.col("__n") * log10(model.train_tokens + model.distinct + 1)).alias("base_score"),
        (F.col("__score") + F.coalesce("__m", F.lit(0.0))).alias("score"),
    )
