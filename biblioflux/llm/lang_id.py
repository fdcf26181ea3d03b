"""Language identification by words first, backing off to shorter and shorter character n-grams.

A known word adds its log frequency in each language. An unseen word is scored by the longest length at which any of its
character n-grams is known, then by shorter ones, down to single letters.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import own_names

_WORD = re.compile(r"[^\W\d_]+")
MAX_GRAM = 5


@dataclass
class LanguageModel:
    """langs in order; words and grams give rows of `table`, each the log share of every language."""

    langs: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    table: np.ndarray
    prior: np.ndarray


def _share(counts: dict[str, np.ndarray], smooth: float) -> np.ndarray:
    c = np.array(list(counts.values()), np.float64) + smooth
    p = np.log(c) - np.log(c.sum(axis=0))
    return (p - np.log(np.exp(p - p.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) - p.max(axis=1, keepdims=True)).astype(np.float32)


def word_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, word, n) of lower-cased words, summed for each batch before anything moves."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, Counter] = defaultdict(Counter)
            for code, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by[code].update(_WORD.findall((t or "").lower()))
            for code, c in by.items():
                yield pa.RecordBatch.from_arrays([pa.array([code] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])

    parts = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(count, "lang string, word string, n long")
    return parts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", docs_per_lang: int = 1500, words_kept: int = 120_000, max_langs: int = 500) -> LanguageModel:
    """Learn from labelled rows; rows with a null label are left out.

    Bounds: about `docs_per_lang` rows of each language, picked by a hash of the key (all rows where there are fewer);
    `words_kept` of their words in all, an equal number for each language, the most frequent first; the `max_langs`
    most frequent labels. No rows give a model without languages.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()
    if not sizes:
        return LanguageModel([], {}, {}, np.zeros((0, 0), np.float32), np.zeros(0))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, docs_per_lang / r["count"]))])
    picked = known.where(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0)) * (1 << 20))
    langs = sorted(r["lang"] for r in sizes)
    each = max(100, words_kept // len(langs))
    counts = word_counts(picked, "text", "lang")
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("r") <= each)
    found = top.select("lang", "word", "n").toPandas()
    at = {x: i for i, x in enumerate(langs)}
    words: dict[str, np.ndarray] = {}
    grams: dict[str, np.ndarray] = {}
    for code, word, n in zip(found["lang"], found["word"], found["n"], strict=True):
        i = at[code]
        if word not in words:
            words[word] = np.zeros(len(langs))
        words[word][i] += n
        edged = f"_{word}_"
        for size in range(1, MAX_GRAM + 1):
            for k in range(len(edged) - size + 1):
                g = edged[k : k + size]
                if g not in grams:
                    grams[g] = np.zeros(len(langs))
                grams[g][i] += n
    grams.pop("_", None)
    rows = [_share(x, 0.5) for x in (words, grams) if x]
    table = np.concatenate(rows) if rows else np.zeros((0, len(langs)), np.float32)
    prior = np.array([next(r["count"] for r in sizes if r["lang"] == x) for x in langs], np.float64)
    return LanguageModel(langs, {w: i for i, w in enumerate(words)}, {g: len(words) + i for i, g in enumerate(grams)}, table, np.log(prior / prior.sum()))


class Scorer:
    """Scores texts; keeps the rows of at most `cache_words` unseen words."""

    def __init__(self, model: LanguageModel, cache_words: int = 300_000):
        self.m = model
        self.at = dict(model.words)
        self.rows = model.table
        self.limit = len(self.at) + cache_words

    def _backoff(self, word: str) -> np.ndarray:
        edged, grams = f"_{word}_", self.m.grams
        for size in range(min(MAX_GRAM, len(edged)), 0, -1):
            hit = [i for k in range(len(edged) - size + 1) if (i := grams.get(edged[k : k + size])) is not None]
            if hit:
                return self.m.table[hit].mean(axis=0)
        return np.full(len(self.m.langs), -math.log(len(self.m.langs)), np.float32)

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        labels, scores, at = [], [], 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end] or "") < 4_000_000):
                chars += len(texts[end] or "")
                end += 1
            a, b = self._slice(texts[at:end])
            labels += a
            scores += b
            at = end
        return labels, scores

    def _slice(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        n = len(self.m.langs)
        if not n:
            return ["und"] * len(texts), [0.0] * len(texts)
        cut = [_WORD.findall(t.lower()) if t else [] for t in texts]
        missing = list({w for words in cut for w in words if w not in self.at})
        at, rows = self.at, self.rows
        if missing:
            rows = np.concatenate((rows, np.array([self._backoff(w) for w in missing], np.float32)))
            new = {w: len(self.rows) + i for i, w in enumerate(missing)}
            if len(at) + len(new) <= self.limit:
                at.update(new)
                self.rows = rows
            else:
                at = _Both(at, new)
        labels, scores = [], []
        for t, words in zip(texts, cut, strict=True):
            if not t or not any(map(str.isalpha, t)):
                labels.append("und")
                scores.append(0.0)
                continue
            total = self.m.prior + (rows[np.fromiter(map(at.__getitem__, words), np.int64, len(words))].sum(axis=0, dtype=np.float64) if words else 0)
            p = np.exp(total - total.max())
            k = int(p.argmax())
            labels.append(self.m.langs[k])
            scores.append(float(p[k] / p.sum()))
        return labels, scores


class _Both(dict):
    def __init__(self, kept: dict, own: dict):
        super().__init__(own)
        self.kept = kept

    def __missing__(self, key):
        return self.kept[key]


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language of each whole text and its posterior share (0 to 1).

    `und` with score 0 where the text is null, empty or has no letter, or the model knows no language. Ties go to the
    first language in alphabetical order. Columns of these names that are there already are replaced; the others stay, and repeated rows
    are scored apart. The model's size is bounded by fit(), so it is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("label string, score double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        s = Scorer(shared.value)
        for x in batches:
            labels, scores = s.score([t if isinstance(t, str) else None for t in x.tolist()])
            yield pd.DataFrame({"label": labels, "score": scores})

    def run(inner: DataFrame, text: str) -> DataFrame:
        return inner.withColumn("p", scored(F.col(text))).select(*inner.columns, F.col("p.label").alias(label), F.col("p.score").alias(score))

    return own_names(docs, {"text": text}, [label, score], run)
