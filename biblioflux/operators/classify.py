"""Assignment of documents to fields by similarity to prototypes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, ngrams
from ..scratch import forget, written
from . import grams


@dataclass(frozen=True)
class Thresholds:
    """Scores and margins under which an assignment is uncertain (high risk) or worth a look (medium risk)."""

    high_score: float = 0.015
    high_margin: float = 0.002
    medium_score: float = 0.020
    medium_margin: float = 0.003


def top_vocabulary(docs: DataFrame, tokens: Column, k: int, cells: int = 1 << 22, sizes: Sequence[int] = (1,)) -> DataFrame:
    """(term, cf, cell): the k most frequent n-grams of all documents for the n of sizes together, ties by term; exact.

    Occurrences are counted first by a hash of the n-gram, in at most `cells` cells, which bound every n-gram in them from
    above. Only n-grams in cells that reach a bound are then counted themselves. If the k-th of those reaches the bound
    too, no other can; if not, it is the next bound, and that one suffices.
    """
    n = grams.sketch(docs, tokens, sizes, cells)
    held = n[n > 0]
    bound = int(np.partition(held, -2 * k)[-2 * k]) if len(held) > 2 * k else 1
    while True:
        counted = grams.counts_in_cells(docs, tokens, sizes, n >= max(bound, 1))
        found = written(counted.orderBy(F.desc("cf"), "term").limit(k), "vocabulary")
        size, least = found.agg(F.count("*"), F.min("cf")).first()
        if bound <= 1 or (size == k and least >= bound):
            return found
        forget(found)
        bound = least if size == k else 1


def vocabulary_counts(docs: DataFrame, doc: str, tokens: Column, max_features: int, counts: DataFrame | None = None, sizes: Sequence[int] = (1,)) -> DataFrame:
    """(doc, term, tf) of the max_features most frequent n-grams of the tokens only, written: other terms never move. counts
    (term, freq) of all tokens are taken if given."""
    if counts is None and max_features <= 100_000:  # a task holds so many terms at most
        cells = 1 << 22
        return written(grams.vocabulary_frequencies(docs, doc, tokens, sizes, top_vocabulary(docs, tokens, max_features, cells, sizes), cells), "tf")
    top = top_vocabulary(docs, tokens, max_features, sizes=sizes) if counts is None else written(counts.orderBy(F.desc("freq"), "term").limit(max_features), "vocabulary")
    terms = top.select("term")
    terms = F.broadcast(terms) if max_features <= 100_000 else terms
    each = F.concat(*[tokens if n == 1 else ngrams(tokens, n) for n in sizes])
    return written(docs.select(doc, F.explode(each).alias("term")).join(terms, "term").groupBy(doc, "term").agg(F.count("*").alias("tf")), "tf")


def inverse_frequency(tf: DataFrame, n_docs: int) -> DataFrame:
    """(term, idf): ln((1 + n) / (1 + df)) + 1; tf is unique by document and term."""
    return tf.groupBy("term").agg(F.count("*").alias("df")).select("term", (F.ln(F.lit(1.0 + n_docs) / (1 + F.col("df"))) + 1).alias("idf"))


def weighted(tf: DataFrame, doc: str, idf: DataFrame) -> DataFrame:
    """(doc, term, weight): (1 + ln tf) idf, rows of unit length; terms without idf are left out."""
    raw = tf.join(idf, "term").select(doc, "term", ((1 + F.ln("tf")) * F.col("idf")).alias("w"))
    # a document's row holds no more than its distinct terms
    rows = raw.groupBy(doc).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.struct("term", "w")).alias("all"))
    return rows.select(doc, "norm", F.inline("all")).select(doc, "term", (F.col("w") / F.col("norm")).alias("weight"))


def tfidf(tf: DataFrame, doc: str, n_docs: int) -> DataFrame:
    """(doc, term, weight) over all terms of tf; vocabulary_counts() gives those of a bounded vocabulary."""
    return weighted(tf, doc, inverse_frequency(tf, n_docs))


def prototype_vectors(tf: DataFrame, doc: str, idf: DataFrame, prototype_ids: DataFrame) -> DataFrame:
    """(term, idx, v): unit vectors of the seed texts in tf; prototype_ids maps their ids to idx."""
    own = weighted(tf.join(prototype_ids.select(doc), doc, "left_semi"), doc, idf)
    return own.join(prototype_ids, doc).select("term", "idx", F.col("weight").alias("v"))


def prototype_scores(tf: DataFrame, doc: str, idf: DataFrame, docs: DataFrame, fields: DataFrame, prototypes: DataFrame) -> DataFrame:
    """(doc, idx, field, score) for every document and field: dot products of unit vectors, 0 where no term is shared.

    The few vectors of prototypes (term, idx, v) meet the terms as one row for each term, so a document's length and its
    product with every field are sums over one pass; no document's vector is put together.
    """
    labels = fields.select("idx", "field").collect()  # a handful of labels
    own = sorted({r["idx"] for r in labels})
    v = prototypes.groupBy("term").agg(*[F.sum(F.when(F.col("idx") == i, F.col("v"))).alias(f"v{i}") for i in own])
    rows = tf.join(idf, "term").withColumn("w", (1 + F.ln("tf")) * F.col("idf")).join(v, "term", "left")
    sums = rows.groupBy(doc).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), *[F.sum(F.col("w") * F.col(f"v{i}")).alias(f"v{i}") for i in own])
    each = [F.struct(F.lit(r["idx"]).alias("idx"), F.lit(r["field"]).alias("field"), F.coalesce(F.col(f"v{r['idx']}") / F.col("norm"), F.lit(0.0)).alias("score")) for r in labels]
    return docs.select(doc).join(sums, doc, "left").select(doc, F.inline(F.array(*each)))


def best_field(scores: DataFrame, doc: str, digits: int = 9) -> DataFrame:
    """(doc, raw_field, score, margin): the first field with the best score and how far ahead of the next it is. Scores
    are rounded before they are compared, so engines agree on ties."""
    s = F.round("score", digits) + 0.0
    ranked = scores.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct((-s).alias("neg"), F.col("idx"), F.col("field")))).alias("r"))
    first, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    return ranked.select(doc, first["field"].alias("raw_field"), (-first["neg"] + 0.0).alias("score"), (second["neg"] - first["neg"] + 0.0).alias("margin"))


def assign(best: DataFrame, methods: str, t: Thresholds = Thresholds()) -> DataFrame:
    """Final labels: an uncertain row of another field goes to the methods field.

    Adds field, basis, is_ambiguous, needs_review (always false), priority (Medium or Low) and is_high_confidence. Rows
    that are uncertain but in the methods field already are not ambiguous.
    """
    score, margin = F.col("score"), F.col("margin")
    high = (score < t.high_score) | (margin < t.high_margin)
    medium = ~high & ((score < t.medium_score) | (margin < t.medium_margin))
    ambiguous = high & (F.col("raw_field") != methods)
    return best.select(
        "*",
        F.when(ambiguous, F.lit(methods)).otherwise(F.col("raw_field")).alias("field"),
        F.when(ambiguous, "insufficient evidence").when(F.col("raw_field") == methods, "methods content").otherwise("clear evidence").alias("basis"),
        ambiguous.alias("is_ambiguous"),
        F.lit(False).alias("needs_review"),
        F.when(ambiguous | medium, "Medium").otherwise("Low").alias("priority"),
        high_confidence(t).alias("is_high_confidence"),
    )


def high_confidence(t: Thresholds = Thresholds()) -> Column:
    return (F.col("score") >= t.medium_score) & (F.col("margin") >= t.medium_margin)


def review_flag(best: DataFrame, score: float = 0.03, margin: float = 0.005) -> DataFrame:
    """The older rule: one flag, no relabelling."""
    return best.withColumn("needs_review", (F.col("score") < score) | (F.col("margin") < margin))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    """The vector at unit length; a zero vector stays."""
    return let(F.sqrt(dot(v, v)), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))))


def embedding_scores(docs: DataFrame, doc: str, vector: str, prototypes: DataFrame) -> DataFrame:
    """(doc, idx, field, score): cosine of every document with every prototype (idx, field, vector)."""
    p = prototypes.select("idx", "field", unit(F.col("vector")).alias("__p"))
    d = docs.select(doc, unit(F.col(vector)).alias("__d"))
    return d.crossJoin(p).select(doc, "idx", "field", dot(F.col("__d"), F.col("__p")).alias("score"))  # prototypes are a handful


def floor_field(best: DataFrame, methods: str, floor: float = 0.35) -> DataFrame:
    return best.withColumn("field", F.when(F.col("score") < floor, F.lit(methods)).otherwise(F.col("raw_field")))


def mean_vectors(df: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, vector): the mean vector of each group, summed by place."""
    cells = df.select(by, F.posexplode(vector).alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return cells.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vector"))


def pool_chunks(chunks: DataFrame, doc: str, vector: str) -> DataFrame:
    """(doc, vector): the largest value of each place over a document's chunks, at unit length. A document's vectors meet as
    they are: a row for each place would take many times their memory."""
    larger = lambda a, v: F.zip_with(a, v, lambda x, y: F.greatest(x, y.cast("double")))
    pooled = chunks.where(F.size(vector) > 0).groupBy(doc).agg(F.collect_list(vector).alias("all"))
    return pooled.select(doc, let(F.aggregate("all", F.array().cast("array<double>"), larger), unit).alias("vector"))
