"""Classification of a stream of documents by a model that was frozen before: vocabulary, weights and prototypes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import classify as cl
from ..scratch import written


@dataclass(frozen=True)
class Frozen:
    """idf: (term, idf); prototypes: (term, idx, v), unit vectors; fields: (idx, field)."""

    idf: DataFrame
    prototypes: DataFrame
    fields: DataFrame


def freeze(docs: DataFrame, doc: str, tokens: Column, seeds: DataFrame, max_features: int = 30_000, sizes: Sequence[int] = (1,)) -> Frozen:
    """The model of documents that hold the seed texts too; seeds has (doc, idx, field). Terms are the
    n-grams of the tokens for the n of sizes. All of it is written."""
    tf = cl.vocabulary_counts(docs, doc, tokens, max_features, sizes=sizes)
    idf = written(cl.inverse_frequency(tf, docs.count()), "idf")
    prototypes = written(cl.prototype_vectors(tf, doc, idf, seeds.select(doc, "idx")), "prototypes")
    return Frozen(idf, prototypes, seeds.select("idx", "field"))


def classify(docs: DataFrame, doc: str, tokens: Column, model: Frozen) -> DataFrame:
    """(doc, idx, field, score) of new documents; terms that the model lacks are left out."""
    known = docs.select(doc, F.explode(tokens).alias("term")).join(model.idf.select("term"), "term", "left_semi")
    tf = known.groupBy(doc, "term").agg(F.count("*").alias("tf"))
    return cl.prototype_scores(tf, doc, model.idf, docs, model.fields, model.prototypes)


def classify_stream(stream: DataFrame, doc: str, tokens: Column, model: Frozen, methods: str, path: str, checkpoint: str) -> DataFrame:
    """Labels of all documents that the stream's source has now, appended batch by batch to files below `path`; a later
    run goes on where this one ended. A batch that is run again replaces its own files. Both folders must be shared."""

    def batch(rows: DataFrame, number: int) -> None:
        labels = cl.assign(cl.best_field(classify(rows, doc, tokens, model), doc), methods)
        labels.write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(path).drop("batch")
