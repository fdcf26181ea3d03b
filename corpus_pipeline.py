"""The corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination and packing of the documents.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents; n_chars follows the text.

Null, empty and wordless texts go in the first stage, as no language can be told. A null id is kept and linked with nothing;
rows with one id go together in near_dedup, whichever of their texts is a copy, and equal rows stay together. Ties between
copies go to the smallest id. An empty table gives an empty result. Other columns pass through whatever their names are,
n_lines and n_removed too. ORACLE_SQL is None: SQL cannot express the stages, so tests hold them against brute-force
versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioflux.llm.common import id_crc, materialize, own_names
from biblioflux.llm.decontaminate import mark
from biblioflux.llm.lang_id import fit, predict
from biblioflux.llm.line_dedup import dedup_lines
from biblioflux.llm.minhash import near_duplicates
from biblioflux.llm.packing import pack_documents
from biblioflux.llm.queries import tokenizer


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents in which no language can be told; learn from the labelled ones outside the held-out fifth."""
    model = fit(docs.where(id_crc("doc_id") % 5 != 0))
    told = lambda inner, text: predict(inner, model, text, "told", "share").where("told <> 'und'").select(*inner.columns)
    return own_names(docs, {"text": "text"}, [], told)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one occurrence of each fuzzy line. Documents stay with what is left of their text; those go that lost lines
    and have no word left."""

    def run(inner: DataFrame, doc_id: str, text: str, n_chars: str | None = None) -> DataFrame:
        out = dedup_lines(inner, doc_id, text).where((F.col("n_removed") == 0) | F.col(text).rlike(r"[^\x20\x09-\x0D]"))
        return out.select(*[F.length(text).cast("long").alias(c) if c == n_chars else F.col(c) for c in inner.columns])

    return own_names(docs, {c: c for c in ("doc_id", "text", "n_chars") if c in docs.columns}, [], run)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (five-word shingles, Jaccard 0.8): the one with the smallest id."""
    found = near_duplicates(docs, ngram=5, percent=80)
    gone = found.where("NOT kept").select("doc_id").distinct()
    return own_names(docs, {"doc_id": "doc_id"}, [], lambda inner, doc_id: inner.join(gone.withColumnRenamed("doc_id", doc_id), doc_id, "left_anti").select(*inner.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    clean = lambda inner, text: mark(inner, benchmark, text, out="places").where(F.size("places") == 0).select(*inner.columns)
    return own_names(docs, {"text": "text"}, [], clean)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 2048 tokens."""
    return pack_documents(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, on the documents of sf_dir; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
