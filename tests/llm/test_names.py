"""Columns with names that helper columns might have, or that need quotes, in any case of letters."""

from __future__ import annotations

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

ODD = ["__n", "__uid", "__t", "__c", "__k", "__id", "__h", "__p", "__P1", "__r", "a`b", "x.y", "N_TOKENS_", "id ", "m", "p", "col_0"]
ROWS = [(1, "alpha beta gamma delta " * 8, "en", "s"), (2, "un deux trois quatre\nalpha beta gamma delta epsilon zeta", "fr", "s"), (3, None, None, None), (1, "alpha beta gamma delta " * 8, "en", "s")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(ODD)])


def same(df, n):
    rows = df.collect()
    assert len(rows) == n and set(ODD) <= set(df.columns) and all([r[c] for c in ODD] == list(range(len(ODD))) for r in rows)
    return rows


def test_odd_names_pass_through(spark, docs):
    from biblioflux.llm.decontaminate import mark
    from biblioflux.llm.lang_id import fit, predict
    from biblioflux.llm.lattice_lm import fit as fit_lm
    from biblioflux.llm.lattice_lm import score
    from biblioflux.llm.line_dedup import dedup_lines
    from biblioflux.llm.link_graph import judge_pages
    from biblioflux.llm.outliers import judge
    from biblioflux.llm.sharding import shard_groups

    same(score(docs, fit_lm(docs, P.path("piece_bpe_32k.model"))), 4)
    same(judge(docs), 4)
    sized = docs.withColumn("size", F.length(F.coalesce("text", F.lit(""))) + 1)
    out = same(shard_groups(sized, ["text", "a`b"], "size", 2), 4)
    assert len({r.shard for r in out if r.doc_id == 1}) == 1
    assert {r.lang_pred for r in same(predict(docs, fit(docs)), 4)} >= {"und"}
    same(dedup_lines(docs), 4)
    same(mark(docs, spark.createDataFrame([(1, "alpha beta gamma delta alpha beta")], "item_id long, text string")), 4)
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a.net/x").alias("url"), F.lit("<a>").alias("html"), *[F.col("`" + c.replace("`", "``") + "`") for c in ODD])
    assert {r.verdict for r in same(judge_pages(pages, [("net/", "block")]), 4)} == {"block"}


def test_inputs_under_odd_names_and_replaced_columns(spark, docs):
    from biblioflux.llm.lang_id import fit, predict
    from biblioflux.llm.line_dedup import dedup_lines
    from biblioflux.llm.outliers import judge

    odd = docs.select(F.col("doc_id").alias("the id"), F.col("text").alias("te`xt"), F.col("lang").alias("l"), F.col("source").alias("s"), F.lit(7).alias("KEPT"), F.lit(8).alias("Score"))
    out = judge(odd, "te`xt", "l", "s")
    assert [c for c in out.columns if c.lower() == "kept"] == ["kept"] and out.count() == 4
    out = predict(odd, fit(docs), "te`xt")
    assert [c for c in out.columns if c.lower() == "score"] == ["score"] and out.columns[:2] == ["the id", "te`xt"]
    assert dedup_lines(odd, "the id", "te`xt").columns == ["the id", "te`xt", "l", "s", "KEPT", "Score", "n_lines", "n_removed"]
