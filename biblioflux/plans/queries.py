"""The query catalogue: each query takes (spark, sf_dir) and runs an operator over whole tables.

The test tables stand in for articles: documents (first line as title, the rest as abstract, lang as group, a year from
the id) and orders (year by priority as panel, o_orderkey as id).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import segment
from ..functions import text as tx
from ..functions.register import register_lexicon, register_segmenter
from ..functions.rand import uniform
from ..operators import chargrams, chunks, clean, concentration, grams, inference, lemmas, likelihood, multiple, panel, phrases, resample, scans, study, terms
from ..operators import classify as cl
from ..scratch import new_folder, written
from ..schemas import backfill, domain, outside_domain, require_columns
from ..sources.readers import parse_blocks
from ..streaming.classify import classify_stream, freeze
from ..streaming.terms import counts_to_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

STOPWORDS = ["the", "of", "and", "to", "in", "for", "with", "that", "by", "on", "de", "la", "que", "el", "le", "les", "der", "die", "und"]
PHRASES = ["of the", "in the", "the and", "and the", "de la", "to be", "that the", "and in the"]
STRONG, WEAK, MARKERS = ["thation", "eringth"], ["the", "ing", "tion", "ent", "wh"], ["$$$", "%%%", "|"]
#: Seed texts of the stand-in fields; the last is the methods field.
SEEDS = [("English", "the and of that with for this was"), ("French", "les des que pour par sur une dans"), ("German", "der die und ein ist das mit von"), ("Spanish", "los las que del para por con una"), ("Methods", "table figure data model test sample")]
SPLIT = 1998
#: A small dictionary for the segmenter, and words that name labels.
SEGMENTS = ["the", "there", "in", "ing", "tion", "ent", "entation", "er", "and", "on"]
LABEL_WORDS = ["thation", "eringth"]
#: Order priorities in their order, the last left out.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.spread(t(spark, sf_dir, "documents"))


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(f.name).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema])


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = texts(spark, sf_dir)
    at = F.locate("\n", F.col("text"))
    return d.select(
        "doc_id", "lang", "source", "text",
        F.substring_index("text", "\n", 1).alias("Title"),
        F.when(at > 0, F.substring(F.col("text"), at + 1, F.length("text"))).otherwise("").alias("Abstract"),
        (F.col("doc_id") % 8 + 2018).cast("string").alias("Year"),
        F.when(F.col("doc_id") % 7 == 0, F.lit("n/a")).otherwise(F.col("n_chars").cast("string")).alias("Citations"),
    )


def order_panel(spark: SparkSession, sf_dir: str, by: list[str] = ()) -> DataFrame:
    o = t(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("field"), (F.col("o_custkey") % 2).alias("grp"))
    return panel.panel(o, "year", "field", list(by))


def orders_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("field"))


def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", "lang", tx.english_tokens(F.col("text")).alias("tokens"))


def content_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_tokens(spark, sf_dir).withColumn("tokens", tx.without(F.col("tokens"), STOPWORDS))


def doc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n_docs"))


# cleaning -------------------------------------------------------------------------------------------------------------


@query
def clean_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clean.clean_articles(articles(spark, sf_dir), ["Title", "Abstract"])
    return out.select("doc_id", F.col("Title").alias("title"), F.md5("Abstract").alias("abstract_md5"), F.col("Year").alias("year"), r6("Citations").alias("citations"))


@query
def reject_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = articles(spark, sf_dir).select(F.col("Title").alias("TI"), F.col("Abstract").alias("AB"), F.col("Year").alias("PY"), F.col("source").alias("AU"), F.col("Citations").alias("TC"))
    out = clean.clean_tab_articles(raw)
    return out.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), F.sum("Citations").alias("citations"))


@query
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents").select("text", "lang", "source")
    return clean.drop_exact_duplicates(d, ["text", "lang", "source"]).select(F.md5("text").alias("text_md5"), "lang", "source")


@query
def dup_key_diagnostic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.repeated_keys(articles(spark, sf_dir), ["lang", "Title"]).select("doc_id", F.col("copies"))


@query
def relevance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents")
    return clean.filter_relevant(d, F.lower("text"), F.col("lang") == "en", STRONG, WEAK, MARKERS).select("doc_id", "lang")


@query
def kv_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = t(spark, sf_dir, "nation")
    text = F.concat(F.lit("Name: "), "n_name", F.lit("\r\nno key here\nRegion："), F.col("n_regionkey").cast("string"), F.lit("\nName: "), F.lower("n_name"), F.lit("\n\nName: second: "), F.col("n_name"), F.lit("\n"))
    b = parse_blocks(n.select(text.alias("value")))
    return b.select("block", F.try_element_at("fields", F.lit("Name")).alias("name"), F.try_element_at("fields", F.lit("Region")).alias("region"))


@query
def keyword_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select("doc_id", F.explode(tx.keyword_phrases(F.col("Title"), STOPWORDS)).alias("phrase"))


@query
def keyword_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    dtm = terms.document_terms(articles(spark, sf_dir), "doc_id", tx.keyword_phrases(F.col("Title"), STOPWORDS))
    kept = terms.presence(terms.frequency_bounds(dtm, 0, 3, float("inf")))
    return kept.select("doc_id", "term", "tf")


@query
def label_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clean.remap(t(spark, sf_dir, "documents"), "lang", {"en": "English", "fr": "French", "de": "German"})
    return out.groupBy("lang").agg(F.count("*").alias("n"))


# terms ----------------------------------------------------------------------------------------------------------------


@query
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.term_counts(doc_tokens(spark, sf_dir), F.col("tokens"))


@query
def weighted_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = articles(spark, sf_dir)
    return terms.weighted_term_counts(a, [(tx.english_tokens(F.col("Title")), 2), (tx.english_tokens(F.col("Abstract")), 1)])


def _lexicon(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The corpus as its own lexicon: words used five times or more, as nouns and verbs; and the irregular forms."""
    pos = F.explode(F.array(F.lit("n"), F.lit("v"))).alias("pos")
    odd = counts.sparkSession.createDataFrame(lemmas.IRREGULAR, "form string, word string, pos string")
    return counts.where("freq >= 5").select(F.col("term").alias("word"), pos), odd


@query
def lemma_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = written(terms.term_counts(doc_tokens(spark, sf_dir), F.col("tokens")), "counts")
    found = lemmas.lemmas(counts, *_lexicon(counts))
    return counts.join(found, "term").groupBy(F.col("lemma").alias("term")).agg(F.sum("freq").alias("freq"))


@query
def doc_freq_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = doc_tokens(spark, sf_dir)
    dtm = terms.document_terms(d, "doc_id", F.col("tokens"))
    return terms.bounded_frequency(dtm, d.count(), 5, 0.85)


@query
def top_terms_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    dtm = terms.document_terms(content_tokens(spark, sf_dir), "doc_id", F.col("tokens"), ["lang"])
    return rounded(concentration.field_top_terms(dtm, "doc_id", "lang", doc_counts(spark, sf_dir), 20))


@query
def char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = texts(spark, sf_dir)
    return terms.char_gram_counts(d, F.col("text"), [2, 3, 4])


@query
def ngrams_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = content_tokens(spark, sf_dir)
    dtm = terms.document_terms(d, "doc_id", F.concat(tx.ngrams(F.col("tokens"), 2), tx.ngrams(F.col("tokens"), 3)))
    return terms.bounded_frequency(dtm, min_df=2)


@query
def ngrams_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.stream_ngrams(doc_tokens(spark, sf_dir), "doc_id", F.col("tokens"), 3)


def _grams(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    return grams.gram_counts(content_tokens(spark, sf_dir), F.col("tokens"), [n]).select("term", "freq")


def _unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grams(spark, sf_dir, 1)


def _counted(spark: SparkSession, sf_dir: str, sizes: list[int], least: int) -> list[DataFrame]:
    """(term, freq) for each of the sizes and of single words, from one pass over the texts; n-grams used less than `least` times
    are left out, as neither they nor longer ones with them are scored."""
    counts = grams.gram_counts(content_tokens(spark, sf_dir), F.col("tokens"), [*sizes, 1])
    kept = written(counts.where((F.col("n") == 1) | (F.col("freq") >= least)), "grams")
    return [kept.where(F.col("n") == n).select("term", "freq") for n in (*sizes, 1)]


@query
def llr_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(terms.collocations(*_counted(spark, sf_dir, [2], 2), 2))


@query
def llr_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(terms.collocations(*_counted(spark, sf_dir, [3], 2), 3))


@query
def contingency_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(terms.contingency_bigrams(*_counted(spark, sf_dir, [2], 5)))


@query
def contingency_llr_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    gapped = grams.gram_counts(content_tokens(spark, sf_dir), F.col("tokens"), [3], gapped=True).where("freq >= 3").select("term", "freq")
    return rounded(terms.contingency_trigrams(*_counted(spark, sf_dir, [3, 2], 3), gapped, 3))


@query
def best_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = terms.contingency_bigrams(*_counted(spark, sf_dir, [2], 5))
    return rounded(terms.best_phrases(scored, 300))


@query
def phrase_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = doc_tokens(spark, sf_dir)
    counts = written(grams.gram_counts(d, F.col("tokens"), [1, 2]), "grams")
    pairs = terms.exclude_phrases(counts.where("n = 2").select("term", "freq"), ["of the"], STOPWORDS, ["tion"])
    words = counts.where("n = 1").select("term", "freq")
    return terms.lemmatised_phrases(pairs, STOPWORDS, *_lexicon(words)).groupBy("term").agg(F.sum("freq").alias("freq"))


@query
def phrase_counts_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = articles(spark, sf_dir)
    return terms.phrase_counts(a, [(F.col("Title"), 2), (F.col("Abstract"), 1)], PHRASES)


@query
def phrase_counts_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = articles(spark, sf_dir)
    return terms.replaced_phrase_counts(a, [(F.col("Title"), 2), (F.col("Abstract"), 1)], PHRASES)


@query
def hot_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = articles(spark, sf_dir)
    words = terms.weighted_term_counts(a, [(tx.english_tokens(F.col("Title")), 2), (tx.english_tokens(F.col("Abstract")), 1)])
    phrases = terms.phrase_counts(a, [(F.col("Title"), 2), (F.col("Abstract"), 1)], [*PHRASES, "the"])
    return terms.hot_terms(words, phrases)


@query
def hot_term_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = terms.term_counts(doc_tokens(spark, sf_dir), F.col("tokens"))
    return terms.filtered_top(counts, 200, ~F.col("term").isin(*STOPWORDS), 10)


@query
def word_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(terms.word_cloud(_unigrams(spark, sf_dir)))


@query
def mined_phrase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of words that are used twenty times or more, counted as phrases wherever they stand in the texts."""
    mined = terms.minimum_frequency(_grams(spark, sf_dir, 2), 20).select("term")
    a = articles(spark, sf_dir)
    return phrases.many_phrase_counts(a, [(F.col("Title"), 2), (F.col("Abstract"), 1)], mined)


def _run_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents without spaces and signs, as a script without spaces has them."""
    line = F.explode(F.split(F.lower("text"), "\n"))
    return texts(spark, sf_dir).select("doc_id", line.alias("line")).select("doc_id", F.regexp_replace("line", "[^a-z]+", "").alias("run"))


def _dictionary(spark: SparkSession, sf_dir: str, size: int = 3000) -> DataFrame:
    """(word, freq): the most frequent words, ties by word."""
    counts = terms.term_counts(doc_tokens(spark, sf_dir), F.col("tokens"))
    return written(counts.orderBy(F.desc("freq"), "term").limit(size).select(F.col("term").alias("word"), "freq"), "dictionary")


@query
def word_graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of run-together lines, by the best path through the graph of dictionary words."""
    cut = segment.word_segmenter(_dictionary(spark, sf_dir))
    return terms.term_counts(_run_together(spark, sf_dir), cut(F.col("run")))


@query
def recut_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words before and after the phrases mined from the first cut become words of the dictionary."""
    runs, base = _run_together(spark, sf_dir), _dictionary(spark, sf_dir)
    first = written(runs.select(segment.word_segmenter(base)(F.col("run")).alias("k")), "cut")
    words = written(terms.term_counts(first, F.col("k")), "words")
    mined = terms.collocations(terms.term_counts(first, tx.ngrams(F.col("k"), 2)), words, 2, 10, 20.0, above_expected=True)
    mined = written(mined.select(F.replace("term", F.lit(" "), F.lit("")).alias("word")), "mined")  # read three times
    again = terms.term_counts(runs, segment.word_segmenter(segment.extended(base, mined), max_words=None)(F.col("run")))
    both = words.withColumnRenamed("freq", "before").join(again.withColumnRenamed("freq", "after"), "term", "full")
    return both.join(mined.select(F.col("word").alias("term"), F.lit(True).alias("mined")).distinct(), "term", "left").select("term", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"), F.coalesce("mined", F.lit(False)).alias("mined"))


@query
def phrase_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.filtered_top(_grams(spark, sf_dir, 2), 200, ~F.contains("term", F.lit("an")), 10)


@query
def minimum_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.minimum_frequency(_unigrams(spark, sf_dir), 10)


@query
def hyphen_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.term_counts(t(spark, sf_dir, "documents"), tx.hyphen_tokens(F.col("text")))


@query
def cjk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.term_counts(t(spark, sf_dir, "documents"), tx.cjk_tokens(F.col("text")))


@query
def max_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = F.regexp_replace(F.lower("text"), r"[^a-z]+", "-")
    return terms.term_counts(t(spark, sf_dir, "documents"), F.filter(tx.max_match_tokens(run, SEGMENTS), lambda w: F.length(w) <= 12))


@query
def registered_segmenter(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_segmenter(spark, "cut_words", SEGMENTS)
    register_lexicon(spark, "segment_words", SEGMENTS)
    t(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.lower("text"), r"[^a-z]+", "-").alias("text")).createOrReplaceTempView("segment_texts")
    rows = spark.sql("SELECT explode(words) AS word FROM (SELECT cut_words(text) AS words FROM segment_texts)")
    return rows.join(F.broadcast(spark.table("segment_words")), "word", "left_semi").groupBy("word").agg(F.count("*").alias("freq"))


@query
def weighted_text_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = articles(spark, sf_dir)
    text = tx.weighted_text(F.col("Title"), F.col("source"), F.col("Abstract"))
    return terms.term_counts(a.select(tx.english_tokens(text).alias("k")), tx.ngrams(F.col("k"), 2))


@query
def document_term_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the document-term matrix by variant: words, words and pairs, pairs, words without the labels' own."""
    d, k = content_tokens(spark, sf_dir), F.col("tokens")
    variants = {"word": k, "word_pair": F.concat(k, tx.ngrams(k, 2)), "pair": tx.ngrams(k, 2), "no_label_words": tx.without(k, ["english", "french", "german", "spanish", *LABEL_WORDS])}
    dtm = terms.variant_terms(d.select("doc_id", "tokens"), "doc_id", variants)
    freq = terms.document_frequency(dtm, ["variant"])
    return freq.groupBy("variant").agg(F.count("*").alias("terms"), F.sum("df").alias("cells"), F.sum("freq").alias("tokens"))


# projections, scopes, sets, orders --------------------------------------------------------------------------------------


@query
def renamed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clean.rename_present(t(spark, sf_dir, "documents"), {"lang": "group_label", "source": "journal", "absent": "nowhere"})
    return require_columns(out, ["group_label", "journal"]).select("doc_id", "group_label", "journal")


@query
def joined_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.when(F.col("doc_id") % 3 != 0, F.concat("lang", F.lit("; ;")))
    return t(spark, sf_dir, "documents").select("doc_id", tx.join_lists(a, F.col("source")).alias("labels"))


@query
def text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.try_element_at(F.array(*[F.lit(w) for w in (" TRUE ", "1", "Yes", "no", "")]), (F.col("doc_id") % 6 + 1).cast("int"))
    return t(spark, sf_dir, "documents").select("doc_id", tx.to_flag(word).alias("flag"))


@query
def backfilled_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = backfill(t(spark, sf_dir, "documents"), {"journal": None, "citations": 0, "lang": None})
    return d.groupBy("lang", "journal", "citations").agg(F.count("*").alias("n"))


@query
def outside_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outside_domain(t(spark, sf_dir, "documents"), domain(spark, ["en", "fr"], "lang"), "lang")


@query
def label_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents")
    return terms.union_of(d.select(F.col("lang").alias("label")), d.select(F.col("source").alias("label"))).where("label IS NOT NULL")


@query
def domain_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = t(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.count("*").alias("n"))
    return panel.in_domain_order(counts, domain(spark, PRIORITIES), "label", "position").withColumn("position", F.coalesce(F.col("position"), F.lit(len(PRIORITIES))).cast("long"))


@query
def period_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = panel.period_scopes(orders_rows(spark, sf_dir), "year", 1996, "to_1996")
    p = both.groupBy("scope", "field").agg(F.count("*").alias("n"))
    return rounded(panel.shares(p, ["scope"]))


@query
def clear_scope_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents").select("doc_id", "lang", (F.coalesce("n_chars", F.lit(0)) < 200).alias("is_ambiguous"))
    none = d.select("doc_id", "lang", F.lit(False).alias("is_ambiguous"))
    both = panel.clear_scope(d, "is_ambiguous").withColumn("case", F.lit("some")).unionByName(panel.clear_scope(none, "is_ambiguous").withColumn("case", F.lit("none")))
    return both.groupBy("case", "scope", "lang").agg(F.count("*").alias("n"))


@query
def trend_with_early_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = order_panel(spark, sf_dir, ["grp"])
    whole = p.groupBy("grp", "field").agg(F.sum("n").alias("n"))
    early = p.where((F.col("year") <= 1994) & (F.col("field") != "5-LOW")).groupBy("grp", "field").agg(F.sum("n").alias("n_early"))
    return panel.attach(whole, early, ["grp", "field"])


@query
def by_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    adjusted = multiple.benjamini_hochberg(_pseudo_p(spark, sf_dir), "p", "p_partkey")
    return rounded(multiple.by_significance(adjusted.withColumn("q", F.round("q", 9)), "p", "p_partkey", "q").select("p_partkey", "p", "q", "place"))


# classification -------------------------------------------------------------------------------------------------------


def _seed_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(-1 - i, i, f, s) for i, (f, s) in enumerate(SEEDS)], "doc_id long, idx int, field string, text string").coalesce(1)


def _frequencies(spark: SparkSession, sf_dir: str, tokens, count) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(doc_id, term, tf) of the documents and the seed texts, (term, idf), the documents and the seeds; `count` makes tf
    of the tokens."""
    docs = t(spark, sf_dir, "documents").select("doc_id", "text")
    seeds = _seed_rows(spark)
    both = texts(spark, sf_dir).select("doc_id", "text").unionByName(seeds.select("doc_id", "text"))
    tf = count(both.select("doc_id", tokens(F.col("text")).alias("k")))
    return tf, written(cl.inverse_frequency(tf, docs.count() + len(SEEDS)), "idf"), docs, seeds


def _scores(spark: SparkSession, sf_dir: str, tokens, count) -> DataFrame:
    tf, idf, docs, seeds = _frequencies(spark, sf_dir, tokens, count)
    return cl.prototype_scores(tf, "doc_id", idf, docs, seeds.select("idx", "field"), cl.prototype_vectors(tf, "doc_id", idf, seeds.select("doc_id", "idx")))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _scores(spark, sf_dir, tx.plain_tokens, lambda cut: cl.vocabulary_counts(cut, "doc_id", F.col("k"), 30_000, sizes=[1, 2, 3]))
    return cl.assign(cl.best_field(scores, "doc_id"), "Methods")


@query
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    tf, idf, _, _ = _frequencies(spark, sf_dir, tx.plain_tokens, lambda cut: cl.vocabulary_counts(cut, "doc_id", F.col("k"), 30_000))
    w = cl.weighted(tf, "doc_id", idf)
    out = w.where("doc_id >= 0").groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.sum("weight").alias("total"), F.max("weight").alias("top"))
    return rounded(out)


@query
def classify_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_classified(spark, sf_dir))


@query
def classify_legacy_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _classified(spark, sf_dir).select("doc_id", "raw_field", "score", "margin")
    return rounded(cl.review_flag(best))


@query
def classify_charngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, seeds = t(spark, sf_dir, "documents").select("doc_id", "text"), _seed_rows(spark)
    both = texts(spark, sf_dir).select("doc_id", "text").unionByName(seeds.select("doc_id", "text"))
    low = F.lower(F.lower("text"))
    counts = terms.char_gram_counts(both, F.lower("text"), [2, 3, 4])
    vocabulary = [r["term"] for r in counts.orderBy(F.desc("freq"), "term").limit(30_000).collect()]
    packed = chargrams.vectors(both, "doc_id", low, vocabulary)
    idf = np.log((1.0 + docs.count() + len(SEEDS)) / (1 + chargrams.document_frequencies(packed, len(vocabulary)))) + 1
    return rounded(cl.review_flag(cl.best_field(chargrams.prototype_scores(packed, "doc_id", idf, docs, seeds), "doc_id")))


@query
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).groupBy("field").agg(F.count("*").alias("n"))


@query
def review_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).groupBy("priority", "basis", "is_ambiguous").agg(F.count("*").alias("n"))


@query
def sensitivity_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _classified(spark, sf_dir).withColumn("year", (F.col("doc_id") % 6 + 2020).cast("int"))
    all_scopes = panel.scopes({"final": c, "raw": c.withColumn("field", F.col("raw_field")), "high_confidence": c.where("is_high_confidence")})
    return rounded(inference.pearson(panel.panel(all_scopes, "year", "field", ["scope"]), "year", ["scope"]))


def _scope_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scope, year, field, n) of the orders: all, those of large accounts' labels merged, and those of a clear total."""
    o = t(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("raw"), "o_totalprice")
    final = F.when(F.col("o_totalprice") < 20_000, F.lit("4-NOT SPECIFIED")).otherwise(F.col("raw"))
    parts = {"final": o.withColumn("field", final), "raw": o.withColumn("field", F.col("raw")), "high_confidence": o.where("o_totalprice >= 50000").withColumn("field", F.col("raw"))}
    return panel.panel(panel.scopes(parts), "year", "field", ["scope"])


SCOPES = ["final", "raw", "high_confidence"]


@query
def scope_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = inference.logit_trends(_scope_panel(spark, sf_dir), ["scope"])
    return rounded(out.select("scope", "field", "beta", "se", "z", "p", "q", "odds_ratio"))


@query
def scope_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(study.scope_tests(_scope_panel(spark, sf_dir)))


def _study(spark: SparkSession, sf_dir: str) -> study.Study:
    return study.scope_study(written(_scope_panel(spark, sf_dir), "panel"), SCOPES, 1000, 500, 20260810)


@query
def scope_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend, change point and low window of three fields in three scopes, with resampled p, q and stability."""
    return rounded(study.key_signals(_study(spark, sf_dir), "1-URGENT", "5-LOW", "3-MEDIUM"))


@query
def scope_signal_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The effects of the signals, a row for each signal and a column for each scope."""
    p = _scope_panel(spark, sf_dir)
    bare = study.Study(p, inference.logit_trends(p, ["scope"]).withColumn("share_or_above_1", F.lit(None).cast("double")), *[
        found.withColumns({"scan_p": F.lit(None).cast("double"), "scan_q": F.lit(None).cast("double"), name: F.lit(None).cast("double")})
        for found, name in ((scans.best(scans.split_scan(p, ["scope"]), ["scope"], F.abs("z"), "cut"), "cut_frequency"), (scans.best(scans.window_scan(p, ["scope"]), ["scope"], F.col("z"), "start"), "window_frequency"))
    ])
    return rounded(study.by_scope(study.key_signals(bare, "1-URGENT", "5-LOW", "3-MEDIUM"), SCOPES))


@query
def fixed_window_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scans.window_scan(order_panel(spark, sf_dir)).where(F.col("start") == SPLIT - 3))


@query
def classify_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "embeddings")
    proto = cl.mean_vectors(e, "label", "embedding").select(F.col("label").cast("int").alias("idx"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("field"), "vector")
    best = cl.best_field(cl.embedding_scores(e, "vec_id", "embedding", proto), "vec_id", 6)
    return rounded(cl.floor_field(best, "methods"))


@query
def chunk_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in chunks of 256 words, each with a vector (those given, dealt by document and chunk), pooled again."""
    vectors = t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = vectors.count()
    parts = chunks.chunk_texts(t(spark, sf_dir, "documents"), "doc_id", "text", 256)
    parts = parts.select("doc_id", ((F.col("doc_id") * 7 + F.col("chunk")) % n).alias("vec_id")).join(vectors, "vec_id")
    return rounded(cl.pool_chunks(parts, "doc_id", "embedding").select("doc_id", F.posexplode("vector").alias("pos", "x")))


@query
def chunk_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunks.chunk_texts(t(spark, sf_dir, "documents"), "doc_id", "text", 256)
    return out.select("doc_id", "chunk", "n_tokens", F.md5("chunk_text").alias("text_md5"))


# panels and tests -----------------------------------------------------------------------------------------------------


@query
def panel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_panel(spark, sf_dir)


@query
def panel_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel.shares(order_panel(spark, sf_dir), ["year"]))


@query
def overall_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel.overall_shares(order_panel(spark, sf_dir)))


@query
def panel_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = order_panel(spark, sf_dir).withColumn("field", F.concat(F.lit("p"), F.substring("field", 1, 1)))
    return panel.pivot_panel(p, ["p1", "p2", "p3", "p4", "p5"])


@query
def bar_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel.bars(order_panel(spark, sf_dir), domain(spark, PRIORITIES, "field")))


@query
def three_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel.panels(order_panel(spark, sf_dir), ["1-URGENT", "5-LOW", "3-MEDIUM"]))


@query
def group_annual_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel.shares(order_panel(spark, sf_dir, ["grp"]), ["grp", "year"]))


@query
def pearson_chi2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inference.pearson_with_p(order_panel(spark, sf_dir)))


@query
def pooled_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = order_panel(spark, sf_dir, ["grp"]).groupBy("grp", "field").agg(F.sum("n").alias("n"))
    return rounded(inference.pearson(p, "grp"))


@query
def logit_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inference.logit_trends(order_panel(spark, sf_dir)).select("field", "beta", "se", "z", "p", "q", "odds_ratio", "or_low", "or_high", "percent_change"))


@query
def leave_one_year_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inference.leave_one_year_out(order_panel(spark, sf_dir)).select("omitted", "field", "beta", "se", "odds_ratio"))


@query
def logit_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = inference.interactions(order_panel(spark, sf_dir, ["grp"]), "grp", 0, 1)
    return rounded(out.select("field", "coefficient", "se", "p", "q", "ratio", "ratio_low", "ratio_high"))


@query
def multinomial_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inference.multinomial_trend(order_panel(spark, sf_dir)))


@query
def group_lr_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inference.group_tests(order_panel(spark, sf_dir, ["grp"]), "grp"))


@query
def individual_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logits of single orders: year alone as dummies, group x year as dummies, and no design, with their tests."""
    rows = t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("field"), F.year("o_orderdate").alias("year"), (F.col("o_custkey") % 2).alias("grp"))
    years = sorted(r[0] for r in rows.select("year").distinct().collect())  # a handful
    one, by_year, by_group = likelihood.intercept(), likelihood.dummies("year", years), likelihood.dummies("grp", [0, 1])
    designs = {"none": one, "year": one + by_year, "group and year": one + by_year + by_group + likelihood.crossed(by_group, by_year)}
    fits = {name: likelihood.fit_multinomial(rows, "field", d) for name, d in designs.items()}
    out = [(name, f.n, f.loglik, *(likelihood.likelihood_ratio(f, fits["none"]) if name != "none" else (0.0, 0, 1.0))) for name, f in fits.items()]
    return rounded(spark.createDataFrame(out, "design string, n long, loglik double, lr double, df int, p double"))


@query
def saturated_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inference.saturated_loglik(order_panel(spark, sf_dir, ["grp"]), ["grp", "year"]))


def _pseudo_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part").select("p_partkey", "p_type", uniform(7, "p_partkey").alias("u"))
    return p.select("p_partkey", "p_type", (F.col("u") * F.col("u")).alias("p"))


@query
def bh_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(multiple.benjamini_hochberg(_pseudo_p(spark, sf_dir), "p", "p_partkey").select("p_partkey", "q"))


@query
def holm_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(multiple.holm(_pseudo_p(spark, sf_dir), "p", "p_partkey").select("p_partkey", "holm"))


@query
def bonferroni(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(multiple.bonferroni(_pseudo_p(spark, sf_dir), "p").select("p_partkey", "bonferroni"))


@query
def bh_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(multiple.benjamini_hochberg(_pseudo_p(spark, sf_dir), "p", "p_partkey", by=["p_type"]).select("p_partkey", "p_type", "q"))


@query
def change_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scans.split_scan(order_panel(spark, sf_dir))
    out = scans.best(s, [], F.abs("z"), "cut").withColumn("label", scans.split_label())
    return rounded(out)


@query
def stage_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scans.split_scan(order_panel(spark, sf_dir), min_side=1)
    return rounded(scans.best(s, [], F.abs("diff"), "cut").select("field", "cut", "before", "after", (F.col("diff") * 100).alias("diff_pp")))


@query
def low_window_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scans.window_scan(order_panel(spark, sf_dir))
    return rounded(scans.best(s, [], F.col("z"), "start").withColumn("label", scans.window_label()))


@query
def fixed_split_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scans.split_scan(order_panel(spark, sf_dir), min_side=1).where(F.col("cut") == SPLIT))


@query
def key_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = order_panel(spark, sf_dir, ["grp"]).where("field = '1-URGENT' OR field = '5-LOW' OR field = '3-MEDIUM'")
    full = order_panel(spark, sf_dir, ["grp"])
    names = p.select("field").distinct()
    split = scans.best(scans.split_scan(full, ["grp"]), ["grp"], F.abs("z"), "cut").join(names, "field").select("grp", "field", F.lit("split").alias("signal"), scans.split_label().alias("place"), F.col("z").alias("value"))
    low = scans.best(scans.window_scan(full, ["grp"]), ["grp"], F.col("z"), "start").join(names, "field").select("grp", "field", F.lit("low window").alias("signal"), scans.window_label().alias("place"), F.col("z").alias("value"))
    return rounded(split.unionByName(low))


# resampling -----------------------------------------------------------------------------------------------------------


@query
def permutation_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, reps = orders_rows(spark, sf_dir), resample.replicates(spark, 20)
    null = resample.scan_statistics(resample.permuted_panels(rows, reps, 11, "o_orderkey", "year", "field"), ["rep"])
    seen = resample.scan_statistics(order_panel(spark, sf_dir))
    return rounded(resample.permutation_p(seen, null, ["field"], "stat"))


@query
def permutation_scans(spark: SparkSession, sf_dir: str, reps: int = 10_000) -> DataFrame:
    panels = resample.many_permuted_panels(orders_rows(spark, sf_dir), reps, 12, "o_orderkey", "year", "field")
    p = order_panel(spark, sf_dir)
    z = resample.permutation_p(resample.scan_statistics(p, kind="z", min_side=2), resample.scan_statistics(panels, ["rep"], "z", 2), ["field"], "stat")
    w = resample.permutation_p(resample.window_statistics(p), resample.window_statistics(panels, ["rep"]), ["field"], "stat")
    return rounded(z.withColumn("scan", F.lit("split")).unionByName(w.withColumn("scan", F.lit("window"))))


@query
def permutation_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = order_panel(spark, sf_dir)
    kinds = [resample.permutation_scan(p, k, 2000, 20260814).withColumn("scan", F.lit(k)) for k in ("split_diff", "split_z", "low_window")]
    out = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    return rounded(multiple.benjamini_hochberg(out, "p", "field", by=["scan"]))


@query
def bootstrap_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resample.bootstrap_trends(order_panel(spark, sf_dir), 1000))


# concentration --------------------------------------------------------------------------------------------------------


def _dtm(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = content_tokens(spark, sf_dir).withColumn("year", (F.col("doc_id") % 6 + 2020).cast("int"))
    return terms.document_terms(d, "doc_id", F.col("tokens"), ["lang", "year"])


@query
def concentration_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _dtm(spark, sf_dir).withColumn("w", F.col("tf").cast("double"))
    return rounded(concentration.concentration(w, "doc_id", "lang", doc_counts(spark, sf_dir)))


def _specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = concentration.weighted_terms(_dtm(spark, sf_dir), "doc_id", "lang", "year", ["frequency", "presence", "paper", "year_paper"])
    return concentration.concentration_of(w, "lang", doc_counts(spark, sf_dir), ["spec"])


@query
def spec_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_specs(spark, sf_dir))


@query
def spec_table_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight specifications: words and pairs under four weightings, pairs alone, keyword phrases, no label words, and the
    non-ambiguous documents; terms in five documents at least and 85 % of them at most."""
    a = articles(spark, sf_dir)
    clear = F.coalesce(F.length("text") >= 200, F.lit(False)).alias("clear")
    d = a.select("doc_id", "lang", (F.col("doc_id") % 6 + 2020).cast("int").alias("year"), clear, tx.without(tx.english_tokens(F.col("text")), STOPWORDS).alias("k"), tx.keyword_phrases(F.col("Title"), STOPWORDS).alias("p"))
    k, both = F.col("k"), lambda c: F.concat(c, tx.ngrams(c, 2))
    has = {"full": F.col("text").isNotNull(), "pairs": F.lit(True), "keywords": F.lit(True), "no_labels": F.col("text").isNotNull(), "clear": clear}
    sizes = a.select("lang", F.explode(F.array(*[F.when(h, F.lit(n)) for n, h in has.items()])).alias("variant")).where("variant IS NOT NULL").groupBy("variant", "lang").agg(F.count("*").alias("n_docs"))
    # only the four weightings need documents; the rest are sums by term, those of pairs and of clear documents from the same rows
    dtm = written(terms.variant_terms(d.drop("p"), "doc_id", {"full": both(k)}, ["lang", "year", "clear"]).drop("variant"), "dtm", "zstd")
    spark._jvm.System.gc()  # shuffle files of the texts may go, and below those of what is written
    n, f, clear_n, clear_f = F.count("*"), F.sum("tf"), F.count_if("clear"), F.sum(F.when(F.col("clear"), F.col("tf")))
    full = dtm.groupBy("lang", "term").agg(n.alias("n"), f.alias("f"), clear_n.alias("clear_n"), clear_f.alias("clear_f"))
    of = lambda name, n, f: F.struct(F.lit(name).alias("variant"), F.col(n).alias("n"), F.col(f).alias("f"))
    pairs = F.when(F.contains("term", F.lit(" ")), of("pairs", "n", "f"))
    cells = full.select("lang", "term", F.explode(F.array(of("full", "n", "f"), pairs, F.when(F.col("clear_n") > 0, of("clear", "clear_n", "clear_f")))).alias("x")).where("x IS NOT NULL").select("x.variant", "lang", "term", "x.n", "x.f")
    others = terms.variant_terms(d, "doc_id", {"keywords": F.col("p"), "no_labels": both(tx.without(k, LABEL_WORDS))}, ["lang"])
    cells = written(cells.unionByName(others.groupBy("variant", "lang", "term").agg(n.alias("n"), f.alias("f"))), "cells", "zstd")
    spark._jvm.System.gc()
    total = sizes.groupBy("variant").agg(F.sum("n_docs").alias("all"))
    keep = cells.groupBy("variant", "term").agg(F.sum("n").alias("df")).join(F.broadcast(total), "variant").where("df >= 5 AND df <= 0.85 * all").select("variant", "term")
    keep = written(keep, "keep")
    spark._jvm.System.gc()
    w = concentration.weighted_terms(dtm.join(keep.where("variant = 'full'").select("term"), "term", "left_semi"), "doc_id", "lang", "year", ["frequency", "presence", "paper", "year_paper"])
    w = w.unionByName(cells.where("variant <> 'full'").join(keep, ["variant", "term"], "left_semi").select(F.col("variant").alias("spec"), "lang", "term", F.col("f").cast("double").alias("w"), F.col("n").alias("df")))
    names = F.explode(F.when(F.col("variant") == "full", F.array(*[F.lit(x) for x in ("frequency", "presence", "paper", "year_paper")])).otherwise(F.array("variant")))
    return rounded(concentration.concentration_of(w, "lang", sizes.select(names.alias("spec"), "lang", "n_docs"), ["spec"], sizes=True))


def _langs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, "de"), (1, "en"), (2, "es"), (3, "fr")], "idx int, lang string")


@query
def pair_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = concentration.all_pairs(_langs(spark), "lang")
    return rounded(concentration.compare_pairs(_specs(spark, sf_dir), "lang", pairs, ["spec"]))


@query
def concentration_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(concentration.curve(_dtm(spark, sf_dir), "lang"))


@query
def largest_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = concentration.field_top_terms(_dtm(spark, sf_dir), "doc_id", "lang", doc_counts(spark, sf_dir), 30)
    return rounded(concentration.largest_coverage(top, "lang").select("lang", "place", "term", "coverage"))


@query
def text_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = content_tokens(spark, sf_dir).withColumn("n_tokens", F.size("tokens"))
    return rounded(concentration.text_lengths(d, "lang"))


def _share20(dtm: DataFrame, labels: DataFrame) -> DataFrame:
    """(rep, lang, v): top-20 share of the documents' terms under replicate labels."""
    x = labels.join(dtm.select("doc_id", "term", "tf"), "doc_id").groupBy("rep", "lang", "term").agg(F.sum("tf").alias("w"))
    total = x.groupBy("rep", "lang").agg(F.sum("w").alias("total"))
    top = concentration.heaviest(x, ["rep", "lang"], 20, F.desc("w"), F.asc("term")).groupBy("rep", "lang").agg(F.sum("w").alias("w"))
    return top.join(total, ["rep", "lang"]).select("rep", "lang", (F.col("w") / F.col("total")).alias("v"))


def _difference(shares: DataFrame, a: str, b: str) -> DataFrame:
    pick = lambda x: F.max(F.when(F.col("lang") == x, F.col("v")))
    return shares.groupBy("rep").agg(F.round(pick(a) - pick(b), 12).alias("diff"))


@query
def pair_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    dtm, reps = _dtm(spark, sf_dir), resample.replicates(spark, 8)
    labels = resample.permuted_pair(t(spark, sf_dir, "documents"), reps, 21, "doc_id", "lang", "de", "es")
    null = _difference(_share20(dtm, labels), "de", "es").withColumn("pair", F.lit("de-es"))
    own = t(spark, sf_dir, "documents").select(F.lit(0).alias("rep"), "doc_id", "lang")
    seen = _difference(_share20(dtm, own), "de", "es").select(F.lit("de-es").alias("pair"), "diff")
    return rounded(resample.two_sided_p(seen, null, ["pair"], "diff"))


@query
def pair_scan_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = t(spark, sf_dir, "documents").select(F.lit(0).alias("rep"), "doc_id", "lang")
    s = _share20(_dtm(spark, sf_dir), own).select("lang", "v")
    pairs = concentration.all_pairs(_langs(spark), "lang")
    out = pairs.join(s.select(F.col("lang").alias("a"), F.col("v").alias("va")), "a").join(s.select(F.col("lang").alias("b"), F.col("v").alias("vb")), "b")
    return rounded(out.select("a", "b", "va", "vb", F.when(F.round(F.col("va") - F.col("vb"), 12) > 0, F.col("a")).otherwise(F.col("b")).alias("more_concentrated")))


@query
def rarefaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, reps = t(spark, sf_dir, "documents"), resample.replicates(spark, 8)
    sizes = doc_counts(spark, sf_dir).where("lang IN ('de', 'es')")
    least = sizes.agg(F.min("n_docs").alias("n"))
    size = sizes.select("lang").crossJoin(least)  # two labels
    picked = resample.sampled_documents(docs.where("lang IN ('de', 'es')"), reps, 31, "doc_id", "lang", size)
    d = _difference(_share20(_dtm(spark, sf_dir), picked), "de", "es").withColumn("pair", F.lit("de-es"))
    return rounded(resample.replicate_summary(d, ["pair"], "diff"))


def _pair_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, metric, value_a, value_b, diff, winner) of all pairs of languages."""
    w = _dtm(spark, sf_dir).withColumn("w", F.col("tf").cast("double"))
    metrics = concentration.concentration(w, "doc_id", "lang", doc_counts(spark, sf_dir))
    out = concentration.compare_pairs(metrics, "lang", concentration.all_pairs(_langs(spark), "lang"))
    return out.select("a", "b", "metric", "value_a", "value_b", F.round(F.col("value_a") - F.col("value_b"), 12).alias("diff"), "winner")


def _draws(spark: SparkSession, sf_dir: str, metrics: list[str], reps: int, seed: int, equal_size: bool = False) -> DataFrame:
    pairs = [(r["a"], r["b"]) for r in concentration.all_pairs(_langs(spark), "lang").orderBy("a", "b").collect()]  # six
    return resample.pair_draws(_dtm(spark, sf_dir), t(spark, sf_dir, "documents"), "doc_id", "lang", pairs, metrics, reps, seed, equal_size)


@query
def pair_permutation_fast(spark: SparkSession, sf_dir: str, reps: int = 10_000) -> DataFrame:
    keys = ["a", "b", "metric"]
    seen = _pair_differences(spark, sf_dir)
    p = resample.two_sided_p(seen.select(*keys, "diff"), _draws(spark, sf_dir, concentration.METRICS, reps, 20260821), keys, "diff")
    return rounded(seen.join(p.drop("diff"), keys).withColumn("reps", F.lit(reps)))


@query
def pair_scan_fast(spark: SparkSession, sf_dir: str, reps: int = 5_000) -> DataFrame:
    keys = ["a", "b", "metric"]
    seen = _pair_differences(spark, sf_dir).where("metric = 'top20_share'")
    p = resample.two_sided_p(seen.select(*keys, "diff"), _draws(spark, sf_dir, ["top20_share"], reps, 20260822), keys, "diff")
    out = seen.join(p.drop("diff"), keys).withColumn("pair", F.concat_ws("-", "a", "b"))
    out = multiple.bonferroni(multiple.holm(multiple.benjamini_hochberg(out, "p", "pair"), "p", "pair"), "p")
    return rounded(out.drop("pair", "metric").withColumn("reps", F.lit(reps)))


@query
def rarefaction_fast(spark: SparkSession, sf_dir: str, reps: int = 5_000) -> DataFrame:
    keys = ["a", "b", "metric"]
    d = _draws(spark, sf_dir, concentration.METRICS, reps, 20260831, equal_size=True)
    d = d.withColumn("more_a", F.when(F.col("metric") == "norm_entropy", -F.col("diff")).otherwise(F.col("diff")))
    share = resample.replicate_summary(d, keys, "more_a").select(*keys, F.col("share_positive").alias("share_a_more"))
    return rounded(resample.replicate_summary(d, keys, "diff").drop("share_positive").join(share, keys).withColumn("reps", F.lit(reps)))


# streaming ------------------------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream, be it one file or a folder of them: a stream takes a file's path only as a pattern."""
    return spark.readStream.schema(t(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


@query
def stream_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = counts_to_files(stream, "ts", ["event_type"], new_folder(spark, "events"), new_folder(spark, "progress"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "freq")


@query
def stream_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream, classified by a model that was frozen on them and the seed texts."""
    seeds = _seed_rows(spark)
    both = texts(spark, sf_dir).select("doc_id", "text").unionByName(seeds.select("doc_id", "text"))
    cut = written(both.select("doc_id", tx.plain_tokens(F.col("text")).alias("k")), "tokens")
    model = freeze(cut, "doc_id", F.col("k"), seeds, sizes=[1, 2, 3])
    stream = _stream(spark, sf_dir, "documents").select("doc_id", tx.plain_tokens(F.col("text")).alias("k"))
    each = F.concat(F.col("k"), tx.ngrams(F.col("k"), 2), tx.ngrams(F.col("k"), 3))
    return rounded(classify_stream(stream, "doc_id", each, model, "Methods", new_folder(spark, "labels"), new_folder(spark, "progress")))
