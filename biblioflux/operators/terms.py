"""Term tables: weighted counts, n-grams, document frequencies, collocations, hot terms."""

from __future__ import annotations

from functools import reduce

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import bigram_g2, two_cell_llr, xlogy
from ..scratch import written
from .grams import gram_rows
from .lemmas import lemmas
from .phrases import many_phrase_counts


def spread(df: DataFrame) -> DataFrame:
    """df as it is where it has as many partitions as the cluster has cores, or more; else dealt out to so many, since the
    work on terms is many times that of reading texts and a small file may be one partition."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def term_counts(df: DataFrame, tokens: Column, by: list[str] = (), weight: Column | None = None) -> DataFrame:
    """(by..., term, freq): occurrences, or summed weights."""
    rows = df.select(*by, (weight if weight is not None else F.lit(1)).cast("long").alias("w"), F.explode(tokens).alias("term"))
    return rows.groupBy(*by, "term").agg(F.sum("w").alias("freq"))


#: Characters whose n-grams are counted at once.
GRAM_CHARS = 1 << 20


def _gram_counts(parts: list[tuple[str, int]], sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """(term, freq) of n-grams of characters that start at one of the first places of each part (text, places)."""
    length = np.array([len(x) for x, _ in parts])
    codes = np.frombuffer("".join(x for x, _ in parts).encode("utf-32-le"), np.uint32)
    kinds, of = np.unique(codes, return_inverse=True)
    bits = max(1, int(len(kinds) - 1).bit_length())
    most = 1 << (62 // max(sizes) - 1)
    if bits * max(sizes) > 62 and len(codes) > 2 * most:  # too many kinds of characters for one number: fewer texts at once
        for x, places in parts:
            yield from _pieces([x], sizes, most, places)
        return
    of = of.astype(np.int64)
    end = np.cumsum(length)
    start = end - length
    room = np.repeat(end, length) - np.arange(len(codes))  # characters from here to the end of the text
    ok = np.arange(len(codes)) - np.repeat(start, length) < np.repeat([n for _, n in parts], length)
    key = np.zeros(len(codes), np.int64)
    for n in range(1, max(sizes) + 1):
        key = (key[: len(codes) - n + 1] << bits) | of[n - 1 :]
        if n not in sizes or not len(key):
            continue
        grams, count = np.unique(key[(ok & (room >= n))[: len(key)]], return_counts=True)
        letters = np.stack([kinds[(grams >> bits * (n - 1 - j)) & ((1 << bits) - 1)] for j in range(n)], axis=1).astype(np.uint32)
        joined = letters.tobytes().decode("utf-32-le")
        yield pa.RecordBatch.from_arrays([pa.array([joined[i : i + n] for i in range(0, len(joined), n)], pa.string()), pa.array(count, pa.int64())], names=["term", "freq"])


def _pieces(texts: list[str | None], sizes: list[int], most: int, places: int | None = None) -> Iterator[pa.RecordBatch]:
    """Counts of texts in parts of about `most` characters; a longer text is cut, and parts overlap by what a gram needs."""
    held, size = [], 0
    for x in texts:
        last = len(x or "") if places is None else min(places, len(x))
        for lo in range(0, last, most):
            part = x[lo : min(lo + most, last) + max(sizes) - 1]
            held.append((part, min(most, last - lo)))
            size += len(part)
            if size >= most:
                yield from _gram_counts(held, sizes)
                held, size = [], 0
    if held:
        yield from _gram_counts(held, sizes)


def char_gram_counts(df: DataFrame, text: Column, sizes: list[int]) -> DataFrame:
    """(term, freq) of n-grams of the lower-cased text's characters: tasks count some texts at a time, as numbers, and what
    moves is each part's distinct n-grams."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _pieces(batch.column(0).to_pylist(), sizes, GRAM_CHARS)

    parts = df.select(F.lower(text).alias("text")).mapInArrow(count, "term string, freq long")
    return parts.groupBy("term").agg(F.sum("freq").alias("freq"))


def weighted_term_counts(df: DataFrame, parts: list[tuple[Column, int]]) -> DataFrame:
    """(term, freq) over several token columns, each with its weight; one pass, one shuffle."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(w).cast("long").alias("w"), t.alias("t")) for t, w in parts])).alias("p"))
    rows = rows.select(F.col("p.w").alias("w"), F.explode("p.t").alias("term"))
    return rows.groupBy("term").agg(F.sum("w").alias("freq"))


def document_terms(df: DataFrame, doc: str, tokens: Column, carry: list[str] = ()) -> DataFrame:
    """(doc, carry..., term, tf): the sparse document-term matrix as a table.

    The documents are dealt by id before they are cut, so counts by document and term, and by document alone, need no
    other shuffle: the texts move once, their many terms do not.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a count that is named is not coalesced: texts are small, terms are not
    rows = df.repartition(parts, doc).select(doc, *carry, F.explode(tokens).alias("term"))
    return rows.groupBy(doc, *carry, "term").agg(F.count("*").alias("tf"))


def variant_terms(df: DataFrame, doc: str, variants: dict[str, Column], carry: list[str] = ()) -> DataFrame:
    """(doc, carry..., variant, term, tf): document_terms() of several token columns. What the tokens are made of is dealt
    by document once; the variants are made after that, so they never move. A null variant has no terms."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), v.alias("k")) for n, v in variants.items()]))
    rows = df.repartition(parts, doc).select(doc, *carry, each.alias("v")).select(doc, *carry, F.col("v.variant").alias("variant"), F.explode("v.k").alias("term"))
    return rows.groupBy(doc, *carry, "variant", "term").agg(F.count("*").alias("tf"))


def document_frequency(dtm: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by..., term, df, freq) from rows that are unique by document and term."""
    return dtm.groupBy(*by, "term").agg(F.count("*").alias("df"), F.sum("tf").alias("freq"))


def frequency_bounds(dtm: DataFrame, n_docs: int, min_df: int = 1, max_share: float = 1.0) -> DataFrame:
    """The rows of dtm whose term lies in at least min_df documents and at most the share of n_docs."""
    keep = document_frequency(dtm).where((F.col("df") >= min_df) & (F.col("df") <= max_share * n_docs)).select("term")
    return dtm.join(keep, "term", "left_semi")


def bounded_frequency(dtm: DataFrame, n_docs: int = 0, min_df: int = 1, max_share: float | None = None) -> DataFrame:
    """document_frequency() of the terms within the bounds: one pass, nothing is joined back."""
    out = document_frequency(dtm).where(F.col("df") >= min_df)
    return out if max_share is None else out.where(F.col("df") <= max_share * n_docs)


def word_cloud(counts: DataFrame, least: int = 3, k: int = 120) -> DataFrame:
    """(term, freq, weight) of the k most frequent terms that occur `least` times or more, weight relative to the first."""
    top = minimum_frequency(counts, least).orderBy(F.desc("freq"), F.asc("term")).limit(k)
    return top.crossJoin(F.broadcast(top.agg(F.max("freq").alias("most")))).select("term", "freq", (F.col("freq") / F.col("most")).alias("weight"))  # one row


def union_of(*lists: DataFrame) -> DataFrame:
    """The distinct rows of all lists, by column name."""
    return reduce(lambda a, b: a.unionByName(b), lists).distinct()


def presence(dtm: DataFrame) -> DataFrame:
    return dtm.withColumn("tf", F.lit(1).cast("long"))


def top_terms(counts: DataFrame, k: int, by: list[str] = (), freq: str = "freq", term: str = "term") -> DataFrame:
    """The k most frequent terms, of each group if `by` is given, ties by term, with rank from 1."""
    order = [F.desc(freq), F.asc(term)]
    if not by:
        first = counts.orderBy(*order).limit(k)
        return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    w = Window.partitionBy(*by).orderBy(*order)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def filtered_top(counts: DataFrame, first: int, keep: Column, k: int) -> DataFrame:
    """The first k that fit among the `first` most frequent: the cut comes before the filter."""
    return counts.orderBy(F.desc("freq"), "term").limit(first).where(keep).orderBy(F.desc("freq"), "term").limit(k)


def minimum_frequency(counts: DataFrame, least: int) -> DataFrame:
    return counts.where(F.col("freq") >= least)


def stream_ngrams(df: DataFrame, doc: str, tokens: Column, n: int = 2) -> DataFrame:
    """(term, freq) of n-grams over the one stream of all tokens in document order, crossing document ends.

    n-grams within documents are counted where they lie. For those that cross, only the first and last n-1 tokens of
    each document are put in order, in ranges of documents whose edges are stitched: the heads of the documents that
    follow a range are found from the next non-empty ones, so no window spans the corpus.
    """
    d = df.select(F.col(doc).alias("d"), tokens.alias("t")).where(F.size("t") > 0)
    inner = gram_rows(d, F.col("t"), [n]).select("term", "freq")
    tail = F.slice("t", F.greatest(F.size("t") - n + 2, F.lit(1)), n - 1)
    edge = written(d.select("d", F.slice("t", 1, n - 1).alias("head"), tail.alias("tail")), "ends")  # so ranges are found without cutting the texts again
    ranged = edge.repartitionByRange("d").sortWithinPartitions("d").select(F.spark_partition_id().alias("part"), "d", "head", "tail")
    schema = "kind string, part int, pos int, words array<string>"

    def stitch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        lead: list[str] = []
        trail: list[str] = []
        part, seen, total = -1, False, 0
        for f in frames:
            for p, head, tail in zip(f["part"], f["head"], f["tail"], strict=True):
                head, tail = list(head), list(tail)
                if seen:
                    span = trail + head
                    for i in range(len(span) - n + 1):
                        if i < len(trail) < i + n:
                            rows.append(("gram", int(p), 0, span[i : i + n]))
                part, seen = int(p), True
                if total < n - 1:
                    lead = (lead + head)[: n - 1]
                total += len(head)
                # a document shorter than n - 1 is all head, and its words go on to follow what came before
                trail = (trail + tail)[-(n - 1) :] if len(head) < n - 1 else tail
                if len(rows) > 5000:
                    yield pd.DataFrame(rows, columns=["kind", "part", "pos", "words"])
                    rows = []
        if seen:
            rows += [("edge", part, 0, lead), ("edge", part, 1, trail)]
        yield pd.DataFrame(rows, columns=["kind", "part", "pos", "words"])

    pieces = written(ranged.mapInPandas(stitch, schema), "edges")
    grams = pieces.where("kind = 'gram'").select(F.array_join("words", " ").alias("term"), F.lit(1).cast("long").alias("freq"))
    edges = pieces.where("kind = 'edge'").orderBy("part", "pos").collect()  # two rows for each range of documents
    extra, trail = [], []
    for lead, end in zip(edges[::2], edges[1::2], strict=True):
        head, last = list(lead["words"]), list(end["words"])
        span = trail + head
        extra += [(" ".join(span[i : i + n]), 1) for i in range(len(span) - n + 1) if i < len(trail) < i + n]
        trail = (trail + last)[-(n - 1) :] if len(head) < n - 1 else last
    crossed = df.sparkSession.createDataFrame(extra, "term string, freq long")
    return inner.unionByName(grams).unionByName(crossed).groupBy("term").agg(F.sum("freq").alias("freq"))


def _parts(n: int) -> list[Column]:
    return [F.get(F.split("term", " "), F.lit(i)) for i in range(n)]


def collocations(grams: DataFrame, unigrams: DataFrame, n: int, min_freq: int = 2, min_llr: float = 0.1, above_expected: bool = False) -> DataFrame:
    """(term, freq, llr) of n-grams (2 or 3) by the two-cell likelihood ratio against independence.

    Expected is the product of the words' counts over N^(n-1), N being all unigrams. n-grams with a word that has no
    count are left out. The unigram table is joined by shuffle unless Spark finds it small.
    """
    total = unigrams.agg(F.sum("freq").cast("double").alias("N"))
    g = grams.where(F.col("freq") >= min_freq).withColumns({f"w{i}": p for i, p in enumerate(_parts(n))})
    for i in range(n):
        g = g.join(unigrams.select(F.col("term").alias(f"w{i}"), F.col("freq").cast("double").alias(f"n{i}")), f"w{i}")
    g = g.crossJoin(F.broadcast(total))  # one row
    expected = F.col("n0")
    for i in range(1, n):
        expected = expected * F.col(f"n{i}") / F.col("N")
    scored = g.withColumn("E", expected).withColumn("llr", two_cell_llr(F.col("freq").cast("double"), F.col("E"), F.col("N")))
    keep = F.col("llr") >= min_llr
    return scored.where(keep & (F.col("freq") > F.col("E")) if above_expected else keep).select("term", "freq", "llr")


def contingency_bigrams(bigrams: DataFrame, unigrams: DataFrame, min_freq: int = 5) -> DataFrame:
    """(term, freq, score) of bigrams by the likelihood ratio of their 2 x 2 table."""
    total = unigrams.agg(F.sum("freq").cast("double").alias("N"))
    g = bigrams.where(F.col("freq") >= min_freq).withColumns({f"w{i}": p for i, p in enumerate(_parts(2))})
    for i in range(2):
        g = g.join(unigrams.select(F.col("term").alias(f"w{i}"), F.col("freq").cast("double").alias(f"n{i}")), f"w{i}")
    g = g.crossJoin(F.broadcast(total))  # one row
    return g.select("term", "freq", bigram_g2(F.col("freq").cast("double"), F.col("n0"), F.col("n1"), F.col("N")).alias("score"))


def contingency_trigrams(trigrams: DataFrame, bigrams: DataFrame, unigrams: DataFrame, gapped: DataFrame, min_freq: int = 5) -> DataFrame:
    """(term, freq, score) of trigrams by the likelihood ratio of their 2 x 2 x 2 table under full independence; gapped
    counts first and third words."""
    total = unigrams.agg(F.sum("freq").cast("double").alias("N"))
    a, b, c = _parts(3)
    g = trigrams.where(F.col("freq") >= min_freq).withColumns({"w0": a, "w1": b, "w2": c})
    g = g.withColumns({"p01": F.concat_ws(" ", "w0", "w1"), "p12": F.concat_ws(" ", "w1", "w2"), "p02": F.concat_ws(" ", "w0", "w2")})
    for i in range(3):
        g = g.join(unigrams.select(F.col("term").alias(f"w{i}"), F.col("freq").cast("double").alias(f"n{i}")), f"w{i}")
    for key, table in (("p01", bigrams), ("p12", bigrams), ("p02", gapped)):
        g = g.join(table.select(F.col("term").alias(key), F.col("freq").cast("double").alias(f"c{key}")), key)
    g = g.crossJoin(F.broadcast(total))  # one row
    n0, n1, n2, N = (F.col(x) for x in ("n0", "n1", "n2", "N"))
    k, ab, bc, ac = F.col("freq").cast("double"), F.col("cp01"), F.col("cp12"), F.col("cp02")
    cells = [
        (k, n0 * n1 * n2), (ab - k, n0 * n1 * (N - n2)), (ac - k, n0 * (N - n1) * n2), (bc - k, (N - n0) * n1 * n2),
        (n0 - ab - ac + k, n0 * (N - n1) * (N - n2)), (n1 - ab - bc + k, (N - n0) * n1 * (N - n2)), (n2 - ac - bc + k, (N - n0) * (N - n1) * n2),
        (N - n0 - n1 - n2 + ab + ac + bc - k, (N - n0) * (N - n1) * (N - n2)),
    ]
    out = F.lit(0.0)
    for observed, product in cells:
        out = out + F.when(product > 0, xlogy(observed, observed * N * N / product)).otherwise(F.lit(0.0))
    return g.select("term", "freq", (2 * out).alias("score"))


def best_phrases(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best by score (to 9 digits), ties by phrase."""
    return scored.orderBy(F.desc(F.round(score, 9)), "term").limit(k)


def exclude_phrases(phrases: DataFrame, exact: list[str], stopwords: list[str], stems: list[str], equals: bool = False) -> DataFrame:
    """Phrases that are not listed, not made of stopwords only, and of which no part contains (or equals) a boilerplate
    stem."""
    parts = F.split("term", " ")
    stops, bad = (F.array(*[F.lit(w) for w in sorted(set(x))]).cast("array<string>") for x in (stopwords, stems))
    hit = F.exists(parts, lambda p: F.exists(bad, lambda s: (p == s) if equals else F.contains(p, s)))
    all_stops = F.forall(parts, lambda p: F.array_contains(stops, p))
    listed = F.col("term").isin(*exact) if exact else F.lit(False)
    return phrases.where(~listed & ~all_stops & ~hit)


def lemmatised_phrases(phrases: DataFrame, stopwords: list[str], lexicon: DataFrame, exceptions: DataFrame | None = None, least: int = 3) -> DataFrame:
    """Phrases with every part lemmatised; kept if no part is a stopword or shorter than `least`. Each distinct part is
    looked up once; a phrase's parts, a few, come together again by its text."""
    parts = phrases.select(F.col("term").alias("phrase"), F.posexplode(F.split("term", " ")).alias("place", "term"))
    found = parts.join(lemmas(parts, lexicon, exceptions), "term", "left").select("phrase", "place", F.coalesce("lemma", "term").alias("lemma"))
    ok = ~F.col("lemma").isin(*sorted(set(stopwords))) if stopwords else F.lit(True)
    whole = found.groupBy("phrase").agg(F.min(ok & (F.length("lemma") >= least)).alias("ok"), F.transform(F.array_sort(F.collect_set(F.struct("place", "lemma"))), lambda x: x["lemma"]).alias("parts"))
    whole = whole.where("ok").select(F.col("phrase").alias("term"), F.array_join("parts", " ").alias("__lemmas"))
    return phrases.join(whole, "term").withColumn("term", F.col("__lemmas")).drop("__lemmas")


def phrase_counts(df: DataFrame, parts: list[tuple[Column, int]], phrases: list[str]) -> DataFrame:
    """(term, freq): many_phrase_counts() of a list."""
    return many_phrase_counts(df, parts, df.sparkSession.createDataFrame([(p,) for p in sorted(set(phrases))], "term string"))


def replaced_phrases(text: Column, phrases: list[str]) -> Column:
    """The lower-cased text with each phrase glued by underscores, longest first: a phrase inside a longer word glues that
    too."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for p in sorted(set(phrases), key=lambda p: (-len(p), p)):
        out = F.replace(out, F.lit(p), F.lit(p.replace(" ", "_")))
    return out


def replaced_phrase_counts(df: DataFrame, parts: list[tuple[Column, int]], phrases: list[str]) -> DataFrame:
    """(term, freq) of glued tokens, weighted; suffixes that stick to a phrase make a token of their own."""
    tokens = [(F.filter(F.regexp_extract_all(replaced_phrases(t, phrases), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: F.contains(w, F.lit("_"))), w) for t, w in parts]
    return weighted_term_counts(df, tokens)


def hot_terms(words: DataFrame, phrases: DataFrame, least: int = 3) -> DataFrame:
    """Words and phrases as one list: by surface form, the larger count, with its source (word, phrase or both)."""
    both = words.select("term", "freq", F.lit("word").alias("s")).unionByName(phrases.select("term", "freq", F.lit("phrase").alias("s")))
    out = both.groupBy("term").agg(F.max("freq").alias("freq"), F.min("s").alias("lo"), F.max("s").alias("hi"))
    return out.where(F.col("freq") >= least).select("term", "freq", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.lit("both")).alias("source"))
