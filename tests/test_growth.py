"""Steps whose cost must grow with the input and no faster, and tables that are folders of files."""

from __future__ import annotations

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F


def test_ngrams_of_a_long_text(spark):
    from biblioflux.functions import text as tx

    k = F.transform(F.sequence(F.lit(1), F.col("id").cast("int")), lambda i: F.concat(F.lit("w"), i.cast("string")))
    words = spark.range(120_000, 120_001).select(k.alias("k"))
    began = time.time()
    got = words.select(F.explode(tx.ngrams(F.col("k"), 3)).alias("g")).agg(F.count("*").alias("n"), F.max(F.length("g")).alias("m"), F.min("g").alias("g")).first()
    assert (got.n, got.m, got.g) == (119_998, 23, "w1 w2 w3")
    assert time.time() - began < 20  # each n-gram copied the whole text: 120,000 squared
    few = spark.createDataFrame([(["a"],), ([],), (["a", "b"],), (["a", "b", "c"],), (None,)], "k array<string>")
    assert [r.g for r in few.select(tx.ngrams(F.col("k"), 2, "").alias("g")).collect()] == [[], [], ["ab"], ["ab", "bc"], []]


def test_stream_reads_a_folder_of_files(spark, tmp_path):
    from biblioflux.plans.queries import QUERIES, _stream

    rows = [(i, "the and of that" if i % 2 else "der die und ein", None, "s", 15) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/many/documents.parquet")
    docs.coalesce(1).write.parquet(f"{tmp_path}/part")
    (tmp_path / "one").mkdir()
    next((tmp_path / "part").glob("part-*.parquet")).rename(tmp_path / "one" / "documents.parquet")
    got = [sorted((r.doc_id, r.raw_field) for r in QUERIES["stream_classified"](spark, f"{tmp_path}/{d}").collect()) for d in ("many", "one")]
    assert got[0] == got[1] == [(i, "English" if i % 2 else "German") for i in range(6)]
    assert _stream(spark, f"{tmp_path}/many", "documents").isStreaming


def test_runs_cut_together_equal_runs_cut_alone():
    import random

    from biblioflux.functions.segment import WordGraph

    rng = random.Random(1)
    for k in range(40):
        words = {"".join(rng.choice("abc語") for _ in range(rng.randint(1, 5))): rng.randint(1, 4) for _ in range(rng.choice([0, 1, 5, 60]))}
        texts = ["".join(rng.choice("abcdé語😀 -") for _ in range(rng.randint(0, 60))) for _ in range(rng.choice([1, 3, 200]))] + [None]
        graph = WordGraph(words)
        assert graph.cut_all(texts) == [None if t is None else graph.cut(t) for t in texts], k


def test_permuted_panels_by_buckets(spark, monkeypatch):
    import hashlib
    from collections import Counter

    from biblioflux.operators import resample

    monkeypatch.setattr(resample, "BUCKET_ROWS", 20)  # a replicate's rows in many tasks
    rows = [(i * 3 % 301, 2000 + i % 4, "abc"[i % 3]) for i in range(300)]
    got = resample.permuted_panels(spark.createDataFrame(rows, "id long, year int, field string").repartition(5), resample.replicates(spark, 3), 9, "id", "year", "field")
    want = Counter()
    for rep in range(3):
        mixed = sorted(rows, key=lambda r: (hashlib.md5(f"9|{rep}|{r[0]}".encode()).hexdigest(), r[0]))
        want.update((rep, r[1], m[2]) for r, m in zip(sorted(rows), mixed, strict=True))
    assert {(r.rep, r.year, r.field): r.n for r in got.collect() if r.n} == want


def test_char_gram_counts_against_plain_counts(spark, monkeypatch):
    import random
    from collections import Counter

    from biblioflux.operators import terms

    rng = random.Random(2)
    texts = ["".join(rng.choice("abC éß語😀\n") for _ in range(rng.choice([0, 1, 3, 4, 50]))) for _ in range(60)]
    texts += ["".join(map(chr, range(0x4E00, 0x9F00))) + "".join(chr(0xAC00 + i) for i in range(11_000)) + "".join(map(chr, range(0x20000, 0x21400))), None]  # more kinds than 15 bits hold
    df = spark.createDataFrame([(x,) for x in texts], "t string").repartition(3)
    low = [r[0] for r in df.select(F.lower("t")).collect()]
    want = Counter(x[i : i + n] for x in low if x for n in (2, 3, 4) for i in range(len(x) - n + 1))
    for most in (1 << 20, 97):
        parts = [dict(zip(*b.to_pydict().values(), strict=True)) for b in terms._pieces(low, [2, 3, 4], most)] if most == 97 else [{r.term: r.freq for r in terms.char_gram_counts(df, F.col("t"), [2, 3, 4]).collect()}]
        got = Counter()
        for p in parts:
            got.update(p)
        assert got == want


def test_pair_draws_move_terms_not_replicates(spark):
    from biblioflux.operators import resample

    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "de").otherwise("es").alias("lang"))
    dtm = spark.range(600 * 40).select((F.col("id") % 600).alias("doc_id"), F.concat(F.lit("t"), F.floor(F.col("id") / 7).cast("string")).alias("term"), F.lit(2).alias("tf")).groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))

    def moved(reps: int) -> int:
        """Bytes that all executors wrote to shuffles."""
        written = lambda: sum(x.totalShuffleWrite() for x in scala_list(spark.sparkContext._jsc.sc().statusStore().executorList(False)))
        before = written()
        got = resample.pair_draws(dtm, docs, "doc_id", "lang", [("de", "es")], ["hhi"], reps, 3, per_job=10_000).count()
        assert got == reps
        return written() - before

    def scala_list(x) -> list:
        return [x.apply(i) for i in range(x.size())]

    assert moved(4000) < 4 * moved(500)  # a count for each term and replicate: 8 times


def test_variants_of_documents_do_not_move(spark, tmp_path):
    from biblioflux.plans.queries import QUERIES

    rows = [(i, None if i == 3 else f"Title one\nthe data of model {i % 2} and data again" + " and long" * 30, "en" if i % 2 else "de", "s", 30) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    variants = QUERIES["document_term_variants"](spark, str(tmp_path))
    assert "Generate" not in plan(variants).split("RepartitionByExpression")[-1]  # each document moved once for each variant
    full = QUERIES["spec_table_full"](spark, str(tmp_path))
    windows = [x for x in plan(full).split("\n") if "windowspecdefinition(doc_id" in x]
    assert windows and not any("variant" in x for x in windows)  # all variants were dealt by document again
    assert {r.spec for r in full.collect()} == {"frequency", "presence", "paper", "year_paper", "pairs", "keywords", "no_labels", "clear"}


def test_chunks_go_on_as_they_are_cut(spark):
    from types import SimpleNamespace

    import pyarrow as pa

    from biblioflux.operators import chunks

    kept = SimpleNamespace(schema={"d": SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "bigint"))}, withColumnRenamed=lambda *_: None)
    kept.select = lambda *_: kept
    kept.mapInArrow = lambda f, _: setattr(kept, "f", f) or kept
    chunks.chunk_texts(kept, "d", "t", 50)
    texts = ["word " * 40_000, None, "", *["more words " * 20_000] * 20]
    out = list(kept.f(iter([pa.RecordBatch.from_pydict({"d": list(range(23)), "t": texts})])))
    assert max(sum(map(len, b.column(5).to_pylist())) for b in out) < 2 << 20  # all chunks of all texts were held at once
    ids, chunk = ([x for b in out for x in b.column(i).to_pylist()] for i in (0, 1))
    assert len(ids) == 800 + 2 + 20 * 800 and list(zip(ids, chunk)) == sorted(zip(ids, chunk))


def test_pooled_vectors_meet_whole(spark):
    from biblioflux.operators.classify import pool_chunks

    nan = float("nan")
    rows = [(1, [3.0, 0.0]), (1, [1.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [2.0]), (5, [1.0, -1.0]), (6, [nan, 1.0]), (6, [1.0, 1.0])]
    out = pool_chunks(spark.createDataFrame(rows, "d long, v array<float>"), "d", "v")
    got = {r.d: r.vector for r in out.collect()}
    assert got[1] == [0.6, 0.8] and got[2] == [0.0, 0.0] and set(got) == {1, 2, 5, 6}
    assert abs(got[5][0] ** 2 + got[5][1] ** 2 - 1) < 1e-12 and got[5][1] < 0
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()  # a row for each place of each vector


def test_word_grams_of_a_vocabulary_are_counted_as_numbers(spark, monkeypatch):
    from biblioflux.operators import grams
    from biblioflux.operators.classify import top_vocabulary, vocabulary_counts

    rng = random.Random(5)
    docs = [(i, [f"w{int(rng.paretovariate(0.7)) % 40}" for _ in range(rng.choice([0, 1, 2, 3, 200]))]) for i in range(60)] + [(60, None)]
    df = spark.createDataFrame(docs, "d long, k array<string>").repartition(3)
    of = {d: Counter(" ".join(k[i : i + n]) for n in (1, 2, 3) for i in range(len(k or []) - n + 1)) for d, k in docs}
    count = sum(of.values(), Counter())
    want = sorted(count.items(), key=lambda x: (-x[1], x[0]))[:300]
    for cells in (5, 1 << 12):
        got = top_vocabulary(df, F.col("k"), 300, cells, [1, 2, 3]).orderBy(F.desc("cf"), "term").collect()
        assert [(r.term, r.cf) for r in got] == want
    tf = {(r.d, r.term): r.tf for r in vocabulary_counts(df, "d", F.col("k"), 300, sizes=[1, 2, 3]).collect()}
    kept = {w for w, _ in want}
    assert tf == {(d, w): n for d, c in of.items() for w, n in c.items() if w in kept}
    # cuts between places lose and invent nothing
    batch = pa.array([k for _, k in docs], pa.list_(pa.string()))
    monkeypatch.setattr(grams, "PLACES", 7)
    seen = Counter()
    for s in grams.stretches(batch, 3):
        for n in (1, 2, 3):
            at = s.starts(n)
            seen.update(zip(s.row[at].tolist(), s.terms(s.keys(at, n), n).to_pylist(), strict=True))
    assert seen == Counter({(d, w): n for d, c in of.items() for w, n in c.items()})


def test_word_gram_counts_hold_few_rows_a_stretch(spark):
    from biblioflux.functions import text as tx
    from biblioflux.operators import grams

    rng = random.Random(6)
    docs = [(i, [rng.choice("abcdefg") for _ in range(i % 9)]) for i in range(200)]
    df = spark.createDataFrame(docs, "d long, k array<string>").coalesce(1)
    want = Counter((n, " ".join(k[i : i + n])) for _, k in docs for n in (1, 3) for i in range(len(k) - n + 1))
    assert {(r.n, r.term): r.freq for r in grams.gram_counts(df, F.col("k"), [3, 1]).collect()} == want
    assert grams.gram_rows(df, F.col("k"), [3, 1]).count() == len(want)  # not a row for each place
    gapped = Counter(f"{k[i]} {k[i + 2]}" for _, k in docs for i in range(len(k) - 2))
    assert {r.term: r.freq for r in grams.gram_counts(df, F.col("k"), [3], gapped=True).collect()} == gapped
    odd = ["the cat_x a-b " + "z" * 41 + " éab ab9 Zoo", "z" * 40 + "|b|of 9ab ab", ""]
    got = spark.createDataFrame([(x,) for x in odd], "t string").select(tx.without(tx.english_tokens(F.col("t")), ["the", "of"]).alias("k"))
    assert [r.k for r in got.collect()] == [["zoo"], ["z" * 40, "ab"], []]


def test_mined_phrases_are_made_once(spark):
    from biblioflux.operators.phrases import many_phrase_counts

    made = spark.sparkContext.accumulator(0)

    def mine(rows):
        for r in rows:
            made.add(1)
            yield r

    phrases = spark.createDataFrame(spark.createDataFrame([("ab c",), ("c d",)], "term string").coalesce(1).rdd.mapPartitions(mine), "term string")
    df = spark.createDataFrame([("ab c d ab c",)], "t string")
    got = {r.term: r.freq for r in many_phrase_counts(df, [(F.col("t"), 1)], phrases, max_chars=4).collect()}
    assert got == {"ab c": 2, "c d": 1} and made.value == 2


def test_documents_as_vectors_of_character_grams(spark, monkeypatch):
    import numpy as np

    from biblioflux.operators import chargrams

    rng = random.Random(7)
    docs = [(i % 50, "".join(rng.choice("abC éß語😀\n\0") for _ in range(rng.choice([0, 1, 3, 60])))) for i in range(60)] + [(50, None)]
    grams = Counter(x.lower()[i : i + n] for _, x in docs if x for n in (2, 3, 4) for i in range(len(x) - n + 1))
    names = [g for g, _ in grams.most_common(90)]
    want = Counter((d, x.lower()[i : i + n]) for d, x in docs if x for n in (2, 3, 4) for i in range(len(x) - n + 1) if x.lower()[i : i + n] in names)
    df = spark.createDataFrame(docs, "d long, t string").repartition(3)
    packed = chargrams.vectors(df, "d", F.lower("t"), names)
    rows = packed.collect()
    got = {(r.d, names[a]): n for r in rows for a, n in zip(np.frombuffer(r["at"], np.int32).tolist(), np.frombuffer(r.tf, np.int64).tolist(), strict=True)}
    assert got == want and len({r.d for r in rows}) == len(rows)  # a row for each n-gram of a document moved
    of = Counter(g for _, g in want)
    assert chargrams.document_frequencies(packed, len(names)).tolist() == [of[g] for g in names]
    # cuts of long texts, and a tree that is no plain table
    whole = chargrams._counted([(0, docs[3][1] * 5), (2, "ab")], chargrams.GramTree(names), len(names))
    monkeypatch.setattr(chargrams, "PLACES", 7)
    monkeypatch.setattr(chargrams, "TABLE", 0)
    parts = chargrams._counted([(0, docs[3][1] * 5), (2, "ab")], chargrams.GramTree(names), len(names))
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_classify_charngram_moves_no_row_for_each_gram(spark):
    from biblioflux.plans.queries import QUERIES

    plan = QUERIES["classify_charngram"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "term" not in plan


def test_pair_draws_hold_few_copies_of_packed_terms(spark, monkeypatch):
    from biblioflux.operators import resample

    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "de").otherwise("es").alias("lang"))
    dtm = spark.range(300 * 40).select((F.col("id") % 300).alias("doc_id"), F.concat(F.lit("t"), F.floor(F.col("id") / 7).cast("string")).alias("term"), F.lit(2).alias("tf"))
    made = {}

    def written(df, tag="t", own=resample.written):
        out = own(df, tag)
        made.setdefault(tag, []).append(out.count())
        return out

    monkeypatch.setattr(resample, "written", written)
    monkeypatch.setattr(resample, "LABEL_BYTES", 1 << 9)
    monkeypatch.setattr(resample, "SLICE_ROWS", 1 << 10)
    got = resample.pair_draws(dtm, docs, "doc_id", "lang", [("de", "es")], ["hhi"], 60, 3, block=10)
    assert got.count() == 60
    assert len(made["draws"]) > 1  # one job held a copy of the terms for every group
    assert made["postings"][0] <= 1 + resample.TERM_PARTS * 2  # a row for each term and block


def test_permutation_scans_take_all_replicates(spark, monkeypatch):
    import inspect

    from biblioflux.operators import resample
    from biblioflux.plans.oracle import ORACLE
    from biblioflux.plans.queries import QUERIES

    query = inspect.unwrap(QUERIES["permutation_scans"])
    assert inspect.signature(query).parameters["reps"].default == 10_000 and "range(10000)" in ORACLE["permutation_scans"]  # 10 were drawn
    df = spark.createDataFrame([(i * 3 % 101, 2000 + i % 4, "abc"[i % 3]) for i in range(100)], "id long, year int, field string")
    want = sorted(resample.permuted_panels(df, resample.replicates(spark, 7), 9, "id", "year", "field").collect())
    monkeypatch.setattr(resample, "JOB_ROWS", 250)
    assert sorted(resample.many_permuted_panels(df, 7, 9, "id", "year", "field").collect()) == want


def test_large_dictionaries_are_arrays(spark, monkeypatch):
    import inspect

    from biblioflux.functions import segment
    from biblioflux.plans.queries import QUERIES

    rng = random.Random(11)
    for k in range(40):
        words = {"".join(rng.choice("abc語") for _ in range(rng.randint(0, 5))): rng.randint(1, 4) for _ in range(rng.choice([0, 1, 5, 60]))}
        texts = ["".join(rng.choice("abcdé語😀 -") for _ in range(rng.randint(0, 60))) for _ in range(rng.choice([1, 3, 200]))] + [None]
        plain, large = segment.WordGraph(words), segment.LargeWordGraph(pa.array(list(words), pa.string()), np.array(list(words.values()), np.int64))
        assert large.cut_all(texts) == plain.cut_all(texts), k
        assert [large.path(x) for x in texts if x] == [plain.path(x) for x in texts if x], k
        with monkeypatch.context() as m:
            m.setattr(segment, "_CELLS", 40)
            assert large.cut_all(texts) == plain.cut_all(texts), k
    rows = [("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))), rng.randint(1, 9)) for _ in range(500)]
    lexicon, df = spark.createDataFrame(rows, "word string, freq long"), spark.createDataFrame([("abcdefghxabcd" * 5,), (None,)], "t string")
    plain = df.select(segment.word_segmenter(lexicon)("t")).collect()
    monkeypatch.setattr(segment, "LARGE", 10)
    assert df.select(segment.word_segmenter(lexicon, max_words=None)("t")).collect() == plain
    assert "max_words=None" in inspect.getsource(inspect.unwrap(QUERIES["recut_counts"]))  # more than a million mined words raised


def test_terms_of_documents_lie_compressed(spark, tmp_path, monkeypatch):
    from pathlib import Path

    from biblioflux.plans import queries

    rows = [(i, f"Title one\nthe data of model {i % 2}", "en" if i % 2 else "de", "s", 30) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    files = {}

    def written(df, tag="t", *codec, own=queries.written):
        out = own(df, tag, *codec)
        files[tag] = [f.name for f in Path(out._scratch.removeprefix("file:")).glob("*.parquet")]
        return out

    monkeypatch.setattr(queries, "written", written)
    queries.QUERIES["spec_table_full"](spark, str(tmp_path))
    assert all(files[t] and all(".zstd." in f for f in files[t]) for t in ("dtm", "cells"))  # Spark's own codec took more disk
