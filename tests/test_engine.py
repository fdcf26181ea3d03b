"""Golden panel, unit and property tests of the engine."""

from __future__ import annotations

import json
import math
import subprocess
import sys
import zipfile
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from biblioflux import schemas
from biblioflux.functions import rand, stats
from biblioflux.functions import text as tx
from biblioflux.operators import classify, clean, inference, multiple, panel, resample, scans, terms
from biblioflux.sources import readers, sinks

#: A published panel of article counts, years 2020 to 2025 by ten fields.
FIELDS = ["development", "history", "finance", "industry", "international", "labour", "macro", "micro", "public", "methods"]
PANEL = {
    2020: [27, 31, 55, 30, 18, 21, 33, 13, 36, 93],
    2021: [25, 26, 40, 39, 19, 24, 19, 13, 28, 95],
    2022: [19, 37, 42, 22, 23, 16, 28, 16, 32, 75],
    2023: [16, 18, 37, 26, 19, 16, 30, 8, 29, 54],
    2024: [12, 23, 41, 30, 20, 16, 33, 13, 26, 46],
    2025: [20, 16, 41, 33, 37, 15, 15, 11, 31, 59],
}


@pytest.fixture(scope="module")
def golden(spark):
    rows = [(y, f, n) for y, c in PANEL.items() for f, n in zip(FIELDS, c, strict=True)]
    return spark.createDataFrame(rows, "year int, field string, n long").cache()


def test_golden_overall(golden):
    r = inference.pearson_with_p(golden).first()
    assert math.isclose(r["chi2"], 64.2731859503624, rel_tol=1e-12) and r["df"] == 45 and math.isclose(r["p"], 0.031035401200292374, rel_tol=1e-9)
    assert math.isclose(r["cramers_v"], 0.08483775831080732, rel_tol=1e-12) and math.isclose(r["min_expected"], 10.482642777155656, rel_tol=1e-12)
    m = inference.multinomial_trend(golden).first()
    assert math.isclose(m["lr"], 23.853101475609947, rel_tol=1e-9) and m["df"] == 9 and m["converged"] and math.isclose(m["p"], 0.004539696720570686, rel_tol=1e-6)


def test_golden_trends(golden):
    t = {r["field"]: r for r in inference.logit_trends(golden, exclude=["methods"]).collect()}
    i = t["international"]
    for c, v in (("beta", 0.19025083201976709), ("se", 0.0519402326345946), ("p", 0.00024939552550072694), ("odds_ratio", 1.2095529542204135), ("q", 0.0022445597295065426), ("or_low", 1.092477416148103), ("or_high", 1.3391749133100561)):
        assert math.isclose(i[c], v, rel_tol=1e-8), c
    assert math.isclose(t["finance"]["p"], 0.6680570279327802, rel_tol=1e-8) and math.isclose(t["finance"]["q"], 0.7725354757202525, rel_tol=1e-8) and len(t) == 9
    out = {r["omitted"]: r for r in inference.leave_one_year_out(golden).where("field = 'international'").collect()}
    assert math.isclose(out[2025]["odds_ratio"], 1.123875880954624, rel_tol=1e-8) and math.isclose(out[2025]["p"], 0.1113626315825699, rel_tol=1e-7)
    assert math.isclose(out[2020]["beta"], 0.20177972007909578, rel_tol=1e-7)


def test_golden_stage_scan(golden):
    best = {r["field"]: r for r in scans.best(scans.split_scan(golden, min_side=2), [], F.abs("diff"), "cut").withColumn("label", scans.split_label()).collect()}
    assert best["international"]["label"] == "2023/2024" and math.isclose(best["international"]["diff"] * 100, 4.264667333905252, rel_tol=1e-12)
    assert best["history"]["label"] == "2022/2023" and math.isclose(best["history"]["diff"] * 100, -2.241167912889351, rel_tol=1e-12)
    p = {r["field"]: r for r in resample.permutation_scan(golden, "split_diff", 4000, 7, min_side=2).collect()}
    for field, want in (("international", 0.0035996400359964), ("history", 0.23587641235876414), ("industry", 0.2576742325767423)):
        assert abs(p[field]["p"] - want) < 4 * math.sqrt(want * (1 - want) / 4000) + 1e-3 and p[field]["reps"] == 4000


def test_shares_and_pivot(golden, spark):
    s = panel.shares(golden, ["year"]).groupBy("year").agg(F.sum("share").alias("s"), F.max("total").alias("t")).collect()
    assert {r["year"]: r["t"] for r in s} == {2020: 357, 2021: 328, 2022: 310, 2023: 253, 2024: 260, 2025: 278} and all(abs(r["s"] - 1) < 1e-12 for r in s)
    assert panel.pivot_panel(golden, FIELDS).where("year = 2025").first()["international"] == 37
    rows = spark.createDataFrame([(2020, "a"), (2021, "b"), (None, "a")], "y int, f string")
    assert sorted(tuple(r) for r in panel.panel(rows, "y", "f").collect()) == [(2020, "a", 1), (2020, "b", 0), (2021, "a", 0), (2021, "b", 1)]


def test_group_tests_agree_with_separate_fits(golden, spark):
    other = golden.withColumn("n", F.col("n") + (F.col("year") - 2020) * 2)
    both = golden.withColumn("g", F.lit(0)).unionByName(other.withColumn("g", F.lit(1)))
    got = {r["test"]: r for r in inference.group_tests(both, "g").collect()}
    assert [got[k]["df"] for k in ("group composition", "group x linear year", "group x categorical year")] == [9, 9, 45] and all(r["converged"] and r["lr"] >= -1e-6 for r in got.values())
    x = {r["field"]: r for r in inference.interactions(both, "g", 0, 1).collect()}
    a = {r["field"]: r["beta"] for r in inference.logit_trends(golden).collect()}
    b = {r["field"]: r["beta"] for r in inference.logit_trends(other).collect()}
    assert all(math.isclose(x[f]["coefficient"], b[f] - a[f], abs_tol=1e-12) and math.isclose(x[f]["ratio"], math.exp(x[f]["coefficient"])) for f in FIELDS)


def test_bootstrap_is_repeatable_on_any_partitioning(golden, spark):
    a = sorted(map(tuple, resample.bootstrap_trends(golden, 60).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        b = sorted(map(tuple, resample.bootstrap_trends(golden.repartition(3), 60).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert a == b and len(a) == 10


def test_adjustments(spark):
    ps = [0.001, 0.02, 0.02, 0.5, 0.9, None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "k int, p double")
    out = multiple.bonferroni(multiple.holm(multiple.benjamini_hochberg(df, "p", "k"), "p", "k"), "p").orderBy("k").collect()
    assert [round(r["q"], 6) for r in out[:5]] == [0.005, 0.033333, 0.033333, 0.625, 0.9] and out[5]["q"] is None and out[5]["holm"] is None
    assert [round(r["holm"], 6) for r in out[:5]] == [0.005, 0.08, 0.08, 1.0, 1.0]
    assert all(r["q"] >= r["p"] and r["q"] <= r["holm"] + 1e-12 <= r["bonferroni"] + 2e-12 for r in out[:5])


def test_tails():
    assert math.isclose(stats.chi2_tail(3.841458820694124, 1), 0.05, rel_tol=1e-9) and math.isclose(stats.chi2_tail(7.814727903251179, 3), 0.05, rel_tol=1e-9)
    assert math.isclose(stats.normal_two_sided(1.959963984540054), 0.05, rel_tol=1e-12) and stats.chi2_tail(0, 5) == 1


def test_text_expressions(spark):
    df = spark.createDataFrame([("  A　b  c ", "x; ; y ;", "Café Labor-markets 12 studies the ab1 ", None)], "a string, b string, c string, d string")
    r = df.select(
        tx.squeeze(F.col("a")).alias("s"), tx.join_lists(F.col("b"), F.col("d")).alias("j"), tx.english_tokens(F.col("c")).alias("t"), tx.plain_tokens(F.col("c")).alias("p"), tx.hyphen_tokens(F.col("c")).alias("h"),
        tx.ngrams(F.split(F.lit("a b c"), " "), 2).alias("n"), tx.ngrams(F.split(F.lit("a"), " "), 2).alias("e"), tx.char_ngrams(F.lit("Aé b"), 2).alias("g"), tx.char_ngrams(F.lit("a"), 2).alias("g0"),
        tx.occurrences(F.lit("aaaa b aa"), F.lit("aa")).alias("o"), tx.to_number(F.lit("x"), "double", 0.0).alias("z"), tx.to_flag(F.lit(" YES ")).alias("f"),
        tx.keyword_phrases(F.lit("GDP growth; the | Trade-off,, ab"), ["the"]).alias("k"),
        tx.weighted_text(F.lit("T"), F.lit("K"), F.lit("A")).alias("w"), tx.cjk_tokens(F.lit("经济 学 增长 123 gdp")).alias("cj"),
    ).first()
    assert r["s"] == "A b c" and r["j"] == "x; y" and r["t"] == ["labor", "markets", "studies", "the"] and "cafe" in r["p"] and "labor-markets" in r["h"]
    assert r["n"] == ["a b", "b c"] and r["e"] == [] and r["g"] == ["aé", "é ", " b"] and r["g0"] == [] and r["o"] == 3 and r["z"] == 0 and r["f"]
    assert r["k"] == ["gdp growth", "trade-off"]
    assert r["w"] == "T. T. K. K. A" and r["cj"] == ["经济", "增长", "gdp"]


def test_stream_ngrams_cross_documents(spark):
    docs = [(i, t.split()) for i, t in enumerate(["a b c", "d", "", "e", "f g h i", "j"] * 5)]
    flat = [w for _, t in docs for w in t]
    df = spark.createDataFrame(docs, "d long, t array<string>").repartition(7)
    for n in (2, 3):
        want = {}
        for k in range(len(flat) - n + 1):
            g = " ".join(flat[k : k + n])
            want[g] = want.get(g, 0) + 1
        assert {r["term"]: r["freq"] for r in terms.stream_ngrams(df, "d", F.col("t"), n).collect()} == want


def test_phrases(spark):
    df = spark.createDataFrame([("Labor Markets in labor market", "labor")], "t string, a string")
    counts = {r["term"]: r["freq"] for r in terms.phrase_counts(df, [(F.col("t"), 2), (F.col("a"), 1)], ["labor market", "labor"]).collect()}
    assert counts == {"labor market": 4, "labor": 5}
    glued = {r["term"]: r["freq"] for r in terms.replaced_phrase_counts(df, [(F.col("t"), 2), (F.col("a"), 1)], ["labor market"]).collect()}
    assert glued == {"labor_markets": 2, "labor_market": 2}
    p = spark.createDataFrame([("of the", 5), ("labor markets", 4), ("section one", 3), ("the market", 2)], "term string, freq long")
    kept = terms.exclude_phrases(p, ["zz"], ["of", "the"], ["sect"])
    assert {r["term"] for r in kept.collect()} == {"labor markets", "the market"}
    assert [r["term"] for r in terms.lemmatised_phrases(kept, ["the"], spark.createDataFrame([("labor", "n"), ("market", "n")], "word string, pos string")).collect()] == ["labor market"]
    hot = terms.hot_terms(spark.createDataFrame([("a", 5), ("b", 1)], "term string, freq long"), spark.createDataFrame([("a", 7), ("c d", 3)], "term string, freq long"))
    assert {tuple(r) for r in hot.collect()} == {("a", 7, "both"), ("c d", 3, "phrase")}


def test_classification_thresholds(spark):
    rows = [(1, 0.5, 0.4), (2, 0.0, 0.0), (3, 0.018, 0.01), (4, 0.1, 0.099)]
    scores = spark.createDataFrame([(d, i, f, s) for d, a, b in rows for i, f, s in ((0, "x", a), (1, "methods", b))], "doc long, idx int, field string, score double")
    got = {r["doc"]: r for r in classify.assign(classify.best_field(scores, "doc"), "methods").collect()}
    assert got[1]["field"] == "x" and got[1]["priority"] == "Low" and got[1]["is_high_confidence"]
    assert got[2]["raw_field"] == "x" and got[2]["field"] == "methods" and got[2]["is_ambiguous"] and got[2]["priority"] == "Medium"
    assert got[3]["field"] == "x" and got[3]["priority"] == "Medium" and not got[3]["is_high_confidence"]
    assert got[4]["is_ambiguous"] and not any(r["needs_review"] for r in got.values())


def test_shuffle_is_the_same_on_any_partitioning(spark):
    df = spark.range(50).select(F.col("id"), (F.col("id") % 3).alias("year"), (F.col("id") % 4).cast("string").alias("f"))
    reps = resample.replicates(spark, 3)
    a, b = (sorted(map(tuple, resample.permuted_panels(x, reps, 1, "id", "year", "f").collect())) for x in (df, df.repartition(5)))
    assert a == b and sum(r[3] for r in a) == 150
    u = spark.range(100).select(rand.uniform(3, "id").alias("u")).agg(F.min("u"), F.max("u")).first()
    assert 0 <= u[0] < u[1] < 1


def test_readers(spark, tmp_path):
    (tmp_path / "a-1.txt").write_text("﻿TI\tAB\tPY\nOne\tText\t2020\nToo\tmany\t2020\tfields\nShort\n", encoding="utf-8")
    (tmp_path / "a-2.txt").write_text("TI\tTC\nTwo\t3\n", encoding="utf-8")
    raw = readers.read_tab_export(spark, f"{tmp_path}/a-*.txt")
    assert sorted((r["TI"], r["AB"], r["TC"]) for r in raw.collect()) == [("One", "Text", None), ("Short", None, None), ("Two", None, "3")]
    tagged = clean.clean_tab_articles(raw.withColumn("AU", F.lit("x")))
    assert {r["Title"]: r["reject_reason"] for r in tagged.collect()} == {"One": None, "Short": "missing_abstract", "Two": "missing_abstract"}
    sinks.write_rejects(tagged, f"{tmp_path}/rejects")
    assert spark.read.parquet(f"{tmp_path}/rejects").count() == 2
    (tmp_path / "CN1.txt").write_bytes("题名：经济 增长\r\nYear: 2021\r\nno key\r\nYear: 2022\r\n\r\n题名: b: c\n".encode("gb18030"))
    got = [tuple(r) for r in readers.read_blocks(spark, f"{tmp_path}/CN*.txt", ["题名", "Year"]).collect()]
    assert got == [("经济 增长", "2022"), ("b: c", None)]
    (tmp_path / "g.csv").write_bytes("名,v\n\"a\n\"\"b\"\"\",1\n".encode("gb18030"))
    r = readers.read_csv_any(spark, f"{tmp_path}/g.csv").first()
    assert r["名"] == 'a\n"b"' and r["v"] == "1"
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/x.csv", "﻿a,b\n1,\n2,y\n")
    assert sorted(tuple(r) for r in readers.read_zip_member(spark, f"{tmp_path}/z.zip", "in/x.csv").collect()) == [("1", ""), ("2", "y")]
    with pytest.raises(FileNotFoundError):
        readers.matching_files(spark, f"{tmp_path}/none-*.txt")
    assert readers.first_existing(spark, [f"{tmp_path}/no", f"{tmp_path}/g.csv"]).endswith("g.csv")


def test_sinks_and_checks(spark, tmp_path, golden):
    sinks.write_csv_bom(golden, f"{tmp_path}/p.csv")
    assert Path(f"{tmp_path}/p.csv").read_bytes().startswith(b"\xef\xbb\xbf") and len(pd.read_csv(f"{tmp_path}/p.csv")) == 60
    sinks.write_metadata(f"{tmp_path}/m.json", seed=1, label="é")
    assert json.loads(Path(f"{tmp_path}/m.json").read_text(encoding="utf-8")) == {"seed": 1, "label": "é"}
    assert "| 2020 | development | 27 |" in sinks.markdown_report("T", {"Panel": golden.orderBy("year").limit(1), "Note": "x"})
    dim = schemas.domain(spark, FIELDS)
    assert schemas.check_domain(golden, dim, "field", 10) is golden
    with pytest.raises(ValueError, match="zzz"):
        schemas.check_domain(spark.createDataFrame([("zzz",)], "field string"), dim, "field")
    with pytest.raises(ValueError, match="x"):
        schemas.require_columns(golden, ["x"])
    assert schemas.backfill(golden, {"x": None, "n": 0}).columns == ["year", "field", "n", "x"]


def test_streaming(spark, tmp_path):
    from biblioflux.streaming.terms import drop_repeats, run_to_memory, windowed_terms

    df = spark.sql("SELECT timestamp'2024-01-01 10:00:00' AS ts, 'a b a' AS text UNION ALL SELECT timestamp'2024-01-02 01:00:00', 'b' UNION ALL SELECT timestamp'2024-01-02 01:00:00', 'b'")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    got = {(str(r[0])[:10], r[1]): r[2] for r in run_to_memory(windowed_terms(stream, "ts", F.split("text", " ")), "w1").collect()}
    assert got == {("2024-01-01", "a"): 2, ("2024-01-01", "b"): 1, ("2024-01-02", "b"): 2}
    assert run_to_memory(drop_repeats(stream, "ts", ["text"]), "w2", "append").count() == 2


def test_relevance_and_duplicates(spark):
    df = spark.createDataFrame([(1, "j", "strong x"), (2, "j", "w1 w2 w3"), (3, "j", "w1 w2 w3 mark"), (4, "k", "none"), (5, "j", None)], "i int, j string, t string")
    got = clean.filter_relevant(df, F.col("t"), F.col("j") == "j", ["strong"], ["w1", "w2", "w3"], ["mark"])
    assert {r["i"] for r in got.collect()} == {1, 2, 4}
    dup = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "i int, k string")
    assert {(r["i"], r["copies"]) for r in clean.repeated_keys(dup, ["k"]).collect()} == {(1, 2), (2, 2)}


def test_imports_without_the_optional_package():
    code = (
        "import sys, importlib.abc\n"
        "class No(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('biblioflux.llm') or name == 'corpus_pipeline': raise ImportError(name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries()\n"
        "assert 'classify_tfidf' in q and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q)\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)


def test_pair_resampling_over_all_pairs(spark):
    from biblioflux.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    scan = {(r["a"], r["b"]): r for r in QUERIES["pair_scan_fast"](spark, sf, reps=199).collect()}
    seen = {(r["a"], r["b"]): r for r in QUERIES["pair_scan_top20"](spark, sf).collect()}
    assert set(scan) == set(seen) and len(scan) == 6
    ps = sorted(r["p"] for r in scan.values())
    for k, r in scan.items():
        assert abs(r["diff"] - (seen[k]["va"] - seen[k]["vb"])) < 3e-6 and 2 / 200 <= r["p"] <= 1
        assert r["p"] <= r["q"] + 1e-6 and r["q"] <= r["holm"] + 1e-6 and r["holm"] <= r["bonferroni"] + 1e-6
        assert abs(r["bonferroni"] - min(1, 6 * r["p"])) < 1e-5
    assert ps[0] < 2 / 9  # 8 replicates could not go below
    full = QUERIES["pair_permutation_fast"](spark, sf, reps=40).collect()
    rare = QUERIES["rarefaction_fast"](spark, sf, reps=40).collect()
    assert len(full) == len(rare) == 30 and all(r["low"] <= r["median"] <= r["high"] for r in rare)


def test_pair_draws_against_plain_counts(spark):
    """Two documents: a shuffle keeps or swaps them; equal-size draws of all documents give the observed difference."""
    from biblioflux.operators import resample
    from biblioflux.operators.concentration import METRICS

    dtm = spark.createDataFrame([(1, "x", 3), (1, "y", 1), (2, "x", 1), (2, "z", 1)], "doc_id long, term string, tf int")
    docs = spark.createDataFrame([(1, "de"), (2, "es")], "doc_id long, lang string")
    h = lambda s: -sum(p * math.log(p) for p in s) / math.log(3)
    want = {"top10_share": 0, "top20_share": 0, "hhi": 0.625 - 0.5, "norm_entropy": h((0.75, 0.25)) - h((0.5, 0.5)), "max_coverage": 0}
    shuffled = resample.pair_draws(dtm, docs, "doc_id", "lang", [("de", "es")], METRICS, 60, 1).collect()
    for m, v in want.items():
        assert {round(r["diff"], 9) + 0 for r in shuffled if r["metric"] == m} == {round(v, 9) + 0, round(-v, 9) + 0}
    same = resample.pair_draws(dtm, docs, "doc_id", "lang", [("de", "es")], METRICS, 5, 1, equal_size=True).collect()
    assert len(same) == 25 and all(abs(r["diff"] - want[r["metric"]]) < 1e-9 for r in same)


def test_forward_maximum_match(spark):
    from biblioflux.functions import text as tx
    from biblioflux.functions.register import register_lexicon, register_segmenter

    words = ["经济", "经济学", "中国经济", "研究", "a+b"]
    df = spark.createDataFrame([("中国经济学研究 GDP2020", ), ("经济学a+b的", ), ("", ), (None, )], "x string")
    want = [["中国经济", "学", "研究", "GDP2020"], ["经济学", "a+b", "的"], [], None]
    assert [r[0] for r in df.select(tx.max_match_tokens(F.col("x"), words)).collect()] == want
    register_segmenter(spark, "cut_test", words)
    register_lexicon(spark, "words_test", words)
    df.createOrReplaceTempView("cut_texts")
    assert [r[0] for r in spark.sql("SELECT cut_test(x) FROM cut_texts").collect()] == want
    assert spark.table("words_test").count() == 5


def test_command_line(spark, tmp_path):
    from biblioflux.__main__ import main

    rows = [(2020 + i % 6, "abc"[(i * i + i // 7) % 3]) for i in range(300)]
    spark.createDataFrame(rows, "year long, field string").write.parquet(f"{tmp_path}/in")
    main(["trends", "--input", f"{tmp_path}/in", "--output", f"{tmp_path}/out"], spark)
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("place").collect()
    assert [r["place"] for r in got] == [1, 2, 3] and [r["q"] for r in got] == sorted(r["q"] for r in got)


def test_encoding_is_decided_by_whole_files(spark, tmp_path):
    from biblioflux.sources.readers import read_csv_any

    (tmp_path / "a.csv").write_bytes(b"x,y\n" + b"plain,1\n" * 200_000 + "é,2\n".encode("latin1"))
    (tmp_path / "b.csv").write_bytes("x,y\né,3\n".encode())
    got = {tuple(r) for r in read_csv_any(spark, f"{tmp_path}/*.csv", ("utf-8", "latin1")).distinct().collect()}
    assert got == {("plain", "1"), ("é", "2"), ("é", "3")}


def test_stream_to_files(spark, tmp_path):
    from biblioflux.streaming.terms import run_to_files, windowed_counts

    spark.sql("SELECT timestamp'2024-01-01 10:00:00' AS ts, 'a' AS k UNION ALL SELECT timestamp'2024-01-01 11:00:00', 'a' UNION ALL SELECT timestamp'2024-02-01 00:00:00', 'b'").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, k string").parquet(f"{tmp_path}/in")
    got = run_to_files(windowed_counts(stream, "ts", ["k"]), f"{tmp_path}/out", f"{tmp_path}/ck").collect()
    assert [(r["k"], r["freq"]) for r in got] == [("a", 2)]
