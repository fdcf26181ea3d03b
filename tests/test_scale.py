"""Distributed forms against plain ones: ordered scans, drawn labels, vocabularies, word graphs, lemmas, phrases, fits."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F


@pytest.fixture()
def many_partitions(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}

    def use(n: int) -> None:
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")

    yield use
    for k, v in old.items():
        spark.conf.set(k, v)


# ordered scans --------------------------------------------------------------------------------------------------------


def plain_adjust(rows):
    """rows (key, family, p) to {key: (bh, holm, bonferroni)}."""
    out = {}
    for fam in {f for _, f, _ in rows}:
        own = sorted((p, k) for k, f, p in rows if f == fam and p is not None)
        n, q, h = len(own), [0.0] * len(own), 0.0
        low = 1.0
        for i in range(n - 1, -1, -1):
            low = min(low, own[i][0] * n / (i + 1))
            q[i] = low
        for i, (p, k) in enumerate(own):
            h = max(h, min(1.0, (n - i) * p))
            out[k] = (q[i], h, min(1.0, n * p))
        out |= {k: (None, None, None) for k, f, p in rows if f == fam and p is None}
    return out


@pytest.mark.parametrize("parts", [1, 8])
@pytest.mark.parametrize("families", [1, 3])
def test_adjustments_over_slices(spark, many_partitions, parts, families):
    from biblioflux.operators import multiple

    many_partitions(parts)
    rng = random.Random(3)
    rows = [(i, None if families > 1 and i % 50 == 7 else f"f{i % families}", rng.choice([None, 1.0, 1.0, rng.random() ** 3, round(rng.random(), 2)])) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, fam string, p double").repartition(5)
    by = ["fam"] if families > 1 else []
    out = multiple.bonferroni(multiple.holm(multiple.benjamini_hochberg(df, "p", "k", by=by), "p", "k", by=by), "p", by=by)
    assert out.columns == ["k", "fam", "p", "q", "holm", "bonferroni"]
    want = plain_adjust([(k, f if by else 0, p) for k, f, p in rows])
    got = {r.k: (r.q, r.holm, r.bonferroni) for r in out.collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-12) for a, b in zip(got[k], w, strict=True)), (k, got[k], w)
    placed = multiple.by_significance(df, "p", "k").collect()
    order = sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[0]))
    assert [(r.place, r.k) for r in placed] == [(i, r[0]) for i, r in enumerate(order, 1)]
    assert multiple.holm(df.limit(0), "p", "k").count() == 0


def test_slices_are_even_under_ties(spark, many_partitions):
    from biblioflux.operators.ordered import SLICE, in_slices

    many_partitions(8)
    df = spark.range(8000).select("id", F.lit(1.0).alias("p"))
    sizes = [r["count"] for r in in_slices(df, [], F.asc("p"), F.asc("id")).groupBy(SLICE).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 1000


# drawn labels ---------------------------------------------------------------------------------------------------------


def metrics_of(weights, dfs, n_docs, vocabulary):
    total = sum(weights.values())
    s = sorted((w / total for w in weights.values() if w), reverse=True)
    return {"top10_share": sum(s[:10]), "top20_share": sum(s[:20]), "hhi": sum(x * x for x in s), "norm_entropy": -sum(x * math.log(x) for x in s) / math.log(vocabulary), "max_coverage": max(dfs.values()) / n_docs}


@pytest.mark.parametrize("equal_size", [False, True])
def test_pair_draws_equal_counts_of_the_same_labels(spark, monkeypatch, equal_size):
    from biblioflux.operators import resample
    from biblioflux.operators.concentration import METRICS

    monkeypatch.setattr(resample, "BLOCK_DOCS", 16)
    rng = random.Random(9)
    docs = [(i, ["de", "de", "es", "fr"][i % 4]) for i in range(70)]
    cells = [(i, f"t{t}", rng.choice([1, 1, 1, 2, 300])) for i, _ in docs for t in {int(rng.paretovariate(0.5)) % 60 for _ in range(25)} if i % 9]
    dtm, dd = spark.createDataFrame(cells, "doc_id long, term string, tf int").repartition(3), spark.createDataFrame(docs, "doc_id long, lang string")
    pairs, reps, block, seed = [("de", "es"), ("es", "fr")], 14, 5, 4
    got = {(r.a, r.b, r.rep, r.metric): r["diff"] for r in resample.pair_draws(dtm, dd, "doc_id", "lang", pairs, METRICS, reps, seed, equal_size, block=block, per_job=10).collect()}
    assert len(got) == len(pairs) * reps * len(METRICS)
    # the same labels, drawn block by block, and plain sums over all documents
    blocks = -(-len(docs) // 16)
    place = {r.d: r.b for r in dd.select(F.col("doc_id").alias("d"), F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("b")).collect()}
    of, vocabulary = dict(docs), len({t for _, t, _ in cells})
    members = {(b, f): sorted(d for d in of if place[d] == b and of[d] == f) for b in range(blocks) for f in ("de", "es", "fr")}
    before = {f: np.concatenate(([0], np.cumsum([len(members[b, f]) for b in range(blocks)]))) for f in ("de", "es", "fr")}
    for k, (a, b) in enumerate(pairs):
        total = {f: int(before[f][-1]) for f in (a, b)}
        for turn in range(-(-reps // block)):
            key, sides = [seed, k, turn], {0: defaultdict(set), 1: defaultdict(set)}
            for blk in range(blocks):
                if equal_size:
                    for i, f in enumerate((a, b)):
                        m = resample.drawn(len(members[blk, f]), resample.block_counts(before[f], min(total.values()), blk, block, [*key, i]), [*key, i, blk])
                        for d, row in zip(members[blk, f], m, strict=True):
                            for r in np.flatnonzero(row):
                                sides[i][r].add(d)
                else:
                    both = sorted(members[blk, a] + members[blk, b])
                    m = resample.drawn(len(both), resample.block_counts(before[a] + before[b], total[a], blk, block, [*key, 2]), [*key, 2, blk])
                    for d, row in zip(both, m, strict=True):
                        for r in range(block):
                            sides[0 if row[r] else 1][r].add(d)
            for r in range(block):
                rep = turn * block + r
                if rep >= reps:
                    continue
                sizes = [min(total.values())] * 2 if equal_size else [total[a], total[b]]
                assert [len(sides[i][r]) for i in (0, 1)] == sizes
                value = []
                for i in (0, 1):
                    w, df = Counter(), Counter()
                    for d, t, n in cells:
                        if d in sides[i][r]:
                            w[t] += n
                            df[t] += 1
                    value.append(metrics_of(w, df, sizes[i], vocabulary))
                for m in METRICS:
                    assert abs(got[a, b, rep, m] - (value[0][m] - value[1][m])) < 1e-9, (a, b, rep, m)


def test_block_counts_are_hypergeometric():
    from biblioflux.operators.resample import block_counts

    sizes = np.array([5, 0, 9, 30, 6])
    before = np.concatenate(([0], np.cumsum(sizes)))
    got = np.array([block_counts(before, 20, b, 4000, [1]) for b in range(5)])
    assert (got.sum(axis=0) == 20).all() and (got <= sizes[:, None]).all() and (got >= 0).all()
    want = 20 * sizes / 50
    assert np.abs(got.mean(axis=1) - want).max() < 0.1
    variance = 20 * (sizes / 50) * (1 - sizes / 50) * 30 / 49
    assert np.abs(got.var(axis=1) - variance).max() < 0.35


# vocabulary -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("cells", [7, 1 << 20])
def test_top_vocabulary_is_exact(spark, cells):
    from biblioflux.operators.classify import top_vocabulary, vocabulary_counts

    rng = random.Random(2)
    docs = [(i, [f"w{int(rng.paretovariate(0.6)) % 500}" for _ in range(60)]) for i in range(80)]
    df = spark.createDataFrame(docs, "d long, k array<string>")
    count = Counter(w for _, k in docs for w in k)
    for k in (1, 20, 10_000):
        want = sorted(count.items(), key=lambda x: (-x[1], x[0]))[:k]
        got = [(r.term, r.cf) for r in top_vocabulary(df, F.col("k"), k, cells).orderBy(F.desc("cf"), "term").collect()]
        assert got == want
    kept = {w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:20]}
    tf = {(r.d, r.term): r.tf for r in vocabulary_counts(df, "d", F.col("k"), 20).collect()}
    assert tf == {(i, w): n for i, k in docs for w, n in Counter(k).items() if w in kept}


# segmentation ---------------------------------------------------------------------------------------------------------


def all_cuts(run, known):
    for cuts in itertools.product([False, True], repeat=len(run) - 1):
        words, start = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                words.append(run[start:i])
                start = i
        words.append(run[start:])
        if all(len(w) == 1 or w in known for w in words):
            yield words


def test_best_path_against_all_segmentations():
    from biblioflux.functions.segment import WordGraph

    rng = random.Random(5)
    for _ in range(60):
        letters = "经济学研究ab"
        known = {"".join(rng.choices(letters, k=rng.randint(1, 4))): rng.randint(1, 500) for _ in range(25)}
        g = WordGraph(known)
        for _ in range(8):
            run = "".join(rng.choices(letters, k=rng.randint(1, 9)))
            score = lambda words: sum(g.score.get(w, g.unknown) for w in words)  # noqa: B023, E731
            best = max(score(w) for w in all_cuts(run, known))
            got = g.path(run)
            assert "".join(got) == run and abs(score(got) - best) < 1e-9


def test_cut_of_mixed_text(spark):
    from biblioflux.functions import segment

    words = [("中国", 50), ("中国经济", 30), ("经济", 80), ("经济学", 60), ("研究", 90), ("学研", 1), ("AI", 5)]
    lexicon = spark.createDataFrame(words + [("经济", 3)], "word string, freq long")
    df = spark.createDataFrame([("中国经济学研究，GDP2020年 AI", ), ("", ), (None, ), ("  \n", )], "x string")
    cut = segment.word_segmenter(lexicon)
    got = [r[0] for r in df.select(cut("x")).collect()]
    assert got == [["中国", "经济学", "研究", "，", "GDP2020", "年", "AI"], [], None, []]
    segment.register_word_segmenter(spark, "cut_graph", lexicon)
    df.createOrReplaceTempView("graph_texts")
    assert [r[0] for r in spark.sql("SELECT cut_graph(x) FROM graph_texts").collect()] == got
    with pytest.raises(ValueError):
        segment.word_segmenter(lexicon, max_words=2)
    # a new word takes the suggested frequency to be kept whole
    graph = segment.WordGraph(dict(words))
    freq = segment.suggested_frequency(graph, "经济学研究")
    assert segment.WordGraph({**dict(words), "经济学研究": freq * 2}).path("经济学研究") == ["经济学研究"]


def test_tags_cut_unknown_runs(spark):
    from biblioflux.functions import segment

    df = spark.createDataFrame([(["甲乙", "丙", "甲乙"], ), (["丙", "甲乙", "丁戊己"], ), ([], ), (None, )], "w array<string>")
    tags = segment.fit_tags(df, "w")
    assert tags.first == {"B": 1, "S": 1} and tags.seen["B", "甲"] == 3 and tags.after["B", "E"] == 3 and tags.after["M", "E"] == 1
    assert tags.words("丙甲乙丙") == ["丙", "甲乙", "丙"] and tags.words("丁戊己甲乙") == ["丁戊己", "甲乙"] and tags.words("丙") == ["丙"]
    graph = segment.WordGraph({"研究": 5}, tags)
    assert graph.cut("研究甲乙丙研究x1") == ["研究", "甲乙", "丙", "研究", "x1"]


def test_mined_words_change_the_cut(spark):
    from biblioflux.functions import segment

    base = spark.createDataFrame([("全要素", 40), ("生产率", 60), ("企业", 90)], "word string, freq long")
    mined = spark.createDataFrame([("全要素生产率", ), ("全要素生产率", ), ("企业", )], "word string")
    df = spark.createDataFrame([("企业全要素生产率", )], "x string")
    wider = segment.extended(base, mined)
    assert {(r.word, r.freq) for r in wider.collect()} == {("全要素", 40), ("生产率", 60), ("全要素生产率", 1000), ("企业", 1000)}
    assert df.select(segment.word_segmenter(base)("x")).first()[0] == ["企业", "全要素", "生产率"]
    assert df.select(segment.word_segmenter(wider)("x")).first()[0] == ["企业", "全要素生产率"]


# lemmas ---------------------------------------------------------------------------------------------------------------


def test_lemmas_of_a_hand_written_list(spark):
    from biblioflux.operators import lemmas

    pairs = {
        "studies": "study", "analyses": "analysis", "boxes": "box", "classes": "class", "status": "status", "gas": "gas", "wolves": "wolf", "knives": "knife", "churches": "church", "wishes": "wish",
        "women": "woman", "countries": "country", "taxes": "tax", "prices": "price", "policies": "policy", "children": "child",
        "planned": "plan", "making": "make", "made": "make", "running": "run", "falling": "fall", "carried": "carry", "uses": "use", "used": "use", "missing": "miss", "stopped": "stop", "went": "go",
        "xyzzing": "xyzzing", "thing": "thing", "bring": "bring", "red": "red", "unknowns": "unknowns",
    }
    nouns = "study analysis box class status gas wolf knife church wish woman country tax price policy child plan use thing".split()
    verbs = "study box class wish tax price plan make run fall carry use miss stop go bring".split()
    lexicon = spark.createDataFrame([(w, "n") for w in nouns] + [(w, "v") for w in verbs], "word string, pos string")
    odd = spark.createDataFrame(lemmas.IRREGULAR, "form string, word string, pos string")
    terms = spark.createDataFrame([(w, ) for w in [*pairs, *pairs]] + [(None, )], "term string")
    got = {r.term: r.lemma for r in lemmas.lemmas(terms, lexicon, odd).collect()}
    assert got == pairs
    assert {r.term: r.lemma for r in lemmas.lemmas(terms, lexicon.limit(0)).collect()} == {w: w for w in pairs}


# phrases --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("max_chars,held", [(10_000_000, 200_000), (40, 1)])
def test_many_phrases_against_plain_counts(spark, max_chars, held):
    from biblioflux.operators.phrases import many_phrase_counts

    rng = random.Random(8)
    texts = [("".join(rng.choices("abc 经济", k=rng.randint(0, 60))), rng.choice([None, "AA aaa 经济经济", "b"])) for _ in range(40)]
    names = {"".join(rng.choices("abc 经济", k=rng.randint(1, 4))) for _ in range(60)} | {"aa", "a", "经济", "nowhere"}
    df = spark.createDataFrame(texts, "t string, a string")
    phrases = spark.createDataFrame([(p, ) for p in [*names, "aa", ""]] + [(None, )], "term string")
    want = Counter()
    for p in names:
        for x, y in texts:
            want[p] += 2 * x.lower().count(p) + (y or "").lower().count(p)
    got = {r.term: r.freq for r in many_phrase_counts(df, [(F.col("t"), 2), (F.col("a"), 1)], phrases, max_chars, held).collect()}
    assert got == {p: n for p, n in want.items() if n}
    assert many_phrase_counts(df, [(F.col("t"), 1)], phrases.limit(0)).count() == 0


# fits -----------------------------------------------------------------------------------------------------------------


def test_individual_fit_equals_the_grouped_one(spark):
    from biblioflux.functions.stats import multinomial_fit
    from biblioflux.operators import likelihood as lk

    rng = np.random.default_rng(4)
    rows = []
    for _ in range(1500):
        year, g = int(rng.integers(2020, 2026)), int(rng.integers(0, 2))
        p = np.exp(np.array([0.1 * (year - 2020), 0.3 * g, -0.05 * (year - 2020) * g, 0.0]))
        rows.append((year, g, "abcd"[rng.choice(4, p=p / p.sum())]))
    df = spark.createDataFrame(rows + [(2020, 1, None), (None, 1, "a")], "year int, g int, field string").repartition(5)
    one, t, group = lk.intercept(), lk.linear("year", 2020), lk.dummies("g", [0, 1])
    years = lk.dummies("year", list(range(2020, 2026)))
    designs = {"trend": one + t + group, "interaction": one + t + group + lk.crossed(group, t), "dummies": one + years + group, "all": one + years + group + lk.crossed(group, years)}
    cells = sorted({(y, g) for y, g, _ in rows})
    counts = np.array([[sum(1 for r in rows if r == (y, g, c)) for c in "abcd"] for y, g in cells], float)
    for name, design in designs.items():
        fit = lk.fit_multinomial(df, "field", design)
        x = np.array([[1.0, *{
            "trend": [y - 2020, g], "interaction": [y - 2020, g, g * (y - 2020)], "dummies": [*[float(y == k) for k in range(2021, 2026)], g],
            "all": [*[float(y == k) for k in range(2021, 2026)], g, *[g * float(y == k) for k in range(2021, 2026)]],
        }[name]] for y, g in cells])
        value, beta, ok = multinomial_fit(x, counts)
        assert ok and abs(fit.loglik - value) < 1e-8 * abs(value) and np.abs(fit.beta - beta).max() < 1e-5 and fit.n == 1500
    lr, k, p = lk.likelihood_ratio(lk.fit_multinomial(df, "field", designs["interaction"]), lk.fit_multinomial(df.where("year IS NOT NULL"), "field", designs["trend"]))
    assert k == 3 and lr > 0 and 0 <= p <= 1


def test_individual_fit_raises_without_a_maximum(spark):
    from biblioflux.operators import likelihood as lk

    apart = spark.createDataFrame([(x, "a" if x < 5 else "b") for x in range(10)], "x int, field string")
    with pytest.raises(lk.NotConverged):
        lk.fit_multinomial(apart, "field", lk.intercept() + lk.linear("x"))
    twice = spark.createDataFrame([(x, "ab"[x * 7 % 3 == 0]) for x in range(30)], "x int, field string")
    with pytest.raises(lk.NotConverged):
        lk.fit_multinomial(twice, "field", lk.intercept() + lk.linear("x") + lk.linear("x", 3))
    with pytest.raises(ValueError):
        lk.fit_multinomial(twice.where("field = 'a'"), "field", lk.intercept())


# chunks, streams, scopes ----------------------------------------------------------------------------------------------


def test_chunks(spark):
    from biblioflux.operators.chunks import chunk_texts

    df = spark.createDataFrame([(1, "one two, three four. five!"), (2, "short"), (3, None), (4, ""), (5, "  a b  ")], "d long, t string")
    got = {(r.d, r.chunk): (r.start, r.end, r.n_tokens, r.chunk_text) for r in chunk_texts(df, "d", "t", 2).collect()}
    assert got == {(1, 0): (0, 7, 2, "one two"), (1, 1): (9, 19, 2, "three four"), (1, 2): (21, 25, 1, "five"), (2, 0): (0, 5, 1, "short"), (3, 0): (0, 0, 0, ""), (4, 0): (0, 0, 0, ""), (5, 0): (0, 7, 2, "  a b  ")}
    by_char = chunk_texts(df.where("d = 2"), "d", "t", 2, lambda s: [(i, i + 1) for i in range(len(s))]).orderBy("chunk").collect()
    assert [r.chunk_text for r in by_char] == ["sh", "or", "t"]


def test_stream_classification_goes_on(spark, tmp_path):
    from biblioflux.streaming.classify import classify_stream, freeze

    docs = spark.createDataFrame([(i, ["x", "y"] if i % 2 else ["z", "q"]) for i in range(10)] + [(-1, ["x"]), (-2, ["z"])], "d long, k array<string>")
    seeds = spark.createDataFrame([(-1, 0, "X"), (-2, 1, "Z")], "d long, idx int, field string")
    model = freeze(docs, "d", F.col("k"), seeds)
    new = docs.where("d >= 0")
    new.where("d < 5").write.parquet(f"{tmp_path}/in/a")
    stream = spark.readStream.schema(new.schema).parquet(f"{tmp_path}/in/*")
    go = lambda: {r.d: r.raw_field for r in classify_stream(stream, "d", F.col("k"), model, "none", f"{tmp_path}/out", f"{tmp_path}/ck").collect()}
    assert go() == {i: "X" if i % 2 else "Z" for i in range(5)}
    new.where("d >= 5").write.parquet(f"{tmp_path}/in/b")
    assert go() == {i: "X" if i % 2 else "Z" for i in range(10)}


def test_scope_study(spark):
    from biblioflux.functions.rand import scope_seed
    from biblioflux.operators import inference, panel, resample, study

    rng = random.Random(1)
    rows = [(s, 2020 + i % 6, rng.choice("abbccc" if (i % 6) < 3 else "aabbcd")) for s in ("u", "v") for i in range(600)]
    p = panel.panel(spark.createDataFrame(rows, "scope string, year int, field string"), "year", "field", ["scope"])
    s = study.scope_study(p, ["u", "v"], 200, 100, 5)
    trends = {(r.scope, r.field): r for r in s.trends.collect()}
    alone = {r.field: r for r in inference.logit_trends(p.where("scope = 'v'").drop("scope")).collect()}
    assert len(trends) == 8 and all(abs(trends["v", f].q - r.q) < 1e-9 and trends["v", f].slope_low <= trends["v", f].slope_median for f, r in alone.items())
    boot = {r.field: r.cut_frequency for r in resample.bootstrap_trends(p.where("scope = 'v'").drop("scope"), 100, scope_seed(5, 1, True)).collect()}
    assert {r.field: r.cut_frequency for r in s.changes.where("scope = 'v'").collect()} == boot
    signals = study.key_signals(s, "a", "c", "d")
    assert signals.count() == 6 and {r.structure for r in signals.where("signal = 'linear trend'").collect()} == {"linear"}
    wide = {r.signal: (r.u, r.v) for r in study.by_scope(signals, ["u", "v"]).collect()}
    assert wide["linear trend"] == (trends["u", "a"].odds_ratio, trends["v", "a"].odds_ratio)
    tests = {r.scope: r for r in s.overall.collect()}
    assert tests["u"].converged and tests["u"].lr_df == tests["u"].chi2_df // 5 and abs(tests["u"].n - 600) == 0


def test_command_line_study_and_comparison(spark, tmp_path):
    from biblioflux.__main__ import main

    rng = random.Random(3)
    rows = [(2020 + i % 6, rng.choice("abbc"), rng.choice("abc"), rng.random() * 0.1, rng.random() * 0.02) for i in range(400)]
    df = spark.createDataFrame(rows, "year long, field string, raw_field string, score double, margin double")
    df.write.parquet(f"{tmp_path}/in")
    main(["study", "--input", f"{tmp_path}/in", "--output", f"{tmp_path}/out", "--permutations", "60", "--bootstraps", "40", "--seed", "5"], spark)
    trends = spark.read.parquet(f"{tmp_path}/out/trends")
    assert {r.scope for r in trends.select("scope").distinct().collect()} == {"final", "raw", "high_confidence"}
    text = (tmp_path / "out" / "report.md").read_text()
    assert "## Findings" in text and "Scope raw: 400 rows" in text and text.count("chi-square") == 3
    df.where("year > 2020").select((F.col("year") + 0).alias("year"), "field").write.parquet(f"{tmp_path}/other")
    main(["compare", "--cn", f"{tmp_path}/in", "--en", f"{tmp_path}/other", "--output", f"{tmp_path}/cmp"], spark)
    tests = spark.read.parquet(f"{tmp_path}/cmp/group_tests")
    assert tests.count() == 6 and {r.scope for r in tests.collect()} == {"all", "to_2024"}
    assert spark.read.parquet(f"{tmp_path}/cmp/interactions").count() == 6
