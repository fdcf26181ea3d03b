"""Each operator against a brute-force version, and over nulls, empty and long texts, ties, repeats and empty tables."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

SP, BPE = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string"
SYLLABLES = "an er in on re th st ea ti en at ou he nd or".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(i, prose(rng, rng.randint(30, 120)), "en" if i % 3 else "fr", f"s{i % 2}") for i in range(60)]
    base = out[3][1].split()
    out += [(100, out[3][1], "en", "s0"), (101, " ".join(base[:-1] + ["changed"]), "en", "s0"), (102, None, None, None), (103, "", "en", "s1"), (104, " \n\t ", None, "s1"), (105, "é日本 \U0001f600 x" * 40, "fr", "s0"), (106, "ab" * 20_000, "en", "s0"), (7, out[7][1], "en", "s1"), (None, "no id at all here", "en", "s1")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    from biblioflux.llm.common import connected_components

    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randint(100, 300), rng.randint(100, 300)) for _ in range(90)] + [(5, 5), (7, 8), (8, 7), (None, 3)]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    part = {}

    def find(x):
        while part.setdefault(x, x) != x:
            x = part[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            part[max(x, y)] = min(x, y)
    want = {x: find(x) for x in list(part)}
    assert got == want
    df = spark.createDataFrame(edges, "x long, y long")
    for kind, limit in (("long", 0), ("string", 0), ("string", 1000), ("binary", 1000)):
        same = df.select(*[F.lpad(F.col(c).cast("string"), 4, "0").cast(kind).alias(c) for c in ("x", "y")])
        rows = connected_components(same, "x", "y", driver_edges=limit).collect()
        assert len(rows) == len(want) and {int(bytes(r[0]) if kind == "binary" else r[0]): int(bytes(r[1]) if kind == "binary" else r[1]) for r in rows} == want
    assert connected_components(df.where("x < 0"), "x", "y").count() == 0


def test_token_counts_match_the_library(spark, docs, empty):
    import sentencepiece

    from biblioflux.llm.token_counts import RankMerger, count_tokens

    m = sentencepiece.SentencePieceProcessor(model_file=SP)
    rng = random.Random(2)
    parts = [" ", "a", "th", "e", "\n", "é", "日", "▁", "0", "=", "  ", "ing", "\U0001f600", "\x00", "\t", "<s>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["a" * 3000, " " * 500, "ab" * 2000]
    assert RankMerger(SP).counts(texts).tolist() == [len(x) for x in m.encode(texts)]
    small = RankMerger(SP, cache_words=10)
    assert small.counts(texts[:200]).tolist() == [len(x) for x in m.encode(texts[:200])]
    got = count_tokens(docs.withColumn("n_tokens", F.lit("clash")), SP).select("text", "n_tokens", "lang").collect()
    assert all(r["n_tokens"] == len(m.encode(r["text"] or "")) for r in got) and len(got) == docs.count()
    assert count_tokens(empty, SP).count() == 0


def test_encoder_and_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    from biblioflux.llm.packing import Encoder, best_fit_decreasing, local_search, pack_documents

    full = Tokenizer.from_file(BPE)
    rng = random.Random(3)
    parts = [" ", "a", "b", "é", "日", "0", "the", "ing", "\t", "\n", "'s", "'", " word", "  ", "<|endoftext|>", "\x1c", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    for e in (Encoder(BPE), Encoder(BPE, cache_words=5)):
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [x.ids for x in full.encode_batch(texts, add_special_tokens=False)]
    sizes = np.random.default_rng(0).integers(300, 1200, 800)
    first = best_fit_decreasing(sizes, 2048)
    better = local_search(sizes, first, 2048)
    assert np.bincount(better, sizes).max() <= 2048 and better.max() <= first.max()
    for low, high, n in ((300, 1200, 40), (1, 20, 300), (600, 800, 30)):  # at the end no step is left, or no fewer bins are possible
        sizes = np.random.default_rng(low).integers(low, high, n)
        bins = local_search(sizes, best_fit_decreasing(sizes, 2048), 2048)
        fill = np.bincount(bins, sizes)
        assert fill.max() <= 2048 and fill.min() > 0
        if len(fill) > math.ceil(sizes.sum() / 2048):
            for a in range(len(fill)):
                mine = [int(x) for x in sizes[bins == a]]
                leave = mine + [x + y for x, y in itertools.combinations(mine, 2)]
                for b in set(range(len(fill))) - {a}:
                    if fill[b] >= fill[a]:
                        assert fill[b] + min(mine) > 2048
                        assert not any(0 < s - c <= 2048 - fill[b] for s in leave for c in sizes[bins == b])
    got = pack_documents(docs, BPE, capacity=64, group_rows=20).toPandas()
    ids = {r["doc_id"]: full.encode(r["text"] or "", add_special_tokens=False).ids + [0] for r in docs.collect()}
    assert sum(len(full.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.collect()) == got.length.sum()
    for r in got.itertuples():
        want = ids[None if math.isnan(r.doc_id) else int(r.doc_id)][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes()) and len(want) == r.length
        assert r.length == 64 or r.piece == 0
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 64 and g.offset.tolist() == (g.length.cumsum() - g.length).tolist()
    assert pack_documents(empty, BPE).count() == 0


def test_sharding(spark, docs, empty):
    from biblioflux.llm.sharding import RoomTree, best_fit_decreasing, shard_groups

    rng = random.Random(4)
    tree, plain = RoomTree(), []
    for k in range(3000):
        if rng.random() < 0.6:
            room = rng.randint(1, 50)
            tree.insert(room, k)
            plain.append((room, k))
        else:
            size = rng.randint(1, 60)
            fit = min((x for x in plain if x[0] >= size), default=None)
            assert tree.take(size) == fit
            if fit:
                plain.remove(fit)
    sizes = np.array([rng.randint(1, 400) for _ in range(500)])
    bins, room, opened = best_fit_decreasing(sizes, 1000), [], 0
    for i in np.argsort(-sizes, kind="stable"):
        fit = min((x for x in room if x[0] >= sizes[i]), default=None)
        if fit:
            room.remove(fit)
        else:
            fit, opened = (1000, opened), opened + 1
        assert fit[1] == bins[i]
        if fit[0] > sizes[i]:
            room.append((fit[0] - sizes[i], fit[1]))
    keyed = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), "text", F.lit("x").alias("shard")).withColumn("size", F.col("size") + 1)
    got = shard_groups(keyed, ["text"], "size", 4).toPandas()
    assert len(got) == docs.count() and set(got.shard) <= set(range(4))
    assert (got.assign(text=got.text.fillna("~")).groupby("text").shard.nunique() == 1).all()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert shard_groups(empty.withColumn("size", F.lit(1)), ["text"], "size", 4).count() == 0


def test_language_id(spark, rows, docs, empty):
    from biblioflux.llm.lang_id import Scorer, fit, predict

    rng = random.Random(6)
    two = [(i, " ".join(rng.choice(("der die und ist nicht" if i % 2 else "the and of with not").split()) for _ in range(30)), "de" if i % 2 else "en", "s") for i in range(40)]
    labelled = spark.createDataFrame(two + [(90, None, "en", "s"), (91, "unlabelled", None, "s")], SCHEMA)
    model = fit(labelled)
    assert model.langs == ["de", "en"]
    test = spark.createDataFrame([(1, "Und nicht die", "x", "s"), (2, "andx thex", "x", "s"), (3, None, "x", "s"), (4, "123 ½ !", "x", "s"), (5, "", "x", "s"), (6, "日本", "x", "s")], SCHEMA)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in predict(test, model).collect()}
    assert [got[k][0] for k in range(1, 6)] == ["de", "en", "und", "und", "und"] and got[6][0] in ("de", "en")
    assert got[3][1] == got[4][1] == 0 and all(0 <= s <= 1 for _, s in got.values())
    s = Scorer(model, cache_words=1)
    assert s.score(["und nicht neu alt ganz"])[0] == ["de"]
    assert [r["lang_pred"] for r in predict(test, fit(empty)).collect()] == ["und"] * 6
    assert predict(empty, model).count() == 0
    back = s._backoff("undz")
    assert back[0] > back[1]


def test_lattice(spark, docs, rows, empty):
    from sentencepiece import sentencepiece_model_pb2 as pb

    from biblioflux.llm.lattice_lm import PieceTable, _lattice, fit, score

    m = pb.ModelProto()
    with open(SP, "rb") as f:
        m.ParseFromString(f.read())
    t = PieceTable.load(SP)
    names = [p.piece for p in m.pieces if p.type == 1]
    lp = dict(zip(names, t.logp, strict=True))

    def brute(x: str) -> float:
        if not x:
            return 1.0
        total = 0.0
        for k in range(1, len(x) + 1):
            if x[:k] in lp:
                total += math.exp(lp[x[:k]]) * brute(x[k:])
            elif k == 1:
                total += math.exp(sum(t.byte_logp[b] for b in x[0].encode())) * brute(x[1:])
        return total

    words = ["the", "éàx", "zq9", "international", "abሴ", "a"]
    assert np.allclose(_lattice(t, [w.encode() for w in words]), [math.log(brute("▁" + w)) for w in words])
    model = fit(docs.where("doc_id % 3 <> 0 OR doc_id IS NULL"), SP, rounds=1)
    c = Counter()
    for i, text, *_ in rows:
        if i is None or i % 3:
            c.update((text or "").encode().lower().split())
            c[None] += 1
    c = +c
    total, kinds = sum(c.values()), len(c)
    for hot in (250_000, 3):
        got = score(docs.withColumn("score", F.lit("clash")), model, hot_words=hot).collect()
        assert len(got) == len(rows)
        for r in got:
            text = next(x[1] for x in rows if x[0] == r["doc_id"])
            w = (text or "").encode().lower().split() + [None]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), total)
            assert math.isclose(r["base_score"], sum(math.log10((c[x] + 1) / (total + kinds + 1)) for x in w), rel_tol=1e-9)
            own = math.log10(model.end_share)
            for x in w[:-1]:
                own += math.log10(c[x] * model.whole_weight + model.spelled_weight * math.exp(_lattice(model.pieces, [x])[0]))
            assert math.isclose(r["score"], own, rel_tol=1e-9) and r["score"] < 0
    assert score(empty, model).count() == 0
    assert all(math.isfinite(r["score"]) for r in score(docs, fit(empty, SP)).collect())


def brute_groups(sets: dict, percent: int) -> dict:
    part = {i: i for i in sets}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    part[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def test_near_duplicates(spark, rows, docs, empty):
    from biblioflux.llm.minhash import near_duplicates, signatures

    rng = random.Random(8)
    base = prose(rng, 80).split()
    extra = []
    for i in range(40):  # copies of one original: near it, and far from one another
        w = list(base)
        for k in rng.sample(range(80), 5):
            w[k] = f"new{i}x{k}"
        extra.append((1000 + i, " ".join(w), "en", "s"))
    extra.append((1500, " ".join(base), "en", "s"))
    all_rows = rows + extra
    for n in (2, 5):
        got = near_duplicates(docs.unionByName(spark.createDataFrame(extra, SCHEMA)), ngram=n).collect()
        assert len(got) == len(all_rows)
        sets = {i: shingles(t, n) for i, t, *_ in all_rows if i is not None}
        want = brute_groups(sets, 80)
        for r in got:
            if r["doc_id"] is None:
                assert r["component_id"] is None and r["kept"]
            else:
                assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == want[r["doc_id"]])
                assert r["n_shingles"] == len(sets[r["doc_id"]])
    assert near_duplicates(empty).count() == 0
    a = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    s = signatures([a, a[:800], a[500:]], 256)
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.12 and abs((s[0] == s[2]).mean() - 0.5) < 0.15


def test_near_duplicates_one_id_with_two_texts(spark):
    from biblioflux.llm.minhash import near_duplicates

    rng = random.Random(15)
    a, b = prose(rng, 80), prose(rng, 80)
    rows = [(5, a, None, None), (5, b, None, None), (7, a + " end", None, None), (8, b + " end", None, None), (8, b + " end", None, None), (9, prose(rng, 80), None, None)]
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(5, 5, True), (5, 5, True), (7, 5, False), (8, 5, False), (8, 5, False), (9, 9, True)]


def test_near_duplicates_apart_from_the_leader(spark):
    """A large group whose members are too far from its middle, each with a copy that only the finer buckets join."""
    from biblioflux.llm.minhash import near_duplicates

    rng = random.Random(16)
    base = prose(rng, 200).split()
    rows = [(0, " ".join(base), None, None)]
    for i in range(1, 150):
        w = list(base)
        for k in rng.sample(range(200), 18):
            w[k] = f"v{i}x{k}"
        rows.append((i, " ".join(w), None, None))
        for j in range(i % 3):
            v = list(w)
            for k in rng.sample(range(200), 4):
                v[k] = f"u{i}x{j}x{k}"
            rows.append((1000 * (j + 1) + i, " ".join(v), None, None))
    want = brute_groups({i: shingles(t, 2) for i, t, *_ in rows}, 80)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), ngram=2).collect()}
    assert got == want and len(set(want.values())) > 100


def test_near_duplicates_in_one_bucket(spark, monkeypatch):
    """One bucket of all documents: links just at the threshold, between members that no leader links, are found there."""
    from biblioflux.llm import minhash

    rng = random.Random(18)
    base = [f"b{k}" for k in range(200)]
    rows = [(0, " ".join(base), None, None)] + [(2000 + i, " ".join(base) + f" end{i}", None, None) for i in range(10)]
    for i in range(1, 50):
        at = [k + 1 for k in rng.sample(range(0, 196, 2), 17)]
        w = base[:199]
        for k in at[:12]:
            w[k] = f"v{i}x{k}"
        v = list(w)
        for k in at[:6]:
            v[k] = base[k]
        for k in at[12:]:
            v[k] = f"u{i}x{k}"
        rows += [(i, " ".join(w), None, None), (1000 + i, " ".join(v), None, None)]
    sketch, key = minhash.sketch, lambda k: F.lit(k).cast("long")
    # the base and its copies are in a second bucket, so that one of them is the leader of the first
    monkeypatch.setattr(minhash, "sketch", lambda *a: sketch(*a).withColumn("bands", F.when(F.col("n_shingles") < 199, F.array(key(0))).otherwise(F.array(key(0), key(1)))))
    want = brute_groups({i: shingles(t, 2) for i, t, *_ in rows}, 80)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), ngram=2).collect()}
    assert len(set(want.values())) == 50 and got == want


def test_near_duplicates_copies_with_common_changes(spark, monkeypatch):
    """One bucket of copies that share some changes and are far from each other: few pairs are left to verify, no link is lost."""
    from biblioflux.llm import minhash

    rng = random.Random(21)
    base = [f"b{k}" for k in range(200)]
    rows = [(0, " ".join(base), None, None)] + [(2000 + i, " ".join(base) + f" end{i}", None, None) for i in range(10)]
    for i in range(1, 51):
        w = [f"z{k}" if k in range(180, 192, 2) else x for k, x in enumerate(base[:199])]
        at = rng.sample(range(1, 178, 2), 17)
        for k in at[:14]:
            w[k] = f"v{i}x{k}"
        v = [f"u{i}x{k}" if k in at[14:] else x for k, x in enumerate(w)]
        rows += [(i, " ".join(w), None, None), (1000 + i, " ".join(v), None, None)]
    sketch, key, open_pairs, left = minhash.sketch, lambda k: F.lit(k).cast("long"), minhash._open_pairs, []
    monkeypatch.setattr(minhash, "sketch", lambda *a: sketch(*a).withColumn("bands", F.when(F.col("n_shingles") < 199, F.array(key(0))).otherwise(F.array(key(0), key(1)))))

    def counted(*a):
        left.append((out := open_pairs(*a)).distinct().count())
        return out

    monkeypatch.setattr(minhash, "_open_pairs", counted)
    want = brute_groups({i: shingles(t, 2) for i, t, *_ in rows}, 80)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), ngram=2).collect()}
    assert len(set(want.values())) == 51 and got == want and 0 < sum(left) < 300, left


def levenshtein(x: str, y: str) -> int:
    p = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        q = [i]
        for j, e in enumerate(y, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (c != e)))
        p = q
    return p[-1]


def test_fuzzy_lines(spark, empty):
    from biblioflux.llm.line_dedup import MIN_CHARS, SIMILARITY, dedup_lines

    rng = random.Random(9)
    base = [prose(rng, 40) for _ in range(6)]
    rows = []
    for i in range(30):
        lines = []
        for _ in range(rng.randint(1, 5)):
            x = rng.choice(base)
            if rng.random() < 0.6:
                k = rng.randrange(len(x))
                x = x[:k] + rng.choice("xyz") + x[k + rng.randint(0, 1) :]
            lines.append(rng.choice((x, x.upper(), x + "!", "", "Short.", prose(rng, 8))))
        rows.append((i, "\n".join(lines), "en", "s"))
    rows += [(50, None, None, None), (51, "", None, None), (None, base[0], None, None), (3, rows[3][1], "en", "s")]
    got = dedup_lines(spark.createDataFrame(rows, SCHEMA).withColumn("n_lines", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    norm = lambda x: re.sub(r"[\W_]+", " ", x.lower()).strip()
    order = sorted({(i is not None, i or 0, t) for i, t, *_ in rows if t is not None})
    all_lines = [(key, k, x, norm(x)) for key in order for k, x in enumerate(key[2].split("\n"))]
    kinds = sorted({n for *_, n in all_lines if n})
    part = {n: n for n in kinds}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a in kinds:
        for b in kinds:
            if a < b and min(len(a), len(b)) >= MIN_CHARS:
                longest = max(len(a), len(b))
                if min(len(a), len(b)) >= SIMILARITY * longest and levenshtein(a, b) <= int(longest * (1 - SIMILARITY) + 1e-9):
                    part[find(a)] = find(b)
    seen, want = set(), {}
    for key, _, x, n in all_lines:
        if not n or find(n) not in seen:
            want.setdefault(key, []).append(x)
        if n:
            seen.add(find(n))
    assert len(seen) < len(kinds)
    for r in got:
        text = next(t for i, t, *_ in rows if i == r["doc_id"])
        if text is None:
            assert r["text"] is None and r["n_lines"] == 0
        else:
            assert r["text"] == "\n".join(want.get((r["doc_id"] is not None, r["doc_id"] or 0, text), []))
    assert dedup_lines(empty).count() == 0


def _edited(rng: random.Random, x: str, n: int) -> str:
    s = list(x)
    for _ in range(n):
        k, op = rng.randrange(len(s)), rng.random()
        if op < 0.5:
            s[k] = rng.choice("abcdefghijklmnopqrstuvwxyz")
        elif op < 0.75:
            s.insert(k, rng.choice("abcdefghijklmnopqrstuvwxyz"))
        else:
            del s[k]
    return " ".join("".join(s).split())


def test_fuzzy_lines_recall(spark):
    """Keys shared by lines within the edit similarity, which is measured apart: lines of every length with one edit, with
    words changed, and with letters changed all over."""
    from biblioflux.llm.line_dedup import SIMILARITY, with_keys

    rng = random.Random(4)
    pairs = []
    for low, high in ((10, 20), (20, 30), (30, 50), (50, 100), (100, 200), (200, 500)):
        for _ in range(200):
            x = prose(rng, high)[: rng.randrange(low, high)].strip()
            y = x.split()
            for k in rng.sample(range(len(y)), max(1, len(y) // 20)):
                y[k] = prose(rng, 1)
            pairs += [(low, "one", x, _edited(rng, x, 1)), (low, "words", x, " ".join(y)), (low, "all over", x, _edited(rng, x, max(1, len(x) // 50)))]
    pairs = [p for p in pairs if min(len(p[2]), len(p[3])) >= 10 and p[2] != p[3]]
    df = spark.createDataFrame(pairs, "low long, kind string, x string, y string")
    df = df.where(F.levenshtein("x", "y") <= F.floor(F.greatest(F.length("x"), F.length("y")) * (1 - SIMILARITY) + 1e-9))
    df = df.where("kind <> 'one' OR levenshtein(x, y) = 1")
    df = with_keys(with_keys(df, "x").withColumnRenamed("keys", "kx"), "y")
    got = {(r["low"], r["kind"]): r["share"] for r in df.groupBy("low", "kind").agg(F.avg(F.arrays_overlap("kx", "keys").cast("int")).alias("share")).collect()}
    assert all(got[low, "one"] == 1 for low in (10, 20, 30, 50)) and min(got[100, "one"], got[200, "one"]) >= 0.98, got
    assert all(got[low, "words"] >= 0.95 and got[low, "all over"] >= 0.9 for low in (30, 50, 100, 200)) and got[20, "words"] >= 0.85, got


def test_fuzzy_lines_large_groups(spark):
    """Large buckets: many lines far from the one in the middle, and copies of these that only finer buckets can find."""
    from biblioflux.llm.line_dedup import dedup_lines

    rng = random.Random(14)
    base = prose(rng, 60).split()
    rows = [(0, " ".join(base), None, None)]
    for i in range(1, 120):
        w = list(base)
        for k in rng.sample(range(60), 10):
            w[k] = prose(rng, 1)
        rows.append((i, " ".join(w), None, None))
        if i % 2:
            rows.append((1000 + i, _edited(rng, rows[-1][1], 4), None, None))
    texts = {i: t for i, t, *_ in rows}
    part = {i: i for i in texts}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    df = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text")
    pairs = df.join(df.toDF("b", "t"), F.col("doc_id") < F.col("b")).where("levenshtein(text, t) <= int(greatest(length(text), length(t)) * 0.1 + 1e-9)")
    for r in pairs.collect():
        x, y = find(r["doc_id"]), find(r["b"])
        part[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["n_removed"] for r in dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    wrong = [i for i in texts if got[i] != (find(i) != i)]
    assert len(wrong) <= 2 and sum(got.values()) > 50


def test_fuzzy_lines_in_one_bucket(spark, monkeypatch):
    """One bucket of all lines: pairs within the similarity with edits all over, which share few runs, are found there."""
    from biblioflux.llm import line_dedup

    rng = random.Random(19)
    rows = []
    for i in range(30):
        x = prose(rng, 20 + i)
        rows += [(i, x, None, None), (1000 + i, _edited(rng, x, len(x) // 11), None, None)]
    assert all(levenshtein(a[1], b[1]) <= int(max(len(a[1]), len(b[1])) * 0.1 + 1e-9) for a, b in zip(rows[::2], rows[1::2], strict=True))
    keys = line_dedup.with_keys
    monkeypatch.setattr(line_dedup, "with_keys", lambda *a: keys(*a).withColumn("keys", F.array(F.lit(0).cast("long"))))
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: int(i >= 1000) for i, *_ in rows}


def test_fuzzy_lines_families_in_one_bucket(spark, monkeypatch):
    """One bucket of several families of near copies: few of all their pairs are left for the last, exact step."""
    from biblioflux.llm import line_dedup

    rng = random.Random(20)
    rows = []
    for f in range(5):
        x = prose(rng, 20)
        copies = {x} | {_edited(rng, x, 1) for _ in range(50)}
        rows += [(1000 * f + i, y, None, None) for i, y in enumerate(sorted(copies))]
    keys, open_pairs, left = line_dedup.with_keys, line_dedup._open_pairs, []
    monkeypatch.setattr(line_dedup, "with_keys", lambda *a: keys(*a).withColumn("keys", F.array(F.lit(0).cast("long"))))

    def counted(*a):
        left.append((out := open_pairs(*a)).count())
        return out

    monkeypatch.setattr(line_dedup, "_open_pairs", counted)
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: int(i % 1000 > 0) for i, *_ in rows} and sum(left) < 500, left


def test_fuzzy_long_lines_with_common_words(spark, monkeypatch):
    """One bucket of long lines that share half of their words: few pairs are left to verify, links between such lines are found."""
    from biblioflux.llm import line_dedup

    rng = random.Random(22)
    common = [f"common{k}" for k in range(75)]
    rows = []
    for i in range(40):
        w = common + [f"v{i:02}x{k:02}" for k in range(75)]
        v = [f"u{i:02}x{k:02}" if k in at else x for at in [rng.sample(range(150), 15)] for k, x in enumerate(w)]
        rows += [(i, " ".join(w), None, None), (1000 + i, " ".join(v), None, None)]
    keys, open_pairs, left = line_dedup.with_keys, line_dedup._open_pairs, []
    monkeypatch.setattr(line_dedup, "with_keys", lambda *a: keys(*a).withColumn("keys", F.array(F.lit(0).cast("long"))))

    def counted(*a):
        left.append((out := open_pairs(*a)).distinct().count())
        return out

    monkeypatch.setattr(line_dedup, "_open_pairs", counted)
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: int(i >= 1000) for i, *_ in rows}
    assert 0 < sum(left) < 200, left


def test_fuzzy_lines_are_normalised_once(spark, monkeypatch):
    """The text of lines with common keys comes from the table of lines, not from the documents again."""
    from biblioflux.llm import line_dedup

    rng = random.Random(23)
    x = [prose(rng, 30) for _ in range(4)]
    rows = [(i, f"{a}\n\n{a.upper()}!\nown line {i}", None, None) for i, a in enumerate(x)] + [(10 + i, _edited(rng, a, 1), None, None) for i, a in enumerate(x)]
    normalised, calls = line_dedup.normalised, []
    monkeypatch.setattr(line_dedup, "normalised", lambda c: calls.append(c) or normalised(c))
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    own = ["own line 0"] + [""] * 3  # the others are one edit away from it
    assert got == {i: ("\n".join([a, "", own[i]] if own[i] else [a, ""]), 1 + (i > 0)) for i, a in enumerate(x)} | {10 + i: ("", 1) for i in range(4)}
    assert len(calls) == 1


def test_fuzzy_lines_make_keys_and_verify_pairs_once(spark, monkeypatch):
    """Equal lines get their keys once, and no pair of one bucket that an early round has parted is verified in a later one."""
    from biblioflux.llm import line_dedup

    rng = random.Random(24)
    base = prose(rng, 40).split()
    rows = [(i, " ".join(prose(rng, 1) if k in at else w for k, w in enumerate(base)), None, None) for i in range(40) for at in [rng.sample(range(40), 8)]]
    rows += [(100 + i, t, None, None) for i, t, *_ in rows]
    keys, groups, made, pairs = line_dedup.with_keys, line_dedup.linked_groups, [], []

    def one_bucket(lines, *a):
        made.append(lines.count())
        return keys(lines, *a).withColumn("keys", F.array(F.lit(0).cast("long")))

    def watched(members, verify, *a, **k):
        return groups(members, lambda p: pairs.extend((r["a"], r["b"]) for r in p.collect()) or verify(p), *a, **k)

    monkeypatch.setattr(line_dedup, "with_keys", one_bucket)
    monkeypatch.setattr(line_dedup, "linked_groups", watched)
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: int(i >= 100) for i, *_ in rows}
    assert made == [40] and len(pairs) > 100 and len(pairs) == len(set(pairs)), (made, len(pairs), len(set(pairs)))


def test_decontamination(spark, empty):
    from biblioflux.llm import decontaminate as D

    rng = random.Random(10)
    items = [(i, prose(rng, 30)) for i in range(8)] + [(20, None), (21, "tiny"), (None, prose(rng, 30))]
    rows, want = [], {}
    for i in range(40):
        text = prose(rng, 60)
        if i % 4 == 0:
            item = items[i // 4 % 8]
            s = list(item[1].upper())
            codes, _ = D.normalise(item[1])
            for _ in range(D.edit_budget(len(codes), D.Q, D.EDIT_RATE)):
                k = rng.randrange(len(s))
                op = rng.random()
                if op < 0.4:
                    s[k] = rng.choice("qxz")
                elif op < 0.7:
                    s.insert(k, "q")
                else:
                    del s[k]
            text = f"{prose(rng, rng.randint(0, 20))} -- {''.join(s)} -- {prose(rng, 20)}"
            want[i] = item[0]
        rows.append((i, text, "en", "s"))
    rows += [(50, None, None, None), (51, "", None, None), (52, "na" * 30_000, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("matches", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for chars in (4_000_000, 300):
        got = {r["doc_id"]: {m["item_id"] for m in r["matches"]} for r in D.mark(docs, bench, index_chars=chars).collect()}
        assert got == {r[0]: {want[r[0]]} if r[0] in want else set() for r in rows}
    assert D.mark(empty, bench).count() == 0
    assert all(not r["matches"] for r in D.mark(docs, bench.limit(0)).collect())
    h = D.gram_hashes(np.frombuffer("abcabcabcd".encode("utf-32-le"), np.uint32), 3)
    assert h[0] == h[3] and h[1] == h[4] and len(set(h.tolist())) == 4


def brute_stats(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    hit = {p for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
    return len(w), sum(map(len, w)), sum((text or "").count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_outliers(spark, rows, docs, empty):
    from biblioflux.llm import outliers as O

    rng = random.Random(11)
    clean = [(1000 + i, prose(rng, rng.randint(40, 90)), "en", "a") for i in range(150)]
    junk = [(2000 + i, " ".join(f"{w}###" for w in prose(rng, 50).split()), "en", "a") for i in range(10)]
    loops = [(3000, prose(rng, 10) + " " + " ".join([prose(random.Random(1), 12)] * 4), "en", "a"), (3001, "x | y\nx | y\n\nz", "en", "a")]
    data = rows + clean + junk + loops
    got = O.judge(spark.createDataFrame(data, SCHEMA).withColumn("kept", F.lit("clash"))).collect()
    assert len(got) == len(data)
    texts = Counter((i, *brute_stats(t)) for i, t, *_ in data)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == texts
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["kept"] for i, *_ in clean) and not any(by[i]["kept"] for i, *_ in junk)
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in got)
    assert not any(r["kept"] and r["base_failed"] for r in got) and O.judge(empty).count() == 0
    assert abs(O._chi2_tail(O._chi2_point(0.05, 4), 4) - 0.05) < 1e-9 and abs(O._chi2_point(0.05, 4) - 9.487729) < 1e-5


def test_outliers_repeated_lines(spark):
    """In a clean group, half of the lines repeated (short lines, so few words are in repeated windows) is too much; one of
    twenty is not."""
    from biblioflux.llm import outliers as O

    rng = random.Random(13)
    lines = lambda n: [prose(rng, 12) for _ in range(n)]
    data = [(i, "\n".join(lines(rng.randint(6, 12))), "en", "a") for i in range(150)]
    for i in range(4):
        head = [prose(rng, 3) for _ in range(5)]
        body = [x for k in range(10) for x in (prose(rng, 9), head[k % 5])]
        data.append((1000 + i, "\n".join(body + [rng.choice(head) for _ in range(10)]), "en", "a"))
        one = lines(20)
        data.append((2000 + i, "\n".join([*one, prose(rng, 3), *one[:1]]), "en", "a"))
    by = {r["doc_id"]: r for r in O.judge(spark.createDataFrame(data, SCHEMA)).collect()}
    assert not any(by[1000 + i]["base_failed"] or by[2000 + i]["base_failed"] for i in range(4))
    assert all(2 * by[1000 + i]["n_dup_lines"] >= 15 and not by[1000 + i]["kept"] for i in range(4))
    assert all(by[i]["kept"] for i in range(150)) and all(by[2000 + i]["kept"] for i in range(4))


def test_outlier_estimates_against_numpy(spark):
    from biblioflux.llm import outliers as O

    g = np.random.default_rng(0)
    x = g.normal(size=(400, 4)) @ np.diag([0.3, 0.2, 0.4, 0.5]) + [1, 2, 3, 4]
    x[:40] += 5
    df = spark.createDataFrame([("k", *map(float, r)) for r in x], "key string, x_word double, x_symbol double, x_lines double, x_repeat double")
    m = O.estimates(df).first()
    assert np.allclose([m[f"m{i}"] for i in range(4)], x[40:].mean(axis=0), atol=0.1)
    low = np.array([[m[f"l{i}{j}"] if j <= i else 0 for j in range(4)] for i in range(4)])
    assert np.allclose(np.diag(low @ low.T), x[40:].var(axis=0) + np.array(list(O.FLOORS.values())) ** 2, rtol=0.35)


def test_link_graph(spark, empty):
    from biblioflux.llm import link_graph as G

    urls = ["http://A.net/x", "https://b.example.net/en/?q#f", "x://c.example.com/de/z", "d.org/fr/", None, "http://d.org", "http://d.org/fr?x", "http://user@e.org:80/p#://q", "://"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    rules = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    got = {r["page_id"]: r for r in G.judge_pages(pages.withColumn("host", F.lit("clash")), rules).collect()}
    assert [(got[i]["host"], got[i]["path"]) for i in range(9)] == [("a.net", "/x"), ("b.example.net", "/en/"), ("c.example.com", "/de/z"), ("", ""), ("", ""), ("d.org", ""), ("d.org", "/fr"), ("user@e.org:80", "/p"), ("", "")]
    assert [(got[i]["rule"], got[i]["verdict"]) for i in range(9)] == [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), *[(None, "allow")] * 6]
    edges = [(0, 1), (1, 2), (2, 0), (3, 0), (4, 3), (0, 4)]
    name = "a.net b.org c.org d.org e.org".split()
    html = lambda i: "".join(f'<a href="//{name[b].upper()}/x">' for a, b in edges if a == i)
    graph = spark.createDataFrame([(i, f"http://{name[i]}/", html(i)) for i in range(5)], "page_id long, url string, html string")
    ranks = {r["host"]: (r["trust"], r["distrust"], r["verdict"]) for r in G.judge_pages(graph, [("net/", "block"), ("c.org/", "allow")]).collect()}

    def brute(links, seed, n=5, d=0.85, rounds=20):
        s = np.zeros(n)
        s[seed] = 1
        r = s.copy()
        for _ in range(rounds):
            new = (1 - d) * s
            for a, b in links:
                new[b] += d * r[a] / sum(x == a for x, _ in links)
            r = new
        return r

    t, u = brute(edges, 2), brute([(b, a) for a, b in edges], 0)
    for i, h in enumerate(name):
        assert abs(ranks[h][0] - t[i]) < 1e-8 and abs(ranks[h][1] - u[i]) < 1e-8
    assert ranks["d.org"][2] == ("block" if u[3] > t[3] else "allow")
    assert G.judge_pages(pages.limit(0), rules).count() == 0


def test_link_graph_verdicts_do_not_depend_on_size(spark):
    from biblioflux.llm import link_graph as G

    def verdicts(k):
        i = F.col("id")
        page = lambda tld, to: F.struct(F.concat(F.lit("http://h"), i, F.lit(f".{tld}/")).alias("url"), F.concat(*[x for t in to for x in (F.lit('<a href="//h'), i, F.lit(f'.{t}/">'))], F.lit("")).alias("html"))
        pages = spark.range(k).select(F.explode(F.array(page("org", ["net"]), page("net", []), page("com", ["de", "fr"]), page("de", ["net"]), page("fr", []))).alias("p")).select("p.*")
        out = G.judge_pages(pages, [("net/", "block"), ("com/", "allow")])
        return {tuple(r) for r in out.select(F.substring_index("host", ".", -1), "verdict").distinct().collect()}

    assert verdicts(1) == verdicts(3000) and ("org", "block") in verdicts(1)


def test_link_graph_seeds_by_share(spark):
    """Four of ten pages blocked: the host is a seed by that share, and distrust reaches the host that links to it."""
    from biblioflux.llm import link_graph as G

    rows = [(i, f"http://a.org/{'bad' if i < 4 else 'x'}/{i}", None) for i in range(10)] + [(10, "http://b.org/", '<a href="//a.org/">')]
    got = {r["page_id"]: r for r in G.judge_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), [("a.org/bad", "block")]).collect()}
    assert abs(got[9]["distrust"] - 0.4 * 0.15) < 1e-8 and abs(got[10]["distrust"] - 0.4 * 0.15 * 0.85) < 1e-8
    assert got[10]["verdict"] == "block"
