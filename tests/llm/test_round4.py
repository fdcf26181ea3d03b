"""Centroid clustering, source divergence and files of ids against plain versions, and over odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

WORD = P.path("word_bpe_49k.json")


# clustering -----------------------------------------------------------------------------------------------------------


def plain_clusters(rows, k, rounds, scale=1024, dim=4, seed=3):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    vecs = [(i, [math.floor(float(np.float32(x)) * scale) for x in v]) for i, v in kept]
    order = sorted(range(len(vecs)), key=lambda j: (hashlib.sha256(f"{seed}:{'' if vecs[j][0] is None else vecs[j][0]}".encode()).hexdigest(), kept[j][1]))
    centroids = [vecs[j][1] for j in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in vecs:
            groups[near(v)[1]].append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if groups[j] else c for j, c in enumerate(centroids)]
    return sorted(((-1 if i is None else i), *reversed(near(v))) for i, v in vecs), centroids


def vectors(n, seed, dim=4, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(12)]
    return [(i, [x + rng.gauss(0, spread) for x in rng.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("k,bounds,rounds", [(8, None, 10), (8, 1, 6), (12, 3, 6), (3, 2, 5), (1, None, 3), (2, None, 0)])
def test_clusters_equal_plain_rounds(spark, k, bounds, rounds):
    from biblioflux.llm.centroids import cluster_vectors

    rows = vectors(300, k, spread=0.4) + [(1000 + i, [0.25, 0.5, -0.5, 0.0]) for i in range(40)]  # repeats
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    found = cluster_vectors(df, k=k, rounds=rounds, dim=4, bounds=bounds)
    want, centroids = plain_clusters([(i, [float(np.float32(x)) for x in v]) for i, v in rows], k, rounds)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in found.vectors.collect()) == want
    assert found.centroids == centroids
    if k == 8 and bounds is None:  # most vectors keep their place by their bounds alone
        assert len(found.measured) == 10 and found.measured[-1][0] + found.measured[-1][1] < 200


def test_clusters_of_odd_rows(spark):
    from biblioflux.llm.centroids import cluster_vectors, with_inertia

    rows = [(1, [1.0, 2.0, 3.0, 4.0]), (1, [1.0, 2.0, 3.0, 4.5]), (2, None), (3, [1.0, None, 2.0, 3.0]), (4, [1.0, 2.0]), (5, [float("nan")] * 4), (6, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.0, 0.0, -0.0, -0.1])]
    rows += [(7, [3e38, 1.0, 1.0, -3e38]), (8, [2.5e38, 1.0, 0.0, -3e38]), (9, [])] + [(20 + i, [float(i % 2)] * 4) for i in range(30)]  # ties
    df = spark.createDataFrame([(*r, 5, "x", 1) for r in rows], "vec_id long, embedding array<float>, cluster int, distance string, `a``b` int").repartition(3)
    found = cluster_vectors(df, k=5, rounds=4, dim=4)
    want, centroids = plain_clusters([(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 5, 4)
    want = [(i, c, d if d < 1 << 63 else None) for i, c, d in want]
    key = lambda r: (r[0], r[1], r[2] is None, r[2] or 0)
    assert sorted(((-1 if r.vec_id is None else r.vec_id), r.cluster, r.distance) for r in found.vectors.collect()) == sorted(want, key=key) and found.centroids == centroids
    out = with_inertia(found).collect()
    if any(w[2] is None for w in want):
        assert {r.inertia for r in out} == {None}
    assert with_inertia(cluster_vectors(df.limit(0))).count() == 0
    assert cluster_vectors(df.where("vec_id = 4")).vectors.count() == 0
    named = df.where("vec_id = 1").select(F.col("vec_id").alias("v`1"), F.col("embedding").alias("id"))
    assert cluster_vectors(named, "v`1", "id", dim=4).vectors.columns == ["v`1", "id", "cluster", "distance"]


def test_inertia_and_hash(spark):
    from biblioflux.llm.centroids import cluster_vectors, with_inertia

    found = cluster_vectors(spark.createDataFrame(vectors(100, 4), "vec_id long, embedding array<double>"), k=4, rounds=3, dim=4)
    out = with_inertia(found).collect()
    assert {r.inertia for r in out} == {sum(r.distance for r in out)}
    for r in out:
        assert r.cluster_inertia == sum(x.distance for x in out if x.cluster == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, found.centroids[r.cluster])).encode()).hexdigest()


# divergence -----------------------------------------------------------------------------------------------------------


def plain_divergence(rows, min_docs, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = [tuple(x or "" for x in r) for r in rows]
    words = [(g, s, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(lower))) for g, s, t in rows]
    df, group = defaultdict(Counter), defaultdict(Counter)
    for g, s, w in words:
        df[g].update(set(w))
        group[g, s].update(w)
    out = []
    for g, s in group:
        kept = [t for t, n in df[g].items() if n >= min_docs]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[u] for u in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        mine, whole = share(group[g, s]), share(sum((c for (h, _), c in group.items() if h == g), Counter()))
        pairs = [(sum(abs(mine[t] - o[t]) for t in kept), x) for (h, x), o in ((k, share(c)) for k, c in group.items() if k[0] == g and k[1] != s)]
        terms = [(mine[t] - whole[t], t) for t in kept if group[g, s][t] and mine[t] > whole[t]]
        for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(g, s, part, x, v, r) for r, (v, x) in enumerate(found[:most], 1)]
    return sorted(out)


def test_divergence_equals_all_pairs_of_terms(spark, monkeypatch):
    from biblioflux.llm import divergence

    rng = random.Random(2)
    vocab = ["alpha", "Beta", "été", "日本", "x", "ZZ", "ÀÉ", "foo", "bar", "naïve", "\U0001f600q"] + [f"w{c}" for c in "abcdefghij"]
    rows = [(rng.choice(["en", "en", "fr", None]), rng.choice(["s1", "s1", "s1", "s2", "s3", "é", None]), " ,-1\n".join(rng.choices(vocab, [1 + 9 * (i % 4 == 0) for i in range(len(vocab))], k=rng.randint(0, 25)))) for _ in range(250)]
    rows += [("en", "silent", None), ("en", "blank", ""), ("de", "few", "alpha beta"), ("de", "other", None), ("it", "alone", "alpha " * 9), (None, None, None)] + [("en", "s1", "alpha beta alpha")] * 12
    df = spark.createDataFrame([(*r, 1, 2, "y") for r in rows], "lang string, source string, text string, n int, p int, `te``rm` string").repartition(4)
    for min_docs, top in ((5, 4), (30, 50), (10_000, 50)):
        want = plain_divergence(rows, min_docs, top)
        assert sorted(map(tuple, divergence.source_divergence(df, min_docs=min_docs, top=top).collect())) == want
    assert divergence.source_divergence(df.limit(0)).count() == 0
    # counts handed on early, and texts cut into slices, make no difference
    names = ["l`1", "s", "x"]
    renamed = df.select(*[F.col(a).alias(b) for a, b in zip(("lang", "source", "text"), names, strict=True)])
    assert sorted(map(tuple, divergence.source_divergence(renamed, *names, min_docs=5, top=4).collect())) == plain_divergence(rows, 5, 4)


def test_divergence_counts_in_slices(monkeypatch):
    import pyarrow as pa
    from biblioflux.llm import divergence

    rng = random.Random(3)
    text = " ".join("".join(rng.choices("abcé", k=3)) for _ in range(4000)) + "x" * 3000
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 3), pa.array(["s"] * 3), pa.array([text, "", text])], names=["a", "b", "c"])
    monkeypatch.setattr(divergence, "SLICE", 100)
    monkeypatch.setattr(divergence, "HELD", 10)
    n, docs, rows = Counter(), Counter(), 0
    for out in divergence._count(iter([batch, batch])):
        for r in out.to_pylist():
            n[r["term"]] += r["n"]
            docs[r["term"]] += r["docs"]
    assert n == Counter(text.split() * 4) + Counter({None: 0}) and docs.pop(None) == 6 and set(docs.values()) == {4}


# files of ids ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD)


HARD = ["", " ", "Hello<|endoftext|>World <|startoftext|>x", "é é ́x a b c\x1c\x1d", "ΑΣ ΟΔΟΣ İstanbul ﬁ ½ 日本語 \U0001f600\U0001f600 ‍", "don't I'll 'S x's'd", "tab\tnl\nvt\x0bff\x0c\x85 nel", "a" * 3000, "123 45.6 $$$ |", "\x01 a\x01b", "<|endoftext|", " lead", "trail "]


def test_word_encoder_equals_the_library(library):
    import pyarrow as pa
    from biblioflux.llm.binary_ids import WordEncoder

    rng, e = random.Random(7), WordEncoder(WORD)
    assert e.by_word and e.fast is not None
    letters = "abcdefghijklmnopqrstuvwxyzABCXYZ0123456789'éÉßÖñŒƒǅ.,;:!?-_$%#@()[] ́Σς日\x01\x1c    \n"
    vocab = [w.replace("</w>", "") for w in library.get_vocab()]
    texts = HARD + ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(400)] + ["".join(rng.choices(vocab, k=3)) for _ in range(400)]
    for some in (texts, texts[:1], [], ["plain words only", "", "more words"]):
        ids, counts = e.encode(pa.array([t.encode() for t in some], pa.binary()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts))[:-1]] == [library.encode(t, add_special_tokens=False).ids for t in some]
    sliced = pa.array([t.encode() for t in texts], pa.binary()).slice(5, 3)
    assert e.encode(sliced)[1].tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts[5:8]]


def test_blocks_round_trip():
    from biblioflux.llm.binary_ids import Piece, decode_blocks, encode_block

    rng = np.random.default_rng(3)
    for top, n in ((5, 40), (200, 900), (70_000, 90_000), (1 << 31, 3000)):
        if top == 1 << 31:  # sparse ids
            ids = rng.choice(rng.integers(0, 1 << 22, 400), n).astype(np.uint32)
        else:
            ids = rng.integers(0, top, n).astype(np.uint32)
        cut = np.split(ids, [3, 3, n // 2])
        pieces = [Piece(None if i == 1 else str(i).encode(), x, i != 2) for i, x in enumerate(cut)]
        raw = encode_block(pieces, 9, 0) + b"\n" + encode_block(pieces[:1], 9, 1) + b"\n" + encode_block([], 9, 2) + b"\n"
        got = list(decode_blocks(raw))
        assert [g[0] for g in got] == [9, 9, 9] and [len(g[1]) for g in got[:2]] == [4, 1]
        assert all(a.name == b.name and a.ends == b.ends and (a.ids == b.ids).all() for a, b in zip(pieces, got[0][1], strict=True))
    with pytest.raises(ValueError):
        next(decode_blocks(b"x" * 50))


def test_coding_is_short_for_frequent_ids():
    from biblioflux.llm.binary_ids import Piece, encode_block

    ids = np.full(10_000, 49_000, np.uint32)
    assert len(encode_block([Piece(b"1", ids, True)], 0, 0)) < 10_000 * 1.25 + 100


@pytest.mark.parametrize("file_bytes,block_ids", [(1 << 26, 1 << 22), (2000, 50), (300, 7)])
def test_files_of_ids(spark, tmp_path, library, file_bytes, block_ids):
    from biblioflux.llm.binary_ids import read_ids, write_ids

    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["the", "of", "zebra", "qux", "été"]) for _ in range(rng.randint(0, 60)))) for i in range(80)]
    rows += [(100 + i, t) for i, t in enumerate(HARD)] + [(7, "twice"), (7, "twice"), (7, None), (None, "no id"), (-5, "first"), (300, "hot copy")] + [(300, "hot copy")] * 40
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, m int, `i``d` string").repartition(5)
    path = str(tmp_path / "ids")
    write_ids(df, path, WORD, 2, file_bytes=file_bytes, block_ids=block_ids)
    out = read_ids(spark, path, with_ids=True).orderBy("start").collect()
    assert len(out) == len(rows)
    at, by_id = 0, defaultdict(list)
    for r in out:
        ids = np.frombuffer(r.ids, "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(r.ids)) and ids[-1] == 2
        at += len(ids)
        by_id[r.doc_id].append(ids[:-1].tolist())
    order = [r.doc_id for r in out]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(library.encode(t or "", add_special_tokens=False).ids)
    assert {k: sorted(v) for k, v in by_id.items()} == {k: sorted(v) for k, v in want.items()}
    if file_bytes == 300:  # equal rows do not meet in one file
        assert len({r.file for r in out if r.doc_id == 300}) > 1
    empty = str(tmp_path / "empty")
    write_ids(df.limit(0), empty, WORD, 2)
    assert read_ids(spark, empty).count() == 0


def test_files_of_ids_by_another_tokenizer_and_names(spark, tmp_path):
    from tokenizers import Tokenizer

    from biblioflux.llm.binary_ids import read_ids, write_ids

    path, bpe = str(tmp_path / "x"), P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(bpe)
    df = spark.createDataFrame([("b", "some text  here"), ("a", "x\n\ny")], "`k``1` string, t string")
    write_ids(df, path, bpe, 0, "k`1", "t")
    out = read_ids(spark, path, "string", with_ids=True).orderBy("start").collect()
    assert [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in out] == [(k, [*t.encode(x, add_special_tokens=False).ids, 0]) for k, x in (("a", "x\n\ny"), ("b", "some text  here"))]
