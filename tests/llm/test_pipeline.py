"""The pipeline's stages against plain Python versions, on a small table."""

from __future__ import annotations

import random

from test_operators import BPE, SCHEMA, brute_groups, prose, shingles
from tokenizers import Tokenizer


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    items = [(i, prose(rng, 30)) for i in range(3)]
    rows = []
    for i in range(40):
        lines = [prose(rng, 12) for _ in range(6)]
        if i % 10 == 4:
            lines.insert(2, items[i % 3][1])
        rows.append((i, "\n".join(lines), "en" if i % 2 else "fr", "s"))
    rows += [(50, "1234 5678 !!", "en", "s"), (51, None, "en", "s"), (52, "", None, "s")]
    rows.append((53, rows[1][1], "en", "s"))  # an exact copy: all its lines go
    near = prose(rng, 72).split()  # two near copies that share no line
    rows += [(54 + k, "\n".join(" ".join(near[i : i + n]) for i in range(0, 72, n)), "fr", "s") for k, n in enumerate((17, 11))]
    rows = [(*r, len(r[1]) if r[1] is not None else None) for r in rows]
    spark.createDataFrame(rows, f"{SCHEMA}, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    kept = {r[0]: r[1] for r in rows}

    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), name)
        if k < 4:
            assert docs.columns == columns
            seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())

    kept = {i: t for i, t in kept.items() if t and any(map(str.isalpha, t))}
    assert seen["language_id"] == kept
    lines, out = set(), {}
    for i in sorted(kept):
        rest = []
        for x in kept[i].split("\n"):
            if x not in lines:
                rest.append(x)
            lines.add(x)
        if rest:
            out[i] = "\n".join(rest)
    assert seen["line_dedup"] == out and 53 not in out
    groups = brute_groups({i: shingles(t, 5) for i, t in out.items()}, 80)
    out = {i: t for i, t in out.items() if groups[i] == i}
    assert seen["near_dedup"] == out and 54 in out and 55 not in out
    norm = lambda t: "".join(c for c in t.lower() if c.isalnum())
    out = {i: t for i, t in out.items() if not any(norm(x) in norm(t) for _, x in items)}
    assert seen["decontaminate"] == out and len(out) < len(seen["near_dedup"])
    full = Tokenizer.from_file(BPE)
    got = docs.toPandas()
    assert set(got.doc_id) == set(out) and got.length.sum() == sum(len(full.encode(t, add_special_tokens=False).ids) + 1 for t in out.values())
    assert got.groupby("sequence_id").length.sum().max() <= 2048
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(got)


def test_pipeline_over_odd_rows(spark, tmp_path):
    """Null and repeated ids, equal rows, null labels, names that helpers have: nothing crashes, and clean rows stay."""
    import corpus_pipeline

    rng = random.Random(4)
    rows = [(i, "\n".join(prose(rng, 14) for _ in range(4)), "en" if i % 2 else "fr", "s") for i in range(12)]
    rows += [(None, prose(rng, 40), "en", "s"), (None, prose(rng, 40), None, None), (None, None, "en", None), (3, prose(rng, 50), "fr", "s"), (20, prose(rng, 45), "en", "t"), (20, prose(rng, 45), "en", "t")]
    same = (30, prose(rng, 60), "en", "s")
    rows += [same, same]
    odd = ["__lang", "__score", "__matches", "n_lines", "n_removed", "told", "places", "a`b", "__gone", "col_0"]
    schema = ", ".join([SCHEMA, *[f"`{c.replace('`', '``')}` int" for c in odd]])
    docs = spark.createDataFrame([(*r, *range(len(odd))) for r in rows], schema)
    spark.createDataFrame([(1, prose(rng, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    columns, none = docs.columns, docs.limit(0)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs, none = (corpus_pipeline.materialize(stage(spark, d, str(tmp_path)), name) for d in (docs, none))
        assert none.count() == 0
        if k < 4:
            assert docs.columns == none.columns == columns
            got = docs.collect()
            assert all([r[c] for c in odd] == list(range(len(odd))) for r in got)
            assert {r["text"] for r in got} == {r[1] for r in rows if r[1]}
            assert len(got) == sum(1 for r in rows if r[1])
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} == {r[0] for r in rows if r[1]}
