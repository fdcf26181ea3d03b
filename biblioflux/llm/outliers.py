"""Robust multivariate outliers among documents, with DataFrame functions only.

Each document has a vector of transformed text statistics. For each language and source, and more coarsely for each
language and for all, minimum-covariance-determinant estimates are found by concentration steps: the share H of rows
nearest to the centre give the next mean and covariance. A step is one pass: rows are summed by group and by step of a
logarithmic histogram of their distance (partial sums, so a hot group is no hot task), and the histogram's nearest part
gives the moments. A document is rejected by its Mahalanobis distance under the finest group that has enough rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, own_names

#: Share of rows that the estimates rest on; concentration steps; rows that a group needs for its own estimates.
H, STEPS, MIN_ROWS = 0.75, 4, 50
#: Share of clean rows that may lie beyond the limit.
TAIL = 1e-4
#: The statistics, and the least spread that each is taken to have: without it, a statistic that is 0 in nearly all rows
#: would reject every row that has any. A statistic alone reaches the limit about 4.8 floors from the mean.
FLOORS = {"x_word": 0.08, "x_symbol": 0.04, "x_lines": 0.1, "x_repeat": 0.1}
#: Lines and words added to a text's own in the shares of repeated ones, so that one chance repeat in a short text is no
#: large share: a repeated line, two windows of 8 words.
EXTRA_LINES, EXTRA_WORDS = 2, 16
_NAMES = list(FLOORS)
_WS = " \t\n\x0b\f\r"


def _chi2_tail(q: float, df: int) -> float:
    """Upper tail of chi-square for an even number of degrees of freedom."""
    term = total = 1.0
    for k in range(1, df // 2):
        term *= q / 2 / k
        total += term
    return math.exp(-q / 2) * total


def _chi2_point(tail: float, df: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_tail(mid, df) > tail else (lo, mid)
    return hi


#: Makes the covariance of the nearest share H that of all rows, for normal data.
CONSISTENCY = H / (1 - _chi2_tail(_chi2_point(1 - H, len(_NAMES)), len(_NAMES) + 2))
LIMIT = _chi2_point(TAIL, len(_NAMES))


def text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of the whole text.

    Words are runs without white space (space, U+0009 to U+000D). A null text counts as empty. n_repeat_words counts the
    words in windows of 8 words that the text has twice or more; windows are compared by 64-bit hashes and sorted, so
    a text of n words costs n log n.
    """
    mine = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    kept = [c for c in docs.columns if c not in (text, *mine)]
    t = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(t, F.lit(_WS))
    df = docs.select(*kept, t.alias("__t"), trimmed.alias("__trim"))
    df = df.select(
        *kept,
        F.when(F.col("__trim") == "", F.array().cast("array<string>")).otherwise(F.split("__trim", r"[\x20\x09-\x0D]+")).alias("__w"),
        F.filter(F.split("__t", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("__l"),
        F.length(F.translate("__t", _WS, "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    )
    n = F.size("__w")
    windows = F.when(n >= 8, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 7)), lambda i: F.xxhash64(F.slice("__w", i, 8)))).otherwise(F.array().cast("array<bigint>"))
    df = df.select(*kept, "word_chars", "n_symbols", n.cast("long").alias("n_words"), F.size("__l").cast("long").alias("n_lines"), (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"), windows.alias("__h"))
    twice = F.size(F.array_distinct("__h")) < F.size("__h")
    pairs = F.when(twice, F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("__s", pairs).drop("__h")
    s = F.col("__s")

    def again(x: Column, k: Column) -> Column:
        before = F.when(k > 0, F.get(s, k - 1)["h"] == x["h"])
        return F.coalesce(before, F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))

    places = F.sort_array(F.transform(F.filter(s, again), lambda x: x["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(-8).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(8), p - a["last"])).cast("long").alias("n")),
        lambda a: a["n"],
    )
    return df.withColumn("n_repeat_words", F.coalesce(F.when(s.isNotNull(), covered), F.lit(0).cast("long"))).drop("__s")


def _vector(df: DataFrame) -> DataFrame:
    """The transformed statistics: log mean word length, roots of the shares of symbols, repeated lines and repeated words."""
    n = F.greatest("n_words", F.lit(1))
    return df.withColumns({
        "x_word": F.log(F.greatest("word_chars", F.lit(1)) / n),
        "x_symbol": F.sqrt(F.col("n_symbols") / F.greatest("word_chars", F.lit(1))),
        "x_lines": F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + EXTRA_LINES)),
        "x_repeat": F.sqrt(F.col("n_repeat_words") / (n + EXTRA_WORDS)),
    })


def _key(level: int, *cols: str) -> Column:
    return F.concat_ws("\x01", F.lit(str(level)), *[F.coalesce(F.col(c).cast("string"), F.lit("\x02")) for c in cols])


def _model(moments: DataFrame) -> DataFrame:
    """Means and the inverse Cholesky factor's makings from sums of values and products over n rows."""
    d = len(_NAMES)
    mean = {i: F.col(f"s{i}") / F.col("k") for i in range(d)}
    out = moments.select("key", "n", *[mean[i].alias(f"m{i}") for i in range(d)], *[((F.col(f"p{i}{j}") / F.col("k") - mean[i] * mean[j]) * CONSISTENCY + (FLOORS[_NAMES[i]] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i in range(d) for j in range(i + 1)])
    for j in range(d):
        for i in range(j, d):
            c = F.col(f"c{i}{j}")
            for k in range(j):
                c = c - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(c, F.lit(1e-12))) if i == j else c / F.col(f"l{j}{j}"))
    return out.select("key", "n", *[f"m{i}" for i in range(d)], *[f"l{i}{j}" for i in range(d) for j in range(i + 1)])


def _distance(model: str = "") -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    z: list[Column] = []
    for i, name in enumerate(_NAMES):
        v = F.col(name) - F.col(f"{model}m{i}")
        for k in range(i):
            v = v - F.col(f"{model}l{i}{k}") * z[k]
        z.append(v / F.col(f"{model}l{i}{i}"))
    total = z[0] * z[0]
    for v in z[1:]:
        total = total + v * v
    return total


def estimates(rows: DataFrame) -> DataFrame:
    """MCD estimates for each `key` of rows with the statistics: key, n, means and Cholesky factors."""
    d = len(_NAMES)
    # start: medians from histograms of the single statistics, spreads from the floors and quartiles
    single = rows.select("key", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.round(F.col(x) * 512).cast("long").alias("b")) for i, x in enumerate(_NAMES)])).alias("v"))
    hist = single.select("key", "v.i", "v.b").groupBy("key", "i", "b").agg(F.count("*").alias("c"))
    w = Window.partitionBy("key", "i")
    upto = hist.withColumns({"cum": F.sum("c").over(w.orderBy("b")), "n": F.sum("c").over(w)})
    q = [F.min(F.when(F.col("cum") >= F.col("n") * p, F.col("b"))) / 512 for p in (0.25, 0.5, 0.75)]
    start = upto.groupBy("key", "i").agg(F.max("n").alias("n"), q[1].alias("m"), ((q[2] - q[0]) / 1.349).alias("s"))
    of = lambda i, c: F.max(F.when(F.col("i") == i, F.col(c)))
    floors = list(FLOORS.values())
    model = start.groupBy("key").agg(F.max("n").alias("n"), *[of(i, "m").alias(f"m{i}") for i in range(d)], *[(F.greatest(of(i, "s"), F.lit(floors[i])) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in range(d) for j in range(i + 1)])
    model = materialize(model, "mcd")
    for _ in range(STEPS):
        near = rows.join(model.drop("n"), "key").withColumn("b", F.floor(F.log(_distance() + 1e-6) * 32))
        x = [F.col(c) for c in _NAMES]
        sums = [F.sum(x[i]).alias(f"s{i}") for i in range(d)] + [F.sum(x[i] * x[j]).alias(f"p{i}{j}") for i in range(d) for j in range(i + 1)]
        cells = near.groupBy("key", "b").agg(F.count("*").alias("k"), *sums)
        w = Window.partitionBy("key")
        cells = cells.withColumns({"n": F.sum("k").over(w), "before": F.coalesce(F.sum("k").over(w.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
        parts = [c for c in cells.columns if c[0] in "sp"]
        moments = cells.where(F.col("before") < F.col("n") * H).groupBy("key").agg(F.max("n").alias("n"), F.sum("k").alias("k"), *[F.sum(c).alias(c) for c in parts])
        model = materialize(_model(moments), "mcd")
    return model


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """docs without the text, with the counts of text_stats(), base_failed, distance (squared Mahalanobis) and kept.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated windows. All others are held against the
    estimates of their language and source; where these have fewer than MIN_ROWS rows, of their language; else of all.
    Where no group is large enough nothing more is rejected and the distance is null. Null languages and sources are groups of their own. Repeated
    rows count again; ties at the share H go in together; an empty table gives no rows. Columns of these names are
    replaced, others stay.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept"]
    return own_names(docs, {"text": text, "lang": lang, "source": source}, new, _judge)


def _judge(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    stats = materialize(_vector(text_stats(docs, text)).withColumn("base_failed", (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)), "stats")
    keys = {"__k2": _key(2, lang, source), "__k1": _key(1, lang), "__k0": _key(0)}
    rows = stats.where("NOT base_failed").select(F.explode(F.array(*keys.values())).alias("key"), *_NAMES)
    model = estimates(rows).where(F.col("n") >= MIN_ROWS)
    out = stats.withColumns(keys)
    dist: list[Column] = []
    for k in keys:
        out = out.join(model.select(F.col("key").alias(k), *[F.col(c).alias(f"{k}{c}") for c in model.columns if c not in ("key", "n")]), k, "left")
        dist.append(_distance(k))
    d2 = F.coalesce(*dist)
    kept = ~F.col("base_failed") & (F.coalesce(d2, F.lit(0.0)) <= LIMIT)
    return out.select(*[c for c in stats.columns if c not in (*_NAMES, "distance", "kept")], d2.alias("distance"), kept.alias("kept"))
