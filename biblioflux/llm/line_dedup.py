"""Fuzzy line deduplication, with DataFrame functions only.

Lines are normalised; candidates meet under keys made of their characters, all are verified by edit similarity, links are
closed to groups, and the first occurrence of each group stays.

Keys of a line, by its length n and its runs: each word with the first three characters of the next; where words are longer than
LONG_WORD characters on average, as in scripts without spaces, RUN characters from the start of each word and from each
place within a word beyond its RUN-th character:

* n <= MAX_DELETES: the line, and the line with each one character left out. One edit is all that the similarity allows
  below 20 characters, so this misses no pair of such lines.
* up to MAX_HALVES: the first and last n // 2 and (n - 1) // 2 characters. A single edit leaves one half as it was, so no
  pair with one edit is missed.
* from 8 runs: the hashes of the runs in order, and each WINDOW neighbours among the SKETCH least of them. A pair with
  several edits shares a window with a probability that grows with the share of runs it has in common.
* from 5 to 12 runs: each two neighbours among them.

The SimHash with pigeonhole blocks that this operator was planned with misses most lines one edit apart (see the README).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import linked_groups, main_component, materialize, own_names, release

#: Characters of a run in lines whose words are longer than this on average.
RUN, LONG_WORD = 8, 12
#: Least hashes of a line's runs that make keys, and neighbours in a key.
SKETCH, WINDOW = 12, 3
#: Edit similarity of linked lines: 1 - distance / longer length.
SIMILARITY = 0.9
#: From this length on edits are counted in words, not in characters.
LONG_LINE = 600
#: Normalised lines below this length are compared exactly only: one edit is below the similarity for them.
MIN_CHARS = 10
#: Longest lines with keys of left out characters, and with keys of halves.
MAX_DELETES, MAX_HALVES = 21, 120
#: Members of a large bucket, drawn by hash, with which what stands apart is compared before all pairs are.
SAMPLES = 16
#: Letters that are counted to rule out pairs.
LETTERS = "etaoinshrdlucm"
#: Buckets with more open members that are long take the words as a filter: in smaller ones all pairs cost less.
CROWD = 64
#: Ids of candidates are broadcast up to this count (some 50 bytes each), else joined by shuffle.
BROADCAST_IDS = 400_000


def normalised(line: Column) -> Column:
    """Lower case, with each run of anything but letters and digits as one space."""
    return F.btrim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def _let(value: Column, f) -> Column:
    """f(value), with value computed once: a column inside a lambda is worked out anew for each element."""
    return F.get(F.transform(F.array(value), f), 0)


def _run_hashes(norm: Column) -> Column:
    """The distinct hashes of a line's runs, in order."""
    within = F.regexp_extract_all(norm, F.lit(rf"(?s)(?:(?<![^ ])|(?<=[^ ]{{{RUN}}}))(?=([^ ].{{0,{RUN - 1}}}))"), F.lit(1))

    def runs(words: Column) -> Column:
        by_word = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda w, after: F.xxhash64(w, F.substring(after, 1, 3)))
        return F.when(F.length(norm) > LONG_WORD * F.size(words), F.transform(within, lambda x: F.xxhash64(x))).otherwise(by_word)

    return F.sort_array(F.array_distinct(_let(F.split(norm, " "), runs)))


def _windows(hashes: Column, size: int, salt: int) -> Column:
    """A key for each `size` neighbours of an array; without so many, none."""
    none = F.array().cast("array<bigint>")
    places = lambda h: F.sequence(F.lit(0), F.size(h) - size)
    keys = lambda h: F.transform(places(h), lambda i: F.xxhash64(F.lit(salt), *[F.get(h, i + k) for k in range(size)]))
    return _let(hashes, lambda h: F.when(F.size(h) >= size, keys(h)).otherwise(none))


def with_keys(lines: DataFrame, norm: str = "norm") -> DataFrame:
    """lines with column keys, the array of keys under which a line is looked for."""
    none = F.array().cast("array<bigint>")
    n = F.length(norm)
    out = lines.withColumn("__r", F.when(n > MAX_DELETES, _run_hashes(F.col(norm))).otherwise(none))
    r, runs = F.col("__r"), F.size("__r")
    left_out = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.concat(F.substring(norm, F.lit(1), i - 1), F.substring(norm, i + 1, n))))
    deletes = F.when(n.between(MIN_CHARS, MAX_DELETES), F.array_append(left_out, F.xxhash64(norm))).otherwise(none)
    half = [(F.floor(n / 2)).cast("int"), F.floor((n - 1) / 2).cast("int")]
    ends = [F.xxhash64(F.lit(side), h, F.substring(norm, F.lit(1) if side == "first" else n - h + 1, h)) for h in half for side in ("first", "last")]
    halves = F.when(n.between(MAX_DELETES - 2, MAX_HALVES), F.array(*ends)).otherwise(none)
    few = F.when(runs.between(5, 12), _windows(r, 2, 2)).otherwise(none)
    many = F.when(runs >= 8, _windows(F.slice(r, 1, SKETCH), WINDOW, 3)).otherwise(none)
    return out.withColumn("keys", F.concat(deletes, halves, few, many)).drop("__r")


def _near(n: Column, m: Column) -> Column:
    return F.least(n, m) >= F.greatest(n, m) * SIMILARITY


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, row, line, norm, h) of the lines that have a letter or digit; row tells texts of one id apart."""
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("row"), F.posexplode(F.split(text, "\n")).alias("line", "__l"))
    rows = rows.where(F.col("__l").rlike(r"[\p{L}\p{N}]")).select("doc_id", "row", "line", normalised(F.col("__l")).alias("norm"))
    return rows.withColumn("h", F.xxhash64("norm"))


def _sized(spread: DataFrame) -> DataFrame:
    """The members (key, id, n) of buckets that hold several ids, with the bucket's size; spread has each member once. The
    counts and the join read one and the same shuffle of spread, so both need all its columns: no n is below MIN_CHARS."""
    spread = spread.repartition("key")
    buckets = spread.groupBy("key").agg(F.count("id").alias("size"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.min("n").alias("least"))
    buckets = buckets.where((F.col("lo") != F.col("hi")) & (F.col("least") >= MIN_CHARS)).select("key", "size")
    return spread.join(buckets.hint("shuffle_hash"), "key")


def _coded(c: str) -> Column:
    """A normalised line with each word as one character (of 20,000), for lines that can meet one of LONG_LINE characters."""
    code = F.array_join(F.transform(F.split(c, " "), lambda w: F.lpad(F.hex(F.pmod(F.xxhash64(w), F.lit(20_000)) + 0x4E00), 4, "0")), "")
    return F.when(F.length(c) >= int(LONG_LINE * SIMILARITY), F.decode(F.unhex(code), "UTF-16BE"))


def _similar(x: str, y: str, coded_x: str, coded_y: str) -> Column:
    """Whether two normalised lines have the edit similarity. Of lines from LONG_LINE characters on each word stands as one
    character, as the time grows with the square of the length."""
    long = F.greatest(F.length(x), F.length(y)) >= LONG_LINE
    a, b = (F.when(long, F.col(w)).otherwise(F.col(c)) for c, w in ((x, coded_x), (y, coded_y)))
    limit = F.floor(F.greatest(F.length(a), F.length(b)) * (1 - SIMILARITY) + 1e-9).cast("int")
    return F.call_function("levenshtein", a, b, limit) >= 0


def _crowded(placed: DataFrame) -> DataFrame:
    """(key) of the buckets whose long members are matched by _open_long_pairs."""
    long = placed.where(F.col("n") >= int(LONG_LINE * SIMILARITY)).groupBy("key").agg(F.count("*").alias("size"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("n").alias("most"))
    return long.where((F.col("size") > CROWD) & (F.col("lo") != F.col("hi")) & (F.col("most") >= LONG_LINE)).select("key")


def _open_long_pairs(placed: DataFrame, crowded: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of one crowded bucket in different components, one of LONG_LINE characters or more, among them
    all that are linked. Edits are counted in words there, so linked lines of up to w words share w - k words or more, repeats counted,
    k being the edits allowed. So, in any fixed order, one of the first k + 1 words of each is common. The order is by the
    number of lines that hold a word; those that only lines of one component hold are first and left out of the join."""
    edits = lambda w: F.floor(w * (1 - SIMILARITY) + 1e-9).cast("int")
    long = placed.where(F.col("n") >= int(LONG_LINE * SIMILARITY))
    lines = long.join(crowded, "key", "left_semi").groupBy("id", "n", "c").agg(F.collect_list("key").alias("keys")).join(texts.select(F.col("h").alias("id"), "coded"), "id")
    lines = materialize(lines.withColumn("w", F.length("coded")), "long")
    words = lines.select("id", "c", F.explode(F.split("coded", "")).alias("word")).where("word <> ''").groupBy("id", "c", "word").agg(F.count("*").alias("times"))
    words = materialize(words.select("id", "c", F.explode(F.transform(F.sequence(F.lit(1), "times"), lambda i: F.struct("word", i.alias("nth")))).alias("word")), "words")
    held = words.groupBy("word").agg(F.count("*").alias("held"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi")
    order = words.join(held.select("word", "held"), "word").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("held", "word"))).alias("order"))
    first = F.col("w") - F.size("order")
    x = lines.join(order, "id").select("id", "n", "c", "keys", "w", first.alias("first"), F.posexplode(F.slice("order", F.lit(1), F.greatest(edits(F.col("w")) + 1 - first, F.lit(0)))).alias("i", "word"))
    x = materialize(x.select("id", "n", "c", "keys", "w", (F.col("first") + F.col("i")).alias("i"), F.col("word.word").alias("word")), "apart")
    y = x.select("word", *[F.col(c).alias(f"{c}_2") for c in x.columns if c != "word"])
    most = F.greatest("w", "w_2")
    shared = most - edits(most)
    placed_so = (F.col("i") <= F.col("w") - shared) & (F.col("i_2") <= F.col("w_2") - shared)
    met = x.join(y, "word").where((F.col("id") < F.col("id_2")) & (F.col("c") != F.col("c_2")) & placed_so & _near(F.col("n"), F.col("n_2")))
    met = met.where((F.greatest("n", "n_2") >= LONG_LINE) & F.arrays_overlap("keys", "keys_2"))
    return met.select(F.col("id").alias("a"), F.col("id_2").alias("b"))


def _open_pairs(placed: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of one bucket in different components, but for those that lengths and letters rule out: an edit
    takes one character of a kind away, adds one, or both, so neither the missing nor the added ones of all kinds can be more
    than the edits. One member of such a pair is outside the bucket's largest component. From LONG_LINE characters on, where
    edits are counted in words, words decide in crowded buckets, and lengths alone, as in _near, in others."""
    crowded = materialize(_crowded(placed), "crowded")
    count = [(F.length("norm") - F.length(F.replace(F.col("norm"), F.lit(c), F.lit("")))).alias(f"l_{c}") for c in LETTERS]
    letters = texts.join(placed.select(F.col("id").alias("h")).distinct(), "h", "left_semi").select(F.col("h").alias("id"), *count)
    letters = letters.withColumn("l_rest", sum(F.col(f"l_{c}") for c in LETTERS))
    x = placed.select("key", "id", "n", "c").join(letters, "id").join(main_component(placed), "key").join(crowded.withColumn("crowd", F.lit(True)), "key", "left")
    x = materialize(x.withColumn("l_rest", F.col("n") - F.col("l_rest")).withColumn("out", F.col("c") != F.col("main")).drop("main"), "apart")
    y = x.drop("crowd").select("key", *[F.col(c).alias(f"{c}_2") for c in x.columns if c not in ("key", "crowd")])
    longest = F.greatest("n", "n_2")
    # the missing and the added ones together, and the difference of the two
    twice = sum((F.abs(F.col(c) - F.col(f"{c}_2")) for c in letters.columns if c != "id"), F.abs(F.col("n") - F.col("n_2")))
    possible = F.when(longest >= LONG_LINE, F.col("crowd").isNull()).otherwise(twice <= 2 * F.floor(longest * (1 - SIMILARITY) + 1e-9))
    once = ~F.col("out_2") | (F.col("id") < F.col("id_2"))
    met = x.where("out").join(y, "key").where((F.col("c") != F.col("c_2")) & once & _near(F.col("n"), F.col("n_2")) & possible)
    short = met.select(F.least("id", "id_2").alias("a"), F.greatest("id", "id_2").alias("b"))
    return short.unionByName(_open_long_pairs(placed, crowded, texts))


def removed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, line) of all lines but the first occurrence of each group."""
    lines = _lines(docs, doc_id, text).withColumn("n", F.length("norm"))
    lines = materialize(lines, "lines", codec="zstd")  # with their text, so that it is normalised once
    once = with_keys(lines.where(F.col("n") >= MIN_CHARS).select("h", "n", "norm").distinct())  # equal lines have equal keys
    once = once.select(F.col("h").alias("id"), "n", "norm", F.array_distinct("keys").alias("keys"))
    once = materialize(once, "once", codec="zstd")  # with a shuffle before its own, that of the keys would not be read twice
    texts, lines = lines, materialize(lines.select("doc_id", "row", "line", "h"), "places")
    release(texts)
    members = materialize(_sized(once.select("id", "n", F.explode("keys").alias("key"))), "members")
    ids = materialize(members.select("id").distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    texts = once.join(F.broadcast(ids) if few else ids, "id", "left_semi").select(F.col("id").alias("h"), "norm")
    texts = materialize(texts.withColumn("coded", _coded("norm")), "texts")
    release(once)

    def verify(pairs: DataFrame) -> DataFrame:
        side = lambda k: texts.select(F.col("h").alias(k), F.col("norm").alias(f"t{k}"), F.col("coded").alias(f"w{k}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        return both.where(_similar("ta", "tb", "wa", "wb")).select("a", "b")

    groups = linked_groups(members, verify, _near, refine=lambda placed: _open_pairs(placed, texts), small=3, leader_rounds=1, samples=SAMPLES, skip_tried=True)
    kinds = lines.groupBy("h").agg(F.count("*").alias("count"), F.min(F.struct("doc_id", "row", "line")).alias("first"))
    kinds = kinds.join(groups.select(F.col("node").alias("h"), "component"), "h", "left").withColumn("g", F.coalesce("component", "h"))
    kinds = materialize(kinds.select("h", "g", "count", "first"), "kinds")
    winners = kinds.groupBy("g").agg(F.sum("count").alias("all"), F.min("first").alias("first")).where(F.col("all") > 1)
    losers = kinds.select("h", "g").join(winners.select("g", "first"), "g").select("h", "first")
    out = lines.select("doc_id", "row", "line", "h").join(losers, "h")
    out = materialize(out.where(~F.struct("doc_id", "row", "line").eqNullSafe(F.col("first"))).select("doc_id", "row", "line"), "removed")
    release(lines, members, ids, texts, kinds)
    return out


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the text's repeated lines left out, and columns n_lines and n_removed.

    Lines (cut at line feeds) are linked if they are equal once normalised, or if both have MIN_CHARS characters or more,
    share a key and their edit similarity is at least 0.9. Of each connected group over all
    documents the first line stays, by doc_id and line number (null ids come first). Lines without letters and digits
    always stay.

    A null text stays null and has no lines; an empty one has one. Rows equal in id and text are one document: they keep
    the same lines. Rows with one id and different texts are told apart by a hash of the text. An empty table gives no
    rows; columns n_lines and n_removed are replaced if they are there, others stay. Lines are told apart by 64-bit
    hashes of their normalised text.
    """
    return own_names(docs, {"doc_id": doc_id, "text": text}, ["n_lines", "n_removed"], _dedup_lines)


def _dedup_lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    kept = list(docs.columns)
    gone = removed_lines(docs, doc_id, text).groupBy("doc_id", "row").agg(F.collect_set("line").alias("__gone"))
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), "__gone")
    hashed = docs.withColumn("__h", F.xxhash64(text))
    out = hashed.join(gone.hint("shuffle_hash"), F.col("__id").eqNullSafe(F.col(doc_id)) & (F.col("__row") == F.col("__h")), "left")
    lines = F.split(text, "\n")
    out = out.withColumn("n_lines", F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long"))
    out = out.withColumn("n_removed", F.coalesce(F.size("__gone"), F.lit(0)).cast("long"))

    def rest(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    text_out = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(_let(lines, rest))
    return out.withColumn(text, text_out).select(*kept, "n_lines", "n_removed")
