"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

One permutation of the 32-bit universe spreads the shingles; a second one, shifted circularly by 0, 1, 2, ..., gives all
signature coordinates. Documents with one and the same shingle set form a class and are compared once. Classes that
share a band are candidates; every link is confirmed on full shingle sets. With 32 bands of 5 coordinates a pair at
similarity 0.8 shares no band with probability 3e-6, and less above.

No bucket is gathered in one task: buckets are counted and given leaders by partial aggregates. In small buckets all
pairs are candidates. In large ones members are compared with a few leaders; those that stay apart meet again under the
shingles in which they differ from a leader, by a prefix filter that rules out no link, so nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import linked_groups, materialize, release

BANDS, ROWS = 32, 5
#: Characters of texts worked on at once.
BATCH_CHARS = 4_000_000
#: Classes that are candidates are broadcast up to this count (some 50 bytes each), else joined by shuffle.
BROADCAST_IDS = 400_000


class Shingler:
    """Shingle sets as sorted 64-bit hashes; keeps the hashes of at most `cache_words` words."""

    def __init__(self, n: int, cache_words: int = 400_000):
        self.n, self.known, self.cache_words = n, {}, cache_words

    def _codes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.cache_words:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        out = []
        for t in texts:
            words = (t or "").encode("utf-8", "surrogatepass").lower().split()
            if not words:
                out.append(np.zeros(0, np.uint64))
                continue
            codes, n = self._codes(words), min(self.n, len(words))
            h = np.full(len(codes) - n + 1, n, np.uint64)
            for k in range(n):
                h = _mix64(h * np.uint64(0x9E3779B97F4A7C15) + codes[k : len(codes) - n + 1 + k])
            h.sort()
            out.append(h[np.concatenate(([True], h[1:] != h[:-1]))])
        return out


def _mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Circulant MinHash of non-empty sets: coordinate k is the least value of the second permutation, shifted by k,
    over the places that the first one gives the shingles. A row for each set."""
    out = np.empty((len(sets), coordinates), np.uint32)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) < 100_000):
            size += len(sets[end])
            end += 1
        place = (_mix64(np.concatenate(sets[at:end])) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *(len(s) for s in sets[at : end - 1])])
        h, tmp = np.empty_like(place), np.empty_like(place)
        for k in range(coordinates):
            np.add(place, np.uint32(k), out=h)
            for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
                np.right_shift(h, np.uint32(shift), out=tmp)
                np.bitwise_xor(h, tmp, out=h)
                np.multiply(h, np.uint32(factor), out=h)
            np.right_shift(h, np.uint32(16), out=tmp)
            np.bitwise_xor(h, tmp, out=h)
            out[at:end, k] = np.minimum.reduceat(h, starts)
        at = end
    return out


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band of each signature; the band's number is part of it."""
    rows = sig.shape[1] // bands
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), bands)).copy()
    parts = sig[:, : rows * bands].reshape(len(sig), bands, rows)
    for k in range(rows):
        key = _mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.view(np.int64)


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most 1,000 rows and BATCH_CHARS characters of a text column, a longer text alone."""
    at, chars = 0, 0
    for k, text in enumerate(batch.column(column).to_pylist()):
        size = len(text) if text is not None else 0
        if k > at and (chars + size > BATCH_CHARS or k - at == 1000):
            yield batch.slice(at, k - at)
            at, chars = k, 0
        chars += size
    if at < batch.num_rows:
        yield batch.slice(at)


def sketch(docs: DataFrame, doc_id: str, text: str, ngram: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands) of each row; without shingles the last two are null."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shingler(ngram)
        for whole in batches:
            for batch in _parts(whole, 1):
                sets = s.sets(batch.column(1).to_pylist())
                full = [i for i, x in enumerate(sets) if len(x)]
                keys: list = [None] * len(sets)
                found: list = [None] * len(sets)
                if full:
                    b = band_keys(signatures([sets[i] for i in full], bands * rows), bands)
                    for i, x in zip(full, b, strict=True):
                        keys[i], found[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), x
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "set_key", "bands"],
                )

    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, n_shingles long, set_key binary, bands array<long>")


def shingle_sets(docs: DataFrame, ngram: int) -> DataFrame:
    """(id, set) of (text), id being the set's key; texts without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shingler(ngram)
        for whole in batches:
            for batch in _parts(whole, 0):
                sets = [x for x in s.sets(batch.column(0).to_pylist()) if len(x)]
                keys = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["id", "set"])

    return docs.select("text").mapInArrow(run, "id binary, set array<long>")


def _near_sizes(a: Column, b: Column, percent: int) -> Column:
    """Sets of these sizes can reach the similarity."""
    return (F.least(a, b) * 100) >= (F.greatest(a, b) * percent)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose full sets reach the similarity."""
    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    both = with_a.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    both = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("n"))
    return both.where(F.col("n") * 100 >= (F.col("na") + F.col("nb") - F.col("n")) * percent).select("a", "b")


def _sized(spread: DataFrame) -> DataFrame:
    """The members (key, id, n) of buckets that hold different ids, with the bucket's size."""
    sizes = spread.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi")
    return spread.join(sizes.select("key", "size"), "key")


def _open_pairs(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of one bucket in different components, among them all that are linked.

    Let h be the bucket's hub (the most met member of any component in the bucket) and d(x) the shingles in just one of x
    and h. Of two members in different components, and not both linked with h, one, x, is not linked with h. The pair
    (x, y) is linked if d(x) and d(y) differ in no more than D = (|x| + |y|) (100 - percent) / (100 + percent) elements,
    that is if they share o = (|d(x)| + |d(y)| - D) / 2 or more. As |d(x)| is above the limit of its own pair with h, o is
    above 0, and above (|d(y)| + (|h| - |y|) (100 - percent) / (100 + percent)) / 2. So, in any fixed order, one of the
    first |d| - o + 1 elements of each is common. The order is by the number of members that hold an element, the rarest
    first: what copies of h leave out of it is common to many, what each adds is its own. Elements that only members of
    one component hold, or none that is apart from h, are first of all and left out of the join, as no pair meets there.
    """
    hubs = placed.groupBy("c").agg(F.max(F.struct("meets", "id", "n")).alias("p"))
    # once for each bucket and component: the members of the largest component would all meet at its hub
    lead = placed.select("key", "c").distinct().join(hubs, "c").groupBy("key").agg(F.max(F.struct("p.meets", "p.id", "p.n", "c")).alias("p"))
    lead = lead.select("key", F.col("p.id").alias("hub"), F.col("p.n").alias("nh"), F.col("p.c").alias("hub_c"))
    met = placed.join(lead, "key").where("id <> hub").select("id", "n", "c", "hub", "nh", "hub_c").distinct()
    both = met.join(sets.select("id", F.col("set").alias("x")), "id").join(sets.select(F.col("id").alias("hub"), F.col("set").alias("h")), "hub")
    only = lambda a, b: F.transform(F.array_except(a, b), lambda v: F.xxhash64("hub", v))
    far, near = 100 - percent, 100 + percent
    d = both.withColumn("d", F.concat(only("x", "h"), only("h", "x"))).withColumn("nd", F.size("d").cast("long")).drop("x", "h")
    d = d.withColumn("apart", (F.col("c") != F.col("hub_c")) & (F.col("nd") * near > (F.col("n") + F.col("nh")) * far))
    most = F.floor(F.col("n") * far / percent)
    half = F.floor((F.col("nd") * near + (F.col("nh") - F.col("n")) * far) / (2 * near))
    d = d.withColumn("p", F.col("nd") - F.greatest(F.lit(1), F.col("nd") - most, half) + 1)
    d = d.withColumn("q", F.when(F.col("apart"), F.col("nd") - F.greatest(F.lit(1), F.col("nd") - most) + 1).otherwise(0))
    d = materialize(d, "apart")
    keys = d.select("id", "hub", "n", "nd", "c", "p", "q", F.explode("d").alias("key"))
    held = keys.groupBy("key").agg(F.count("*").alias("held"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("q").alias("most"))
    keys = keys.join(held.where("lo <> hi AND most > 0").select("key", "held"), "key")
    keys = keys.groupBy("id", "hub", "n", "nd", "c", "p", "q").agg(F.array_sort(F.collect_list(F.struct("held", "key"))).alias("d"))
    keys = keys.withColumn("first", F.col("nd") - F.size("d")).select("id", "n", "nd", "c", "p", "q", "first", F.posexplode("d").alias("i", "k"))
    keys = keys.select("id", "n", "nd", "c", "p", "q", (F.col("first") + F.col("i")).alias("i"), "k.key").where(F.col("i") < F.greatest("p", "q"))
    keys = materialize(keys, "prefix")
    x = keys.where("i < q").select("key", F.col("id").alias("a"), F.col("n").alias("na"), F.col("nd").alias("da"), F.col("c").alias("ca"), F.col("i").alias("ia"))
    y = keys.where("i < p").select("key", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("nd").alias("db"), F.col("c").alias("cb"), F.col("i").alias("ib"))
    o = F.floor((F.col("da") + F.col("db") - F.floor((F.col("na") + F.col("nb")) * far / near) + 1) / 2)
    met = (F.col("ca") != F.col("cb")) & _near_sizes(F.col("na"), F.col("nb"), percent) & (F.col("ia") <= F.col("da") - o) & (F.col("ib") <= F.col("db") - o)
    pairs = x.join(y, "key").where(met).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    own = d.where((F.col("c") != F.col("hub_c")) & ~F.col("apart")).select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    return pairs.unionByName(own)


def near_duplicates(docs: DataFrame, ngram: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Near-duplicate groups: doc_id, n_shingles, component_id, kept for each row of docs.

    Texts are lower-cased (A-Z) and cut at white space; a document's set holds its distinct `ngram`-word shingles, or its
    whole word sequence where it is shorter. Two documents are linked if 100 * intersection >= percent * union.
    component_id is the smallest id reachable by links, the document's own included; kept says that it is the own id.

    A null, empty or wordless text has no shingles and is linked with nothing. Repeated rows get the same component, and
    all of them are kept if one is. Rows with one id and different texts count as one document, linked with all that any
    of its texts is linked with. A row with a null id is linked with nothing: its component is null and it is kept. An
    empty table gives no rows. Other columns are not read. Shingles are compared by 64-bit hashes, sets by 128-bit ones.
    """
    sig = materialize(sketch(docs, doc_id, text, ngram, bands, rows), "sig")
    full = sig.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = materialize(full.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")
    spread = classes.select(F.col("set_key").alias("id"), "n", F.explode("bands").alias("key"))
    members = materialize(_sized(spread), "members")

    ids = materialize(members.select("id").distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    reps = classes.join(ids.select(F.col("id").alias("set_key")), "set_key", "left_semi").select("rep").distinct()
    wanted = docs.select(F.col(doc_id).alias("rep"), F.col(text).alias("text")).join(F.broadcast(reps) if few else reps, "rep", "left_semi")
    sets = shingle_sets(wanted, ngram).join(F.broadcast(ids) if few else ids, "id", "left_semi")
    several = full.groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi"), F.count("*").alias("rows")).where("rows > 1")
    several = materialize(several.select("doc_id", "lo", "hi"), "several")
    sets = materialize(sets if several.isEmpty() else sets.dropDuplicates(["id"]), "sets")

    own = full.join(several.where("lo <> hi"), "doc_id").where("set_key <> lo").select(F.col("lo").alias("a"), F.col("set_key").alias("b"))
    found = linked_groups(members, lambda pairs: _verified(pairs, sets, percent), lambda n, m: _near_sizes(n, m, percent), own.distinct(), refine=lambda placed: _open_pairs(placed, sets, percent))
    part = classes.join(found.select(F.col("node").alias("set_key"), "component"), "set_key", "left")
    part = materialize(part.select("set_key", "rep", F.coalesce("component", "set_key").alias("c")), "part")
    least = part.groupBy("c").agg(F.min("rep").alias("component"))
    part = part.join(least, "c").select("set_key", "component")
    keyed = sig.where("set_key IS NOT NULL").join(part, "set_key", "left").select("doc_id", "n_shingles", "component")
    alone = sig.where("set_key IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    mine = F.when(F.col("doc_id").isNotNull(), F.col("component"))
    out = keyed.unionByName(alone).select("doc_id", "n_shingles", mine.alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))
    release(members, ids, sets)
    return out
