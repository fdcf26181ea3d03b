"""Helpers shared by the training-data operators: shared scratch tables, graph components, tokens."""

from __future__ import annotations

import atexit
import functools
import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType

#: Bytes that separate words: space and U+0009 to U+000D, as bytes.split() has them.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"

#: Edge tables of up to so many rows (16 bytes each, or 32) are worked on by the driver.
DRIVER_EDGES = 300_000

_made: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir. Where that is unset, a local one on a local master;
    on any other it raises, as executors would write to disks that the others cannot read."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_folder(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the session's Python ends."""
    path = f"{scratch_root(spark)}/tables/{tag}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, tag: str = "t", codec: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder, compressed by the session's codec or the one given, and read it back: lineage
    ends there, and a lost executor costs only the tasks that read the table. release() deletes the folder, else it goes when
    the session's Python ends."""
    spark = df.sparkSession
    path = scratch_folder(spark, tag)
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables made by materialize() that nothing reads any more; and let the driver's JVM collect its garbage, with
    which the shuffle files of ended queries go."""
    for df in tables:
        mine = (df.sparkSession, df._scratch_path)
        if mine in _made:
            _made.remove(mine)
            _delete(*mine)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may have ended before Python
            return


def own_names(docs: DataFrame, inputs: dict[str, str], new: list[str], run: Callable[..., DataFrame]) -> DataFrame:
    """run(inner, **inputs) over docs under column names of this function's own, which clash with no helper column and need
    no quotes; what it returns has the given names again. Columns named as one of `new`, in any case, that are no input
    are replaced: they are dropped first."""
    taken = {c.lower() for c in new}
    given = [c for c in docs.columns if c in inputs.values() or c.lower() not in taken]
    inner = docs.select(*[F.col("`" + c.replace("`", "``") + "`").alias(f"col_{i}") for i, c in enumerate(given)])
    back = {f"col_{i}": c for i, c in enumerate(given)}
    out = run(inner, **{k: f"col_{given.index(c)}" for k, c in inputs.items()})
    return out.select(*[F.col(c).alias(back.get(c, c)) for c in out.columns])


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_crc(col: str) -> Column:
    """crc32 of an integer id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def _edge_mark(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def _each(df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Rows (a, b) for each of the pairs of columns; an explode, which keeps the partitioning, where a union would not."""
    x = F.explode(F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in pairs]))
    return df.select(x.alias("x")).select("x.a", "x.b")


def _components_here(edges: DataFrame) -> pa.Table:
    """(node, component) of few edges (a, b), by union-find in the driver. Arrow compares bytes and text as Spark does."""
    t = edges.toArrow()
    ends = [t.column(c).combine_chunks() for c in ("a", "b")]
    names = pc.unique(pa.chunked_array(ends))
    names = names.take(pc.sort_indices(names))
    part = list(range(len(names)))

    def find(x: int) -> int:
        while part[x] != x:
            part[x] = x = part[part[x]]
        return x

    for x, y in zip(*(pc.index_in(c, names).to_pylist() for c in ends), strict=True):
        x, y = find(x), find(y)
        part[max(x, y)] = min(x, y)
    return pa.table({"node": names, "component": names.take(pa.array([find(x) for x in part], pa.int32()))})


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """Connected components of an undirected edge table as (node, component), component being the smallest node.

    Up to `driver_edges` edges between integers, strings or bytes go to the driver, whose table is written for all. For
    more, alternating large-star and small-star rounds: the number of rounds grows with the logarithm of the longest path.
    Minima are partial aggregates and the joins back to them can be split by AQE, so a node with a third of all edges
    does not meet in one task. Nodes are compared by their own order (integers, strings or structs). Loops and
    repeated edges are allowed; edges with a null end are ignored.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    if isinstance(e.schema["a"].dataType, (BinaryType, IntegerType, LongType, StringType)) and e.schema["a"].dataType == e.schema["b"].dataType and e.count() <= driver_edges:
        here = _components_here(e)
        kind = e.schema["a"].dataType.simpleString()
        return materialize(e.sparkSession.createDataFrame(here, f"node {kind}, component {kind}"), "cc")
    e = materialize(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    mark = _edge_mark(e)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = _each(e, ("a", "b"), ("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _each(large.join(low, "a"), ("b", "m"), ("a", "m")).where("a <> b").distinct()
        old, e = e, materialize(small, "cc")
        release(old)
        new = _edge_mark(e)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    # settled: every edge leads from a node to the least node of its component
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def linked_groups(members: DataFrame, verify, near, first_edges: DataFrame | None = None, refine=None, small: int = 8, leader_rounds: int = 2, samples: int = 0, skip_tried: bool = False) -> DataFrame:
    """Components (node, component) of the links among members of buckets.

    members has key, id, n (a size that `near` compares) and size (members of the bucket); verify takes pairs (a, b) and
    returns the true ones; near(n, m) says which sizes can be linked at all; first_edges are links known already.

    In buckets of up to `small` members all pairs are verified. In larger ones, members are compared with the bucket's
    hub: the member that meets most others over all its buckets, as the original of many copies does. What is still in
    other components is compared with the hub of the rest, then with a member picked by a hash; then, if `samples` is
    given, what is outside the bucket's largest component with so many members picked by hashes. So a bucket of near
    copies costs a few comparisons for each member, and no bucket meets in one task.

    Nothing is left out then: all pairs of members of one bucket and of different components are verified that are not
    ruled out by `near` or, if given, by refine. It takes the open members (key, id, n, c: the component so far, meets)
    and returns pairs (a, b), with all links among those. With skip_tried, no pair is verified in two rounds.
    """
    other = members.select("key", F.col("id").alias("id2"), F.col("n").alias("m"), "size").where(F.col("size") <= small).drop("size")
    few = members.where(F.col("size") <= small).join(other, "key").where(F.col("id") < F.col("id2")).where(near(F.col("n"), F.col("m")))
    pairs = few.select(F.col("id").alias("a"), F.col("id2").alias("b"))
    large = members.where(F.col("size") > small)
    meets = large.groupBy("id").agg(F.sum("size").alias("meets"))
    many = materialize(large.join(meets, "id").select("key", "id", "n", "meets"), "many")
    pairs = materialize(pairs.unionByName(_with_leader(many, _leader(many, "meets"), near)).distinct(), "pairs")
    edges = materialize(verify(pairs), "edges")
    tried = [pairs] if skip_tried else []
    release(*[] if skip_tried else [pairs])
    if first_edges is not None:
        edges = edges.unionByName(first_edges)
    found = connected_components(edges, "a", "b")
    for turn in range(1, leader_rounds + (3 if samples else 2)):
        placed = many.join(found.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
        split = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
        placed = materialize(placed.join(split, "key", "left_semi"), "open")
        if placed.isEmpty():
            break
        if turn == 1:
            hub = _leader(placed, "meets").select("key", F.col("lead_c").alias("hub_c"))
            others = placed.join(hub, "key").where(F.col("c") != F.col("hub_c"))
            pairs = _with_leader(placed, _leader(others, "meets"), near)
        elif turn <= leader_rounds:
            pairs = _with_leader(placed, _leader(placed.withColumn("h", F.xxhash64("c", F.lit(turn))), "h"), near)
        elif samples and turn == leader_rounds + 1:
            pairs = _with_samples(placed, samples, near)
        elif refine is not None:
            pairs = refine(placed)
        else:
            other = placed.select("key", F.col("id").alias("id2"), F.col("n").alias("m"), F.col("c").alias("c2"))
            close = placed.join(other, "key").where((F.col("id") < F.col("id2")) & (F.col("c") != F.col("c2"))).where(near(F.col("n"), F.col("m")))
            pairs = close.select(F.col("id").alias("a"), F.col("id2").alias("b"))
        pairs = materialize(pairs.distinct(), "pairs")
        if tried:  # after the distinct: Spark would put the join before it
            met, pairs = pairs, materialize(pairs.join(functools.reduce(DataFrame.unionByName, tried), ["a", "b"], "left_anti"), "pairs")
            release(met)
        more = materialize(verify(pairs), "edges")
        tried += [pairs] if skip_tried else []
        release(placed, *[] if skip_tried else [pairs])
        if not more.isEmpty():
            edges = edges.unionByName(more)
            found = connected_components(edges, "a", "b")
    release(*tried)
    return found


def _leader(members: DataFrame, by: str) -> DataFrame:
    """(key, lead, m, lead_c): the member of each bucket with the largest `by`, ties by id; a partial aggregate."""
    c = [F.col("c")] if "c" in members.columns else []
    lead = members.groupBy("key").agg(F.max(F.struct(F.col(by).alias("h"), F.col("id"), F.col("n"), *c)).alias("p"))
    return lead.select("key", F.col("p.id").alias("lead"), F.col("p.n").alias("m"), *([F.col("p.c").alias("lead_c")] if c else []))


def main_component(placed: DataFrame) -> DataFrame:
    """(key, main): the component with most members in each bucket, ties by the component; partial aggregates."""
    main = placed.groupBy("key", "c").agg(F.count("*").alias("k")).groupBy("key").agg(F.max(F.struct("k", "c")).alias("p"))
    return main.select("key", F.col("p.c").alias("main"))


def _with_samples(placed: DataFrame, samples: int, near) -> DataFrame:
    """Pairs (a, b) of members outside their bucket's largest component with members of other components, picked by hashes."""
    member = F.struct("id", "n", "c")
    picked = [F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), member.alias("x"))).alias(f"p{k}") for k in range(samples)]
    picked = placed.groupBy("key").agg(*picked).select("key", F.explode(F.array_distinct(F.array(*[F.col(f"p{k}.x") for k in range(samples)]))).alias("x"))
    picked = picked.select("key", F.col("x.id").alias("id2"), F.col("x.n").alias("m"), F.col("x.c").alias("c2"))
    out = placed.join(main_component(placed), "key").where("c <> main").select("key", "id", "n", "c")
    met = out.join(picked, "key").where("c <> c2").where(near(F.col("n"), F.col("m")))
    return met.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"))


def _with_leader(members: DataFrame, lead: DataFrame, near) -> DataFrame:
    """Pairs (a, b) of members with their bucket's leader, those of its own component left out."""
    met = members.join(lead, "key").where((F.col("c") != F.col("lead_c")) if "c" in members.columns else (F.col("id") != F.col("lead")))
    return met.where(near(F.col("n"), F.col("m"))).select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b"))
