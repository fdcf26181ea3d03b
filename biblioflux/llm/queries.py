"""The registered queries of this package: thin digests of what the operators return, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    )
    out = count_tokens(docs, tokenizer("piece_bpe_32k.model"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


@query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query
def op4_best_fit_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_groups

    text = F.coalesce("text", F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("text_sha"),
    )
    out = shard_groups(docs, ["text_sha"], "size", 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import id_crc
    from .lang_id import fit, predict

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (id_crc("doc_id") % 5 == 0).alias("held_out"))
    model = fit(docs.where("NOT held_out"))
    return predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


@query
def op5_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), ngram=2)


@query
def op9_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import mark

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = mark(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", F.size("matches").cast("long").alias("n_matches"), (F.size("matches") == 0).alias("kept"))


@query
def op1_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import id_crc
    from .lattice_lm import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (id_crc("doc_id") % 7 == 2).alias("held_out"))
    model = fit(docs.where("NOT held_out"), tokenizer("piece_bpe_32k.model"))
    return score(docs, model)


@query
def op2_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .outliers import judge

    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op3_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .link_graph import judge_pages

    rules = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return judge_pages(pages, rules).drop("url")


@query
def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))


@query
def op11_drake_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import cluster_vectors, with_inertia

    out = with_inertia(cluster_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _centroid_sql(rounds: int = 10) -> str:
    """Plain rounds of assignment and floor means."""
    steps = [
        """kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), embedding) r, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) v
FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        "c0 AS MATERIALIZED (SELECT (r - 1)::INT c, v FROM kept WHERE r <= 8)",
    ]
    for i in range(rounds + 1):
        steps.append(f"d{i} AS (SELECT r, vec_id, k.v, c, list_sum(list_transform(list_zip(k.v, m.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT d FROM kept k, c{i} m)")
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) vec_id, any_value(v) v, arg_min(c, (d, c)) c, min(d) d FROM d{i} GROUP BY r)")
        if i < rounds:
            steps.append(f"s{i} AS (SELECT c, j, sum(v[j])::HUGEINT s, count(*)::HUGEINT n FROM a{i}, range(1, 65) g(j) GROUP BY c, j)")
            steps.append(f"m{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) v FROM s{i} GROUP BY c)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) v FROM c{i} o LEFT JOIN m{i} m USING (c))")
    last = f"""SELECT vec_id, a.c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} m ON a.c = m.c"""
    return "WITH " + ",\n".join(steps) + "\n" + last


ORACLE["op11_drake_centroids"] = _centroid_sql()


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


ORACLE["op12_source_divergence"] = r"""WITH d AS (SELECT row_number() OVER () r, coalesce(lang, '') lang, coalesce(source, '') source, coalesce(text, '') t FROM documents),
tok AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT ln FROM tok GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
lv AS (SELECT lang, count(*)::HUGEINT v, sum(ln)::HUGEINT n FROM kept GROUP BY lang),
cnt AS (SELECT t.lang, t.source, t.term, count(*)::HUGEINT c FROM tok t JOIN kept k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT lang, source, sum(c)::HUGEINT n FROM cnt GROUP BY lang, source),
grid AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) c, 1 + 1000000000 * (coalesce(c.c, 0) + 5) // (coalesce(gn.n, 0) + 5 * lv.v) p, 1 + 1000000000 * (k.ln + 5) // (lv.n + 5 * lv.v) q
FROM grp g JOIN kept k ON g.lang = k.lang JOIN lv ON lv.lang = g.lang LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
prs AS (SELECT a.lang, a.source, b.source item FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source),
dist AS (SELECT a.lang, a.source, b.source item, sum(abs(a.p - b.p))::BIGINT v FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (SELECT lang, source, 'pair' part, item, coalesce(v, 0)::BIGINT AS value FROM prs LEFT JOIN dist USING (lang, source, item)
UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM grid WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM parts) WHERE part = 'pair' OR rank <= 50"""


@query
def op13_frequency_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .binary_ids import read_ids, write_ids
    from .common import scratch_folder

    path = scratch_folder(spark, "ids")
    write_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), path, tokenizer("word_bpe_49k.json"), end_id=2)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
