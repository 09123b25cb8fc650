"""Registered queries and their reference SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.config import SMALL, EngineConfig
from deltaloom.functions import bytescan, codecs, formats, vcdiff
from deltaloom.operators import reduce as ops
from deltaloom.plans import oracles, reduction
from deltaloom.sources import blobs as sources
from deltaloom.sources import shared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _docs(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return sources.from_text(_read(spark, sf_dir, "documents"), "doc_id", "text", *keep)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.from_text(_read(spark, sf_dir, "pages"), "page_id", "html")


def _fixed_sql(table: str, key: str, text: str, tail: bool) -> str:
    size, n = 8192, f"octet_length(encode(coalesce({text}, '')))"
    count = f"CAST({'ceil' if tail else 'floor'}({n} / {size}.0) AS BIGINT)"
    return f"""
SELECT {key} AS blob_id, CAST(i AS INTEGER) AS idx, {key} * 1048576 + i AS ord, i * {size} AS "offset", CAST(least({size}, {n} - i * {size}) AS INTEGER) AS size,
  md5(unhex(substr(hex(encode(coalesce({text}, ''))), i * {2 * size} + 1, {2 * size}))) AS digest
FROM (SELECT *, unnest(range({count})) AS i FROM {table})"""


def _digests(chunks: DataFrame) -> DataFrame:
    return chunks.select("blob_id", "idx", "ord", "offset", "size", F.md5("data").alias("digest"))


@query(_fixed_sql("documents", "doc_id", "text", True))
def fixed_chunks_docs(spark, sf_dir):
    return _digests(ops.fixed_chunks(_docs(spark, sf_dir)))


@query(_fixed_sql("documents", "doc_id", "text", False))
def fixed_chunks_drop_tail(spark, sf_dir):
    return _digests(ops.fixed_chunks(_docs(spark, sf_dir), keep_tail=False))


@query(_fixed_sql("pages", "page_id", "html", True))
def pages_chunks(spark, sf_dir):
    return _digests(ops.fixed_chunks(_pages(spark, sf_dir)))


_WHOLE = "SELECT doc_id * 1048576 AS ord, lang, source, md5(coalesce(text, '')) AS fp, octet_length(encode(coalesce(text, '')))::BIGINT AS size FROM documents"
_DEDUP = f"WITH c AS ({_WHOLE}), d AS (SELECT *, min(ord) OVER (PARTITION BY fp) AS first_ord FROM c)"


def _whole(spark, sf_dir) -> DataFrame:
    """Each document as one chunk, deduplicated."""
    rows = _docs(spark, sf_dir, "lang", "source").withColumn("ord", F.col("blob_id") * (1 << 20))
    rows = rows.withColumn("size", F.octet_length("content").cast("long"))
    return ops.dedup(rows, EngineConfig(), F.md5("content")).drop("content")


@query(f"{_DEDUP} SELECT ord, fp, first_ord, first_ord < ord AS is_dup FROM d")
def dedup_first_occurrence(spark, sf_dir):
    return _whole(spark, sf_dir).select("ord", "fp", "first_ord", "is_dup")


_SUMS = "count(*) AS n, count_if(first_ord < ord)::BIGINT AS dups, sum(size)::BIGINT AS bytes, sum(CASE WHEN first_ord < ord THEN 0 ELSE size END)::BIGINT AS unique_bytes"


def _sums() -> list:
    return [
        F.count("*").alias("n"), F.count_if("is_dup").alias("dups"), F.sum("size").cast("long").alias("bytes"),
        F.sum(F.when(F.col("is_dup"), 0).otherwise(F.col("size"))).cast("long").alias("unique_bytes"),
    ]


@query(f"{_DEDUP}, s AS (SELECT {_SUMS} FROM d) SELECT *, bytes / unique_bytes::DOUBLE AS dedup_ratio FROM s")
def dedup_summary(spark, sf_dir):
    return _whole(spark, sf_dir).agg(*_sums()).withColumn("dedup_ratio", F.col("bytes") / F.col("unique_bytes"))


@query(f"{_DEDUP} SELECT lang, {_SUMS} FROM d GROUP BY lang")
def dedup_ratio_by_lang(spark, sf_dir):
    return _whole(spark, sf_dir).groupBy("lang").agg(*_sums())


@query(f"{_DEDUP} SELECT lang, source, {_SUMS} FROM d GROUP BY ROLLUP (lang, source)")
def dedup_rollup(spark, sf_dir):
    return _whole(spark, sf_dir).rollup("lang", "source").agg(*_sums())


@query("""
WITH c AS (SELECT conv_id, turn, md5(coalesce(text, '')) AS fp FROM conversations)
SELECT fp, count(*) AS n, min(conv_id * 4096 + turn) AS first_ord FROM c GROUP BY fp""")
def conversation_dedup(spark, sf_dir):
    rows = _read(spark, sf_dir, "conversations").select((F.col("conv_id") * 4096 + F.col("turn")).alias("ord"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("fp"))
    return rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


@query("""
SELECT source, count(*) AS n, count_if(EXISTS (SELECT 1 FROM documents o WHERE o.source <> d.source AND md5(o.text) = md5(d.text)))::BIGINT AS elsewhere
FROM documents d GROUP BY source""")
def cross_source_overlap(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("fp"))
    spread = rows.where("source IS NOT NULL").groupBy("fp").agg(F.count_distinct("source").alias("k"))
    found = rows.join(spread, "fp", "left")
    return found.groupBy("source").agg(F.count("*").alias("n"), F.count_if((F.col("k") > 1) & F.col("source").isNotNull()).alias("elsewhere"))


_KEYS = """WITH k AS (SELECT l_orderkey * 8 + l_linenumber AS ord, 0 AS sf_pos, l_partkey AS sf_value FROM lineitem
  UNION ALL SELECT l_orderkey * 8 + l_linenumber, 1, l_suppkey FROM lineitem),
u AS (SELECT DISTINCT ord, sf_pos, sf_value FROM k)"""


def _table_keys(spark, sf_dir) -> DataFrame:
    """Index keys from a table of numbers: order lines in order, keyed by part and by supplier."""
    rows = _read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), F.array("l_partkey", "l_suppkey").alias("sfp"))
    return ops.index_keys(rows).distinct()


@query(f"""{_KEYS}, l AS (SELECT *, lag(ord) OVER (PARTITION BY sf_pos, sf_value ORDER BY ord) AS base FROM u)
SELECT ord, arg_min(base, sf_pos * 1e15 + base) AS base_ord, min(sf_pos)::INTEGER AS sf_pos FROM l WHERE base IS NOT NULL GROUP BY ord""")
def latest_base(spark, sf_dir):
    return ops.latest_base(_table_keys(spark, sf_dir))


@query(f"{_KEYS} SELECT sf_pos::INTEGER AS sf_pos, count(DISTINCT sf_value) AS n_keys FROM u GROUP BY sf_pos")
def index_size(spark, sf_dir):
    return ops.index_size(_table_keys(spark, sf_dir))


@query(f"""{_KEYS}, l AS (SELECT *, lag(ord) OVER (PARTITION BY sf_pos, sf_value ORDER BY ord) AS base_ord FROM u)
SELECT ord, base_ord, count(*) AS n_shared FROM l WHERE base_ord IS NOT NULL GROUP BY ord, base_ord""")
def similar_pairs(spark, sf_dir):
    return ops.similar_pairs(_table_keys(spark, sf_dir))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) AS size, CAST(floor(l_extendedprice * (1 - l_discount)) AS BIGINT) AS self_size,
  CASE WHEN l_returnflag <> 'N' THEN CAST(floor(l_quantity * 800) AS BIGINT) END AS delta_size FROM lineitem),
k AS (SELECT *, CASE WHEN delta_size IS NOT NULL AND least(self_size, size) > delta_size THEN 'delta' WHEN self_size < size THEN 'lossless' ELSE 'raw' END AS kind FROM s)
SELECT kind, count(*) AS n, sum(size)::BIGINT AS bytes FROM k GROUP BY kind""")
def choose_encoding(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").select(
        F.floor("l_extendedprice").cast("long").alias("size"), F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("long").alias("self_size"),
        F.when(F.col("l_returnflag") != "N", F.floor(F.col("l_quantity") * 800).cast("long")).alias("delta_size"),
    )
    return rows.withColumn("kind", ops.choose(F.col("size"), F.col("self_size"), F.col("delta_size"))).groupBy("kind").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("""
SELECT o_orderkey, o_custkey, bit_count(~xor(o_orderkey * 2654435761, o_custkey * 40503))::INTEGER AS anti_hamming,
  bit_count(xor(o_orderkey * 2654435761, o_custkey * 40503))::INTEGER AS hamming, bit_count((o_orderkey * 2654435761) & (o_custkey * 40503))::INTEGER AS shared_ones FROM orders""")
def similarity_measures(spark, sf_dir):
    a, b = F.col("o_orderkey") * 2654435761, F.col("o_custkey") * 40503
    return _read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", ops.anti_hamming(a, b).alias("anti_hamming"), ops.hamming(a, b).alias("hamming"), ops.shared_ones(a, b).alias("shared_ones")
    )


@query("""
WITH p AS (SELECT d.doc_id, encode(coalesce(d.text, '')) AS a, encode(coalesce(o.text, '')) AS b FROM documents d LEFT JOIN documents o ON o.doc_id = d.doc_id + 1)
SELECT doc_id, octet_length(a)::INTEGER AS new_bytes, octet_length(b)::INTEGER AS base_bytes, TRUE AS ok FROM p""")
def codec_roundtrip(spark, sf_dir):
    """Every document against the one after it, through every codec; ok if all give it back."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("a"))
    pairs = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b")), "doc_id", "left")

    @F.pandas_udf("boolean")
    def ok(new: pd.Series, base: pd.Series) -> pd.Series:
        def same(n: bytes, b: bytes) -> bool:
            deltas = all(codecs.DECODERS[k](e(n, b), b) == n for k, e in codecs.ENCODERS.items())
            bits = [bytescan.bitmap_sketch(x) for x in (n, b)]
            guided = codecs.gdelta_decode(codecs.gdelta_sketch_encode(n, b, *bits), b) == n
            return deltas and guided and all(codecs.decompress(codecs.compress(n, k), len(n), k) == n for k in ("zstd", "lz4"))

        return pd.Series([same(n, b) for n, b in zip(new, base)])

    b = F.coalesce("b", F.lit(b""))
    return pairs.select("doc_id", F.octet_length("a").alias("new_bytes"), F.octet_length(b).alias("base_bytes"), ok("a", b).alias("ok"))


def _chunk_rows(spark, sf_dir, **options) -> DataFrame:
    return ops.content_chunks(_docs(spark, sf_dir), replace(SMALL, **options)).select("blob_id", "idx", "ord", "offset", "size", "bits", F.md5("data").alias("digest"))


def _chunk_query(kind: str, config: EngineConfig):
    def run(spark, sf_dir):
        chunks = ops.content_chunks(_docs(spark, sf_dir), replace(config, chunker=kind))
        return chunks.select("blob_id", "idx", "ord", "offset", "size", "bits", F.md5("data").alias("digest"))

    return run


for _name, _kind, _config in (
    ("cdc_chunks_docs", "normalized", SMALL), ("cdc_two_bytes", "normalized2", SMALL), ("cdc_plain", "plain", SMALL), ("cdc_plain_two_bytes", "plain2", SMALL),
    ("cdc_unified", "unified", SMALL), ("cdc_chunks_default", "normalized", EngineConfig()), ("cdc_unified_default", "unified", EngineConfig()),
):
    QUERIES[_name] = _chunk_query(_kind, _config)
    QUERIES[_name].__name__ = _name
    ORACLE[_name] = oracles.chunks_sql(_kind, _config)


@query(oracles.small_sql(SMALL))
def small_chunks(spark, sf_dir):
    rows = _chunk_rows(spark, sf_dir)
    return rows.groupBy((F.col("size") <= 1024).alias("small")).agg(F.count("*").alias("n"), F.sum(F.col("size").cast("long")).alias("bytes"))


def _sketched(spark, sf_dir, **options) -> reduction.Reduction:
    return reduction.reduce(_docs(spark, sf_dir), replace(SMALL, **options))


def _numbered(column: str, prefix: str, n: int) -> list:
    return [F.get(column, F.lit(k)).alias(f"{prefix}{k}") for k in range(n)]


@query(oracles.bitmap_sql(SMALL))
def bitmap_sketches(spark, sf_dir):
    return _sketched(spark, sf_dir).sketched.select("ord", "bits", *_numbered("sfp", "sf", 3), F.bit_count("bits").alias("ones"))


@query()
def odess_sketches(spark, sf_dir):
    return _sketched(spark, sf_dir, sketch="odess", features=12).sketched.select("ord", "features", "sfp")


@query(oracles.ntransform_sql(SMALL, 12))
def ntransform_sketches(spark, sf_dir):
    return _sketched(spark, sf_dir, sketch="ntransform", features=12).sketched.select("ord", *_numbered("features", "f", 12))


@query()
def finesse_sketches(spark, sf_dir):
    return _sketched(spark, sf_dir, sketch="finesse", features=12).sketched.select("ord", "features", "sfp")


@query(oracles.popcount_sql(SMALL))
def popcount_histogram(spark, sf_dir):
    return _sketched(spark, sf_dir).sketched.groupBy(F.bit_count("bits").alias("ones")).agg(F.count("*").alias("n"))


@query(oracles.hits_sql())
def mask_hits(spark, sf_dir):
    @F.pandas_udf("array<long>")
    def hits(s: pd.Series) -> pd.Series:
        return s.map(bytescan.bitmap_hits)

    rows = _docs(spark, sf_dir).select(F.posexplode(hits("content")).alias("mask", "n"))
    return rows.groupBy("mask").agg(F.sum("n").alias("n"))


@query(oracles.similar_sql(SMALL))
def similar_chunks(spark, sf_dir):
    return _sketched(spark, sf_dir).candidates


@query(oracles.fetch_sql(SMALL))
def base_fetch_join(spark, sf_dir):
    r = _sketched(spark, sf_dir)
    rows = ops.base_bytes(r.sketched, r.candidates)
    return rows.select("ord", "base_ord", "size", "base_size", F.md5("data").alias("digest"), F.md5("base_data").alias("base_digest"))


@query()
def cluster_base(spark, sf_dir):
    return _sketched(spark, sf_dir, index="cluster").candidates


@query()
def reduction_report(spark, sf_dir):
    return _sketched(spark, sf_dir).report()


@query()
def reduction_report_default(spark, sf_dir):
    """At the default sizes, over pages."""
    return reduction.reduce(_pages(spark, sf_dir), EngineConfig()).report()


@query()
def reduction_report_baseline(spark, sf_dir):
    return _sketched(spark, sf_dir, chunker="fixed", sketch="odess", features=12, delta_post_compress=False).report()


@query("""
WITH c AS (SELECT octet_length(encode(coalesce(text, '')))::BIGINT AS size, md5(coalesce(text, '')) AS fp, doc_id FROM documents),
d AS (SELECT *, min(doc_id) OVER (PARTITION BY fp) AS first FROM c WHERE size > 0)
SELECT count(*) AS total_chunks, sum(size)::BIGINT AS total_bytes, count_if(doc_id > first)::BIGINT AS dup_chunks,
  sum(CASE WHEN doc_id > first THEN size ELSE 0 END)::BIGINT AS dup_bytes, count_if(size <= 4096)::BIGINT AS small_chunks,
  sum(CASE WHEN doc_id > first THEN 0 ELSE size END)::BIGINT AS encoded_bytes, TRUE AS restores FROM d""")
def report_of_whole_texts(spark, sf_dir):
    """Texts as one chunk each: what the report counts, its classes' sum, and whether the store gives the texts back."""
    config = replace(SMALL, chunker="fixed", normal_size=1 << 30)
    docs = _docs(spark, sf_dir)
    r = reduction.reduce(docs, config)
    path = f"{shared.folder(spark)}/store-{uuid.uuid4().hex}"
    reduction.store(r, path)
    back = reduction.restore(spark, path, config).withColumnRenamed("content", "restored")
    wrong = docs.where(F.octet_length("content") > 0).join(back, "blob_id", "left").agg(F.count_if(~F.col("content").eqNullSafe(F.col("restored"))).alias("wrong"))
    encoded = F.col("delta_bytes") + F.col("lossless_bytes") + F.col("raw_bytes")
    one = r.report().select("total_chunks", "total_bytes", "dup_chunks", "dup_bytes", "small_chunks", encoded.alias("encoded_bytes"))
    both = one.unionByName(wrong, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in one.columns], (F.max("wrong") == 0).alias("restores"))


@query()
def dce_by_similarity(spark, sf_dir):
    return ops.dce_by_similarity(_sketched(spark, sf_dir).encoded)


@query()
def codec_comparison(spark, sf_dir):
    r = _sketched(spark, sf_dir)
    return ops.codec_comparison(r.sketched, r.candidates, r.config)


@query()
def codec_ratio_distribution(spark, sf_dir):
    r = _sketched(spark, sf_dir)
    return ops.distribution(ops.codec_events(ops.codec_sizes(r.sketched, r.candidates, r.config)), "method", "block_reduction_ratio")


@query("""
WITH s AS (SELECT *, CAST(floor(l_extendedprice) AS BIGINT) AS size, CAST(floor(l_quantity * 800) AS BIGINT) AS stored, (l_orderkey * 7 + l_linenumber) % 65 AS sim FROM lineitem)
SELECT sim::INTEGER AS sim, sum(size - stored)::BIGINT AS reduced, sum(stored)::BIGINT AS stored, 100 * sum(size - stored)::BIGINT / nullif(sum(stored)::BIGINT, 0)::DOUBLE AS dce
FROM s WHERE l_returnflag <> 'N' GROUP BY sim""")
def dce_of_sizes(spark, sf_dir):
    """The efficiency by similarity over sizes from a table of numbers."""
    rows = _read(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") != "N", "delta").otherwise("raw").alias("kind"), ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 65).cast("int").alias("sim"),
        F.floor("l_extendedprice").cast("long").alias("size"), F.floor(F.col("l_quantity") * 800).cast("long").alias("stored_size"),
    )
    return ops.dce_by_similarity(rows)


@query(f"""{_KEYS}, k2 AS (SELECT sf_pos, count(DISTINCT sf_value) AS n FROM u GROUP BY sf_pos)
SELECT ((SELECT count(DISTINCT ord) FROM u) * 12 + (SELECT sum(n) FROM k2) * 16)::BIGINT AS bytes""")
def index_memory(spark, sf_dir):
    keys = _table_keys(spark, sf_dir)
    size = ops.index_size(keys).agg(F.sum("n_keys").alias("k"))
    both = keys.agg(F.count_distinct("ord").alias("u")).unionByName(size, allowMissingColumns=True)
    return both.agg(ops.index_memory(F.max("u"), F.max("k"), 2).alias("bytes"))


@query(f"""{_DEDUP}, o AS (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS k, count(*) OVER () AS total FROM d WHERE size > 0)
SELECT ord, fp FROM o WHERE k < total // 3""")
def limit_fraction(spark, sf_dir):
    """The first third of the stream."""
    return ops.limited(_whole(spark, sf_dir).where("size > 0"), 1 / 3).select("ord", "fp")


@query("""
SELECT event_id, format('{:d}s {:d}ms {:d}us', m // 1000000, m // 1000 % 1000, m % 1000) AS took,
  CASE WHEN m >= 1048576 THEN format('{:.2f} MB', m / 1048576.0) WHEN m >= 1024 THEN format('{:.2f} KB', m / 1024.0) ELSE format('{:d} B', m) END AS size,
  strftime(ts, '%Y-%m-%d_%H:%M:%S') AS moment
FROM (SELECT *, (event_id * 7919) % 5000000 AS m FROM events)""")
def report_formats(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").withColumn("m", F.col("event_id") * 7919 % 5_000_000)
    return rows.select("event_id", formats.duration(F.col("m")).alias("took"), formats.byte_size(F.col("m")).alias("size"), formats.moment(F.col("ts")).alias("moment"))


@query("""
SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name, regexp_extract(url, '([^/]*)$', 1) || '_all.csv' AS result FROM pages""")
def file_names(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", formats.file_name(F.col("url")).alias("name"), formats.result_name(F.col("url"), F.lit("all")).alias("result"))


@query("""
WITH x AS (SELECT l_orderkey * 8 + l_linenumber AS ord, [l_partkey, l_suppkey, l_orderkey, l_linenumber::BIGINT, l_partkey + 1, l_suppkey + 1] AS f FROM lineitem)
SELECT ord, f[1] + f[3] + f[5] AS even, f[2] + f[4] + f[6] AS odd, list_max(f) AS best FROM x""")
def strided_groups(spark, sf_dir):
    """Features in strided groups, as super-features take them."""
    f = F.array("l_partkey", "l_suppkey", "l_orderkey", F.col("l_linenumber").cast("long"), F.col("l_partkey") + 1, F.col("l_suppkey") + 1)
    rows = _read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), f.alias("f"))
    total = lambda k: F.aggregate(F.filter("f", lambda x, i: i % 2 == k), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("ord", total(0).alias("even"), total(1).alias("odd"), F.array_max("f").alias("best"))


@query("""
SELECT doc_id, md5(coalesce(text, '')) AS md5, sha1(coalesce(text, '')) AS sha1, sha256(coalesce(text, '')) AS sha256 FROM documents""")
def digests(spark, sf_dir):
    data = F.coalesce("text", F.lit("")).cast("binary")
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(data).alias("md5"), F.sha1(data).alias("sha1"), F.sha2(data, 256).alias("sha256"))


@query("""
WITH p AS (SELECT d.doc_id, hex(encode(coalesce(d.text, ''))) AS a, hex(encode(coalesce(o.text, ''))) AS b FROM documents d LEFT JOIN documents o ON o.doc_id = d.doc_id + 1),
n AS (SELECT *, length(a) // 2 AS na, length(b) // 2 AS nb FROM p),
k AS (SELECT doc_id, na, nb, least(na, nb) AS m, list_min(list_filter(range(1, least(na, nb) + 1), lambda i: substr(a, 2 * i - 1, 2) <> substr(b, 2 * i - 1, 2))) AS first,
  list_min(list_filter(range(1, least(na, nb) + 1), lambda i: substr(a, 2 * (na - i) + 1, 2) <> substr(b, 2 * (nb - i) + 1, 2))) AS last FROM n)
SELECT doc_id, coalesce(first - 1, m)::INTEGER AS prefix, coalesce(last - 1, m)::INTEGER AS suffix FROM k""")
def common_ends(spark, sf_dir):
    """The common prefix and suffix of every document and the one after it: the first step of a delta."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("a"))
    pairs = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b")), "doc_id", "left")

    @F.pandas_udf("struct<prefix: int, suffix: int>")
    def ends(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(codecs.common_prefix(x, y or b""), codecs.common_suffix(x, y or b"")) for x, y in zip(a, b)], columns=["prefix", "suffix"])

    return pairs.select("doc_id", ends("a", "b").alias("e")).select("doc_id", "e.prefix", "e.suffix")


@query("""
WITH p AS (SELECT d.doc_id, octet_length(encode(coalesce(d.text, '')))::BIGINT AS n FROM documents d)
SELECT doc_id, n AS new_bytes, TRUE AS merged, TRUE AS streamed, TRUE AS recoded, TRUE AS many_references FROM p""")
def delta_tools_roundtrip(spark, sf_dir):
    """Every document against the two after it: deltas merged without the base, fed in pieces, written anew, several references."""
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("a"))
    return _delta_tools(docs, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _delta_tools(docs: DataFrame, parts: int) -> DataFrame:
    """Documents are dealt by blocks of 64 ids, a block with copies of the two documents after it, and met from the last id to the
    first: each delta is made once, and of a repeated id the first row by its text is what others are compared with."""
    block = F.coalesce(F.shiftright("doc_id", 6), F.pmod(F.xxhash64("a"), F.lit(1 << 20)))
    rows = docs.withColumn("own", block).withColumn("block", F.explode(F.when(F.pmod("doc_id", F.lit(64)) < 2, F.array("own", F.col("own") - 1)).otherwise(F.array("own"))))
    rows = rows.repartition(parts, "block").sortWithinPartitions("block", F.desc_nulls_last("doc_id"), "a")
    names = ["doc_id", "new_bytes", "merged", "streamed", "recoded", "many_references"]

    def run(batches):
        texts: dict[int, bytes] = {}
        deltas: dict[int, bytes] = {}
        for batch in batches:
            out = []
            for i, x, own, at in zip(*(batch[c].to_pylist() for c in ("doc_id", "a", "own", "block"))):
                y, z = (texts.get(i + k, b"") if i is not None else b"" for k in (1, 2))
                delta = codecs.vcdiff_encode(x, y) if own == at else None
                if own == at:
                    before = deltas.get(i + 1) if i is not None else None
                    out.append((i, len(x), *_tools_agree(x, y, z, delta, codecs.vcdiff_encode(y, z) if before is None else before)))
                if i is not None and i not in texts:
                    texts = {i: x} | {k: texts[k] for k in (i + 1,) if k in texts}
                    deltas = {} if delta is None else {i: delta}
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema) if out else pa.RecordBatch.from_pylist([], schema)

    schema = pa.schema([*((c, pa.int64()) for c in names[:2]), *((c, pa.bool_()) for c in names[2:])])
    return rows.mapInArrow(run, "doc_id long, new_bytes long, merged boolean, streamed boolean, recoded boolean, many_references boolean")


def _tools_agree(x: bytes, y: bytes, z: bytes, delta: bytes, before: bytes) -> tuple[bool, bool, bool, bool]:
    """merged, streamed, recoded, many_references, of the deltas of x to y and of y to z."""
    merged = codecs.vcdiff_decode(codecs.merge_deltas(before, delta, len(z)), z) == x
    coder = codecs.vcdiff_stream(y, window=700)
    stream = b"".join([*(coder.feed(x[i : i + 500]) for i in range(0, len(x), 500)), coder.finish()])
    packed = vcdiff.recode(delta, secondary=True, app=b"doc")
    refs = codecs.zdelta_decode(codecs.zdelta_encode(x, y, z), y, z) == x
    return merged, codecs.vcdiff_decode(stream, y) == x, codecs.vcdiff_decode(packed, y) == x and vcdiff.recode(packed, False, b"") == delta, refs
