"""Queries of the training-data operators, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from deltaloom.llm import decontam, hostrep, katz, langid, mixing, pqdedup, simhash, tokenbin, toxicity, warc
from deltaloom.llm.common import tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, _read(spark, sf_dir, "documents"))


@query
def op2_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 not toxic, 1 toxic in a text of good quality (or none given), 2 toxic and of low quality."""
    grade = F.col("toxic") * (1 + F.coalesce((F.col("quality") == 0).cast("int"), F.lit(0)))
    labels = _read(spark, sf_dir, "labels").select("doc_id", grade.alias("grade"))
    return toxicity.severities(spark, _read(spark, sf_dir, "documents"), labels)


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digest(spark, _read(spark, sf_dir, "pages"))


ORACLE["op4_warc"] = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM last AND last IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM m
"""


@query
def op5_pq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pqdedup.near_duplicates(spark, _read(spark, sf_dir, "embeddings"))


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample(spark, _read(spark, sf_dir, "documents"))


@query
def op8_token_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.digest(spark, _read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


URL_RULES = [
    hostrep.Rule("block", "com", "/en/"),
    hostrep.Rule("allow", "example.com", "/en/7"),
    hostrep.Rule("allow", "net", "/de/"),
    hostrep.Rule("block", "example.net", "/de/8"),
    hostrep.Rule("block", "org", "/es/"),
]
URL_THRESHOLD, URL_Z = 0.2, 1.645


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: a page is bad if its document (the number in its path) is labelled toxic or of low quality."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    labels = _read(spark, sf_dir, "labels").select("doc_id", ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    seen = pages.select(
        hostrep.url_host(F.col("url")).alias("host"),
        F.expr("try_cast(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]+)', 1) as bigint)").alias("doc_id"),
    )
    return hostrep.url_filter(spark, pages, seen.join(labels, "doc_id"), URL_RULES, URL_THRESHOLD, URL_Z)


def _url_sql() -> str:
    az, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    two = "array_to_string(list_slice(string_split(host, '.'), -2, -1), '.')"
    three = "array_to_string(list_slice(string_split(host, '.'), -3, -1), '.')"
    long_suffix = f"regexp_matches(host, '{hostrep.TWO_LABELS}')"
    rules = ", ".join(f"({i}, '{r.verdict}', '{r.host}', '{r.path}')" for i, r in enumerate(URL_RULES))

    def strength(level: str) -> str:
        between = "((sum(n * pow(bad / n - m, 2)) - sum(m * (1 - m))) / greatest(sum(n) - sum(n * n) / sum(n), 1e-9))"
        return f"(SELECT coalesce(greatest(1.0, least(1000.0, CASE WHEN {between} > 0 THEN sum(m * (1 - m)) / count(*) / {between} - 1 ELSE 1000.0 END)), 1000.0) FROM {level})"

    return f"""
WITH split AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
judged AS (
  SELECT page_id, url, CASE WHEN rest IS NULL THEN '' ELSE translate(regexp_extract(rest, '^([^/?#]*)', 1), '{az}', '{low}') END AS host,
    CASE WHEN rest IS NULL THEN '' ELSE regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) END AS path FROM split),
outcomes AS (
  SELECT host, (toxic = 1 OR quality = 0) AS bad FROM judged
  JOIN labels ON doc_id = try_cast(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]+)', 1) AS BIGINT)),
hosts0 AS (
  SELECT host, CASE WHEN regexp_matches(host, '^[0-9.]+(:[0-9]+)?$') THEN host WHEN {long_suffix} THEN {three} ELSE {two} END AS domain,
    CASE WHEN {long_suffix} THEN {two} ELSE list_last(string_split(host, '.')) END AS suffix,
    count(*)::DOUBLE AS n, sum(bad::INT)::DOUBLE AS bad
  FROM outcomes WHERE bad IS NOT NULL AND host <> '' GROUP BY 1, 2, 3),
domains0 AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hosts0 GROUP BY 1, 2),
suffixes0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT sum(bad) / sum(n) FROM hosts0) AS m FROM domains0 GROUP BY 1),
suffixes1 AS (SELECT *, {strength('suffixes0')} AS k FROM suffixes0),
domains1 AS (SELECT d.*, (s.bad + s.k * s.m) / (s.n + s.k) AS m FROM domains0 d JOIN suffixes1 s USING (suffix)),
domains2 AS (SELECT *, {strength('domains1')} AS k FROM domains1),
hosts1 AS (SELECT h.*, (d.bad + d.k * d.m) / (d.n + d.k) AS m FROM hosts0 h JOIN domains2 d USING (suffix, domain)),
hosts2 AS (SELECT *, {strength('hosts1')} AS k FROM hosts1),
hosts3 AS (SELECT *, (bad + k * m) / (n + k) AS rate FROM hosts2),
bad_hosts AS (SELECT host, true AS bb FROM hosts3 WHERE rate - {URL_Z} * sqrt(rate * (1 - rate) / (n + k + 1)) > {URL_THRESHOLD}),
rules(i, verdict, rhost, rpath) AS (VALUES {rules}),
keys AS (SELECT DISTINCT host, path FROM judged),
best AS (
  SELECT host, path, arg_max(verdict, length(rhost || rpath) * 100 - i) AS rv, arg_max(rhost || rpath, length(rhost || rpath) * 100 - i) AS rule
  FROM keys JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY 1, 2)
SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN bb IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN best USING (host, path) LEFT JOIN bad_hosts USING (host)
"""


ORACLE["op9_url_filter"] = _url_sql()


@query
def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark, _read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


@query
def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(spark, _read(spark, sf_dir, "documents"))
