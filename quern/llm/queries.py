"""The corpus operators as queries over the driver tables, with their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontam, gam, langid, mixing, neardup, pii, rules, secrets, sharding, urls
from quern.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]

#: Every so manieth page gives its URL to the list that op6 filters by.
LISTED_EVERY = 16


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, pages.where(F.col("page_id") % LISTED_EVERY == 0))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(read(spark, sf_dir, "documents"))


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_mixing,
        op3_pii,
        op4_sharding,
        op5_near_duplicates,
        op6_url_filter,
        op7_quality_rules,
        op8_language,
        op9_quality_model,
        op10_secrets,
    )
}

_MIXING = f"""
WITH t AS (
  SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+'))) AS tokens FROM documents GROUP BY source
), w AS (
  SELECT source, tokens, CASE WHEN tokens > 0 THEN pow(tokens::DOUBLE, {mixing.SMOOTHING}) ELSE 0 END AS weight FROM t
), r AS (
  SELECT source, coalesce(CASE WHEN tokens > 0 AND sum(weight) OVER () > 0
    THEN weight / sum(weight) OVER () * (sum(tokens) OVER ())::DOUBLE / tokens END, 0) AS rate FROM w
), n AS (
  SELECT d.*, (floor(rate) + CASE WHEN ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0
    < rate - floor(rate) THEN 1 ELSE 0 END)::INT AS copies
  FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, text, lang, source, n_chars, unnest(range(copies))::INT AS copy FROM n WHERE copies > 0
"""

_SHARDING = f"""
WITH RECURSIVE g AS (
  SELECT md5(coalesce(text, '')) AS key, sum(length(coalesce(text, '')))::BIGINT AS size FROM documents GROUP BY 1
), o AS (
  SELECT key, size, row_number() OVER (ORDER BY size DESC, key) AS rn FROM g
), lpt AS (
  SELECT 0::BIGINT AS rn, list_transform(range({sharding.SHARDS}), lambda x: 0::BIGINT) AS loads, ''::VARCHAR AS key, -1::INT AS shard
  UNION ALL
  SELECT o.rn, list_transform(range({sharding.SHARDS}), lambda x: loads[x + 1] + CASE WHEN x + 1 = list_position(loads, list_min(loads)) THEN o.size ELSE 0 END),
    o.key, (list_position(loads, list_min(loads)) - 1)::INT
  FROM lpt JOIN o ON o.rn = lpt.rn + 1
)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.shard FROM documents d JOIN lpt l ON md5(coalesce(d.text, '')) = l.key AND l.rn > 0
"""


def _canonical(url: str) -> str:
    part = lambda i: f"regexp_extract(trim({url}), '{urls.PARTS}', {i})"
    kept = f"list_sort(list_filter(string_split({part(5)}, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{urls.TRACKING}')))"
    host = f"regexp_replace(lower({part(2)}), '^www[.]', '')"
    path = f"regexp_replace(regexp_replace({part(4)}, '/index[.]html?$', '/'), '/+$', '')"
    return f"""CASE WHEN {host} <> '' THEN {host}
    || CASE WHEN {part(3)} IN ('', '80', '443') THEN '' ELSE ':' || {part(3)} END
    || {path} || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END END"""


_URLS = f"""
WITH p AS (SELECT page_id, url, {_canonical('url')} AS canonical_url FROM pages),
l AS (SELECT DISTINCT canonical_url FROM p WHERE page_id % {LISTED_EVERY} = 0 AND canonical_url IS NOT NULL)
SELECT p.page_id, p.url, p.canonical_url, l.canonical_url IS NOT NULL AS listed FROM p LEFT JOIN l ON p.canonical_url = l.canonical_url
"""

ORACLE_SQL: dict[str, str] = {"op2_mixing": _MIXING, "op4_sharding": _SHARDING, "op6_url_filter": _URLS}
