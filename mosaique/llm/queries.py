"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embedding_dedup, html_text, licenses, packing, pii, quality, simhash, url_filters, warc

URL_RULES = [
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
]


#: In production the key comes from a secret store.
PII_KEY = b"surrogates-v1"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(_docs(spark, sf_dir).select("doc_id", "text"), PII_KEY, count="n_replaced")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_docs(spark, sf_dir))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_docs(spark, sf_dir))


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack_documents(_docs(spark, sf_dir), *tokenizer_paths()))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_docs(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_pii_surrogates, op2_url_filters, op3_warc_revisits, op4_license_scan, op5_benchmark_decontamination, op6_quality_classifier,
        op7_best_fit_packing, op8_embedding_near_dedup, op9_html_extraction, op10_simhash_near_dedup,
    )}


#: Relative links with dot segments, links relative to a page's base, and variants aside (tests hold these by example).
OP2_SQL = r"""
with recursive parts as (
  select page_id, html, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as rest from pages
), urls as (
  select page_id, html,
    translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
  from parts
), rules(v, h, p) as (values
  ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), seen as (
  select host, path, regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'), '<script.*?</script>', ' ', 'gis') as s from urls where host <> '' and regexp_matches(html, 'canonical|refresh', 'i')
), tags as (
  select host, path, regexp_extract(regexp_extract(s, '<link\s(?:[^>]*\s)?rel\s*=\s*["'']?canonical\b[^>]*>', 0, 'is'), '\shref\s*=\s*["'']?([^"''\s>]+)', 1, 'i') as link from seen
  union all
  select host, path, regexp_extract(regexp_extract(s, '<meta\s(?:[^>]*\s)?http-equiv\s*=\s*["'']?refresh\b[^>]*>', 0, 'is'), '\burl\s*=\s*["'']?([^"''\s>]+)', 1, 'i') from seen
), targets as (
  select host, path, case when regexp_matches(link, '^([A-Za-z][A-Za-z0-9+.-]*:)?//') then regexp_replace(link, '^[^/]*//', '')
    when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') then '' when regexp_matches(link, '^[?#]') then host || path when starts_with(link, '/') then host || link
    else host || regexp_replace(case when path = '' then '/' else path end, '[^/]*$', '') || link end as rest from tags where link <> ''
), edges as (
  select host || ' ' || path as a, lower(regexp_extract(rest, '^[^/?#]*')) || ' ' || regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as b from targets where rest <> ''
), both_ways as (select a, b from edges union select b, a from edges), reach(a, b) as (select a, a from both_ways union select r.a, e.b from reach r join both_ways e on r.b = e.a),
nodes as (select distinct host, path from urls where host <> '' union select split_part(b, ' ', 1), substr(b, strpos(b, ' ') + 1) from edges),
judged as (
  select host, path, arg_min(h || p, (-length(h || p), v, h || p)) as rule, arg_min(v, (-length(h || p), v, h || p)) as verdict
  from nodes join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
  group by host, path
), components as (
  select reach.a as node, case when bool_or(verdict = 'allow') then 'allow' else 'block' end as inherited from reach join judged on reach.b = host || ' ' || path group by 1
)
select page_id, urls.host, urls.path, rule, coalesce(verdict, inherited, 'allow') as verdict
from urls left join judged on judged.host = urls.host and judged.path = urls.path left join components on node = urls.host || ' ' || urls.path
"""

OP3_SQL = """
with bodies as (
  select page_id, encode(coalesce(html, '')) as payload from pages
), hashed as (
  select page_id, octet_length(payload)::bigint as payload_bytes, sha1(payload) as hexed from bodies
), bits as (
  select *, array_to_string(list_transform(range(40), lambda i: bin((strpos('0123456789abcdef', substr(hexed, (i + 1)::int, 1)) + 15)::int)[2:]), '') as b from hashed
), digests as (
  select page_id, payload_bytes,
    array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + list_sum(list_transform(range(5), lambda j: case when substr(b, (k * 5 + j + 1)::int, 1) = '1' then (16 >> j::int) else 0 end)))::int, 1)), '') as payload_digest
  from bits
)
select page_id, payload_bytes, payload_digest,
  case when page_id = max(page_id) over w then 'response' else 'revisit' end as record_type,
  case when page_id <> max(page_id) over w then max(page_id) over w end as refers_to
from digests window w as (partition by payload_digest, payload_bytes)
"""

OP8_SQL = """
with recursive good as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where label is not null and embedding is not null and not list_contains(list_transform(embedding, lambda x: x is null or not isfinite(x)), true)
    and list_sum(list_transform(embedding, lambda x: abs(x))) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from good a join good b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.98
), reach(a, b) as (
  select vec_id, vec_id from embeddings union select r.a, l.b from reach r join links l on r.b = l.a
), counts as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, min(reach.b) as component_id, vec_id = min(reach.b) as kept
from embeddings join reach on reach.a = vec_id left join counts on counts.a = vec_id group by vec_id, n
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": OP2_SQL, "op3_warc_revisits": OP3_SQL, "op8_embedding_near_dedup": OP8_SQL}
