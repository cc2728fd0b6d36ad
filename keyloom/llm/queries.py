"""The queries of the operators in this folder, with production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import imatch, langid, minhash, mixing, packing, pii, sharding, telephony, tokenfile, urlfilter
from .common import read_table

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", mixing.text_size().alias("size"), mixing.text_spin().alias("spin"))
    return mixing.mix(docs, size=F.col("size"), spin=F.col("spin")).drop("spin")


def op2_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1
    docs = read_table(spark, sf_dir, "documents").select("doc_id", size.alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    out = sharding.histogram_shards(docs, 16, F.col("size"), F.col("text_hash"), F.col("doc_id"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonyms(read_table(spark, sf_dir, "documents"), pii.key_of(spark))


def op4_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return tokenfile.read_tokens(tokenfile.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1))


def op5_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify_keys(docs, langid.train(docs))


def op6_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited_fingerprints(read_table(spark, sf_dir, "documents"))


def op7_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents")).drop("text_hash")


def op8_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.digests(telephony.store(read_table(spark, sf_dir, "documents")))


def op9_redirect_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"), RULES).drop("url", "html")


def op10_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_pfair_mixing, op2_histogram_shards, op3_feistel_pseudonyms, op4_simple8b_tokens, op5_crf_language, op6_imatch_fingerprints, op7_circulant_minhash, op8_telephony_audio, op9_redirect_verdicts, op10_sum_of_squares_packing, pipeline)
    return {f.__name__: f for f in found}


#: op7: exact Jaccard over all pairs that share a shingle, and components by recursion (for small tables).
_NEAR = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
c AS (SELECT min(doc_id) AS node, s, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM s WHERE len(s) > 0) GROUP BY s),
t AS (SELECT node, n, unnest(s) AS t FROM c),
p AS (SELECT a.node AS x, b.node AS y FROM t a JOIN t b ON a.t = b.t AND a.node < b.node GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r AS (SELECT node AS x, node AS y FROM c UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
k AS (SELECT x AS node, min(y) AS component FROM r GROUP BY x)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(k.component, d.doc_id) AS component_id, coalesce(k.component, d.doc_id) = d.doc_id AS kept
FROM s d LEFT JOIN c ON c.s = list_sort(d.s) LEFT JOIN k USING (node)
"""

#: op9: no page of these tables has a canonical link or a refresh, so addresses are the components.
_URLS = r"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(url, '://[^?#]*\?([^#]*)', 1), '') AS q FROM pages),
a AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(regexp_replace(path, '\.html?$', ''), '/+$', '') || '?' ||
  regexp_replace(regexp_replace(q, '(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&', '') END AS address FROM u),
rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
hit AS (SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS ruled FROM a JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
known AS (SELECT address, min(ruled) AS aliased FROM a JOIN hit USING (page_id) WHERE address IS NOT NULL GROUP BY address)
SELECT a.page_id, a.host, a.path, hit.rule, coalesce(hit.ruled, known.aliased, 'allow') AS verdict FROM a LEFT JOIN hit USING (page_id) LEFT JOIN known USING (address)
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_imatch_fingerprints": imatch.ORACLE, "op7_circulant_minhash": _NEAR, "op9_redirect_verdicts": _URLS}
