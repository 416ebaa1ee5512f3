"""Registered queries of this subpackage: opN_<name> and the pipeline, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from stratus.llm.ann import nearest
from stratus.llm.common import new_path
from stratus.llm.exact_dedup import exact_duplicates
from stratus.llm.mixing import mix_sources
from stratus.llm.packing import pack_documents
from stratus.llm.prefix_trie import numbered_turns, prefix_trie, rebuild
from stratus.llm.quality import held_out, score, train
from stratus.llm.sharding import shard_documents
from stratus.llm.simhash import near_duplicates
from stratus.llm.token_counts import count_tokens
from stratus.llm.token_store import read_token_store, write_token_store
from stratus.llm.url_filter import host_of, path_of, temporal_filter
from stratus.llm.weighted_sampling import fingerprints_with_edits
from stratus.llm.whitening import whiten

# Where the public vocabularies lie; a parameter of every operator that needs one.
WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"

Query = Callable[[SparkSession, str], DataFrame]


def _pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    out = shard_documents(_read(spark, folder, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_read(spark, folder, "documents"), words=3, bits=2)


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    out = pack_documents(_read(spark, folder, "documents"), vocabulary(WORD_VOCABULARY), capacity=2048, end_id=0)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_token_store(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "token-store")
    write_token_store(_read(spark, folder, "documents"), path, vocabulary(WORD_VOCABULARY), end_id=2)
    return read_token_store(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_weighted_sampling(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints_with_edits(_read(spark, folder, "documents"), samples=32)


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    out = mix_sources(_read(spark, folder, "documents"), weights=(5, 2, 1), cap=3, seed=42)
    return out.select("doc_id", "size", "source_size", "target", "taken", F.array_join(F.col("shards").cast("array<string>"), ",").alias("shards"),
                      F.array_join("places", ",").alias("places"))


def op7_ann(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(_read(spark, folder, "embeddings"), F.col("id") % 50 == 0, k=5)


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents")
    machine = train(docs, _read(spark, folder, "labels"), train_rows=6000)
    return score(docs.select("doc_id", "text"), machine, threshold=0.3) \
        .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def dated_list(pages: DataFrame) -> DataFrame:
    """A dated URL list made from the pages' own hosts, parent domains and host/segment pairs.

    The tables hold no list and no fetch days.  The digest of a key decides whether it is listed, when, and how its history goes on.
    """
    at = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("segment")).filter("host is not null").distinct()
    keys = at.select(F.explode(F.array("host", F.when(F.size(F.split("host", r"\.")) > 2, F.regexp_replace("host", r"^[^.]*\.", "")),
                                       F.when(F.col("segment") != "", F.concat_ws("/", "host", "segment")))).alias("key")).dropna().distinct()
    n = keys.withColumn("n", F.conv(F.substring(F.md5("key"), 1, 4), 16, 10).cast("int"))
    return n.selectExpr("key", "n", "date_add(date'2024-01-01', n % 300) as first").selectExpr("key", """inline(array(
        struct(0 as i, n % 2 = 0 as listed, if(n % 3 = 1, 'allow', 'block') as action, first as since),
        struct(1 as i, n % 4 = 0 as listed, 'unlist' as action, date_add(first, 30 + n % 90) as since),
        struct(2 as i, n % 8 = 0 as listed, 'block' as action, date_add(first, 50 + n % 90 + n % 50) as since)))""") \
        .filter("listed").select(F.concat_ws("#", "key", F.col("i").cast("string")).alias("entry_id"), "key", "action", "since")


def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = _read(spark, folder, "pages")
    captures = pages.withColumn("fetched", F.expr("date_add(date'2024-01-01', cast(page_id * 37 % 400 as int))"))
    return temporal_filter(captures, dated_list(pages))


OP9_SQL = r"""
WITH captures AS (
  SELECT page_id, DATE '2024-01-01' + CAST(page_id * 37 % 400 AS INT) AS fetched, url,
         lower(regexp_replace(regexp_replace(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^[^@]*@', ''), '\.?(:[0-9]*)?$', '')) AS raw,
         regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)', 1) AS segment
  FROM pages),
placed AS (SELECT row_number() OVER () AS id, page_id, fetched, CASE WHEN raw <> '' THEN raw END AS host, coalesce(segment, '') AS segment FROM captures),
keys AS (
  SELECT DISTINCT host AS key FROM placed WHERE host IS NOT NULL
  UNION SELECT DISTINCT regexp_replace(host, '^[^.]*\.', '') FROM placed WHERE len(string_split(host, '.')) > 2
  UNION SELECT DISTINCT host || '/' || segment FROM placed WHERE host IS NOT NULL AND segment <> ''),
numbers AS (SELECT key, CAST('0x' || substr(md5(key), 1, 4) AS INT) AS n FROM keys),
entries AS (
  SELECT key || '#0' AS entry_id, key, CASE WHEN n % 3 = 1 THEN 'allow' ELSE 'block' END AS action, DATE '2024-01-01' + n % 300 AS since FROM numbers WHERE n % 2 = 0
  UNION ALL SELECT key || '#1', key, 'unlist', DATE '2024-01-01' + (n % 300 + 30 + n % 90) FROM numbers WHERE n % 4 = 0
  UNION ALL SELECT key || '#2', key, 'block', DATE '2024-01-01' + (n % 300 + 50 + n % 90 + n % 50) FROM numbers WHERE n % 8 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key, since ORDER BY entry_id DESC, action) AS nth FROM entries),
spans AS (SELECT entry_id, key, action, since, lead(since) OVER (PARTITION BY key ORDER BY since) AS until FROM ranked WHERE nth = 1),
asked AS (
  SELECT id, fetched, array_to_string(list_slice(string_split(host, '.'), i, 99), '.') AS key, len(string_split(host, '.')) - i + 1 AS rank
  FROM placed, generate_series(1, 20) g(i) WHERE i <= greatest(1, len(string_split(host, '.')) - 1)
  UNION ALL SELECT id, fetched, host || '/' || segment, 1000 + len(string_split(host || '/' || segment, '.')) FROM placed WHERE host IS NOT NULL AND segment <> ''),
active AS (
  SELECT a.id, s.entry_id, s.action, row_number() OVER (PARTITION BY a.id ORDER BY a.rank DESC) AS nth, count(*) OVER (PARTITION BY a.id) AS n
  FROM asked a JOIN spans s ON a.key = s.key AND a.fetched >= s.since AND (s.until IS NULL OR a.fetched < s.until) AND s.action <> 'unlist')
SELECT p.page_id, p.host, p.fetched, coalesce(a.n, 0) AS n_active, a.entry_id, a.action, coalesce(a.action, 'allow') <> 'block' AS kept
FROM placed p LEFT JOIN active a ON p.id = a.id AND a.nth = 1
"""


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(_read(spark, folder, "documents"), vocabulary(BYTE_VOCABULARY), limit=512)


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(rebuild(numbered_turns(_read(spark, folder, "conversations")), family=5, heads=9))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(_read(spark, folder, "embeddings"), components=4, scale=256.0)


def op13_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(_read(spark, folder, "documents"))


OP13_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


OP6_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(concat_ws('|', '42', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS place
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight
  FROM rows GROUP BY source),
filled AS (
  SELECT *, sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight,
         sum(3 * source_size) OVER f AS full_size, sum(weight) OVER f AS full_weight
  FROM sources WINDOW f AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
levels AS (
  SELECT *, max(CAST(all_size - (full_size - 3 * source_size) AS DOUBLE) / (all_weight - (full_weight - weight))) OVER () AS unit FROM filled),
targets AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), unit * weight) AS target FROM levels),
passes AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets),
blocks AS (
  SELECT *, target - whole * source_size AS rest, CAST(greatest(1, ceil(source_size / 64)) AS BIGINT) AS block,
         CAST(ceil(source_size / greatest(1, ceil(source_size / 64))) AS BIGINT) AS pass_blocks FROM passes),
tree0 AS (
  SELECT source, unnest(range(CAST(whole * pass_blocks + ceil(rest / block) AS BIGINT))) AS number, 0 AS node FROM blocks),
tree1 AS (
  SELECT source, number, node * 2 + CASE WHEN row_number() OVER (PARTITION BY node ORDER BY draw, source NULLS LAST, number)
    <= count(*) OVER (PARTITION BY node) // 2 THEN 0 ELSE 1 END AS node
  FROM (SELECT *, md5(concat_ws('|', '42', '0', CAST(node AS VARCHAR), CAST(CAST(source IS NULL AS INT) AS VARCHAR), coalesce(source, ''), CAST(number AS VARCHAR))) AS draw FROM tree0)),
tree2 AS (
  SELECT source, number, node * 2 + CASE WHEN row_number() OVER (PARTITION BY node ORDER BY draw, source NULLS LAST, number)
    <= count(*) OVER (PARTITION BY node) // 2 THEN 0 ELSE 1 END AS node
  FROM (SELECT *, md5(concat_ws('|', '42', '1', CAST(node AS VARCHAR), CAST(CAST(source IS NULL AS INT) AS VARCHAR), coalesce(source, ''), CAST(number AS VARCHAR))) AS draw FROM tree1)),
tree3 AS (
  SELECT source, number, node * 2 + CASE WHEN row_number() OVER (PARTITION BY node ORDER BY draw, source NULLS LAST, number)
    <= count(*) OVER (PARTITION BY node) // 2 THEN 0 ELSE 1 END AS node
  FROM (SELECT *, md5(concat_ws('|', '42', '2', CAST(node AS VARCHAR), CAST(CAST(source IS NULL AS INT) AS VARCHAR), coalesce(source, ''), CAST(number AS VARCHAR))) AS draw FROM tree2)),
tree4 AS (
  SELECT source, number, node * 2 + CASE WHEN row_number() OVER (PARTITION BY node ORDER BY draw, source NULLS LAST, number)
    <= count(*) OVER (PARTITION BY node) // 2 THEN 0 ELSE 1 END AS node
  FROM (SELECT *, md5(concat_ws('|', '42', '3', CAST(node AS VARCHAR), CAST(CAST(source IS NULL AS INT) AS VARCHAR), coalesce(source, ''), CAST(number AS VARCHAR))) AS draw FROM tree3)),
quotas AS (SELECT source, node AS shard, count(*) AS n FROM tree4 GROUP BY ALL),
bounds AS (
  SELECT source, shard, n, sum(n) OVER (PARTITION BY source ORDER BY shard) - n AS low, sum(n) OVER (PARTITION BY source ORDER BY shard) AS high FROM quotas),
placed AS (
  SELECT r.*, t.source_size, t.target, t.whole, t.rest, t.block, t.pass_blocks,
         coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.place, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
         row_number() OVER () AS id
  FROM rows r JOIN blocks t ON r.source IS NOT DISTINCT FROM t.source),
taken AS (
  SELECT *, CAST(CASE WHEN size > 0 THEN whole + CASE WHEN 2 * start + size < 2 * rest THEN 1 ELSE 0 END ELSE 0 END AS INT) AS passes FROM placed),
copies AS (
  SELECT c.id, string_agg(CAST(b.shard AS VARCHAR), ',' ORDER BY p) AS shards, string_agg(substr(md5(concat_ws('|', c.place, CAST(p AS VARCHAR))), 1, 16), ',' ORDER BY p) AS places
  FROM (SELECT *, unnest(range(passes)) AS p FROM taken) c JOIN bounds b ON c.source IS NOT DISTINCT FROM b.source
    AND p * pass_blocks + start // block >= b.low AND p * pass_blocks + start // block < b.high
  GROUP BY c.id)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target, CAST(size * passes AS BIGINT) AS taken,
       coalesce(shards, '') AS shards, coalesce(places, '') AS places
FROM taken LEFT JOIN copies USING (id)
"""


def queries() -> dict[str, Query]:
    return {
        "pipeline": _pipeline,
        "op1_sharding": op1_sharding,
        "op2_simhash": op2_simhash,
        "op3_packing": op3_packing,
        "op4_token_store": op4_token_store,
        "op5_weighted_sampling": op5_weighted_sampling,
        "op6_mixing": op6_mixing,
        "op7_ann": op7_ann,
        "op8_quality": op8_quality,
        "op9_url_filter": op9_url_filter,
        "op10_token_counts": op10_token_counts,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_whitening": op12_whitening,
        "op13_exact_dedup": op13_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": OP6_SQL, "op9_url_filter": OP9_SQL, "op13_exact_dedup": OP13_SQL}
