"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, centroids, exact_dedup, image_copies, line_dedup, merkle, mixing, ngram_join, substring_dedup, toxicity, unigram, url_filter, warc
from .common import discard, remove, scratch_path, table, written

#: The rules of the url contract: (host, path, verdict).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

#: The vocabulary of the tokenizer query; it stays where it is installed.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def op1_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: edited pictures of every row whose id is divisible by 20. Index: the pictures of all rows. One row per row:
    its class on the index side and, for query rows, the classes that their picture copies."""
    rows = table(spark, sf_dir, "embeddings")
    queries = image_copies.rendered(rows.where("vec_id % 20 = 0"), edited=True)
    pairs, members = image_copies.find_copies(queries, image_copies.rendered(rows))
    found = pairs.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("image_id", "votes", "turn", "scale", "dx", "dy"))).alias("copies"))
    asked = members.where("side = 'query'").join(found, F.col("class_id") == F.col("query_id"), "left").select(F.col("image_id").alias("asked_id"), "copies")
    index = members.where("side = 'index'").select(F.col("image_id").alias("vec_id"), "class_id")
    none = F.expr("cast(array() as array<struct<image_id: bigint, votes: bigint, turn: int, scale: double, dx: int, dy: int>>)")
    out = index.join(asked, index["vec_id"] == asked["asked_id"], "left")
    return out.select("vec_id", "class_id", F.col("asked_id").isNotNull().alias("is_query"), F.coalesce("copies", none).alias("copies"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, whole=True)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "lang", "text"), model)
    return scored.select(
        "doc_id", toxicity.held_out().alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.3).cast("int").alias("predicted"), toxicity.decided(scored, model).alias("rejected")
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    index = written(warc.read_index(spark, folder), "index")
    remove(spark, folder)
    merged = written(warc.merge_index(index), "captures")
    discard(index)
    return warc.resolved(warc.in_history(merged)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "position"
    )


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.curriculum(table(spark, sf_dir, "documents"))
    return mixing.in_order(plan.select("doc_id", "size", "source_size", "target", "taken", "position"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str, model: str = TOKENIZER) -> DataFrame:
    return unigram.tokenize(table(spark, sf_dir, "documents"), unigram.load(model))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = byte_bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return byte_bpe.tokenize(table(spark, sf_dir, "documents"), vocabulary)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_image_copies": op1_image_copies,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_warc": op5_warc,
    "op6_ngram_join": op6_ngram_join,
    "op7_url_filter": op7_url_filter,
    "op8_mixing": op8_mixing,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_merkle": op11_merkle,
    "op12_centroids": op12_centroids,
    "op13_byte_bpe": op13_byte_bpe,
}

SQL: dict[str, str] = {
    "op2_exact_dedup": r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY ALL)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)
""",
    "op5_warc": r"""
WITH p AS (
  SELECT page_id, url, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
         min(CASE WHEN strlen(coalesce(html, '')) >= 100 THEN page_id END) OVER (PARTITION BY sha256(coalesce(html, ''))) AS first_id
  FROM pages)
SELECT *, row_number() OVER (ORDER BY url_key, captured, page_id NULLS FIRST) AS position FROM (
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to,
       CASE WHEN url LIKE '%://%' THEN
         array_to_string(list_reverse(string_split(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.')), ',')
         || ')' || regexp_extract(url, '://[^/?#]*([^#]*)', 1) ELSE '' END AS url_key,
       strftime(make_timestamp((1600000000 + page_id % 100000000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured
FROM p)
""",
    "op7_url_filter": r"""
WITH p AS (
  SELECT page_id,
         CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/'
  END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
""",
    "op8_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS o, md5(coalesce(text, '')) AS tie
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS k FROM s),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][k % 3 + 1] AS w, source_size * 2.0::DOUBLE AS top FROM k),
l AS (
  SELECT *, (sum(source_size) OVER ()::BIGINT * 1.5::DOUBLE - coalesce(sum(top) OVER b, 0))
            / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY top / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, k,
         CASE WHEN level * w >= top THEN top
              ELSE w * (SELECT level FROM l WHERE NOT level * w >= top ORDER BY top / w, k LIMIT 1) END AS target
  FROM l),
c AS (
  SELECT d.*, source_size, target, k, round(target)::BIGINT AS asked,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (SELECT *, CASE WHEN source_size > 0 THEN asked // source_size ELSE 0 END AS passes FROM c),
e AS (SELECT *, (passes * size + greatest(0, least(size, asked - passes * source_size - before)))::BIGINT AS taken FROM n),
u AS (SELECT *, least(1.0::DOUBLE, (before + least(size, taken) / 2.0::DOUBLE) / target) AS share FROM e)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN round(CASE k % 3
         WHEN 0 THEN (sqrt(2.25 + 2 * -1.0::DOUBLE * share) - 1.5) / -1.0
         WHEN 1 THEN share
         ELSE CASE WHEN share >= 0.25 THEN 0.5 + (sqrt(0.25 + 2 * 4.0::DOUBLE * (share - 0.25)) - 0.5) / 4.0 ELSE share / 0.5 END
       END, 9) END AS position
FROM u
""",
}


def clustering_sql(rounds: int) -> str:
    """The rounds of a clustering, one after the other."""
    steps = [r"""e AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT v, sha256('3:' || vec_id::VARCHAR) AS h FROM e ORDER BY h NULLS LAST, v LIMIT 8),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS cluster, v AS c FROM s)"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT rid, vec_id, v, b.d AS distance, b.k AS cluster FROM (
    SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': d, 'k': cluster}}) AS b FROM (
      SELECT rid, vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM e, c{i}) GROUP BY rid))""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT o.cluster, coalesce(n.c, o.c) AS c FROM c{i} o LEFT JOIN (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS c FROM (
      SELECT cluster, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{i}, range(1, 65) r(i) GROUP BY cluster, i) GROUP BY cluster) n ON o.cluster = n.cluster)""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, a.cluster::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia,
       sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.cluster = c.cluster"""


SQL["op12_centroids"] = clustering_sql(centroids.ROUNDS)
def merkle_sql() -> str:
    """Levels, then each row's siblings level by level, folded from its leaf."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    head = " || ".join(map(field, ("doc_id", "source", "lang", "n_chars")))
    crc = "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
    return rf"""
WITH RECURSIVE l AS (
  SELECT doc_id, source, sha256({head} || {field("text")}) AS leaf,
         sha256({head} || CASE WHEN {crc} % 2 = 0 THEN {field("replace(text, chr(10), '')")} ELSE {field("text")} END) AS tampered
  FROM documents),
d AS MATERIALIZED (
  SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, tampered) - 1 AS idx,
         count(*) OVER (PARTITION BY source) AS n FROM l),
up AS (
  SELECT source, 0 AS lvl, idx, leaf AS digest, n FROM d
  UNION ALL
  SELECT source, lvl + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3 FROM up WHERE n > 1 GROUP BY source, lvl, idx // 3, n),
sub AS MATERIALIZED (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1),
over_ AS (
  SELECT 0 AS lvl, idx, subroot AS digest, n FROM sub
  UNION ALL
  SELECT lvl + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3 FROM over_ WHERE n > 1 GROUP BY lvl, idx // 3, n),
steps AS MATERIALIZED (
  SELECT u.source, u.lvl, u.idx, coalesce(string_agg(v.digest, '' ORDER BY v.idx) FILTER (v.idx < u.idx), '') AS l,
         coalesce(string_agg(v.digest, '' ORDER BY v.idx) FILTER (v.idx > u.idx), '') AS r
  FROM up u LEFT JOIN up v ON u.source IS NOT DISTINCT FROM v.source AND u.lvl = v.lvl AND u.idx // 3 = v.idx // 3 AND u.idx <> v.idx
  WHERE u.n > 1 GROUP BY ALL),
steps_over AS MATERIALIZED (
  SELECT u.lvl, u.idx, coalesce(string_agg(v.digest, '' ORDER BY v.idx) FILTER (v.idx < u.idx), '') AS l,
         coalesce(string_agg(v.digest, '' ORDER BY v.idx) FILTER (v.idx > u.idx), '') AS r
  FROM over_ u LEFT JOIN over_ v ON u.lvl = v.lvl AND u.idx // 3 = v.idx // 3 AND u.idx <> v.idx WHERE u.n > 1 GROUP BY ALL),
way AS (
  SELECT d.rid, s.lvl, s.l, s.r FROM d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source AND s.idx = d.idx // (3 ** s.lvl)::BIGINT
  UNION ALL
  SELECT d.rid, 1000 + s.lvl, s.l, s.r FROM d JOIN sub ON d.source IS NOT DISTINCT FROM sub.source JOIN steps_over s ON s.idx = sub.idx // (3 ** s.lvl)::BIGINT),
ways AS (SELECT rid, list({{'l': l, 'r': r}} ORDER BY lvl) AS path, string_agg(l || r, '' ORDER BY lvl) AS siblings FROM way GROUP BY rid)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM (
  SELECT d.doc_id, leaf, subroot, siblings, (SELECT digest FROM over_ WHERE n = 1) AS root,
         list_reduce(list_prepend({{'l': tampered, 'r': ''}}, coalesce(path, [])), lambda a, b: {{'l': sha256(b.l || a.l || b.r), 'r': ''}}).l AS folded_root
  FROM d JOIN sub ON d.source IS NOT DISTINCT FROM sub.source LEFT JOIN ways ON d.rid = ways.rid)"""


SQL["op11_merkle"] = merkle_sql()
