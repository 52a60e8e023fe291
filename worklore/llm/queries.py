"""Registered queries of this subpackage, with SQL where SQL can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from worklore import session
from worklore.llm import (
    alignment,
    bpe,
    centroids,
    host_quality,
    line_windows,
    nearest,
    ngram_join,
    packing,
    sharding,
    token_counts,
    token_records,
    url_templates,
    vector_dedup,
)
from worklore.llm.shipping import ship

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_folder(spark: SparkSession, name: str) -> str:
    return f"{session.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = own_folder(spark, "records")
    token_records.write_records(table(spark, sf_dir, "documents"), folder, BYTE_BPE)
    index = token_records.write_index(spark, folder, f"{folder}.index")
    return token_records.with_starts(index).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE, 2048)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"), n=4, percent=85)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.code_digests(table(spark, sf_dir, "documents"), WORD_BPE)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), BYTE_BPE, own_folder(spark, "token-counts"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_quality.judge(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_windows.drop_repeated_passages(documents)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


URL_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, good): a page shows the document whose number ends its path."""
    number = F.regexp_extract(url_templates.path_of(F.col("url")), r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    shown = pages.select("page_id", number.try_cast("long").alias("doc_id")).where("doc_id is not null")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return shown.join(labels.select("doc_id", good.alias("good")), "doc_id").select("page_id", "good")


def op10_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_templates.judge_urls(pages, page_labels(pages, table(spark, sf_dir, "labels")), URL_RULES)


def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.similar_vectors(table(spark, sf_dir, "embeddings"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align_documents(documents, BYTE_BPE, PIECE_BPE).drop("text")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings")).drop("measured")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_records": op1_token_records,
    "op2_packing": op2_packing,
    "op3_ngram_join": op3_ngram_join,
    "op4_bpe": op4_bpe,
    "op5_token_counts": op5_token_counts,
    "op6_nearest": op6_nearest,
    "op7_quality_rules": op7_quality_rules,
    "op8_line_dedup": op8_line_dedup,
    "op9_sharding": op9_sharding,
    "op10_url_templates": op10_url_templates,
    "op11_near_vectors": op11_near_vectors,
    "op12_alignment": op12_alignment,
    "op13_centroids": op13_centroids,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP7_SQL = rf"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
c AS (
 SELECT doc_id, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines,
        words, [array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)] AS runs
 FROM w),
g AS (SELECT doc_id, u.run, count(*) AS times, list(u.at) AS places
      FROM (SELECT doc_id, unnest([{{'run': runs[i], 'at': i}} FOR i IN range(1, len(runs) + 1)]) AS u FROM c) GROUP BY 1, 2),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
        SELECT doc_id, unnest([a + k FOR k IN range(5)]) AS p FROM (SELECT doc_id, unnest(places) AS a FROM g WHERE times > 1)) GROUP BY 1),
b AS (
 SELECT c.doc_id, source, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        coalesce(r.n, 0) AS n_repeat_words FROM c LEFT JOIN r ON c.doc_id = r.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS failed FROM f GROUP BY 1),
t AS (SELECT sum(n) AS n_all, sum(failed) / sum(n) AS mean, count(*) AS hosts, sum(n * n) AS squares FROM h),
s AS (SELECT mean, hosts, n_all, squares, sum(n * (failed / n - mean) ** 2) AS apart FROM h, t GROUP BY ALL),
p AS (SELECT mean, CASE WHEN hosts > 1 AND (apart - (hosts - 1) * mean * (1 - mean)) / (n_all - squares / n_all) > 1e-12
        THEN greatest(mean * (1 - mean) / ((apart - (hosts - 1) * mean * (1 - mean)) / (n_all - squares / n_all)) - 1, 1.0)
        ELSE 1e9 END AS strength FROM s),
v AS (SELECT source, (failed + mean * strength) / (n + strength) > 0.5 AS refused FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT refused AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""

OP8_SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
a AS (SELECT *, [i FOR i IN range(1, len(lines) + 1) IF regexp_matches(lines[i], '[^\x20\x09-\x0D]')] AS pos FROM l),
w AS (SELECT doc_id, unnest([{'place': k, 'win': [lines[pos[k]], lines[pos[k + 1]], lines[pos[k + 2]]]} FOR k IN range(1, len(pos) - 1)]) AS u FROM a),
o AS (SELECT doc_id, u.place AS place, row_number() OVER (PARTITION BY u.win ORDER BY doc_id, u.place) AS nth FROM w),
c AS (SELECT doc_id, list_distinct(flatten(list([place, place + 1, place + 2]))) AS covered FROM o WHERE nth > 1 GROUP BY 1),
g AS (SELECT a.doc_id, text, lines, [pos[p] FOR p IN covered] AS gone FROM a LEFT JOIN c ON a.doc_id = c.doc_id)
SELECT doc_id, CASE WHEN gone IS NULL THEN text
         ELSE coalesce(array_to_string([lines[i] FOR i IN range(1, len(lines) + 1) IF NOT list_contains(gone, i)], chr(10)), '') END AS text,
       coalesce(len(lines), 0) AS n_lines, coalesce(len(gone), 0) AS n_removed FROM g
"""



def _round_sql(i: int) -> str:
    return f"""
d{i} AS (SELECT vec_id, q, cluster, list_sum([(q[i] - c[i]) * (q[i] - c[i]) FOR i IN range(1, 65)]) AS d FROM v, c{i}),
a{i} AS (SELECT * FROM d{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) = 1),"""


def _mean_sql(i: int) -> str:
    return f"""
s{i} AS (SELECT cluster, i, sum(q[i]) AS s, count(*) AS n FROM a{i}, range(1, 65) AS t(i) GROUP BY ALL),
m{i} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{i} GROUP BY 1),
c{i + 1} AS (SELECT c{i}.cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} ON c{i}.cluster = m{i}.cluster),"""


OP13_SQL = f"""
WITH v AS (
 SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
 WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster, q AS c FROM v ORDER BY cluster LIMIT 16),
{_round_sql(0)}{_mean_sql(0)}{_round_sql(1)}{_mean_sql(1)}{_round_sql(2)}{_mean_sql(2)}{_round_sql(3)}
e AS (SELECT cluster, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM a3 GROUP BY 1)
SELECT vec_id, CAST(a3.cluster AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, cluster_inertia,
       (SELECT CAST(sum(cluster_inertia) AS BIGINT) FROM e) AS inertia, sha256(array_to_string(c3.c, ',')) AS centroid_sha256
FROM a3 JOIN e ON a3.cluster = e.cluster JOIN c3 ON a3.cluster = c3.cluster
"""

CHECKS: dict[str, str] = {"op7_quality_rules": OP7_SQL, "op8_line_dedup": OP8_SQL, "op13_centroids": OP13_SQL}
